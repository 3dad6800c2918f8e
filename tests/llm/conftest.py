"""A small corpus with every awkward row, and the same rows for brute force."""

from __future__ import annotations

import pytest

LINE = "the quick brown fox jumps over the lazy dog and then it runs far away from here"
SHARED = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma"


def corpus() -> list[tuple]:
    """(doc_id, text, lang, source, n_chars)"""
    texts = [
        f"{LINE} one two three four five. Contact me at jane.doe@mail.example.com or +1 (365) 555-0101 today.",
        f"{LINE} one two three four five. Contact me at jane.doe@mail.example.com or +1 (365) 555-0101 today.",
        f"{LINE} one two three four six. Contact me at jane.doe@mail.example.com or +1 (365) 555-0101 today.",
        None,
        "",
        "   \n\t ",
        "word",
        "12345 67890 !!!",
        f"first {SHARED} last",
        f"before {SHARED} after {SHARED} end",
        "\n".join([LINE] * 30),
        f"le chat est sur la table avec une pomme et {SHARED} pour les enfants",
        "日本語のテキスト without blanks 😀 and more",
        "card 4111 1111 1111 1111 ip 10.0.0.256 and 192.168.1.10 a@b.c_d@e.f x@y@z.com 1.2.3.4.5.6.7.8",
        "token = \"0641917ea4e9feb9cda83477b5aa\" password=d9f3929e83c8655244 end of it all",
        "a b c " * 3000,
        "<|endoftext|> it's we'll  double  blanks\r\nand\x0bvertical x y ﬁ",
        "der hund und die katze sind in dem haus mit der maus und dem ball",
    ]
    rows = [(i, t, ["en", "en", "en", None, "en", "en", "en", "en", "en", "en", "en", "fr", "en", "en", "en", "en", "en", "de"][i], ["s1", "s1", "s2", None, "s2", "s2", "s3", "s3", "s1", "s2", "s1", "s3", None, "s1", "s2", "s1", "s3", "s2"][i], len(t or "")) for i, t in enumerate(texts)]
    rows += [(0, rows[0][1], "en", "s1", rows[0][4]), (9, "another text with a known number", "en", "s2", 32), (None, f"{LINE} nameless", "en", "s1", 10), (None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def rows() -> list[tuple]:
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """With extra columns whose names the operators use inside."""
    extra = "id long, text2 string, size int, source_size int, fp long, n int, rank double, score double, lang_pred string, token_ids string, kept boolean"
    return spark.createDataFrame([(*r, 1, "x", 2, 3, 4, 5, 6.0, 7.0, "zz", "t", True) for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {extra}")


@pytest.fixture(scope="session")
def none(docs):
    return docs.where("false")
