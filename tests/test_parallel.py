"""Kinds of pairs, problems of translations and summaries of cases on small literal inputs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tracewell.operators import evaluation, parallel, spelling
from tracewell.queries import parallel as queries

PAIRS = [
    ("", "x", "invalid", ["empty_side"]), (None, "x", "invalid", ["empty_side"]), ("12 34", "dis", "invalid", ["no_letters"]), ("a�", "b", "invalid", ["replacement_char"]),
    ("Wait here a  little", "wait here a little ", "suspected_misalignment", ["source_equals_target"]), ("one two", "a b c d e f g", "suspected_misalignment", ["length_ratio_gt_3"]), ("one two", "a b c d e f", "dictionary_definition", []),
    ("lakaz", "house", "single_word_gloss", []), ("lakaz", "a house", "single_word_gloss", []), ("mo lakaz", "my house", "short_phrase", []), ("mo lakaz la", "that house of mine", "short_phrase", []), ("mo pe al lakaz aster", "I am going home now", "natural_sentence", []),
]
CASES = [
    ("pay <URL_1> 200 now", "", ["<URL_1>"], [("empty_output", "")]),
    ("pay <URL_1> now please", "peye aster <URL_1> mersi", ["<URL_1>"], []),
    ("pay <URL_1> now please", "peye aster mersi dimoun", ["<URL_1>"], [("lost", "<URL_1>")]),
    ("pay <URL_1> now please", "peye <URL_1> <URL_1> <URL_2> aster mersi", ["<URL_1>"], [("duplicated", "<URL_1>"), ("unknown_placeholder", "<URL_2>")]),
    ("do not pay now please", "peye aster mersi dimoun", [], [("negation_mismatch", "lost")]),
    ("do not pay 20 now", "pa peye 30 aster dimoun", [], [("number_mismatch", "")]),
    ("see you in town tomorrow", "nou pu zot dan lavil <b>", [], [("stray_markup", ""), ("nonstandard_spelling", "")]),
    ("see you in town tomorrow then", "zot", [], [("too_short", "")]),
    ("see you in town tomorrow", " See you in Town tomorrow", [], [("not_translated", ""), ("wrong_language", "en")]),
    ("short", "peye aster mersi " * 10, [], [("too_long", "")]),
    ("visit us in town today", "vini dan labank https://a.example.com/x aster", [], [("unsupported_entity", "https://a.example.com/x")]),
]


def test_pairs(spark):
    d = spark.createDataFrame([(k, s, t) for k, (s, t, *_) in enumerate(PAIRS)], "k int, source string, target string")
    got = {r["k"]: (r["pair_class"], r["flags"]) for r in parallel.classified(d).collect()}
    assert got == {k: (c, f) for k, (_, _, c, f) in enumerate(PAIRS)}


def test_translations(spark):
    d = spark.createDataFrame([(k, t, o, p) for k, (t, o, p, _) in enumerate(CASES)], "k int, text string, output string, placeholders array<string>")
    got = {r["k"]: [tuple(x) for x in r["problems"]] for r in parallel.checked(d, "en", "mfe").collect()}
    assert got == {k: want for k, (*_, want) in enumerate(CASES)}


def test_nulls_and_empty_tables(spark):
    schema = "k int, text string, output string, placeholders array<string>"
    rows = parallel.checked(spark.createDataFrame([(1, None, None, None), (2, None, "mersi", None)], schema), "en", "mfe").collect()
    assert [[x["kind"] for x in r["problems"]] for r in sorted(rows)] == [["empty_output"], []]
    assert parallel.checked(spark.createDataFrame([], schema), "en", "fr").count() == 0
    assert parallel.classified(spark.createDataFrame([], "source string, target string")).count() == 0


def test_problems_are_found_once(spark):
    plan = queries.translation_problems(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    # Their patterns stand in one place, not in a filter on their number too.
    assert plan.count(parallel.STRAY_MARKUP) == 2
    assert r"[\t-\r ]+\z" not in plan


@pytest.mark.parametrize("language", list(parallel.NEGATION))
def test_denials_equal_their_plain_patterns(spark, language):
    rng = random.Random(language)
    parts = ["not", "NO", "nobody", "n't", "N’T", "can", "cannot", "ne", "n'", "n’", "pas", "aucune", "Pann", "zamai", "ſans", "é", "_", "7", "x", " ", ".", "'", "\n", "\u212a"]
    d = spark.createDataFrame([("".join(rng.choice(parts) for _ in range(rng.randint(0, 5))),) for _ in range(3000)] + [(None,)], "t string")
    plain = F.rlike("t", F.lit("(?i)" + parallel.NEGATION[language].replace("EDGE", spelling.EDGE)))
    got = d.select("t", plain.alias("plain"), parallel._denies(F.col("t"), language).alias("quick"))
    assert got.where("NOT plain <=> quick").count() == 0 and got.where("plain").count() > 100 and got.where("NOT plain").count() > 100


def test_blanks_are_taken_off_both_ends_only(spark):
    texts = ["", " ", "\t\n\v\f\r a \t b\u00a0\r\n", "\u00a0 a", "a" + " " * 5 + "b", None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in texts], "t string").select(parallel._trimmed(F.col("t"))).collect()]
    assert got == ["", "", "a \t b\u00a0", "\u00a0 a", "a     b", None]


def test_case_summaries(spark):
    rows = [("a", ["X"], ["Y"], ["X", "Z"], "high"), ("a", ["X", "W"], [], ["X"], "low"), ("b", [], ["Y"], ["Y"], "medium"), ("b", None, None, None, "low")]
    d = spark.createDataFrame(rows, "family string, expected array<string>, forbidden array<string>, codes array<string>, level string")
    got = {r["family"]: r for r in evaluation.case_summaries(d, ["family"]).collect()}
    assert (got[None]["cases"], got[None]["passed"], got[None]["recall"], got[None]["forbidden_hits"], got[None]["forbidden_checks"], got[None]["legit_false_positive_rate"]) == (4, 2, pytest.approx(0.6667), 1, 2, 0.5)
    assert (got["a"]["pass_rate"], got["a"]["legit_false_positive_rate"], got["b"]["recall"]) == (0.5, None, None)
    groups = {r["family"]: (r["members"], r["consistent"]) for r in evaluation.variant_groups(d, "family").collect()}
    assert groups == {"a": (2, False), "b": (2, False)}
