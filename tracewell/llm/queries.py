"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracewell.llm import collocations, exact, langid, lattice, media, mixing, negatives, pii, quality, simhash, substrings, token_ids, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_langid": langid.op1_langid,
    "op2_quality": quality.op2_quality,
    "op3_pii": pii.op3_pii,
    "op4_token_ids": token_ids.op4_token_ids,
    "op5_simhash": simhash.op5_simhash,
    "op6_media": media.op6_media,
    "op7_mixing": mixing.op7_mixing,
    "op8_substrings": substrings.op8_substrings,
    "op9_warc": warc.op9_warc,
    "op10_sentencepiece": lattice.op10_sentencepiece,
    "op11_exact": exact.op11_exact,
    "op12_collocations": collocations.op12_collocations,
    "op13_negatives": negatives.op13_negatives,
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: SQL can't express trained models (1, 2, 3), tokenizers and lattices (4, 10), XXH64 fingerprints (5) and PNG (6); tests/llm compares those with brute force.
ORACLE_SQL: dict[str, str] = {
    "op7_mixing": f"""
WITH d AS (SELECT doc_id, source, len({_WORDS})::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS turn FROM d GROUP BY source),
w AS (SELECT *, CASE turn WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::DOUBLE AS weight, source_size * 3.0::DOUBLE AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER turns, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER turns, 0)) AS level
      FROM w WINDOW turns AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, min(CASE WHEN level <= cap / weight THEN cap / weight END) OVER () AS free_from FROM l),
t AS (SELECT source, source_size, CASE WHEN source_size = 0 THEN 0 ELSE least(cap, coalesce((SELECT g.level FROM f g WHERE g.cap / g.weight = f.free_from ORDER BY g.source NULLS LAST LIMIT 1) * weight, cap)) END AS target FROM f),
k AS (SELECT d.source, length(bin(greatest(size, 1))) - 1 AS class, sum(size)::DOUBLE AS class_size, 2.0::DOUBLE ** ((length(bin(greatest(size, 1))) - 1) // 2) AS odds FROM d GROUP BY ALL),
v AS (SELECT k.*, source_size, target, floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END) AS whole, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS share FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source),
x AS (SELECT *, (share - whole) * source_size AS wanted FROM v),
y AS (SELECT *, (wanted - coalesce(sum(class_size) OVER longer, 0)) / nullif(sum(odds * class_size) OVER (PARTITION BY source) - coalesce(sum(odds * class_size) OVER longer, 0), 0) AS level
      FROM x WINDOW longer AS (PARTITION BY source ORDER BY class DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
z AS (SELECT *, max(CASE WHEN odds * level < 1 THEN class END) OVER (PARTITION BY source) AS free_class FROM y),
p AS (SELECT z.source, z.class, z.source_size, z.target, z.whole, z.wanted, CASE WHEN z.wanted <= 0 THEN 0 ELSE least(1, greatest(0, coalesce(g.level * z.odds, 1))) END AS part
      FROM z LEFT JOIN z g ON g.source IS NOT DISTINCT FROM z.source AND g.class = z.free_class),
m AS (SELECT doc_id, d.source, size, source_size, target, whole, part, wanted, (('0x' || md5(doc_id::VARCHAR)[1:13])::BIGINT + 0.5::DOUBLE) / 4503599627370496 AS u
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source AND length(bin(greatest(d.size, 1))) - 1 = p.class),
o AS (SELECT *, CASE WHEN part >= 1 THEN 0 WHEN part > 0 THEN (u / (1 - u)) / (part / (1 - part)) END AS rank FROM m),
c AS (SELECT *, CASE WHEN rank IS NOT NULL THEN sum(CASE WHEN rank IS NOT NULL THEN size END) OVER (PARTITION BY source ORDER BY rank NULLS LAST, doc_id ROWS UNBOUNDED PRECEDING) END AS upto FROM o)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN rank IS NOT NULL AND upto - size / 2 <= wanted THEN 1 ELSE 0 END))::BIGINT AS taken FROM c""",
    "op8_substrings": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
g AS (SELECT doc_id, s, array_to_string(w[s : s + 12], ' ') AS window_words FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS s FROM d)),
l AS (SELECT window_words, min(doc_id) AS least FROM g GROUP BY window_words),
r AS (SELECT DISTINCT doc_id, s + unnest(range(0, 13)) AS k FROM g JOIN l USING (window_words) WHERE least < doc_id),
k AS (SELECT e.doc_id, count(*) AS n_kept, string_agg(e.word, ' ' ORDER BY e.k) AS kept FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM d) e ANTI JOIN r ON e.doc_id = r.doc_id AND e.k = r.k GROUP BY e.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n_kept, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON d.doc_id = k.doc_id""",
    "op9_warc": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT payload_digest, min(page_id) AS least FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, p.payload_digest, CASE WHEN least IS NOT NULL AND page_id IS DISTINCT FROM least THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id IS DISTINCT FROM least THEN least END AS refers_to
FROM p LEFT JOIN m ON p.payload_digest = m.payload_digest""",
    "op11_exact": """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, text_sha256
FROM d WINDOW same AS (PARTITION BY text_sha256)""",
    "op12_collocations": r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
e AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS s FROM w),
g AS (SELECT lang, s, w[s] AS w1, w[s + 1] AS w2, w[s + 2] AS w3 FROM e),
f AS (SELECT lang, 1 AS k, w1 AS phrase, w1, NULL AS w2, NULL AS w3, count(*) AS n FROM g GROUP BY lang, w1
      UNION ALL SELECT lang, 2, w1 || ' ' || w2, w1, w2, NULL, count(*) FROM g WHERE w2 IS NOT NULL GROUP BY lang, w1, w2
      UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3, w1, w2, w3, count(*) FROM g WHERE w3 IS NOT NULL GROUP BY lang, w1, w2, w3),
t AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE k > 1 AND n >= 10),
u AS (SELECT lang, phrase, n AS a, 1 AS cut, w1 AS left_part, concat_ws(' ', w2, w3) AS rest FROM c UNION ALL SELECT lang, phrase, n, 2, w1 || ' ' || w2, w3 FROM c WHERE k = 3),
x AS (SELECT u.lang, u.phrase, a, cut, l.n AS l, r.n AS r, (1000000::HUGEINT * a * a // (l.n::HUGEINT * r.n))::BIGINT AS score FROM u JOIN f l ON l.lang = u.lang AND l.phrase = left_part JOIN f r ON r.lang = u.lang AND r.phrase = rest),
b AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
i AS (SELECT lang, phrase, max(n) AS longer FROM (SELECT lang, n, unnest([w1 || ' ' || w2, w2 || ' ' || w3]) AS phrase FROM c WHERE k = 3) GROUP BY lang, phrase)
SELECT b.lang, row_number() OVER best AS rank, b.phrase, a, l, r, t.n, score
FROM b JOIN t ON t.lang = b.lang LEFT JOIN i ON i.lang = b.lang AND i.phrase = b.phrase WHERE longer IS NULL OR 100 * longer < 50 * a
WINDOW best AS (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) QUALIFY rank <= 2000""",
    "op13_negatives": """
WITH q AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
      WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score FROM q a JOIN q b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER best)::INTEGER AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW best AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) QUALIFY row_number() OVER best <= 3""",
}
