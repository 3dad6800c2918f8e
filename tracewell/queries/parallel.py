"""Pairs of texts and detectors' cases: turns and their answers, translations with known faults, header findings against what was expected."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators import evaluation, parallel
from tracewell.queries import ledger

MARKS = "<URL_1> <EMAIL_1>"
#: What the header checks must and must not say, by the page's policy (its number in ledger.POLICIES).
EXPECTED = [["missing policy"], [], ["policy allows inline scripts", "policy without plugins"], ["policy allows eval", "policy without plugins"], ["policy without scripts"], []]
FORBIDDEN = [["policy without base-uri"], ["missing policy", "policy allows eval"], ["policy without base-uri"], [], ["missing policy"], ["policy allows any script host"]]


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What kind of pair each turn and the next one of its conversation are."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("target"))
    pairs = c.select("conv_id", "turn", F.col("text").alias("source")).join(after, ["conv_id", "turn"])
    return parallel.classified(pairs).select("conv_id", "turn", "pair_class", F.array_join("flags", ",").alias("flags"))


def translations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a text with two placeholders, and an output with a fault by the document's number."""
    i, t = F.col("doc_id") % 8, F.concat(F.coalesce("text", F.lit("")), F.lit(f" {MARKS}"))
    out = F.when(i == 0, F.concat(F.lit("\n "), t)).when(i == 1, F.regexp_replace(t, "[0-9]+(?!>)", "")).when(i == 2, F.concat(t, F.lit(" <b>!</b>"))).when(i == 3, F.substr(t, F.lit(1), F.floor(F.length(t) / 5).cast("int")))
    out = out.when(i == 4, F.repeat(t, 5)).when(i == 5, F.replace(t, F.lit("<URL_1>"), F.lit("<URL_2>"))).when(i == 6, F.concat(t, F.lit(" jamais")))
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", t.alias("text"), out.alias("output"), F.array(*[F.lit(m) for m in MARKS.split()]).alias("placeholders"))


def translation_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problems of each document's output that patterns tell, as from English to French."""
    found = parallel.checked(translations(spark, sf_dir), "en", "fr", deep=False)
    return found.select("doc_id", F.inline("problems"))


def header_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A case a page: what its header findings should be, by its policy, and what they are."""
    i = F.col("page_id")
    by_policy = lambda lists: F.get(F.array(*[F.array(*[F.lit(x) for x in v]).cast("array<string>") for v in lists]), (i % len(lists)).cast("int"))
    found = ledger.header_findings(spark, sf_dir).groupBy("id").agg(F.collect_set("kind").alias("codes"), F.bool_or(F.col("severity") == "medium").alias("medium"))
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(i, by_policy(EXPECTED).alias("expected"), by_policy(FORBIDDEN).alias("forbidden"), (i % 6).cast("string").alias("policy"), F.when(i % 4 == 0, "heldout").otherwise("dev").alias("split"))
    return pages.join(found, F.col("page_id") == F.col("id"), "left").withColumn("level", F.when(F.col("medium"), "medium").otherwise("low"))


def header_case_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.case_summaries(header_cases(spark, sf_dir), ["policy", "split"])


def header_variant_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether pages of one policy get the same findings."""
    return evaluation.variant_groups(header_cases(spark, sf_dir), "policy")


_TRIM = r"regexp_replace({0}, '^[\t-\r ]+|[\t-\r ]+$', '', 'g')"
_COUNT = "len(regexp_extract_all({0}, '{1}'))"
_BARE = f"regexp_replace({{0}}, '{parallel.PLACEHOLDER}', ' ', 'g')"
_DIGITS = "array_to_string(list_sort(regexp_extract_all({0}, '[0-9]+')), ',')"
_NEG = {k: "(?i)" + v.replace("EDGE", r"\b").replace("'", "''") for k, v in parallel.NEGATION.items()}
_FOLD = r"regexp_replace(lower({0}), '[\t-\r ]+', ' ', 'g')"
_LISTS = lambda lists: "[" + ", ".join("[" + ", ".join(f"'{x}'" for x in v) + "]::VARCHAR[]" for v in lists) + "][page_id % 6 + 1]"
_MARK_LIST = "[" + ", ".join(f"'{m}'" for m in MARKS.split()) + "]"
_CASES = f"""f AS ({ledger.ORACLE['header_findings']}), g AS (SELECT id, list(DISTINCT kind) AS codes, bool_or(severity = 'medium') AS medium FROM f GROUP BY id),
 cases AS (SELECT page_id, (page_id % 6)::VARCHAR AS policy, CASE WHEN page_id % 4 = 0 THEN 'heldout' ELSE 'dev' END AS split, {_LISTS(EXPECTED)} AS expected, {_LISTS(FORBIDDEN)} AS forbidden, coalesce(codes, []) AS codes, coalesce(medium, false) AS raised FROM pages LEFT JOIN g ON id = page_id),
 n AS (SELECT *, len(expected) AS e, len(list_filter(expected, lambda x: list_contains(codes, x))) AS fo, len(forbidden) AS c, len(list_filter(forbidden, lambda x: list_contains(codes, x))) AS h FROM cases)"""
_RATE = "CASE WHEN ({1}) > 0 THEN floor(({0}) * 10000.0 / ({1}) + 0.5) / 10000.0::DOUBLE END"

QUERIES = {f.__name__: f for f in (turn_pairs, translation_problems, header_case_summaries, header_variant_groups)}
ORACLE = {
    "turn_pairs": f"""WITH p AS (SELECT a.conv_id, a.turn, {_TRIM.format("coalesce(a.text, '')")} AS s, {_TRIM.format("coalesce(b.text, '')")} AS t FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1),
 w AS (SELECT *, {_COUNT.format('s', parallel.WORD.replace("'", "''"))} AS sw, {_COUNT.format('t', parallel.WORD.replace("'", "''"))} AS tw FROM p),
 f AS (SELECT *, least(sw, tw) AS lo, greatest(sw, tw) AS hi, CASE WHEN s = '' OR t = '' THEN 'empty_side' WHEN NOT regexp_matches(s, '\\p{{L}}') OR NOT regexp_matches(t, '\\p{{L}}') THEN 'no_letters' WHEN contains(s, chr(65533)) OR contains(t, chr(65533)) THEN 'replacement_char' END AS why FROM w),
 o AS (SELECT *, concat_ws(',', CASE WHEN {_FOLD.format('s')} = {_FOLD.format('t')} AND sw > 3 THEN 'source_equals_target' END, CASE WHEN hi >= 6 AND lo > 0 AND hi > 3 * lo THEN 'length_ratio_gt_3' END, CASE WHEN hi >= 4 AND lo = 0 THEN 'empty_words' END) AS odd FROM f)
SELECT conv_id, turn, coalesce(why, odd) AS flags, CASE WHEN why IS NOT NULL THEN 'invalid' WHEN odd <> '' THEN 'suspected_misalignment' WHEN sw = 1 AND tw = 1 THEN 'single_word_gloss' WHEN lo <= 2 AND hi >= 6 THEN 'dictionary_definition' WHEN hi <= 2 AND lo = 1 THEN 'single_word_gloss' WHEN hi <= 4 THEN 'short_phrase' ELSE 'natural_sentence' END AS pair_class FROM o""",
    "translation_problems": f"""WITH d AS (SELECT doc_id, doc_id % 8 AS k, coalesce(text, '') || ' {MARKS}' AS t FROM documents),
 x AS (SELECT *, CASE k WHEN 0 THEN chr(10) || ' ' || t WHEN 1 THEN regexp_replace(t[:len(t) - {len(MARKS)}], '[0-9]+', '', 'g') || '{MARKS}' WHEN 2 THEN t || ' <b>!</b>' WHEN 3 THEN t[:len(t) // 5] WHEN 4 THEN repeat(t, 5) WHEN 5 THEN replace(t, '<URL_1>', '<URL_2>') WHEN 6 THEN t || ' jamais' ELSE '' END AS o FROM d),
 m AS (SELECT *, regexp_extract_all(o, '{parallel.PLACEHOLDER}') AS marks, {_BARE.format('t')} AS tb, {_BARE.format('o')} AS ob, regexp_matches(t, '{_NEG['en']}') AS n1, regexp_matches(o, '{_NEG['fr']}') AS n2 FROM x),
 w AS (SELECT *, {_COUNT.format('tb', parallel._TEXT_WORD)} AS iw, {_COUNT.format('ob', parallel._TEXT_WORD)} AS ow FROM m), u AS (SELECT * FROM w WHERE {_TRIM.format('o')} <> ''),
 p AS (SELECT *, len(list_filter(marks, lambda y: y = mark)) AS times FROM (SELECT *, unnest({_MARK_LIST}) AS mark FROM u))
SELECT doc_id, 'empty_output' AS kind, '' AS detail FROM w WHERE {_TRIM.format('o')} = '' UNION ALL SELECT doc_id, CASE WHEN times = 0 THEN 'lost' ELSE 'duplicated' END, mark FROM p WHERE times <> 1
UNION ALL SELECT doc_id, 'unknown_placeholder', mark FROM (SELECT DISTINCT doc_id, unnest(marks) AS mark FROM u) WHERE NOT list_contains({_MARK_LIST}, mark)
UNION ALL SELECT doc_id, 'stray_markup', '' FROM u WHERE regexp_matches(ob, '{parallel.STRAY_MARKUP}') AND NOT regexp_matches(tb, '{parallel.STRAY_MARKUP}') UNION ALL SELECT doc_id, 'too_long', '' FROM u WHERE len(o) > len(t) * {parallel.MOST_LENGTH} + {parallel.MORE_LENGTH}
UNION ALL SELECT doc_id, 'too_short', '' FROM u WHERE iw >= {parallel.SHORT_WORDS} AND ow < iw * {parallel.LEAST_WORDS}::DOUBLE UNION ALL SELECT doc_id, 'not_translated', '' FROM u WHERE iw >= {parallel.COPIED_WORDS} AND {_TRIM.format('lower(o)')} = {_TRIM.format('lower(t)')}
UNION ALL SELECT doc_id, 'negation_mismatch', CASE WHEN n1 THEN 'lost' ELSE 'added' END FROM u WHERE n1 <> n2 UNION ALL SELECT doc_id, 'number_mismatch', '' FROM u WHERE {_DIGITS.format('tb')} <> {_DIGITS.format('ob')}""",
    "header_case_summaries": f"WITH {_CASES}, s AS (SELECT policy, split, count(*) AS cases, count(*) FILTER (WHERE e = fo AND h = 0) AS passed, sum(e)::BIGINT AS expected, sum(fo)::BIGINT AS found, sum(c)::BIGINT AS forbidden_checks, sum(h)::BIGINT AS forbidden_hits, count(*) FILTER (WHERE e = 0) AS legit, count(*) FILTER (WHERE e = 0 AND raised) AS legit_raised FROM n GROUP BY GROUPING SETS ((), (policy), (split))) SELECT *, {_RATE.format('passed', 'cases')} AS pass_rate, {_RATE.format('found', 'expected')} AS recall, {_RATE.format('legit_raised', 'legit')} AS legit_false_positive_rate FROM s",
    "header_variant_groups": f"WITH {_CASES} SELECT policy, count(*) AS members, count(DISTINCT array_to_string(list_sort(codes), ',')) AS code_sets, count(DISTINCT array_to_string(list_sort(codes), ',')) = 1 AS consistent FROM cases GROUP BY policy",
}
