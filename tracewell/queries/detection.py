"""Links, imitations and phrases in generated messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import hosts as h
from tracewell.operators import lexicon, links
from tracewell.sources import messages as src

REGISTRY = [(0, "North Bank", "northbank.com", ["northbank"]), (1, "Post Office", "post-office.net", ["postoffice", "post"]), (2, "Tax Office", "tax.gov.uk", ["tax"]), (3, "Telecom One", "telecomone.info", ["telecomone"])]
LISTED = [("secure-northbank.top", "/login"), ("bit.ly", ""), ("news.example.org", "/1")]


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.extract_links(src.messages(spark, sf_dir))


def message_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _links(spark, sf_dir).select("msg_id", "ord", "url", "host", "has_scheme")


def imitated_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.imitations(_links(spark, sf_dir), links.registry_frame(spark, REGISTRY))


def link_hygiene(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.hygiene(_links(spark, sf_dir)).groupBy("code", "host").agg(F.count("*").alias("n"))


def threat_list_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.threat_hits(_links(spark, sf_dir), spark.createDataFrame(LISTED, "host string, path string"))


def page_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, registrable domain and fragment-free URL of every page."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    host = F.try_parse_url("url", F.lit("HOST"))
    return p.select("page_id", h.normal_host(host).alias("host"), h.registrable_domain(host).alias("registrable"), h.registrable_label(host).alias("label"), F.size(h.subdomains(host)).cast("long").alias("n_subdomains"), F.regexp_replace("url", "[?#].*$", "").alias("plain_url"))


def visual_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How page labels look at a glance, and how many labels look alike."""
    p = page_hosts(spark, sf_dir).select("label").distinct()
    return p.groupBy(h.visual_fold(F.col("label")).alias("fold")).agg(F.count("*").alias("labels"), F.min("label").alias("first"))


def lexicon_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.detect(src.messages(spark, sf_dir))


def lexicon_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages per code and language."""
    return lexicon.detect(src.messages(spark, sf_dir)).groupBy("code", "lang").agg(F.countDistinct("msg_id").alias("messages"))


_LINK = links.LINK.replace("'", "''")
_LINKS_SQL = rf"""{src.MESSAGES_SQL}, raw AS (SELECT msg_id, regexp_extract_all(lower(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+', ' ', 'g')), '{_LINK}') AS l FROM messages),
 one AS (SELECT msg_id, unnest(range(len(l))) AS ord, unnest(l) AS r FROM raw), cut AS (SELECT msg_id, ord, regexp_replace(r, '[.,;:!?]+$', '') AS url FROM one),
 links AS (SELECT msg_id, ord, url, regexp_replace(regexp_extract(url, '^(?:https?://)?(?:[^/@]*@)?([^/:?#]+)', 1), '^www\.', '') AS host, regexp_matches(url, '^https?://') AS has_scheme, regexp_extract(url, '^(?:https?://)?[^/?#]+([^?#]*)', 1) AS path FROM cut)"""
_SUFFIXES = "(" + ", ".join(f"'{s}'" for s in h.TWO_LABEL_SUFFIXES) + ")"


def label_sql(host: str) -> str:
    l, n = f"string_split({host}, '.')", f"len(string_split({host}, '.'))"
    return f"{l}[greatest({n} - CASE WHEN {n} >= 3 AND array_to_string({l}[-2:], '.') IN {_SUFFIXES} THEN 2 ELSE 1 END, 1)]"


_FOLD = "lower({0})"
for _a, _b in h.PAIR_FOLDS:
    _FOLD = f"replace({_FOLD}, '{_a}', '{_b}')"
_FOLD = f"translate({_FOLD}, '{h.CHAR_FOLDS[0]}', '{h.CHAR_FOLDS[1]}')"
_PAGES_SQL = f"p AS (SELECT page_id, url, regexp_replace(lower(regexp_extract(url, '^https?://(?:[^/@]*@)?([^/:?#]+)', 1)), '^www\\.', '') AS host FROM pages), q AS (SELECT *, string_split(host, '.') AS l, {label_sql('host')} AS label FROM p)"
_K = f"CASE WHEN len(l) >= 3 AND array_to_string(l[-2:], '.') IN {_SUFFIXES} THEN 2 ELSE 1 END"
_REG = "(VALUES " + ", ".join(f"({o}, '{d}', {src.sql_list(t)})" for o, _, d, t in REGISTRY) + ") r(ro, official, tokens)"
_EDITS = "CASE WHEN len({0}) <= 4 THEN 0 WHEN len({0}) <= 8 THEN 1 ELSE 2 END"
QUERIES = {
    "message_links": message_links,
    "imitated_hosts": imitated_hosts,
    "link_hygiene": link_hygiene,
    "threat_list_hits": threat_list_hits,
    "page_hosts": page_hosts,
    "visual_folds": visual_folds,
    "lexicon_signals": lexicon_signals,
    "lexicon_counts": lexicon_counts,
}
ORACLE = {
    "message_links": f"WITH {_LINKS_SQL} SELECT msg_id, ord, url, host, has_scheme FROM links WHERE host <> ''",
    "imitated_hosts": f"""WITH {_LINKS_SQL}, reg AS (SELECT *, {label_sql('official')} AS olabel FROM {_REG}),
 sp AS (SELECT DISTINCT host, path, string_split(host, '.') AS l, {label_sql('host')} AS label FROM links WHERE host NOT IN ({', '.join(f"'{x}'" for x in h.SHORTENERS)}) AND NOT EXISTS (SELECT 1 FROM reg WHERE host = official OR host LIKE '%.' || official)),
 c AS (SELECT host, path, 1 AS rank, ro, 'URL-02' AS code, official FROM sp, reg WHERE list_has_any(string_split(label, '-'), tokens)
  UNION ALL SELECT host, path, 2, ro, 'URL-01', official FROM sp, reg WHERE levenshtein(label, olabel) <= {_EDITS.format('olabel')} OR (label <> olabel AND {_FOLD.format('label')} = {_FOLD.format('olabel')})
  UNION ALL SELECT host, path, 3, ro, 'URL-03', official FROM sp, reg WHERE list_has_any(string_split_regex(array_to_string(l[:len(l) - 1 - {_K}], '.'), '[.-]'), tokens) OR list_has_any(string_split_regex(lower(path), '[/\\-_.?=&]+'), tokens)),
 best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY host, path ORDER BY rank, ro) AS t FROM c) WHERE t = 1)
 SELECT msg_id, ord, links.host, code, official FROM links JOIN best ON links.host = best.host AND links.path = best.path""",
    "link_hygiene": f"WITH {_LINKS_SQL} SELECT 'URL-05' AS code, host, count(*) AS n FROM links WHERE host IN ({', '.join(f"'{x}'" for x in h.SHORTENERS)}) GROUP BY host",
    "threat_list_hits": f"WITH {_LINKS_SQL}, t AS (SELECT * FROM (VALUES {', '.join(f"('{a}', '{b}')" for a, b in LISTED)}) t(lh, lp)) SELECT msg_id, ord, host, lp AS listed_path FROM links JOIN t ON host = lh WHERE lp = '' OR path = lp OR starts_with(path, lp || '/')",
    "page_hosts": f"WITH {_PAGES_SQL} SELECT page_id, host, array_to_string(l[-least(len(l), {_K} + 1):], '.') AS registrable, label, CAST(greatest(len(l) - {_K} - 1, 0) AS BIGINT) AS n_subdomains, regexp_replace(url, '[?#].*$', '') AS plain_url FROM q",
    "visual_folds": f"WITH {_PAGES_SQL}, d AS (SELECT DISTINCT label FROM q) SELECT {_FOLD.format('label')} AS fold, count(*) AS labels, min(label) AS first FROM d GROUP BY 1",
}
