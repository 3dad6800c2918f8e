"""Headers, pseudonyms, marked texts, and stores that batches merge into."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import keyed
from tracewell.operators import headers, offsets, spans
from tracewell.sources import messages as src
from tracewell.sources.scratch import folder
from tracewell.streaming.campaigns import Campaigns
from tracewell.streaming.store import KeyedStore

POLICIES = ["", "default-src 'self'; object-src 'none'; base-uri 'self'", "script-src * 'unsafe-inline'; base-uri 'none'", "SCRIPT-SRC 'nonce-x' 'unsafe-inline' 'unsafe-eval'; script-src https:; frame-ancestors *", "img-src data:, frame-ancestors 'self'", "default-src https: 'strict-dynamic'"]
STRICT = ["", "max-age=100", "max-age=31536000", "Max-Age=31536000; includeSubDomains"]
FRAMES = ["", "DENY", "ALLOW-FROM https://a.org", "maybe", "SameOrigin"]
ORIGINS = ["", "*", "null", "https://a.org"]
SERVERS = ["", "nginx", "Apache/2.4.1"]
COOKIES = ["sid=1; Secure; HttpOnly; SameSite=Lax", "theme=dark", "auth_token=x; SameSite=None", "a=b; Secure; HttpOnly; SameSite=None"]
SECRET = "a secret that only tests and samples use, longer than one block of the hash function"


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One response a page: headers and cookies by arithmetic on its number."""
    i = F.col("page_id")
    at = lambda values, k: src.pick(values, F.floor(i / k).cast("long"))
    pairs = {"content-security-policy": at(POLICIES, 1), "strict-transport-security": at(STRICT, 2), "x-frame-options": at(FRAMES, 3), "access-control-allow-origin": at(ORIGINS, 5), "access-control-allow-credentials": src.pick(["true", ""], i), "server": at(SERVERS, 7), "x-content-type-options": at(["nosniff", "", "sniff"], 4), "referrer-policy": at(["", "unsafe-url", "origin"], 6), "content-security-policy-report-only": src.pick(["", "default-src 'self'"], F.floor(i / 6))}
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return p.select(i.alias("id"), src.pick(["https:", "http:"], F.floor(i / 11)).alias("protocol"), F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v)]).alias("headers"), F.slice(F.array(at(COOKIES, 1), at(COOKIES, 4)), 1, (i % 3).cast("int")).alias("cookies"))


def header_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return headers.findings(responses(spark, sf_dir)).select("id", "category", "kind", "severity")


def customer_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return c.select("c_custkey", keyed.pseudonym(F.lit(SECRET), F.col("c_nationkey"), F.col("c_name")).alias("pseudonym"), keyed.hmac_sha256(F.col("c_mktsegment"), F.col("c_name")).alias("mac"))


def marked_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns cut at words of three kinds that overlap; the weightier word, then the earlier, keeps its place."""
    t = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.concat_ws(":", "conv_id", "turn").alias("id"), "text")
    found = None
    for rank, pattern in enumerate(("[a-z]*an[a-z]* ?", "[a-z]+ [a-z]*e", "[A-Z][a-z]+")):
        m = t.select("id", F.inline(offsets.spans(F.coalesce("text", F.lit("")), pattern))).select("id", "start", "end", F.lit(rank).alias("rank"), F.lit(f"k{rank}").alias("label"))
        found = m if found is None else found.unionAll(m)
    return spans.segments(t, spans.resolved(found, ["id"]), "id").select("id", "place", "start", "end", "label", "part")


def _batches(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return [e.where(F.pmod(F.col("event_id"), F.lit(3)) == k) for k in (1, 0, 2)]


def merged_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters by user and type that three batches of all events, out of order and one of them twice, merge into."""
    store = KeyedStore(folder(spark, "counters"), "user_id long, event_type string, n long, value double, ts timestamp_ntz", ("user_id", "event_type"), "ts", {"n": "sum", "value": "last"}, 16)
    rows = [b.select("user_id", "event_type", F.lit(1).cast("long").alias("n"), "value", "ts") for b in _batches(spark, sf_dir)]
    for k, b in [(0, rows[0]), (1, rows[1]), (1, rows[1]), (2, rows[2])]:
        store.put(b, k)
    return store.read(spark).select("user_id", "event_type", "n", F.col("value").alias("last_value"), F.col("first_at").alias("first_ts"), F.col("last_at").alias("last_ts"))


def campaign_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Campaigns of all events, recorded in three batches, one of them twice."""
    store = Campaigns(folder(spark, "campaigns"), 8)
    for k, e in enumerate(_batches(spark, sf_dir)):
        u = F.col("user_id")
        b = e.select(
            F.col("event_id").alias("msg_id"), F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_type") == "view", "safe").otherwise("scam").alias("verdict"), src.pick(["bank", "parcel"], u).alias("scam_type"),
            F.nullif(src.pick(src.IDENTITIES, u), F.lit("")).alias("identity"), F.when(u % 5 == 0, "[phone]").otherwise(F.concat(F.lit("s"), (u % 40).cast("string"))).alias("sender"),
            F.when(u % 3 == 0, F.array(src.pick(src.FAKE_DOMAINS, F.col("event_id")))).otherwise(F.array().cast("array<string>")).alias("domains"), (F.col("event_id") % 7 != 0).alias("share"),
        )
        store.record(b, k)
        if k == 1:
            store.record(b, k)
    return store.known(spark)


def _at(values: list[str], k: int) -> str:
    return src.sql_pick(values, f"page_id // {k}")


_HEAD = f"""r AS (SELECT page_id AS id, page_id, {src.sql_pick(['https:', 'http:'], 'page_id // 11')} = 'https:' AS secure, lower({_at(POLICIES, 1)}) AS csp, {_at(STRICT, 2)} AS hsts, {_at(FRAMES, 3)} AS xfo, {_at(ORIGINS, 5)} AS origin, page_id % 2 = 0 AS allowed, {_at(SERVERS, 7)} AS server, {_at(['nosniff', '', 'sniff'], 4)} AS nosniff, {_at(['', 'unsafe-url', 'origin'], 6)} AS referrer, {src.sql_pick(['', "default-src 'self'"], 'page_id // 6')} AS report FROM pages),
 d AS (SELECT id, n AS name, w[2:] AS sources FROM (SELECT id, w[1] AS n, w, row_number() OVER (PARTITION BY id, w[1] ORDER BY k) AS t FROM (SELECT id, string_split(trim(unnest(string_split_regex(csp, '[;,]'))), ' ') AS w, unnest(range(len(string_split_regex(csp, '[;,]')))) AS k FROM r) WHERE w[1] <> '') WHERE t = 1),
 p AS (SELECT r.*, (SELECT any_value(sources) FROM d WHERE d.id = r.id AND name = 'script-src') AS s1, (SELECT any_value(sources) FROM d WHERE d.id = r.id AND name = 'default-src') AS s2, (SELECT any_value(sources) FROM d WHERE d.id = r.id AND name = 'object-src') AS obj, (SELECT any_value(sources) FROM d WHERE d.id = r.id AND name = 'frame-ancestors') AS frame, EXISTS (SELECT 1 FROM d WHERE d.id = r.id AND name = 'base-uri') AS base FROM r),
 q AS (SELECT *, coalesce(s1, s2) AS script, coalesce(try_cast(nullif(regexp_extract(hsts, '(?i)max-age=(\\d+)', 1), '') AS BIGINT), 0) AS age FROM p),
 c AS (SELECT id, secure, unnest([{_at(COOKIES, 1)}, {_at(COOKIES, 4)}][1:(page_id % 3)::INT]) AS raw FROM r),
 k AS (SELECT id, secure, string_split(raw, '=')[1] AS name, contains(raw, 'Secure') AS is_secure, contains(raw, 'HttpOnly') AS http_only, lower(regexp_extract(raw, 'SameSite=(\\w+)', 1)) AS same FROM c)"""
_WILD = "len(list_filter({0}, lambda s: s = '*' OR regexp_matches(s, '^(?:https?|data|blob|filesystem):$'))) > 0"
_RULES = [
    ("headers", "'policy report-only'", "'low'", "csp = '' AND report <> ''"), ("headers", "'missing policy'", "'medium'", "csp = '' AND report = ''"), ("headers", "'policy without scripts'", "'medium'", "csp <> '' AND script IS NULL"),
    ("headers", "'policy allows inline scripts'", "'medium'", "list_contains(script, '''unsafe-inline''') AND len(list_filter(script, lambda s: regexp_matches(s, '^''(?:nonce|sha256|sha384|sha512)-'))) = 0"), ("headers", "'policy allows eval'", "'medium'", "list_contains(script, '''unsafe-eval''')"),
    ("headers", "'policy allows any script host'", "'medium'", f"NOT list_contains(script, '''strict-dynamic''') AND {_WILD.format('script')}"), ("headers", "'policy without plugins'", "'low'", "csp <> '' AND coalesce(obj, s2) IS NULL"), ("headers", "'policy without base-uri'", "'low'", "csp <> '' AND NOT base"),
    ("headers", "'missing strict-transport-security'", "'medium'", "secure AND hsts = ''"), ("headers", "'short strict transport'", "'low'", f"secure AND hsts <> '' AND age < {headers.MIN_HSTS}"), ("headers", "'strict transport without subdomains'", "'info'", f"secure AND age >= {headers.MIN_HSTS} AND NOT contains(lower(hsts), 'includesubdomains')"),
    ("headers", "'missing x-content-type-options'", "'low'", "nosniff = ''"), ("headers", "'odd content type option'", "'low'", "nosniff = 'sniff'"), ("headers", "'missing referrer-policy'", "'info'", "referrer = ''"), ("headers", "'permissive referrer policy'", "'low'", "referrer = 'unsafe-url'"),
    ("headers", "'missing permissions-policy'", "'info'", "true"), ("headers", "'missing cross-origin-opener-policy'", "'info'", "true"), ("framing", "'any site may frame by policy'", "'medium'", _WILD.format("frame")), ("framing", "'any site may frame'", "'medium'", "frame IS NULL AND xfo = ''"),
    ("framing", "'allow-from is ignored'", "'medium'", "frame IS NULL AND xfo LIKE 'ALLOW-FROM%'"), ("framing", "'odd framing option'", "'low'", "frame IS NULL AND xfo = 'maybe'"), ("cors", "'null origin trusted'", "'medium'", "origin = 'null'"), ("cors", "'any origin with credentials'", "'medium'", "origin = '*' AND allowed"),
    ("cors", "'any origin'", "'info'", "origin = '*' AND NOT allowed"), ("disclosure", "'server software version'", "'low'", "regexp_matches(server, '\\d')"),
]
_COOKIE_RULES = [
    ("'not secure: ' || name", "'medium'", "secure AND NOT is_secure"), ("'readable by scripts: ' || name", "CASE WHEN regexp_matches(name, '(?i)session|auth|token|sid\\b|jwt|login') THEN 'medium' ELSE 'low' END", "NOT http_only"), ("'weak same-site: ' || name", "'medium'", "same = '' OR (same = 'none' AND NOT is_secure)"),
]


def _blob(data: bytes) -> str:
    return "'" + "".join(f"\\x{b:02X}" for b in data) + "'::BLOB"


def hmac_sql(secret: str, message: str) -> str:
    import hashlib

    k = secret.encode()
    k = (hashlib.sha256(k).digest() if len(k) > 64 else k).ljust(64, b"\0")
    return f"sha256({_blob(bytes(b ^ 0x5C for b in k))} || unhex(sha256({_blob(bytes(b ^ 0x36 for b in k))} || encode({message}))))"


_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
QUERIES = {"header_findings": header_findings, "customer_pseudonyms": customer_pseudonyms, "marked_parts": marked_parts, "merged_counters": merged_counters, "campaign_growth": campaign_growth}
ORACLE = {
    "header_findings": f"WITH {_HEAD} " + " UNION ALL ".join([f"SELECT id, '{c}' AS category, {k} AS kind, {s} AS severity FROM q WHERE {w}" for c, k, s, w in _RULES] + [f"SELECT id, 'cookies', {k}, {s} FROM k WHERE {w}" for k, s, w in _COOKIE_RULES]),
    "customer_pseudonyms": f"SELECT c_custkey, left({hmac_sql(SECRET, 'c_nationkey || chr(0) || lower(c_name)')}, 32) AS pseudonym, CASE c_mktsegment " + " ".join(f"WHEN '{s}' THEN {hmac_sql(s, 'c_name')}" for s in _SEGMENTS) + " END AS mac FROM customer",
    "merged_counters": "SELECT user_id, event_type, count(*) AS n, (max(struct_pack(t := ts, v := value))).v AS last_value, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY user_id, event_type",
    "campaign_growth": f"""WITH e AS (SELECT *, {src.sql_pick(src.IDENTITIES, 'user_id')} AS identity, {src.sql_pick(['bank', 'parcel'], 'user_id')} AS scam_type FROM events WHERE event_type <> 'view' AND event_id % 7 <> 0),
f AS (SELECT *, CASE WHEN identity <> '' THEN lower(replace(identity, ' ', '-')) ELSE scam_type || '-unknown' END AS campaign FROM e)
SELECT campaign, count(*) AS messages, count(DISTINCT CASE WHEN user_id % 5 <> 0 THEN user_id % 40 END) AS n_senders, count(DISTINCT CASE WHEN user_id % 3 = 0 THEN {src.sql_pick(src.FAKE_DOMAINS, 'event_id')} END) AS n_domains FROM f GROUP BY campaign""",
}
