"""Messages to verdicts: detectors over generated messages, their union, scores, marks and plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import hosts as h
from tracewell.operators import domains, identity, lexicon, links, urls, workflows
from tracewell.plans import pipeline, scoring
from tracewell.plans.ruleset import VERSIONS, ruleset
from tracewell.queries.detection import label_sql
from tracewell.queries.scoring import ctes, score_sql
from tracewell.sources import messages as src
from tracewell.sources.scratch import dealt, written

TEMPLATES = [
    "Dear North Bank client, verify your account at https://northbank.com.login-check.top/{u}",
    "North Bank: confirm at https://www.northbank.com/secure",
    "Post Office fee: pay at https://p0st-office.net/{u} recipient: John Smith now",
    "Log in to paypa1.com/{u} to keep your money",
    "Click bit.ly/x{u}",
    "Open http://10.1.3.4/u{u}",
    "See https://northbank.com@evil-{u}.xyz/a",
    "News at https://news.example.org/{u} about North Bank",
    "Visit https://nоrthbank.com/{u} today",
    "From: 5900{u}\nSend it here please, {n}",
    "Transfer to Mary Jane today, North Bank",
    "Nothing to see here {n}",
    "Update now: https://micros0ft-login.com/{u} or https://docs.example.org/post/a",
    "Tax Office refund at https://tax.gov.uk/{u} and telecomome.info",
]
REGISTRY = [
    identity.Institution(0, "North Bank", ["northbank.com"], ["northbank"], [r"\bnorth ?bank\b"], ["North Bank"]),
    identity.Institution(1, "Post Office", ["post-office.net"], ["postoffice", "post"], [r"\bpost office\b"], ["Post Office"]),
    identity.Institution(2, "Tax Office", ["tax.gov.uk"], ["tax"], [r"\btax office\b"], ["Tax Office"]),
    identity.Institution(3, "Telecom One", ["telecomone.info"], ["telecomone"], [r"\btelecom one\b"], ["Telecom One"]),
]
BRANDS = ["paypal.com", "microsoft.com", "facebook.com"]
TRUSTED, USER_CONTENT, SHARED = ["example.org"], ["docs.example.org"], ["pages.dev"]
LISTED = [("northbank.com.login-check.top", "/1"), ("news.example.org", "/1"), ("bit.ly", ""), ("news.example.org", "")]
METHODS, RECIPIENTS, ORGANISATIONS = ["bank_transfer", "gift_card", "card", "crypto"], ["John Smith", "North Bank Ltd", "Acme Trading"], ["North Bank", "Acme Ltd", ""]
CONFIDENCES = ["low", "medium", "high"]
WORKFLOWS = [
    workflows.Workflow("bank-change", ["EMAIL-06", "PAY-05", "PAY-07:payroll"], ["ID-01", "ID-02", "PAY-02"], "treasury", 2),
    workflows.Workflow("link-report", ["URL-01", "URL-02", "URL-03", "URL-04"], [], "it", 0),
    workflows.Workflow("document", ["DOC-09:high", "DOC-13"], ["PAY-02", "PAY-05", "PAY-06", "URL-08"], None, 1),
]


def _domains(spark: SparkSession, names: list[str]) -> DataFrame:
    return spark.createDataFrame([(x,) for x in names], "domain string")


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What users say about a payment, for each fifth message."""
    i = F.col("msg_id")
    m = src.messages(spark, sf_dir, TEMPLATES).where(i % 5 == 0)
    return m.select("msg_id", src.pick(METHODS, F.floor(i / 5)).alias("method"), src.pick(RECIPIENTS, F.floor(i / 10)).alias("recipient"), F.nullif(src.pick(ORGANISATIONS, F.floor(i / 15)), F.lit("")).alias("organisation"), (i % 35 == 0).alias("on_call"))


def image_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("msg_id")
    return src.messages(spark, sf_dir, TEMPLATES).where(i % 6 == 0).select("msg_id", F.lit(0).alias("place"), src.pick([*pipeline.IMAGE_CHECKS, "unknown"], F.floor(i / 6)).alias("check"), src.pick(CONFIDENCES, F.floor(i / 12)).alias("confidence"), F.lit(None).cast("string").alias("evidence"))


def message_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict]:
    """Messages with their claim, and the outputs of all detectors that need no phrase rules."""
    m = src.messages(spark, sf_dir, TEMPLATES)
    m = written(m.select("msg_id", "user_id", "text", identity.claimed(F.col("text"), REGISTRY).alias("claim")), "messages")
    m = dealt(m, src.EVENTS_A_TASK, "msg_id")
    found = written(links.extract_links(m), "links")
    first, official = identity.registry_frames(spark, REGISTRY)
    brands = spark.createDataFrame(list(enumerate(BRANDS)), "ord int, domain string")
    trusted = domains.trusted_hosts(found, _domains(spark, TRUSTED), _domains(spark, USER_CONTENT)).select("host")
    shared = domains.shared_hosts(spark.createDataFrame([(x,) for x, _ in LISTED], "host string"), _domains(spark, TRUSTED), _domains(spark, USER_CONTENT), _domains(spark, SHARED))
    urls = links.imitations(found, first, brands, trusted).select("msg_id", F.col("ord").alias("place"), "code", "host")
    odd = domains.homoglyphs(m, first, brands).select("msg_id", "place", "code", "host")
    calls = links.unofficial_calls(m, found, official, trusted).select("msg_id", F.lit(0).cast("long").alias("place"), F.lit("URL-08").alias("code"), "host")
    clean = links.hygiene(found).select("msg_id", (F.col("ord") * 2 + F.when(F.col("code") == "URL-05", 1).when(F.col("code") == "URL-07", 2).otherwise(1 << 20)).alias("place"), "code", "host")
    threats = links.threat_hits(found, spark.createDataFrame(LISTED, "host string, path string"), shared, official.select("domain"))
    threats = threats.groupBy("msg_id", "ord").agg(F.first("host").alias("host")).select("msg_id", F.col("ord").alias("place"), F.lit("REP-05").alias("code"), "host")
    reports = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type = 'error'").select(F.concat(F.lit("5900"), F.col("user_id").cast("string")).alias("sender"))
    senders = m.select("msg_id", identity.observed_sender(F.col("text")).alias("sender")).where("sender IS NOT NULL")
    parts = {
        "urls": urls,
        "homoglyphs": odd,
        "hygiene": calls.unionAll(clean),
        "threat": (threats, "intel"),
        "identity": identity.contradictions(m, found, REGISTRY),
        "payment": identity.payment_signals(payments(spark, sf_dir), REGISTRY),
        "extra": pipeline.accepted(pipeline.image_signals(image_checks(spark, sf_dir)), ruleset()),
        "reputation": (identity.reported_senders(senders, reports).select("msg_id", F.lit("REP-03").alias("code"), "evidence"), "community"),
    }
    return m, parts


def _signals(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    m, parts = message_parts(spark, sf_dir)
    return m.select("msg_id", F.col("claim").isNotNull().alias("claimed"), F.lit(False).alias("semantic_ok")), pipeline.gathered(parts, "signals")


def message_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signals(spark, sf_dir)[1].select("msg_id", "ord", "code", "source_type", F.coalesce("variant", F.lit("")).alias("variant"), "host")


def message_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    contexts, s = _signals(spark, sf_dir)
    return pipeline.assess(s, contexts)


def message_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored signals and those merged into another's finding."""
    s = pipeline.checked(_signals(spark, sf_dir)[1], ruleset())
    m = scoring.members(s.select("msg_id", "ord", "code", "source_type", F.coalesce("variant", F.lit("")).alias("variant"), "host"), ruleset())
    return pipeline.annotated(m)


def risk_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    contexts, s = _signals(spark, sf_dir)
    return pipeline.categories(s, contexts)


def verification_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    contexts, s = _signals(spark, sf_dir)
    levels = pipeline.assess(s, contexts).select("msg_id", "level")
    return workflows.plan(s.select("msg_id", "code", "variant"), levels, WORKFLOWS)


def batch_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.batch_summary(message_verdicts(spark, sf_dir))


def full_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All detectors with the phrase rules, which SQL can't express."""
    m, parts = message_parts(spark, sf_dir)
    phrases = written(lexicon.detect_twice(m).select("msg_id", F.col("start").alias("place"), "code", "evidence", "start"), "phrases")
    parts["lexicon"] = (phrases.where("code NOT IN ('SOC-07', 'ID-05')"), "lexicon")
    parts["injection"], parts["template"] = phrases.where("code = 'SOC-07'"), phrases.where("code = 'ID-05'")
    s = pipeline.gathered(parts, "signals")
    return pipeline.assess(s, m.select("msg_id", F.col("claim").isNotNull().alias("claimed"), F.lit(False).alias("semantic_ok")))


def url_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every link of every message by itself; ages and certificates follow from the host's length."""
    found = links.extract_links(src.messages(spark, sf_dir, TEMPLATES))
    found = written(found.select((F.col("msg_id") * 10 + F.col("ord")).alias("url_id"), "url", "host"), "urls")
    hosts, n = found.select("host").distinct(), F.length("host")
    ages = hosts.select(urls.dated_domain(F.col("host")).alias("domain")).where("domain IS NOT NULL").distinct()
    ages = ages.select("domain", F.when(F.length("domain") % 4 > 0, F.length("domain") * 3 % 60).alias("days"), (F.length("domain") * 7 % 50).alias("certificate_days"))
    problem = F.when(n % 9 == 0, "expired").when(n % 5 == 0, "self_signed")
    _, official = identity.registry_frames(spark, REGISTRY)
    trusted = domains.trusted_hosts(hosts, _domains(spark, TRUSTED), _domains(spark, USER_CONTENT)).select("host")
    shared = domains.shared_hosts(spark.createDataFrame([(x,) for x, _ in LISTED], "host string"), _domains(spark, TRUSTED), _domains(spark, USER_CONTENT), _domains(spark, SHARED))
    return urls.assess(found.select("url_id", "url"), REGISTRY, spark.createDataFrame(list(enumerate(BRANDS)), "ord int, domain string"), trusted, spark.createDataFrame(LISTED, "host string, path string"), shared, ages, hosts.select("host", problem.alias("problem"), (n % 12).alias("issued_days")), found.where("url_id % 3 = 0").select("host"))


def _list(names: list[str]) -> str:
    return "(" + ", ".join(f"'{x}'" for x in names) + ")"


def below_sql(host: str, names: list[str]) -> str:
    return "(" + " OR ".join(f"{host} = '{d}' OR {host} LIKE '%.{d}'" for d in names) + ")"


def claim_sql(text: str) -> str:
    """ord of the institution that stands first."""
    at = lambda name: f"nullif(instr(lower({text}), '{name}'), 0)"
    spot = lambda i: f"least({at(i.name.lower())}, {at(i.name.lower().replace(' ', ''))})" if " ?" in i.patterns[0] else at(i.name.lower())
    spots = ", ".join(f"{{'at': {spot(i)}, 'ord': {i.ord}}}" for i in REGISTRY)
    return f"(list_sort(list_filter([{spots}], lambda x: x.at IS NOT NULL))[1]).ord"


_EDITS = "CASE WHEN len({0}) <= 4 THEN 0 WHEN len({0}) <= 8 THEN 1 ELSE 2 END"


def fold_sql(x: str) -> str:
    for a, b in h.PAIR_FOLDS:
        x = f"replace({x}, '{a}', '{b}')"
    return f"translate({x}, '{h.CHAR_FOLDS[0]}', '{h.CHAR_FOLDS[1]}')"


_LINK = links.LINK.replace("'", "''")
_REG = "(VALUES " + ", ".join(f"({i.ord}, '{i.official[0]}', {src.sql_list(i.tokens)})" for i in REGISTRY) + ") r(ro, official, tokens)"
_BRANDS = "(VALUES " + ", ".join(f"({k}, '{d}', '{d.split('.')[0]}')" for k, d in enumerate(BRANDS)) + ") b(bo, bdomain, brand)"
_OFFICIAL = [d for i in REGISTRY for d in i.official]
_TRUST = f"({below_sql('host', TRUSTED)} AND NOT {below_sql('host', USER_CONTENT)})"
_SUFFIXES = "(" + ", ".join(f"'{s}'" for s in h.TWO_LABEL_SUFFIXES) + ")"
_K = f"CASE WHEN len(l) >= 3 AND array_to_string(l[-2:], '.') IN {_SUFFIXES} THEN 2 ELSE 1 END"
_CALL = r"(?i)\b(?:verify|confirm|log ?in|sign ?in|update|unlock|reactivate|restore|claim|click|tap|klik)\b"
_BENEFICIARY = "CASE WHEN text LIKE '%recipient: John Smith now%' THEN 'John Smith' WHEN text LIKE 'Transfer to Mary Jane today%' THEN 'Mary Jane' END"


def _tokens_sql(x: str) -> str:
    stop = _list(identity.NAME_STOPWORDS)
    return f"list_filter(string_split_regex(lower({x}), '[^a-z0-9]+'), lambda t: len(t) >= 2 AND t NOT IN {stop})"


_MATCH = f"CASE WHEN {claim_sql('recipient')} IS NOT NULL AND {claim_sql('organisation')} IS NOT NULL THEN {claim_sql('recipient')} = {claim_sql('organisation')} WHEN len({_tokens_sql('recipient')}) = 0 OR len({_tokens_sql('organisation')}) = 0 THEN true ELSE list_has_any({_tokens_sql('recipient')}, {_tokens_sql('organisation')}) END"


def _row(detector: str, place: str, code: str, kind: str, host: str, frm: str, variant: str = "''") -> str:
    return f"SELECT msg_id, ({pipeline.DETECTORS.index(detector) << 40} + {place})::BIGINT AS ord, {code} AS code, '{kind}' AS source_type, {variant} AS variant, {host} AS host FROM {frm}"


_PARTS = [
    _row("urls", "links.ord", "best.code", "rule", "links.host", "links JOIN best ON links.host = best.host AND links.path = best.path"),
    _row("homoglyphs", "0", "'URL-04'", "rule", f"'n{chr(0x43E)}rthbank.com'", f"messages WHERE text LIKE 'Visit https://n{chr(0x43E)}rthbank%'"),
    _row("hygiene", "0", "'URL-08'", "rule", "host", f"(SELECT msg_id, arg_min(host, ord) AS host FROM links JOIN messages USING (msg_id) WHERE NOT {below_sql('host', _OFFICIAL)} AND NOT {_TRUST} AND regexp_matches(text, '{_CALL}') GROUP BY msg_id)"),
    _row("hygiene", "ord * 2 + 1", "'URL-05'", "rule", "host", f"links WHERE host IN {_list(h.SHORTENERS)}"),
    _row("hygiene", "ord * 2 + 2", "'URL-07'", "rule", "host", "links WHERE user_info <> ''"),
    _row("hygiene", f"ord * 2 + {1 << 20}", "'URL-06'", "rule", "host", r"links WHERE regexp_matches(host, '^[0-9]{1,3}(\.[0-9]{1,3}){3}$')"),
    _row("threat", "ord", "'REP-05'", "intel", "host", "(SELECT DISTINCT msg_id, ord, host FROM links JOIN listed ON host = lh AND (NOT many OR path = lp OR starts_with(path, lp || '/')))"),
    _row("identity", "0", "'ID-01'", "rule", "host", "(SELECT msg_id, arg_min(host, ord) AS host FROM links JOIN claims USING (msg_id) WHERE claim IS NOT NULL AND host NOT IN " + _list(h.SHORTENERS) + " AND NOT CASE claim " + " ".join(f"WHEN {i.ord} THEN {below_sql('host', i.official)}" for i in REGISTRY) + " END GROUP BY msg_id)"),
    _row("identity", "1", "'ID-02'", "rule", "NULL", f"claims WHERE claim IS NOT NULL AND {_BENEFICIARY} IS NOT NULL"),
    _row("payment", "0", "'PAY-02'", "rule", "NULL", f"payments WHERE method IN {_list(identity.UNUSUAL_METHODS)}"),
    _row("payment", "1", "'PAY-05'", "rule", "NULL", f"payments WHERE organisation <> '' AND NOT {_MATCH}"),
    _row("payment", "2", "'PAY-06'", "rule", "NULL", "payments WHERE msg_id % 35 = 0"),
    _row("extra", "0", src.sql_pick([*pipeline.IMAGE_CHECKS.values(), ""], "msg_id // 6"), "rule", "NULL", f"messages WHERE msg_id % 6 = 0 AND {src.sql_pick([*pipeline.IMAGE_CHECKS.values(), ''], 'msg_id // 6')} <> ''", src.sql_pick(CONFIDENCES, "msg_id // 12")),
    _row("reputation", "0", "'REP-03'", "community", "NULL", f"messages WHERE text LIKE 'From: 5900%' AND user_id IN (SELECT user_id FROM events WHERE event_type = 'error' GROUP BY user_id HAVING count(*) >= {identity.MIN_REPORTS})"),
]
BASE = rf"""{src.messages_sql(TEMPLATES)}, raw AS (SELECT msg_id, regexp_extract_all(lower(text), '{_LINK}') AS l FROM messages),
 one AS (SELECT msg_id, unnest(range(len(l))) AS ord, unnest(l) AS r FROM raw), cut AS (SELECT msg_id, ord, regexp_replace(r, '[.,;:!?]+$', '') AS url FROM one),
 links AS (SELECT * FROM (SELECT msg_id, ord, url, regexp_replace(regexp_extract(url, '^(?:https?://)?(?:[^/@]*@)?([^/:?#]+)', 1), '^www\.', '') AS host, regexp_extract(url, '^(?:https?://)?[^/?#]+([^?#]*)', 1) AS path, regexp_extract(url, '^(?:https?://)?(?:([^/@]*)@)?', 1) AS user_info FROM cut) WHERE regexp_matches(host, '^[\x00-\x7f]+$')),
 reg AS (SELECT *, {label_sql('official')} AS olabel FROM {_REG}), brands AS (SELECT * FROM {_BRANDS}),
 sp AS (SELECT *, {_K} AS k FROM (SELECT DISTINCT host, path, string_split(host, '.') AS l, {label_sql('host')} AS label FROM links WHERE host NOT IN {_list(h.SHORTENERS)} AND NOT {below_sql('host', _OFFICIAL)})),
 cand AS (SELECT host, path, 1 AS rank, ro, 'URL-02' AS code FROM sp, reg WHERE list_has_any(string_split(label, '-'), tokens)
  UNION ALL SELECT host, path, 2, ro, 'URL-01' FROM sp, reg WHERE levenshtein(label, olabel) <= {_EDITS.format('olabel')} OR (label <> olabel AND {fold_sql('label')} = {fold_sql('olabel')})
  UNION ALL SELECT host, path, 3, bo, CASE WHEN part THEN 'URL-02' ELSE 'URL-01' END FROM (SELECT *, len(string_split(label, '-')) > 1 AND list_contains(list_transform(string_split(label, '-'), lambda x: {fold_sql('x')}), {fold_sql('brand')}) AS part FROM sp, brands
    WHERE NOT {_TRUST} AND NOT {below_sql('host', BRANDS)} AND label <> brand) WHERE part OR {fold_sql('label')} = {fold_sql('brand')} OR (label[1] = brand[1] AND levenshtein(label, brand) <= {_EDITS.format('brand')})
  UNION ALL SELECT host, path, 4, ro, 'URL-03' FROM sp, reg WHERE NOT {_TRUST} AND (list_has_any(string_split_regex(array_to_string(l[:len(l) - 1 - k], '.'), '[.-]'), tokens) OR list_has_any(string_split_regex(lower(path), '[/\-_.?=&]+'), tokens))),
 best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY host, path ORDER BY rank, ro) AS t FROM cand) WHERE t = 1),
 listed AS (SELECT DISTINCT lh, CASE WHEN many THEN lp ELSE '' END AS lp, many FROM (SELECT lh, lp, {below_sql('lh', TRUSTED + USER_CONTENT + SHARED)} AS many FROM (VALUES {', '.join(f"('{a}', '{b}')" for a, b in LISTED)}) t(lh, lp)) WHERE NOT many OR lp <> ''),
 claims AS (SELECT msg_id, text, {claim_sql('text')} AS claim FROM messages),
 payments AS (SELECT msg_id, {src.sql_pick(METHODS, 'msg_id // 5')} AS method, {src.sql_pick(RECIPIENTS, 'msg_id // 10')} AS recipient, {src.sql_pick(ORGANISATIONS, 'msg_id // 15')} AS organisation FROM messages WHERE msg_id % 5 = 0),
 signals AS ({' UNION ALL '.join(_PARTS)}),
 contexts AS (SELECT msg_id, claim IS NOT NULL AS claimed, false AS semantic_ok FROM claims)"""
_ACTIVE = VERSIONS[-1]
_SITE = f"array_to_string(string_split(host, '.')[-CASE WHEN len(string_split(host, '.')) >= 3 AND array_to_string(string_split(host, '.')[-2:], '.') IN {_SUFFIXES} THEN 3 ELSE least(2, len(string_split(host, '.'))) END:], '.')"
_URLS = rf"""u AS (SELECT msg_id * 10 + ord AS url_id, url, host, path, user_info, starts_with(url, 'https:') AS secure FROM links),
 st AS (SELECT url_id, best.code, NULL AS severity, u.host FROM u JOIN best ON u.host = best.host AND u.path = best.path UNION ALL SELECT url_id, 'URL-05', NULL, host FROM u WHERE host IN {_list(h.SHORTENERS)} UNION ALL SELECT url_id, 'URL-07', NULL, host FROM u WHERE user_info <> ''
  UNION ALL SELECT url_id, 'URL-06', NULL, host FROM u WHERE regexp_matches(host, '^[0-9]{{1,3}}(\.[0-9]{{1,3}}){{3}}$') UNION ALL SELECT DISTINCT url_id, 'REP-05', NULL, host FROM u JOIN listed ON host = lh AND (NOT many OR path = lp OR starts_with(path, lp || '/'))),
 op AS (SELECT DISTINCT host, {_SITE} AS site FROM u WHERE NOT {below_sql('host', _OFFICIAL)} AND NOT {_TRUST}),
 ag AS (SELECT host, CASE WHEN len(site) % 4 > 0 THEN CASE WHEN len(site) * 3 % 60 < 7 THEN 'high' WHEN len(site) * 3 % 60 < 30 THEN 'medium' END WHEN len(site) * 7 % 50 < 30 THEN 'medium' END AS severity FROM op WHERE NOT regexp_matches(host, '^[0-9.]+$')),
 rp AS (SELECT host FROM u WHERE url_id % 3 = 0 AND host IN (SELECT host FROM op) GROUP BY host HAVING count(*) >= {urls.MIN_REPORTS}),
 ct AS (SELECT url_id, CASE WHEN len(host) % 9 = 0 OR len(host) % 5 = 0 THEN 'CERT-01' WHEN url_id IN (SELECT url_id FROM st WHERE code IN {_list(urls.LOOKALIKE)}) AND len(host) % 12 < {urls.NEW_CERTIFICATE_DAYS} THEN 'CERT-02' END AS code, host FROM u WHERE secure)
SELECT * FROM st UNION ALL SELECT url_id, 'URL-09', severity, u.host FROM u JOIN ag USING (host) WHERE severity IS NOT NULL UNION ALL SELECT url_id, 'REP-03', 'medium', host FROM u WHERE host IN (SELECT host FROM rp) UNION ALL SELECT url_id, code, CASE code WHEN 'CERT-01' THEN 'high' ELSE 'medium' END, host FROM ct WHERE code IS NOT NULL"""


def verdicts_sql(base: str) -> str:
    """assess in SQL over a base of signals and contexts."""
    stages = " ".join(f"WHEN list_has_any(string_split(codes, ','), {src.sql_list(some)}) THEN '{name}'" for name, some in pipeline.STAGES)
    scored = score_sql(_ACTIVE, base)
    at = scored.rindex("\nSELECT msg_id, CAST(total")
    return f"""{scored[:at]}, scored AS ({scored[at + 1 :]}), seen AS (SELECT msg_id, array_to_string(list_sort(list_distinct(list(code))), ',') AS codes FROM signals GROUP BY msg_id)
SELECT scored.*, CASE {stages} END AS stage, coalesce(codes, '') AS codes FROM scored LEFT JOIN seen USING (msg_id)"""


def _categories_sql() -> str:
    category = "CASE " + " ".join(f"WHEN code = '{k}' THEN '{v}'" for k, v in pipeline.CATEGORY_OF.items() if "-" in k) + " " + " ".join(f"WHEN string_split(code, '-')[1] = '{k}' THEN '{v}'" for k, v in pipeline.CATEGORY_OF.items() if "-" not in k) + " END"
    severity = f"CASE WHEN code LIKE 'DOC-%' THEN variant WHEN code IN {_list(pipeline.SEVERITY['low'])} THEN 'low' WHEN code IN {_list(pipeline.SEVERITY['high'])} THEN 'high' ELSE 'medium' END"
    columns = ", ".join(f"['LOW', 'MEDIUM', 'HIGH'][coalesce(max(CASE WHEN category = '{c}' THEN list_position(['low', 'medium', 'high'], severity) END), 1)::INT] AS {c}" for c in pipeline.CATEGORIES)
    return f"WITH {BASE}, s AS (SELECT msg_id, {category} AS category, {severity} AS severity FROM signals) SELECT msg_id, {columns} FROM contexts LEFT JOIN s USING (msg_id) GROUP BY msg_id"


def _plan_sql() -> str:
    rows = [(k, w.id, w.owner, w.approvals, kind, n, name, bool(w.requires_any)) for k, w in enumerate(WORKFLOWS) for kind, names in (("t", w.triggers), ("a", w.requires_any)) for n, name in enumerate(names)]
    values = ", ".join(f"({k}, '{i}', {'NULL' if o is None else repr(o)}, {a}, '{kind}', {n}, '{name}', {str(x).lower()})" for k, i, o, a, kind, n, name, x in rows)
    return f"""WITH v AS ({verdicts_sql(BASE)}), {BASE}, w AS (SELECT * FROM (VALUES {values}) w(place, workflow, owner, approvals, kind, nth, name, needs)),
n AS (SELECT DISTINCT msg_id, unnest([code, CASE WHEN variant <> '' THEN code || ':' || variant END]) AS name FROM signals)
SELECT msg_id, place::BIGINT AS place, workflow, owner, approvals::BIGINT AS approvals, string_agg(name, ',' ORDER BY nth) FILTER (WHERE kind = 't') AS triggered_by FROM n JOIN w USING (name) WHERE msg_id IN (SELECT msg_id FROM v WHERE level <> 'low')
GROUP BY msg_id, place, workflow, owner, approvals, needs HAVING count(*) FILTER (WHERE kind = 't') > 0 AND (NOT needs OR count(*) FILTER (WHERE kind = 'a') > 0)"""


QUERIES = {
    "message_signals": message_signals,
    "message_verdicts": message_verdicts,
    "message_marks": message_marks,
    "risk_categories": risk_categories,
    "verification_plan": verification_plan,
    "batch_totals": batch_totals,
    "full_verdicts": full_verdicts,
    "url_signals": url_signals,
}
ORACLE = {
    "url_signals": f"WITH {BASE}, {_URLS}",
    "message_signals": f"WITH {BASE} SELECT msg_id, ord, code, source_type, variant, host FROM signals",
    "message_verdicts": verdicts_sql(BASE),
    "message_marks": f"{ctes(_ACTIVE, BASE)} SELECT m.msg_id, m.ord, m.code, m.grp, m.place = 1 AS scored, CASE WHEN m.place > 1 THEN p.code END AS merged_into FROM mem m JOIN (SELECT msg_id, grp, code FROM mem WHERE place = 1) p USING (msg_id, grp)",
    "risk_categories": _categories_sql(),
    "verification_plan": _plan_sql(),
    "batch_totals": f"SELECT count(*) AS total, count(*) FILTER (WHERE verdict = 'scam') AS scam, count(*) FILTER (WHERE verdict = 'suspicious') AS suspicious, count(*) FILTER (WHERE verdict = 'safe') AS safe, count(*) FILTER (WHERE verdict IS NULL) AS unanalysed FROM ({verdicts_sql(BASE)})",
}
