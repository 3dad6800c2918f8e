"""Workplace email: sender identity, threads, payments, and what they add up to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import hosts as h
from tracewell.operators import asof, containment, domains, indicators, mail
from tracewell.plans import pipeline
from tracewell.queries.community import template_sql
from tracewell.queries.detection import label_sql
from tracewell.queries.ledger import SECRET, hmac_sql
from tracewell.queries.pipeline import REGISTRY, below_sql, claim_sql, fold_sql, verdicts_sql
from tracewell.sources import mail as src
from tracewell.sources.messages import sql_list
from tracewell.sources.scratch import written

ORG = src.ORGANISATION


def _financial(emails: DataFrame) -> DataFrame:
    return emails.where("lower(text) LIKE '%pay%' OR lower(text) LIKE '%beneficiary%'").select("msg_id")


def domain_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sender domains beside every supplier's domain that they are, share a site with, or imitate."""
    hosts = src.emails(spark, sf_dir).select(mail.domain_of(F.col("from_address")).alias("host"))
    return domains.relations(hosts, src.suppliers(spark, sf_dir).select(F.explode("domains").alias("domain")))


def _mail_signals(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Emails, made and written once, and their signals."""
    e = written(src.emails(spark, sf_dir), "emails")
    return e, mail.signals(e, src.suppliers(spark, sf_dir), ORG, REGISTRY, _financial(e))


def mail_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mail_signals(spark, sf_dir)[1].select("msg_id", "code", F.coalesce("variant", F.lit("")).alias("variant"), "host")


def mail_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Emails to verdicts."""
    e, found = _mail_signals(spark, sf_dir)
    s = pipeline.gathered({"email": found}, "mail-signals")
    contexts = e.select("msg_id", F.lit(False).alias("claimed"), F.lit(False).alias("semantic_ok"))
    return pipeline.assess(s, contexts)


def thread_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mail.thread_changes(src.emails(spark, sf_dir))


def supplier_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers whose name stands in a subject or text, and how often."""
    e = src.emails(spark, sf_dir)
    names = src.suppliers(spark, sf_dir).select(F.col("supplier_id").alias("name_id"), F.substring_index("name", " Trading", 1).alias("name"))
    texts = e.select(F.col("msg_id").alias("text_id"), F.concat_ws(" ", "subject", "text").alias("text"))
    return containment.names_in(texts, names).groupBy("text_id", "name_id").agg(F.count("*").alias("times"))


def accounts_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The account that a sender last asked to be paid into before each email, where one stands in it."""
    e = src.emails(spark, sf_dir).select("msg_id", "ts", F.substring_index("from_address", "@", 1).alias("sender"), F.get(mail.account_ends(F.col("text")), F.lit(0)).alias("account"))
    told = e.where("account IS NOT NULL")
    return asof.last_before(e, told, "sender", "ts", F.struct("msg_id", "account"), "last", 86400.0).select("msg_id", "account", F.col("last.account").alias("before"), F.coalesce("last.msg_id", F.lit(-1)).alias("before_id"))


def mail_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indicators.indicators(src.emails(spark, sf_dir), src.suppliers(spark, sf_dir), ORG, REGISTRY, SECRET).drop("place")


_SUFFIXES = "(" + ", ".join(f"'{s}'" for s in h.TWO_LABEL_SUFFIXES) + ")"
_EDITS = "CASE WHEN len({0}) <= 4 THEN 0 WHEN len({0}) <= 8 THEN 1 ELSE 2 END"


def site_sql(x: str) -> str:
    n = f"len(string_split({x}, '.'))"
    return f"array_to_string(string_split({x}, '.')[-least({n}, CASE WHEN {n} >= 3 AND array_to_string(string_split({x}, '.')[-2:], '.') IN {_SUFFIXES} THEN 3 ELSE 2 END):], '.')"


def relation_sql(a: str, b: str) -> str:
    """The relation of two ASCII hosts, as a ladder."""
    la, lb = label_sql(a), label_sql(b)
    before = f"left({a}, greatest(len({a}) - len({site_sql(a)}) - 1, 0))"
    return f"""CASE WHEN {a} = {b} OR {a} LIKE '%.' || {b} THEN 'same' WHEN {site_sql(a)} = {site_sql(b)} THEN 'sibling'
 WHEN ({before} <> '' AND replace({before}, '.', '') || {la} = {lb}) OR (replace({la}, '-', '') = replace({lb}, '-', '') AND {la} <> {lb}) THEN 'label_split' WHEN list_contains(string_split({before}, '.'), {lb}) THEN 'subdomain_abuse' WHEN {la} = {lb} THEN 'tld_swap'
 WHEN {fold_sql(la)} = {fold_sql(lb)} THEN 'confusable' WHEN len({lb}) >= 5 AND levenshtein({la}, {lb}) <= {_EDITS.format(lb)} THEN 'typo' WHEN len({lb}) >= 5 AND contains({la}, {lb}) THEN 'brand_embedded' END"""


def _free(x: str) -> str:
    return f"({site_sql(x)} IN (" + ", ".join(f"'{d}'" for d in mail.FREEMAIL) + "))"


_ORG_RANK = "list_position(" + sql_list(mail.TECHNIQUE_ORDER) + ", {0})"
_LIKE = "'label_split', 'subdomain_abuse', 'tld_swap', 'confusable', 'typo'"
_LURES = sql_list(mail.LURES)
_KEY = r"trim(regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9]+', ' ', 'g'))"
_ENDS = r"""list_distinct(list_concat(list_concat(regexp_extract_all(body, '(?i)\b(?:account|acct|a/c|iban|compte|kont)\b[^.\n]{0,20}?\b(?:ending|ends|se terminant par)\s*(?:in\s+|with\s+|par\s+)?(\d{4})\b', 1), regexp_extract_all(body, '(?:\*{2,})\s?(\d{4})\b', 1)),
 list_transform(list_filter(list_transform(regexp_extract_all(body, '(?i)\b(?:account|acct|a/c|iban|compte|kont)\b(?:\s+(?:number))?\s*[:#-]?\s*(\d[\d -]{4,28}\d)', 1), lambda x: regexp_replace(x, '\D', '', 'g')), lambda x: len(x) >= 6), lambda x: right(x, 4))))"""
_PAYEE = r"trim(regexp_extract(body, '(?im)\b(?:beneficiary|payee)\s*:\s*(\pL[\pL .&-]{1,60}?)\s*(?:$|\n|,|;|\.\s)', 1))"
_TOKENS = "list_filter(string_split_regex(lower({0}), '[^a-z0-9]+'), lambda t: len(t) >= 2 AND t NOT IN ('ltd', 'limited', 'co', 'company', 'inc', 'plc', 'sarl', 'ltee', 'the', 'and', 'de', 'la', 'le', 'mr', 'mrs', 'ms'))"
_AT = "struct_pack(t := ts, m := msg_id)"
_CHANGES = f"""t AS (SELECT msg_id, thread, address, domain, {site_sql('domain')} AS site, nullif({_KEY.format('from_name')}, '') AS name, {_AT} AS at FROM emails),
 dd AS (SELECT a.domain AS x, b.domain AS y FROM (SELECT DISTINCT domain FROM t) a, (SELECT DISTINCT domain FROM t) b WHERE {relation_sql('a.domain', 'b.domain')} IN ({_LIKE})),
 p AS (SELECT n.msg_id, n.domain AS host, bool_or(o.address = n.address) AS known, bool_or(o.site = n.site) AS owned, arg_min(o.domain, o.at) FILTER (WHERE dd.y IS NOT NULL) AS imitated, arg_min(o.domain, o.at) FILTER (WHERE o.name = n.name) AS same_name, CASE WHEN count(DISTINCT o.site) = 1 THEN min(o.site) END AS one
  FROM t n JOIN t o ON o.thread = n.thread AND o.at < n.at LEFT JOIN dd ON dd.x = n.domain AND dd.y = o.domain GROUP BY n.msg_id, n.domain),
 changes AS (SELECT msg_id, CASE WHEN imitated IS NOT NULL THEN 'lookalike' WHEN same_name IS NOT NULL THEN 'same_name_new_domain' ELSE 'different_domain' END AS variant, host, coalesce(imitated, same_name, one) AS previous FROM p WHERE NOT known AND NOT owned AND coalesce(imitated, same_name, one) IS NOT NULL)"""
_BANK = f"{claim_sql('from_name')}"
_TITLE = r"(?i)\b(?:ceo|cfo|coo|md|managing director|president|chairman)\b"
_EXT = "list_transform(string_split(lower(f.name), '.'), lambda x: trim(x))"
_RISK = f"CASE WHEN len({_EXT}) >= 3 AND list_contains({sql_list(mail.DOCUMENT_TYPES)}, {_EXT}[-2]) AND list_contains({sql_list(mail.RISKY_TYPES)}, {_EXT}[-1]) THEN 'double_extension' WHEN list_contains({sql_list(mail.DOCUMENT_TYPES)}, {_EXT}[-1]) AND regexp_matches(f.type, '^(?:text/html|image/svg.xml)') THEN 'type_mismatch' WHEN list_contains({sql_list(mail.RISKY_TYPES)}, {_EXT}[-1]) THEN 'risky_type' END"
_PROFILE = f"""{src.EMAILS_SQL}, hosts AS (SELECT DISTINCT domain AS host FROM emails UNION SELECT reply_domain FROM emails WHERE reply_domain IS NOT NULL),
 refs AS (SELECT * FROM (VALUES {', '.join([f"('{d}', true)" for d in ORG.domains] + [f"('{t}.invalid', false)" for t in ORG.tokens])}) r(trusted, own)),
 orgs AS (SELECT host, bool_or(own AND relation IN ('same', 'sibling')) AS same, min(CASE WHEN {_ORG_RANK.format('relation')} > 0 THEN {_ORG_RANK.format('relation')} END) AS rank FROM (SELECT host, own, {relation_sql('host', 'trusted')} AS relation FROM hosts, refs) WHERE relation IS NOT NULL GROUP BY host),
 org AS (SELECT host, same, CASE WHEN NOT same THEN {sql_list(mail.TECHNIQUE_ORDER)}[rank] END AS technique FROM orgs WHERE same OR rank IS NOT NULL),
 rel AS (SELECT host, supplier_id, {relation_sql('host', 'sdomain')} AS relation FROM hosts, suppliers),
 sender AS (SELECT host, min(supplier_id) FILTER (WHERE relation IN ('same', 'sibling')) AS own_id, min(supplier_id) FILTER (WHERE relation IN ({_LIKE})) AS like_id FROM rel WHERE relation IS NOT NULL GROUP BY host),
 names AS (SELECT msg_id, min(s.supplier_id) FILTER (WHERE contains(' ' || {_KEY.format('from_name')} || ' ', ' ' || lower(s.name) || ' ')) AS name_id, min(s.supplier_id) FILTER (WHERE contains(' ' || {_KEY.format('subject')} || ' ', ' ' || lower(s.name) || ' ')) AS subject_id FROM emails, suppliers s GROUP BY msg_id),
 e0 AS (SELECT e.*, coalesce(org.same, false) AS internal, org.same AS org_same, technique, coalesce(contains(replace({_KEY.format('from_name')}, ' ', ''), 'aspen'), false) AS claims, own_id, coalesce(name_id, CASE WHEN NOT coalesce(org.same, false) THEN subject_id END, CASE WHEN own_id IS NULL THEN like_id END) AS claimed
  FROM emails e LEFT JOIN org ON org.host = e.domain LEFT JOIN sender ON sender.host = e.domain LEFT JOIN names USING (msg_id)),
 m AS (SELECT e0.*, coalesce(claimed, own_id) AS sid, coalesce(rel.relation, '') AS relation, coalesce(rel.relation IN ('same', 'sibling'), false) AS owned, s.account AS s_account, s.word AS s_word, s.sdomain AS s_domain, {_ENDS} AS ends, nullif({_PAYEE}, '') AS payee
  FROM e0 LEFT JOIN rel ON rel.host = e0.domain AND rel.supplier_id = coalesce(claimed, own_id) LEFT JOIN suppliers s ON s.supplier_id = coalesce(claimed, own_id)),
 q AS (SELECT *, claimed IS NOT NULL AND NOT owned AND NOT internal AS mismatch, coalesce(from_name = 'Doe Jane', false) AND NOT internal AND address <> 'jane.doe@aspen.mu' AS impersonates, coalesce(technique <> 'brand_embedded', false) AS org_like,
  coalesce(NOT internal AND technique IS NOT NULL AND (technique <> 'brand_embedded' OR list_has_any(string_split({label_sql('domain')}, '-'), {_LURES}) OR claims), false) AS imitation,
  CASE WHEN contains(from_name, '@') AND {site_sql("split_part(from_name, '@', 2)")} <> {site_sql('domain')} THEN 'embedded_address' WHEN {_BANK} IS NOT NULL AND NOT {below_sql('domain', ['northbank.com'])} THEN 'institution_name' WHEN regexp_matches(from_name, '{_TITLE}') AND {_free('domain')} THEN 'title_on_freemail' END AS eight,
  CASE WHEN {_KEY.format('from_name')} LIKE '%accounts team%' THEN 'finance' END AS by_name, CASE WHEN local = 'accounts' THEN 'finance' END AS by_local, file AS f,
  CASE WHEN dmarc = 'pass' THEN NULL WHEN dmarc = 'fail' AND (owned OR internal) THEN 'dmarc_fail_known_domain' WHEN dmarc = 'fail' THEN 'dmarc_fail' WHEN spf IN ('fail', 'softfail') AND dkim = 'fail' THEN 'spf_and_dkim_fail' WHEN (spf IN ('fail', 'softfail') AND coalesce(dkim <> 'pass', true)) OR (dkim = 'fail' AND coalesce(spf <> 'pass', true)) THEN 'partial_fail' END AS failed FROM m),
 {_CHANGES},
 mail AS (SELECT msg_id, 1 AS place, 'EMAIL-02' AS code, CASE WHEN relation IN ({_LIKE}) THEN 'lookalike' WHEN relation = 'brand_embedded' THEN 'brand_embedded' WHEN {_free('domain')} THEN 'freemail' ELSE 'unrelated' END AS variant, domain AS host FROM q WHERE mismatch
  UNION ALL SELECT q.msg_id, 2, 'EMAIL-01', CASE WHEN since < struct_pack(t := q.ts, m := q.msg_id) THEN 'in_thread' ELSE '' END, reply_domain FROM q JOIN (SELECT thread, address, min({_AT}) AS since FROM emails GROUP BY thread, address) USING (thread, address)
   WHERE reply_domain IS NOT NULL AND {site_sql('reply_domain')} <> {site_sql('domain')} AND NOT (owned AND (reply_domain = s_domain OR reply_domain LIKE '%.' || s_domain OR {site_sql('reply_domain')} = {site_sql('s_domain')})) AND NOT (internal AND reply_domain IN (SELECT host FROM org WHERE same))
  UNION ALL SELECT msg_id, 3, 'EMAIL-03', failed, NULL FROM q WHERE failed IS NOT NULL
  UNION ALL SELECT msg_id, 4, 'EMAIL-04', variant, host FROM changes
  UNION ALL SELECT msg_id, 5, 'EMAIL-05', {_RISK}, NULL FROM q WHERE f IS NOT NULL AND {_RISK} IS NOT NULL
  UNION ALL SELECT msg_id, 6, 'EMAIL-06', '', NULL FROM q WHERE s_account IS NOT NULL AND len(list_filter(list_concat(ends, CASE WHEN pay_last4 IS NOT NULL THEN [pay_last4] ELSE [] END), lambda x: x <> s_account)) > 0
  UNION ALL SELECT msg_id, 7, 'EMAIL-07', '', NULL FROM q WHERE sid IS NOT NULL AND coalesce(pay_recipient, payee) IS NOT NULL AND NOT list_has_any({_TOKENS.format('coalesce(pay_recipient, payee)')}, ['house', s_word])
  UNION ALL SELECT msg_id, 8, 'EMAIL-10', '', NULL FROM q WHERE (lower(body) LIKE '%pay%' OR lower(body) LIKE '%beneficiary%') AND owned AND address <> 'billing@' || s_domain
  UNION ALL SELECT msg_id, 9, 'EMAIL-09', 'executive', domain FROM q WHERE impersonates
  UNION ALL SELECT msg_id, 10, 'EMAIL-08', eight, domain FROM q WHERE from_name IS NOT NULL AND NOT mismatch AND NOT impersonates AND NOT org_like AND eight IS NOT NULL
  UNION ALL SELECT msg_id, 20, 'ORG-01', technique, domain FROM q WHERE imitation
  UNION ALL SELECT msg_id, 21, 'ORG-03', coalesce(by_name, by_local), domain FROM q WHERE NOT internal AND coalesce(by_name, by_local) IS NOT NULL AND NOT owned AND (claims OR imitation OR {_free('domain')} OR (by_name IS NOT NULL AND by_local IS NOT NULL))
  UNION ALL SELECT msg_id, 22, 'ORG-04', '', NULL FROM q JOIN (SELECT address, recipient, min(ts) AS first_ts FROM emails GROUP BY address, recipient) USING (address, recipient) WHERE NOT internal AND ts - first_ts < {mail.FIRST_CONTACT_SECONDS})"""
_BASE = f"{_PROFILE}, signals AS (SELECT msg_id, ({pipeline.DETECTORS.index('email') << 40} + place)::BIGINT AS ord, code, 'rule' AS source_type, variant, host FROM mail), contexts AS (SELECT msg_id, false AS claimed, false AS semantic_ok FROM emails)"
_TEMPLATE = template_sql("lower(coalesce(body, ''))")
_INDICATORS = f"""{_PROFILE}, gen AS (SELECT host FROM org WHERE same UNION SELECT host FROM rel WHERE relation IN ('same', 'sibling')),
 b0 AS (SELECT msg_id, 1 AS rank, 'sender' AS kind, address, domain AS host FROM emails UNION ALL SELECT msg_id, 2, 'reply', CASE WHEN i % 6 = 0 THEN 'desk@' ELSE 'x@' END || reply_domain, reply_domain FROM emails WHERE reply_domain IS NOT NULL AND {site_sql('reply_domain')} <> {site_sql('domain')}),
 b1 AS (SELECT *, {_free('host')} AS personal FROM b0 WHERE host NOT IN (SELECT host FROM gen)),
 kn AS (SELECT DISTINCT account FROM suppliers WHERE account IS NOT NULL), kw AS (SELECT word AS w FROM suppliers UNION SELECT 'house'),
 a AS (SELECT DISTINCT msg_id, unnest(list_concat(ends, CASE WHEN pay_last4 IS NOT NULL THEN [pay_last4] ELSE [] END)) AS v FROM q),
 pay AS (SELECT msg_id, coalesce(pay_recipient, payee) AS v, {_TOKENS.format('coalesce(pay_recipient, payee)')} AS t FROM q WHERE coalesce(pay_recipient, payee) IS NOT NULL),
 tp AS (SELECT msg_id, trim({_TEMPLATE}) AS t FROM emails),
 x AS (SELECT msg_id, rank, CASE WHEN personal THEN kind || '_address' ELSE kind || '_domain' END AS type, CASE WHEN personal THEN left({hmac_sql(SECRET, "'aspen.mu' || chr(0) || address")}, 32) ELSE {site_sql('host')} END AS value, CASE WHEN personal THEN left(address, 1) || '***@' || host ELSE {site_sql('host')} END AS display FROM b1
  UNION ALL SELECT msg_id, 4, 'account', v, '****' || v FROM a WHERE v NOT IN (SELECT account FROM kn) UNION ALL SELECT msg_id, 5, 'payee', trim({_KEY.format('v')}), v FROM pay WHERE len(t) > 0 AND NOT EXISTS (SELECT 1 FROM kw WHERE list_contains(t, kw.w))
  UNION ALL SELECT msg_id, 6, 'attachment', regexp_replace(lower(f.name), '[0-9]+', '#', 'g'), regexp_replace(lower(f.name), '[0-9]+', '#', 'g') FROM q WHERE f IS NOT NULL AND {_RISK} IS NOT NULL UNION ALL SELECT msg_id, 7, 'template', left(sha256(t), 16), 'matching message template' FROM tp WHERE len(list_filter(string_split(t, ' '), lambda w: w <> '')) >= 5)"""
QUERIES = {"domain_relations": domain_relations, "mail_signals": mail_signals, "mail_verdicts": mail_verdicts, "thread_changes": thread_changes, "supplier_mentions": supplier_mentions, "accounts_before": accounts_before, "mail_indicators": mail_indicators}
ORACLE = {
    "mail_indicators": f"WITH {_INDICATORS} SELECT msg_id, type, value, display FROM x",
    "domain_relations": f"WITH {src.EMAILS_SQL}, r AS (SELECT DISTINCT domain AS host, sdomain AS trusted FROM (SELECT DISTINCT domain FROM emails), (SELECT sdomain FROM suppliers)) SELECT * FROM (SELECT host, trusted, {relation_sql('host', 'trusted')} AS relation FROM r) WHERE relation IS NOT NULL",
    "mail_signals": f"WITH {_BASE} SELECT msg_id, code, variant, host FROM mail",
    "mail_verdicts": verdicts_sql(_BASE),
    "thread_changes": f"WITH {src.EMAILS_SQL}, {_CHANGES} SELECT * FROM changes",
    "supplier_mentions": f"WITH {src.EMAILS_SQL}, x AS (SELECT msg_id, ' ' || {_KEY.format("subject || ' ' || body")} || ' ' AS k FROM emails) SELECT msg_id AS text_id, supplier_id AS name_id, ((len(k) - len(replace(k, ' house ' || word || ' ', '  '))) // (len(word) + 6))::BIGINT AS times FROM x, suppliers WHERE contains(k, ' house ' || word || ' ')",
    "accounts_before": f"WITH {src.EMAILS_SQL}, a AS (SELECT msg_id, ts, local, {_ENDS}[1] AS account FROM emails), l AS (SELECT a.msg_id, a.account, max(struct_pack(t := b.ts, m := b.msg_id, account := b.account)) AS last FROM a LEFT JOIN a b ON b.local = a.local AND b.ts < a.ts AND b.account IS NOT NULL GROUP BY a.msg_id, a.account) SELECT msg_id, account, last.account AS before, coalesce(last.m, -1) AS before_id FROM l",
}
