"""Deterministic emails and suppliers over the events and supplier tables, with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators.mail import Organisation
from tracewell.sources.messages import EVENTS_A_TASK, sql_list
from tracewell.sources.scratch import dealt

ORGANISATION = Organisation("Aspen Group", ["aspen.mu"], ["aspen"], [("Jane Doe", "executive", ["jane.doe@aspen.mu"]), ("Ravi Patel", "employee", ["ravi@aspen.mu"])], [("finance", ["accounts team", "finance desk"], ["accounts@aspen.mu"]), ("it", ["it helpdesk"], ["helpdesk@aspen.mu"])])
FROM_NAMES = ["{s}", "Accounts Team", "Doe Jane", "", "billing@{d}", "North Bank support", "CEO office"]
SUBJECTS = ["Invoice from {s}", "Hello", "Payment of {s} and others", "Re: meeting", "Your order"]
BODIES = ["Please pay account number 55512{n} today", "Beneficiary: {s}\nThanks", "See you tomorrow", "Compte se terminant par {a}, merci", "Payee: Someone Else\n****{a}"]
#: Suppliers that are broadcast to the events.
MOST_BROADCAST = 10_000
FILES = [("invoice.pdf.exe", "application/pdf"), ("terms.pdf", "text/html"), ("photo.jpg", "image/jpeg"), ("setup.msi", "application/octet-stream")]


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """supplier_id, name, domains, accounts, beneficiaries, addresses of every supplier; each third one has no account on record."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("long").alias("supplier_id"))
    s = s.withColumn("word", F.left(F.md5(F.col("supplier_id").cast("string").cast("binary")), F.lit(9)))
    domain = F.concat(F.lit("tr"), "word", F.lit(".com"))
    account = F.lpad(((F.col("supplier_id") * 7919) % 10000).cast("string"), 4, "0")
    return s.select(
        "supplier_id", F.concat(F.lit("House "), "word", F.lit(" Trading")).alias("name"), F.array(domain).alias("domains"),
        F.when(F.col("supplier_id") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(account)).alias("accounts"),
        F.array(F.concat(F.lit("House "), "word", F.lit(" Ltd"))).alias("beneficiaries"), F.array(F.concat(F.lit("billing@"), domain)).alias("addresses"),
    )


SUPPLIERS_SQL = """suppliers AS (SELECT s_suppkey::BIGINT AS supplier_id, md5(s_suppkey::VARCHAR)[1:9] AS word, 'House ' || word || ' Trading' AS name, 'tr' || word || '.com' AS sdomain,
 CASE WHEN s_suppkey % 3 <> 0 THEN lpad(((s_suppkey * 7919) % 10000)::VARCHAR, 4, '0') END AS account FROM supplier)"""


def _filled(texts: list[str], at: F.Column) -> F.Column:
    text = F.element_at(F.array(*[F.lit(x) for x in texts]), (at % len(texts) + 1).cast("int"))
    for mark, value in (("{s}", F.col("name")), ("{d}", F.col("sdomain")), ("{n}", F.lpad((F.col("msg_id") % 10000).cast("string"), 4, "0")), ("{a}", F.lpad(((F.col("supplier_id") * 7919) % 10000).cast("string"), 4, "0"))):
        text = F.replace(text, F.lit(mark), value)
    return text


def emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One email an event, about some supplier: the columns that operators.mail reads."""
    s = suppliers(spark, sf_dir).select("supplier_id", "name", F.col("domains")[0].alias("sdomain"))
    n = s.count()
    e = dealt(spark.read.parquet(f"{sf_dir}/events.parquet"), EVENTS_A_TASK, "event_id").select(F.col("event_id").cast("long").alias("msg_id"), F.unix_timestamp("ts").alias("ts"), "user_id")
    i, label = F.col("msg_id"), F.replace("sdomain", F.lit(".com"), F.lit(""))
    s = s.withColumn("slot", F.col("supplier_id") % n)
    e = e.withColumn("slot", F.floor(i / 2) % n).join(s if n <= MOST_BROADCAST else s.hint("merge"), "slot")
    kind = i % 9
    host = (
        F.when(i % 11 == 0, "aspen.mu").when(i % 13 == 0, "aspen-login.com").when(i % 17 == 0, "asp1en.mu").when(kind == 2, F.concat(label, F.lit("x.com"))).when(kind == 3, F.concat(label, F.lit(".net")))
        .when(kind == 4, F.concat(label, F.lit("-pay.com"))).when(kind == 5, "gmail.com").when(kind == 6, F.concat(F.lit("mail"), (F.col("user_id") % 50).cast("string"), F.lit(".org"))).when(kind == 7, F.concat(F.lit("a."), "sdomain")).otherwise(F.col("sdomain"))
    )
    local = F.element_at(F.array(*[F.lit(x) for x in ("billing", "accounts", "jane.doe", "info")]), (i % 4 + 1).cast("int"))
    none = F.array().cast("array<struct<name:string,type:string>>")
    file = F.element_at(F.array(*[F.struct(F.lit(a).alias("name"), F.lit(b).alias("type")) for a, b in FILES]), (i % 4 + 1).cast("int"))
    return e.select(
        "msg_id", "ts", F.concat(F.lit("t"), (F.col("user_id") % 500).cast("string")).alias("thread"), F.nullif(_filled(FROM_NAMES, i), F.lit("")).alias("from_name"), F.concat(local, F.lit("@"), host).alias("from_address"),
        F.concat(F.lit("ap"), (i % 3).cast("string"), F.lit("@aspen.mu")).alias("recipient"), _filled(SUBJECTS, F.floor(i / 3)).alias("subject"), _filled(BODIES, F.floor(i / 5)).alias("text"),
        F.when(i % 6 == 0, F.array(F.concat(F.lit("desk@reply"), (F.col("user_id") % 20).cast("string"), F.lit(".net")))).when(i % 6 == 1, F.array(F.concat(F.lit("x@b."), host))).otherwise(F.array().cast("array<string>")).alias("reply_to"),
        F.when(i % 8 < 2, "fail").when(i % 8 == 2, "softfail").when(i % 8 == 3, "pass").alias("spf"), F.when(i % 8 == 0, "fail").when(i % 8 == 2, "pass").alias("dkim"), F.when(i % 16 < 4, F.when(i % 3 == 0, "fail").otherwise("none")).when(i % 16 == 11, "pass").alias("dmarc"),
        F.when(i % 5 == 0, F.array(file)).when(i % 5 == 1, F.array(F.struct(F.lit("notes.txt").alias("name"), F.lit(None).cast("string").alias("type")), file)).otherwise(none).alias("attachments"),
        F.when(i % 10 == 0, "House Ltd").alias("pay_recipient"), F.when(i % 14 == 0, "0000").alias("pay_last4"),
    )


def _filled_sql(texts: list[str], at: str) -> str:
    text = f"{sql_list(texts)}[(({at}) % {len(texts)})::INT + 1]"
    for mark, value in (("{s}", "name"), ("{d}", "sdomain"), ("{n}", "lpad((event_id % 10000)::VARCHAR, 4, '0')"), ("{a}", "lpad(((supplier_id * 7919) % 10000)::VARCHAR, 4, '0')")):
        text = f"replace({text}, '{mark}', {value})"
    return text.replace("\n", "' || chr(10) || '")


_HOST = """CASE WHEN i % 11 = 0 THEN 'aspen.mu' WHEN i % 13 = 0 THEN 'aspen-login.com' WHEN i % 17 = 0 THEN 'asp1en.mu' WHEN i % 9 = 2 THEN 'tr' || word || 'x.com' WHEN i % 9 = 3 THEN 'tr' || word || '.net' WHEN i % 9 = 4 THEN 'tr' || word || '-pay.com'
 WHEN i % 9 = 5 THEN 'gmail.com' WHEN i % 9 = 6 THEN 'mail' || (user_id % 50) || '.org' WHEN i % 9 = 7 THEN 'a.' || sdomain ELSE sdomain END"""
_FILE = "[" + ", ".join(f"{{'name': '{a}', 'type': '{b}'}}" for a, b in FILES) + "][(i % 4)::INT + 1]"
EMAILS_SQL = f"""{SUPPLIERS_SQL},
emails AS (SELECT event_id AS msg_id, i, epoch(ts)::BIGINT AS ts, 't' || (user_id % 500) AS thread, nullif({_filled_sql(FROM_NAMES, 'i')}, '') AS from_name, {_HOST} AS domain, ['billing', 'accounts', 'jane.doe', 'info'][(i % 4)::INT + 1] AS local, local || '@' || domain AS address,
 'ap' || (i % 3) || '@aspen.mu' AS recipient, {_filled_sql(SUBJECTS, 'i // 3')} AS subject, {_filled_sql(BODIES, 'i // 5')} AS body,
 CASE WHEN i % 6 = 0 THEN 'reply' || (user_id % 20) || '.net' WHEN i % 6 = 1 THEN 'b.' || domain END AS reply_domain,
 CASE WHEN i % 8 < 2 THEN 'fail' WHEN i % 8 = 2 THEN 'softfail' WHEN i % 8 = 3 THEN 'pass' END AS spf, CASE WHEN i % 8 = 0 THEN 'fail' WHEN i % 8 = 2 THEN 'pass' END AS dkim, CASE WHEN i % 16 < 4 THEN CASE WHEN i % 3 = 0 THEN 'fail' ELSE 'none' END WHEN i % 16 = 11 THEN 'pass' END AS dmarc,
 CASE WHEN i % 5 < 2 THEN {_FILE} END AS file, CASE WHEN i % 10 = 0 THEN 'House Ltd' END AS pay_recipient, CASE WHEN i % 14 = 0 THEN '0000' END AS pay_last4
 FROM (SELECT event_id, event_id AS i, ts, user_id FROM events) e JOIN suppliers ON (i // 2) % (SELECT count(*) FROM suppliers) = supplier_id % (SELECT count(*) FROM suppliers))"""
