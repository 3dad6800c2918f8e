"""Indicators that emails of one campaign share: senders, replies, links, accounts, payees, files, templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions import hosts as h
from tracewell.functions import keyed
from tracewell.operators import community, domains, links, mail
from tracewell.operators.identity import Institution, name_tokens, registry_frames
from tracewell.sources.scratch import dealt, written

# Results depend on them.
MAX_INDICATORS = 20
MIN_TEMPLATE_TOKENS = 5
KINDS = ["sender", "reply", "link", "account", "payee", "attachment", "template"]
# End of the fixed values.


def generic_domains(hosts: DataFrame, suppliers: DataFrame, org: mail.Organisation, registry: list[Institution]) -> DataFrame:
    """Hosts that can't tell a campaign: the organisation's own, known suppliers', institutions', shorteners: host."""
    spark = hosts.sparkSession
    own = mail.organisation_relations(hosts, org).where("relation = 'same'").select("host")
    known = domains.relations(hosts, suppliers.select(F.explode("domains").alias("domain"))).where("relation IN ('same', 'sibling')").select("host")
    official = domains.below(hosts, registry_frames(spark, registry)[1].select("domain")).select("host")
    short = hosts.select("host").where(h.registrable_domain(F.col("host")).isin(h.SHORTENERS))
    return own.unionAll(known).unionAll(official).unionAll(short).distinct()


def masked(address: Column) -> Column:
    return F.concat(F.left(address, F.lit(1)), F.lit("***@"), F.substring_index(address, "@", -1))


def indicators(emails: DataFrame, suppliers: DataFrame, org: mail.Organisation, registry: list[Institution], secret: str) -> DataFrame:
    """msg_id, place, type, value, display: at most MAX_INDICATORS an email, in the order of KINDS.

    Personal mailboxes appear as keyed pseudonyms with a masked display,
    other senders as their site. Accounts on any supplier's record and payees
    that share a word with any known beneficiary are no indicators; both are
    looked up by equal keys, so suppliers may be many. A value counts once a
    type and email. Every kind reads the emails, which are written once; what
    they are looked up in grows with hosts or suppliers and isn't broadcast.
    """
    e = emails.select("msg_id", "text", "reply_to", "attachments", "pay_recipient", "pay_last4", F.lower("from_address").alias("address"), mail.domain_of(F.col("from_address")).alias("domain"))
    e = dealt(written(e, "indicator-mail"), mail.EMAILS_A_TASK, "msg_id")
    box = e.where("domain IS NOT NULL").select("msg_id", F.lit("sender").alias("kind"), F.lit(0).alias("k"), "address", F.col("domain").alias("host"))
    reply = e.select("msg_id", "domain", F.posexplode("reply_to").alias("k", "r")).select("msg_id", F.lit("reply").alias("kind"), "k", F.lower(F.trim("r")).alias("address"), mail.domain_of(F.col("r")).alias("host"), "domain").where("host IS NOT NULL")
    reply = reply.where(domains_differ(F.col("host"), F.col("domain"))).drop("domain")
    link = links.extract_links(e.select("msg_id", "text")).select("msg_id", F.lit("link").alias("kind"), F.col("ord").cast("int").alias("k"), F.lit(None).cast("string").alias("address"), "host")
    hosted = written(box.unionByName(reply).unionByName(link), "indicator-hosts")
    generic = written(generic_domains(written(hosted.select("host").distinct(), "indicator-sites"), suppliers, org, registry), "generic")
    hosted = hosted.join(generic.hint("merge"), "host", "left_anti")
    personal = (F.col("kind") != "link") & mail.freemail(F.col("host"))
    site = h.registrable_domain(F.col("host"))
    value = F.when(personal, keyed.pseudonym(F.lit(secret), F.lit(org.domains[0]), F.col("address"))).otherwise(site)
    kind = F.when(F.col("kind") == "link", "link").when(personal, F.concat("kind", F.lit("_address"))).otherwise(F.concat("kind", F.lit("_domain")))
    out = hosted.select("msg_id", F.array_position(F.array(*[F.lit(x) for x in KINDS]), F.col("kind")).cast("int").alias("rank"), "k", kind.alias("type"), value.alias("value"), F.when(personal, masked(F.col("address"))).otherwise(site).alias("display"))
    row = lambda df, name, value, display: df.select("msg_id", F.lit(KINDS.index(name) + 1).alias("rank"), "k", F.lit(name).alias("type"), value.alias("value"), display.alias("display"))
    asked = F.array_distinct(F.concat(mail.account_ends(F.col("text")), F.when(F.col("pay_last4").isNotNull(), F.array("pay_last4")).otherwise(F.array().cast("array<string>"))))
    accounts = e.select("msg_id", F.posexplode(asked).alias("k", "v")).join(suppliers.select(F.explode("accounts").alias("v")).distinct().hint("merge"), "v", "left_anti")
    out = out.unionAll(row(accounts, "account", F.col("v"), F.concat(F.lit("****"), "v")))
    paid = e.select("msg_id", F.lit(0).alias("k"), F.coalesce("pay_recipient", mail.payee(F.col("text"))).alias("v")).where("v IS NOT NULL").withColumn("t", name_tokens(F.col("v"))).where(F.size("t") > 0)
    words = suppliers.select(F.explode("beneficiaries").alias("b")).select(F.explode(name_tokens(F.col("b"))).alias("w")).distinct()
    met = paid.select("msg_id", F.explode("t").alias("w")).join(words.hint("merge"), "w", "left_semi").select("msg_id").distinct()
    out = out.unionAll(row(paid.join(met.hint("merge"), "msg_id", "left_anti"), "payee", mail.key(F.col("v")), F.col("v")))
    risky = F.filter(F.coalesce("attachments", F.array().cast("array<struct<name:string,type:string>>")), lambda a: mail.attachment_risk(a["name"], a["type"]).isNotNull())
    hidden = F.filter(risky, lambda a: mail.attachment_risk(a["name"], a["type"]) != "risky_type")
    files = e.select("msg_id", F.lit(0).alias("k"), F.lower(F.coalesce(F.get(hidden, F.lit(0)), F.get(risky, F.lit(0)))["name"]).alias("v")).where("v IS NOT NULL")
    name = F.regexp_replace("v", r"\d+", "#")
    out = out.unionAll(row(files, "attachment", name, name))
    plain = e.select("msg_id", F.lit(0).alias("k"), community.template(F.coalesce("text", F.lit(""))).alias("t")).where(F.size(F.filter(F.split("t", " "), lambda w: w != "")) >= MIN_TEMPLATE_TOKENS)
    out = out.unionAll(row(plain, "template", community.template_hash(F.col("t")), F.lit("matching message template")))
    once = out.groupBy("msg_id", "type", "value").agg(F.min_by(F.struct("rank", "k", "display"), F.struct("rank", "k")).alias("x")).select("msg_id", "type", "value", "x.*")
    order = Window.partitionBy("msg_id").orderBy("rank", "k", "type", "value")
    return once.withColumn("place", F.row_number().over(order)).where(F.col("place") <= MAX_INDICATORS).select("msg_id", F.col("place").cast("long").alias("place"), "type", "value", "display")


def domains_differ(a: Column, b: Column) -> Column:
    return F.coalesce(h.registrable_domain(a) != h.registrable_domain(b), F.lit(True))
