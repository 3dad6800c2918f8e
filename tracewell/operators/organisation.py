"""Organisation intelligence: indicators shared by emails, labels, reputation, campaigns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators.ranking import numbered
from tracewell.sources.scratch import written

# Fixed values of the campaign rules.
WINDOW_DAYS = 14
MIN_MESSAGES = 3
STRONG_TYPES = ["account", "payee", "link"]
BENIGN = ["legitimate", "false_positive"]
FRAUD = ["confirmed_fraud", "confirmed_phishing", "confirmed_bec", "supplier_impersonation"]


def consensus(outcomes: DataFrame) -> DataFrame:
    """input_hash, label, votes: the majority label; a tie goes to the label voted for last, then by name."""
    by_label = outcomes.groupBy("input_hash", "label").agg(F.count("*").alias("n"), F.max("created_at").alias("last"))
    best = Window.partitionBy("input_hash").orderBy(F.desc("n"), F.desc("last"), "label")
    votes = Window.partitionBy("input_hash")
    t = by_label.withColumn("turn", F.row_number().over(best)).withColumn("votes", F.sum("n").over(votes))
    return t.where("turn = 1").select("input_hash", "label", F.col("votes").cast("long").alias("votes"))


def latest_outcomes(outcomes: DataFrame) -> DataFrame:
    """One label per email and analyst: the last one written."""
    return outcomes.groupBy("input_hash", "analyst").agg(F.max_by("label", F.struct("created_at", "label")).alias("label"), F.max("created_at").alias("created_at"))


def campaigns(indicators: DataFrame, labels: DataFrame, since: Column) -> DataFrame:
    """Indicators that three or more flagged emails share: messages, senders, recipients, first and last sight.

    ``indicators`` has input_hash, indicator (type:value), sender, recipient,
    created_at and flagged. Emails labelled benign don't count. An indicator
    must be company-wide (two senders or recipients) or of a strong type.
    """
    benign = labels.where(F.col("label").isin(BENIGN)).select("input_hash")
    rows = indicators.where(F.col("flagged") & (F.col("created_at") >= since)).join(benign, "input_hash", "left_anti")
    g = rows.groupBy("indicator").agg(F.countDistinct("input_hash").alias("messages"), F.countDistinct("sender").alias("senders"), F.countDistinct("recipient").alias("recipients"), F.min("created_at").alias("first_seen"), F.max("created_at").alias("last_seen"))
    strong = F.substring_index("indicator", ":", 1).isin(STRONG_TYPES)
    g = g.where((F.col("messages") >= MIN_MESSAGES) & ((F.col("senders") >= 2) | (F.col("recipients") >= 2) | strong))
    return g.withColumn("campaign_id", F.concat(F.lit("OC-"), F.left(F.sha2(F.col("indicator").cast("binary"), 256), F.lit(12))))


def indicator_peers(indicators: DataFrame) -> DataFrame:
    """How many other emails share an indicator with each email.

    Counted from group sizes: pairs within an indicator are never made. An
    email that shares several indicators with another counts it once per
    indicator.
    """
    pairs = indicators.select("input_hash", "indicator").distinct()
    sizes = pairs.groupBy("indicator").agg((F.count("*") - 1).alias("others"))
    return pairs.join(sizes, "indicator").groupBy("input_hash").agg(F.sum("others").alias("peer_links"), F.count_if(F.col("others") > 0).alias("shared_indicators"))


def domain_reputation(emails: DataFrame) -> DataFrame:
    """Per sender domain: emails, flagged ones, distinct recipients, first and last sight."""
    return emails.groupBy("sender_domain").agg(F.count("*").alias("emails"), F.count_if("flagged").alias("flagged"), F.countDistinct("recipient").alias("recipients"), F.min("created_at").alias("first_seen"), F.max("created_at").alias("last_seen"))


def confirmed_fraud(emails: DataFrame, indicators: DataFrame, labels: DataFrame) -> DataFrame:
    """For each email, the strongest earlier evidence of fraud: by its sender, else an indicator, else its domain.

    input_hash, basis (sender, indicator, domain) and count of other emails
    that analysts confirmed as fraud. Counts per key come from aggregates, so
    emails are never paired.
    """
    # Both are read several times below.
    fraud = written(labels.where(F.col("label").isin(FRAUD)).select("input_hash", F.lit(1).alias("f")), "fraud").hint("merge")
    e = emails.select("input_hash", "sender", "sender_domain").distinct().join(fraud, "input_hash", "left").fillna(0, ["f"])
    by_sender = e.groupBy("sender").agg(F.sum("f").alias("by_sender"))
    by_domain = e.groupBy("sender_domain").agg(F.sum("f").alias("by_domain"))
    ind = written(indicators.where(~F.startswith("indicator", F.lit("sender_"))).select("input_hash", "indicator").distinct().join(fraud, "input_hash", "left").fillna(0, ["f"]), "indicators")
    by_ind = ind.groupBy("indicator").agg(F.sum("f").alias("n"))
    best = ind.join(by_ind, "indicator").groupBy("input_hash").agg(F.max(F.col("n") - F.col("f")).alias("by_indicator"))
    t = e.join(by_sender.hint("merge"), "sender").join(by_domain, "sender_domain").join(best.hint("merge"), "input_hash", "left")
    s, d, i = F.col("by_sender") - F.col("f"), F.col("by_domain") - F.col("f"), F.coalesce("by_indicator", F.lit(0))
    t = t.select("input_hash", F.when(s > 0, "sender").when(i > 0, "indicator").when(d > 0, "domain").alias("basis"), F.when(s > 0, s).when(i > 0, i).otherwise(d).cast("long").alias("n"))
    return t.where("basis IS NOT NULL")


def first_contact(emails: DataFrame, days: int = 7) -> DataFrame:
    """Per email whether its sender was first seen with it or within ``days`` before: input_hash, first_contact, earlier."""
    seen = emails.groupBy(F.col("sender").alias("_sender")).agg(F.min("created_at").alias("seen"))
    e = numbered(emails.select("input_hash", "sender", "created_at"), ["sender"], ["created_at", "input_hash"], "place").join(seen, F.col("sender").eqNullSafe(F.col("_sender")))
    return e.select("input_hash", (F.col("created_at") - F.make_interval(days=F.lit(days)) <= F.col("seen")).alias("first_contact"), (F.col("place") - 1).alias("earlier"))
