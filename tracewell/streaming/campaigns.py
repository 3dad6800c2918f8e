"""Campaigns that batches of assessed messages add to: counts, senders and domains by fingerprint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators.links import slug
from tracewell.sources.scratch import written
from tracewell.streaming.store import KeyedStore

#: Senders that a redaction has taken out name nobody. Fixed value.
REDACTED = r"(?i)\[(?:phone|redacted|account|email)"


def fingerprint(scam_type: Column, identity: Column) -> Column:
    """The claimed identity's slug, else the type's own unknown one."""
    name = F.nullif(F.trim(F.regexp_replace(identity, r"\s+", " ")), F.lit(""))
    return F.when(name.isNotNull(), slug(F.left(name, F.lit(200)))).otherwise(F.concat(scam_type, F.lit("-unknown")))


class Campaigns:
    """Three stores below one folder: campaigns, their senders, their domains.

    All merges are sums, least and greatest values and sets of keys, so
    batches in any order end alike, and one that runs again counts once.
    """

    def __init__(self, path: str, buckets: int = 64) -> None:
        self.main = KeyedStore(f"{path}/campaigns", "campaign string, scam_type string, identity string, messages long, ts timestamp", ("campaign",), "ts", {"scam_type": "first", "identity": "first", "messages": "sum"}, buckets)
        self.senders = KeyedStore(f"{path}/senders", "campaign string, sender string, ts timestamp", ("campaign", "sender"), "ts", {}, buckets)
        self.domains = KeyedStore(f"{path}/domains", "campaign string, domain string, ts timestamp", ("campaign", "domain"), "ts", {}, buckets)

    def known(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        """campaign, messages, n_senders, n_domains as they were before a version, or as they are."""
        count = lambda store, name: store.read(spark, before).groupBy("campaign").agg(F.count("*").alias(name))
        out = self.main.read(spark, before).select("campaign", "messages")
        return out.join(count(self.senders, "n_senders"), "campaign", "left").join(count(self.domains, "n_domains"), "campaign", "left").fillna(0, ["n_senders", "n_domains"])

    def matches(self, batch: DataFrame, before: int | None) -> DataFrame:
        """msg_id, campaign, match ('matched' or 'new') and the counts before, of each message with a type that isn't safe."""
        rows = self._flagged(batch).select("msg_id", "campaign").join(self.known(batch.sparkSession, before), "campaign", "left")
        return rows.select("msg_id", "campaign", F.when(F.col("messages").isNull(), "new").otherwise("matched").alias("match"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("messages", "n_senders", "n_domains")])

    def record(self, batch: DataFrame, version: int) -> None:
        """Add a batch (msg_id, ts, verdict, scam_type, identity, sender, domains, share) as version ``version``. Messages whose senders don't share are left out of all stores."""
        # Three stores read them: fingerprints and names are made once.
        rows = written(self._flagged(batch.where("share")).select("campaign", "scam_type", "identity", "sender", "domains", "ts"), "flagged")
        self.main.put(rows.select("campaign", "scam_type", "identity", F.lit(1).cast("long").alias("messages"), "ts"), version)
        sender = F.nullif(F.left(F.trim(F.regexp_replace("sender", r"\s+", " ")), F.lit(200)), F.lit(""))
        self.senders.put(rows.select("campaign", sender.alias("sender"), "ts").where(F.col("sender").isNotNull() & ~F.rlike("sender", F.lit(REDACTED))), version)
        self.domains.put(rows.select("campaign", F.explode("domains").alias("domain"), "ts").select("campaign", F.nullif(F.lower(F.trim("domain")), F.lit("")).alias("domain"), "ts"), version)

    def _flagged(self, batch: DataFrame) -> DataFrame:
        return batch.where("verdict <> 'safe' AND scam_type IS NOT NULL").withColumn("campaign", fingerprint(F.col("scam_type"), F.col("identity")))
