"""Near-duplicate reports: fingerprints, matching, wave metrics and tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the active wave rules.
LOOKBACK_DAYS = 7
BASELINE_DAYS = 14
BURST_HOURS = 24
HALF_LIFE_DAYS = 7
LEAST_BASELINE = 0.5
MAX_DISTANCE = 6
MIN_TOKENS = 8
WEIGHT_OF = {"user_report": 1.0, "auto_high_confidence": 0.5}
CLUSTER = {"reporters": 3, "human": 1, "decayed": 2.0}
WAVE = {"reporters_24h": 5, "ratio": 3.0}


def round2(x: Column) -> Column:
    """Two decimals, halves upward."""
    return F.floor(x * 100 + 0.5) / 100.0


def template(text: Column) -> Column:
    """What stays of a message when its particulars go: lower-cased, marks stripped (Latin letters), placeholders as ph, links as hosts, digit runs as #, punctuation dropped."""
    t = F.lower(text)
    t = F.translate(t, "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    t = F.regexp_replace(t, r"\[(?:phone|email|account)[^\]]*\](?:@[^\s]+)?", " ph ")
    t = F.regexp_replace(t, r"(?:https?://)?(?:www\.)?((?:[a-z0-9-]+\.)+[a-z]{2,10})(?:/[^\s]*)?", " $1 ")
    t = F.regexp_replace(t, r"[0-9]+(?:[.,\s][0-9]+)*", " # ")
    t = F.regexp_replace(t, r"[^\p{L}\p{N}#.\s-]", " ")
    t = F.regexp_replace(t, r"(^|[^\p{L}])[.-]+", "$1 ")
    t = F.regexp_replace(t, r"[.-]+([^\p{L}]|$)", " $1")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def template_hash(normal: Column) -> Column:
    return F.left(F.sha2(normal.cast("binary"), 256), F.lit(16))


def fingerprints(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, template_hash, simhash (long), token_count for each row.

    A bit of the SimHash is set if more tokens' SHA-1 have it than not. Rows
    of equal template share one computation: distinct templates are exploded,
    64 conditional sums aggregate them on the map side.
    """
    t = rows.select(F.col(key), template(F.col(text)).alias("tpl"))
    distinct = t.select("tpl").distinct()
    words = distinct.select("tpl", F.explode(F.split("tpl", " ")).alias("w")).where("w <> ''")
    h = F.conv(F.substring(F.sha1(F.col("w").cast("binary")), 1, 16), 16, -10).cast("long")
    words = words.select("tpl", h.alias("h"))
    sums = words.groupBy("tpl").agg(F.count("*").alias("token_count"), *[F.sum(F.when(F.expr(f"getbit(h, {b})") == 1, 1).otherwise(-1)).alias(f"b{b}") for b in range(64)])
    bits = F.array(*[F.when(F.col(f"b{b}") > 0, F.lit(1 << b if b < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long")) for b in range(64)])
    hashed = sums.select("tpl", "token_count", F.aggregate(bits, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x)).alias("simhash"))
    joined = t.join(hashed, "tpl", "left")
    return joined.select(key, template_hash(F.col("tpl")).alias("template_hash"), F.coalesce("simhash", F.lit(0).cast("long")).alias("simhash"), F.coalesce("token_count", F.lit(0)).cast("long").alias("token_count"))


def near_templates(prints: DataFrame, distance: int = MAX_DISTANCE, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """Pairs a < b of distinct template hashes whose SimHashes differ in 1..``distance`` bits or none.

    Seven disjoint bands of the 64 bits: any two within six bits agree in a
    band, so an equi-join on (band, value) finds all; the row count of the
    join depends on distinct templates, not on their copies.
    """
    one = prints.where(F.col("token_count") >= min_tokens).groupBy("template_hash").agg(F.first("simhash").alias("simhash"))
    n = distance + 1
    edges = [64 * i // n for i in range(n + 1)]
    bands = F.array(*[F.expr(f"shiftrightunsigned(shiftleft(simhash, {64 - hi}), {64 - hi + lo})") for lo, hi in zip(edges, edges[1:], strict=False)])
    dealt = one.select("template_hash", "simhash", F.posexplode(bands).alias("band", "value"))
    a, b = (dealt.select("band", "value", F.col("template_hash").alias(f"{x}_hash"), F.col("simhash").alias(f"{x}_sim")) for x in "ab")
    d = F.bit_count(F.col("a_sim").bitwiseXOR(F.col("b_sim")))
    return a.join(b, ["band", "value"]).where((F.col("a_hash") < F.col("b_hash")) & (d <= distance)).select("a_hash", "b_hash", d.alias("distance")).distinct()


def match_reasons(candidates: DataFrame, events: DataFrame) -> DataFrame:
    """Which events belong to which candidates, and why: cand_id, event_id, reasons (sorted).

    Reasons: same template, near-duplicate (only if not the same template),
    shared look-alike host, same sender. Each is an equi-join of its own;
    their union is grouped. Candidates and events have id, template_hash,
    simhash, token_count, hosts (array) and sender_key.
    """
    c = candidates.select(F.col("id").alias("cand_id"), F.col("template_hash").alias("c_hash"), F.col("simhash").alias("c_sim"), F.col("token_count").alias("c_n"), F.col("hosts").alias("c_hosts"), F.col("sender_key").alias("c_sender"))
    e = events.select(F.col("id").alias("event_id"), "template_hash", "simhash", "token_count", "hosts", "sender_key")
    same = c.join(e, F.col("c_hash") == F.col("template_hash")).select("cand_id", "event_id", F.lit("template").alias("reason"))
    pairs = near_templates(candidates.select("template_hash", "simhash", "token_count").unionAll(events.select("template_hash", "simhash", "token_count")))
    both = pairs.select("a_hash", "b_hash").unionAll(pairs.select(F.col("b_hash"), F.col("a_hash")))
    near = c.where(F.col("c_n") >= MIN_TOKENS).join(both, F.col("c_hash") == F.col("a_hash")).join(e.where(F.col("token_count") >= MIN_TOKENS), F.col("b_hash") == F.col("template_hash")).select("cand_id", "event_id", F.lit("near_duplicate").alias("reason"))
    host = c.select("cand_id", F.explode(F.array_distinct("c_hosts")).alias("h")).join(e.select("event_id", F.explode(F.array_distinct("hosts")).alias("h")), "h").select("cand_id", "event_id", F.lit("lookalike_host").alias("reason"))
    sender = c.join(e, F.col("c_sender") == F.col("sender_key")).select("cand_id", "event_id", F.lit("sender").alias("reason"))
    return same.unionAll(near).unionAll(host).unionAll(sender).groupBy("cand_id", "event_id").agg(F.sort_array(F.collect_set("reason")).alias("reasons"))


def wave_metrics(matched: DataFrame, group: list[str], now: Column) -> DataFrame:
    """Per group of matched events: counts, reporters, burst, baseline, decayed weight, first and last sight.

    ``matched`` has id, created_at, origin and reporter. An event counts from
    age 0 to 7 days, both ends included; the baseline is older than 24 hours
    and up to 14 days more; future events count nowhere.
    """
    weight = F.lit(0.0)
    for origin, w in WEIGHT_OF.items():
        weight = F.when(F.col("origin") == origin, w).otherwise(weight)
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp"))) / 1e6
    m = matched.withColumn("w", weight).withColumn("age", age)
    seen = (F.col("age") >= 0) & (F.col("age") <= LOOKBACK_DAYS * 86400)
    burst = seen & (F.col("age") <= BURST_HOURS * 3600)
    base = (F.col("age") > BURST_HOURS * 3600) & (F.col("age") <= BURST_HOURS * 3600 + BASELINE_DAYS * 86400)
    total = lambda c, x: F.coalesce(F.sum(F.when(c, x)), F.lit(0.0))
    out = m.groupBy(*group).agg(
        F.count_if(seen).alias("matched_events"),
        F.countDistinct(F.when(seen, F.col("reporter"))).alias("distinct_reporters"),
        F.count_if(seen & (F.col("origin") == "user_report")).alias("human_reports"),
        F.countDistinct(F.when(burst, F.col("reporter"))).alias("distinct_reporters_24h"),
        total(burst, F.col("w")).alias("burst_weight"),
        F.greatest(F.lit(LEAST_BASELINE), total(base, F.col("w")) / BASELINE_DAYS).alias("per_day"),
        total(seen, F.col("w") * F.pow(F.lit(0.5), F.col("age") / (HALF_LIFE_DAYS * 86400))).alias("decayed"),
        F.min(F.when(seen, F.col("created_at"))).alias("first_seen"),
        F.max(F.when(seen, F.col("created_at"))).alias("last_seen"),
    )
    return out.select(
        *group, "matched_events", "distinct_reporters", "human_reports", "distinct_reporters_24h", round2(F.col("burst_weight")).alias("weight_24h"), round2(F.col("per_day")).alias("baseline_per_day"),
        round2(F.col("burst_weight") / F.col("per_day")).alias("burst_ratio"), round2(F.col("decayed")).alias("decayed_weight"), "first_seen", "last_seen",
    )


def tier(metrics: DataFrame) -> DataFrame:
    """Adds ``tier``: wave, cluster or null. A wave is a cluster that also bursts."""
    cluster = (F.col("distinct_reporters") >= CLUSTER["reporters"]) & (F.col("human_reports") >= CLUSTER["human"]) & (F.col("decayed_weight") >= CLUSTER["decayed"])
    wave = (F.col("distinct_reporters_24h") >= WAVE["reporters_24h"]) & (F.col("burst_ratio") >= WAVE["ratio"])
    return metrics.withColumn("tier", F.when(cluster & wave, "wave").when(cluster, "cluster"))
