"""Signals to findings to a score, level, decision and trace, without a UDF.

Signals have ``msg_id``, ``ord`` (arrival), ``code``, ``source_type``,
``variant`` and ``host``; contexts have ``msg_id``, ``claimed`` and
``semantic_ok``. Everything groups by message, so the first shuffle by msg_id
serves all later steps; rulesets are a few hundred broadcast rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.plans.ruleset import BANDS, CAP_LEXICON, CAP_SEMANTIC, IMPERSONATION, Ruleset, ruleset
from tracewell.sources.scratch import dealt, written

#: Signals whose messages one task scores: their groups are held in memory.
SIGNALS_A_TASK = 50_000

LEVELS = [level for level, _ in BANDS]


def level_rank(total: Column) -> Column:
    """0 low, 1 elevated, 2 high, 3 critical."""
    out = F.lit(0)
    for i, (_, least) in enumerate(BANDS):
        out = F.when(total >= least, i).otherwise(out)
    return out


def level_name(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in LEVELS]), rank + 1)


def verdict(level: Column) -> Column:
    return F.when(level == "low", "safe").when(level == "elevated", "suspicious").otherwise("scam")


def pointed(signals: DataFrame, rules: Ruleset) -> DataFrame:
    """Adds ``points``: by variant, else by source type, else the code's default, else 0."""
    weights, _, _ = rules.frames(signals.sparkSession)
    out = signals
    for name, key in (("v", F.concat(F.lit("v:"), "variant")), ("s", F.concat(F.lit("s:"), "source_type")), ("d", F.lit("d"))):
        w = F.broadcast(weights.select(F.col("w_code").alias(f"{name}_code"), F.col("w_key").alias(f"{name}_key"), F.col("w_points").alias(f"{name}_points")))
        out = out.join(w, (F.col("code") == F.col(f"{name}_code")) & (key == F.col(f"{name}_key")), "left").drop(f"{name}_code", f"{name}_key")
    return out.withColumn("points", F.coalesce("v_points", "s_points", "d_points", F.lit(0))).drop("v_points", "s_points", "d_points")


def members(signals: DataFrame, rules: Ruleset) -> DataFrame:
    """Signals with the finding they belong to: ``grp``, ``grp_ord`` and ``place``, and whether it is only inferred (``sem``) or only phrases (``lex``).

    Signals of host codes about one host are one finding, else signals of one
    code; a record-backed email finding takes in the payment finding that says
    the same; an inferred authority claim joins the first verified
    impersonation finding.
    """
    by_msg = Window.partitionBy("msg_id")
    s = pointed(dealt(signals, SIGNALS_A_TASK, "msg_id"), rules)
    key = F.when(F.col("code").isin(rules.host_codes) & F.col("host").isNotNull() & (F.col("host") != ""), F.concat(F.lit("host:"), "host")).otherwise(F.concat(F.lit("code:"), "code"))
    s = s.withColumn("grp", key).withColumn("late", F.lit(0))
    for k, (into, taken) in enumerate(rules.absorb):
        there = F.max(F.when(F.col("grp") == f"code:{into}", 1).otherwise(0)).over(by_msg) == 1
        moves = (F.col("grp") == f"code:{taken}") & there
        s = s.withColumn("moves", moves).withColumn("grp", F.when(F.col("moves"), f"code:{into}").otherwise(F.col("grp"))).withColumn("late", F.when(F.col("moves"), k + 1).otherwise(F.col("late"))).drop("moves")
    by_group = Window.partitionBy("msg_id", "grp")
    s = s.withColumn("grp_ord", F.min(F.when(F.col("late") == 0, F.col("ord"))).over(by_group))
    verified = F.col("code").isin(IMPERSONATION) & (F.col("source_type") != "semantic_model")
    s = s.withColumn("host_grp", F.min(F.when(verified, F.struct("grp_ord", "grp"))).over(by_msg)["grp"])
    moves = (F.col("grp") == "code:ID-04") & F.col("host_grp").isNotNull()
    s = s.withColumn("moves", moves).withColumn("grp", F.when(F.col("moves"), F.col("host_grp")).otherwise(F.col("grp"))).withColumn("late", F.when(F.col("moves"), 99).otherwise(F.col("late")))
    s = s.withColumn("grp_ord", F.min(F.when(F.col("late") == 0, F.col("ord"))).over(by_group))
    first = Window.partitionBy("msg_id", "grp").orderBy(F.desc("strength"), "late", "ord")
    s = s.withColumn("strength", F.col("points") + F.when(F.col("source_type") == "semantic_model", 0).otherwise(1000))
    s = s.withColumn("sem", F.bool_and(F.col("source_type") == "semantic_model").over(by_group)).withColumn("lex", F.bool_and(F.col("source_type") == "lexicon").over(by_group))
    return s.withColumn("place", F.row_number().over(first)).drop("moves", "host_grp", "strength")


def findings(member_rows: DataFrame) -> DataFrame:
    """One row per message and finding: primary code and points, source classes, members."""
    kind = F.col("source_type")
    return member_rows.groupBy("msg_id", "grp").agg(
        F.min("grp_ord").alias("grp_ord"),
        F.max(F.when(F.col("place") == 1, F.col("code"))).alias("code"),
        F.max(F.when(F.col("place") == 1, F.col("points"))).alias("points"),
        F.count("*").alias("n_members"),
        F.bool_and(kind == "semantic_model").alias("sem"),
        F.bool_and(kind == "lexicon").alias("lex"),
        F.bool_or(kind.isin("rule", "intel", "community")).alias("det"),
        F.bool_or(kind == "lexicon").alias("has_lex"),
        F.bool_or(kind == "semantic_model").alias("has_sem"),
        F.sort_array(F.collect_set("code")).alias("codes"),
    )


def interactions(member_rows: DataFrame, found: DataFrame, rules: Ruleset) -> DataFrame:
    """Interactions that apply: msg_id, ix, ix_id, ix_points, cls (S, L or O).

    Both sides must be present on different findings; of a group only the
    first in order counts; one that rests on inferred findings alone counts
    as inferred, on inferred and phrase findings as phrases.
    """
    _, parts, _ = rules.frames(found.sparkSession)
    m = member_rows.select("msg_id", "grp", "code", "variant", "sem", "lex")
    hit = m.join(F.broadcast(parts), (F.col("code") == F.col("ix_code")) & (F.col("ix_variant").isNull() | (F.col("ix_variant") == F.col("variant"))))
    sides = hit.groupBy("msg_id", "ix", "ix_id", "ix_points", "ix_group", "grp").agg(F.bool_or(F.col("side") == "a").alias("in_a"), F.bool_or(F.col("side") == "b").alias("in_b"), F.first("sem").alias("sem"), F.first("lex").alias("lex"))
    both = sides.groupBy("msg_id", "ix", "ix_id", "ix_points", "ix_group").agg(
        F.count_if("in_a").alias("n_a"), F.count_if(F.col("in_b") & ~F.col("in_a")).alias("n_b"), F.bool_and("sem").alias("all_sem"), F.bool_and(F.col("sem") | F.col("lex")).alias("all_lex")
    )
    both = both.where("n_a > 0 AND n_b > 0")
    only = Window.partitionBy("msg_id", F.coalesce("ix_group", F.concat(F.lit("#"), F.col("ix").cast("string")))).orderBy("ix")
    cls = F.when(F.col("all_sem"), "S").when(F.col("all_lex"), "L").otherwise("O")
    return both.withColumn("turn", F.row_number().over(only)).where("turn = 1").select("msg_id", "ix", "ix_id", "ix_points", cls.alias("cls"))


def floors(member_rows: DataFrame, found: DataFrame, contexts: DataFrame, rules: Ruleset) -> DataFrame:
    """Floors whose conditions hold on findings that aren't only inferred: msg_id, fl, fl_id, fl_rank, fl_min."""
    _, _, parts = rules.frames(found.sparkSession)
    solid = member_rows.where("NOT sem").select("msg_id", "code").distinct()
    some = {name for name, _, _, x, _ in rules.floors if x}
    hit = solid.join(F.broadcast(parts), F.col("code") == F.col("fl_code")).groupBy("msg_id", "fl", "fl_id", "fl_rank", "fl_min", "n_all", "needs_claim").agg(F.count_if(F.col("kind") == "all").alias("n_hit"), F.count_if(F.col("kind") == "any").alias("n_any"))
    hit = hit.where((F.col("n_hit") == F.col("n_all")) & (~F.col("fl_id").isin(sorted(some)) | (F.col("n_any") > 0)))
    return hit.join(contexts.select("msg_id", "claimed").hint("merge"), "msg_id").where("NOT needs_claim OR claimed").select("msg_id", "fl", "fl_id", "fl_rank", "fl_min")


def score(signals: DataFrame, contexts: DataFrame, version: str | None = None) -> DataFrame:
    """One row per context: score, level, verdict, confidence, decision and what led there.

    Sums by class, interactions, caps, bands, the clamp on inferred evidence,
    floors, in this order. Messages without a signal score 0.
    """
    rules = ruleset(version) if version else ruleset()
    # Both are read several times below, by tasks of so many rows; none of the sides is broadcast, as all grow with the messages.
    m = dealt(written(members(signals, rules), "members"), SIGNALS_A_TASK, "msg_id")
    f = dealt(written(findings(m), "findings"), SIGNALS_A_TASK, "msg_id")
    ix = interactions(m, f, rules)
    fl = floors(m, f, contexts, rules).groupBy("msg_id").agg(F.max("fl_rank").alias("floor_rank"), F.max("fl_min").alias("floor_min"), F.count("*").alias("n_floors"))
    points = F.col("points")
    by_class = f.groupBy("msg_id").agg(
        F.sum(F.when(F.col("sem"), points).otherwise(0)).alias("f_sem"),
        F.sum(F.when(~F.col("sem") & F.col("lex"), points).otherwise(0)).alias("f_lex"),
        F.sum(F.when(~F.col("sem") & ~F.col("lex"), points).otherwise(0)).alias("f_other"),
        F.count("*").alias("n_findings"),
        F.bool_or(~F.col("sem")).alias("solid"),
        F.bool_or(F.array_contains("codes", "SOC-07")).alias("soc07"),
        F.sum(F.when(F.col("sem") & (F.col("code") == "SOC-07"), points).otherwise(0)).alias("soc07_sem"),
        F.bool_or("det").alias("any_det"),
        F.bool_or(F.col("det") & (points >= 20)).alias("strong_det"),
        F.bool_or("has_lex").alias("any_lex"),
        F.bool_or("has_sem").alias("any_sem"),
        F.bool_or(F.col("det")).alias("fam_det"),
    )
    by_ix = ix.groupBy("msg_id").agg(*[F.sum(F.when(F.col("cls") == c, F.col("ix_points")).otherwise(0)).alias(f"ix_{c}") for c in "SLO"], F.count("*").alias("n_interactions"))
    t = contexts.select("msg_id", "claimed", "semantic_ok").join(by_class.hint("merge"), "msg_id", "left").join(by_ix.hint("merge"), "msg_id", "left").join(fl.hint("merge"), "msg_id", "left")
    numbers = ["f_sem", "f_lex", "f_other", "n_findings", "soc07_sem", "ix_S", "ix_L", "ix_O", "n_interactions", "floor_min", "n_floors"]
    t = t.fillna(0, numbers).fillna(-1, ["floor_rank"]).fillna(False, ["solid", "soc07", "any_det", "strong_det", "any_lex", "any_sem", "fam_det"])
    t = t.withColumn("sem_sum", F.least(F.col("f_sem") + F.col("ix_S"), F.lit(CAP_SEMANTIC))).withColumn("lex_sum", F.least(F.col("f_lex") + F.col("ix_L"), F.lit(CAP_LEXICON))).withColumn("other_sum", F.col("f_other") + F.col("ix_O"))
    t = t.withColumn("raw", F.least(F.lit(100), F.col("sem_sum") + F.col("lex_sum") + F.col("other_sum"))).withColumn("raw_rank", level_rank(F.col("raw")))
    t = t.withColumn("backed_rank", level_rank(F.least(F.lit(100), F.col("lex_sum") + F.col("other_sum") + F.least("soc07_sem", "sem_sum"))))
    clamp = F.lit(rules.clamps_semantic) & F.col("soc07") & (F.col("sem_sum") > 0) & (F.col("raw_rank") > F.col("backed_rank"))
    next_min = F.element_at(F.array(*[F.lit(least) for _, least in BANDS[1:]], F.lit(101)), F.col("backed_rank") + 1)
    t = t.withColumn("clamped", clamp).withColumn("total", F.when(F.col("clamped"), next_min - 1).otherwise(F.col("raw"))).withColumn("rank", F.when(F.col("clamped"), F.col("backed_rank")).otherwise(F.col("raw_rank")))
    t = t.withColumn("floored", F.col("floor_rank") > F.col("rank"))
    t = t.withColumn("total", F.when(F.col("floored"), F.col("floor_min")).otherwise(F.col("total"))).withColumn("rank", F.when(F.col("floored"), F.col("floor_rank")).otherwise(F.col("rank")))
    level = level_name(F.col("rank"))
    decision = F.when(F.col("rank") == 0, "proceed").when((F.col("rank") == 1) | ~F.col("solid"), "verify_first").otherwise("do_not_pay")
    families = F.col("any_lex").cast("int") + F.col("any_sem").cast("int") + F.col("fam_det").cast("int")
    unsure = F.when(F.col("semantic_ok"), "moderate").otherwise("low")
    confidence = (
        F.when(F.col("strong_det") | (F.col("any_det") & (families >= 2)), "high")
        .when(F.col("any_det") | (F.col("any_lex") & F.col("any_sem")), "moderate")
        .when(F.col("any_lex"), unsure)
        .when(F.col("any_sem"), "low")
        .otherwise(unsure)
    )
    return t.select("msg_id", F.col("total").cast("long").alias("score"), level.alias("level"), verdict(level).alias("verdict"), confidence.alias("confidence"), decision.alias("decision"), F.col("n_findings").cast("long"), F.col("n_interactions").cast("long"), "clamped", "floored")


def trace(signals: DataFrame, contexts: DataFrame, version: str | None = None) -> DataFrame:
    """Findings and interactions that added points, and floors that would raise the level, in order: msg_id, step, id, points.

    A floor is listed if its level exceeds that of every floor before it.
    """
    rules = ruleset(version) if version else ruleset()
    m = dealt(written(members(signals, rules), "members"), SIGNALS_A_TASK, "msg_id")
    f = dealt(written(findings(m), "findings"), SIGNALS_A_TASK, "msg_id")
    steps = f.where("points > 0").select("msg_id", F.lit(1).alias("stage"), F.col("grp_ord").cast("long").alias("at"), F.col("code").alias("id"), "points")
    steps = steps.unionAll(interactions(m, f, rules).select("msg_id", F.lit(2), F.col("ix").cast("long"), "ix_id", "ix_points"))
    fl = floors(m, f, contexts, rules)
    before = Window.partitionBy("msg_id").orderBy("fl").rowsBetween(Window.unboundedPreceding, -1)
    fl = fl.withColumn("top", F.coalesce(F.max("fl_rank").over(before), F.lit(-1))).where("fl_rank > top")
    steps = steps.unionAll(fl.select("msg_id", F.lit(3), F.col("fl").cast("long"), "fl_id", "fl_min"))
    return steps.select("msg_id", F.row_number().over(Window.partitionBy("msg_id").orderBy("stage", "at", "id")).cast("long").alias("step"), "id", F.col("points").cast("long").alias("points"))
