"""Conversations: transcripts within a budget, offsets, stages, payment checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
BUDGET = 12_000
SEPARATOR = 2
STAGE_OF = {"SOC-05": "hook", "SOC-06": "trust", "SOC-01": "pressure", "SOC-02": "pressure", "SOC-03": "isolation", "PAY-01": "payment", "PAY-02": "payment", "PAY-03": "payment", "PAY-04": "payment", "SEC-01": "credential", "SEC-02": "access"}
LARGE_AMOUNT = 50_000.0
# End of the fixed values.


def transcript(turns: DataFrame, budget: int = BUDGET) -> DataFrame:
    """The newest turns of each conversation that fit the budget, with their place in the joined text: conv_id, turn, start, end.

    Turns are joined by two characters; one more turn is kept as long as the
    sum of lengths and separators stays within the budget.
    """
    n = F.length(F.coalesce("text", F.lit(""))) + SEPARATOR
    back = Window.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, 0)
    kept = turns.withColumn("n", n).where("n IS NOT NULL").withColumn("used", F.sum("n").over(back)).where(F.col("used") <= budget)
    on = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    kept = kept.withColumn("upto", F.sum("n").over(on))
    return kept.select("conv_id", "turn", (F.col("upto") - F.col("n")).cast("long").alias("start"), (F.col("upto") - SEPARATOR).cast("long").alias("end"))


def locate(spans: DataFrame, parts: DataFrame) -> DataFrame:
    """Which part of its conversation each span starts in: equi-join on the conversation, then start in [start, end)."""
    p = parts.select(F.col("conv_id").alias("p_conv"), "turn", F.col("start").alias("p_start"), F.col("end").alias("p_end"))
    s = spans.join(p, F.col("conv_id") == F.col("p_conv"))
    return s.where((F.col("at") >= F.col("p_start")) & (F.col("at") < F.col("p_end"))).select("conv_id", "at", "turn")


def stages(flags: DataFrame) -> DataFrame:
    """When each stage first shows: conv_id, stage, first_turn, flags. ``flags`` has conv_id, turn and code."""
    stage: Column = F.create_map(*[F.lit(x) for kv in STAGE_OF.items() for x in kv])[F.col("code")]
    one = flags.select("conv_id", "turn", "code", stage.alias("stage")).where("stage IS NOT NULL").distinct()
    return one.groupBy("conv_id", "stage").agg(F.min("turn").alias("first_turn"), F.count("*").alias("flags"))


def payee_verdict(payments: DataFrame) -> DataFrame:
    """id, verdict (stop, caution, clear) and findings of a payment: payee known, name matching, amount, on a call.

    ``payments`` has id, known, name_match, amount and on_call.
    """
    red = F.array_compact(F.array(F.when(~F.col("name_match"), "name_mismatch"), F.when(F.col("on_call"), "directed_on_call")))
    amber = F.array_compact(F.array(F.when(~F.col("known"), "new_payee"), F.when(F.col("amount") >= LARGE_AMOUNT, "large_amount")))
    verdict = F.when(F.size(red) > 0, "stop").when(F.size(amber) > 0, "caution").otherwise("clear")
    return payments.select("id", verdict.alias("verdict"), F.array_join(F.concat(red, amber), ",").alias("findings"))
