"""Verification workflows: which of an organisation's procedures a message's findings call for."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Workflow:
    """Triggers are ``CODE`` or ``CODE:variant``; one must be there, and one of ``requires_any`` if that isn't empty."""

    id: str
    triggers: list[str]
    requires_any: list[str] = field(default_factory=list)
    owner: str | None = None
    approvals: int = 0


def workflow_rows(spark: SparkSession, workflows: list[Workflow]) -> DataFrame:
    """One row a condition: place, id, owner, approvals, kind ('trigger' or 'any'), nth, name, needs_any."""
    rows = [(k, w.id, w.owner, w.approvals, kind, n, name, bool(w.requires_any)) for k, w in enumerate(workflows) for kind, names in (("trigger", w.triggers), ("any", w.requires_any)) for n, name in enumerate(names)]
    return spark.createDataFrame(rows, "place int, id string, owner string, approvals int, kind string, nth int, name string, needs_any boolean")


def plan(signals: DataFrame, levels: DataFrame, workflows: list[Workflow]) -> DataFrame:
    """msg_id, place, workflow, owner, approvals, triggered_by of messages above level low.

    ``signals`` (msg_id, code, variant) holds merged members too, so facts
    that another finding took in still trigger. A division with an optional
    second set: each signal becomes its names, equal names are joined, and a
    message's conditions are counted. Signals that repeat are made one
    first.
    """
    names = F.array_compact(F.array(F.col("code"), F.when(F.coalesce("variant", F.lit("")) != "", F.concat("code", F.lit(":"), "variant"))))
    present = signals.select("msg_id", F.explode(names).alias("name")).distinct()
    met = present.join(workflow_rows(signals.sparkSession, workflows), "name")
    held = met.groupBy("msg_id", "place", "id", "owner", "approvals", "needs_any").agg(
        F.count_if(F.col("kind") == "trigger").alias("n_triggers"),
        F.count_if(F.col("kind") == "any").alias("n_any"),
        F.array_sort(F.array_compact(F.collect_set(F.when(F.col("kind") == "trigger", F.struct("nth", "name"))))).alias("by"),
    )
    held = held.where("n_triggers > 0 AND (NOT needs_any OR n_any > 0)")
    held = held.join(levels.where("level <> 'low'").select("msg_id"), "msg_id", "left_semi")
    return held.select("msg_id", F.col("place").cast("long").alias("place"), F.col("id").alias("workflow"), "owner", F.col("approvals").cast("long").alias("approvals"), F.array_join(F.array_distinct(F.transform("by", lambda x: x["name"])), ",").alias("triggered_by"))
