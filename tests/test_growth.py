"""Plans that hold at size: what grows is dealt out by its rows and isn't broadcast."""

from pyspark.sql import functions as F

from tracewell.operators import domains, indicators, mail
from tracewell.plans import pipeline, scoring
from tracewell.plans.ruleset import ruleset
from tracewell.queries import organisation
from tracewell.queries.pipeline import REGISTRY
from tracewell.sources import mail as source_mail
from tracewell.sources import messages, scratch
from tracewell.streaming import campaigns

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_keys_of_many_hosts_are_not_broadcast(spark):
    hosts = spark.range(domains.MOST_BROADCAST + 500).select(F.concat(F.lit("brand"), F.col("id").cast("string"), F.lit(".com")).alias("host"))
    found = domains.relations(hosts, hosts.select(F.col("host").alias("domain")))
    assert "BroadcastExchange" not in _plan(found)
    assert found.where("relation = 'same'").count() == domains.MOST_BROADCAST + 500


def test_thread_changes_broadcast_nothing(spark):
    rows = [(1, 10, "t", "Ann", "ann@a.com"), (2, 11, "t", "Ann", "ann@b.com"), (3, 12, "t", "Bob", "bob@a.com")]
    e = spark.createDataFrame(rows, "msg_id long, ts long, thread string, from_name string, from_address string")
    found = mail.thread_changes(e)
    assert "BroadcastExchange" not in _plan(found)
    # The last plan joins tables only, so that the driver needn't hold all of it.
    assert _plan(found).count("SortMergeJoin") <= 3
    assert [tuple(r) for r in found.collect()] == [(2, "same_name_new_domain", "b.com", "a.com")]


def test_rows_are_dealt_by_their_number(spark):
    df = scratch.written(spark.range(1000).coalesce(1), "many")
    assert scratch.dealt(df, 100, "id").rdd.getNumPartitions() == 10
    assert scratch.dealt(df, 1000).rdd.getNumPartitions() == df.rdd.getNumPartitions()


def test_scores_broadcast_rulesets_only(spark):
    scored = _plan(scoring.score(messages.signals(spark, SF), messages.contexts(spark, SF)))
    assert "BroadcastHashJoin [msg_id" not in scored


def test_members_are_made_once_for_marks_and_interactions(spark):
    m = scoring.members(messages.signals(spark, SF), ruleset())
    assert "Join [msg_id" not in _plan(pipeline.annotated(m))
    assert "Join [msg_id" not in _plan(scoring.interactions(m, scoring.findings(m), ruleset()))


def test_signals_are_scored_by_bounded_tasks(spark, monkeypatch):
    monkeypatch.setattr(scoring, "SIGNALS_A_TASK", 100)
    assert "REPARTITION_BY_NUM" in _plan(scoring.members(messages.signals(spark, SF), ruleset()))


def test_registries_in_memory_are_the_broadcast_side(spark):
    hosts, listed = scratch.written(spark.createDataFrame([("a.b.com",), ("c.org",)], "host string"), "some"), spark.createDataFrame([("b.com",)], "domain string")
    found = domains.below(hosts, listed)
    assert "rightHint=(strategy=broadcast)" in found._jdf.queryExecution().analyzed().toString() or "BuildRight" in _plan(found)
    assert [tuple(r) for r in found.collect()] == [("a.b.com", "b.com")]


def test_lines_are_grouped_by_bounded_tasks(spark, monkeypatch):
    monkeypatch.setattr(organisation, "ROWS_A_TASK", 1000)
    found = organisation.indicators(spark, SF)
    assert "REPARTITION_BY_NUM" in _plan(found) and "BroadcastExchange" not in _plan(found)


def test_what_makes_hosts_runs_once(spark):
    hosts = spark.range(3).select(F.concat(F.lit("WWW.h"), F.col("id").cast("string"), F.lit(".com.")).alias("host"))
    found = domains.host_forms(hosts)
    assert "Range" not in _plan(found)
    assert sorted(r["host"] for r in found.collect()) == ["h0.com", "h1.com", "h2.com"]


def test_indicators_broadcast_nothing_that_grows(spark):
    e = source_mail.emails(spark, SF)
    found = indicators.indicators(e, source_mail.suppliers(spark, SF), source_mail.ORGANISATION, REGISTRY, "secret")
    assert "BroadcastExchange" not in _plan(found)


def test_a_campaign_batch_is_made_once(spark):
    made = spark.sparkContext.accumulator(0)
    rows = spark.sparkContext.parallelize([(i, "scam", "bank", "North Bank", f"s{i % 3}", ["a.com"], True) for i in range(20)], 2)
    kinds = "msg_id long, verdict string, scam_type string, identity string, sender string, domains array<string>, share boolean"

    def row(x):
        made.add(1)
        return x

    batch = spark.createDataFrame(rows.map(row), kinds).withColumn("ts", F.timestamp_seconds("msg_id"))
    store = campaigns.Campaigns(scratch.folder(spark, "campaigns"), 2)
    store.record(batch, 0)
    assert made.value == 20
    assert [tuple(r) for r in store.known(spark).collect()] == [("north-bank", 20, 3, 1)]
