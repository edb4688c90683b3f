"""The decision and its votes: what is evaluated once, and where rows are dealt."""

from pyspark.sql import functions as F

from netvigil.operators import ensemble
from netvigil.sources import derived


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _flows(spark, n=400):
    return spark.range(n).select(F.col("id").alias("flow_id"), F.timestamp_seconds(F.col("id")).alias("timestamp"))


def test_filter_on_a_decision_evaluates_it_once(spark):
    d = ensemble.decide(derived.flows_with_votes(_flows(spark))).where("conflicts_detected > 0").select("flow_id", "conflicts_detected")
    assert _plan(d).count("class_conflict AS type") <= 1
    assert d.count() > 0


def test_few_splits_are_spread_over_several_tasks_a_core(spark):
    cores = spark.sparkContext.defaultParallelism
    as_many_as_cores = _flows(spark).repartition(cores)
    assert derived.flows_with_votes(as_many_as_cores).rdd.getNumPartitions() == derived.TASKS_PER_CORE * cores


def test_conflict_detail_exchanges_flows_and_no_votes(spark):
    fv = derived.flows_with_votes(_flows(spark), by_flow=True)
    for d in (ensemble.class_conflict_detail(fv, "timestamp"), ensemble.attack_type_conflict_detail(fv, ensemble.EnsembleConfig(), "timestamp")):
        assert _plan(d).count("Exchange hashpartitioning") == 1
        assert d.count() > 0


def test_votes_of_odd_flow_ids(spark):
    ids = spark.createDataFrame([(None,), (-9,), (-1,), (7,), (12,), (13,)], "flow_id long")
    got = {r["flow_id"]: r["votes"] for r in ids.withColumn("votes", derived.votes_column(F.col("flow_id"))).collect()}
    assert {v["is_trained"] for v in got[None]} == {None} and {v["prediction"] for v in got[None]} == {"Unknown"}
    assert [v["ordinal"] for v in got[-9] if v["is_trained"]] == [0, 1]
    assert not any(v["is_trained"] for v in got[7])
    assert {v["error"] for v in got[13]} == {None, "boom"}
    assert all(v["confidence"] == 0.0 and v["prediction"] == "Error" for v in got[13] if v["error"])
