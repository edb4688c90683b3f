"""Flow-domain tables derived from the ``events`` table.

``flows`` are labelled network flow records, ``detector_votes`` are the 18
detectors' opinions about each flow, ``host_metrics`` are monitor samples.
All are pure projections of ``events`` (no shuffle, no join): every output row
comes from one input row, so they scale with the input and keep its
partitioning.  Detector votes are produced *nested* (one array of votes per
flow), which is the shape the ensemble operators consume without a shuffle;
``votes_long`` explodes them for row-wise consumers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ATTACK_TYPES, detector_registry
from .tables import read_table

MAX_REGISTRY = 10_000  # bound on detectors inlined into a plan as literals


def flows_from_events(events: DataFrame) -> DataFrame:
    e = F.col("event_id")
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("bigint")
    return events.select(
        e.alias("flow_id"),
        F.col("ts").alias("timestamp"),
        F.concat(F.lit("192.168.1."), (F.col("user_id") % 254 + 1).cast("string")).alias("src_ip"),
        F.concat(F.lit("10.0.0."), (k % 254 + 1).cast("string")).alias("dst_ip"),
        (F.lit(1024) + (e * 7919) % 64511).cast("int").alias("src_port"),
        (F.lit(1) + (e * 104729) % 65535).cast("int").alias("dst_port"),
        F.when(e % 3 == 0, "TCP").when(e % 3 == 1, "UDP").otherwise("ICMP").alias("protocol"),
        (F.lit(64) + F.round(F.col("value") * 100).cast("bigint") % 1436).cast("int").alias("packet_size"),
        F.when(e % 17 == 0, F.lit(None).cast("double")).otherwise(F.col("value") / 10.0).alias("flow_duration"),
        ((e * 31) % 10000).alias("bytes_sent"),
        ((e * 37) % 10000).alias("bytes_received"),
        (F.lit(1) + (e * 41) % 99).alias("packets_sent"),
        (F.lit(1) + (e * 43) % 99).alias("packets_received"),
        F.when(F.col("event_type") == "signup", "DoS")
         .when(F.col("event_type") == "purchase", "DDoS")
         .when(F.col("event_type") == "error", "Botnet")
         .otherwise("Benign").alias("label"),
    )


#: Tasks a core that the CPU-heavy per-row steps get at least.
TASKS_PER_CORE = 8


def spread(df: DataFrame) -> DataFrame:
    """Round-robin the rows over several tasks a core when the scan yields fewer
    splits than that.  Splits are cut by bytes and rows are read by row group, so
    as many splits as cores may still hold all rows in a few of them.  Large inputs
    already have many splits and are returned untouched (no shuffle)."""
    if df.isStreaming:  # micro-batches are planned per trigger
        return df
    tasks = TASKS_PER_CORE * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df


def load_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows_from_events(read_table(spark, sf_dir, "events"))


def clusters_df(spark: SparkSession, registry=None) -> DataFrame:
    rows = registry if registry is not None else detector_registry()
    return spark.createDataFrame(
        rows, "ordinal int, attack_idx int, cluster_id string, attack_type string, model_type string")


def _registry_literal(registry) -> Column:
    if len(registry) > MAX_REGISTRY:
        raise ValueError(f"detector registry too large to inline ({len(registry)})")
    return F.array(*[
        F.struct(F.lit(o).alias("ordinal"), F.lit(a).alias("attack_idx"),
                 F.lit(c).alias("cluster_id"), F.lit(t).alias("attack_type"),
                 F.lit(m).alias("model_type"), F.lit(o * 104729).cast("bigint").alias("hash"))
        for (o, a, c, t, m) in registry])


def votes_column(flow_id: Column, registry=None) -> Column:
    """Array of simulated detector outputs for one flow (the fixture scoring rule).

    ``flow_id % 8`` selects a scenario: 0-3 one trained specialism at falling
    confidence, 4 all agree, 5 low-confidence split, 6 random, 7 moderate
    agreement (nothing trained when ``flow_id % 16 = 7``).

    The scenario is chosen once a flow, and a vote evaluates only what its own
    state (failed, trained, untrained) shows: the lambdas are interpreted, so
    every condition in them is paid for each of the votes.
    """
    registry = registry if registry is not None else detector_registry()
    target = F.element_at(F.array(*[F.lit(a) for a in ATTACK_TYPES]),
                          (flow_id % len(ATTACK_TYPES) + 1).cast("int"))
    s = flow_id % 8

    def vote(k: Column, trained: Column, error: Column, prediction: Column, confidence: Column) -> Column:
        return F.struct(
            k["ordinal"].alias("ordinal"), k["cluster_id"].alias("cluster_id"),
            k["attack_type"].alias("attack_type"), k["model_type"].alias("model_type"),
            trained.alias("is_trained"), error.alias("error"),
            prediction.alias("prediction"), confidence.alias("confidence"),
            (hashed(k, 500).cast("double") / 1000).alias("prediction_time"))

    def hashed(k: Column, n: int) -> Column:
        return (flow_id * 7919 + k["hash"]) % n

    def untrained(k: Column, trained: Column = F.lit(False)) -> Column:
        return vote(k, trained, F.lit(None).cast("string"), F.lit("Unknown"), F.lit(0.0))

    def scored(k: Column, prediction: Column, milli: Column) -> Column:
        return vote(k, F.lit(True), F.lit(None).cast("string"), prediction, milli.cast("double") / 1000)

    def votes(one: Callable[[Column], Column]) -> Column:
        return F.transform(_registry_literal(registry), one)

    def specialist(k: Column) -> Column:
        m = hashed(k, 100)
        milli = (F.when(s == 0, 900 + m).when(s == 1, 800 + m).when(s == 2, 600 + 2 * m)
                 .when(s == 3, 50 + 5 * m).otherwise(600 + m))
        return F.when(k["attack_idx"] == flow_id % 9, scored(k, target, milli)).otherwise(untrained(k))

    def all_trained(raw: Callable[[Column], Column], milli: Callable[[Column], Column],
                    trained: Callable[[Column], Column] = lambda k: (flow_id + k["ordinal"]) % 11 != 0) -> Column:
        failed = lambda k: (flow_id + k["ordinal"]) % 13 == 0
        return votes(lambda k: F.when(failed(k), vote(k, trained(k), F.lit("boom"), F.lit("Error"), F.lit(0.0)))
                     .when(trained(k), scored(k, raw(k), milli(k))).otherwise(untrained(k)))

    return (F.when(flow_id.isNull(), votes(lambda k: untrained(k, F.lit(None).cast("boolean"))))
            .when(s < 4, votes(specialist))
            .when(s == 4, all_trained(lambda k: target, lambda k: 900 + hashed(k, 100)))
            .when(s == 5, all_trained(lambda k: F.when(hashed(k, 1000) % 3 == 0, k["attack_type"]).otherwise("Benign"),
                                      lambda k: 100 + 5 * hashed(k, 100)))
            .when(s == 6, all_trained(lambda k: F.when(hashed(k, 2) == 0, k["attack_type"]).otherwise("Benign"),
                                      lambda k: hashed(k, 1000)))
            .otherwise(all_trained(lambda k: target, lambda k: 600 + hashed(k, 100), lambda k: flow_id % 16 != 7)))


def flows_with_votes(flows: DataFrame, registry=None, by_flow: bool = False) -> DataFrame:
    """flows + ``votes`` array (J3: every flow x every detector, map-side only).

    Vote generation and the decision on top of it are the CPU-heavy per-row
    steps, so a scan with few splits is spread first.  ``by_flow``: the flows, still
    without votes, are dealt by ``flow_id``, for groupings of the votes by flow; those
    then need no exchange of the votes, which are many times larger."""
    if by_flow and not flows.isStreaming:
        cores = flows.sparkSession.sparkContext.defaultParallelism
        flows = flows.repartition(max(TASKS_PER_CORE * cores, flows.rdd.getNumPartitions()), "flow_id")
    else:
        flows = spread(flows)
    return flows.withColumn("votes", votes_column(F.col("flow_id"), registry))


def votes_long(flows_votes: DataFrame, keep=("flow_id", "timestamp")) -> DataFrame:
    """One row per (flow, detector): the long ``cluster_predictions`` table."""
    cols = [F.col(c).alias("ts") if c == "timestamp" else F.col(c) for c in keep]
    # inline_outer: the plain generator makes Catalyst infer a size(votes) > 0
    # filter that would evaluate the votes expression a second time
    return flows_votes.select(*cols, F.inline_outer("votes"))


def load_cluster_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return votes_long(flows_with_votes(load_flows(spark, sf_dir)))


def host_metrics_from_events(events: DataFrame) -> DataFrame:
    e = F.col("event_id")
    return events.select(
        e.alias("sample_id"), "ts",
        F.concat(F.lit("host"), (F.col("user_id") % 5).cast("string")).alias("host"),
        F.when(e % 3 == 0, "cpu_usage").when(e % 3 == 1, "memory_usage").otherwise("disk_usage").alias("metric"),
        ((F.round(F.col("value") * 100).cast("bigint") % 10000).cast("double") / 100).alias("value"),
    )


def load_host_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_metrics_from_events(read_table(spark, sf_dir, "events"))


def eval_predictions(flows_votes: DataFrame) -> DataFrame:
    """Valid votes as binary (y_true, y_pred) per detector: evaluation input.

    Works on the nested shape, so no join back to flows is needed: the label
    travels with the votes.
    """
    v = flows_votes.select("flow_id", "label", F.inline_outer("votes"))
    v = v.filter(F.col("is_trained") & F.col("error").isNull())
    return v.select(
        "flow_id", "ordinal", "cluster_id", "attack_type", "model_type",
        (F.col("label") == F.col("attack_type")).cast("int").alias("y_true"),
        (F.col("prediction") == F.col("attack_type")).cast("int").alias("y_pred"))
