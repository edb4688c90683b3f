"""Structured Streaming.

Every batch operator that is per-row (flow derivation, detector votes, the
ensemble decision) runs unchanged on a streaming DataFrame, so continuous
scoring (T1) is a plain ``readStream -> transform -> writeStream`` with a
checkpoint.  Row-count windows are not supported on streams, so the last-N
rolling features per key (T2) keep the last N-1 rows of each key in state
(``applyInPandasWithState``; state per key is bounded by N; ``streaming.keyed`` has
all features and scoring with fitted detectors over ``transformWithState``).  Counters and
health checks (T3-T6) are event-time window aggregations with a watermark;
late duplicates are dropped with ``dropDuplicatesWithinWatermark`` (T7).
Each function also accepts a batch DataFrame (its batch twin).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import ALERT_THRESHOLDS, HEALTH_CHECK_INTERVAL, SCRAPE_INTERVAL, WINDOW_OVERLAP, WINDOW_SIZE
from ..operators import ensemble
from ..sources import derived

EVENTS_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])


def event_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Events arriving as parquet files under ``path`` (a directory or glob)."""
    r = spark.readStream.schema(EVENTS_SCHEMA)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(path)


def flow_stream(events: DataFrame) -> DataFrame:
    """Flows with an event-time ``ts`` column of type TIMESTAMP (watermarks
    reject TIMESTAMP_NTZ; the session zone is UTC)."""
    return derived.flows_from_events(events).withColumn("ts", F.col("timestamp").cast("timestamp"))


# --- T1 ------------------------------------------------------------------------

def score_stream(flows: DataFrame, strategy: str | None = None) -> DataFrame:
    """Votes + ensemble decision per flow; stateless, so any output mode works."""
    d = ensemble.decide(derived.flows_with_votes(flows), strategy=strategy)
    return d.select("flow_id", "ts", "src_ip", "dst_ip", "protocol", "attack_type", "prediction",
                    "confidence", "severity", "method", "conflicts_detected")


def run_available(df: DataFrame, sink_path: str, checkpoint: str, fmt: str = "parquet",
                  output_mode: str = "append") -> None:
    """Process everything available now into a file sink (restartable: the
    checkpoint records progress, so a rerun after a failure resumes)."""
    q = (df.writeStream.format(fmt).outputMode(output_mode).option("checkpointLocation", checkpoint)
           .trigger(availableNow=True).start(sink_path))
    q.awaitTermination()


def run_updates(df: DataFrame, path: str, checkpoint: str) -> None:
    """Process everything available now in update mode: every micro-batch leaves the rows it changed
    in ``path``/batch=<id>, overwritten when the batch is run again after a failure."""
    def run(rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    df.writeStream.foreachBatch(run).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def latest_updates(spark: SparkSession, path: str, keys) -> DataFrame:
    """The last state of every key that ``run_updates`` wrote (combined map side, no window)."""
    t = spark.read.parquet(path)
    rest = [c for c in t.columns if c not in (*keys, "batch")]
    return t.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(*keys, "_r.*")


# --- T2 ------------------------------------------------------------------------

ROLLING_INPUTS = ("packet_size", "flow_duration")
#: Feature -> (input, pandas rolling statistic).
ROLLING_STATS = {
    "packet_size_mean": ("packet_size", "mean"), "packet_size_std": ("packet_size", "std"),
    "packet_size_min": ("packet_size", "min"), "packet_size_max": ("packet_size", "max"),
    "packet_size_median": ("packet_size", "median"),
    "flow_duration_mean": ("flow_duration", "mean"), "flow_duration_std": ("flow_duration", "std"),
}
ROLLING_OUT = T.StructType([T.StructField("flow_id", T.LongType()), T.StructField("src_ip", T.StringType()),
                            *[T.StructField(c, T.DoubleType()) for c in ROLLING_STATS]])
ROLLING_STATE = T.StructType([T.StructField("ids", T.ArrayType(T.LongType())),
                              *[T.StructField(c, T.ArrayType(T.DoubleType())) for c in ROLLING_INPUTS]])


def _rolling_update(n: int, idle_ms: int | None):
    def update(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        new = pd.concat(list(batches), ignore_index=True).sort_values(["ts", "flow_id"], kind="mergesort")
        cols = ["flow_id", *ROLLING_INPUTS]
        rows = new[cols].astype({c: "float64" for c in ROLLING_INPUTS})
        k = 0
        if state.exists:
            before = pd.DataFrame({c: list(v) for c, v in zip(cols, state.get)}).astype({c: "float64" for c in ROLLING_INPUTS})
            k, rows = len(before), pd.concat([before, rows])
        rows = rows.reset_index(drop=True)
        # pandas min_periods = n (NULL unless n values in the frame)
        stats = {f: getattr(rows[c].rolling(n, min_periods=n), how)() for f, (c, how) in ROLLING_STATS.items()}
        out = pd.DataFrame({"flow_id": rows["flow_id"].astype("int64"), "src_ip": key[0], **stats}).iloc[k:]
        tail = rows.iloc[max(0, len(rows) - n + 1):]
        state.update(([int(x) for x in tail["flow_id"]],
                      *[[None if pd.isna(x) else float(x) for x in tail[c]] for c in ROLLING_INPUTS]))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield out
    return update


def rolling_state(flows: DataFrame, n: int = WINDOW_SIZE, key: str = "src_ip", idle_ms: int | None = None) -> DataFrame:
    """Statistics of the packet size and the duration over the last ``n`` flows of each key.

    State per key is the last n-1 rows (bounded); rows of one micro-batch are ordered by
    (ts, flow_id) and follow the rows already in state.  A stream that goes on for ever
    sets ``idle_ms``: a key without rows for so long (processing time) is forgotten.  A
    run that ends with the input leaves it unset, as Spark then adds batches without end."""
    src = flows.select(key, "flow_id", "ts", *[F.col(c).cast("double").alias(c) for c in ROLLING_INPUTS])
    return src.groupBy(key).applyInPandasWithState(
        _rolling_update(n, idle_ms), ROLLING_OUT, ROLLING_STATE, "append",
        GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout)


# --- T3-T7 ----------------------------------------------------------------------

def tumbling_counts(decisions: DataFrame, every: str = SCRAPE_INTERVAL, late: str = "1 minute") -> DataFrame:
    """Decisions per (window, attack type, severity) on a tumbling window."""
    return (decisions.withWatermark("ts", late)
            .groupBy(F.window("ts", every).alias("w"), "attack_type", "severity")
            .agg(F.count(F.lit(1)).alias("n")))


def conflict_counts(flows_votes: DataFrame, every: str = SCRAPE_INTERVAL, late: str = "1 minute") -> DataFrame:
    """Conflicts per (window, conflict type) on a tumbling window; a flow adds its numbers of either type, flows
    without conflicts add no row."""
    n_class = F.size(F.filter("conflicts", lambda c: c["type"] == "class_conflict")).cast("long")
    per = (ensemble.with_conflicts(flows_votes.withWatermark("ts", late))
           .select("ts", n_class.alias("c"), F.col("conflicts_detected").cast("long").alias("both")))
    kinds = F.array(F.struct(F.lit("class_conflict").alias("conflict_type"), F.col("c").alias("k")),
                    F.struct(F.lit("attack_type_conflict").alias("conflict_type"), (F.col("both") - F.col("c")).alias("k")))
    return (per.select("ts", F.inline_outer(kinds)).where("k > 0")
            .groupBy(F.window("ts", every).alias("w"), "conflict_type").agg(F.sum("k").alias("n")))


def sliding_counts(flows: DataFrame, length_s: int = WINDOW_SIZE, overlap: float = WINDOW_OVERLAP,
                   late: str = "1 minute") -> DataFrame:
    """T4: flows per (sliding window, protocol); slide = length * (1 - overlap)."""
    slide = max(1, int(length_s * (1 - overlap)))
    return (flows.withWatermark("ts", late)
            .groupBy(F.window("ts", f"{length_s} seconds", f"{slide} seconds").alias("w"), "protocol")
            .agg(F.count(F.lit(1)).alias("n")))


def health_windows(samples: DataFrame, every: str = HEALTH_CHECK_INTERVAL, late: str = "1 minute",
                   thresholds=ALERT_THRESHOLDS) -> DataFrame:
    """T5: per check interval and host, the latest value of each metric and
    the health status (strictly above a threshold -> unhealthy)."""
    latest = [F.max_by(F.col("value"), F.when(F.col("metric") == m, F.struct("ts", "sample_id"))).alias(m)
              for m in thresholds]
    agg = (samples.withWatermark("ts", late)
           .groupBy(F.window("ts", every).alias("w"), "host").agg(*latest))
    issues = F.array_compact(F.array(*[F.when(F.col(m) > float(t), F.lit(m)) for m, t in thresholds.items()]))
    return agg.select("w", "host", *thresholds,
                      F.when(F.size(issues) > 0, "unhealthy").otherwise("healthy").alias("status"),
                      F.array_join(issues, ",").alias("issues"))


def running_stats(votes_long: DataFrame) -> DataFrame:
    """Running count and mean prediction time per detector (update mode)."""
    ok = votes_long.filter(F.col("is_trained") & F.col("error").isNull())
    return ok.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("prediction_count"),
                                        F.avg("prediction_time").alias("avg_prediction_time"))


def dedup(flows: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Drop re-sent flows (same flow_id) that arrive within the watermark
    (batch twin: plain ``dropDuplicates``, which Spark requires for batch)."""
    if not flows.isStreaming:
        return flows.dropDuplicates(["flow_id"])
    return flows.withWatermark("ts", late).dropDuplicatesWithinWatermark(["flow_id"])


def window_seconds(col: str = "w") -> list:
    """Window bounds as epoch seconds (engine-neutral output)."""
    return [F.unix_seconds(F.col(f"{col}.start")).alias("window_start"),
            F.unix_seconds(F.col(f"{col}.end")).alias("window_end")]

