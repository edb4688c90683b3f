"""Counters, histograms, status roll-ups, health checks and history views
(A7-A16, L1-L3).  All are single-pass partial aggregations or bounded top-k;
nothing is collected except where noted.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import ALERT_THRESHOLDS, HISTOGRAM_BUCKETS, SEVERITIES
from ..functions.scalar import map_attack_type

DASHBOARD_TYPES = ("Benign", "DoS", "DDoS", "Botnet", "Brute_Force")


def successful(votes_long: DataFrame) -> DataFrame:
    """Votes that count as a prediction made (trained, no error)."""
    return votes_long.filter(F.coalesce(F.col("is_trained"), F.lit(False)) & F.col("error").isNull())


def newest_first(df: DataFrame, ts: str, row_id: str) -> Column:
    """What orders rows like the struct (ts, row_id), NULLs lowest, as one number where the types allow it.

    A hash aggregate can hold a number in its buffer; with a struct ``max_by`` sorts all rows of a task."""
    kind, ids = df.schema[ts].dataType.typeName(), df.schema[row_id].dataType.typeName()
    if kind not in ("timestamp", "timestamp_ntz") or ids not in ("byte", "short", "integer", "long"):
        return F.struct(ts, row_id)
    if kind == "timestamp":
        micros = F.unix_micros(ts)
    else:  # by its own calendar fields, whatever the session's zone
        second = F.expr(f"extract(SECOND FROM `{ts}`)").cast("decimal(8,6)") * 1000000
        micros = (F.datediff(F.col(ts).cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * 86400000000
                  + F.hour(ts).cast("long") * 3600000000 + F.minute(ts).cast("long") * 60000000 + second.cast("long"))
    # the ids and the place of NULL below them take 2^64 + 1 numbers for every time; times reach +-2^59 here (year 18,000)
    at = F.coalesce(micros, F.lit(-(2**59))).cast("decimal(18,0)")
    number = F.coalesce(F.col(row_id).cast("decimal(20,0)"), F.lit(Decimal(-(2**63) - 1)).cast("decimal(20,0)"))
    return at * F.lit(Decimal(2**64 + 1)).cast("decimal(20,0)") + number


def detector_status(votes_long: DataFrame) -> DataFrame:
    """prediction_count, mean and last prediction time per detector."""
    ok = successful(votes_long)
    return ok.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("prediction_count"),
        F.avg("prediction_time").alias("avg_prediction_time"),
        F.max_by("prediction_time", newest_first(ok, "ts", "flow_id")).alias("last_prediction_time"))


def prediction_counter(votes_long: DataFrame) -> DataFrame:
    """A10: predictions by (predicted attack type, detector)."""
    ok = successful(votes_long)
    return ok.groupBy(map_attack_type("prediction").alias("attack_type"), "cluster_id") \
             .agg(F.count(F.lit(1)).alias("n"))


def conflict_counter(decisions: DataFrame) -> DataFrame:
    """A10: conflicts by type (sums of per-flow counts; nothing exploded)."""
    n_class = F.size(F.filter("conflicts", lambda c: c["type"] == "class_conflict"))
    per = decisions.select(n_class.alias("c"), (F.col("conflicts_detected") - n_class).alias("a"))
    tot = per.agg(F.sum("c").alias("class_conflict"), F.sum("a").alias("attack_type_conflict"))
    return (tot.selectExpr("stack(2, 'class_conflict', class_conflict, 'attack_type_conflict', "
                           "attack_type_conflict) AS (conflict_type, n)")
               .filter(F.col("n") > 0))


def duration_histogram(votes_long: DataFrame, bounds=HISTOGRAM_BUCKETS) -> DataFrame:
    """Cumulative ``le`` buckets per detector (plus +Inf), one pass."""
    ok = successful(votes_long)
    labels = [str(b) for b in bounds] + ["+Inf"]
    aggs = [F.sum(F.when(F.col("prediction_time") <= b, 1).otherwise(0)).cast("long").alias(f"b{i}")
            for i, b in enumerate(bounds)]
    aggs.append(F.count(F.lit(1)).alias(f"b{len(bounds)}"))
    wide = ok.groupBy("cluster_id").agg(*aggs)
    pairs = ", ".join(f"'{lab}', b{i}" for i, lab in enumerate(labels))
    return wide.selectExpr("cluster_id", f"stack({len(labels)}, {pairs}) AS (le, cumulative_count)")


def duration_summary(votes_long: DataFrame) -> DataFrame:
    """The histogram's ``sum`` and ``count`` per detector."""
    return successful(votes_long).groupBy("cluster_id").agg(
        F.sum("prediction_time").alias("duration_sum"), F.count(F.lit(1)).alias("duration_count"))


def ensemble_status(decisions: DataFrame, registry: DataFrame) -> DataFrame:
    """Decision and conflict counts, mean scoring time, registered detectors, recent conflicts.

    One pass over decisions that still carry their ``votes``: a flow's scoring time is
    a sum inside its array, so nothing is exploded or grouped by flow."""
    ok = F.filter("votes", lambda v: F.coalesce(v["is_trained"], F.lit(False)) & v["error"].isNull())
    spent = F.when(F.size(ok) > 0, F.aggregate(ok, F.lit(0.0), lambda acc, v: acc + v["prediction_time"]))
    d = decisions.select("conflicts_detected", spent.alias("t")).agg(
        F.count(F.lit(1)).alias("decision_count"),
        F.coalesce(F.sum((F.col("conflicts_detected") > 0).cast("long")), F.lit(0)).alias("conflict_count"),
        F.avg("t").alias("avg_scoring_time"))
    n = registry.agg(F.count(F.lit(1)).alias("active_clusters"))
    # two one-row aggregates: combined without a join
    return (d.unionByName(n, allowMissingColumns=True)
             .agg(*[F.max(c).alias(c) for c in ("decision_count", "conflict_count", "avg_scoring_time", "active_clusters")])
             .withColumn("recent_conflicts", F.least(F.lit(10).cast("long"), F.col("conflict_count"))))


def attack_distribution(decisions: DataFrame, shown=DASHBOARD_TYPES) -> DataFrame:
    """Decisions per attack type, anything not shown folded into 'Other'."""
    t = F.when(F.col("attack_type").isin(list(shown)), F.col("attack_type")).otherwise(F.lit("Other"))
    return decisions.groupBy(t.alias("attack_type")).agg(F.count(F.lit(1)).alias("n"))


def severity_distribution(decisions: DataFrame) -> DataFrame:
    """Low/Medium/High/Critical counts, zeros kept (one pass, then stack)."""
    aggs = [F.sum((F.col("severity") == s).cast("long")).alias(s) for s in SEVERITIES]
    pairs = ", ".join(f"'{s}', coalesce(`{s}`, 0L)" for s in SEVERITIES)
    return decisions.agg(*aggs).selectExpr(f"stack({len(SEVERITIES)}, {pairs}) AS (severity, n)")


def latest_by_host(samples: DataFrame) -> DataFrame:
    """Latest value of each metric per host (max_by on (ts, id), partial agg)."""
    return samples.groupBy("host").pivot("metric", list(ALERT_THRESHOLDS)).agg(
        F.max_by("value", newest_first(samples, "ts", "sample_id")))


def health_check(samples: DataFrame, thresholds=ALERT_THRESHOLDS) -> DataFrame:
    """A host is unhealthy when its latest sample of any metric is above
    its threshold (strict).  ``issues`` lists the metrics in threshold order."""
    latest = latest_by_host(samples)
    flags = [F.when(F.col(m) > float(t), F.lit(m)) for m, t in thresholds.items()]
    issues = F.array_compact(F.array(*flags))
    return latest.select(
        "host", *[F.col(m) for m in thresholds],
        F.when(F.size(issues) > 0, "unhealthy").otherwise("healthy").alias("status"),
        F.array_join(issues, ",").alias("issues"))


def threshold_alerts(samples: DataFrame, metrics=("cpu_usage", "memory_usage"),
                     thresholds=ALERT_THRESHOLDS) -> DataFrame:
    """Every sample of an alerting metric above its threshold."""
    thr = F.create_map(*[x for m in metrics for x in (F.lit(m), F.lit(float(thresholds[m])))])
    s = samples.filter(F.col("metric").isin(list(metrics))) \
               .withColumn("threshold", F.try_element_at(thr, F.col("metric")))
    return s.filter(F.col("value") > F.col("threshold")).select(
        "sample_id", "host", F.col("metric").alias("type"), "value", "threshold", "ts")


def system_status(registry: DataFrame, votes_long: DataFrame) -> DataFrame:
    """Every registered detector with its rolled-up state."""
    st = detector_status(votes_long)
    trained = votes_long.groupBy("cluster_id").agg(
        F.max(F.coalesce(F.col("is_trained"), F.lit(False)).cast("int")).alias("_t"))
    return (registry.join(st, "cluster_id", "left").join(trained, "cluster_id", "left")
            .select("cluster_id", "attack_type", "model_type",
                    (F.coalesce(F.col("_t"), F.lit(0)) == 1).alias("is_trained"),
                    F.coalesce(F.col("prediction_count"), F.lit(0).cast("long")).alias("prediction_count"),
                    F.coalesce(F.col("avg_prediction_time"), F.lit(0.0)).alias("avg_prediction_time")))


# --- history views (L1-L3) ----------------------------------------------------

def latest(df: DataFrame, n: int, order=("ts", "flow_id")) -> DataFrame:
    """L1: the ``n`` most recent rows (top-k), oldest first."""
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(n).orderBy(*order)


def threats(recent: DataFrame, first: int = 20, order=("ts", "flow_id")) -> DataFrame:
    """L2: of the recent decisions the non-Benign ones, the oldest ``first`` of them."""
    return recent.filter(F.col("attack_type") != "Benign").orderBy(*order).limit(first)


def retain(history: DataFrame, max_rows: int = 1000, keep: int = 500,
           order=("ts", "flow_id")) -> DataFrame:
    """L3: when the history holds more than ``max_rows``, keep the newest ``keep``.

    One pass: the newest ``max_rows`` + 1 rows tell which case it is, and hold the rows of
    either.  ``sources.history.retain_history`` is the storage job by date."""
    newest = history.orderBy(*[F.col(c).desc() for c in order]).limit(max_rows + 1)
    w = Window.orderBy(*[F.col(c).desc() for c in order])  # over max_rows + 1 rows
    placed = newest.withColumn("_rank", F.row_number().over(w)).withColumn("_rows", F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))))
    return placed.where((F.col("_rows") <= max_rows) | (F.col("_rank") <= keep)).orderBy(*order).drop("_rank", "_rows")
