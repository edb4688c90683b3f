"""T3 conflict counters and T5 alerts over several files equal a plain walk over the rows."""

import datetime as dt
import random

from pyspark.sql import functions as F

from netvigil.operators import ensemble
from netvigil.sources import derived, files
from netvigil.streaming import keyed, stream

SF = "/root/testdata/sf0.001"
T0 = dt.datetime(2024, 1, 1)
SAMPLES = "sample_id long, ts timestamp, host string, metric string, value double"


def _samples(seed, n=600):
    rng, rows, at = random.Random(seed), [], 0.0
    for i in range(n):
        at += rng.choice([0, 1, 4, 9, 40])
        value = rng.choice([10.0, 79.9, 80.0, 80.1, 85.0, 85.1, 99.0, None, float("nan")])
        rows.append((i, T0 + dt.timedelta(seconds=at), rng.choice(["hot", "hot", "hot", "a", "b"]),
                     rng.choice(["cpu_usage", "memory_usage", "disk_usage"]), value))
    return rows


def _walk(rows, late=60):
    """Transitions of every alert by walking over the closed intervals."""
    latest, end = {}, max(r[1] for r in rows) - dt.timedelta(seconds=late)
    for i, ts, host, metric, value in sorted(rows, key=lambda r: (r[1], r[0])):
        w = T0 + dt.timedelta(seconds=((ts - T0).total_seconds() // 30 + 1) * 30)
        if w <= end:
            latest[host, metric, w] = value
    out, alert = [], {}
    for (host, metric, w), v in sorted(latest.items(), key=lambda x: x[0][2]):
        if metric == "disk_usage" or v is None or v != v:
            continue
        limit, at, k = {"cpu_usage": 80.0, "memory_usage": 85.0}[metric], int(w.replace(tzinfo=dt.timezone.utc).timestamp()), (host, metric)
        if v > limit:
            a = alert.setdefault(k, [at, v, 0])
            a[1], a[2] = max(a[1], v), a[2] + 1
            if a[2] == 1:
                out.append((host, metric, "opened", at, v, limit, *a))
        elif k in alert:
            out.append((host, metric, "closed", at, v, limit, *alert.pop(k)))
    return sorted(out)


def _stream(spark, rows, n_files, name):
    base, k = files.scratch_dir(spark, name), len(rows) // n_files + 1
    for i in range(n_files):
        spark.createDataFrame(rows[i * k:(i + 1) * k], SAMPLES).coalesce(1).write.parquet(f"{base}/in/p{i}")
    raw = spark.readStream.schema(SAMPLES).option("maxFilesPerTrigger", 1).parquet(f"{base}/in/*/*.parquet")
    return base, raw


def test_alerts_open_and_close_over_several_batches(spark):
    rows = _samples(3)
    base, raw = _stream(spark, rows, 5, "alerts")
    keyed.run_available(keyed.alert_stream(raw), f"{base}/out", f"{base}/ckpt")
    got = sorted(tuple(r) for r in spark.read.parquet(f"{base}/out").collect())
    assert got == _walk(rows) and {r[2] for r in got} == {"opened", "closed"}
    assert any(r[8] > 1 for r in got)  # an alert that stayed open over several checks


def test_a_restart_neither_repeats_nor_forgets_an_alert(spark):
    rows = [(i, T0 + dt.timedelta(seconds=30 * i), "a", "cpu_usage", v) for i, v in enumerate([90.0] * 6 + [10.0] * 6)]
    base = files.scratch_dir(spark, "alerts-restart")
    for part in (rows[:6], rows[6:]):
        spark.createDataFrame(part, SAMPLES).coalesce(1).write.mode("append").parquet(f"{base}/in")
        raw = spark.readStream.schema(SAMPLES).parquet(f"{base}/in")
        keyed.run_available(keyed.alert_stream(raw), f"{base}/out", f"{base}/ckpt")
    got = sorted((r["event"], r["n_checks"]) for r in spark.read.parquet(f"{base}/out").collect())
    assert got == [("closed", 6), ("opened", 1)]


def test_alerts_of_an_empty_stream(spark):
    base = files.scratch_dir(spark, "alerts-empty")
    spark.createDataFrame([], SAMPLES).coalesce(1).write.parquet(f"{base}/in")
    raw = spark.readStream.schema(SAMPLES).parquet(f"{base}/in")
    keyed.run_available(keyed.alert_stream(raw), f"{base}/out", f"{base}/ckpt")
    assert spark.read.schema("host string").parquet(f"{base}/out").count() == 0


def test_conflict_counts_by_type_equal_the_batch(spark):
    ev = spark.read.parquet(f"{SF}/events.parquet")
    base = files.scratch_dir(spark, "conflict-counts")
    ev.orderBy("ts", "event_id").coalesce(1).write.option("maxRecordsPerFile", 300).parquet(f"{base}/in")
    flows = derived.flows_with_votes(stream.flow_stream(stream.event_stream(spark, f"{base}/in", 1)))
    stream.run_updates(stream.conflict_counts(flows, late="1000 days"), f"{base}/out", f"{base}/ckpt")
    got = {(r["w"]["start"], r["conflict_type"]): r["n"] for r in stream.latest_updates(spark, f"{base}/out", ("w", "conflict_type")).collect()}
    want = {}
    batch = ensemble.with_conflicts(derived.flows_with_votes(stream.flow_stream(ev)))
    for r in batch.select(F.window("ts", "10 seconds").alias("w"), "conflicts.type").collect():
        for kind in r["type"]:
            want[r["w"]["start"], kind] = want.get((r["w"]["start"], kind), 0) + 1
    assert got == want and len({k for _, k in want}) == 2
