"""T2 over transformWithState: every feature equals the batch window, over several files, with hot and idle keys."""

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from netvigil.operators import features
from netvigil.sources import derived, files
from netvigil.streaming import keyed, stream

SF = "/root/testdata/sf0.001"


def _files(spark, rows, schema, n):
    d = files.scratch_dir(spark, "keyed")
    k = len(rows) // n + 1
    for i in range(n):
        spark.createDataFrame(rows[i * k:(i + 1) * k], schema).coalesce(1).write.parquet(f"{d}/in/p{i}")
    return d


def _same(got, want):
    for f in keyed.FEATURES:
        a, b = got[f], want[f]
        assert (a is None) == (b is None) and (a is None or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)), (f, a, b)


@pytest.mark.parametrize("hot", [False, True])
def test_all_features_over_several_files(spark, hot):
    ev = spark.read.parquet(f"{SF}/events.parquet")
    rows = ev.orderBy("ts", "event_id").collect()
    if hot:  # one source sends all flows
        rows = [(*r[:2], 7, *r[3:]) for r in rows]
    d = _files(spark, rows, ev.schema, 4)
    flows = stream.flow_stream(stream.event_stream(spark, f"{d}/in/*/*.parquet", max_files_per_trigger=1))
    before = spark.conf.get(keyed.PROVIDER)
    keyed.run_available(keyed.rolling_stream(flows), f"{d}/out", f"{d}/ckpt")
    assert spark.conf.get(keyed.PROVIDER) == before
    got = {r["flow_id"]: r for r in spark.read.parquet(f"{d}/out").collect()}
    batch = derived.flows_from_events(spark.read.parquet(f"{d}/in/*/*.parquet"))
    want = features.rolling_features(batch, keyed.FEATURES, key_cols=("src_ip",)).collect()
    assert len(got) == len(want) == len(rows)
    for w in want:
        _same(got[w["flow_id"]], w)
    if hot:
        assert sum(r["packet_rate"] is not None for r in got.values()) == len(rows) - 10


def test_ring_frame_against_plain_python():
    rng = random.Random(1)
    frame, rows = keyed.RingFrame(4), []
    for k in range(200):
        values = (rng.choice("ab"), rng.choice(["x", "y", None]), *[rng.choice([1.0, 2.0, 5.0, None]) for _ in range(7)])
        frame.push(k * 1_000_000, values)
        rows = [*rows, values][-4:]
        got = frame.features()
        dst = [r[1] for r in rows]
        whole = len(rows) == 4 and None not in dst
        assert got["unique_dst_ips"] == (len(set(dst)) if whole else None)
        if whole:
            assert got["dst_ip_entropy"] == pytest.approx(-sum(dst.count(x) / 4 * math.log(dst.count(x) / 4) for x in set(dst)))
        size = [r[4] for r in rows]
        assert (got["packet_size_mean"] is None) == (len(size) < 4 or None in size)


@pytest.mark.parametrize("idle_ms,full", [(1000, 0), (10**9, 1)])
def test_an_idle_key_is_forgotten_by_the_store(spark, idle_ms, full):
    ev = spark.read.parquet(f"{SF}/events.parquet")
    rows = [(*r[:2], 7, *r[3:]) for r in ev.orderBy("ts", "event_id").take(10)]
    d = files.scratch_dir(spark, "idle-keyed")
    put = lambda k, part: spark.createDataFrame(part, ev.schema).coalesce(1).write.parquet(f"{d}/in/p{k}")
    put(0, rows[:9])
    flows = stream.flow_stream(stream.event_stream(spark, f"{d}/in/*/*.parquet"))
    with keyed.rocksdb(spark):  # a stream that goes on: with a time to live Spark plans batches without end
        q = (keyed.rolling_stream(flows, idle_ms=idle_ms).writeStream.format("parquet").outputMode("append")
             .option("checkpointLocation", f"{d}/ckpt").trigger(processingTime="0 seconds").start(f"{d}/out"))

    def out():
        try:
            return spark.read.parquet(f"{d}/out")
        except Exception:  # nothing is written yet
            return spark.createDataFrame([], "flow_id long, packet_size_mean double")

    try:
        until = time.time() + 60
        while time.time() < until and out().count() < 9:
            time.sleep(0.5)
        time.sleep(4)
        put(1, rows[9:])
        while time.time() < until and out().count() < 10:
            time.sleep(0.5)
    finally:
        q.stop()
    assert out().count() == 10 and out().where("packet_size_mean is not null").count() == full
