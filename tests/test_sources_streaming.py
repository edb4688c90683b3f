"""Sources, sinks and streams (stream == batch twin)."""

from pyspark.sql import functions as F

from netvigil.sources import derived, files
from netvigil.streaming import stream

SF = "/root/testdata/sf0.001"


def test_contract_quarantines_missing_and_malformed(spark):
    raw = spark.createDataFrame([
        ('{"src_ip":"a","dst_ip":"b","src_port":1,"dst_port":2,"protocol":"TCP","packet_size":10}',),
        ('{"src_ip":"a","dst_ip":"b","src_port":1,"protocol":"TCP","packet_size":10}',),
        ('{"src_ip":"a","dst_ip":"b","src_port":1,"dst_port":2,"protocol":"TCP","packet_size":"big"}',),
        ('not json',)], "value string")
    good, bad = files.validate_records(raw)
    assert good.count() == 1 and bad.count() == 3
    errs = sorted(r["error"] for r in bad.collect())
    assert any("dst_port" in e for e in errs) and any("packet_size" in e for e in errs)


def test_ingest_defaults(spark):
    df = spark.createDataFrame([(None,), ("2024-01-01 00:00:00",)], "timestamp string") \
        .withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    out = files.with_ingest_defaults(df).collect()
    assert all(r["timestamp"] is not None and len(r["request_id"]) == 36 for r in out)


def test_csv_roundtrip_skips_unreadable_file(spark):
    f = derived.load_flows(spark, SF)
    d = files.scratch_dir(spark, "csv-test")
    files.write_flow_csv(f, f"{d}/ds")
    with open(f"{d}/ds/broken.csv.gz", "wb") as fh:
        fh.write(b"garbage")
    back = files.read_flow_csv(spark, f"{d}/ds/*.csv*")
    assert back.count() == f.count()
    assert back.select("timestamp").subtract(f.select(F.col("timestamp").cast("timestamp"))).count() == 0


def test_dataset_registry(spark):
    import pytest
    assert files.dataset_info("bot_iot_2019")["label_column"] == "category"
    with pytest.raises(ValueError):
        files.dataset_info("nope")
    assert files.datasets_df(spark).count() == 3


def _split_events(spark, n_files=4, duplicate=False):
    """Events cut into several parquet files (optionally re-sending one file)."""
    ev = spark.read.parquet(f"{SF}/events.parquet")
    d = files.scratch_dir(spark, "ev-stream")
    rows = ev.orderBy("ts", "event_id").collect()
    k = len(rows) // n_files + 1
    for i in range(n_files):
        part = rows[i * k:(i + 1) * k]
        spark.createDataFrame(part, ev.schema).coalesce(1).write.parquet(f"{d}/in/p{i:02d}")
    if duplicate:
        spark.createDataFrame(rows[:k], ev.schema).coalesce(1).write.parquet(f"{d}/in/p99")
    return d


def test_stream_scoring_equals_batch(spark):
    d = _split_events(spark)
    fl = stream.flow_stream(stream.event_stream(spark, f"{d}/in/*/*.parquet", max_files_per_trigger=1))
    stream.run_available(stream.score_stream(fl), f"{d}/out", f"{d}/ckpt")
    got = spark.read.parquet(f"{d}/out").select("flow_id", "severity", "prediction")
    batch = derived.flows_with_votes(derived.load_flows(spark, SF))
    from netvigil.operators import ensemble
    want = ensemble.decide(batch).select("flow_id", "severity", "prediction")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_stream_rolling_state_equals_batch_over_several_batches(spark):
    from netvigil.operators import features
    d = _split_events(spark)
    fl = stream.flow_stream(stream.event_stream(spark, f"{d}/in/*/*.parquet", max_files_per_trigger=1))
    stream.run_available(stream.rolling_state(fl), f"{d}/out", f"{d}/ckpt")
    got = {r["flow_id"]: r for r in spark.read.parquet(f"{d}/out").collect()}
    want = features.rolling_features(derived.load_flows(spark, SF), ("packet_size_mean", "packet_size_std"),
                                     key_cols=("src_ip",)).collect()
    assert len(got) == len(want)
    for r in want:
        g = got[r["flow_id"]]
        for c in ("packet_size_mean", "packet_size_std"):
            assert (g[c] is None and r[c] is None) or abs(g[c] - r[c]) < 1e-9


def test_stream_dedup_drops_resent_rows(spark):
    d = _split_events(spark, duplicate=True)
    fl = stream.flow_stream(stream.event_stream(spark, f"{d}/in/*/*.parquet", max_files_per_trigger=1))
    stream.run_available(stream.dedup(fl).select("flow_id", "ts"), f"{d}/out", f"{d}/ckpt")
    out = spark.read.parquet(f"{d}/out")
    assert out.count() == out.select("flow_id").distinct().count() == derived.load_flows(spark, SF).count()


def test_updates_of_several_batches_end_in_the_batch_counts(spark):
    """The last state of every key equals the counts over all rows."""
    d = _split_events(spark)
    src = lambda: stream.flow_stream(stream.event_stream(spark, f"{d}/in/*/*.parquet", max_files_per_trigger=1))
    batch = stream.flow_stream(spark.read.parquet(f"{SF}/events.parquet"))
    for name, fn, keys in (("t4", lambda f: stream.sliding_counts(f, late="1000 days"), ("w", "protocol")),
                           ("t6", lambda f: stream.running_stats(derived.votes_long(derived.flows_with_votes(f))), ("cluster_id",))):
        stream.run_updates(fn(src()), f"{d}/{name}", f"{d}/{name}-ckpt")
        got, want = stream.latest_updates(spark, f"{d}/{name}", keys), fn(batch)
        cols = [c for c in want.columns if not c.startswith("avg_")]
        assert got.select(cols).exceptAll(want.select(cols)).count() == 0 and got.count() == want.count() > 0


def test_an_idle_key_is_forgotten(spark):
    """After the timeout a key starts anew, so its next row has no full frame."""
    import time
    d = files.scratch_dir(spark, "idle")
    ev = spark.read.parquet(f"{SF}/events.parquet")
    rows = [r for r in ev.orderBy("ts", "event_id").collect() if r["user_id"] % 254 == ev.first()["user_id"] % 254]
    put = lambda k, part: spark.createDataFrame([(*r[:2], 7, *r[3:]) for r in part], ev.schema).coalesce(1).write.parquet(f"{d}/in/p{k}")
    base = (rows * 10)[:10]
    put(0, base[:9])
    fl = stream.flow_stream(stream.event_stream(spark, f"{d}/in/*/*.parquet"))
    q = (stream.rolling_state(fl, idle_ms=1000).writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", f"{d}/ckpt").trigger(processingTime="0 seconds").start(f"{d}/out"))
    read = lambda: spark.read.schema(stream.ROLLING_OUT).parquet(f"{d}/out")
    try:
        until = time.time() + 40
        while time.time() < until and (not q.lastProgress or read().count() < 9):
            time.sleep(0.5)
        time.sleep(4)
        put(1, base[9:])
        while time.time() < until and read().count() < 10:
            time.sleep(0.5)
    finally:
        q.stop()
    out = read()
    assert out.count() == 10 and out.where("packet_size_mean is not null").count() == 0


def test_history_append_partitions_by_date(spark):
    from netvigil.operators import ensemble
    dec = ensemble.decide(derived.flows_with_votes(derived.load_flows(spark, SF))).withColumnRenamed("timestamp", "ts")
    p = files.scratch_dir(spark, "hist")
    files.append_history(dec.select("flow_id", "ts", "severity"), p)
    files.append_history(dec.select("flow_id", "ts", "severity"), p)
    assert spark.read.parquet(p).count() == 2 * dec.count()


def test_late_file_keeps_on_time_rows(spark):
    """A file of old rows arriving after newer data does not break the
    watermarked window count, and every on-time row is counted.  (Spark only
    guarantees that data less late than the watermark is kept; older rows may
    or may not be dropped, so both outcomes are accepted for them.)"""
    ev = spark.read.parquet(f"{SF}/events.parquet")
    rows = ev.orderBy("ts", "event_id").collect()
    d = files.scratch_dir(spark, "late")
    half = len(rows) // 2
    spark.createDataFrame(rows[half:], ev.schema).coalesce(1).write.parquet(f"{d}/in/p1")
    spark.createDataFrame(rows[:50], ev.schema).coalesce(1).write.parquet(f"{d}/in/p2")  # late file
    fl = stream.flow_stream(stream.event_stream(spark, f"{d}/in/*/*.parquet", max_files_per_trigger=1))
    counts = (fl.withWatermark("ts", "1 minute").groupBy(F.window("ts", "10 seconds")).count())
    stream.run_available(counts, f"{d}/out", f"{d}/ckpt")
    total = spark.read.parquet(f"{d}/out").agg(F.sum("count")).first()[0] or 0
    assert len(rows) - half <= total <= len(rows) - half + 50


def test_columns_are_found_by_header(spark):
    d = files.scratch_dir(spark, "headers")
    parts = {"a.csv": "flow_id,src_ip,dst_ip,label\n1,s1,d1,x\n2,s2,d2,y\n",
             "b.csv": "﻿dst_ip,label,src_ip,flow_id\nd3,x,s3,3\n",
             "c.csv": 'extra,flow_id,"src_ip",extra\nq,4,s4,r\n',
             "d.csv": "", "e.csv.gz": "no gzip"}
    for name, text in parts.items():
        files.write_bytes(spark, f"{d}/{name}", text.encode())
    index = files.header_index(spark, f"{d}/*.csv*")
    assert [f.columns for f in index[2:]] == [("extra", "flow_id", "src_ip", "extra.1"), None, None]
    assert [r["path"][-8:] for r in files.skipped_files(spark, index).sort("path").collect()] == [index[3].path[-8:], "e.csv.gz"]
    got = files.read_flow_csv(spark, f"{d}/*.csv*").select("flow_id", "src_ip", "dst_ip", "label", "extra", "`extra.1`")
    assert sorted(map(tuple, got.collect())) == [(1, "s1", "d1", "x", None, None), (2, "s2", "d2", "y", None, None),
                                                 (3, "s3", "d3", "x", None, None), (4, "s4", None, None, "q", "r")]
    alone = [files.read_flow_csv(spark, f"{d}/{n}").select("flow_id", "src_ip", "dst_ip", "label") for n in ("a.csv", "b.csv", "c.csv")]
    assert sorted(map(tuple, got.drop("extra", "extra.1").collect()), key=str) == sorted((tuple(r) for a in alone for r in a.collect()), key=str)
    assert files.read_flow_csv(spark, f"{d}/*.csv", keep_extra=False).columns == [f.name for f in files.FLOW_CSV.fields]


def test_dataset_files_of_different_types_are_united(spark):
    d = files.scratch_dir(spark, "dataset")
    for name, text in {"1.csv": "x,y,Label\n1,a,Benign\n", "2.csv": "y,z,x,Label\nb,7,2.5,DoS\n", "3.csv": "Label,z,x\nDDoS,w,3\n"}.items():
        files.write_bytes(spark, f"{d}/cic_iot_2023/{name}", text.encode())
    got = files.load_dataset(spark, d, "cic_iot_2023")
    assert {f.name: f.dataType.simpleString() for f in got.schema} == {"x": "double", "y": "string", "z": "string", "label": "string"}
    assert sorted(map(tuple, got.select("label", "x", "y", "z").collect())) == [("Benign", 1.0, "a", None), ("DDoS", 3.0, None, "w"), ("DoS", 2.5, "b", "7")]


def test_no_readable_file(spark):
    import pytest
    d = files.scratch_dir(spark, "nothing")
    files.write_bytes(spark, f"{d}/a.csv", b"")
    assert files.read_flow_csv(spark, f"{d}/*.csv").count() == 0
    with pytest.raises(ValueError):
        files.read_flow_csv(spark, f"{d}/*.csv", schema=None)
    with pytest.raises(ValueError):
        files.read_flow_csv(spark, f"{d}/*.csv", skip_bad_files=False)
