"""Halo-block windows equal the plain window; rolling micro-tables."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from netvigil.functions import rolling as R
from netvigil.operators import features, halo
from netvigil.sources import derived

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("block,key", [(3, ()), (11, ()), (64, ()), (5, ("src_ip",)), (37, ("src_ip",))])
def test_halo_equals_plain_window(spark, block, key):
    f = derived.load_flows(spark, SF)
    feats = ("packet_size_mean", "packet_size_std", "packet_size_median", "unique_dst_ips",
             "packet_rate", "src_ip_entropy")
    got = features.rolling_features(f, feats, key_cols=key, block_rows=block)
    w = Window.partitionBy(*key).orderBy("timestamp", "flow_id") if key else Window.orderBy("timestamp", "flow_id")
    plain = f.withColumn("_high_port", F.lit(0.0))
    fr = halo.HaloFrame(plain.withColumn("_halo", F.lit(False)).withColumn("_blk", F.lit(0)), w, [], [])
    df = fr.df.withColumn("_dt", R.seconds_since_previous("timestamp", w))
    v = w.rowsBetween(-9, 0)
    ex = {"packet_size_mean": R.r_mean("packet_size", v, 10), "packet_size_std": R.r_std("packet_size", v, 10),
          "packet_size_median": R.r_median("packet_size", v, 10), "unique_dst_ips": R.r_nunique("dst_ip", v, 10),
          "packet_rate": R.gated(F.try_divide(F.lit(1.0), F.avg("_dt").over(v)), "_dt", v, 10),
          "src_ip_entropy": R.r_entropy("src_ip", v, 10)}
    want = df.select("flow_id", *[ex[c].alias(c) for c in feats])
    a = {r["flow_id"]: r for r in got.collect()}
    b = {r["flow_id"]: r for r in want.collect()}
    assert a.keys() == b.keys()
    for k in a:
        for c in feats:
            x, y = a[k][c], b[k][c]
            assert (x is None and y is None) or abs(x - y) < 1e-9, (k, c, x, y)


def test_global_index_dense_and_ordered(spark):
    f = derived.load_flows(spark, SF)
    idx = halo.with_global_index(f.select("flow_id", "timestamp"), ["timestamp", "flow_id"], 7)
    rows = idx.orderBy("_idx").collect()
    assert [r["_idx"] for r in rows] == list(range(len(rows)))
    keys = [(r["timestamp"], r["flow_id"]) for r in rows]
    assert keys == sorted(keys)


def _micro(spark, values, ts=None):
    ts = ts or list(range(len(values)))
    rows = [(i, v, t) for i, (v, t) in enumerate(zip(values, ts))]
    return spark.createDataFrame(rows, "flow_id long, x double, t long")


def _roll(spark, values, fn, ts=None):
    df = _micro(spark, values, ts)
    w = Window.orderBy("t", "flow_id").rowsBetween(-2, 0)
    return [r["v"] for r in df.select("flow_id", fn("x", w, 3).alias("v")).orderBy("flow_id").collect()]


def test_fewer_rows_than_frame_is_null(spark):
    assert _roll(spark, [1.0, 2.0], R.r_mean) == [None, None]


def test_exactly_n_rows(spark):
    assert _roll(spark, [1.0, 2.0, 3.0], R.r_mean) == [None, None, 2.0]


def test_null_inside_frame_gates(spark):
    assert _roll(spark, [1.0, None, 3.0, 4.0, 5.0], R.r_mean) == [None, None, None, None, 4.0]


def test_constant_values_std_zero_and_corr_null(spark):
    assert _roll(spark, [2.0, 2.0, 2.0], R.r_std) == [None, None, 0.0]
    df = _micro(spark, [2.0, 2.0, 2.0])
    w = Window.orderBy("t", "flow_id").rowsBetween(-2, 0)
    r = df.select(R.r_corr("x", "t", w, 3).alias("r")).collect()
    assert [x["r"] for x in r] == [None, None, None]


def test_identical_timestamps_ordered_by_id(spark):
    got = _roll(spark, [1.0, 2.0, 3.0, 10.0], R.r_max, ts=[5, 5, 5, 5])
    assert got == [None, None, 3.0, 10.0]


def test_entropy_bounds(spark):
    df = spark.createDataFrame([(["a", "a", "b", "c"],), (["a", "a"],)], "v array<string>")
    e = [r[0] for r in df.select(R.entropy_of(F.col("v"))).collect()]
    import math
    assert abs(e[0] - (-(0.5 * math.log(0.5) + 2 * 0.25 * math.log(0.25)))) < 1e-12
    assert e[1] == 0.0


def test_plan_has_one_gate_count_per_column_and_no_global_window(spark):
    """Plan check: gates share one count per input column, and the window is
    partitioned by halo block (never a single-partition window)."""
    import re
    f = derived.load_flows(spark, SF)
    df = features.rolling_features(f, ("packet_size_mean", "packet_size_std", "packet_size_min",
                                       "packet_size_max", "traffic_burstiness"), block_rows=97)
    plan = df._jdf.queryExecution().executedPlan().toString()
    counts = re.findall(r"count\(packet_size#\d+\) windowspecdefinition", plan)
    assert len(counts) == 1
    corr = features.rolling_features(f, tuple(features.corr_names()), block_rows=97)
    plan = corr._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"stddev_pop\([^)]*\)+ windowspecdefinition", plan)) == 6
    assert re.search(r"windowspecdefinition\(_blk#\d+", plan)
