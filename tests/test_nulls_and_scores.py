"""NULLs in sampling, splitting and correlation; contingency scores by hand."""

import math

import pytest
from pyspark.sql import functions as F

from netvigil.operators import features, monitor, prep


def test_sample_counts_rows_without_id(spark):
    rows = spark.createDataFrame([(k if k % 3 else None, k) for k in range(30)], "flow_id long, v long")
    for n in (0, 4, 17, 30, 50):
        assert prep.exact_sample(rows, n).count() == min(n, 30)


def test_split_keeps_rows_without_label(spark):
    rows = spark.createDataFrame([(k, "a" if k % 3 else None) for k in range(30)], "flow_id long, label string")
    got = prep.stratified_split(rows)
    sizes = {(r["label"], r["split"]): r["count"] for r in got.groupBy("label", "split").count().collect()}
    assert sizes == {(None, "test"): 2, (None, "val"): 1, (None, "train"): 7, ("a", "test"): 4, ("a", "val"): 2, ("a", "train"): 14}
    shares = {r["split"]: r["count"] for r in prep.hash_split(spark.range(20_000).withColumnRenamed("id", "flow_id")).groupBy("split").count().collect()}
    assert abs(shares["test"] - 4000) < 300 and abs(shares["val"] - 2000) < 250


def test_correlation_of_complete_pairs(spark):
    rows = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 6.0), (100.0, None), (None, -50.0)], "a double, b double")
    assert prep.correlation_pairs(rows, ["a", "b"]).first()["r"] == pytest.approx(1.0)
    assert prep.correlation_pairs(rows.where("a is null"), ["a", "b"]).first()["r"] is None


def test_correlation_of_many_columns(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    v = rng.normal(size=(300, 11)) + rng.normal(size=(300, 1))
    gap = rng.random((300, 11)) < 0.1
    v[:, 7], gap[:, 7] = 5.0, False  # constant: no correlation
    names = [f"c{k}" for k in range(11)]
    rows = spark.createDataFrame([tuple(None if g else float(x) for x, g in zip(*r)) for r in zip(v, gap)], ", ".join(f"{n} double" for n in names))
    got = prep.correlation_pairs(rows, names).collect()
    assert len(got) == len({(r["feature_a"], r["feature_b"]) for r in got}) == 55
    for r in got:
        i, j = names.index(r["feature_a"]), names.index(r["feature_b"])
        ok = ~gap[:, i] & ~gap[:, j]
        assert i < j and (r["r"] is None if 7 in (i, j) else r["r"] == pytest.approx(np.corrcoef(v[ok, i], v[ok, j])[0, 1]))
    assert [r["r"] for r in prep.correlation_pairs(rows.limit(0), names).collect()] == [None] * 55
    assert prep.correlation_pairs(rows, names[:1]).count() == 0


def test_correlation_aggregate_has_compiled_code(spark):
    """The aggregate of 20 columns (x5_selected_features) stays inside code generation, in methods that HotSpot compiles."""
    import re

    names = [f"c{k}" for k in range(20)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        pairs = prep.correlation_pairs(spark.range(10).select(*[(F.col("id") * k).cast("double").alias(n) for k, n in enumerate(names)]), names)
        text = spark._jvm.PythonSQLUtils.explainString(pairs._jdf.queryExecution(), "codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "HashAggregate" in text
    assert max(int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", text)) < 8000


def test_contingency_scores_by_hand(spark):
    rows = [(float(k), "x" if k < 5 else "y") for k in range(10)] + [(None, "x")] * 4
    df = spark.createDataFrame(rows, "v double, label string").withColumn("same", F.lit(1.0))
    got = {r["feature"]: r for r in prep.contingency_scores(df, ["v", "same"], bins=2).collect()}
    assert got["v"]["chi2"] == pytest.approx(10.0) and got["v"]["mutual_info"] == pytest.approx(math.log(2))
    assert got["same"]["chi2"] == pytest.approx(0.0) and got["same"]["mutual_info"] == pytest.approx(0.0)
    assert prep.feature_scores(df, ["v"], "chi2", bins=2).first()["f_score"] == pytest.approx(10.0)
    best = prep.select_k_best(prep.feature_scores(df, ["v", "same"], "mutual_info", bins=2), 1)
    assert [(r["feature"], r["selected"]) for r in best.sort("rank").collect()] == [("v", True), ("same", False)]
    with pytest.raises(ValueError):
        prep.feature_scores(df, ["v"], "nope")


def test_retention_in_one_pass(spark):
    rows = spark.range(30).select(F.col("id").alias("flow_id"), (F.col("id") % 7).alias("ts"))
    assert monitor.retain(rows, 30, 5).count() == 30
    kept = monitor.retain(rows, 29, 5)
    assert [(r["ts"], r["flow_id"]) for r in kept.collect()] == [(5, 26), (6, 6), (6, 13), (6, 20), (6, 27)]


def test_sketches_of_days_merge(spark):
    rows = spark.range(4000).select(F.lit("s").alias("src_ip"), (F.col("id") % 1500).cast("string").alias("dst_ip"),
                                    F.timestamp_seconds(F.col("id") * 60).alias("timestamp"))
    sketches = features.fan_sketches(rows)
    assert sketches.count() == 3
    assert abs(features.merged_fan(sketches).first()["fan_out"] - 1500) < 75
