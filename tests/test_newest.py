"""The newest value by a number that a hash aggregate can hold; history files by day."""

import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from netvigil.operators import monitor
from netvigil.sources.files import append_history


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_number_orders_like_the_struct(spark, kind):
    times = [None, datetime(1901, 3, 4, 5, 6, 7, 123456), datetime(1970, 1, 1), datetime(2024, 1, 1, 23, 59, 59, 999999), datetime(9000, 1, 1)]
    ids = [None, -(2**63), -1, 0, 1, 2**63 - 1]
    df = spark.createDataFrame([(t, i) for t in times for i in ids], f"ts {kind}, id long")
    rows = df.select(monitor.newest_first(df, "ts", "id").alias("k"), F.struct("ts", "id").alias("s")).orderBy("s").collect()
    keys = [r["k"] for r in rows]
    assert all(a < b for a, b in zip(keys, keys[1:]))


def test_detector_status_sorts_no_votes(spark):
    votes = spark.createDataFrame([("a", True, None, 0.5, None, 2), ("a", True, None, 0.1, datetime(2024, 1, 1), 1), ("b", True, None, None, None, None)],
                                  "cluster_id string, is_trained boolean, error string, prediction_time double, ts timestamp, flow_id long")
    d = monitor.detector_status(votes)
    assert "SortAggregate" not in d._jdf.queryExecution().executedPlan().toString()
    assert {r["cluster_id"]: (r["prediction_count"], r["last_prediction_time"]) for r in d.collect()} == {"a": (2, 0.1), "b": (1, None)}


def test_appended_days_are_one_file_each(spark, tmp_path):
    rows = spark.range(400).select("id", F.timestamp_seconds(F.col("id") * 1000).alias("ts")).repartition(8)
    append_history(rows, f"{tmp_path}/h")
    days = [d for d in os.listdir(f"{tmp_path}/h") if d.startswith("date=")]
    assert len(days) == 5
    assert all(sum(f.endswith(".parquet") for f in os.listdir(f"{tmp_path}/h/{d}")) == 1 for d in days)
    assert spark.read.parquet(f"{tmp_path}/h").count() == 400
