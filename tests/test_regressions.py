"""One test per fault that a review found."""

import math

from pyspark.sql import functions as F

from netvigil.functions.scalar import is_valid_vote
from netvigil.operators import monitor, prep
from netvigil.plans.catalog import QUERIES

VOTE = "is_trained boolean, confidence double, prediction string, error string"


def test_votes_without_a_number_or_a_class_do_not_count(spark):
    rows = [(True, math.nan, "DoS", None), (True, 0.9, None, None), (True, 0.9, "DoS", None), (True, None, "DoS", None)]
    df = spark.createDataFrame(rows, VOTE).select(is_valid_vote({c: F.col(c) for c in ("is_trained", "confidence", "prediction", "error")}).alias("ok"))
    assert [r.ok for r in df.collect()] == [False, False, True, False]


def test_null_takes_no_ordinal_code(spark):
    df = spark.createDataFrame([("b",), (None,), ("a",)], "v string")
    assert {r.v: r.v_code for r in prep.ordinal_codes(df, "v").collect()} == {"a": 0, "b": 1, None: None}


def test_latest_returns_oldest_first(spark):
    df = spark.range(20).select(F.col("id").alias("flow_id"), F.col("id").alias("ts"))
    assert [r.flow_id for r in monitor.latest(df, 5).collect()] == [15, 16, 17, 18, 19]
    rows = QUERIES["l1_recent_decisions"](spark, "/root/testdata/sf0.001").collect()
    assert [r.position for r in rows] == list(range(1, len(rows) + 1))


def test_anova_counts_the_rows_of_each_feature(spark):
    rows = [("a", 1.0, 5.0), ("a", 2.0, 6.0), ("a", None, 7.0), ("b", 4.0, 5.0), ("b", 5.0, 9.0)]
    whole = spark.createDataFrame(rows, "label string, x double, y double")
    got = {r.feature: r.f_score for r in prep.anova_f(whole, ["x", "y"]).collect()}
    only = prep.anova_f(whole.where("x is not null"), ["x"]).first().f_score
    assert got["x"] == only and got["x"] == 18.0


def test_correlated_columns_are_dropped_by_the_first_that_stays():
    corr = {("a", "b"): 0.99, ("b", "c"): 0.99, ("a", "c"): 0.5, ("c", "d"): 1.0}
    assert prep.correlated_to_drop(corr, ["a", "b", "c", "d"], 0.95) == ["b"]
