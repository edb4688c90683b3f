"""What the detectors move and evaluate: Fourier features behind the windows, one pass for all models, splits without a sort."""

import numpy as np
import pytest
from pyspark.ml.classification import LinearSVCModel
from pyspark.sql import functions as F

from netvigil.operators import detectors, prep
from netvigil.sources import files


@pytest.fixture(scope="module")
def flows(spark):
    e = F.col("id")
    return spark.range(400).select(
        e.alias("flow_id"), F.timestamp_seconds(1_700_000_000 + e * 7 % 401).alias("timestamp"), F.concat(F.lit("10.0.0."), e % 5).alias("src_ip"),
        F.when(e % 3 == 0, "DoS").otherwise("Benign").alias("label"),
        *[F.when(e % 11 != 0, (e * (2 * i + 3)) % 97).cast("double").alias(c) for i, c in enumerate(detectors.FEATURE_COLS)])


def test_the_windows_do_not_carry_the_fourier_features(flows):
    fs = detectors.fit_feature_space(flows)
    rows = detectors.featurize(fs, flows)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "COS(" not in plan and "svm_features" not in plan[plan.index("Window"):]
    w, b = np.array(fs.rff_w), np.array(fs.rff_b)
    for r in rows.collect():
        want = np.sqrt(2 / len(b)) * np.cos(w @ np.array(r["lstm_features"][-len(fs.cols):]) + b)
        assert r["svm_features"] == pytest.approx(list(want), abs=1e-12)


def test_scores_of_all_detectors_in_one_pass_equal_the_models_own(flows):
    fs = detectors.fit_feature_space(flows)
    rows = detectors.featurize(fs, flows).withColumn("y", (F.col("label") == "DoS").cast("int")).cache()
    models = [(k, detectors.train_detector(rows, k, max_iter=5)) for k in ("svm", "lstm")]
    got = detectors.detector_scores([(k, k, m, None) for k, m in models] + [("again", "svm", models[0][1], (2.0, 0.5))], rows)
    # a pass a model type, and that of the Fourier features below the cache
    assert got._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 3
    for kind, model in models:
        data = detectors._vec(got, detectors.features_of(kind), "fv")
        for r in model.setFeaturesCol("fv").transform(data).collect():
            raw = r["rawPrediction"]
            margin = raw[1] if isinstance(model, LinearSVCModel) else raw[1] - raw[0]
            assert r[f"{kind}_pred"] == r["prediction"] and r[f"{kind}_margin"] == pytest.approx(margin, rel=1e-6, abs=1e-8)
            if kind == "svm":
                assert r["again_p1"] == pytest.approx(1 / (1 + np.exp(-(2 * margin + 0.5))), rel=1e-6)


def test_only_border_buckets_are_ranked(spark, monkeypatch):
    rows = spark.range(30_000).select(F.col("id").alias("flow_id"), F.when(F.col("id") % 4 == 0, None).otherwise("a").alias("label"))
    want = prep.class_rank(rows, "label").select("flow_id", F.when(F.col("_rk") <= F.round(F.col("_n") * 0.2), "test").when(
        F.col("_rk") <= F.round(F.col("_n") * 0.2) + F.round(F.col("_n") * 0.1), "val").otherwise("train").alias("split")).collect()
    ranked, real = [], prep.class_rank
    monkeypatch.setattr(prep, "class_rank", lambda df, *a: ranked.append(df.count()) or real(df, *a))
    got = prep.stratified_split(rows)
    assert sorted(map(tuple, got.select("flow_id", "split").collect())) == sorted(map(tuple, want))
    sets = prep.training_sets(rows, spark.createDataFrame([("a",)], "attack_type string"), 50, positive_cap=50)
    assert sets.where("y = 1").count() == 50
    assert len(ranked) == 2 and max(ranked) < 300


def test_a_record_is_parsed_once(spark):
    raw = spark.createDataFrame([(1, '{"src_ip": "1.1.1.1"}'), (2, "no json"), (3, None)], "flow_id long, value string")
    for part in files.validate_records(raw):
        assert part._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
    assert files.validate_records(raw)[1].count() == 3
