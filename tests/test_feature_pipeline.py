"""One fitted feature pipeline, saved, loaded and shared by training and scoring."""

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from netvigil.operators import detectors, feature_pipeline as fp
from netvigil.operators.prep import drop_correlated
from netvigil.sources import derived

SF = "/root/testdata/sf0.001"
FEATURES = ("packet_size_mean", "packet_size_std", "packet_size_max", "flow_duration_mean", "unique_src_ips",
            "src_ip_entropy", "dst_ip_entropy", "unique_dst_ips",
            "traffic_burstiness", "traffic_regularity")


@pytest.fixture(scope="module")
def flows(spark):
    return derived.load_flows(spark, SF)


@pytest.fixture(scope="module")
def fitted(flows):
    return fp.fit_pipeline(flows, [fp.EncodeValues(column="label"), *fp.flow_stages(FEATURES, raw=("dst_port",))])


def _rows(df):
    cols = sorted(df.columns)
    return sorted(df.select(*cols).collect(), key=str)


def test_reloaded_pipeline_gives_equal_features(spark, flows, fitted, tmp_path):
    fitted.write().overwrite().save(str(tmp_path / "p"))
    again = PipelineModel.load(str(tmp_path / "p"))
    assert [type(s) for s in again.stages] == [type(s) for s in fitted.stages]
    assert _rows(again.transform(flows)) == _rows(fitted.transform(flows))


def test_fit_equals_the_ml_pipeline(spark, flows, fitted):
    """Holding the windowed rows during the fit changes nothing against Spark ML's own Pipeline."""
    stages = [fp.EncodeValues(column="label"), *fp.flow_stages(FEATURES, raw=("dst_port",))]
    assert _rows(Pipeline(stages=stages).fit(flows).transform(flows)) == _rows(fitted.transform(flows))


def test_steps_do_what_the_single_functions_do(flows, fitted):
    rolled = fp.RollingFeatures(features=list(FEATURES)).transform(flows).na.fill(0, list(FEATURES))
    kept, gone = drop_correlated(rolled, [*FEATURES, "dst_port"])
    out = fitted.transform(flows)
    assert fp.scaling_of(fitted).get("columns") == kept
    assert not set(gone) & set(out.columns) and not {c + "_s" for c in gone} & set(out.columns)
    low, high = rolled.agg(F.min(kept[0]), F.max(kept[0])).first()
    worst = out.join(rolled.select("flow_id", kept[0]), "flow_id").agg(
        F.max(F.abs(F.col(kept[0] + "_s") - (F.col(kept[0]) - low) / (high - low)))).first()[0]
    assert worst < 1e-9
    codes = {r[0]: r[1] for r in out.select("label", "label_code").distinct().collect()}
    assert codes == {v: i for i, v in enumerate(sorted(codes))}


def test_k_best_decides_among_the_kept(flows):
    model = fp.fit_pipeline(flows, fp.flow_stages(FEATURES, k=2, score="mutual_info"))
    assert len(fp.scaling_of(model).get("columns")) == 2


def test_windows_stay_within_the_split(flows):
    step = fp.RollingFeatures(features=["packet_size_mean"], within=["split"], rows=3)
    parted = flows.withColumn("split", F.when(F.col("flow_id") % 2 == 0, "a").otherwise("b"))
    alone = step.transform(parted.where("split = 'a'")).select("flow_id", F.col("packet_size_mean").alias("want"))
    both = step.transform(parted).join(alone, "flow_id")
    assert both.count() == alone.count() and both.where("not packet_size_mean <=> want").count() == 0


def test_nulls_unseen_values_empty_table_and_extra_columns(spark, flows, fitted):
    odd = (flows.limit(5).withColumn("label", F.when(F.col("flow_id") % 2 == 0, "never seen"))
           .withColumn("packet_size", F.lit(None).cast("int")).withColumn("extra", F.lit(1)))
    out = fitted.transform(odd).collect()
    assert len(out) == 5 and all(r["label_code"] is None and r["extra"] == 1 for r in out)
    none = fp.fit_pipeline(flows.limit(0), fp.flow_stages(FEATURES))
    assert none.transform(flows.limit(0)).count() == 0
    got = none.transform(flows.limit(3)).select(*[c + "_s" for c in fp.scaling_of(none).get("columns")]).collect()
    assert len(got) == 3 and all(x == 0.0 for r in got for x in r)


def test_detectors_learn_from_the_pipeline_and_reload_with_it(spark, flows, tmp_path):
    reg = [r for r in derived.detector_registry() if r[3] == "DoS"]
    t = detectors.train_all(spark, flows, registry=reg, stages=fp.flow_stages(FEATURES, raw=("dst_port",)))
    try:
        assert [r[4] for r in t.result.rows] == ["trained", "trained"]
        assert set(t.features.cols) <= {*FEATURES, "dst_port"} and "packet_size_mean" in t.features.cols
        low, high = t.features.scaler.params["dst_port"]
        train = detectors.stratified_split(flows).where("split = 'train'")
        assert (low, high) == tuple(float(x) for x in train.agg(F.min("dst_port"), F.max("dst_port")).first())
        detectors.save_detectors(spark, t, str(tmp_path / "d"))
        fs, res = detectors.load_detectors(spark, str(tmp_path / "d"))
        assert fs.cols == t.features.cols
        want = detectors.score_votes(t.features, t.result, flows, reg).select("flow_id", "votes")
        got = detectors.score_votes(fs, res, flows, reg).select("flow_id", "votes")
        assert want.count() == flows.count() and want.exceptAll(got).count() == 0
    finally:
        t.release()
