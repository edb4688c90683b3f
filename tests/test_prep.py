"""Preparation edge cases and properties."""

from netvigil.operators import prep
from netvigil.sources import derived

SF = "/root/testdata/sf0.001"


def test_minmax_constant_negative_single(spark):
    df = spark.createDataFrame([(1, 5.0, -3.0), (2, 5.0, -1.0), (3, 5.0, -2.0)], "id int, c double, n double")
    m = prep.fit_minmax(df, ["c", "n"])
    got = {r["id"]: (r["c"], r["n"]) for r in m.transform(df).collect()}
    assert got == {1: (0.0, 0.0), 2: (0.0, 1.0), 3: (0.0, 0.5)}
    one = spark.createDataFrame([(1, 7.0)], "id int, c double")
    assert prep.fit_minmax(one, ["c"]).transform(one).collect()[0]["c"] == 0.0


def test_standard_constant_is_zero(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0)], "id int, c double")
    assert [r["c"] for r in prep.fit_standard(df, ["c"]).transform(df).collect()] == [0.0, 0.0]


def test_correlated_greedy_rule():
    cols = ["a", "b", "c", "d", "e"]
    corr = {("a", "b"): 1.0,      # exact duplicate: kept (r == 1.0 is skipped)
            ("a", "c"): 0.96,     # c dropped
            ("a", "d"): -0.96,    # d dropped
            ("c", "e"): 0.99}     # c already dropped -> e stays
    assert prep.correlated_to_drop(corr, cols) == ["c", "d"]
    chain = {("a", "b"): 0.97, ("b", "c"): 0.97}
    assert prep.correlated_to_drop(chain, ["a", "b", "c"]) == ["b"]


def test_stratified_split_disjoint_cover_and_sizes(spark):
    f = derived.load_flows(spark, SF).select("flow_id", "label")
    s = prep.stratified_split(f)
    n = f.count()
    assert s.count() == n and s.select("flow_id").distinct().count() == n
    per = {(r["label"], r["split"]): r["count"] for r in s.groupBy("label", "split").count().collect()}
    for lab in {k[0] for k in per}:
        tot = sum(v for (l2, _), v in per.items() if l2 == lab)
        assert per.get((lab, "test"), 0) == int(tot * 0.2 + 0.5)


def test_exact_sample_is_exact_and_stable(spark):
    f = derived.load_flows(spark, SF)
    a = [r["flow_id"] for r in prep.exact_sample(f, 50).collect()]
    b = [r["flow_id"] for r in prep.exact_sample(f, 50).collect()]
    assert len(a) == 50 and sorted(a) == sorted(b)


def test_training_sets_balance(spark):
    f = derived.load_flows(spark, SF)
    reg = derived.clusters_df(spark)
    t = prep.training_sets(f, reg, cap=10)
    for r in t.groupBy("attack_type").agg({"y": "sum", "*": "count"}).collect():
        pos = r["sum(y)"]
        assert r["count(1)"] - pos == min(pos, 10)


def test_register_detectors_rejects_duplicates(spark):
    reg = derived.clusters_df(spark)
    cands = spark.createDataFrame([("DoS", "lstm"), ("DoS", "gbt"), ("DoS", "gbt")], "attack_type string, model_type string")
    out = prep.register_detectors(reg, cands)
    assert out.count() == 19
    new = out.filter("model_type = 'gbt'").collect()[0]
    assert new["ordinal"] == 18 and new["attack_idx"] == 0 and new["cluster_id"] == "DoS_gbt"


def test_unknown_dataset_is_error():
    import pytest
    with pytest.raises(ValueError):
        prep.canonical_label(None, "no_such_dataset")


def test_roc_auc_scores_rank_sum(spark):
    from netvigil.operators.evaluate import roc_auc_scores
    rows = [("d", 0.9, 1), ("d", 0.8, 1), ("d", 0.7, 0), ("d", 0.8, 0), ("e", 0.5, 1)]
    df = spark.createDataFrame(rows, "cluster_id string, score double, y_true int")
    got = {r["cluster_id"]: r["roc_auc"] for r in roc_auc_scores(df).collect()}
    # d: pairs (pos, neg): (0.9,0.7)=1 (0.9,0.8)=1 (0.8,0.7)=1 (0.8,0.8)=0.5 -> 3.5/4
    assert abs(got["d"] - 0.875) < 1e-12 and got["e"] is None
