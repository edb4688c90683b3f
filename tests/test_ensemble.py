"""Ensemble decision: golden micro-tables and a property test against brute force."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brute import decide as brute_decide
from netvigil.config import EnsembleConfig, detector_registry
from netvigil.operators import ensemble

SCHEMA = ("flow_id long, votes array<struct<ordinal:int, cluster_id:string, attack_type:string, "
          "model_type:string, is_trained:boolean, error:string, prediction:string, confidence:double>>")
REG = detector_registry()


def vote(o, pred, conf, trained=True, error=None, model=None, attack=None):
    _, _, cid, at, mt = REG[o]
    return {"ordinal": o, "cluster_id": cid, "attack_type": attack or at, "model_type": model or mt,
            "is_trained": trained, "error": error, "prediction": pred, "confidence": conf}


def run(spark, cases, **kw):
    rows = [(i, [dict(v) for v in votes]) for i, votes in enumerate(cases)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = ensemble.decide(df, **kw).orderBy("flow_id").collect()
    return [(r.attack_type, r.prediction, r.confidence, r.severity, r.method, r.conflicts_detected) for r in out]


CASES = {
    "no valid votes": [vote(0, "DoS", 0.0), vote(1, "DoS", 0.9, trained=False), vote(2, "DDoS", 0.9, error="x")],
    "one valid vote": [vote(0, "DoS", 0.95)],
    "critical": [vote(0, "DoS", 0.95), vote(1, "DoS", 0.95)],
    "exact tie -> first in walk": [vote(0, "DoS", 0.5), vote(1, "DDoS", 0.75)],
    "unknown class": [vote(0, "Zero_Day", 0.9)],
    "unknown model type weight 0.5": [vote(0, "DoS", 0.8, model="gbt"), vote(2, "DDoS", 0.9)],
    "confidence exactly 0.9": [vote(0, "DoS", 0.9), vote(1, "DoS", 0.9)],
    "confidence exactly 0.8": [vote(0, "DoS", 0.8)],
    "confidence exactly 0.6": [vote(0, "DoS", 0.6)],
    "confidence exactly 0.7 (no E2)": [vote(0, "DoS", 0.7), vote(2, "DDoS", 0.7)],
    "class conflict bumps Low->Medium": [vote(0, "DoS", 0.3), vote(1, "Benign", 0.2)],
    "attack-type conflict": [vote(0, "DoS", 0.95), vote(2, "DDoS", 0.95)],
    "benign is low": [vote(16, "Benign", 0.99), vote(17, "Benign", 0.99)],
}


@pytest.mark.parametrize("strategy", ["weighted_voting", "majority_voting", "highest_confidence"])
def test_golden_cases_match_brute_force(spark, strategy):
    got = run(spark, list(CASES.values()), strategy=strategy)
    want = [brute_decide(c, strategy) for c in CASES.values()]
    for name, g, w in zip(CASES, got, want):
        assert g[0] == w[0] and g[1] == w[1] and g[3:] == w[3:], name
        assert abs(g[2] - w[2]) < 1e-9, name


def test_specific_golden_values(spark):
    got = dict(zip(CASES, run(spark, list(CASES.values()))))
    assert got["no valid votes"] == ("Unknown", "Unknown", 0.0, "Low", "default", 0)
    assert got["critical"][3] == "Critical"
    assert got["unknown class"][0] == "Unknown"
    assert got["confidence exactly 0.8"][3] == "High"
    assert got["confidence exactly 0.6"][3] == "Medium"
    assert got["confidence exactly 0.7 (no E2)"][5] == 0
    assert got["attack-type conflict"][5] == 1 and got["attack-type conflict"][3] == "Medium"  # score 0.475: Low, bumped
    assert got["class conflict bumps Low->Medium"][3] == "Medium"
    assert got["benign is low"][3] == "Low"
    # tie: DoS_lstm 0.6*0.5 = 0.3 vs DoS_svm ... first class in the walk wins
    assert got["exact tie -> first in walk"][1] == brute_decide(CASES["exact tie -> first in walk"])[1]


def test_weights_not_summing_to_one_are_normalised(spark):
    votes = [vote(0, "DoS", 0.9), vote(1, "DDoS", 0.8), vote(3, "DDoS", 0.3)]
    a = run(spark, [votes], cfg=EnsembleConfig(weights={"lstm": 3.0, "svm": 2.0}))
    b = run(spark, [votes])
    assert a == b


def test_unknown_strategy_falls_back_to_weighted(spark):
    votes = [vote(0, "DoS", 0.9), vote(1, "DDoS", 0.8)]
    assert run(spark, [votes], strategy="nope") == run(spark, [votes], strategy="weighted_voting")


preds = st.sampled_from(["DoS", "DDoS", "Benign", "Botnet", "Zero_Day"])
confs = st.sampled_from([0.0, 0.1, 0.3, 0.5, 0.6, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95, 1.0])
vote_st = st.builds(lambda o, p, c, t, e: vote(o, p, c, trained=t, error="boom" if e else None),
                    st.integers(0, 17), preds, confs, st.booleans(), st.booleans())


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(vote_st, min_size=0, max_size=18, unique_by=lambda v: v["ordinal"]),
                min_size=1, max_size=8),
       st.sampled_from(["weighted_voting", "majority_voting", "highest_confidence"]))
def test_property_matches_brute_force(spark, cases, strategy):
    got = run(spark, cases, strategy=strategy)
    for c, g in zip(cases, got):
        w = brute_decide(c, strategy)
        assert (g[0], g[1], g[3], g[4], g[5]) == (w[0], w[1], w[3], w[4], w[5])
        assert abs(g[2] - w[2]) < 1e-9


def test_nest_votes_roundtrip(spark):
    from netvigil.sources import derived
    fv = derived.flows_with_votes(derived.load_flows(spark, "/root/testdata/sf0.001"))
    long = derived.votes_long(fv)
    nested = ensemble.nest_votes(long)
    a = ensemble.decide(fv).select("flow_id", "prediction", "severity")
    b = ensemble.decide(nested).select("flow_id", "prediction", "severity")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_filter_on_decision_stays_cheap(spark):
    """A pushed-down filter must not copy the decision expression many times."""
    from netvigil.sources import derived
    fv = derived.flows_with_votes(derived.load_flows(spark, "/root/testdata/sf0.001"))
    d = ensemble.decide(fv).filter(F.col("severity") == "Critical")
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("class_conflict") <= 4
