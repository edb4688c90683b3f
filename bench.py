"""Benchmark the headline queries; prints one JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Each query runs to completion through the ``noop`` sink (full execution, no
collect); the reported time is the best of ``BENCH_REPEAT`` runs (default 2)
after one warm-up of the session.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from netvigil.operators import ensemble, evaluate, features, prep  # noqa: E402
from netvigil.session import get_session  # noqa: E402
from netvigil.sources import derived  # noqa: E402


def q_rolling_features(spark, d):
    """W1-W13 over the global frame (halo blocks)."""
    return features.rolling_features(derived.load_flows(spark, d), features.BASIC + features.ADVANCED)


def q_rolling_correlation(spark, d):
    """15 rolling correlations."""
    return features.rolling_features(derived.load_flows(spark, d), tuple(features.corr_names()))


def q_keyed_features(spark, d):
    """W1 + W4 per src_ip (halo blocks)."""
    return features.rolling_features(derived.load_flows(spark, d),
                                     ("packet_size_mean", "packet_size_std", "unique_dst_ips"),
                                     key_cols=("src_ip",))


def q_decision(spark, d):
    """18 votes per flow -> decision -> summary."""
    dec = ensemble.decide(derived.flows_with_votes(derived.load_flows(spark, d)))
    return dec.groupBy("attack_type", "severity").agg(F.count(F.lit(1)).alias("n"))


def q_decisions_full(spark, d):
    """E8 per flow with conflicts and class scores (row output)."""
    return ensemble.decide(derived.flows_with_votes(derived.load_flows(spark, d)))


def q_evaluation(spark, d):
    """A2-A4 per detector."""
    ev = derived.eval_predictions(derived.flows_with_votes(derived.load_flows(spark, d)))
    return evaluate.classification_report(evaluate.confusion(ev))


def q_fan(spark, d):
    """A1 + J2."""
    return features.attach_fan(derived.load_flows(spark, d))


def q_split(spark, d):
    """X4 exact stratified split."""
    return prep.stratified_split(derived.load_flows(spark, d).select("flow_id", "label"))


def q_feature_row(spark, d):
    """All 35 rolling features."""
    return features.rolling_features(derived.load_flows(spark, d), features.BASIC + features.ADVANCED + tuple(features.corr_names()))


def q_training_sets(spark, d):
    """X2 + X3."""
    return prep.training_sets(derived.load_flows(spark, d), derived.clusters_df(spark), 10_000)


def q_best_detectors(spark, d):
    """L4 over A2-A4."""
    ev = derived.eval_predictions(derived.flows_with_votes(derived.load_flows(spark, d)))
    return evaluate.best_by_metric(evaluate.classification_report(evaluate.confusion(ev, ("ordinal", "cluster_id"))))


QUERIES = {
    "rolling_features": q_rolling_features,
    "rolling_correlation": q_rolling_correlation,
    "keyed_features": q_keyed_features,
    "decision_summary": q_decision,
    "decisions_full": q_decisions_full,
    "evaluation": q_evaluation,
    "fan_join": q_fan,
    "stratified_split": q_split,
    "feature_row": q_feature_row,
    "training_sets": q_training_sets,
    "best_detectors": q_best_detectors,
}


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = int(os.environ.get("BENCH_REPEAT", "2"))
    only = [q for q in os.environ.get("BENCH_ONLY", "").split(",") if q]
    spark = get_session(f"local[{cpus}]", shuffle_partitions=max(8, cpus * 2))
    m = re.search(r"sf([0-9.]+)", sf_dir)
    sf = float(m.group(1)) if m else None
    # warm-up: JVM, parquet footer cache, codegen of the flow projection
    derived.load_flows(spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name, fn in QUERIES.items():
        if only and name not in only:
            continue
        best = None
        for _ in range(repeat):
            t0 = time.perf_counter()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            dt = time.perf_counter() - t0
            best = dt if best is None else min(best, dt)
            spark.catalog.clearCache()
        times[name] = round(best, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec",
                      "queries": times, "sf": sf, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
