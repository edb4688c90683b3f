"""Detector evaluation.

Input: one row per scored example with ``y_true``/``y_pred`` in {0, 1} and the
detector key columns.  Everything reduces to four counts per detector,
computed in one partial aggregation; the per-detector metric table is tiny.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRICS = ("accuracy", "precision", "recall", "f1_score")


def confusion(ev: DataFrame, keys=("cluster_id",)) -> DataFrame:
    """A2: 2x2 confusion matrix per detector as tn, fp, fn, tp (zeros kept)."""
    t, p = F.col("y_true"), F.col("y_pred")

    def n(cond: Column) -> Column:
        return F.sum(F.when(cond, 1).otherwise(0)).cast("long")

    return ev.groupBy(*keys).agg(
        n((t == 0) & (p == 0)).alias("tn"), n((t == 0) & (p == 1)).alias("fp"),
        n((t == 1) & (p == 0)).alias("fn"), n((t == 1) & (p == 1)).alias("tp"))


def _ratio(a: Column, b: Column) -> Column:
    """Zero-denominator rule: 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def _f1(p: Column, r: Column) -> Column:
    return F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))


def classification_report(cm: DataFrame) -> DataFrame:
    """A3 + A4: per-class precision/recall/F1/support, accuracy, macro and
    weighted averages, and ROC AUC of hard predictions ((TPR + TNR) / 2,
    NULL when only one class is present in ``y_true``)."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    n = tn + fp + fn + tp
    sup0, sup1 = tn + fp, fn + tp
    p1, r1 = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    p0, r0 = _ratio(tn, tn + fn), _ratio(tn, tn + fp)
    out = cm.select(
        "*",
        p0.alias("precision_0"), r0.alias("recall_0"), sup0.alias("support_0"),
        p1.alias("precision_1"), r1.alias("recall_1"), sup1.alias("support_1"),
        n.alias("test_samples"), _ratio(tp + tn, n).alias("accuracy"))
    out = out.withColumn("f1_0", _f1(F.col("precision_0"), F.col("recall_0"))) \
             .withColumn("f1_1", _f1(F.col("precision_1"), F.col("recall_1")))
    macro = lambda a, b: (F.col(a) + F.col(b)) / 2
    weighted = lambda a, b: _ratio(F.col(a) * F.col("support_0") + F.col(b) * F.col("support_1"),
                                   F.col("test_samples"))
    return out.select(
        "*",
        macro("precision_0", "precision_1").alias("precision"),
        macro("recall_0", "recall_1").alias("recall"),
        macro("f1_0", "f1_1").alias("f1_score"),
        weighted("precision_0", "precision_1").alias("weighted_precision"),
        weighted("recall_0", "recall_1").alias("weighted_recall"),
        weighted("f1_0", "f1_1").alias("weighted_f1"),
        F.when((F.col("support_0") > 0) & (F.col("support_1") > 0),
               (F.col("recall_0") + F.col("recall_1")) / 2).alias("roc_auc"))


def grouped_means(report: DataFrame) -> DataFrame:
    """A5 + A6: mean metrics by model type, by attack type, and overall, in one
    aggregation with grouping sets.  ``grouping`` says which rows are which."""
    keys = [F.col("model_type"), F.col("attack_type")]
    sets = report.groupingSets([[keys[0]], [keys[1]], []], *keys)
    means = sets.agg(*[F.avg(m).alias(m) for m in METRICS], F.count(F.lit(1)).alias("n_detectors"),
                     F.grouping("model_type").alias("_gm"), F.grouping("attack_type").alias("_ga"))
    which = F.when(F.col("_gm") == 0, "model_type").when(F.col("_ga") == 0, "attack_type").otherwise("overall")
    return means.select(which.alias("grouping"), F.coalesce("model_type", "attack_type", F.lit("all")).alias("group_value"),
                        *METRICS, "n_detectors")


def best_by_metric(report: DataFrame, order_col: str = "ordinal") -> DataFrame:
    """L4: best detector per metric, first (lowest ``order_col``) on ties."""
    best = report.agg(*[x for m in METRICS for x in (
        F.max_by(F.col("cluster_id"), F.struct(F.col(m), -F.col(order_col))).alias(f"best_{m}"), F.max(m).alias(f"max_{m}"))])
    rows = ", ".join(f"'{m}', best_{m}, max_{m}" for m in METRICS)
    return best.selectExpr(f"stack({len(METRICS)}, {rows}) AS (metric, cluster_id, value)")


def roc_auc_scores(scored: DataFrame, keys=("cluster_id",), score_col: str = "score") -> DataFrame:
    """A4 with scores: rank-sum AUC per detector, ties counted half, scores as they are.

    Rows are combined to one per (key, score) map side.  The negatives below a score
    come from the distributed order (``halo.with_running_total``), so no task holds a
    detector's scores, however many differ."""
    from .halo import with_running_total
    g = scored.groupBy(*keys, F.col(score_col).cast("double").alias(score_col)).agg(
        F.sum(F.col("y_true")).alias("pos"), F.sum(1 - F.col("y_true")).alias("neg"))
    below = with_running_total(g, [*keys, score_col], "neg", "_below")
    first = below.groupBy(*keys).agg(F.min("_below").alias("_first"))  # what earlier keys add up to
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    j = below.alias("a").join(first.alias("b"), on).select("a.*", "_first")
    agg = j.groupBy(*keys).agg(
        F.sum(F.col("pos") * (F.col("_below") - F.col("_first") + F.col("neg") / 2.0)).alias("u"),
        F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return agg.select(*keys, F.when((F.col("p") > 0) & (F.col("n") > 0),
                                    F.col("u") / (F.col("p") * F.col("n"))).alias("roc_auc"))
