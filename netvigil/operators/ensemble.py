"""Ensemble decision over detector votes.

Input shape: one row per flow with ``votes``: array<struct<ordinal, cluster_id,
attack_type, model_type, is_trained, error, prediction, confidence, ...>>,
the first field being ``ordinal``.  Each flow's decision depends only on its
own votes, so the decision is a per-row array expression evaluated in the JVM:
it adds no shuffle, and a hot source or destination cannot create a hot task.
Inputs in long form (one row per vote) are nested first with ``nest_votes`` --
one shuffle on ``flow_id`` whose groups are bounded by the number of
detectors.

The whole decision is ONE struct expression.  Intermediate arrays (valid
votes, class list, scores) are bound once with ``let`` -- a one-element
``transform`` whose lambda receives the value as a variable -- instead of
separate columns.  Catalyst inlines column aliases into pushed-down
filters; with separate columns a filter such as ``severity = 'Critical'``
would copy every intermediate many times into the predicate.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import EnsembleConfig
from ..functions.scalar import is_valid_vote, map_attack_type, severity

VOTE_FIELDS = ("ordinal", "cluster_id", "attack_type", "model_type", "is_trained",
               "error", "prediction", "confidence")
STRATEGIES = ("weighted_voting", "majority_voting", "highest_confidence")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` as a lambda variable.

    A ``transform`` of one element copies the result of ``body`` only; an ``aggregate``
    would copy ``value``, here mostly arrays of votes."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def nest_votes(long_votes: DataFrame, key: str = "flow_id", extra=()) -> DataFrame:
    """Long (flow, detector) rows -> one row per flow with a ``votes`` array.

    ``collect_list`` is combined map side, and a group holds one flow's votes
    (bounded by the number of detectors)."""
    fields = [c for c in VOTE_FIELDS if c in long_votes.columns]
    # One vote per (flow, detector) first: re-sent copies of a flow are merged
    # map side, so the collected group stays bounded by the detector count
    # even when one flow id is repeated a huge number of times.
    one = (long_votes.groupBy(key, *extra, "ordinal")
           .agg(F.max_by(F.struct(*fields), F.struct(*fields)).alias("v")))
    return one.groupBy(key, *extra).agg(F.sort_array(F.collect_list("v")).alias("votes"))


def _weight_of(cfg: EnsembleConfig):
    weights = cfg.normalized_weights()
    wmap = F.create_map(*[x for k, w in weights.items() for x in (F.lit(k), F.lit(float(w)))])
    return lambda v: F.coalesce(F.try_element_at(wmap, v["model_type"]), F.lit(float(cfg.default_weight)))


def _valid(votes: Column) -> Column:
    """P16, in ordinal order (native sort on the leading ``ordinal`` field)."""
    return F.sort_array(F.filter(votes, is_valid_vote))


def _conflicts(valid: Column, thr: float) -> Column:
    """E1-E3 for one flow -> array<struct<type, attack_type, classes>>.

    Linear in the votes: distinct (specialism, class) pairs are sorted natively
    and a specialism owning two adjacent pairs has a class conflict; "best
    confidence above the threshold" is "some vote above it".  Votes of one class
    have no class conflict, and their pairs are not formed.
    """
    pairs = F.sort_array(F.array_distinct(F.transform(valid, lambda v: F.struct(
        v["attack_type"].alias("attack_type"), v["prediction"].alias("prediction")))))

    def with_pairs(p: Column) -> Column:
        def with_types(t: Column) -> Column:
            n = F.size(t)
            dup = F.array_distinct(F.transform(
                F.filter(F.sequence(F.lit(2), F.greatest(n, F.lit(2))),
                         lambda i: (i <= n) & (F.element_at(t, i) == F.element_at(t, i - 1))),
                lambda i: F.element_at(t, i)))
            return F.transform(dup, lambda c: F.struct(
                F.lit("class_conflict").alias("type"), c.alias("attack_type"),
                F.transform(F.filter(p, lambda x: x["attack_type"] == c),
                            lambda x: x["prediction"]).alias("classes")))

        return let(F.transform(p, lambda x: x["attack_type"]), with_types)

    # each distinct value is looked for among the votes before it, so few distinct ones cost little
    several_classes = F.size(F.array_distinct(F.transform(valid, lambda v: v["prediction"]))) > 1
    class_conflicts = F.when(several_classes, let(pairs, with_pairs))
    high = F.sort_array(F.array_distinct(F.transform(
        F.filter(valid, lambda v: v["confidence"] > thr), lambda v: v["attack_type"])))
    type_conflicts = let(high, lambda h: F.when(F.size(h) > 1, F.array(F.struct(
        F.lit("attack_type_conflict").alias("type"), F.lit(None).cast("string").alias("attack_type"),
        h.alias("classes")))))
    return F.concat(F.coalesce(class_conflicts, F.array()), F.coalesce(type_conflicts, F.array()))


def _vote_weighted(valid: Column, cfg: EnsembleConfig, digits: int) -> Column:
    """score(class) = sum(w * conf) / sum(w); ties -> first class in the walk
    order (model-type groups in first-seen order, detectors by ordinal).
    -> struct<prediction, confidence, detail map<class, score>>"""
    weight = _weight_of(cfg)
    weighed = F.transform(valid, lambda v: F.struct(
        v["model_type"].alias("m"), v["prediction"].alias("c"), weight(v).alias("w"), v["confidence"].alias("conf")))

    def in_walk_order(ws: Column) -> Column:
        mt = F.array_distinct(F.transform(ws, lambda v: v["m"]))
        return F.flatten(F.transform(mt, lambda m: F.filter(ws, lambda v: v["m"] == m)))

    def on_walk(w: Column) -> Column:
        bound = F.struct(w.alias("walk"), F.array_distinct(F.transform(w, lambda v: v["c"])).alias("classes"),
                         F.aggregate(w, F.lit(0.0), lambda acc, v: acc + v["w"]).alias("total"))

        def on_classes(b: Column) -> Column:
            scores = F.transform(b["classes"], lambda c: F.round(F.try_divide(F.aggregate(
                b["walk"], F.lit(0.0), lambda acc, v: F.when(v["c"] == c, acc + v["w"] * v["conf"]).otherwise(acc)),
                b["total"]), digits))

            def on_scores(sc: Column) -> Column:
                best = F.array_max(sc)
                cl = b["classes"]
                return F.struct(F.try_element_at(cl, F.array_position(sc, best).cast("int")).alias("prediction"),
                                best.alias("confidence"),
                                F.map_from_arrays(cl, sc).alias("detail"))
            return let(scores, on_scores)
        return let(bound, on_classes)
    return let(let(weighed, in_walk_order), on_walk)


def _vote_majority(valid: Column) -> Column:
    """E5: most votes, ties -> first class seen in detector order; conf = votes / n."""
    classes = F.array_distinct(F.transform(valid, lambda v: v["prediction"]))

    def on_classes(cl: Column) -> Column:
        counts = F.transform(cl, lambda c: F.size(F.filter(valid, lambda v: v["prediction"] == c)))

        def on_counts(cn: Column) -> Column:
            best = F.array_max(cn)
            return F.struct(F.try_element_at(cl, F.array_position(cn, best).cast("int")).alias("prediction"),
                            F.try_divide(best.cast("double"), F.size(valid).cast("double")).alias("confidence"),
                            F.map_from_arrays(cl, F.transform(cn, lambda x: x.cast("double"))).alias("detail"))
        return let(counts, on_counts)
    return let(classes, on_classes)


def _vote_highest(valid: Column) -> Column:
    """Strictly highest confidence, first detector on ties; detail = best detector."""
    best = F.array_max(F.transform(valid, lambda v: F.struct(
        v["confidence"].alias("confidence"), (-v["ordinal"]).alias("neg_ord"),
        v["prediction"].alias("prediction"), v["cluster_id"].alias("cluster_id"))))
    return let(best, lambda b: F.struct(
        b["prediction"].alias("prediction"), b["confidence"].alias("confidence"),
        F.when(b["cluster_id"].isNotNull(), F.create_map(b["cluster_id"], b["confidence"])).alias("detail")))


def decision_expr(votes: Column, cfg: EnsembleConfig = EnsembleConfig(), strategy: str | None = None,
                  score_digits: int = 9) -> Column:
    """E8 for one flow as a single struct column:
    P16 -> E1-E3 -> E4/E5/E6 (E7 picks) -> P3, P14 -> P18 default."""
    strategy = strategy or cfg.strategy
    if strategy not in STRATEGIES:
        strategy = "weighted_voting"  # E7: unknown strategy -> weighted voting
    thr = float(cfg.confidence_threshold)

    def on_valid(valid: Column) -> Column:
        if strategy == "weighted_voting":
            vote = _vote_weighted(valid, cfg, score_digits)
        elif strategy == "majority_voting":
            vote = _vote_majority(valid)
        else:
            vote = _vote_highest(valid)
        has_valid = F.size(valid) > 0

        def on_parts(parts: Column) -> Column:
            conflicts, v = parts["conflicts"], parts["vote"]
            n_conf = F.when(has_valid, F.size(conflicts)).otherwise(F.lit(0))
            pred = F.when(has_valid, v["prediction"]).otherwise(F.lit("Unknown"))
            conf = F.when(has_valid, v["confidence"]).otherwise(F.lit(0.0))
            attack = F.when(has_valid, map_attack_type(v["prediction"], cfg.known_classes)).otherwise(F.lit("Unknown"))
            return F.struct(
                attack.alias("attack_type"), pred.alias("prediction"), conf.alias("confidence"),
                severity(attack, conf, n_conf).alias("severity"),
                F.when(has_valid, F.lit(strategy)).otherwise(F.lit("default")).alias("method"),
                n_conf.alias("conflicts_detected"), conflicts.alias("conflicts"),
                v["detail"].alias("detail"), F.size(valid).alias("n_valid"))

        return let(F.struct(_conflicts(valid, thr).alias("conflicts"), vote.alias("vote")), on_parts)

    return let(_valid(votes), on_valid)


DETAIL_NAME = {"weighted_voting": "class_scores", "majority_voting": "class_votes",
               "highest_confidence": "best_cluster"}


def decide(df: DataFrame, cfg: EnsembleConfig = EnsembleConfig(), strategy: str | None = None,
           score_digits: int = 9) -> DataFrame:
    """Adds attack_type, prediction, confidence, severity, method,
    conflicts_detected, conflicts and the strategy's detail column
    (class_scores map / class_votes map / best_cluster id)."""
    strategy = strategy or cfg.strategy
    if strategy not in STRATEGIES:
        strategy = "weighted_voting"
    # a generator of one row: filters on the decision stay above it and do not evaluate it a second time
    d = df.select("*", F.explode_outer(F.array(decision_expr(F.col("votes"), cfg, strategy, score_digits))).alias("_d"))
    detail = F.col("_d.detail")
    if strategy == "highest_confidence":
        detail = F.try_element_at(F.map_keys(detail), F.lit(1))
    return d.select(*[c for c in df.columns], *[F.col(f"_d.{c}").alias(c) for c in (
        "attack_type", "prediction", "confidence", "severity", "method", "conflicts_detected", "conflicts")],
        detail.alias(DETAIL_NAME[strategy]))


def with_conflicts(df: DataFrame, cfg: EnsembleConfig = EnsembleConfig()) -> DataFrame:
    """E1-E3 only: adds ``conflicts`` and ``conflicts_detected``."""
    c = df.withColumn("_c", _conflicts(_valid(F.col("votes")), float(cfg.confidence_threshold)))
    return c.select(*df.columns, F.col("_c").alias("conflicts"), F.size("_c").alias("conflicts_detected"))


def class_conflict_rows(df: DataFrame) -> DataFrame:
    """E1 as rows: (flow_id, attack_type, n_classes) for every specialism whose
    valid votes disagree.  Explodes the votes (map side) and aggregates per
    (flow, specialism); groups are bounded by the detector count."""
    v = df.select("flow_id", F.explode_outer(F.filter("votes", is_valid_vote)).alias("v"))
    return (v.groupBy("flow_id", F.col("v.attack_type").alias("attack_type"))
             .agg(F.count_distinct("v.prediction").alias("n_classes"))
             .filter(F.col("n_classes") > 1))


def attack_type_conflict_rows(df: DataFrame, cfg: EnsembleConfig = EnsembleConfig()) -> DataFrame:
    """E2 as rows: (flow_id, n_high_types) for flows with an attack-type conflict."""
    thr = float(cfg.confidence_threshold)
    v = df.select("flow_id", F.explode_outer(F.filter("votes", is_valid_vote)).alias("v"))
    per = v.groupBy("flow_id", F.col("v.attack_type").alias("attack_type")).agg(
        F.max("v.confidence").alias("mx"))
    f = per.groupBy("flow_id").agg(F.count(F.lit(1)).alias("n_types"),
                                   F.sum((F.col("mx") > thr).cast("int")).alias("n_high_types"))
    return f.filter((F.col("n_types") > 1) & (F.col("n_high_types") > 1)).select("flow_id", "n_high_types")


def _conflict_votes(df: DataFrame, *extra: str) -> DataFrame:
    v = df.select("flow_id", *extra, F.inline_outer(F.filter("votes", is_valid_vote)))
    return v.select("flow_id", *extra, "ordinal", "attack_type", "cluster_id", "prediction", "confidence")


def class_conflict_detail(df: DataFrame, *extra: str) -> DataFrame:
    """E1 with its evidence: (flow_id, attack_type, classes) where ``classes`` maps every
    class to the votes for it, {cluster_id, prediction, confidence} in detector order.

    Two groupings; a group is bounded by the number of detectors."""
    vote = F.struct("ordinal", "cluster_id", "prediction", "confidence")
    per = (_conflict_votes(df, *extra).groupBy("flow_id", *extra, "attack_type", "prediction")
           .agg(F.sort_array(F.collect_list(vote)).alias("votes")))
    votes = F.transform("votes", lambda v: v.dropFields("ordinal"))
    return (per.groupBy("flow_id", *extra, "attack_type")
            .agg(F.sort_array(F.collect_list(F.struct(F.col("prediction").alias("key"), votes.alias("value")))).alias("c"))
            .where(F.size("c") > 1)
            .select("flow_id", *extra, "attack_type", F.map_from_entries("c").alias("classes")))


def attack_type_conflict_detail(df: DataFrame, cfg: EnsembleConfig = EnsembleConfig(), *extra: str) -> DataFrame:
    """E2 with its evidence: (flow_id, types), one {attack_type, confidence, predictions} for
    every specialism whose best confidence is above the threshold, in detector order."""
    vote = F.struct("ordinal", "cluster_id", "prediction", "confidence")
    per = (_conflict_votes(df, *extra).groupBy("flow_id", *extra, "attack_type")
           .agg(F.sort_array(F.collect_list(vote)).alias("votes"), F.max("confidence").alias("confidence"), F.min("ordinal").alias("first")))
    votes = F.transform("votes", lambda v: v.dropFields("ordinal"))
    high = F.when(F.col("confidence") > float(cfg.confidence_threshold),
                  F.struct("first", "attack_type", "confidence", votes.alias("predictions")))
    return (per.groupBy("flow_id", *extra).agg(F.sort_array(F.collect_list(high)).alias("types"))
            .where(F.size("types") > 1)  # two high ones are two specialisms
            .select("flow_id", *extra, F.transform("types", lambda t: t.dropFields("first")).alias("types")))


def error_decision(df: DataFrame, message_col: str = "error") -> DataFrame:
    """Decision row for a record that could not be processed."""
    return df.select(
        *[c for c in df.columns if c != message_col],
        F.lit("Error").alias("attack_type"), F.lit("Error").alias("prediction"),
        F.lit(0.0).alias("confidence"), F.lit("High").alias("severity"),
        F.lit("error").alias("method"), F.lit(0).alias("conflicts_detected"),
        F.col(message_col).alias("error"))
