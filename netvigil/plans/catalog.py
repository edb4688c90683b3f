"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator.

Keys are the SURVEY operator id in lower case plus a short name.  Each query
reads the given parquet tables (through ``sources.derived``) so its work grows
with the data.  Computed columns carry the same aliases as the oracle SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ensemble
from ..sources import derived

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def pin_utc(spark: SparkSession) -> None:
    """Flow timestamps are UTC wall-clock (TIMESTAMP_NTZ in the tables); casts
    to TIMESTAMP for event-time windows and epochs must use UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def widen_integers(df: DataFrame) -> DataFrame:
    """Every integral result column as 64-bit (the oracle side does the same),
    so result schemas compare equal across engines."""
    narrow = {"tinyint", "smallint", "int"}
    if not any(f.dataType.simpleString() in narrow for f in df.schema.fields):
        return df
    return df.select(*[F.col(f.name).cast("long").alias(f.name) if f.dataType.simpleString() in narrow
                       else F.col(f.name) for f in df.schema.fields])


def query(key: str):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            pin_utc(spark)
            return widen_integers(fn(spark, sf_dir))
        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[key] = run
        return fn
    return deco


def decisions(spark: SparkSession, sf_dir: str, strategy: str = "weighted_voting") -> DataFrame:
    fv = derived.flows_with_votes(derived.load_flows(spark, sf_dir))
    d = ensemble.decide(fv, strategy=strategy)
    return d.withColumn("confidence", F.round("confidence", 6))


@query("e8_decision_summary")
def e8_decision_summary(spark, sf_dir):
    d = decisions(spark, sf_dir)
    return d.groupBy("attack_type", "severity").agg(
        F.count(F.lit(1)).alias("n_flows"),
        F.sum((F.col("conflicts_detected") > 0).cast("long")).alias("n_conflict_flows"),
        F.sum((F.col("method") == "default").cast("long")).alias("n_default"))


@query("e4_weighted_voting")
def e4_weighted_voting(spark, sf_dir):
    return decisions(spark, sf_dir).select(
        "flow_id", "attack_type", "prediction", "confidence", "severity", "method", "conflicts_detected")


# --- helpers ----------------------------------------------------------------

def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column (and turn -0.0 into 0.0) for engine-neutral output."""
    out = []
    for f in df.schema.fields:
        if f.dataType.typeName() in ("double", "float"):
            out.append((F.round(F.col(f.name), digits) + F.lit(0.0)).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def _flows(spark, sf_dir):
    return derived.load_flows(spark, sf_dir)


# Small blocks in the registered queries so every run crosses many halo
# boundaries; production callers keep the 1M-row default.
TEST_BLOCK_ROWS = 997


def _rolling(spark, sf_dir, feats, **kw):
    from ..operators.features import rolling_features
    kw.setdefault("block_rows", TEST_BLOCK_ROWS)
    return round_doubles(rolling_features(_flows(spark, sf_dir), features=feats, **kw))


# --- W: rolling features ----------------------------------------------------

@query("w1_packet_size_stats")
def w1_packet_size_stats(spark, sf_dir):
    return _rolling(spark, sf_dir, ("packet_size_mean", "packet_size_std", "packet_size_min", "packet_size_max"))


@query("w1_keyed_packet_size_stats")
def w1_keyed_packet_size_stats(spark, sf_dir):
    return _rolling(spark, sf_dir, ("packet_size_mean", "packet_size_std", "packet_size_min", "packet_size_max"),
                    key_cols=("src_ip",)).drop("src_ip")


@query("w0_keyed_halo_stats")
def w0_keyed_halo_stats(spark, sf_dir):
    return _rolling(spark, sf_dir, ("packet_size_mean", "packet_size_std", "unique_dst_ips"),
                    key_cols=("src_ip",), block_rows=101).drop("src_ip")


@query("w2_packet_size_median")
def w2_packet_size_median(spark, sf_dir):
    return _rolling(spark, sf_dir, ("packet_size_median",))


@query("w3_flow_duration_stats")
def w3_flow_duration_stats(spark, sf_dir):
    return _rolling(spark, sf_dir, ("flow_duration_mean", "flow_duration_std"))


@query("w4_distinct_counts")
def w4_distinct_counts(spark, sf_dir):
    return _rolling(spark, sf_dir, ("unique_src_ips", "unique_dst_ips", "unique_src_ports", "unique_dst_ports"))


@query("w5_high_port_ratio")
def w5_high_port_ratio(spark, sf_dir):
    return _rolling(spark, sf_dir, ("high_port_ratio",))


@query("w6_inter_arrival")
def w6_inter_arrival(spark, sf_dir):
    from ..functions.rolling import seconds_since_previous
    from ..operators import halo
    fr = halo.frame(_flows(spark, sf_dir), ["timestamp", "flow_id"], 2, (),
                    block_rows=TEST_BLOCK_ROWS)
    out = fr.df.select("flow_id", "_halo", "_blk",
                       seconds_since_previous("timestamp", fr.window).alias("inter_arrival"))
    return round_doubles(fr.finish(out))


@query("w7_packet_rate")
def w7_packet_rate(spark, sf_dir):
    return _rolling(spark, sf_dir, ("packet_rate", "packet_rate_std"))


@query("w10_ip_entropy")
def w10_ip_entropy(spark, sf_dir):
    return _rolling(spark, sf_dir, ("src_ip_entropy", "dst_ip_entropy"))


@query("w11_time_entropy")
def w11_time_entropy(spark, sf_dir):
    return _rolling(spark, sf_dir, ("hour_entropy", "day_entropy"))


@query("w12_w13_burstiness_regularity")
def w12_w13_burstiness_regularity(spark, sf_dir):
    return _rolling(spark, sf_dir, ("traffic_burstiness", "traffic_regularity"))


@query("w14_rolling_correlation")
def w14_rolling_correlation(spark, sf_dir):
    from ..operators.features import corr_names
    return _rolling(spark, sf_dir, tuple(corr_names()))


def _seq_string(col="sequence"):
    return F.array_join(F.transform(col, lambda x: x.cast("string")), ",")


@query("w8_sequences")
def w8_sequences(spark, sf_dir):
    from ..operators.features import sequences
    s = sequences(_flows(spark, sf_dir), "packet_size", 10, 1, label_col="label", block_rows=TEST_BLOCK_ROWS)
    return s.select("flow_id", "label", _seq_string().alias("sequence"))


@query("w8_strided_sequences")
def w8_strided_sequences(spark, sf_dir):
    from ..config import WINDOW_OVERLAP, WINDOW_SIZE
    from ..operators.features import sequences
    stride = max(1, int(WINDOW_SIZE * (1 - WINDOW_OVERLAP)))
    s = sequences(_flows(spark, sf_dir), "packet_size", WINDOW_SIZE, stride, label_col="label",
                  block_rows=TEST_BLOCK_ROWS)
    return s.select("flow_id", "label", _seq_string().alias("sequence"))


@query("w9_padded_sequences")
def w9_padded_sequences(spark, sf_dir):
    from ..operators.features import sequences
    s = sequences(_flows(spark, sf_dir), "packet_size", 10, 1, key_cols=("src_ip",), pad=True,
                  block_rows=TEST_BLOCK_ROWS)
    return s.select("flow_id", _seq_string().alias("sequence"))


# --- A1 / J2 / W15: fan-out and fan-in ---------------------------------------

@query("a1_fan_out")
def a1_fan_out(spark, sf_dir):
    from ..operators.features import fan_out
    return fan_out(_flows(spark, sf_dir))


@query("a1_fan_in")
def a1_fan_in(spark, sf_dir):
    from ..operators.features import fan_in
    return fan_in(_flows(spark, sf_dir))


@query("a1_fan_sketches")
def a1_fan_sketches(spark, sf_dir):
    """Fan-out from stored daily sketches, held against the exact counts."""
    from ..operators.features import fan_out, fan_sketches, merged_fan
    from ..sources.files import scratch_dir
    f, path = _flows(spark, sf_dir), scratch_dir(spark, "fan-sketches")
    fan_sketches(f).write.partitionBy("date").parquet(path)
    near = merged_fan(spark.read.parquet(path), out="estimate")
    close = F.abs(F.col("estimate") - F.col("fan_out")) <= 0.05 * F.col("fan_out") + 1
    return fan_out(f).join(near, "src_ip").select("src_ip", "fan_out", close.alias("within_5_percent"))


@query("j2_flow_fan")
def j2_flow_fan(spark, sf_dir):
    from ..operators.features import attach_fan
    return attach_fan(_flows(spark, sf_dir)).select("flow_id", "src_ip", "dst_ip", "fan_out", "fan_in")


@query("w15_rolling_fan_out")
def w15_rolling_fan_out(spark, sf_dir):
    from ..operators.features import fan_out, rolling_fan_mean
    return round_doubles(rolling_fan_mean(fan_out(_flows(spark, sf_dir)), "src_ip", "fan_out", block_rows=37))


@query("w15_rolling_fan_in")
def w15_rolling_fan_in(spark, sf_dir):
    from ..operators.features import fan_in, rolling_fan_mean
    return round_doubles(rolling_fan_mean(fan_in(_flows(spark, sf_dir)), "dst_ip", "fan_in", block_rows=37))


# --- E: ensemble variants -----------------------------------------------------

def _fv(spark, sf_dir, by_flow=False):
    return derived.flows_with_votes(_flows(spark, sf_dir), by_flow=by_flow)


def _decide(spark, sf_dir, **kw):
    d = ensemble.decide(_fv(spark, sf_dir), **kw)
    return d.withColumn("confidence", F.round("confidence", 6)).withColumnRenamed("timestamp", "ts")


DECISION_COLS = ("flow_id", "attack_type", "prediction", "confidence", "severity", "method", "conflicts_detected")


def _summary(d):
    return d.groupBy("attack_type", "severity").agg(
        F.count(F.lit(1)).alias("n_flows"),
        F.sum((F.col("conflicts_detected") > 0).cast("long")).alias("n_conflict_flows"),
        F.sum((F.col("method") == "default").cast("long")).alias("n_default"))


@query("e1_class_conflicts")
def e1_class_conflicts(spark, sf_dir):
    return ensemble.class_conflict_rows(_fv(spark, sf_dir, by_flow=True))


@query("e2_attack_type_conflicts")
def e2_attack_type_conflicts(spark, sf_dir):
    return ensemble.attack_type_conflict_rows(_fv(spark, sf_dir, by_flow=True))


def _votes_text(votes):
    """Votes as text, in detector order: cluster=confidence."""
    one = lambda v: F.concat(v["cluster_id"], F.lit("="), F.format_number(v["confidence"], 3))
    return F.array_join(F.transform(votes, one), ",")


@query("e1_conflict_detail")
def e1_conflict_detail(spark, sf_dir):
    """E1 with the votes of every class."""
    d = ensemble.class_conflict_detail(_fv(spark, sf_dir, by_flow=True))
    return d.select("flow_id", "attack_type", F.explode("classes").alias("prediction", "v")).select(
        "flow_id", "attack_type", "prediction", _votes_text("v").alias("votes"))


@query("e2_conflict_detail")
def e2_conflict_detail(spark, sf_dir):
    """E2 with the best confidence and the votes of every specialism above the threshold."""
    d = ensemble.attack_type_conflict_detail(_fv(spark, sf_dir, by_flow=True))
    return d.select("flow_id", F.inline("types")).select(
        "flow_id", "attack_type", F.round("confidence", 6).alias("confidence"), _votes_text("predictions").alias("votes"))


@query("e4_class_scores")
def e4_class_scores(spark, sf_dir):
    """The score of every class that a weighted vote weighed."""
    d = ensemble.decide(_fv(spark, sf_dir))
    return d.select("flow_id", F.explode("class_scores").alias("prediction", "s")).select("flow_id", "prediction", F.round("s", 6).alias("score"))


@query("e5_class_votes")
def e5_class_votes(spark, sf_dir):
    """The votes of every class that a majority vote counted."""
    d = ensemble.decide(_fv(spark, sf_dir), strategy="majority_voting")
    return d.select("flow_id", F.explode("class_votes").alias("prediction", "n")).select("flow_id", "prediction", F.col("n").cast("long").alias("n_votes"))


@query("e3_conflict_counts")
def e3_conflict_counts(spark, sf_dir):
    c = ensemble.with_conflicts(_fv(spark, sf_dir))
    n_class = F.size(F.filter("conflicts", lambda x: x["type"] == "class_conflict"))
    return c.select("flow_id", n_class.alias("n_class_conflicts"),
                    (F.col("conflicts_detected") - n_class).alias("n_attack_type_conflicts"),
                    "conflicts_detected")


@query("e5_majority_voting")
def e5_majority_voting(spark, sf_dir):
    return _decide(spark, sf_dir, strategy="majority_voting").select(*DECISION_COLS)


@query("e6_highest_confidence")
def e6_highest_confidence(spark, sf_dir):
    return _decide(spark, sf_dir, strategy="highest_confidence").select(*DECISION_COLS, "best_cluster")


@query("e7_unknown_strategy_fallback")
def e7_unknown_strategy_fallback(spark, sf_dir):
    d = _decide(spark, sf_dir, strategy="no_such_strategy")
    return d.groupBy("method", "severity").agg(F.count(F.lit(1)).alias("n_flows"))


@query("j4_weight_lookup_default")
def j4_weight_lookup_default(spark, sf_dir):
    from ..config import EnsembleConfig
    return _summary(_decide(spark, sf_dir, cfg=EnsembleConfig(weights={"lstm": 1.0})))


@query("p19_weight_normalization")
def p19_weight_normalization(spark, sf_dir):
    from ..config import EnsembleConfig
    return _summary(_decide(spark, sf_dir, cfg=EnsembleConfig(weights={"lstm": 3.0, "svm": 2.0})))


@query("p16_vote_validity")
def p16_vote_validity(spark, sf_dir):
    from ..functions.scalar import is_valid_vote
    v = derived.votes_long(_fv(spark, sf_dir))
    return v.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("n_votes"),
        F.sum(is_valid_vote(F.struct("is_trained", "confidence", "prediction", "error")).cast("long")).alias("n_valid"))


@query("p17_detector_defaults")
def p17_detector_defaults(spark, sf_dir):
    v = derived.votes_long(_fv(spark, sf_dir))
    return v.groupBy("cluster_id").agg(
        F.sum((F.col("prediction") == "Unknown").cast("long")).alias("n_untrained_default"),
        F.sum((F.col("prediction") == "Error").cast("long")).alias("n_error_rows"))


@query("p18_default_decisions")
def p18_default_decisions(spark, sf_dir):
    return _decide(spark, sf_dir).filter(F.col("method") == "default").select("flow_id", "attack_type", "severity")


@query("j3_flow_detector_pairs")
def j3_flow_detector_pairs(spark, sf_dir):
    v = derived.votes_long(_fv(spark, sf_dir))
    return v.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(F.col("is_trained").cast("long")).alias("n_trained"),
        F.round(F.sum("confidence"), 3).alias("sum_confidence"))


# --- A7-A16, L1-L3: monitoring -------------------------------------------------

def _votes(spark, sf_dir):
    return derived.votes_long(_fv(spark, sf_dir))


@query("a7_detector_status")
def a7_detector_status(spark, sf_dir):
    from ..operators.monitor import detector_status
    return round_doubles(detector_status(_votes(spark, sf_dir)))


@query("a8_attack_distribution")
def a8_attack_distribution(spark, sf_dir):
    from ..operators.monitor import attack_distribution
    return attack_distribution(_decide(spark, sf_dir))


@query("a9_severity_distribution")
def a9_severity_distribution(spark, sf_dir):
    from ..operators.monitor import severity_distribution
    return severity_distribution(_decide(spark, sf_dir))


@query("a10_prediction_counter")
def a10_prediction_counter(spark, sf_dir):
    from ..operators.monitor import prediction_counter
    return prediction_counter(_votes(spark, sf_dir))


@query("a10_conflict_counter")
def a10_conflict_counter(spark, sf_dir):
    from ..operators.monitor import conflict_counter
    return conflict_counter(ensemble.with_conflicts(_fv(spark, sf_dir)))


@query("a11_duration_histogram")
def a11_duration_histogram(spark, sf_dir):
    from ..operators.monitor import duration_histogram
    return duration_histogram(_votes(spark, sf_dir))


@query("a11_duration_summary")
def a11_duration_summary(spark, sf_dir):
    from ..operators.monitor import duration_summary
    return round_doubles(duration_summary(_votes(spark, sf_dir)), 3)


@query("a12_ensemble_status")
def a12_ensemble_status(spark, sf_dir):
    from ..operators.monitor import ensemble_status
    fv = _fv(spark, sf_dir)
    return round_doubles(ensemble_status(ensemble.decide(fv), derived.clusters_df(spark)))


@query("a13_health_check")
def a13_health_check(spark, sf_dir):
    from ..operators.monitor import health_check
    return health_check(derived.load_host_metrics(spark, sf_dir))


@query("a14_threshold_alerts")
def a14_threshold_alerts(spark, sf_dir):
    from ..operators.monitor import threshold_alerts
    return threshold_alerts(derived.load_host_metrics(spark, sf_dir)).drop("ts")


@query("a15_system_status")
def a15_system_status(spark, sf_dir):
    from ..operators.monitor import system_status
    return round_doubles(system_status(derived.clusters_df(spark), _votes(spark, sf_dir)))


@query("l1_recent_decisions")
def l1_recent_decisions(spark, sf_dir):
    from ..operators.monitor import latest
    recent = latest(_flows(spark, sf_dir).withColumn("ts", F.col("timestamp")), 100)  # then only these are decided
    recent = recent.withColumn("votes", derived.votes_column(F.col("flow_id")))
    d = ensemble.decide(recent).withColumn("confidence", F.round("confidence", 6))  # the place is read off the returned order
    return d.withColumn("position", F.monotonically_increasing_id() + 1).select(*DECISION_COLS, "position")


@query("l1_recent_conflicts")
def l1_recent_conflicts(spark, sf_dir):
    from ..operators.monitor import latest
    d = _decide(spark, sf_dir).filter(F.col("conflicts_detected") > 0)
    return latest(d, 50).select("flow_id", "conflicts_detected")


@query("l2_threat_list")
def l2_threat_list(spark, sf_dir):
    from ..operators.monitor import latest, threats
    recent = latest(_flows(spark, sf_dir).withColumn("ts", F.col("timestamp")), 100)
    d = ensemble.decide(recent.withColumn("votes", derived.votes_column(F.col("flow_id"))))
    return threats(d.withColumn("confidence", F.round("confidence", 6))).select(*DECISION_COLS)


@query("l3_history_retention")
def l3_history_retention(spark, sf_dir):
    from ..operators.monitor import retain
    return retain(_decide(spark, sf_dir)).select("flow_id", "severity")


@query("l3_history_by_date")
def l3_history_by_date(spark, sf_dir):
    """The stored history after a retention job that keeps the last 10 days and compacts them."""
    from datetime import timedelta

    from ..sources.files import append_history, scratch_dir
    from ..sources.history import retain_history
    d = _decide(spark, sf_dir).select("flow_id", "ts", "attack_type")
    path = scratch_dir(spark, "history-retained")
    for part in range(3):  # three appends: several files a day
        append_history(d.where(F.col("flow_id") % 3 == part), path)
    last = spark.read.parquet(path).agg(F.max("date")).first()[0]
    if last is None:
        return d.groupBy(F.to_date("ts").cast("string").alias("date")).agg(F.count(F.lit(1)).alias("n"))
    left = retain_history(spark, path, last - timedelta(days=9), most_files=2)
    return left.groupBy(F.col("date").cast("string").alias("date")).agg(F.count(F.lit(1)).alias("n"))


# --- A2-A6, L4: evaluation -------------------------------------------------------

def _report(spark, sf_dir):
    from ..operators.evaluate import classification_report, confusion
    ev = derived.eval_predictions(_fv(spark, sf_dir))
    return classification_report(confusion(ev, ("ordinal", "cluster_id", "attack_type", "model_type")))


@query("a2_confusion_matrix")
def a2_confusion_matrix(spark, sf_dir):
    from ..operators.evaluate import confusion
    return confusion(derived.eval_predictions(_fv(spark, sf_dir)))


@query("a3_classification_report")
def a3_classification_report(spark, sf_dir):
    r = _report(spark, sf_dir)
    return round_doubles(r.select(
        "cluster_id", "accuracy", "precision_0", "recall_0", "f1_0", "support_0",
        "precision_1", "recall_1", "f1_1", "support_1", "precision", "recall", "f1_score",
        "weighted_precision", "weighted_recall", "weighted_f1", "test_samples"))


@query("a4_roc_auc")
def a4_roc_auc(spark, sf_dir):
    return round_doubles(_report(spark, sf_dir).select("cluster_id", "roc_auc"))


@query("a6_grouped_means")
def a6_grouped_means(spark, sf_dir):
    from ..operators.evaluate import grouped_means
    return round_doubles(grouped_means(_report(spark, sf_dir)))


@query("a5_summary_means")
def a5_summary_means(spark, sf_dir):
    from ..operators.evaluate import METRICS
    r = _report(spark, sf_dir)
    return round_doubles(r.agg(*[F.avg(m).alias(f"overall_{m}") for m in METRICS]))


@query("l4_best_detectors")
def l4_best_detectors(spark, sf_dir):
    from ..operators.evaluate import best_by_metric
    return round_doubles(best_by_metric(_report(spark, sf_dir)))


# --- P / U / X / J5 / J6: preparation ---------------------------------------------

NUMERIC_FLOW_COLS = ("src_port", "dst_port", "packet_size", "flow_duration", "bytes_sent",
                     "bytes_received", "packets_sent", "packets_received")
SCALED_COLS = ("packet_size", "flow_duration", "bytes_sent", "src_port")


@query("p1_numeric_columns")
def p1_numeric_columns(spark, sf_dir):
    from ..operators.prep import split_columns
    num, _ = split_columns(_flows(spark, sf_dir))
    return round_doubles(_flows(spark, sf_dir).select(*num))


@query("u1_p2_union_datasets")
def u1_p2_union_datasets(spark, sf_dir):
    from ..operators.prep import union_datasets
    f = _flows(spark, sf_dir)
    a = f.filter(F.col("protocol") != "ICMP").withColumnRenamed("label", "Label")
    b = (f.filter(F.col("protocol") == "ICMP").drop("bytes_sent", "bytes_received")
          .withColumnRenamed("label", "category"))
    u = union_datasets({"cic_ids_2018": a, "bot_iot_2019": b})
    return u.groupBy("dataset", "label").agg(F.count(F.lit(1)).alias("n"),
                                             F.count("bytes_sent").alias("n_with_bytes"))


@query("p5_impute_zero")
def p5_impute_zero(spark, sf_dir):
    from ..operators.prep import impute_zero
    return round_doubles(impute_zero(_flows(spark, sf_dir)).select("flow_id", "flow_duration"))


@query("p6_timestamp_parse")
def p6_timestamp_parse(spark, sf_dir):
    from ..functions.scalar import parse_timestamp
    text = F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss")
    return _flows(spark, sf_dir).select(
        "flow_id", F.unix_seconds(parse_timestamp(text, "yyyy-MM-dd HH:mm:ss")).alias("parsed_epoch"))


@query("p7_hour_day_of_week")
def p7_hour_day_of_week(spark, sf_dir):
    from ..functions.scalar import day_of_week, hour_of_day
    return _flows(spark, sf_dir).select("flow_id", hour_of_day("timestamp").alias("hour"),
                                        day_of_week("timestamp").alias("day_of_week"))


@query("p8_protocol_onehot")
def p8_protocol_onehot(spark, sf_dir):
    from ..operators.prep import one_hot, vocabulary
    f = _flows(spark, sf_dir)
    vocab = vocabulary(f, "protocol")
    return one_hot(f.select("flow_id", "protocol"), "protocol", vocab).drop("protocol")


@query("p9_high_port_indicator")
def p9_high_port_indicator(spark, sf_dir):
    from ..functions.scalar import high_port
    return _flows(spark, sf_dir).select("flow_id", high_port("dst_port").cast("int").alias("high_port"))


@query("p10_ordinal_encoding")
def p10_ordinal_encoding(spark, sf_dir):
    from ..operators.prep import ordinal_codes
    f = _flows(spark, sf_dir).select("flow_id", "src_ip", "dst_ip", "protocol")
    for c in ("src_ip", "dst_ip", "protocol"):
        f = ordinal_codes(f, c)
    return f.select("flow_id", "src_ip_code", "dst_ip_code", "protocol_code")


@query("p11_label_encoding")
def p11_label_encoding(spark, sf_dir):
    from ..operators.prep import ordinal_codes
    return ordinal_codes(_flows(spark, sf_dir).select("flow_id", "label"), "label").select("flow_id", "label_code")


@query("p11_label_decoding")
def p11_label_decoding(spark, sf_dir):
    """Codes of a saved label encoder turned back into labels."""
    from ..operators.prep import apply_codes, decode_ordinal, ordinal_codes, save_codes
    from ..sources.files import scratch_dir
    f = _flows(spark, sf_dir).select("flow_id", "label")
    path = scratch_dir(spark, "label-codes")
    save_codes(ordinal_codes(f, "label"), "label", path)
    coded = apply_codes(spark, f, "label", path).select("flow_id", "label_code")
    return decode_ordinal(coded, spark.read.parquet(path), "label").select("flow_id", "label_code", "label")


@query("p12_minmax_scaling")
def p12_minmax_scaling(spark, sf_dir):
    from ..operators.prep import fit_minmax
    f = _flows(spark, sf_dir).select("flow_id", *SCALED_COLS)
    return round_doubles(fit_minmax(f, SCALED_COLS).transform(f))


@query("p13_standard_scaling")
def p13_standard_scaling(spark, sf_dir):
    from ..operators.prep import fit_standard
    f = _flows(spark, sf_dir).select("flow_id", *SCALED_COLS)
    return round_doubles(fit_standard(f, SCALED_COLS).transform(f))


@query("x1_exact_sample")
def x1_exact_sample(spark, sf_dir):
    from ..operators.prep import exact_sample
    return exact_sample(_flows(spark, sf_dir), 1000).select("flow_id", "label")


def _training_sets(spark, sf_dir):
    from ..config import TRAIN_BENIGN_CAP
    from ..operators.prep import training_sets
    return training_sets(_flows(spark, sf_dir), derived.clusters_df(spark), TRAIN_BENIGN_CAP)


@query("x2_undersample_counts")
def x2_undersample_counts(spark, sf_dir):
    t = _training_sets(spark, sf_dir)
    return t.groupBy("attack_type").agg(F.sum("y").cast("long").alias("n_attack"),
                                        F.sum(1 - F.col("y")).cast("long").alias("n_benign"))


@query("x3_training_sets")
def x3_training_sets(spark, sf_dir):
    return _training_sets(spark, sf_dir)


@query("x4_stratified_split")
def x4_stratified_split(spark, sf_dir):
    from ..operators.prep import stratified_split
    return stratified_split(_flows(spark, sf_dir).select("flow_id", "label")).select("flow_id", "label", "split")


@query("x4_split_sizes")
def x4_split_sizes(spark, sf_dir):
    s = x4_stratified_split(spark, sf_dir)
    return s.groupBy("label", "split").agg(F.count(F.lit(1)).alias("n"))


@query("x4_hash_split")
def x4_hash_split(spark, sf_dir):
    from ..operators.prep import hash_split
    return hash_split(_flows(spark, sf_dir).select("flow_id", "label"))


@query("x5_correlations_with_gaps")
def x5_correlations_with_gaps(spark, sf_dir):
    """Correlations of the raw flows: durations are missing, so every pair has rows of its own."""
    from ..operators.prep import correlation_pairs
    gaps = _flows(spark, sf_dir).withColumn("packet_size", F.when(F.col("flow_id") % 5 != 0, F.col("packet_size")))
    return round_doubles(correlation_pairs(gaps, NUMERIC_FLOW_COLS))


@query("x5_feature_correlations")
def x5_feature_correlations(spark, sf_dir):
    from ..operators.prep import correlation_pairs, impute_zero
    return round_doubles(correlation_pairs(impute_zero(_flows(spark, sf_dir)), NUMERIC_FLOW_COLS))


@query("x5_selected_features")
def x5_selected_features(spark, sf_dir):
    """Greedy correlated-feature removal over the extracted rolling features
    (missing values filled with 0 first, as the training path does).  The
    p x p matrix is one aggregation; only its p^2 numbers reach the driver."""
    from ..operators.features import ADVANCED, BASIC
    from ..operators.prep import correlation_pairs, correlated_to_drop
    feats = list(BASIC + ADVANCED)
    x = _rolling(spark, sf_dir, tuple(feats)).na.fill(0)
    pairs = correlation_pairs(x, feats)
    corr = {(r["feature_a"], r["feature_b"]): r["r"] for r in pairs.collect()}
    dropped = set(correlated_to_drop(corr, feats))
    return spark.createDataFrame([(f, f not in dropped) for f in feats], "feature string, kept boolean")


@query("x6_anova_f")
def x6_anova_f(spark, sf_dir):
    from ..operators.prep import anova_f, impute_zero, select_k_best
    f = anova_f(impute_zero(_flows(spark, sf_dir)), NUMERIC_FLOW_COLS)
    return select_k_best(f.withColumn("f_score", F.round("f_score", 4)))


@query("x6_contingency_scores")
def x6_contingency_scores(spark, sf_dir):
    """Chi-square and mutual information of ten quantile bins, of features that depend on the class and of one that does not."""
    from ..operators.prep import contingency_scores, impute_zero
    f = impute_zero(_flows(spark, sf_dir)).withColumn("class_bytes", F.col("bytes_sent") % 100 + F.length("label") * 20)
    return round_doubles(contingency_scores(f, NUMERIC_FLOW_COLS + ("class_bytes",)), 5)


@query("j5_detectors_with_data")
def j5_detectors_with_data(spark, sf_dir):
    from ..operators.prep import detectors_with_data
    return detectors_with_data(derived.clusters_df(spark), _flows(spark, sf_dir))


@query("j6_register_detectors")
def j6_register_detectors(spark, sf_dir):
    from ..operators.prep import register_detectors
    labels = _flows(spark, sf_dir).select(F.col("label").alias("attack_type")).distinct()
    cands = labels.select("attack_type", F.explode(F.array(F.lit("lstm"), F.lit("gbt"))).alias("model_type"))
    return register_detectors(derived.clusters_df(spark), cands)


# --- S: sources and sinks -----------------------------------------------------------

def _flows_csv(spark, sf_dir, extra_corrupt=False):
    from ..sources.files import read_flow_csv, scratch_dir, write_bytes, write_flow_csv
    out = scratch_dir(spark, "flows-csv")
    write_flow_csv(_flows(spark, sf_dir), f"{out}/good")
    if extra_corrupt:
        # an unreadable member of the dataset: gzip extension, not gzip content
        write_bytes(spark, f"{out}/good/zz-broken.csv.gz", b"this is not gzip data")
    return read_flow_csv(spark, f"{out}/good/*.csv*")


@query("s1_csv_scan")
def s1_csv_scan(spark, sf_dir):
    df = _flows_csv(spark, sf_dir)
    return round_doubles(df.withColumn("timestamp", F.unix_micros(F.col("timestamp"))))


@query("s1_header_union")
def s1_header_union(spark, sf_dir):
    """Flows written by three kinds of sensors: as declared, columns in reverse order, and without a duration but with the sensor's name."""
    from ..sources.files import read_flow_csv, scratch_dir, write_flow_csv
    out = scratch_dir(spark, "flows-by-header")
    f, kind = _flows(spark, sf_dir), F.col("flow_id") % 3
    write_flow_csv(f.where(kind == 0), f"{out}/declared")
    write_flow_csv(f.where(kind == 1).select(*reversed(f.columns)), f"{out}/reversed")
    write_flow_csv(f.where(kind == 2).drop("flow_duration").select(F.concat(F.lit("s"), (F.col("flow_id") % 7).cast("string")).alias("sensor"), "*"), f"{out}/named")
    df = read_flow_csv(spark, f"{out}/*/*.csv")
    return round_doubles(df.withColumn("timestamp", F.unix_micros(F.col("timestamp"))))


@query("s2_skipped_files")
def s2_skipped_files(spark, sf_dir):
    """Rows per label of what could be read, beside the files that could not."""
    from ..sources.files import header_index, read_flow_csv, scratch_dir, skipped_files, write_bytes, write_flow_csv
    out = scratch_dir(spark, "flows-broken")
    write_flow_csv(_flows(spark, sf_dir), f"{out}/good")
    write_bytes(spark, f"{out}/good/zy-empty.csv", b"")
    write_bytes(spark, f"{out}/good/zz-broken.csv.gz", b"this is not gzip data")
    index = header_index(spark, f"{out}/good/*.csv*")
    rows = read_flow_csv(spark, None, index=index).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    names = skipped_files(spark, index).select(F.element_at(F.split("path", "/"), -1).alias("file"))
    return rows.unionByName(names.groupBy(F.concat(F.lit("skipped "), "file").alias("label")).agg(F.count(F.lit(1)).alias("n")))


@query("s2_skip_unreadable_files")
def s2_skip_unreadable_files(spark, sf_dir):
    df = _flows_csv(spark, sf_dir, extra_corrupt=True)
    return df.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def _request_json(spark, sf_dir):
    """Flows rendered as request JSON: ICMP has no ports (fails the contract),
    UDP sensors send no timestamp (gets the ingest default)."""
    f = _flows(spark, sf_dir)
    port = lambda c: F.when(F.col("protocol") != "ICMP", F.col(c))
    body = F.struct(F.when(F.col("protocol") != "UDP", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
                    .alias("timestamp"), "src_ip", "dst_ip", port("src_port").alias("src_port"),
                    port("dst_port").alias("dst_port"), "protocol", "packet_size", "flow_duration")
    return f.select("flow_id", F.to_json(body).alias("value"))


@query("s4_contract_check")
def s4_contract_check(spark, sf_dir):
    from ..sources.files import validate_records
    good, bad = validate_records(_request_json(spark, sf_dir))
    return (good.select("flow_id", F.lit("valid").alias("status"))
                .unionByName(bad.select("flow_id", F.lit("quarantine").alias("status"))))


@query("s5_ingest_defaults")
def s5_ingest_defaults(spark, sf_dir):
    from ..sources.files import validate_records, with_ingest_defaults
    good, _ = validate_records(_request_json(spark, sf_dir))
    d = with_ingest_defaults(good.withColumn("defaulted", F.col("timestamp").isNull()))
    return d.select("flow_id", "defaulted", F.col("timestamp").isNotNull().alias("has_timestamp"),
                    (F.length("request_id") == 36).alias("has_request_id"))


@query("s6_batch_scoring_isolation")
def s6_batch_scoring_isolation(spark, sf_dir):
    from ..sources.files import validate_records
    good, bad = validate_records(_request_json(spark, sf_dir))
    scored = ensemble.decide(derived.flows_with_votes(good.select("flow_id")))
    errors = ensemble.error_decision(bad.select("flow_id", "error"))
    allrows = scored.select("flow_id", "method", "severity").unionByName(errors.select("flow_id", "method", "severity"))
    return allrows.groupBy("method", "severity").agg(F.count(F.lit(1)).alias("n_flows"))


@query("s8_scaler_roundtrip")
def s8_scaler_roundtrip(spark, sf_dir):
    from ..operators.prep import fit_minmax, load_scaler, save_scaler
    from ..sources.files import scratch_dir
    f = _flows(spark, sf_dir).select("flow_id", *SCALED_COLS)
    path = scratch_dir(spark, "scaler")
    save_scaler(spark, fit_minmax(f, SCALED_COLS), path)
    return round_doubles(load_scaler(spark, path).transform(f))


@query("s8_feature_pipeline")
def s8_feature_pipeline(spark, sf_dir):
    """(flow_id, label_code, feature, value) from the feature pipeline fitted on the flows, saved and loaded
    again; the windows run over automatically sized blocks."""
    from pyspark.ml import PipelineModel

    from ..operators import feature_pipeline as fp
    from ..sources.files import scratch_dir
    flows = _flows(spark, sf_dir)
    path = scratch_dir(spark, "feature-pipeline")
    fp.fit_pipeline(flows, [fp.EncodeValues(column="label"), *fp.flow_stages()]).write().overwrite().save(path)
    model = PipelineModel.load(path)
    kept = fp.scaling_of(model).get("columns")
    wide = ", ".join(f"'{c}', {c}{fp.SUFFIX}" for c in kept)
    out = model.transform(flows).selectExpr("flow_id", "label_code", f"stack({len(kept)}, {wide}) AS (feature, value)")
    return out.withColumn("value", F.round("value", 4))


@query("s10_history_append")
def s10_history_append(spark, sf_dir):
    from ..sources.files import append_history, scratch_dir
    d = _decide(spark, sf_dir).select("flow_id", "ts", "attack_type", "severity")
    path = scratch_dir(spark, "history")
    hot = F.col("severity").isin("Critical", "High")
    append_history(d.filter(hot), path)
    append_history(d.filter(~hot), path)
    h = spark.read.parquet(path)
    return h.groupBy(F.col("date").cast("string").alias("date"), "severity").agg(F.count(F.lit(1)).alias("n"))


@query("s8_selection_roundtrip")
def s8_selection_roundtrip(spark, sf_dir):
    """The features that a saved and reloaded selector keeps (k = 5), as columns of the flows."""
    from ..operators.prep import anova_f, impute_zero, load_selection, save_selection, select_k_best
    from ..sources.files import scratch_dir
    f = impute_zero(_flows(spark, sf_dir))
    path = scratch_dir(spark, "selection")
    save_selection(select_k_best(anova_f(f, NUMERIC_FLOW_COLS).withColumn("f_score", F.round("f_score", 4)), 5), path)
    kept = load_selection(spark, path)
    return spark.read.parquet(path).where("selected").join(
        f.agg(*[F.sum(F.col(c).cast("double")).alias(c) for c in kept])
         .selectExpr(f"stack({len(kept)}, " + ", ".join(f"'{c}', {c}" for c in kept) + ") AS (feature, total)"), "feature"
    ).select("feature", "rank", F.round("total", 3).alias("total"))


@query("s10_conflict_history")
def s10_conflict_history(spark, sf_dir):
    """Conflicts of both kinds appended to a history by date."""
    from ..sources.files import append_history, scratch_dir
    fv = _fv(spark, sf_dir, by_flow=True)
    path = scratch_dir(spark, "conflicts")
    append_history(ensemble.class_conflict_detail(fv, "timestamp").select("flow_id", "timestamp", F.lit("class_conflict").alias("type")), path, "timestamp")
    append_history(ensemble.attack_type_conflict_detail(fv, ensemble.EnsembleConfig(), "timestamp")
                   .select("flow_id", "timestamp", F.lit("attack_type_conflict").alias("type")), path, "timestamp")
    h = spark.read.parquet(path)
    return h.groupBy(F.col("date").cast("string").alias("date"), "type").agg(F.count(F.lit(1)).alias("n"))


@query("s3_dataset_registry")
def s3_dataset_registry(spark, sf_dir):
    """Registered datasets with the rows of the flows that each one's attack types cover."""
    from ..sources.files import datasets_df
    per = _flows(spark, sf_dir).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    d = datasets_df(spark).select("name", "label_column", F.explode("attack_types").alias("label"))
    return d.join(per, "label", "left").groupBy("name", "label_column").agg(
        F.count(F.lit(1)).alias("n_attack_types"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"))


# --- M: detectors (rows-only: model weights are not SQL-expressible) -----------------

_TRAINED = {}


def _trained(spark, sf_dir):
    """Train once per (application, data set) and reuse across the M queries."""
    from ..operators.detectors import train_all
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _TRAINED:
        for old in [k for k in _TRAINED if k[0] != key[0]]:
            del _TRAINED[old]
        _TRAINED[key] = train_all(spark, _flows(spark, sf_dir))
    return _TRAINED[key]


@query("m3_train_all_detectors")
def m3_train_all_detectors(spark, sf_dir):
    rows = _trained(spark, sf_dir).result.rows
    return spark.createDataFrame(rows, "ordinal int, cluster_id string, attack_type string, model_type string, "
                                       "status string, n_train long, n_test long, error string")


@query("m2_early_stopping")
def m2_early_stopping(spark, sf_dir):
    """Validation loss of each sequence detector by iterations, and the round whose weights it keeps."""
    seen = _trained(spark, sf_dir).result.history
    rows = [(cid, done, float(loss), loss == min(x for _, x in h)) for cid, h in sorted(seen.items()) for done, loss in h]
    return round_doubles(spark.createDataFrame(rows, "cluster_id string, iterations int, validation_loss double, lowest boolean"))


def _scored_flows(spark, sf_dir):
    """The columns of the flows that scoring reads (their windows move and keep no others)."""
    from ..operators.detectors import FEATURE_COLS
    return _flows(spark, sf_dir).select("flow_id", "timestamp", "src_ip", "label", *FEATURE_COLS)


@query("m4_score_flows")
def m4_score_flows(spark, sf_dir):
    from ..operators.detectors import score_votes
    t = _trained(spark, sf_dir)
    d = ensemble.decide(score_votes(t.features, t.result, _scored_flows(spark, sf_dir)))
    return d.groupBy("label", "attack_type", "severity").agg(F.count(F.lit(1)).alias("n_flows"))


@query("p21_class_probabilities")
def p21_class_probabilities(spark, sf_dir):
    """Per detector: flows scored, whether every map sums to one, and how many favour the attack."""
    from ..operators.detectors import score_votes
    t = _trained(spark, sf_dir)
    p = score_votes(t.features, t.result, _scored_flows(spark, sf_dir)).select(F.explode("class_probabilities").alias("cluster_id", "p"))
    total = F.aggregate(F.map_values("p"), F.lit(0.0), lambda acc, x: acc + x)
    return p.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n_flows"), F.max(F.size("p")).alias("n_classes"),
                                       F.bool_and((F.size("p") == 1) | (F.abs(total - 1.0) < 1e-9)).alias("sums_to_one"))


@query("m5_retrain_detectors")
def m5_retrain_detectors(spark, sf_dir):
    """The DoS detectors refitted on the validation rows: test accuracy before and after."""
    from ..operators.detectors import Training, evaluate_all, retrain
    t = _trained(spark, sf_dir)
    new = t.held_out.where("split = 'val' and label in ('DoS', 'Benign')").withColumn("y", (F.col("label") == "DoS").cast("int"))
    again = retrain(retrain(t.result, "DoS_svm", new), "DoS_lstm", new)
    parts = [evaluate_all(Training(t.features, t.fit, t.held_out, r)).where("attack_type = 'DoS'").groupBy("cluster_id")
             .agg(F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias(name), F.count(F.lit(1)).alias(f"n_{name}"))
             for name, r in (("before", t.result), ("after", again))]
    return round_doubles(parts[0].join(parts[1], "cluster_id").select("cluster_id", "before", "after", F.col("n_after").alias("test_samples")))


@query("m6_evaluate_detectors")
def m6_evaluate_detectors(spark, sf_dir):
    from ..operators.detectors import evaluate_all
    from ..operators.evaluate import classification_report, confusion, roc_auc_scores
    ev = evaluate_all(_trained(spark, sf_dir))
    rep = classification_report(confusion(ev, ("ordinal", "cluster_id", "attack_type", "model_type")))
    auc = roc_auc_scores(ev).withColumnRenamed("roc_auc", "roc_auc_scores")
    return round_doubles(rep.join(auc, "cluster_id").select("cluster_id", "accuracy", "precision", "recall", "f1_score", "roc_auc",
                                                            "roc_auc_scores", "test_samples"))


@query("s6_score_records")
def s6_score_records(spark, sf_dir):
    """JSON records through the contract, the shared features and the fitted detectors."""
    from ..operators.detectors import score_records
    t = _trained(spark, sf_dir)
    d = score_records(_request_json(spark, sf_dir), t.features, t.result)
    return d.groupBy("method", "attack_type", "severity").agg(F.count(F.lit(1)).alias("n_flows"), F.count("error").alias("n_errors"))


@query("s9_detector_roundtrip")
def s9_detector_roundtrip(spark, sf_dir):
    """Decisions of saved and reloaded detectors."""
    from ..operators.detectors import load_detectors, save_detectors, score_votes
    from ..sources.files import scratch_dir
    path = scratch_dir(spark, "detectors")
    save_detectors(spark, _trained(spark, sf_dir), path)
    fs, res = load_detectors(spark, path)
    d = ensemble.decide(score_votes(fs, res, _scored_flows(spark, sf_dir)))
    return d.groupBy("label", "attack_type", "severity").agg(F.count(F.lit(1)).alias("n_flows"))


@query("s9_model_versions")
def s9_model_versions(spark, sf_dir):
    """Versions of the stored detectors after one of them is retrained on the flows."""
    from ..operators.model_store import ModelStore
    from ..sources.files import scratch_dir
    store, t = ModelStore(spark, scratch_dir(spark, "model-store")), _trained(spark, sf_dir)
    store.save(t)
    some = next((r[1] for r in t.result.rows if r[4] == "trained" and r[3] == "lstm"), None)
    if some is not None:
        store.retrain(some, _scored_flows(spark, sf_dir))
    return store.versions()


@query("p21_calibration")
def p21_calibration(spark, sf_dir):
    """Log-loss of each detector on the test rows, with its calibrated probabilities and with the plain logistic."""
    from ..operators.detectors import Training, TrainResult, evaluate_all
    t = _trained(spark, sf_dir)
    p = F.least(F.lit(1 - 1e-9), F.greatest(F.lit(1e-9), F.col("score")))
    loss = F.avg(-F.when(F.col("y_true") == 1, F.log(p)).otherwise(F.log(1 - p)))
    plain = Training(t.features, t.fit, t.held_out, TrainResult(t.result.models, t.result.rows))
    return round_doubles(evaluate_all(t).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"), loss.alias("log_loss")).join(
        evaluate_all(plain).groupBy("cluster_id").agg(loss.alias("plain_log_loss")), "cluster_id"))


@query("t1_stream_detectors")
def t1_stream_detectors(spark, sf_dir):
    """Fitted detectors over a stream of events, summed like m4_score_flows."""
    from ..sources.files import scratch_dir
    from ..streaming.keyed import run_detectors
    t, base = _trained(spark, sf_dir), scratch_dir(spark, "t1d")
    run_detectors(_stream_flows(spark, sf_dir), t.features, t.result, f"{base}/out", f"{base}/ckpt")
    d = spark.read.parquet(f"{base}/out")
    return d.groupBy("attack_type", "severity").agg(F.count(F.lit(1)).alias("n_flows"))


# --- T: streaming (availableNow streams into a sink)  ------------

def _stream_flows(spark, sf_dir):
    from ..streaming.stream import event_stream, flow_stream
    # a glob, not a file path: the file source watches a directory pattern
    return flow_stream(event_stream(spark, f"{sf_dir.rstrip('/')}/events*.parquet"))


@query("t1_stream_scoring")
def t1_stream_scoring(spark, sf_dir):
    from ..sources.files import scratch_dir
    from ..streaming.stream import run_available, score_stream
    base = scratch_dir(spark, "t1")
    run_available(score_stream(_stream_flows(spark, sf_dir)), f"{base}/out", f"{base}/ckpt")
    return _summary(spark.read.parquet(f"{base}/out"))


def _rolling_stream(spark, sf_dir):
    from ..sources.files import scratch_dir
    from ..streaming.stream import rolling_state, run_available
    base = scratch_dir(spark, "t2")
    run_available(rolling_state(_stream_flows(spark, sf_dir)), f"{base}/out", f"{base}/ckpt")
    return spark.read.parquet(f"{base}/out")


@query("t2_stream_rolling_state")
def t2_stream_rolling_state(spark, sf_dir):
    return round_doubles(_rolling_stream(spark, sf_dir).select("flow_id", "packet_size_mean", "packet_size_std"))


@query("t2_stream_rolling_features")
def t2_stream_rolling_features(spark, sf_dir):
    return round_doubles(_rolling_stream(spark, sf_dir).drop("src_ip", "packet_size_mean", "packet_size_std"))


@query("t2_stream_all_features")
def t2_stream_all_features(spark, sf_dir):
    """All rolling features per source from the state store."""
    from ..sources.files import scratch_dir
    from ..streaming.keyed import rolling_stream, run_available
    base = scratch_dir(spark, "t2-all")
    run_available(rolling_stream(_stream_flows(spark, sf_dir)), f"{base}/out", f"{base}/ckpt")
    return round_doubles(spark.read.parquet(f"{base}/out").drop("src_ip"))


def _request_stream_run(spark, sf_dir):
    """Request records through the contract and the fitted detectors as a stream: the folder of both sinks."""
    from ..sources.files import scratch_dir
    from ..streaming.keyed import run_requests
    t, base = _trained(spark, sf_dir), scratch_dir(spark, "t1-requests")
    _request_json(spark, sf_dir).write.parquet(f"{base}/in")
    raw = spark.readStream.schema("flow_id long, value string").parquet(f"{base}/in")
    run_requests(raw, t.features, t.result, base, f"{base}/ckpt")
    return base


@query("t1_stream_requests")
def t1_stream_requests(spark, sf_dir):
    """Which sink each request record reached, and what the quarantine says."""
    base = _request_stream_run(spark, sf_dir)
    good = spark.read.parquet(f"{base}/decisions").select("flow_id", F.lit("decided").alias("status"), F.lit(None).cast("string").alias("error"))
    return good.unionByName(spark.read.parquet(f"{base}/quarantine").select("flow_id", F.lit("quarantined").alias("status"), "error"))


def _stream_result(spark, df, keys, name):
    """The final state of a stream in update mode."""
    from ..sources.files import scratch_dir
    from ..streaming.stream import latest_updates, run_updates
    base = scratch_dir(spark, name)
    run_updates(df, f"{base}/out", f"{base}/ckpt")
    return latest_updates(spark, f"{base}/out", keys)


@query("t3_tumbling_counts")
def t3_tumbling_counts(spark, sf_dir):
    from ..streaming.stream import tumbling_counts, window_seconds
    d = ensemble.decide(derived.flows_with_votes(_stream_flows(spark, sf_dir)))
    return _stream_result(spark, tumbling_counts(d), ("w", "attack_type", "severity"), "t3").select(
        *window_seconds(), "attack_type", "severity", "n")


@query("t3_conflict_counts")
def t3_conflict_counts(spark, sf_dir):
    from ..streaming.stream import conflict_counts, window_seconds
    c = conflict_counts(derived.flows_with_votes(_stream_flows(spark, sf_dir)))
    return _stream_result(spark, c, ("w", "conflict_type"), "t3c").select(*window_seconds(), "conflict_type", "n")


@query("t4_sliding_windows")
def t4_sliding_windows(spark, sf_dir):
    from ..streaming.stream import sliding_counts, window_seconds
    return _stream_result(spark, sliding_counts(_stream_flows(spark, sf_dir)), ("w", "protocol"), "t4").select(
        *window_seconds(), "protocol", "n")


@query("t5_health_windows")
def t5_health_windows(spark, sf_dir):
    from ..streaming.stream import event_stream, health_windows, window_seconds
    s = derived.host_metrics_from_events(event_stream(spark, f"{sf_dir.rstrip('/')}/events*.parquet"))
    out = health_windows(s.withColumn("ts", F.col("ts").cast("timestamp")))
    return _stream_result(spark, out, ("w", "host"), "t5").select(
        *window_seconds(), "host", "cpu_usage", "memory_usage", "disk_usage", "status", "issues")


@query("t5_alerts")
def t5_alerts(spark, sf_dir):
    """Alerts that open and close over the check intervals that the watermark has passed."""
    from ..sources.files import scratch_dir
    from ..streaming.keyed import alert_stream, run_available
    from ..streaming.stream import event_stream
    s = derived.host_metrics_from_events(event_stream(spark, f"{sf_dir.rstrip('/')}/events*.parquet"))
    base = scratch_dir(spark, "t5-alerts")
    run_available(alert_stream(s.withColumn("ts", F.col("ts").cast("timestamp"))), f"{base}/out", f"{base}/ckpt")
    return spark.read.parquet(f"{base}/out")


@query("t6_running_stats")
def t6_running_stats(spark, sf_dir):
    from ..streaming.stream import running_stats
    votes = derived.votes_long(derived.flows_with_votes(_stream_flows(spark, sf_dir)))
    return round_doubles(_stream_result(spark, running_stats(votes), ("cluster_id",), "t6"))


@query("t7_dedup_within_watermark")
def t7_dedup_within_watermark(spark, sf_dir):
    from ..sources.files import scratch_dir
    from ..streaming.stream import dedup, run_available
    f = _stream_flows(spark, sf_dir).select("flow_id", "protocol", "ts")
    resent = _stream_flows(spark, sf_dir).select("flow_id", "protocol", "ts").filter(F.col("protocol") == "UDP")  # UDP senders retransmit
    base = scratch_dir(spark, "t7")
    run_available(dedup(f.unionByName(resent)), f"{base}/out", f"{base}/ckpt")
    return spark.read.parquet(f"{base}/out").select("flow_id", "protocol")


# --- remaining inventory items -------------------------------------------------------

@query("p3_attack_type_map")
def p3_attack_type_map(spark, sf_dir):
    from ..functions.scalar import map_attack_type
    v = _votes(spark, sf_dir)
    return v.groupBy("prediction", map_attack_type("prediction").alias("attack_type")).agg(
        F.count(F.lit(1)).alias("n"))


@query("p20_decision_metadata")
def p20_decision_metadata(spark, sf_dir):
    from ..functions.scalar import flow_metadata
    d = ensemble.decide(_fv(spark, sf_dir)).withColumn("metadata", flow_metadata())
    return d.select("flow_id", "severity", F.unix_micros(F.col("metadata.timestamp").cast("timestamp")).alias("meta_ts"),
                    F.col("metadata.src_ip").alias("meta_src_ip"), F.col("metadata.dst_ip").alias("meta_dst_ip"),
                    F.col("metadata.protocol").alias("meta_protocol"))


@query("a16_dataset_statistics")
def a16_dataset_statistics(spark, sf_dir):
    s = x4_stratified_split(spark, sf_dir)
    total = _flows(spark, sf_dir).count()
    return s.groupBy("label").agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.round(F.count(F.lit(1)) / F.lit(float(total)), 6).alias("share"),
        *[F.sum((F.col("split") == x).cast("long")).alias(f"n_{x}") for x in ("train", "val", "test")])


@query("a16_dataset_summary")
def a16_dataset_summary(spark, sf_dir):
    """Samples, numeric features and classes of the flows."""
    from ..operators.prep import split_columns
    f = _flows(spark, sf_dir)
    numeric, _ = split_columns(f)
    return f.agg(F.count(F.lit(1)).alias("n_samples"), F.lit(len([c for c in numeric if c != "flow_id"])).alias("n_features"),
                 F.array_join(F.sort_array(F.collect_set("label")), ",").alias("classes"))


@query("s7_json_results")
def s7_json_results(spark, sf_dir):
    from ..sources.files import scratch_dir, write_json
    r = _report(spark, sf_dir).withColumn("confusion_matrix", F.array(F.array("tn", "fp"), F.array("fn", "tp")))
    path = scratch_dir(spark, "eval-json")
    write_json(r.select("cluster_id", "accuracy", "f1_score", "test_samples", "confusion_matrix"), path)
    back = spark.read.schema("cluster_id string, accuracy double, f1_score double, test_samples long, "
                             "confusion_matrix array<array<long>>").json(path)
    return round_doubles(back.select("cluster_id", "accuracy", "f1_score", "test_samples",
                                     F.col("confusion_matrix")[1][1].alias("tp")))


@query("j1_feature_row")
def j1_feature_row(spark, sf_dir):
    from ..operators.features import ADVANCED, BASIC, corr_names
    return _rolling(spark, sf_dir, BASIC + ADVANCED + tuple(corr_names()))
