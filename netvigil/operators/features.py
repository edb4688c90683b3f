"""Traffic features.

``rolling_features`` evaluates every rolling feature in one pass over one
window specification (one Window operator, no recomputation of shared
aggregates).  The frame is the last N rows in (timestamp, flow_id) order,
either over the whole stream (``key_cols=()``, the reference's semantics) or
per key (e.g. per ``src_ip``).  All frames use halo blocks (``operators.halo``),
so no task ever holds more than a block.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import WINDOW_SIZE
from ..functions import rolling as R
from ..functions.scalar import day_of_week, high_port, hour_of_day
from . import halo

ORDER = ("timestamp", "flow_id")
# Numeric request columns whose pairwise rolling correlation is a feature
# (hour and day_of_week are present because the time features add them).
CORR_COLUMNS = ("src_port", "dst_port", "packet_size", "flow_duration", "hour", "day_of_week")

BASIC = ("packet_size_mean", "packet_size_std", "packet_size_min", "packet_size_max",
         "packet_size_median", "flow_duration_mean", "flow_duration_std", "unique_src_ips",
         "unique_dst_ips", "unique_src_ports", "unique_dst_ports", "high_port_ratio",
         "packet_rate", "packet_rate_std")
ADVANCED = ("src_ip_entropy", "dst_ip_entropy", "traffic_burstiness", "traffic_regularity",
            "hour_entropy", "day_entropy")


def corr_names(cols=CORR_COLUMNS):
    return [f"corr_{a}_{b}" for a, b in combinations(cols, 2)]


_AGGREGATES = {
    "count": F.count, "mean": F.avg, "sd": F.stddev_samp, "sd_pop": F.stddev_pop, "min": F.min, "max": F.max,
    "median": lambda c: F.percentile(F.col(c), F.lit(0.5)), "values": F.collect_list, "covar": F.covar_pop,
}


class FrameAggregates:
    """Aggregates over one frame, each computed once however many features read it.

    Calling it names an aggregate and returns the column that will hold it; the
    features are formulas in the projection above the Window node.  (Spark does not
    share equal window expressions by itself.)"""

    def __init__(self, w):
        self.w, self.columns = w, {}

    def __call__(self, kind: str, *cols: str):
        name = "_".join(("_agg", kind, *cols))
        self.columns[name] = _AGGREGATES[kind](*cols).over(self.w).alias(name)
        return F.col(name)

    def full(self, cols, n: int):
        """True where none of ``cols`` has a NULL among the ``n`` rows of a full frame."""
        cond = F.lit(True)
        for c in cols:
            cond = cond & (self("count", c) == n)
        return cond


def _distinct(col):
    return lambda at: F.size(F.array_distinct(at("values", col)))


def _entropy(col):
    return lambda at: R.entropy_of(at("values", col))


def _plain(kind, col):
    return lambda at: at(kind, col)


def _correlation(a, b):
    return lambda at: F.try_divide(at("covar", a, b), at("sd_pop", a) * at("sd_pop", b))


#: Feature -> (the columns it reads, its formula over the frame's aggregates).
FORMULAS = {
    "packet_size_mean": (("packet_size",), _plain("mean", "packet_size")),
    "packet_size_std": (("packet_size",), _plain("sd", "packet_size")),
    "packet_size_min": (("packet_size",), _plain("min", "packet_size")),
    "packet_size_max": (("packet_size",), _plain("max", "packet_size")),
    "packet_size_median": (("packet_size",), _plain("median", "packet_size")),
    "flow_duration_mean": (("flow_duration",), _plain("mean", "flow_duration")),
    "flow_duration_std": (("flow_duration",), _plain("sd", "flow_duration")),
    "unique_src_ips": (("src_ip",), _distinct("src_ip")),
    "unique_dst_ips": (("dst_ip",), _distinct("dst_ip")),
    "unique_src_ports": (("src_port",), _distinct("src_port")),
    "unique_dst_ports": (("dst_port",), _distinct("dst_port")),
    "high_port_ratio": (("_high_port",), _plain("mean", "_high_port")),
    "packet_rate": (("_dt",), lambda at: F.try_divide(F.lit(1.0), at("mean", "_dt"))),
    "packet_rate_std": (("_dt",), lambda at: F.try_divide(F.lit(1.0), at("sd", "_dt"))),
    "src_ip_entropy": (("src_ip",), _entropy("src_ip")),
    "dst_ip_entropy": (("dst_ip",), _entropy("dst_ip")),
    "traffic_burstiness": (("packet_size",), lambda at: F.try_divide(at("sd", "packet_size"), at("mean", "packet_size"))),
    "traffic_regularity": (("packet_size",), lambda at: 1.0 / (1.0 + at("sd", "packet_size"))),
    "hour_entropy": (("hour",), _entropy("hour")),
    "day_entropy": (("day_of_week",), _entropy("day_of_week")),
    **{f"corr_{a}_{b}": ((a, b), _correlation(a, b)) for a, b in combinations(CORR_COLUMNS, 2)},
}


def input_columns(features) -> list:
    """Columns the requested features read (the halo numbering holds its input,
    so it is pruned before, not after); ``_dt`` is made from the timestamp."""
    return sorted({c for f in features for c in FORMULAS[f][0]} - {"_dt"})


def rolling_features(flows: DataFrame, features=BASIC + ADVANCED, n: int = WINDOW_SIZE,
                     key_cols=(), block_rows: int | None = None,
                     keep=("flow_id",), num_partitions: int | None = None) -> DataFrame:
    """Rolling features per flow (last ``n`` rows, pandas min_periods = n)."""
    inputs = {c for f in features for c in FORMULAS[f][0]}
    cols = list(dict.fromkeys(list(keep) + list(key_cols)))
    src = flows
    if inputs & {"hour", "day_of_week"}:
        src = src.withColumn("hour", hour_of_day("timestamp")).withColumn("day_of_week", day_of_week("timestamp"))
    src = src.withColumn("_high_port", high_port("dst_port"))
    src = src.select(*dict.fromkeys(list(cols) + list(ORDER) + input_columns(features)))
    fr = halo.frame(src, ORDER, n, key_cols, block_rows=block_rows,
                    num_partitions=num_partitions)
    w = fr.rows(n)
    df = fr.df
    if "_dt" in inputs:
        df = df.withColumn("_dt", R.seconds_since_previous("timestamp", fr.window))
    at = FrameAggregates(w)
    gated = [F.when(at.full(FORMULAS[f][0], n), FORMULAS[f][1](at)).alias(f) for f in features]
    stage = df.select(*[F.col(c) for c in cols], "_halo", "_blk", *at.columns.values())
    out = stage.select(*[F.col(c) for c in cols], "_halo", "_blk", *gated)
    return fr.finish(out)


# --- connection fan-out / fan-in (A1, J2, W15) -----------------------------

def fan_out(flows: DataFrame, approx: bool = False) -> DataFrame:
    """A1: distinct destinations per source (two-phase distinct aggregation)."""
    agg = F.approx_count_distinct("dst_ip") if approx else F.count_distinct("dst_ip")
    return flows.groupBy("src_ip").agg(agg.alias("fan_out"))


def fan_in(flows: DataFrame, approx: bool = False) -> DataFrame:
    """A1: distinct sources per destination."""
    agg = F.approx_count_distinct("src_ip") if approx else F.count_distinct("src_ip")
    return flows.groupBy("dst_ip").agg(agg.alias("fan_in"))


def attach_fan(flows: DataFrame) -> DataFrame:
    """Per-IP fan-out / fan-in joined back to each flow.

    Both directions count rows of one distinct (src, dst) table, which a single shuffle
    makes (combined map side).  The per-IP tables have one row per distinct IP; AQE turns
    the join into a broadcast when they are small and splits skewed IP partitions otherwise.
    """
    pairs = flows.select("src_ip", "dst_ip").distinct()
    out = pairs.groupBy("src_ip").agg(F.count("dst_ip").alias("fan_out"))
    into = pairs.groupBy("dst_ip").agg(F.count("src_ip").alias("fan_in"))
    return flows.join(out, "src_ip", "left").join(into, "dst_ip", "left")


def fan_sketches(flows: DataFrame, ip: str = "src_ip", other: str = "dst_ip", ts: str = "timestamp", lg_k: int = 12) -> DataFrame:
    """A1 over stored sketches: (date, ip, peers), one HLL sketch of the distinct peers for each day and IP.

    Sketches of new days are appended; a range of days is merged without its flows."""
    return flows.groupBy(F.to_date(ts).alias("date"), ip).agg(F.hll_sketch_agg(other, F.lit(lg_k)).alias("peers"))


def merged_fan(sketches: DataFrame, ip: str = "src_ip", out: str = "fan_out") -> DataFrame:
    """Distinct peers per IP over all the given days, estimated (about 1.6 % standard error at ``lg_k`` 12)."""
    return sketches.groupBy(ip).agg(F.hll_sketch_estimate(F.hll_union_agg("peers")).alias(out))


def rolling_fan_mean(fan: DataFrame, ip_col: str, value_col: str, n: int = WINDOW_SIZE,
                     block_rows: int | None = None) -> DataFrame:
    """Rolling mean of the per-IP table in IP (string) order."""
    fr = halo.frame(fan, [ip_col], n, (), block_rows=block_rows)
    w = fr.rows(n)
    out = fr.df.select(ip_col, value_col, "_halo", "_blk",
                       R.r_mean(value_col, w, n).alias(f"avg_{value_col}"))
    return fr.finish(out)


def sequences(df: DataFrame, value_col: str, length: int = WINDOW_SIZE, stride: int = 1,
              label_col: str | None = None, key_cols=(), pad: bool = False,
              block_rows: int | None = None) -> DataFrame:
    """Sliding sequences of ``length`` rows (oldest first), label = last row's.

    With ``pad=False`` only complete sequences are emitted, one every
    ``stride`` rows; with ``pad=True`` every row gets a sequence left-padded
    with zeros (the online path).
    """
    fr = halo.frame(df, ORDER, length, key_cols, block_rows=block_rows)
    w = fr.rows(length)
    seq = F.collect_list(F.col(value_col)).over(w)
    cols = ["flow_id", "_halo", "_blk", "_idx"] + list(key_cols) + ([label_col] if label_col else [])
    out = fr.df.select(*cols, seq.alias("sequence"))
    out = fr.finish(out, keep_index=True)
    if key_cols:
        # Position inside the key: the key's first global index comes from a
        # partial aggregate (one row per key) joined back, not a per-key window.
        starts = out.groupBy(*key_cols).agg(F.min("_idx").alias("_start"))
        out = (out.join(starts, list(key_cols), "left")
                  .withColumn("_pos", F.col("_idx") - F.col("_start")).drop("_start"))
    else:
        out = out.withColumn("_pos", F.col("_idx"))
    if pad:
        zero = F.lit(0).cast(df.schema[value_col].dataType)
        out = out.withColumn("sequence", F.concat(
            F.array_repeat(zero, F.greatest(F.lit(0), length - F.size("sequence"))), F.col("sequence")))
    else:
        out = out.filter((F.col("_pos") >= length - 1) & (((F.col("_pos") - (length - 1)) % stride) == 0))
    return out.drop("_idx", "_pos")
