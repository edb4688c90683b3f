"""Training-set preparation.

Fitting steps reduce the data to a handful of numbers (min/max, means,
vocabularies, a p x p correlation matrix) with one distributed aggregation;
those small results are collected with a size check and applied as column
expressions, so applying a fitted step is a narrow projection.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import CORRELATION_THRESHOLD, DATASETS, MAX_FEATURES, MINMAX_RANGE, SEED
from . import halo

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
MAX_VOCAB = 100_000  # bound on a vocabulary collected to the driver


def split_columns(df: DataFrame, label: str = "label"):
    """(numeric, categorical) column names by type, label excluded."""
    num = [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC) and f.name != label]
    cat = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name != label]
    return num, cat


def canonical_label(df: DataFrame, dataset: str, registry=DATASETS) -> DataFrame:
    """Rename the dataset's label column to ``label`` (unknown dataset -> error)."""
    if dataset not in registry:
        raise ValueError(f"Unknown dataset: {dataset}")
    col = registry[dataset]["label_column"]
    return df.withColumnRenamed(col, "label") if col != "label" else df


def union_datasets(frames: dict) -> DataFrame:
    """Union by column name, columns missing in a part become NULL; adds ``dataset``."""
    out = None
    for name, df in frames.items():
        part = canonical_label(df, name).withColumn("dataset", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def impute_zero(df: DataFrame) -> DataFrame:
    """P5: NULL/NaN -> 0 for numbers, '0' for strings (the fill precedes typing)."""
    return df.na.fill(0).na.fill("0")


def vocabulary(df: DataFrame, col: str, max_values: int = MAX_VOCAB) -> list:
    """Sorted distinct values of a low-cardinality column (size-checked)."""
    vals = df.select(col).distinct().limit(max_values + 1).collect()
    if len(vals) > max_values:
        raise ValueError(f"{col}: more than {max_values} distinct values; use ordinal_codes")
    return sorted(r[0] for r in vals if r[0] is not None)


def one_hot(df: DataFrame, col: str, vocab: list, prefix: str | None = None) -> DataFrame:
    """One indicator column per fitted value; unseen values -> all zero."""
    prefix = prefix or col
    return df.select("*", *[(F.col(col) == v).cast("int").alias(f"{prefix}_{v}") for v in vocab])


def ordinal_codes(df: DataFrame, col: str, out_col: str | None = None) -> DataFrame:
    """code = rank of the value among the sorted distinct values (0-based).

    The distinct values are numbered with a distributed global index (range
    partitioning, no single-task window), then joined back; AQE broadcasts the
    code table when small and splits skewed values when not.
    """
    out_col = out_col or f"{col}_code"
    # NULL has no code, and must not take the first one from a value
    codes = halo.with_global_index(df.select(col).where(F.col(col).isNotNull()).distinct(), [col], idx_col=out_col)
    return df.join(codes, col, "left")


@dataclass
class ScalerModel:
    """Fitted min-max (P12) or standard (P13) scaling parameters."""
    kind: str
    params: dict  # column -> (a, b)
    lo: float = 0.0
    hi: float = 1.0

    def transform(self, df: DataFrame, suffix: str = "") -> DataFrame:
        exprs = []
        for c, (a, b) in self.params.items():
            x = F.col(c).cast("double")
            if self.kind == "minmax":
                # a = min, b = max; constant column -> lo
                e = (F.lit(self.lo) if a is None or b is None or b == a else
                     (x - F.lit(a)) / F.lit(b - a) * F.lit(self.hi - self.lo) + F.lit(self.lo))
                e = F.when(x.isNull(), F.lit(None).cast("double")).otherwise(e)
            else:
                # a = mean, b = population sd; constant column -> 0
                e = (x - F.lit(a)) / F.lit(b) if b not in (None, 0.0) else F.when(x.isNotNull(), F.lit(0.0))
            exprs.append(e.alias(c + suffix))
        keep = [F.col(c) for c in df.columns if suffix or c not in self.params]
        return df.select(*keep, *exprs)


def save_scaler(spark, model: ScalerModel, path: str) -> None:
    """Fitted parameters as a small parquet table (no pickles)."""
    rows = [(c, model.kind, a, b, model.lo, model.hi) for c, (a, b) in model.params.items()]
    spark.createDataFrame(rows, "column string, kind string, a double, b double, lo double, hi double") \
         .coalesce(1).write.mode("overwrite").parquet(path)


def load_scaler(spark, path: str) -> ScalerModel:
    """Read back a saved scaler (a handful of rows)."""
    rows = spark.read.parquet(path).collect()
    if not rows:
        raise ValueError(f"empty scaler table at {path}")
    return ScalerModel(rows[0]["kind"], {r["column"]: (r["a"], r["b"]) for r in rows},
                       rows[0]["lo"], rows[0]["hi"])


def save_codes(encoded: DataFrame, col: str, path: str, code_col: str | None = None) -> None:
    """A fitted ordinal encoder as its table of (value, code)."""
    code_col = code_col or f"{col}_code"
    encoded.where(F.col(code_col).isNotNull()).select(col, code_col).distinct().write.mode("overwrite").parquet(path)


def apply_codes(spark, df: DataFrame, col: str, path: str, code_col: str | None = None) -> DataFrame:
    """A saved encoder applied to new rows; values that it has not seen get NULL."""
    return df.join(spark.read.parquet(path).select(col, code_col or f"{col}_code"), col, "left")


def save_selection(selected: DataFrame, path: str) -> None:
    """A fitted selector as its table (feature, f_score, rank, selected)."""
    selected.write.mode("overwrite").parquet(path)


def load_selection(spark, path: str) -> list:
    """The names of the selected features, best first (one row per feature column)."""
    return [r["feature"] for r in spark.read.parquet(path).where("selected").orderBy("rank").collect()]


def fit_minmax(df: DataFrame, cols, feature_range=MINMAX_RANGE) -> ScalerModel:
    r = df.agg(*[F.min(F.col(c).cast("double")).alias(f"mn_{i}") for i, c in enumerate(cols)],
               *[F.max(F.col(c).cast("double")).alias(f"mx_{i}") for i, c in enumerate(cols)]).collect()[0]
    return ScalerModel("minmax", {c: (r[f"mn_{i}"], r[f"mx_{i}"]) for i, c in enumerate(cols)},
                       float(feature_range[0]), float(feature_range[1]))


def fit_standard(df: DataFrame, cols) -> ScalerModel:
    r = df.agg(*[F.avg(F.col(c).cast("double")).alias(f"m_{i}") for i, c in enumerate(cols)],
               *[F.stddev_pop(F.col(c).cast("double")).alias(f"s_{i}") for i, c in enumerate(cols)]).collect()[0]
    return ScalerModel("standard", {c: (r[f"m_{i}"], r[f"s_{i}"]) for i, c in enumerate(cols)})


# --- sampling and splitting ------------------------------------------------------

def hash_key(id_col: str = "flow_id", seed: int = SEED):
    """Deterministic pseudo-random order: md5 of 'id|seed'; a NULL id counts as an empty one."""
    return F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(f"|{seed}")))


#: Leading hex digits of the hash that rows are counted by (16 ** 3 counts reach the driver).
HASH_DIGITS = 3


def exact_sample(df: DataFrame, n: int, id_col: str = "flow_id", seed: int = SEED) -> DataFrame:
    """Exactly ``n`` rows without replacement (all rows when fewer): the first in hash order.

    Rows are counted by the leading digits of their hash (one partial aggregation).
    Whole buckets below the threshold stay without a sort; only the bucket that the
    n-th row falls in is ordered, so no task merges n rows.  Rows without an id share one
    place in the order; which of them are taken is not determined."""
    h = hash_key(id_col, seed)
    keyed = df.withColumn("_h", h).withColumn("_b", F.substring("_h", 1, HASH_DIGITS))
    counts = sorted((r["_b"], r["n"]) for r in keyed.groupBy("_b").agg(F.count(F.lit(1)).alias("n")).collect())
    left, edge = n, None
    for bucket, size in counts:
        if size > left:
            edge = bucket
            break
        left -= size
    if edge is None:
        return df
    whole = keyed.where(F.col("_b") < edge).drop("_h", "_b")
    if left == 0:
        return whole
    part = keyed.where(F.col("_b") == edge).orderBy("_h", F.col(id_col)).limit(left).drop("_h", "_b")
    return whole.unionByName(part)


def _ranked_pool(pool: DataFrame, cap: int, id_col: str, seed: int) -> DataFrame:
    """The ``cap`` first rows of ``pool`` in hash order, numbered 1..cap by the distributed index."""
    top = exact_sample(pool, cap, id_col, seed).withColumn("_h", hash_key(id_col, seed))
    return halo.with_global_index(top, ["_h", id_col], idx_col="_rk").withColumn("_rk", F.col("_rk") + 1).drop("_h")


def detectors_with_data(registry: DataFrame, flows: DataFrame, label: str = "label") -> DataFrame:
    """Detector attack types that occur among the labels (left semi join)."""
    labels = flows.select(F.col(label).alias("attack_type")).distinct()
    return registry.select("attack_type").distinct().join(labels, "attack_type", "left_semi")


#: Classes whose starts may be broadcast (two numbers and a name each).
BROADCAST_CLASSES = 100_000


def training_sets(flows: DataFrame, registry: DataFrame, cap: int, label: str = "label",
                  id_col: str = "flow_id", seed: int = SEED, positive_cap: int | None = None) -> DataFrame:
    """X2 + X3: one binary set per detector attack type present in the data.

    Positives: every row of that class (with ``positive_cap`` its first in hash order).  Negatives: the first min(#positives, cap) rows
    of the other side in hash order (Benign for attack detectors; all attacks for the
    Benign detector).  The two pools are ranked once and joined to the class counts, so
    the scans do not grow with the registry."""
    rows = flows.select(id_col, F.col(label).alias("attack_type"))
    types = registry.select("attack_type").distinct()
    pos = rows.join(types, "attack_type", "left_semi").select("attack_type", id_col, F.lit(1).alias("y"))
    if positive_cap is not None:
        ranked = class_rank(_leading(pos, "attack_type", positive_cap, id_col, seed), "attack_type", id_col, seed)
        pos = ranked.where(F.col("_rk") <= positive_cap).drop("_rk", "_n")
    need = pos.groupBy("attack_type").agg(F.least(F.count(F.lit(1)), F.lit(cap)).alias("need"))
    if types.count() <= BROADCAST_CLASSES:  # one row of ``need`` per type at most
        need = F.broadcast(need)
    is_benign = F.col("attack_type") == "Benign"
    benign = _ranked_pool(rows.where(is_benign).select(id_col), cap, id_col, seed).withColumn("_side", F.lit(False))
    attack = _ranked_pool(rows.where(~is_benign).select(id_col), cap, id_col, seed).withColumn("_side", F.lit(True))
    # a pool row meets at most one row per registered attack type
    neg = (benign.unionByName(attack).join(need.withColumn("_side", is_benign), "_side")
           .where("_rk <= need").select("attack_type", id_col, F.lit(0).alias("y")))
    return pos.unionByName(neg)


def _hash_buckets(df: DataFrame, label: str, id_col: str, seed: int) -> tuple[DataFrame, DataFrame]:
    """``df`` with ``_b``, the leading digits of the row's hash, and (_class, _b, _m, _n, _before): the rows of each class
    and bucket, of the class, and of the class in earlier buckets.  At most 16 ** HASH_DIGITS counts a class."""
    keyed = df.withColumn("_b", F.substring(hash_key(id_col, seed), 1, HASH_DIGITS))
    every = Window.partitionBy("_class")
    per = keyed.groupBy(F.col(label).alias("_class"), "_b").agg(F.count(F.lit(1)).alias("_m"))
    earlier = F.sum("_m").over(every.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    return keyed, per.select("*", F.sum("_m").over(every).alias("_n"), F.coalesce(earlier, F.lit(0)).alias("_before"))


def _small(per: DataFrame) -> DataFrame:
    """Broadcast a table of classes or of their buckets if a count proves it small."""
    return F.broadcast(per) if per.count() <= BROADCAST_CLASSES else per


def _leading(df: DataFrame, label: str, n: int, id_col: str, seed: int) -> DataFrame:
    """The rows of each class up to the hash bucket of its n-th row: its n first in hash order and at most the rest of that bucket."""
    keyed, per = _hash_buckets(df, label, id_col, seed)
    edge = per.where(F.col("_before") < n).groupBy("_class").agg(F.max("_b").alias("_edge"))
    kept = keyed.join(_small(edge), F.col(label).eqNullSafe(F.col("_class"))).where("_b <= _edge")
    return kept.select(*df.columns)


def class_rank(df: DataFrame, label: str, id_col: str = "flow_id", seed: int = SEED) -> DataFrame:
    """Adds ``_rk``, the 1-based rank in hash order inside the row's class, and ``_n``, the class's rows.

    The rank comes from a global index over (label, hash, id) minus the class's first
    index -- no per-class window, so a class holding most rows does not end up in one
    task.  The classes are counted before they are broadcast; more than
    ``BROADCAST_CLASSES`` are joined by a shuffle.  Rows without a label are a class of their own."""
    idx = halo.with_global_index(df.withColumn("_h", hash_key(id_col, seed)), [label, "_h", id_col])
    per = idx.groupBy(F.col(label).alias("_class")).agg(F.min("_idx").alias("_start"), F.count(F.lit(1)).alias("_n"))
    if per.count() <= BROADCAST_CLASSES:
        per = F.broadcast(per)
    return (idx.join(per, F.col(label).eqNullSafe(F.col("_class"))).withColumn("_rk", F.col("_idx") - F.col("_start") + 1)
            .drop("_idx", "_start", "_h", "_class"))


def stratified_split(df: DataFrame, label: str = "label", id_col: str = "flow_id",
                     test_size: float = 0.2, val_size: float = 0.1, seed: int = SEED) -> DataFrame:
    """Exact per-class 70/10/20 split in hash order (adds ``split``).

    Rows are counted by class and leading digits of their hash.  A bucket that lies in one split whole needs no order;
    only the rows of the buckets that a border falls in, two a class at most, are ranked (``class_rank``)."""
    n_test, n_val = F.round(F.col("_n") * test_size), F.round(F.col("_n") * val_size)

    def of(rk):
        return F.when(rk <= n_test, "test").when(rk <= n_test + n_val, "val").otherwise("train")

    keyed, per = _hash_buckets(df, label, id_col, seed)
    per = per.select("_class", F.col("_b").alias("_bucket"), "_n", "_before", of(F.col("_before") + 1).alias("split"),
                     of(F.col("_before") + F.col("_m")).alias("_last")).persist()  # 16 ** HASH_DIGITS rows a class at most
    same = F.col(label).eqNullSafe(F.col("_class")) & (F.col("_b") == F.col("_bucket"))
    whole = keyed.join(_small(per.where("split = _last")), same).select(*df.columns, "split")
    edge = keyed.join(_small(per.where("split <> _last").drop("split")), same)
    edge = edge.select(*df.columns, "_before", F.col("_n").alias("_size"), F.struct("_class", "_b").alias("_cell"))
    ranked = class_rank(edge, "_cell", id_col, seed).withColumn("_n", F.col("_size"))
    return whole.unionByName(ranked.select(*df.columns, of(F.col("_before") + F.col("_rk")).alias("split")))


def hash_split(df: DataFrame, id_col: str = "flow_id", test_size: float = 0.2, val_size: float = 0.1, seed: int = SEED) -> DataFrame:
    """X4 at scale: adds ``split`` from the row's hash alone, in the scan.

    No shuffle and no count, and a row keeps its split however the table grows; the shares
    hold in every class up to sampling error (about 0.4 / sqrt(rows of the class))."""
    place = F.conv(F.substring(hash_key(id_col, seed), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return df.withColumn("split", F.when(place < test_size, "test").when(place < test_size + val_size, "val").otherwise("train"))


def decode_ordinal(df: DataFrame, codes: DataFrame, col: str, code_col: str | None = None) -> DataFrame:
    """P11 inverse: the value of each code, from a table (``col``, ``code_col``); unknown codes give NULL."""
    code_col = code_col or f"{col}_code"
    return df.join(codes.select(col, code_col).distinct(), code_col, "left")


# --- feature selection -------------------------------------------------------------

#: Columns that meet a column in one group of ``correlation_pairs``: few aggregates stay inside whole-stage code generation.
PAIR_BLOCK = 4


def correlation_pairs(df: DataFrame, cols) -> DataFrame:
    """p x p Pearson matrix (upper triangle) in one aggregation, each pair over the rows that have both values.

    A group holds a column and a block of ``PAIR_BLOCK`` others, and each row meets every group.  The groups
    are combined map side.  A single row of p^2 aggregates is too wide for whole-stage code generation."""
    p, spark = len(cols), df.sparkSession
    blocks = [(i, j) for i in range(p) for j in range(0, p, PAIR_BLOCK) if min(j + PAIR_BLOCK, p) > i + 1]
    if not blocks:
        return spark.createDataFrame([], "feature_a string, feature_b string, r double")
    groups = spark.createDataFrame(blocks, "i int, j int")
    row = df.select(F.array(*[F.col(c).cast("double") for c in cols]).alias("v"))
    ys = [f"y{k}" for k in range(PAIR_BLOCK)]
    met = row.crossJoin(F.broadcast(groups)).select("i", "j", F.get("v", F.col("i")).alias("x"),
                                                    *[F.get("v", F.col("j") + k).alias(y) for k, y in enumerate(ys)])
    # a pair without any row stays, with a NULL
    met = met.unionByName(groups.select("i", "j", *[F.lit(None).cast("double").alias(c) for c in ["x", *ys]]))
    aggs = []
    for k, y in enumerate(ys):
        a, b = F.when(F.col(y).isNotNull(), F.col("x")), F.when(F.col("x").isNotNull(), F.col(y))
        aggs.append(F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)).alias(f"r{k}"))
    stack = ", ".join(f"j + {k}, r{k}" for k in range(PAIR_BLOCK))
    long = met.groupBy("i", "j").agg(*aggs).selectExpr("i", f"stack({PAIR_BLOCK}, {stack}) AS (j, r)").where(f"i < j AND j < {p}")
    names = F.array(*[F.lit(c) for c in cols])
    return long.select(F.get(names, F.col("i")).alias("feature_a"), F.get(names, F.col("j")).alias("feature_b"), "r")


ONE_TOL = 1e-12


def correlated_to_drop(corr: dict, cols, threshold: float = CORRELATION_THRESHOLD, one_tol: float = ONE_TOL) -> list:
    """Walk the columns in order; each one that stays removes the later columns
    it is strongly correlated with (|r| > ``threshold``).  An exact duplicate (r = 1
    up to ``one_tol``, the noise of the correlation itself) is not removed."""
    def strong(a, b):
        r = corr.get((a, b), corr.get((b, a)))
        return r is not None and abs(r) > threshold and abs(r - 1.0) > one_tol

    kept, left = [], list(cols)
    while left:
        head, *rest = left
        kept.append(head)
        left = [c for c in rest if not strong(head, c)]
    return [c for c in cols if c not in kept]


def drop_correlated(df: DataFrame, cols, threshold: float = CORRELATION_THRESHOLD):
    """Returns (kept column names, dropped column names). Only p^2 numbers
    reach the driver."""
    pairs = correlation_pairs(df, cols).collect()
    corr = {(r["feature_a"], r["feature_b"]): r["r"] for r in pairs}
    dropped = correlated_to_drop(corr, list(cols), threshold)
    return [c for c in cols if c not in dropped], dropped


def anova_f(df: DataFrame, cols, label: str = "label") -> DataFrame:
    """One-way ANOVA F statistic of each feature against the class label.

    One grouped aggregation (count, mean, population variance per class) ->
    small table -> F = (SSB / (k - 1)) / (SSW / (N - k)).
    """
    # rows are counted per feature: means and variances skip NULLs
    stats = df.groupBy(label).agg(
        *[F.count(c).alias(f"n_{i}") for i, c in enumerate(cols)],
        *[F.avg(F.col(c).cast("double")).alias(f"m_{i}") for i, c in enumerate(cols)],
        *[F.var_pop(F.col(c).cast("double")).alias(f"v_{i}") for i, c in enumerate(cols)])
    stack = ", ".join(f"'{c}', n_{i}, m_{i}, v_{i}" for i, c in enumerate(cols))
    long = stats.selectExpr(label, f"stack({len(cols)}, {stack}) AS (feature, n, m, v)").where("n > 0")
    tot = long.groupBy("feature").agg(
        F.sum("n").alias("n_total"), F.count(F.lit(1)).alias("k"),
        (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("gm"))
    j = long.join(tot, "feature")
    f = j.groupBy("feature", "n_total", "k").agg(
        F.sum(F.col("n") * (F.col("m") - F.col("gm")) ** 2).alias("ssb"),
        F.sum(F.col("n") * F.col("v")).alias("ssw"))
    return f.select("feature", F.try_divide(F.col("ssb") / (F.col("k") - 1),
                                            F.col("ssw") / (F.col("n_total") - F.col("k"))).alias("f_score"))


#: Quantile bins of the contingency-table scores.
SCORE_BINS = 10


def contingency(df: DataFrame, cols, label: str = "label", bins: int = SCORE_BINS) -> DataFrame:
    """(feature, bin, label, n): how the quantile bins of each feature meet the classes.

    A value's bin is floor(bins * rows below it / rows), so equal values share a bin and
    the bins are exact quantiles.  Rows are first counted by (feature, value, class), map
    side; ranks are a distributed running total over the counted values, so neither a
    sort of the rows nor a single-task window is needed."""
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in cols)
    cells = (df.selectExpr(f"`{label}` AS _class", f"stack({len(cols)}, {pairs}) AS (feature, _value)").where("_value IS NOT NULL")
             .groupBy("feature", "_value", "_class").agg(F.count(F.lit(1)).alias("_n")))
    values = cells.groupBy("feature", "_value").agg(F.sum("_n").alias("_here"))
    below = halo.with_running_total(values, ["feature", "_value"], "_here", "_below")
    whole = below.groupBy("feature").agg(F.min("_below").alias("_first"), F.sum("_here").alias("_rows"))  # a row a column
    place = F.floor((F.col("_below") - F.col("_first")) * bins / F.col("_rows"))
    binned = below.join(F.broadcast(whole), "feature").select("feature", "_value", place.alias("bin"))
    return (cells.join(binned, ["feature", "_value"]).groupBy("feature", "bin", F.col("_class").alias(label))
            .agg(F.sum("_n").alias("n")))


def contingency_scores(df: DataFrame, cols, label: str = "label", bins: int = SCORE_BINS) -> DataFrame:
    """(feature, chi2, mutual_info) of each feature's quantile bins against the class (natural logarithm)."""
    t = contingency(df, cols, label, bins)
    row, col, every = Window.partitionBy("feature", "bin"), Window.partitionBy("feature", label), Window.partitionBy("feature")
    t = t.select("feature", "n", F.sum("n").over(row).alias("r"), F.sum("n").over(col).alias("c"), F.sum("n").over(every).alias("t"))
    share = F.col("n") / F.col("t")
    return t.groupBy("feature").agg(
        (F.max("t") * (F.sum(F.col("n") * F.col("n") / (F.col("r") * F.col("c"))) - 1)).alias("chi2"),
        F.sum(share * F.log(F.col("n") * F.col("t") / (F.col("r") * F.col("c")))).alias("mutual_info"))


def feature_scores(df: DataFrame, cols, score: str = "anova_f", label: str = "label", bins: int = SCORE_BINS) -> DataFrame:
    """(feature, f_score) by the named score function: ``anova_f``, ``chi2`` or ``mutual_info``."""
    if score == "anova_f":
        return anova_f(df, cols, label)
    if score not in ("chi2", "mutual_info"):
        raise ValueError(f"Unknown score function: {score}")
    return contingency_scores(df, cols, label, bins).select("feature", F.col(score).alias("f_score"))


def select_k_best(fscores: DataFrame, k: int = MAX_FEATURES) -> DataFrame:
    """Top-k by score (p rows, a bounded table): adds ``rank`` and ``selected``."""
    w = Window.orderBy(F.col("f_score").desc_nulls_last(), F.col("feature"))
    r = fscores.withColumn("rank", F.row_number().over(w))
    return r.withColumn("selected", F.col("rank") <= k)


# --- detector registry (J6) ----------------------------------------------------------

def register_detectors(registry: DataFrame, candidates: DataFrame, max_detectors: int = 10_000) -> DataFrame:
    """Append candidate (attack_type, model_type) detectors that are not yet
    registered (left anti join); new ordinals follow the current maximum in
    (attack_type, model_type) order, a known attack type keeps its index."""
    new = (candidates.select("attack_type", "model_type").distinct()
           .join(registry.select("attack_type", "model_type"), ["attack_type", "model_type"], "left_anti"))
    top = registry.agg(F.max("ordinal").alias("m"), F.max("attack_idx").alias("ma"),
                       F.count(F.lit(1)).alias("n")).collect()[0]
    if top["n"] > max_detectors:
        raise ValueError("detector registry too large")
    m, ma = int(top["m"] if top["m"] is not None else -1), int(top["ma"] if top["ma"] is not None else -1)
    known = registry.select("attack_type", "attack_idx").distinct()
    # The candidate set is bounded by the registry limit, so these windows are small.
    w = Window.orderBy("attack_type", "model_type")
    new = new.join(known, "attack_type", "left").withColumn("_is_fresh", F.col("attack_idx").isNull())
    fresh_idx = F.dense_rank().over(Window.partitionBy("_is_fresh").orderBy("attack_type"))
    new = new.select(
        (F.lit(m) + F.row_number().over(w)).cast("int").alias("ordinal"),
        F.coalesce(F.col("attack_idx"), (F.lit(ma) + fresh_idx)).cast("int").alias("attack_idx"),
        F.concat_ws("_", "attack_type", "model_type").alias("cluster_id"),
        "attack_type", "model_type")
    if new.limit(max_detectors + 1).count() > max_detectors:
        raise ValueError("too many new detectors")
    return registry.unionByName(new)
