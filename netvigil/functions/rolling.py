"""Rolling-window expressions with pandas ``min_periods = N`` semantics.

Each function takes the window spec ``w`` (already framed to the last N rows)
and returns a Column that is NULL unless N non-null inputs are in the frame.
"""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def full(x, w: WindowSpec, n: int) -> Column:
    return F.count(c(x)).over(w) == n


def gated(agg: Column, x, w: WindowSpec, n: int) -> Column:
    return F.when(full(x, w, n), agg)


def r_mean(x, w, n):
    return gated(F.avg(c(x)).over(w), x, w, n)


def r_std(x, w, n):
    """Sample standard deviation (ddof 1)."""
    return gated(F.stddev_samp(c(x)).over(w), x, w, n)


def r_min(x, w, n):
    return gated(F.min(c(x)).over(w), x, w, n)


def r_max(x, w, n):
    return gated(F.max(c(x)).over(w), x, w, n)


def r_median(x, w, n):
    """Exact interpolated median (``percentile`` accepts a row frame)."""
    return gated(F.percentile(c(x), F.lit(0.5)).over(w), x, w, n)


def r_nunique(x, w, n):
    return gated(F.size(F.collect_set(c(x)).over(w)), x, w, n)


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a lambda variable."""
    return F.aggregate(F.array(F.lit(0)), value, lambda acc, _: acc, body)


def entropy_of(values: Column) -> Column:
    """Shannon entropy (natural log) of the value distribution of an array.

    The frame's list is bound once; each distinct value's share is computed once.
    """
    def on_list(a: Column) -> Column:
        total = F.size(a).cast("double")
        return -F.aggregate(
            F.array_distinct(a), F.lit(0.0),
            lambda acc, v: acc + _let(F.size(F.filter(a, lambda y: y == v)) / total,
                                      lambda p: p * F.ln(p)))
    return _let(values, on_list)


def r_entropy(x, w, n):
    return gated(entropy_of(F.collect_list(c(x)).over(w)), x, w, n)


def r_corr(a, b, w, n):
    """Pearson r over the frame; NULL for a constant frame (no divide error)."""
    both = F.when(c(a).isNotNull() & c(b).isNotNull(), F.lit(1))
    r = F.try_divide(F.covar_pop(c(a), c(b)).over(w),
                     F.stddev_pop(c(a)).over(w) * F.stddev_pop(c(b)).over(w))
    return F.when(F.count(both).over(w) == n, r)


def seconds_since_previous(ts, w: WindowSpec) -> Column:
    """Inter-arrival gap in seconds (first row of a frame partition is NULL)."""
    micros = F.unix_micros(c(ts).cast("timestamp"))
    return (micros - F.lag(micros, 1).over(w)) / F.lit(1e6)
