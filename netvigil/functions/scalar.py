"""Scalar column expressions (all JVM built-ins, codegen friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import KNOWN_CLASSES


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def map_attack_type(pred, known=KNOWN_CLASSES) -> Column:
    """Class -> attack type, anything outside the known classes is 'Unknown'."""
    pred = col_(pred)
    return F.when(pred.isin(list(known)), pred).otherwise(F.lit("Unknown"))


def severity(attack_type, confidence, n_conflicts, digits: int = 6) -> Column:
    """Severity ladder, then one step up when any conflict was found."""
    a, n = col_(attack_type), col_(n_conflicts)
    c = F.round(col_(confidence), digits)
    base = (F.when(a == "Benign", "Low")
            .when((c >= 0.9) & (n == 0), "Critical")
            .when(c >= 0.8, "High")
            .when(c >= 0.6, "Medium")
            .otherwise("Low"))
    return (F.when((n > 0) & (base == "Low"), "Medium")
            .when((n > 0) & (base == "Medium"), "High")
            .otherwise(base))


def is_valid_vote(v) -> Column:
    """Trained, strictly positive confidence, a prediction, no error.

    NaN is not positive (Spark orders it above every number), and a vote without a
    prediction cannot be counted for a class."""
    return (F.coalesce(v["is_trained"], F.lit(False))
            & (F.coalesce(v["confidence"], F.lit(0.0)) > 0)
            & ~F.isnan(F.coalesce(v["confidence"], F.lit(0.0)))
            & v["prediction"].isNotNull()
            & v["error"].isNull())


def default_prediction(trained, error, prediction, confidence):
    """Untrained detector -> ('Unknown', 0.0); failed detector -> ('Error', 0.0)."""
    trained, error = col_(trained), col_(error)
    pred = (F.when(error.isNotNull(), "Error")
            .when(~F.coalesce(trained, F.lit(False)), "Unknown")
            .otherwise(col_(prediction)))
    conf = F.when(error.isNotNull() | ~F.coalesce(trained, F.lit(False)), F.lit(0.0)).otherwise(col_(confidence))
    return pred, conf


def hour_of_day(ts) -> Column:
    """P7."""
    return F.hour(col_(ts))


def day_of_week(ts) -> Column:
    """Monday = 0 ... Sunday = 6 (``weekday``, not ``dayofweek``)."""
    return F.weekday(col_(ts))


def high_port(dst_port, cutoff: int = 1024) -> Column:
    """Indicator dst_port > 1024 as double."""
    return (col_(dst_port) > cutoff).cast("double")


def flow_metadata(ts="timestamp", src="src_ip", dst="dst_ip", proto="protocol") -> Column:
    """P20: metadata struct attached to a decision."""
    return F.struct(col_(ts).alias("timestamp"), col_(src).alias("src_ip"),
                    col_(dst).alias("dst_ip"), col_(proto).alias("protocol"))


def parse_timestamp(c, fmt: str | None = None) -> Column:
    """Lenient timestamp parse (NULL on bad input instead of failing)."""
    c = col_(c)
    return F.try_to_timestamp(c, F.lit(fmt)) if fmt else F.try_to_timestamp(c)
