"""Retention of the date-partitioned history as a storage job.

The history grows by appended files.  The job drops the partitions before a date and
rewrites partitions of many small files into few, and may be run again after a crash at
any point: what it has finished stays finished, and rows are never only in a place that
the next run throws away.

1. A rewrite that an earlier run completed (its success marker is there) is put in place
   first; one that it did not complete is removed.
2. Partitions before the date are deleted, folder by folder.
3. The rows of fragmented partitions are written, compacted, to ``_rewrite`` below the
   history, and only then moved in place of the old ones, day by day.

One job at a time may change a history; appends have to wait for it.
"""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REWRITE = "_rewrite"
#: A partition with more files than this is compacted.
MOST_FILES = 8
#: Rows that a compacted file holds.
FILE_ROWS = 5_000_000


def _fs(spark: SparkSession, path: str):
    sc = spark.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(sc._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _fs(spark, path)
    return fs.exists(where)


_exists = exists


def partitions(spark: SparkSession, path: str) -> dict[str, int]:
    """Data files in each ``date=`` folder (from the listing alone)."""
    fs, where = _fs(spark, path)
    found = {}
    for status in fs.listStatus(where):
        name = status.getPath().getName()
        if status.isDirectory() and re.fullmatch(r"date=\d{4}-\d{2}-\d{2}", name):
            found[name[5:]] = sum(not f.getPath().getName().startswith(("_", ".")) for f in fs.listStatus(status.getPath()))
    return found


def _delete(spark: SparkSession, path: str) -> None:
    fs, where = _fs(spark, path)
    fs.delete(where, True)


def _put_in_place(spark: SparkSession, path: str) -> None:
    """The rewritten partitions replace those of the same dates; all others stay as they are.

    A day leaves the rewrite only when its folder stands in the history, so a crash
    between the two steps costs nothing: the next run takes the days that are left."""
    rewrite = f"{path}/{REWRITE}"
    for day in partitions(spark, rewrite):
        fs, target = _fs(spark, f"{path}/date={day}")
        fs.delete(target, True)
        if not fs.rename(_fs(spark, f"{rewrite}/date={day}")[1], target):
            raise OSError(f"could not move {rewrite}/date={day}")
    _delete(spark, rewrite)


def recover(spark: SparkSession, path: str) -> None:
    """Finishes or removes what an earlier run left."""
    if exists(spark, f"{path}/{REWRITE}/_SUCCESS"):
        _put_in_place(spark, path)
    else:
        _delete(spark, f"{path}/{REWRITE}")


def retain_history(spark: SparkSession, path: str, since: date, most_files: int = MOST_FILES, file_rows: int = FILE_ROWS) -> DataFrame:
    """Drops the days before ``since``, compacts fragmented ones, and returns the history that is left."""
    path = path.rstrip("/")
    recover(spark, path)
    files = partitions(spark, path)
    for day in files:
        if date.fromisoformat(day) < since:
            _delete(spark, f"{path}/date={day}")
    loose = [day for day, n in files.items() if n > most_files and date.fromisoformat(day) >= since]
    if loose:
        rows = spark.read.parquet(path).where(F.col("date").isin([date.fromisoformat(d) for d in loose]))
        # rebalanced by day: a large day is split over several tasks, a small one is one file
        (rows.hint("rebalance", "date").write.option("maxRecordsPerFile", file_rows).mode("overwrite")
         .partitionBy("date").parquet(f"{path}/{REWRITE}"))
        _put_in_place(spark, path)
    return spark.read.parquet(path)
