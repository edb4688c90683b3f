"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netvigil.session import ensure_checkpoint_dir

#: Rows per Arrow batch sent to a Python worker: a batch of very long texts stays small.
ARROW_ROWS = 128
#: A side smaller than this many rows of a few numbers may be broadcast (about 20 MB).
BROADCAST_ROWS = 300_000


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers once per application (as --py-files would)."""
    sc = spark.sparkContext
    if not getattr(sc, "_netvigil_shipped", False):
        root = Path(__file__).resolve().parents[1]
        target = Path(tempfile.mkdtemp(prefix="netvigil-py-"), "netvigil.zip")
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        sc.addPyFile(str(target))  # the driver's file server hands it to every executor
        sc._netvigil_shipped = True


def prepare(spark: SparkSession) -> None:
    """Package on the workers, shared checkpoint folder, small Arrow batches for the Python stages."""
    ship(spark)
    ensure_checkpoint_dir(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: the rows go to the shared checkpoint folder once, and a lost
    executor costs a read of that folder instead of the whole computation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Scratch:
    """Tables of a loop, written below the shared checkpoint folder.

    A checkpointed plan keeps the size estimate of the plan it replaces, and in a loop
    of joins those estimates multiply until planning them takes longer than the work;
    a table that is written and read again has the size of its files.  ``drop`` removes
    the tables once what was made of them is checkpointed itself.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.n = spark, 0
        self.base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/netvigil-{uuid.uuid4().hex}"

    def cut(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        sc = self.spark.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(self.base)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def tasks(spark: SparkSession) -> int:
    """How many tasks a costly step over small rows is dealt to (adaptive execution would join them by size)."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` if a count proves it small; otherwise leave the join to a shuffle."""
    return F.broadcast(df) if df.count() <= rows else df


def fold_ascii(text: Column) -> Column:
    """A-Z to a-z, every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text: Column) -> Column:
    """Lower-cased words between ASCII white space; an empty array for null or blank text."""
    return F.filter(F.split(fold_ascii(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"),
                    lambda w: w != "")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected graph by repeated contraction.

    ``edges``: two columns of node ids (long).  Returns (node long, root long) for
    every node with an edge, where all nodes of a component share one root.

    This is a union-find run as joins: in a round every node hooks onto the smallest
    node around it and the edges are rewritten between the hooked-on nodes, so the
    graph shrinks by a constant share until no edge is left; one pointer jump a round
    halves the rounds.  "Smallest" is taken
    after an XOR with a constant that changes by round, so that chains of ascending
    ids do not shrink one by one.  The minimum is combined map side (a hub does not
    land in one task), the rewriting joins are plain equi-joins that adaptive
    execution may split, and each round is written to the shared folder.
    """
    a, b = edges.columns[:2]
    held = Scratch(edges.sparkSession)
    left = held.cut(edges.select(F.col(a).alias("a"), F.col(b).alias("b"))
                    .where("a is not null and b is not null and a <> b").distinct())
    layers = []
    while not left.isEmpty():
        turn = F.xxhash64(F.lit(len(layers)))
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = held.cut(both.groupBy("a").agg(F.min(F.col("b").bitwiseXOR(turn)).alias("m"))
                        .select(F.col("a").alias("node"),
                                F.least("m", F.col("a").bitwiseXOR(turn)).bitwiseXOR(turn).alias("up")))
        hook = held.cut(hook.join(hook.select(F.col("node").alias("up"), F.col("up").alias("top")), "up")
                        .select("node", F.col("top").alias("up")))
        layers.append(hook)
        left = held.cut(left.join(hook.select(F.col("node").alias("a"), F.col("up").alias("ua")), "a")
                        .join(hook.select(F.col("node").alias("b"), F.col("up").alias("ub")), "b")
                        .where("ua <> ub")
                        .select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b"))
                        .distinct())
    out = layers[0].select("node", F.col("up").alias("root")) if layers else left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    for hook in layers[1:]:
        out = (out.join(hook.select(F.col("node").alias("root"), "up"), "root", "left")
               .select("node", F.coalesce("up", "root").alias("root")))
    out = cut(out)
    held.drop()
    return out
