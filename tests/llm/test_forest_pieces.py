"""A shard is sent in bounded pieces, once for many blocks of queries; the neighbours are the same however it is cut (operator 2)."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from netvigil.llm import ann_forest


@pytest.fixture(scope="module")
def table(spark):
    x = np.random.default_rng(3).standard_normal((700, 64))
    x[650:] = x[:50]  # equal vectors tie
    return x, spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")


def found(df):
    return sorted(map(tuple, ann_forest.search(df.where("vec_id % 2 = 0"), df, 5).collect()))


def test_pieces_are_small_and_do_not_grow_with_the_blocks(table, monkeypatch):
    _, df = table
    monkeypatch.setattr(ann_forest, "SHARD_ROWS", 350)
    sizes, real = [], type(df).mapInArrow

    def watched(self, f, schema, *a, **kw):
        wide = [c for c, kind in self.dtypes if kind == "binary"]
        sizes.extend(map(tuple, self.select(sum((F.octet_length(c) for c in wide), F.lit(0)).alias("n")).agg(F.max("n"), F.sum("n")).collect()))
        return real(self, f, schema, *a, **kw)

    monkeypatch.setattr(type(df), "mapInArrow", watched)
    monkeypatch.setattr(ann_forest, "TASKS_PER_CORE", 0.25, raising=False)  # one task, or one a shard
    monkeypatch.setattr(ann_forest, "BLOCK_ROWS", 32)
    found(df)
    largest, whole = sizes[-1]
    trees, vectors = 700 * ann_forest.TREES * 12, 700 * 65 * 8
    assert largest <= 2 * 32 * 65 * 8  # blocks are dealt by hash, so some hold a few more
    assert whole <= trees + vectors + 2 * 350 * 65 * 8  # each shard once, and all queries to both shards


def test_neighbours_do_not_depend_on_blocks_and_tasks(table, monkeypatch):
    x, df = table
    want = found(df)
    monkeypatch.setattr(ann_forest, "BLOCK_ROWS", 50)
    assert found(df) == want
    monkeypatch.setattr(ann_forest, "TASKS_PER_CORE", 0.25, raising=False)
    monkeypatch.setattr(ann_forest, "HASH_ROWS", 64, raising=False)
    assert found(df) == want
    score = {(q, v): s for q, _, v, s in want}
    assert all(s == pytest.approx(x[q] @ x[v], abs=1e-9) for (q, v), s in score.items())


def test_a_shard_without_vectors_is_passed_over(spark, monkeypatch):
    monkeypatch.setattr(ann_forest, "SHARD_ROWS", 1)
    df = spark.createDataFrame([(i, [1.0 + i, 2.0, 0.5]) for i in range(8)], "vec_id long, embedding array<double>")
    got = ann_forest.search(df, df, 3).groupBy("query_id").count().collect()
    assert len(got) == 8 and {r["count"] for r in got} == {3}
