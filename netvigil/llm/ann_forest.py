"""Approximate nearest neighbours by a hash-prefix forest (operator 2).

Every vector gets ``TREES`` hash strings of ``DEPTH`` bits (signs of random
projections).  The index is cut into shards of bounded size by vec_id; a shard holds,
per tree, its hash strings as a sorted array.  A task reads one shard, in pieces of
bounded size, and then the blocks of queries one by one: a shard is sent once for
all of its task's blocks, and memory holds one shard and a few pieces, however many
queries there are.  A block of queries meets every shard once: in all trees of the shard each query descends to its longest matching prefix,
then all trees ascend together, one bit at a time, and take in every vector under the
shorter prefix until ``SHARE`` of the shard, and as many as are asked for, has been seen.  The candidates are ranked by their exact inner
product in double precision, and the best of all shards are merged by a window whose
group limit runs before the shuffle.

The largest inner product is sought, so vectors are extended by sqrt(M^2 - |x|^2)
(M: the largest norm) before hashing, which turns it into the smallest angle; queries
are extended by 0.  Random directions of 64 and more dimensions are nearly
orthogonal, and the 20th best of an isotropic set is not much closer than the rest:
prefixes cannot tell it apart cheaply, which is why ``SHARE`` is large (README).

Defined results: vectors that are null, zero, of another length than most, or hold a
null or non-finite component take no part; nor do rows without vec_id; rows that
repeat a vec_id count once (the smallest vector); ties go to the smaller vec_id; fewer
candidates than asked are all returned; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netvigil.llm.common import cut, prepare

TREES, DEPTH = 48, 24
SHARE = 0.5
NEAREST = 20
#: Vectors of a shard and queries of a block: what one task holds.
SHARD_ROWS, BLOCK_ROWS = 8_192, 512
#: Bytes of vectors in a row that is sent (several rows make an Arrow batch).
PIECE_BYTES = 1 << 18
#: Vectors hashed at a time.
HASH_ROWS = 1_024
#: Tasks a core that meet shards and blocks, as far as there are so many pairs of them.
TASKS_PER_CORE = 4
#: Kinds of pieces, in the order in which a task reads them.
VECTORS, TREE, QUERIES = range(3)
SEED = 7


def _planes(dim: int):
    import numpy as np

    return np.random.default_rng(SEED).standard_normal((dim + 1, TREES * DEPTH))


def _codes(x, extra):
    """Hash strings as integers: one column per tree, the first bit the highest."""
    import numpy as np

    wide, planes, weights = np.column_stack([x, extra]), _planes(x.shape[1]), 1 << np.arange(DEPTH - 1, -1, -1)
    out = np.empty((len(x), TREES), dtype=np.int64)
    for at in range(0, len(x), HASH_ROWS):
        bits = wide[at:at + HASH_ROWS] @ planes > 0
        out[at:at + HASH_ROWS] = bits.reshape(-1, TREES, DEPTH).astype(np.int64) @ weights
    return out


def ranges(codes, queries):
    """Per level (0 to DEPTH), tree and query: where the sorted array holds the query's prefix."""
    import numpy as np

    lo = np.empty((DEPTH + 1, TREES, len(queries)), dtype=np.int32)
    hi = np.empty_like(lo)
    for t in range(TREES):
        for level in range(DEPTH + 1):
            prefix = queries[:, t] >> (DEPTH - level) << (DEPTH - level)
            lo[level, t] = np.searchsorted(codes[t], prefix)
            hi[level, t] = np.searchsorted(codes[t], prefix + (1 << (DEPTH - level)))
    return lo, hi


def candidates(order, lo, hi, want: int):
    """Positions that one query meets: all under the longest common level that covers ``want``.

    ``order``: per tree the positions in the order of their hash strings; ``lo``/``hi``: the query's ``ranges``.
    """
    import numpy as np

    level = DEPTH
    while level and (hi[level] - lo[level]).sum() < want:  # even without overlap too few: ascend
        level -= 1
    while True:
        seen = np.zeros(order.shape[1], dtype=bool)
        for t in range(TREES):
            seen[order[t, lo[level, t]:hi[level, t]]] = True
        if not level or np.count_nonzero(seen) >= want:
            return np.flatnonzero(seen)
        level -= 1


def _valid(rows: DataFrame, ids: str, vectors: str) -> DataFrame:
    whole = F.col(vectors).cast("array<double>")
    good = rows.select(F.col(ids).cast("long").alias("vec_id"), whole.alias("v")).where(
        "vec_id is not null and v is not null and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(v, x -> x <> 0)")
    return good.groupBy("vec_id").agg(F.min("v").alias("v"))


def search(queries: DataFrame, rows: DataFrame, nearest: int = NEAREST, ids: str = "vec_id", vectors: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest found of each query, the query's own row left out."""
    import numpy as np
    import pyarrow as pa

    prepare(rows.sparkSession)
    valid = cut(_valid(rows, ids, vectors))
    empty = valid.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lengths = valid.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("m")).orderBy(F.desc("n"), F.desc("dim")).first()
    if lengths is None:
        return empty
    dim, n, largest = int(lengths.dim), int(lengths.n), float(lengths.m)
    valid = valid.where(F.size("v") == dim)
    asked = _valid(queries, ids, vectors).where(F.size("v") == dim)
    shards = max(1, -(-n // SHARD_ROWS))
    step = max(1, min(BLOCK_ROWS, PIECE_BYTES // (8 * dim)))  # vectors of a piece, queries of a block
    piece = "kind int, seq int, ids binary, data binary"

    def build(pdf):  # one shard: its vectors, and the sorted array of each tree, in pieces
        pdf = pdf.sort_values("vec_id")
        ids_, x = pdf["vec_id"].to_numpy("<i8"), np.array(pdf["v"].tolist()).astype("<f8")
        codes = _codes(x, np.sqrt(np.maximum(0.0, largest - (x * x).sum(axis=1)))).T
        order = np.argsort(codes, axis=1, kind="stable")
        rows_ = [(VECTORS, k, ids_[at:at + step].tobytes(), x[at:at + step].tobytes()) for k, at in enumerate(range(0, len(x), step))]
        rows_ += [(TREE, t, order[t].astype("<i4").tobytes(), codes[t][order[t]].astype("<i8").tobytes()) for t in range(TREES)]
        out = __import__("pandas").DataFrame(rows_, columns=["kind", "seq", "ids", "data"])
        out.insert(0, "shard", int(pdf["shard"].iloc[0]))
        return out

    index = (valid.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")).groupBy("shard")
             .applyInPandas(build, f"shard int, {piece}"))

    def block(pdf):
        x = np.array(pdf["v"].tolist()).astype("<f8")
        return __import__("pandas").DataFrame({"kind": [QUERIES], "seq": [int(pdf["block"].iloc[0])], "ids": [pdf["vec_id"].to_numpy("<i8").tobytes()], "data": [x.tobytes()]})

    n_blocks = max(1, -(-asked.count() // step))
    blocks = (asked.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(n_blocks)).cast("int")).groupBy("block")
              .applyInPandas(block, piece))
    # the stated query set against all rows, in blocks: each block goes to each shard once, and the blocks of a
    # shard are dealt to as many tasks as keep the cores busy; only those read the shard anew
    parts = min(n_blocks, int(-(-TASKS_PER_CORE * valid.sparkSession.sparkContext.defaultParallelism // shards)))
    to_all = lambda df, name, count: df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    names = ["shard", "part", "kind", "seq", "ids", "data"]
    sent = to_all(blocks.withColumn("part", F.pmod("seq", F.lit(parts)).cast("int")), "shard", shards).select(*names)
    met = (to_all(index, "part", parts).select(*names).unionByName(sent)
           .repartitionById(shards * parts, F.col("shard") * parts + F.col("part")).sortWithinPartitions("shard", "part", "kind", "seq"))

    def run(batches):
        key, held, shard = None, {}, None
        for b in batches:
            for own, kind, i, d in zip(zip(b["shard"].to_pylist(), b["part"].to_pylist()), b["kind"].to_pylist(), b["ids"], b["data"]):
                if own != key:
                    key, held, shard = own, {VECTORS: [], TREE: []}, None
                if kind != QUERIES:
                    held[kind].append((i.as_py(), d.as_py()))
                    continue
                if shard is None:
                    if not held[VECTORS]:  # no vector fell into this shard
                        continue
                    shard = [np.concatenate([np.frombuffer(p[0], "<i8") for p in held[VECTORS]]),
                             np.concatenate([np.frombuffer(p[1], "<f8") for p in held[VECTORS]]).reshape(-1, dim),
                             np.stack([np.frombuffer(p[0], "<i4") for p in held[TREE]]), np.stack([np.frombuffer(p[1], "<i8") for p in held[TREE]])]
                    held = {VECTORS: [], TREE: []}
                yield answer(*shard, np.frombuffer(i.as_py(), "<i8"), np.frombuffer(d.as_py(), "<f8").reshape(-1, dim))

    def answer(ids_, x, order, codes, qid, q):
        lo, hi = ranges(codes, _codes(q, np.zeros(len(q))))
        out_q, out_v, out_s = [], [], []
        for i in range(len(q)):
            near = candidates(order, lo[:, :, i], hi[:, :, i], max(int(np.ceil(SHARE * len(ids_))), nearest) + 1)
            near = near[ids_[near] != qid[i]]
            if len(near) > nearest:  # what may tie with the last stays, the merge decides
                rough = x[near] @ q[i]
                last = np.partition(rough, len(rough) - nearest)[len(rough) - nearest]
                near = near[rough >= last - 1e-9 * max(1.0, abs(last))]
            score = (x[near] * q[i]).sum(axis=1)  # summed alike for every row, so equal vectors tie
            out_q.append(np.full(len(near), qid[i]))
            out_v.append(ids_[near])
            out_s.append(score)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (out_q, out_v, out_s)], names=["query_id", "vec_id", "score"])

    found = met.mapInArrow(run, "query_id bigint, vec_id bigint, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= nearest)
            .select("query_id", "rank", "vec_id", "score"))
