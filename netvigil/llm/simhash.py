"""SimHash near-dedup by meet-in-the-middle ball hashing (operator 8).

A text's fingerprint is the bitwise majority of the XXH64 values of its word
shingles.  Two fingerprints at distance 2r share at least one value within
distance r of both, so every fingerprint emits all its variants within half the
radius; one shuffle on the variant brings each linked pair together.  All
fingerprints that emit one variant are within the radius of each other, so a star
around the smallest of them keeps every link's connectivity without pairs; a
variant has at most 1 + 64 emitters (half radius 1), which bounds the group.

Defined results: a null text counts as empty; a text without words has
fingerprint zero, which links like any other; rows that repeat a doc_id or a text
each get a row; a component's id is its smallest non-null doc_id (null if all are
null); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import uuid
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netvigil.llm.common import components, cut, prepare, tasks

SHINGLE_WORDS = 3
MAX_BITS = 2
SEED = 42


def text_fingerprint(text: str | None, size: int = SHINGLE_WORDS) -> int:
    """The 64-bit fingerprint of one whole text as a signed integer."""
    import numpy as np
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII rules only
    if not words:
        return 0
    digest, join = xxhash.xxh64_intdigest, b" ".join
    hashes = np.array([digest(join(words[i:i + size]), SEED)
                       for i in range(max(1, len(words) - size + 1))], dtype="<u8")
    bits = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 8192):  # bounded memory for very long texts
        bits += np.unpackbits(hashes[at:at + 8192].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(bits * 2 > len(hashes)).view("<i8")[0])


def with_fingerprint(docs: DataFrame, keys: list[str], text: str = "text",
                     size: int = SHINGLE_WORDS, name: str = "fp") -> DataFrame:
    """``keys`` of ``docs`` plus the fingerprint of ``text`` (long)."""
    import pyarrow as pa

    src = docs.select(*keys, F.col(text).alias("_simhash_text"))
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in docs.select(*keys).schema)}, `{name}` bigint"

    def run(batches):
        for b in batches:
            fps = [text_fingerprint(t, size) for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fps, pa.int64())],
                                             names=[*keys, name])

    return src.mapInArrow(run, schema)


def ball_links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b) links that connect exactly the fingerprints within ``max_bits`` (even).

    ``fps``: one column of distinct fingerprints.
    """
    if max_bits % 2 or not 0 <= max_bits <= 6:
        raise ValueError("max_bits must be 0, 2, 4 or 6")
    fp = fps.columns[0]
    masks = [sum(1 << i for i in pick) for k in range(max_bits // 2 + 1) for pick in combinations(range(64), k)]
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    dealt = fps.repartition(tasks(fps.sparkSession), fp)  # small rows that each become 65
    variants = (dealt.select(F.col(fp).alias("fp"),
                           F.explode(F.array(*[F.lit(m).cast("long") for m in signed])).alias("mask"))
                .select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant")))
    met = (variants.groupBy("variant").agg(F.min("fp").alias("a"), F.collect_list("fp").alias("members"))
           .where(F.size("members") > 1))
    return (met.select("a", F.explode("members").alias("b")).where("a <> b").distinct()
            .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits))


def _rooted(docs: DataFrame, size: int, max_bits: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_key, fp) of every row, and (fp, first, root): one fingerprint stands for each component."""
    prepare(docs.sparkSession)
    hashed = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    marked = cut(with_fingerprint(hashed, ["doc_id", "text_key"], size=size))
    # the row that stands for a fingerprint: smallest (doc_id, hash of the text), null ids last
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    fps = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("first"), F.min(order).alias("row")))
    comp = components(ball_links(fps.select("fp"), max_bits))
    return marked, (fps.join(comp.withColumnRenamed("node", "fp"), "fp", "left")
                    .select("fp", "first", "row", F.coalesce("root", "fp").alias("root")))


def link_documents(docs: DataFrame, size: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs`` (doc_id, text, ...)."""
    marked, rooted = _rooted(docs, size, max_bits)
    # the smallest doc_id of each root, combined before the shuffle
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = rooted.join(least, "root").select("fp", "component_id")
    return marked.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def near_dedup(docs: DataFrame, size: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of each component of near-duplicates, with all columns of ``docs``.

    The row with the smallest (doc_id, hash of the text) stays, null ids last; of rows
    that repeat both, one stays.  Columns of ``docs`` may have any names.
    """
    columns = docs.columns
    own = uuid.uuid4().hex  # names that no column of docs has
    key, keep_id, keep_key = f"key_{own}", f"id_{own}", f"kept_{own}"
    # components are told apart by their root: a doc_id may stand on rows of several, or be null
    _, rooted = _rooted(docs, size, max_bits)
    best = rooted.groupBy("root").agg(F.min("row").alias("m"))
    keep = cut(best.select(F.col("m.doc_id").alias(keep_id), F.col("m.text_key").alias(keep_key)).distinct())
    marked = docs.withColumn(key, F.xxhash64("text"))  # rows are found by it again, without a second fingerprint
    kept = marked.join(keep, F.col("doc_id").eqNullSafe(F.col(keep_id)) & (F.col(key) == F.col(keep_key)), "left_semi")
    return kept.dropDuplicates(["doc_id", key]).select(*[F.col(f"`{c}`") for c in columns])
