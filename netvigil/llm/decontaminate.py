"""Benchmark decontamination by SimHash of item-sized windows (operator 10, native).

A document is contaminated by a benchmark item if some window of as many words as
the item has is similar to it: weighted Jaccard of their word shingles (weight:
how often a shingle occurs) of ``SIMILARITY`` or more.

1. Anchors.  Every shingle of every whole document is hashed inside code generation
   and looked up among the items' shingles.  A window can only reach the similarity
   if it holds enough shingles of that item, so only windows with that many anchors
   go on; the bound is exact, no window is lost.
2. Each such window gets a SimHash (majority per bit over its shingle hashes), and
   so does the item.  The radius follows from the similarity itself: a similar window
   lacks so many of the item's shingles at most and has so many others, so a bit of the
   item whose majority is larger than that cannot differ.  The item's fingerprint is cut
   into ``BLOCKS`` blocks, of which such steady bits count; a window within the radius
   agrees with the item on the steady bits of every block, so an equi-join on (item,
   value of its blocks) finds all of them and loses none.
3. The exact similarity of each remaining pair decides.

Words are runs of letters and digits, lower-cased, so punctuation and case do not
hide a passage.

Defined results: null or wordless texts and items match nothing; an item of fewer
than ``SHINGLE_WORDS`` words is one shingle; a document shorter than an item is one
window; of equal windows the first counts; items of equal words are reported under
each of their ids; rows that repeat a doc_id count as one document here and are all
removed by ``keep_clean``; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netvigil.llm.common import bounded, cut, prepare

SHINGLE_WORDS = 5
SIMILARITY = 0.8
BLOCKS = 8
EPS = 1e-9


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _shingle(at: Column, k: int) -> Column:
    """Hash of the ``k`` words from position ``at`` of column words."""
    return F.xxhash64(*[F.get(F.col("words"), at + i) for i in range(k)])


def _simhash(shingles: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    """One fingerprint per key: bit b is 1 if set in over half of the hashes ``h``; ``more`` is of n, b0 to b63."""
    ones = [F.sum(F.shiftrightunsigned("h", b).bitwiseAND(F.lit(1).cast("long"))).alias(f"b{b}") for b in range(64)]
    tall = shingles.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *ones)
    fp = F.lit(0).cast("long")
    for b in range(64):
        fp = fp.bitwiseOR(F.when(F.col(f"b{b}") * 2 > F.col("n"), F.shiftleft(F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")))
    return tall.select(*keys, "n", fp.alias("fp"), *more)


def _steady(similarity: float) -> tuple[Column, Column]:
    """Bits of an item (columns n and b0 to b63, its set bits counted) that no similar window can flip: for windows of
    as many shingles, and for shorter ones (of documents shorter than the item).

    A window of w shingles shares I >= s / (1 + s) * (w + n) of them; it lacks n - I of the item's and
    has w - I others.  With c of the item's hashes set, between c - (n - I) and c + (w - I) of its own are.
    """
    share = similarity / (1 + similarity)
    n, ones = F.col("n"), F.array(*[F.col(f"b{b}") for b in range(64)])
    bits = F.array(*[F.lit(1 << b if b < 63 else -1 << 63).cast("long") for b in range(64)])

    def mask(shared: Column, window: Column) -> Column:
        away = n - shared
        steady = lambda c: (2 * (c - away) > n) | (2 * (c + away) <= window)
        kept = F.zip_with(ones, bits, lambda c, bit: F.when(steady(c), bit).otherwise(F.lit(0).cast("long")))
        return F.aggregate(kept, F.lit(0).cast("long"), lambda acc, bit: acc.bitwiseOR(bit))

    least = F.ceil(similarity * n - EPS)  # a window of fewer shingles cannot be similar; all of these are shared
    return mask(F.ceil(2 * share * n - EPS), n), mask(least, least)


def _blocks(fp: str, steady: str) -> Column:
    """The blocks of a fingerprint, of which the steady bits count."""
    width = 64 // BLOCKS
    return F.array(*[F.shiftrightunsigned(F.col(fp).bitwiseAND(F.col(steady)), width * i).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
                     for i in range(BLOCKS)])


def leaks(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, size: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, text_key, item_id, start, n_words, similarity, bits): the best window per document and item.

    ``docs``: doc_id, text; ``items``: item_id, text.  start counts words from 0.
    """
    prepare(docs.sparkSession)
    # items by their words; ids come back at the end
    named = cut(items.select("item_id", words(F.col("text")).alias("words")).where(F.size("words") > 0)
                .withColumn("item", F.xxhash64("words")).distinct())
    distinct = named.select("item", "words").dropDuplicates(["item"]).withColumn("len", F.size("words"))
    sizes = sorted(r.k for r in distinct.select(F.least("len", F.lit(size)).alias("k")).distinct().collect())  # at most ``size`` numbers
    item_shingles = None
    for k in sizes:
        part = (distinct.where(F.least("len", F.lit(size)) == k)
                .select("item", "len", F.lit(k).alias("k"), "words", F.explode(F.sequence(F.lit(0), F.col("len") - k)).alias("q"))
                .select("item", "len", "k", _shingle(F.col("q"), k).alias("h")))
        item_shingles = part if item_shingles is None else item_shingles.unionByName(part)
    if item_shingles is None:
        return (docs.join(named.select("item_id"), F.lit(False))
                .select("doc_id", F.xxhash64("text").alias("text_key"), "item_id", F.lit(0).alias("start"), F.lit(0).alias("n_words"),
                        F.lit(0.0).alias("similarity"), F.lit(0).alias("bits")))
    item_shingles = cut(item_shingles)
    item_bag = cut(item_shingles.groupBy("item", "h").agg(F.count(F.lit(1)).alias("c")))
    full, short = _steady(similarity)
    item_fp = cut(_simhash(item_shingles, ["item"], full.alias("full"), short.alias("short"))
                  .select("item", F.col("n").alias("item_n"), F.col("fp").alias("item_fp"), "full", "short"))
    look_up = cut(item_shingles.distinct())

    keyed = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    split = keyed.select("doc_id", "text_key", words(F.col("text")).alias("words")).withColumn("n", F.size("words"))
    anchors = None
    for k in sizes:
        mine = bounded(look_up.where(F.col("k") == k))
        part = (split.where(F.col("n") >= k)
                .select("doc_id", "text_key", "n", "words", F.explode(F.sequence(F.lit(0), F.col("n") - k)).alias("p"))
                .select("doc_id", "text_key", "n", "p", _shingle(F.col("p"), k).alias("h"))
                .join(mine, "h").select("doc_id", "text_key", "n", "p", "item", "len", "k"))
        anchors = part if anchors is None else anchors.unionByName(part)
    width = F.least("len", "n")
    # J = I / (w + i - I) >= s needs I >= s / (1 + s) * (w + i) shared shingles
    need = F.ceil(F.lit(similarity / (1 + similarity)) * ((width - F.col("k") + 1) + (F.col("len") - F.col("k") + 1)) - EPS)
    starts = F.sequence(F.greatest(F.lit(0), F.col("p") + F.col("k") - width), F.least(F.col("p"), F.col("n") - width))
    windows = cut(anchors.select("doc_id", "text_key", "item", "k", width.alias("w"), need.alias("need"), F.explode(starts).alias("s"))
                  .groupBy("doc_id", "text_key", "item", "k", "w", "need", "s").agg(F.count(F.lit(1)).alias("got"))
                  .where("got >= need").drop("need", "got"))

    hit = windows.select(F.col("doc_id").alias("_d"), F.col("text_key").alias("_t")).distinct()
    texts = (keyed.join(bounded(hit), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_key") == F.col("_t")), "left_semi")
             .dropDuplicates(["doc_id", "text_key"]).select(F.col("doc_id").alias("_d"), F.col("text_key").alias("_t"),
                                                            words(F.col("text")).alias("words")))
    spot = windows.select("doc_id", "text_key", "k", "w", "s").distinct()
    at_spot = spot.join(texts, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_key") == F.col("_t")))
    shingles = None
    for k in sizes:
        part = (at_spot.where(F.col("k") == k)
                .select("doc_id", "text_key", "k", "w", "s", "words", F.explode(F.sequence("s", F.col("s") + F.col("w") - k)).alias("p"))
                .select("doc_id", "text_key", "k", "w", "s", _shingle(F.col("p"), k).alias("h")))
        shingles = part if shingles is None else shingles.unionByName(part)
    shingles = cut(shingles)
    spot_keys = ["doc_id", "text_key", "k", "w", "s"]
    marked = _simhash(shingles, spot_keys)

    def same(left, right):  # null-safe on doc_id
        on = left["doc_id"].eqNullSafe(right["_d"])
        for a in spot_keys[1:]:
            on = on & (left[a] == right[f"_{a}"])
        return on

    marks = marked.select(F.col("doc_id").alias("_d"), *[F.col(a).alias(f"_{a}") for a in spot_keys[1:]], "fp", "n")
    with_fp = windows.join(marks, same(windows, marks)).select(*spot_keys, "item", "fp", "n")
    masks = with_fp.join(bounded(item_fp.select("item", "item_n", "full", "short")), "item").withColumn(
        "steady", F.when(F.col("n") == F.col("item_n"), F.col("full")).otherwise(F.col("short")))
    item_blocks = (item_fp.select("item", "item_fp", F.explode(F.array_distinct(F.array("full", "short"))).alias("steady"))
                   .withColumn("blocks", _blocks("item_fp", "steady")))
    near = cut(masks.withColumn("blocks", _blocks("fp", "steady")).join(bounded(item_blocks), ["item", "steady", "blocks"])
               .withColumn("bits", F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))))
               .select(*spot_keys, "item", "n", "item_n", "bits"))
    bags = shingles.groupBy(*spot_keys, "h").agg(F.count(F.lit(1)).alias("c"))
    bags = bags.select(F.col("doc_id").alias("_d"), *[F.col(a).alias(f"_{a}") for a in spot_keys[1:]], "h", F.col("c").alias("cw"))
    shared = (near.join(bags, same(near, bags)).select(*spot_keys, "item", "n", "item_n", "bits", "h", "cw")
              .join(bounded(item_bag), ["item", "h"])
              .groupBy(*spot_keys, "item", "n", "item_n", "bits").agg(F.sum(F.least("cw", "c")).alias("i")))
    sim = F.col("i") / (F.col("n") + F.col("item_n") - F.col("i"))
    best = (shared.withColumn("similarity", sim).where(F.col("similarity") >= similarity - EPS)
            .groupBy("doc_id", "text_key", "item")
            .agg(F.max(F.struct("similarity", (-F.col("s")).alias("back"), "w", "bits")).alias("m")))
    return (best.join(named.select("item", "item_id"), "item")
            .select("doc_id", "text_key", "item_id", (-F.col("m.back")).alias("start"), F.col("m.w").alias("n_words"),
                    F.col("m.similarity").alias("similarity"), F.col("m.bits").alias("bits")))


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row per document and item: (doc_id, item_id, start, n_words, similarity)."""
    return (leaks(docs, items).groupBy("doc_id", "item_id")
            .agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"), "n_words")).alias("m"))
            .select("doc_id", "item_id", (-F.col("m.back")).cast("long").alias("start"), F.col("m.n_words").cast("long").alias("n_words"),
                    F.col("m.similarity").alias("similarity")))


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` without a leak, with all their columns."""
    bad = cut(leaks(docs, items).select(F.col("doc_id").alias("_leak_id"), F.col("text_key").alias("_leak_text")).distinct())
    on = F.col("doc_id").eqNullSafe(F.col("_leak_id")) & (F.xxhash64(F.col("text")) == F.col("_leak_text"))
    return docs.join(bounded(bad), on, "left_anti")
