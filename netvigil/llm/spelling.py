"""Spelling variant grouping with a bit-sliced position index (operator 12).

Words are counted over the whole corpus.  Two words are near if one inserted, deleted or
replaced code point turns one into the other; a word's form is its near word of largest
count where that count is at least twice its own, and its root is where the forms lead.

*Where near words can meet.*  Let w have a code points and v a or a + 1.  If they are near
and their common prefix ends at c, all of w but its code point c stands in v: w and v share
their first c and their last a - 1 - c code points.  The positions 0 to a - 1 are cut into
intervals; for each interval [lo, hi) a word goes to the bucket named by its first lo and
last a - hi code points, and a near pair meets in exactly one bucket, that of the interval
holding c.  Two halves do to begin with.  A bucket that grows beyond ``BUCKET`` words is
refined: its interval is halved again and its words go to the longer names.  An interval of
one position is the end: its bucket holds w's that differ in one code point and v's that
differ in two, a number bounded by the alphabet alone.  So no bucket is ever compared with
itself at large, none is cut off, and no pair is found twice.

*Inside a shard of buckets* a bitset over all its words stands for each position and letter.
For all words of a letters at once, position by position, the words without an error so far,
with one replaced letter and with one more letter (positions shifted by one) are tracked by
the recurrences

    same  <- same & at[j, w_j]
    error  = same & ~at[j, w_j]                     (only for j inside the bucket's interval)
    other <- (other & at[j, w_j]) | error
    extra <- (extra | error) & at[j + 1, w_j]

64 words at a time.  A word with one letter less is the same pair seen from the other side.

Defined results: null and empty texts have no words; a null doc_id counts as an empty
string; rows that repeat are counted each; ties in n go to the smaller word in code-point
order; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netvigil.llm.common import Scratch, bounded, cut, fold_ascii, prepare

LEAST_LENGTH, LEAST_COUNT, TIMES = 5, 3, 2
EVERY = 97
#: Words in a bucket before its interval is halved, and words in a shard of buckets (about 10 MB of bitsets).
BUCKET = 4096
SHARD = 2048


def runs(docs: DataFrame) -> DataFrame:
    """(doc_id, run): every letter run of every text, A-Z folded."""
    found = F.split(fold_ascii(F.col("text")), "[^a-zÀ-ÿ]+")
    return docs.where("text is not null").select("doc_id", F.explode(found).alias("run")).where("run <> ''")


def damaged(rows: DataFrame) -> DataFrame:
    """Every run as a word; where 97 divides crc32("doc_id:run"), a code point is left out."""
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    return (rows.withColumn("h", h)
            .select(F.when(F.col("h") % EVERY != 0, F.col("run"))
                    .otherwise(F.concat(F.substring("run", F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))).alias("word")))


def vocabulary(words: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): the words that are long and frequent enough."""
    return (words.where(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") >= least_count))


_NAME = ["a", "lo", "hi", "head", "tail"]


def _named(rows: DataFrame) -> DataFrame:
    """The bucket's name for the interval [lo, hi)."""
    keep = F.col("a") - F.col("hi")
    tail = F.when(keep > 0, F.substring("word", F.length("word") - keep + 1, keep)).otherwise("")
    return rows.select("word", "n", "a", "lo", "hi", F.substring("word", F.lit(1), F.col("lo")).alias("head"), tail.alias("tail"))


def _halved(rows: DataFrame) -> DataFrame:
    mid = F.ceil((F.col("lo") + F.col("hi")) / 2).cast("int")
    halves = F.array(F.struct(F.col("lo").alias("lo"), mid.alias("hi")), F.struct(mid.alias("lo"), F.col("hi").alias("hi")))
    return _named(rows.select("word", "n", "a", F.explode(halves).alias("half")).select("word", "n", "a", "half.lo", "half.hi"))


def buckets(vocab: DataFrame, held: Scratch, bucket: int = BUCKET) -> DataFrame:
    """(word, n, a, lo, hi, head, tail): each word in all its buckets, none over ``bucket`` words that can be refined."""
    length = F.length("word")
    classes = F.when(length > LEAST_LENGTH, F.array(length, length - 1)).otherwise(F.array(length))
    todo = _halved(vocab.select("word", "n", F.explode(classes).alias("a")).withColumns({"lo": F.lit(0), "hi": F.col("a")}))
    ready = None
    while True:
        todo = held.cut(todo)
        hot = held.cut(todo.groupBy(*_NAME).agg(F.count(F.lit(1)).alias("size")).where((F.col("size") > bucket) & (F.col("hi") - F.col("lo") > 1)))
        if hot.isEmpty():
            return todo if ready is None else ready.unionByName(todo)
        marked = todo.join(bounded(hot), _NAME, "left")
        kept = marked.where("size is null").drop("size")
        ready = kept if ready is None else ready.unionByName(kept)
        todo = _halved(marked.where("size is not null"))


def near_in_shard(words: list[str], n, a: int, lo, hi, bucket):
    """Index pairs (i, k) of near words of one bucket, where word i has ``a`` letters and k has a or a + 1."""
    import numpy as np

    size = len(words)
    length = np.array([len(w) for w in words])
    wide = -(-size // 64)
    letters = np.zeros((wide * 64, a + 2), np.uint8)  # code points are below 256; 0 stands behind a word
    flat = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
    inside = np.arange(a + 1) < length[:, None]
    letters[:size, :a + 1][inside] = flat
    used = np.unique(flat)
    code_of = np.zeros(256, np.int64)
    code_of[used] = np.arange(len(used))

    def bits(rows):
        return np.packbits(rows, axis=1, bitorder="little").view(np.uint64)

    def at(j):
        return bits(letters[:, j][None, :] == used[:, None])

    def pad(flags):
        out = np.zeros((1, wide * 64), bool)
        out[0, :size] = flags
        return bits(out)

    asks = np.flatnonzero(length == a)
    names, place = np.unique(bucket, return_inverse=True)
    members = np.zeros((len(names), wide * 64), bool)
    members[place, np.arange(size)] = True
    same = bits(members)[place[asks]]
    other, extra = np.zeros_like(same), np.zeros_like(same)
    here = at(0)
    for j in range(a):
        behind = at(j + 1)
        code = code_of[letters[asks, j]]
        now = here[code]
        allowed = np.where((lo[asks] <= j) & (j < hi[asks]), np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0))
        error = same & ~now
        error &= allowed[:, None]
        same &= now
        other &= now
        other |= error
        extra |= error
        extra &= behind[code]
        here = behind
    same &= np.where(hi[asks] == a, np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0))[:, None]  # one more letter at the end
    found = (other & pad(length == a)) | ((extra | same) & pad(length == a + 1))
    row, col = np.nonzero(found)
    one = np.unpackbits(found[row, col].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    k, bit = np.nonzero(one)
    return asks[row[k]], col[k] * 64 + bit


def _shard(table):
    """One shard to (word, n_near, form_n, form): counts and the best near word of what meets here."""
    import numpy as np
    import pyarrow as pa

    a = table.column("a")[0].as_py()
    words, n = table.column("word").to_pylist(), table.column("n").to_numpy()
    lo, hi = table.column("lo").to_numpy(), table.column("hi").to_numpy()
    names = {}
    bucket = np.array([names.setdefault(x, len(names)) for x in zip(lo.tolist(), table.column("head").to_pylist(), table.column("tail").to_pylist())])
    length = np.array([len(w) for w in words])
    some = np.bincount(bucket) > 1
    some &= np.bincount(bucket, length == a) > 0
    keep = np.flatnonzero(some[bucket])
    words, n, lo, hi, bucket = [words[k] for k in keep], n[keep], lo[keep], hi[keep], bucket[keep]
    i = k = np.zeros(0, np.int64)
    if len(words):
        i, k = near_in_shard(words, n, a, lo, hi, bucket)
        longer = np.array([len(w) for w in words])[k] > a  # found from the shorter word only
        i, k = np.concatenate([i, k[longer]]), np.concatenate([k, i[longer]])
    rank = np.empty(len(words), np.int64)
    rank[sorted(range(len(words)), key=lambda x: (-n[x], words[x]))] = np.arange(len(words))
    order = np.lexsort((rank[k], i))
    i, k = i[order], k[order]
    first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else i
    counts = np.diff(np.r_[first, len(i)])
    return pa.table({"word": pa.array([words[x] for x in i[first]], pa.string()), "n_near": pa.array(counts, pa.int64()),
                     "form_n": pa.array(n[k[first]], pa.int64()), "form": pa.array([words[x] for x in k[first]], pa.string())})


def near_words(vocab: DataFrame, held: Scratch, bucket: int = BUCKET, shard: int = SHARD) -> DataFrame:
    """(word, n_near, form_n, form): how many near words a word has, and the one of largest n."""
    met = held.cut(buckets(vocab, held, bucket))
    shards = met.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / shard).alias("shards"))
    dealt = met.join(bounded(shards), "a").withColumn("shard", F.pmod(F.xxhash64("lo", "head", "tail"), "shards"))
    local = dealt.groupBy("a", "shard").applyInArrow(_shard, "word string, n_near bigint, form_n bigint, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("m"), "form")).alias("best")
    return local.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("best.m")).alias("form_n"), "best.form")


def roots(forms: DataFrame, held: Scratch) -> DataFrame:
    """(word, root) for the rows of (word, form): pointers are doubled until all stand still (counts double along a
    chain of forms, so a logarithm of a logarithm of the largest count rounds)."""
    links = held.cut(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("top"))
        moved = held.cut(links.join(onward, "root", "left").select("word", F.coalesce("top", "root").alias("root"), F.col("top").isNotNull().alias("moved")))
        if moved.where("moved").isEmpty():
            return moved.select("word", "root")
        links = moved.select("word", "root")


def group_variants(docs: DataFrame, damage: bool = True, bucket: int = BUCKET, shard: int = SHARD) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of the corpus."""
    prepare(docs.sparkSession)
    held = Scratch(docs.sparkSession)
    rows = runs(docs.select("doc_id", "text"))
    vocab = held.cut(vocabulary(damaged(rows) if damage else rows.select(F.col("run").alias("word"))))
    near = near_words(vocab, held, bucket, shard)
    enough = F.col("form_n") >= TIMES * F.col("n")
    judged = held.cut(vocab.join(near, "word", "left").select(
        "word", F.when(enough, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(enough, F.col("form_n")).alias("form_n")))
    top = roots(judged.where("form is not null"), held)
    out = cut(judged.join(top, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
    held.drop()
    return out
