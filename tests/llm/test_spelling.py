"""Operator 12 against plain Python: all pairs of a small vocabulary, forms followed one by one."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from netvigil.llm import spelling as S
from netvigil.llm.common import Scratch


def near(w, v):
    if len(w) == len(v):
        return sum(a != b for a, b in zip(w, v)) == 1
    if len(w) > len(v):
        w, v = v, w
    return len(v) == len(w) + 1 and any(v[:i] + v[i + 1:] == w for i in range(len(v)))


def variants(w):
    """All words that one left-out code point makes of w: words near each other share one, or one is the other's."""
    return {w[:i] + w[i + 1:] for i in range(len(w))}


def plain(docs):
    n = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            n[run[:h % len(run)] + run[h % len(run) + 1:] if h % 97 == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    met = {}
    for w in n:
        for v in {w, *variants(w)}:
            met.setdefault(v, set()).add(w)
    close = {w: {x for v in {w, *variants(w)} for x in met[v] if near(w, x)} for w in n}
    form = {}
    for w, found in close.items():
        best = min(found, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], len(close[w]), n[form[w]] if form[w] else None)
    return out


def run(spark, docs, **how):
    df = docs if hasattr(docs, "columns") else spark.createDataFrame(docs, "doc_id long, text string")
    rows = S.group_variants(df, **how).collect()
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(got) == len(rows)
    return got


def corpus(seed, words, docs):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abné") for _ in range(rng.randrange(4, 9))) for _ in range(words)]
    weights = [1 / (k + 1) for k in range(words)]

    def text():
        out = []
        for w in rng.choices(stems, weights, k=60):
            if rng.random() < 0.15:
                i = rng.randrange(len(w))
                w = rng.choice([w[:i] + w[i + 1:], w[:i] + rng.choice("abÉ÷") + w[i:], w[:i] + "b" + w[i + 1:]])
            out.append(w.upper() if rng.random() < 0.1 else w)
        return rng.choice([" ", ", ", "1"]).join(out)

    return [(k, text()) for k in range(docs)]


@pytest.mark.parametrize("seed,bucket,shard", [(1, 4096, 2048), (2, 8, 16), (3, 2, 1)])
def test_like_plain_python(spark, seed, bucket, shard):
    docs = corpus(seed, 150, 120)
    want = plain(docs)
    assert len(want) > 150 and sum(x[0] is not None for x in want.values()) > 20
    assert run(spark, docs, bucket=bucket, shard=shard) == want


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    assert run(spark, docs) == plain([tuple(r) for r in docs.collect()])


def test_hot_bucket_is_refined_and_no_pair_found_twice(spark):
    words = [f"common{a}{b}{c}" for a in "abcdef" for b in "ghijkl" for c in "mnopqr"]
    vocab = spark.createDataFrame([(w, 3 + k) for k, w in enumerate(words)], "word string, n long")
    held = Scratch(spark)
    met = S.buckets(vocab, held, bucket=20).groupBy(*S._NAME).count()
    assert met.where("count > 20 and hi - lo > 1").isEmpty()
    got = {r["word"]: r["n_near"] for r in S.near_words(vocab, held, bucket=20, shard=64).collect()}
    assert got == {w: 15 for w in words}
    held.drop()


def test_chain_of_forms_reaches_its_last(spark):
    chain = ["aaaaa", "aaaab", "aaabb", "aabbb", "abbbb", "bbbbb"]
    docs = [(None, " ".join([w] * (3 * 2 ** k))) for k, w in enumerate(chain)]
    assert run(spark, docs, damage=False)["aaaaa"][:2] == ("aaaab", "bbbbb")


def test_nulls_empty_long_and_clashing_columns(spark):
    long = "ab" * 3000
    rows = [(1, None), (2, ""), (3, f"{long} {long} {long} {long}c {long}c {long}c 12"), (None, "tests tests tests"), (4, "12 !? ××")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("word", "n", "run", "a", "h")})
    assert run(spark, docs) == plain(rows)
    assert run(spark, docs.limit(0)) == {}
