"""Operator 13 against the sentencepiece library itself."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from netvigil.llm import pieces as P
from netvigil.llm import queries

public = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public.path(P.MODEL))


def texts_of(seed, names, count):
    rng = random.Random(seed)

    def one():
        n = rng.randrange(1, 30)
        return rng.choice([
            lambda: " " * rng.randrange(70) + rng.choice(names) + " " * rng.randrange(40),
            lambda: "".join(rng.choice(names) for _ in range(n)),
            lambda: "".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xd7ff), rng.randrange(0xe000, 0x10ffff), 0x2581, 0])) for _ in range(n)),
            lambda: "".join(rng.choice(["of", "Tim", "reason", "feat", "\n", "in", "re", "son"]) for _ in range(n)),
            lambda: "".join(chr(rng.randrange(97, 123)) for _ in range(4 * n)),
            lambda: rng.choice("a=-_ \n/#*e") * rng.randrange(200) + rng.choice("ab ")])()

    return [one() for _ in range(count)]


def decoded(lists):
    flat = np.array([i for of in lists for i in of], np.int32)
    return P.decode_ids(flat, np.cumsum([len(of) for of in lists]).tolist(), public.path(P.MODEL))


def test_ids_and_text_are_the_library_s(library):
    names = [library.id_to_piece(i).replace("▁", " ") for i in range(259, library.get_piece_size())]
    texts = ["", " ", "  ", "▁", "a\r\nb\tc", "<s>hi</s><0x41><unk>", "é́ İ 🙂", *texts_of(1, names, 3000)]
    got = [np.frombuffer(g, np.int32).tolist() for g in P.encode_texts(texts, public.path(P.MODEL))]
    assert got == library.encode(texts)
    assert decoded(got) == [library.decode(g) for g in got]


def test_any_ids_decode_like_the_library(library):
    rng = random.Random(2)
    ids = [[rng.choice([rng.randrange(32_000), rng.randrange(260)]) for _ in range(rng.randrange(8))] for _ in range(3000)]
    assert decoded(ids) == [library.decode(i) for i in ids]


def test_long_runs(library):
    rng = random.Random(3)
    texts = [" " * 50_000, "a" * 50_000, "".join(chr(rng.randrange(97, 123)) for _ in range(100_000)), "ab" * 20_000 + "日本" * 20_000]
    assert [np.frombuffer(g, np.int32).tolist() for g in P.encode_texts(texts, public.path(P.MODEL))] == library.encode(texts)


def test_query_over_a_whole_table(spark, library):
    d = "/root/testdata/sf0.001"
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op13_sentencepiece(spark, d).collect()}
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for doc, text in docs:
        ids = library.encode(text or "")
        assert got[doc] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())


def test_nulls_repeats_empty_table_and_clashing_columns(spark):
    rows = [(1, None), (1, ""), (None, "x"), (2, "same text"), (2, "same text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"ids": F.lit("i"), "tokens": F.lit(0)})
    got = sorted((r["doc_id"] or 0, r["n_tokens"]) for r in P.digest(P.decode(P.encode(docs))).collect())
    assert got == [(0, 1), (1, 0), (1, 0), (2, 2), (2, 2)]
    assert P.digest(P.decode(P.encode(docs.limit(0)))).count() == 0
    ids = spark.createDataFrame([(1, [261]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert [r["text"] for r in P.decode(ids).sort("doc_id").collect()] == ["t", "", ""]
