"""Ids against the untouched tokenizer, ledgers with old rule versions, a fit that does not hang on the partitioning,
windows that are similar whatever their fingerprints' distance."""

import random

import numpy as np
import pytest

from netvigil.llm import decontaminate, packing, queries, secrets, toxicity
from netvigil.session import checkpoint_path

SF = "/root/testdata/sf0.001"


def test_ids_are_the_untouched_tokenizer_s():
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path(packing.TOKENIZER)
    tok, rng = Tokenizer.from_file(path), random.Random(1)
    odd = ["İ", "́", "̧", "é", "E", "ß", "Σ", "ς", "한", "ᅡ", "ᆨ", "ा", "’", "🙂", "<|endoftext|>", "<|", "ENDOFTEXT|>", " ", "\n",
           "12", "'S", "'ll", "Ǆ", "ﬁ", "Å", "a", "the", "\0", "\x85", " ", "Ⱥ", "K", "\U00016eb2"]
    texts = ["".join(rng.choice(odd) for _ in range(rng.randrange(1, 9))) for _ in range(4000)]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 0x250), rng.randrange(0xd7ff), rng.randrange(0xe000, 0x1ffff)])) for _ in range(8)) for _ in range(4000)]
    texts += ["".join(chr(rng.randrange(256)) for _ in range(12)) for _ in range(4000)]
    got = [np.frombuffer(g, "<u4").tolist() for g in packing.token_bytes(texts, path)]
    assert got == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_findings_of_older_rule_versions_do_not_count(spark):
    docs = spark.createDataFrame([(1, "password: hunter2hunter2"), (2, "plain")], "doc_id long, text string")
    old = secrets.BASE
    new = (secrets.Rule("assign", 2, old[0].pattern, old[0].least, old[0].group), *old[1:])
    ledger = secrets.scan(docs, None, old).checkpoint()
    assert sorted(map(tuple, secrets.digest(docs, ledger, new).collect())) == sorted(map(tuple, secrets.digest(docs, None, new).collect()))


def test_stored_ledger_scans_each_pair_once(spark):
    docs = spark.createDataFrame([(1, "password: hunter2hunter2"), (2, "token=abcdefgh12 " + "0af" * 12), (3, None), (4, "token=abcdefgh12 " + "0af" * 12)], "doc_id long, text string")
    path = checkpoint_path(spark, f"ledger-test-{random.random()}")
    first = secrets.record(docs.where("doc_id < 3"), path, secrets.BASE)
    assert first.count() == 2
    ledger = secrets.record(docs, path)
    pairs = [(r["blob"], t) for r in ledger.collect() for t in r["scanned"]]
    assert len(pairs) == len(set(pairs)) == 3 * len(secrets.RULES)
    n = ledger.count()
    assert secrets.record(docs, path).count() == n
    assert sorted(map(tuple, secrets.digest(docs, ledger).collect())) == sorted(map(tuple, secrets.digest(docs).collect()))


def test_query_equals_one_full_scan(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    assert sorted(map(tuple, queries.op7_secret_ledger(spark, SF).collect())) == sorted(map(tuple, secrets.digest(docs).collect()))


def test_fit_does_not_hang_on_the_partitioning(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "toxic")
    fits = [toxicity.fit(d, labels) for d in (docs, docs.repartition(7), docs.orderBy("text"), docs.unionByName(docs.where("doc_id % 2 = 0")))]
    assert len(fits[0].weights) > 5 and fits[0].curve is not None
    assert all(f.weights == fits[0].weights and f.curve == pytest.approx(fits[0].curve) for f in fits[1:])


def test_sample_is_bounded_by_documents(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "FIT_TOXIC", 3)
    monkeypatch.setattr(toxicity, "FIT_CLEAN", 5)
    docs = spark.createDataFrame([(k % 40, f"text {k}") for k in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, toxic int")
    rows = toxicity._sample(docs, labels, "toxic").collect()
    assert sorted(r["label"] for r in rows) == [0] * 5 + [1] * 3


def test_similar_windows_of_repeated_words_are_found(spark):
    items = spark.createDataFrame([(1, " ".join(["ab", "cd"] * 7)[:-3])], "item_id long, text string")
    docs = spark.createDataFrame([(1, " ".join(["cd", "ab"] * 6) + " cd")], "doc_id long, text string")
    got = decontaminate.contaminated(docs, items).collect()
    assert [(r["doc_id"], r["item_id"], r["similarity"]) for r in got] == [(1, 1, pytest.approx(0.8))]


def test_steady_bits_lose_no_window(spark):
    """Random items over few words and documents with edited copies: all windows against the definition."""
    rng = random.Random(4)
    words = ["ab", "cd", "ef"]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(6, 22)))) for k in range(25)]
    docs = []
    for k in range(60):
        body = rng.choice(items)[1].split()
        for _ in range(rng.randrange(3)):
            body[rng.randrange(len(body))] = rng.choice(words)
        docs.append((k, " ".join(body[rng.randrange(2):] + [rng.choice(words) for _ in range(rng.randrange(4))])))

    def bag(w, k):
        out = {}
        for i in range(len(w) - k + 1):
            out[tuple(w[i:i + k])] = out.get(tuple(w[i:i + k]), 0) + 1
        return out

    want = {}
    for d, text in docs:
        for i, item in items:
            t, w = item.split(), text.split()
            k, width = min(5, len(t)), min(len(t), len(w))
            if width < k:
                continue
            best = 0
            b = bag(t, k)
            for s in range(len(w) - width + 1):
                a = bag(w[s:s + width], k)
                both = sum(min(n, b.get(x, 0)) for x, n in a.items())
                best = max(best, both / (sum(a.values()) + sum(b.values()) - both))
            if best >= 0.8 - 1e-9:
                want[d, i] = best
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]): pytest.approx(r["similarity"]) for r in got.collect()} == want
    assert len(want) > 15
