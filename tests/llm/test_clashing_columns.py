"""Columns of documents may have any names, and the row that stays of several is defined (operators 1 and 8)."""

from pyspark.sql import functions as F

from netvigil.llm import line_dedup, simhash

A = "the quick brown fox jumps over a lazy dog near the river"


def test_near_dedup_keeps_columns_of_any_name_and_a_defined_row(spark):
    names = ["_keep_id", "_keep_fp", "text_key", "fp", "root", "key", "a.b"]
    rows = [(5, A.upper()), (5, A), (9, A), (None, A), (None, None), (3, ""), (2, "a letter without a stamp came back to the old post office")]
    docs = spark.createDataFrame([(i, t, *[k] * len(names)) for k, (i, t) in enumerate(rows)], "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names))
    want = min([A, A.upper()], key=lambda t: spark.range(1).select(F.xxhash64(F.lit(t))).first()[0])
    for part in (1, 5):
        out = simhash.near_dedup(docs.repartition(part))
        assert out.columns == docs.columns
        assert sorted((r.doc_id, r.text) for r in out.collect()) == sorted([(5, want), (3, ""), (2, rows[6][1])])
    assert simhash.near_dedup(docs.limit(0)).count() == 0


def test_dedup_lines_keeps_columns_of_any_name(spark):
    names = ["_gone", "_gone_id", "_gone_key", "_parts", "place", "kept", "pos", "a.b"]
    rows = [(1, f"{A}\nonly here"), (2, f"nothing else\n{A}"), (3, None), (4, "")]
    docs = spark.createDataFrame([(i, t, *[i] * len(names)) for i, t in rows], "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names))
    out = line_dedup.dedup_lines(docs)
    assert out.columns == docs.columns
    assert {r.doc_id: (r.text, r["_gone"], r["a.b"]) for r in out.collect()} == {
        1: (f"{A}\nonly here", 1, 1), 2: ("nothing else", 2, 2), 3: (None, 3, 3), 4: ("", 4, 4)}
