"""A doc_id on rows with different texts does not merge their components (pipeline, operator 8)."""

from netvigil.llm import simhash


def test_repeated_ids_do_not_drop_other_components(spark):
    a, b, c = ("the quick brown fox jumps over a lazy dog near the river", "seven grey boats lay still at their moorings until noon",
               "a letter without a stamp came back to the old post office")
    rows = [(5, a), (7, a), (5, b), (9, b), (0, c), (0, a.upper() + " again and again"), (None, b), (None, "only this row has no number at all")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.text, r.doc_id) for r in simhash.near_dedup(docs).collect())
    assert got == sorted([(a, 5), (b, 5), (c, 0), (a.upper() + " again and again", 0), ("only this row has no number at all", None)], key=lambda r: r[0])
