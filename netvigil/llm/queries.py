"""Registered queries of the training-data operators: ``fn(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from netvigil.llm import ann_forest, conversations, decontaminate, html_extract, licenses, line_dedup, packing, pieces, pii, secrets, simhash, spelling, toxicity
from netvigil.session import checkpoint_path
from netvigil.sources.tables import read_table


def op1_line_dedup(spark, sf_dir):
    """Every non-blank line of every document with its class (first document and line) and whether it stays."""
    rows = line_dedup.line_classes(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    doc, line = line_dedup.class_of(F.col("class_place"))
    return rows.select("doc_id", F.col("pos").cast("long").alias("line_no"), doc.alias("class_doc_id"), line.alias("class_line_no"), "kept")


def op2_ann_forest(spark, sf_dir):
    """The 20 nearest found for every vec_id divisible by 20, among all other rows."""
    rows = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann_forest.search(rows.where("vec_id % 20 = 0"), rows)


def op3_bin_slack_packing(spark, sf_dir):
    """All documents in sequences of at most 4096 tokens."""
    return packing.pack(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_toxicity(spark, sf_dir):
    """A toxicity score for every document."""
    return toxicity.score_documents(read_table(spark, sf_dir, "documents").select("doc_id", "text"),
                                    read_table(spark, sf_dir, "labels").select("doc_id", "toxic"))


def op5_licenses(spark, sf_dir):
    """The licence of every document, its own or its nearest ancestor directory's."""
    return licenses.scan(licenses.with_path(read_table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")))


def op6_pii_crf(spark, sf_dir):
    """Personal data in every document."""
    return pii.scan(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_secret_ledger(spark, sf_dir):
    """Secrets in every document, joined back to every row from a stored ledger: a first run records the base rules, a second
    one the pairs of blobs and rules that are new then."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    path = checkpoint_path(spark, f"secret-ledger-{uuid.uuid4().hex}")
    secrets.record(docs, path, secrets.BASE)
    return secrets.digest(docs, secrets.record(docs, path))


def op8_simhash_ball(spark, sf_dir):
    """Fingerprint and component of every document."""
    linked = simhash.link_documents(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return linked.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_line_blocks(spark, sf_dir):
    """Main text of every page."""
    return html_extract.extract(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op10_decontaminate(spark, sf_dir):
    """Benchmark passages in every document: the best window per document and item."""
    return decontaminate.contaminated(read_table(spark, sf_dir, "documents").select("doc_id", "text"),
                                      read_table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op11_conversation_repair(spark, sf_dir):
    """Damaged conversations, repaired at least cost."""
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return conversations.digest(conversations.repair(conversations.damage(rows)))


def op12_spelling_variants(spark, sf_dir):
    """Words of all documents, their most frequent near word and where that leads."""
    return spelling.group_variants(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_sentencepiece(spark, sf_dir):
    """Ids and decoded text of every document, as digests."""
    return pieces.digest(pieces.decode(pieces.encode(read_table(spark, sf_dir, "documents").select("doc_id", "text"))))


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_ann_forest, op3_bin_slack_packing, op4_toxicity, op5_licenses,
                                   op6_pii_crf, op7_secret_ledger, op8_simhash_ball, op9_line_blocks, op10_decontaminate,
                                   op11_conversation_repair, op12_spelling_variants, op13_sentencepiece)}

#: DuckDB SQL for the rows of ``op10_decontaminate``: all item-sized windows with an anchor, exact similarity, best window.
ORACLE = {
    "op10_decontaminate": r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w
           FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w
      FROM benchmark WHERE text IS NOT NULL),
il AS (SELECT item_id, w, len(w) AS n, least(len(w), 5) AS k FROM i WHERE len(w) > 0),
ish AS (SELECT item_id, n, k, w[q:q + k - 1] AS sh, count(*) AS c
        FROM (SELECT item_id, n, k, w, unnest(range(1, n - k + 2)) AS q FROM il) GROUP BY ALL),
ks AS (SELECT DISTINCT k FROM il),
dsh AS (SELECT doc_id, len(w) AS dn, k, p - 1 AS p, w[p:p + k - 1] AS sh
        FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, ks WHERE len(w) >= k)),
hit AS (SELECT h.doc_id, h.dn, h.p, h.sh, s.item_id, s.n, s.k, s.c FROM dsh h JOIN ish s ON h.k = s.k AND h.sh = s.sh),
win AS (SELECT doc_id, item_id, dn, n, k, p, sh, c, least(n, dn) AS wd,
               unnest(range(greatest(0, p + k - least(n, dn)), least(p, dn - least(n, dn)) + 1)) AS s FROM hit),
bag AS (SELECT doc_id, item_id, n, k, wd, s, least(count(*), any_value(c)) AS m FROM win GROUP BY doc_id, item_id, n, k, wd, s, sh),
sim AS (SELECT doc_id, item_id, wd, s, sum(m) / ((wd - k + 1) + (n - k + 1) - sum(m)) AS j
        FROM bag GROUP BY doc_id, item_id, n, k, wd, s),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY j DESC, s) AS r FROM sim WHERE j >= 0.8 - 1e-9)
SELECT doc_id, item_id, CAST(s AS BIGINT) AS start, CAST(wd AS BIGINT) AS n_words, CAST(j AS DOUBLE) AS similarity
FROM best WHERE r = 1""",
}
