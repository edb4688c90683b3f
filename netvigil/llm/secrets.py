"""Secret scans over an incremental blob ledger (operator 7, native).

Every version of a text is a blob named by its SHA-256, so a text is scanned once
however many paths and versions hold it.  A ledger row holds a blob, the (rule, rule
version) pairs it has been scanned with and the findings; a run joins the blobs to the
ledger, scans only the pairs that it does not hold, and the findings of all rows are
joined back to every path.  A new rule version rescans with that rule alone.

Positions come from built-in functions: a rule's matches and the gaps between them
alternate, so running sums of their lengths are code-point offsets.

Defined results: a null text counts as the empty blob; rows that repeat a path get a
row each; a failing match (too short) is dropped without a retry inside it; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netvigil.llm.common import cut, prepare

_VALUE = "[A-Za-z0-9+/_.=-]+"


@dataclass(frozen=True)
class Rule:
    kind: str
    version: int
    pattern: str
    #: code points the match (or group ``group``) must have
    least: int = 1
    group: int = 0


#: The base rules come first; their order is the order of kinds at one position.
BASE = (
    Rule("assign", 1, r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?(""" + _VALUE + ")", 8, 1),
    Rule("access", 1, "AKIA[A-Z0-9]+", 16),
    Rule("hex", 1, "[0-9a-f]{32,}"),  # the same as runs of [0-9a-f]+ of 32 or more
)
EXTRA = (
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", 1, "-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("forge", 1, "gh[pousr]_[A-Za-z0-9]{36,}"),
)
RULES = BASE + EXTRA


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


FINDING = "struct<kind:string,version:int,start:bigint,end:bigint>"


def _matches(rule: Rule) -> Column:
    """The matches of a rule in column text, their checked part, and the gaps around them."""
    return F.struct(F.regexp_extract_all("text", F.lit(rule.pattern), 0).alias("found"),
                    F.regexp_extract_all("text", F.lit(rule.pattern), rule.group).alias("value"),
                    F.split("text", rule.pattern, -1).alias("gaps"))


def _findings(matches: Column, rule: Rule) -> Column:
    """array<FINDING> of the matches that pass; one walk carries the end of the last match."""
    none = F.array().cast(f"array<{FINDING}>")

    def step(acc, i):
        start = acc["at"] + F.length(F.get(matches["gaps"], i))
        end = start + F.length(F.get(matches["found"], i))
        one = F.struct(F.lit(rule.kind).alias("kind"), F.lit(rule.version).alias("version"), start.cast("long").alias("start"), end.cast("long").alias("end"))
        return F.struct(end.cast("long").alias("at"),
                        F.when(F.length(F.get(matches["value"], i)) >= rule.least, F.concat(acc["got"], F.array(one))).otherwise(acc["got"]).alias("got"))

    walk = F.aggregate(F.sequence(F.lit(0), F.size(matches["found"]) - 1),
                       F.struct(F.lit(0).cast("long").alias("at"), none.alias("got")), step, lambda acc: acc["got"])
    return F.when(matches.isNull(), none).otherwise(walk)


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The new ledger rows: (blob, scanned array<string>, findings array<FINDING>).

    ``versions``: column text, one row per path and version.  ``ledger``: the union of
    what earlier calls returned; blobs that it has scanned with all ``rules`` give no row.
    """
    prepare(versions.sparkSession)
    tags = {r: f"{r.kind}@{r.version}" for r in rules}
    every = F.array(*[F.lit(t) for t in tags.values()])
    texts = versions.select(F.coalesce("text", F.lit("")).alias("text")).withColumn("blob", blob_of(F.col("text")))
    blobs = texts.groupBy("blob").agg(F.any_value("text").alias("text"))
    if ledger is None:
        todo = blobs.withColumn("done", F.array().cast("array<string>"))
    else:
        done = (ledger.select("blob", F.explode("scanned").alias("tag")).groupBy("blob").agg(F.collect_set("tag").alias("done")))
        todo = (blobs.join(done, "blob", "left").withColumn("done", F.coalesce("done", F.array().cast("array<string>")))
                .where(F.size(F.array_except(every, "done")) > 0))
    raw = todo.select("blob", "done", *[F.when(~F.array_contains("done", t) & F.col("text").rlike(r.pattern), _matches(r)).alias(f"m{i}")
                                        for i, (r, t) in enumerate(tags.items())])
    found = [_findings(F.col(f"m{i}"), r) for i, r in enumerate(rules)]
    return raw.select("blob", F.array_except(every, "done").alias("scanned"), F.concat(*found).alias("findings"))


def record(docs: DataFrame, path: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger stored at ``path`` after a run over ``docs``: what the run scanned is appended.

    A run that dies leaves no half-written rows (Spark commits the files at the end); one
    that is repeated finds its pairs in the ledger and scans nothing."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    known = spark.read.parquet(path) if where.getFileSystem(sc._jsc.hadoopConfiguration()).exists(where) else None
    scan(docs, known, rules).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def digest(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans): findings joined back to every row of ``docs``.

    Pairs of blob and rule that ``ledger`` lacks are scanned; findings of other versions in it do not count."""
    order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))])
    base = len(BASE)
    new = cut(scan(docs, ledger, rules))
    known = new if ledger is None else new.unionByName(ledger)
    asked = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])
    now = lambda f: F.array_contains(asked, F.struct(f["kind"].alias("kind"), f["version"].alias("version")))
    known = known.select("blob", F.filter("findings", now).alias("findings"))  # a ledger may hold older rule versions
    sorted_ = F.sort_array(F.collect_list(F.struct("f.start", F.element_at(order, F.col("f.kind")).alias("at"), "f.end", "f.kind")))
    flat = known.select("blob", F.explode("findings").alias("f")).groupBy("blob").agg(sorted_.alias("all"))
    name = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    text = lambda spans: F.array_join(F.transform(spans, name), ",")
    count = lambda i: F.size(F.filter("all", lambda s: s["at"] == i)).cast("long")
    per_blob = flat.select("blob", *[count(i).alias(f"n_{r.kind}") for i, r in enumerate(BASE)],
                           F.sha2(text(F.filter("all", lambda s: s["at"] < base)).cast("binary"), 256).alias("base_sha256"),
                           text(F.col("all")).alias("spans"))
    joined = docs.select("doc_id", blob_of(F.col("text")).alias("blob")).join(per_blob, "blob", "left")
    none = F.sha2(F.lit("").cast("binary"), 256)
    return joined.select("doc_id", *[F.coalesce(f"n_{r.kind}", F.lit(0).cast("long")).alias(f"n_{r.kind}") for r in BASE],
                         F.coalesce("base_sha256", none).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))
