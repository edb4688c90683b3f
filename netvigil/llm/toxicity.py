"""Toxicity scores from a weighted lexicon matched by Aho-Corasick (operator 4).

Texts are folded first (compatibility forms, lower case, look-alike letters of
other scripts, digits and signs that stand for letters inside a word, i and l made
one letter), so a disguised spelling meets the plain one.  The lexicon is learned:
words and word stems (prefixes) that labelled toxic documents hold and clean ones
do not, weighted by their log-odds.  One automaton matches all of them in one walk
over the whole text; a term inside an exception phrase does not count; the summed
weight is normalised by the text's length, and a logistic curve fitted on rows that
the lexicon did not see turns both into a score.

The fit uses at most ``FIT_TOXIC`` + ``FIT_CLEAN`` labelled rows, drawn by hash; the
lexicon has at most ``MAX_TERMS`` entries.  Every document is scored, whole.

Defined results: a null text counts as empty; an empty text scores like any text
without matches; of several labels for a doc_id the most toxic holds; rows that
repeat a doc_id are scored each; a null doc_id is never held out and never
labelled; without labels of both kinds the lexicon is empty and every score is
``NO_FIT_SCORE``; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netvigil.llm.common import cut, prepare

FIT_TOXIC, FIT_CLEAN = 8_000, 16_000
MAX_TERMS = 5_000
#: Distinct toxic documents that must hold a term, and its least log-odds.
MIN_DOCS, MIN_LOG_ODDS = 6, 2.3
#: Terms are added until each toxic document holds this many, as long as a term helps MIN_DOCS documents.
COVER = 6
STEMS = range(4, 8)
NO_FIT_SCORE = 0.0
THRESHOLD = 0.5
#: Phrases in which a harsh word is harmless; more are learned from clean documents.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "class clown", "stupid question")

# Letters of other scripts that look like Latin ones.
LOOK_ALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t",
    "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ӏ": "l",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "ı": "i", "ɑ": "a", "ɡ": "g", "օ": "o", "ո": "n", "ս": "u",
}
# Signs that stand for a letter inside a word.
SIGNS = {"0": "o", "1": "l", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "l"}
_LETTERS = str.maketrans(LOOK_ALIKES | {"i": "l", "_": " ", **dict.fromkeys("­​‌‍⁠﻿")}
                         | {k: "l" for k, v in LOOK_ALIKES.items() if v == "i"})
_SIGNS = str.maketrans(SIGNS)
_WORD = re.compile(r"[\w@$!]+")


def _unsign(word: str) -> str:
    word = word.strip("@$!")
    return word.translate(_SIGNS) if sum(c.isalpha() for c in word) >= 2 else word


def folded(text: str | None) -> list[str]:
    """The folded words of a whole text."""
    text = unicodedata.normalize("NFKC", text or "").lower().translate(_LETTERS)
    return [w for w in (w if w.isalpha() else _unsign(w) for w in _WORD.findall(text)) if w]


def _terms(words: list[str]) -> set[str]:
    """What a document may add to the lexicon: ' word ' and ' stem'."""
    own = set(words)
    return {f" {w} " for w in own if 3 <= len(w) <= 40} | {f" {w[:n]}" for w in own for n in STEMS if len(w) > n}


@dataclass
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    curve: tuple[float, float, float] | None = None

    def automaton(self):
        import ahocorasick

        auto = ahocorasick.Automaton()
        for t, w in self.weights.items():
            auto.add_word(t, (len(t), w))
        for e in self.exceptions:
            auto.add_word(f" {e} ", (len(e) + 2, None))
        if len(auto):
            auto.make_automaton()
        return auto

    @staticmethod
    def hits(auto, line: str) -> dict[int, tuple[float, str]]:
        """Weight and term by word start; the heaviest term of a word counts, none inside an exception."""
        best: dict[int, tuple[float, str]] = {}
        spared: list[tuple[int, int]] = []
        if len(auto):
            for end, (n, w) in auto.iter(line):
                at = end - n + 1
                if w is None:
                    spared.append((at, end))
                elif at not in best or w > best[at][0]:
                    best[at] = w, line[at:end + 1]
        for lo, hi in spared:
            for at in [x for x in best if lo <= x < hi]:
                del best[at]
        return best

    def evidence(self, auto, words: list[str]) -> tuple[float, float]:
        """(log of the summed weight, summed weight per hundred words); repeats of a term add by their logarithm."""
        met = Counter(self.hits(auto, f" {' '.join(words)} ").values())
        total = sum(w * (1.0 + math.log(n)) for (w, _), n in met.items())
        return math.log1p(total), 100.0 * total / (len(words) + 20)

    def score(self, auto, text: str | None) -> float:
        if self.curve is None:
            return NO_FIT_SCORE
        x, y = self.evidence(auto, folded(text))
        z = self.curve[0] + self.curve[1] * x + self.curve[2] * y
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


def bucket_of(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; 0 is the held-out part."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5))


def _sample(docs: DataFrame, labels: DataFrame, flag: str) -> DataFrame:
    """(text, label, bucket, doc_id) of at most FIT_TOXIC + FIT_CLEAN labelled rows outside the held-out part."""
    marks = cut(labels.where(f"doc_id is not null and {flag} is not null")
                .groupBy("doc_id").agg(F.max(flag).alias("label"))
                .where(bucket_of(F.col("doc_id")) != 0))
    drawn = [marks.where(side).select("doc_id", F.lit(label).alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
             for side, label, most in ((F.col("label") > 0, 1, FIT_TOXIC), (~(F.col("label") > 0), 0, FIT_CLEAN))]
    picked = drawn[0].unionByName(drawn[1]).withColumnRenamed("doc_id", "_id")
    # the draw is bounded by the two parameters, so this side may be broadcast; of rows that repeat an id one counts
    return (docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("_id"))
            .groupBy("doc_id", "label").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
            .select("text", "label", bucket_of(F.col("doc_id")).alias("part"), "doc_id"))


def fit(docs: DataFrame, labels: DataFrame, flag: str = "toxic") -> Lexicon:
    """Learn lexicon, exceptions and curve from labelled rows outside the held-out part."""
    import pyarrow as pa

    prepare(docs.sparkSession)

    def read(batches):  # folded once; a min-hash of word triples marks near copies of one text
        for b in batches:
            words = [folded(t) for t in b.column(0).to_pylist()]
            import xxhash

            key = [min((xxhash.xxh64_intdigest(" ".join(w[i:i + 3])) for i in range(max(1, len(w) - 2))), default=0) >> 1 for w in words]
            yield pa.RecordBatch.from_arrays([pa.array([" ".join(w) for w in words]), *b.columns[1:], pa.array(key, pa.int64())],
                                             names=["words", "label", "part", "doc_id", "copy"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = cut(_sample(docs, labels, flag).mapInArrow(read, f"words string, label int, part bigint, doc_id {id_type}, copy bigint")
               .groupBy("copy", "label").agg(F.min(F.struct("doc_id", "words", "part")).alias("one")).select("one.words", "label", "one.part"))
    learn, tune = rows.where("part <> 4"), rows.where("part = 4")
    size = {r.label: r.n for r in learn.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not size.get(0) or not size.get(1):
        return Lexicon()

    def count(batches):
        for b in batches:
            tally = {0: Counter(), 1: Counter()}
            for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                tally[label].update(_terms(text.split()))
            if terms := list(tally[0].keys() | tally[1].keys()):
                yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array([tally[1][t] for t in terms], pa.int64()),
                                                  pa.array([tally[0][t] for t in terms], pa.int64())], names=["term", "k", "z"])

    odds = (F.log((F.col("k") + 0.5) / (size[1] + 1.0)) - F.log((F.col("z") + 0.5) / (size[0] + 1.0)))
    found = (learn.select("words", "label").mapInArrow(count, "term string, k bigint, z bigint")
             .groupBy("term").agg(F.sum("k").alias("k"), F.sum("z").alias("z"))
             .where(F.col("k") >= MIN_DOCS).withColumn("w", odds).where(F.col("w") >= MIN_LOG_ODDS)
             .orderBy(F.desc(F.col("w") * F.sqrt("k")), "term").limit(MAX_TERMS).collect())
    pool = {r.term: (r.w, r.k) for r in found}
    if not pool:
        return Lexicon()

    # the terms that the toxic documents need: each is covered COVER times, general and heavy terms first
    held = [pool.keys() & _terms(r.words.split()) for r in learn.where("label = 1").select("words").toLocalIterator()]
    weights, need = {}, [COVER] * len(held)
    by_term: dict[str, list[int]] = {}
    for i, terms in enumerate(held):
        for t in terms:
            by_term.setdefault(t, []).append(i)
    for t in sorted(pool, key=lambda t: (-pool[t][0] * math.sqrt(pool[t][1]), t)):
        if any(t != s and t.startswith(s.rstrip()) and pool[s][0] >= pool[t][0] - 0.7 for s in
               (t[:n + 1] for n in STEMS) if s in weights):
            continue  # its stem is in and says as much
        if sum(need[i] > 0 for i in by_term.get(t, ())) >= MIN_DOCS:
            weights[t] = float(pool[t][0])
            for i in by_term[t]:
                need[i] -= 1
    plain = tuple(" ".join(folded(e)) for e in EXCEPTIONS)
    bare = Lexicon(weights)

    def around(batches):  # a matched word with its neighbour, by label
        auto = bare.automaton()
        for b in batches:
            tally = {0: Counter(), 1: Counter()}
            for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                line, seen = f" {text} ", set()
                for at in bare.hits(auto, line):
                    after = line[at + 1:].split(" ", 2)[:2]
                    before = line[:at].rsplit(" ", 1)[-1]
                    seen |= {" ".join(after)} | ({f"{before} {after[0]}"} if before else set())
                tally[label].update(x for x in seen if " " in x.strip())
            if terms := list(tally[0].keys() | tally[1].keys()):
                yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array([tally[1][t] for t in terms], pa.int64()),
                                                  pa.array([tally[0][t] for t in terms], pa.int64())], names=["term", "k", "z"])

    mild = (learn.select("words", "label").mapInArrow(around, "term string, k bigint, z bigint")
            .groupBy("term").agg(F.sum("k").alias("k"), F.sum("z").alias("z"))
            .where((F.col("z") >= MIN_DOCS) & (F.col("k") == 0)).orderBy(F.desc("z"), "term").limit(MAX_TERMS).collect())
    lexicon = Lexicon(weights, tuple(dict.fromkeys((*plain, *(r.term for r in mild)))))

    auto = lexicon.automaton()
    sample = [(*lexicon.evidence(auto, r.words.split()), r.label) for r in tune.toLocalIterator()]
    lexicon.curve = _logistic(sample)
    return lexicon


def _logistic(rows: list[tuple[float, float, int]]) -> tuple[float, float, float]:
    """Newton steps on a two-feature logistic curve; slopes are not negative, so a match never lowers a score."""
    import numpy as np

    data = np.array(rows + [(0.0, 0.0, 0), (math.log1p(8.0), 4.0, 1)], dtype=float)  # one prior row of each kind
    x = np.column_stack([np.ones(len(data)), data[:, :2]])
    y, use, w = data[:, 2], [0, 1, 2], np.zeros(3)
    while True:
        w[:] = 0
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            ridge = 0.05 * np.eye(3)
            step = np.zeros(3)
            step[use] = np.linalg.solve(((x.T * (p * (1 - p))) @ x + ridge)[np.ix_(use, use)], (x.T @ (y - p) - ridge @ w)[use])
            w += step
            if np.abs(step).max() < 1e-8:
                break
        bad = [i for i in use if i and w[i] < 0]
        if not bad:
            return tuple(float(v) for v in w)
        use = [i for i in use if i not in bad]


def with_score(docs: DataFrame, lexicon: Lexicon, keys: list[str], name: str = "score") -> DataFrame:
    """``keys`` of ``docs`` plus the score of each whole text."""
    import pyarrow as pa

    src = docs.select(*keys, F.col("text").alias("_toxicity_text"))
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in docs.select(*keys).schema)}, `{name}` double"

    def run(batches):
        auto = lexicon.automaton()
        for b in batches:
            s = [lexicon.score(auto, t) for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(s, pa.float64())], names=[*keys, name])

    return src.mapInArrow(run, schema)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``."""
    scored = with_score(docs, fit(docs, labels), ["doc_id"])
    return scored.select("doc_id", F.coalesce(bucket_of(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with all their columns."""
    scored = with_score(docs, fit(docs, labels), docs.columns, name="_toxicity_score")
    return scored.where(F.col("_toxicity_score") < THRESHOLD).select(*docs.columns)
