"""Licence scans: sparse TF-IDF cosine to templates, then directory inheritance (operator 5).

Every line, every run of adjacent lines up to ``RUN_WORDS`` between its first and last,
and the whole of every file are compared with the licence notices as sparse TF-IDF
vectors, the whole also with full licences; the document frequencies of all words are
counted over all files and joined to the words of the blocks that may decide about a
file.  A file's own licence is the full licence it is closest to from ``BODY_THRESHOLD``
on, else the notice with the largest cosine of any block from ``THRESHOLD`` on.  Files
that are licence files (the whole text reaches ``BODY_THRESHOLD`` beside a full licence
or ``FILE_THRESHOLD`` beside a notice) license their directory; every file without
a licence of its own inherits from the nearest ancestor directory that has one, found by
joining each distinct directory with its ancestors' paths.

Defined results: a null text counts as empty, a null path as the root directory ""; of
equal cosines the first template in ``TEMPLATES`` holds; a directory with several
licence files takes the licence most of them have (ties: the smaller name); rows that
repeat a path are reported each; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netvigil.llm.common import bounded, cut, prepare
from netvigil.llm.license_bodies import BODIES

THRESHOLD = 0.6
FILE_THRESHOLD = 0.5
#: Of a whole file beside a full licence; long texts share many common words.
BODY_THRESHOLD = 0.8
#: The words between the first and the last line of a run: twice the longest notice.
RUN_WORDS = 80

# Public licence notices, short forms and headers.
TEMPLATES = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.",
                   "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    "BSD-3-Clause": ("Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
                     "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.",
                "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License."),
    "MIT": ("Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
}
_WORD = re.compile(r"[^\W_]+")
#: Distinct words that a task counts before it hands them on.
TALLY_WORDS = 100_000


def _words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


#: Words of the notices, and of the full licences.
VOCABULARY = frozenset(w for t in TEMPLATES.values() for x in t for w in _words(x))
BODY_VOCABULARY = frozenset(w for x in BODIES.values() for w in _words(x))


@dataclass(frozen=True)
class Unit:
    """A block's product with its closest template, the square of its norm over template words, and its other words."""

    name: str
    dot: float
    known: float
    others: dict[str, int]

    def cosine(self, weight: float) -> float:
        """The cosine if all other words weighed so much."""
        return self.dot / math.sqrt(self.known + weight * weight * sum(c * c for c in self.others.values()))


class Matcher:
    """Texts as sparse TF-IDF vectors beside every template; words outside the templates get their weight later, by a join."""

    def __init__(self, frequency: dict[str, int], files: int):
        self.most = math.log((1.0 + files) / 2.0) + 1.0  # of a word of one file; a word of all files weighs 1
        self.idf = {w: math.log((1.0 + files) / (1.0 + frequency.get(w, 0))) + 1.0 for w in VOCABULARY | BODY_VOCABULARY}
        self.rows = [(name, self._row(x)) for name, forms in TEMPLATES.items() for x in forms]
        self.bodies = [(name, self._row(x)) for name, x in BODIES.items()]
        self.strong = self._strong(self.rows, min(THRESHOLD, FILE_THRESHOLD))
        self.strong_body = self._strong(self.bodies, BODY_THRESHOLD)
        #: what a word that is present adds at most to the square of the cosine to each notice
        self.share: dict[str, list[tuple[int, float]]] = {}
        for k, (_, row) in enumerate(self.rows):
            for w, a in row.items():
                self.share.setdefault(w, []).append((k, a * a))

    def _row(self, text: str) -> dict[str, float]:
        v = {w: c * self.idf[w] for w, c in Counter(_words(text)).items()}
        norm = math.sqrt(sum(a * a for a in v.values()))
        return {w: a / norm for w, a in v.items()}

    def _strong(self, rows, threshold: float) -> frozenset:
        # a text of common words alone cannot reach a threshold: its cosine is at most their share of a template
        words = {w for _, v in rows for w in v}
        weak: dict[int, float] = dict.fromkeys(range(len(rows)), 0.0)
        for w in sorted(words, key=lambda w: (self.idf[w], w)):
            for k, (_, v) in enumerate(rows):
                weak[k] += v.get(w, 0.0) ** 2
            if any(x >= threshold ** 2 for x in weak.values()):
                break
            words.discard(w)
        return frozenset(words)

    def _reaches(self, words) -> bool:
        """Whether a block with these words can have cosine THRESHOLD to a notice."""
        total = [0.0] * len(self.rows)
        for w in words:
            for k, a in self.share.get(w, ()):
                total[k] += a
        return max(total) >= THRESHOLD ** 2 - 1e-9

    def unit(self, count: Counter, body: bool = False) -> Unit | None:
        """One block of a text beside its closest template; None without a word that counts."""
        if not (self.strong_body if body else self.strong) & count.keys():
            return None
        v = {w: count[w] * self.idf[w] for w in count.keys() & self.idf.keys()}
        name, top = None, 0.0  # the norm is the same for all templates
        for n, row in self.bodies if body else self.rows:
            s = sum(row[w] * v[w] for w in sorted(row.keys() & v.keys()))
            if s > top * (1 + 1e-12):
                name, top = n, s
        return Unit(name, top, sum(v[w] ** 2 for w in sorted(v)), {w: c for w, c in count.items() if w not in v})

    def runs(self, lines: list[list[str]]) -> list[Unit]:
        """Runs of two and more adjacent lines that can reach THRESHOLD.

        Lines without words do not part a run.  A run that begins or ends with a line
        without notice words is closer to every notice without that line.
        """
        lines = [x for x in lines if x]
        if len(lines) < 2 or not self._reaches(set().union(*lines)):
            return []
        sets = [self.share.keys() & set(x) for x in lines]
        got = []
        for a in range(len(lines) - 1):
            if not sets[a]:
                continue
            end, between, seen = a + 1, 0, set(sets[a])  # lines a to end - 1
            while end < len(lines) and between <= RUN_WORDS:
                seen |= sets[end]
                between += len(lines[end])
                end += 1
            if not self.strong & seen or not self._reaches(seen):
                continue
            count, seen = Counter(lines[a]), set(sets[a])
            for b in range(a + 1, end):
                count.update(lines[b])
                seen |= sets[b]
                if sets[b] and self._reaches(seen) and (u := self.unit(count)) and u.cosine(1.0) >= THRESHOLD - 1e-9:
                    got.append(u)
        return got

    def units(self, text: str | None) -> list[tuple[int, str, Unit]]:
        """(order, kind, unit) of every block that may decide about a file; the rest cannot, whatever its words weigh.

        Kinds: "body" and "file" are the whole file beside full licences and notices, "part" is a line or a run.
        """
        lines = [_words(x) for x in (text or "").split("\n")]
        count = Counter(w for x in lines for w in x)
        out = []
        if (u := self.unit(count, body=True)) and u.cosine(1.0) >= BODY_THRESHOLD - 1e-9:
            out.append((-1, "body", u))
        if not (whole := self.unit(count)):
            return out
        got = [u for x in lines if not self.strong.isdisjoint(x) and (u := self.unit(Counter(x)))] + self.runs(lines)
        least = max(u.cosine(self.most) for u in [*got, whole])
        out += [(k, "part", u) for k, u in enumerate(got) if u.cosine(1.0) >= least - 1e-9]
        if whole.cosine(1.0) >= min(least, FILE_THRESHOLD) - 1e-9:
            out.append((len(got), "file", whole))
        return out


def with_path(docs: DataFrame) -> DataFrame:
    """doc_id, path, text: documents laid out as source/language/thousand/doc_id."""
    parts = [F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")),
             F.coalesce(F.floor(F.col("doc_id") / 1000).cast("string"), F.lit("")), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))]
    return docs.select("doc_id", F.concat_ws("/", *parts).alias("path"), "text")


def word_counts(files: DataFrame) -> DataFrame:
    """(w, n): in how many files each word stands; the word "" counts the files."""
    import pyarrow as pa

    def count(batches):
        tally: Counter = Counter()
        for b in batches:
            tally[""] += b.num_rows
            for t in b.column(0).to_pylist():
                tally.update(set(_words(t or "")))
            if len(tally) > TALLY_WORDS:
                yield pa.RecordBatch.from_arrays([pa.array(list(tally), pa.string()), pa.array(list(tally.values()), pa.int64())], names=["w", "n"])
                tally.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(tally), pa.string()), pa.array(list(tally.values()), pa.int64())], names=["w", "n"])

    return files.select("text").mapInArrow(count, "w string, n bigint").groupBy("w").agg(F.sum("n").alias("n"))


def own_licenses(files: DataFrame) -> DataFrame:
    """(keys of ``files`` but text, own, cosine, is_file) of every file."""
    import pyarrow as pa

    prepare(files.sparkSession)
    counts = cut(word_counts(files))
    # at most one row per word of the templates
    seen = {r.w: r.n for r in counts.where(F.col("w").isin("", *sorted(VOCABULARY | BODY_VOCABULARY))).collect()}
    files_n = seen.pop("", 0)

    def run(batches):
        matcher = Matcher(seen, files_n)
        for b in batches:
            rows = [{"_text": key, "unit": k, "kind": kind, "name": u.name, "dot": u.dot, "known": u.known,
                     "others": [{"w": w, "c": c} for w, c in u.others.items()]}
                    for key, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for k, kind, u in matcher.units(t)]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([
                ("_text", pa.string()), ("unit", pa.int32()), ("kind", pa.string()), ("name", pa.string()), ("dot", pa.float64()), ("known", pa.float64()),
                ("others", pa.list_(pa.struct([("w", pa.string()), ("c", pa.int64())])))]))

    # equal texts are judged alike, so each is weighed once
    marked = files.withColumn("_text", F.sha2(F.coalesce("text", F.lit("")), 256))
    units = cut(marked.select("_text", "text").mapInArrow(
        run, "_text string, unit int, kind string, name string, dot double, known double, others array<struct<w string, c bigint>>").dropDuplicates(["_text", "unit"]))
    others = units.select("_text", "unit", F.explode("others").alias("o")).select("_text", "unit", F.col("o.w").alias("w"), F.col("o.c").alias("c"))
    idf = F.log((1.0 + files_n) / (1.0 + F.col("n"))) + 1.0
    weights = cut(counts.join(others.select("w").distinct(), "w", "left_semi").select("w", idf.alias("idf")))
    rest = others.join(bounded(weights), "w").groupBy("_text", "unit").agg(F.sum(F.pow(F.col("c") * F.col("idf"), 2)).alias("rest"))
    # rounded, as the order of a sum is not fixed
    scored = (units.drop("others").join(rest, ["_text", "unit"], "left")
              .withColumn("cosine", F.round(F.col("dot") / F.sqrt(F.col("known") + F.coalesce("rest", F.lit(0.0))), 12)))
    # a full licence decides before its lines do
    scored = scored.where((F.col("kind") != "body") | (F.col("cosine") >= BODY_THRESHOLD))
    whole = F.col("kind").isin("body", "file") & (F.col("cosine") >= FILE_THRESHOLD)
    verdict = cut(scored.groupBy("_text").agg(F.min(F.struct((F.col("kind") != "body").alias("part"), (-F.col("cosine")).alias("c"), "unit", "name")).alias("m"),
                                              F.max(whole).alias("is_file"))
                  .select("_text", (-F.col("m.c")).alias("cosine"), "is_file", F.col("m.name").alias("name")))
    keys = [c for c in files.columns if c != "text"]
    return (marked.select(*keys, "_text").join(bounded(verdict), "_text", "left")
            .select(*keys, F.when((F.col("cosine") >= THRESHOLD) | F.col("is_file"), F.col("name")).alias("own"),
                    F.coalesce("cosine", F.lit(0.0)).alias("cosine"), F.coalesce("is_file", F.lit(False)).alias("is_file")))


def scan(files: DataFrame) -> DataFrame:
    """(doc_id, path, license, origin, cosine): origin is "own", the licensing directory, or null.

    ``files``: doc_id, path, text.
    """
    judged = cut(own_licenses(files.select("doc_id", "path", "text")).withColumn(
        "dir", F.regexp_replace(F.coalesce("path", F.lit("")), "/?[^/]*$", "")))
    votes = judged.where("is_file and own is not null").groupBy("dir", "own").agg(F.count(F.lit(1)).alias("n"))
    licensed = (votes.groupBy("dir").agg(F.min(F.struct((-F.col("n")).alias("n"), "own")).alias("m"))
                .select(F.col("dir").alias("at"), F.col("m.own").alias("given")))
    # each distinct directory meets its ancestors once; files only join their directory
    parts = F.split("dir", "/")
    above = (judged.select("dir").distinct()
             .withColumn("depth", F.explode(F.sequence(F.lit(0), F.when(F.col("dir") == "", 0).otherwise(F.size(parts)))))
             .withColumn("at", F.array_join(F.slice(parts, F.lit(1), F.col("depth")), "/")))
    nearest = (above.join(licensed, "at").groupBy("dir").agg(F.max(F.struct("depth", "at", "given")).alias("m"))
               .select("dir", F.col("m.at").alias("origin"), F.col("m.given").alias("given")))
    return (judged.join(nearest, "dir", "left")
            .select("doc_id", "path", F.coalesce("own", "given").alias("license"),
                    F.when(F.col("own").isNotNull(), F.lit("own")).otherwise(F.col("origin")).alias("origin"), "cosine"))
