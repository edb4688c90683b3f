"""Personal data by patterns and a skip-chain conditional random field (operator 6).

Patterns find the base spans (email, ip, card, phone) of every whole text.  Around
them a skip-chain CRF decides about the mentions that look alike but fail a pattern:
its nodes are the document's mentions (base spans, other long numbers, other tokens
with a commercial at), chain edges join neighbours, skip edges join repeated or
similar mentions (equal once reduced to digits or to the local part, or one number
the end of the other) to the first of their kind.  Loopy message passing over these
edges, in every document with such a mention, makes labels consistent: a number that
is written "+49 30 1234567" once is the same phone where it stands without its prefix.
Base spans are observed, so they stay; a mention whose marginal for a kind passes
``ACCEPT`` is added.

Unary, chain and skip weights are fitted together, as the likelihood of each mention's
label given its own shape, its left neighbour's label and the label of the mention that
its skip edge leads to, over at most ``FIT_DOCS`` documents drawn by hash.  Labels come
from the patterns; every base span also gives a masked copy (a phone without its plus,
an address without its domain, a card with or without its separators) with the span's
label and a skip edge to it.  Look-alikes of a base span are left out: the field decides
about them.  A value of a shape's feature that the fit has not seen speaks for no kind.

Defined results: a null text counts as empty; rows that repeat a doc_id are scanned
each; matches that fail their check are dropped without a retry inside them; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netvigil.llm.common import prepare

FIT_DOCS = 5_000
ACCEPT = 0.5
SWEEPS = 12
#: Steps of the fit, and the pull of its weights towards zero, in mentions.
FIT_STEPS, RIDGE = 1_500, 0.5
#: Log odds against a kind of a feature value that the fit has not seen.
UNSEEN = 3.0
#: Code points between neighbours of the chain.
CHAIN_GAP = 80
#: Two numbers are similar if the shorter has this many digits and ends the longer.
SUFFIX_DIGITS = 7

# Kinds in the order of the result, and their patterns.
KINDS = ("email", "ip", "card", "phone")
LABELS = (*KINDS, "none")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")  # a run of digits is never split, so starts inside one are skipped
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NUMBER = re.compile(r"\+?[(]?[0-9](?:[\x20().-]{0,2}[0-9]){6,}")
_AT = re.compile(r"[^\s,;<>\"']+@[^\s,;<>\"']*|@[^\s,;<>\"']+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the patterns, leftmost and non-overlapping per kind, in result order."""
    out = []
    at = text.find("@")
    done = 0
    while at >= 0:  # every match holds one sign: walk from sign to sign, so long runs stay linear
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            done = m.end()
        at = text.find("@", at + 1)
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and _luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


@dataclass(frozen=True)
class Mention:
    start: int
    end: int
    key: str
    shape: tuple
    label: int  # of a base span; len(KINDS) if none


def _key(s: str) -> str:
    return s.split("@", 1)[0].lower() or s.lower() if "@" in s else "".join(c for c in s if c.isdigit())


def _shape(s: str) -> tuple:
    digits = "".join(c for c in s if c in "0123456789")
    local, _, domain = s.partition("@")
    return ("@" in s, "@" in s and bool(local), "." in domain.strip("."), s.count(".") == 3 and "@" not in s, s.startswith("+"), min(20, len(digits)) // 2,
            13 <= len(digits) <= 19 and _luhn(digits), any(c in " ()-" for c in s))


def mentions(text: str, base: list[tuple[str, int, int]]) -> list[Mention]:
    """Base spans and the look-alikes that overlap none, by position."""
    out = [Mention(s, e, _key(text[s:e]), _shape(text[s:e]), KINDS.index(k)) for k, s, e in base]
    taken = sorted((s, e) for _, s, e in base)
    more = [m.span() for m in _NUMBER.finditer(text)]
    if "@" in text:
        more += [m.span() for m in _AT.finditer(text)]
    i, last = 0, -1
    for s, e in sorted(more):
        while i < len(taken) and taken[i][1] <= s:
            i += 1
        if s < last or any(a < e and s < b for a, b in taken[max(0, i - 1):i + 2]):
            continue
        last = e
        out.append(Mention(s, e, _key(text[s:e]), _shape(text[s:e]), len(KINDS)))
    return sorted(out, key=lambda m: (m.start, m.end))


_BASE, _PRIME = 1_000_003, (1 << 61) - 1


def _endings(key: str) -> list[tuple[int, int]]:
    """(length, hash) of each end of ``key`` from SUFFIX_DIGITS characters on; the last one is of the whole key."""
    out, h, power = [], 0, 1
    for n, c in enumerate(reversed(key), 1):
        h = (h + ord(c) * power) % _PRIME
        power = power * _BASE % _PRIME
        if n >= SUFFIX_DIGITS:
            out.append((n, h))
    return out


def skip_edges(nodes: list[Mention]) -> list[tuple[int, int]]:
    """Each mention to the first with its key, or else to the first with a key that ends in (or is the end of) its own."""
    first: dict[str, int] = {}
    whole: dict[tuple, int] = {}  # the first mention of each distinct number, by its whole key
    ending: dict[tuple, int] = {}  # and by each end of its key
    edges = []
    for i, m in enumerate(nodes):
        if not m.key:
            continue
        j = first.setdefault(m.key, i)
        if j == i and m.key.isdigit() and len(m.key) >= SUFFIX_DIGITS:
            ends = _endings(m.key)
            near = [whole[e] for e in ends if e in whole] + ([ending[ends[-1]]] if ends[-1] in ending else [])
            j = min((a for a in near if nodes[a].key.endswith(m.key) or m.key.endswith(nodes[a].key)), default=i)
            whole.setdefault(ends[-1], i)
            for e in ends:
                ending.setdefault(e, i)
        if j != i:
            edges.append((j, i))
    return edges


@dataclass
class Model:
    """Softmax weights by feature of a shape, and the weights of agreement along edges."""

    unary: dict
    skip: float
    chain: float

    def scores(self, shape: tuple) -> list[float]:
        total = list(self.unary.get("bias", [0.0] * len(LABELS)))
        for f in enumerate(shape):
            if f not in self.unary:
                total[-1] += UNSEEN
            for k, w in enumerate(self.unary.get(f, ())):
                total[k] += w
        return total


def _neighbours(left: Mention, right: Mention) -> bool:
    return right.start - left.end <= CHAIN_GAP


def marginals(nodes: list[Mention], model: Model, skips: list[tuple[int, int]]):
    """Loopy sum-product in log space over chain and skip edges; base spans are observed."""
    import numpy as np

    n, k = len(nodes), len(LABELS)
    unary = np.array([model.scores(m.shape) for m in nodes])
    for i, m in enumerate(nodes):
        if m.label < len(KINDS):
            unary[i] = -30.0
            unary[i, m.label] = 0.0
    chain = [(i - 1, i) for i in range(1, n) if _neighbours(nodes[i - 1], nodes[i])]
    edges = [(a, b, model.chain) for a, b in chain] + [(a, b, model.skip) for a, b in skips]
    if not edges:
        belief = unary
    else:
        src = np.array([e[0] for e in edges] + [e[1] for e in edges])
        dst = np.array([e[1] for e in edges] + [e[0] for e in edges])
        w = np.array([e[2] for e in edges] * 2)
        back = np.r_[np.arange(len(edges), 2 * len(edges)), np.arange(len(edges))]
        msg = np.zeros((2 * len(edges), k))
        for _ in range(SWEEPS):
            belief = unary.copy()
            np.add.at(belief, dst, msg)
            out = belief[src] - msg[back]
            out -= out.max(axis=1, keepdims=True)
            p = np.exp(out)
            new = np.log(p.sum(axis=1, keepdims=True) + p * (np.exp(w)[:, None] - 1))  # agreement weighs exp(w), the rest 1
            new -= new.max(axis=1, keepdims=True)
            done = np.abs(new - msg).max() < 1e-4
            msg = 0.5 * msg + 0.5 * new
            if done:
                break
        belief = unary.copy()
        np.add.at(belief, dst, msg)
    belief = belief - belief.max(axis=1, keepdims=True)
    p = np.exp(belief)
    return p / p.sum(axis=1, keepdims=True)


def added_spans(text: str, base: list[tuple[str, int, int]], model: Model) -> list[tuple[str, int, int]]:
    """Mentions that the field labels beyond the patterns."""
    nodes = mentions(text, base)
    free = len(KINDS)
    if all(m.label < free for m in nodes):
        return []
    p = marginals(nodes, model, skip_edges(nodes))
    return [(LABELS[int(p[i].argmax())], m.start, m.end) for i, m in enumerate(nodes)
            if m.label == free and int(p[i].argmax()) < free and p[i].max() >= ACCEPT]


def masked(kind: str, s: str) -> str | None:
    """A base span as it might stand elsewhere without what makes it match (None: no such form)."""
    if kind == "phone":
        return s[1:]
    if kind == "email":
        return s[:s.index("@") + 1]
    if kind == "card":
        digits = s.replace(" ", "").replace("-", "")
        return digits if digits != s else " ".join(digits[i:i + 4] for i in range(0, len(digits), 4))
    return None


def evidence(text: str) -> list[tuple[tuple, int, int, int]]:
    """(shape, label, left neighbour's label, label at the skip edge's other end) of the mentions to learn
    from; -1 where there is no such edge or its end has no known label."""
    base = base_spans(text)
    nodes = mentions(text, base)
    free, to = len(KINDS), {b: a for a, b in skip_edges(nodes)}
    unknown = set()  # a look-alike of a base span is what the field decides later, not a label
    for b, a in to.items():
        if (nodes[a].label == free) != (nodes[b].label == free):
            unknown.add(a if nodes[a].label == free else b)
    out = []
    for i, m in enumerate(nodes):
        if i in unknown:
            continue
        left = nodes[i - 1].label if i and i - 1 not in unknown and _neighbours(nodes[i - 1], m) else -1
        out.append((m.shape, m.label, left, nodes[to[i]].label if i in to and to[i] not in unknown else -1))
        hidden = masked(KINDS[m.label], text[m.start:m.end]) if m.label < free else None
        if hidden:
            out.append((_shape(hidden), m.label, -1, m.label))
    return out


def fit(docs: DataFrame) -> Model:
    """Weights from the mentions of at most FIT_DOCS documents (in expectation, drawn by hash)."""
    import ast

    import pyarrow as pa

    prepare(docs.sparkSession)
    n = docs.count()
    share = min(1.0, FIT_DOCS / max(1, n))
    sample = docs.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / float(1 << 30) < share).select("text")

    def count(batches):
        for b in batches:
            seen = [x for t in b.column(0).to_pylist() for x in evidence(t or "")]
            yield pa.RecordBatch.from_arrays([pa.array([repr(x[0]) for x in seen], pa.string()), *[pa.array([x[k] for x in seen], pa.int32()) for k in (1, 2, 3)]],
                                             names=["shape", "label", "left", "first"])

    # shapes take a few hundred values and each label six, so this is a small table
    rows = (sample.mapInArrow(count, "shape string, label int, left int, first int").groupBy("shape", "label", "left", "first")
            .agg(F.count(F.lit(1)).alias("n")).orderBy("shape", "label", "left", "first").collect())
    return learn([(ast.literal_eval(r.shape), r.label, r.left, r.first, r.n) for r in rows])


def learn(rows: list[tuple[tuple, int, int, int, int]]) -> Model:
    """Weights of the highest conditional likelihood of (shape, label, left, first, count), less RIDGE times their
    squares.  The problem is concave; steps are accelerated gradient steps of a safe length."""
    import numpy as np

    if not rows:
        return Model({}, 0.0, 0.0)
    names = ["bias"] + sorted({f for r in rows for f in enumerate(r[0])}, key=repr)
    at, k = {f: i for i, f in enumerate(names)}, len(LABELS)
    x, y, near, weight = np.zeros((len(rows), len(names))), np.zeros((len(rows), k)), np.zeros((2, len(rows), k)), np.zeros(len(rows))
    for i, (shape, label, left, first, c) in enumerate(rows):
        x[i, [0, *(at[f] for f in enumerate(shape))]] = 1
        y[i, label], weight[i] = 1, c
        for e, other in enumerate((left, first)):
            if other >= 0:
                near[e, i, other] = 1
    weight, ridge = weight / weight.sum(), RIDGE / weight.sum()
    step = 1 / (0.5 * (x.sum(axis=1).max() + 2) + ridge)
    w, edge = np.zeros((len(names), k)), np.zeros(2)
    last_w, last_edge = w, edge
    for t in range(FIT_STEPS):
        ahead = t / (t + 3)
        vw, ve = w + ahead * (w - last_w), edge + ahead * (edge - last_edge)
        z = x @ vw + ve[0] * near[0] + ve[1] * near[1]
        p = np.exp(z - z.max(axis=1, keepdims=True))
        miss = weight[:, None] * (y - p / p.sum(axis=1, keepdims=True))
        last_w, last_edge = w, edge
        w = vw + step * (x.T @ miss - ridge * vw)
        edge = ve + step * ((near * miss).sum(axis=(1, 2)) - ridge * ve)
    return Model({f: [float(v) for v in w[i]] for f, i in at.items()}, float(edge[1]), float(edge[0]))


def _join(spans: list[tuple[str, int, int]]) -> str:
    order = {k: i for i, k in enumerate(KINDS)}
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (order[x[0]], x[1], x[2])))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for every row; the counts are of base spans."""
    import pyarrow as pa

    model = fit(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            counts, digests, every = [[] for _ in KINDS], [], []
            for t in b.column(1).to_pylist():
                base = base_spans(t or "")
                for c, k in zip(counts, KINDS):
                    c.append(sum(x[0] == k for x in base))
                digests.append(hashlib.sha256(_join(base).encode()).hexdigest())
                every.append(_join(base + added_spans(t or "", base, model)))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(digests, pa.string()), pa.array(every, pa.string())],
                                             names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, {', '.join(f'n_{k} bigint' for k in KINDS)}, base_sha256 string, spans string")
