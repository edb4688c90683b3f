"""Skip-chain field: marginals against enumeration, learned weights, linear skip edges (operator 6)."""

import itertools
import math
import random
import time

from netvigil.llm import pii
from tests.llm.test_operators import documents


def slow_edges(nodes):
    out = []
    for i, m in enumerate(nodes):
        same = [j for j in range(i) if m.key and nodes[j].key == m.key]
        firsts = [j for j in range(i) if nodes[j].key.isdigit() and len(nodes[j].key) >= 7 and all(nodes[q].key != nodes[j].key for q in range(j))]
        ends = [j for j in firsts if m.key.isdigit() and len(m.key) >= 7 and (nodes[j].key.endswith(m.key) or m.key.endswith(nodes[j].key))]
        if same or ends:
            out.append(((same or ends)[0], i))
    return out


def test_skip_edges_equal_the_definition_and_stay_linear():
    rng = random.Random(6)
    for _ in range(300):
        keys = ["".join(rng.choice("12") for _ in range(rng.randrange(10))) + "1234567" * rng.randrange(2) for _ in range(rng.randrange(12))]
        nodes = [pii.Mention(i, i, k, (), 4) for i, k in enumerate(keys)]
        assert pii.skip_edges(nodes) == slow_edges(nodes), keys
    alike = [pii.Mention(i, i, f"{i}9991234567", (), 4) for i in range(1_000_000, 1_020_000)]
    begin = time.perf_counter()
    assert pii.skip_edges(alike) == [] and time.perf_counter() - begin < 5


def enumerated(nodes, model, skips):
    total = [[0.0] * 5 for _ in nodes]
    scores = [model.scores(m.shape) for m in nodes]
    chain = [(i - 1, i) for i in range(1, len(nodes)) if nodes[i].start - nodes[i - 1].end <= pii.CHAIN_GAP]
    for labels in itertools.product(*[[m.label] if m.label < 4 else range(5) for m in nodes]):
        w = sum(s[k] for m, s, k in zip(nodes, scores, labels) if m.label == 4)
        w += sum(model.chain for a, b in chain if labels[a] == labels[b]) + sum(model.skip for a, b in skips if labels[a] == labels[b])
        for i, k in enumerate(labels):
            total[i][k] += math.exp(w)
    return [[v / sum(row) for v in row] for row in total]


def test_marginals_are_exact_without_loops_and_close_with_them():
    rng = random.Random(7)
    for case in range(60):
        loops, n = case % 2, rng.randrange(1, 6)
        nodes = [pii.Mention(i * (10 if loops else 1000), i * (10 if loops else 1000) + 5, "", (rng.random() < 0.5, rng.randrange(3)), rng.choice([4, 4, rng.randrange(4)]))
                 for i in range(n)]
        unary = {f: [rng.gauss(0, 1) for _ in range(5)] for f in ["bias", (0, True), (0, False), (1, 0), (1, 1), (1, 2)]}
        model = pii.Model(unary, rng.random() * 1.5, rng.random() * 0.5)
        skips = [(rng.randrange(i), i) for i in range(1, n) if rng.random() < 0.7]
        got = pii.marginals(nodes, model, skips)
        for a, b in zip(got, enumerated(nodes, model, skips)):
            assert max(abs(x - y) for x, y in zip(a, b)) < (0.1 if loops else 0.01)


def test_weights_are_learned_from_the_rows():
    """Labels that follow their neighbours give positive edges, labels that avoid them negative ones."""
    rows = [((k % 2 == 0,), a, a if agree else 4 - a, -1, 20) for k in range(2) for a in (0, 4) for agree in (True,)]
    model = pii.learn(rows + [((True,), a, -1, 4 - a, 20) for a in (0, 4)])
    assert model.chain > 1 and model.skip < -1
    assert pii.learn([]).scores((True,))[-1] > 0


def test_field_runs_in_every_document_and_leaves_decoys(spark):
    rng = random.Random(8)
    number = lambda n: "".join(rng.choice("123456789") for _ in range(n))
    rows = []
    for i in range(60):
        a, b, c = number(3), number(3), number(4)
        rows.append((i, f"call +1 ({a}) {b}-{c} today, order {number(16)} of page {number(8)} came"))
    a = "+1 (212) 555-0188"
    rows += [(100, f"call {a} or 212 555 0188 or 1 212.555.0188"), (101, "order 1234567812345678 again 1234567812345678"), (102, None), (103, ""),
             (104, "write jane.roe@example.org or jane.roe@ now, @someone"), (105, f"{a} " * 3000 + "or 212 555 0188")]
    rows += [(i, f"mail {chr(97 + i % 26)}{i}@example.org please") for i in range(200, 240)]
    got = {r.doc_id: r for r in pii.scan(documents(spark, rows)).collect()}
    spans = {d: set(filter(None, r.spans.split(","))) for d, r in got.items()}
    assert spans[100] >= {"phone:5:22", "phone:26:38", "phone:42:56"}
    assert spans[101] == spans[102] == spans[103] == set()
    assert {s.split(":")[0] for s in spans[104]} == {"email"} and len(spans[104]) == 2
    assert len(spans[105]) == 3001
    for i, text in rows[:60]:  # some order numbers happen to be cards
        assert spans[i] == set(pii._join(pii.base_spans(text)).split(","))
