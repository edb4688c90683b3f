"""Operator 11 against plain Python: all edit scripts by a memoised search over whole strings."""

import hashlib
import random
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from netvigil.llm import conversations as C

LEGAL = {"": {"s", "u"}, "s": {"u"}, "u": {"a"}, "a": {"u"}}
SCHEMA = "conv_id long, turn long, role string, text string"
WS = " \t\n\x0b\x0c\r"


def plain(rows):
    """{conv_id: (gaps, blank, duplicate, truncated, illegal, cost, audit, sha)} straight from the contract."""
    out = {}
    for conv in {r[0] for r in rows}:
        got = []
        of = [(r[1], r[2] if r[2] is not None else " ", r[3] if r[3] is not None else " ") for r in rows if r[0] == conv]
        for turn, role, text in of:
            h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            if h == 1:
                text = ""
            if h == 2:
                text = "".join(c for c in text if c not in ".!?")
            if h == 4:
                role = "user"
            got += [(turn, role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
        got.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(f"{r[1]}\0{r[2]}".encode()).hexdigest()))
        faults, seen = [], set()
        for _, role, text in got:
            bare = text.strip(WS)
            faults.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, _, _ in got if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [r[:1] for _, r, _ in got]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))

        @lru_cache(None)
        def best(i, state):
            """(cost, audit, messages) of what is left."""
            found = [(0, "", ())] if i == len(got) and state in ("", "a") else []
            if i < len(got):
                _, role, text = got[i]
                c, a, m = best(i + 1, state)
                found.append((c + 4, "D" + a, m))
                if faults[i] not in ("b", "d"):
                    extra = 3 * (faults[i] == "t")
                    for price, letter, new in ((0, "K", role), (3, "R", "user"), (3, "R", "assistant")):
                        if new[:1] in LEGAL[state]:
                            c, a, m = best(i + 1, new[:1])
                            found.append((c + price + extra, letter + a, ((new, text), *m)))
            for new in ("user", "assistant"):
                if new[0] in LEGAL[state] and inserts[0] < 3:
                    inserts[0] += 1
                    c, a, m = best_after_insert(i, new[0])
                    inserts[0] -= 1
                    found.append((c + 3, "I" + a, ((new, ""), *m)))
            return min(found, key=lambda f: f[:2]) if found else (10**9, "", ())

        inserts = [0]

        def best_after_insert(i, state):
            return best.__wrapped__(i, state)

        cost, audit, messages = best(0, "")
        body = "\n".join(f"{r}:{t}" for r, t in messages)
        out[conv] = (gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256(body.encode()).hexdigest())
    return out


def rows_of(seed, convs, longest, turn_of=lambda rng, k: k):
    rng = random.Random(seed)
    texts = ["Hello there.", "Hi", "What?", "", " \n", "Yes!", "More. ", "cut off", "é…", "Done.\t"]
    return [(c, turn_of(rng, k), rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", "User", None]),
             rng.choice([*texts, None]) + str(rng.randrange(3)) if False else rng.choice([*texts, None]))
            for c in range(convs) for k in range(rng.randrange(1, longest))]


def run(spark, rows, **how):
    df = spark.createDataFrame(rows, SCHEMA)
    got = C.digest(C.repair(C.damage(df), **how)).collect()
    return {r["conv_id"]: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"], r["repaired_sha256"]) for r in got}


@pytest.mark.parametrize("seed,block_rows,partitions", [(1, None, 3), (2, 2, 4), (3, 5, 7)])
def test_like_the_contract(spark, seed, block_rows, partitions):
    rows = rows_of(seed, 150, 12)
    assert run(spark, rows, block_rows=block_rows, partitions=partitions) == plain(rows)


def test_one_conversation_over_all_tasks(spark):
    rows = rows_of(5, 1, 2) + [(7, k, r, t) for k, (_, _, r, t) in enumerate(rows_of(6, 40, 9))]
    assert run(spark, rows, block_rows=6, partitions=8) == plain(rows)


def test_null_turns_ties_and_repeated_rows(spark):
    rows = rows_of(8, 60, 10, lambda rng, k: rng.choice([None, 1, 1, 2, 5])) + [(None, None, "user", "Same.")] * 30 + [(None, 3, None, None)]
    assert run(spark, rows, block_rows=3, partitions=5) == plain(rows)


def test_empty_table_extra_columns_and_long_text(spark):
    assert run(spark, []) == {}
    rows = [(1, 0, "user", "x" * 3_000_000 + "."), (1, 1, "assistant", "ok.")]
    assert run(spark, rows) == plain(rows)
    clash = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("part", "piece", "whole", "_tie", "_copy", "audit", "times_")})
    assert C.repair(C.damage(clash)).count() >= 1


def test_checkpoints_hold_the_vectors_of_the_whole_backward_pass():
    rng = random.Random(3)
    codes = bytes(rng.randrange(32) for _ in range(50))
    vectors = [C.END]
    for code in reversed(codes):
        vectors.append(C.back(vectors[-1], code))
    vectors.reverse()
    step, held = C.checkpoints(codes, C.END)
    assert step == 7 and held == [vectors[min(50, (b + 1) * 7)] for b in range(8)]
    assert C.through(C.matrix(codes[:20]), vectors[20]) == vectors[0]
