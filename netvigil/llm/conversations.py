"""Conversation structure repair by a square-root checkpointed DP (operator 11).

A conversation is read as the initials of its roles and edited at least cost into
``(s?(ua)+)?``: Keep 0, Rerole to user or assistant 3, Delete 4 (the only edit of a
blank or repeated message), Insert an empty user or assistant message 3; a truncated
message that stays costs 3.  Of all cheapest edit scripts the ASCII-least is taken.

The DP runs backward: a vector holds, for each of four states (nothing yet, after s, u
or a), the least cost of what is still to come.  Vectors are stored at checkpoints only,
every square root of the rows; the forward walk recomputes the vectors of one block at a
time and emits the ASCII-least edit that is tight.

On Spark, rows are range partitioned by (conversation, turn, ...) and sorted, so one
conversation may lie over any number of tasks.  A task cuts its rows into blocks.  A
conversation that lies whole in one block is finished there.  For the others the blocks
are the checkpoint intervals: each block becomes a 4 x 4 min-plus matrix, a streamed
backward scan over the matrices gives the vector at every block border, every block is
walked from all four states at once, a streamed forward scan picks the state that each
block is entered in.  Neither a task nor a group ever holds more than one block of rows.

Defined results: a null conv_id is a conversation of its own; a null role or text is one
space; null turns come first, rows of one turn in the order of md5(role, NUL, text); an empty role
has no initial; identical rows are repeats, all but the first are duplicates; a conversation
without rows has zeros and an empty audit; an empty table gives an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from math import inf, isqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netvigil.llm.common import Scratch, prepare

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: A block has at most this many bytes of text (one message more, if it is longer) ...
BLOCK_BYTES = 256 << 10
#: ... and at most the square root of all rows, but not fewer than this.
LEAST_BLOCK = 256
SPACE = " \t\n\x0b\x0c\r"

# A row's code: two bits of initial (s, u, a, other), then its faults.
_INITIAL = {"s": 0, "u": 1, "a": 2}
BLANK, REPEATED, CUT_OFF = 4, 8, 16
#: State after one more message of the only role that may follow (0 start, 1 s, 2 u, 3 a).
_NEXT = (2, 2, 3, 2)
_NEXT_INITIAL = (1, 1, 2, 1)
_ROLE_OF = (None, None, "user", "assistant")
END = (0, 2 * INSERT, INSERT, 0)  # what the four states still cost after the last row


def faults(text: str) -> int:
    bare = text.rstrip(SPACE)
    return BLANK if not bare else 0 if bare[-1] in ".!?" else CUT_OFF


def first_fault(code: int) -> int:
    """BLANK, REPEATED, CUT_OFF or 0: the first that applies."""
    return code & BLANK or code & REPEATED or code & CUT_OFF


def _closed(b0, b1, b2, b3):
    """Inserts in front of a row."""
    c2, c3 = min(b2, INSERT + b3), min(b3, INSERT + b2)
    return min(b0, INSERT + c2), min(b1, INSERT + c2), c2, c3


def back(vector, code: int):
    """The vector in front of a row, from the vector behind it."""
    v0, v1, v2, v3 = vector
    b0, b1, b2, b3 = v0 + DELETE, v1 + DELETE, v2 + DELETE, v3 + DELETE
    if not code & (BLANK | REPEATED):
        extra, initial = TRUNCATED if code & CUT_OFF else 0, code & 3
        user = v2 + extra + (KEEP if initial == 1 else REROLE)
        b0, b1, b3 = min(b0, user), min(b1, user), min(b3, user)
        b2 = min(b2, v3 + extra + (KEEP if initial == 2 else REROLE))
        if initial == 0:
            b0 = min(b0, v1 + extra + KEEP)
    return _closed(b0, b1, b2, b3)


def matrix(codes: bytes) -> list[float]:
    """16 numbers: entry 4 q + e is the least cost from state q in front of the rows to state e behind them."""
    rows = []
    for e in range(4):
        v = tuple(0 if e == q else inf for q in range(4))
        for code in reversed(codes):
            v = back(v, code)
        rows.append(v)
    return [rows[e][q] for q in range(4) for e in range(4)]


def through(m: list[float], vector) -> tuple:
    return tuple(min(m[4 * q + e] + vector[e] for e in range(4)) for q in range(4))


def checkpoints(codes: bytes, end) -> tuple[int, list]:
    """The block length and the vectors behind every block of that length."""
    step, v, held = max(1, isqrt(len(codes))), tuple(end), []
    for i in range(len(codes) - 1, -1, -1):
        if (i + 1) % step == 0 or i + 1 == len(codes):
            held.append(v)
        v = back(v, codes[i])
    return step, held[::-1]


def walk(codes: bytes, end, starts=(0,), last: bool = True) -> list[tuple[str, int]]:
    """For each start state (edits, state behind the rows): the ASCII-least tight edits.

    ``end``: the vector behind the rows; ``last``: nothing follows, so open pairs are closed.
    """
    step, held = checkpoints(codes, end)
    states, edits = list(starts), [[] for _ in starts]
    for b, behind in enumerate(held):
        lo, hi = b * step, min(len(codes), (b + 1) * step)
        vectors = [behind]
        for i in range(hi - 1, lo - 1, -1):
            vectors.append(back(vectors[-1], codes[i]))
        vectors.reverse()
        for k, out in enumerate(edits):
            q = states[k]
            for i in range(lo, hi):
                here, there, code = vectors[i - lo], vectors[i - lo + 1], codes[i]
                stays = not code & (BLANK | REPEATED)
                extra, initial = TRUNCATED if code & CUT_OFF else 0, code & 3
                while True:
                    nxt = _NEXT[q]
                    if here[q] == there[q] + DELETE:
                        out.append("D")
                        break
                    if here[q] == here[nxt] + INSERT:
                        out.append("I")
                        q = nxt
                        continue
                    kept = 1 if q == 0 and initial == 0 else nxt if initial == _NEXT_INITIAL[q] else None
                    if stays and kept is not None and here[q] == there[kept] + extra + KEEP:
                        out.append("K")
                        q = kept
                        break
                    out.append("R")  # the only edit left
                    q = nxt
                    break
            states[k] = q
    if last:
        for k, out in enumerate(edits):
            while states[k] in (1, 2):
                out.append("I")
                states[k] = _NEXT[states[k]]
    return ["".join(out) for out in edits], states


def apply(edits: str, state: int, roles: list[str], texts: list[str]):
    """The repaired (roles, texts) of the rows, entered in ``state``."""
    out_roles, out_texts, i = [], [], 0
    for e in edits:
        if e == "D":
            i += 1
            continue
        start_kept = e == "K" and state == 0 and roles[i][:1] == "s"
        state = 1 if start_kept else _NEXT[state]
        if e == "I":
            out_roles.append(_ROLE_OF[state])
            out_texts.append("")
            continue
        out_roles.append(roles[i] if e == "K" else _ROLE_OF[state])
        out_texts.append(texts[i])
        i += 1
    return out_roles, out_texts


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, times): the damage of the contract; ``times`` 0 drops a row, 2 repeats it."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    text = spaced("text")
    return rows.select("conv_id", "turn", F.when(kind == 4, F.lit("user")).otherwise(spaced("role")).alias("role"),
                       F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
                       F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("times"))


class _Block:
    """Rows of one conversation, in order."""

    def __init__(self, conv):
        self.conv, self.roles, self.texts, self.turns, self.codes = conv, [], [], [], bytearray()
        self.keys, self.seen, self.size = [], set(), 0

    def add(self, turn, role, text):
        key = hashlib.md5(role.encode() + b"\0" + text.encode()).digest()
        code = _INITIAL.get(role[:1], 3) | faults(text)
        if key in self.seen and not code & BLANK:
            code |= REPEATED
        self.seen.add(key)
        self.keys.append(key)
        self.roles.append(role)
        self.texts.append(text)
        self.turns.append(turn)
        self.codes.append(code)
        self.size += len(text)

    def turn_span(self):
        turns = [t for t in self.turns if t is not None]
        return (turns[0], turns[-1], len(set(turns))) if turns else (None, None, 0)


def counts(codes: bytes) -> tuple[int, int, int]:
    found = [first_fault(c) for c in codes]
    return found.count(BLANK), found.count(REPEATED), found.count(CUT_OFF)


def illegal_pairs(initials: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


def _pieces_schema(rows: DataFrame) -> T.StructType:
    kind = {f.name: f.dataType for f in rows.schema}
    long, text = T.LongType(), T.StringType()
    fields = [("conv_id", kind["conv_id"]), ("part", long), ("piece", long), ("whole", T.BooleanType()), ("n_rows", long),
              ("turn_min", kind["turn"]), ("turn_max", kind["turn"]), ("turns", long), ("blank", long), ("duplicate", long),
              ("truncated", long), ("illegal", long), ("first", text), ("last", text), ("cost", long), ("audit", text),
              ("roles", T.ArrayType(text)), ("texts", T.ArrayType(text)), ("codes", T.BinaryType()), ("keys", T.BinaryType())]
    return T.StructType([T.StructField(n, t) for n, t in fields])


def _cut_blocks(limit: int, schema: T.StructType):
    """Sorted rows to blocks; only the first and the last conversation of a task may go on in another one."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, part = to_arrow_schema(schema), TaskContext.get().partitionId()
        out, at, block, opened = [], 0, None, True  # opened: what comes before the block's rows is not known here

        def close(more: bool):
            nonlocal at, out
            whole = not opened and not more
            lo, hi, turns = block.turn_span()
            codes = bytes(block.codes)
            initials = [r[:1] for r in block.roles]
            row = [block.conv, part, at, whole, len(codes), lo, hi, turns, *counts(codes), illegal_pairs(initials),
                   initials[0] if initials else None, initials[-1] if initials else None]
            if whole:
                v = END
                for code in reversed(codes):
                    v = back(v, code)
                (audit,), _ = walk(codes, END)
                row += [int(v[0]), audit, *apply(audit, 0, block.roles, block.texts), None, None]
            else:
                row += [None, None, block.roles, block.texts, codes, b"".join(block.keys)]
            out.append(row)
            at += 1

        def flush():
            nonlocal out
            cols, out = list(zip(*out)), []
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow)], schema=arrow)

        for b in batches:
            for conv, turn, role, text, times in zip(*[c.to_pylist() for c in b.columns]):
                if block is None or conv != block.conv:
                    if block is not None:
                        close(False)
                        opened = False
                    block = _Block(conv)
                for _ in range(times):
                    if len(block.codes) >= limit or block.size >= BLOCK_BYTES:
                        close(True)
                        opened, block = True, _Block(conv)
                    block.add(turn, role, text)
                if len(out) >= 256 or (out and sum(len(r[-3]) for r in out[-1:]) > limit):
                    yield flush()
        if block is not None:
            close(True)
        if out:
            yield flush()

    return run


def _stream(df: DataFrame, order: list, fn, schema: str) -> DataFrame:
    """``fn(rows)`` over each task's rows as tuples, sorted by conversation and ``order``, with all pieces of a conversation
    in one task: pieces are few and small, and pass one by one."""
    names, shape = df.columns, T.StructType.fromDDL(schema)

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(shape)
        held = []
        for row in fn(dict(zip(names, r)) for b in batches for r in zip(*[c.to_pylist() for c in b.columns])):
            held.append(row)
            if len(held) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), arrow)], schema=arrow)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), arrow)], schema=arrow)

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, "conv_id").sortWithinPartitions("conv_id", *order).mapInArrow(run, schema)


def _chain(rows, same, finish):
    """Runs of equal conv_id in a sorted stream: yields what ``same(state, row)`` gives, then what ``finish(conv, state)`` gives."""
    conv, state = None, None
    for row in rows:
        if state is None or row["conv_id"] != conv:
            if state is not None:
                yield from finish(conv, state)
            conv, state = row["conv_id"], {}
        yield from same(state, row)
    if state is not None:
        yield from finish(conv, state)


def _with_repeats(open_: DataFrame, held: Scratch) -> DataFrame:
    """Pieces with the repeats of messages that an earlier piece of the conversation holds marked in ``codes``."""
    key = F.struct("part", "piece")

    def local(batches):  # one entry a piece and message
        import pyarrow as pa

        for b in batches:
            out = [[], [], [], [], []]
            for conv, part, piece, codes, keys in zip(*[c.to_pylist() for c in b.columns]):
                for i, code in enumerate(codes):
                    if not code & (BLANK | REPEATED):
                        for c, v in zip(out, (conv, part, piece, i, keys[16 * i:16 * i + 16])):
                            c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], b.schema.field(0).type), *[pa.array(c, pa.int64()) for c in out[1:4]], pa.array(out[4], pa.binary())],
                                             names=["conv_id", "part", "piece", "place", "key"])

    id_type = open_.schema["conv_id"].dataType.simpleString()
    seen = held.cut(open_.select("conv_id", "part", "piece", "codes", "keys")
                    .mapInArrow(local, f"conv_id {id_type}, part bigint, piece bigint, place bigint, key binary"))
    first = (seen.groupBy("conv_id", "key").agg(F.min(key).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
             .select(F.col("conv_id").alias("c"), F.col("key").alias("k"), "first"))
    again = (seen.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("key") == F.col("k")))
             .where(key > F.col("first")).groupBy("part", "piece").agg(F.collect_list("place").alias("again")))

    def mark(batches):
        import pyarrow as pa

        for b in batches:
            codes = []
            for c, places in zip(b.column("codes").to_pylist(), b.column("again").to_pylist()):
                c = bytearray(c)
                for p in places or ():
                    c[p] |= REPEATED
                codes.append(bytes(c))
            facts = list(zip(*[counts(c) for c in codes])) or [[], [], []]
            m = [[None if x == inf else int(x) for x in matrix(c)] for c in codes]
            keep = [b.column(n) for n in ("conv_id", "part", "piece", "turn_min", "turn_max", "turns", "illegal", "first", "last")]
            yield pa.RecordBatch.from_arrays(
                [*keep, *[pa.array(f, pa.int64()) for f in facts], pa.array(codes, pa.binary()), pa.array(m, pa.list_(pa.int64()))],
                names=["conv_id", "part", "piece", "turn_min", "turn_max", "turns", "illegal", "first", "last", "blank", "duplicate", "truncated", "codes", "matrix"])

    turn = open_.schema["turn_min"].dataType.simpleString()
    slim = open_.select("conv_id", "part", "piece", "turn_min", "turn_max", "turns", "illegal", "first", "last", "codes")
    return held.cut(slim.join(again, ["part", "piece"], "left").select(*slim.columns, "again").mapInArrow(
        mark, f"conv_id {id_type}, part bigint, piece bigint, turn_min {turn}, turn_max {turn}, turns bigint, illegal bigint, first string, last string, "
              "blank bigint, duplicate bigint, truncated bigint, codes binary, matrix array<bigint>"))


def _borders(pieces: DataFrame) -> DataFrame:
    """Backward scan: the vectors behind and in front of each piece, and whether it is its conversation's last."""

    def same(state, row):
        behind, last = state.get("v", END), not state
        state["v"] = through([inf if x is None else x for x in row["matrix"]], behind)
        yield row["conv_id"], row["part"], row["piece"], [int(x) for x in behind], [int(x) for x in state["v"]], last

    id_type = pieces.schema["conv_id"].dataType.simpleString()
    return _stream(pieces.select("conv_id", "part", "piece", "matrix"), [F.desc("part"), F.desc("piece")],
                   lambda rows: _chain(rows, same, lambda conv, state: ()), f"conv_id {id_type}, part bigint, piece bigint, behind array<bigint>, front array<bigint>, is_last boolean")


def _walks(batches):
    import pyarrow as pa

    for b in batches:
        audits, exits = [], []
        for codes, vector, last in zip(*[b.column(n).to_pylist() for n in ("codes", "behind", "is_last")]):
            a, e = walk(codes, vector, (0, 1, 2, 3), last)
            audits.append(a)
            exits.append(e)
        names = ["conv_id", "part", "piece", "behind", "front"]
        yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], pa.array(audits, pa.list_(pa.string())), pa.array(exits, pa.list_(pa.int64()))],
                                         names=[*names, "audits", "exits"])


def _entered(walked: DataFrame) -> DataFrame:
    """Forward scan: the state that each piece is entered in, its edits and their cost."""

    def same(state, row):
        q = state.get("q", 0)
        state["q"] = out = row["exits"][q]
        yield row["part"], row["piece"], q, row["audits"][q], row["front"][q] - row["behind"][out]

    return _stream(walked, ["part", "piece"], lambda rows: _chain(rows, same, lambda conv, state: ()),
                   "part bigint, piece bigint, state bigint, audit string, cost bigint")


def repair(rows: DataFrame, block_rows: int | None = None, partitions: int | None = None) -> DataFrame:
    """Repaired conversations in pieces, one row a piece; a conversation's pieces in the order of (part, piece).

    ``rows``: conv_id, turn, role, text and, if there, times (0 leaves a row out, 2 repeats it).  Columns:
    conv_id, part, piece, whole (the only piece), n_rows, turn_min, turn_max, turns (distinct), the fault counts
    blank, duplicate, truncated and illegal (pairs inside the piece), first and last (initials of the damaged rows),
    cost, audit (the edits), roles and texts (the repaired messages).
    """
    spark = rows.sparkSession
    prepare(spark)
    times = F.col("times").cast("int") if "times" in rows.columns else F.lit(1)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), times.alias("times"))
    limit = block_rows or max(LEAST_BLOCK, isqrt(rows.count()))
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["conv_id", "turn", "_tie", "_copy"]  # copies of one row may fill several tasks
    tied = (rows.withColumn("_tie", F.md5(F.concat(F.col("role"), F.lit("\0"), F.col("text")).cast("binary")))
            .withColumn("_copy", F.monotonically_increasing_id()))
    ranged = tied.repartitionByRange(n, *order).sortWithinPartitions(*order).drop("_tie", "_copy")
    schema, held = _pieces_schema(rows), Scratch(spark)
    pieces = held.cut(ranged.mapInArrow(_cut_blocks(limit, schema), schema))
    final = ["conv_id", "part", "piece", "whole", "n_rows", "turn_min", "turn_max", "turns", "blank", "duplicate", "truncated",
             "illegal", "first", "last", "cost", "audit", "roles", "texts"]
    closed, open_ = pieces.where("whole").select(*final), pieces.where("not whole")
    marked = _with_repeats(open_, held)
    behind = held.cut(_borders(marked).drop("conv_id"))
    id_type = rows.schema["conv_id"].dataType.simpleString()
    walked = held.cut(marked.select("conv_id", "part", "piece", "codes").join(behind, ["part", "piece"])
                      .mapInArrow(_walks, f"conv_id {id_type}, part bigint, piece bigint, behind array<bigint>, front array<bigint>, audits array<string>, exits array<bigint>"))
    entered = held.cut(_entered(walked))

    def edit(batches):
        import pyarrow as pa

        for b in batches:
            got = [apply(a, q, r, t) for a, q, r, t in zip(*[b.column(n).to_pylist() for n in ("audit", "state", "roles", "texts")])]
            cols = {n: b.column(n) for n in b.schema.names if n != "state"}
            cols["roles"] = pa.array([g[0] for g in got], pa.list_(pa.string()))
            cols["texts"] = pa.array([g[1] for g in got], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([cols[n] for n in final], names=final)

    facts = ["blank", "duplicate", "truncated"]
    raw = open_.drop(*facts, "audit", "cost", "codes", "keys").join(marked.select("part", "piece", *facts), ["part", "piece"]).join(entered, ["part", "piece"])
    shape = T.StructType([schema[c] for c in final])
    return closed.unionByName(raw.select(*final, "state").mapInArrow(edit, shape))


def digest(pieces: DataFrame) -> DataFrame:
    """One row a conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    What lies in one piece is summed up by built-in functions; the pieces of the others pass through
    one task in order (a SHA-256 has no parts that could be joined), one piece at a time.
    """
    id_type = pieces.schema["conv_id"].dataType.simpleString()
    out = (f"conv_id {id_type}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, "
           "audit string, repaired_sha256 string")
    lines = F.array_join(F.transform(F.arrays_zip("roles", "texts"), lambda m: F.concat(m["roles"], F.lit(":"), m["texts"])), "\n")
    gaps = F.coalesce(F.col("turn_max") - F.col("turn_min") + 1 - F.col("turns"), F.lit(0)).cast("long")
    facts = ["blank", "duplicate", "truncated", "illegal", "cost"]
    closed = pieces.where("whole").select("conv_id", gaps.alias("gaps"), *facts, "audit", F.sha2(lines.cast("binary"), 256).alias("repaired_sha256"))

    def same(state, row):
        if not state:
            state |= {"n": dict.fromkeys(facts, 0), "audit": [], "sha": hashlib.sha256(), "lines": 0, "turns": 0, "lo": None, "hi": None, "last": None}
        for c in facts:
            state["n"][c] += row[c]
        state["audit"].append(row["audit"])
        if row["n_out"]:
            state["sha"].update((("\n" if state["lines"] else "") + row["lines"]).encode())
            state["lines"] += row["n_out"]
        if row["n_rows"]:
            if state["last"] is not None:
                state["n"]["illegal"] += illegal_pairs([state["last"], row["first"]])
            state["last"] = row["last"]
        if row["turns"]:
            state["turns"] += row["turns"] - (state["hi"] == row["turn_min"])
            state["lo"] = row["turn_min"] if state["lo"] is None else state["lo"]
            state["hi"] = row["turn_max"]
        return ()

    def finish(conv, state):
        missing = state["hi"] - state["lo"] + 1 - state["turns"] if state["turns"] else 0
        yield conv, missing, *[state["n"][c] for c in facts], "".join(state["audit"]), state["sha"].hexdigest()

    open_ = pieces.where("not whole").select("conv_id", "part", "piece", "n_rows", "turn_min", "turn_max", "turns", *facts, "first", "last", "audit",
                                             F.size("roles").alias("n_out"), lines.alias("lines"))
    return closed.unionByName(_stream(open_, ["part", "piece"], lambda rows: _chain(rows, same, finish), out))
