"""Best-fit packing by minimum bin slack (operator 3).

Documents become token sequences (public tokenizer, then the separator id) and
are packed whole into as few sequences of at most ``capacity`` tokens as possible.
Per bin the longest open piece is the seed, and a bitset subset-sum dynamic
programme over the lengths still available finds the fullest feasible
combination, which is removed.  Pieces are dealt over groups of bounded size that
pack independently; what is left over in bins that stay open (slack above
``OPEN_SHARE``) is packed again across groups in a second round, so a group
border costs next to nothing.

Defined results: a null text counts as empty and yields the separator alone; rows
that repeat a doc_id are packed each on its own; an empty table packs to no row;
other columns are ignored.
"""

from __future__ import annotations

import sys
from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netvigil.llm.common import cut, prepare

CAPACITY = 4096
SEPARATOR = 1
TOKENIZER = "word_bpe_49k.json"
#: Pieces in a group: one task's memory (about 100 bytes a piece) and the bins a dynamic programme draws from.
GROUP_PIECES = 20_000
OPEN_SHARE = 0.004
#: Units whose ids a Python worker remembers (about 170 bytes each).
CACHE_WORDS = 1_200_000
# The units of the tokenizer file, for ASCII and for all texts.
_ASCII_PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+"
_PARTS = (r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|"
          r"[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\p{L}\p{N}]+")



def _latin_parts() -> str:
    """``_PARTS`` for texts of code points below 256, where the classes can be listed."""
    import unicodedata

    of = lambda kind: "".join(chr(c) for c in range(128, 256) if unicodedata.category(chr(c))[0] == kind)
    return rf"'s|'t|'re|'ve|'m|'ll|'d|[a-zA-Z{of('L')}]+|[0-9{of('N')}]|[^\t-\r \x85\xa0a-zA-Z0-9{of('L')}{of('N')}]+"


_LATIN_PARTS = _latin_parts()
_cache: dict[str, bytes] = {}
_loaded: dict[str, object] = {}
#: Characters that the tokenizer's normaliser treats alike wherever they stand.
_plain: set[str] = set()


def _tokenizer(path: str):
    import os

    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _cache.clear()
        _plain.clear()
        _loaded.clear()
        _loaded[path] = Tokenizer.from_file(path)
    return _loaded[path]


def _joins_back() -> set[str]:
    """Characters that may combine with the one before them."""
    import unicodedata

    out = {chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}
    for c in range(0x110000):
        parts = unicodedata.decomposition(chr(c)).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            out.add(chr(int(parts[1], 16)))
    return out


def _stands_alone(text: str, tok) -> bool:
    """Whether no character of the text changes with its neighbours under composition and lower case, and the
    tokenizer itself normalises and cuts each as ``_parts`` does (its tables may be of another Unicode version)."""
    import unicodedata

    import regex

    if not _plain:
        _plain.update(map(chr, range(128)))
    if not _joiners:
        _joiners.update(_joins_back())
    for c in set(text) - _plain:
        low = c.lower()
        if len(low) != 1 or low.lower() != low or any(
                unicodedata.combining(x) or x in _joiners or not unicodedata.is_normalized("NFC", x) for x in (c, low)):
            return False
        for probe in (f"a{c}a", f"{c}{c}", f"!{c}!"):
            low = "".join([x.lower() for x in probe])
            if tok.normalizer.normalize_str(probe) != low or len(tok.pre_tokenizer.pre_tokenize_str(low)) != len(regex.findall(_PARTS, low)):
                return False
        _plain.add(c)
    return True


_joiners: set[str] = set()


def _parts(text: str, tok) -> list[str] | None:
    """The tokenizer's own units of a text (its normaliser and pre-tokenizer), which merges never cross; None where
    they cannot be told without it: text that may hold a special token, or whose characters change together."""
    import re

    if "<|" in text:
        return None
    if text.isascii():
        return re.findall(_ASCII_PARTS, text.lower())
    import regex

    if not _stands_alone(text, tok):
        return None
    try:
        text.encode("latin-1")
        return re.findall(_LATIN_PARTS, text.lower())
    except UnicodeEncodeError:
        pass
    text = "".join([c.lower() for c in text]) if "\u03a3" in text else text.lower()  # a final sigma is not told apart
    return regex.findall(_PARTS, text)


def token_bytes(texts: list[str | None], path: str) -> list[bytes]:
    """The ids of each whole text as little-endian unsigned 32-bit integers.

    A unit's ids do not depend on what stands around it, so the ids of units met
    before are remembered; the tokenizer itself runs on new ones, and on whole texts
    that cannot be cut beforehand.
    """
    from array import array

    def raw(ids):
        ids = array("I", ids)
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    tok = _tokenizer(path)
    split = [_parts(t or "", tok) for t in texts]
    if len(_cache) > CACHE_WORDS:
        _cache.clear()
    new = list(set().union(*filter(None, split)).difference(_cache))
    for at in range(0, len(new), 10_000):
        part = new[at:at + 10_000]
        for w, e in zip(part, tok.encode_batch_fast(part, add_special_tokens=False)):
            _cache[w] = raw(e.ids)
    return [b"".join(map(_cache.__getitem__, ws)) if ws is not None else raw(tok.encode(t, add_special_tokens=False).ids)
            for t, ws in zip(texts, split)]


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32), cut only where a document is longer than ``capacity``."""
    import pyarrow as pa

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import zlib

        end = SEPARATOR.to_bytes(4, "little")
        for b in batches:
            cols = [[], [], [], [], []]
            for doc, ids in zip(b.column(0).to_pylist(), token_bytes(b.column(1).to_pylist(), path)):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    for c, v in zip(cols, (doc, k, at // 4, len(part) // 4, zlib.crc32(part))):
                        c.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], b.schema.field(0).type), pa.array(cols[1], pa.int32()),
                 *[pa.array(c, pa.int64()) for c in cols[2:]]],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {id_type}, piece int, start bigint, length bigint, ids_crc32 bigint")


def fullest(lengths: list[int], left: dict[int, int], room: int) -> list[int]:
    """The multiset of available lengths with the largest sum within ``room``.

    ``lengths``: ascending lengths with pieces left; ``left``: how many of each.
    Bit s of ``reach`` says that s tokens can be made; a count is added in powers
    of two, so a length costs a logarithm of its count.  Stops once ``room`` is met.
    """
    reach, steps, full = 1, [], (1 << (room + 1)) - 1
    for i in range(bisect_right(lengths, room) - 1, -1, -1):
        n = lengths[i]
        most, take = min(left[n], room // n), 1
        while most > 0:
            take = min(take, most)
            steps.append((reach, n, take))
            reach = (reach | reach << (n * take)) & full
            most -= take
            take *= 2
        if reach >> room & 1:
            break
    total, picked = reach.bit_length() - 1, []
    for before, n, take in reversed(steps):
        if not before >> total & 1:
            picked += [n] * take
            total -= n * take
    return picked


def minimum_bin_slack(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of positions in ``sizes`` (each 1 to ``capacity``), the longest piece left seeding each bin."""
    stock: dict[int, list[int]] = {}
    for k in range(len(sizes) - 1, -1, -1):
        stock.setdefault(sizes[k], []).append(k)
    left = {n: len(v) for n, v in stock.items()}
    lengths, bins = sorted(left), []

    def take(n):
        left[n] -= 1
        if not left[n]:
            lengths.pop(bisect_right(lengths, n) - 1)
        return stock[n].pop()

    while lengths:
        seed = lengths[-1]
        held, room = [take(seed)], capacity - seed
        if room and lengths:
            held += [take(n) for n in fullest(lengths, left, room)]
        bins.append(held)
    return bins


def _pack_groups(rows: DataFrame, groups: int, step: int, capacity: int, schema: str) -> DataFrame:
    def run(pdf):
        pdf = pdf.sort_values(["length", "doc_id", "piece", "start"], ascending=[False, True, True, True],
                              kind="stable").reset_index(drop=True)
        sizes = pdf["length"].tolist()
        number, offset, free = [0] * len(sizes), [0] * len(sizes), [0] * len(sizes)
        base = (int(pdf["_group"].iloc[0]) * 2 + step) << 32
        for k, held in enumerate(minimum_bin_slack(sizes, capacity)):
            at = 0
            for i in held:
                number[i], offset[i] = base + k, at
                at += sizes[i]
            for i in held:
                free[i] = capacity - at
        return pdf.drop(columns="_group").assign(sequence_id=number, offset=offset, _free=free)

    mixed = rows.withColumn("_group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    return mixed.groupBy("_group").applyInPandas(run, schema)


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY,
         group_pieces: int = GROUP_PIECES) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row a piece."""
    prepare(docs.sparkSession)
    cut_up = cut(pieces(docs, path, capacity))  # tokenised once; rows stay in place for the dealing below
    n = cut_up.count()
    schema = (f"doc_id {cut_up.schema['doc_id'].dataType.simpleString()}, piece int, start bigint, length bigint, "
              "ids_crc32 bigint, sequence_id bigint, offset bigint, _free bigint")
    first = cut(_pack_groups(cut_up, max(1, -(-n // group_pieces)), 0, capacity, schema))
    is_open = F.col("_free") > int(capacity * OPEN_SHARE)
    again = cut(first.where(is_open).drop("sequence_id", "offset", "_free"))
    second = _pack_groups(again, max(1, -(-again.count() // group_pieces)), 1, capacity, schema)
    return first.where(~is_open).unionByName(second).drop("_free")
