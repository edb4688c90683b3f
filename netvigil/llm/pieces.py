"""SentencePiece encoding and decoding in vectorised merge rounds (operator 13).

For a BPE model with byte pieces.  A text is normalised by the model's own rules and cut
into words, which no piece crosses.  The words of a batch that are not known yet lie one
after the other in flat numpy arrays: a symbol and its segment for every character.  In
each round every segment finds the least rank among its adjacent pairs (a segmented
minimum), merges all occurrences of that pair at once, leftmost first, and the arrays are
compacted; segments without a pair to merge leave.  Segments also end where two
characters stand together in no piece, so runs without spaces stay short.

Merging all occurrences at once equals merging one by one unless the merged piece can
start a pair of a rank no worse than its own.  Such pieces are known from the vocabulary;
where one occurs more than once in a segment, a sweep from the left merges occurrence by
occurrence, each with the better pairs that it makes.

Defined results: a null text counts as empty and has no ids; rows that repeat a doc_id
get a row each; characters outside the vocabulary become their UTF-8 bytes; an empty table
gives an empty result; other columns are ignored.  Decoding takes any ids: bytes that are
no UTF-8 become U+FFFD one by one, control ids nothing, the unknown id its sign;
no list of ids is an empty text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netvigil.llm.common import prepare

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
UNKNOWN_SIGN = " ⁇ "
#: Words whose ids a Python worker remembers, and how long they may be (about 200 bytes each).
CACHE_WORDS = 500_000
CACHE_LENGTH = 48
NEVER = 2**31 - 1
#: Ids whose bytes are gathered at once.
DECODED = 1 << 18


@dataclass
class Vocabulary:
    normalize: object
    #: symbol of a code point; 0 if no piece holds it.  Symbols are ids + 1, then characters that are no piece
    char_symbol: object
    #: position of a code point among the characters of pieces (0: none), and which of them stand together in a piece
    char_place: object
    together: object
    #: sorted pairs (left symbol * symbols + right symbol), and for each the merged symbol and its rank
    pair_key: object
    pair_symbol: object
    pair_rank: object
    #: per symbol: merging it may make a pair of no worse rank
    early: object
    #: the bytes that the ids decode to, one after the other, and per id where they start and how many they are
    surface_bytes: object
    surface_start: object
    surface_size: object
    #: ids of the 256 byte pieces
    byte_id: object
    #: per symbol: its id, or -1 where it has to be spelled in bytes
    symbol_id: object
    symbols: int
    #: whether no piece goes on with a space after another character
    spaces_start: bool
    #: per id: whether it loses its leading space at the start of a text
    spaced: object

    def rank(self, left: int, right: int) -> tuple[int, int]:
        """(rank, merged symbol) of one pair."""
        return self.pairs.get(left * self.symbols + right, (NEVER, 0))

    def __post_init__(self):
        self.pairs = dict(zip(self.pair_key.tolist(), zip(self.pair_rank.tolist(), self.pair_symbol.tolist())))


def vocabulary(path: str) -> Vocabulary:
    import numpy as np
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    names = [sp.id_to_piece(i) for i in range(n)]
    special = [sp.is_control(i) or sp.is_unknown(i) for i in range(n)]
    is_byte = [sp.is_byte(i) for i in range(n)]
    if sum(is_byte) != 256 or any(sp.is_unused(i) for i in range(n)):
        raise ValueError("a BPE model with byte pieces and without unused ones is needed")
    symbol = {names[i]: i + 1 for i in range(n) if not special[i] and not is_byte[i]}
    score = {p: sp.get_score(s - 1) for p, s in symbol.items()}
    order = {s: k for k, s in enumerate(sorted(set(score.values()), reverse=True))}
    rank = {p: order[s] for p, s in score.items()}
    chars = sorted({c for p in symbol for c in p})
    every = dict(symbol)
    for c in chars:
        every.setdefault(c, n + 1 + len(every) - len(symbol))
    symbols = n + 1 + len(every) - len(symbol)
    char_symbol, char_place = np.zeros(0x110000, np.int32), np.zeros(0x110000, np.int32)
    for k, c in enumerate(chars):
        char_symbol[ord(c)], char_place[ord(c)] = every[c], k + 1
    together = np.zeros((len(chars) + 1, len(chars) + 1), bool)
    early = np.zeros(symbols, bool)
    pairs = {}
    for p, s in symbol.items():
        for a, b in zip(p, p[1:]):
            together[char_place[ord(a)], char_place[ord(b)]] = True
        for k in range(1, len(p)):
            if p[:k] in every and p[k:] in every:
                pairs[every[p[:k]] * symbols + every[p[k:]]] = (s, rank[p])
                for part in (p[:k], p[k:]):
                    if part in rank and rank[p] <= rank[part]:
                        early[symbol[part]] = True
    keys = np.array(sorted(pairs), np.int64)
    byte_id = np.zeros(256, np.int32)
    surface = []
    for i in range(n):
        if is_byte[i]:
            byte_id[int(names[i][3:5], 16)] = i
            surface.append(bytes([int(names[i][3:5], 16)]))
        else:
            surface.append((UNKNOWN_SIGN if sp.is_unknown(i) else "" if special[i] else names[i].replace(SPACE, " ")).encode())
    symbol_id = np.full(symbols, -1, np.int32)
    symbol_id[[s for s in symbol.values()]] = [s - 1 for s in symbol.values()]
    spaced = np.zeros(n, bool)
    if sp.normalize("a")[0] == SPACE:
        spaced[[s - 1 for p, s in symbol.items() if p[0] == SPACE]] = True
    sizes = np.array([len(s) for s in surface])
    return Vocabulary(sp.normalize, char_symbol, char_place, together, keys, np.array([pairs[k][0] for k in keys.tolist()], np.int32),
                      np.array([pairs[k][1] for k in keys.tolist()], np.int32), early, np.frombuffer(b"".join(surface), np.uint8),
                      np.cumsum(sizes) - sizes, sizes, byte_id, symbol_id, symbols,
                      not any(a != SPACE and b == SPACE for p in symbol for a, b in zip(p, p[1:])), spaced)


def _pair_ranks(voc: Vocabulary, left, right):
    import numpy as np

    key = left.astype(np.int64) * voc.symbols + right
    at = np.minimum(np.searchsorted(voc.pair_key, key), len(voc.pair_key) - 1)
    hit = voc.pair_key[at] == key
    return np.where(hit, voc.pair_rank[at], NEVER), np.where(hit, voc.pair_symbol[at], 0)


def _swept(voc: Vocabulary, symbols: list[int], places: list[int], least: int):
    """All merges of rank ``least`` from the left, each followed by the pairs of no worse rank that it makes."""
    left, at = [], []
    right, right_at = symbols[::-1], places[::-1]
    while right:
        left.append(right.pop())
        at.append(right_at.pop())
        if not right or voc.rank(left[-1], right[-1])[0] != least:
            continue
        left[-1] = voc.rank(left[-1], right.pop())[1]
        right_at.pop()
        while True:
            before = voc.rank(left[-2], left[-1]) if len(left) > 1 else (NEVER, 0)
            behind = voc.rank(left[-1], right[-1]) if right else (NEVER, 0)
            if min(before[0], behind[0]) > least:
                break
            if before[0] <= behind[0]:
                left.pop()
                at.pop()
                left[-1] = before[1]
            else:
                right.pop()
                right_at.pop()
                left[-1] = behind[1]
    return left, at


def merged(words: list[str], voc: Vocabulary):
    """(word, place, symbol) arrays, in order, of what is left when no pair can be merged; place: the symbol's first character."""
    import numpy as np

    code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    word = np.repeat(np.arange(len(words)), [len(w) for w in words])
    symbol, place = voc.char_symbol[code], np.arange(len(code))
    near = voc.char_place[code]
    starts = np.ones(len(code), bool)
    starts[1:] = (word[1:] != word[:-1]) | ~voc.together[near[:-1], near[1:]]
    segment = np.cumsum(starts) - 1
    done = []

    def ranks_of(sym, seg):
        rank, into = np.full(len(sym), NEVER, np.int32), np.zeros(len(sym), np.int32)
        inside = np.flatnonzero(seg[:-1] == seg[1:])
        rank[inside], into[inside] = _pair_ranks(voc, sym[inside], sym[inside + 1])
        return rank, into

    rank, into = ranks_of(symbol, segment)
    while len(symbol):
        begin = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
        least = np.minimum.reduceat(rank, begin)
        size = np.diff(np.r_[begin, len(symbol)])
        over = np.repeat(least == NEVER, size)
        if over.any():  # segments without a pair to merge leave
            done.append((place[over], symbol[over]))
            live = ~over
            symbol, place, segment, rank, into = symbol[live], place[live], segment[live], rank[live], into[live]
            size, least = size[least != NEVER], least[least != NEVER]
            if not len(symbol):
                break
        group = np.repeat(np.arange(len(size)), size)
        hit = np.flatnonzero(rank == least[group])
        run = np.r_[True, np.diff(hit) != 1]
        first = hit[np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))]
        pick = hit[(hit - first) % 2 == 0]  # in a run like aaaa every other pair
        several = np.bincount(group[hit], minlength=len(size)) > 1
        one_by_one = np.zeros(len(size), bool)
        one_by_one[group[pick[voc.early[into[pick]]]]] = True
        one_by_one &= several
        pick = pick[~one_by_one[group[pick]]]
        stays = np.ones(len(symbol), bool)
        symbol = symbol.copy()
        symbol[pick] = into[pick]
        stays[pick + 1] = False
        stale = np.zeros(len(symbol), bool)
        stale[pick] = True
        stale[np.maximum(pick - 1, 0)] = True
        for g in np.flatnonzero(one_by_one):
            lo = int(np.searchsorted(group, g))
            hi = lo + int(size[g])
            left, at = _swept(voc, symbol[lo:hi].tolist(), place[lo:hi].tolist(), int(least[g]))
            stays[lo + len(left):hi] = False
            symbol[lo:lo + len(left)], place[lo:lo + len(left)] = left, at
            stale[lo:hi] = True
        symbol, place, segment, rank, into, stale = symbol[stays], place[stays], segment[stays], rank[stays], into[stays], stale[stays]
        again = np.flatnonzero(stale)
        # A symbol whose pair partner was merged is stale by its own or its right neighbour's merge.
        rank[again], into[again] = NEVER, 0
        again = again[again + 1 < len(symbol)]
        again = again[segment[again] == segment[again + 1]]
        rank[again], into[again] = _pair_ranks(voc, symbol[again], symbol[again + 1])
    if not done:
        return word[:0], place[:0], symbol[:0], code
    place, symbol = np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])
    order = np.argsort(place)
    place, symbol = place[order], symbol[order]
    return word[place], place, symbol, code


def word_ids(words: list[str], voc: Vocabulary) -> list[bytes]:
    """The ids of each word as 32-bit integers."""
    import numpy as np

    if not words:
        return []
    word, place, symbol, code = merged(words, voc)
    ids = voc.symbol_id[symbol]
    spelled = np.flatnonzero(ids < 0)
    if len(spelled):
        raw = [chr(c).encode() for c in code[place[spelled]].tolist()]
        times = np.ones(len(ids), np.int64)
        times[spelled] = [len(r) for r in raw]
        out = np.repeat(ids, times)
        ends = np.cumsum(times)
        for k, r in zip(spelled.tolist(), raw):
            out[ends[k] - len(r):ends[k]] = voc.byte_id[list(r)]
        ids, word = out, np.repeat(word, times)
    ends = np.searchsorted(word, np.arange(len(words)), side="right") * 4
    flat, begin, found = ids.astype(np.int32).tobytes(), 0, []
    for e in ends.tolist():
        found.append(flat[begin:e])
        begin = e
    return found


_WORDS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_cache: dict[str, bytes] = {}
_loaded: dict[str, Vocabulary] = {}


def _vocabulary(path: str) -> Vocabulary:
    if path not in _loaded:
        _loaded.clear()
        _cache.clear()
        _loaded[path] = vocabulary(path)
    return _loaded[path]


def encode_texts(texts: list[str | None], path: str) -> list[bytes]:
    """The ids of each whole text as 32-bit integers in the machine's order."""
    voc = _vocabulary(path)
    split = [(_WORDS.findall(s) if voc.spaces_start else [s]) if (s := voc.normalize(t or "")) else [] for t in texts]
    if len(_cache) > CACHE_WORDS:
        _cache.clear()
    new = list(set().union(*split).difference(_cache))
    _cache.update(zip(new, word_ids(new, voc)))
    out = [b"".join(map(_cache.__getitem__, ws)) for ws in split]
    for w in new:
        if len(w) > CACHE_LENGTH:
            del _cache[w]
    return out


def _byte_by_byte(error):
    return "�", error.start + 1


def decode_ids(ids, ends: list[int], path: str) -> list[str]:
    """The texts of lists of ids that lie one after the other; ``ends``: where each list ends."""
    import codecs

    import numpy as np

    codecs.register_error("netvigil-byte-by-byte", _byte_by_byte)
    voc = _vocabulary(path)
    size = voc.surface_size[ids]
    stops, raw = np.cumsum(size), []
    for at in range(0, len(ids), DECODED):  # the bytes of all ids, gathered by position
        part, sizes = ids[at:at + DECODED], size[at:at + DECODED]
        behind = np.cumsum(sizes)
        raw.append(voc.surface_bytes[np.arange(behind[-1]) + np.repeat(voc.surface_start[part] - behind + sizes, sizes)].tobytes())
    raw = b"".join(raw)
    spoken, begin, out = np.flatnonzero(size), 0, []
    firsts = np.searchsorted(spoken, [0, *ends])
    for k, end in enumerate(ends):
        lo = int(stops[begin - 1]) if begin else 0
        hi = int(stops[end - 1]) if end else 0
        if firsts[k] < firsts[k + 1] and voc.spaced[ids[spoken[firsts[k]]]]:
            lo += 1
        out.append(raw[lo:hi].decode("utf-8", "netvigil-byte-by-byte"))
        begin = end
    return out


def _path(path: str | None) -> str:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(MODEL)
    return path


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>) of every text."""
    import pyarrow as pa

    prepare(docs.sparkSession)
    path = _path(path)

    def run(batches):
        import numpy as np

        for b in batches:
            raw = encode_texts(b.column(1).to_pylist(), path)
            ends = np.cumsum([0, *[len(r) // 4 for r in raw]])
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(raw), np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids, text) of every row of (doc_id, ids)."""
    import pyarrow as pa

    prepare(encoded.sparkSession)
    path = _path(path)

    def run(batches):
        import numpy as np

        for b in batches:
            lists = b.column(1)
            ids, ends = lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).tolist()
            yield pa.RecordBatch.from_arrays([b.column(0), lists, pa.array(decode_ids(ids, ends, path), pa.string())], names=["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, ids array<int>, text string")


def digest(decoded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of what ``decode`` returns."""
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed.cast("binary"), 256).alias("ids_sha256"),
                          F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
