"""Byte-level BPE over whole batches of texts, and back.

Pre-tokenisation uses no regular expression: every code point becomes a symbol (its class and what follows it), every symbol
a function from the state before it to the state after it, and the functions, of which the pattern needs only a small
closed set, are composed by an associative scan over the whole batch. Where a piece begins follows from the state and the
symbol. Pieces are merged once a worker and kept in a bounded cache; ids and the byte offset of every token are returned.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import product
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: the pattern whose pieces are located, and the code points that Unicode calls white space
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WHITE = (*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
ONE = "stmd"  # an apostrophe takes one of these letters with it
TWO = ("re", "ve", "ll")  # or two

LETTER, NUMBER, OTHER, SPACE, BLANK = range(5)
# symbols: the classes, apostrophes before one or two letters of a contraction, and white space before a visible character
QUOTE1, QUOTE2, SPACE_LAST, BLANK_LAST = 5, 6, 7, 8
SYMBOLS = 9
FIRST = SYMBOLS  # added at the first code point of a text
# states after a code point
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_BLANKS, GLUE, TAKE1, TAKE2 = range(8)

STEP_CHARS = 1_000_000  # bytes of text scanned together
NONE = 1 << 32  # the rank of what is no token
LANE = 256  # positions composed one after another, all lanes at once
CACHE_BYTES = 8_000_000  # of pieces and their places, about 100 MB of objects
SHORT = 64  # bytes of a piece up to which a plain scan for the least rank is quicker than a heap


def _move(state: int, symbol: int) -> tuple[int, bool]:
    """The state after a code point and whether a piece begins at it."""
    if state == TAKE2:
        return TAKE1, False
    if state == TAKE1:
        return FRESH, False
    if symbol in (LETTER, NUMBER, OTHER):
        run = (IN_LETTERS, IN_NUMBERS, IN_OTHERS)[symbol]
        return run, state not in (run, GLUE)
    if symbol in (QUOTE1, QUOTE2):
        if state in (IN_OTHERS, GLUE):
            return IN_OTHERS, False
        return (TAKE1 if symbol == QUOTE1 else TAKE2), True
    if symbol == SPACE_LAST:
        return GLUE, True
    if symbol == BLANK_LAST:
        return FRESH, True
    return IN_BLANKS, state != IN_BLANKS


def _closure() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The functions that sequences of symbols compose to: their numbers by symbol, products, values, and piece starts."""
    states = range(8)
    of_symbol = [tuple(_move(s, y)[0] for s in states) for y in range(SYMBOLS)]
    of_symbol += [(f[FRESH],) * 8 for f in of_symbol]  # at the first code point nothing counts that stood before
    same = tuple(states)
    known = {same: 0}
    todo = [same]
    while todo:
        f = todo.pop()
        for g in of_symbol:
            h = tuple(g[f[s]] for s in states)
            if h not in known:
                known[h] = len(known)
                todo.append(h)
    values = np.array(list(known), np.uint8)
    n = len(known)
    times = np.zeros((n, n), np.uint16)
    for (f, i), (g, j) in product(known.items(), known.items()):
        times[i, j] = known[tuple(g[f[s]] for s in states)]
    starts = np.array([[_move(s, y)[1] for y in range(SYMBOLS)] + [True] * SYMBOLS for s in states])
    return np.array([known[f] for f in of_symbol], np.uint16), times, values, starts


@lru_cache(maxsize=1)  # on the driver only
def code_point_classes() -> np.ndarray:
    """The class of every code point as the tokenizer library's own tables have it: 1.1 million bytes."""
    import tiktoken

    # a library vocabulary that joins x or 1 with the byte after it shows whether the two stand in one piece
    ranks = {bytes([b]): b for b in range(256)} | {bytes([mark, b]): 256 + 256 * k + b for k, mark in enumerate(b"x1") for b in range(256)}
    probe = tiktoken.Encoding("classes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    points = np.array([c for c in range(0x110000) if not 0xD800 <= c < 0xE000])
    out = np.full(0x110000, OTHER, np.uint8)
    for mark, kind in (("x", LETTER), ("1", NUMBER)):
        text = "".join(f"{mark}{chr(c)}\n" for c in points)
        ids = np.asarray(probe.encode_ordinary(text))
        at = np.cumsum(np.where(ids >= 256, 2, 1)) - np.where(ids >= 256, 2, 1)
        widths = 2 + np.select([points < 0x80, points < 0x800, points < 0x10000], [1, 2, 3], 4)
        place = np.cumsum(widths) - widths
        out[points[ids[np.searchsorted(at, place)] >= 256]] = kind
    out[list(WHITE)] = BLANK
    out[0x20] = SPACE
    return out


def load_vocabulary(path: str, to_encode: bool = True) -> SimpleNamespace:
    """All that tasks need of a rank file, of plain types: it is a few MB, fixed by the vocabulary, and broadcast."""
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    tokens = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, i in ranks.items():
        tokens[i] = token
    lengths = np.array([len(t) for t in tokens], np.int64)
    v = SimpleNamespace(flat=np.frombuffer(b"".join(tokens), np.uint8), lengths=lengths, first=np.cumsum(lengths) - lengths)
    if to_encode:
        v.ranks, v.classes, v.cache = ranks, code_point_classes(), None
        v.joins = {a << 32 | b: i for t, i in ranks.items() for k in range(1, len(t)) if (a := ranks.get(t[:k])) is not None and (b := ranks.get(t[k:])) is not None}
        v.of_symbol, v.times, v.values, v.starts = _closure()
    return v


def _prefixes(elements: np.ndarray, v: SimpleNamespace) -> np.ndarray:
    """The state before every element, by an associative scan: lanes are composed side by side, then the lanes' products."""
    n, k = len(elements), len(v.times)
    lanes = -(-n // LANE)
    grid = np.zeros((lanes, LANE), np.uint16)  # 0 is the identity
    grid.ravel()[:n] = elements
    grid = np.ascontiguousarray(grid.T)
    times = v.times.ravel()
    for j in range(1, LANE):
        grid[j] = times[grid[j - 1].astype(np.int64) * k + grid[j]]
    before = _prefixes(grid[-1], v) if lanes > 1 else np.zeros(1, np.uint8)
    after = v.values[grid, before]
    return np.concatenate([before[None], after[:-1]]).T.ravel()[:n]


def piece_starts(points: np.ndarray, first: np.ndarray, v: SimpleNamespace, cut: bool = False) -> np.ndarray:
    """Whether a piece begins at each code point of texts laid end to end; ``first`` marks the beginning of each text.

    With ``cut`` the last text goes on behind the array, and white space at the end is not the text's end.
    """
    n = len(points)
    kind = v.classes[points]
    ends = np.append(first[1:], not cut)  # the text ends with this code point
    visible = np.append(kind[1:] < SPACE, cut) & ~ends
    symbol = kind + np.where((kind >= SPACE) & visible, SPACE_LAST - SPACE, 0).astype(np.uint8)
    quote = np.flatnonzero(points == ord("'"))
    if len(quote):
        inside = lambda k: (quote + k < n) & ~first[np.minimum(quote + k, n - 1)]
        one = np.where(inside(1), points[np.minimum(quote + 1, n - 1)], 0)
        two = np.where(inside(1) & inside(2), points[np.minimum(quote + 2, n - 1)], 0)
        short = np.isin(one, [ord(c) for c in ONE])
        long = np.any([(one == ord(a)) & (two == ord(b)) for a, b in TWO], axis=0)
        symbol[quote[short]] = QUOTE1
        symbol[quote[long]] = QUOTE2
    symbol = symbol + np.where(first, FIRST, 0).astype(np.uint8)
    return v.starts[_prefixes(v.of_symbol[symbol], v), symbol]


def merged(piece: bytes, ranks: dict[bytes, int], joins: dict[int, int]) -> list[int]:
    """The ids of a piece: neighbours of the least rank are joined, the leftmost first, until none can be.

    ``joins`` has the id that two neighbours, ``a << 32 | b``, make together.
    """
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    ids = [ranks[piece[i : i + 1]] for i in range(len(piece))]
    if len(ids) > SHORT:
        return _merged_long(ids, joins)
    rank = [joins.get(a << 32 | b, NONE) for a, b in zip(ids, ids[1:])]
    while rank and (least := min(rank)) < NONE:
        i = rank.index(least)
        ids[i] = least
        del ids[i + 1], rank[i]
        if i < len(rank):
            rank[i] = joins.get(least << 32 | ids[i + 1], NONE)
        if i:
            rank[i - 1] = joins.get(ids[i - 1] << 32 | least, NONE)
    return ids


def _merged_long(ids: list[int], joins: dict[int, int]) -> list[int]:
    """The same by a heap over a linked list, n log n for a piece of any length."""
    n = len(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, i + 1) for i in range(n - 1) if (r := joins.get(ids[i] << 32 | ids[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        r, i, j = heapq.heappop(heap)
        if after[i] != j or joins.get(ids[i] << 32 | ids[j]) != r:  # one of the two has been joined since
            continue
        ids[i], k, h = r, after[j], before[i]
        after[i], after[j] = k, -1
        if k < n:
            before[k] = i
            if (s := joins.get(r << 32 | ids[k])) is not None:
                heapq.heappush(heap, (s, i, k))
        if h >= 0 and (s := joins.get(ids[h] << 32 | r)) is not None:
            heapq.heappush(heap, (s, h, i))
    out, i = [], 0
    while i < n:
        out.append(ids[i])
        i = after[i]
    return out


class _Merges(dict):
    """The place of a piece's ids in one growing array."""

    def __init__(self, v: SimpleNamespace) -> None:
        self.joins, self.ranks, self.ids, self.first, self.count, self.size = v.joins, v.ranks, array("I"), array("q"), array("q"), 0

    def __missing__(self, piece: bytes) -> int:
        ids = merged(piece, self.ranks, self.joins)
        self.first.append(len(self.ids))
        self.count.append(len(ids))
        self.ids.extend(ids)
        self.size += len(piece) + 8
        at = self[piece] = len(self.first) - 1
        return at


def encode_step(raw: bytes, first_bytes: np.ndarray, v: SimpleNamespace, cut: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Ids and byte offsets of the tokens of texts laid end to end; ``first_bytes`` is where each of them begins.

    With ``cut`` the text goes on: the last piece is left out unless it is the only one (then nothing is returned).
    """
    data = np.frombuffer(raw, np.uint8)
    begins = np.flatnonzero((data & 0xC0) != 0x80)  # bytes at which a code point begins
    points = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
    first = np.zeros(len(points), bool)
    first[np.searchsorted(begins, first_bytes)] = True
    starts = piece_starts(points, first, v, cut)
    if cut:
        starts[-2:] = False  # what stands behind may still change these
    at = begins[starts]
    bounds = (at if cut else np.append(at, len(raw))).tolist()
    if v.cache is None or v.cache.size > CACHE_BYTES:
        v.cache = _Merges(v)
    held = v.cache
    which = np.fromiter(map(held.__getitem__, [raw[a:b] for a, b in zip(bounds, bounds[1:])]), np.int64, max(len(bounds) - 1, 0))
    count = np.frombuffer(held.count, np.int64)[which] if len(which) else which
    place = np.frombuffer(held.first, np.int64)[which] if len(which) else which
    # a copy: the array must be free to grow
    ids = np.frombuffer(held.ids, np.uint32)[np.repeat(place - (np.cumsum(count) - count), count) + np.arange(count.sum())] if len(which) else np.empty(0, np.uint32)
    lengths = v.lengths[ids]
    return ids, np.cumsum(lengths) - lengths


def encode_texts(texts: list[bytes], v: SimpleNamespace) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and byte offsets of each UTF-8 text, in steps of ``STEP_CHARS`` bytes; a longer text is cut where a piece begins."""
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and size + len(texts[j]) <= STEP_CHARS:
            size += len(texts[j])
            j += 1
        if j == i:
            yield _encode_long(texts[i], v)
            i += 1
            continue
        group = [t for t in texts[i:j] if t]
        sizes = np.array([len(t) for t in group], np.int64)
        begin = np.cumsum(sizes) - sizes
        ids, offsets = encode_step(b"".join(group), begin, v) if group else (np.empty(0, np.uint32), np.empty(0, np.int64))
        bound = np.append(np.searchsorted(offsets, begin), len(ids))
        k = 0
        for t in texts[i:j]:
            if not t:
                yield np.empty(0, np.uint32), np.empty(0, np.int64)
                continue
            a, b = bound[k], bound[k + 1]
            yield ids[a:b], offsets[a:b] - begin[k]
            k += 1
        i = j


def _encode_long(text: bytes, v: SimpleNamespace) -> tuple[np.ndarray, np.ndarray]:
    ids, offsets, at, size = [], [], 0, STEP_CHARS
    while at < len(text):
        end = min(at + size, len(text))
        while end < len(text) and text[end] & 0xC0 == 0x80:
            end += 1
        some, where = encode_step(text[at:end], np.zeros(1, np.int64), v, cut=end < len(text))
        if len(some):
            ids.append(some)
            offsets.append(where + at)
            at += int(where[-1] + v.lengths[some[-1]])
            size = STEP_CHARS
        else:
            size *= 2  # one piece longer than the step
    return np.concatenate(ids), np.concatenate(offsets)


def _parts(batch: pa.Array) -> Iterator[pa.Array]:
    """Slices of a batch of about ``STEP_CHARS`` bytes, so that little is held at once."""
    sizes = pc.fill_null(pc.binary_length(batch), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    step = (np.cumsum(sizes) - sizes) // STEP_CHARS
    bounds = np.flatnonzero(np.diff(step, prepend=-1)).tolist() + [len(batch)]
    for a, b in zip(bounds, bounds[1:]):
        yield batch.slice(a, b - a)


def with_tokens(customers: DataFrame, vocabulary: str, text: str = "address", as_column: str = "tokens") -> DataFrame:
    """``customers`` with the byte-level BPE tokens of a whole text: struct of n_tokens, ids and offsets.

    ``vocabulary`` is a rank file (base64 token and rank a line). ``ids`` are little-endian unsigned 32-bit integers, ``offsets``
    the byte at which each token begins in the UTF-8 text, likewise. Null and empty texts have no tokens; special tokens are
    ordinary text. All columns are kept, one called ``as_column`` is replaced; equal rows stay.
    """
    held = customers.sparkSession.sparkContext.broadcast(load_vocabulary(vocabulary))  # a few MB, fixed by the file

    @F.arrow_udf("struct<n_tokens: long, ids: binary, offsets: binary>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        v = held.value  # once a worker, its cache of merged pieces with it
        for batch in batches:
            for part in _parts(batch.cast(pa.binary())):
                rows = [(len(i), i.astype("<u4").tobytes(), o.astype("<u4").tobytes()) for i, o in encode_texts([t or b"" for t in part.to_pylist()], v)]
                yield pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary()))], names=["n_tokens", "ids", "offsets"])

    return customers.withColumn(as_column, encode(F.col(text)))


def with_decoded(customers: DataFrame, vocabulary: str, tokens: str = "tokens", as_column: str = "decoded") -> DataFrame:
    """``customers`` with the bytes that a ``tokens`` struct of :func:`with_tokens` stands for, each token laid at its offset.

    A null struct gives null, no tokens give no bytes. Ids outside the vocabulary raise an error.
    """
    held = customers.sparkSession.sparkContext.broadcast(load_vocabulary(vocabulary, to_encode=False))

    @F.arrow_udf("binary")
    def decode(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        v = held.value
        for ids_of, offsets_of in batches:
            at = 0
            for part in _parts(ids_of):
                out = [None if i is None else decoded(np.frombuffer(i, "<u4"), np.frombuffer(o, "<u4"), v) for i, o in zip(part.to_pylist(), offsets_of.slice(at, len(part)).to_pylist())]
                at += len(part)
                yield pa.array(out, pa.binary())

    return customers.withColumn(as_column, decode(F.col(f"{tokens}.ids"), F.col(f"{tokens}.offsets")))


def decoded(ids: np.ndarray, offsets: np.ndarray, v: SimpleNamespace) -> bytes:
    lengths = v.lengths[ids]
    total = int(lengths.sum())
    out = np.empty(total, np.uint8)
    within = np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[np.repeat(offsets.astype(np.int64), lengths) + within] = v.flat[np.repeat(v.first[ids], lengths) + within]
    return out.tobytes()
