"""Held-out passages in training records, found with a generalised suffix automaton."""

from __future__ import annotations

import re
from collections.abc import Iterator
from types import SimpleNamespace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import unused

MAX_AUTOMATON_WORDS = 2_000_000  # words of items in one automaton; more items make more automata, each passed over the records
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_RESULT = "n_words long, n_hit long, items array<string>, longest long, spans array<array<long>>, chars_hit long, clean string"
_NAMES = ["n_words", "n_hit", "items", "longest", "spans", "chars_hit", "clean"]


def words_of(text: str | None) -> list[bytes]:
    """Letters, digits and anything beyond ASCII, with A-Z lower-cased, as UTF-8."""
    return _WORD.findall(text.encode().lower()) if text else []


class Automaton:
    """Generalised suffix automaton over words; states know the windows and short items that end in them."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.len = [-1], [0]
        self.window = window
        short: dict[int, dict[str, int]] = {}
        ends: list[tuple[int, str, int]] = []
        for item, words in items:
            last = 0
            for i, w in enumerate(words, 1):
                last = self._extend(last, w)
                if i >= window or i == len(words):
                    ends.append((last, item, min(i, window)))
        by_window: dict[int, set[str]] = {}
        for state, item, size in ends:
            at = self._ancestor(state, size)
            if size == window:
                by_window.setdefault(at, set()).add(item)
            else:
                short.setdefault(at, {})[item] = size
        # the state in which the last `window` words of a match lie, and the short items that end any match there
        n = len(self.len)
        self.home, self.short = [0] * n, [()] * n
        for s in sorted(range(1, n), key=self.len.__getitem__):
            p = self.link[s]
            if self.len[s] >= window:
                self.home[s] = s if self.len[p] < window else self.home[p]
            own = short.get(s)
            self.short[s] = self.short[p] + tuple((size, item) for item, size in own.items()) if own else self.short[p]
        self.items = by_window

    def _ancestor(self, state: int, size: int) -> int:
        while self.len[self.link[state]] >= size:
            state = self.link[state]
        return state

    def _extend(self, last: int, w: bytes) -> int:
        nxt, link, length = self.next, self.link, self.len
        q = nxt[last].get(w)
        if q is not None:  # the word string is there already
            return q if length[q] == length[last] + 1 else self._clone(last, w, q)
        cur = len(length)
        nxt.append({}), length.append(length[last] + 1), link.append(0)
        p = last
        while p != -1 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return cur

    def _clone(self, p: int, w: bytes, q: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        c = len(length)
        nxt.append(dict(nxt[q])), length.append(length[p] + 1), link.append(link[q])
        link[q] = c
        while p != -1 and nxt[p].get(w) == q:
            nxt[p][w] = c
            p = link[p]
        return c

    def matches(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str], int]:
        """Word spans (first, end) of windows and short items in ``words``, the items they belong to, the longest match."""
        nxt, link, length, home, short, window = self.next, self.link, self.len, self.home, self.short, self.window
        spans, items, longest = [], set(), 0
        root, state, size = nxt[0], 0, 0
        for i, w in enumerate(words, 1):
            to = nxt[state].get(w)
            if to is None:
                while state and to is None:
                    state = link[state]
                    to = nxt[state].get(w)
                if to is None:
                    size = 0
                    continue
                size = length[state]
            state, size = to, size + 1
            if size >= window:
                longest = max(longest, size)
                first = i - size
                if spans and first <= spans[-1][1] and first >= spans[-1][0]:
                    spans[-1] = (spans[-1][0], i)
                else:
                    spans.append((i - size, i))
                items |= self.items[home[state]]
            if short[state]:
                for k, item in short[state]:
                    if k <= size:
                        spans.append((i - k, i))
                        items.add(item)
                        longest = max(longest, k)
        return spans, items, longest


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _finder(held, window: int, max_words: int):
    """A column function from texts to matches in one automaton, built once per Python worker."""
    @F.pandas_udf(_RESULT)
    def find(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        v = held.value
        if v.automaton is None:  # once a worker: the broadcast value stays there
            v.automaton = Automaton(v.items, window)
        for texts, before in parts:
            rows = []
            for text, known in zip(texts, before):
                words = words_of(text)
                spans, items, longest = v.automaton.matches(words)
                spans = _merged([*spans, *((int(a), int(b)) for a, b in known)])
                clean, chars = text, 0
                cut = [s for s in spans if s[1] - s[0] > max_words]
                if cut:
                    raw = text.encode()
                    places = [m.span() for m in _WORD.finditer(raw.lower())]
                    pieces, at = [], 0
                    for a, b in cut:
                        pieces.append(raw[at : places[a][0]])
                        at = places[b - 1][1]
                        chars += len(raw[places[a][0] : at].decode())
                    clean = b"".join([*pieces, raw[at:]]).decode()
                rows.append((len(words), sum(b - a for a, b in spans), sorted(items), longest, [list(s) for s in spans], chars, clean))
            yield pd.DataFrame(rows, columns=_NAMES)

    return find


def strip_leaks(customers: DataFrame, items: DataFrame, address: str = "address", item_id: str = "item_id", item_text: str = "text", window: int = 10, max_words: int = 0, max_share: float = 0.5, as_column: str = "leak", max_automaton_words: int = MAX_AUTOMATON_WORDS) -> DataFrame:
    """Find, and cut out, passages of held-out ``items`` in the ``address`` texts of training records.

    The project splits its records into training and test sides; here the test side is any table of texts. A window is
    ``window`` consecutive item words, or a whole shorter item. All columns stay and the struct ``as_column`` is added (a
    column of that name is replaced): n_words, n_hit (words inside windows), items (ids as strings, sorted), longest match,
    chars_hit, clean (the text without spans of more than ``max_words`` words) and kept (n_hit is at most ``max_share`` of
    the words). Null or empty text has no words, no hits and is kept; null items match nothing; repeated rows get equal
    results. Items beyond ``max_automaton_words`` are spread over several automata that pass the records one after another,
    so memory stays bounded.
    """
    spark = customers.sparkSession
    items = items.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).alias("text"), F.size(F.split(F.col(item_text), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")).alias("n")).where("item is not null and text is not null")
    total = items.agg(F.sum("n")).first()[0] or 0
    parts = max(1, -(-total // max_automaton_words))
    items = items.withColumn("part", F.pmod(F.xxhash64("item"), F.lit(parts)))
    out, spans, cols = customers, F.array().cast("array<array<long>>"), []
    for k in range(parts):
        held = spark.sparkContext.broadcast(SimpleNamespace(items=[(r["item"], words_of(r["text"])) for r in items.where(F.col("part") == k).select("item", "text").collect()], automaton=None))
        cols += unused(out.columns, f"_{as_column}_{k}")
        out = out.withColumn(cols[-1], _finder(held, window, max_words)(F.col(address), spans))
        spans = F.col(f"{cols[-1]}.spans")
    each = lambda f: F.array(*[F.col(f"{c}.{f}") for c in cols])
    last = lambda f: F.col(f"{cols[-1]}.{f}").alias(f)  # noqa: E731  the last automaton gets the spans of all
    found = F.array_sort(F.array_distinct(F.flatten(each("items")))).alias("items")
    kept = (last("n_hit") <= F.lit(max_share) * last("n_words")).alias("kept")
    return out.withColumn(as_column, F.struct(last("n_words"), last("n_hit"), found, F.array_max(each("longest")).alias("longest"), last("chars_hit"), last("clean"), kept)).drop(*cols)
