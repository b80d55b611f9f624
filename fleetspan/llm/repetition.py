"""Quality rules on repeated passages, from a suffix array over the words of each text."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH_WORDS = 300_000  # words whose suffixes are sorted together; a longer text makes a batch of its own
_SYMBOLS = "#*$%&|<>"
_FIELDS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, repeat_chars long, "
    "longest_repeat long, n_maximal_repeats long"
)


def suffix_array(ids: np.ndarray, doc: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of the concatenated texts and the common prefix, in words, of neighbouring suffixes.

    A suffix ends with its text, and suffixes of different texts share nothing. Prefix doubling re-sorts only suffixes
    that still tie; the class numbers of each round are kept and give the common prefixes by binary descent.
    """
    n = len(ids)
    key = doc.astype(np.int64) * (int(ids.max()) + 1) + ids
    order = np.argsort(key, kind="stable")
    start = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
    size = np.diff(np.r_[start, n])
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(start, size)
    active, k, levels = order[np.repeat(size > 1, size)], 1, []
    while active.size:
        levels.append(rank.astype(np.int32))
        old, nxt = rank[active], active + k
        second = np.where(nxt < end[active], rank[np.minimum(nxt, n - 1)], -1)
        key = old * (n + 1) + second + 1
        o = np.argsort(key, kind="stable")
        active, key, old = active[o], key[o], old[o]
        index = np.arange(active.size)
        first_old = np.maximum.accumulate(np.where(np.r_[True, old[1:] != old[:-1]], index, 0))
        cut = np.r_[True, key[1:] != key[:-1]]
        rank[active] = old + np.maximum.accumulate(np.where(cut, index, 0)) - first_old
        start = np.flatnonzero(cut)
        size = np.diff(np.r_[start, active.size])
        active, k = active[np.repeat(size > 1, size)], 2 * k
    sa = np.empty(n, np.int64)
    sa[rank] = np.arange(n)
    lcp = np.zeros(n + 1, np.int64)  # lcp[i]: between suffixes i-1 and i
    if levels and n > 1:
        at = np.flatnonzero(levels[0][sa[:-1]] == levels[0][sa[1:]])
        x, y, h = sa[at].copy(), sa[at + 1].copy(), np.zeros(len(at), np.int64)
        for j in range(len(levels) - 1, -1, -1):
            inside = (x < end[sa[at]]) & (y < end[sa[at + 1]])
            same = inside & (levels[j][np.minimum(x, n - 1)] == levels[j][np.minimum(y, n - 1)])
            step = same.astype(np.int64) << j
            x, y, h = x + step, y + step, h + step
        lcp[at + 1] = h
    return sa, lcp


def lcp_intervals(lcp: np.ndarray, low: int) -> np.ndarray:
    """Rows (length, first, last): runs of the suffix array that share ``length`` >= low words and no more."""
    at = np.flatnonzero(lcp >= low)
    out, stack, prev = [], [], -2
    for i, h in zip(at.tolist(), lcp[at].tolist()):
        if i != prev + 1:
            out += [(length, first, prev) for length, first in stack]
            stack = []
        first = i - 1
        while stack and stack[-1][0] > h:
            length, first = stack.pop()
            out.append((length, first, i - 1))
        if not stack or stack[-1][0] < h:
            stack.append((h, first))
        prev = i
    out += [(length, first, prev) for length, first in stack]
    return np.array(out, np.int64).reshape(-1, 3)


def repeats(texts: list[list[bytes]], min_words: int) -> list[tuple[np.ndarray, int, int]]:
    """Per text: which words lie in a maximal repeat of min_words or more, the longest repeat, and how many there are."""
    lens = np.array([len(t) for t in texts], np.int64)
    n = int(lens.sum())
    if n == 0:
        return [(np.zeros(0, bool), 0, 0) for _ in texts]
    vocab: dict[bytes, int] = {}
    ids = np.fromiter((vocab.setdefault(w, len(vocab)) for t in texts for w in t), np.int64, n)
    ends = np.cumsum(lens)
    doc, end = np.repeat(np.arange(len(texts)), lens), np.repeat(ends, lens)
    sa, lcp = suffix_array(ids, doc, end)
    found = lcp_intervals(lcp, min_words)
    # left-maximal: the words before the occurrences differ, or one occurrence begins its text
    before = np.where(sa > (ends - lens)[doc[sa]], ids[sa - 1], -1 - sa)
    change = np.r_[0, np.cumsum(before[1:] != before[:-1])]
    found = found[change[found[:, 2]] > change[found[:, 1]]]
    owner = doc[sa[found[:, 1]]]
    longest, count = np.zeros(len(texts), np.int64), np.bincount(owner, minlength=len(texts))
    np.maximum.at(longest, owner, found[:, 0])
    # the union of all maximal spans: from each position the longest span that begins there
    reach = np.zeros(n, np.int64)
    reach[sa] = np.maximum(lcp[:-1], lcp[1:])
    begin = np.flatnonzero(reach >= min_words)
    edge = np.bincount(begin, minlength=n + 1) - np.bincount(begin + reach[begin], minlength=n + 1)
    covered = np.cumsum(edge[:-1]) > 0
    return [(covered[e - k : e], int(a), int(b)) for e, k, a, b in zip(ends, lens, longest, count)]


def _lines_again(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(" \t\r\x0b\x0c")]
    return len(lines) - len(set(lines))


def _profile(min_words: int):
    @F.pandas_udf(_FIELDS)
    def profile(address: pd.Series) -> pd.DataFrame:
        rows, batch, held = [], [], 0

        def flush():
            for (text, words), (covered, longest, count) in zip(batch, repeats([w for _, w in batch], min_words)):
                sizes = np.array([len(w) for w in words], np.int64) if text.isascii() else np.array([len(w.decode()) for w in words], np.int64)
                rows.append((len(words), int(sizes.sum()), sum(map(text.count, _SYMBOLS)), _lines_again(text), int(covered.sum()), int(sizes[covered].sum()), longest, count))
            batch.clear()

        for text in address:
            text = text or ""
            words = text.encode().split()  # bytes.split knows just the six ASCII blanks
            if batch and held + len(words) > BATCH_WORDS:
                flush()
                held = 0
            batch.append((text, words))
            held += len(words)
        flush()
        return pd.DataFrame(rows, columns=[f.split()[0] for f in _FIELDS.split(", ")])

    return profile


def repetition_verdicts(customers: DataFrame, address: str = "address", min_words: int = 5, max_share: float = 0.2, max_longest: int = 60, as_column: str = "repetition") -> DataFrame:
    """Mark records whose ``address`` text repeats itself too much.

    The project's only free text is the address line of customers, warehouses and pickup points; the operator takes any
    text column. Words are runs of anything but the six ASCII blanks. The suffix array and its longest-common-prefix
    intervals give the maximal repeats of ``min_words`` or more words; the union of their spans may hold ``max_share`` of
    the word characters and the longest may have ``max_longest`` words. All columns stay; the struct ``as_column`` is
    added (a column of that name is replaced): counts, base_failed (under 10 words, or a fifth of the words repeated) and
    kept. Null or empty text has no words and fails. Equal rows get equal verdicts; nothing depends on other rows.
    """
    raw = f"_{as_column}_profile"
    out = customers.withColumn(raw, _profile(min_words)(F.col(address)))
    p = lambda f: F.col(f"{raw}.{f}")
    base = (p("n_words") < 10) | (100 * p("n_repeat_words") > 20 * p("n_words"))
    fine = (p("repeat_chars") <= F.lit(max_share) * p("word_chars")) & (p("longest_repeat") <= max_longest)
    fields = [p(f.split()[0]).alias(f.split()[0]) for f in _FIELDS.split(", ")]
    return out.withColumn(as_column, F.struct(*fields, base.alias("base_failed"), (~base & fine).alias("kept"))).drop(raw)
