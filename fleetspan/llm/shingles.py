"""Word hashes and shingle sets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

_P = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = _Hashes()


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(text: str | None, lower: bool = True) -> np.ndarray:
    """64-bit hashes of the words: runs of anything but the six ASCII blanks, A-Z lower-cased."""
    if not text:
        return np.empty(0, np.uint64)
    raw = text.encode()
    words = (raw.lower() if lower else raw).split()
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


_BLANK = np.isin(np.arange(256), np.frombuffer(b"\t\n\v\f\r ", np.uint8))
_LETTERS = np.where(_BLANK, np.uint64(0), mix(np.arange(1, 257, dtype=np.uint64) * _P))
_LETTERS[ord("A") : ord("Z") + 1] = _LETTERS[ord("a") : ord("z") + 1]
_POWERS = np.cumprod(np.r_[np.uint64(1), np.full(1023, _P)], dtype=np.uint64)
_BYTES = 1 << 18  # of text that are hashed at once


def _hashed(raw: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first bytes of the words of several texts, which begin at ``firsts``."""
    word = ~_BLANK[raw]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    firsts = firsts[firsts < len(raw)]
    begins[firsts] = word[firsts]
    start = np.flatnonzero(begins)
    if not len(start):
        return np.empty(0, np.uint64), start
    room = np.diff(np.r_[start, len(raw)])
    at = np.arange(start[0], len(raw)) - np.repeat(start, room)
    h = mix(np.add.reduceat(_LETTERS[raw[start[0] :]] * _POWERS[at & 1023], start - start[0]))
    for i in np.flatnonzero(room > len(_POWERS)).tolist():  # longer than the table of powers, or blanks behind it
        own = raw[start[i] : start[i] + room[i]].tobytes().lower().rstrip()
        if len(own) > len(_POWERS):
            h[i] = xxhash.xxh3_64_intdigest(own)
    return h, start


def column_hashes(texts: pa.Array) -> list[np.ndarray]:
    """For each text the 64-bit hashes of its words, which are those of ``word_hashes``; a sum over a word's letters, many texts at once."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    out, i = [], 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + _BYTES, "right")) - 1)
        cuts = offsets[i : j + 1] - offsets[i]
        raw = data[offsets[i] : offsets[j]]
        if j > i + 1 or len(raw) <= 2 * _BYTES:
            h, start = _hashed(raw, cuts[:-1])
            at = np.searchsorted(start, cuts).tolist()
            out += [h[a:b] for a, b in zip(at, at[1:])]
        else:  # a long text, cut at blanks
            parts, at = [], 0
            while at < len(raw):
                end = min(len(raw), at + _BYTES)
                while end < len(raw) and not _BLANK[raw[end : end + _BYTES]].any():
                    end = min(len(raw), end + _BYTES)
                end += int(_BLANK[raw[end : end + _BYTES]].argmax()) if end < len(raw) else 0
                parts.append(_hashed(raw[at:end], np.zeros(1, np.int64))[0])
                at = end
            out.append(np.concatenate(parts))
        i = j
    return out


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words; of the whole sequence where it is shorter, and nothing where it is empty."""
    if not len(words):
        return words
    k, n = min(k, len(words)), len(words)
    h = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        h = h * _P + words[j : n - k + 1 + j]
    return mix(h + np.uint64(k))
