"""Compact blocks of integer arrays, for shuffles that would otherwise carry a row per word."""

from __future__ import annotations

import struct

import numpy as np
import zstandard


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed block; 64-bit and 32-bit numbers are split into byte planes, so small ones take little room."""
    parts = [struct.pack("<I", len(arrays))]
    for a in arrays:
        a = np.ascontiguousarray(a)
        planes = a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() if len(a) else b""
        parts += [struct.pack("<cIB", a.dtype.kind.encode(), len(a), a.itemsize), planes]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(block: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(block)
    (n,), at, out = struct.unpack_from("<I", raw), 4, []
    for _ in range(n):
        kind, size, item = struct.unpack_from("<cIB", raw, at)
        at += 6
        planes = np.frombuffer(raw, np.uint8, size * item, at).reshape(item, size)
        out.append(np.ascontiguousarray(planes.T).view(f"<{kind.decode()}{item}").reshape(size))
        at += size * item
    return out


def steps(sorted_keys: np.ndarray) -> np.ndarray:
    """Differences of an ascending array, which pack well."""
    return np.diff(sorted_keys, prepend=sorted_keys.dtype.type(0))


def unsteps(differences: np.ndarray) -> np.ndarray:
    return np.cumsum(differences, dtype=differences.dtype)
