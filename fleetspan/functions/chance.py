"""Reproducible random draws: a uniform is a hash of (seed, stream, row key).

The value belongs to the row, not to the partition it sits in, so a retried task or another
partitioning gives the same draw, and another engine with MD5 can check it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import case_ladder, clip, col


def hash_uniform(stream: str, key: str | Column | Sequence, seed: int = 42) -> Column:
    """Uniform in [0, 1) with 32 bits, one per (stream, key)."""
    keys = [key] if isinstance(key, (str, Column)) else list(key)
    text = F.concat_ws(":", F.lit(str(seed)), F.lit(stream), *[col(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def uniform_between(u: Column, lo: float, hi: float) -> Column:
    return u * (hi - lo) + lo


def weighted_choice(u: Column, labels: Sequence[str], weights: Sequence[float]) -> Column:
    """Categorical draw by cumulative weight; weights need not sum to one, all-zero means equal."""
    total = float(sum(weights))
    weights = [float(w) for w in weights] if total > 0 else [1.0] * len(labels)
    total = total if total > 0 else float(len(labels))
    acc, edges = 0.0, []
    for w in weights[:-1]:
        acc += w
        edges.append(acc / total)
    return case_ladder([u < e for e in edges], list(labels[:-1]), labels[-1])


def normal(u: Column, v: Column, mean: float = 0.0, sd: float = 1.0) -> Column:
    """Box-Muller from two independent uniforms."""
    radius = F.sqrt(F.log(F.greatest(u, F.lit(1e-12))) * -2.0)
    return radius * F.cos(v * (2 * math.pi)) * sd + mean


def clipped_normal(u: Column, v: Column, mean: float, sd: float, lo: float, hi: float) -> Column:
    return clip(normal(u, v, mean, sd), lo, hi)


def rescale(raw: Column, raw_min: Column, raw_max: Column, lo: float, hi: float) -> Column:
    """Map raw draws onto [lo, hi] by their global extremes."""
    return (raw - raw_min) / F.greatest(raw_max - raw_min, F.lit(1e-9)) * (hi - lo) + lo
