"""Exact quantiles, linearly interpolated, without collecting a group into one aggregation buffer.

``percentile`` keeps a map of all distinct values of a group in one task. Here a mergeable sketch
first brackets each wanted rank; only rows inside the bracket (well under 0.1 % of a large group, plus
ties) are then counted and ranked, in value buckets. The answer is exact: the bracket is three times
wider than the sketch's guaranteed error and both neighbours of the bracket are kept.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ordered import numbered

ACCURACY = 10_000
MARGIN = 3.0 / ACCURACY


def approx_quantiles(df: DataFrame, by: Sequence[str], value: str, qs: Mapping[str, float]) -> DataFrame:
    """The sketch alone, for callers that accept a rank error of 1e-4."""
    return df.groupBy(*by).agg(
        *[F.percentile_approx(F.col(value).cast("double"), q, ACCURACY).alias(n) for n, q in qs.items()]
    )


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, qs: Mapping[str, float]) -> DataFrame:
    """One row per group with the quantiles named in ``qs``; groups without a value are absent."""
    by, names = list(by), list(qs)
    keys = [f"_k{i}" for i in range(len(by))] or ["_k0"]
    keyed = [F.col(c).alias(k) for c, k in zip(by, keys)] or [F.lit(0).alias("_k0")]
    rows = df.where(F.col(value).isNotNull()).select(*keyed, F.col(value).cast("double").alias("_v"))
    if by:
        rows = rows.dropna(subset=keys)

    probs = [max(q - MARGIN, 0.0) for q in qs.values()] + [min(q + MARGIN, 1.0) for q in qs.values()]
    m = len(names)
    sketch = rows.groupBy(*keys).agg(
        F.count("_v").alias("_n"), F.percentile_approx("_v", probs, ACCURACY).alias("_p")
    )
    brackets = sketch.select(*keys, "_n", F.slice("_p", 1, m).alias("_lo"), F.slice("_p", m + 1, m).alias("_hi"))

    if by:
        rows = rows.join(brackets, keys, "inner")
    else:  # one row, attached as a scalar: a join on a constant would be a cartesian product
        one = brackets.select(F.struct("_n", "_lo", "_hi").alias("_b")).scalar()
        rows = rows.withColumn("_b", one).select(*keys, "_v", "_b.*")
    v = F.col("_v")
    below, near = [], []
    for i in range(m):
        lo, hi = F.col("_lo")[i], F.col("_hi")[i]
        below.append(F.count_if(v < lo).alias(f"_below{i}"))
        near += [F.max(F.when(v < lo, v)).alias(f"_prev{i}"), F.min(F.when(v > hi, v)).alias(f"_next{i}")]
    edges = rows.groupBy(*keys).agg(F.first("_n").alias("_n"), *below, *near)

    # candidates: (group, bracket, value, how many rows, rank of the first of them)
    tagged = rows.withColumn(
        "_hit",
        F.filter(
            F.transform(
                F.arrays_zip("_lo", "_hi"),
                lambda b, i: F.struct(
                    i.alias("q"), b["_lo"].alias("lo"), b["_hi"].alias("hi"),
                ),
            ),
            lambda s: F.col("_v").between(s["lo"], s["hi"]),
        ),
    ).where(F.size("_hit") > 0)
    inside = (
        tagged.select(*keys, "_v", F.explode("_hit").alias("_s"))
        .groupBy(*keys, F.col("_s.q").alias("_q"), "_v")
        .agg(F.count(F.lit(1)).alias("_c"), F.first("_s.lo").alias("_l"), F.first("_s.hi").alias("_h"))
    )
    width = F.col("_h") - F.col("_l")
    slot = F.when(width > 0, F.floor((F.col("_v") - F.col("_l")) / width * 256)).otherwise(F.lit(0))
    ranked = numbered(inside, [*keys, "_q"], ["_v"], slot, pos=None, running={"_from": "_c"})

    return _at_ranks(ranked, edges, by, keys, qs)


def _at_ranks(ranked: DataFrame, edges: DataFrame, by: Sequence[str], keys: Sequence[str], qs: Mapping[str, float]) -> DataFrame:
    """Values at the wanted ranks, from the ranked values of each bracket and the edges beside it."""
    names = list(qs)
    named = edges.select(
        *keys, "_n",
        F.explode(
            F.array(*[
                F.struct(
                    F.lit(i).alias("q"), F.lit(float(q)).alias("p"), F.col(f"_below{i}").alias("below"),
                    F.col(f"_prev{i}").alias("prev"), F.col(f"_next{i}").alias("next"),
                )
                for i, q in enumerate(qs.values())
            ])
        ).alias("_e"),
    ).select(*keys, "_n", "_e.*")
    both = ranked.join(named.withColumnRenamed("q", "_q"), [*keys, "_q"], "inner")
    target = F.col("p") * (F.col("_n") - 1)

    def holds(rank):
        start = F.col("below") + F.col("_from")
        return (start <= rank) & (rank < start + F.col("_c"))

    picked = both.groupBy(*keys, "_q").agg(
        F.first("p").alias("p"), F.first("_n").alias("_n"),
        F.max(F.when(holds(F.floor(target)), F.col("_v"))).alias("_a"),
        F.max(F.when(holds(F.ceil(target)), F.col("_v"))).alias("_b"),
        F.first("prev").alias("prev"), F.first("next").alias("next"),
    )
    # a wanted rank that is not inside the bracket is the direct neighbour of its edge
    a, b = F.coalesce("_a", "prev"), F.coalesce("_b", "next")
    frac = target - F.floor(target)
    value_at = F.when(frac == 0, a).otherwise(a + (b - a) * frac)
    wide = picked.withColumn("_x", value_at).groupBy(*keys).agg(
        *[F.max(F.when(F.col("_q") == i, F.col("_x"))).alias(n) for i, n in enumerate(names)]
    )
    return wide.select(*[F.col(k).alias(c) for c, k in zip(by, keys)], *names)


def long_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value) rows of the numeric columns, so that one job serves all of them."""
    doubles = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    return doubles.unpivot([], list(columns), "column", "value")


def column_quantiles(df: DataFrame, columns: Sequence[str], qs: Mapping[str, float]) -> DataFrame:
    """Exact quantiles of many columns at once, one row per column, in two scans whatever their number.

    The first scan holds one mergeable sketch a column, whose brackets are all the driver sees. The second counts, in each
    task, the values inside the brackets and what lies beside them; only these counts are shuffled.
    """
    columns = list(columns)
    values = df.select(*[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(columns)])
    probs = [max(q - MARGIN, 0.0) for q in qs.values()] + [min(q + MARGIN, 1.0) for q in qs.values()]
    m = len(qs)
    sketches = values.agg(*[f(F.col(f"_{i}")).alias(f"{k}{i}") for i in range(len(columns)) for k, f in (("n", F.count), ("p", lambda c: F.percentile_approx(c, probs, ACCURACY)))]).first()
    brackets = [(i, q, sketches[f"p{i}"][q], sketches[f"p{i}"][m + q]) for i in range(len(columns)) if sketches[f"n{i}"] for q in range(m)]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        below = dict.fromkeys(brackets, 0)
        before, after = dict.fromkeys(brackets, -np.inf), dict.fromkeys(brackets, np.inf)
        out: list[tuple] = []
        for batch in batches:
            for i, group in groupby(brackets, key=lambda b: b[0]):
                v = np.sort(batch.column(i).drop_null().to_numpy(zero_copy_only=False))
                if not len(v):
                    continue
                for b in group:
                    x, y = np.searchsorted(v, b[2], "left"), np.searchsorted(v, b[3], "right")
                    below[b] += int(x)
                    before[b] = max(before[b], v[x - 1]) if x else before[b]
                    after[b] = min(after[b], v[y]) if y < len(v) else after[b]
                    inside, n = np.unique(v[x:y], return_counts=True)
                    out += [(b[0], b[1], float(w), int(c), 0, None, None) for w, c in zip(inside, n)]
            if len(out) > 50_000:
                yield _counts(out)
                out = []
        finite = lambda w: float(w) if np.isfinite(w) else None
        out += [(b[0], b[1], None, 0, below[b], finite(before[b]), finite(after[b])) for b in brackets]
        yield _counts(out)

    kept = [("_k0", "int", pa.int32()), ("_q", "int", pa.int32()), ("_v", "double", pa.float64()), ("_c", "long", pa.int64()), ("below", "long", pa.int64()), ("prev", "double", pa.float64()), ("next", "double", pa.float64())]

    def _counts(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, _, t) in zip(list(zip(*rows)) or [()] * 7, kept)], names=[n for n, _, _ in kept])

    told = values.mapInArrow(counted, ", ".join(f"{n} {t}" for n, t, _ in kept)).groupBy("_k0", "_q", "_v").agg(F.sum("_c").alias("_c"), F.sum("below").alias("below"), F.max("prev").alias("prev"), F.min("next").alias("next"))
    # a bracket's values are shuffled as counts; the table that is read twice from here on is no larger
    told = cut_lineage(told)
    limits = F.array(*[F.array(*[F.struct(F.lit(float(next((b[2] for b in brackets if b[:2] == (i, q)), 0.0))).alias("l"), F.lit(float(next((b[3] for b in brackets if b[:2] == (i, q)), 0.0))).alias("h")) for q in range(m)]) for i in range(len(columns))])
    inside = told.where("_v is not null").withColumn("_b", F.get(F.get(limits, F.col("_k0")), F.col("_q")))
    width = F.col("_b.h") - F.col("_b.l")
    slot = F.when(width > 0, F.floor((F.col("_v") - F.col("_b.l")) / width * 256)).otherwise(F.lit(0))
    ranked = numbered(inside.select("_k0", "_q", "_v", "_c", slot.alias("_slot")), ["_k0", "_q"], ["_v"], F.col("_slot"), pos=None, running={"_from": "_c"}).select("_k0", "_q", "_v", "_c", "_from")
    sizes = F.array(*[F.lit(int(sketches[f"n{i}"])) for i in range(len(columns))])
    beside = [F.max(F.when(F.col("_q") == q, F.col(c))).alias(f"_{name}{q}") for q in range(m) for c, name in (("below", "below"), ("prev", "prev"), ("next", "next"))]
    edges = told.where("_v is null").groupBy("_k0").agg(*beside).withColumn("_n", F.get(sizes, F.col("_k0")).cast("long"))
    out = _at_ranks(ranked, edges, ["column"], ["_k0"], qs)
    return out.withColumn("column", F.get(F.array(*[F.lit(c) for c in columns]), F.col("column")))


def share_where(condition):
    """Share of rows that satisfy a condition, NULL counted as no."""
    return F.count_if(condition) / F.count(F.lit(1))


def all_of(conditions):
    return reduce(lambda a, b: a & b, conditions)
