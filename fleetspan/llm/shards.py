"""Shards of near-equal bytes by histogram sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .store import stored, unused

LOW, HIGH = -(2**63), 2**63 - 1


def _below(rows: DataFrame, at: str, brackets: list[tuple[int, int]], probes: int) -> dict[int, int]:
    """Exact bytes below each evenly spaced candidate boundary: one pass, partial sums per partition."""
    edges = sorted({lo + (hi - lo) * i // probes for lo, hi in brackets for i in range(1, probes)} | {hi for _, hi in brackets})
    # disjoint, sorted brackets: a row's cell is its bracket's first boundary plus an even step inside it
    table = F.array(*[F.lit(e) for e in edges])
    cell = F.lit(0)
    for lo in range(0, len(edges), 16):  # two levels: block of 16 boundaries, then inside it
        cell = cell + F.when(F.col(at) >= F.lit(edges[lo]), 1).otherwise(0)
    block = rows.withColumn("_block", cell)
    index = (F.col("_block") - 1) * 16
    inside = sum(F.coalesce(F.get(table, index + i) <= F.col(at), F.lit(False)).cast("int") for i in range(1, 16))
    counted = block.withColumn("_cell", F.when(F.col("_block") == 0, 0).otherwise(index + 1 + inside)).groupBy("_cell").agg(F.sum("size").alias("b"))
    got = {r["_cell"]: int(r["b"]) for r in counted.collect()}  # at most brackets x probes rows
    out, total = {}, 0
    for i, e in enumerate(edges):
        total += got.get(i, 0)
        out[e] = total
    return out


def splitters(rows: DataFrame, at: str, targets: list[int], lo: int, hi: int, probes: int = 16, tolerance: int = 0) -> list[int]:
    """For each target the least boundary with that many bytes below it, or one whose bytes exceed it by ``tolerance`` at most.

    ``targets`` ascend; ``at`` is a long within [lo, hi). Each round counts all open brackets in one pass and cuts each to a
    1/probes part; brackets that coincide are probed once.
    """
    span = [(lo, hi)] * len(targets)  # bytes below span[0] < target <= bytes below span[1]
    done: list[int | None] = [None] * len(targets)
    while any(d is None for d in done):
        below = _below(rows, at, sorted({s for s, d in zip(span, done) if d is None}), probes)
        for j, t in enumerate(targets):
            if done[j] is not None:
                continue
            a, b = span[j]
            for e in sorted(x for x in below if a < x <= b):
                if below[e] >= t:
                    b = e
                    break
                a = e
            span[j] = (a, b)
            if b - a <= 1 or t <= below.get(b, -1) <= t + tolerance:
                done[j] = b
    return done


def balanced_shards(orders: DataFrame, order_key: str = "order_id", size: str = "package_bytes", shards: int = 40, run_bytes: int = 128 << 20, probes: int = 16, tolerance: int = 0) -> DataFrame:
    """Deal ``orders`` into ``shards`` contiguous ranges of ``order_key`` with near-equal sums of ``size``.

    ``order_key`` is a whole number, or a string that orders by the number its digits make, as the project's ids do; null, and a
    string without such a number, sorts first. Splitters are refined from
    exact byte counts until they meet ``tolerance``, then rows are exchanged once, by (shard, run); runs, about
    ``run_bytes`` each, keep a shard's numbering out of one task. Rows of one key may be cut: a boundary inside a key
    falls between its rows by a row number. Returns all columns plus shard and slot (gapless from 0 in a shard, in key
    order within a run); columns of these names are replaced. Null sizes count 0; an empty table gives an empty result.
    """
    orders = orders.drop("shard", "slot")
    key, weight, tie, run, first, n = unused(orders.columns, "_key", "_size", "_tie", "_run", "_first", "_n")
    number = F.col(order_key)
    if isinstance(orders.schema[order_key].dataType, StringType):
        number = F.regexp_replace(number, "[^0-9]", "").try_cast("long")
    data = orders.withColumn(key, F.greatest(F.lit(LOW + 1), F.least(F.lit(HIGH - 1), F.coalesce(number.cast("long"), F.lit(LOW + 1))))).withColumn(weight, F.coalesce(F.col(size).cast("long"), F.lit(0)))
    data = stored(data, "orders-to-shard")
    slim = data.select(F.col(key).alias("at"), F.col(weight).alias("size"))
    total, lo, hi = slim.agg(F.sum("size"), F.min("at"), F.max("at")).first()
    if not total:
        return data.drop(key, weight).withColumn("shard", F.lit(0)).withColumn("slot", F.row_number().over(Window.partitionBy("shard").orderBy(order_key)).cast("long") - 1)
    targets = [-(-total * j // shards) for j in range(1, shards)]
    cut = splitters(slim, "at", targets, lo - 1, hi + 1, probes, tolerance)
    # bytes below a boundary's own key, to see whether the target falls inside a key of many rows
    keyed = slim.where(F.col("at").isin([c - 1 for c in set(cut)])).groupBy("at").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()
    many = {r["at"] for r in keyed if r["n"] > 1 and r["b"] > max(tolerance, total // shards // 100)}
    data = data.withColumn(tie, F.when(F.col(key).isin(sorted(many)), F.monotonically_increasing_id()).otherwise(0)) if many else data.withColumn(tie, F.lit(0).cast("long"))
    bounds: list[tuple[int, int]] = []
    if many:
        at_below = _exact_below(slim, sorted(many))
        for k in sorted(many):
            mine = [t - at_below[k] for t, c in zip(targets, cut) if c - 1 == k]
            hot = data.where(F.col(key) == k).select(F.col(tie).alias("at"), F.col(weight).alias("size"))
            top = hot.agg(F.max("at")).first()[0]
            bounds += [(k, x) for x in splitters(hot, "at", mine, -1, top + 1, probes, tolerance)]
    bounds = sorted(bounds + [(c, 0) for c in cut if c - 1 not in many])
    shard = sum(((F.col(key) > k) | ((F.col(key) == k) & (F.col(tie) >= t))).cast("int") for k, t in bounds)
    runs = max(1, -(-total // (shards * run_bytes)))
    data = data.withColumn("shard", shard).withColumn(run, F.pmod(F.xxhash64(key, tie), F.lit(runs)))
    counts = data.groupBy("shard", run).agg(F.count("*").alias(n))
    ahead = Window.partitionBy("shard").orderBy(run).rowsBetween(Window.unboundedPreceding, -1)  # one row per run
    counts = counts.select("shard", run, F.coalesce(F.sum(n).over(ahead), F.lit(0)).alias(first))
    place = Window.partitionBy("shard", run).orderBy(key, tie, F.xxhash64(*[c for c in orders.columns]))
    out = data.join(counts, ["shard", run]).withColumn("slot", F.col(first) + F.row_number().over(place) - 1)
    return out.drop(key, weight, tie, run, first)


def _exact_below(slim: DataFrame, keys: list[int]) -> dict[int, int]:
    row = slim.agg(*[F.coalesce(F.sum(F.when(F.col("at") < k, F.col("size"))), F.lit(0)).alias(f"k{i}") for i, k in enumerate(keys)]).first()
    return {k: int(row[i]) for i, k in enumerate(keys)}
