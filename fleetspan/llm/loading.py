"""Best-fit loading of orders into vehicles, with bounds that certify the number of vehicles."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import stored, unused

PART_ROWS = 20_000  # orders loaded together
SPECIAL = {"<|endoftext|>": 50256}  # fixed values: the special token of the vocabulary byte_bpe_50k


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Vehicles that any loading needs: the best of the dual feasible functions f(k) of Fekete and Schepers and the plain volume.

    For a threshold t: sizes above capacity - t count a whole vehicle, sizes below t nothing, others themselves.
    """
    counts = np.bincount(sizes, minlength=capacity + 1)[: capacity + 1]
    volume = np.cumsum(counts * np.arange(capacity + 1))
    number = np.cumsum(counts)
    t = np.arange(0, capacity // 2 + 1)
    big = number[-1] - number[capacity - t]
    middle = volume[capacity - t] - np.where(t > 0, volume[np.maximum(t - 1, 0)], 0)
    best = int((big + -(-middle // capacity)).max()) if len(t) else 0
    for k in (1, 2, 3, 4):  # rounding functions: shares of 1/(k+1) and their multiples
        x = np.arange(capacity + 1) * (k + 1)
        f = np.where(x % capacity == 0, np.arange(capacity + 1) * k, (x // capacity) * capacity)
        best = max(best, -(-int((counts * f).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Vehicle number and place in it for every size, largest first, each into the fullest vehicle that still has room."""
    bins = np.empty(len(sizes), np.int64)
    place = np.empty(len(sizes), np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]  # vehicles by free room
    room, n = 0, 0  # bit r of room: some vehicle has r free
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        fits = room >> s
        if fits and s:
            r = s + (fits & -fits).bit_length() - 1
            b = free[r].pop()
            if not free[r]:
                room &= ~(1 << r)
        else:
            r, b, n = capacity, n, n + 1
        bins[i], place[i] = b, capacity - r
        if r > s:
            free[r - s].append(b)
            room |= 1 << (r - s)
    return bins, place


def load_orders(orders: DataFrame, units: str = "items_count", capacity: int = 2048, part_rows: int = PART_ROWS) -> DataFrame:
    """Load whole ``orders`` of ``units`` each into vehicles of ``capacity`` units, as few as can be certified.

    Orders are dealt at random into parts of about ``part_rows``; each part is loaded best fit decreasing, and its count is
    held against dual-feasible lower bounds. Where they differ, the vehicles that are not full are unloaded, their orders
    exchanged between parts and loaded again, until a round saves no vehicle. Returns all columns plus vehicle (unique
    numbers) and load_offset (gapless from 0); columns of these names are replaced. Null or negative units count 0 and go
    into a vehicle of their own; more than ``capacity`` units raise an error. Equal rows are separate orders. An empty
    table gives no rows.
    """
    spark = orders.sparkSession
    kept = [c for c in orders.columns if c not in ("vehicle", "load_offset")]
    part, open_, row = unused([*kept, "vehicle", "load_offset"], "_part", "_open", "_row")
    todo = orders.select(*kept)
    done, base = None, 0
    saved_to = None
    schema = todo.withColumn("vehicle", F.lit(0).cast("long")).withColumn("load_offset", F.lit(0).cast("long")).withColumn(open_, F.lit(False)).schema

    def loader(first: int, parts: int):
        def load(group: pd.DataFrame) -> pd.DataFrame:
            sizes = group[units].fillna(0).to_numpy(np.int64).clip(0)
            if len(sizes) and sizes.max() > capacity:
                raise ValueError(f"an order of {sizes.max()} units exceeds the capacity of {capacity}")
            bins, place = best_fit_decreasing(sizes, capacity)
            load_of = np.bincount(bins, weights=sizes, minlength=int(bins.max()) + 1)
            gap = len(load_of) > lower_bound(sizes, capacity)
            group["vehicle"] = first + bins * parts + int(group[part].iloc[0])
            group["load_offset"] = place
            group[open_] = gap & (load_of[bins] < capacity) & (sizes > 0)
            return group[[f.name for f in schema]]

        return load

    while True:
        todo = stored(todo.withColumn(row, F.monotonically_increasing_id()), "orders-to-load")
        n = todo.count()
        parts = max(1, -(-n // part_rows))
        dealt = todo.withColumn(part, F.pmod(F.xxhash64(row, F.lit(base)), F.lit(parts)))
        out = stored(dealt.groupBy(part).applyInPandas(loader(base, parts), schema), "loads")
        used, top, room = out.where(F.col(open_)).agg(F.countDistinct("vehicle"), F.max("vehicle"), F.sum(F.col(units))).first()
        whole = out.agg(F.max("vehicle")).first()[0]
        base = (whole if whole is not None else 0) + 1
        closed = out.where(~F.col(open_)).drop(open_)
        done = closed if done is None else done.unionByName(closed)
        # stop when all parts are certified, when the rest can't be loaded better, or when a round saves nothing
        if not used or parts == 1 or used <= -(-room // capacity) or (saved_to is not None and used >= saved_to):
            return done.unionByName(out.where(F.col(open_)).drop(open_))
        saved_to = used
        todo = out.where(F.col(open_)).select(*kept)


def token_pieces(records: DataFrame, key: str, text: str, vocabulary: str, capacity: int = 2048, end_id: int = 0, special: dict[str, int] = SPECIAL) -> DataFrame:
    """Pieces of tokenised texts: key, piece, start, length and the CRC-32 of the ids.

    ``vocabulary`` is a rank file of the public byte-level BPE. A text is its ids and then ``end_id``; a string in
    ``special`` is one token wherever it stands; null is empty. Texts of more than ``capacity`` ids are cut so that all pieces but the first
    are full.
    """
    held = records.sparkSession.sparkContext.broadcast(SimpleNamespace(ranks=open(vocabulary, "rb").read(), encoding=None))  # 1 MB, a fixed file
    schema = f"key {records.schema[key].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = held.value
        if v.encoding is None:  # once a worker: the broadcast value stays there
            import base64

            import public_tokenizers
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, v.ranks.splitlines())}
            v.encoding = tiktoken.Encoding("records", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        for b in batches:
            rows = []
            for k, t in zip(b.column(0).to_pylist(), b.column(1)):
                t = t.as_py() or ""
                ids = np.empty(0, np.uint32) if not t else v.encoding.encode_to_numpy(t, allowed_special="all")
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                first = len(ids) % capacity or capacity
                bounds = [0, *range(first, len(ids) + 1, capacity)]
                for i, (x, y) in enumerate(zip(bounds, bounds[1:])):
                    rows.append((k, i, x, y - x, zlib.crc32(ids[x:y].tobytes())))
            names = ["key", "piece", "start", "length", "ids_crc32"]
            types = [b.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types], names=names)

    return records.select(F.col(key), F.col(text)).mapInArrow(cut, schema)
