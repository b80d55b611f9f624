"""Order-dependent operators that never put one whole key into one task.

A plain ``Window.partitionBy(key)`` sorts every row of a key in a single task, which fails when one
site or customer holds a third of the table. The operators here use three building blocks instead:

``numbered``
    Splits each key into buckets that follow the order (a day, an hour, a value range), works inside
    (key, bucket) and adds the totals of earlier buckets. Facts are shuffled once, on (key, bucket),
    and keep that partitioning for the join with the totals; only the bucket totals, one row each, are
    ever brought together per key.

``framed``
    Cuts a numbered key into blocks of ``block`` rows and copies the few rows near a block edge into
    the neighbour block, so that a window reaching ``lookback`` rows back sees exactly what it needs.

``blocked``
    Does both in one shuffle of the facts: blocks are whole buckets, found from the bucket totals.

``order`` must identify a row within its key, otherwise positions are not reproducible.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, DateType, NumericType, TimestampNTZType, TimestampType

from ..functions.calendar import epoch_seconds
from ..functions.scalars import col
from ..session import cut_lineage

DAY = 86400
BLOCK_ROWS = 500_000


def time_bucket(ts: str | Column, seconds: int = DAY) -> Column:
    """Order-preserving bucket for keys ordered by time; pick a finer step for denser data."""
    return F.floor(epoch_seconds(ts) / seconds)


def value_bucket(df: DataFrame, value: str, parts: int = 128) -> tuple[DataFrame, Column]:
    """Order-preserving bucket with about equal row counts, from approximate quantiles of the column.

    Returns the frame with the (fixed-size) bounds attached as ``_bounds`` and the bucket expression.
    """
    probs = [i / parts for i in range(1, parts)]
    bounds = df.agg(F.percentile_approx(F.col(value).cast("double"), probs, 10_000).alias("_bounds")).scalar()
    return df.withColumn("_bounds", bounds), F.size(F.filter("_bounds", lambda b: b < F.col(value)))


def text_ranges(df: DataFrame, column: str) -> tuple[DataFrame, Column]:
    """Order-preserving bucket of a column of any type, cut by its own values; the ranges are kept by a checkpoint."""
    return cut_lineage(df.repartitionByRange(column).withColumn("_range", F.spark_partition_id())), F.col("_range")


def _columns(order: Sequence) -> list[Column]:
    return [col(c) for c in order]


def _stand_in(kind: DataType) -> Column:
    """Any value of a type, to stand for NULL beside a flag that tells them apart."""
    if isinstance(kind, (DateType, TimestampType, TimestampNTZType)):
        return F.lit("1970-01-01").cast(kind)
    return F.lit(0).cast(kind) if isinstance(kind, (NumericType, BooleanType)) else F.lit("").cast(kind)


def numbered(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence,
    bucket: Column | Sequence[Column],
    pos: str | None = "pos",
    running: Mapping[str, str | Column] | None = None,
    size: str | None = None,
    keep_null: bool = False,
) -> DataFrame:
    """Add the 0-based position within the key, exclusive running sums and the key's row count.

    ``running`` maps an output column to the expression summed over all *earlier* rows of the key
    (0 for the first row). Rows with a NULL key are dropped, as a group-by of the source data would, or with
    ``keep_null`` form a key of their own.
    """
    keys, running = list(keys), dict(running or {})
    buckets = [bucket] if isinstance(bucket, Column) else list(bucket)
    bnames = [f"_b{i}" for i in range(len(buckets))]
    base = df if keep_null or not keys else df.dropna(subset=keys)
    base = base.withColumns(
        {n: b for n, b in zip(bnames, buckets)} | {f"_v_{n}": col(c) for n, c in running.items()}
    )
    # a bucket may be NULL (a missing time) and forms a leading one; flags and stand-ins let the join below match by
    # plain equality, which keeps the partitioning of the window, and so the facts are not shuffled again
    kind = {f.name: f.dataType for f in base.schema.fields}
    nullable = [*bnames, *(keys if keep_null else [])]
    flags, plain = {c: f"_f_{c}" for c in nullable}, {c: f"_p_{c}" for c in nullable}
    base = base.withColumns({flags[c]: F.col(c).isNotNull() for c in nullable} | {plain[c]: F.coalesce(F.col(c), _stand_in(kind[c])) for c in nullable})
    keys = [x for c in keys for x in ((flags[c], plain[c]) if keep_null else (c,))]
    bnames = [x for c in bnames for x in (flags[c], plain[c])]
    parts = keys + bnames

    totals = base.groupBy(*parts).agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in running]
    )
    # one row per bucket from here on
    earlier = Window.partitionBy(*keys).orderBy(*bnames).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    carry = totals.select(
        *parts,
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n0"),
        F.sum("_n").over(whole).alias("_size"),
        *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_c_{n}") for n in running],
    )

    inside = Window.partitionBy(*parts).orderBy(*_columns(order))
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    local = base.withColumns(
        {"_rn": F.row_number().over(inside)}
        | {f"_r_{n}": F.coalesce(F.sum(f"_v_{n}").over(before), F.lit(0)) for n in running}
    )
    return local.join(carry, parts, "inner").select(
        *df.columns,
        *([(F.col("_rn") - 1 + F.col("_n0")).alias(pos)] if pos else []),
        *([F.col("_size").alias(size)] if size else []),
        *[(F.col(f"_r_{n}") + F.col(f"_c_{n}")).alias(n) for n in running],
    )


def framed(
    df: DataFrame, keys: Sequence[str], pos: str, lookback: int = 0, lookahead: int = 0, block: int = BLOCK_ROWS
) -> tuple[DataFrame, Callable[..., Window]]:
    """Copy edge rows into the neighbour block; returns the frame and its window.

    Rows belonging to the block carry ``_own = true``; filter on it after the window columns are added.
    """
    if max(lookback, lookahead) > block:
        raise ValueError("a frame must fit into one block")
    blk, off = F.floor(F.col(pos) / block), F.col(pos) % block
    copies = F.array_compact(
        F.array(
            blk,
            F.when(off >= block - lookback, blk + 1) if lookback else F.lit(None).cast("bigint"),
            F.when((off < lookahead) & (blk > 0), blk - 1) if lookahead else F.lit(None).cast("bigint"),
        )
    )
    out = df.withColumn("_blk", F.explode(copies)).withColumn("_own", F.col("_blk") == blk)
    return out, Window.partitionBy(*keys, "_blk").orderBy(pos)


def windowed(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence,
    bucket: Column | Sequence[Column],
    columns: Callable[[Window], Mapping[str, Column]],
    lookback: int = 0,
    lookahead: int = 0,
    block: int = BLOCK_ROWS,
    pos: str | None = None,
    running: Mapping[str, str | Column] | None = None,
    size: str | None = None,
    keep_null: bool = False,
    first: Callable[[Window], Mapping[str, Column]] | None = None,
) -> DataFrame:
    """Window columns over a bounded frame, exact on keys of any size.

    ``first`` adds helper columns over the same window that ``columns`` may look back on.
    """
    ranked = numbered(df, keys, order, bucket, pos="_pos", running=running, size=size, keep_null=keep_null)
    cut, w = framed(ranked, keys, "_pos", lookback, lookahead, block)
    helpers = dict(first(w)) if first else {}
    made = cut.withColumns(helpers).withColumns(dict(columns(w))).where("_own").drop("_blk", "_own", *helpers)
    return made.withColumnRenamed("_pos", pos) if pos else made.drop("_pos")


# ---------------------------------------------------------------- history without leakage


def prior_count(df, keys, order, bucket, out="prior_count") -> DataFrame:
    """How many rows of the key came before this one."""
    return numbered(df, keys, order, bucket, pos=out)


def prior_rate(df, keys, order, bucket, flag, out="prior_rate") -> DataFrame:
    """Mean of a flag over strictly earlier rows; NULL where there is none."""
    hit = col(flag).cast("int")
    run = {"_hits": F.coalesce(hit, F.lit(0)), "_known": hit.isNotNull().cast("int")}
    ranked = numbered(df, keys, order, bucket, pos=None, running=run)
    return ranked.withColumn(out, F.when(F.col("_known") > 0, F.col("_hits") / F.col("_known"))).drop(*run)


def prefix_sums(w, value: str) -> dict[str, Column]:
    """Sum and count of the finite values before each row of the block."""
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    v = F.when(F.abs(value) < float("inf"), F.col(value).cast("double"))
    return {"_cum": F.coalesce(F.sum(v).over(before), F.lit(0.0)), "_cnt": F.count(v).over(before)}


def rolling_mean_column(w, rows: int, min_rows: int) -> Column:
    """Mean of the previous ``rows`` rows as a difference of prefix sums: constant work per row."""
    n = F.col("_cnt") - F.lag("_cnt", rows, 0).over(w)
    total = F.col("_cum") - F.lag("_cum", rows, 0.0).over(w)
    return F.when(n >= min_rows, total / n)


def rolling_rows_mean(df, keys, order, bucket, value, rows, min_rows=3, out="rolling_mean", block=BLOCK_ROWS):
    """Mean of the previous ``rows`` rows, NULL below ``min_rows`` known values.

    The source data's "7 day" and "30 day" columns are in fact the previous 35 and 150 rows.
    """
    return windowed(
        df, keys, order, bucket, lambda w: {out: rolling_mean_column(w, rows, min_rows)},
        lookback=rows, block=block, first=lambda w: prefix_sums(w, value),
    )


def _cuts(df: DataFrame, keys: Sequence[str], bucket: str, running: Sequence[str], lookback: int, block: int) -> DataFrame:
    """Where keys of more than ``block`` rows are cut: one row a key with a list of its blocks.

    A block holds whole buckets: from ``at`` up to ``end`` its own, from ``back`` on the earlier ones that frames of
    ``lookback`` rows reach into; ``n0`` and ``c_*`` are the totals before ``back``. There is less than one block and
    one key for each ``block`` rows, so the table is small.
    """
    totals = df.groupBy(*keys, bucket).agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_t{c}") for c in running])
    rising = Window.partitionBy(*keys).orderBy(bucket)
    earlier = rising.rowsBetween(Window.unboundedPreceding, -1)
    placed = totals.withColumns({"n0": F.coalesce(F.sum("_n").over(earlier), F.lit(0))} | {f"c{c}": F.coalesce(F.sum(f"_t{c}").over(earlier), F.lit(0)) for c in running})
    here = F.struct(F.col(bucket).alias("back"), "n0", *[f"c{c}" for c in running])
    reach = F.max(here).over(Window.partitionBy(*keys).orderBy("n0").rangeBetween(Window.unboundedPreceding, -lookback))
    # a key's first bucket is where frames end that reach back too far
    placed = placed.withColumns({"blk": F.floor(F.col("n0") / block), "_from": F.coalesce(reach, F.first(here).over(rising))})
    starts = placed.withColumn("_last", F.lag("blk").over(rising)).where(F.col("_last").isNull() | (F.col("blk") > F.col("_last")))
    entry = F.struct("blk", F.col(bucket).alias("at"), F.lead(bucket).over(rising).alias("end"), "_from.*")
    return starts.select(*keys, entry.alias("_e")).groupBy(*keys).agg(F.collect_list("_e").alias("_cuts")).where(F.size("_cuts") > 1)


def blocked(
    df: DataFrame, keys: Sequence[str], order: Sequence, bucket: Column, running: Mapping[str, Column], lookback: int, block: int = BLOCK_ROWS,
    sizes_from: DataFrame | None = None, totals_from: DataFrame | None = None,
) -> tuple[DataFrame, Window]:
    """Cut large keys into blocks of whole buckets before the rows move, so that they are shuffled once.

    Returns the frame and its window. ``_own`` marks the rows of a block, the others are copies for frames of up to
    ``lookback`` rows; ``_n0`` and ``_c_*`` are the rows and the sums of ``running`` before the first row of the window.
    ``sizes_from`` may name a narrower table with the same keys, in which keys of more than ``block`` rows are looked for,
    ``totals_from`` one with the same rows and the columns of keys, bucket and ``running``, for the totals of the buckets.
    """
    keys = list(keys)
    before = ["n0", *[f"c{c}" for c in running]]
    no_key = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    # rows without a key have no history: any block will do
    alone = F.struct(F.when(no_key, F.pmod(F.xxhash64(*_columns(order)), F.lit(1024))).otherwise(F.lit(0)).cast("bigint").alias("blk"), F.lit(True).alias("own"), *[F.lit(0).cast("bigint").alias(c) for c in before])
    b = F.coalesce(bucket.cast("bigint"), F.lit(-(2**63)).cast("bigint"))
    base, counted, known = df.withColumn("_b", b), (df if totals_from is None else totals_from).withColumn("_b", b), None
    if sizes_from is not None:
        large = sizes_from.dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > block).select(*keys)
        known = None if large.isEmpty() else counted.join(F.broadcast(large), keys, "left_semi")
    else:
        known = counted.dropna(subset=keys)
    if known is None:
        placed = base.withColumn("_at", alone)
    else:
        held = F.filter("_cuts", lambda c: (c["back"] <= F.col("_b")) & (c["end"].isNull() | (F.col("_b") < c["end"])))
        at = F.transform(held, lambda c: F.struct(c["blk"].alias("blk"), (c["at"] <= F.col("_b")).alias("own"), *[c[x].alias(x) for x in before]))
        cuts = _cuts(known.withColumns(running), keys, "_b", list(running), lookback, block)
        placed = base.join(F.broadcast(cuts), keys, "left").withColumn("_at", F.explode(F.coalesce(at, F.array(alone))))
    out = placed.select(*df.columns, F.col("_at.blk").alias("_blk"), F.col("_at.own").alias("_own"), *[F.col(f"_at.{c}").alias(f"_{c}") for c in before])
    # moved here, so that helper columns of the window are not; whole keys stay where a join by the key has put them
    out = out if known is None else out.repartition(*keys, "_blk")
    return out, Window.partitionBy(*keys, "_blk").orderBy(*_columns(order))


def history_features(df, keys, order, bucket, flag, value, rows=(35, 150), min_rows=3, prefix="key", block=BLOCK_ROWS, sizes_from=None, totals_from=None):
    """Prior count, prior rate and several row-window means of one key in one shuffle.

    ``flag`` and ``value`` are columns or names. Rows without a key stay, with NULL history. ``sizes_from`` and
    ``totals_from``: see ``blocked``.
    """
    hit = col(flag).cast("int")
    run = {"_hits": F.coalesce(hit, F.lit(0)), "_known": hit.isNotNull().cast("int")}
    cut, w = blocked(df, keys, order, bucket, run, max(rows), block, sizes_from, totals_from)
    cut = cut.withColumns(run | {"_value": col(value)})
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    sums = {f"_r{c}": F.coalesce(F.sum(c).over(before), F.lit(0)) + F.col(f"_c{c}") for c in run}
    made = cut.withColumns({"_pos": F.row_number().over(w) - 1 + F.col("_n0")} | sums | prefix_sums(w, "_value"))
    made = made.withColumns({f"{prefix}_roll{n}_mean": rolling_mean_column(w, n, min_rows) for n in rows}).where("_own")
    has_key = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    columns = {f"{prefix}_prior_count": F.col("_pos"), f"{prefix}_prior_rate": F.when(F.col("_r_known") > 0, F.col("_r_hits") / F.col("_r_known"))}
    columns |= {c: F.col(c) for c in (f"{prefix}_roll{n}_mean" for n in rows)}
    return made.select(*df.columns, *[F.when(has_key, c).alias(n) for n, c in columns.items()])


def rolling_days_mean(df, keys, ts, value, days, out="rolling_days_mean", min_rows=3) -> DataFrame:
    """Mean over the ``days`` days that end just before this row's time (rows of the same instant excluded).

    Sums per (key, instant) are taken first. Each instant is then placed in its ``days``-long slot and
    the next one, so a task holds at most two slots of one key's instants, never the whole key.
    """
    span = days * DAY
    base = df.dropna(subset=list(keys)).withColumn("_t", epoch_seconds(ts))
    instants = base.groupBy(*keys, "_t").agg(
        F.count(value).alias("_n"), F.coalesce(F.sum(value), F.lit(0.0)).alias("_s")
    )
    slot = F.floor(F.col("_t") / span)
    placed = instants.withColumn("_slot", F.explode(F.array(slot, slot + 1))).withColumn("_mine", F.col("_slot") == slot)
    w = Window.partitionBy(*keys, "_slot").orderBy("_t").rangeBetween(-span, -1)
    n = F.coalesce(F.sum("_n").over(w), F.lit(0))
    mean = (
        placed.withColumn(out, F.when(n >= min_rows, F.sum("_s").over(w) / n))
        .where("_mine")
        .select(*keys, "_t", out)
    )
    return base.join(mean, [*keys, "_t"], "left").select(*df.columns, out)


def lags(df, keys, order, bucket, value, steps=(1, 2, 7), prefix=None, block=BLOCK_ROWS) -> DataFrame:
    name = prefix or f"{value}_lag"
    return windowed(
        df, keys, order, bucket, lambda w: {f"{name}{k}": F.lag(value, k).over(w) for k in steps},
        lookback=max(steps), block=block,
    )


def lead_label(df, keys, order, bucket, flag, out="next_flag", block=BLOCK_ROWS) -> DataFrame:
    """The flag of the key's next row; rows without a next row are dropped."""
    made = windowed(
        df, keys, order, bucket, lambda w: {out: F.lead(flag).over(w)}, lookahead=1, block=block
    )
    return made.where(F.col(out).isNotNull())


def run_tag(df, keys, order, bucket, start: Column, run: int, out="in_run", block=BLOCK_ROWS) -> DataFrame:
    """True on a start row and the ``run - 1`` rows after it."""
    return windowed(
        df.withColumn("_start", start.cast("int")), keys, order, bucket,
        lambda w: {out: F.max("_start").over(w.rowsBetween(-(run - 1), 0)) == 1},
        lookback=run - 1, block=block,
    ).drop("_start")


def terminal_flag(df, keys, order, bucket, seq="event_sequence", progress="progress", out="is_terminal") -> DataFrame:
    """1-based sequence, progress i/(n-1) and a flag on the last row of each key."""
    ranked = numbered(df, keys, order, bucket, pos="_i", size="_n")
    return ranked.withColumns(
        {
            seq: F.col("_i") + 1,
            progress: F.col("_i") / F.greatest(F.col("_n") - 1, F.lit(1)),
            out: F.col("_i") == F.col("_n") - 1,
        }
    ).drop("_i", "_n")


def thin_trace(df, keys, order, bucket, target=40, min_points=3) -> DataFrame:
    """Every (n // target)-th point of each trace with at least ``min_points`` points."""
    ranked = numbered(df, keys, order, bucket, pos="point", size="_n")
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / target))
    return ranked.where((F.col("_n") >= min_points) & (F.col("point") % step == 0)).drop("_n")


def cluster_runs(df, keys, order, bucket, run_len, run="run_no", stop="stop_sequence") -> DataFrame:
    """Cut each key's ordered rows into runs of ``run_len``; adds run number and 1-based stop number.

    ``run_len`` is a number or a column that is constant within the key.
    """
    length = run_len if isinstance(run_len, Column) else F.lit(run_len)
    ranked = numbered(df, keys, order, bucket, pos="_i")
    return ranked.withColumns(
        {run: F.floor(F.col("_i") / length), stop: (F.col("_i") % length + 1).cast("int")}
    ).drop("_i")


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Values of the latest row of each key, by a partial aggregate (no sort, no window)."""
    row = F.max_by(F.struct(*columns), F.struct(*order)).alias("_last")
    return df.dropna(subset=list(keys)).groupBy(*keys).agg(row).select(*keys, "_last.*")


# ---------------------------------------------------------------- ranks and shares


def pct_rank(df: DataFrame, value: str, out="pct_rank", null_rank: float = 0.5, parts: int = 128) -> DataFrame:
    """Average percentile rank over the whole table, ties share their mean rank, NULL gets ``null_rank``.

    Ranks are computed once per distinct value, in value buckets, and joined back.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("_val")).agg(F.count(F.lit(1)).alias("_k"))
    counts, bucket = value_bucket(counts, "_val", parts)
    ranked = numbered(counts, [], ["_val"], bucket, pos=None, running={"_below": "_k"})
    total = df.agg(F.count(value)).scalar()
    table = ranked.select("_val", ((F.col("_below") + (F.col("_k") + 1) / 2) / total).alias("_rank"))
    joined = df.join(table, df[value] == table["_val"], "left")
    return joined.select(*df.columns, F.coalesce("_rank", F.lit(null_rank)).alias(out))


def dense_rank_in_group(df: DataFrame, by: Sequence[str], score: str, bucket: Column, out="rank_in_group") -> DataFrame:
    """Dense rank by score, highest first. ``bucket`` follows the *descending* score."""
    distinct = df.dropna(subset=list(by)).select(*by, score).distinct()
    ranks = numbered(distinct, by, [F.col(score).desc()], bucket, pos="_r")
    renamed = ranks.select(*[F.col(c).alias(f"_g_{c}") for c in by], F.col(score).alias("_g_score"), "_r")
    match = reduce(lambda a, b: a & b, [df[c] == renamed[f"_g_{c}"] for c in by])
    joined = df.join(renamed, match & df[score].eqNullSafe(renamed["_g_score"]), "inner")
    return joined.select(*df.columns, (F.col("_r") + 1).cast("int").alias(out))


def group_ratio(df: DataFrame, value: str, by: Sequence[str], out="ratio") -> DataFrame:
    """Value over its group mean; the mean is a small aggregate joined back instead of a window."""
    means = df.groupBy(*by).agg((F.sum(value) / F.count(value)).alias("_mean"))
    return df.dropna(subset=list(by)).join(means, list(by), "inner").select(
        *df.columns, F.try_divide(F.col(value), F.col("_mean")).alias(out)
    )


def period_over_period(small: DataFrame, period: str, columns: Sequence[str]) -> DataFrame:
    """Change in percent against the previous period. ``small`` has one row per period already."""
    w = Window.orderBy(period)

    def change(c):
        prev = F.lag(c).over(w)
        return F.try_divide((F.col(c) - prev) * 100, F.abs(prev))

    return small.withColumns({f"{c}_delta": change(c) for c in columns})


def cumulative_share(df: DataFrame, value: str, order: Sequence, bucket: Column, level: float = 0.9) -> DataFrame:
    """Running share of the total in the given order, and a mark on the first row that reaches ``level``."""
    total = df.agg(F.sum(value)).scalar()
    run = numbered(df, [], order, bucket, pos="position", running={"_before": value})
    share_before = F.col("_before") / total
    share = (F.col("_before") + F.col(value)) / total
    return run.withColumns(
        {"cumulative_share": share, "reaches_level": (share >= level) & (share_before < level)}
    ).drop("_before")


def trend_index(small: DataFrame, period: str, out="trend_index") -> DataFrame:
    """0..n-1 over a series that holds one row per period (days, not facts)."""
    return small.withColumn(out, F.row_number().over(Window.orderBy(period)) - 1)
