"""Data quality: masking with known truth, labelled corruption, detection and rule checks."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import add_seconds, epoch_seconds
from ..functions.chance import hash_uniform, uniform_between
from ..functions.geo import haversine_km
from ..functions.labels import append_label, label_array
from .joins import anti_join_orphans
from .ordered import pct_rank, windowed

# ---------------------------------------------------------------- missingness


@dataclass(frozen=True)
class MaskRule:
    """Which cells of a column go missing: flat (MCAR), by another column (MAR), by the value itself (MNAR)."""

    column: str
    mechanism: str = "MCAR"
    rate: float = 0.05
    driver: str | None = None
    direction: str = "high"
    numeric_driver: bool = True


def _tilted(df: DataFrame, weight: Column, rate: float, u: Column) -> DataFrame:
    """Add ``_mask``: u < weight scaled so that its mean over all rows is ``rate``, capped at 0.98."""
    weighted = df.withColumn("_w", weight)
    mean = weighted.agg((F.sum("_w") / F.count("_w")).alias("m")).scalar()
    p = F.least(F.col("_w") * rate / F.greatest("_m", F.lit(1e-9)), F.lit(0.98))
    return weighted.withColumn("_m", mean).withColumn("_mask", u < p).drop("_w", "_m")


def mask_mcar(df: DataFrame, key: Sequence[str], column: str, rate: float, seed: int = 42) -> DataFrame:
    return df.withColumn("_mask", hash_uniform(f"missing:{column}", key, seed) < rate)


def mask_mar(df: DataFrame, key: Sequence[str], column: str, driver: str, rate: float, numeric: bool = True, seed: int = 42):
    """Numeric drivers tilt by percentile rank; others by one multiplier per level, NULL being a level."""
    u = hash_uniform(f"missing:{column}", key, seed)
    if numeric:
        return _tilted(pct_rank(df, driver, "_r"), F.col("_r") * 1.3 + 0.35, rate, u).drop("_r", "_bounds")
    level = F.coalesce(F.col(driver).cast("string"), F.lit("__NA__"))
    return _tilted(df, uniform_between(hash_uniform(f"level:{column}", level, seed), 0.25, 2.4), rate, u)


def mask_mnar(df: DataFrame, key: Sequence[str], column: str, rate: float, direction: str = "high", seed: int = 42):
    """The hidden value itself drives its chance of being hidden."""
    ranked = pct_rank(df, column, "_r")
    tilt = F.col("_r") if direction == "high" else 1.0 - F.col("_r")
    return _tilted(ranked, tilt * 1.85 + 0.15, rate, hash_uniform(f"missing:{column}", key, seed)).drop("_r")


def mask_column(df: DataFrame, key: Sequence[str], rule: MaskRule, seed: int = 42) -> DataFrame:
    """Add ``_mask`` for one rule; already missing cells are never chosen."""
    if rule.mechanism == "MCAR" or (rule.mechanism == "MAR" and rule.driver not in df.columns):
        out = mask_mcar(df, key, rule.column, rule.rate, seed)
    elif rule.mechanism == "MAR":
        out = mask_mar(df, key, rule.column, rule.driver, rule.rate, rule.numeric_driver, seed)
    elif rule.mechanism == "MNAR":
        out = mask_mnar(df, key, rule.column, rule.rate, rule.direction, seed)
    else:
        raise ValueError(f"unknown mechanism {rule.mechanism!r}")
    return out.withColumn("_mask", F.col("_mask") & F.col(rule.column).isNotNull())


def apply_missingness(df: DataFrame, table: str, key: Sequence[str], rules: Sequence[MaskRule], seed: int = 42):
    """Masked frame, ground truth of the masked cells, and a report of target against achieved rates.

    Rules apply in order: a later rule sees the cells an earlier one emptied.
    """
    out, truths = df, []
    for i, rule in enumerate(rules):
        marked = mask_column(out, key, rule, seed + i)
        truths.append(
            marked.where("_mask").select(
                F.lit(table).alias("table"), F.lit(rule.column).alias("column"),
                F.concat_ws(":", *[F.col(k).cast("string") for k in key]).alias("row_key"),
                F.col(rule.column).cast("string").alias("true_value"), F.lit(rule.mechanism).alias("mechanism"),
            )
        )
        out = marked.withColumn(rule.column, F.when(~F.col("_mask"), F.col(rule.column))).drop("_mask")
    report = missing_report(df, out, table, rules)
    return out, reduce(lambda a, b: a.unionByName(b), truths), report


def missing_report(before: DataFrame, after: DataFrame, table: str, rules: Sequence[MaskRule]) -> DataFrame:
    """One row per rule: rows, missing before and after, target and achieved rate."""
    cols = list(dict.fromkeys(r.column for r in rules))
    counts = lambda df: df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    was, now = counts(before), counts(after)
    rows = [
        F.struct(
            F.lit(table).alias("table"), F.lit(r.column).alias("column"), F.lit(r.mechanism).alias("mechanism"),
            F.lit(float(r.rate)).alias("target_rate"), F.col(r.column).alias("n_missing"), F.col("_n").alias("n_rows"),
            F.col(f"_was_{r.column}").alias("n_missing_before"),
        )
        for r in rules
    ]
    one = now
    for c in cols:
        one = one.withColumn(f"_was_{c}", was.select(c).scalar())
    long = one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    return long.withColumn("achieved_rate", F.try_divide(F.col("n_missing"), F.col("n_rows")))


def missingness_sweep(df: DataFrame, table: str, key: Sequence[str], rules: Sequence[MaskRule], rates: Sequence[float], seed=42):
    """The report at several severities; the data stay as they are."""
    frames = []
    for rate in rates:
        scaled = [MaskRule(**{**r.__dict__, "rate": rate}) for r in rules]
        frames.append(apply_missingness(df, table, key, scaled, seed)[2])
    return reduce(lambda a, b: a.unionByName(b), frames)


def score_imputation(imputed: DataFrame, truth: DataFrame, key: Sequence[str], column: str) -> DataFrame:
    """Error of imputed values at the cells whose truth was kept."""
    filled = imputed.select(
        F.concat_ws(":", *[F.col(k).cast("string") for k in key]).alias("row_key"), F.col(column).cast("double").alias("_x")
    )
    both = truth.where(F.col("column") == column).join(filled, "row_key", "inner")
    err = F.col("_x") - F.col("true_value").cast("double")
    return both.agg(F.count(F.lit(1)).alias("cells"), F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"), F.avg(err).alias("bias"))


# ---------------------------------------------------------------- injection


def inject_rowwise(
    df: DataFrame, key: Sequence[str], label: str, rate: float, edits: Mapping[str, Callable[[Column], Column] | Column],
    only: Column | None = None, flags: str = "anomaly_flags", seed: int = 42,
) -> DataFrame:
    """Rows chosen by their hash uniform get the column edits and the label."""
    chosen = hash_uniform(f"anomaly:{label}", key, seed) < rate
    chosen = chosen & F.coalesce(only, F.lit(False)) if only is not None else chosen
    marked = df.withColumn("_hit", chosen)
    if flags not in df.columns:
        marked = marked.withColumn(flags, F.lit(""))
    made = {c: F.when(F.col("_hit"), e(F.col(c)) if callable(e) else e).otherwise(F.col(c)) for c, e in edits.items()}
    made[flags] = append_label(flags, label, F.col("_hit"))
    return marked.withColumns(made).drop("_hit")


def event_windows(spark, n: int, hours: tuple[int, int], start: str, span_hours: int, places: Sequence[str], seed: int = 42, stream="windows"):
    """``n`` windows: place, start and end drawn from named streams."""
    base = spark.range(n).withColumnRenamed("id", "window_id")
    u = lambda s: hash_uniform(f"{stream}:{s}", "window_id", seed)
    place = F.element_at(F.array(*[F.lit(p) for p in places]), (F.floor(u("place") * len(places)) + 1).cast("int"))
    begin = add_seconds(F.to_timestamp_ntz(F.lit(start)), F.floor(u("start") * span_hours) * 3600)
    length = F.floor(u("len") * (hours[1] - hours[0] + 1)) + hours[0]
    return base.select("window_id", place.alias("place"), begin.alias("start_ts"), add_seconds(begin, length * 3600).alias("end_ts"), u("mult").alias("u_mult"))


def inject_windows(
    df: DataFrame, windows: DataFrame, place: str, ts: str, label: str, edits: Mapping[str, Callable[[Column, Column], Column]],
    row_key: Sequence[str], strength: str = "multiplier", flags: str = "anomaly_flags",
) -> DataFrame:
    """Rows inside windows of their place are edited once per window and labelled once per window.

    Strengths of all windows over a row are gathered first (a row meets few windows), then the edits are
    applied in window order: ``edit(value, list of strengths)``.
    """
    from .joins import event_window_tag

    hits = event_window_tag(df.select(*row_key, place, ts), windows, place, ts)
    per_row = hits.groupBy(*row_key).agg(F.array_sort(F.collect_list(F.struct("window_id", strength))).alias("_s"))
    joined = df.join(per_row.withColumn("_s", F.transform("_s", lambda x: x[strength])), list(row_key), "left")
    hit = F.col("_s").isNotNull()
    if flags not in df.columns:
        joined = joined.withColumn(flags, F.lit(""))
    repeated = F.array_join(F.transform("_s", lambda _: F.lit(label)), ";")
    made = {c: F.when(hit, e(F.col(c), F.col("_s"))).otherwise(F.col(c)) for c, e in edits.items()}
    made[flags] = append_label(flags, repeated, hit)
    return joined.withColumns(made).drop("_s")


def inject_duplicates(df: DataFrame, key: str, ts: str, rate: float, flags: str = "anomaly_flags", seed: int = 42) -> DataFrame:
    """Copies with ``-DUP`` keys, a time shift below four minutes, a flag and a label, appended to the table."""
    base = df if flags in df.columns else df.withColumn(flags, F.lit(""))
    base = base.withColumn("is_duplicate", F.lit(False))
    copies = base.where(hash_uniform("duplicate", key, seed) < rate)
    shift = F.floor(hash_uniform("duplicate_shift", key, seed) * 239) + 1
    made = copies.withColumns({
        ts: add_seconds(ts, shift), flags: append_label(flags, "duplicate_order"), "is_duplicate": F.lit(True),
        key: F.concat(F.col(key).cast("string"), F.lit("-DUP")),
    })
    return base.withColumn(key, F.col(key).cast("string")).unionByName(made)


# ---------------------------------------------------------------- reports and detection


def anomaly_report(df: DataFrame, flags: str = "anomaly_flags") -> DataFrame:
    """Rows and rate per label."""
    total = df.agg(F.count(F.lit(1))).scalar()
    return df.select(F.explode(label_array(flags)).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("rows")).withColumn(
        "rate", F.col("rows") / total
    )


def detect_duplicates(df: DataFrame, keys: Sequence[str], order: Sequence, bucket: Column, ts: str, row_id: str, seconds: int = 240, block: int = 500_000):
    """Rows that repeat the previous row of the same keys within ``seconds``."""
    made = windowed(
        df, keys, order, bucket,
        lambda w: {"_prev_ts": F.lag(ts).over(w), "earlier_id": F.lag(row_id).over(w)}, lookback=1, block=block,
    )
    gap = F.timestamp_diff("SECOND", F.col("_prev_ts"), F.col(ts))
    return made.withColumn("gap_seconds", gap).where(F.col("gap_seconds") <= seconds).drop("_prev_ts")


def implied_speed(df: DataFrame, keys, order, bucket, ts: str, lat: str, lon: str, limit: float = 200.0, block: int = 500_000) -> DataFrame:
    """Distance, time and speed since the previous ping; ``is_jump`` marks impossible ones."""
    prev = lambda w: {"_lat": F.lag(lat).over(w), "_lon": F.lag(lon).over(w), "_t": F.lag(epoch_seconds(ts)).over(w)}
    made = windowed(df, keys, order, bucket, prev, lookback=1, block=block)
    km, secs = haversine_km("_lat", "_lon", lat, lon), epoch_seconds(ts) - F.col("_t")
    speed = F.col("leg_km") / (F.greatest(F.col("leg_seconds"), F.lit(1)) / 3600.0)
    return (
        made.withColumns({"leg_km": km, "leg_seconds": secs})
        .withColumns({"speed_kmh": F.when(F.col("leg_seconds").isNotNull(), speed)})
        .withColumn("is_jump", F.coalesce(F.col("speed_kmh") > limit, F.lit(False))).drop("_lat", "_lon", "_t")
    )


def rule_checks(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """One row per plausibility rule: rows violating it and their share. NULL never violates."""
    one = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(~c).alias(n) for n, c in rules.items()])
    long = one.unpivot(["_n"], list(rules), "rule", "violations")
    return long.select("rule", "violations", F.try_divide(F.col("violations"), F.col("_n")).alias("share"))


def fk_report(tables: Mapping[str, DataFrame], keys: Sequence[tuple[str, str, str, str]]) -> DataFrame:
    """Orphans per foreign key ``(child, column, parent, column)``."""
    parts = [
        anti_join_orphans(tables[c], fk, tables[p], pk).agg(F.count(F.lit(1)).alias("orphans")).select(
            F.lit(c).alias("child"), F.lit(fk).alias("column"), F.lit(p).alias("parent"), "orphans")
        for c, fk, p, pk in keys
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)
