"""Cleaning a feature table: indicators, imputation, clipping, encoding, constants, and replay on new rows.

A fit brings one small row of statistics to the driver (fills, bounds, short level lists); applying it is a
plain projection. The levels of wide columns stay a table in the shared folder and are joined.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, StringIndexer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clip
from ..session import shared_folder
from .aggregates import distinct_counts
from .ordered import numbered, text_ranges
from .profile import column_roles, top_values
from .quantiles import column_quantiles

INLINE_LEVELS = 100  # longer level lists are joined as a table; the codes are the same


def missing_indicators(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``col__was_missing`` for columns that have some, but not only, missing cells."""
    row = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).first()
    some = [c for c in columns if 0 < row[c] < row["_n"]]
    return df.withColumns({f"{c}__was_missing": F.col(c).isNull().cast("tinyint") for c in some})


def fit_fills(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], num="median", cat="mode") -> dict[str, object]:
    """Fill values: median, mean or zero for numbers; smallest mode or ``unknown`` for text."""
    fills: dict[str, object] = {}
    if numeric and num == "median":
        fills |= {r["column"]: r["m"] for r in column_quantiles(df, numeric, {"m": 0.5}).collect()}
    elif numeric and num == "mean":
        fills |= df.agg(*[F.avg(c).alias(c) for c in numeric]).first().asDict()
    if num != "none":
        fills = {c: float(fills.get(c) or 0.0) for c in numeric}
    if categorical and cat == "mode":
        modes = {r["column"]: r["value"] for r in top_values(df, categorical, 1).collect()}
        fills |= {c: modes.get(c, "unknown") for c in categorical}
    elif cat != "none":
        fills |= {c: "unknown" for c in categorical}
    return fills


def impute(df: DataFrame, fills: Mapping[str, object]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in fills.items() if c in df.columns})


def fit_bounds(df: DataFrame, columns: Sequence[str], q: float, min_rows: int = 10) -> dict[str, tuple[float, float]]:
    """Two-sided quantile bounds; columns with fewer than ``min_rows`` values are left alone."""
    if not columns:
        return {}
    n = df.agg(*[F.count(c).alias(c) for c in columns]).first()
    rows = column_quantiles(df, columns, {"lo": q, "hi": 1 - q}).collect()
    return {r["column"]: (r["lo"], r["hi"]) for r in rows if n[r["column"]] >= min_rows}


def clip_quantiles(df: DataFrame, bounds: Mapping[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: clip(F.col(c).cast("double"), lo, hi) for c, (lo, hi) in bounds.items() if c in df.columns})


def level_codes(df: DataFrame, c: str) -> DataFrame:
    """Alphabetic codes 0..k-1 of a column's levels as a table, for any number of levels.

    Levels are numbered in ranges cut by the levels themselves, so a common prefix puts no load on one task.
    """
    levels = df.where(F.col(c).isNotNull()).select(F.col(c).cast("string").alias("level")).distinct()
    ranged, bucket = text_ranges(levels, "level")
    return numbered(ranged, [], ["level"], bucket, pos="code").select("level", "code")


def fit_levels(df: DataFrame, columns: Sequence[str]) -> dict[str, list[str] | dict[str, str]]:
    """Sorted levels of each column with any value, whatever their number.

    Up to ``INLINE_LEVELS`` of them are a list. More are a (level, code) table in the shared folder, for which
    ``{"table": path}`` stands, so the record stays small enough to be saved as text.
    """
    sizes = {r["column"]: r["n_unique"] for r in distinct_counts(df, columns).collect()}
    few = [c for c in columns if sizes.get(c, 0) <= INLINE_LEVELS]
    levels: dict[str, list[str] | dict[str, str]] = {}
    if few:
        text = df.select(*[F.col(c).cast("string").alias(c) for c in few]).unpivot([], few, "column", "value")
        rows = text.where(F.col("value").isNotNull()).distinct().groupBy("column").agg(F.sort_array(F.collect_list("value")).alias("v")).collect()
        levels |= {r["column"]: list(r["v"]) for r in rows}
    for c in columns:
        if c not in few:
            path = shared_folder(df.sparkSession, "levels")
            level_codes(df, c).write.parquet(path)
            levels[c] = {"table": path}
    return levels


def ordinal_encode(df: DataFrame, levels: Mapping[str, Sequence[str] | Mapping[str, str]], unknown: int = -1) -> DataFrame:
    """Alphabetic codes; a level not seen in the fit, and NULL, get ``unknown``."""
    made = {}
    for c, values in levels.items():
        if c not in df.columns:
            continue
        if isinstance(values, Mapping):
            codes = df.sparkSession.read.parquet(values["table"]).select(F.col("level").alias("_level"), F.col("code").alias(f"_code_{c}"))
            df = df.join(codes, F.col(c).cast("string") == F.col("_level"), "left").drop("_level")
            made[c] = F.coalesce(F.col(f"_code_{c}"), F.lit(unknown)).cast("int")
        else:
            at = F.array_position(F.array(*[F.lit(v) for v in values]), F.col(c).cast("string"))
            made[c] = F.when(at > 0, at - 1).otherwise(F.lit(unknown)).cast("int")
    return df.withColumns(made).drop(*[f"_code_{c}" for c in made])


def onehot_encode(df: DataFrame, levels: Mapping[str, Sequence[str] | Mapping[str, str]], max_card: int = 25) -> DataFrame:
    """0/1 columns ``col_level`` for columns of up to ``max_card`` levels; the source column is dropped.

    Wider columns get ordinal codes instead, so no text is left.
    """
    low = {c: v for c, v in levels.items() if c in df.columns and not isinstance(v, Mapping) and len(v) <= max_card}
    made = {f"{c}_{v}": F.coalesce((F.col(c).cast("string") == v).cast("tinyint"), F.lit(0).cast("tinyint")) for c, vs in low.items() for v in vs}
    return ordinal_encode(df.withColumns(made).drop(*low), {c: v for c, v in levels.items() if c not in low})


def constant_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns with at most one distinct value, NULL counted as a value."""
    row = df.agg(*[
        F.struct(F.min(c).eqNullSafe(F.max(c)).alias("same"), F.count_if(F.col(c).isNull()).alias("miss"), F.count(F.lit(1)).alias("n")).alias(c)
        for c in columns
    ]).first()
    return [c for c in columns if row[c]["n"] == 0 or (row[c]["same"] and row[c]["miss"] in (0, row[c]["n"]))]


def drop_constants(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    cols = [c for c in df.columns if c not in keep]
    return df.drop(*constant_columns(df, cols))


def clean_table(df: DataFrame, leakage: Sequence[str], clip_q: float | None = 0.01, encoding: str = "ordinal"):
    """The whole cleaning sequence; returns the table and the record of every decision.

    The input is persisted because every fitting step reads it.
    """
    df = df.persist()
    meta: dict[str, object] = {"dropped_leakage_columns": [c for c in leakage if c in df.columns]}
    out = df.drop(*leakage)
    fixed = [c for c in out.columns if c.startswith("target_") or c.endswith("_id")]
    free = [c for c in out.columns if c not in fixed]
    out = missing_indicators(out, free)
    meta["missing_indicators"] = [c for c in out.columns if c.endswith("__was_missing")]
    roles = column_roles(out.select(*free))
    meta["imputation_values"] = fit_fills(out, roles["numeric"], [c for c in roles["other"] if c in free])
    out = impute(out, meta["imputation_values"])
    if clip_q:
        meta["clip_bounds"] = fit_bounds(out, roles["numeric"], clip_q)
        out = clip_quantiles(out, meta["clip_bounds"])
    if encoding != "none" and roles["other"]:
        meta["levels"] = fit_levels(out, roles["other"])
        out = ordinal_encode(out, meta["levels"]) if encoding == "ordinal" else onehot_encode(out, meta["levels"])
    meta["encoding"] = encoding
    meta["dropped_constant_columns"] = constant_columns(out, [c for c in out.columns if not c.startswith("target_")])
    return out.drop(*meta["dropped_constant_columns"]), meta


def replay(df: DataFrame, meta: Mapping[str, object]) -> DataFrame:
    """Apply recorded cleaning decisions to new rows."""
    out = df.drop(*meta["dropped_leakage_columns"])
    flags = {c: F.col(c.removesuffix("__was_missing")).isNull().cast("tinyint") for c in meta["missing_indicators"]}
    out = impute(out.withColumns(flags), meta["imputation_values"])
    out = clip_quantiles(out, meta.get("clip_bounds") or {})
    if meta.get("levels"):
        out = ordinal_encode(out, meta["levels"]) if meta["encoding"] == "ordinal" else onehot_encode(out, meta["levels"])
    return out.drop(*meta["dropped_constant_columns"])


def save_meta(meta: Mapping[str, object]) -> str:
    return json.dumps(meta, indent=2, sort_keys=True)


def load_meta(text: str) -> dict[str, object]:
    return json.loads(text)


def ml_encoders(categorical: Sequence[str], onehot: bool = False) -> Pipeline:
    """The MLlib form of the encoders, for pipelines that are saved and loaded whole."""
    idx = StringIndexer(inputCols=list(categorical), outputCols=[f"{c}_ix" for c in categorical], stringOrderType="alphabetAsc", handleInvalid="keep")
    stages = [idx]
    if onehot:
        stages.append(OneHotEncoder(inputCols=idx.getOutputCols(), outputCols=[f"{c}_oh" for c in categorical], handleInvalid="keep", dropLast=False))
    return Pipeline(stages=stages)
