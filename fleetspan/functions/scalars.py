"""Null-aware arithmetic, ladders and lookups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip(c: str | Column, lo=None, hi=None) -> Column:
    """Two-sided clip that leaves NULL as NULL (``greatest``/``least`` alone would skip it)."""
    x = out = col(c)
    if lo is not None:
        out = F.greatest(out, F.lit(lo) if not isinstance(lo, Column) else lo)
    if hi is not None:
        out = F.least(out, F.lit(hi) if not isinstance(hi, Column) else hi)
    return F.when(x.isNotNull(), out)


def safe_ratio(num: str | Column, den: str | Column, floor: float) -> Column:
    """``num / den`` with the denominator clipped from below, the guard against division by zero."""
    return col(num) / clip(den, lo=floor)


def case_ladder(conditions: Sequence[Column], values: Sequence, default=None) -> Column:
    """First matching condition wins."""
    ladder = F
    for cond, value in zip(conditions, values, strict=True):
        ladder = ladder.when(cond, value if isinstance(value, Column) else F.lit(value))
    return ladder.otherwise(default if isinstance(default, Column) else F.lit(default))


def bucket_labels(edges: Sequence[float], unit: str = "") -> list[str]:
    """``<5km``, ``5-15km``, ``>15km`` for edges 5, 15."""
    inner = [f"{a}-{b}{unit}" for a, b in zip(edges, edges[1:])]
    return [f"<{edges[0]}{unit}", *inner, f">{edges[-1]}{unit}"]


def bucketize(c: str | Column, edges: Sequence[float], labels: Sequence[str] | None = None, unit: str = "") -> Column:
    """Right-closed bins: a value on an edge belongs to the bin that ends there."""
    labels = list(labels) if labels is not None else bucket_labels(edges, unit)
    x = col(c)
    ladder = F
    for edge, label in zip(edges, labels):
        ladder = ladder.when(x <= edge, F.lit(label))
    return ladder.when(x.isNotNull(), F.lit(labels[-1]))


def map_lookup(c: str | Column, table: Mapping, default=None) -> Column:
    """Constant dictionary as a map literal; a missing key gives ``default``."""
    literal = F.create_map(*[F.lit(v) for v in chain.from_iterable(table.items())])
    found = F.try_element_at(literal, col(c))
    return found if default is None else F.coalesce(found, F.lit(default))


def isin_flag(c: str | Column, values: Sequence) -> Column:
    """Membership that is false, not NULL, for a missing value."""
    return F.coalesce(col(c).isin(list(values)), F.lit(False))


def between_flag(c: str | Column, lo, hi) -> Column:
    return F.coalesce(col(c).between(lo, hi), F.lit(False))


def composite_score(terms: Sequence[tuple[float, str | Column, float | None]]) -> Column:
    """Weighted sum of ``(weight, term, fill)``; ``fill`` replaces a missing term."""
    parts = [
        (F.coalesce(col(c).cast("double"), F.lit(float(fill))) if fill is not None else col(c).cast("double")) * w
        for w, c, fill in terms
    ]
    return reduce(lambda a, b: a + b, parts)


def replace_nonfinite(c: str | Column, value: float = 0.0) -> Column:
    """NaN, infinities and NULL all become ``value``."""
    x = col(c)
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(bad, F.lit(value)).otherwise(x)


def tidy_double(c: str | Column) -> Column:
    """NaN to NULL and -0.0 to 0.0, so that grouping and sorting treat equal values as equal."""
    x = col(c)
    return F.when(~F.isnan(x), x + F.lit(0.0))


def _fixed_point_sum(c: str | Column, scale: int) -> Column:
    """Exact sum of values rounded to ``scale`` places, as a decimal of the scaled units.

    Scaled values are whole numbers, added in two halves of 64-bit integers: as fast as adding doubles,
    and neither half can overflow below 10^12 rows.
    """
    units = F.rint(col(c).cast("double") * F.lit(float(10**scale))).cast("long")
    high, low = F.sum(F.shiftright(units, 20)), F.sum(units.bitwiseAND(F.lit((1 << 20) - 1)))
    return high.cast("decimal(38,0)") * F.lit(1 << 20) + low


def exact_sum(c: str | Column, scale: int = 4) -> Column:
    """Sum that does not depend on how rows were partitioned or retried; 0 for an empty group."""
    return F.coalesce(_fixed_point_sum(c, scale).cast("double") / F.lit(float(10**scale)), F.lit(0.0))


def exact_avg(c: str | Column, scale: int = 4) -> Column:
    """Mean of the non-null values built from the exact sum; NULL for an empty group."""
    n = F.count(col(c))
    return F.when(n > 0, _fixed_point_sum(c, scale).cast("double") / F.lit(float(10**scale)) / n)


def rate(c: str | Column) -> Column:
    """Share of rows where a flag holds, NULL flags skipped."""
    return F.avg(col(c).cast("int"))


def pairwise_interactions(names: Sequence[str]) -> list[Column]:
    """All products of two different columns, named ``a__x__b``."""
    return [
        (F.col(a) * F.col(b)).alias(f"{a}__x__{b}")
        for i, a in enumerate(names)
        for b in names[i + 1:]
    ]


def make_sequences(c: str | Column, steps: int, width: int) -> Column:
    """A flat array zero-padded to ``steps * width`` and cut into ``steps`` rows of ``width``."""
    flat = col(c)
    padded = F.slice(
        F.concat(flat, F.array_repeat(F.lit(0.0).cast("double"), steps * width)), 1, steps * width
    )
    return F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: F.slice(padded, i * width + 1, width))


def zero_pad_id(prefix: str, c: str | Column, width: int = 9) -> Column:
    """``ORD-000000001``."""
    return F.concat(F.lit(f"{prefix}-"), F.lpad(col(c).cast("string"), width, "0"))


def title_case(c: str | Column) -> Column:
    return F.initcap(F.regexp_replace(col(c), "_", " "))


def slug(c: str | Column) -> Column:
    """Lower-case, runs of anything but letters and digits become one underscore."""
    return F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", "_")


def json_field(c: str | Column, path: str) -> Column:
    return F.get_json_object(col(c), path)
