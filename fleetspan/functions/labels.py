"""Semicolon-separated label lists: ``""`` is none, ``a;b`` is two labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import col


def append_label(flags: str | Column, label: str | Column, when: Column | None = None) -> Column:
    """Add a label without a leading separator; rows outside ``when`` keep their list."""
    current = F.coalesce(col(flags), F.lit(""))
    new = label if isinstance(label, Column) else F.lit(label)
    joined = F.when(current == "", new).otherwise(F.concat_ws(";", current, new))
    return joined if when is None else F.when(when, joined).otherwise(current)


def label_array(flags: str | Column) -> Column:
    """The labels as an array; empty for ``""`` and NULL."""
    return F.filter(F.split(F.coalesce(col(flags), F.lit("")), ";"), lambda x: x != "")


def first_label(flags: str | Column) -> Column:
    """First label, NULL when there is none."""
    return F.try_element_at(label_array(flags), F.lit(1))


def has_label(flags: str | Column, label: str) -> Column:
    """Whole-label membership (a substring test would also hit longer labels)."""
    return F.array_contains(label_array(flags), label)


def has_suffix(c: str | Column, suffix: str) -> Column:
    return col(c).endswith(suffix)
