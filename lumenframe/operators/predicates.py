"""Metadata predicates."""

from __future__ import annotations

import warnings
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _find(df: DataFrame, key: str) -> str | None:
    return next((c for c in df.columns if c.lower() == key.lower()), None)


def _comparable(kind: T.DataType, value: Any) -> bool:
    """Python equality does not coerce text and numbers; booleans count as numbers."""
    if isinstance(kind, T.StringType):
        return isinstance(value, str)
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return isinstance(value, (int, float))
    return True


def _equals(df: DataFrame, col: str, values: list) -> Column:
    kind, c = df.schema[col].dataType, F.col(f"`{col}`")
    fit = [v for v in values if v is not None and _comparable(kind, v)]
    if isinstance(kind, T.BooleanType):
        fit = [bool(v) for v in fit if v in (0, 1)]
    tests = ([c.isin(*fit)] if fit else []) + ([c.isNull()] if any(v is None for v in values) else [])
    return F.coalesce(reduce(lambda a, b: a | b, tests), F.lit(False)) if tests else F.lit(False)


def _listed(v: Any) -> list:
    return list(v) if isinstance(v, (list, tuple, set, frozenset)) else [v]


def metadata_filter(df: DataFrame, filters: dict | None = None, exclude: dict | None = None) -> DataFrame:
    """Rows that match every key of ``filters`` (a list is any-of), without those that match any key of ``exclude``.

    Keys ignore case. A criterion None is skipped; None inside a list matches nulls. An unknown filter key warns and
    matches nothing, an unknown exclude key warns and excludes nothing.
    """
    keep = F.lit(True)
    for k, v in (filters or {}).items():
        if v is None:
            continue
        col = _find(df, k)
        if col is None:
            warnings.warn(f"unknown filter key {k!r}: nothing matches", stacklevel=2)
            keep = F.lit(False)
        else:
            keep = keep & _equals(df, col, _listed(v))
    return df.where(keep & ~_excluded(df, exclude))


def file_table_filter(df: DataFrame, filters: dict | None = None, exclude: dict | None = None) -> DataFrame:
    """As :func:`metadata_filter`, but unknown keys are ignored and a scalar None matches nothing."""
    keep = F.lit(True)
    for k, v in (filters or {}).items():
        col = _find(df, k)
        if col is not None:
            keep = keep & (F.lit(False) if v is None else _equals(df, col, [x for x in _listed(v) if x is not None]))
    return df.where(keep & ~_excluded(df, exclude, quiet=True))


def _excluded(df: DataFrame, exclude: dict | None, quiet: bool = False) -> Column:
    out = F.lit(False)
    for k, v in (exclude or {}).items():
        col = _find(df, k)
        if col is None:
            if not quiet:
                warnings.warn(f"unknown exclude key {k!r}: nothing is excluded", stacklevel=3)
        elif v is not None:
            out = out | _equals(df, col, _listed(v))
    return out


def numeric_range(c: Column, lo: float | None, hi: float | None) -> Column:
    """Inclusive range; what is no number does not match."""
    x = c.cast("string").try_cast("double")
    x = F.when(~F.isnan(x), x)
    test = F.lit(True)
    if lo is not None:
        test = test & (x >= lo)
    if hi is not None:
        test = test & (x <= hi)
    return F.coalesce(test & x.isNotNull(), F.lit(False))


def text_in(c: Column, values: list) -> Column:
    """Membership by text form."""
    return F.coalesce(c.cast("string").isin(*[str(v) for v in values]), F.lit(False))


def finite(c: Column) -> Column:
    x = c.cast("double")
    return F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))


def finite_or_null(c: Column) -> Column:
    return F.when(finite(c), c.cast("double"))


def finite_rows(df: DataFrame, cols: list[str], pairwise: bool = False, min_rows: int = 3) -> DataFrame:
    """Rows whose ``cols`` are all finite (listwise), or non-finite cells set to null (pairwise); no rows if too few are left."""
    if pairwise:
        return df.withColumns({c: finite_or_null(F.col(c)) for c in cols})
    out = df.where(reduce(lambda a, b: a & b, [finite(F.col(c)) for c in cols]))
    return out if out.limit(min_rows).count() >= min_rows else out.limit(0)


def informative_properties(df: DataFrame, cols: list[str], min_finite: int = 3) -> list[str]:
    """Columns with at least ``min_finite`` finite values that are not all equal; one aggregation for all."""
    if not cols:
        return []
    aggs = [f(finite_or_null(F.col(c))).alias(f"{n}{i}") for i, c in enumerate(cols) for n, f in (("n", F.count), ("lo", F.min), ("hi", F.max))]
    r = df.agg(*aggs).first()
    return [c for i, c in enumerate(cols) if r[f"n{i}"] >= min_finite and r[f"hi{i}"] > r[f"lo{i}"]]


def drop_temporal(df: DataFrame) -> DataFrame:
    """Without rows appended for the session."""
    return df.where(~F.col("source").eqNullSafe("NEW"))
