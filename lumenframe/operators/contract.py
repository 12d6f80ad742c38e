"""Per-image result frames: column order, accessors and column typing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.functions.text import basename, capitalize_preserve
from lumenframe.operators.predicates import finite_or_null

LEADING = ("image_index", "image_path", "image_name")


def tier_a(df: DataFrame, metadata: list[str] | None = None, properties: list[str] | None = None, image_name: bool = False) -> DataFrame:
    """``image_index, image_path, [image_name]``, then sorted metadata, then the rest."""
    if image_name and "image_name" not in df.columns:
        df = df.withColumn("image_name", basename(F.col("image_path")))
    lead = [c for c in LEADING if c in df.columns]
    meta = sorted(metadata if metadata is not None else metadata_keys(df), key=str.lower)
    rest = properties if properties is not None else [c for c in df.columns if c not in lead and c not in meta]
    return df.select(*lead, *[m for m in meta if m not in lead], *[c for c in rest if c not in lead and c not in meta])


def is_tier_a(df: DataFrame) -> bool:
    return df.columns[:2] == ["image_index", "image_path"]


def metadata_keys(df: DataFrame) -> list[str]:
    """Non-numeric columns; first spelling wins."""
    return [f.name for f in df.schema if f.name not in LEADING and not isinstance(f.dataType, (T.NumericType, T.ArrayType))]


def property_keys(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if f.name not in LEADING and isinstance(f.dataType, T.NumericType)]


def append_properties(df: DataFrame, properties: DataFrame, key: str = "image_index") -> DataFrame:
    """Left join of property columns; missing ones are null."""
    return df.join(properties.select(key, *[c for c in properties.columns if c not in df.columns]), key, "left")


def capitalized(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*[F.col(c).alias(capitalize_preserve(c)) for c in cols])


def image_info(df: DataFrame, index: int) -> DataFrame:
    """The row of one image, NaN as null."""
    doubles = {f.name: F.when(~F.isnan(f.name), F.col(f.name)) for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.where(F.col("image_index") == index).limit(1).withColumns(doubles)


def first_store(df: DataFrame, name: str, stores: list[str]):
    """First non-missing value of several columns that hold the same key."""
    return F.coalesce(*[F.col(s) for s in stores]).alias(name)


def metadata_to_properties(df: DataFrame, cols: list[str]) -> DataFrame:
    """Metadata as property columns: numbers where the text is one, else null."""
    return df.withColumns({f"{c}_value": finite_or_null(F.col(c).cast("string").try_cast("double")) for c in cols})


def match_names(wanted: list[str], available: list[str]) -> list[str]:
    """Names in order of request, ignoring case, without duplicates; two spellings of one name are an error."""
    by: dict[str, str] = {}
    for a in available:
        if by.setdefault(a.lower(), a) != a:
            raise ValueError(f"columns {by[a.lower()]!r} and {a!r} differ only by case")
    out = []
    for w in wanted:
        if w.lower() not in by:
            raise KeyError(f"no column {w!r}")
        if by[w.lower()] not in out:
            out.append(by[w.lower()])
    return out


def column_profile(df: DataFrame, cols: list[str]) -> DataFrame:
    """``(column, n_distinct, n_rows, all_whole, kind, informative)``, from one aggregation.

    kind is discrete for text, booleans and the names cluster and class, and for whole numbers with at most 256 values;
    informative means two values or more, and not an id (over 90 % distinct with more than 10 rows).
    """
    kinds = {f.name: f.dataType for f in df.schema}
    aggs = [F.count("*").alias("n")]
    for i, c in enumerate(cols):
        num = isinstance(kinds[c], T.NumericType)
        aggs += [F.count_distinct(c).alias(f"d{i}"), (F.min(F.when(F.col(c).isNotNull(), F.col(c) == F.floor(c))) if num else F.lit(False)).alias(f"w{i}")]
    r = df.agg(*aggs).first()
    rows = []
    for i, c in enumerate(cols):
        d, whole = r[f"d{i}"], bool(r[f"w{i}"])
        num = isinstance(kinds[c], T.NumericType)
        kind = "discrete" if not num or c.lower() in ("cluster", "class") or whole and d <= 256 else "continuous"
        rows.append((c, d, r["n"], whole, kind, d >= 2 and not (kind == "discrete" and r["n"] > 10 and d > 0.9 * r["n"])))
    return df.sparkSession.createDataFrame(rows, "column string, n_distinct bigint, n_rows bigint, all_whole boolean, kind string, informative boolean")


def compact_types(df: DataFrame, cols: list[str]) -> DataFrame:
    """Doubles stored smaller: columns whose finite values are all whole become bigint, others float (NaN and infinities stay)."""
    whole = df.agg(*[F.min(F.when(F.col(c).isNotNull(), (F.col(c) == F.floor(c)) & (F.abs(c) < 2.0**53))).alias(c) for c in cols]).first()
    return df.withColumns({c: F.col(c).cast("bigint" if whole[c] else "float") for c in cols})
