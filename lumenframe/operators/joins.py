"""Alignment of catalogs with stored results: resume, path matching, merging and appending."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenframe.functions.text import posix


def keep_first(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per key, the first by ``order``; rows with a null key are kept."""
    w = Window.partitionBy(key).orderBy(*order)
    named = df.where(F.col(key).isNotNull()).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    return named.unionByName(df.where(F.col(key).isNull()))


def require_unique(df: DataFrame, key: str) -> DataFrame:
    twice = df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").limit(5).collect()
    if twice:
        raise ValueError(f"{key} repeats: " + ", ".join(str(r[0]) for r in twice))
    return df


def align_by_index(left: DataFrame, right: DataFrame, key: str = "image_index") -> DataFrame:
    """Inner join on unique indices; an index of ``left`` that ``right`` lacks is an error."""
    require_unique(left, key)
    require_unique(right, key)
    lost = left.join(right, key, "left_anti").limit(5).select(key).collect()
    if lost:
        raise KeyError("no row for " + ", ".join(str(r[0]) for r in lost))
    return left.join(right, key)


def rows_align(left: DataFrame, right: DataFrame, key: str = "image_index", path: str = "image_path") -> bool:
    """Whether two tables have the same keys, each once, and files of the same name under them (case and folders aside)."""
    name = lambda c: F.lower(F.element_at(F.split(posix(F.col(c)), "/"), -1))
    a = left.groupBy(key).agg(F.count("*").alias("_n"), F.min(name(path)).alias("_a"))
    b = right.groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("_m"), F.min(name(path)).alias("_b"))
    off = a.join(b, F.col(key) == F.col("_k"), "full_outer").where(~(F.col("_n").eqNullSafe(F.lit(1)) & F.col("_m").eqNullSafe(F.lit(1)) & F.col("_a").eqNullSafe(F.col("_b"))))
    return off.isEmpty()


def not_done(catalog: DataFrame, done: DataFrame, key: str, require_overlap: bool = False) -> DataFrame:
    """Rows of the catalog whose key is not stored yet; null keys count as not stored."""
    if require_overlap and not done.isEmpty() and catalog.join(done, key, "left_semi").isEmpty():
        raise ValueError("the stored results and the catalog share no record")
    return catalog.join(done.select(key).distinct(), key, "left_anti")


def path_suffixes(path: Column) -> Column:
    """All trailing parts of a path, the longest first: a/b/c, b/c, c."""
    parts = F.split(F.lower(posix(path)), "/+")
    parts = F.filter(parts, lambda p: p != "")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def portable_path_join(left: DataFrame, right: DataFrame, left_path: str, right_path: str, left_id: str, right_id: str) -> DataFrame:
    """``(left_id, right_id, matched)``: rows whose paths share a suffix that is unique on both sides; longest suffix wins.

    Paths have few parts, so a row spreads to a handful of keys; keys that are not unique are dropped on their own side
    before the join, so the join is one to one.
    """

    def keys(df: DataFrame, idc: str, path: str, name: str) -> DataFrame:
        k = df.where(F.col(path).isNotNull()).select(F.col(idc).alias(name), F.explode(path_suffixes(F.col(path))).alias("key"))
        return k.groupBy("key").agg(F.count("*").alias("n"), F.min(name).alias(name)).where("n = 1").drop("n")

    j = keys(left, left_id, left_path, "l").join(keys(right, right_id, right_path, "r"), "key")
    w = Window.partitionBy("l").orderBy(F.desc(F.length("key")), "key")
    return j.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(F.col("l").alias(left_id), F.col("r").alias(right_id), F.col("key").alias("matched"))


def enrich_metadata(stored: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """Metadata of the current run overwrites the stored one wherever the record is known to it, also with null."""
    cur = current.select(F.col(key).alias("_k"), F.lit(True).alias("_on"), *[F.col(c).alias(f"_c_{c}") for c in current.columns if c != key])
    j = stored.join(cur, stored[key] == cur["_k"], "left")
    new = [c for c in current.columns if c != key and c not in stored.columns]
    cols = [F.when(F.col("_on"), F.col(f"_c_{c}")).otherwise(F.col(c)).alias(c) if c in current.columns and c != key else F.col(c) for c in stored.columns]
    return j.select(*cols, *[F.col(f"_c_{c}").alias(c) for c in new])


def merge_properties(old: DataFrame, new: DataFrame, key: str = "image_index") -> DataFrame:
    """Recomputed values, else the old ones; rows and columns of either side."""
    cols = list(dict.fromkeys([*[c for c in old.columns if c != key], *[c for c in new.columns if c != key]]))
    o = old.select(F.col(key).alias("_o"), *[F.col(c).alias(f"_o_{c}") for c in old.columns if c != key])
    n = new.select(F.col(key).alias("_n"), *[F.col(c).alias(f"_n_{c}") for c in new.columns if c != key])

    def val(df: DataFrame, c: str, p: str) -> Column:
        x = F.col(f"{p}{c}")
        return F.when(~F.isnan(x), x) if df.schema[c].dataType.simpleString() in ("double", "float") else x

    j = o.join(n, F.col("_o") == F.col("_n"), "full_outer")
    pick = lambda c: F.coalesce(*([val(new, c, "_n_")] if c in new.columns else []), *([val(old, c, "_o_")] if c in old.columns else [])).alias(c)
    return j.select(F.coalesce("_n", "_o").alias(key), *[pick(c) for c in cols])


def unprocessed(props: DataFrame, cols: list[str], attempted: str = "attempted") -> DataFrame:
    """Rows never attempted: no flag and no value."""
    flag = F.col(attempted).isNull() if attempted in props.columns else F.lit(True)
    return props.where(flag & reduce(lambda a, b: a & b, [F.col(c).isNull() for c in cols]))


def append_new(catalog: DataFrame, cohort: DataFrame, path: str = "image_path") -> tuple[DataFrame, DataFrame]:
    """(catalog with the new rows, the new rows): those whose path the catalog lacks, first of equal paths."""
    new = cohort.join(catalog.select(path), path, "left_anti")
    new = keep_first(new, path, [c for c in ("image_index", path) if c in cohort.columns])
    return catalog.unionByName(new, allowMissingColumns=True), new


def replace_catalog(catalog: DataFrame, cohort: DataFrame, properties: list[str], path: str = "image_path") -> DataFrame:
    """The cohort, with the properties its paths had in the catalog."""
    have = keep_first(catalog.select(path, *properties), path, [path])
    return cohort.drop(*properties).join(have, path, "left")


def overlay_by_path(images: DataFrame, prior: DataFrame, properties: list[str], path: str = "image_path") -> DataFrame:
    """Images with the properties that an earlier table has under their path, in place of their own; others keep theirs.

    Of several earlier rows of a path the first by its properties counts; rows without any property don't.
    """
    have = keep_first(prior.where(reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in properties])), path, properties)
    have = have.where(F.col(path).isNotNull()).select(F.col(path).alias("_p"), F.lit(True).alias("_on"), *[F.col(c).alias(f"_was_{c}") for c in properties])
    j = images.join(have, images[path] == have["_p"], "left")
    own = lambda c: F.col(c) if c in images.columns else F.lit(None)
    return j.withColumns({c: F.when(F.col("_on"), F.col(f"_was_{c}")).otherwise(own(c)) for c in properties}).drop("_p", "_on", *[f"_was_{c}" for c in properties])


def append_temporal(catalog: DataFrame, new: DataFrame, metadata: list[str], vec: str = "embedding") -> DataFrame:
    """Session rows: text metadata they lack is ``Temporal``, source is ``NEW``, other columns null; equal vector length."""
    dims = [x.select(F.size(vec)).where(F.col(vec).isNotNull()).limit(1).collect() for x in (catalog, new)]
    if dims[0] and dims[1] and dims[0][0][0] != dims[1][0][0]:
        raise ValueError(f"vectors of length {dims[1][0][0]} do not fit {dims[0][0][0]}")
    rows = new.withColumns({m: F.lit("Temporal") for m in metadata if m not in new.columns and catalog.schema[m].dataType.simpleString() == "string"}).withColumn("source", F.lit("NEW"))
    return catalog.unionByName(rows, allowMissingColumns=True)


def update_vectors(stored: DataFrame, changed: DataFrame, key: str = "image_index", vec: str = "embedding") -> DataFrame:
    """Stored rows with the vectors of ``changed`` where given."""
    c = changed.select(F.col(key).alias("_k"), F.col(vec).alias("_v"))
    return stored.join(c, stored[key] == c["_k"], "left").select(*[F.coalesce("_v", vec).alias(vec) if x == vec else F.col(x) for x in stored.columns])


def ordered_selection(rows: DataFrame, picks: list[int], key: str = "image_index") -> DataFrame:
    """Rows in the order of a selection (its ordinal is a column); repeated picks repeat."""
    sel = rows.sparkSession.createDataFrame([(i, int(p)) for i, p in enumerate(picks)], f"ordinal int, {key} bigint")
    return sel.join(rows, key).orderBy("ordinal")
