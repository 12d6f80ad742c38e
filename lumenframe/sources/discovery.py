"""Finding files and building the image catalog."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lumenframe.functions.text import basename, identifier_keys, path_to_id, posix, strip_full_extension, template_columns
from lumenframe.operators.blocks import numbered

# fixed values: extensions that are read as images
IMAGE_EXTENSIONS = ("png", "jpg", "jpeg", "bmp", "tif", "tiff", "npy", "npz", "nii", "nii.gz")


def scan(spark: SparkSession, path: str, extensions: list[str] | None = None) -> DataFrame:
    """``(file_path, size, modified)`` of files below a folder, or matching a glob; extensions ignore case.

    Contents are never read: only the listing columns of the file source are selected.
    """
    ext = "|".join(re.escape(e.lstrip(".").lower()) for e in (extensions or IMAGE_EXTENSIONS))
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true" if not re.search(r"[*?]", path) else "false")
    f = r.load(path).select(F.regexp_replace("path", "^file:(//)?", "").alias("file_path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    return f.where(F.lower("file_path").rlike(rf"\.({ext})$"))


def index_by_path(files: DataFrame, path: str = "image_path", ties: list[str] | None = None) -> DataFrame:
    """Adds ``image_index`` 0..n-1 in the order of the path; equal paths by ``ties`` (by default all other plain columns).

    No task sorts more than a range of the paths (see :func:`numbered`); a path that many rows share is split by the ties.
    """
    if ties is None:
        ties = [f.name for f in files.schema if f.name != path and not f.dataType.simpleString().startswith(("map", "struct", "array", "variant"))]
    return numbered(files, [path, *ties], "image_index")


def default_metadata(files: DataFrame, path: str = "file_path") -> DataFrame:
    return files.withColumn("filename", strip_full_extension(basename(F.col(path)))).withColumn("id", path_to_id(F.col(path)))


def template_metadata(files: DataFrame, template: str, path: str = "file_path", on_missing: str = "drop") -> DataFrame:
    """Columns of a path template; rows that do not match are dropped or kept with nulls."""
    cols = template_columns(F.col(path), template)
    out = files.withColumns(cols)
    if on_missing == "drop":
        return out.where(F.col(next(iter(cols))).isNotNull())
    if on_missing != "keep":
        raise ValueError(f"on_missing must be 'drop' or 'keep', not {on_missing!r}")
    return out


def callable_metadata(files: DataFrame, fn, names: list[str], path: str = "file_path", on_missing: str = "drop") -> DataFrame:
    """Columns ``names`` (texts) from a function of a path that returns a dict, called in the tasks.

    None, or a ValueError, KeyError or FileNotFoundError, means that a file has no metadata: its row is dropped, or kept
    with nulls. Any other error ends the job.
    """
    if on_missing not in ("drop", "keep"):
        raise ValueError(f"on_missing must be 'drop' or 'keep', not {on_missing!r}")
    schema = T.StructType([*files.schema.fields, *[T.StructField(n, T.StringType()) for n in names]])

    def run(batches):
        for pdf in batches:
            rows, keep = [], []
            for p in pdf[path].tolist():
                try:
                    got = fn(p)
                except (ValueError, KeyError, FileNotFoundError):
                    got = None
                keep.append(got is not None or on_missing == "keep")
                rows.append({n: None if (got or {}).get(n) is None else str(got[n]) for n in names})
            out = pdf.assign(**{n: [r[n] for r in rows] for n in names})
            yield out[pd.Series(keep, index=out.index, dtype=bool)]

    return files.mapInPandas(run, schema)


def lookup_metadata(files: DataFrame, lookup: DataFrame, filename: str | list[str], path: str = "file_path", on_missing: str = "drop") -> DataFrame:
    """Metadata from a table by file name: path, basename, each with and without extension; the most specific match wins.

    With several filename columns each is a channel and ``channel_index`` is added. A name that occurs twice in the table
    is an error. Two rows of different names may share a short key: that key then matches nothing.
    """
    cols = [filename] if isinstance(filename, str) else list(filename)
    rows = lookup.withColumn("_row", F.monotonically_increasing_id()) if len(cols) else lookup
    named = rows.select(*[c for c in lookup.columns if c not in cols], F.posexplode(F.array(*[F.col(c).cast("string") for c in cols])).alias("channel_index", "_name")).where(F.trim("_name") != "")
    twice = named.groupBy(F.lower("_name").alias("k")).agg(F.count("*").alias("n")).where("n > 1").limit(3).collect()
    if twice:
        raise ValueError("file names repeat in the lookup table: " + ", ".join(r[0] for r in twice))
    keyed = named.withColumn("_key", F.explode(identifier_keys(F.col("_name"))))
    once = keyed.groupBy("_key").agg(F.count_distinct("_name").alias("_n")).where("_n = 1").select("_key")
    keyed = keyed.join(once, "_key")
    f = files.select(path, F.posexplode(identifier_keys(F.col(path))).alias("_rank", "_key"))
    hit = f.join(keyed, "_key")
    w = Window.partitionBy(path).orderBy("_rank", "_name")
    best = hit.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_rank", "_key", "_name")
    if len(cols) == 1:
        best = best.drop("channel_index")
    return files.join(best, path, "inner" if on_missing == "drop" else "left")


def merge_channels(files: DataFrame, keys: list[str], path: str = "file_path", channel: str = "channel_index") -> DataFrame:
    """One row per group with ``channel_paths`` in channel order and ``image_path`` the first.

    The indices of a group must be exactly 0..n-1, each once; a group that breaks this raises when it is computed.
    """
    g = files.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(channel).cast("int").alias("i"), F.col(path).alias("p")))).alias("_x"))
    idx = F.transform("_x", lambda s: s["i"])
    right = F.coalesce(idx == F.sequence(F.lit(0), F.size("_x") - 1), F.lit(False))
    paths = F.when(right, F.transform("_x", lambda s: s["p"])).otherwise(F.raise_error(F.concat(F.lit("channels are not 0..n-1: "), F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}))).cast("array<string>"))
    return g.withColumn("channel_paths", paths).withColumn("image_path", F.element_at("channel_paths", 1)).drop("_x")


def require_unique_ids(catalog: DataFrame, key: str = "id") -> DataFrame:
    twice = catalog.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where("n > 1").orderBy(key).limit(5).collect()
    if twice:
        raise ValueError("ids repeat: " + ", ".join(str(r[0]) for r in twice))
    return catalog


def resolve_masks(catalog: DataFrame, masks: DataFrame, path: str = "image_path", root: str = "", mask_root: str = "", column: str | None = None) -> DataFrame:
    """Adds ``mask_path``: an existing one, else a named column, else the same relative path (any extension) under the mask
    folder, else an unambiguous base name. A key that several masks share matches nothing."""
    rel = lambda c, r: F.lower(strip_full_extension(F.regexp_replace(posix(c), "^" + re.escape(r.rstrip("/")) + "/", "")))

    def unique(c: Column, name: str) -> DataFrame:
        return masks.select(c.alias(name), F.col("file_path")).groupBy(name).agg(F.count("*").alias("_n"), F.min("file_path").alias(f"_{name}")).where("_n = 1").drop("_n")

    m = catalog.withColumn("k_rel", rel(F.col(path), root)).withColumn("k_base", F.lower(strip_full_extension(basename(F.col(path)))))
    m = m.join(unique(rel(F.col("file_path"), mask_root), "k_rel"), "k_rel", "left").join(unique(F.lower(strip_full_extension(basename(F.col("file_path")))), "k_base"), "k_base", "left")
    first = ([F.col("mask_path")] if "mask_path" in catalog.columns else []) + ([F.nullif(F.trim(F.col(column)), F.lit(""))] if column else [])
    return m.withColumn("mask_path", F.coalesce(*first, "_k_rel", "_k_base")).drop("k_rel", "k_base", "_k_rel", "_k_base")


def resolve_paths(wanted: DataFrame, files: DataFrame, path: str = "image_path") -> DataFrame:
    """Left join of the file table on the normalised path."""
    f = files.select(F.lower(posix(F.col("file_path"))).alias("_k"), *[c for c in files.columns if c not in wanted.columns])
    return wanted.join(f, F.lower(posix(F.col(path))) == F.col("_k"), "left").drop("_k")


def common_root(df: DataFrame, path: str) -> str:
    """The longest folder that all paths lie below; what the smallest and the largest share, all share."""
    r = df.where(F.col(path).isNotNull()).agg(F.min(posix(F.col(path))), F.max(posix(F.col(path)))).first()
    if r[0] is None:
        return ""
    n = next((i for i, (a, b) in enumerate(zip(r[0], r[1])) if a != b), min(len(r[0]), len(r[1])))
    return r[0][:n].rpartition("/")[0]


def rebase_to_current(stored: DataFrame, current: DataFrame, path: str = "image_path", key: str = "image_index") -> DataFrame:
    """Stored rows with the paths of the current run, where a suffix of both paths names the same file; others stay."""
    from lumenframe.operators.joins import portable_path_join

    hit = portable_path_join(stored, current.select(F.col(key).alias("_now"), F.col(path).alias("_there")), path, "_there", key, "_now")
    new = hit.join(current.select(F.col(key).alias("_now"), F.col(path).alias("_there")), "_now").select(key, "_there")
    return stored.join(new, key, "left").withColumn(path, F.coalesce("_there", path)).drop("_there")


def rebase(df: DataFrame, old_root: str | None, new_root: str | None, cols: list[str]) -> DataFrame:
    """Paths under ``old_root`` (by default the folder all paths of the first column share) moved below ``new_root``; others
    stay. Without ``new_root`` they become relative. Array columns are mapped."""
    if old_root is None:
        old_root = common_root(df, cols[0])
    pat = "^" + re.escape(old_root.rstrip("/")) + "/"
    to = "" if new_root is None else new_root.rstrip("/").replace("\\", "\\\\").replace("$", "\\$") + "/"
    f = lambda c: F.regexp_replace(posix(c), pat, to)
    return df.withColumns({c: F.transform(c, f) if df.schema[c].dataType.simpleString().startswith("array") else f(F.col(c)) for c in cols})


def catalog_from_table(table: DataFrame) -> DataFrame:
    """A catalog from any table with a non-empty ``file_path``; column names are lower-cased, clashes are an error."""
    low = [c.lower() for c in table.columns]
    if len(set(low)) < len(low):
        raise ValueError("column names differ only by case")
    t = table.toDF(*low)
    if "file_path" not in low:
        raise ValueError("the table needs a column file_path")
    if not t.where(F.coalesce(F.trim("file_path"), F.lit("")) == "").isEmpty():
        raise ValueError("file_path is empty in some rows")
    return index_by_path(t.withColumnRenamed("file_path", "image_path"))


def discover(spark: SparkSession, path: str, extensions: list[str] | None = None, template: str | None = None, lookup: DataFrame | None = None, filename: str | list[str] | None = None, on_missing: str = "drop", metadata_fn=None, names: list[str] | None = None) -> DataFrame:
    """Scan, extract metadata (by template, table, or a function of the path that gives ``names``), merge channels, give ids
    and indices."""
    f = scan(spark, path, extensions).select("file_path")
    if template:
        f = template_metadata(f, template, on_missing=on_missing)
    elif metadata_fn is not None:
        f = callable_metadata(f, metadata_fn, names or [], on_missing=on_missing)
    elif lookup is not None:
        f = lookup_metadata(f, lookup, filename, on_missing=on_missing)
    else:
        f = default_metadata(f)
    if "channel_index" in f.columns:
        f = merge_channels(f, [c for c in f.columns if c not in ("file_path", "channel_index")])
    else:
        f = f.withColumnRenamed("file_path", "image_path")
    if "id" not in f.columns:
        f = f.withColumn("id", path_to_id(F.col("image_path")))
    return index_by_path(require_unique_ids(f))


def sample_indices(n: int, cap: int = 32) -> list[int]:
    """At most ``cap`` evenly spaced indices of 0..n-1."""
    k = min(n, cap)
    return sorted({round(i * (n - 1) / max(k - 1, 1)) for i in range(k)}) if n else []


def preflight(observed: DataFrame, required: list[str]) -> DataFrame:
    """Checks on a sample of inspected files: errors, mixed shapes and types, missing columns."""
    tests = [F.count(F.when(F.col("error").isNotNull(), 1)).alias("n_errors"), F.count_distinct("height", "width").alias("n_shapes"), F.count_distinct("dtype").alias("n_dtypes"), *[F.count(F.when(F.col(c).isNull(), 1)).alias(f"missing_{c}") for c in required]]
    return observed.agg(F.count("*").alias("n"), *tests)


def findings(checks: DataFrame) -> DataFrame:
    """``(level, finding)`` of what :func:`preflight` counted: unreadable files and missing columns are errors, mixed shapes
    or types warnings. No row where all is well."""
    lost = [c for c in checks.columns if c.startswith("missing_")]
    say = lambda level, test, text: F.when(test, F.struct(F.lit(level).alias("level"), text.alias("finding")))
    all_ = [
        say("error", F.col("n") == 0, F.lit("no images")),
        say("error", F.col("n_errors") > 0, F.concat(F.col("n_errors").cast("string"), F.lit(" files cannot be read"))),
        say("warning", F.col("n_shapes") > 1, F.concat(F.col("n_shapes").cast("string"), F.lit(" different shapes"))),
        say("warning", F.col("n_dtypes") > 1, F.concat(F.col("n_dtypes").cast("string"), F.lit(" different types"))),
        *[say("error", F.col(c) > 0, F.concat(F.lit(c.removeprefix("missing_") + " is missing in "), F.col(c).cast("string"))) for c in lost],
    ]
    return checks.select(F.explode(F.array_compact(F.array(*all_))).alias("x")).select("x.*")


def all_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests)
