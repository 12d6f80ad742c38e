"""Distances to a reference, outliers and prototypes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenframe.functions.vectors import distance, l2_normalize, mean_vector
from lumenframe.operators import cells
from lumenframe.runtime import materialize, release


def centroid_distances(feats: DataFrame, reference: Column, dim: int, kind: str = "euclidean", key: str = "image_index", vec: str = "features") -> DataFrame:
    """``(key, is_reference, distance)`` to the mean of the reference rows; vectors are normalised first.

    The mean is one row from one map-side combined aggregation, and is broadcast. No reference row: distances are null.
    """
    f = feats.select(key, l2_normalize(F.col(vec)).alias("_v"), F.coalesce(reference, F.lit(False)).alias("is_reference"))
    c = f.where("is_reference").agg(mean_vector(F.col("_v"), dim).alias("_c"))
    return f.crossJoin(F.broadcast(c)).select(key, "is_reference", distance(kind, F.col("_v"), F.col("_c")).alias("distance"))


def nearest_reference_distances(feats: DataFrame, reference: Column, dim: int, kind: str = "euclidean", key: str = "image_index", vec: str = "features") -> DataFrame:
    """``(key, is_reference, distance)``: the least distance to any reference row (0 for reference rows themselves).

    All rows meet all references, by way of :class:`cells.Search`, which leaves out what cannot be nearest. Vectors that
    repeat are one reference; one with a value that is not finite is none, and has no distance. References are broadcast in
    turn, cells.HELD bytes at most, and what a pass finds is written.
    """
    f = materialize(feats.select(key, F.col(vec).alias("_v"), F.coalesce(reference, F.lit(False)).alias("is_reference")), "rows")
    refs = materialize(f.where("is_reference").select("_v").distinct(), "references")
    passes = cells.passes(refs.count(), dim)
    kind_of = feats.schema[key].dataType.simpleString()
    found = []
    for i in range(passes):
        part = refs.where(F.pmod(F.xxhash64("_v"), F.lit(passes)) == i).toArrow()
        r = _matrix(part.column(0).combine_chunks(), dim)
        r = r[np.isfinite(r).all(1)]
        del part
        n = np.linalg.norm(r, axis=1, keepdims=True)
        # rows of length 1 are searched; a zero row lies at 1 from them, in either measure
        b = feats.sparkSession.sparkContext.broadcast((cells.Cells((r / np.where(n == 0, 1, n))[n[:, 0] > 0]), len(r) > 0, bool((n == 0).any())))
        del r

        def run(batches: Iterator[pa.RecordBatch], b=b) -> Iterator[pa.RecordBatch]:
            held, some, zero = b.value
            s = cells.Search(held)
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = _matrix(batch.column("_v"), dim)
                n = np.linalg.norm(x, axis=1)
                x = x / np.where(n == 0, 1, n)[:, None]
                d = np.full(len(x), np.inf)
                ok = np.isfinite(x).all(1)
                if len(held.x) and ok.any():
                    s.set(x[ok])
                    d[ok] = s.nearest()
                if kind == "cosine":
                    d = np.where(n == 0, 1.0, d * d / 2)
                    d = np.minimum(d, 1.0) if zero else d
                else:
                    d = np.where(n == 0, 0.0 if zero else 1.0, np.minimum(d, 1.0) if zero else d)
                d[~ok] = np.nan
                d = d if some else np.where((n == 0) & (kind == "cosine"), 1.0, np.nan)
                yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("is_reference"), pa.array(d, mask=np.isnan(d))], names=[key, "is_reference", "distance"])

        found.append(materialize(f.mapInArrow(run, f"{key} {kind_of}, is_reference boolean, distance double"), "nearest"))
        b.destroy()
    release(f)
    release(refs)
    return found[0] if passes == 1 else reduce(DataFrame.unionByName, found).groupBy(key, "is_reference").agg(F.min("distance").alias("distance"))


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(col.flatten()).astype(float).reshape(-1, dim)


def reference_distances(images: DataFrame, feats: DataFrame, reference: Column, dim: int, keep: Column | None = None, mode: str = "centroid", kind: str = "euclidean", key: str = "image_index") -> DataFrame:
    """All images with ``is_reference`` and ``distance``; null distance where filtered out or without features.

    The reference is what matches ``reference`` among the kept rows; if nothing does, an error is raised.
    """
    keep = F.lit(True) if keep is None else F.coalesce(keep, F.lit(False))
    inside = images.where(keep)
    ref = inside.where(reference).select(key, F.lit(True).alias("_ref"))
    if ref.isEmpty():
        raise ValueError("no image matches the reference filters")
    f = feats.join(inside.select(key), key, "left_semi").join(ref, key, "left").select(key, "features", F.coalesce("_ref", F.lit(False)).alias("_ref"))
    run = {"centroid": centroid_distances, "all_to_all": nearest_reference_distances}
    if mode not in run:
        raise ValueError(f"mode must be one of {sorted(run)}")
    d = run[mode](f, F.col("_ref"), dim, kind, key)
    return images.join(d, key, "left").withColumn("is_reference", F.coalesce("is_reference", F.lit(False)))


def distance_summary(d: DataFrame, group_by: list[str], lo: float | None = None, hi: float | None = None) -> DataFrame:
    """mean, std, min, max, count of distances per group, within an inclusive range."""
    x = d.where(F.col("distance").isNotNull())
    x = x.where(F.col("distance") >= lo) if lo is not None else x
    x = x.where(F.col("distance") <= hi) if hi is not None else x
    return x.groupBy(*group_by).agg(F.avg("distance").alias("mean"), F.stddev_samp("distance").alias("std"), F.min("distance").alias("min"), F.max("distance").alias("max"), F.count("*").alias("count"))


def distribution(d: DataFrame, group: str | None = None, reference: bool = False, key: str = "image_index") -> DataFrame:
    """``(key, group, is_reference, distance)`` for plots of distances: rows with one, without the reference unless asked."""
    x = d.where(F.col("distance").isNotNull() & (F.lit(reference) | ~F.col("is_reference")))
    g = F.lit("All") if group is None else F.coalesce(F.nullif(F.trim(F.col(group).cast("string")), F.lit("")), F.lit("N/A"))
    return x.select(key, g.alias("group"), "is_reference", "distance")


def extremes(d: DataFrame, n: int, key: str = "image_index") -> DataFrame:
    """The n closest and n farthest rows, ties by key; a top-k, so no full sort."""
    x = d.where("distance IS NOT NULL").select(key, "distance")
    near = x.orderBy("distance", key).limit(n).withColumn("side", F.lit("closest"))
    return near.unionByName(x.orderBy(F.desc("distance"), key).limit(n).withColumn("side", F.lit("farthest")))


def own_centroid_distances(feats: DataFrame, group: str, dim: int, kind: str = "euclidean", key: str = "image_index", vec: str = "features") -> DataFrame:
    """``(key, group, distance)`` to the mean of the own group; nulls are a group."""
    c = feats.groupBy(group).agg(mean_vector(F.col(vec), dim).alias("_c")).withColumnRenamed(group, "_g")
    j = feats.join(c, feats[group].eqNullSafe(c["_g"]))
    return j.select(key, group, distance(kind, F.col(vec), F.col("_c")).alias("distance"))


def prototypes(feats: DataFrame, group: str, dim: int, n: int = 5, kind: str = "euclidean", key: str = "image_index", vec: str = "features") -> DataFrame:
    """The n rows nearest to their group's centroid: ``(key, group, distance, rank_in_group)``; ties by key."""
    d = own_centroid_distances(feats, group, dim, kind, key, vec)
    w = Window.partitionBy(group).orderBy("distance", key)
    return d.withColumn("rank_in_group", F.row_number().over(w)).where(F.col("rank_in_group") <= n)


def outliers(feats: DataFrame, group: str | None, dim: int, method: str = "z-score", threshold: float = 3.0, key: str = "image_index", vec: str = "features") -> DataFrame:
    """``(key, group, distance_to_centroid, threshold)`` of rows farther from their group's centroid than the cut.

    z-score: mean + t sample std; iqr: q3 + t (q3 - q1), exact linear percentiles; strictly greater. A spread of 0 or a
    group under 2 rows gives none. A missing group is ``N/A``. A null vector is no row.
    """
    if method not in ("z-score", "iqr"):
        raise ValueError(f"unknown method {method!r}")
    label = F.lit("All") if group is None else F.coalesce(F.nullif(F.trim(F.col(group).cast("string")), F.lit("")), F.lit("N/A"))
    f = feats.where(F.col(vec).isNotNull()).select(key, label.alias("group"), vec)
    d = own_centroid_distances(f, "group", dim, "euclidean", key, vec)
    if method == "z-score":
        spread, cut = F.stddev_samp("distance"), F.avg("distance") + threshold * F.stddev_samp("distance")
    else:
        q1, q3 = F.percentile("distance", F.lit(0.25)), F.percentile("distance", F.lit(0.75))
        spread, cut = q3 - q1, q3 + threshold * (q3 - q1)
    cuts = d.groupBy("group").agg(F.count("*").alias("_n"), spread.alias("_s"), cut.alias("threshold")).where("_n >= 2 AND _s > 0")
    return d.join(cuts, "group").where("distance > threshold").select(key, "group", F.col("distance").alias("distance_to_centroid"), "threshold")


def drop_outliers(images: DataFrame, found: DataFrame, key: str = "image_index") -> DataFrame:
    return images.join(found.select(key), key, "left_anti")
