"""Choosing a varied subset: density from repeated hash buckets, then a weighted sample of fixed size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm import vectors as V
from lumenframe.llm.cuts import lowest
from lumenframe.runtime import materialize

BITS = (24, 12)  # planes of a fine and a coarse table


def bucket_keys(df: DataFrame, id_col: str, vec_col: str, dim: int = 128, tables: int = 8, seed: int = 23) -> DataFrame:
    """``(id, keys)`` of usable vectors, each id once: the bucket of each of ``tables`` random-hyperplane hashes."""
    bits = [BITS[i % len(BITS)] for i in range(tables)]
    planes = np.random.default_rng(seed).standard_normal((sum(bits), dim)).astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = V.read_batch(batch, id_col, vec_col, dim)
            if not len(ids):
                continue
            up = (V.unit(x).astype(np.float32) @ planes.T) > 0
            keys, at = np.empty((len(ids), tables), np.int32), 0
            for t, w in enumerate(bits):
                keys[:, t] = up[:, at : at + w] @ (1 << np.arange(w, dtype=np.int64))
                at += w
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), tables).cast(pa.list_(pa.int32()))], names=["id", "keys"])

    return df.select(id_col, vec_col).mapInArrow(run, "id bigint, keys array<int>").dropDuplicates(["id"])


def densities(df: DataFrame, id_col: str, vec_col: str, dim: int = 128, tables: int = 8) -> DataFrame:
    """``(id, density)``: the mean, over the tables, of how many vectors share the bucket.

    A fine and a coarse hash take turns, so that near copies count as well as wide crowds: the coarse counts are set
    against the count of an average coarse bucket before they enter the mean. Bucket counts are pre-aggregated; the
    counts meet the rows by a join on the bucket, whose hot buckets adaptive execution may split.
    """
    keys = materialize(bucket_keys(df, id_col, vec_col, dim, tables), "buckets")
    n = keys.count()
    long = keys.select("id", F.posexplode("keys").alias("t", "key"))
    counts = long.groupBy("t", "key").agg(F.count("*").alias("c"))
    scale = F.lit(1.0)
    for i, w in enumerate(BITS):
        scale = F.when(F.col("t") % len(BITS) == i, F.greatest(F.lit(1.0), F.lit(n / 2.0**w))).otherwise(scale)
    # buckets with one member need no join: a missing count is 1
    j = long.join(counts.where("c > 1"), ["t", "key"], "left")
    return j.groupBy("id").agg(F.avg(F.coalesce(F.col("c"), F.lit(1)) / scale).alias("density"))


def varied_subset(df: DataFrame, id_col: str, vec_col: str, size: int, dim: int = 128, tables: int = 8, seed: int = 29) -> DataFrame:
    """``(image_index, density, weight)``: exactly ``size`` vectors (all, if there are fewer), each drawn with a
    probability inverse to its density, without replacement.

    Every vector gets an exponential waiting time with rate 1/density from a hash of its id; the ``size`` shortest win,
    ties by id. The time that cuts is narrowed down by counting (see :func:`lowest`), so neither all rows nor a share of
    them is ever sorted in one task. The draw is repeatable. ``weight`` is the rate.
    """
    u = (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    t = materialize(densities(df, id_col, vec_col, dim, tables).withColumn("wait", -F.log(u) * F.col("density")), "waits")
    return lowest(t, {0: size}, "wait", "id").select(F.col("id").alias("image_index"), "density", (1 / F.col("density")).alias("weight"))
