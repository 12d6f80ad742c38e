"""Batch correction from control rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.functions.text import stable_batch_id
from lumenframe.runtime import materialize


FAN_IN = 32
WHITEN_MB = 64  # most megabytes of whitening matrices that are broadcast


def with_batch_id(df: DataFrame, batch: str, name: str = "batch_id") -> DataFrame:
    return df.withColumn(name, stable_batch_id(F.col(batch), df.schema[batch].dataType.simpleString()))


def batch_stats(df: DataFrame, batch: str, vec: str, dim: int, controls: Column | None = None, method: str = "sphering", min_controls: int = 2, ridge: float = 1e-3) -> DataFrame:
    """``(batch_id, method, n_controls, mean, std, whiten)`` per batch, from control rows.

    zscore: std = sqrt(max(sample variance, 1e-12)), all in the JVM. sphering: symmetric whitening of the covariance plus a
    ridge of max(1e-12, ridge x trace / dim); per partition the sums and the scatter matrix of each batch are built with
    numpy, and only those (dim x dim numbers a batch and partition) are shuffled and added.
    A missing batch key, or a batch with fewer than ``min_controls`` controls, is an error.
    """
    if method not in ("zscore", "sphering"):
        raise ValueError(f"unknown method {method!r}")
    if not df.where(F.coalesce(F.trim(F.col(batch).cast("string")), F.lit("")) == "").isEmpty():
        raise ValueError(f"{batch} is missing in some rows")
    d = with_batch_id(df, batch, "batch_id").select("batch_id", F.transform(vec, lambda x: x.cast("double")).alias("_v"), (F.lit(True) if controls is None else F.coalesce(controls, F.lit(False))).alias("_c"))
    n = d.groupBy("batch_id").agg(F.count(F.when(F.col("_c"), 1)).alias("n_controls"))
    short = n.where(F.col("n_controls") < min_controls).limit(5).collect()
    if short:
        raise ValueError("too few controls in batches " + ", ".join(r[0] for r in short))
    c = d.where("_c")
    if method == "zscore":
        from pyspark.ml.functions import array_to_vector, vector_to_array
        from pyspark.ml.stat import Summarizer

        # one JVM summary per batch, partial sums combined map-side; its variance is the sample's
        x = array_to_vector("_v")
        std = F.transform(vector_to_array(Summarizer.variance(x)), lambda v: F.sqrt(F.greatest(v, F.lit(1e-12))))
        aggs = [F.count("*").cast("int").alias("n_controls"), vector_to_array(Summarizer.mean(x)).alias("mean"), std.alias("std")]
        return c.groupBy("batch_id").agg(*aggs).select("batch_id", F.lit("zscore").alias("method"), "n_controls", "mean", "std", F.lit(None).cast("array<array<double>>").alias("whiten"))

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc: dict[str, list] = {}
        for pdf in batches:
            for b, g in pdf.groupby("batch_id"):
                x = np.stack(g["_v"].to_numpy())
                m, k = x.mean(0), len(x)
                s = (x - m).T @ (x - m)
                if b in acc:
                    acc[b] = _merge(acc[b], [k, m, s])
                else:
                    acc[b] = [k, m, s]
        yield pd.DataFrame({"batch_id": list(acc), "n": [a[0] for a in acc.values()], "m": [a[1] for a in acc.values()], "s": [a[2].ravel() for a in acc.values()]})

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        total = None
        for r in pdf.itertuples(index=False):
            one = [r.n, np.asarray(r.m), np.asarray(r.s).reshape(dim, dim)]
            total = one if total is None else _merge(total, one)
        k, m, s = total
        cov = s / max(k - 1, 1)
        extra = max(1e-12, ridge * np.trace(cov) / dim)
        w, q = np.linalg.eigh(cov + extra * np.eye(dim))
        white = (q * (1 / np.sqrt(np.maximum(w, extra)))) @ q.T
        return pd.DataFrame({"batch_id": [pdf["batch_id"].iloc[0]], "method": ["sphering"], "n_controls": [int(k)], "mean": [m], "std": [None], "whiten": [[list(row) for row in white]]})

    kind = "batch_id string, n bigint, m array<double>, s array<double>"

    def together(pdf: pd.DataFrame) -> pd.DataFrame:
        total = None
        for r in pdf.itertuples(index=False):
            one = [r.n, np.asarray(r.m), np.asarray(r.s).reshape(dim, dim)]
            total = one if total is None else _merge(total, one)
        return pd.DataFrame({"batch_id": [pdf["batch_id"].iloc[0]], "n": [total[0]], "m": [total[1]], "s": [total[2].ravel()]})

    sums = c.select("batch_id", "_v").mapInPandas(partial, kind)
    # by a tree: FAN_IN partitions' matrices of a batch are added first, so that no task holds those of all partitions
    parts = c.select(F.spark_partition_id().alias("p")).agg(F.max("p")).first()[0] or 0
    while parts >= FAN_IN:
        parts //= FAN_IN
        sums = sums.withColumn("_g", F.pmod(F.spark_partition_id(), F.lit(parts + 1))).groupBy("batch_id", "_g").applyInPandas(lambda p: together(p.drop(columns="_g")), kind)
    return sums.groupBy("batch_id").applyInPandas(finish, "batch_id string, method string, n_controls int, mean array<double>, std array<double>, whiten array<array<double>>")


def _merge(a: list, b: list) -> list:
    n = a[0] + b[0]
    d = b[1] - a[1]
    return [n, a[1] + d * (b[0] / n), a[2] + b[2] + np.outer(d, d) * (a[0] * b[0] / n)]


def apply_correction(df: DataFrame, stats: DataFrame, batch: str, vec: str, out: str = "corrected") -> DataFrame:
    """Adds the corrected vector; a batch without statistics is an error when its row is computed.

    Whitening is a matrix product per batch of rows (numpy), with the matrices broadcast while they have WHITEN_MB or less.
    Beyond, and for zscore, the statistics are joined on the batch (broadcast by Spark only under its size threshold).
    """
    stats = materialize(stats, "batch_stats")
    shape = stats.where("whiten IS NOT NULL").agg(F.count("*"), F.max(F.size("mean"))).first()
    if shape[0] and shape[0] * shape[1] ** 2 * 8 <= WHITEN_MB * 1e6:
        rows = stats.collect()  # bounded by the line above
        known = {r["batch_id"]: (np.asarray(r["mean"]), np.asarray(r["whiten"])) for r in rows}
        b = df.sparkSession.sparkContext.broadcast(known)
        names = df.columns
        schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rb in batches:
                ids, col = np.asarray(rb.column("_bid").to_pylist(), object), rb.column(vec)
                lost = set(ids.tolist()) - set(b.value)
                if lost:
                    raise ValueError(f"no statistics for batch {sorted(map(str, lost))[0]}")
                size = np.asarray(pc.fill_null(pc.list_value_length(col), -1))
                got = np.full(len(ids), None, object)
                for k in set(ids.tolist()):
                    mean, white = b.value[k]
                    at = np.flatnonzero((ids == k) & (size == len(mean)))
                    if len(at):
                        x = np.asarray(col.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False), float).reshape(len(at), -1)
                        got[at] = list((x - mean) @ white.T)
                cols = [rb.column(c) for c in names] + [pa.array(got.tolist(), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(cols, names=[*names, out])

        return with_batch_id(df, batch, "_bid").mapInArrow(run, schema)
    s = stats.select(F.col("batch_id").alias("_b"), F.col("mean").alias("_m"), F.col("std").alias("_s"), F.col("whiten").alias("_w"))
    j = with_batch_id(df, batch, "_bid").join(s, F.col("_bid") == F.col("_b"), "left")
    v = F.when(F.col("_b").isNull(), F.raise_error(F.concat(F.lit("no statistics for batch "), F.col("_bid"))).cast("array<double>")).otherwise(F.transform(vec, lambda x: x.cast("double")))
    j = j.withColumn("_d", F.zip_with(v, "_m", lambda a, b: a - b))
    z = F.zip_with("_d", "_s", lambda a, b: a / F.greatest(b, F.lit(1e-12)))
    sph = F.transform("_w", lambda row: F.aggregate(F.zip_with("_d", row, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x))
    return j.withColumn(out, F.when(F.col("_w").isNotNull(), sph).otherwise(z)).drop("_b", "_m", "_s", "_w", "_d", "_bid")


def correct_batches(df: DataFrame, batch: str, vec: str, dim: int, controls: Column | None = None, method: str = "sphering", **options) -> tuple[DataFrame, DataFrame]:
    """(rows with ``corrected``, statistics). Tables are immutable here, so correcting twice is the caller's choice."""
    stats = batch_stats(df, batch, vec, dim, controls, method, **options)
    return apply_correction(df, stats, batch, vec), stats
