"""Streaming over sorted partitions, so that a large group never has to be in memory as a whole."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.runtime import materialize, partitions


def numbered(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """Adds ``name``: 0..n-1 in the order of ``by``.

    Rows are range-partitioned and numbered within their range, and written once, since another run of a range
    partitioning may draw other borders. The counts of the ranges, one number each, then say where a range begins. No task
    sorts more than its range.
    """
    s = df.repartitionByRange(max(1, partitions(df.sparkSession)), *by).sortWithinPartitions(*by).withColumn("_m", F.monotonically_increasing_id())
    s = materialize(s, "numbered")
    part, rank = F.shiftright("_m", 33), F.col("_m").bitwiseAND((1 << 33) - 1)
    base, at = [], 0
    for r in s.groupBy(part.alias("p")).agg(F.count("*").alias("c")).orderBy("p").collect():  # one row a range
        base.append((r["p"], at))
        at += r["c"]
    starts = F.broadcast(df.sparkSession.createDataFrame(base, "_p bigint, _base bigint"))
    return s.withColumn("_p", part).join(starts, "_p").select((rank + F.col("_base")).cast("bigint").alias(name), *df.columns)


def stream_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[bool, pa.Table]]:
    """Slices of sorted batches, cut where a key changes; True marks the first slice of a new key."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        cols = [np.asarray(t.column(k)) for k in keys]
        cut = np.zeros(t.num_rows, bool)
        cut[0] = True
        for c in cols:
            cut[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(cut)
        for lo, hi in zip(starts, np.append(starts[1:], t.num_rows)):
            key = tuple(c[lo] for c in cols)
            yield key != last, t.slice(lo, hi - lo)
            last = key
