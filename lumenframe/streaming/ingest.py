"""Appending new rows as they arrive, with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lumenframe.operators.joins import not_done
from lumenframe.sources.store import ResultStore


def append_stream(rows: DataFrame, store: ResultStore, name: str, key: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append rows of a stream whose key the stored table lacks; a micro-batch that is repeated after a failure adds nothing,
    since its keys are stored already. Of the stored table only files whose keys overlap the batch's range are read."""

    def put(batch: DataFrame, _: int) -> None:
        new = batch.dropDuplicates([key])
        if store.has(name):
            lo, hi = new.agg(F.min(key), F.max(key)).first()
            new = not_done(new, store.read(name).where(F.col(key).between(lo, hi)), key)
        if not new.isEmpty():
            store.append(name, new)

    w = rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def late_counts(spark: SparkSession, path: str, schema: str, event: str, window: str = "1 day", late: str = "7 days") -> DataFrame:
    """Rows per event-time window of a parquet stream; rows later than the watermark are dropped by Spark."""
    s = spark.readStream.schema(schema).parquet(path)
    return s.withWatermark(event, late).groupBy(F.window(event, window)).agg(F.count("*").alias("n"))
