"""Incremental ingestion: what the sink has is skipped, in batches or as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.jsonl import exists


def seen(spark: SparkSession, sink: str, key: str) -> DataFrame | None:
    if not exists(spark, sink):
        return None
    return spark.read.parquet(sink).select(key).filter(F.coalesce(F.col(key), F.lit("")) != "").distinct()


def new_rows(landed: DataFrame, known: DataFrame | None, key: str, order: str | None = None) -> DataFrame:
    """Rows with a key that is neither empty nor known; the first of each by ``order``."""
    d = landed.filter(F.coalesce(F.col(key).cast("string"), F.lit("")) != "")
    if known is not None:
        d = d.join(known, key, "left_anti")
    if order is None:
        return d.dropDuplicates([key])
    return d.groupBy(key).agg(F.min_by(F.struct(*d.columns), F.col(order)).alias("r")).select("r.*")


def route(rows: DataFrame) -> dict[str, DataFrame]:
    """ok, blocked and failed rows by their status."""
    return {s: rows.filter(F.col("status") == s) for s in ("ok", "blocked", "failed")}


def counters(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("pages"), *(F.count_if(F.col("status") == s).alias(s) for s in ("ok", "blocked", "failed")))


def ingest_batch(landed: DataFrame, sink: str, key: str = "url", order: str | None = None) -> int:
    """Append what is new; returns the number of rows. A repeated run adds none."""
    from pyspark.sql import Observation

    n = Observation("new")
    fresh = new_rows(landed, seen(landed.sparkSession, sink, key), key, order).observe(n, F.count(F.lit(1)).alias("n"))
    fresh.write.mode("append").parquet(sink)
    return n.get["n"]


def ingest_stream(spark: SparkSession, folder: str, schema: str, sink: str, checkpoint: str, key: str = "url", transform: Callable[[DataFrame], DataFrame] | None = None, source: str = "parquet"):
    """All that has landed so far, each file once; batches that are repeated add nothing twice."""

    def write(batch: DataFrame, _: int) -> None:
        ingest_batch(transform(batch) if transform else batch, sink, key)

    stream = spark.readStream.schema(schema).format(source).load(folder)
    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def events_by_window(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts a window and type; the same on a stream, where rows later than ``late`` no longer count."""
    ts = F.col("ts").cast("timestamp")
    d = events.withColumn("ts", ts)
    d = d.withWatermark("ts", late) if events.isStreaming else d
    return d.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
