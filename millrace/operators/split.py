"""Deterministic splits, samples and exact deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.casts import ratio as clamp

#: What a group is told by; the others come after it in this order.
KEYS = ("upc", "product_url", "title", "category")


def bucket(c: Column, buckets: int = 100) -> Column:
    """From the first 8 hexadecimal digits of the SHA-256."""
    return F.conv(F.substring(F.sha2(c, 256), 1, 8), 16, 10).cast("bigint") % buckets


def group_key(by: str) -> Column:
    """struct(key, source): upc, then product_url, then "null"; any other field falls back likewise."""
    first, url = F.nullif(F.col(by).cast("string"), F.lit("")), F.nullif(F.col("product_url"), F.lit(""))
    return F.struct(F.coalesce(first, url, F.lit("null")).alias("key"), F.when((F.lit(by == "upc")) & first.isNotNull(), "upc").otherwise("product_url").alias("source"))


def split(rows: DataFrame, by: str = "upc", val_ratio: float = 0.05, order: str = "seq") -> DataFrame:
    """Adds key, key_source, bucket, split. A side left empty gets the last row of the other."""
    limit = int(round(clamp(val_ratio) * 100))
    k = group_key(by)
    d = rows.withColumn("key", k["key"]).withColumn("key_source", k["source"]).withColumn("bucket", bucket(F.col("key")))
    if clamp(val_ratio) <= 0:
        return d.withColumn("split", F.lit("train"))
    d = d.withColumn("_val", F.col("bucket") < limit)
    # one row, joined to all: nothing runs while the plan is built
    side = d.agg(F.count_if("_val").alias("_vals"), F.count_if(~F.col("_val")).alias("_trains"), F.max(order).alias("_last"))
    last = F.col(order) == F.col("_last")
    val = F.when(F.col("_vals") == 0, last).when(F.col("_trains") == 0, ~last).otherwise(F.col("_val"))
    return d.crossJoin(F.broadcast(side)).withColumn("split", F.when(val, "val").otherwise("train")).drop("_val", "_vals", "_trains", "_last")


def keep_first(rows: DataFrame, keys: list[str | Column], order: str) -> DataFrame:
    """The first row of each key. Rows of a key meet as running minima, not as a group."""
    others = [c for c in rows.columns]
    hashed = rows.withColumn("_key", F.sha2(F.concat_ws("||", *keys), 256))
    return hashed.groupBy("_key").agg(F.min_by(F.struct(*others), F.col(order)).alias("r")).select("r.*")


def audit_sample(rows: DataFrame, most: int = 20, by: str = "product_url") -> DataFrame:
    return rows.orderBy(F.sha2(by, 256), by).limit(most)


def first_per_group(rows: DataFrame, group: str, order: str, most: int) -> DataFrame:
    """Ranks prune before the shuffle (window group limit), so a large group sends few rows a task."""
    w = Window.partitionBy(group).orderBy(order)
    return rows.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= most).drop("_rank")
