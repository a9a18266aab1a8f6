"""Profiles: exact nearest-rank percentiles, fixed-domain histograms, top-k, missing rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.casts import missing

# The fields whose missing rates are reported.
STATS_FIELDS = ("title", "category", "price", "currency", "availability_text", "in_stock", "stock_count", "rating", "description", "product_information", "image_url")


def nearest_rank(c: str, p: float, exact: bool = True, whole: bool = False) -> Column:
    """The value at rank ceil(p * n); whole: of integers. Not exact, it is a sketch of bounded memory by the same rule."""
    out = F.expr(f"percentile_disc({p}) within group (order by {c})") if exact else F.percentile_approx(c, p, 100_000)
    return out.cast("bigint") if whole else out


def safe_rate(n: Column, d: Column, places: int = 4) -> Column:
    return F.coalesce(F.round(F.try_divide(n, d), places), F.lit(0.0))


def mean(c: str, places: int = 4) -> Column:
    return F.round(F.avg(c), places)


def lengths(rows: DataFrame, c: str, prefix: str) -> list[Column]:
    zero, whole = F.lit(0), dict(rows.dtypes)[c] in ("int", "bigint")
    return [
        F.coalesce(F.round(F.avg(c), 2), zero.cast("double")).alias(f"{prefix}_avg"),
        F.coalesce(nearest_rank(c, 0.5, whole=whole), zero).alias(f"{prefix}_p50"),
        F.coalesce(nearest_rank(c, 0.95, whole=whole), zero).alias(f"{prefix}_p95"),
    ]


def dataset_stats(rows: DataFrame) -> DataFrame:
    """Lengths, prices and the rating histogram in one aggregation."""
    d = rows.withColumn("_n", F.char_length("description"))
    return d.agg(*lengths(d, "_n", "description"), *lengths(d, "price", "price"), *histogram("rating"))


def histogram(c: str) -> list[Column]:
    return [*(F.count_if(F.col(c) == k).alias(f"{c}_{k}") for k in range(1, 6)), F.count_if(F.col(c).isNull()).alias(f"{c}_null")]


def text_quality(prepared: DataFrame) -> DataFrame:
    """Over all records whose description was cleaned, dropped later or not."""
    d = prepared.filter("reached_description")
    return d.agg(
        *lengths(d, "before_len", "before"), *lengths(d, "after_len", "after"), F.coalesce(F.sum("description_deduped"), F.lit(0)).alias("dedup_applied"),
        F.coalesce(F.round(F.avg("shrink_ratio"), 4), F.lit(1.0)).alias("shrink_ratio_mean"), F.count_if("over_shrink").alias("over_shrink_count"),
    )


def top_k(rows: DataFrame, c: str, most: int = 20, order: str = "seq", null_name: str = "null") -> DataFrame:
    """By count; ties by first appearance."""
    g = rows.groupBy(F.coalesce(F.col(c).cast("string"), F.lit(null_name)).alias("value")).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    return g.orderBy(F.desc("n"), "first").limit(most)


def split_report(rows: DataFrame, c: str = "category", most: int = 10, order: str = "seq") -> DataFrame:
    g = rows.groupBy("split", F.coalesce(F.col(c), F.lit("null")).alias("value")).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    w = Window.partitionBy("split")
    d = g.withColumn("rows", F.sum("n").over(w)).withColumn("rank", F.row_number().over(w.orderBy(F.desc("n"), "first")))
    return d.filter(F.col("rank") <= most).drop("first")


def missing_rates(rows: DataFrame, fields=STATS_FIELDS) -> DataFrame:
    """A row a field; one pass."""
    kinds = dict(rows.dtypes)
    wide = rows.agg(*(F.coalesce(F.round(F.avg(missing(F.col(f), kinds[f]).cast("double")), 4), F.lit(0.0)).alias(f) for f in fields))
    return wide.select(F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("missing_rate")) for f in fields))).alias("x")).select("x.*")


def distribution(rows: DataFrame, c: str, unknown: str = "UNKNOWN") -> DataFrame:
    return rows.groupBy(F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(unknown)).alias(c)).agg(F.count(F.lit(1)).alias("n"))


def price_distribution(rows: DataFrame, c: str = "price") -> DataFrame:
    return rows.agg(F.count(c).alias("n"), F.min(c).alias("min"), F.median(c).alias("median"), F.max(c).alias("max"))


def format_prices(row) -> dict[str, str]:
    """Two places on the driver, n/a for no price."""
    return {k: "n/a" if row[k] is None else f"{row[k]:.2f}" for k in ("min", "median", "max")} | {"count": str(row["n"])}


def mean_length(rows: DataFrame, c: str = "description") -> DataFrame:
    return rows.agg(F.coalesce(F.round(F.avg(F.coalesce(F.char_length(c), F.lit(0))), 2), F.lit(0.0)).alias("mean_length"))
