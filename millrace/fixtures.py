"""Record fixtures derived from the part table, in SQL that Spark and DuckDB both read.

No table holds product records; these expressions make them, with the defects that the
operators are there for at fixed key steps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_K = "p_partkey"
_PRICE = "CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS STRING)"

PRODUCT_FIELDS = {
    "seq": _K,
    "product_url": f"CASE WHEN {_K} % 41 = 0 THEN NULL ELSE 'https://shop.example/p/' || CAST({_K} AS STRING) END",
    "title": f"CASE WHEN {_K} % 29 = 0 THEN 'Itâ€™s  ' || p_name WHEN {_K} % 31 = 0 THEN 'From Â£ ' || p_name ELSE p_name END",
    "category": f"CASE WHEN {_K} % 7 = 0 THEN 'Default' WHEN {_K} % 11 = 0 THEN '' WHEN {_K} % 13 = 0 THEN NULL ELSE p_type END",
    "price_text": f"CASE WHEN {_K} % 17 = 0 THEN 'free' WHEN {_K} % 19 = 0 THEN '£0.00' WHEN {_K} % 23 = 0 THEN NULL ELSE '£' || {_PRICE} END",
    "availability_text": f"CASE WHEN {_K} % 5 = 0 THEN 'Out of stock' ELSE 'In stock (' || CAST(p_size AS STRING) || ' available)' END",
    "raw_rating_text": f"CASE WHEN {_K} % 37 = 0 THEN 'star-rating Three' WHEN {_K} % 6 = 0 THEN 'Zero' WHEN {_K} % 6 = 1 THEN 'One' WHEN {_K} % 6 = 2 THEN 'Two' WHEN {_K} % 6 = 3 THEN 'Three' WHEN {_K} % 6 = 4 THEN 'Four' ELSE 'Five' END",
    "rating": f"CAST(CASE WHEN {_K} % 43 = 0 THEN 9 WHEN {_K} % 3 = 0 THEN NULL ELSE {_K} % 6 END AS INT)",
    "description": f"CASE WHEN {_K} % 53 = 0 THEN repeat('Same words here. ', 20) ELSE p_name || ' is good.  It is made of ' || p_type || '. ' || CASE WHEN {_K} % 4 = 0 THEN p_name || ' IS GOOD. ' ELSE '' END || CASE WHEN {_K} % 47 = 0 THEN 'Â£ ' ELSE '' END || 'The end of ' || p_brand || '!' END",
    "upc": "CASE WHEN p_partkey % 59 = 0 THEN NULL ELSE substr({sha}, 1, 16) END",
    "product_type": "p_brand",
    "price_excl": f"CASE WHEN {_K} % 61 = 0 THEN 'n/a' ELSE '£' || {_PRICE} END",
    "price_incl": f"'£' || {_PRICE}",
    "tax": "'£0.00'",
    "reviews": f"CASE WHEN {_K} % 67 = 0 THEN 'many' ELSE CAST({_K} % 10 AS STRING) END",
}
SHA = {"spark": "sha2(CAST(p_partkey AS STRING), 256)", "duckdb": "sha256(CAST(p_partkey AS STRING))"}


def fields(dialect: str) -> list[str]:
    return [f"{e.replace('{sha}', SHA[dialect])} AS {n}" for n, e in PRODUCT_FIELDS.items()]


PRODUCT_SQL = f"SELECT {', '.join(fields('duckdb'))}, p_size, p_name, p_type, p_brand FROM part"


def raw_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr(*fields("spark"), "p_size", "p_name", "p_type", "p_brand")


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product records: the raw fields through the casts of a parsed page."""
    from .functions import casts as C

    d = raw_products(spark, sf_dir)
    labels = (("UPC", "upc"), ("Product Type", "product_type"), ("Price (excl. tax)", "price_excl"), ("Price (incl. tax)", "price_incl"), ("Tax", "tax"), ("Availability", "availability_text"), ("Number of reviews", "reviews"))
    kv = F.filter(F.array(*(F.struct(F.lit(k).alias("k"), F.col(c).alias("v")) for k, c in labels)), lambda x: x["v"].isNotNull())
    p = C.price(F.col("price_text"))
    return d.select(
        "seq", "product_url", "title", F.array(F.lit("Home"), F.lit("Books"), "p_type", "p_name").alias("raw_breadcrumb"), "category", p["price"].alias("price"), F.coalesce(p["currency"], F.lit("")).alias("currency"),
        "availability_text", C.in_stock(F.col("availability_text")).alias("in_stock"), C.stock_count(F.col("availability_text")).alias("stock_count"), "rating", "raw_rating_text", "description", kv.alias("product_information"),
        F.lit(None).cast("string").alias("image_url"), F.lit("2024-01-01T00:00:00Z").alias("scraped_at"),
    )


# The same records after the strict build, from the key steps alone.
_MISMATCH = "(n IS NOT NULL AND w IS NOT NULL AND n <> w)"
FATE_SQL = f"""
SELECT *, CASE WHEN NOT coalesce(price > 0, false) THEN 'price_parse_failed'
  WHEN {_MISMATCH} OR coalesce(coalesce(n, w) NOT BETWEEN 1 AND 5, false) THEN 'rating_out_of_range'
  WHEN seq % 61 = 0 OR seq % 67 = 0 THEN 'key_attr_parse_failed'
  WHEN seq % 29 = 0 THEN 'mojibake_detected' END AS drop_reason
FROM (SELECT *, rating AS n, CASE WHEN seq % 37 = 0 THEN 3 WHEN seq % 6 > 0 THEN (seq % 6)::INT END AS w,
  CASE WHEN seq % 17 = 0 OR (seq % 19 <> 0 AND seq % 23 = 0) THEN NULL WHEN seq % 19 = 0 THEN 0.0 ELSE CAST(replace(price_incl, '£', '') AS DOUBLE) END AS price,
  trim(regexp_replace(replace(replace(title, 'Â£', '£'), 'Â', ''), '\\s+', ' ', 'g')) AS t, nullif(nullif(category, 'Default'), '') AS c,
  CASE WHEN seq % 5 <> 0 THEN p_size END AS stock, seq % 5 <> 0 AS in_stock FROM ({PRODUCT_SQL}))
"""

_Q = lambda c: f"coalesce('\"' || {c} || '\"', 'null')"
_N = lambda c: f"coalesce(CAST({c} AS STRING), 'null')"
OUTPUT_SQL = (
    "'{\"availability\":{\"in_stock\":' || CAST(in_stock AS STRING) || ',\"stock_count\":' || " + _N("stock") + " || '},\"category\":' || " + _Q("c")
    + " || ',\"currency\":\"GBP\",\"key_attributes\":{\"availability_text\":\"' || availability_text || '\",\"price_excl_tax\":' || " + _N("CAST(replace(price_excl, '£', '') AS DOUBLE)") + " || ',\"price_incl_tax\":' || " + _N("CAST(replace(price_incl, '£', '') AS DOUBLE)")
    + " || ',\"product_type\":' || " + _Q("product_type") + " || ',\"review_count\":' || reviews || ',\"tax\":0.0,\"upc\":' || " + _Q("upc") + " || '},\"price\":' || " + _N("price") + " || ',\"rating\":' || " + _N("coalesce(n, w)") + " || ',\"title\":' || " + _Q("t") + " || '}'"
)


def label_text(category: str = "'\"' || p_type || '\"'", price: str = _PRICE, stock: str = "CAST(p_size AS STRING)", rating: str = f"CAST({_K} % 5 + 1 AS STRING)") -> str:
    """JSON of a label in both dialects."""
    return (
        f"'{{\"availability\":{{\"in_stock\":true,\"stock_count\":' || {stock} || '}},\"category\":' || {category} || ',\"currency\":\"GBP\",\"key_attributes\":{{\"availability_text\":\"In stock\",\"price_excl_tax\":' || {_PRICE} || ',\"price_incl_tax\":' || {_PRICE} || "
        f"',\"product_type\":\"' || p_brand || '\",\"review_count\":0,\"tax\":0.00,\"upc\":\"u' || CAST({_K} AS STRING) || '\"}},\"price\":' || {price} || ',\"rating\":' || {rating} || ',\"title\":\"' || p_name || '\"}}'"
    )


GOLD = label_text()
PREDICTED = f"""CASE {_K} % 11 WHEN 0 THEN {label_text(category="'null'")} WHEN 1 THEN {label_text(price="CAST(CAST(p_retailprice AS DECIMAL(12,2)) + 1 AS STRING)")}
 WHEN 2 THEN {label_text(stock="'null'")} WHEN 3 THEN 'no json' WHEN 4 THEN substr({GOLD}, 1, length({GOLD}) - 20) WHEN 5 THEN {label_text(price=f"'\"' || {_PRICE} || '\"'")}
 WHEN 6 THEN {label_text(rating="'9'")} WHEN 7 THEN 'Here: ' || {GOLD} || ' done' WHEN 8 THEN '' ELSE {GOLD} END"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """idx, gold_text, raw_response."""
    return spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr(f"{_K} AS idx", f"{GOLD} AS gold_text", f"{PREDICTED} AS raw_response", "p_name")
