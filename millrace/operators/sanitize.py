"""Record validation with named drop reasons and exact fix counts.

Checks run in a fixed order and the first that fails names the reason. Fixes are counted as far
as a record came, so counts are columns gated by stage, never accumulators.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import casts as C
from ..functions import text as X
from ..functions.rows import keep_where
from ..schemas import DROP_REASONS, FIXES, PAYLOAD
from .render import model_input, payload, stable_json

# Labels of the attribute table and their keys, numeric ones in the order they are read.
ATTRIBUTES = (("UPC", "upc"), ("Product Type", "product_type"), ("Price (excl. tax)", "price_excl_tax"), ("Price (incl. tax)", "price_incl_tax"), ("Tax", "tax"), ("Availability", "availability_text"), ("Number of reviews", "review_count"))
NUMERIC = ("price_excl_tax", "price_incl_tax", "tax", "review_count")
INSTRUCTION = "请从给定的商品页面文本中抽取并规范化商品信息，输出符合 JSON Schema 的结果。"


def last_wins(kv: Column) -> Column:
    """Of a repeated key, the last value at the first place."""
    keys = F.array_distinct(F.transform(kv, lambda x: x["k"]))
    return F.transform(keys, lambda k: F.struct(k.alias("k"), F.element_at(F.filter(kv, lambda x: x["k"] == k), -1)["v"].alias("v")))


def lookup(kv: Column, key: str) -> Column:
    return F.get(F.filter(kv, lambda x: x["k"] == key), 0)["v"]


def _count(*flags: Column) -> Column:
    return reduce(lambda a, b: a + b, [F.coalesce(f.cast("int"), F.lit(0)) for f in flags])


def sanitize(products: DataFrame, strict: bool = True, drop_default: bool = False, halves: bool = True) -> DataFrame:
    """Every record with drop_reason (null if accepted), payload, input, output, fix counts, description metrics.

    A record with text in a column ``_corrupt`` could not be read as its type: it is quarantined as
    ``other_exception``, with that text as its excerpt, and counts no fixes.
    """
    corrupt = F.col("_corrupt") if "_corrupt" in products.columns else F.lit(None).cast("string")
    kv = F.coalesce("product_information", F.array().cast("array<struct<k:string,v:string>>"))
    d = products.withColumns({"_fixed": X.fix_all(["title", "category", "description", "availability_text", "raw_rating_text"]), "_kv_texts": F.flatten(F.transform(kv, lambda x: F.array(x["k"], x["v"])))})
    d = d.withColumn("_kv_fixed", F.expr(f"transform(_kv_texts, x -> {X._fix_sql('x')})"))
    d = d.select(
        F.col("seq"), F.col("product_url"), F.coalesce("raw_breadcrumb", F.array().cast("array<string>")).alias("raw_breadcrumb"),
        *(F.get("_fixed", i).alias(c) for i, c in enumerate(("_title", "_category_fix", "_description", "_availability", "_rating_text"))),
        F.expr("transform(filter(_kv_fixed, (x, i) -> i % 2 = 0), (x, i) -> named_struct('k', x, 'v', get(_kv_fixed, 2 * i + 1)))").alias("_kv"),
        C.parse_float(F.col("price")).alias("_price"), C.rating(F.col("rating"), F.col("raw_rating_text"), strict).alias("_rating"),
        F.coalesce("in_stock", F.lit(False)).alias("in_stock"), C.parse_int(F.col("stock_count")).alias("stock_count"), F.struct(*[F.col(c) for c in ("title", "category", "description")]).alias("_raw"), corrupt.alias("_broken"),
    )
    d = d.withColumn("_category", X.let(F.nullif(F.col("_category_fix.text"), F.lit("")), lambda v: F.struct(F.when(v != C.DEFAULT_CATEGORY, v).alias("value"), F.coalesce(v == C.DEFAULT_CATEGORY, F.lit(False)).alias("is_default"))))
    d = d.withColumn("_text", F.col("_description.text"))
    d = X.clean_description(d, "_text", halves, keep="_collapsed")
    d = d.withColumn("product_information", last_wins(F.transform("_kv", lambda x: F.struct(x["k"]["text"].alias("k"), x["v"]["text"].alias("v")))))
    label = {key: name for name, key in ATTRIBUTES}
    names = (*NUMERIC, "availability_text", "product_type", "upc")
    d = d.withColumn("_values", F.array(*(lookup(F.col("product_information"), label[key]) for key in names)))
    d = d.withColumn("_values_fixed", F.expr(f"transform(_values, x -> {X._fix_sql('x')})"))
    new = {}
    for i, key in enumerate(names):
        new[f"_{key}"] = F.get("_values_fixed", i)
        if key in NUMERIC:
            number = f"regexp_extract(replace(x.text, '£', ''), '-?[0-9]+{'' if key == 'review_count' else '(?:[.][0-9]+)?'}', 0)"
            value = f"try_cast({number} AS INT)" if key == "review_count" else f"round(try_cast({number} AS DOUBLE), 2)"
            stripped = "false" if key == "review_count" else "contains(x.text, '£')"
            new[f"_{key}"] = F.expr(f"get(transform(array(get(_values_fixed, {i})), x -> named_struct('value', {value}, 'stripped', {stripped}, 'changed', x.changed)), 0)")
            new[f"_has_{key}"] = F.coalesce(F.get("_values", i) != "", F.lit(False))
    d = d.withColumns(new)
    # how far a numeric attribute is reached: in strict mode a failure ends the reading
    reached: list[Column] = []
    going = F.lit(True)
    for key in NUMERIC:
        reached.append(going & F.col(f"_has_{key}"))
        failed = F.col(f"_has_{key}") & F.col(f"_{key}.value").isNull()
        going = going & ~failed if strict else going
    attributes_failed = ~going if strict else F.lit(False)
    whole = F.col("_broken").isNull()
    passed_category = whole & ~(F.col("_category.value").isNull()) if drop_default else whole
    passed_price = passed_category & F.coalesce(F.col("_price") > 0, F.lit(False))
    passed_rating = passed_price & ~F.col("_rating.drop")
    passed_attributes = passed_rating & ~attributes_failed

    plain = lambda key: F.nullif(F.col(f"_{key}.text"), F.lit(""))
    number = lambda key: F.when(F.col(f"_has_{key}"), F.col(f"_{key}.value"))
    keys = F.struct(
        plain("availability_text").alias("availability_text"), number("price_excl_tax").alias("price_excl_tax"), number("price_incl_tax").alias("price_incl_tax"),
        plain("product_type").alias("product_type"), number("review_count").alias("review_count"), number("tax").alias("tax"), plain("upc").alias("upc"),
    )
    d = d.withColumns({
        "title": F.col("_title.text"), "category": F.col("_category.value"), "availability_text": F.col("_availability.text"), "price": F.round("_price", 2), "currency": F.lit("GBP"),
        "rating": F.col("_rating.value"), "raw_rating_text": F.nullif(F.col("_rating_text.text"), F.lit("")), "key_attributes": keys, "reached_description": passed_category,
    })
    d = d.withColumn("payload", payload().cast(PAYLOAD)).withColumns({"output": stable_json(F.col("payload")), "input": model_input()})
    reason = (
        F.when(~whole, "other_exception").when(~passed_category, "category_default_dropped").when(~passed_price, "price_parse_failed").when(~passed_rating, "rating_out_of_range")
        .when(~passed_attributes, "key_attr_parse_failed").when(F.try_parse_json("output").isNull(), "invalid_output_json").when(X.has_mojibake(F.col("output")), "mojibake_detected")
    )
    gate = lambda ok, n: F.when(ok, n).otherwise(F.lit(0))
    kv_fixes = F.aggregate(F.transform("_kv", lambda x: x["k"]["changed"].cast("int") + x["v"]["changed"].cast("int")), F.lit(0), lambda a, x: a + x)
    mojibake = (
        gate(whole, _count(F.col("_title.changed"), F.col("_category_fix.changed")))
        + gate(passed_category, _count(F.col("_description.changed"), F.col("_availability.changed")) + kv_fixes)
        + gate(passed_rating, _count(*(F.col(f"_{k}.changed") for k in ("availability_text", "product_type", "upc")), *(r & F.col(f"_{k}.changed") for r, k in zip(reached, NUMERIC))))
        + gate(passed_attributes, _count(F.col("_rating_text.changed")))
    )
    excerpt = F.concat_ws(" | ", *(F.when(F.col(f"_raw.{c}").isNull(), "None").when(F.col(f"_raw.{c}") != "", F.col(f"_raw.{c}")) for c in ("title", "category", "description")))
    d = d.withColumns({
        "drop_reason": reason, "mojibake_fixed": mojibake, "category_default_to_null": gate(whole, F.col("_category.is_default").cast("int")), "description_deduped": gate(passed_category, F.col("deduped").cast("int")),
        "currency_symbol_stripped": gate(passed_rating, _count(*(r & F.col(f"_{k}.stripped") for r, k in zip(reached, NUMERIC)))),
        "key_attr_numeric_cast": gate(passed_rating, _count(*(r & F.col(f"_{k}.value").isNotNull() for r, k in zip(reached, NUMERIC)))),
        "rating_mismatch": passed_price & F.col("_rating.mismatch"), "rating_out_of_range": passed_price & F.col("_rating.out_of_range"),
        "excerpt": X.head_preview(F.coalesce("_broken", excerpt)), **_previews(), "instruction": F.lit(INSTRUCTION),
    })
    return d.drop(*[c for c in d.columns if c.startswith("_")])


def accepted(prepared: DataFrame) -> DataFrame:
    return keep_where(prepared, "drop_reason", lambda r: r.isNull())


def dropped(prepared: DataFrame) -> DataFrame:
    return keep_where(prepared, "drop_reason", lambda r: r.isNotNull())


def sft_rows(prepared: DataFrame) -> DataFrame:
    return accepted(prepared).select("seq", "instruction", "input", "output")


def drop_counts(prepared: DataFrame) -> DataFrame:
    """Every reason, those without drops too."""
    spark = prepared.sparkSession
    domain = spark.createDataFrame([(i, r) for i, r in enumerate(DROP_REASONS)], "place int, drop_reason string")
    counts = dropped(prepared).groupBy("drop_reason").agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(domain).join(counts, "drop_reason", "left").select("drop_reason", F.coalesce("n", F.lit(0)).alias("n"))


def shown_url() -> Column:
    """A missing address as samples show it; in the records it stays null, so that group keys fall back."""
    return F.coalesce("product_url", F.lit("None")).alias("product_url")


def drop_samples(prepared: DataFrame, most: int = 20) -> DataFrame:
    return dropped(prepared).orderBy("seq").limit(most).select("seq", "drop_reason", shown_url(), "excerpt")


def _previews() -> dict[str, Column]:
    """Heads and middles of a description before and after its deduplication; null where it was left."""
    shown = {"before": "_collapsed", "after": "description"}
    return {f"{when}_{kind}_preview": F.when(F.col("deduped"), f(F.col(c))) for when, c in shown.items() for kind, f in (("head", X.head_preview), ("mid", X.mid_preview))}


def dedup_samples(prepared: DataFrame, most: int = 10) -> DataFrame:
    """The first records whose description was deduplicated, dropped later or not, with previews."""
    columns = ("seq", shown_url(), "before_len", "after_len", "shrink_ratio", "before_head_preview", "after_head_preview", "before_mid_preview", "after_mid_preview")
    return prepared.filter("description_deduped = 1").orderBy("seq").limit(most).select(*columns)


def fix_counts(prepared: DataFrame) -> DataFrame:
    return prepared.agg(*(F.sum(c).alias(c) for c in FIXES), F.sum(F.col("rating_mismatch").cast("int")).alias("rating_mismatch_count"), F.sum(F.col("rating_out_of_range").cast("int")).alias("rating_out_of_range_count"))
