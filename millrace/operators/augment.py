"""Failure-driven augmentation: rows times strategies, rewritten natively, capped a row.

Orders that would be drawn at random are orders of SHA-256 over seed, row and strategy, so a
run is the same on any cluster. A rewrite that changes nothing still counts against a row's
budget; deduplication removes it later.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapse, let
from .sanitize import ATTRIBUTES
from .split import keep_first

# Tags that count, and what they switch on.
TARGET_TAGS = ("long_input", "missing_category", "has_non_ascii", "truncation_suspected", "normalization_error", "null_handling_error")
BY_TAG = (("long_input", "trim_description"), ("long_input", "description_repeat_variant"), ("missing_category", "drop_category_line"), ("has_non_ascii", "special_char_perturb"), ("truncation_suspected", "trim_product_information"))
BY_ERROR = (("normalization_error", "pi_numeric_surface_perturb"), ("null_handling_error", "drop_stock_count_line"), ("null_handling_error", "drop_upc_line"))
ALWAYS = ("shuffle_fields", "shuffle_product_information_order", "drop_description_line")
BLOCKS = ("title", "category", "price", "availability", "description")
HEADS = ("Title: ", "Category: ", "Price: ", "Availability: ", "Description: ")
LABEL_SCHEMA = "struct<availability:struct<in_stock:boolean,stock_count:int>,category:string,currency:string,key_attributes:struct<availability_text:string,price_excl_tax:double,price_incl_tax:double,product_type:string,review_count:int,tax:double,upc:string>,price:double,rating:int,title:string>"


def active_strategies(badcases: DataFrame) -> DataFrame:
    """(strategy, n): rows of badcases (bucket_tags, error_type) that call for each; the constant ones have none."""
    spark = badcases.sparkSession
    rules = F.broadcast(spark.createDataFrame([("tag", *r) for r in BY_TAG] + [("error", *r) for r in BY_ERROR], "kind string, name string, strategy string"))
    names = badcases.select(F.explode(F.concat(F.transform(F.array_distinct(F.coalesce("bucket_tags", F.array().cast("array<string>"))), lambda t: F.struct(F.lit("tag").alias("kind"), t.alias("name"))), F.array(F.struct(F.lit("error").alias("kind"), F.col("error_type").alias("name"))))).alias("x")).select("x.*")
    found = names.join(rules, ["kind", "name"]).groupBy("strategy").agg(F.count(F.lit(1)).alias("n"))
    return found.unionByName(spark.createDataFrame([(s, 0) for s in ALWAYS], "strategy string, n long"))


def targeted(badcases: DataFrame) -> DataFrame:
    """(tag, n) of the tags that count."""
    return badcases.select(F.explode("bucket_tags").alias("tag")).filter(F.col("tag").isin(*TARGET_TAGS)).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def _first_with(head: str) -> Column:
    return F.get(F.filter("_head", lambda x: x.startswith(head)), 0)


def parse(rows: DataFrame) -> DataFrame:
    """Adds the blocks of a rendered input, its attribute list and the label."""
    lines = F.split("input", "\n")
    info = F.array_position(lines, "Product Information:")
    head = F.when(info > 0, F.slice(lines, F.lit(1), info.cast("int") - 1)).otherwise(lines)
    tail = F.when(info > 0, F.slice(lines, info.cast("int") + 1, F.size(lines))).otherwise(F.array().cast("array<string>"))
    d = rows.withColumns({"_head": head, "_tail": tail})
    d = d.withColumns({b: F.substr(_first_with(h), F.lit(len(h) + 1)) for b, h in zip(BLOCKS, HEADS)})
    pair = lambda x: F.struct(F.trim(F.get(F.split(x, ":", 2), 0)).alias("k"), F.trim(F.get(F.split(x, ":", 2), 1)).alias("v"))
    label = defaults(F.from_json("output", LABEL_SCHEMA), F.try_parse_json("output"))
    d = d.withColumns({"info": F.transform(F.filter("_tail", lambda x: F.contains(x, F.lit(":"))), pair), "label": label, "blocks": F.array(*map(F.lit, BLOCKS))})
    return d.drop("_head", "_tail")


def defaults(label: Column, raw: Column) -> Column:
    """Missing keys get defaults; a key that is there as null keeps it. Other keys than the schema's go."""
    gone = lambda p: F.try_variant_get(raw, "$." + p, "variant").isNull()
    text = lambda c, p: F.when(gone(p), "").otherwise(c)
    a, k = label["availability"], label["key_attributes"]
    return F.struct(
        F.struct(F.when(gone("availability.in_stock"), False).otherwise(a["in_stock"]).alias("in_stock"), a["stock_count"].alias("stock_count")).alias("availability"),
        label["category"].alias("category"), F.when(gone("currency"), "GBP").otherwise(label["currency"]).alias("currency"),
        F.struct(*(k[f].alias(f) for f in ("availability_text", "price_excl_tax", "price_incl_tax", "product_type", "review_count", "tax", "upc"))).alias("key_attributes"),
        label["price"].alias("price"), label["rating"].alias("rating"), text(label["title"], "title").alias("title"),
    )


def render(d: DataFrame) -> DataFrame:
    """input from blocks in their order and the attribute list; output from the label."""
    line = lambda b: F.coalesce(*(F.when(b == n, F.concat(F.lit(h), F.col(n))) for n, h in zip(BLOCKS, HEADS)))
    shown = F.filter(F.transform("blocks", line), lambda x: x.isNotNull())
    items = F.array_join(F.transform("info", lambda x: F.concat(x["k"], F.lit(": "), x["v"])), "\n")
    text = F.concat_ws("\n", shown, F.lit("Product Information:"), F.when(F.size("info") > 0, items).otherwise("(empty)"))
    return d.withColumn("input", F.regexp_replace(text, r"(?U)^\s+|\s+$", "")).withColumn("output", F.to_json("label", {"ignoreNullFields": "false"}))


def sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"(?U)(?<=[。！？.!?])\s+"), collapse), lambda x: x != "")


def _by_hash(c: str, seed: int, what: str, key: Callable[[Column], Column]) -> Column:
    keyed = F.transform(c, lambda x: F.struct(F.sha2(F.concat_ws("~", F.lit(str(seed)), F.col("seq").cast("string"), F.lit(what), key(x)), 256).alias("h"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda x: x["x"])


def _marks(c: Column) -> Column:
    return F.translate(c, "'-£", "’—￡")


def rewrites(seed: int = 42) -> dict[str, tuple[Column, dict[str, Column]]]:
    """strategy -> (whether it applies, new columns)."""
    label, info = F.col("label"), F.col("info")
    no_stock = label.withField("availability.stock_count", F.lit(None).cast("int"))
    desc = F.coalesce(F.col("description"), F.lit("")) != ""
    parts = sentences(F.col("description"))
    half = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.lit(1), F.floor(F.size(parts) / 2).cast("int"))), " ")
    kept = F.slice(info, F.lit(1), F.greatest(F.lit(3), F.floor(F.size(info) / 2).cast("int")))
    gone = F.array_except(F.transform(info, lambda x: x["k"]), F.transform(kept, lambda x: x["k"]))
    keys = sorted((key, name) for name, key in ATTRIBUTES)
    trimmed = let(gone, lambda g: label.withField("key_attributes", F.struct(*(F.when(~F.array_contains(g, name), label["key_attributes"][key]).alias(key) for key, name in keys))))
    priced = F.transform(info, lambda x: F.struct(x["k"].alias("k"), F.when(x["k"].rlike("Price|Tax"), F.replace(x["v"], F.lit("£"), F.lit("GBP "))).otherwise(x["v"]).alias("v")))
    yes = F.lit(True)
    return {
        "shuffle_fields": (yes, {"blocks": _by_hash("blocks", seed, "fields", lambda x: x)}),
        "shuffle_product_information_order": (yes, {"info": _by_hash("info", seed, "info", lambda x: F.concat_ws("~", x["k"], x["v"]))}),
        "drop_category_line": (yes, {"category": F.lit(None).cast("string"), "label": label.withField("category", F.lit(None).cast("string"))}),
        "drop_upc_line": (yes, {"info": F.filter(info, lambda x: x["k"] != "UPC"), "label": label.withField("key_attributes.upc", F.lit(None).cast("string"))}),
        "drop_stock_count_line": (yes, {"availability": F.trim(F.regexp_replace("availability", r"(?i)\(\s*[0-9]+\s+available\s*\)", "")), "label": no_stock}),
        "trim_description": (desc, {"description": F.when(F.char_length("description") < 120, F.col("description")).otherwise(half)}),
        "drop_description_line": (F.col("description").isNotNull(), {"description": F.lit(None).cast("string")}),
        "trim_product_information": (F.size(info) > 3, {"info": kept, "label": trimmed}),
        "special_char_perturb": (yes, {**{c: _marks(F.col(c)) for c in ("title", "availability", "description")}, "info": F.transform(info, lambda x: F.struct(x["k"].alias("k"), _marks(x["v"]).alias("v")))}),
        "pi_numeric_surface_perturb": (F.to_json(priced) != F.to_json(info), {"info": priced}),
        "description_repeat_variant": (desc, {"description": F.concat("description", F.lit(" "), F.coalesce(F.get(parts, 0), F.lit("")))}),
    }


def apply(parsed: DataFrame, strategy: str, seed: int = 42) -> DataFrame:
    """seq, strategy, input, output: one strategy on the rows it applies to."""
    applies, new = rewrites(seed)[strategy]
    return render(parsed.filter(applies).withColumns(new)).select("seq", F.lit(strategy).alias("strategy"), "instruction", "input", "output")


def augment(rows: DataFrame, strategies: list[str], per_row: int = 2, seed: int = 42, dedup: bool = True) -> DataFrame:
    """Originals (strategy null) and at most ``per_row`` rewrites each; without strategies, fields are permuted.

    The strategies of a row that apply are ranked before any text is built, so the rows that
    are rendered are only those that stay.
    """
    names = sorted(set(strategies)) or ["shuffle_fields"]
    rules = rewrites(seed)
    d = parse(rows)
    rank = lambda s: F.sha2(F.concat_ws("~", F.lit(str(seed)), F.col("seq").cast("string"), F.lit(s)), 256)
    options = F.array_compact(F.array(*(F.when(rules[s][0], F.struct(rank(s).alias("h"), F.lit(s).alias("s"))) for s in names)))
    chosen = d.withColumn("strategy", F.explode(F.slice(F.array_sort(options), 1, per_row)))
    chosen = chosen.withColumn("strategy", F.col("strategy.s"))
    new: dict[str, Column] = {}
    for s in names:
        for c, value in rules[s][1].items():
            new[c] = F.when(F.col("strategy") == s, value).otherwise(new.get(c, F.col(c)))
    made = render(chosen.withColumns(new)).select("seq", "strategy", "instruction", "input", "output")
    out = rows.select("seq", F.lit(None).cast("string").alias("strategy"), "instruction", "input", "output").unionByName(made)
    if not dedup:
        return out
    order = F.struct("seq", F.col("strategy").isNotNull(), F.coalesce("strategy", F.lit("")))
    return keep_first(out.withColumn("_order", order), ["instruction", "input", "output"], "_order").drop("_order")


def usage(rows: DataFrame, augmented: DataFrame) -> DataFrame:
    """(strategy, n) of the rewrites that remain."""
    return augmented.filter("strategy is not null").groupBy("strategy").agg(F.count(F.lit(1)).alias("n"))


def coverage(rows: DataFrame, augmented: DataFrame) -> DataFrame:
    """One row: sizes and the share of source rows with a rewrite."""
    n = rows.agg(F.count(F.lit(1)).alias("source_rows"))
    m = augmented.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("strategy").isNotNull()).alias("rewrites"), F.count_distinct(F.when(F.col("strategy").isNotNull(), F.col("seq"))).alias("covered"))
    return n.crossJoin(m).withColumn("coverage_rate", F.coalesce(F.round(F.try_divide("covered", "source_rows"), 4), F.lit(0.0)))  # one row each
