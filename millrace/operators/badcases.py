"""Analysis of bad cases: aligned by position, tagged, typed and sampled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jsonx as J
from ..functions.rows import keep_where
from ..functions.text import let
from ..schemas import LEAVES, NUMERIC_7
from .evaluate import name
from .profile import nearest_rank, safe_rate
from .split import first_per_group

TOLERANCE, LONG_INPUT = 1e-9, 1200


def align(gold: DataFrame, pred: DataFrame, order: str = "pos") -> DataFrame:
    """Rows of the same place; what has no partner goes. ``idx`` of the prediction plays no part."""
    p = pred.select(order, *[F.col(c).alias("pred_" + c) for c in pred.columns if c != order])
    return gold.join(p, order)


def tolerant_sql(g: str, p: str) -> str:
    """Within the tolerance; two values that are no numbers are equal, one alone is not."""
    return f"(CASE WHEN {g}.number IS NULL AND {p}.number IS NULL THEN true WHEN {g}.number IS NULL OR {p}.number IS NULL THEN false ELSE abs({g}.number - {p}.number) <= {TOLERANCE} END)"


def analyze(rows: DataFrame, long_input: int = LONG_INPUT) -> DataFrame:
    """rows: pos, input, gold_text, pred_text, raw_response, parse_ok, schema_ok. Adds all but drops none."""
    d = rows.withColumns({"_g": J.as_object(F.col("gold_text")), "_p": let(J.as_object(F.col("pred_text")), lambda v: F.when(F.to_json(v) != "{}", v)), "parse_ok": F.coalesce("parse_ok", F.lit(False)), "schema_ok": F.coalesce("schema_ok", F.lit(False))})
    d = d.withColumns({"_gl": J.leaves("_g"), "_pl": J.leaves("_p"), "gold_ok": F.col("_g").isNotNull()})
    same = {p: (tolerant_sql if p in NUMERIC_7 else J.equal_sql)("_gl." + name(p), "_pl." + name(p)) for p in LEAVES}
    d = d.withColumns({f"_same_{name(p)}": F.expr(same[p]) for p in LEAVES})
    wrong = F.expr("array_compact(array(" + ", ".join(f"CASE WHEN NOT _same_{name(p)} THEN '{p}' END" for p in LEAVES) + "))")
    d = d.withColumn("mismatch_fields", F.when(F.col("gold_ok"), wrong).otherwise(F.array().cast("array<string>")))
    gold_category = F.coalesce(F.col("_gl.category.text"), F.lit(""))
    tags = F.array_compact(F.array(
        F.when(F.char_length("input") > long_input, "long_input"), F.when(F.col("input").rlike(r"[^\x00-\x7F]"), "has_non_ascii"), F.when(~F.col("parse_ok"), "parse_fail"),
        F.when(~F.col("schema_ok"), "schema_fail"), F.when(F.col("gold_ok") & (gold_category == ""), "missing_category"),
    ))
    errors = {"error_" + name(p): F.expr(f"CASE WHEN gold_ok THEN abs(_pl.{name(p)}.number - _gl.{name(p)}.number) END") for p in NUMERIC_7}
    flags = {"same_" + name(p): F.expr(f"gold_ok AND _same_{name(p)}") for p in LEAVES}
    d = d.withColumns({"bucket_tags": tags, "error_type": error_type(), "is_badcase": (F.size("mismatch_fields") > 0) | ~F.col("parse_ok") | ~F.col("schema_ok"), **errors, **flags})
    return d.drop(*[c for c in d.columns if c.startswith("_")])


def error_type() -> Column:
    """Ordered rules over the columns of ``analyze``."""
    bad, raw = F.col("mismatch_fields"), F.coalesce(F.col("raw_response"), F.lit(""))
    has = lambda *fields: F.exists(bad, lambda f: f.isin(*fields))
    null = lambda p: F.col(f"_pl.{name(p)}.family") == "null"
    return (
        F.when(~F.col("parse_ok"), F.when((raw != "") & ~F.contains(raw, F.lit("}")), "truncation_suspected").otherwise("extraction_error"))
        .when(~F.col("schema_ok"), "type_error").when(F.size(bad) >= 4, "multi_field_error")
        .when((has("category") & null("category")) | (has("availability.stock_count") & null("availability.stock_count")), "null_handling_error")
        .when(F.exists(bad, lambda f: F.contains(f, F.lit("price")) | F.contains(f, F.lit("tax"))), "normalization_error")
        .when(has("title", "key_attributes.product_type"), "hallucination").otherwise("extraction_error")
    )


def badcases(analyzed: DataFrame) -> DataFrame:
    return keep_where(analyzed, "is_badcase", lambda b: b).select("pos", F.substring("input", 1, 500).alias("input_preview"), "gold_text", "pred_text", "mismatch_fields", "bucket_tags", "error_type")


def summary(analyzed: DataFrame) -> DataFrame:
    """One row; field rates are over rows with parsable gold."""
    n, g = F.count(F.lit(1)), F.count_if("gold_ok")
    out = [n.alias("total"), F.count_if("is_badcase").alias("badcases"), safe_rate(F.count_if("is_badcase"), n).alias("badcase_rate"), safe_rate(F.count_if("parse_ok"), n).alias("parse_rate"), safe_rate(F.count_if("schema_ok"), n).alias("schema_rate")]
    out += [safe_rate(F.count_if("same_" + name(p)), g).alias("accuracy_" + name(p)) for p in LEAVES]
    for p in NUMERIC_7:
        e = "error_" + name(p)
        out += [F.round(F.avg(e), 6).alias(e + "_avg"), F.round(nearest_rank(e, 0.5), 6).alias(e + "_p50"), F.round(nearest_rank(e, 0.95), 6).alias(e + "_p95")]
    return analyzed.agg(*out)


def tag_counts(analyzed: DataFrame) -> DataFrame:
    return analyzed.select(F.explode("bucket_tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def top_error_types(analyzed: DataFrame, most: int = 10) -> DataFrame:
    """Counted over every aligned row, good ones too."""
    g = analyzed.groupBy("error_type").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))
    return g.orderBy(F.desc("n"), "first").limit(most).select("error_type", "n")


def samples_by_type(analyzed: DataFrame, most: int = 3) -> DataFrame:
    return first_per_group(keep_where(analyzed, "is_badcase", lambda b: b), "error_type", "pos", most).select("error_type", "pos", "mismatch_fields")
