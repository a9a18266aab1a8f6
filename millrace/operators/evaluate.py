"""Field-level evaluation of predicted labels against gold ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import jsonx as J
from ..functions.rows import keep_where
from ..schemas import LEAVES, NUMERIC_4, RATES
from .profile import nearest_rank, safe_rate


def name(path: str) -> str:
    return path.replace(".", "_")


def evaluate(rows: DataFrame, gold: str = "gold_text", raw: str = "raw_response") -> DataFrame:
    """idx, parse and schema outcomes, a match flag a leaf, absolute errors. Rows with unparsable gold are not evaluated."""
    d = rows.withColumns({"_g": J.as_object(F.col(gold)), "_p": J.lenient_object(F.col(raw))}).filter("_g is not null")
    d = d.withColumns({"_bad": J.schema_error("_p"), "parse_ok": F.col("_p").isNotNull(), "_gl": J.leaves("_g"), "_pl": J.leaves("_p")})
    d = d.withColumns({"error_reason": F.coalesce(J.parse_error(F.col(raw), F.col("_p")), "_bad"), "schema_ok": F.col("parse_ok") & F.col("_bad").isNull()})
    out = [F.expr(f"coalesce(parse_ok AND {J.equal_sql('_gl.' + name(p), '_pl.' + name(p))}, false) AS match_{name(p)}") for p in LEAVES]
    out += [F.expr(f"CASE WHEN parse_ok THEN abs(_pl.{name(p)}.number - _gl.{name(p)}.number) END AS error_{name(p)}") for p in NUMERIC_4]
    return d.select("idx", "parse_ok", "schema_ok", "error_reason", *out)


def metrics(evaluated: DataFrame) -> DataFrame:
    """One row: rates over all evaluated rows, error statistics of four numeric leaves."""
    n = F.count(F.lit(1))
    rate = lambda flag: safe_rate(F.count_if(flag), n)
    out = [n.alias("total"), rate("parse_ok").alias("json_parse_rate"), rate("schema_ok").alias("schema_valid_rate")]
    out += [rate("match_" + name(p)).alias(r) for p, r in zip(LEAVES, RATES)]
    for p in NUMERIC_4:
        e, short = "error_" + name(p), p.rpartition(".")[2]
        out += [F.round(F.avg(e), 4).alias(f"{short}_abs_error_avg"), F.round(nearest_rank(e, 0.5), 4).alias(f"{short}_abs_error_p50"), F.round(nearest_rank(e, 0.95), 4).alias(f"{short}_abs_error_p95")]
    return evaluated.agg(*out)


def failure_reasons(evaluated: DataFrame, most: int = 10) -> DataFrame:
    g = keep_where(evaluated, "error_reason", lambda r: r.isNotNull()).groupBy("error_reason").agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("first"))
    return g.orderBy(F.desc("n"), "first").limit(most).select("error_reason", "n")


def failure_samples(evaluated: DataFrame, most: int = 10) -> DataFrame:
    return keep_where(evaluated, "error_reason", lambda r: r.isNotNull()).orderBy("idx").limit(most).select("idx", "error_reason")
