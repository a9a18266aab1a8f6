"""Comparison of two metric tables (metric, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEADLINE = ("json_parse_rate", "schema_valid_rate")


def family(metric):
    return F.when(metric.isin(*HEADLINE), "headline").when(F.contains(metric, F.lit("_abs_error_")), "numeric").otherwise("field")


def long_table(one_row: DataFrame) -> DataFrame:
    """Columns of a one-row report as (metric, value)."""
    pairs = F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in one_row.columns if c != "total"))
    return one_row.select(F.explode(pairs).alias("x")).select("x.*")


def diff(baseline: DataFrame, other: DataFrame) -> DataFrame:
    """Every metric of either; errors improve downwards, rates upwards, and a tie improves."""
    b, o = baseline.select("metric", F.col("value").alias("baseline")), other.select("metric", F.col("value").alias("other"))
    d = b.join(o, "metric", "full_outer").withColumn("delta", F.round(F.col("other") - F.col("baseline"), 4)).withColumn("family", family(F.col("metric")))
    return d.withColumn("improved", F.when(F.col("family") == "numeric", F.col("delta") <= 0).otherwise(F.col("delta") >= 0))


def headline(d: DataFrame) -> DataFrame:
    return d.filter("family = 'headline'")


def wins(d: DataFrame) -> DataFrame:
    """Metrics that improved and those that did not, by family; metric names are a bounded set."""
    pick = lambda good: F.array_sort(F.collect_list(F.when(F.col("improved") == good, F.col("metric"))))
    return d.filter("delta is not null").groupBy("family").agg(pick(True).alias("wins"), pick(False).alias("losses"))


def top_improvements(d: DataFrame, most: int = 5) -> DataFrame:
    good = d.filter("delta is not null and not isnan(delta) and family <> 'headline'")
    part = lambda f, key: good.filter(F.col("family") == f).orderBy(key, "metric").limit(most)
    return part("field", F.desc("delta")).unionByName(part("numeric", F.asc("delta"))).select("family", "metric", "delta")


def report(d: DataFrame) -> dict:
    """The assembled comparison, on the driver: a row a metric."""
    rows = sorted((r.asDict() for r in d.collect()), key=lambda r: r["metric"])
    best = sorted((r.asDict() for r in top_improvements(d).collect()), key=lambda r: (r["family"], -r["delta"] if r["family"] == "field" else r["delta"], r["metric"]))
    won = {r["family"]: {"wins": r["wins"], "losses": r["losses"]} for r in wins(d).collect()}
    head = {r["metric"]: r["delta"] for r in rows if r["family"] == "headline"}
    told = ", ".join(f"{k} {v:+.4f}" for k, v in head.items() if v is not None)
    return {"metrics": rows, "headline": head, "wins": won, "top_improvements": best, "summary": f"{sum(bool(r['improved']) for r in rows)} of {len(rows)} metrics did not get worse; {told or 'no headline metric'}."}


def markdown(rep: dict) -> str:
    """The comparison as a table."""
    show = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    lines = ["# Comparison", "", rep["summary"], "", "| metric | baseline | other | delta | improved |", "|---|---|---|---|---|"]
    lines += [f"| {r['metric']} | {show(r['baseline'])} | {show(r['other'])} | {show(r['delta'])} | {show(r['improved'])} |" for r in rep["metrics"]]
    lines += ["", "## Largest improvements", ""] + [f"- {r['metric']}: {r['delta']:+.4f}" for r in rep["top_improvements"]]
    return "\n".join(lines) + "\n"
