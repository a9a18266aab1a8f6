"""The build plan: products to instruction rows, splits and a quality report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import profile as P
from ..operators import sanitize as S
from ..operators import split as G
from ..schemas import DROP_REASONS, FIXES
from ..workspace import Workspace


def prepared_rows(products: DataFrame, strict: bool = True, drop_default: bool = False, by: str = "upc", val_ratio: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """(all records with their fate, accepted ones with their split)."""
    prepared = S.sanitize(products, strict, drop_default)
    rows = S.accepted(prepared).withColumn("upc", F.col("key_attributes.upc"))
    return prepared, G.split(rows, by, val_ratio)


def build(products: DataFrame, strict: bool = True, drop_default: bool = False, by: str = "upc", val_ratio: float = 0.05) -> tuple[DataFrame, DataFrame, dict]:
    """(train, val, report). The prepared records are written to the shared folder once, as all of the report reads them."""
    ws = Workspace(products.sparkSession, "build")
    prepared = ws.write(S.sanitize(products, strict, drop_default), "prepared")
    rows = G.split(S.accepted(prepared).withColumn("upc", F.col("key_attributes.upc")), by, val_ratio)
    rows = ws.write(rows, "accepted")
    one = lambda d: d.first().asDict()
    drops = {r["drop_reason"]: r["n"] for r in S.drop_counts(prepared).collect()}
    fixes = one(S.fix_counts(prepared))
    read, written = prepared.count(), rows.count()
    usage = {r["key_source"]: r["count"] for r in rows.groupBy("key_source").count().collect()}
    stats = one(P.dataset_stats(rows))
    splits: dict = {}
    for r in P.split_report(rows).collect():  # ten rows a split
        splits.setdefault(r["split"], {"count": r["rows"], "top_categories": {}})["top_categories"][r["value"]] = r["n"]
    report = {
        "total_read": read, "total_written": written, "dropped_count": read - written, "strict": strict, "category_missing_count": fixes["category_default_to_null"] or 0,
        "drop_reasons": {k: drops.get(k, 0) for k in DROP_REASONS}, "fixes_applied": {k: fixes[k] or 0 for k in FIXES}, "text_quality": one(P.text_quality(prepared)),
        "output_quality": {"stable_json_serialization_enabled": True, "schema_valid_rate": round(written / read, 4) if read else 0.0},
        "label_quality": {"rating_distribution": {str(k): stats.pop(f"rating_{k}") for k in (1, 2, 3, 4, 5, "null")}, "rating_out_of_range_count": fixes["rating_out_of_range_count"] or 0, "rating_mismatch_count": fixes["rating_mismatch_count"] or 0},
        "stats": stats | {"top_categories": {r["value"]: r["n"] for r in P.top_k(rows, "category").collect()}},
        "sample_badcases": [r.asDict() for r in S.drop_samples(prepared).collect()], "sample_dedup_cases": [r.asDict() for r in S.dedup_samples(prepared).collect()],
        "split_config": {"enabled": val_ratio > 0, "split_by": by, "val_ratio": val_ratio, "upc_samples_count": usage.get("upc", 0), "product_url_fallback_count": usage.get("product_url", 0)},
        "splits": splits, "rating_audit": [r.asDict() for r in G.audit_sample(rows.select(S.shown_url(), "raw_rating_text", "rating")).collect()],
    }
    columns = ["seq", "instruction", "input", "output"]
    return rows.filter("split = 'train'").select(*columns), rows.filter("split = 'val'").select(*columns), report


def document_slice(documents: DataFrame) -> DataFrame:
    """Normalise, keep the first of equal texts, split by hash, and profile each split and language."""
    from ..functions.text import collapse

    d = documents.select("doc_id", "lang", collapse(F.col("text")).alias("t"))
    d = d.groupBy(F.sha2("t", 256).alias("h")).agg(F.min_by(F.struct("doc_id", "lang", F.char_length("t").alias("n")), "doc_id").alias("r")).select("h", "r.*")
    d = d.withColumn("split", F.when(F.conv(F.substring("h", 1, 8), 16, 10).cast("bigint") % 100 < 5, "val").otherwise("train"))
    return d.groupBy("split", "lang").agg(F.count(F.lit(1)).alias("docs"), F.round(F.avg("n"), 2).alias("mean_chars"), P.nearest_rank("n", 0.5, whole=True).alias("p50"), P.nearest_rank("n", 0.95, whole=True).alias("p95"))
