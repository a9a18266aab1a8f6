"""JSON lines and documents, tab-separated logs, pages and encodings."""

from __future__ import annotations

import json
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read(spark: SparkSession, path: str, schema: str, mode: str = "FAILFAST", missing_ok: bool = True, non_empty: bool = False) -> DataFrame:
    """FAILFAST raises on a malformed line, DROPMALFORMED skips it; blank lines never count."""
    if not exists(spark, path):
        if not missing_ok or non_empty:
            raise FileNotFoundError(path)
        return spark.createDataFrame([], schema)
    d = spark.read.schema(schema).option("mode", mode).json(path)
    if non_empty and d.isEmpty():
        raise ValueError(f"{path} has no rows")
    return d


def read_ordered(spark: SparkSession, path: str, schema: str, corrupt: str | None = None) -> DataFrame:
    """With seq, the place of each line: files come in order of their names, blank lines do not count.

    A line that is no JSON raises. So does a field of the wrong type, unless ``corrupt`` names a column
    for the text of such lines. A file is read in blocks, each by one task: a line's place is that of
    its block, a running sum over the counts of blocks, and its place in there.
    """
    block = ["_file", "_block"]
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")).filter(F.trim("value") != "").withColumn("_at", F.monotonically_increasing_id())
    blocks = lines.groupBy(*block).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = F.sum("_n").over(Window.orderBy(*block).rowsBetween(Window.unboundedPreceding, -1))  # a row a block
    placed = lines.join(blocks.withColumn("_base", F.coalesce(before, F.lit(0))), block).withColumn("seq", F.col("_base") + F.col("_at") - F.col("_first"))
    if corrupt is None:
        return placed.select("seq", F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("seq", "r.*")
    checked = F.when(F.try_parse_json("value").isNull(), F.raise_error(F.concat(F.lit("no JSON: "), F.substring("value", 1, 200)))).otherwise(F.col("value"))
    read = F.from_json(checked, f"{schema}, `{corrupt}` string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt})
    return placed.select("seq", read.alias("r")).select("seq", "r.*")


def write(df: DataFrame, path: str, order: str | None = None, single: bool = False) -> int:
    """Overwrite; returns the rows written. Ordered rows go to files of a range each, in order of their names.

    single: one file, written by one task; for results known to be small.
    """
    from pyspark.sql import Observation

    seen, d = Observation("rows"), df
    if single:
        d = d.coalesce(1)
    if order:
        d = d.sortWithinPartitions(order) if single else d.orderBy(order)
    d = d.observe(seen, F.count(F.lit(1)).alias("n"))  # behind the sort, whose sampling reads what is before it twice
    if order:
        d = d.drop(order)
    d.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    return seen.get["n"]


def read_document(spark: SparkSession, path: str) -> dict:
    """One JSON document of a file, for reports."""
    return json.loads("\n".join(r["value"] for r in spark.read.option("wholetext", True).text(path).collect()))


def write_document(report: dict, path: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(report, f, ensure_ascii=False, sort_keys=True, indent=2)


def append_log(df: DataFrame, path: str) -> None:
    """Tab-separated lines of url and reason, as failed and blocked addresses are kept."""
    df.write.mode("append").option("sep", "\t").csv(path)


def write_pages(pages: DataFrame, path: str) -> None:
    """Raw pages keyed by the SHA-256 of their address, in a table rather than a file each."""
    pages.withColumn("name", F.concat(F.sha2("url", 256), F.lit(".html"))).write.mode("append").parquet(path)


# Declared encodings that say nothing, as servers send them by default.
UNTOLD = ("", "iso-8859-1", "latin-1", "latin1")


@F.arrow_udf(StringType())
def _decode_as(content: pa.Array, declared: pa.Array) -> pa.Array:
    out = []
    for raw, name in zip(content.to_pylist(), declared.to_pylist()):
        try:
            out.append(None if raw is None or name is None else raw.decode(name, "replace"))
        except LookupError:  # no such encoding: as if none were declared
            out.append(None)
    return pa.array(out, pa.string())


def decode(content: Column, declared: Column | None = None) -> Column:
    """Bytes to text: by the declared encoding, if it is known and not the default Latin-1; else UTF-8 if valid, else Latin-1.

    Rows without such a declaration reach Python as nulls.
    """
    plain = F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1"))
    if declared is None:
        return plain
    name = F.lower(F.trim(declared))
    told = declared.isNotNull() & ~name.isin(*UNTOLD, "utf-8", "utf8")
    return F.coalesce(F.when(told, _decode_as(F.when(told, content), F.when(told, name))), plain)


def head(df: DataFrame, n: int | None, order: str) -> DataFrame:
    return df if n is None else df.orderBy(order).limit(max(0, n))
