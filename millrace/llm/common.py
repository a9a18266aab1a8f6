"""What the training-data operators share: materialised steps, joins by weight and tokenizers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workspace import Workspace as _Workspace

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of an Arrow batch on its way to a Python worker; the JVM and the worker hold a few such at a time.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Hold the session's Arrow batches to ``BATCH_BYTES``, whatever a row's size; a smaller bound stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key)
    if now.startswith("-") or spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(now) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


class Workspace(_Workspace):
    """A fresh folder in the shared root, for operators that send batches to Python too."""

    def __init__(self, spark: SparkSession, label: str):
        super().__init__(spark, label)
        bound_batches(spark)


def give_back() -> None:
    """Return to the system what earlier tasks of this Python worker freed; workers live on, and allocators keep it otherwise."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def open_fs(uri: str):
    """(file system, path) of a URI, for files that tasks read and write themselves."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(col):
    """Lower-case A-Z and nothing else."""
    return F.translate(col, UPPER, LOWER)


def text_of(col):
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Default path of a public tokenizer's file; operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: A key is hot if it has over this share of all rows, and this many at least: there are at most 1 / HOT_SHARE such keys.
HOT_SHARE, HOT_ROWS = 1 / 1000, 100


def join_by_weight(rows: DataFrame, side: DataFrame, on: list[str], weight: str, total: int) -> DataFrame:
    """``rows`` joined to ``side``, a row a key with the number of rows of that key in ``weight``.

    The rows of hot keys meet a broadcast of at most 1 / HOT_SHARE keys where they lie, the others are
    shuffled; so no key gathers its rows in one task, whatever its size.
    """
    hot, cold = _by_weight(side, weight, total)
    here = rows.join(F.broadcast(hot), on)
    rest = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold, on)
    return here.unionByName(rest)


def without(rows: DataFrame, side: DataFrame, on: list[str], weight: str, total: int) -> DataFrame:
    """The rows of ``rows`` whose key ``side`` lacks, with the same care for hot keys."""
    hot, cold = _by_weight(side, weight, total)
    return rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold.select(*on), on, "left_anti")


def _by_weight(side: DataFrame, weight: str, total: int) -> tuple[DataFrame, DataFrame]:
    heavy = F.col(weight) > max(HOT_ROWS, int(total * HOT_SHARE))
    return side.filter(heavy).drop(weight), side.filter(~heavy).drop(weight)


def fresh(docs: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``docs`` has."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def filter_rows(ws: Workspace, docs: DataFrame, fate: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` that ``fate`` (doc, mark, keep; a row for each of them) keeps, all columns.

    mark is the hash of the raw text, null as empty. A row is told by id and text; of rows that
    repeat both, one stays. Only the rows to drop are joined, by shuffle or, if small, broadcast.
    """
    by = ws.write(fate.groupBy("doc", "mark").agg(F.max("keep").alias("keep"), F.count(F.lit(1)).alias("n")).filter("not keep or n > 1"), "fate")
    a, b = fresh(docs, "__fate_doc"), fresh(docs, "__fate_mark")
    mark = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    same = F.col(id_col).cast("long").eqNullSafe(F.col(a)) & (mark == F.col(b))
    out = docs.join(by.filter("not keep").select(F.col("doc").alias(a), F.col("mark").alias(b)), same, "left_anti")
    twice = by.filter("keep").select(F.col("doc").alias(a), F.col("mark").alias(b))
    if twice.isEmpty():
        return out
    one = out.join(twice, same, "left_semi").withColumn(b, mark).dropDuplicates([id_col, b]).drop(b)
    return out.join(twice, same, "left_anti").unionByName(one)
