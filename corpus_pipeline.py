"""Corpus pipeline: quality, exact copies, near copies, benchmark passages, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a
DataFrame, and each works on all that the one before it kept. All but the last return the
columns of documents, whatever further ones there are and whatever their names.

In every stage a null text is an empty one, texts are read whole whatever their length, and an
empty table gives no rows. What stages do with nulls, ties and repeated rows stands in each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm.common import Workspace, table
from millrace.llm.decontaminate import drop_contaminated
from millrace.llm.exact_dedup import drop_copies
from millrace.llm.packing import pack
from millrace.llm.quality import keep_good
from millrace.llm.simhash import drop_near_copies


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (a score under 0.7) go; rows that repeat go or stay together.

    Null labels and ids of labels do not count. With labels of one class, or none, all documents have the
    share of label 1 (0.5 without labels) as their score.
    """
    return keep_good(spark, docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased) the document with the largest id stays; null is the smallest id, and of rows that repeat one stays."""
    return drop_copies(spark, docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash component the document with the smallest id stays; null is the largest id, and of rows that repeat one stays.

    Texts without words have the fingerprint zero and are linked like any other.
    """
    return drop_near_copies(spark, docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with benchmark passages go; a null id is no matter, nor is an item listed twice. Null items count for nothing."""
    return drop_contaminated(spark, docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 ids, their ids included. A null source is a queue of its own; repeated rows are packed each."""
    return pack(spark, docs)


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("decontaminate", clean), ("packing", packed)]

#: A classifier's decisions and token ids are beyond SQL; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    ws = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = ws.write(stage(spark, docs, sf_dir), f"{k}-{name}")
    return docs
