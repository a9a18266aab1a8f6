"""Exact dedup by an extendible-hash index whose bucket files lie in the shared folder.

Texts are equal when identical after lower-casing A-Z only; a null text counts as empty.

1. Every row gets a 64-bit hash of its normalised text. The weight of each of 2**depth hash
   cells (bytes of distinct hashes) plans the directory: an overfull bucket splits in two, and
   the directory doubles when a bucket grows deeper than it. Only cell weights reach the
   driver: some eight a bucket of ``BUCKET_BYTES``, and never over 2**MAX_DEPTH, as buckets are
   larger where all texts have over 4 TB.
2. Equal texts meet inside each map task first, so a text that fills a third of the table
   travels once a task. Owner tasks take contiguous ranges of directory slots in hash order,
   chain the distinct texts of a hash and compare their bytes, and write their buckets.
3. Rows look their class up by hash and digest; only classes of two or more rows are joined,
   those with over a thousandth of all rows by a bounded broadcast, so that no text gathers its rows.

Defined cases: of equal texts the row with the largest doc_id stays (null is smallest); if the
same doc_id repeats with that text, one of those rows stays. An empty table gives no rows.
Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import HOT_ROWS, HOT_SHARE, Workspace, ascii_lower, filter_rows, give_back, partitions, table, text_of

#: Bytes of distinct texts that a bucket holds before it splits; buckets hold more where there would be over 2**(MAX_DEPTH - 2).
BUCKET_BYTES, MAX_DEPTH = 16 << 20, 20
#: Bytes of texts that a map task holds to merge equal ones before it passes them on.
COMBINE_BYTES = 24 << 20


class Directory:
    """Slots of an extendible hash table over the top bits of the hash."""

    def __init__(self, weights: dict[int, int], capacity: int, max_depth: int):
        self.depth, self.slots, self.buckets = 0, [0], [(0, 0)]  # bucket: (prefix, local depth)
        self._weights, self._max = weights, max_depth
        todo = [0]
        while todo:
            b = todo.pop()
            prefix, local = self.buckets[b]
            if local < max_depth and self._weight(prefix, local) > capacity:
                todo += self._split(b)

    def _weight(self, prefix: int, local: int) -> int:
        if not hasattr(self, "_levels"):
            self._levels = {self._max: dict(self._weights)}
            for level in range(self._max - 1, -1, -1):
                up: dict[int, int] = {}
                for cell, w in self._levels[level + 1].items():
                    up[cell >> 1] = up.get(cell >> 1, 0) + w
                self._levels[level] = up
        return self._levels[local].get(prefix, 0)

    def _split(self, b: int) -> list[int]:
        prefix, local = self.buckets[b]
        if local == self.depth:  # the directory doubles
            self.slots = [x for x in self.slots for _ in (0, 1)]
            self.depth += 1
        self.buckets[b] = (prefix * 2, local + 1)
        self.buckets.append((prefix * 2 + 1, local + 1))
        new, span = len(self.buckets) - 1, 1 << (self.depth - local - 1)
        at = (prefix * 2 + 1) * span
        self.slots[at : at + span] = [new] * span
        return [b, new]

    def owners(self, tasks: int) -> list[int]:
        """Owner task of each slot: contiguous ranges of whole buckets of about equal weight."""
        order = sorted(range(len(self.buckets)), key=lambda b: self.buckets[b][0] << (self._max - self.buckets[b][1]))
        total, seen, owner = max(1, self._weight(0, 0)), 0, {}
        for b in order:
            owner[b] = min(tasks - 1, seen * tasks // total)
            seen += self._weight(*self.buckets[b])
        return [owner[b] for b in self.slots]


def _merge_in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (h, text, keep, size, ties) with equal texts merged within the task, flushed by bytes."""
    give_back()
    held: dict[bytes, list] = {}
    size = 0

    def out() -> pa.RecordBatch:
        rows = list(held.values())
        cols = [[r[0] for r in rows], list(held), *([r[k] for r in rows] for k in (1, 2, 3))]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()))], names=["h", "text", "keep", "size", "ties"])

    for batch in batches:
        for h, text, doc in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if (row := held.get(text)) is None:
                held[text] = [h, doc, 1, 1]
                size += len(text) + 200
                if size > COMBINE_BYTES:
                    yield out()
                    held, size = {}, 0
            else:
                _take(row, doc, 1, 1)
    if held:
        yield out()


def _take(row: list, doc: int | None, size: int, ties: int) -> None:
    """Merge another part of the class into [h, keep, size, ties]; null is the smallest id."""
    row[2] += size
    if doc == row[1]:
        row[3] += ties
    elif doc is not None and (row[1] is None or doc > row[1]):
        row[1], row[3] = doc, ties


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by hash. The chain of a hash holds its distinct texts, told apart by their bytes."""
    names, kinds = ["h", "chain", "text_sha256", "keep_id", "group_size", "ties"], (pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64())
    chain: list[tuple[bytes, list]] = []
    rows: list[tuple] = []
    now = None

    def close() -> None:
        digests = [hashlib.sha256(t).hexdigest() for t, _ in chain]
        if len(set(digests)) < len(digests):
            raise ValueError("two texts share both hashes")
        rows.extend((now, k, d, r[1], r[2], r[3]) for k, (d, (_, r)) in enumerate(zip(digests, chain)))

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    for batch in batches:
        for h, text, keep, size, ties in zip(*(batch.column(k).to_pylist() for k in range(5))):
            if h != now:
                if chain:
                    close()
                now, chain = h, []
            for held, row in chain:
                if held == text:
                    _take(row, keep, size, ties)
                    break
            else:
                chain.append((text, [h, keep, size, ties]))
        if len(rows) > 20_000:
            yield out()
            rows = []
    if chain:
        close()
    if rows:
        yield out()


def build_index(spark: SparkSession, docs: DataFrame, ws: Workspace, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, DataFrame, Directory]:
    """(keys: a row for each document, entries: a row for each distinct text, directory)."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text_of(text_col)).alias("mark"), ascii_lower(text_of(text_col)).alias("t")).withColumn("h", F.xxhash64("t"))
    keys = ws.write(texts.select("doc", "mark", "h", F.sha2("t", 256).alias("sha"), F.octet_length("t").alias("bytes"), F.monotonically_increasing_id().alias("rid")), "keys")
    total = keys.agg(F.sum(F.col("bytes") + 200)).first()[0] or 0
    bucket_bytes = max(bucket_bytes, total >> (MAX_DEPTH - 2))
    max_depth = max(1, min(MAX_DEPTH, (total // bucket_bytes).bit_length() + 3))  # cells are finer than buckets, as some split more often
    cell = F.shiftrightunsigned("h", 64 - max_depth).cast("int")
    cells = keys.groupBy("h").agg(F.max("bytes").alias("bytes")).groupBy(cell.alias("cell")).agg(F.sum(F.col("bytes") + 200).alias("w"))
    directory = Directory({r["cell"]: r["w"] for r in cells.collect()}, bucket_bytes, max_depth)
    tasks = max(partitions(spark), 1)
    owner = F.get(F.lit(directory.owners(tasks)), (F.shiftrightunsigned("h", 64 - directory.depth) if directory.depth else F.lit(0)).cast("int"))
    merged = texts.select("h", F.col("t").cast("binary").alias("t"), "doc").mapInArrow(_merge_in_task, "h long, text binary, keep long, size long, ties long")
    owned = merged.repartitionById(tasks, owner).sortWithinPartitions("h")
    entries = ws.write(owned.mapInArrow(_own, "h long, chain int, text_sha256 string, keep_id long, group_size long, ties long"), "buckets")
    return keys, entries, directory


def exact_dedup(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, mark: a row for each document, dropped ones too.

    mark, the hash of the raw text, is what stages tell rows by beside the id.
    """
    ws = Workspace(spark, "exact-dedup")
    keys, entries, _ = build_index(spark, docs, ws, id_col, text_col)
    many = entries.filter("group_size > 1").select("h", F.col("text_sha256").alias("sha"), "keep_id", "group_size", "ties")
    # hot classes meet their rows where they lie; what is left goes by hash
    heavy = F.col("group_size") > max(HOT_ROWS, int(keys.count() * HOT_SHARE))
    hot = F.broadcast(many.filter(heavy))
    cold = keys.join(F.broadcast(many.filter(heavy).select("h", "sha")), ["h", "sha"], "left_anti").join(many.filter(~heavy), ["h", "sha"], "left")
    rows = keys.join(hot, ["h", "sha"]).unionByName(cold).withColumn("_first", F.lit(True))
    if not many.filter("ties > 1").isEmpty():  # the same id repeats with the same text: one row of those stays
        first = keys.join(many.filter("ties > 1"), ["h", "sha"], "left_semi").groupBy("h", "sha", F.col("doc").alias("d")).agg(F.min("rid").alias("first"))
        rows = rows.join(first.withColumnsRenamed({"h": "h2", "sha": "sha2"}), (F.col("h") == F.col("h2")) & (F.col("sha") == F.col("sha2")) & F.col("doc").eqNullSafe(F.col("d")), "left")
        rows = rows.withColumn("_first", F.coalesce(F.col("rid") == F.col("first"), F.lit(True)))
    grouped = F.col("group_size").isNotNull()
    return rows.select(
        F.col("doc").alias("doc_id"),
        F.when(grouped, F.col("keep_id")).otherwise(F.col("doc")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast(T.LongType())).alias("group_size"),
        F.when(grouped, F.col("doc").eqNullSafe(F.col("keep_id")) & F.col("_first")).otherwise(F.lit(True)).alias("kept"),
        F.col("sha").alias("text_sha256"),
        "mark",
    )


def drop_copies(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns."""
    found = exact_dedup(spark, docs, id_col, text_col)
    fate = found.select(F.col("doc_id").alias("doc"), "mark", F.col("kept").alias("keep"))
    return filter_rows(Workspace(spark, "exact-drop"), docs, fate, id_col, text_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark, table(spark, sf_dir, "documents")).drop("mark")


SQL = f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{"ABCDEFGHIJKLMNOPQRSTUVWXYZ"}', '{"abcdefghijklmnopqrstuvwxyz"}') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""
