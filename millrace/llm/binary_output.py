"""Length-delimited binary records of token ids with an offset index.

File format, little-endian. A shard holds ids of ``width`` bytes, one record a document:

    uint64 payload length | uint32 masked CRC-32 of those 8 bytes | payload | uint32 masked CRC-32 of the payload

payload: int64 doc_id, uint8 whether doc_id is null, uint8 width, ids. The mask rotates a
checksum right by 15 bits and adds a constant, so that checksums of data that hold checksums
stay useful. Beside ``shard-N.rec`` lies ``shard-N.idx``: for each record int64 byte offset,
int64 ids before it in the shard. Any record can thus be read alone, in any order.

Shards follow each other in ascending doc_id order, and so do their records; equal ids are
ordered by a hash of their text, then by their token bytes. Rows without an id come first, in the
order of that hash, in as many shards as their share asks for. Shard bounds are quantiles of doc_id, found from
that column alone; ids are encoded before the shuffle, which then moves 2 bytes an id.
A task writes to a name of its own and renames at the end, so a repeated attempt is harmless.

Defined cases: a null or empty text is a record of the end id alone; an empty table writes
nothing and returns no rows; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Workspace, give_back, open_fs, partitions, table, vocabulary
from .tokens import text_ids

MASK = 0xA282EAD8
HEAD, CRC, ENTRY = "<Q", "<I", "<qq"
#: Documents a shard at most.
SHARD_ROWS = 250_000


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack(HEAD, len(payload))
    return b"".join((head, struct.pack(CRC, masked(head)), payload, struct.pack(CRC, masked(payload))))


def unframe(f) -> bytes | None:
    """The next record of an open file; None at its end. Raises on damage."""
    if not (head := f.read(8)):
        return None
    crc = f.read(4)
    if len(head) < 8 or len(crc) < 4 or struct.unpack(CRC, crc)[0] != masked(head):
        raise ValueError("damaged length")
    (n,) = struct.unpack(HEAD, head)
    payload, crc = f.read(n), f.read(4)
    if len(payload) < n or len(crc) < 4 or struct.unpack(CRC, crc)[0] != masked(payload):
        raise ValueError("damaged record")
    return payload


def write_records(spark: SparkSession, docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the shards; return (shard, uri, records, ids), a row a shard, in order."""
    n, named = docs.agg(F.count(F.lit(1)).alias("n"), F.count(F.col(id_col).cast("long")).alias("named")).first()
    shards = max(1, min(partitions(spark), -(-n // 64)), -(-n // SHARD_ROWS))
    nulls = -(-(n - named) * shards // n) if n else 0  # shards of rows without an id, dealt by hash
    at = [i / shards for i in range(1, shards)]
    bounds = docs.agg(F.percentile_approx(F.col(id_col).cast("long"), at, max(10_000, 10 * shards)).alias("b")).first()["b"] if at else []
    bounds = np.array(sorted(set(bounds or [])), np.int64)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        ids = text_ids(tokenizer)
        end = np.array([end_id], ids.dtype).tobytes()
        for batch in batches:
            doc, a = batch.column(0), 0
            for k, flat, off in ids.encode(batch.column(1).fill_null("")):
                d, mark = doc.slice(a, k), batch.column(2).slice(a, k)
                place = (mark.to_numpy().view(np.uint64) >> np.uint64(32)) ^ np.uint64(1 << 31)  # in order of the signed hash
                shard = np.where(d.is_null().to_numpy(zero_copy_only=False), (place * np.uint64(max(1, nulls))) >> np.uint64(32), nulls + np.searchsorted(bounds, d.fill_null(0).to_numpy(), "left")).astype(np.int32)
                raw, w = flat.tobytes(), flat.itemsize
                out = [raw[x * w : y * w] + end for x, y in zip(off[:-1].tolist(), off[1:].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(shard), d, mark, pa.array(out, pa.binary())], names=["shard", "doc", "mark", "ids"])
                a += k

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width, done, now = text_ids(tokenizer).dtype.itemsize, [], None
        rec = idx = None

        def close() -> None:
            rec.close()
            idx.close()
            for kind in ("rec", "idx"):
                fs, path = open_fs(f"{folder}/shard-{now:08d}.{kind}")
                fs.move(f"{path}.{mark}", path)
            done.append((now, f"{folder}/shard-{now:08d}", records, total))

        for batch in batches:
            for shard, doc, ids in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3))):
                if shard != now:
                    if rec:
                        close()
                    now, mark, at, records, total = shard, uuid.uuid4().hex, 0, 0, 0
                    fs, path = open_fs(f"{folder}/shard-{now:08d}.rec")
                    rec, idx = (fs.open_output_stream(f"{p}.{mark}", buffer_size=1 << 20) for p in (path, path[:-4] + ".idx"))
                framed = frame(struct.pack("<qBB", doc or 0, doc is None, width) + ids)
                rec.write(framed)
                idx.write(struct.pack(ENTRY, at, total))
                at, records, total = at + len(framed), records + 1, total + len(ids) // width
        if rec:
            close()
        cols = [pa.array([d[k] for d in done], t) for k, t in enumerate((pa.int32(), pa.string(), pa.int64(), pa.int64()))]
        yield pa.RecordBatch.from_arrays(cols, names=["shard", "uri", "records", "ids"])

    encoded = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("mark")).mapInArrow(encode, "shard int, doc long, mark long, ids binary")
    dealt = encoded.repartitionById(nulls + len(bounds) + 1, F.col("shard")).sortWithinPartitions("shard", F.col("doc").asc_nulls_first(), "mark", "ids")
    return dealt.mapInArrow(write, "shard int, uri string, records long, ids long")


def read_records(spark: SparkSession, shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) read back from the files of ``shards``, a task a few shards."""
    rows = sorted(shards.collect(), key=lambda r: r["shard"])  # a row a shard of up to SHARD_ROWS documents
    base, todo = 0, []
    for r in rows:
        todo.append((r["uri"], r["records"], base))
        base += r["ids"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, records, before in zip(*(batch.column(k).to_pylist() for k in range(3))):
                fs, path = open_fs(uri)
                with fs.open_input_stream(path + ".idx") as f:
                    index = np.frombuffer(f.read(), "<i8").reshape(-1, 2)
                if len(index) != records:
                    raise ValueError(f"{uri}: the index has {len(index)} records of {records}")
                out: list[tuple] = []
                with fs.open_input_stream(path + ".rec", buffer_size=1 << 20) as f:
                    at = 0
                    for offset, start in index.tolist():
                        if offset != at:
                            raise ValueError(f"{uri}: the index points to {offset}, the record is at {at}")
                        payload = unframe(f)
                        at += len(payload) + 16
                        doc, null, width = struct.unpack_from("<qBB", payload)
                        ids = np.frombuffer(payload, f"<u{width}", offset=10)
                        out.append((None if null else doc, before + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        if len(out) == 20_000:
                            yield _batch(out)
                            out = []
                if out:
                    yield _batch(out)

    # a file list of a few bytes a shard; each row becomes a task of its own
    listed = spark.createDataFrame(todo, "uri string, records long, base long").repartitionByRange(max(1, len(todo)), "base") if todo else spark.createDataFrame([], "uri string, records long, base long")
    return listed.mapInArrow(read, T.StructType([T.StructField(c, T.LongType()) for c in ("doc_id", "start", "n_tokens", "ids_crc32")]))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_one(uri: str, record: int) -> tuple[int | None, np.ndarray]:
    """One record by the offset index: a shuffled read."""
    fs, path = open_fs(uri)
    with fs.open_input_file(path + ".idx") as f:
        f.seek(record * struct.calcsize(ENTRY))
        offset, _ = struct.unpack(ENTRY, f.read(struct.calcsize(ENTRY)))
    with fs.open_input_file(path + ".rec") as f:
        f.seek(offset)
        payload = unframe(f)
    doc, null, width = struct.unpack_from("<qBB", payload)
    return None if null else doc, np.frombuffer(payload, f"<u{width}", offset=10)


def binary_output(spark: SparkSession, docs: DataFrame, tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    ws = Workspace(spark, "records")
    folder = ws.mkdirs("shards")
    written = ws.write(write_records(spark, docs, folder, tokenizer or vocabulary(), end_id), "written")
    return read_records(spark, written)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary_output(spark, table(spark, sf_dir, "documents"))
