"""Mixture-controlled packing by deficit round-robin over source queues.

Every window (sequence) of ``window`` ids is filled from the queues in target proportions, and
each id lands in exactly one piece. A queue is a source. ``targets`` are weights by source; by
default they are the sources' shares of all ids, so that every queue drains at the same time.

The drain is defined: where targets differ from the shares, a queue that is empty drops out and
the others go on in the proportions of their own weights. Sources that ``targets`` does not name
come last, once all named ones are empty, in their shares.

1. Map tasks encode whole texts and write ids with each document's place within (task, queue).
   Places over all tasks are running sums over (task, queue) totals, not over documents, so a
   source with a third of all rows is no bottleneck.
2. Windows are grouped in blocks. Ids of all queues are ordered by virtual time, the k-th of a
   queue of weight w at (2k + 1) / 2w; a block takes the next ids of that order. What a queue has
   given before a block follows from the totals and weights alone, in exact integers, so tasks find
   it without each other: that is how deficits carry across partitions.
3. Documents are cut at block bounds, pieces are dealt out by block, and a task runs the
   round-robin inside: each window adds its share to the deficit of every queue that is not empty,
   serves queues whose deficit reaches ``quantum`` ids in turn and carries the rest on.

Only the last sequence can be short. Defined cases: a null text is empty and gives the end id
alone; a null source is a queue, which ``targets`` names None; a weight that is not positive
counts as none; repeated ids are packed row by row; an empty table gives no rows; other columns
are ignored. Names and totals of the sources, a row each, are all that reaches the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace, give_back, partitions, table, vocabulary
from .tokens import text_ids

WINDOW, BLOCK, QUANTUM = 2048, 1024, 64
#: Bytes of ids that go out at a time, and rows that are Python objects at a time.
PART_BYTES, SLICE = 2 << 20, 500
_NULL = "\x00null"
_BITS = 160  # of virtual time: finer than the gap of any two ids of queues below 2**79 ids


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (batch.slice(a, SLICE) for batch in batches for a in range(0, batch.num_rows, SLICE))


class Shares:
    """What each queue has given when the first m ids of the virtual order are out."""

    def __init__(self, totals: list[int], weights: list[int] | None = None):
        """weights: whole numbers above zero; the totals themselves if there are none. An empty queue gives nothing."""
        self.totals, self.weights = totals, [max(1, w) for w in (totals if weights is None else weights)]
        self.n, self._memo, self._near = sum(totals), {}, {}
        self._end = 1 + max((-((-t << _BITS) // w) for t, w in zip(totals, self.weights)), default=0)

    def _at(self, x: int) -> list[int]:
        """Ids out of each queue at virtual time x / 2**_BITS."""
        half = 1 << (_BITS - 1)
        return [min(t, (w * x + half) >> _BITS) for t, w in zip(self.totals, self.weights)]

    def given(self, m: int) -> list[int]:
        if m <= 0:
            return [0] * len(self.totals)
        if m >= self.n:
            return list(self.totals)
        if m not in self._memo:
            lo, hi, out = 0, self._end, None
            while hi - lo > 1:
                mid = (lo + hi) >> 1
                at = self._at(mid)
                if (size := sum(at)) == m:
                    out = at
                    break
                lo, hi = (lo, mid) if size > m else (mid, hi)
            if out is None:
                out, later = self._at(lo), self._at(hi)
                left = m - sum(out)
                for q, (x, y) in enumerate(zip(out, later)):  # ids of the very same time, in the order of queues
                    out[q] += (take := min(left, y - x))
                    left -= take
            if len(self._memo) > 256:
                self._memo.clear()
            self._memo[m] = out
        return self._memo[m]

    def owed(self, m: int) -> list[float]:
        """The deficits at that point: the fractions of an id by which each queue is behind its share, or ahead."""
        given, live = self.given(m), [q for q, t in enumerate(self.totals) if t > self.given(m)[q]]
        if not live:
            return [0.0] * len(given)
        x = sum(given[q] for q in live) / sum(self.weights[q] for q in live)
        return [max(-1.0, min(1.0, w * x - g)) if t > g else 0.0 for t, w, g in zip(self.totals, self.weights, given)]

    def block_of(self, block_ids: int, queue: int, place: int) -> int:
        """The block of an id by its place in its queue; documents come in order, so the last answer is near."""
        b = self._near.get(queue)
        if b is None or not self.given(b * block_ids)[queue] <= place < self.given((b + 2) * block_ids)[queue]:
            b = sum(self._at((place << _BITS) // self.weights[queue])) // block_ids
        b = min(b, -(-self.n // block_ids) - 1)
        while b and self.given(b * block_ids)[queue] > place:
            b -= 1
        while self.given((b + 1) * block_ids)[queue] <= place:
            b += 1
        self._near[queue] = b
        return b


class Tiers:
    """Named sources by their targets, then the others: two ``Shares``, one behind the other."""

    def __init__(self, totals: list[int], targets: list[float] | None = None):
        named = [q for q in range(len(totals)) if targets is None or targets[q] > 0]
        parts = [named, [q for q in range(len(totals)) if q not in set(named)]]
        whole = None if targets is None or not named else max(targets)
        weights = [None if whole is None else [round(targets[q] / whole * (1 << 40)) for q in named], None]
        self.totals, self.n, self.tiers, before = totals, sum(totals), [], 0
        for queues, w in zip(parts, weights):
            shares = Shares([totals[q] for q in queues], w)
            self.tiers.append((queues, shares, before))
            before += shares.n
        self.place = {q: (shares, k, start) for queues, shares, start in self.tiers for k, q in enumerate(queues)}
        self.weights = [0.0] * len(totals)  # of the round-robin: the second tier's are nothing beside the first's
        for tier, (queues, shares, _) in enumerate(self.tiers):
            for q, w in zip(queues, shares.weights):
                self.weights[q] = w / sum(shares.weights) * 1e-12**tier

    def _spread(self, what: str, m: int, zero) -> list:
        out = [zero] * len(self.totals)
        for queues, shares, start in self.tiers:
            for q, v in zip(queues, getattr(shares, what)(m - start)):
                out[q] = v
        return out

    def given(self, m: int) -> list[int]:
        return self._spread("given", m, 0)

    def owed(self, m: int) -> list[float]:
        return self._spread("owed", max(0, m), 0.0)

    def cut(self, block_ids: int, queue: int, start: int, size: int) -> Iterator[tuple[int, int, int]]:
        """(block, start, length) of a document that lies at [start, start + size) of its queue."""
        shares, k, before = self.place[queue]
        at, end = start, start + size
        while at < end:
            b = (before + self._offset(shares, k, at)) // block_ids if before else shares.block_of(block_ids, k, at)
            while shares.given((b + 1) * block_ids - before)[k] <= at:
                b += 1
            while b and shares.given(b * block_ids - before)[k] > at:
                b -= 1
            take = min(end, shares.given((b + 1) * block_ids - before)[k]) - at
            yield b, at, take
            at += take

    @staticmethod
    def _offset(shares: Shares, queue: int, place: int) -> int:
        return sum(shares._at((place << _BITS) // shares.weights[queue]))


def round_robin(quotas: list[int], weights: list[float], deficits: list[float], window: int, quantum: int) -> list[list[tuple[int, int]]]:
    """Windows as lists of (queue, ids). quotas: what each queue gives in all; deficits: carried in."""
    left, debt, weight = np.array(quotas, np.int64), np.array(deficits, float), np.array(weights, float)
    total, out, turn = int(left.sum()), [], 0
    while total:
        room, now = min(window, total), np.zeros(len(left), np.int64)
        live = np.where(left > 0, weight, 0.0)
        debt += live / live.sum() * room
        open_ = np.flatnonzero((debt >= min(quantum, room)) & (left > 0))
        order = np.roll(open_, -int(np.searchsorted(open_, turn))).tolist()
        for q in order:
            now[q] = take = min(int(debt[q]), int(left[q]), room)
            room -= take
            turn = q + 1
            if not room:
                break
        while room:  # what no deficit covers goes to the queue that is owed most
            q = int(np.argmax(np.where(left > now, debt - now, -np.inf)))
            take = min(room, int(left[q] - now[q]), max(quantum, int(debt[q]) - int(now[q])))
            now[q] += take
            room -= take
        left -= now
        debt -= now
        total -= int(now.sum())
        spot = {q: k for k, q in enumerate(order)}
        out.append([(q, int(now[q])) for q in sorted(np.flatnonzero(now).tolist(), key=lambda q: spot.get(q, len(order) + q))])
    return out


def pack(spark: SparkSession, docs: DataFrame, tokenizer: str | None = None, end_id: int = 1, window: int = WINDOW, block: int = BLOCK, quantum: int = QUANTUM, targets: dict | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", with_ids: bool = True) -> DataFrame:
    """A row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source, ids.

    targets: weight by source, see above; ids: little-endian unsigned 32-bit, null unless with_ids.
    """
    ws, tokenizer = Workspace(spark, "packing"), tokenizer or vocabulary()
    source = F.coalesce(F.col(source_col).cast("string"), F.lit(_NULL)) if source_col in docs.columns else F.lit("")
    place = {r["s"]: i for i, r in enumerate(sorted(docs.select(source.alias("s")).distinct().collect()))}  # a row a source
    key = source
    wanted = None if targets is None else [targets.get(None if s == _NULL else s, 0) for s in place]
    count = max(1, len(place))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        ids, seen, task = text_ids(tokenizer), [0] * count, TaskContext.get().partitionId()
        end = np.array([end_id], ids.dtype).tobytes()
        for batch in batches:
            doc, keys, a = batch.column(0), batch.column(2).to_pylist(), 0
            for k, flat, off in ids.encode(batch.column(1).fill_null("")):
                raw, w, rows, queues, at = flat.tobytes(), flat.itemsize, [], [], []
                for x, y, s in zip(off[:-1].tolist(), off[1:].tolist(), keys[a : a + k]):
                    rows.append(raw[x * w : y * w] + end)
                    queues.append(q := place[s])
                    at.append(seen[q])
                    seen[q] += y - x + 1
                n = pa.array(np.diff(off) + 1)
                yield pa.RecordBatch.from_arrays([pa.array([task] * k, pa.int32()), pa.array(queues, pa.int32()), pa.array(at, pa.int64()), n, doc.slice(a, k), pa.array(rows, pa.binary())], names=["task", "queue", "at", "n", "doc", "ids"])
                a += k

    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"), key.alias("key"))
    encoded = ws.write(rows.mapInArrow(encode, "task int, queue int, at long, n long, doc long, ids binary"), "encoded")
    totals_by_task = encoded.groupBy("task", "queue").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("queue").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = ws.write(totals_by_task.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), "bases")
    totals = [0] * count
    for r in bases.groupBy("queue").agg(F.sum("n").alias("n")).collect():  # a row a queue
        totals[r["queue"]] = r["n"]
    n, block_ids = sum(totals), window * block

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        shares, w = Tiers(totals, wanted), text_ids(tokenizer).dtype.itemsize
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())

        def part(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, kinds)], names=["block", "queue", "place", "doc", "start", "size", "ids"])

        for batch in slices(batches):
            out, held = [], 0
            for queue, at, size, doc, ids, base in zip(*(batch.column(k).to_pylist() for k in range(6))):
                for b, start, length in shares.cut(block_ids, queue, base + at, size):
                    x = start - base - at
                    out.append((b, queue, start, doc, x, size, ids[x * w : (x + length) * w]))
                    held += length * w
                    if held > PART_BYTES:
                        yield part(out)
                        out, held = [], 0
            if out:
                yield part(out)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        shares, w, names = Tiers(totals, wanted), text_ids(tokenizer).dtype.itemsize, [None if s == _NULL else s for s in place]

        def windows(b: int, held: list[list[tuple]]) -> pa.RecordBatch:
            first, last = shares.given(b * block_ids), shares.given(min(n, (b + 1) * block_ids))
            owed = shares.owed(b * block_ids)
            out: list[tuple] = []
            at = [[0, 0] for _ in totals]  # next piece of each queue, ids taken of it
            for k, served in enumerate(round_robin([y - x for x, y in zip(first, last)], shares.weights, owed, window, quantum)):
                offset = 0
                for q, want in served:
                    here = at[q]
                    while want:
                        doc, start, size, ids = held[q][here[0]]
                        have = len(ids) // w - here[1]
                        take = min(have, want)
                        part = ids[here[1] * w : (here[1] + take) * w]
                        wide = np.frombuffer(part, f"<u{w}").astype("<u4").tobytes()
                        out.append((doc, start + here[1], take, zlib.crc32(wide), size, b * block + k, offset, names[q], wide if with_ids else None))
                        offset += take
                        want -= take
                        if take == have:
                            here[0], here[1] = here[0] + 1, 0
                        else:
                            here[1] += take
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _PIECE)], names=_NAMES)

        now, held = None, []
        for batch in slices(batches):
            for b, q, doc, start, size, ids in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3, 4, 5, 6))):
                if b != now:
                    if held:
                        yield windows(now, held)
                    now, held = b, [[] for _ in totals]
                held[q].append((doc, start, size, ids))
        if held:
            yield windows(now, held)

    # a row a task and queue: far fewer than documents, so the optimizer may broadcast it by its size
    placed = encoded.join(bases.select("task", "queue", "base"), ["task", "queue"])
    cut = placed.select("queue", "at", "n", "doc", "ids", "base").mapInArrow(pieces, "block long, queue int, place long, doc long, start long, size long, ids binary")
    tasks = max(1, min(max(partitions(spark), -(-n // (8 * block_ids))), -(-n // block_ids)))
    dealt = cut.repartitionById(tasks, (F.col("block") % tasks).cast("int")).sortWithinPartitions("block", "queue", "place")
    return dealt.mapInArrow(fill, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string, ids binary")


_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source", "ids"]
_PIECE = [*[pa.int64()] * 7, pa.string(), pa.binary()]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark, table(spark, sf_dir, "documents"), with_ids=False).drop("source", "ids")
