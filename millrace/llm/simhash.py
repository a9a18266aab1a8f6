"""SimHash near-dedup: a byte-position inverted index with count filtering.

Fingerprint: texts are lower-cased (A-Z), cut into words at ASCII white space and into shingles
of four words (a shorter text is one shingle, no words give zero); bit i is 1 if it is set in
over half of the shingles' XXH64 (seed 42).

Two fingerprints of 8 bytes that differ in at most 4 bits share at least 4 positional bytes.
A posting list of a single positional byte holds 1/256 of all fingerprints, so the lists are
kept for groups of three positions: the 20 triples below meet every set of 4 positions, so
each linked pair shares a list. Within a list the shared positional bytes of a pair are
tallied, pairs that reach 4 are retained, and their differing bits counted.

Equal fingerprints are one entry. A list only has to keep its members connected, not show
every pair: it is searched breadth first over what is not yet reached. A list of more than
``list_rows`` is cut into blocks, and every pair of blocks is a unit of work of its own, so
no list lands in one task and no pair is lost. Links are contracted within tasks, then by
alternating large-star and small-star rounds, each written to the shared folder.

Defined cases: null text is empty; component_id is the smallest doc_id of the component
(nulls last); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, filter_rows, give_back, join_by_weight, partitions, table, without

BITS, SHARED = 4, 4
LIST_ROWS = 8192
#: Bit spread: byte -> 8 counters, the most significant bit first.
SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).reshape(-1).view(np.uint64)


def triples() -> list[tuple[int, ...]]:
    """20 triples of 8 positions that meet every set of 4 in a whole triple.

    Three classes of positions in a ring: a triple within a class, or two of a class and one
    of the next. Any 4 positions hold one such triple.
    """
    ring = [c for c in range(3) for _ in range(3)][:8]
    out = []
    for t in combinations(range(8), 3):
        n = [sum(ring[p] == c for p in t) for c in range(3)]
        if 3 in n or any(n[c] == 2 and n[(c + 1) % 3] == 1 for c in range(3)):
            out.append(t)
    assert all(any(set(t) <= set(s) for t in out) for s in combinations(range(8), SHARED))
    return out


def fingerprint(texts: list[bytes]) -> np.ndarray:
    """uint64 fingerprints of raw UTF-8 texts."""
    digest, hashes, counts = xxhash.xxh64_digest, [], []
    for text in texts:
        words = text.lower().split()
        if not words:
            counts.append(0)
            continue
        joined = b" ".join(words)
        gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
        starts, ends = np.append(0, gaps + 1), np.append(gaps, len(joined))
        n = max(1, len(words) - 3)
        hashes.append(b"".join([digest(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), ends[min(3, len(words) - 1) :].tolist())]))
        counts.append(n)
    count = np.array(counts, np.int64)
    out = np.zeros(len(texts), np.uint64)
    if not count.any():
        return out
    raw = np.frombuffer(b"".join(hashes), np.uint8).reshape(-1, 8)
    full = np.flatnonzero(count)
    first = np.cumsum(count[full]) - count[full]
    # sums of at most 255 rows fit the 8-bit counters; chunks are then summed by text
    chunks = [np.arange(a, a + n, 255) for a, n in zip(first.tolist(), count[full].tolist())]
    at = np.concatenate(chunks)
    by_text = np.cumsum([0, *map(len, chunks[:-1])])
    bits = np.empty((len(full), 64), bool)
    for k in range(8):
        sums = np.add.reduceat(SPREAD[raw[:, k]], at).view(np.uint8).reshape(-1, 8)
        bits[:, 8 * k : 8 * k + 8] = np.add.reduceat(sums.astype(np.uint32), by_text, axis=0) * 2 > count[full, None]
    out[full] = np.packbits(bits, axis=1).view(">u8").reshape(-1)
    return out


def linked(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Tally shared positional bytes, retain pairs with enough, and verify those."""
    x = a ^ b
    tally = (np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8) == 0).sum(1)
    out = tally >= SHARED
    kept = np.flatnonzero(out)
    out[kept] = np.bitwise_count(x[kept]) <= BITS
    return out


def forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """Links that keep a list's members as connected as all of its links do."""
    rest, out = fps, []
    while len(rest) > 1:
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            p = frontier.pop()
            near = linked(rest, np.broadcast_to(p, rest.shape))
            if near.any():
                hit = rest[near]
                out += [(int(p), x) for x in hit.tolist()]
                frontier += list(hit)
                rest = rest[~near]
    return out


class Union:
    """Union-find over the links of a task; the smallest member leads."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up, top = self.up, x
        while (p := up.get(top, top)) != top:
            top = p
        while x != top:
            up[x], x = top, up.get(x, x)
        return top

    def link(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def stars(self) -> list[tuple[int, int]]:
        return [(x, self.find(x)) for x in list(self.up)]


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of sorted (key, unit, fp) rows, contracted in the task."""
    found, left = Union(), None

    def out() -> pa.RecordBatch:
        s = np.array(found.stars(), np.uint64).reshape(-1, 2).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(s[:, 0]), pa.array(s[:, 1])], names=["u", "v"])

    def search(key: np.ndarray, unit: np.ndarray, fp: np.ndarray) -> None:
        new = np.flatnonzero((key[1:] != key[:-1]) | (unit[1:] != unit[:-1])) + 1
        at = np.append(0, new)
        size = np.diff(np.append(at, len(key)))
        group = np.repeat(np.arange(len(at)), size)
        small = np.flatnonzero(np.repeat(size <= 8, size) & np.repeat(size > 1, size))
        g, f = group[small], fp[small]
        for d in range(1, min(8, len(small))):
            same = np.flatnonzero(g[d:] == g[:-d])
            if not len(same):
                break
            same = same[linked(f[same], f[same + d])]
            for a, b in zip(f[same].tolist(), f[same + d].tolist()):
                found.link(a, b)
        for k in np.flatnonzero(size > 8).tolist():
            for a, b in forest(fp[at[k] : at[k] + size[k]]):
                found.link(a, b)

    for batch in batches:
        key, unit, fp = (batch.column(k).to_numpy() for k in range(3))
        fp = fp.view(np.uint64)
        if left is not None:
            key, unit, fp = (np.concatenate(x) for x in zip(left, (key, unit, fp)))
        if not len(key):
            continue
        last = np.flatnonzero((key != key[-1]) | (unit != unit[-1]))
        cut = int(last[-1]) + 1 if len(last) else 0  # the last list may go on in the next batch
        if cut:
            search(key[:cut], unit[:cut], fp[:cut])
        left = key[cut:], unit[cut:], fp[cut:]
        if len(found.up) > 500_000:
            yield out()
            found = Union()
    if left is not None and len(left[0]):
        search(*left)
    yield out()


def components(ws: Workspace, links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(u, v): each linked node but the smallest of its component, and that smallest one."""
    sign = lambda e: e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    edges = ws.write(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "links")
    now = sign(edges)
    for k in range(most_rounds):
        if not now[0]:
            return edges
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = ws.write(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n")), f"least-{k}")
        large = join_by_weight(both, least, ["u"], "n", 2 * now[0]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = ws.write(large, f"large-{k}")
        small = ws.write(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), f"small-{k}")
        met = join_by_weight(large, small, ["u"], "n", large.count())
        joined = met.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = ws.write(joined.select("e.u", "e.v").filter("u <> v").distinct(), f"round-{k}")
        if (then := sign(edges)) == now:
            return edges
        now = then
    raise RuntimeError("the components did not settle")


def near_dedup(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", list_rows: int = LIST_ROWS) -> DataFrame:
    """doc_id, fingerprint, component_id, and for stages: mark (hash of the text), keep."""
    ws = Workspace(spark, "simhash")

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                fps = fingerprint(part.column(2).to_pylist()).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(fps)], names=["doc", "mark", "fp"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = ws.write(docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text).alias("mark"), text.cast("binary").alias("t")).mapInArrow(prints, "doc long, mark long, fp long"), "prints")
    # nulls last: a struct whose first field tells null ids apart
    first = F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "mark"))
    nodes = ws.write(rows.groupBy("fp").agg(first.alias("first"), F.count(F.lit(1)).alias("copies")), "nodes")
    distinct, total = nodes.agg(F.count(F.lit(1)), F.coalesce(F.sum("copies"), F.lit(0))).first()
    sets = triples()
    byte = lambda p: F.shiftrightunsigned("fp", 56 - 8 * p).bitwiseAND(F.lit(255))
    key = lambda i, s: reduce(lambda x, p: x * 256 + byte(p), s, F.lit(i).cast("long"))
    lists = nodes.select("fp", F.explode(F.array(*(key(i, s) for i, s in enumerate(sets)))).alias("key"))
    hot = ws.write(lists.groupBy("key").count().filter(F.col("count") > list_rows).select("key", "count", F.ceil(F.col("count") / list_rows).cast("int").alias("blocks")), "hot")
    own = F.pmod(F.xxhash64("fp", F.lit("block")), F.col("blocks")).cast("int")
    split = join_by_weight(lists, hot, ["key"], "count", distinct * len(sets)).withColumn("own", own)
    split = split.select("key", "fp", "blocks", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).filter((F.col("own") != F.col("other")) | (F.col("blocks") == 1))
    pair = (F.least("own", "other") * F.col("blocks") + F.greatest("own", "other") + 1).cast("int")
    plain = without(lists, hot, ["key"], "count", distinct * len(sets))
    units = plain.select("key", F.lit(0).alias("unit"), "fp").unionByName(split.select("key", pair.alias("unit"), "fp"))
    links = units.repartition(partitions(spark), "key", "unit").sortWithinPartitions("key", "unit").mapInArrow(_search, "u long, v long")
    stars = components(ws, links)
    member = stars.select(F.col("u").alias("fp"), F.col("v").alias("top")).unionByName(stars.select(F.col("v").alias("fp"), F.col("v").alias("top")).distinct())
    member = member.join(nodes, "fp")
    member = ws.write(member, "members")
    tops = ws.write(member.groupBy("top").agg(F.min("first").alias("lead"), F.count(F.lit(1)).alias("n")), "tops")
    led = ws.write(join_by_weight(member.select("fp", "top"), tops, ["top"], "n", member.count()).select("fp", "lead"), "led")
    of = ws.write(nodes.join(led, "fp", "left").select("fp", "copies", F.coalesce("lead", "first").alias("lead")), "of")
    return join_by_weight(rows, of, ["fp"], "copies", total).select(
        F.col("doc").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("lead.doc").alias("component_id"),
        "mark",
        (F.col("doc").eqNullSafe(F.col("lead.doc")) & (F.col("mark") == F.col("lead.mark"))).alias("keep"),
    )


def drop_near_copies(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, the one with the smallest doc_id, with all its columns."""
    found = near_dedup(spark, docs, id_col, text_col)
    return filter_rows(Workspace(spark, "simhash-drop"), docs, found.select(F.col("doc_id").alias("doc"), "mark", "keep"), id_col, text_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(spark, table(spark, sf_dir, "documents")).drop("mark", "keep")
