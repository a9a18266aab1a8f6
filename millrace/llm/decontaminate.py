"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts and benchmark items are lower-cased and every run of other characters than letters and
digits, of any script, becomes a blank. An item is cut into windows of ``WINDOW`` characters
(UTF-8 bytes), at most ``STRIDE`` apart and the last at its end, each with an edit budget k of
``RATE`` of its length; an item of up to ``WINDOW`` is one window, its k as large as the bound
below allows. So a verbatim passage of WINDOW + STRIDE - 1 bytes of any item is found.

An occurrence of a window of w characters with at most k edits shares at least
w - q + 1 - k * q of the window's q-grams with the text, on diagonals that differ by at most
k. Shared q-grams of (item, text) are counted in two overlapping sets of bands of 2k
diagonals, so every such run of diagonals lies whole in one band; windows that reach the
bound are verified by alignment about the band, with free ends in the text. A document is
contaminated by an item if any of its windows verifies, and they are at least ``cover`` of the
item's (``COVER``: no least share).

The benchmark is written to the shared folder in slices of at most about ``INDEX_BYTES``, which tasks
read and index, once a Python worker; each slice has a pass of its own over the documents, so a
benchmark of any size fits. None of it goes through the driver.

Defined cases: null or empty text has no hits; items of under ``SHORTEST`` normalised
characters, too short for edits, are found where they stand as they are, between blanks or ends;
items without any letter or digit are not looked for; an item listed twice is reported for each id, a document that
repeats for each row; an empty table on either side gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow.fs import FileSelector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, bound_batches, fresh, give_back, open_fs, table

Q, WINDOW, STRIDE, RATE, COVER, SHORTEST, INDEX_BYTES = 8, 60, 10, 0.1, 0.0, 20, 8 << 20
#: Characters of text looked through at a time; a slice takes some 60 times as much.
TEXT_BYTES = 1 << 19
#: Beyond ASCII, what is no letter or digit; ``_KEEP`` does the rest.
_MARK = re.compile(r"[^\w\x00-\x7f]+")
_KEEP = np.full(256, 32, np.uint8)
for _c in b"abcdefghijklmnopqrstuvwxyz0123456789\x00":
    _KEEP[_c] = _c
_KEEP[128:] = np.arange(128, 256)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MAP_BITS = 22


def normalise(text: str) -> np.ndarray:
    """Bytes of a text, or of several with NUL between them; runs of blanks are one."""
    text = text.lower()
    data = _KEEP[np.frombuffer((text if text.isascii() else _MARK.sub(" ", text)).encode(), np.uint8)]
    blank = data == 32
    keep = np.ones(len(data), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    return data[keep]


def codes(data: np.ndarray) -> np.ndarray:
    """A number for each q-gram; the eight bytes at a place and those up to its end are mixed."""
    n = len(data) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    data = np.ascontiguousarray(data)
    words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    return words[:n] * _MIX + (words[Q - 8 : Q - 8 + n] ^ (words[Q - 8 : Q - 8 + n] >> np.uint64(29)))


class Index:
    def __init__(self, items: list[str]):
        parts, begin, last, edits, self.count, at = [], [], [], [], [], 0
        self.start, owner = [], []
        short: dict[int, dict[bytes, list[int]]] = {}  # by length: items that are looked up as they are
        for i, text in enumerate(items):
            data = normalise(re.sub("\x00", " ", text or ""))
            data = data[(data != 32).argmax() :] if len(data) else data
            data = data[:-1] if len(data) and data[-1] == 32 else data
            size = len(data)
            self.start.append(at)
            w = min(size, WINDOW)
            own = np.append(np.arange(0, size - w, STRIDE), size - w) if size >= SHORTEST else np.zeros(0, np.int64)
            if 0 < size < SHORTEST:
                short.setdefault(size, {}).setdefault(data.tobytes(), []).append(i)
            begin.append(own)
            last.append(own + w - Q)
            edits.append(np.full(len(own), min(int(w * RATE), (w - Q) // Q)))
            self.count.append(len(own))
            parts.append(data)
            owner.append(np.full(size, i, np.int32))
            at += size
        none = np.zeros(0, np.int64)
        # by window: place of the first and of the last q-gram in the item, edits, least number of shared q-grams
        self.begin, self.last, self.edits = (np.concatenate([*x, none]) for x in (begin, last, edits))
        self.least = self.last - self.begin + 1 - self.edits * Q
        self.first_window = np.cumsum([0, *self.count])
        self.need = np.array([self.least[a : a + n].min() if n else 1 << 30 for a, n in zip(self.first_window, self.count)], np.int64)
        self.band = 2 * int(max(1, self.edits.max(initial=1)))
        self.data = np.concatenate([*parts, np.zeros(0, np.uint8)])
        self.owner = np.concatenate([*owner, np.zeros(0, np.int32)])
        self.start, self.count = np.array([*self.start, at]), np.array(self.count, np.int64)
        self.units = [int(n) for n in self.count]
        for found in short.values():  # a short item is one window
            for i in (i for ids in found.values() for i in ids):
                self.units[i] = 1
        places, grams = [], []
        for a, part, n in zip(self.start, parts, self.count):
            c = codes(part) if n else np.zeros(0, np.uint64)
            grams.append(c)
            places.append(a + np.arange(len(c)))
        grams, places = np.concatenate([*grams, np.zeros(0, np.uint64)]), np.concatenate([*places, none]).astype(np.int64)
        order = np.argsort(grams, kind="stable")
        self.places = places[order]
        self.grams, self.first, self.times = np.unique(grams[order], return_index=True, return_counts=True)
        self.short = short
        self.map = np.zeros(1 << _MAP_BITS, bool)
        self.map[self._slot(self.grams)] = True

    @staticmethod
    def _slot(c: np.ndarray) -> np.ndarray:
        return (c * _MIX) >> np.uint64(64 - _MAP_BITS)

    def find(self, texts: list[str]) -> list[tuple[int, int, int]]:
        """(row, item, verified windows) over a few MB of texts."""
        if not len(self.grams) and not self.short:
            return []
        data = normalise("\x00".join(t.replace("\x00", " ") if "\x00" in t else t for t in texts))
        return self._exact(data) + self._near(data)

    def _exact(self, data: np.ndarray) -> list[tuple[int, int, int]]:
        """Short items that stand between blanks or ends."""
        if not self.short:
            return []
        edge = np.flatnonzero(np.concatenate([[True], (data == 32) | (data == 0), [True]]))  # starts of words, and places after their ends
        ends, found = np.flatnonzero(data == 0), set()
        for n, items in self.short.items():
            starts = edge[np.isin(edge + n + 1, edge, assume_unique=True)]
            starts = starts[starts + n <= len(data)]
            if len(starts):
                views = np.ndarray((len(data) - n + 1,), f"S{n}", np.ascontiguousarray(data), strides=(1,))[starts]
                for k in np.flatnonzero(np.isin(views, np.array(list(items), f"S{n}"))).tolist():
                    at = int(starts[k])
                    found |= {(int(np.searchsorted(ends, at)), i) for i in items[data[at : at + n].tobytes()]}
        return [(d, i, 1) for d, i in found]

    def _near(self, data: np.ndarray) -> list[tuple[int, int, int]]:
        if not len(self.grams):
            return []
        c = codes(data)
        at = np.flatnonzero(self.map[self._slot(c)])
        c = c[at]
        row = np.minimum(np.searchsorted(self.grams, c), len(self.grams) - 1)
        real = self.grams[row] == c
        at, row = at[real], row[real]
        n = self.times[row]
        if not n.sum():
            return []
        place = self.places[np.repeat(self.first[row] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        at = np.repeat(at, n)
        item, diagonal = self.owner[place].astype(np.int64), at - place + len(self.data)
        ends = np.flatnonzero(data == 0)
        starts = np.append(0, ends + 1)
        doc, local = np.searchsorted(ends, at), place - self.start[item]
        limits = np.append(ends, len(data))
        found: dict[tuple[int, int], set] = {}
        for shift in (0, self.band // 2):
            for d, i, w, low in self._candidates(item, doc, local, diagonal + shift, shift):
                good = self._occurs(data, starts[d], limits[d], w, self.start[i] + self.begin[w] + low)
                for x, y, z in zip(d[good].tolist(), i[good].tolist(), w[good].tolist()):
                    found.setdefault((x, y), set()).add(z)
        return [(d, i, len(ws)) for (d, i), ws in found.items()]

    def _candidates(self, item: np.ndarray, doc: np.ndarray, local: np.ndarray, diagonal: np.ndarray, shift: int) -> Iterator[tuple]:
        """(document, item, window, lowest diagonal) of windows that reach their bound in a band, in chunks."""
        band = diagonal // self.band
        key = item * (int(band.max()) + 1) + band
        order = np.argsort(key, kind="stable")
        new = np.flatnonzero(np.append(True, np.diff(key[order]) != 0))
        size = np.diff(np.append(new, len(key)))
        enough = size >= self.need[item[order[new]]]
        hits = order[np.repeat(enough, size)]
        hits = hits[np.lexsort((local[hits], doc[hits], key[hits]))]
        if not len(hits):
            return
        # distinct places of the item, by band and document
        group = np.append(True, (np.diff(key[hits]) != 0) | (np.diff(doc[hits]) != 0))
        fresh = group | np.append(True, np.diff(local[hits]) != 0)
        head = hits[group]
        wide = int(np.diff(self.start).max()) + 1
        spots = ((np.cumsum(group) - 1) * wide + local[hits])[fresh]
        size = np.bincount((np.cumsum(group) - 1)[fresh])
        picked = np.flatnonzero(size >= self.need[item[head]])
        for a in range(0, len(picked), 4096):
            g = picked[a : a + 4096]
            i = item[head[g]]
            n = self.count[i]
            g, i, w = np.repeat(g, n), np.repeat(i, n), np.repeat(self.first_window[i] - np.cumsum(n) + n, n) + np.arange(n.sum())
            shared = np.searchsorted(spots, g * wide + self.last[w], "right") - np.searchsorted(spots, g * wide + self.begin[w])
            good = shared >= self.least[w]
            g, i, w = g[good], i[good], w[good]
            low = band[head[g]] * self.band - shift - len(self.data)
            for b in range(0, len(g), 4096):
                c = slice(b, b + 4096)
                yield doc[head[g[c]]], i[c], w[c], low[c]

    def _occurs(self, data: np.ndarray, starts: np.ndarray, limits: np.ndarray, w: np.ndarray, base: np.ndarray) -> np.ndarray:
        """Whether each window is within its edits of a part of the text about its band, by bit-parallel alignment."""
        k, size, n = self.edits[w], self.last[w] - self.begin[w] + Q, len(w)
        place, rows, one = self.start[np.searchsorted(self.first_window, w, "right") - 1] + self.begin[w], np.arange(n), np.uint64(1)
        same = np.zeros((n, 256), np.uint64)  # by byte: the places of the window that hold it
        for row in range(int(size.max())):
            on = rows[size > row]
            same[on, self.data[place[on] + row]] |= one << np.uint64(row)
        plus, minus = np.full(n, ~np.uint64(0)), np.zeros(n, np.uint64)
        top, score, best = (size - 1).astype(np.uint64), size.copy(), size.copy()
        reach = int(k.max())
        for col in range(-reach, int(size.max()) + self.band + reach):
            spot = base + col
            text = np.where((spot >= starts) & (spot < limits), data[np.clip(spot, 0, len(data) - 1)], 0)
            eq = same[rows, text]
            cross = eq | minus
            flat = (((eq & plus) + plus) ^ plus) | eq
            up, down = minus | ~(flat | plus), plus & flat
            score += ((up >> top) & one).astype(np.int64) - ((down >> top) & one).astype(np.int64)
            best = np.minimum(best, score)
            up, down = up << one, down << one  # the first row is zero: an occurrence may begin anywhere
            plus, minus = down | ~(cross | up), up & cross
        return best <= k


def contamination(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, cover: float = COVER, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", index_bytes: int = INDEX_BYTES) -> DataFrame:
    """doc_id, item_id, mark (hash of the text), windows, verified, cover: contaminated documents only."""
    schema = "doc_id long, mark long, item_id long, windows int, verified int, cover double"
    bound_batches(spark)
    out = None
    for uri in _slices(spark, benchmark, item_col, item_text_col, index_bytes):

        def scan(batches: Iterator[pa.RecordBatch], uri=uri) -> Iterator[pa.RecordBatch]:
            give_back()
            ids, index = indexed(uri)
            for batch in batches:
                docs_, marks, rows = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
                found, a, held = [], 0, 0
                for b in range(len(rows)):
                    held += len(rows[b])
                    if held > TEXT_BYTES or b + 1 == len(rows):
                        found += [(a + r, i, n) for r, i, n in index.find(rows[a : b + 1])]
                        a, held = b + 1, 0
                hits = [(docs_[r], marks[r], ids[i], index.units[i], n, n / index.units[i]) for r, i, n in found]
                hits = [h for h in hits if h[5] >= cover]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*hits) if hits else [[]] * 6, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64()))], names=["doc_id", "mark", "item_id", "windows", "verified", "cover"])

        text = F.coalesce(F.col(text_col), F.lit(""))
        found = docs.select(F.col(id_col).cast("long").alias("d"), F.xxhash64(text).alias("m"), text.alias("t")).mapInArrow(scan, schema)
        out = found if out is None else out.unionByName(found)
    return out


@lru_cache(maxsize=1)
def indexed(uri: str) -> tuple[list, Index]:
    """(ids, index) of a slice, read from its files; the last one stays with the worker. Names of slices are never used twice."""
    fs, path = open_fs(uri)
    files = [f.path for f in fs.get_file_info(FileSelector(path)) if f.base_name.endswith(".parquet")]
    rows = [r for f in sorted(files) for r in pq.read_table(fs.open_input_file(f), columns=["i", "t"]).to_pylist()]
    rows.sort(key=lambda r: (r["i"] is None, r["i"] or 0, r["t"]))
    return [r["i"] for r in rows], Index([r["t"] for r in rows])


def _slices(spark: SparkSession, benchmark: DataFrame, item_col: str, text_col: str, index_bytes: int) -> list[str]:
    """Folders of the slices."""
    ws = Workspace(spark, "benchmark")
    items = ws.write(benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(text_col).alias("t")).filter("t is not null"), "items")
    total = items.agg(F.sum(F.octet_length("t")).alias("n")).first()["n"] or 0
    slices = max(1, -(-total // index_bytes))
    for s in range(slices):
        ws.write(items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(slices)) == s), f"slice-{s}")
    return [f"{ws.path}/slice-{s}" for s in range(slices)]


def drop_contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The clean documents with all their columns."""
    ws = Workspace(spark, "decontaminate")
    a, b = fresh(docs, "__hit_doc"), fresh(docs, "__hit_mark")
    hits = ws.write(contamination(spark, docs, benchmark, id_col=id_col, text_col=text_col).select(F.col("doc_id").alias(a), F.col("mark").alias(b)).distinct(), "hits")
    mark = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    return docs.join(hits, F.col(id_col).cast("long").eqNullSafe(F.col(a)) & (mark == F.col(b)), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("mark")
