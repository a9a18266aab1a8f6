"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of a whole text (shares of byte classes, of distinct words and lines, lengths) are
binned at quantiles; trees of fixed depth grow on gradient histograms of the log loss, and are
flattened into arrays in heap order that numpy walks for a batch of documents at once.

Labels are learnt only from rows whose crc32(doc_id as text) mod 4 is not 2. Training uses the
``sample`` labelled documents with the smallest hash of their id, a documented bound; all
documents are scored. Defined cases: a null text is empty and is scored like any other;
repeated labels of an id count as their mean; under 2 * ``LEAST`` labelled rows, the least rows of
a leaf (a quarter of all) and the shrinkage are less in proportion; with fewer than two classes to learn from, the
score is the share of label 1 (0.5 without labels); documents that repeat are scored each;
an empty table gives no rows. Only the text enters a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, table

THRESHOLD, SAMPLE = 0.7, 12_000
#: Texts that are Python strings at a time.
SLICE = 500
TREES, DEPTH, BINS, RATE, L2, LEAST = 60, 4, 64, 0.15, 5.0, 20

_SETS = {"lower": "abcdefghijklmnopqrstuvwxyz", "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": "0123456789", "blank": " \t", "line": "\n", "stop": ".", "comma": ",", "bang": "!?", "bar": "|", "symbol": "#$%&*+=<>@^~\\", "bracket": "()[]{}", "quote": "\"'`", "join": "-_/:;"}
_CLASS = np.zeros((256, len(_SETS) + 1), np.float32)
for _k, _chars in enumerate(_SETS.values()):
    _CLASS[[ord(c) for c in _chars], _k] = 1
_CLASS[128:, -1] = 1


def statistics(texts: list[str | None]) -> np.ndarray:
    """A row of float32 statistics for each text."""
    n = len(texts)
    hist, more = np.zeros((n, 256), np.float32), np.zeros((n, 9), np.float32)
    for i, text in enumerate(texts):
        if not text:
            continue
        raw = np.frombuffer(text.encode(), np.uint8)
        hist[i] = np.bincount(raw, minlength=256)
        words, lines = text.split(), text.split("\n")
        w, distinct, own = len(words), set(words), set(lines)
        more[i] = (np.log1p(len(raw)), w, len(distinct) / max(1, w), len(raw) / max(1, w), len(lines), len(own) / len(lines), sum(map(len, own)) / max(1, len(text) - len(lines) + 1), max(map(len, lines)), max(map(len, distinct), default=0))
    counts = hist @ _CLASS
    size, words = np.maximum(1, counts.sum(1, keepdims=True)), np.maximum(1, more[:, 1:2])
    top = hist / size
    spread = -(top * np.log(np.maximum(top, 1e-9))).sum(1, keepdims=True)
    per_word = counts[:, [1, 5, 6, 7, 8, 9, 12]] / words
    return np.concatenate([counts / size, per_word, more, spread, more[:, 1:2] / np.maximum(1, more[:, 4:5])], axis=1)


class Trees:
    """Boosted trees flattened by level: node i of a tree has children 2i + 1 and 2i + 2."""

    def __init__(self, base: float, feature: np.ndarray, cut: np.ndarray, value: np.ndarray):
        self.base, self.feature, self.cut, self.value = base, feature, cut, value

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        if self.feature.size:
            rows, trees = np.arange(len(x))[:, None], np.arange(len(self.feature))[None, :]
            node = np.zeros((len(x), len(self.feature)), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.cut[trees, node])
            out = out + self.value[trees, node - (2**DEPTH - 1)].sum(1)
        return 1 / (1 + np.exp(-out))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    empty = Trees(0.0, np.zeros((0, 0), np.int64), np.zeros((0, 0)), np.zeros((0, 0)))
    if not len(y):
        return empty
    p = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    empty.base = np.log(p / (1 - p))
    if (y >= 0.5).all() or (y < 0.5).all():
        return empty
    least, l2 = (LEAST, L2) if len(y) >= 2 * LEAST else (max(1, len(y) // 4), L2 * len(y) / (2 * LEAST))
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS)[1:-1])) for j in range(m)]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)
    flat = binned + np.arange(m) * BINS
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    feature, cut, value = np.zeros((TREES, inner), np.int64), np.full((TREES, inner), np.inf), np.zeros((TREES, leaves))
    raw = np.full(n, empty.base)
    for t in range(TREES):
        prob = 1 / (1 + np.exp(-raw))
        grad, hess = y - prob, prob * (1 - prob)
        node = np.zeros(n, np.int64)
        for level in range(DEPTH):
            width, start = 2**level, 2**level - 1
            at = ((node - start)[:, None] * (m * BINS) + flat).ravel()
            g, h, c = (np.bincount(at, np.repeat(v, m) if v is not None else None, width * m * BINS).reshape(width, m, BINS).cumsum(2) for v in (grad, hess, None))
            gt, ht, ct = g[:, :, -1:], h[:, :, -1:], c[:, :, -1:]
            gain = g**2 / (h + l2) + (gt - g) ** 2 / (ht - h + l2) - gt**2 / (ht + l2)
            gain[(c < least) | (ct - c < least)] = 0
            best = gain.reshape(width, -1).argmax(1)
            for k in range(width):
                if gain[k].flat[best[k]] > 1e-6:
                    j, b = divmod(int(best[k]), BINS)
                    if b < len(edges[j]):
                        feature[t, start + k], cut[t, start + k] = j, edges[j][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > cut[t, node])
        leaf = node - inner
        value[t] = RATE * np.bincount(leaf, grad, leaves) / (np.bincount(leaf, hess, leaves) + l2)
        raw += value[t, leaf]
    return Trees(empty.base, feature, cut, value)


def held_out(doc):
    return F.coalesce(F.crc32(F.col(doc).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Trees:
    """At most ``sample`` labelled documents reach the driver, as rows of statistics."""
    bound_batches(docs.sparkSession)
    learn = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    learn = learn.groupBy(F.col("doc_id").cast("long").alias("__doc")).agg(F.avg("quality").alias("y"))
    picked = learn.orderBy(F.xxhash64("__doc"), "__doc").limit(sample)  # a bounded side: at most `sample` rows of two numbers
    texts = docs.select(F.col(id_col).cast("long").alias("__doc"), F.col(text_col).alias("t"))
    rows = texts.join(F.broadcast(picked), "__doc").select("__doc", "t", "y")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (batch.slice(a, SLICE) for batch in batches for a in range(0, batch.num_rows, SLICE)):
            x = statistics(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(x), pa.list_(pa.float32())), b.column(2)], names=["doc", "x", "y"])

    found = rows.mapInArrow(measure, "doc long, x array<float>, y double").dropDuplicates(["doc"]).toArrow()
    if not found.num_rows:
        return fit(np.zeros((0, 1), np.float32), np.zeros(0))
    doc = found.column("doc").to_numpy()
    x = found.column("x").combine_chunks().flatten().to_numpy().reshape(len(doc), -1)
    order = np.argsort(doc, kind="stable")
    return fit(x[order], found.column("y").to_numpy()[order])


def score(docs: DataFrame, model: Trees, text_col: str = "text") -> DataFrame:
    """``docs`` without their text, with column __score (in place of one of that name); the text leaves in the same pass."""
    rest = [c for c in docs.columns if c not in (text_col, "__score")]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, SLICE):
                b = batch.slice(a, SLICE)
                s = model.score(statistics(b.column(0).to_pylist()))
                yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(s)], names=[*rest, "__score"])

    return docs.select(F.col(text_col), *rest).mapInArrow(run, f"{schema + ', ' if rest else ''}__score double")


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    model = train(docs, labels, sample)
    scored = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= threshold).cast("int").alias("predicted"))


def keep_good(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with a score of ``threshold`` or more, with all their columns.

    Only the text goes to Python, in slices of ``SLICE`` rows; null texts are empty, rows that repeat
    are kept or dropped together, an empty table gives no rows, and columns of any name stay.
    """
    model = train(docs, labels)

    @F.arrow_udf("double")
    def good(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            parts = [model.score(statistics(batch.slice(a, SLICE).to_pylist())) for a in range(0, len(batch), SLICE)]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return docs.filter(good(F.coalesce(F.col("text"), F.lit(""))) >= threshold)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
