"""Quality classifier: hashed word and character n-gram vectors, averaged per document, softmax output.

Features are a document's words and its 3- and 4-byte grams (case and marks count), hashed to one
table of BUCKETS vectors. The vectors and the output layer are trained by numpy stochastic gradient
descent on a bounded sample of labelled rows (SAMPLE_ROWS, those of least xxhash64(doc_id), so the
same at every run); every document is then scored over its whole text. Since the output layer is
linear in the mean vector, scoring needs just one number a bucket, the product of vector and layer.

A null or empty text has no features and gets the score of the output layer's bias; without
labelled rows every score is the rate of label 1 assumed then, 0.5. Labels, language, source and id
are no inputs. Repeated rows get equal scores; other columns of the documents are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import common

BUCKETS = 1 << 16
SAMPLE_ROWS = 6000
FACTOR = np.uint64(0x9E3779B97F4A7C15)
BASE = 0x100000001B3
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


PAD = b"\n\n\n"


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n + 1, BASE, np.uint64)
    down = np.full(n + 1, pow(BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def features(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each kind of feature: buckets, and where each text's begin and end in them.

    The last grams of a text reach into its own padding, never into the next text.
    """
    flat = np.frombuffer(PAD.join([*texts, b"", b""]), np.uint8)
    lengths = np.array([len(t) for t in texts])
    lo = np.concatenate([[0], np.cumsum(lengths + len(PAD))[:-1]]).astype(np.int64)
    hi = lo + lengths
    n = len(flat) - 3
    four = flat[:n].astype(np.uint32)
    for i in (1, 2, 3):
        four = four << np.uint32(8) | flat[i : n + i]
    found = [((four >> np.uint32(8)) * np.uint32(0x9E3779B1) >> np.uint32(16), lo, hi), (four * np.uint32(0x85EBCA6B) >> np.uint32(16), lo, hi)]
    up, down = _powers(1 << max(20, (len(flat) - 1).bit_length()))
    running = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum((flat + np.uint64(1)) * up[: len(flat)], out=running[1:])
    space = SPACE[flat]
    starts, stops = np.flatnonzero(~space & np.concatenate([[True], space[:-1]])), np.flatnonzero(space & np.concatenate([[False], ~space[:-1]]))
    words = (running[stops] - running[starts]) * down[starts] * FACTOR >> np.uint64(48)
    return [*found, (words.astype(np.uint32), np.searchsorted(starts, lo), np.searchsorted(starts, hi))]


@dataclass
class Model:
    weights: np.ndarray  # BUCKETS float32 numbers: log-odds of label 1 that each feature adds to the mean
    bias: float

    def scores(self, texts: list[bytes]) -> np.ndarray:
        total, n = np.zeros(len(texts)), np.zeros(len(texts))
        if texts:
            for bucket, lo, hi in features(texts):
                some = np.flatnonzero(hi > lo)
                if len(some):
                    each = np.append(self.weights.take(bucket), np.float32(0))
                    total[some] += np.add.reduceat(each, np.stack([lo[some], hi[some]], axis=1).ravel(), dtype=np.float64)[::2]
                n += hi - lo
        return 1 / (1 + np.exp(-np.clip(total / np.maximum(n, 1) + self.bias, -30, 30)))


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], dim: int = 8, epochs: int = 12, batch: int = 32, rate: float = 60.0, seed: int = 1) -> Model:
    """rows: buckets, counts and label (0 or 1) of each sampled document."""
    if not rows:
        return Model(np.zeros(BUCKETS, np.float32), 0.0)
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (BUCKETS, dim)).astype(np.float32)
    layer, bias = rng.normal(0, 0.5, (dim, 2)).astype(np.float32), np.zeros(2, np.float32)
    steps, step = epochs * -(-len(rows) // batch), 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for i in range(0, len(order), batch):
            chosen = [rows[k] for k in order[i : i + batch]]
            at = np.concatenate([b for b, _, _ in chosen]).astype(np.int64)
            owner = np.repeat(np.arange(len(chosen)), [len(b) for b, _, _ in chosen])
            share = np.concatenate([c / max(1, int(c.sum())) for _, c, _ in chosen]).astype(np.float32)
            mean = np.stack([np.bincount(owner, share * vectors[at, k], len(chosen)) for k in range(dim)], axis=1).astype(np.float32)
            out = mean @ layer + bias
            p = np.exp(out - out.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(chosen)), [y for _, _, y in chosen]] -= 1
            now = rate * (1 - step / steps)
            back = (p @ layer.T)[owner] * share[:, None]
            for k in range(dim):
                vectors[:, k] -= np.float32(now / len(chosen)) * np.bincount(at, back[:, k], BUCKETS).astype(np.float32)
            layer -= np.float32(now / rate / len(chosen)) * (mean.T @ p)
            bias -= np.float32(now / rate / len(chosen)) * p.sum(axis=0)
            step += 1
    return Model((vectors @ (layer[:, 1] - layer[:, 0])), float(bias[1] - bias[0]))


def histograms(rows: DataFrame) -> DataFrame:
    """buckets and counts (little-endian uint16 bytes; counts above its range are its greatest) and label of rows (text, label)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            texts = common.byte_texts(batch.column("text"))
            kinds = features(texts)
            each = [np.unique(np.concatenate([bucket[lo[i] : hi[i]] for bucket, lo, hi in kinds]), return_counts=True) for i in range(len(texts))]
            part = lambda k: pa.array([np.minimum(x[k], 65535).astype("<u2").tobytes() for x in each], pa.binary())
            yield pa.RecordBatch.from_arrays([part(0), part(1), batch.column("label")], names=["buckets", "counts", "label"])

    return rows.select("text", F.col("label").cast("int").alias("label")).mapInArrow(run, "buckets binary, counts binary, label int")


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """docs: doc_id, text; labels: doc_id, label, at most sample_rows of which are used."""
    known = labels.where("label in (0, 1) and doc_id is not null").select("doc_id", "label")
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample_rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # sample_rows bounds it
    found = histograms(texts).orderBy(F.xxhash64("buckets", "counts")).toLocalIterator()  # a partition at a time in the driver's JVM
    return fit([(np.frombuffer(b, "<u2"), np.frombuffer(c, "<u2"), y) for b, c, y in found])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row of docs."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # half a megabyte

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(held.value.scores(common.byte_texts(batch.column("text"))))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def held_out() -> Column:
    """By the id; a row without one is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted; learns from rows that aren't held out."""
    model = train(docs, labels.select("doc_id", F.col("quality").alias("label")).where(~held_out()))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def batch_scores(model: Model, texts: pa.Array) -> pa.Array:
    """The scores of a batch's texts, of which only a slice at a time is copied out of Arrow's memory."""
    parts = common.slices(iter([pa.record_batch({"text": texts})]), "text")
    return pa.array(np.concatenate([np.zeros(0), *(model.scores(common.byte_texts(p.column("text"))) for p in parts)]))


def keep(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of docs, all columns, whose score reaches the threshold."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        return batch_scores(held.value, texts)

    return docs.where(scored("text") >= threshold)
