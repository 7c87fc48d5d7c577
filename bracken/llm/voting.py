"""Quality by nearest-neighbour voting in a latent-semantic space.

A text's terms are its byte trigrams, hashed to ``TERMS`` buckets, and ``MARKS`` for what trigrams cannot
see: words in repeated three-word windows, repeated lines, words all in capitals, and the size of the
text in powers of two. Counts are damped by logarithm, weighted by inverse document frequency and
projected on the leading singular vectors of the labelled sample (a randomised range finder and an
exact decomposition inside it). The labelled vectors, at most twice ``SAMPLE`` of ``DIMENSIONS`` numbers and so at
most two megabytes, are broadcast; every document's cosines with all of them are computed in blocks, exactly,
and its ``NEIGHBOURS`` nearest vote with their similarity as weight.

Labels are learned only from ids that are not held out, at most ``SAMPLE`` ids and, as ids may repeat, twice as
many rows, by hash of the id. Defined
results: null and empty texts have the vector of their marks alone and are scored; with no labels every
score is 0.5; rows with equal ids are scored on their own; an id with two labels counts as its larger.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, rules
from .common import small

TERMS = 4096
MARKS = 24
DIMENSIONS = 64
SAMPLE = 4000
NEIGHBOURS = 15
#: Similarities are raised to this power before they weight votes.
SHARPNESS = 4
BLOCK = 1024

_MIX = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35], np.uint32)


def counts(text: bytes | None) -> np.ndarray:
    """Counts of the text's terms and marks."""
    out = np.zeros(TERMS + MARKS, np.float32)
    words = text.split() if text else []
    n = len(words)
    out[TERMS + 8 + min(15, n.bit_length())] = 4
    if not n:
        return out
    b = np.frombuffer(text, np.uint8).astype(np.uint32)
    if len(b) > 2:
        h = b[:-2] * _MIX[0] + b[1:-1] * _MIX[1] + b[2:] * _MIX[2]
        out[:TERMS] = np.bincount((h ^ (h >> np.uint32(15))) % np.uint32(TERMS), minlength=TERMS)
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    lines = [x for x in text.split(b"\n") if x]
    out[TERMS] = rules.repeated_words(ids)
    out[TERMS + 1] = 4 * (len(lines) - len(set(lines)))
    out[TERMS + 2] = sum(w.isupper() and len(w) > 1 for w in number)
    return out


@dataclass
class Space:
    weights: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def place(self, table: np.ndarray) -> np.ndarray:
        """Unit vectors of rows of counts; zero stays zero."""
        v = (np.log1p(table) * self.weights) @ self.axes
        size = np.linalg.norm(v, axis=1, keepdims=True)
        return (v / np.where(size > 0, size, 1)).astype(np.float32)

    def score(self, table: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
        out = np.full(len(table), 0.5)
        k = min(neighbours, len(self.labels))
        for at in range(0, len(table), BLOCK):
            cosine = self.place(table[at : at + BLOCK]) @ self.vectors.T
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 0) ** SHARPNESS + 1e-9
            out[at : at + BLOCK] = (weight * self.labels[near]).sum(axis=1) / weight.sum(axis=1)
        return np.clip(out, 0, 1)


def fit(table: np.ndarray, labels: np.ndarray, dimensions: int = DIMENSIONS, seed: int = 7) -> Space:
    """The space of the labelled rows."""
    weights = (np.log((1 + len(table)) / (1 + (table > 0).sum(axis=0))) + 0.1).astype(np.float32)
    a = np.log1p(table) * weights
    a /= np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-9)
    wide = min(dimensions + 16, *a.shape)
    q = a.T @ (a @ np.random.default_rng(seed).standard_normal((a.shape[1], wide)).astype(np.float32))
    for _ in range(2):
        q = a.T @ (a @ np.linalg.qr(q)[0])
    q = np.linalg.qr(q)[0]
    axes = (q @ np.linalg.svd(a @ q, full_matrices=False)[2].T)[:, :dimensions].astype(np.float32)
    space = Space(weights, axes, np.zeros((0, dimensions), np.float32), labels.astype(np.float32))
    space.vectors = space.place(table)
    return space


def labelled(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Counts and labels of the rows of at most ``most`` labelled ids, twice as many rows at most; counts are gathered sparsely."""
    known = labels.filter(~common.held_out(F.col("doc_id"))).groupBy(F.col("doc_id").alias("of")).agg(F.max("quality").alias("y")).filter("y IS NOT NULL")
    known = known.orderBy(F.xxhash64("of"), "of").limit(most)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(small(known, most), F.col("doc_id") == F.col("of"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [counts(t.as_py()) for t in b.column("text").cast(pa.large_binary())]
            at = [np.flatnonzero(c) for c in found]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y").cast(pa.int32()), pa.array([x.astype(np.int32) for x in at], pa.list_(pa.int32())), pa.array([c[x] for c, x in zip(found, at)], pa.list_(pa.float32()))], ["doc_id", "y", "at", "n"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    got = rows.select("doc_id", "text", "y").mapInArrow(run, f"doc_id {kind}, y int, at array<int>, n array<float>").orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * most).toArrow()
    table = np.zeros((got.num_rows, TERMS + MARKS), np.float32)
    for i, (at, n) in enumerate(zip(got["at"].to_pylist(), got["n"].to_pylist())):
        table[i, at] = n
    return table, np.array(got["y"].to_pylist(), float)


def scored(docs: DataFrame, space: Space | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row."""
    rows = docs.select(common.column(docs, id_col).alias("doc_id"), common.column(docs, text_col).cast("string").alias("text"))
    held = docs.sparkSession.sparkContext.broadcast(space)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = held.value
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                b = whole.slice(at, BLOCK)
                if space is None:
                    score = np.full(b.num_rows, 0.5)
                else:
                    score = space.score(np.stack([counts(t.as_py()) for t in b.column("text").cast(pa.large_binary())]))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score.astype(float))], ["doc_id", "score"])

    return rows.mapInArrow(run, f"doc_id {kind}, score double")
