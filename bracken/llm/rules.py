"""Quality rules: base rules, then gradient-boosted trees over document statistics.

The trees are grown here from labelled statistics (histogram splits, logistic loss, Newton leaves) under
monotonic constraints: a statistic that marks junk may only lower the score as it grows. The model is
flattened into numpy node arrays (feature, threshold, left, right, value), and a batch of documents is
scored by walking all documents down each tree at once.

Words are runs without white space (the space and \\t to \\r). Base statistics of a text: n_words;
word_chars, code points in words; n_symbols, characters of ``#*$%&|<>``; n_dup_lines, lines with a word
equal to an earlier line; n_repeat_words, words in three-word windows found twice or more. A document
fails the base rules with fewer than 50 words or more than half of its words repeated.

Defined results: a null or empty text has zero everywhere and fails; rows with equal ids are scored on
their own; with no labelled rows of both classes the trees keep every document; an empty table gives an
empty result. The labelled sample is bounded by ``SAMPLE`` ids and twice as many rows (ids may repeat), by hash of the id; texts are whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import small

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = b"#*$%&|<>"
#: At most so many labelled ids, and twice as many rows of documents with them, are gathered for the trees; their
#: statistics are a few numbers each.
SAMPLE = 20_000
#: Documents whose probability of good quality is below this are rejected.
KEEP = 0.1

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("log_words", "mean_word", "symbol_rate", "dup_line_rate", "repeat_rate", "upper_rate", "punct_rate", "digit_rate", "pipe_rate", "distinct_rate", "line_words")
#: -1: the score may only fall as the statistic grows; 0: free.
MONOTONE = {"symbol_rate": -1, "dup_line_rate": -1, "repeat_rate": -1, "upper_rate": -1, "pipe_rate": -1, "punct_rate": -1}

_SPACE = b" \t\n\x0b\x0c\r"
_CLASSES = np.zeros(256, np.uint8)  # 1 symbol, 2 other ASCII punctuation, 3 digit, 4 upper, 5 continuation byte, 6 space
_CLASSES[[*b"!\"'()+,-./:;=?@[\\]^_`{}~"]] = 2
_CLASSES[[*SYMBOLS]] = 1
_CLASSES[ord("0") : ord("9") + 1] = 3
_CLASSES[ord("A") : ord("Z") + 1] = 4
_CLASSES[0x80:0xC0] = 5
_CLASSES[[*_SPACE]] = 6


def repeated_words(ids: np.ndarray) -> int:
    """Words that lie in a three-word window found twice or more."""
    n = len(ids)
    if n < 4:
        return 0
    wide = ids.astype(np.int64)
    span = int(wide.max()) + 1
    pair = wide[:-1] * span + wide[1:]
    if span > 2_000_000:  # three numbers would not fit in 63 bits: number the pairs first
        pair = np.unique(pair, return_inverse=True)[1].astype(np.int64)
    windows = pair[:-1] * span + wide[2:]
    order = np.argsort(windows, kind="stable")
    ranked = windows[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= twice
    return int(covered.sum())


def statistics(text: bytes | None) -> list[float]:
    """The base statistics and the features of a text in UTF-8, in the order of BASE and FEATURES."""
    words = text.split() if text else []
    n = len(words)
    if not n:
        symbols = 0
        return [0, 0, symbols, 0, 0] + [0.0] * len(FEATURES)
    count = np.bincount(_CLASSES[np.frombuffer(text, np.uint8)], minlength=7)
    chars = len(text) - int(count[5])
    word_chars = chars - int(count[6])
    seen, dup, lines = set(), 0, 0
    for line in text.split(b"\n"):
        if line.strip(_SPACE):
            lines += 1
            dup += line in seen
            seen.add(line)
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    repeat = repeated_words(ids)
    pipe = text.count(b"|")
    return [n, word_chars, int(count[1]), dup, repeat, float(np.log1p(n)), word_chars / n, count[1] / chars, dup / lines, repeat / n, count[4] / chars, count[2] / chars, count[3] / chars, pipe / n, len(number) / n, n / lines]


@dataclass
class Trees:
    """Flattened trees: node arrays over all trees, the roots, and the score without any tree."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float
    depth: int

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Of label 1, for each row of features; leaves lead to themselves."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return 1 / (1 + np.exp(-(self.base + self.value[at].sum(axis=1))))


def grow(x: np.ndarray, y: np.ndarray, signs: list[int], trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, least: int = 10, ridge: float = 1.0) -> Trees:
    """Boosted trees with histogram splits. A split of a signed feature must order its two values by the
    sign, and the middle of the two bounds the values of everything below, so the whole is monotone."""
    base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    edges = [np.unique(np.quantile(f, np.linspace(0, 1, bins + 1)[1:-1])) for f in x.T]
    binned = np.stack([np.searchsorted(e, f, side="left") for e, f in zip(edges, x.T)], axis=1)
    nodes: list[list[float]] = []  # feature, threshold, left, right, value
    roots, margin = [], np.full(len(y), base)

    def value(g: float, h: float, low: float, high: float) -> float:
        return float(np.clip(-g / (h + ridge), low, high))

    def split(rows: np.ndarray, level: int, low: float, high: float) -> int:
        g, h = grad[rows].sum(), hess[rows].sum()
        me = len(nodes)
        nodes.append([0, np.inf, me, me, rate * value(g, h, low, high)])
        best = (1e-6, -1, 0, 0.0, 0.0)
        for f in range(x.shape[1]) if level < depth and len(rows) >= 2 * least else ():
            b = binned[rows, f]
            size = len(edges[f]) + 1
            gs, hs, ns = (np.cumsum(np.bincount(b, w, size))[:-1] for w in (grad[rows], hess[rows], None))
            ok = (ns >= least) & (len(rows) - ns >= least)
            left, right = np.clip(-gs / (hs + ridge), low, high), np.clip(-(g - gs) / (h - hs + ridge), low, high)
            if signs[f]:
                ok &= signs[f] * (right - left) >= 0
            gain = np.where(ok, gs**2 / (hs + ridge) + (g - gs) ** 2 / (h - hs + ridge) - g**2 / (h + ridge), 0)
            if len(gain) and gain.max() > best[0]:
                k = int(gain.argmax())
                best = (float(gain[k]), f, k, float(left[k]), float(right[k]))
        _, f, k, a, b = best
        if f >= 0:
            middle = (a + b) / 2
            below, above = ((low, middle), (middle, high)) if signs[f] > 0 else ((middle, high), (low, middle)) if signs[f] else ((low, high),) * 2
            goes = binned[rows, f] <= k
            nodes[me][0], nodes[me][1] = f, float(edges[f][k])
            nodes[me][2] = split(rows[goes], level + 1, *below)
            nodes[me][3] = split(rows[~goes], level + 1, *above)
        return me

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p)
        first = len(nodes)
        roots.append(split(np.arange(len(y)), 0, -np.inf, np.inf))
        tree = Trees(*_arrays(nodes), np.array([first]), 0.0, depth)
        q = tree.probability(x)
        margin = margin + np.log(q / (1 - q))
    return Trees(*_arrays(nodes), np.array(roots), base, depth)


def _arrays(nodes: list[list[float]]) -> tuple[np.ndarray, ...]:
    a = np.array(nodes)
    return a[:, 0].astype(np.int64), a[:, 1], a[:, 2].astype(np.int64), a[:, 3].astype(np.int64), a[:, 4]


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, the base statistics, features) of every row, written to the shared folder."""
    rows = docs.select(common.column(docs, id_col).alias("doc_id"), F.xxhash64(common.column(docs, text_col)).alias("text_hash"), common.column(docs, text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, text_hash long, " + ", ".join(f"{c} long" for c in BASE) + ", features array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [statistics(t.as_py()) for t in b.column("text").cast(pa.large_binary())]
            base = [pa.array([int(s[i]) for s in found], pa.int64()) for i in range(len(BASE))]
            features = pa.array([s[len(BASE) :] for s in found], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), *base, features], ["doc_id", "text_hash", *BASE, "features"])

    return common.shared_table(rows.mapInArrow(run, schema), "statistics")


def fit(stats: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees | None:
    """Trees from the labelled rows of ``labels`` (doc_id, quality), held-out ids left out; at most ``sample``
    ids and twice as many rows, by hash of the id. None if there are not both classes."""
    known = labels.filter(~common.held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("y")).filter("y IS NOT NULL")
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = stats.select("doc_id", "features").join(small(known, sample), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * sample).select("features", "y").collect()
    y = np.array([r["y"] for r in rows], float)
    if len(set(y)) < 2:
        return None
    return grow(np.array([r["features"] for r in rows], float), y, [MONOTONE.get(f, 0) for f in FEATURES])


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: float = KEEP, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, text_hash, base statistics, base_failed, score, kept) of every row."""
    stats = measured(docs, id_col, text_col)
    trees = fit(stats, labels, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            x = b.column("features").flatten().to_numpy(zero_copy_only=False).reshape(n, len(FEATURES))
            score = trees.probability(x) if trees else np.ones(n)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "text_hash", *BASE)), pa.array(score)], ["doc_id", "text_hash", *BASE, "score"])

    kind = stats.schema["doc_id"].dataType.simpleString()
    out = stats.mapInArrow(run, f"doc_id {kind}, text_hash long, " + ", ".join(f"{c} long" for c in BASE) + ", score double")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= keep))


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that are kept; columns as in the input. Rows of equal id and text are judged alike."""
    found = judged(docs, labels, id_col, text_col, **how).filter("NOT kept").select("doc_id", "text_hash").distinct()
    return common.without(docs, common.shared_table(found, "rejected"), id_col, text_col)
