"""Importance resampling towards a target distribution, by a dictionary of distinct features.

Words of a text are runs of digits, lower-case ASCII letters (A-Z are lowered) and all characters beyond ASCII; features are
the n-grams of words, joined by a space. Every distinct feature of the corpus is counted once for all documents and hashed
once (crc32, modulo BUCKETS). Buckets are summed for the corpus and for the target; a bucket's gain is the logarithm of the
ratio of the two smoothed shares, in thousandths and rounded down. Gains go back to the dictionary and from there to the
counts of each document. A document's weight is the floored mean of its features' gains; with noise that the seed and the
id fix (Gumbel's), the highest scores are a draw without replacement in proportion to the exponentials of the weights.

Two passes count the features of whole texts. The first folds them by partition and then by feature. The second meets the
gains: those of the most frequent features, HEAD bytes of them at most, are broadcast, and what they give is summed
where the text lies; only a document's other features are shuffled, and none of these is frequent. Ranks come from
a range sort. Nothing else is gathered: buckets are bounded by their number.

Defined results: a null or empty text has no features and weight 0; a null id has the noise of the text ``null`` and is last
among ties; rows of equal ids are rows of their own, ties among them in order of their rows; a target without words leaves
the corpus' own shares alone to decide; an empty table gives an empty result. Rows are told apart by their place in the
scan, so that ``docs`` should be a table that is read and not one that is shuffled anew. Columns beside id and text are not
looked at.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, mixing

BUCKETS = 10_000
GRAMS = 1
MIN_WORDS = 20
PERCENT = 10
SEED = 2024
#: Bytes of the features whose gains are broadcast, each with ENTRY bytes for the rest of it.
HEAD = 8 << 20
ENTRY = 100
#: Distinct features that a task holds before it hands them on.
HELD = 200_000
#: Frequencies are told apart in so many steps for each doubling, to find the head.
STEPS = 8

_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def features(text: bytes | None, grams: int = GRAMS) -> Counter:
    """How often each feature of a text in UTF-8 occurs in it."""
    words = text.translate(_WORDS).split() if text else []
    found = Counter(words)
    for n in range(2, grams + 1):
        found.update(map(b" ".join, zip(*(words[i:] for i in range(n)))))
    return found


def dictionary(texts: DataFrame, grams: int = GRAMS, buckets: int = BUCKETS) -> DataFrame:
    """(feature, n, bucket) of the column ``text``: each distinct feature once, with its count over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()).cast(pa.string()), pa.array(held.values(), pa.int64())], ["feature", "n"])

        for b in batches:
            for t in b.column("text").cast(pa.large_binary()):
                held.update(features(t.as_py(), grams))
                if len(held) >= HELD:
                    yield out()
                    held.clear()
        yield out()

    counted = texts.mapInArrow(run, "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    return counted.withColumn("bucket", (F.crc32(F.col("feature").cast("binary")) % buckets).cast("int"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of the buckets of ``corpus``, of which there are ``buckets`` at most; both are dictionaries."""
    s, t = (d.groupBy("bucket").agg(F.sum("n").alias(n)) for d, n in ((corpus, "s"), (target, "t")))
    sizes = s.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("all_s")).crossJoin(t.agg(F.coalesce(F.sum("t"), F.lit(0)).alias("all_t")))  # one row each
    out = s.join(F.broadcast(t), "bucket", "left").crossJoin(F.broadcast(sizes))
    up = (F.coalesce("t", F.lit(0)) + 1).cast("double") * (F.col("all_s") + buckets).cast("double")
    down = (F.col("s") + 1).cast("double") * (F.col("all_t") + buckets).cast("double")
    return out.select("bucket", F.floor(F.ln(up / down) * 1000).cast("long").alias("gain"))


def _frequency() -> Column:
    return F.floor(F.log2("n") * STEPS)


def _head(known: DataFrame, most: int) -> int:
    """The least frequency step from which on all features take at most ``most`` bytes."""
    sizes = known.groupBy(_frequency().alias("step")).agg(F.sum(F.octet_length("feature") + ENTRY).alias("size")).collect()  # 64 * STEPS rows at most
    step, size = 64 * STEPS, 0
    for r in sorted(sizes, key=lambda r: -r["step"]):
        size += r["size"]
        if size > most:
            break
        step = r["step"]
    return step


def weights(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", grams: int = GRAMS, buckets: int = BUCKETS, head: int = HEAD) -> DataFrame:
    """(row, doc_id, n_words, n_features, weight) of every row of ``docs``."""
    texts = docs.select(common.column(docs, text_col).cast("string").alias("text"))
    known = common.shared_table(dictionary(texts, grams, buckets), "features")
    wanted = common.shared_table(dictionary(target.select(common.column(target, target_col).cast("string").alias("text")), grams, buckets), "target-features")
    gain = common.shared_table(gains(known, wanted, buckets), "gains")
    step = _head(known, head)
    known = known.withColumn("step", _frequency()).join(F.broadcast(gain), "bucket")
    frequent = known.filter(F.col("step") >= step).select("feature", "gain").toArrow()  # HEAD bytes at most
    frequent = dict(zip(frequent.column("feature").cast(pa.binary()).to_pylist(), frequent.column("gain").to_pylist()))
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(frequent))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), common.column(docs, id_col).alias("doc_id"), common.column(docs, text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = pickle.loads(sent.value).get
        for b in batches:
            at, feature, n, words, total, have = [], [], [], [], [], []
            for i, (row, t) in enumerate(zip(b.column("row").to_pylist(), b.column("text").cast(pa.large_binary()))):
                found = features(t.as_py(), grams)
                sum_, rest = 0, len(at)
                for f, k in found.items():
                    if (g := given(f)) is None:
                        at.append(i)
                        feature.append(f)
                        n.append(k)
                    else:
                        sum_ += k * g
                if rest == len(at):  # a row for itself, under a name that no feature has
                    at.append(i)
                    feature.append(b"\0%d" % row)
                    n.append(0)
                more = len(at) - rest - 1
                words += [sum(k for f, k in found.items() if b" " not in f)] + [0] * more
                have += [found.total()] + [0] * more
                total += [sum_] + [0] * more
                if len(at) >= HELD:
                    yield _batch(b, at, feature, n, words, have, total)
                    at, feature, n, words, total, have = [], [], [], [], [], []
            yield _batch(b, at, feature, n, words, have, total)

    schema = f"row long, doc_id {kind}, feature string, n long, n_words long, n_features long, known long"
    rare = known.filter(F.col("step") < step).select("feature", "gain")
    met = rows.mapInArrow(run, schema).join(rare, "feature", "left")
    summed = met.groupBy("row", "doc_id").agg(F.sum("n_words").alias("n_words"), F.sum("n_features").alias("n_features"), F.sum(F.col("known") + F.col("n") * F.coalesce("gain", F.lit(0))).alias("sum"))
    mean = F.when(F.col("n_features") > 0, F.expr("(sum - pmod(sum, n_features)) div n_features")).otherwise(0)
    return summed.select("row", "doc_id", "n_words", "n_features", mean.cast("long").alias("weight"))


def _batch(b: pa.RecordBatch, at: list, feature: list, n: list, words: list, have: list, total: list) -> pa.RecordBatch:
    own = b.select(["row", "doc_id"]).take(pa.array(at, pa.int64()))
    made = [pa.array(feature, pa.binary()).cast(pa.string()), *(pa.array(c, pa.int64()) for c in (n, words, have, total))]
    return pa.RecordBatch.from_arrays([*own.columns, *made], ["row", "doc_id", "feature", "n", "n_words", "n_features", "known"])


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise of an id, in thousandths and rounded down."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.ln(-F.ln((h + 0.5) / 4294967296.0)) * -1000).cast("long")


def resampled(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", grams: int = GRAMS, buckets: int = BUCKETS, min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED, head: int = HEAD) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row; of those with ``min_words`` words ``percent`` in a hundred
    are drawn and have a rank, from 1 on in order of score."""
    out = weights(docs, target, id_col, text_col, target_col, grams, buckets, head)
    out = common.shared_table(out.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "weights")
    able = F.col("n_words") >= min_words
    n = out.filter(able).count()
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row").asc()]
    ranked = mixing._running(out.filter(able).withColumn("_one", F.lit(1).cast("long")), order, ["_one"], mixing._pow2(max(mixing.ROWS_A_SLICE, n / mixing.MAX_SLICES), 1 << 30), label="draw-order")
    rank = F.when(F.col("_bk_to__one") <= n * percent // 100, F.col("_bk_to__one")).cast("long")
    names = ["doc_id", "n_words", "n_features", "weight", "score"]
    return ranked.select(*names, rank.alias("rank")).unionByName(out.filter(~able).select(*names, F.lit(None).cast("long").alias("rank")))
