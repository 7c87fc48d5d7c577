"""Cosine similarity join by banded random-hyperplane signatures.

A vector's signature has a bit for each of a number of random hyperplanes. Two vectors at an angle t agree in a bit with
probability 1 - t / pi, so that pairs at the wanted similarity agree in a whole band of BITS bits at least once with the
probability ``recall``, from which the number of bands follows. Rows are shuffled by (band, bits of the band) and carry the first
128 bits of the signature; of the pairs that meet, those whose sketches differ in more bits than such a pair's do
(but for one in 30,000) are dropped where they meet. What is left is distinct pairs, which are verified by their vectors.

Equal vectors are one representative, the smallest id; ``members`` tells whose. A bucket of more than HOT rows is cut into
blocks, and each pair of blocks is a task's work. The planes follow from the seed and the number of dimensions, so that all
workers and runs draw the same ones.

Vectors that ``vector.invalid`` finds are in no pair and no membership; rows with equal ids are taken as one if their vectors are
equal too.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shared_table, small
from .vector import dot, invalid

BITS = 16
SKETCH = 128
RECALL = 0.99
HOT = 2000


def bands(least: float, bits: int = BITS, recall: float = RECALL) -> int:
    """So many bands that pairs of similarity ``least`` share one with the probability ``recall``."""
    agree = (1 - math.acos(least) / math.pi) ** bits
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - agree)))


def most_bits(least: float, sketch: int = SKETCH) -> int:
    """Differing bits of sketches that pairs of similarity ``least`` exceed once in about 30,000."""
    p = math.acos(least) / math.pi
    return math.ceil(sketch * p + 4 * math.sqrt(sketch * p * (1 - p)))


def _keyed(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    dim = vectors.agg(F.max(F.size(vec_col))).first()[0]
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"))
    return rows.filter(F.col("id").isNotNull() & ~invalid(F.col("v"), dim or 0)).withColumn("h", F.struct(F.xxhash64("v").alias("a"), F.hash("v").alias("b")))


def representatives(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """((id, v) of each different vector, (rep, id) of each row). Vectors are told apart by 96 bits of their hashes."""
    rows = shared_table(_keyed(vectors, id_col, vec_col), "vectors")
    reps = shared_table(rows.groupBy("h").agg(F.min("id").alias("rep"), F.min_by("v", "id").alias("v")), "representatives")
    members = rows.select("id", "h").join(reps.select("h", "rep"), "h").select("rep", "id").distinct()
    return reps.select(F.col("rep").alias("id"), "v"), members


def signed(rows: DataFrame, n_bands: int, bits: int = BITS, seed: int = 11) -> DataFrame:
    """(band, key, id, s1, s2) of each row (id, v) and band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = weigh = None
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                v = np.stack(part.column("v").to_numpy(zero_copy_only=False)).astype(np.float64)
                if planes is None or len(planes) != v.shape[1]:
                    planes = np.random.default_rng(seed).standard_normal((v.shape[1], max(n_bands * bits, SKETCH)))
                    weigh = 1 << np.arange(bits, dtype=np.int64)
                sign = v @ planes > 0
                key = sign[:, : n_bands * bits].reshape(len(v), n_bands, bits) @ weigh
                sketch = np.packbits(sign[:, :SKETCH], axis=1).view(np.int64)
                n = np.repeat(np.arange(len(v)), n_bands)
                made = [np.tile(np.arange(n_bands, dtype=np.int32), len(v)), key.ravel(), part.column("id").to_numpy()[n], sketch[n, 0], sketch[n, 1]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in made], ["band", "key", "id", "s1", "s2"])

    return rows.mapInArrow(run, "band int, key long, id long, s1 long, s2 long")


def _near(most: int) -> Column:
    return F.bit_count(F.col("s1").bitwiseXOR(F.col("t1"))) + F.bit_count(F.col("s2").bitwiseXOR(F.col("t2"))) <= most


def _blocks(rows: DataFrame, hot: DataFrame, left: bool) -> DataFrame:
    """Adds ``i`` and ``j``, the pair of blocks in which a row of a hot bucket meets others: a row on the left stands for its
    block and meets every block, one on the right the other way round."""
    rows = rows.join(small(hot), ["band", "key"], "left")
    n = F.coalesce("blocks", F.lit(1))
    own, other = F.pmod(F.xxhash64("id"), n).cast("int"), F.explode(F.sequence(F.lit(0), n - 1)).alias("_o")
    rows = rows.select("*", own.alias("_b"), other)
    i, j = ("_b", "_o") if left else ("_o", "_b")
    return rows.withColumn("i", F.col(i)).withColumn("j", F.col(j)).drop("_b", "_o", "blocks")


def candidates(left: DataFrame, right: DataFrame | None, least: float, bits: int = BITS, recall: float = RECALL) -> DataFrame:
    """Distinct (a, b) of ``left`` and ``right`` (id, v), or of ``left`` with itself and a < b, that share a band and whose
    sketches are near."""
    n = bands(least, bits, recall)
    a = shared_table(signed(left, n, bits), "signatures")
    b = a if right is None else shared_table(signed(right, n, bits), "signatures")
    sizes = a.groupBy("band", "key").count()
    if right is not None:
        sizes = sizes.unionByName(b.groupBy("band", "key").count())
    hot = sizes.groupBy("band", "key").agg(F.max("count").alias("n")).filter(F.col("n") > HOT)
    hot = shared_table(hot.select("band", "key", F.ceil(F.col("n") / HOT).cast("int").alias("blocks")), "hot-buckets")
    b = b.select("band", "key", F.col("id").alias("b"), F.col("s1").alias("t1"), F.col("s2").alias("t2"))
    left_, right_ = _blocks(a, hot, True), _blocks(b.withColumnRenamed("b", "id"), hot, False).withColumnRenamed("id", "b")
    met = left_.join(right_, ["band", "key", "i", "j"]).filter(_near(most_bits(least)))
    if right is None:
        met = met.filter(F.col("id") < F.col("b"))
    return met.select(F.col("id").alias("a"), "b").distinct()


def _verified(pairs: DataFrame, left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    norm = lambda v: F.sqrt(dot(v, v))
    pairs = pairs.join(left.select(F.col("id").alias("a"), F.col("v").alias("va")), "a").join(right.select(F.col("id").alias("b"), F.col("v").alias("vb")), "b")
    score = F.round(dot(F.col("va"), F.col("vb")) / (norm(F.col("va")) * norm(F.col("vb"))), 6)
    return pairs.select("a", "b", score.alias("score")).filter(F.col("score") >= least)


def links(vectors: DataFrame, least: float, id_col: str = "vec_id", vec_col: str = "embedding", bits: int = BITS, recall: float = RECALL) -> tuple[DataFrame, DataFrame]:
    """JN-16, SET-04 over a whole table: ((a, b, score) of different vectors with a similarity of ``least`` or more, the
    members (rep, id)); a and b are representatives, a < b."""
    reps, members = representatives(vectors, id_col, vec_col)
    return _verified(shared_table(candidates(reps, None, least, bits, recall), "pairs"), reps, reps, least), members


def matches(queries: DataFrame, cached: DataFrame, least: float, id_col: str = "vec_id", vec_col: str = "embedding", bits: int = BITS, recall: float = RECALL) -> DataFrame:
    """SET-05: (query_id, hit, score): of each query with a cached vector of similarity ``least`` or more the nearest, ties by the
    smaller id. Cached vectors that are equal are one, the smallest id; other queries have no row."""
    reps, _ = representatives(cached, id_col, vec_col)
    asked = shared_table(_keyed(queries, id_col, vec_col).select("id", "v").dropDuplicates(["id"]), "asked")
    found = _verified(shared_table(candidates(asked, reps, least, bits, recall), "pairs"), asked, reps, least)
    return found.groupBy(F.col("a").alias("query_id")).agg(F.min_by("b", F.struct(-F.col("score"), "b")).alias("hit"), F.max("score").alias("score"))
