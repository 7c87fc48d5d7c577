"""An approximate vector index: inverted lists with product-quantised residuals, exact scores for what is found.

Centroids and codebooks are fitted on at most SAMPLE vectors, drawn by a hash of their ids. Every row is then assigned to the
list of its nearest centroid and written, by list, in blocks of BLOCK rows: ``codes`` holds ids and the code of
what the centroid leaves over, one byte for each of PARTS pieces; ``vectors`` holds the vectors themselves. A search
gives each query its nearest lists, joins queries and code blocks by list, keeps the RERANK best approximate scores of a
query, and scores these again by their vectors. Queries of a list are joined in blocks as well, so that a row of the join
is a product of two bounded matrices; no side is collected.

How many lists a query probes is found when the index is fitted: the least number, up to all, at which the nearest K of the
sample's own queries are found with a recall of RECALL, by brute force over the sample. Vectors without clusters
thus probe many lists, clustered ones few. ``vector.topk`` is the exact mode.

Vectors that ``vector.invalid`` finds (null, of another length, not finite, zero) are not indexed and ask nothing. An empty table gives
an index without lists. Ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_path, shared_table, small
from .vector import invalid, topk

#: Rows that the model is fitted on; 20,000 vectors of 64 floats are 5 MB.
SAMPLE = 20_000
MAX_LISTS = 4096
PARTS, CODES = 16, 256
BLOCK, QUERY_BLOCK = 1024, 256
RERANK = 20
#: Copies of queries, one for each list that they probe, that are made at once.
COPIES = 32_768
K, RECALL, ASKED = 10, 0.97, 200


@dataclass(frozen=True)
class Model:
    """Unit centroids (lists x dim), codebooks (parts x codes x dim of a part), lists to probe, and the recall that the sample had."""

    centroids: np.ndarray
    books: np.ndarray
    probe: int
    recall: float

    def lists(self, v: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` lists nearest to each row, nearest first."""
        s = v @ self.centroids.T
        n = min(n, s.shape[1])
        at = np.argpartition(-s, n - 1, axis=1)[:, :n] if n < s.shape[1] else np.tile(np.arange(n), (len(v), 1))
        return np.take_along_axis(at, np.argsort(-np.take_along_axis(s, at, 1), axis=1, kind="stable"), 1)

    def encode(self, v: np.ndarray, lists: np.ndarray) -> np.ndarray:
        rest = v - self.centroids[lists]
        parts = np.split(rest, len(self.books), axis=1)
        return np.stack([_nearest(p, b) for p, b in zip(parts, self.books)], axis=1).astype(np.uint8)

    def decode(self, codes: np.ndarray, list_: int) -> np.ndarray:
        return self.centroids[list_] + np.concatenate([b[codes[:, i]] for i, b in enumerate(self.books)], axis=1)


@dataclass(frozen=True)
class Index:
    model: Model
    codes: DataFrame
    vectors: DataFrame


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _nearest(v: np.ndarray, to: np.ndarray) -> np.ndarray:
    """The row of ``to`` nearest to each row of ``v`` by distance."""
    return np.concatenate([np.argmax(v[i : i + 4096] @ to.T - (to * to).sum(axis=1) / 2, axis=1) for i in range(0, len(v), 4096)])


def _means(v: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """k-means; a mean that nothing is nearest to is drawn again from the rows."""
    at = v[rng.choice(len(v), k, replace=len(v) < k)].copy()
    for _ in range(rounds):
        own = _nearest(v, at)
        n = np.bincount(own, minlength=k)
        sums = np.stack([np.bincount(own, weights=v[:, j], minlength=k) for j in range(v.shape[1])], axis=1)
        at = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], v[rng.integers(0, len(v), k)])
    return at


def fit(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", sample: int = SAMPLE, recall: float = RECALL, seed: int = 7) -> Model | None:
    """A model of a sample of ``vectors``; None if no vector is valid."""
    n, dim = vectors.agg(F.count("*"), F.max(F.size(vec_col))).first()
    if not n or not dim or dim < 1:
        return None
    drawn = vectors.filter(~invalid(F.col(vec_col), dim)).orderBy(F.xxhash64(id_col), id_col).limit(sample).select(vec_col).toArrow()
    if not drawn.num_rows:
        return None
    v = _unit(np.stack(drawn[vec_col].to_numpy()).astype(np.float64))
    rng = np.random.default_rng(seed)
    lists = int(min(MAX_LISTS, max(1, n**0.5), max(1, len(v) // 8)))
    centroids = _means(v, lists, rng)
    centroids = centroids / np.maximum(np.linalg.norm(centroids, axis=1, keepdims=True), 1e-12)
    own = np.argmax(v @ centroids.T, axis=1)
    rest = v - centroids[own]
    parts = next(p for p in range(min(PARTS, dim), 0, -1) if dim % p == 0)
    books = np.stack([_means(p, CODES, rng) for p in np.split(rest, parts, axis=1)])
    probe, reached = _probes(v, centroids, own, recall)
    return Model(centroids, books, probe, reached)


def _probes(v: np.ndarray, centroids: np.ndarray, own: np.ndarray, recall: float) -> tuple[int, float]:
    """The least number of lists with the wanted share of the nearest K of the first ASKED rows in them, and that share."""
    q = v[:ASKED]
    s = q @ v.T
    s[np.arange(len(q)), np.arange(len(q))] = -np.inf
    k = min(K, len(v) - 1)
    if k < 1:
        return len(centroids), 1.0
    near = np.argpartition(-s, k - 1, axis=1)[:, :k]
    order = np.argsort(np.argsort(-(q @ centroids.T), axis=1), axis=1)  # the place of each list for each query
    place = np.take_along_axis(order, own[near], 1)
    share = np.cumsum(np.bincount(place.ravel(), minlength=len(centroids))) / place.size
    probe = int(np.searchsorted(share, recall - 1e-12)) + 1
    return min(probe, len(centroids)), float(share[min(probe, len(centroids)) - 1])


def build(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", model: Model | None = None, **how) -> Index | None:
    """Fits a model unless one is given, assigns every valid row and writes the lists."""
    model = model or fit(vectors, id_col, vec_col, **how)
    if model is None:
        return None
    spark, dim = vectors.sparkSession, model.centroids.shape[1]
    held = spark.sparkContext.broadcast(model)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            if b.num_rows:
                v = _unit(np.stack(b.column("v").to_numpy(zero_copy_only=False)).astype(np.float64))
                lists = m.lists(v, 1)[:, 0]
                yield pa.RecordBatch.from_arrays([pa.array(lists.astype(np.int32)), b.column("id"), pa.array([c.tobytes() for c in m.encode(v, lists)], pa.binary()), b.column("v")], ["list", "id", "code", "vec"])

    schema = f"list int, id long, code binary, vec {vectors.select(vec_col).schema[0].dataType.simpleString()}"
    rows = vectors.filter(~invalid(F.col(vec_col), dim)).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).mapInArrow(assign, schema)
    path = shared_path(spark, "ivf")
    rows.repartitionByRange("list", "id").sortWithinPartitions("list", "id").write.parquet(f"{path}/vectors")
    written = spark.read.schema(schema).parquet(f"{path}/vectors")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:  # in order of the list, so that runs of a list are cut into blocks
            lists, ids = b.column("list").to_numpy(), b.column("id").to_numpy()
            cuts = np.flatnonzero(np.diff(lists, prepend=-1))
            for i, j in zip(cuts, [*cuts[1:], len(lists)]):
                for a in range(i, j, BLOCK):
                    e = min(j, a + BLOCK)
                    yield pa.RecordBatch.from_arrays([pa.array([lists[a]], pa.int32()), pa.array([ids[a:e].tobytes()], pa.binary()), pa.array([b"".join(b.column("code")[a:e].to_pylist())], pa.binary())], ["list", "ids", "codes"])

    written.select("list", "id", "code").mapInArrow(blocks, "list int, ids binary, codes binary").write.parquet(f"{path}/codes")
    return Index(model, spark.read.schema("list int, ids binary, codes binary").parquet(f"{path}/codes"), written.select("list", "id", "vec"))


def _copies(model: Model, ids: pa.Array, v: np.ndarray, probe: int) -> Iterator[pa.RecordBatch]:
    """(list, query_id, q) of unit vectors for each of their ``probe`` lists, at most about COPIES rows at once."""
    step = max(1, COPIES // min(probe, len(model.centroids)))
    for lo in range(0, len(v), step):
        lists = model.lists(v[lo : lo + step], probe)
        at = np.repeat(np.arange(len(lists)), lists.shape[1])
        raw = [x.tobytes() for x in v[lo : lo + step].astype(np.float32)]
        yield pa.RecordBatch.from_arrays([pa.array(lists.ravel().astype(np.int32)), ids.slice(lo, step).take(pa.array(at)), pa.array([raw[i] for i in at], pa.binary())], ["list", "query_id", "q"])


def search_all(index: Index, queries: DataFrame, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding", itself: bool = False) -> DataFrame:
    """RET-02: (query_id, doc, score, rank from 0) of the ``k`` best by exact cosine: all lists are read and every vector in them is
    scored, so that nothing depends on codes. Queries are not copied by list."""
    asked = queries.filter(~invalid(F.col(vec_col), index.model.centroids.shape[1])).select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"))
    return topk(index.vectors.select("id", "vec"), asked, k, "id", "vec", itself=itself)


def search(index: Index, queries: DataFrame, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding", probe: int | None = None, rerank: int = RERANK, itself: bool = False) -> DataFrame:
    """TOP-02: (query_id, doc, score, rank from 0) of the ``k`` best by exact cosine among ``rerank`` times ``k`` candidates. A query's
    own id is left out unless ``itself``."""
    model, most = index.model, rerank * k
    held = queries.sparkSession.sparkContext.broadcast(model)
    probe = probe or model.probe

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v = _unit(np.stack(b.column("v").to_numpy(zero_copy_only=False)).astype(np.float64))
                yield from _copies(held.value, b.column("id"), v, probe)

    asked = queries.filter(~invalid(F.col(vec_col), model.centroids.shape[1])).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"))
    rows = asked.mapInArrow(placed, "list int, query_id long, q binary")
    # queries of one list in blocks; a block of a number that no list has is empty
    n = queries.count()
    part = F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-n // QUERY_BLOCK))))
    rows = rows.groupBy("list", part.alias("part")).agg(F.collect_list(F.struct("query_id", "q")).alias("qs"))
    rows = shared_table(rows, "probes")

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            for r in (b.slice(i, 1).to_pylist()[0] for i in range(b.num_rows)):  # the queries of one block at a time
                ids = np.frombuffer(r["ids"], np.int64)
                asks = np.array([x["query_id"] for x in r["qs"]], np.int64)
                q = np.frombuffer(b"".join(x["q"] for x in r["qs"]), np.float32).reshape(len(asks), -1)
                s = q @ m.decode(np.frombuffer(r["codes"], np.uint8).reshape(len(ids), -1), r["list"]).T
                if not itself:
                    s[asks[:, None] == ids[None, :]] = -np.inf
                n = min(most, len(ids))
                at = np.argpartition(-s, n - 1, axis=1)[:, :n]
                who = np.repeat(np.arange(len(asks)), n)
                got, at = s[who, at.ravel()], at.ravel()
                ok = np.isfinite(got)
                yield pa.RecordBatch.from_arrays([pa.array(asks[who][ok]), pa.array(np.full(ok.sum(), r["list"], np.int32)), pa.array(ids[at][ok]), pa.array(got[ok])], ["query_id", "list", "id", "approx"])

    found = index.codes.join(small(rows, 64), "list").mapInArrow(best, "query_id long, list int, id long, approx double")
    near = Window.partitionBy("query_id").orderBy(F.desc("approx"), "id")
    found = found.withColumn("_n", F.row_number().over(near)).filter(F.col("_n") <= most).select("query_id", "list", "id")
    found = shared_table(found, "candidates")
    exact = index.vectors.join(small(found), ["list", "id"]).join(small(asked.select(F.col("id").alias("query_id"), "v")), "query_id")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                q = _unit(np.stack(b.column("v").to_numpy(zero_copy_only=False)).astype(np.float64))
                v = _unit(np.stack(b.column("vec").to_numpy(zero_copy_only=False)).astype(np.float64))
                yield pa.RecordBatch.from_arrays([b.column("query_id"), b.column("id"), pa.array(np.round((q * v).sum(axis=1), 6))], ["query_id", "doc", "score"])

    out = exact.select("query_id", "id", "v", "vec").mapInArrow(scored, "query_id long, doc long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc")
    return out.withColumn("rank", F.row_number().over(order) - 1).filter(F.col("rank") < k)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the rows (query_id, doc) of ``exact`` that ``found`` has."""
    both = exact.select("query_id", "doc").join(found.select("query_id", "doc").withColumn("_hit", F.lit(1)), ["query_id", "doc"], "left")
    return both.agg(F.coalesce(F.avg(F.coalesce("_hit", F.lit(0))), F.lit(1.0))).first()[0]
