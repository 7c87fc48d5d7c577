"""Exact vector search and similarity joins on unit vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import profiles as P

#: Queries that are broadcast at once: 20,000 of 64 floats are 5 MB.
QUERY_BLOCK = 20_000
#: Vectors of a block, and so many groups of them at most, which the blocks of queries are copied to.
VECTOR_BLOCK, MAX_GROUPS = 4096, 4096
#: Products of a batch that are made at once: 16 MB.
CELLS = 2_000_000


def dot(a: Column, b: Column) -> Column:
    """MTH-02 in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def invalid(v: Column, dim: int) -> Column:
    """MIS-06: null, of another length, with a value that is not finite, or zero."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNull() | (F.size(v) != dim) | F.coalesce(bad, F.lit(True)) | ~(dot(v, v) > 0)


def _best(scores: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of each row's k largest finite scores, ties by the column's id: what reaches the k-th largest
    score of its row is sorted, not the whole."""
    if scores.shape[1] > k:
        least = np.partition(scores, scores.shape[1] - k, axis=1)[:, [scores.shape[1] - k]]
        row, col = np.nonzero((scores >= least) & np.isfinite(scores))
    else:
        row, col = np.nonzero(np.isfinite(scores))
    order = np.lexsort((own[col], -scores[row, col], row))
    row, col = row[order], col[order]
    place = np.arange(len(row)) - np.searchsorted(row, row, side="left")
    return row[place < k], col[place < k]


def topk(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding", within: list[str] | None = None, itself: bool = False) -> DataFrame:
    """TOP-02: (query_id, doc, score, rank) of the k nearest of each query by cosine, all pairs considered; among
    rows that are equal in ``within`` if given. A query's own id is left out unless ``itself``.

    Up to QUERY_BLOCK queries are broadcast. More are dealt in blocks, and each block of queries meets each block of vectors
    in one row of a join on groups of vector blocks, so that no side is gathered. Of every pair of blocks the k best for
    each query are shuffled. A batch is multiplied with as many queries at a time as make CELLS products.
    """
    group = F.xxhash64(*within) if within else F.lit(0).cast("long")
    as_rows = lambda df: df.select(F.col(id_col).cast("long").alias("id"), group.alias("g"), F.col(vec_col).alias("v"))
    n = queries.count()

    def pairs(q_ids: np.ndarray, q_groups: np.ndarray, q: np.ndarray, ids: np.ndarray, groups: np.ndarray, v: np.ndarray) -> Iterator[pd.DataFrame]:
        step = max(1, CELLS // len(ids))
        for at in range(0, len(q_ids), step):
            cosine = np.round(q[at : at + step] @ v.T, 6)
            if not itself:
                cosine[q_ids[at : at + step, None] == ids[None, :]] = -np.inf
            if within:
                cosine[q_groups[at : at + step, None] != groups[None, :]] = -np.inf
            row, col = _best(cosine, ids, k)
            yield pd.DataFrame({"query_id": q_ids[at + row], "doc": ids[col], "score": cosine[row, col]})

    schema = "query_id long, doc long, score double"
    if n <= QUERY_BLOCK:
        rows = as_rows(queries).toArrow()
        held = queries.sparkSession.sparkContext.broadcast((rows["id"].to_numpy(), rows["g"].to_numpy(), _units(rows["v"].to_pylist())))

        def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b) and len(held.value[0]):
                    yield from pairs(*held.value, b["id"].to_numpy(), b["g"].to_numpy(), _units(b["v"].to_list()))

        out = as_rows(vectors).mapInPandas(best, schema)
    else:
        groups = max(1, min(MAX_GROUPS, -(-vectors.count() // VECTOR_BLOCK)))
        left = as_rows(queries).mapInPandas(_packed(QUERY_BLOCK // 16), _PACKED).withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        right = as_rows(vectors).mapInPandas(_packed(VECTOR_BLOCK), _PACKED).withColumn("at", F.pmod(F.xxhash64("ids"), F.lit(groups)).cast("int"))
        met = left.select("at", *[F.col(c).alias(f"q_{c}") for c in ("ids", "gs", "vs")]).join(right, "at")

        def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for r in b.itertuples():
                    yield from pairs(*_unpacked(r.q_ids, r.q_gs, r.q_vs), *_unpacked(r.ids, r.gs, r.vs))

        out = met.mapInPandas(meet, schema)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc")
    return out.withColumn("rank", F.row_number().over(w) - 1).filter(F.col("rank") < k)


def _units(rows: list) -> np.ndarray:
    v = np.stack(rows).astype(np.float64) if len(rows) else np.zeros((0, 1))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


_PACKED = "ids binary, gs binary, vs binary"


def _packed(size: int):
    """Rows (id, g, v) of a task as blocks of at most ``size``, their unit vectors in double precision."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), size):
                part = b.iloc[at : at + size]
                yield pd.DataFrame({"ids": [part["id"].to_numpy(np.int64).tobytes()], "gs": [part["g"].to_numpy(np.int64).tobytes()], "vs": [_units(part["v"].to_list()).tobytes()]})

    return run


def _unpacked(ids: bytes, groups: bytes, vectors: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    found = np.frombuffer(ids, np.int64)
    return found, np.frombuffer(groups, np.int64), np.frombuffer(vectors, np.float64).reshape(len(found), -1)


def cache_hits(cached: DataFrame, queries: DataFrame, least: float = P.CACHE_SIMILAR, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """SET-05: (query_id, hit, score): the nearest cached question if it is near enough, else a null hit."""
    best = topk(cached, queries, 1, id_col, vec_col)
    out = queries.select(F.col(id_col).alias("query_id")).join(best, "query_id", "left")
    return out.select("query_id", F.when(F.col("score") >= least, F.col("doc")).alias("hit"), "score")
