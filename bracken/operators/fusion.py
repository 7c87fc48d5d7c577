"""Rank fusion, selection in two segments, the rerank fallback, traces and context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import profiles as P
from ..functions import text as T
from ..session import small

CLASS_WEIGHTS = {"vector": 1.0, "bm25": 1.0}


def source_type(source: Column, rules: tuple[tuple[str, str], ...] = P.SOURCE_RULES) -> Column:
    """JN-04: the type of the first rule whose text the source has; a chain of conditions, no join."""
    out = F.when(F.coalesce(source, F.lit("")) == "", "unknown")
    for part, kind in rules:
        out = out.when(source.contains(part), kind)
    return out.otherwise("unknown")


def source_weight(kind: Column, weights: dict[str, float] = P.SOURCE_WEIGHTS) -> Column:
    out = F.when(kind.isNull(), weights["unknown"])
    for k, w in weights.items():
        out = out.when(kind == k, w)
    return out.otherwise(weights["unknown"])


def fused(boards: DataFrame, weights: DataFrame | None = None, class_weights: dict[str, float] | None = None, k: int = P.RRF_K) -> DataFrame:
    """AGG-10 to 12, RET-03: boards (query_id, class, doc, rank from 0) to (query_id, doc, score, vector_rank, bm25_rank, contrib).

    A class has one vote a document, its best rank; ``weights`` (doc, weight) weighs sources.
    """
    best = boards.groupBy("query_id", "class", "doc").agg(F.min("rank").alias("rank"))
    cw = F.lit(1.0)
    for name, w in (class_weights or CLASS_WEIGHTS).items():
        cw = F.when(F.col("class") == name, w).otherwise(cw)
    if weights is not None:
        weights = weights.select("doc", "weight").join(small(best.select("doc").distinct()), "doc", "left_semi")
        best = best.join(weights, "doc", "left")
        cw = cw * F.coalesce("weight", F.lit(1.0))
    best = best.withColumn("part", cw / (k + F.col("rank") + 1))
    by = best.groupBy("query_id", "doc").agg(
        F.round(F.sum("part"), 9).alias("score"),
        F.min(F.when(F.col("class") == "vector", F.col("rank"))).alias("vector_rank"),
        F.min(F.when(F.col("class") == "bm25", F.col("rank"))).alias("bm25_rank"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("class", F.round("part", 9))))).alias("contrib"),
    )
    return by


def fused_order() -> list[Column]:
    """TOP-04: score, then place on the vector board, then on the lexical one."""
    return [F.desc("score"), F.asc_nulls_last("vector_rank"), F.asc_nulls_last("bm25_rank"), F.asc("doc")]


def fallback_score(query: Column, text: Column) -> Column:
    """RET-06: share of the lower-cased query's words that the text contains."""
    terms = F.filter(F.split(F.lower(query), r"(?U)\s+"), lambda x: x != "")
    return F.round(F.size(F.filter(terms, lambda t: F.contains(F.lower(text), t))) / F.greatest(F.size(terms), F.lit(1)), 6)


def two_segments(candidates: DataFrame, scorer=fallback_score, pool: int = P.POOL, anchor: int = P.ANCHOR, top_k: int = P.TOP_STRONG, chars: int = 500) -> DataFrame:
    """TOP-05 over fused candidates with query and text: the first ``anchor`` keep their place, the rest of the
    pool is ordered by ``scorer`` on its first characters, and the whole is cut to ``top_k``."""
    order = Window.partitionBy("query_id").orderBy(*fused_order())
    c = candidates.withColumn("rrf_rank", F.row_number().over(order) - 1).filter(F.col("rrf_rank") < F.greatest(F.lit(pool), F.lit(top_k)))
    c = c.withColumn("rerank", F.when(F.col("rrf_rank") >= anchor, scorer(F.col("query"), F.substring("text", 1, chars))))
    final = Window.partitionBy("query_id").orderBy(F.col("rrf_rank") >= anchor, F.when(F.col("rrf_rank") < anchor, F.col("rrf_rank")), F.desc("rerank"), "rrf_rank")
    return c.withColumn("rank", F.row_number().over(final) - 1).filter(F.col("rank") < top_k)


def routes(vector: DataFrame | None, lexical: DataFrame | None) -> tuple[DataFrame, str]:
    """RET-07: the boards of the routes that are there, and the mode; an error if neither is."""
    if vector is None and lexical is None:
        raise ValueError("neither route is available")
    named = [(df.withColumn("class", F.lit(name))) for name, df in (("vector", vector), ("bm25", lexical)) if df is not None]
    out = named[0] if len(named) == 1 else named[0].unionByName(named[1], allowMissingColumns=True)
    return out, "hybrid" if len(named) == 2 else "vector_only" if vector is not None else "lexical_only"


def depths(top_k: int = P.TOP_STRONG, reranks: bool = True) -> tuple[int, int]:
    """TOP-03: (pool of the reranker, candidates that each board fetches)."""
    pool = max(top_k, P.POOL) if reranks else top_k
    return pool, 2 * max(top_k, pool)


def with_metadata(candidates: DataFrame, docs: DataFrame) -> DataFrame:
    """JN-02 over (doc, ...) and (doc, source, text): a candidate without metadata stays, with empty ones."""
    # an outer join cannot broadcast its left side: the few documents that are candidates are taken first, so that no text is shuffled
    named = docs.select("doc", "source", "text").join(small(candidates.select("doc").distinct()), "doc", "left_semi")
    out = candidates.join(named, "doc", "left")
    return out.withColumn("source", F.coalesce("source", F.lit(""))).withColumn("text", F.coalesce("text", F.lit("")))


def retrieved(mode: str, queries: DataFrame, docs: DataFrame, vector: DataFrame | None, lexical: DataFrame | None, weights: DataFrame | None = None, top_k: int = P.TOP_STRONG, scorer=fallback_score) -> DataFrame:
    """RET-04, RET-10 over queries (query_id, query), docs (doc, source, text) and the boards (query_id, doc, rank):
    (query_id, doc, rank, source, text, rrf_rank, score, rerank, vector_rank, bm25_rank, mode).

    ``full`` fuses both boards and selects in two segments; a route that is missing is left out and named in the
    mode (RET-07). ``vector_only`` has the nearest documents alone. ``agent`` is what a model gets that asks itself:
    the full selection of the query that it wrote.
    """
    if mode not in ("full", "vector_only", "agent"):
        raise ValueError(f"no mode {mode}")
    if mode == "vector_only":
        c = with_metadata(vector.filter(F.col("rank") < top_k).select("query_id", "doc", F.col("rank").cast("int").alias("rank"), "score"), docs)
        empty = F.lit(None).cast("int")
        return c.select("query_id", "doc", "rank", "source", "text", F.col("rank").alias("rrf_rank"), "score", F.lit(None).cast("double").alias("rerank"), F.col("rank").alias("vector_rank"), empty.alias("bm25_rank"), F.lit(mode).alias("mode"))
    boards, found = routes(vector, lexical)
    c = with_metadata(fused(boards.select("query_id", "class", "doc", "rank"), weights), docs).join(queries.select("query_id", "query"), "query_id")
    out = two_segments(c, scorer, depths(top_k)[0], top_k=top_k)
    return out.select("query_id", "doc", "rank", "source", "text", "rrf_rank", "score", "rerank", "vector_rank", "bm25_rank", F.lit(found if mode == "full" else f"agent {found}").alias("mode"))


def trace(selected: DataFrame, anchor: int = P.ANCHOR) -> DataFrame:
    """RET-08: of each selected document its places on the boards, in the fused order and at the end, whether it is an
    anchor, and how far the reranker moved it. It is made of the selection and changes nothing in it."""
    return selected.select("query_id", "doc", "vector_rank", "bm25_rank", "rrf_rank", "rank", (F.col("rrf_rank") < anchor).alias("anchor"), (F.col("rrf_rank") - F.col("rank")).alias("moved"), "mode")


def with_evidence(results: DataFrame, evidence: DataFrame) -> DataFrame:
    """JN-11, SET-08 over results (query_id, pos, doc, text) and evidence of the graph (query_id, pos, doc, text): the
    results, and after them evidence whose content is not there yet, each content once; adds inferred."""
    key = F.md5(F.substring("text", 1, 200))
    e = evidence.withColumn("_key", key)
    new = e.join(results.select("query_id", key.alias("_key")).distinct(), ["query_id", "_key"], "left_anti")
    first = Window.partitionBy("query_id", "_key").orderBy("pos", "doc")
    new = new.withColumn("_rn", F.row_number().over(first)).filter("_rn = 1")
    n = results.groupBy("query_id").agg((F.max("pos") + 1).alias("_n"))
    order = Window.partitionBy("query_id").orderBy("pos", "doc")
    new = new.withColumn("pos", F.row_number().over(order) - 1).join(n, "query_id", "left").withColumn("pos", F.col("pos") + F.coalesce("_n", F.lit(0)))
    cols = ["query_id", "pos", "doc", "text"]
    return results.select(*cols).withColumn("inferred", F.lit(False)).unionByName(new.select(*cols).withColumn("inferred", F.lit(True)))


def numbered(evidence: DataFrame) -> DataFrame:
    """WIN-12 over (query_id, pos, inferred): adds label, [1], [2], ... and [G1], [G2], ... for inferred rows."""
    w = Window.partitionBy("query_id", "inferred").orderBy("pos")
    n = F.row_number().over(w).cast("string")
    return evidence.withColumn("label", F.concat(F.when(F.col("inferred"), "[G").otherwise("["), n, F.lit("]")))


def contexts(evidence: DataFrame) -> DataFrame:
    """RET-09, TXT-28 over (query_id, pos, inferred, source, text, tail): (query_id, context, sources)."""
    text, _ = T.with_continuation(F.col("text"), F.col("source"), F.col("tail"))
    rows = numbered(evidence).withColumn("_line", F.concat_ws(" ", "label", F.concat(F.lit("("), "source", F.lit(")")), text))
    joined = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", c))), lambda x: x[c]), "\n")
    rows = rows.withColumn("_source", F.concat_ws(" ", "label", "source"))
    return rows.groupBy("query_id").agg(joined("_line").alias("context"), joined("_source").alias("sources"))
