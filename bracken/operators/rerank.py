"""Injected models: rerankers and embedders, with caches keyed by content."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scored(pairs: DataFrame, score, chars: int = 500) -> DataFrame:
    """RET-05, STR-16 over (query, text): adds rerank by ``score(queries, texts) -> list of floats``. Distinct pairs are
    scored once; a query with one candidate needs no model."""

    @F.pandas_udf("double")
    def run(q: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series(score(q.tolist(), t.tolist()))

    p = pairs.withColumn("_head", F.substring("text", 1, chars))
    distinct = p.select("query", "_head").distinct()
    n = distinct.groupBy("query").agg(F.count("*").alias("_n"))
    many = distinct.join(n, "query")
    done = many.filter("_n > 1").withColumn("rerank", run("query", "_head")).unionByName(many.filter("_n = 1").withColumn("rerank", F.lit(1.0))).drop("_n")
    return p.join(done, ["query", "_head"]).drop("_head")


def cache_key(version: str, model: str, text: Column) -> Column:
    """MIS-05."""
    return F.left(F.sha2(F.concat_ws("\x1f", F.lit(version), F.lit(model), text), 256), F.lit(16))


def embedded(texts: DataFrame, cache: DataFrame, embed, version: str, model: str) -> DataFrame:
    """MIS-05, RET-12 over (id, text) and a cache (key, vec): vectors from the cache, others by ``embed(texts)``."""

    @F.pandas_udf("array<float>")
    def run(t: pd.Series) -> pd.Series:
        return pd.Series([list(map(float, v)) for v in embed(t.tolist())])

    keyed = texts.withColumn("key", cache_key(version, model, F.col("text")))
    known = keyed.join(cache.select("key", "vec"), "key")
    new = keyed.join(cache.select("key"), "key", "left_anti").withColumn("vec", run("text"))
    return known.select("id", "key", "vec").unionByName(new.select("id", "key", "vec"))
