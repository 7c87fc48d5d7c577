"""Ingest: texts to chunks with their source type and vector."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chunk, fusion, rerank


def ingested(docs: DataFrame, cache: DataFrame, embed, version: str, model: str) -> DataFrame:
    """RET-12 over (doc_id, text, source) and a cache (key, vec): (doc_id, ordinal, source, source_type, heading, text, key,
    vec), ready for a sink (SNK-01 checks vectors before it replaces anything). ``embed`` is asked for texts that the
    cache does not have."""
    c = chunk.chunked(chunk.elements(docs)).select("doc_id", "ordinal", "source", "heading", "text")
    c = c.withColumn("source_type", fusion.source_type(F.col("source")))
    vectors = rerank.embedded(c.select(F.struct("doc_id", "ordinal").alias("id"), "text"), cache, embed, version, model)
    return c.join(vectors.select("id.doc_id", "id.ordinal", "key", "vec"), ["doc_id", "ordinal"])
