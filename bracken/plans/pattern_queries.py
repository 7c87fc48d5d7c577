"""Queries that look for many patterns at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import patterns
from ..session import table


def dictionary_hits(spark, sf):
    """JN-05, FLT-10: where the words of the parts' names and types, and the first three letters of each, stand in the documents."""
    p = table(spark, sf, "part")
    words = p.select(F.explode(F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " ")).alias("w"))
    words = words.select(F.explode(F.array("w", F.left("w", F.lit(3)))).alias("pattern"))
    return patterns.hits(table(spark, sf, "documents"), words).select(F.col("id").alias("doc_id"), "pattern", "start")


QUERIES = {f.__name__: f for f in (dictionary_hits,)}

ORACLES = {
    "dictionary_hits": """WITH w AS (SELECT DISTINCT unnest([w, left(w, 3)]) AS w FROM (SELECT DISTINCT unnest(string_split(lower(p_name || ' ' || p_type), ' ')) AS w FROM part)),
 s AS (SELECT doc_id, w, list_transform(string_split(text, w), lambda x: length(x)) AS n FROM documents JOIN w ON w <> '' AND contains(text, w))
 SELECT doc_id, w AS pattern, CAST(unnest(list_transform(range(1, len(n)), lambda i: list_sum(n[1:i]) + (i - 1) * length(w))) AS BIGINT) AS start FROM s""",
}
