"""Keyed memories: recall, caps, near duplicates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import profiles as P
from ..session import small
from .vector import dot, topk


def capped(items: DataFrame, caps: dict[str, int] | None = None) -> DataFrame:
    """WIN-10 over (user_id, kind, updated_at, id): the newest of each user and kind."""
    caps = caps or P.MEMORY_CAPS
    w = Window.partitionBy("user_id", "kind").orderBy(F.desc("updated_at"), F.desc("id"))
    cap = F.lit(None).cast("int")
    for kind, n in caps.items():
        cap = F.when(F.col("kind") == kind, n).otherwise(cap)
    return items.withColumn("_rn", F.row_number().over(w)).filter(cap.isNull() | (F.col("_rn") <= cap)).drop("_rn")


def recalled(items: DataFrame, queries: DataFrame, profiles: int = P.MEMORY_TOP_PROFILES, topics: int = P.MEMORY_TOP_TOPICS, similar: float = P.MEMORY_SIMILAR) -> DataFrame:
    """TOP-10 over items (user_id, id, kind, text, vec, updated_at) and queries (query_id, user_id, vec): the newest
    profiles, then the nearest topics that are similar enough; a text that repeats stays at its first place."""
    q = small(queries.select("query_id", "user_id", F.col("vec").alias("qv")))
    both = items.join(q, "user_id")
    newest = Window.partitionBy("query_id").orderBy(F.desc("updated_at"), F.desc("id"))
    a = both.filter("kind = 'profile'").withColumn("rn", F.row_number().over(newest)).filter(F.col("rn") <= profiles).select("query_id", "id", "text", F.lit(0).alias("part"), "rn", F.lit(None).cast("double").alias("sim"))
    nearest = Window.partitionBy("query_id").orderBy(F.desc("sim"), "id")
    b = both.filter("kind = 'topic'").withColumn("sim", F.round(dot("vec", "qv"), 6)).withColumn("rn", F.row_number().over(nearest)).filter((F.col("rn") <= topics) & (F.col("sim") >= similar)).select("query_id", "id", "text", F.lit(1).alias("part"), "rn", "sim")
    rows = a.unionByName(b)
    first = Window.partitionBy("query_id", "text").orderBy("part", "rn")
    return rows.withColumn("_d", F.row_number().over(first)).filter("_d = 1").drop("_d")


def nearest_item(items: DataFrame, new: DataFrame, replace: float = P.MEMORY_REPLACE) -> DataFrame:
    """JN-16 over (user_id, kind, id, vec): for each new item the nearest other one of its user and kind, and whether
    it replaces that. All items of ``items`` are considered; new ones are dealt in blocks, no pair is shuffled."""
    best = topk(items, new, 1, "id", "vec", ["user_id", "kind"]).select(F.col("query_id").alias("id"), F.col("doc").alias("old_id"), F.col("score").alias("sim"))
    out = new.select("user_id", "kind", "id").join(best, "id", "left")
    return out.select("user_id", "kind", "id", "old_id", "sim", F.coalesce(F.col("sim") >= replace, F.lit(False)).alias("replaces"))


def merged(items: DataFrame, replace: float = P.MEMORY_REPLACE, most: int | None = None) -> DataFrame:
    """SET-04 over (user_id, kind, id, text, vec): items in order of id; one that is near an item kept before takes its
    place instead of a new one. With ``most`` (WIN-10) the oldest of more kept items goes. Each step depends on the
    one before: keys are sorted and streamed, and a task holds a batch and what its key keeps."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, kept, vectors = None, [], np.empty((0, 0))

        def done() -> pd.DataFrame:
            return pd.DataFrame({"user_id": [key[0]] * len(kept), "kind": key[1], "id": [k[0] for k in kept], "text": [k[1] for k in kept], "updates": [k[2] for k in kept]})

        for b in batches:
            for row in b.itertuples():
                if (row.user_id, row.kind) != key:
                    if kept:
                        yield done()
                    key, kept, vectors = (row.user_id, row.kind), [], np.empty((0, len(row.vec)))
                v = np.asarray(row.vec, float)
                sims = vectors @ v
                if len(sims) and sims.max() >= replace:
                    at = int(sims.argmax())
                    kept[at][1:] = [row.text, kept[at][2] + 1]
                    vectors[at] = v
                    continue
                kept.append([row.id, row.text, 0])
                vectors = np.vstack([vectors, v])
                if most and len(kept) > most:
                    kept, vectors = kept[1:], vectors[1:]
        if kept:
            yield done()

    rows = items.select("user_id", "kind", "id", "text", "vec").repartition("user_id", "kind").sortWithinPartitions("user_id", "kind", "id")
    return rows.mapInPandas(fold, "user_id long, kind string, id long, text string, updates long")
