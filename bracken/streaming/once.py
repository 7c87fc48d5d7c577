"""Decisions that count once and deletions that block what comes back, on streams.

Both keep state only as long as the watermark lets it matter: a decision's key goes ``late`` after its event time, a tombstone
when nothing can ask for it any more. Rows behind the watermark are dropped by Spark and decide nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_path
from .run import drained


def claimed(decisions: DataFrame, keys: list[str], ts: str = "ts", late: str = "2 days") -> DataFrame:
    """STR-07 on a stream: of the rows with equal keys (nulls are equal) one, of the earliest trigger that has any. It holds for
    rows whose event times lie within ``late`` of each other, and for all if a key spans no more than that."""
    return decisions.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def restored(restores: DataFrame, tombstones: DataFrame, key: str, horizon: str = "30 days", late: str = "2 days", ts: str = "ts") -> DataFrame:
    """STR-17 on two streams: the restores without a tombstone of their key in the ``horizon`` before them, itself included.

    A restore is told once no tombstone for it can come any more, which is when the later of both watermarks has passed
    it; a tombstone of a later trigger still blocks until then. A null key is blocked by nothing.
    """
    r = restores.withWatermark(ts, late)
    t = tombstones.select(F.col(key).alias("_tomb"), F.col(ts).alias("_died")).withWatermark("_died", late)
    blocks = (F.col(key) == F.col("_tomb")) & (F.col("_died") <= F.col(ts)) & (F.col("_died") >= F.col(ts) - F.expr(f"INTERVAL {horizon}"))
    return r.join(t, blocks, "left_outer").filter(F.col("_tomb").isNull()).select(*restores.columns)


def in_parts(spark: SparkSession, sources: dict[str, DataFrame], plan: Callable[..., DataFrame], part: str = "part", at: str | None = None) -> DataFrame:
    """What ``plan`` of the streams ``sources`` writes when their rows arrive part by part, in order of ``part``.

    Every part is appended to the streams' folders and the plan is started again on its checkpoint, so that state crosses
    triggers and restarts. The number of parts is that of distinct values, which is meant to be small.
    """
    at = at or shared_path(spark, "parts")
    values: set = set()
    for df in sources.values():
        values |= {r[0] for r in df.select(part).distinct().collect()}
    out = None
    for v in sorted(values):
        streams = {}
        for name, df in sources.items():
            df.filter(F.col(part) == v).write.mode("append").parquet(f"{at}/in-{name}")
            streams[name] = spark.readStream.schema(df.schema).parquet(f"{at}/in-{name}")
        out = drained(spark, plan(**streams), at=at)
    if out is None:
        out = drained(spark, plan(**{n: _none(spark, df, f"{at}/in-{n}") for n, df in sources.items()}), at=at)
    return out


def _none(spark: SparkSession, df: DataFrame, path: str) -> DataFrame:
    df.limit(0).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)
