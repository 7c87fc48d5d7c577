"""Sinks: validated overwrite, append, keyed merge, JSON export."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def overwrite(df: DataFrame, path: str, valid: Column | None = None, partition: str | None = "collection") -> None:
    """SNK-01, SNK-02: rows are checked before anything is removed; only the partitions that are written are replaced."""
    if valid is not None and (bad := df.filter(~valid).limit(1).count()):
        raise ValueError(f"{bad} or more rows are not valid; nothing was written")
    w = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (w.partitionBy(partition) if partition else w).parquet(path)


def append(df: DataFrame, path: str, partition: str | None = "collection") -> None:
    """SNK-03."""
    w = df.write.mode("append")
    (w.partitionBy(partition) if partition else w).parquet(path)


def merged(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """SNK-05: new rows replace old ones of their key."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def export_json(df: DataFrame, path: str) -> None:
    """SNK-08."""
    df.write.mode("overwrite").json(path)


def vectors_valid(vec: Column, dim: int) -> Column:
    """MIS-06 as a check before writing."""
    from ..operators.vector import invalid

    return ~invalid(vec, dim)


def retagged(chunks: DataFrame, kind: Column) -> tuple[DataFrame, DataFrame]:
    """SNK-04: (chunks with the new source type, changes by old and new type); vectors stay as they are."""
    out = chunks.withColumn("_new", kind)
    report = out.groupBy(F.col("source_type").alias("before"), F.col("_new").alias("after")).agg(F.count("*").alias("n"))
    return out.withColumn("source_type", F.col("_new")).drop("_new"), report


def publish(df: DataFrame, path: str, form: str = "parquet") -> None:
    """SNK-07: written beside the path first and renamed at once; readers see the old rows or the new ones."""
    spark = df.sparkSession
    temporary, old = f"{path}.{uuid.uuid4().hex}.tmp", f"{path}.{uuid.uuid4().hex}.old"
    df.write.format(form).save(temporary)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    had = fs.exists(hadoop(path))
    if had and not fs.rename(hadoop(path), hadoop(old)):
        raise OSError(f"{path} cannot be replaced")
    if not fs.rename(hadoop(temporary), hadoop(path)):
        if had:
            fs.rename(hadoop(old), hadoop(path))
        raise OSError(f"{temporary} cannot be renamed")
    if had:
        fs.delete(hadoop(old), True)


class Conflict(RuntimeError):
    """The version that a write was meant for is not the current one."""


def _versions(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    folder = hadoop(f"{path}/versions")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs, hadoop, sorted(s.getPath().getName() for s in fs.listStatus(folder)) if fs.exists(folder) else []


def current(spark: SparkSession, path: str) -> tuple[int, DataFrame | None]:
    """SNK-06: the version of a table that is written by ``replace_if``, and its rows; (0, None) before the first."""
    _, _, names = _versions(spark, path)
    if not names:
        return 0, None
    data = spark.read.text(f"{path}/versions/{names[-1]}").first()[0]
    return int(names[-1]), spark.read.parquet(f"{path}/{data}")


def replace_if(df: DataFrame, path: str, version: int) -> int:
    """SNK-06: writes ``df`` as the next version if ``version`` is still the current one, else ``Conflict``, upon which a writer
    reads again. The rows are written first; the version is a file that only one writer can create, so that of several
    with one version one succeeds. Readers keep what they read."""
    spark, data = df.sparkSession, f"rows-{uuid.uuid4().hex}"
    fs, hadoop, names = _versions(spark, path)
    if (int(names[-1]) if names else 0) != version:
        raise Conflict(f"{path}: version {version} is not the current one")
    df.write.parquet(f"{path}/{data}")
    marker = hadoop(f"{path}/versions/{version + 1:09d}")
    try:
        out = fs.create(marker, False)
    except Exception as e:  # noqa: BLE001  whatever the file system throws for a file that is there
        fs.delete(hadoop(f"{path}/{data}"), True)
        if fs.exists(marker):
            raise Conflict(f"{path}: version {version + 1} is another writer's") from e
        raise
    out.write(bytearray(data.encode()))
    out.close()
    return version + 1


def swapped(writes: DataFrame) -> DataFrame:
    """SNK-06, STR-06 over (key, ord, value): (key, version, value): writers that read again until their version is the
    current one end with all writes applied in order; that end is folded at once."""
    return writes.groupBy("key").agg(F.count("*").alias("version"), F.max_by("value", "ord").alias("value"))
