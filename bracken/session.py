"""Session defaults, tables, and the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}
_own_dirs: dict[str, str] = {}


def session(app: str = "bracken", **more: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    for k, v in (DEFAULTS | more).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """``df`` for a broadcast if it has at most so many rows, which is counted; else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def dealt(df: DataFrame) -> DataFrame:
    """Small rows dealt evenly over all cores, where what is made of a row costs far more than to move it and a table's files may
    have fewer pieces than there are cores. The number is given, so that adaptive execution leaves it."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Unset it may be in local mode only, for a temporary folder; on a cluster
    executors could not see each other's files."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        if not re.fullmatch(r"local(?:\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        _own_dirs[app] = tempfile.mkdtemp(prefix="bracken-")
        spark.sparkContext.setCheckpointDir(_own_dirs[app])
    return (spark.sparkContext.getCheckpointDir() or _own_dirs[app]).rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the JVM may be gone already; the folder is scratch space
        pass


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; deleted when the driver's interpreter ends."""
    path = f"{shared_dir(spark)}/bracken-{uuid.uuid4().hex}-{label}"
    atexit.register(remove, spark, path)
    return path


def shared_table(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: its lineage ends there, and it is computed once. Lost executors
    cost no recomputation of what lies before, as the files are not theirs."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def release(*tables: DataFrame | None) -> None:
    """Deletes written tables that nothing reads any more; what is no such table is left alone."""
    for t in tables:
        if path := getattr(t, "_shared_path", None):
            remove(t.sparkSession, path)
