"""Running a streaming plan over files to its end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import shared_path


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table's files as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}*.parquet")


def drained(spark: SparkSession, df: DataFrame, mode: str = "append", at: str | None = None) -> DataFrame:
    """Everything that is there now, through a written sink and back as a table.

    Sink and checkpoint lie at ``at``; a later call with the same place resumes from its cursor and takes only what
    is new (STR-15). Without a place they lie in the shared folder until the driver ends.
    """
    at = at or shared_path(spark, "stream")
    if mode == "append":
        q = df.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start()
    else:
        q = df.writeStream.foreachBatch(lambda part, _: part.write.mode("overwrite").parquet(f"{at}/out")).option("checkpointLocation", f"{at}/state").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{at}/out")
