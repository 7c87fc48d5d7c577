"""op7: the quality of every document. Tests measure held-out accuracy."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, voting


def op7_quality_voting(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    table, labels = voting.labelled(docs, common.table(spark, sf_dir, "labels"))
    out = voting.scored(docs, voting.fit(table, labels) if len(labels) else None)
    return out.withColumn("held_out", common.held_out(F.col("doc_id"))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


QUERIES = {"op7_quality_voting": op7_quality_voting}
ORACLES: dict[str, str] = {}
