"""op5: the language of every document. Tests measure held-out accuracy."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, langid


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    models = langid.fit(*langid.sample(docs))
    return langid.identified(docs, models).withColumn("held_out", common.held_out(F.col("doc_id")))


QUERIES = {"op5_language_id": op5_language_id}
ORACLES: dict[str, str] = {}
