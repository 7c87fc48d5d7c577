"""op10: SimHash near-duplicates. XXH64 is not in the SQL oracle; tests compare with brute force."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, simhash


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op10_simhash_near_dedup": op10_simhash_near_dedup}
ORACLES: dict[str, str] = {}
