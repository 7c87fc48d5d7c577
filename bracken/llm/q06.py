"""op6: all documents with surrogates for personal data. Tests compare with a plain replacement."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, pii


def op6_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.replaced(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    kinds = F.array_join(F.transform("pii_spans", lambda s: s["kind"]), ",")
    return out.select("doc_id", "text", F.greatest("pii_count", F.lit(0)).alias("n_entities"), kinds.alias("kinds"))


QUERIES = {"op6_pii_surrogates": op6_pii_surrogates}
ORACLES: dict[str, str] = {}
