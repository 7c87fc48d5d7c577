"""op4: all pages to WARC archives and back. Tests compare with digests taken from the table."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, warc


def op4_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url", "html")
    to = common.shared_path(spark, "warc")
    warc.write(pages, to)
    kind = pages.schema["page_id"].dataType
    out = warc.read(spark, to)
    return out.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"), "error")


QUERIES = {"op4_warc_segments": op4_warc_segments}
ORACLES: dict[str, str] = {}
