"""Exact, content-id and cross-format duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import small


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """SET-01, AGG-07: (id, keeper, copies) of documents that have copies. Texts are not shuffled, their digests are."""
    h = docs.select(id_col, F.length(text_col).alias("_n"), F.sha2(text_col, 256).alias("_sha"))
    g = h.groupBy("_n", "_sha").agg(F.count("*").alias("copies"), F.min(id_col).alias("keeper")).filter("copies > 1")
    return h.join(small(g), ["_n", "_sha"]).select(id_col, "keeper", "copies")


def shallowest(files: DataFrame) -> DataFrame:
    """TOP-09 over (path, sha): of equal files the shallowest path stays, then the smallest; adds keeper."""
    depth = F.size(F.split("path", "/"))
    best = files.groupBy("sha").agg(F.min(F.struct(depth.alias("depth"), F.col("path"))).getField("path").alias("keeper"))
    return files.join(best, "sha")


def content_ids(chunks: DataFrame, id_col: str = "doc_id", text_col: str = "text", first: int = 200) -> DataFrame:
    """SET-09, DM-05: one candidate for the chunks that share their first characters."""
    return chunks.groupBy(F.md5(F.substring(text_col, 1, first)).alias("content_id")).agg(F.count("*").alias("n_chunks"), F.min(id_col).alias("first_id"))


def cross_format(files: DataFrame, pages: int = 100, chars: int = 100_000, ratio: float = 0.5) -> DataFrame:
    """SET-02 over (file_id, stem, ext, pages, chars): adds title and dropped. Of one paged and one plain file
    of a title the paged one goes if both have enough."""
    paged, plain = F.col("ext") == ".pdf", F.col("ext").isin(".txt", ".md")
    f = files.withColumn("title", T.normalise_title(F.col("stem")))
    g = f.groupBy("title").agg(F.count_if(paged).alias("_p"), F.count_if(plain).alias("_t"), F.max(F.when(paged, F.col("pages"))).alias("_pages"), F.max(F.when(paged, F.col("chars"))).alias("_pc"), F.max(F.when(plain, F.col("chars"))).alias("_tc"))
    drop = paged & (F.col("_p") == 1) & (F.col("_t") == 1) & (F.col("_pages") >= pages) & (F.col("_pc") >= chars) & (F.col("_tc") >= ratio * F.col("_pc"))
    return f.join(g, "title").withColumn("dropped", drop).drop("_p", "_t", "_pages", "_pc", "_tc")
