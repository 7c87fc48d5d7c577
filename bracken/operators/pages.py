"""Pages: lines with their place and size to elements, result pages to snippets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import profiles as P
from ..functions import text as T
from . import filters


def body_lines(lines: DataFrame) -> DataFrame:
    """TXT-12 over (doc, page, pos, y, height, size, text): without blank and noise lines, and without short lines in the
    top and bottom margin unless the page has nothing else."""
    rows = lines.withColumn("text", T.strip(F.coalesce("text", F.lit("")))).withColumn("size", T.font_size(F.col("size").cast("string")))
    rows = rows.filter(~T.is_ocr_noise(F.col("text")))
    edge = (F.col("y") <= F.col("height") * P.MARGIN_RATIO) | (F.col("y") >= F.col("height") * (1 - P.MARGIN_RATIO))
    rows = rows.withColumn("_margin", F.coalesce((F.col("height") > 0) & (F.length("text") <= P.MARGIN_CHARS) & edge, F.lit(False)))
    body = F.count_if(~F.col("_margin")).over(Window.partitionBy("doc", "page"))
    return rows.withColumn("_body", body).filter(~F.col("_margin") | (F.col("_body") == 0)).drop("_margin", "_body")


def page_elements(lines: DataFrame, sizes: DataFrame) -> DataFrame:
    """TXT-13 over lines (doc, page, pos, size, text) and heading sizes (doc, size, level): (doc, page, pos, kind, level,
    content). A short line of a heading's size is a heading; lines between headings are joined to a paragraph."""
    rows = lines.join(sizes.select("doc", "size", "level"), ["doc", "size"], "left")
    head = F.col("level").isNotNull() & (F.length("text") <= P.HEADING_CHARS)
    rows = rows.withColumn("_head", head)
    up = Window.partitionBy("doc", "page").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    # lines after the same number of headings are one paragraph; a heading is an island of its own
    rows = rows.withColumn("_island", F.sum(F.col("_head").cast("int")).over(up))
    by = rows.groupBy("doc", "page", "_island", "_head").agg(F.min("pos").alias("pos"), F.max("level").alias("level"), T.joined_lines(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"])).alias("content"))
    return by.filter("content <> ''").select("doc", "page", "pos", F.when(F.col("_head"), "heading").otherwise("paragraph").alias("kind"), F.when(F.col("_head"), F.col("level")).alias("level"), "content")


def engine_results(blocks: DataFrame) -> DataFrame:
    """SRC-09 over (query_id, engine, page_id, pos, block): (query_id, engine, rank, snippet) of the first engine with any
    snippet; a query without one has no row."""
    found = filters.snippets(blocks.select("page_id", "pos", "block"))
    of = found.join(blocks.select("query_id", "engine", "page_id").distinct(), "page_id")
    first = of.groupBy("query_id").agg(F.min("engine").alias("engine"))
    return of.join(first, ["query_id", "engine"]).select("query_id", "engine", "rank", "snippet")
