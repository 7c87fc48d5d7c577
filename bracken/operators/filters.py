"""Filters over tables: cleaning, exclusion, page tests, definitions, snippets, heading sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import profiles as P
from ..functions import text as T


def cleaned(docs: DataFrame, p: P.FrontMatter = P.CHINESE, text_col: str = "text") -> DataFrame:
    """FLT-03/04: adds kind and cleaned; cleaned is empty where the chunk is dropped."""
    text, kind = T.clean_chunk(F.coalesce(F.col(text_col), F.lit("")), p)
    return docs.withColumn("kind", kind).withColumn("cleaned", text)


def drop_histogram(cleaned_docs: DataFrame) -> DataFrame:
    """FLT-04: chunks and drops by reason."""
    return cleaned_docs.filter("kind <> ''").groupBy(F.col("kind").alias("reason")).agg(F.count("*").alias("n_chunks"), F.count_if(F.col("cleaned") == "").alias("n_dropped"))


def excluded(files: DataFrame, name_col: str, rules: tuple[tuple[str, str], ...], exact: tuple[str, ...] = ()) -> DataFrame:
    """FLT-11: adds reason, of the exact list or of the first rule whose text the name has; null if kept."""
    reason = F.when(F.col(name_col).isin(*exact), "listed") if exact else F.when(F.lit(False), "")
    for part, why in rules:
        reason = reason.when(F.col(name_col).contains(part), why)
    return files.withColumn("reason", reason)


def needs_vision(pages: DataFrame, least: int = 200, ratio: float = 0.5, samples: int = 12) -> DataFrame:
    """FLT-12 over (doc, page from 1, chars): first, last and evenly spaced pages are tested."""
    whole = Window.partitionBy("doc")
    n = F.count("*").over(whole)
    step = F.greatest(F.lit(1), F.floor(n / samples))
    sampled = pages.withColumn("_n", n).withColumn("_step", step).filter((F.col("page") == 1) | (F.col("page") == F.col("_n")) | ((F.col("page") - 1) % F.col("_step") == 0))
    ok = F.avg(F.when(F.col("chars") >= least, 1.0).otherwise(0.0))
    return sampled.groupBy("doc").agg(F.count("*").alias("n_sampled"), F.round(ok, 6).alias("ok_ratio"), (ok < ratio).alias("needs_vision"))


def screenshots(pages: DataFrame, aspect: float = 3.0) -> DataFrame:
    """FLT-13 over (doc, w, h): all pages are portrait and at least so tall."""
    return pages.groupBy("doc").agg(F.bool_and(F.col("h") / F.col("w") >= aspect).alias("is_screenshot"))


def spread(w: Column, h: Column) -> Column:
    """MTH-04: a landscape page of two."""
    return (w > h) & (w / h >= 1.2)


def field_definitions(raw: DataFrame) -> DataFrame:
    """FLT-14 over (save_id, ordinal, name, kind): valid names, the first of each; kind is number by default."""
    valid = raw.filter(F.col("name").rlike("^[A-Za-z][A-Za-z0-9_]{0,23}$"))
    first = Window.partitionBy("save_id", "name").orderBy("ordinal")
    kind = F.when(F.col("kind").isin("number", "tag"), F.col("kind")).otherwise("number")
    return valid.withColumn("_rn", F.row_number().over(first)).filter("_rn = 1").select("save_id", "name", kind.alias("kind"), "ordinal")


def slug(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def is_account(name: Column) -> Column:
    return name.rlike("^[A-Za-z0-9_]{3,32}$")


def snippets(blocks: DataFrame, least: int = 25, most: int = 360, key: int = 40, top: int = 8) -> DataFrame:
    """TOP-11 over (page_id, pos, block): (page_id, rank, snippet)."""
    s = blocks.select("page_id", "pos", T.strip(F.col("block")).alias("snippet")).filter(F.length("snippet").between(least, most))
    same = Window.partitionBy("page_id", F.left("snippet", F.lit(key))).orderBy("pos")
    order = Window.partitionBy("page_id").orderBy("pos")
    s = s.withColumn("_d", F.row_number().over(same)).filter("_d = 1").withColumn("rank", F.row_number().over(order).cast("long"))
    return s.filter(F.col("rank") <= top).select("page_id", "rank", "snippet")


def heading_sizes(lines: DataFrame, larger: float = 1.12, share: float = 0.06) -> DataFrame:
    """AGG-13 over (doc, size, chars): sizes of headings with their level; the body has the most characters."""
    by = lines.groupBy("doc", F.round("size", 1).alias("size")).agg(F.sum("chars").alias("chars"), F.count("*").alias("lines"))
    body = by.groupBy("doc").agg(F.max_by("size", F.struct("chars", "size")).alias("body"), F.sum("lines").alias("total"))
    heads = by.join(body, "doc").filter((F.col("size") >= larger * F.col("body")) & (F.col("lines") <= share * F.col("total")))
    level = F.dense_rank().over(Window.partitionBy("doc").orderBy(F.desc("size"))).cast("long")
    return heads.select("doc", "body", "size", level.alias("level"))
