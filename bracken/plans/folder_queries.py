"""Parts as notes and as picture cards, written to folders and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cards
from ..session import shared_path, table
from ..sources import folders
from .card_queries import FORM


def _saved(df: DataFrame, kind: type[folders.Folder], **limits: int) -> DataFrame:
    spark = df.sparkSession
    folders.register(spark)
    path = shared_path(spark, kind.name())
    df.write.format(kind.name()).mode("append").save(path)
    return spark.read.format(kind.name()).options(**limits).load(path)


def _notes(spark, sf, **limits: int) -> DataFrame:
    p = table(spark, sf, "part")
    head = F.create_map(F.lit("name"), "p_name", F.lit("brand"), "p_brand")
    body = F.concat("p_type", F.lit("\n\nsize: "), F.col("p_size").cast("string"))
    sections = F.when(F.col("p_size") % 3 == 0, F.create_map(F.lit("Kind"), body, F.lit("Price"), F.col("p_retailprice").cast("decimal(12,2)").cast("string"))).otherwise(F.create_map(F.lit("Kind"), body))
    return _saved(p.select(F.col("p_partkey").cast("long").alias("id"), head.alias("head"), sections.alias("sections")), folders.Notes, **limits)


def notes_read_back(spark, sf):
    """SRC-10: fields and sections of every note."""
    n = _notes(spark, sf)
    return n.select("id", n["head"]["name"].alias("name"), n["head"]["brand"].alias("brand"), n["sections"]["Kind"].alias("kind"), n["sections"]["Price"].alias("price"))


def notes_in_range(spark, sf):
    """SRC-07: the notes of a range of ids, which the source is given; other blocks are not opened."""
    n = _notes(spark, sf, low=41, high=90)
    return n.select("id", n["head"]["name"].alias("name"), F.size("sections").cast("long").alias("n_sections"))


def cards_read_back(spark, sf):
    """SRC-11, MIS-03: the card of every picture, checked."""
    p = table(spark, sf, "part")
    card = F.to_json(F.struct(F.lit(FORM).alias("format"), F.col("p_name").alias("name"), F.when(F.col("p_size") % 4 != 0, F.col("p_type")).alias("role_prompt")))
    c = _saved(p.select(F.col("p_partkey").cast("long").alias("id"), card.alias("card")), folders.Cards).select("id", cards.checked(F.col("card"), FORM).alias("c"))
    return c.select("id", "c.error", "c.card.name", "c.card.role_prompt")


QUERIES = {f.__name__: f for f in (notes_read_back, notes_in_range, cards_read_back)}
ORACLES = {
    "notes_read_back": "SELECT p_partkey AS id, p_name AS name, p_brand AS brand, p_type || chr(10) || chr(10) || 'size: ' || p_size AS kind, CASE WHEN p_size % 3 = 0 THEN CAST(CAST(p_retailprice AS DECIMAL(12, 2)) AS VARCHAR) END AS price FROM part",
    "notes_in_range": "SELECT p_partkey AS id, p_name AS name, CASE WHEN p_size % 3 = 0 THEN 2 ELSE 1 END AS n_sections FROM part WHERE p_partkey > 40 AND p_partkey <= 90",
    "cards_read_back": "SELECT p_partkey AS id, CASE WHEN p_size % 4 = 0 THEN 'content' END AS error, CASE WHEN p_size % 4 <> 0 THEN p_name END AS name, CASE WHEN p_size % 4 <> 0 THEN p_type END AS role_prompt FROM part",
}
