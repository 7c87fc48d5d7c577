"""Checks of cards that are made from the parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cards
from ..session import table

FORM = "own-card"


def card_checks(spark, sf):
    """MIS-03: a card of each part, broken in a way that its key, size and type tell."""
    k, n = F.col("p_partkey"), F.col("p_size")
    field = lambda name, value: F.concat(F.lit(f'"{name}":'), value)
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    parts = F.array_compact(F.array(
        F.when(k % 5 != 0, field("format", F.when(k % 7 == 0, quoted("p_type")).otherwise(quoted(F.lit(FORM))))),
        F.when(k % 3 != 0, field("version", F.when(k % 11 == 0, quoted(F.lit("1"))).otherwise((n % 3).cast("string")))),
        field("name", quoted(F.when(k % 13 == 0, "  ").otherwise(F.concat(F.lit(" "), "p_name")))),
        F.when(n % 4 != 0, field("role_prompt", quoted("p_brand"))), F.when(n % 5 == 1, field("background", quoted("p_type"))),
        F.when(k % 2 == 0, field("zone", quoted(F.when(k % 4 == 0, "education").otherwise(F.col("p_type"))))),
        field("lorebook", F.concat(F.lit("["), F.concat_ws(",", F.concat(F.lit('{"keyword":"'), "p_brand", F.lit('","content":"'), F.when(n % 2 == 0, "p_name").otherwise(""), F.lit('"}')), F.lit('{"keyword":"k"}'), F.lit("3")), F.lit("]"))),
    ))
    raw = F.concat(F.lit("{"), F.array_join(parts, ","), F.when(k % 17 == 0, "").otherwise("}"))
    c = table(spark, sf, "part").select("p_partkey", cards.checked(raw, FORM).alias("c"))
    return c.select("p_partkey", "c.error", "c.card.name", "c.card.description", "c.card.role_prompt", "c.card.background", "c.card.zone", F.size("c.card.lorebook").cast("long").alias("entries"))


QUERIES = {f.__name__: f for f in (card_checks,)}

ORACLES = {
    "card_checks": f"""WITH a AS (SELECT p_partkey, p_name, p_type, p_brand, p_size AS n, p_partkey AS k, CASE WHEN p_partkey % 17 = 0 THEN 'json'
  WHEN p_partkey % 5 <> 0 AND p_partkey % 7 = 0 THEN 'format' WHEN p_partkey % 3 <> 0 AND (p_partkey % 11 = 0 OR p_size % 3 > {cards.VERSION}) THEN 'version'
  WHEN p_partkey % 13 = 0 THEN 'name' WHEN p_size % 4 = 0 AND p_size % 5 <> 1 THEN 'content' END AS error FROM part)
 SELECT p_partkey, error, CASE WHEN error IS NULL THEN p_name END AS name, CASE WHEN error IS NULL THEN p_name END AS description,
  CASE WHEN error IS NULL THEN CASE WHEN n % 4 <> 0 THEN p_brand ELSE '' END END AS role_prompt, CASE WHEN error IS NULL THEN CASE WHEN n % 5 = 1 THEN p_type ELSE '' END END AS background,
  CASE WHEN error IS NULL THEN CASE WHEN k % 4 = 0 THEN 'education' ELSE 'entertainment' END END AS zone, CASE WHEN error IS NULL THEN CASE WHEN n % 2 = 0 THEN 1 ELSE 0 END END AS entries FROM a""",
}
