"""op9: the mix of all documents."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, mixing


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = mixing.mix(docs, keep=["doc_id"])
    return mixed.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_size") * F.col("mix_copies")).alias("taken"))


#: Common table expressions up to ``mixed`` (doc_id, size, source_size, target, copies) over a view {docs}.
MIX_CTES = r"""
mix_sized AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS k FROM {docs}),
mix_src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rnk FROM mix_sized GROUP BY source),
mix_w AS (SELECT *, (rnk - 1) % 3 + 1 AS weight, source_size * 3 AS cap, CAST(source_size * 3 AS DOUBLE) / ((rnk - 1) % 3 + 1) AS ratio FROM mix_src),
mix_l AS (SELECT *, CAST((SELECT sum(source_size) FROM mix_w) - coalesce(sum(cap) OVER p, 0) AS DOUBLE) / CAST((SELECT sum(weight) FROM mix_w) - coalesce(sum(weight) OVER p, 0) AS DOUBLE) AS lvl
    FROM mix_w WINDOW p AS (ORDER BY ratio, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
mix_t AS (SELECT source, rnk, source_size, least(CAST(cap AS DOUBLE), coalesce((SELECT lvl FROM mix_l WHERE ratio >= lvl ORDER BY ratio, rnk LIMIT 1), 0.0) * weight) AS target FROM mix_l),
mix_c AS (SELECT d.doc_id, d.size, d.k, t.rnk, t.source_size, t.target,
    sum(d.size) OVER (PARTITION BY t.rnk ORDER BY d.k, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS through
    FROM mix_sized d JOIN mix_t t ON d.source IS NOT DISTINCT FROM t.source),
mix_e AS (SELECT c.*, e.e, CAST(e.e * source_size + through AS DOUBLE) / target AS finish FROM mix_c c, (VALUES (0), (1), (2)) e(e) WHERE target > 0),
mix_g AS (SELECT *, sum(size) OVER (ORDER BY finish, rnk, e, k, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS so_far FROM mix_e),
mix_n AS (SELECT rnk, k, size, through, count(*) AS copies FROM mix_g WHERE so_far <= (SELECT sum(size) FROM mix_sized) GROUP BY ALL),
mixed AS (SELECT c.doc_id, c.size, c.source_size, c.target, coalesce(n.copies, 0) AS copies FROM mix_c c
    LEFT JOIN mix_n n ON c.rnk = n.rnk AND c.k = n.k AND c.size = n.size AND c.through = n.through)
"""

QUERIES = {"op9_source_mix": op9_source_mix}
ORACLES = {"op9_source_mix": "WITH " + MIX_CTES.replace("{docs}", "documents") + "SELECT doc_id, size, source_size, target, CAST(size * copies AS BIGINT) AS taken FROM mixed"}
