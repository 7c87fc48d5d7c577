"""op11: open sales of each nation, with the running highs and the peaks."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, peaks


def op11_peak_concurrency(spark: SparkSession, sf_dir: str) -> DataFrame:
    sales = common.table(spark, sf_dir, "sales").select("sale_id", "client_id", "total", "sold_at")
    lines = common.table(spark, sf_dir, "sale_lines").select("sale_id", "shipped_at")
    clients = common.table(spark, sf_dir, "clients").select(F.col("client_id").alias("key"), F.col("nation_id").cast("int").alias("grp"))
    found = peaks.concurrency(peaks.changes(peaks.open_sales(sales, lines), clients))
    return found.select(F.col("grp").alias("nation_id"), (F.col("moment") * 60).alias("from_s"), (F.col("until") * 60).alias("to_s"), "n_open", F.col("weight_open").alias("open_cents"), "high_open", "is_peak")


SQL = """
WITH ends AS (SELECT sale_id, max(shipped_at) AS sent FROM sale_lines GROUP BY sale_id),
s AS (SELECT client_id, CAST(floor(epoch_us(sold_at) / 60000000) AS BIGINT) * 60 AS a, CAST(floor(epoch_us(sent) / 60000000) AS BIGINT) * 60 + 7 * 86400 AS b,
    coalesce(CAST(floor(100 * total + 0.5) AS BIGINT), 0) AS cents FROM sales LEFT JOIN ends USING (sale_id) WHERE sold_at IS NOT NULL),
n AS (SELECT coalesce(nation_id, -1) AS nation_id, a, b, cents FROM s LEFT JOIN clients USING (client_id) WHERE b IS NULL OR b > a),
both_ AS (SELECT * FROM n UNION ALL SELECT -2, a, b, cents FROM n),
d AS (SELECT nation_id, a AS from_s, 1 AS d, cents FROM both_ UNION ALL SELECT nation_id, b, -1, -cents FROM both_ WHERE b IS NOT NULL),
m AS (SELECT nation_id, from_s, sum(d) AS d, sum(cents) AS cents FROM d GROUP BY ALL HAVING sum(d) <> 0 OR sum(cents) <> 0),
o AS (SELECT nation_id, from_s, lead(from_s) OVER w AS to_s, CAST(sum(d) OVER w AS BIGINT) AS n_open, CAST(sum(cents) OVER w AS BIGINT) AS open_cents FROM m WINDOW w AS (PARTITION BY nation_id ORDER BY from_s))
SELECT CAST(nation_id AS INTEGER) AS nation_id, from_s, to_s, n_open, open_cents, max(n_open) OVER (PARTITION BY nation_id ORDER BY from_s) AS high_open,
    n_open = max(n_open) OVER (PARTITION BY nation_id) AS is_peak FROM o
"""

QUERIES = {"op11_peak_concurrency": op11_peak_concurrency}
ORACLES = {"op11_peak_concurrency": SQL}
