"""op12: all documents drawn towards the benchmark's distribution of words."""

from pyspark.sql import DataFrame, SparkSession

from . import common, resample


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return resample.resampled(docs, common.table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


#: crc32 by the table of its polynomial, over the distinct words' bytes in hexadecimal.
SQL = r"""
WITH RECURSIVE step(i, k, c) AS (SELECT i, 0, CAST(i AS BIGINT) FROM range(256) t(i)
    UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, CAST(3988292384 AS BIGINT)) ELSE c >> 1 END FROM step WHERE k < 8),
tab AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM step WHERE k = 8),
dw AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
f AS MATERIALIZED (SELECT doc_id, f, count(*) AS k FROM (SELECT doc_id, unnest(w) AS f FROM dw) GROUP BY ALL),
s AS (SELECT f, sum(k) AS n FROM f GROUP BY f),
t AS (SELECT f, count(*) AS n FROM (SELECT unnest(w) AS f FROM bw) GROUP BY f),
h AS (SELECT f, hex(encode(f)) AS x FROM (SELECT f FROM s UNION SELECT f FROM t)),
dict AS MATERIALIZED (SELECT f, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, len(x), 2), lambda i: CAST('0x' || substr(x, i, 2) AS BIGINT))),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), CAST(4294967295 AS BIGINT)) % 10000 AS b FROM h, tab),
sb AS (SELECT b, sum(n) AS s FROM s JOIN dict USING (f) GROUP BY b),
tb AS (SELECT b, sum(n) AS t FROM t JOIN dict USING (f) GROUP BY b),
g AS (SELECT b, CAST(floor(1000 * ln(CAST(coalesce(t, 0) + 1 AS DOUBLE) * CAST((SELECT coalesce(sum(s), 0) FROM sb) + 10000 AS DOUBLE)
    / (CAST(s + 1 AS DOUBLE) * CAST((SELECT coalesce(sum(t), 0) FROM tb) + 10000 AS DOUBLE)))) AS BIGINT) AS gain FROM sb LEFT JOIN tb USING (b)),
w AS (SELECT doc_id, sum(k) AS n, sum(k * gain) AS total FROM f JOIN dict USING (f) JOIN g USING (b) GROUP BY doc_id),
d AS (SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_features, CAST(CASE WHEN n > 0 THEN (total - ((total % n) + n) % n) // n ELSE 0 END AS BIGINT) AS weight,
    CAST('0x' || substr(sha256('2024:' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) AS h FROM documents LEFT JOIN w USING (doc_id)),
o AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296.0))) AS BIGINT) AS score FROM d),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM o WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= (SELECT count(*) FROM r) * 10 // 100 THEN r END AS rank FROM o LEFT JOIN r USING (doc_id)
"""

QUERIES = {"op12_importance_resampling": op12_importance_resampling}
ORACLES = {"op12_importance_resampling": SQL}
