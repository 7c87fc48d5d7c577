"""op1: paired completions of every conversation, with all its turns."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, preference


def _text(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")


def op1_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = preference.every(common.table(spark, sf_dir, "conversations"))
    return out.select("conv_id", "status", "n_prefix", "prompt", "chosen", "rejected", _text("chosen_spans").alias("chosen_mask"), _text("rejected_spans").alias("rejected_mask"))


SQL = r"""
WITH t AS (SELECT conv_id, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) AS pos FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, CAST(floor(conv_id / 2) AS BIGINT) AS k, max(pos) AS size FROM t GROUP BY conv_id),
a AS (SELECT conv_id, pos, row_number() OVER (PARTITION BY conv_id ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM t WHERE role = 'assistant'),
cut AS (SELECT conv_id, pos AS at FROM a JOIN c USING (conv_id) WHERE i = k % n),
p AS (SELECT c.conv_id, o.conv_id AS other, x.at AS n, y.at AS m FROM c LEFT JOIN cut x ON x.conv_id = c.conv_id LEFT JOIN c o ON o.k = c.k AND o.conv_id <> c.conv_id LEFT JOIN cut y ON y.conv_id = o.conv_id),
sides AS (SELECT 'a' AS s, conv_id, pos, role, text FROM t
    UNION ALL SELECT 'b', conv_id, pos, role, text FROM t JOIN p USING (conv_id) WHERE n IS NULL OR pos < n
    UNION ALL SELECT 'b', p.conv_id, p.n + t.pos - p.m, role, text FROM p JOIN t ON t.conv_id = p.other WHERE p.n IS NOT NULL AND p.m IS NOT NULL AND t.pos >= p.m),
cmp AS (SELECT x.conv_id, min(x.pos) - 1 AS before FROM sides x JOIN sides y ON x.conv_id = y.conv_id AND x.pos = y.pos AND x.s = 'a' AND y.s = 'b' WHERE x.role <> y.role OR x.text <> y.text GROUP BY x.conv_id),
len AS (SELECT conv_id, coalesce(max(pos) FILTER (s = 'a'), 0) AS la, coalesce(max(pos) FILTER (s = 'b'), 0) AS lb FROM sides GROUP BY conv_id),
pre AS (SELECT p.conv_id, n, m, la, lb, coalesce(before, least(la, lb)) AS n_prefix FROM p JOIN len USING (conv_id) LEFT JOIN cmp USING (conv_id)),
r AS (SELECT s, conv_id, pos, role, '<|' || role || '|>' || chr(10) AS h, text || '<|end|>' || chr(10) AS b FROM sides),
tailed AS (SELECT r.*, pos > n_prefix AS after, coalesce(sum(length(h) + length(b)) FILTER (pos > n_prefix) OVER (PARTITION BY s, r.conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at0 FROM r JOIN pre ON pre.conv_id = r.conv_id),
span AS (SELECT *, CAST(CAST(at0 + length(h) AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(at0 + length(h) + length(b) AS BIGINT) AS VARCHAR) AS mask FROM tailed),
agg AS (SELECT conv_id, string_agg(h || b, '' ORDER BY pos) FILTER (s = 'a' AND NOT after) AS prompt,
    string_agg(h || b, '' ORDER BY pos) FILTER (s = 'a' AND after) AS chosen, string_agg(h || b, '' ORDER BY pos) FILTER (s = 'b' AND after) AS rejected,
    string_agg(mask, ',' ORDER BY pos) FILTER (s = 'a' AND after AND role = 'assistant') AS chosen_mask, string_agg(mask, ',' ORDER BY pos) FILTER (s = 'b' AND after AND role = 'assistant') AS rejected_mask
    FROM span GROUP BY conv_id)
SELECT pre.conv_id, CASE WHEN n IS NULL THEN 'no_reply' WHEN m IS NULL THEN 'unpaired' WHEN n_prefix = la AND n_prefix = lb THEN 'identical' WHEN lb = 0 THEN 'chosen_only' ELSE 'pair' END AS status, CAST(n_prefix AS BIGINT) AS n_prefix,
    coalesce(prompt, '') AS prompt, coalesce(chosen, '') AS chosen, coalesce(rejected, '') AS rejected, coalesce(chosen_mask, '') AS chosen_mask, coalesce(rejected_mask, '') AS rejected_mask
FROM pre JOIN agg USING (conv_id)
UNION ALL SELECT NULL, 'no_id', 1, '<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10), '', '', '', '' FROM conversations WHERE conv_id IS NULL
"""

QUERIES = {"op1_preference_format": op1_preference_format}
ORACLES = {"op1_preference_format": SQL}
