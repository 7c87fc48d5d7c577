"""op2: benchmark items contained in documents."""

from pyspark.sql import DataFrame, SparkSession

from . import common, decontam


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    items = common.table(spark, sf_dir, "benchmark")
    found = decontam.contained(docs, items)
    for short in decontam.contained_short(docs, items):
        found = found.unionByName(short)
    return found.drop("text_hash")


#: Exact containment over all pairs that share a shingle. Items of fewer than five words: unspaced scripts are cut into
#: characters, and what is still short is one shingle of its own size.
_SCRIPTS = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}"
SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
ds AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) AS s FROM dw),
iw AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark),
ish AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) AS s FROM iw),
n AS (SELECT item_id, count(*) AS n_shingles FROM ish GROUP BY item_id),
c AS (SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN ish USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shingles, n_shared, n_shared / n_shingles AS containment FROM c JOIN n USING (item_id)
WHERE n_shared >= 0.8 * n_shingles - 1e-9
UNION ALL
SELECT doc_id, item_id, n_shingles, n_shared, n_shared / n_shingles FROM (
    SELECT doc_id, item_id, n_shingles, count(*) AS n_shared FROM (
        SELECT item_id, k, s, count(*) OVER (PARTITION BY item_id, k) AS n_shingles FROM (
            SELECT DISTINCT item_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i+k-1], ' '))) AS s FROM (
                SELECT item_id, w, least(len(w), 5) AS k FROM (SELECT item_id, regexp_extract_all(regexp_replace(lower(text), '([{scripts}])', ' \1 ', 'g'), '[\p{L}\p{N}]+') AS w
                    FROM benchmark WHERE len(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) < 5) WHERE len(w) > 0)))
    JOIN (SELECT DISTINCT doc_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i+k-1], ' '))) AS s FROM (
        SELECT doc_id, k, regexp_extract_all(regexp_replace(lower(text), '([{scripts}])', ' \1 ', 'g'), '[\p{L}\p{N}]+') AS w FROM documents,
            (SELECT DISTINCT least(len(regexp_extract_all(regexp_replace(lower(text), '([{scripts}])', ' \1 ', 'g'), '[\p{L}\p{N}]+')), 5) AS k
             FROM benchmark WHERE len(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) < 5) WHERE k > 0)) USING (k, s)
    GROUP BY ALL) WHERE n_shared >= 0.8 * n_shingles - 1e-9
""".replace("{scripts}", _SCRIPTS)

QUERIES = {"op2_benchmark_decontamination": op2_benchmark_decontamination}
ORACLES = {"op2_benchmark_decontamination": SQL}
