"""Queries of evaluation statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evalstats as E
from ..session import table


def _scores(spark, sf):
    l, d = table(spark, sf, "labels"), table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    bad = F.col("doc_id") % 11 == 0
    return l.join(d, "doc_id").select("doc_id", "lang", "source", F.when(~bad, F.col("quality") * 2 + 1 + F.col("doc_id") % 2).cast("int").alias("faith"), F.when(F.col("doc_id") % 7 != 0, F.col("toxic") * 3 + 1).cast("int").alias("voice"))


def eval_means(spark, sf):
    return E.means(_scores(spark, sf), ["faith", "voice"])


def eval_by_stratum(spark, sf):
    return E.means(_scores(spark, sf), ["faith", "voice"], ["lang"])


def eval_overall(spark, sf):
    return E.overall(_scores(spark, sf), ["faith", "voice"], "lang")


def percentile_nearest(spark, sf):
    e = table(spark, sf, "events")
    ranks = {"p50": E.nearest(0.5), "p95": E.nearest(0.95)} | E.median_ranks()
    return E.at_ranks(e, ["event_type"], "value", ranks).select("event_type", F.round((F.col("low") + F.col("high")) / 2, 6).alias("median"), "p50", "p95")


def pair_agreement(spark, sf):
    li = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("key"), F.col("l_partkey").alias("item")).agg(F.max("l_quantity").alias("a"), F.max("l_discount").alias("b"))
    return E.agreement(li)


def stratum_sample(spark, sf):
    return E.first_of_each(table(spark, sf, "documents"), "source", "doc_id", 3).select("source", "doc_id")


def audit_sample(spark, sf):
    return E.hashed_sample(table(spark, sf, "documents"), "lang", "doc_id", 5).select("lang", "doc_id")


def load_report(spark, sf):
    return E.load_report(table(spark, sf, "events").select((F.col("event_type") != "error").alias("ok"), F.col("value").alias("ms")))


def injection_report(spark, sf):
    d = table(spark, sf, "documents")
    n = (F.col("doc_id") % 6 + 1).cast("int")
    t = d.select(F.col("lang").alias("character"), F.col("doc_id").alias("question"), F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(i.alias("doc"), (i % 3 == 0).alias("graph"))).alias("injected"), F.transform(F.sequence(F.lit(1), n), lambda i: i % 2).alias("cited"))
    return E.injection_report(t)


def injection_levels(spark, sf):
    """AGG-16 with traces made from the documents; the map is told as text."""
    k, n = F.col("doc_id"), (F.col("doc_id") % 6 + 1).cast("int")
    item = lambda i: F.struct(F.when(i % 3 == 0, "infer").otherwise("source").alias("kind"), (F.length("text") % 100 + i).alias("chars"), ((F.col("doc_id") + i) % 2 == 0).alias("ends"))
    t = table(spark, sf, "documents").filter("text IS NOT NULL").select(
        F.col("lang").alias("character"), k.alias("question"), F.transform(F.sequence(F.lit(1), n), item).alias("boundary"), F.lit(6).alias("top_k"), F.when(k % 7 != 0, k % 5).alias("overlap"),
        F.when(k % 4 != 0, k % 3 == 0).alias("graph_on"), (F.length("text") % 9).alias("edges"), (k % 4).alias("added"), F.slice(F.split("text", " "), F.lit(1), F.lit(5)).alias("seeds"),
        F.concat("text", F.when(k % 3 == 0, " [1] [2] [1]").when(k % 3 == 1, " [5][G1]").otherwise("")).alias("answer"),
    )
    out = E.injection_levels(t)
    return out.withColumn("overlap_counts", F.array_join(F.transform(F.map_entries("overlap_counts"), lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string"))), ","))


def chunk_lengths(spark, sf):
    return E.lengths(table(spark, sf, "documents"))


QUERIES = {f.__name__: f for f in (eval_means, eval_by_stratum, eval_overall, percentile_nearest, pair_agreement, stratum_sample, audit_sample, load_report, injection_report, injection_levels, chunk_lengths)}
_S = "WITH s AS (SELECT l.doc_id, lang, source, CASE WHEN l.doc_id % 11 <> 0 THEN quality * 2 + 1 + l.doc_id % 2 END AS faith, CASE WHEN l.doc_id % 7 <> 0 THEN toxic * 3 + 1 END AS voice FROM labels l JOIN documents d ON l.doc_id = d.doc_id) "
_M = "round(avg(faith), 4) AS faith_mean, count(faith) AS faith_valid, count(*) FILTER (faith IS NULL) AS faith_failed, round(avg(voice), 4) AS voice_mean, count(voice) AS voice_valid, count(*) FILTER (voice IS NULL) AS voice_failed"
ORACLES = {
    "eval_means": _S + f"SELECT {_M} FROM s",
    "eval_by_stratum": _S + f"SELECT lang, {_M} FROM s GROUP BY lang",
    "eval_overall": _S + ", u AS (SELECT lang, faith AS x FROM s UNION ALL SELECT lang, voice FROM s) SELECT lang, round(avg(x), 4) AS mean, count(x) AS valid FROM u GROUP BY lang",
    "percentile_nearest": "WITH l AS (SELECT event_type, list_sort(list(value)) AS v, median(value) AS m FROM events GROUP BY event_type) SELECT event_type, round(m, 6) AS median, v[least(CAST(floor(len(v) * 0.5) AS BIGINT), len(v) - 1) + 1] AS p50, v[least(CAST(floor(len(v) * 0.95) AS BIGINT), len(v) - 1) + 1] AS p95 FROM l",
    "pair_agreement": "WITH r AS (SELECT l_orderkey AS key, l_partkey AS item, max(l_quantity) AS a, max(l_discount) AS b FROM lineitem GROUP BY 1, 2), p AS (SELECT x.key, (x.a - y.a) * (x.b - y.b) AS s FROM r x JOIN r y ON x.key = y.key AND x.item < y.item), g AS (SELECT key, count(*) FILTER (s > 0) AS a, count(*) FILTER (s < 0) AS b FROM p GROUP BY key) SELECT k.key, CASE WHEN a + b > 0 THEN round(a / (a + b), 6) ELSE 1.0 END AS agreement FROM (SELECT DISTINCT key FROM r) k LEFT JOIN g ON k.key = g.key",
    "stratum_sample": "SELECT source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) WHERE rn <= 3",
    "audit_sample": "SELECT lang, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS rn FROM documents) WHERE rn <= 5",
    "load_report": "WITH l AS (SELECT list_sort(list(value) FILTER (event_type <> 'error')) AS v, count(*) FILTER (event_type = 'error') AS e FROM events) SELECT len(v) AS n_ok, e AS n_err, v[CAST(floor(len(v) * 0.5) AS BIGINT) + 1] AS p50, v[CAST(floor(len(v) * 0.95) AS BIGINT) + 1] AS p95, v[len(v)] AS max_ms, round(list_avg(v), 4) AS mean_ms FROM l",
    "injection_report": "WITH t AS (SELECT lang, doc_id % 6 + 1 AS n FROM documents) SELECT lang AS character, count(*) AS questions, CAST(sum(n) AS BIGINT) AS injected, CAST(sum(n // 3) AS BIGINT) AS from_graph, CAST(sum(least(n, 2)) AS BIGINT) AS cited, round(sum(least(n, 2)) / sum(n), 4) AS cited_share FROM t GROUP BY lang",
    "injection_levels": """WITH d AS (SELECT doc_id AS k, lang AS character, text, CAST(doc_id % 6 + 1 AS BIGINT) AS m, length(text) % 100 AS c FROM documents WHERE text IS NOT NULL),
 i AS (SELECT k, count(*) FILTER (i % 3 <> 0) AS body_n, count(*) FILTER (i % 3 = 0) AS ev_n, sum(c + i) FILTER (i % 3 <> 0) AS body_chars, coalesce(sum(c + i) FILTER (i % 3 = 0), 0) AS ev_chars, count(*) FILTER (i % 3 <> 0 AND (k + i) % 2 = 0) AS ends_ok FROM (SELECT k, c, unnest(range(1, m + 1)) AS i FROM d) GROUP BY k),
 a AS (SELECT d.*, i.* EXCLUDE (k), CASE WHEN k % 7 <> 0 THEN k % 5 END AS overlap, CASE WHEN k % 4 <> 0 THEN k % 3 = 0 END AS g, length(text) % 9 AS edges, k % 4 AS added, string_split(text, ' ')[1:5] AS seeds,
  list_transform(regexp_extract_all(text || CASE k % 3 WHEN 0 THEN ' [1] [2] [1]' WHEN 1 THEN ' [5][G1]' ELSE '' END, '\\[(\\d+)\\]', 1), lambda x: CAST(x AS BIGINT)) AS ci, regexp_matches(text || CASE k % 3 WHEN 1 THEN ' [5][G1]' ELSE '' END, '\\[G\\d+\\]') AS gc FROM d JOIN i USING (k)),
 h AS (SELECT character, grouping(character) AS t, overlap, count(*) AS n FROM a WHERE overlap IS NOT NULL GROUP BY GROUPING SETS ((character, overlap), (overlap))),
 hm AS (SELECT character, t, string_agg(overlap || ':' || n, ',' ORDER BY overlap) AS overlap_counts FROM h GROUP BY character, t),
 r AS (SELECT character, grouping(character) AS t, count(*) AS questions, CAST(sum(body_n) AS BIGINT) AS body_n, CAST(sum(ev_n) AS BIGINT) AS ev_n, CAST(sum(body_chars) AS BIGINT) AS body_chars, CAST(sum(ev_chars) AS BIGINT) AS ev_chars,
  median(body_n) AS body_n_median, median(body_chars) AS body_chars_median, median(ev_n) AS ev_n_median, median(ev_chars) AS ev_chars_median, median(body_chars + ev_chars) AS chars_median, median(overlap) AS overlap_median, median(6 - overlap) AS swapped_median,
  round(sum(ev_n) / (sum(ev_n) + sum(body_n)), 4) AS ev_share, round(sum(ev_chars) / sum(body_chars + ev_chars), 4) AS ev_char_share, round(sum(ends_ok) / sum(body_n), 4) AS ends_share,
  count(*) FILTER (g) AS graph_on, count(g) AS graph_known, round(count(*) FILTER (g) / count(g), 4) AS graph_share, median(edges) FILTER (g IS NOT NULL) AS edges_median, median(added) FILTER (g IS NOT NULL) AS added_median,
  round(sum(len(list_filter(seeds, lambda x: length(x) = 1))) FILTER (g IS NOT NULL) / sum(len(seeds)) FILTER (g IS NOT NULL), 4) AS single_seed_share,
  count(*) FILTER (len(ci) > 0) AS cited, median(len(list_distinct(ci))) AS distinct_cites_median, count(*) FILTER (len(ci) > 0 AND body_n > 0 AND list_max(ci) > body_n) AS over, count(*) FILTER (gc) AS graph_cited FROM a GROUP BY GROUPING SETS ((character), ()))
 SELECT r.* EXCLUDE (t), t = 1 AS total, overlap_counts FROM r LEFT JOIN hm USING (t) WHERE r.character IS NOT DISTINCT FROM hm.character""",
    "chunk_lengths": "SELECT min(length(text)) AS shortest, median(length(text)) AS median, round(avg(length(text)), 4) AS mean, max(length(text)) AS longest, round(count(*) FILTER (length(text) < 50) / count(*), 6) AS share_short FROM documents",
}
