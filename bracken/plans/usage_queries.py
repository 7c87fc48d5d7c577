"""Queries of usage, sessions and accounts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import usage
from ..session import table
from ..sources import files

NOW = "2024-01-25 00:00:00"


def _now():
    return F.lit(NOW).cast("timestamp_ntz")


def _log(spark, sf) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    e = table(spark, sf, "events")
    return e.select("event_id", "ts", "user_id", F.col("event_type").alias("character"), (F.col("event_type") == "error").alias("error"), (k % 5 == 0).alias("cache_hit"), (k * 10).alias("tokens"), T.cost(k * 1000, k * 500, F.lit(None).cast("long"), F.when(k % 2 == 0, k)).alias("cost"), F.when(k % 7 == 0, 0.0).otherwise(F.col("value")).alias("latency_ms"))


def _conv(spark, sf) -> DataFrame:
    return table(spark, sf, "conversations")


def usage_summary(spark, sf):
    return usage.summary(_log(spark, sf), _now())


def usage_by_key(spark, sf):
    return usage.by_key(_log(spark, sf))


def status_counts(spark, sf):
    return table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


def latest_requests(spark, sf):
    log = _log(spark, sf).withColumn("stages", F.when(F.col("tokens") > 500, F.create_map(F.lit("answer"), F.col("latency_ms")))).withColumn("id", F.col("event_id"))
    return usage.latest_stages(log).select("event_id", F.col("stages")["answer"].alias("answer_ms"))


def stage_times(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("request"), F.col("l_returnflag").alias("stage"), F.col("l_quantity").alias("ms"))
    return usage.stage_times(rows).select("request", F.explode("stages").alias("stage", "ms"))


def ttl_partition(spark, sf):
    kept, gone = usage.expired(table(spark, sf, "events"), "ts", _now())
    return kept.select(F.lit("kept").alias("part")).unionByName(gone.select(F.lit("removed").alias("part"))).groupBy("part").agg(F.count("*").alias("n"))


def feedback_page(spark, sf):
    return usage.page(table(spark, sf, "events").filter("event_type = 'error'"), [F.desc("ts"), F.desc("event_id")], 20, 40).select("event_id", "user_id")


def session_stats(spark, sf):
    c = _conv(spark, sf).groupBy("conv_id").agg(F.to_json(F.sort_array(F.collect_list("turn"))).alias("h"))
    s = c.select(F.when(F.col("conv_id") % 4 == 0, "").otherwise(F.concat(F.lit("p"), (F.col("conv_id") % 3).cast("string"))).alias("character"), F.when(F.col("conv_id") % 5 == 0, "{bad").otherwise(F.col("h")).alias("history"))
    return usage.session_stats(s)


def history_pairs(spark, sf):
    return usage.pairs(_conv(spark, sf))


def last_n_turns(spark, sf):
    return usage.last_turns(_conv(spark, sf), 3)[0].select("conv_id", "turn", "role")


def overflow_turns(spark, sf):
    return usage.last_turns(_conv(spark, sf), 3)[1].groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


def trim_by_user(spark, sf):
    return usage.trimmed(_conv(spark, sf), 2).select("conv_id", "turn", "role")


def active_sessions(spark, sf):
    s = table(spark, sf, "orders").select(F.col("o_orderkey").alias("token"), F.col("o_custkey").alias("user_id"), (F.col("o_orderdate")).alias("expires"))
    u = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), (F.col("c_acctbal") > 0).alias("active"))
    return usage.active_sessions(s, u, F.lit("1998-01-01").cast("timestamp_ntz")).select("token", "user_id")


def cascade_delete(spark, sf):
    gone = table(spark, sf, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return usage.without(table(spark, sf, "orders"), gone, "o_custkey").select("o_orderkey", "o_custkey")


def upsert_latest(spark, sf):
    return usage.latest(table(spark, sf, "events"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id", "value")


def scan_formats(spark, sf):
    """SRC-01, AGG-05: supported and skipped by extension, most common first."""
    folder = F.when(F.col("p_partkey") % 7 == 0, F.lit("/in/.git/")).otherwise("/in/books/")
    name = F.concat(folder, F.col("p_name"), F.element_at(F.array(*map(F.lit, (".PDF", ".md", ".txt", ".docx", ""))), (F.col("p_partkey") % 5 + 1).cast("int")))
    return files.by_extension(files.routed(table(spark, sf, "part").select(name.alias("path"))))


QUERIES = {f.__name__: f for f in (usage_summary, usage_by_key, status_counts, latest_requests, stage_times, ttl_partition, feedback_page, session_stats, history_pairs, last_n_turns, overflow_turns, trim_by_user, active_sessions, cascade_delete, upsert_latest, scan_formats)}

_LOG = """WITH k AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events), lg AS (SELECT event_id, ts, user_id, event_type AS character, event_type = 'error' AS error, k % 5 = 0 AS cache_hit, k * 10 AS tokens,
 round(CAST(floor(k * 1000 * 0.75) AS BIGINT) / 1e6 * 1.0 + (CASE WHEN k % 2 = 0 THEN k ELSE CAST(floor(k * 500 * 0.75) AS BIGINT) END) / 1e6 * 2.0, 6) AS cost, CASE WHEN k % 7 = 0 THEN 0.0 ELSE value END AS latency_ms FROM k) """
_LAST = "WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) "

ORACLES = {
    "usage_summary": _LOG + f"SELECT count(*) AS requests, count(*) FILTER (error) AS errors, count(*) FILTER (cache_hit) AS cache_hits, round(count(*) FILTER (cache_hit) / count(*), 3) AS hit_rate, round(sum(cost), 4) AS cost, CAST(sum(tokens) AS BIGINT) AS tokens, round(avg(latency_ms) FILTER (latency_ms <> 0), 1) AS mean_latency FROM lg WHERE ts >= TIMESTAMP '{NOW}'",
    "usage_by_key": _LOG + "SELECT character, count(*) AS requests, round(sum(cost), 4) AS cost, count(*) FILTER (error) AS errors FROM lg GROUP BY character",
    "status_counts": "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus",
    "latest_requests": _LOG + "SELECT event_id, latency_ms AS answer_ms FROM lg WHERE tokens > 500 ORDER BY ts DESC, event_id DESC LIMIT 30",
    "stage_times": "SELECT l_orderkey AS request, l_returnflag AS stage, max(l_quantity) AS ms FROM lineitem GROUP BY 1, 2",
    "ttl_partition": f"SELECT CASE WHEN ts < TIMESTAMP '{NOW}' - INTERVAL 7 DAYS THEN 'removed' ELSE 'kept' END AS part, count(*) AS n FROM events GROUP BY 1",
    "feedback_page": "SELECT event_id, user_id FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 20 OFFSET 40",
    "session_stats": "WITH c AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id) SELECT CASE WHEN conv_id % 4 = 0 THEN 'unknown' ELSE 'p' || CAST(conv_id % 3 AS VARCHAR) END AS character, count(*) AS sessions, CAST(sum(CASE WHEN conv_id % 5 = 0 THEN 0 ELSE n END) AS BIGINT) AS turns FROM c GROUP BY 1",
    "history_pairs": "WITH t AS (SELECT *, lead(role) OVER w AS nr, lead(text) OVER w AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT conv_id, turn, text AS question, answer FROM t WHERE role = 'user' AND nr = 'assistant'",
    "last_n_turns": _LAST + "SELECT conv_id, turn, role FROM r WHERE rn <= 3",
    "overflow_turns": _LAST + "SELECT conv_id, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM r WHERE rn > 3 GROUP BY conv_id",
    "trim_by_user": "WITH u AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations WHERE role = 'user'), c AS (SELECT conv_id, max(turn) FILTER (rn = 2) AS cut FROM u GROUP BY conv_id) SELECT t.conv_id, t.turn, t.role FROM conversations t LEFT JOIN c USING (conv_id) WHERE cut IS NULL OR t.turn >= cut",
    "active_sessions": "SELECT o_orderkey AS token, o_custkey AS user_id FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderdate > TIMESTAMP '1998-01-01' AND c_acctbal > 0",
    "cascade_delete": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)",
    "upsert_latest": "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1",
    "scan_formats": "SELECT ['.pdf', '.md', '.txt', '.docx', ''][p_partkey % 5 + 1] AS ext, count(*) AS n, p_partkey % 5 < 3 AS supported FROM part WHERE p_partkey % 7 <> 0 GROUP BY ALL",
}
