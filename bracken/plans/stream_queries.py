"""Queries that run as streams over the tables' files."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import state_queries
from ..session import table
from ..streaming import keyed, leases, windows
from ..streaming.run import drained, stream


def stream_hourly(spark, sf):
    """In complete mode, so that it equals the batch."""
    out = drained(spark, windows.windowed(stream(spark, sf, "events")), "complete")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def stream_hourly_closed(spark, sf):
    """In append mode: windows that the watermark has passed; their state is dropped."""
    out = drained(spark, windows.windowed(stream(spark, sf, "events")))
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def stream_limiter(spark, sf):
    e = stream(spark, sf, "events")
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return drained(spark, keyed.limited(e.select((F.col("user_id") % 10).alias("user_id"), "event_id", (t / 30).alias("t")), 2, 100))


def stream_sliding(spark, sf):
    e = stream(spark, sf, "events")
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return drained(spark, keyed.limited_sliding(e.select((F.col("user_id") % 10).alias("user_id"), "event_id", (t / 30).alias("t")), 2))


def stream_answers(spark, sf):
    e = stream(spark, sf, "events")
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return drained(spark, keyed.first_answers(e.select((F.col("user_id") % 10).alias("user_id"), "event_id", t.alias("t")), 7200.0))


def stream_sessions(spark, sf):
    """In complete mode, so that it equals the batch."""
    out = drained(spark, windows.sessions(stream(spark, sf, "events")), "complete")
    return out.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


def stream_markers(spark, sf):
    c = stream(spark, sf, "conversations")
    token = F.when(F.col("turn") % 3 == 1, F.concat(F.lit("<state>"), F.col("text"))).when(F.col("turn") % 3 == 2, F.concat(F.col("text"), F.lit("</state>"))).otherwise(F.col("text"))
    out = drained(spark, keyed.filtered(c.select(F.col("conv_id").alias("msg"), F.col("turn").alias("ord"), token.alias("token"), F.lit(True).alias("last"))))
    return out.select("msg", F.md5("text").alias("text_md5"))


def stream_leases(spark, sf):
    """STR-05 in five triggers: what each beat was, and when leases lapsed, some by a timer alone."""
    e = table(spark, sf, "events")
    t = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000)
    beats = e.select((F.col("user_id") % 20).alias("run"), "event_id", t.alias("t"), F.col("event_type").alias("owner"))
    with leases.rocks(spark):
        return drained(spark, leases.leased(leases.sliced(beats, "t", 5), 3_600_000))


QUERIES = {f.__name__: f for f in (stream_hourly, stream_hourly_closed, stream_limiter, stream_sliding, stream_answers, stream_sessions, stream_markers, stream_leases)}
_TOKEN = "CASE turn % 3 WHEN 1 THEN '<state>' || text WHEN 2 THEN text || '</state>' ELSE text END"
ORACLES = {
    "stream_leases": """WITH RECURSIVE tm AS MATERIALIZED (SELECT user_id % 20 AS run, event_id, event_type AS own, CAST(floor(epoch_us(ts) / 1000) AS BIGINT) AS t, row_number() OVER (PARTITION BY user_id % 20 ORDER BY floor(epoch_us(ts) / 1000), event_id) AS n FROM events),
 st AS (SELECT run, event_id, n, own, own AS owner, t, t + 3600000 AS until, TRUE AS ok FROM tm WHERE n = 1
 UNION ALL SELECT run, event_id, n, own, CASE WHEN ok THEN own ELSE owner END, t, CASE WHEN ok THEN t + 3600000 ELSE until END, ok FROM (SELECT tm.run, tm.event_id, tm.n, tm.own, tm.t, st.owner, until, tm.own = st.owner OR tm.t > until AS ok FROM st JOIN tm ON tm.run = st.run AND tm.n = st.n + 1)),
 a AS (SELECT *, lead(t) OVER w AS nt, row_number() OVER w AS k FROM st WHERE ok WINDOW w AS (PARTITION BY run ORDER BY n)),
 l AS (SELECT *, k - coalesce(lag(k) OVER (PARTITION BY run ORDER BY n), 0) AS beats FROM a WHERE nt > until OR (nt IS NULL AND until <= (SELECT max(t) FROM tm) - 600000))
 SELECT run, event_id, ok AS accepted, NULL::BIGINT AS lapsed, own AS owner, NULL::BIGINT AS beats FROM st UNION ALL SELECT run, NULL, NULL, until, owner, beats FROM l""",
    "stream_hourly_closed": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTES GROUP BY 1, 2, date_trunc('hour', ts)",
    "stream_limiter": state_queries._FIXED,
    "stream_sliding": state_queries._SLIDING,
    "stream_answers": state_queries._ANSWERS,
    "stream_sessions": "WITH g AS (SELECT *, CASE WHEN ts > lag(ts) OVER w + INTERVAL 30 MINUTES OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k",
    "stream_hourly": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "stream_markers": f"SELECT conv_id AS msg, md5(regexp_replace(string_agg({_TOKEN}, '' ORDER BY turn), '(?s)<state>.*?</state>', '', 'g')) AS text_md5 FROM conversations GROUP BY conv_id",
}
