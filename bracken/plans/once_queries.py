"""Queries of decisions, tombstones and markers on streams of several triggers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from . import stream_queries
from ..session import table
from ..streaming import keyed
from ..streaming.once import claimed, in_parts, restored


def stream_decisions(spark, sf):
    """STR-07: a client's first action of a kind on a day counts; clicks come by the month of arrival."""
    c = table(spark, sf, "clicks").filter("ts IS NOT NULL")
    rows = c.select(F.col("client_id").alias("run"), F.col("kind").alias("decision"), F.col("ts").cast("date").alias("day"), F.col("ts").cast("timestamp").alias("ts"), F.month(F.coalesce("arrived_at", "ts")).alias("part"))
    out = in_parts(spark, {"decisions": rows}, lambda decisions: claimed(decisions, ["run", "decision", "day"]))
    return out.select("run", "decision", F.date_format("day", "yyyy-MM-dd").alias("day"), "part")


def stream_restores(spark, sf):
    """STR-17: updates of clients that no deletion of the 30 days before blocks; some changes come a month late."""
    c = table(spark, sf, "client_changes").filter("valid_at IS NOT NULL")
    month = F.month("valid_at") + F.when(F.col("change_id") % 7 == 0, 1).otherwise(0)
    rows = c.select("change_id", "client_id", "op", F.col("valid_at").cast("timestamp").alias("ts"), month.cast("int").alias("part"))
    sources = {"restores": rows.filter("op = 'U'"), "tombstones": rows.filter("op = 'D'")}
    return in_parts(spark, sources, lambda restores, tombstones: restored(restores, tombstones, "client_id")).select("change_id", "client_id", "part")


def stream_markers_held(spark, sf):
    """STR-08 in four triggers: markers and blocks that are open at the end of one are closed, or given back, in a later one."""
    c, turn = table(spark, sf, "conversations"), F.col("turn")
    token = F.when(turn % 3 == 1, F.concat(F.lit("<state>"), "text")).when(turn % 3 == 2, F.concat("text", F.lit("</state>"))).otherwise(F.col("text"))
    last = turn == F.max("turn").over(Window.partitionBy("conv_id"))
    rows = c.select(F.col("conv_id").alias("msg"), turn.alias("ord"), token.alias("token"), last.alias("last"), F.least(turn, F.lit(3)).cast("int").alias("part"))
    shown = in_parts(spark, {"tokens": rows}, lambda tokens: keyed.filtered(tokens))
    pieces = F.sort_array(F.collect_list(F.struct("ord", "text")))
    return shown.groupBy("msg").agg(F.md5(F.array_join(F.transform(pieces, lambda x: x["text"]), "")).alias("text_md5"))


QUERIES = {f.__name__: f for f in (stream_decisions, stream_restores, stream_markers_held)}
_DAY = 86_400_000
#: The watermark that rows of a part meet is that of all parts before, in milliseconds.
_BEFORE = "coalesce(max(top) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
ORACLES = {
    "stream_markers_held": stream_queries.ORACLES["stream_markers"],
    "stream_decisions": f"""WITH c AS (SELECT client_id AS run, kind AS decision, strftime(ts, '%Y-%m-%d') AS day, epoch_us(ts) AS us, CAST(month(coalesce(arrived_at, ts)) AS INT) AS part FROM clicks WHERE ts IS NOT NULL),
 m AS (SELECT part, max(us) // 1000 - {2 * _DAY} AS top FROM c GROUP BY part), w AS (SELECT part, {_BEFORE} AS mark FROM m)
 SELECT run, decision, day, min(part) AS part FROM c JOIN w USING (part) WHERE us > mark * 1000 GROUP BY run, decision, day""",
    "stream_restores": f"""WITH c AS (SELECT change_id, client_id, op, epoch_us(valid_at) AS us, CAST(month(valid_at) + CASE WHEN change_id % 7 = 0 THEN 1 ELSE 0 END AS INT) AS part FROM client_changes WHERE valid_at IS NOT NULL AND op IN ('U', 'D')),
 p AS (SELECT DISTINCT part FROM c), o AS (SELECT part, op, max(us) // 1000 - {2 * _DAY} AS top FROM c GROUP BY part, op),
 s AS (SELECT p.part, max(top) FILTER (op = 'U') AS u, max(top) FILTER (op = 'D') AS d FROM p LEFT JOIN o ON o.part <= p.part GROUP BY p.part),
 m AS (SELECT part, least(coalesce(u, 0), coalesce(d, 0)) AS top FROM s), w AS (SELECT part, {_BEFORE} AS mark FROM m),
 k AS (SELECT c.* FROM c JOIN w USING (part) WHERE us > mark * 1000)
 SELECT change_id, client_id, part FROM k r WHERE op = 'U' AND us < (SELECT max(top) FROM m) * 1000
 AND NOT EXISTS (SELECT 1 FROM k t WHERE t.op = 'D' AND t.client_id = r.client_id AND t.us <= r.us AND t.us >= r.us - {30 * _DAY * 1000})""",
}
