"""Usage, session and feedback analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def summary(log: DataFrame, since: Column | None = None) -> DataFrame:
    """AGG-01 over (ts, error, cache_hit, tokens, cost, latency_ms): one row."""
    rows = log.filter(F.col("ts") >= since) if since is not None else log
    n, hits = F.count("*"), F.count_if("cache_hit")
    return rows.agg(
        n.alias("requests"), F.count_if("error").alias("errors"), hits.alias("cache_hits"), F.when(n > 0, F.round(hits / n, 3)).otherwise(0.0).alias("hit_rate"),
        F.round(F.coalesce(F.sum("cost"), F.lit(0.0)), 4).alias("cost"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.round(F.coalesce(F.avg(F.when(F.col("latency_ms") != 0, F.col("latency_ms"))), F.lit(0.0)), 1).alias("mean_latency"),
    )


def by_key(log: DataFrame, key: str = "character") -> DataFrame:
    """AGG-02; an empty key is 'unknown'; costs are rounded once."""
    k = F.when(F.coalesce(F.col(key), F.lit("")) == "", "unknown").otherwise(F.col(key))
    return log.groupBy(k.alias(key)).agg(F.count("*").alias("requests"), F.round(F.sum("cost"), 4).alias("cost"), F.count_if("error").alias("errors"))


def latest_stages(log: DataFrame, top: int = 30) -> DataFrame:
    """WIN-13 over (ts, id, stages map): the latest requests that carry stages."""
    return log.filter(F.col("stages").isNotNull() & (F.size("stages") > 0)).orderBy(F.desc("ts"), F.desc("id")).limit(top)


def stage_times(log: DataFrame, how: str = "max") -> DataFrame:
    """AGG-21 over (request, stage, ms): a map of stages by request, largest or summed."""
    f = F.max if how == "max" else F.sum
    by = log.groupBy("request", "stage").agg(f("ms").alias("ms"))
    return by.groupBy("request").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("stage", "ms")))).alias("stages"))


def expired(rows: DataFrame, at: str, now: Column, days: int = 7) -> tuple[DataFrame, DataFrame]:
    """SNK-09, STR-04, DAT-01: (kept, removed) by age."""
    old = F.col(at) < now - F.expr(f"INTERVAL {days} DAYS")
    return rows.filter(~old), rows.filter(old)


def session_stats(sessions: DataFrame) -> DataFrame:
    """AGG-04 over (character, history JSON): bad JSON counts no turn but a session."""
    turns = F.coalesce(F.json_array_length("history"), F.lit(0))
    k = F.when(F.coalesce(F.col("character"), F.lit("")) == "", "unknown").otherwise(F.col("character"))
    return sessions.groupBy(k.alias("character")).agg(F.count("*").alias("sessions"), F.sum(turns).cast("long").alias("turns"))


def pairs(turns: DataFrame) -> DataFrame:
    """JN-20 over (conv_id, turn, role, text): a user turn with the assistant turn that follows it at once."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = turns.withColumn("next_role", F.lead("role").over(w)).withColumn("answer", F.lead("text").over(w))
    return t.filter("role = 'user' AND next_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("question"), "answer")


def last_turns(rows: DataFrame, n: int, key: str = "conv_id", order: str = "turn") -> tuple[DataFrame, DataFrame]:
    """WIN-08, STR-06, MIS-09: (the last n of each key, the overflow before them)."""
    ranked = rows.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order))))
    return ranked.filter(F.col("_rn") <= n).drop("_rn"), ranked.filter(F.col("_rn") > n).drop("_rn")


def trimmed(turns: DataFrame, n: int) -> DataFrame:
    """WIN-09: from the n-th last user turn on; everything if there are fewer."""
    back = Window.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, -1)
    user = F.when(F.col("role") == "user", 1).otherwise(0)
    t = turns.withColumn("_n", F.sum(user).over(back)).withColumn("_before", F.coalesce(F.sum(user).over(after), F.lit(0)))
    return t.filter(F.col("_before") < n).drop("_n", "_before")


def active_sessions(sessions: DataFrame, users: DataFrame, now: Column) -> DataFrame:
    """JN-01 over (token, user_id, expires) and (user_id, active): valid tokens of active users."""
    return sessions.filter(F.col("expires") > now).join(users.filter("active"), "user_id")


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """SNK-10, STR-17, SET-10: rows whose key is not in a list of deletions."""
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def latest(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """SNK-05: upserts folded; the latest row of a key wins."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def page(rows: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    """TOP-12."""
    return rows.orderBy(*order).offset(offset).limit(limit)


def lookup(rows: DataFrame, equal: dict[str, object] | None = None, at: str | None = None, since: Column | None = None, until: Column | None = None, order: list | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """SRC-07: point and range reads: rows with the given values, from ``since`` on and before ``until``, ordered and cut.
    The conditions are plain comparisons, which reach the scan."""
    for c, v in (equal or {}).items():
        rows = rows.filter(F.col(c) == F.lit(v))
    rows = rows.filter(F.col(at) >= since) if since is not None else rows
    rows = rows.filter(F.col(at) < until) if until is not None else rows
    rows = rows.orderBy(*order) if order else rows
    return rows.offset(offset).limit(limit) if limit is not None else rows


def known(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """JN-15: aggregates of known characters only."""
    return rows.join(ids.select(key).distinct(), key, "left_semi")


def listing(saves: DataFrame) -> DataFrame:
    """MIS-07 over (id, title, protagonist, npcs, turns (role), updated_at): summaries of saves, the newest first."""
    some = lambda c: F.when(F.coalesce(c, F.lit("")) != "", F.col(c))
    return saves.select("id", F.coalesce(some("title"), some("protagonist"), F.col("id").cast("string")).alias("title"), F.coalesce(F.size("npcs"), F.lit(0)).alias("npc_count"), F.coalesce(F.size(F.filter("turns", lambda t: t["role"] == "user")), F.lit(0)).alias("turns"), F.coalesce("updated_at", F.lit(0)).alias("updated_at")).orderBy(F.desc("updated_at"), "id")


def archives(rows: DataFrame, now: Column, days: int = 30, without: str = "transcript") -> DataFrame:
    """MIS-08 over (id, updated_at, ...): archives within their time to live, without the transcript, the newest first."""
    return rows.drop(without).filter(F.col("updated_at") >= now - F.expr(f"INTERVAL {days} DAYS")).orderBy(F.desc("updated_at"), "id")


def truncated(rows: DataFrame, keep: Column | int, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """MIS-10: the first ``keep`` rows of each key; a negative number keeps none."""
    n = F.lit(keep) if isinstance(keep, int) else keep
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter(F.col("_rn") <= n).drop("_rn")


def popped(pairs_: DataFrame, expected: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """MIS-10 over pairs (key, order, question, ...) and (key, expected): without the last pair of a key whose question
    is the expected one; a null expectation fits any; keys that are not expected keep all."""
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order))) == 1
    rows = pairs_.withColumn("_last", last).join(expected.select(key, "expected", F.lit(True).alias("_asked")), key, "left")
    fits = F.coalesce(F.col("_asked"), F.lit(False)) & (F.col("expected").isNull() | (F.col("question") == F.col("expected")))
    return rows.filter(~(F.col("_last") & F.coalesce(fits, F.lit(False)))).drop("_last", "_asked", "expected")


def history(pairs_: DataFrame, summaries: DataFrame, n: int, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """MIS-09 over pairs (key, order, question, answer) and (key, summary): a prompt's history, the summary first, then
    the last n turns with their numbers."""
    recent = last_turns(pairs_, n, key, order)[0]
    recent = recent.withColumn("_i", F.row_number().over(Window.partitionBy(key).orderBy(order)))
    line = F.concat(F.lit("第"), F.col("_i").cast("string"), F.lit("轮对话：\n用户："), "question", F.lit("\n助手："), "answer")
    body = recent.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_i", line.alias("line")))), lambda x: x["line"]), "\n\n").alias("_body"))
    out = summaries.select(key, "summary").join(body, key, "full")
    head = F.when(F.coalesce("summary", F.lit("")) != "", F.concat(F.lit("【早期对话摘要】\n"), "summary"))
    return out.select(key, F.concat_ws("\n\n", head, "_body").alias("history"))


def background(chunks: DataFrame, key: str = "collection", order: str = "ordinal") -> DataFrame:
    """MIS-04 over (key, order, text): the text of a collection, its chunks in stored order; overlaps stay."""
    rows = chunks.filter(T.strip(F.coalesce("text", F.lit(""))) != "")
    return rows.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, "text"))), lambda x: x["text"]), "\n\n").alias("background"))
