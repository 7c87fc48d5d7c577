"""Queries of keyed state: memories, limits, meetings, stories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import limits, meeting, memory, story
from ..session import table


def _items(spark, sf) -> DataFrame:
    v = table(spark, sf, "embeddings")
    return v.select((F.col("vec_id") % 20).alias("user_id"), F.col("vec_id").alias("id"), F.when(F.col("label") % 2 == 0, "profile").otherwise("topic").alias("kind"), F.concat(F.lit("t"), (F.col("vec_id") % 37).cast("string")).alias("text"), F.col("embedding").alias("vec"), (F.col("vec_id") * 7 % 101).alias("updated_at"))


def memory_topk(spark, sf):
    items = _items(spark, sf)
    q = items.filter("id % 20 = 0").select(F.col("id").alias("query_id"), (F.col("id") % 400 / 20).cast("long").alias("user_id"), "vec")
    return memory.recalled(items, q, similar=0.1).select("query_id", "id", "text", F.col("part").cast("long").alias("part"), "sim")


def memory_cap(spark, sf):
    return memory.capped(_items(spark, sf), {"profile": 3, "topic": 4}).select("user_id", "kind", "id")


def near_dup_argmax(spark, sf):
    items = _items(spark, sf)
    return memory.nearest_item(items, items.filter("id % 20 = 0"), 0.5)


def memory_merge(spark, sf):
    return memory.merged(_items(spark, sf).withColumn("vec", F.transform("vec", lambda x: x.cast("double"))), 0.5)


def _timed(spark, sf) -> DataFrame:
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return table(spark, sf, "events").select((F.col("user_id") % 10).alias("user_id"), "event_id", (t / 30).alias("t"))


def limiter_fixed(spark, sf):
    return limits.limited(_timed(spark, sf), lambda: limits.FixedWindow(2, 100))


def limiter_sliding(spark, sf):
    return limits.limited(_timed(spark, sf), lambda: limits.SlidingLog(2))


def answer_cache(spark, sf):
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return limits.limited(table(spark, sf, "events").select((F.col("user_id") % 10).alias("user_id"), "event_id", t.alias("t")), lambda: limits.AnswerCache(7200.0))


def decision_dedup(spark, sf):
    e = table(spark, sf, "events")
    rows = e.select(F.col("user_id").alias("run"), (F.col("event_id") % 4).alias("decision"), "ts", F.col("event_id").alias("id"), F.when(F.col("event_type") != "signup", F.col("user_id") % 4).alias("waiting"))
    return meeting.decisions(rows).select("id", "outcome")


def _turns(spark, sf) -> DataFrame:
    return table(spark, sf, "conversations").select(F.col("conv_id").alias("run"), F.col("turn").alias("ordinal"), F.when(F.col("turn") % 3 == 1, F.lit("turn-1")).alias("turn_id"), F.col("role").alias("speaker"), F.col("text").alias("content"), F.floor(F.col("turn") / 2).alias("round"))


def transcript_ids(spark, sf):
    return meeting.transcript(_turns(spark, sf)).select("run", "ordinal", "turn_id", "duplicate")


def bid_validate(spark, sf):
    c = table(spark, sf, "conversations")
    turns = c.select(F.col("conv_id").alias("run"), F.concat(F.lit("turn-"), F.col("turn").cast("string")).alias("turn_id"), F.col("role").alias("speaker"), F.col("text").alias("content"))
    b = c.select((F.col("conv_id") * 100 + F.col("turn")).alias("bid_id"), F.col("conv_id").alias("run"), F.when(F.col("conv_id") % 13 != 0, F.col("turn") % 5 != 4).alias("want"), (F.col("conv_id") % 7).alias("urgency"), F.when(F.col("turn") != 2, "because").alias("reason"), F.when(F.col("conv_id") % 6 == 0, "shout").otherwise("reply").alias("move"), F.when(F.col("turn") % 2 == 0, F.lit("user")).otherwise("assistant").alias("target_speaker"), F.concat(F.lit("turn-"), (F.col("turn") + F.when(F.col("conv_id") % 5 == 0, 50).otherwise(0)).cast("string")).alias("target_turn"), F.when(F.col("turn") % 3 == 0, F.substring("text", 3, 10)).otherwise("not there at all").alias("quote"))
    return meeting.bid_errors(b, turns).select("bid_id", "error")


def bid_rank(spark, sf):
    turns = _turns(spark, sf)
    speakers = turns.select("run", "speaker").distinct().unionByName(turns.select("run", F.lit("guest").alias("speaker")).distinct())
    last = meeting.last_spoke(turns, speakers)
    bids = last.withColumn("round", F.lit(9)).withColumn("urgency", (F.length("speaker") + F.col("run")) % 2)
    return meeting.ranked_bids(bids).select("run", "speaker", F.col("last_round").cast("long").alias("last_round"), F.col("rank").cast("long").alias("rank"))


def bid_counts(spark, sf):
    b = bid_validate(spark, sf).select("error", F.floor(F.col("bid_id") / 100).alias("run"), (F.col("bid_id") % 100).alias("round"), (F.col("bid_id") % 3 != 0).alias("want"))
    return meeting.bid_counts(b)


def lease_gaps(spark, sf):
    b = table(spark, sf, "events").select((F.col("user_id") % 50).alias("run"), "ts", F.col("event_type").alias("owner"))
    return meeting.leases(b, 7200).groupBy("run").agg(F.count_if("lapsed").alias("lapses"), F.count_if("taken_over").alias("takeovers"))


def unaccounted(spark, sf):
    e = table(spark, sf, "events")
    cursors = e.groupBy(F.col("user_id").alias("run")).agg(F.floor(F.avg("event_id")).alias("cursor")).filter("run % 3 <> 0")
    return meeting.unaccounted(e.select(F.col("user_id").alias("run"), F.col("event_id").alias("seq"), F.lit(1).alias("n")), cursors)


def tool_calls(spark, sf):
    li = table(spark, sf, "lineitem")
    d = li.groupBy(F.col("l_orderkey").alias("msg"), F.col("l_linenumber").alias("index"), F.col("l_partkey").alias("ord")).agg(F.max("l_returnflag").alias("name"), F.max("l_linestatus").alias("args"))
    return meeting.deltas(d.withColumn("id", F.when(F.col("ord") % 2 == 0, F.col("ord"))))


def _patches(spark, sf) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf, "events")
    field = F.concat(F.lit("f"), (F.col("event_id") % 5).cast("string"))
    raw = F.when(F.col("event_id") % 9 == 0, "true").when(F.col("event_id") % 8 == 0, " ").otherwise(F.col("value").cast("string"))
    ev = e.select((F.col("user_id") % 30).alias("save_id"), F.col("event_id").alias("ord"), F.col("event_type").alias("who"), field.alias("field"), raw.alias("raw"))
    field = F.explode(F.array(*[F.struct(F.lit(f"f{i}").alias("field"), F.lit("number" if i % 2 else "tag").alias("kind")) for i in range(4)]))
    defs = ev.select("save_id").distinct().select("save_id", field.alias("d")).select("save_id", "d.field", "d.kind")
    return ev, defs


def state_patch_fold(spark, sf):
    return story.patched(*_patches(spark, sf))


def state_sync(spark, sf):
    ev, defs = _patches(spark, sf)
    state = story.patched(ev, defs)
    return story.synced(state, defs.filter("field <> 'f3'"))


def marker_blocks(spark, sf):
    c = table(spark, sf, "conversations")
    token = F.when(F.col("turn") % 3 == 1, F.concat(F.lit("<state>"), F.col("text"))).when(F.col("turn") % 3 == 2, F.concat(F.col("text"), F.lit("</state>"))).otherwise(F.col("text"))
    return story.without_blocks(c.select(F.col("conv_id").alias("msg"), F.col("turn").alias("ord"), token.alias("token"))).select("msg", F.md5("text").alias("text_md5"))


def lorebook(spark, sf):
    words = ["the", "der", "que", "of", "und", "le"]
    entries = spark.createDataFrame([(i, f" {w} ", f"about {w}") for i, w in enumerate(words + ["the"])] + [(90, " ", "x")], "ord int, keyword string, content string")
    scan = table(spark, sf, "conversations").withColumn("_rn", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))).filter("_rn <= 3")
    q = scan.groupBy(F.col("conv_id").alias("query_id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n").alias("scan"))
    return story.lorebook(q, entries, 2).select("query_id", F.col("rank").cast("long").alias("rank"), "keyword", "content")


QUERIES = {f.__name__: f for f in (memory_topk, memory_cap, near_dup_argmax, memory_merge, limiter_fixed, limiter_sliding, answer_cache, decision_dedup, transcript_ids, bid_validate, bid_rank, bid_counts, lease_gaps, unaccounted, tool_calls, state_patch_fold, state_sync, marker_blocks, lorebook)}

_I = "it AS (SELECT vec_id % 20 AS user_id, vec_id AS id, CASE WHEN label % 2 = 0 THEN 'profile' ELSE 'topic' END AS kind, 't' || CAST(vec_id % 37 AS VARCHAR) AS text, embedding::DOUBLE[] AS vec, vec_id * 7 % 101 AS updated_at FROM embeddings)"
_BID = """tn AS (SELECT conv_id AS run, 'turn-' || CAST(turn AS VARCHAR) AS turn_id, role AS speaker, text AS content FROM conversations),
bd AS (SELECT conv_id * 100 + turn AS bid_id, conv_id AS run, CASE WHEN conv_id % 13 <> 0 THEN turn % 5 <> 4 END AS want, conv_id % 7 AS urgency, CASE WHEN turn <> 2 THEN 'because' END AS reason, CASE WHEN conv_id % 6 = 0 THEN 'shout' ELSE 'reply' END AS move, CASE WHEN turn % 2 = 0 THEN 'user' ELSE 'assistant' END AS target_speaker,
 'turn-' || CAST(turn + CASE WHEN conv_id % 5 = 0 THEN 50 ELSE 0 END AS VARCHAR) AS target_turn, CASE WHEN turn % 3 = 0 THEN substr(text, 3, 10) ELSE 'not there at all' END AS quote FROM conversations),
be AS (SELECT bid_id, CASE WHEN want IS NULL THEN 'want' WHEN want AND NOT urgency BETWEEN 1 AND 5 THEN 'urgency' WHEN want AND reason IS NULL THEN 'reason' WHEN move <> 'reply' THEN 'move' WHEN speaker IS NULL THEN 'unknown turn' WHEN speaker <> target_speaker THEN 'speaker' WHEN NOT contains(content, quote) OR quote = '' THEN 'quote' END AS error FROM bd LEFT JOIN tn ON bd.run = tn.run AND bd.target_turn = tn.turn_id)"""
_P = """ev AS (SELECT user_id % 30 AS save_id, event_id AS ord, event_type AS who, 'f' || CAST(event_id % 5 AS VARCHAR) AS field, event_id % 5 AS f, value, event_id FROM events WHERE event_id % 5 < 4),
ok AS (SELECT *, CASE WHEN f % 2 = 1 THEN 'number' ELSE 'tag' END AS kind, CASE WHEN f % 2 = 1 AND event_id % 9 <> 0 AND event_id % 8 <> 0 THEN round(value, 2) END AS num, CASE WHEN f % 2 = 0 THEN CASE WHEN event_id % 9 = 0 THEN 'true' WHEN event_id % 8 = 0 THEN NULL ELSE CAST(value AS VARCHAR) END END AS tag FROM ev),
good AS (SELECT * FROM ok WHERE num IS NOT NULL OR tag IS NOT NULL)"""
_TOKEN = "CASE turn % 3 WHEN 1 THEN '<state>' || text WHEN 2 THEN text || '</state>' ELSE text END"

_TIMED = "tm AS MATERIALIZED (SELECT user_id % 10 AS user_id, event_id, epoch_us(ts) / 1e6 / 30 AS t, row_number() OVER (PARTITION BY user_id % 10 ORDER BY epoch_us(ts) / 1e6 / 30, event_id) AS n FROM events)"
#: One request after the other: the windows' starts and counts so far, and whether the request is accepted.
_FIXED = f"""WITH RECURSIVE {_TIMED}, st AS (SELECT user_id, event_id, n, t AS m, t AS d, 1 AS mc, 1 AS dc, TRUE AS accepted FROM tm WHERE n = 1
 UNION ALL SELECT user_id, event_id, n, m, d, CAST(mc + ok AS INT), CAST(dc + ok AS INT), ok = 1 FROM (SELECT *, CAST(mc < 2 AND dc < 100 AS INT) AS ok FROM (SELECT tm.user_id, tm.event_id, tm.n, CASE WHEN tm.t - m > 60 THEN tm.t ELSE m END AS m, CASE WHEN tm.t - d > 86400 THEN tm.t ELSE d END AS d, CASE WHEN tm.t - m > 60 THEN 0 ELSE mc END AS mc, CASE WHEN tm.t - d > 86400 THEN 0 ELSE dc END AS dc FROM st JOIN tm ON tm.user_id = st.user_id AND tm.n = st.n + 1)))
 SELECT user_id, event_id, accepted FROM st"""

_SLIDING = f"""WITH RECURSIVE {_TIMED}, st AS (SELECT user_id, event_id, n, t AS a, NULL::DOUBLE AS b, TRUE AS accepted FROM tm WHERE n = 1
 UNION ALL SELECT tm.user_id, tm.event_id, tm.n, CASE WHEN b IS NULL OR tm.t - b > 60 THEN tm.t ELSE a END, CASE WHEN b IS NULL OR tm.t - b > 60 THEN a ELSE b END, b IS NULL OR tm.t - b > 60 FROM st JOIN tm ON tm.user_id = st.user_id AND tm.n = st.n + 1) SELECT user_id, event_id, accepted FROM st"""
_ANSWERS = f"""WITH RECURSIVE {_TIMED.replace(" / 30", "")}, st AS (SELECT user_id, event_id, n, t AS since, TRUE AS accepted FROM tm WHERE n = 1
 UNION ALL SELECT tm.user_id, tm.event_id, tm.n, CASE WHEN tm.t - since > 7200 THEN tm.t ELSE since END, tm.t - since > 7200 FROM st JOIN tm ON tm.user_id = st.user_id AND tm.n = st.n + 1) SELECT user_id, event_id, accepted FROM st"""

ORACLES = {
    "limiter_fixed": _FIXED,
    "limiter_sliding": _SLIDING,
    "answer_cache": _ANSWERS,
    "memory_merge": f"""WITH RECURSIVE {_I}, s AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY user_id, kind ORDER BY id) AS n FROM it),
 f AS (SELECT user_id, kind, n, [{{'id': id, 'vec': vec, 'text': text, 'updates': 0::BIGINT}}] AS kept FROM s WHERE n = 1
 UNION ALL SELECT user_id, kind, n, CASE WHEN list_max(sims) >= 0.5 THEN list_transform(kept, lambda k, i: CASE WHEN i = list_position(sims, list_max(sims)) THEN {{'id': k.id, 'vec': vec, 'text': text, 'updates': k.updates + 1}} ELSE k END) ELSE list_append(kept, {{'id': id, 'vec': vec, 'text': text, 'updates': 0::BIGINT}}) END
 FROM (SELECT s.user_id, s.kind, s.n, s.id, s.vec, s.text, kept, list_transform(kept, lambda k: list_dot_product(k.vec, s.vec)) AS sims FROM f JOIN s ON s.user_id = f.user_id AND s.kind = f.kind AND s.n = f.n + 1)),
 e AS (SELECT user_id, kind, unnest(kept) AS k FROM f WHERE n = (SELECT max(n) FROM s WHERE s.user_id = f.user_id AND s.kind = f.kind)) SELECT user_id, kind, k.id AS id, k.text AS text, k.updates AS updates FROM e""",
    "memory_topk": f"""WITH {_I}, q AS (SELECT id AS query_id, id % 400 // 20 AS user_id, vec AS qv FROM it WHERE id % 20 = 0), b AS (SELECT * FROM it JOIN q USING (user_id)),
 p AS (SELECT query_id, id, text, 0 AS part, row_number() OVER (PARTITION BY query_id ORDER BY updated_at DESC, id DESC) AS rn, NULL::DOUBLE AS sim FROM b WHERE kind = 'profile'),
 s AS (SELECT query_id, id, text, 1 AS part, round(list_dot_product(vec, qv), 6) AS sim FROM b WHERE kind = 'topic'), t AS (SELECT query_id, id, text, part, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS rn, sim FROM s),
 u AS (SELECT * FROM p WHERE rn <= 5 UNION ALL SELECT * FROM t WHERE rn <= 3 AND sim >= 0.1), d AS (SELECT *, row_number() OVER (PARTITION BY query_id, text ORDER BY part, rn) AS k FROM u) SELECT query_id, id, text, part, sim FROM d WHERE k = 1""",
    "memory_cap": f"WITH {_I}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id, kind ORDER BY updated_at DESC, id DESC) AS rn FROM it) SELECT user_id, kind, id FROM r WHERE rn <= CASE kind WHEN 'profile' THEN 3 ELSE 4 END",
    "near_dup_argmax": f"WITH {_I}, s AS (SELECT a.user_id, a.kind, a.id, b.id AS old_id, round(list_cosine_similarity(a.vec, b.vec), 6) AS sim FROM it a LEFT JOIN it b ON a.user_id = b.user_id AND a.kind = b.kind AND b.id <> a.id WHERE a.id % 20 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC NULLS LAST, old_id) AS rn FROM s) SELECT user_id, kind, id, old_id, sim, coalesce(sim >= 0.5, FALSE) AS replaces FROM r WHERE rn = 1",
    "decision_dedup": "WITH r AS (SELECT user_id, event_id % 4 AS decision, event_id AS id, CASE WHEN event_type <> 'signup' THEN user_id % 4 END AS waiting, row_number() OVER (PARTITION BY user_id, event_id % 4 ORDER BY ts, event_id) AS rn FROM events) SELECT id, CASE WHEN waiting IS NULL THEN 'not waiting' WHEN rn > 1 THEN 'duplicate' WHEN waiting <> decision THEN 'stale' ELSE 'accepted' END AS outcome FROM r",
    "transcript_ids": "WITH t AS (SELECT conv_id AS run, turn AS ordinal, CASE WHEN turn % 3 = 1 THEN 'turn-1' ELSE 'turn-' || CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS VARCHAR) END AS turn_id FROM conversations) SELECT *, count(*) OVER (PARTITION BY run, turn_id) > 1 AS duplicate FROM t",
    "bid_validate": f"WITH {_BID} SELECT bid_id, error FROM be",
    "bid_rank": "WITH t AS (SELECT conv_id AS run, role AS speaker, max_by(turn // 2, turn) AS last_round FROM conversations GROUP BY 1, 2 UNION ALL SELECT DISTINCT conv_id, 'guest', -1 FROM conversations) SELECT run, speaker, last_round, row_number() OVER (PARTITION BY run ORDER BY (length(speaker) + run) % 2 DESC, last_round, speaker) AS rank FROM t",
    "bid_counts": f"WITH {_BID}, x AS (SELECT error, bid_id // 100 AS run, bid_id % 100 AS round, bid_id % 3 <> 0 AS want FROM be) SELECT run, round, count(*) FILTER (error IS NOT NULL) AS failed, count(*) FILTER (error IS NULL AND NOT want) AS abstained, count(*) FILTER (error IS NULL AND want) AS eligible FROM x GROUP BY run, round",
    "lease_gaps": "WITH b AS (SELECT user_id % 50 AS run, event_type AS owner, epoch_us(ts) - lag(epoch_us(ts)) OVER w > 7200000000 AS lapsed, lag(event_type) OVER w AS prev FROM events WINDOW w AS (PARTITION BY user_id % 50 ORDER BY ts, event_type)) SELECT run, count(*) FILTER (lapsed) AS lapses, count(*) FILTER (lapsed AND prev <> owner) AS takeovers FROM b GROUP BY run",
    "unaccounted": "WITH c AS (SELECT user_id AS run, floor(avg(event_id)) AS cur FROM events WHERE user_id % 3 <> 0 GROUP BY 1) SELECT user_id AS run, count(*) AS n, max(event_id) AS cursor FROM events LEFT JOIN c ON user_id = run WHERE event_id > coalesce(cur, -1) GROUP BY 1",
    "tool_calls": "WITH d AS (SELECT l_orderkey AS msg, l_linenumber AS index, l_partkey AS ord, max(l_returnflag) AS name, max(l_linestatus) AS args FROM lineitem GROUP BY 1, 2, 3) SELECT msg, index, max(ord) FILTER (ord % 2 = 0) AS id, string_agg(name, '' ORDER BY ord) AS name, string_agg(args, '' ORDER BY ord) AS args FROM d GROUP BY msg, index",
    "state_patch_fold": f"WITH {_P} SELECT save_id, who, field, kind, arg_max(num, ord) AS num, arg_max(tag, ord) AS tag, count(*) AS patches FROM good GROUP BY save_id, who, field, kind",
    "state_sync": f"WITH {_P}, st AS (SELECT save_id, who, field, arg_max(num, ord) AS num, arg_max(tag, ord) AS tag FROM good GROUP BY ALL), p AS (SELECT DISTINCT save_id, who FROM st), df AS (SELECT * FROM (VALUES ('f0', 'tag'), ('f1', 'number'), ('f2', 'tag')) d(field, kind)) SELECT p.save_id, p.who, df.field, kind, CASE WHEN kind = 'number' THEN coalesce(num, 0.0) END AS num, CASE WHEN kind = 'tag' THEN coalesce(tag, '') END AS tag FROM p CROSS JOIN df LEFT JOIN st ON st.save_id = p.save_id AND st.who = p.who AND st.field = df.field",
    "marker_blocks": f"SELECT conv_id AS msg, md5(regexp_replace(string_agg({_TOKEN}, '' ORDER BY turn), '(?s)<state>.*?</state>', '', 'g')) AS text_md5 FROM conversations GROUP BY conv_id",
    "lorebook": "WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations), s AS (SELECT conv_id AS query_id, string_agg(text, chr(10) ORDER BY turn) AS scan FROM r WHERE rn <= 3 GROUP BY conv_id), e AS (SELECT * FROM (VALUES (0, 'the'), (1, 'der'), (2, 'que'), (3, 'of'), (4, 'und'), (5, 'le')) v(ord, w)), h AS (SELECT query_id, ' ' || w || ' ' AS keyword, 'about ' || w AS content, row_number() OVER (PARTITION BY query_id ORDER BY ord) AS rank FROM s JOIN e ON contains(scan, ' ' || w || ' ')) SELECT * FROM h WHERE rank <= 2",
}
