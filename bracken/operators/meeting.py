"""Multi-speaker meetings: transcripts, bids, decisions, leases."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import profiles as P
from ..functions import text as T

MOVES = ("support", "challenge", "extend", "question", "reply")


def transcript(turns: DataFrame) -> DataFrame:
    """WIN-15 over (run, ordinal, turn_id, ...): default ids turn-1, ...; adds duplicate."""
    n = F.row_number().over(Window.partitionBy("run").orderBy("ordinal"))
    named = turns.withColumn("_n", n).withColumn("turn_id", F.when(F.coalesce(F.col("turn_id"), F.lit("")) == "", F.concat(F.lit("turn-"), F.col("_n").cast("string"))).otherwise(F.col("turn_id"))).drop("_n")
    return named.withColumn("duplicate", F.count("*").over(Window.partitionBy("run", "turn_id")) > 1)


def bid_errors(bids: DataFrame, turns: DataFrame, moves: tuple[str, ...] = MOVES) -> DataFrame:
    """JN-14 over bids (bid_id, run, want, urgency, reason, move, target_speaker, target_turn, quote) and turns
    (run, turn_id, speaker, content): adds error, null for a valid bid; the first violation counts."""
    t = turns.select("run", F.col("turn_id").alias("target_turn"), F.col("speaker").alias("_s"), F.col("content").alias("_c"))
    b = bids.join(t, ["run", "target_turn"], "left")
    targeted = F.col("target_turn").isNotNull()
    error = (
        F.when(F.col("want").isNull(), "want")
        .when(F.col("want") & ~F.coalesce(F.col("urgency").between(1, 5), F.lit(False)), "urgency")
        .when(F.col("want") & (F.trim(F.coalesce("reason", F.lit(""))) == ""), "reason")
        .when(F.col("move").isNotNull() & ~F.col("move").isin(*moves), "move")
        .when(targeted & F.col("_s").isNull(), "unknown turn")
        .when(targeted & (F.col("_s") != F.col("target_speaker")), "speaker")
        .when(targeted & ~F.coalesce(F.contains("_c", "quote") & (F.col("quote") != ""), F.lit(False)), "quote")
    )
    return b.withColumn("error", error).drop("_s", "_c")


def last_spoke(turns: DataFrame, speakers: DataFrame) -> DataFrame:
    """AGG-26 over (run, speaker, round, ordinal): the round of each speaker's last turn, -1 if none."""
    by = turns.groupBy("run", "speaker").agg(F.max_by("round", "ordinal").alias("last_round"))
    return speakers.join(by, ["run", "speaker"], "left").withColumn("last_round", F.coalesce("last_round", F.lit(-1)))


def ranked_bids(bids: DataFrame) -> DataFrame:
    """TOP-08 over (run, round, speaker, urgency, last_round): urgency, longest silence, id."""
    w = Window.partitionBy("run", "round").orderBy(F.desc("urgency"), "last_round", "speaker")
    return bids.withColumn("rank", F.row_number().over(w))


def bid_counts(bids: DataFrame) -> DataFrame:
    """AGG-20 over (run, round, want, error): failures, abstentions and eligible bidders."""
    ok = F.col("error").isNull()
    return bids.groupBy("run", "round").agg(F.count_if(~ok).alias("failed"), F.count_if(ok & ~F.col("want")).alias("abstained"), F.count_if(ok & F.col("want")).alias("eligible"))


def attempts(available: Column, bidders: Column) -> Column:
    """AGG-20: tries that the budget leaves to each bidder, three at most."""
    return F.least(F.lit(3), F.floor(available / F.greatest(bidders, F.lit(1)))).cast("int")


def stops(used: Column, bidders: Column, most: Column) -> Column:
    """MIS-14: whether the budget ends before bids, or after them."""
    return F.when(used + bidders + 1 > most, "before bids").when(used + 1 > most, "after bids")


def decisions(events: DataFrame) -> DataFrame:
    """STR-07 over (run, decision, ts, id, waiting decision): accepted, duplicate, stale or not waiting."""
    first = F.row_number().over(Window.partitionBy("run", "decision").orderBy("ts", "id"))
    outcome = F.when(F.col("waiting").isNull(), "not waiting").when(F.col("_rn") > 1, "duplicate").when(F.col("waiting") != F.col("decision"), "stale").otherwise("accepted")
    return events.withColumn("_rn", first).withColumn("outcome", outcome).drop("_rn")


def leases(beats: DataFrame, seconds: int = 60) -> DataFrame:
    """STR-05 over (run, ts, owner): adds lapsed, a gap longer than the lease, and whether another owner took over."""
    w = Window.partitionBy("run").orderBy("ts", "owner")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.lag(F.unix_micros(F.col("ts").cast("timestamp"))).over(w)
    before = F.lag("owner").over(w)
    b = beats.withColumn("lapsed", F.coalesce(gap > seconds * 1_000_000, F.lit(False))).withColumn("_o", before)
    return b.withColumn("taken_over", F.coalesce(F.col("lapsed") & (F.col("_o") != F.col("owner")), F.lit(False))).drop("_o")


def unaccounted(events: DataFrame, cursors: DataFrame) -> DataFrame:
    """AGG-19 over (run, seq, n) and (run, cursor): what is new since the cursor, and the cursor after it."""
    new = events.join(cursors, "run", "left").filter(F.col("seq") > F.coalesce("cursor", F.lit(-1)))
    return new.groupBy("run").agg(F.sum("n").alias("n"), F.max("seq").alias("cursor"))


def deltas(parts: DataFrame) -> DataFrame:
    """STR-14 over (msg, index, ord, id, name, args): tool calls put together from their parts."""
    text = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", F.coalesce(c, F.lit("")).alias("v")))), lambda x: x["v"]), "")
    return parts.groupBy("msg", "index").agg(F.max_by("id", F.when(F.col("id").isNotNull(), F.col("ord"))).alias("id"), text("name").alias("name"), text("args").alias("args"))


def first_speeches(turns: DataFrame, chars: int = P.STANCE_CHARS) -> DataFrame:
    """WIN-11 over (run, ordinal, speaker, name, content): the start of each speaker's first turn as a stance."""
    w = Window.partitionBy("run", "speaker").orderBy("ordinal")
    t = turns.filter(F.coalesce("speaker", F.lit("")) != "").withColumn("_rn", F.row_number().over(w)).filter("_rn = 1")
    name = F.when(F.coalesce("name", F.lit("")) != "", F.col("name")).otherwise(F.col("speaker"))
    return t.select("run", "ordinal", name.alias("name"), F.left(_flat(F.col("content")), F.lit(chars)).alias("stance"))


def _flat(c: Column) -> Column:
    return F.replace(T.strip(F.coalesce(c, F.lit(""))), F.lit("\n"), F.lit(" "))


def verdict_word(text: Column, words: tuple[str, ...] = P.SUMMARY_BANNED) -> Column:
    """MIS-12: the first of the words that the text has; empty if it has none."""
    hit = F.lit("")
    for w in reversed(words):
        hit = F.when(F.contains(text, F.lit(w)), F.lit(w)).otherwise(hit)
    return hit


def summaries(raw: DataFrame, words: tuple[str, ...] = P.SUMMARY_BANNED) -> DataFrame:
    """TOP-14, MIS-12 over (run, names, clashes (a, b, point), positions (name, stance), open, closing, applications (name,
    scenario, application)): entries without a verdict word, of known speakers, in their caps; a closing that is empty or
    has a verdict word is replaced. Null names let every name pass."""
    # each text is flattened once, before the conditions that look at it several times
    flat = lambda items, *names: F.transform(items, lambda x: F.struct(*[_flat(x[n]).alias(n) for n in names]))
    banned = "|".join(map(re.escape, words)) or "(?!)"
    ok = lambda c: (c != "") & ~F.rlike(c, F.lit(banned))
    known = lambda c: (c != "") & (F.col("names").isNull() | F.coalesce(F.array_contains("names", c), F.lit(False)))
    first = lambda c, n: F.slice(c, 1, n)
    clashes = F.filter(flat("clashes", "a", "b", "point"), lambda x: known(x["a"]) & known(x["b"]) & (x["a"] != x["b"]) & ok(x["point"]))
    positions = F.filter(flat("positions", "name", "stance"), lambda x: known(x["name"]) & ok(x["stance"]))
    opens = F.filter(F.transform("open", _flat), ok)
    uses = F.filter(flat("applications", "name", "scenario", "application"), lambda x: known(x["name"]) & ok(x["scenario"]) & ok(x["application"]))
    cut = lambda c: F.left(c, F.lit(P.SUMMARY_CHARS))
    uses = F.transform(uses, lambda x: F.struct(x["name"].alias("name"), cut(x["scenario"]).alias("scenario"), cut(x["application"]).alias("application")))
    end = _flat(F.col("closing"))
    closing = F.when(ok(end), F.left(end, F.lit(P.CLOSING_CHARS))).otherwise(P.CLOSING)
    return raw.select("run", first(clashes, P.SUMMARY_CLASHES).alias("clashes"), positions.alias("positions"), first(opens, P.SUMMARY_OPEN).alias("open"), closing.alias("closing"), first(uses, P.SUMMARY_APPLICATIONS).alias("applications"))


def needs_refresh(pending: DataFrame, bids: DataFrame) -> DataFrame:
    """MIS-13 over pending rounds (run, round, bid_round) and bids (run, round, failed, error): adds refresh: bids were
    not collected for the round, there are none, or one that had not failed is not valid any more."""
    by = bids.groupBy("run", "round").agg(F.count("*").alias("_n"), F.bool_or(~F.coalesce("failed", F.lit(False)) & F.col("error").isNotNull()).alias("_bad"))
    p = pending.join(by, ["run", "round"], "left")
    return p.withColumn("refresh", (F.coalesce("bid_round", F.lit(0)) < F.col("round")) | F.col("_n").isNull() | F.coalesce("_bad", F.lit(False))).drop("_n", "_bad")


def bid_loop(rosters: DataFrame, bids: DataFrame, max_rounds: int = 6, quota: int = 4, max_calls: int = 24) -> DataFrame:
    """STR-11 over rosters (run, speaker, seat) and bids (run, round, speaker, want, urgency, error): (run, winners in
    order of rounds, reason, rounds, calls).

    Every speaker opens in the order of seats. Then a round takes bids of those with quota left who did not win the round
    before; each bid is a call, and a speech is one. The most urgent valid bid wins, ties by the longest silence and the
    name (TOP-08). It ends for rounds, quota, budget or, without a bid, by the host. A meeting is one row, folded
    over its rounds.
    """
    seats = rosters.groupBy("run").agg(F.sort_array(F.collect_list(F.struct("seat", "speaker"))).alias("_seats"))
    ok = F.col("want") & F.col("error").isNull()
    by = bids.groupBy("run").agg(F.collect_list(F.when(ok, F.struct("round", "speaker", "urgency"))).alias("_bids"))
    runs = seats.join(by, "run", "left").withColumn("_bids", F.coalesce("_bids", F.array().cast("array<struct<round:int,speaker:string,urgency:int>>")))
    ledger = F.transform("_seats", lambda s: F.struct(s["speaker"].alias("speaker"), F.lit(1).alias("speeches"), F.lit(0).alias("spoke")))
    zero = F.struct(F.lit(0).alias("rounds"), F.size("_seats").alias("calls"), F.lit("").alias("last"), F.lit("").alias("reason"), F.array().cast("array<string>").alias("winners"), ledger.alias("ledger"))

    def step(s: Column, n: Column) -> Column:
        free = F.filter(s["ledger"], lambda x: x["speeches"] < quota)
        bidders = F.filter(free, lambda x: x["speaker"] != s["last"])
        spent = s["calls"] + F.size(bidders)
        reason = F.when(s["reason"] != "", s["reason"]).when(F.size(bidders) == 0, "quota").when(spent + 1 > max_calls, "budget")
        offers = F.transform(bidders, lambda x: F.struct(x["speaker"].alias("speaker"), x["spoke"].alias("spoke"), F.array_max(F.transform(F.filter("_bids", lambda b: (b["round"] == n) & (b["speaker"] == x["speaker"])), lambda b: b["urgency"])).alias("urgency")))
        best = F.array_min(F.transform(F.filter(offers, lambda o: o["urgency"].isNotNull()), lambda o: F.struct((-o["urgency"]).alias("u"), o["spoke"].alias("s"), o["speaker"].alias("who"))))["who"]
        ends = F.coalesce(reason, F.when(best.isNull(), "host"), F.lit(""))
        goes = ends == ""
        told = F.transform(s["ledger"], lambda x: F.when(goes & (x["speaker"] == best), F.struct(x["speaker"].alias("speaker"), (x["speeches"] + 1).alias("speeches"), n.alias("spoke"))).otherwise(x))
        calls = F.when(reason.isNotNull(), s["calls"]).when(goes, spent + 1).otherwise(spent)
        return F.struct(F.when(goes, n).otherwise(s["rounds"]).alias("rounds"), calls.alias("calls"), F.when(goes, best).otherwise(s["last"]).alias("last"), ends.alias("reason"), F.when(goes, F.concat(s["winners"], F.array(best))).otherwise(s["winners"]).alias("winners"), told.alias("ledger"))

    end = F.aggregate(F.sequence(F.lit(1), F.lit(max_rounds)), zero, step)
    return runs.select("run", end.alias("_s")).select("run", F.col("_s.winners").alias("winners"), F.when(F.col("_s.reason") == "", "rounds").otherwise(F.col("_s.reason")).alias("reason"), F.col("_s.rounds").alias("rounds"), F.col("_s.calls").alias("calls"))
