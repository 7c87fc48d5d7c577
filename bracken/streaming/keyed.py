"""Keyed state on streams: rate limiters, marker filters, answer caches.

State leaves with event time: it is dropped once the watermark has passed the time from which on it decides nothing
any more. Rows of a key are put in order within a trigger's input, which bounds what a task holds.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.limits import AnswerCache, FixedWindow, SlidingLog
from ..operators.story import MarkerFilter


def _decided(events: DataFrame, load: Callable, dump: Callable, state: str, keeps: float, late: str) -> DataFrame:
    """(user_id, event_id, accepted) over (user_id, event_id, t in seconds), the state of a user being that of a limiter
    that ``load`` makes of it and ``dump`` gives back; it goes ``keeps`` seconds after the user's last request."""
    rows = events.select("user_id", "event_id", "t", F.timestamp_micros((F.col("t") * 1_000_000).cast("long")).alias("ts")).withWatermark("ts", late)

    def step(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        limiter = load(held.get if held.exists else None)
        rows = pd.concat(list(batches)).sort_values(["t", "event_id"])
        accepted = [limiter.accepts(t) for t in rows["t"]]
        held.update(dump(limiter))
        held.setTimeoutTimestamp(max(int((rows["t"].max() + keeps) * 1000), held.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame({"user_id": key[0], "event_id": rows["event_id"].to_numpy(), "accepted": accepted})

    return rows.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, accepted boolean", state, "append", GroupStateTimeout.EventTimeTimeout)


def limited(events: DataFrame, minute: int, day: int, late: str = "1 hour") -> DataFrame:
    """STR-01 on a stream of (user_id, event_id, t): the windows' starts and counts are the state of a user."""
    return _decided(events, lambda s: FixedWindow(minute, day, json.loads(s[0]) if s else None), lambda x: (json.dumps(x.state),), "state string", 86_400, late)


def limited_sliding(events: DataFrame, most: int, late: str = "1 hour") -> DataFrame:
    """STR-02 on a stream: the log of accepted times is the state of a user."""
    return _decided(events, lambda s: SlidingLog(most, log=list(s[0]) if s else None), lambda x: (list(x.log),), "log array<double>", 60, late)


def first_answers(requests: DataFrame, ttl: float = 3600.0, late: str = "1 hour") -> DataFrame:
    """STR-03 on a stream of (user_id, event_id, t), user_id being the number of a user, persona and question: accepted
    requests are asked, the others are answered from the cache."""
    return _decided(requests, lambda s: AnswerCache(ttl, s[0] if s else None), lambda x: (x.since,), "since double", ttl, late)


def filtered(tokens: DataFrame) -> DataFrame:
    """STR-08 on a stream of (msg, ord, token, last): what may be shown so far of each message."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        f = MarkerFilter(tuple(state.get) if state.exists else ("", False))
        rows = pd.concat(list(batches)).sort_values("ord")
        out = "".join(f.feed(t) for t in rows["token"])
        if rows["last"].any():
            out += f.end()
        state.update((f.held, f.inside))
        yield pd.DataFrame({"msg": [key[0]], "ord": [int(rows["ord"].max())], "text": [out]})

    return tokens.select("msg", "ord", "token", "last").groupBy("msg").applyInPandasWithState(step, "msg long, ord long, text string", "held string, inside boolean", "append", GroupStateTimeout.NoTimeout)
