"""Rate limits. Acceptance depends on what was accepted before, so each key is folded in order of time."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..functions import profiles as P


class FixedWindow:
    """STR-01: windows that start at a request; minute before day; what is rejected does not count."""

    def __init__(self, minute: int = P.LIMIT_MINUTE, day: int = P.LIMIT_DAY, state: list | None = None):
        self.limits = ((60.0, minute), (86400.0, day))
        self.state = state or [[None, 0], [None, 0]]

    def accepts(self, t: float) -> bool:
        for (span, _), s in zip(self.limits, self.state):
            if s[0] is None or t - s[0] > span:
                s[:] = [t, 0]
        if any(s[1] >= most for (_, most), s in zip(self.limits, self.state)):
            return False
        for s in self.state:
            s[1] += 1
        return True


class SlidingLog:
    """STR-02: a log of what was accepted in the last minute."""

    def __init__(self, most: int = P.LIMIT_GLOBAL, span: float = 60.0, log: list | None = None):
        self.most, self.span, self.log = most, span, deque(log or [])

    def accepts(self, t: float) -> bool:
        while self.log and t - self.log[0] > self.span:
            self.log.popleft()
        if len(self.log) >= self.most:
            return False
        self.log.append(t)
        return True


class AnswerCache:
    """STR-03: an answer holds for ``ttl`` seconds; what it answers is no new request."""

    def __init__(self, ttl: float = 3600.0, since: float | None = None):
        self.ttl, self.since = ttl, since

    def accepts(self, t: float) -> bool:
        if self.since is not None and t - self.since <= self.ttl:
            return False
        self.since = t
        return True


class Lease:
    """STR-05: an owner holds a run for ``span`` seconds from its last beat. Another owner takes over after that only, and
    what a stale owner sends is fenced off."""

    def __init__(self, span: float = 60.0):
        self.span, self.owner, self.until = span, None, None

    def accepts(self, t: float, owner: str) -> bool:
        if self.owner is not None and owner != self.owner and t <= self.until:
            return False
        self.owner, self.until = owner, t + self.span
        return True


def limited(events: DataFrame, make, key: str = "user_id", more: tuple[str, ...] = ()) -> DataFrame:
    """(key, event_id, accepted) over (key, event_id, t in seconds, ``more``); ``make`` gives a limiter for each key,
    which is asked with t and ``more``. Keys are sorted and streamed: a task holds a batch and one limiter, however many
    requests a key has."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, limiter = None, None
        for b in batches:
            accepted = []
            for k, *asked in zip(b[key], b["t"], *[b[c] for c in more]):
                if limiter is None or k != last:
                    last, limiter = k, make()
                accepted.append(limiter.accepts(*asked))
            yield pd.DataFrame({key: b[key], "event_id": b["event_id"], "accepted": accepted})

    rows = events.select(key, "event_id", "t", *more).repartition(key).sortWithinPartitions(key, "t", "event_id")
    return rows.mapInPandas(fold, f"{key} long, event_id long, accepted boolean")
