"""Decisions and tombstones on streams: state over triggers, late rows, state that goes."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from bracken.session import shared_path
from bracken.streaming.once import claimed, in_parts, restored

START = datetime(2024, 1, 1)


def day(n: float) -> datetime:
    return START + timedelta(days=n)


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_a_decision_counts_once_over_triggers_and_late_rows_not_at_all(spark):
    rows = [(1, "a", day(0), 1), (1, "a", day(0.1), 1), (1, "a", day(0.5), 2), (2, "a", day(9), 2), (1, "b", day(1), 3), (None, "a", day(9), 2), (None, "a", day(9.5), 3), (3, "c", day(8), 3)]
    at = shared_path(spark, "test-claims")
    df = frame(spark, rows, "run long, decision string, ts timestamp, part int")
    got = in_parts(spark, {"d": df}, lambda d: claimed(d, ["run", "decision"], late="1 day"), at=at).select("run", "decision", "part")
    # (3, c) lies on the watermark of day 8 and is late, as (1, b) is
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, "a", 1), (2, "a", 2), (None, "a", 2)], key=str)
    left = spark.read.format("statestore").load(f"{at}/state")
    assert left.filter(F.col("key.run") == 1).count() == 0  # its time is over
    assert left.count() == 2


@pytest.mark.parametrize("salt", [0, 1, 2])
def test_restores_equal_brute_force(spark, salt):
    import random

    draw = random.Random(salt)
    restores = [(i, draw.choice([1, 2, 3, None]), day(draw.randrange(400) / 10)) for i in range(80)]
    tombs = [(draw.choice([1, 2, 3, None]), day(draw.randrange(400) / 10)) for _ in range(12)]
    part = lambda ts: 1 + int((ts - START).days // 14)
    r = [(*x, part(x[2])) for x in restores] + [(999, 9, day(100), 9)]
    t = [(*x, part(x[1])) for x in tombs] + [(8, day(100), 9)]
    got = in_parts(spark, {"restores": frame(spark, r, "id long, who long, ts timestamp, part int"), "tombstones": frame(spark, t, "who long, ts timestamp, part int")}, lambda restores, tombstones: restored(restores, tombstones, "who", "5 days", "20 days"))
    want = [i for i, who, ts in restores if not any(who is not None and who == k and timedelta(0) <= ts - died <= timedelta(days=5) for k, died in tombs)]
    assert sorted(x["id"] for x in got.collect()) == sorted(want)
    assert got.columns == ["id", "who", "ts", "part"]


def test_a_tombstone_of_a_later_trigger_still_blocks(spark):
    r = frame(spark, [(1, 7, day(3), 1), (2, 6, day(3), 1), (3, 9, day(50), 3)], "id long, who long, ts timestamp, part int")
    t = frame(spark, [(7, day(2), 2), (0, day(50), 3)], "who long, ts timestamp, part int")
    got = in_parts(spark, {"restores": r, "tombstones": t}, lambda restores, tombstones: restored(restores, tombstones, "who", "5 days", "2 days"))
    assert [x["id"] for x in got.collect()] == [2]


def test_nothing_comes_of_nothing(spark):
    none = frame(spark, [], "run long, decision string, ts timestamp, part int")
    assert in_parts(spark, {"d": none}, lambda d: claimed(d, ["run"])).count() == 0


def test_markers_cut_anywhere_in_time_that_grows_with_the_tokens():
    import random
    import re
    import time

    from bracken.operators.story import CLOSE, OPEN, MarkerFilter

    draw = random.Random(1)
    for _ in range(3000):
        text = "".join(draw.choices([OPEN, CLOSE, "a", "<", "<st", "</state", "e>", ">"], k=draw.randrange(12)))
        cuts = sorted(draw.randrange(len(text) + 1) for _ in range(draw.randrange(8)))
        out, state = "", ("", False)
        for i, j in zip([0, *cuts], [*cuts, len(text)]):
            f = MarkerFilter(state)
            out += f.feed(text[i:j])
            state = (f.held, f.inside)
        out += MarkerFilter(state).end()
        assert out == re.sub(f"(?s){OPEN}.*?{CLOSE}", "", text), (text, cuts)

    def took(n):
        f, began = MarkerFilter(), time.perf_counter()
        f.feed(OPEN)
        for _ in range(n):
            assert f.feed("some text ") == ""
        assert len(f.end()) == len(OPEN) + 10 * n
        return time.perf_counter() - began

    took(1000)
    assert took(200_000) < 4 * took(100_000) + 0.2
