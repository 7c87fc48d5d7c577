"""Arrays that are built step by step in a fold.

Spark copies all that a fold has built at each of its steps, which takes time that grows with the square of an array's length.
Here blocks of BLOCK items are folded, each into a short array, and only the state and the finished short arrays are
carried from block to block, so that the copies are BLOCK times fewer.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 256


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value evaluated once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def blocks(items: Column, size: int = BLOCK) -> Column:
    """An array cut into arrays of ``size``; null of null."""

    def cut(a: Column) -> Column:
        starts = F.when(F.size(a) > 0, F.sequence(F.lit(0), ((F.size(a) - 1) / size).cast("int"))).otherwise(F.array().cast("array<int>"))
        return F.when(a.isNotNull(), F.transform(starts, lambda i: F.slice(a, i * size + 1, F.lit(size))))

    return bound(items, cut)


def folded(items: Column, zero: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str) -> Column:
    """What ``step(state, item)`` gives for each item, but nulls, as an array of a type; it returns the next state too.
    The state should be a few numbers."""
    none = F.array().cast(f"array<{kind}>")

    def one(acc: Column, x: Column) -> Column:
        state, made = step(acc["state"], x)
        return F.struct(state.alias("state"), F.when(made.isNotNull(), F.concat(acc["out"], F.array(made))).otherwise(acc["out"]).alias("out"))

    def block(acc: Column, part: Column) -> Column:
        own = F.aggregate(part, F.struct(acc["state"].alias("state"), none.alias("out")), one)
        return bound(own, lambda r: F.struct(r["state"].alias("state"), F.concat(acc["all"], F.array(r["out"])).alias("all")))

    start = F.struct(zero.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("all"))
    return F.aggregate(blocks(items), start, block, lambda acc: F.flatten(acc["all"]))
