"""Peak concurrency by a distributed Fenwick tree: how many intervals are open at each moment of change, and the highs.

Starts and ends become changes per group and moment. Time is cut into blocks of BLOCK units, the leaves of the
tree. A block's changes update the cells above it, one for each level whose bit of its number is clear; a
block that has moments of change reads the cells before it, one for each level whose bit is set. Cells and readers
meet in an equi-join on (group, level, cell), and what a block reads is summed. Within a block, which has BLOCK moments
at most, sums run by a window. Running highs come the same way from a tree whose cells hold the largest value,
and the next moment of change from one over reversed blocks whose cells hold the smallest. ``block=1`` is the
tree down to single moments; results are equal, tests hold both against brute force.

Nothing passes through one task: a cell of level k has at most 2**k readers, and copies of it are made so that each
copy serves READERS of them. The bounds of the blocks' numbers are the only values that the driver gets.

Defined results: an interval with a null start, or whose end is not after its start, takes no part; a null end
is never; a null weight, or one that is no number below 9e13, weighs nothing; a null key finds no group and no
end; moments whose starts and ends cancel out give no row; rows that are repeated count each; empty tables give
an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from . import common

BLOCK = 64
READERS = 4096
SALTS = 16
#: The group of what belongs to no group, and that of all.
NONE, ALL = -1, -2
_FOLDS = {"sum": F.sum, "max": F.max, "min": F.min}


def minutes(at: Column, kind: str) -> Column:
    """Whole minutes since 1970, rounded down, of a timestamp (UTC) or of one without a zone."""
    if kind == "timestamp_ntz":  # its fields are those of UTC, whatever the session's zone
        return F.unix_date(at.cast("date")).cast("long") * 1440 + F.hour(at) * 60 + F.minute(at)
    return F.floor(F.unix_micros(at) / 60_000_000).cast("long")


def before(values: DataFrame, by: str, at: str, folds: dict[str, str], first: int, last: int, backwards: bool = False) -> DataFrame:
    """(by, at, the folds) of each row of ``values``: what the columns of ``folds`` give over the rows of its group whose
    ``at`` is smaller (larger if ``backwards``). ``at`` is a whole number from ``first`` to ``last``, one row each in a
    group; rows that have none before them are left out."""
    k = (F.lit(last) - F.col(at)) if backwards else (F.col(at) - F.lit(first))
    levels = F.sequence(F.lit(0), F.lit((last - first).bit_length()))
    at_level = F.explode(levels).alias("_bk_level")

    def over(level: str) -> Column:
        return F.call_function("shiftright", F.col("_bk_k"), F.col(level))

    bit = F.pmod(over("_bk_level"), F.lit(2)) == 1
    beyond = F.greatest(F.col("_bk_level") - (READERS.bit_length() - 1), F.lit(0))
    rows = values.withColumn("_bk_k", k.cast("long"))
    cells = rows.select(F.col(by), "_bk_k", *folds, at_level).filter(~bit).withColumn("_bk_cell", over("_bk_level"))
    cells = cells.groupBy(by, "_bk_level", "_bk_cell").agg(*[_FOLDS[f](c).alias(f"_bk_of_{c}") for c, f in folds.items()])
    cells = cells.withColumn("_bk_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.call_function("shiftleft", F.lit(1).cast("long"), beyond) - 1)))
    readers = rows.select(F.col(by), F.col(at), "_bk_k", at_level).filter(bit).withColumn("_bk_cell", over("_bk_level") - 1)
    place = F.col("_bk_k") - F.call_function("shiftleft", over("_bk_level"), F.col("_bk_level"))
    readers = readers.withColumn("_bk_copy", F.call_function("shiftright", place, F.lit(READERS.bit_length() - 1))).drop("_bk_k")
    met = readers.join(cells, [by, "_bk_level", "_bk_cell", "_bk_copy"])
    return met.groupBy(by, at).agg(*[_FOLDS[f](f"_bk_of_{c}").alias(c) for c, f in folds.items()])


def concurrency(changes: DataFrame, block: int = BLOCK) -> DataFrame:
    """(grp, moment, until, n_open, weight_open, high_open, is_peak) from ``changes`` (grp, moment, d_open, d_weight): a
    row for each moment of a group at which its changes do not cancel out; ``until`` is the group's next such moment."""
    moments = changes.groupBy("grp", "moment").agg(F.sum("d_open").alias("d_open"), F.sum("d_weight").alias("d_weight")).filter("d_open <> 0 OR d_weight <> 0")
    moments = moments.withColumn("block", F.floor(F.col("moment") / block))
    inside = Window.partitionBy("grp", "block").orderBy("moment")
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    leaves = moments.select("grp", "block", "moment", F.sum("d_open").over(so_far).alias("run"), F.sum("d_weight").over(so_far).alias("run_weight"), F.lead("moment").over(inside).alias("next"))
    leaves = common.shared_table(leaves.withColumn("run_high", F.max("run").over(so_far)), "peak-leaves")
    blocks = leaves.groupBy("grp", "block").agg(F.max_by("run", "moment").alias("sum_open"), F.max_by("run_weight", "moment").alias("sum_weight"), F.max("run").alias("top"), F.min("moment").alias("begins"))
    blocks = common.shared_table(blocks, "peak-blocks")
    first, last = blocks.agg(F.min("block"), F.max("block")).first()
    if first is None:
        first = last = 0
    base = before(blocks, "grp", "block", {"sum_open": "sum", "sum_weight": "sum"}, first, last)
    after = before(blocks, "grp", "block", {"begins": "min"}, first, last, backwards=True)
    held = blocks.select("grp", "block", "top").join(base, ["grp", "block"], "left").join(after, ["grp", "block"], "left")
    base_open = F.coalesce("sum_open", F.lit(0))
    held = common.shared_table(held.select("grp", "block", base_open.alias("base"), F.coalesce("sum_weight", F.lit(0)).alias("base_weight"), F.col("begins").alias("next_block"), (F.col("top") + base_open).alias("top")), "peak-held")
    high = before(held, "grp", "block", {"top": "max"}, first, last).withColumnRenamed("top", "high")
    peak = held.groupBy("grp").agg(F.max("top").alias("peak"))
    held = common.met(held.drop("top").join(high, ["grp", "block"], "left"), peak, "grp", ["block"], common.BROADCAST_ROWS)
    out = leaves.join(held, ["grp", "block"])
    n_open = F.col("base") + F.col("run")
    return out.select(
        "grp", "moment", F.coalesce("next", "next_block").alias("until"), n_open.alias("n_open"), (F.col("base_weight") + F.col("run_weight")).alias("weight_open"),
        F.greatest(F.col("high"), F.col("base") + F.col("run_high")).alias("high_open"), (n_open == F.col("peak")).alias("is_peak"),
    )


def _dealt(key: str, salted: Column) -> Column:
    """A salt that deals rows over tasks where ``salted`` holds, and is zero elsewhere."""
    return F.when(salted, F.pmod(F.xxhash64(*[F.col(c) for c in key.split()]), F.lit(SALTS))).otherwise(0).cast("int")


def changes(intervals: DataFrame, groups: DataFrame) -> DataFrame:
    """(grp, moment, d_open, d_weight) of ``intervals`` (key, start, end, weight; whole numbers): each counts for the group of
    its key in ``groups`` (key, grp), NONE if it has none, and for ALL. The rows of a key, of which there may be many, are dealt
    over SALTS tasks."""
    rows = intervals.filter("start IS NOT NULL AND (end IS NULL OR end > start)").withColumn("salt", _dealt("start end weight", F.lit(True)))
    groups = groups.filter("key IS NOT NULL").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("_key", F.coalesce("key", F.lit(0))).withColumn("_known", F.col("key").isNotNull())
    found = rows.join(groups.select(F.col("key").alias("_key"), F.lit(True).alias("_known"), "salt", "grp"), ["_key", "_known", "salt"], "left")
    ends = F.array(F.struct(F.col("start").alias("moment"), F.lit(1).cast("long").alias("d")), F.struct(F.col("end").alias("moment"), F.lit(-1).cast("long").alias("d")))
    found = found.select(F.coalesce("grp", F.lit(NONE)).alias("grp"), "weight", F.explode(ends).alias("e")).filter("e.moment IS NOT NULL")
    found = found.select(F.explode(F.array(F.col("grp"), F.lit(ALL))).alias("grp"), F.col("e.moment").alias("moment"), F.col("e.d").alias("d_open"), (F.col("e.d") * F.col("weight")).alias("d_weight"))
    return found


def open_sales(sales: DataFrame, lines: DataFrame, days: int = 7) -> DataFrame:
    """(key, start, end, weight) of every sale in minutes: from its time to ``days`` after the last shipping of its lines; the
    weight is its total in cents. Lines are folded by sale before they meet it."""
    kind = dict(lines.dtypes)["shipped_at"]
    ends = lines.filter("shipped_at IS NOT NULL AND sale_id IS NOT NULL").groupBy("sale_id").agg(F.max("shipped_at").alias("at"))
    ends = ends.select("sale_id", (minutes(F.col("at"), kind) + days * 1440).alias("end"), F.lit(0).alias("salt"))
    cents = F.when(F.abs("total") < 9e13, F.floor(F.col("total") * 100 + 0.5)).otherwise(0).cast("long")
    rows = sales.select("sale_id", F.col("client_id").alias("key"), minutes(F.col("sold_at"), dict(sales.dtypes)["sold_at"]).alias("start"), F.coalesce(cents, F.lit(0)).cast("long").alias("weight")).filter("start IS NOT NULL")
    rows = rows.withColumn("salt", _dealt("start key weight", F.col("sale_id").isNull()))  # null ids find no lines, so that they may lie anywhere
    return rows.join(ends, ["sale_id", "salt"], "left").select("key", "start", "end", "weight")
