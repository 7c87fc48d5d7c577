"""Mixing sources to target weights by weighted fair queueing [native].

Every document of a source is put into a keyed shuffled order. A copy of a document gets the virtual
finish time (words of its source up to and with it) / (target of the source), epochs following each
other. All copies are then ordered by finish time over all sources and the order is cut where the
total budget is reached.

Nothing here sees a whole source or the whole order in one task. Documents are range-sorted by source and
key, so that a row's place tells its slice, a run of so many rows whatever their keys; running sums are taken
over (source, slice) with offsets from the slices' sums. The global order is range-partitioned by a histogram
of finish times; only the one range that holds the cut is sorted. Whole rows are written once, and joined with
their places by a number that each row has.

Defined results: a null text has no words; a null source is a source of its own, last in order; rows without
words are never repeated for their own sake but follow their place in the order; sources with a zero target
take nothing; an empty table gives an empty mix; repeated rows are rows like others; rows of equal (or null)
ids are ordered by size and by the hash of their text, so that reruns agree, and lie in many slices if they
are many.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

MAX_EPOCHS = 3
WEIGHTS = (1, 2, 3)
#: Up to so many sources the table of targets is made in one task and broadcast (about 50 bytes each); beyond, it
#: is made by range sorts and joined with salt.
BROADCAST_SOURCES = 100_000
ROWS_A_SLICE = 256
MAX_SLICES = 1 << 20
ROWS_A_RANGE = 4096
MAX_RANGES = 1 << 16
#: Finish times beyond so many units share the last range, which bounds the histogram.
LAST_UNIT = 8
SALTS = 64


def _pow2(x: float, most: int) -> int:
    n = 1
    while n < x and n < most:
        n *= 2
    return n


def _running(df: DataFrame, order: list, values: list[str], rows: int, by: tuple[str, ...] = (), label: str = "order") -> DataFrame:
    """Adds _bk_seq, which grows along ``order``, and of each value its sum up to and with the row (_bk_to_ and its
    name) among the rows that are equal in ``by``, with which the order starts. ``rows``, a power of two, are summed
    by one window."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_bk_seq", F.monotonically_increasing_id())
    placed = common.shared_table(placed, label).withColumn("_bk_slice", F.shiftright("_bk_seq", rows.bit_length() - 1))
    slices = placed.groupBy(*by, "_bk_slice").agg(*[F.sum(v).alias(f"_bk_of_{v}") for v in values])
    w = Window.partitionBy(*by).orderBy("_bk_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select(*[F.col(c).alias(f"_bk_o_{c}") for c in (*by, "_bk_slice")], *[F.coalesce(F.sum(f"_bk_of_{v}").over(w), F.lit(0)).alias(f"_bk_of_{v}") for v in values])
    on = placed["_bk_slice"] == slices["_bk_o__bk_slice"]
    for c in by:
        on &= placed[c] == slices[f"_bk_o_{c}"]
    w = Window.partitionBy(*by, "_bk_slice").orderBy("_bk_seq").rowsBetween(Window.unboundedPreceding, 0)
    out = placed.join(slices, on)
    return out.select(*placed.columns, *[(F.col(f"_bk_of_{v}") + F.sum(v).over(w)).alias(f"_bk_to_{v}") for v in values]).drop("_bk_slice")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = MAX_EPOCHS, one_task: bool = True) -> DataFrame:
    """Water filling over (source, source_size): adds rank, weight, target.

    The total of sizes is shared by weight; a share stops at ``epochs`` times its source's size and the
    excess is shared again by weight. In order of size over weight the stopped sources are a prefix,
    and the level of the rest follows from the sums over that prefix.
    """
    name, cycle = F.col("source").asc_nulls_last(), F.array(*map(F.lit, weights))
    if one_task:
        out = sources.withColumn("rank", F.row_number().over(Window.orderBy(name)))
    else:
        out = _running(sources.withColumn("_one", F.lit(1)), [name], ["_one"], ROWS_A_RANGE, label="mix-ranks").withColumn("rank", F.col("_bk_to__one").cast("int")).drop("_one", "_bk_to__one", "_bk_seq")
    out = out.withColumn("weight", F.element_at(cycle, ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
    out = out.withColumn("_cap", F.col("source_size") * epochs)
    out = out.withColumn("_ratio", F.col("_cap").cast("double") / F.col("weight"))
    if one_task:
        before = Window.orderBy("_ratio", "rank").rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumn("_bk_to__cap", F.sum("_cap").over(before)).withColumn("_bk_to_weight", F.sum("weight").over(before))
    else:
        out = _running(out, ["_ratio", "rank"], ["_cap", "weight"], ROWS_A_RANGE, label="mix-ratios")
    whole = out.agg(F.sum("source_size").alias("_size"), F.sum("weight").alias("_weights"))
    out = out.crossJoin(F.broadcast(whole))  # one row
    rest = F.col("_size") - F.col("_bk_to__cap") + F.col("_cap")
    out = out.withColumn("_level", rest.cast("double") / (F.col("_weights") - F.col("_bk_to_weight") + F.col("weight")))
    reached = F.col("_ratio") >= F.col("_level")
    level = out.agg(F.min_by(F.when(reached, F.col("_level")), F.when(reached, F.struct("_ratio", "rank"))).alias("_share"))
    out = out.crossJoin(F.broadcast(level))
    out = out.withColumn("target", F.least(F.col("_cap").cast("double"), F.coalesce("_share", F.lit(0.0)) * F.col("weight")))
    return out.select("source", "rank", "weight", "source_size", "target")


def _with_targets(df: DataFrame, plan: DataFrame, n_sources: int) -> DataFrame:
    plan = plan.withColumnRenamed("source", "_bk_plan_source")
    if n_sources <= BROADCAST_SOURCES:
        return df.join(F.broadcast(plan), df["_bk_source"].eqNullSafe(plan["_bk_plan_source"])).drop("_bk_plan_source")
    plan = plan.withColumn("_bk_plan_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    df = df.withColumn("_bk_salt", F.pmod(F.xxhash64("_bk_row"), F.lit(SALTS)).cast("int"))
    on = df["_bk_source"].eqNullSafe(plan["_bk_plan_source"]) & (df["_bk_salt"] == plan["_bk_plan_salt"])
    return df.join(plan, on).drop("_bk_plan_source", "_bk_plan_salt", "_bk_salt")


def _finish(epoch: Column | int) -> Column:
    epoch = F.lit(epoch) if isinstance(epoch, int) else epoch
    through = (epoch * F.col("source_size") + F.col("_bk_to__bk_size")).cast("double")
    return F.when(F.col("target") > 0, through / F.col("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, epochs: int = MAX_EPOCHS, seed: str = "mix", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with mix_size, mix_source_size, mix_target, mix_finish (of the first copy) and mix_copies.

    mix_copies says how often the document is in the mix, 0 to ``epochs``. Columns of those names in the
    input are replaced. ``expand`` turns the copies into rows.
    """
    docs = docs.drop("mix_size", "mix_source_size", "mix_target", "mix_finish", "mix_copies")
    names = docs.columns if keep is None else keep
    text = common.column(docs, text_col)
    rows = docs.select(
        F.struct(*[common.column(docs, c).alias(c) for c in names]).alias("_bk_whole"),
        common.column(docs, source_col).cast("string").alias("_bk_source"),
        common.n_words(text).alias("_bk_size"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(common.column(docs, id_col).cast("string"), F.lit("null")))).alias("_bk_key"),
        F.xxhash64(text).alias("_bk_hash"),
        F.monotonically_increasing_id().alias("_bk_row"),
    )
    rows = common.shared_table(rows, "mix-rows")  # from here on a row's number stands
    narrow = rows if set(names) <= {id_col} else rows.drop("_bk_whole")
    sources = common.shared_table(narrow.groupBy(F.col("_bk_source").alias("source")).agg(F.sum("_bk_size").alias("source_size"), F.count("*").alias("_n")), "mix-sources")
    n, n_sources, budget = sources.agg(F.sum("_n"), F.count("*"), F.sum("source_size")).first()
    plan = common.shared_table(targets(sources.drop("_n"), weights, epochs, n_sources <= BROADCAST_SOURCES), "mix-targets")
    order = ["rank", "_bk_key", "_bk_size", "_bk_hash", "_bk_row"]
    places = _running(_with_targets(narrow, plan, n_sources), order, ["_bk_size"], _pow2(max(ROWS_A_SLICE, (n or 0) / MAX_SLICES), 1 << 30), ("rank",), "mix-order")
    places = common.shared_table(places.drop("_bk_source", "_bk_key", "_bk_hash", "weight"), "mix-places")
    cut = _cut(places, budget or 0, _pow2((n or 0) / ROWS_A_RANGE, MAX_RANGES), epochs)
    taken = [F.when(_place(_finish(e), F.col("rank"), F.lit(e), F.col("_bk_seq")) < cut, 1).otherwise(0) if cut is not None else F.lit(1) for e in range(epochs)]
    copies = F.when(F.col("target") > 0, sum(taken[1:], taken[0])).otherwise(0)
    out = places.select(*[c for c in places.columns if c in ("_bk_whole", "_bk_row")], F.col("_bk_size").alias("mix_size"), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"), _finish(0).alias("mix_finish"), copies.cast("int").alias("mix_copies"))
    if narrow is not rows:  # numbers are distinct, so that rows need no sort to meet their places
        out = rows.select("_bk_whole", "_bk_row").join(out.hint("shuffle_hash"), "_bk_row")
    return out.select(*[F.col("_bk_whole")[c].alias(c) for c in names], "mix_size", "mix_source_size", "mix_target", "mix_finish", "mix_copies")


def _cut(places: DataFrame, budget: int, ranges: int, epochs: int) -> Column | None:
    """The first copy in global order with which the words exceed the budget; None if none does. Copies without words
    are never that one."""
    copies = places.filter("target > 0 AND _bk_size > 0").withColumn("_bk_epoch", F.explode(F.array(*map(F.lit, range(epochs))))).withColumn("_bk_finish", _finish(F.col("_bk_epoch")))
    copies = copies.withColumn("_bk_range", F.least(F.floor(F.col("_bk_finish") * ranges), F.lit(ranges * LAST_UNIT)))
    sums = copies.groupBy("_bk_range").agg(F.sum("_bk_size").alias("_bk_words"))
    sums = sums.withColumn("_bk_to", F.sum("_bk_words").over(Window.orderBy("_bk_range").rowsBetween(Window.unboundedPreceding, 0)))
    at = sums.filter(F.col("_bk_to") > budget).orderBy("_bk_range").select("_bk_range", F.col("_bk_to") - F.col("_bk_words")).first()
    if at is None:
        return None
    order = ["_bk_finish", "rank", "_bk_epoch", "_bk_seq"]
    near = copies.filter(F.col("_bk_range") == at[0]).select(*order, "_bk_size")
    near = near.withColumn("_bk_to", F.lit(at[1]) + F.sum("_bk_size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    x = near.filter(F.col("_bk_to") > budget).orderBy(*order).select(*order).first()
    return _place(*map(F.lit, x))


def _place(*parts: Column) -> Column:
    """A copy's place in the global order."""
    return F.struct(*[p.cast(kind).alias(f"p{i}") for i, (p, kind) in enumerate(zip(parts, ("double", "int", "int", "long")))])


def expand(mixed: DataFrame, ordered: bool = False) -> DataFrame:
    """One row per copy, with mix_epoch; in the order of virtual finish times if ``ordered`` (a range sort)."""
    out = mixed.filter("mix_copies > 0").withColumn("mix_epoch", F.explode(F.sequence(F.lit(0), F.col("mix_copies") - 1)))
    out = out.withColumn("mix_finish", F.col("mix_finish") + F.col("mix_epoch") * F.col("mix_source_size") / F.col("mix_target"))
    return out.orderBy("mix_finish", "mix_epoch") if ordered else out
