"""Evaluation statistics: means, percentiles, agreement, sampling, injection and load reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_table


def at_ranks(rows: DataFrame, by: list[str], value: str, ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """AGG-15: of each group the values at ranks from 0, each a function of the number of values; null values do not count.

    Equal values are counted first and the counts range-sorted, so that a group lies in many parts. Sums by part tell
    in which part a rank is, and only those parts are counted through. No list of a group's values is made.
    """
    cells = rows.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    placed = shared_table(cells.repartitionByRange(*by, "_v").withColumn("_part", F.spark_partition_id()), "ranked-values")
    parts = placed.groupBy(*by, "_part").agg(F.sum("_c").alias("_c"))
    whole, before = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_n", F.sum("_c").over(whole)).withColumn("_from", F.coalesce(F.sum("_c").over(before), F.lit(0)))
    asked = parts.withColumn("_r", F.explode(F.array(*[F.struct(F.lit(name).alias("name"), rank(F.col("_n")).cast("long").alias("rank")) for name, rank in ranks.items()])))
    asked = asked.filter((F.col("_r.rank") >= F.col("_from")) & (F.col("_r.rank") < F.col("_from") + F.col("_c"))).drop("_c")
    inside = placed.join(F.broadcast(asked), [*by, "_part"])  # a row of each group and rank
    up = Window.partitionBy(*by, "_r").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("_to", F.col("_from") + F.sum("_c").over(up))
    hit = inside.filter((F.col("_r.rank") < F.col("_to")) & (F.col("_r.rank") >= F.col("_to") - F.col("_c")))
    return hit.groupBy(*by).agg(*[F.max(F.when(F.col("_r.name") == name, F.col("_v"))).alias(name) for name in ranks])


def nearest(p: float) -> Callable[[Column], Column]:
    """The rank min(int(n * p), n - 1)."""
    return lambda n: F.least(F.floor(n * F.lit(p)), n - 1)


def median_ranks() -> dict[str, Callable[[Column], Column]]:
    """The ranks between which the median lies."""
    return {"low": lambda n: F.floor((n - 1) / 2), "high": lambda n: F.floor(n / 2)}


def means(scores: DataFrame, metrics: list[str], by: list[str] | None = None) -> DataFrame:
    """AGG-14: of each metric the mean of valid scores and their number; missing scores never count."""
    cols = [x for m in metrics for x in (F.round(F.avg(m), 4).alias(f"{m}_mean"), F.count(m).alias(f"{m}_valid"), F.count_if(F.col(m).isNull()).alias(f"{m}_failed"))]
    return scores.groupBy(*(by or [])).agg(*cols)


def overall(scores: DataFrame, metrics: list[str], by: str) -> DataFrame:
    """AGG-14: the mean over all metrics by stratum."""
    long = scores.select(by, F.explode(F.array(*metrics)).alias("score"))
    return long.groupBy(by).agg(F.round(F.avg("score"), 4).alias("mean"), F.count("score").alias("valid"))


def agreement(ranks: DataFrame) -> DataFrame:
    """AGG-23, JN-19 over (key, item, a, b): of pairs of common items in a key's two rankings the share in the same
    order by both; 1 below two items. A key has the items of one answer; they are compared inside its row."""
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    by = ranks.groupBy("key").agg(F.collect_list(F.when(both, F.struct("a", "b"))).alias("_x"))
    sign = lambda x, y: (x["a"] - y["a"]) * (x["b"] - y["b"])
    count = lambda keep: F.aggregate(F.transform("_x", lambda x: F.size(F.filter("_x", lambda y: keep(sign(x, y))))), F.lit(0), lambda s, n: s + n)
    by = by.withColumn("_same", count(lambda s: s > 0)).withColumn("_other", count(lambda s: s < 0))  # each pair counts twice
    n = F.col("_same") + F.col("_other")
    return by.select("key", F.when(n > 0, F.round(F.col("_same") / n, 6)).otherwise(1.0).alias("agreement"))


def first_of_each(rows: DataFrame, by: str, order: str, n: int) -> DataFrame:
    """AGG-24."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(by).orderBy(order))).filter(F.col("_rn") <= n).drop("_rn")


def hashed_sample(rows: DataFrame, by: str, key: str, n: int) -> DataFrame:
    """AGG-18: n of each group in the order of a digest, the same in every run."""
    w = Window.partitionBy(by).orderBy(F.md5(F.col(key).cast("string")), key)
    return rows.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def load_report(runs: DataFrame) -> DataFrame:
    """MIS-17 over (ok, ms): counts and latency percentiles of the successful ones; one row."""
    ms = F.when(F.col("ok"), F.col("ms"))
    whole = runs.agg(F.count_if("ok").alias("n_ok"), F.count_if(~F.col("ok")).alias("n_err"), F.max(ms).alias("max_ms"), F.round(F.avg(ms), 4).alias("mean_ms"))
    places = at_ranks(runs.filter("ok"), [], "ms", {"p50": nearest(0.5), "p95": nearest(0.95)})
    return whole.crossJoin(F.broadcast(places)).select("n_ok", "n_err", "p50", "p95", "max_ms", "mean_ms")  # a row each


def dataset(built_in: DataFrame, expanded: DataFrame) -> DataFrame:
    """SRC-12 over (ord, question, ...): one evaluation set, each question once; built-in items win, then the first."""
    rows = built_in.withColumn("_part", F.lit(0)).unionByName(expanded.withColumn("_part", F.lit(1)))
    first = Window.partitionBy("question").orderBy("_part", "ord")
    return rows.withColumn("_rn", F.row_number().over(first)).filter("_rn = 1").drop("_rn").withColumn("built_in", F.col("_part") == 0).drop("_part")


def of_character(rows: DataFrame, characters: DataFrame, default: str = "builtin") -> DataFrame:
    """JN-18 over (question, ...) and (question, character): adds character, the default where a question has none."""
    return rows.join(characters.select("question", "character"), "question", "left").withColumn("character", F.coalesce("character", F.lit(default)))


def injection_report(traces: DataFrame) -> DataFrame:
    """AGG-16 over (character, question, injected array<struct<doc, graph>>, cited array<int>): totals and shares."""
    t = traces.select("character", F.size("injected").alias("n"), F.size(F.filter("injected", lambda x: x["graph"])).alias("g"), F.size(F.array_distinct("cited")).alias("c"))
    return t.groupBy("character").agg(F.count("*").alias("questions"), F.sum("n").alias("injected"), F.sum("g").alias("from_graph"), F.sum("c").alias("cited"), F.round(F.sum("c") / F.sum("n"), 4).alias("cited_share"))


def flattened(traces: DataFrame) -> DataFrame:
    """AGG-16, one row a question: traces (character, question, boundary array<struct<kind, chars, ends>>, top_k, overlap,
    graph_on, edges, added, seeds array<string>, answer) with counts of bodies and evidence, of seeds, and of citations;
    [n] counts bodies, [Gn] evidence, and a number beyond the bodies is ``over``."""
    of = lambda kind: F.filter("boundary", lambda x: x["kind"] == kind)
    chars = lambda items: F.aggregate(items, F.lit(0).cast("long"), lambda a, x: a + x["chars"])
    cites = F.transform(F.regexp_extract_all(F.coalesce("answer", F.lit("")), F.lit(r"\[(\d+)\]")), lambda c: c.cast("long"))
    rows = traces.select("character", "question", of("source").alias("_b"), of("infer").alias("_e"), "top_k", "overlap", "graph_on", "edges", "added", "seeds", cites.alias("_c"), F.regexp_count(F.coalesce("answer", F.lit("")), F.lit(r"\[G\d+\]")).alias("gcites"))
    return rows.select(
        "character", "question", F.size("_b").alias("body_n"), F.size("_e").alias("ev_n"), chars("_b").alias("body_chars"), chars("_e").alias("ev_chars"), (chars("_b") + chars("_e")).alias("chars"),
        F.size(F.filter("_b", lambda x: x["ends"])).alias("ends_ok"), "overlap", (F.col("top_k") - F.col("overlap")).alias("swapped"), "graph_on", "edges", "added",
        F.size(F.filter("seeds", lambda s: F.length(s) == 1)).alias("single_seeds"), F.size("seeds").alias("seeds"), F.size("_c").alias("cites"), F.size(F.array_distinct("_c")).alias("distinct_cites"),
        ((F.size("_b") > 0) & (F.size("_c") > 0) & (F.coalesce(F.array_max("_c"), F.lit(0)) > F.size("_b"))).alias("over"), "gcites",
    )


def injection_levels(traces: DataFrame) -> DataFrame:
    """AGG-16 in full: a row for all questions (a null ``character``, ``total`` is true) and one for each character, of one pass with
    grouping sets: sums, medians, shares with four decimals, and how often each overlap occurs, as a map."""
    rows = flattened(traces)
    share = lambda a, b: F.round(F.when(b > 0, a / b), 4)
    s = lambda c: F.sum(F.col(c).cast("long"))
    known = F.count("graph_on")
    mid = lambda c: F.median(c).alias(f"{c}_median")  # noqa: E731  holds a count for each different value
    sets = rows.groupingSets([[F.col("character")], []], F.col("character"))
    out = sets.agg(
        (F.grouping_id() == 1).alias("total"), F.count("*").alias("questions"), *[s(c).alias(c) for c in ("body_n", "ev_n", "body_chars", "ev_chars")],
        *[mid(c) for c in ("body_n", "body_chars", "ev_n", "ev_chars", "chars", "overlap", "swapped")],
        share(s("ev_n"), s("ev_n") + s("body_n")).alias("ev_share"), share(s("ev_chars"), s("chars")).alias("ev_char_share"), share(s("ends_ok"), s("body_n")).alias("ends_share"),
        F.count_if("graph_on").alias("graph_on"), known.alias("graph_known"), share(F.count_if("graph_on"), known).alias("graph_share"), F.median(F.when(F.col("graph_on").isNotNull(), F.col("edges"))).alias("edges_median"), F.median(F.when(F.col("graph_on").isNotNull(), F.col("added"))).alias("added_median"),
        share(F.sum(F.when(F.col("graph_on").isNotNull(), F.col("single_seeds"))), F.sum(F.when(F.col("graph_on").isNotNull(), F.col("seeds")))).alias("single_seed_share"),
        F.count_if(F.col("cites") > 0).alias("cited"), mid("distinct_cites"), F.count_if("over").alias("over"), F.count_if(F.col("gcites") > 0).alias("graph_cited"),
    )
    counted = rows.filter("overlap IS NOT NULL").groupingSets([[F.col("character"), F.col("overlap")], [F.col("overlap")]], F.col("character"), F.col("overlap"))
    counted = counted.agg((F.grouping("character") == 1).alias("_total"), F.count("*").alias("n"))
    maps = counted.groupBy("_total", F.col("character").alias("_character")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("overlap", "n")))).alias("overlap_counts"))
    return out.join(maps, out["total"].eqNullSafe(maps["_total"]) & out["character"].eqNullSafe(maps["_character"]), "left").drop("_total", "_character")


def lengths(chunks: DataFrame, text_col: str = "text") -> DataFrame:
    """AGG-17."""
    n = F.length(text_col)
    whole = chunks.agg(F.min(n).alias("shortest"), F.round(F.avg(n), 4).alias("mean"), F.max(n).alias("longest"), F.round(F.count_if(n < 50) / F.count("*"), 6).alias("share_short"))
    mid = at_ranks(chunks.select(n.alias("_len")), [], "_len", median_ranks())
    return whole.crossJoin(F.broadcast(mid)).select("shortest", ((F.col("low") + F.col("high")) / 2).alias("median"), "mean", "longest", "share_short")
