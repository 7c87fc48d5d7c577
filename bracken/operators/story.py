"""Interactive stories: typed state patches, marker filtering, lorebooks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import small
from . import patterns

OPEN, CLOSE = "<state>", "</state>"


def patched(events: DataFrame, definitions: DataFrame) -> DataFrame:
    """STR-09 over events (save_id, ord, who, field, raw) and definitions (save_id, field, kind): the last value of
    each defined field, numbers and tags coerced; values that cannot be are passed over."""
    d = small(definitions)
    e = events.join(d, ["save_id", "field"])
    e = e.withColumn("num", F.when(F.col("kind") == "number", T.coerced_number(F.col("raw")))).withColumn("tag", F.when((F.col("kind") == "tag") & (T.strip(F.col("raw")) != ""), F.left(T.strip(F.col("raw")), F.lit(24))))
    e = e.filter("num IS NOT NULL OR tag IS NOT NULL")
    last = F.max_by(F.struct("num", "tag"), "ord")
    first = F.min_by(F.struct("num", "tag"), "ord")
    changes = F.count("*")
    return e.groupBy("save_id", "who", "field", "kind").agg(last.alias("v"), first.alias("f"), changes.alias("patches")).select("save_id", "who", "field", "kind", F.col("v.num").alias("num"), F.col("v.tag").alias("tag"), "patches")


def changes(events: DataFrame, definitions: DataFrame, protagonists: DataFrame) -> DataFrame:
    """STR-09 over events as of ``patched``, where a null who is a flat patch and means the protagonist, and protagonists
    (save_id, protagonist): (save_id, ord, who, field, num, tag) of what really changed a value."""
    e = events.join(protagonists.select("save_id", "protagonist"), "save_id", "left").withColumn("who", F.coalesce("who", "protagonist")).filter("who IS NOT NULL")
    e = e.join(small(definitions), ["save_id", "field"])
    e = e.withColumn("num", F.when(F.col("kind") == "number", T.coerced_number(F.col("raw")))).withColumn("tag", F.when((F.col("kind") == "tag") & (T.strip(F.col("raw")) != ""), F.left(T.strip(F.col("raw")), F.lit(24))))
    e = e.filter("num IS NOT NULL OR tag IS NOT NULL")
    w = Window.partitionBy("save_id", "who", "field").orderBy("ord")
    before = F.lag(F.struct("num", "tag")).over(w)
    return e.withColumn("_b", before).filter(F.col("_b").isNull() | ~F.col("_b").eqNullSafe(F.struct("num", "tag"))).select("save_id", "ord", "who", "field", "num", "tag")


def synced(state: DataFrame, definitions: DataFrame) -> DataFrame:
    """STR-10 over state (save_id, who, field, num, tag): defined fields with a value or the default; others go."""
    people = state.select("save_id", "who").distinct()
    every = people.join(definitions, "save_id")
    out = every.join(state.select("save_id", "who", "field", "num", "tag"), ["save_id", "who", "field"], "left")
    return out.select("save_id", "who", "field", "kind", F.when(F.col("kind") == "number", F.coalesce("num", F.lit(0.0))).alias("num"), F.when(F.col("kind") == "tag", F.coalesce("tag", F.lit(""))).alias("tag"))


class MarkerFilter:
    """STR-08 on a stream: text between the markers is held back; a block that never closes is given back.

    Of what is held only as many last characters as a marker may have begun with are looked at again, so that time is in
    proportion to the tokens.
    """

    def __init__(self, state: tuple[str, bool] = ("", False)):
        held, self.inside = state
        self.block = [held] if self.inside else []
        self.tail = held[len(OPEN) :][-(len(CLOSE) - 1) :] if self.inside else held

    @property
    def held(self) -> str:
        return "".join(self.block) if self.inside else self.tail

    def feed(self, token: str) -> str:
        out, rest = [], token
        while True:
            window = self.tail + rest
            at = window.find(CLOSE if self.inside else OPEN)
            if at >= 0 and self.inside:
                rest = window[at + len(CLOSE) :]
                self.block, self.tail, self.inside = [], "", False
            elif at >= 0:
                out.append(window[:at])
                rest = window[at + len(OPEN) :]
                self.block, self.tail, self.inside = [OPEN], "", True
            elif self.inside:
                self.block.append(rest)
                self.tail = window[-(len(CLOSE) - 1) :]
                return "".join(out)
            else:
                keep = next((n for n in range(min(len(OPEN) - 1, len(window)), 0, -1) if OPEN.startswith(window[-n:])), 0)
                out.append(window[: len(window) - keep])
                self.tail = window[len(window) - keep :]
                return "".join(out)

    def end(self) -> str:
        out = self.held
        self.block, self.tail, self.inside = [], "", False
        return out


def without_blocks(tokens: DataFrame) -> DataFrame:
    """STR-08 as a batch over (msg, ord, token): the text of each message without closed blocks."""
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "token"))), lambda x: x["token"]), "")
    return tokens.groupBy("msg").agg(F.regexp_replace(whole, f"(?s){OPEN}.*?{CLOSE}", "").alias("text"))


def lorebook(queries: DataFrame, entries: DataFrame, most: int = 4) -> DataFrame:
    """JN-17, MIS-01 over (query_id, scan) and (ord, keyword, content): entries whose keyword the scan has, in the
    order of the book, each keyword once."""
    e = entries.filter(F.trim(F.coalesce("keyword", F.lit(""))) != "").groupBy("keyword").agg(F.min("ord").alias("ord"), F.min_by("content", "ord").alias("content"))
    found = patterns.hits(queries, e, "query_id", "scan", "keyword").select(F.col("id").alias("query_id"), F.col("pattern").alias("keyword")).distinct()
    hits = found.join(e, "keyword")
    w = Window.partitionBy("query_id").orderBy("ord")
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most).select("query_id", "rank", "keyword", "content")
