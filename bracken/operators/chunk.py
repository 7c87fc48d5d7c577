"""Chunking as expressions over the array of a document's elements: no shuffle, no Python.

A section is a heading and what follows it up to the next. Its body is packed greedily: a run of elements is a
chunk as long as their sizes fit; a long element is a run of chunks of its own, packed from its sentences. The
only sequential part is where runs start, a fold over sizes; everything else is slices and joins of those.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays
from ..functions import profiles as P
from ..functions import text as T

_PIECE = "array<struct<text:string,kinds:array<string>>>"


def elements(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Paragraph elements of plain text: (doc_id, source, elements), one line an element."""
    lines = F.filter(F.split(text_col, r"\n+"), lambda x: F.trim(x) != "")
    element = F.transform(lines, lambda x: F.struct(F.lit("paragraph").alias("kind"), F.lit(0).alias("level"), x.alias("content")))
    return docs.select(F.col(id_col).alias("doc_id"), "source", element.alias("elements"))


def starts(sizes: Column, most: int) -> Column:
    """Where runs start in an array of (n, alone): one ends before what would make it exceed ``most``, and before and
    after what stands alone."""
    zero = F.struct(F.lit(0).alias("i"), F.lit(0).alias("held"), F.lit(True).alias("closed"))

    def step(s: Column, x: Column) -> tuple[Column, Column]:
        new = s["closed"] | x["alone"] | (s["held"] + x["n"] > most)
        return F.struct((s["i"] + 1).alias("i"), F.when(new, x["n"]).otherwise(s["held"] + x["n"]).alias("held"), x["alone"].alias("closed")), F.when(new, s["i"])

    return arrays.folded(sizes, zero, step, "int")


def runs(items: Column, at: Column) -> Column:
    """The slices of ``items`` that start at ``at``."""
    return arrays.bound(F.struct(items.alias("items"), at.alias("at")), lambda b: F.transform(b["at"], lambda a, i: F.slice(b["items"], a + 1, F.coalesce(F.get(b["at"], i + 1), F.size(b["items"])) - a)))


def with_tail(pieces: Column, least: int) -> Column:
    """WIN-07 over (text, kinds): as many of the last pieces as it takes to reach ``least``, or all, are one."""
    zero = F.struct(F.lit(0).alias("k"), F.lit(0).alias("n"))

    def last(p: Column) -> Column:
        # the size of the tail with its two line ends between pieces
        back = F.transform(F.reverse(p), lambda x: F.length(x["text"]))
        return F.aggregate(back, zero, lambda s, n: F.when((s["k"] > 0) & (s["n"] >= least), s).otherwise(F.struct((s["k"] + 1).alias("k"), (s["n"] + n + F.when(s["k"] > 0, 2).otherwise(0)).alias("n"))))["k"]

    def cut(b: Column) -> Column:
        head = F.slice(b["p"], F.lit(1), F.size(b["p"]) - b["k"])
        tail = F.slice(b["p"], F.size(b["p"]) - b["k"] + 1, b["k"])
        one = F.struct(F.array_join(F.transform(tail, lambda p: p["text"]), "\n\n").alias("text"), F.array_sort(F.array_distinct(F.flatten(F.transform(tail, lambda p: p["kinds"])))).alias("kinds"))
        return F.when(b["k"] > 1, F.concat(head, F.array(one))).otherwise(b["p"])

    # the pieces are used twice and made once
    return arrays.bound(pieces, lambda p: arrays.bound(F.struct(p.alias("p"), last(p).alias("k")), cut))


def _sentence_pieces(content: Column, kind: Column, most: int, least: int) -> Column:
    """TXT-04: the pieces of a long element, packed from its sentences; a sentence that is too long itself is sliced."""
    sliced = lambda s: F.transform(F.sequence(F.lit(0), F.floor((F.length(s) - 1) / most).cast("int")), lambda i: F.struct(F.substring(s, i * most + 1, F.lit(most)).alias("s"), F.lit(True).alias("alone")))
    units = F.flatten(F.transform(T.sentences(content), lambda s: F.when(F.length(s) > most, sliced(s)).otherwise(F.array(F.struct(s.alias("s"), F.lit(False).alias("alone"))))))

    def packed(u: Column) -> Column:
        at = starts(F.transform(u, lambda x: F.struct(F.length(x["s"]).alias("n"), x["alone"].alias("alone"))), most)
        return F.transform(runs(u, at), lambda r: F.struct(F.array_join(F.transform(r, lambda x: x["s"]), "").alias("text"), F.array(kind).alias("kinds")))

    return with_tail(arrays.bound(units, packed), least)


def body_pieces(body: Column, most: int = P.CHUNK_MAX, least: int = P.CHUNK_MIN) -> Column:
    """WIN-06 over (kind, content): the texts of chunks, each with the kinds in it."""
    none = F.array().cast(_PIECE)
    items = F.transform(body, lambda e: F.struct(e["kind"].alias("kind"), e["content"].alias("content"), F.when(F.length(e["content"]) > most, _sentence_pieces(e["content"], e["kind"], most, least)).otherwise(none).alias("own"), (F.length(e["content"]) > most).alias("long")))

    def packed(u: Column) -> Column:
        at = starts(F.transform(u, lambda x: F.struct(F.length(x["content"]).alias("n"), x["long"].alias("alone"))), most)
        one = lambda r: F.array(F.struct(F.array_join(F.transform(r, lambda x: x["content"]), "\n\n").alias("text"), F.array_distinct(F.transform(r, lambda x: x["kind"])).alias("kinds")))
        return F.flatten(F.transform(runs(u, at), lambda r: F.when(r[0]["long"], r[0]["own"]).otherwise(one(r))))

    return with_tail(arrays.bound(items, packed), least)


def paths(headings: Column) -> Column:
    """WIN-04: of headings (level, content) in order the path of each: it goes back to above its level and appends."""

    def step(so_far: Column, h: Column) -> tuple[Column, Column]:
        level = F.when(F.coalesce(h["level"], F.lit(0)) > 0, h["level"]).otherwise(2)
        path = F.concat(F.slice(so_far, F.lit(1), level - 1), F.array(h["content"]))
        return path, path

    return arrays.folded(headings, F.array().cast("array<string>"), step, "array<string>")


def chunked(docs: DataFrame, most: int = P.CHUNK_MAX, least: int = P.CHUNK_MIN, overlap: int = P.CHUNK_OVERLAP) -> DataFrame:
    """RET-11 over (doc_id, source, elements (kind, level, content)): a row of each chunk, with the end of the chunk
    before it in front (WIN-02) and the number of the document's chunks. A last section without a body is a chunk of its path."""
    e = F.col("elements")
    is_head = lambda x: x["kind"] == "heading"
    at = F.filter(F.transform(e, lambda x, i: F.when(is_head(x) | (i == 0), i)), lambda i: i.isNotNull())  # WIN-05
    d = docs.select("doc_id", "source", runs(e, at).alias("sections"), paths(F.filter(e, is_head)).alias("paths"))
    # a first section without a heading has no path
    first = F.when(is_head(F.get("sections", F.lit(0))[0]), 0).otherwise(1)
    path = lambda i: F.coalesce(F.array_join(F.when(i >= first, F.get("paths", i - first)), " > "), F.lit(""))
    d = d.withColumn("sections", F.transform("sections", lambda s, i: F.struct(F.filter(s, lambda x: ~is_head(x)).alias("body"), path(i).alias("heading"))))
    d = d.withColumn("sections", F.transform("sections", lambda s: F.struct(s["heading"].alias("heading"), body_pieces(s["body"], most, least).alias("pieces"))))
    made = F.flatten(F.transform("sections", lambda s: F.transform(s["pieces"], lambda p: F.struct(p["text"].alias("text"), p["kinds"].alias("kinds"), s["heading"].alias("heading")))))
    d = d.withColumn("made", made).withColumn("_last", F.get("sections", F.size("sections") - 1))
    waiting = (F.size("_last.pieces") == 0) & (F.col("_last.heading") != "")
    alone = F.array(F.struct(F.col("_last.heading").alias("text"), F.array(F.lit("heading")).alias("kinds"), F.col("_last.heading").alias("heading")))
    d = d.withColumn("made", F.when(waiting, F.concat("made", alone)).otherwise(F.col("made")))
    before = lambda i: F.right(F.get("made", i - 1)["text"], F.lit(overlap)) if overlap > 0 else F.lit("")
    linked = F.transform("made", lambda c, i: F.struct(F.size("made").alias("pieces"), c.alias("own"), F.coalesce(before(i), F.lit("")).alias("before"), F.get("made", i - 1)["heading"].alias("source")))
    d = d.select("doc_id", "source", F.posexplode(linked).alias("ordinal", "c"))
    own, has = F.col("c.own.text"), F.col("c.before") != ""
    text = F.when(has, F.concat("c.before", F.lit("\n"), own)).otherwise(own)
    return d.select("doc_id", "source", "ordinal", F.col("c.own.heading").alias("heading"), F.col("c.own.kinds").alias("element_types"), F.length(own).alias("char_length"), F.length(text).alias("total_length"), has.alias("has_overlap"), F.when(has, F.col("c.source")).otherwise("").alias("overlap_source"), text.alias("text"), F.col("c.pieces").alias("pieces"))


def page_chunks(pages: DataFrame, most: int = P.CHUNK_MAX, overlap: int = P.CHUNK_OVERLAP) -> DataFrame:
    """RET-17 over (doc, page_num, text): a page is a chunk; only one that is too long is cut, by itself, and its pieces
    keep its number. Adds piece, char_length and has_overlap."""
    p = pages.select("doc", "page_num", T.strip(F.col("text")).alias("text")).filter("text <> ''")
    one = F.array(F.struct(F.lit("paragraph").alias("kind"), F.lit(0).alias("level"), F.col("text").alias("content")))
    cut = chunked(p.select(F.struct("doc", "page_num").alias("doc_id"), F.lit("").alias("source"), one.alias("elements")), most, most // 2, overlap)
    out = cut.select("doc_id.doc", "doc_id.page_num", F.col("ordinal").alias("piece"), T.strip(F.col("text")).alias("text"), (F.col("pieces") > 1).alias("has_overlap"))
    return out.withColumn("char_length", F.length("text")).filter("text <> ''")
