"""Benchmark decontamination by bottom-k MinHash containment search [native].

A test item is contained in a document if at least ``threshold`` of the item's distinct five-word
shingles occur in the document, however long that is. The similarity of a short item and a long
document is near zero, so signatures of whole documents cannot find it; containment needs sketches
whose size follows the item's. An item's sketch, n its number of shingles, is its
n - ceil(threshold * n) + 1 smallest shingle hashes, one MinHash
permutation's bottom values. A document that lacks all of them lacks too many shingles, so every
contained item has a sketch value among the document's hashes: the search loses nothing. Of a
document only hashes up to the largest sketch value of any item are looked up. This one lookup of all
items stands in for a partitioning by size: results are the same, and nothing is partitioned.

Candidates are verified by exact containment. A candidate document's distinct shingles, of which only those
whose hash some item has go on, are joined with the shingles of its own candidate items and counted. No text
or list of shingles is copied for each candidate, and each join is broadcast up to a counted bound and dealt
with salt beyond it, so that a passage of a third of all documents is no task's own.

Words are maximal runs of letters and digits of the lower-cased text. Defined results: null or short
texts have no shingles and neither contain nor are contained; items of fewer than five words are listed by
``unsearchable`` and searched by ``contained_short``, which ``decontaminated`` does as well: unspaced scripts
are cut into characters there, and an item that is still short is contained where its whole sequence
occurs, so that a single word is found in every document that has it; repeated rows give their pair once; empty tables give no pairs; ids may be
null or repeated, rows are told apart by id and text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .common import met, small

WORDS = 5
THRESHOLD = 0.8
TOKEN = r"[\p{L}\p{N}]+"
#: Scripts without spaces between words.
_UNSPACED = "".join(rf"\p{{Is{s}}}" for s in ("Han", "Hiragana", "Katakana", "Thai", "Lao", "Khmer", "Myanmar"))
CHARACTERS = rf"[\p{{L}}\p{{N}}&&[{_UNSPACED}]]|[\p{{L}}\p{{N}}&&[^{_UNSPACED}]]+"
#: Sketch rows (a hash and an item key, 16 bytes) up to which the sketches are broadcast; they are counted.
BROADCAST_SKETCH = 1_000_000
#: Shingle hashes of all items (8 bytes) up to which they are broadcast; they are counted.
BROADCAST_SHINGLES = 1_000_000
#: Shingles of items (their text, some 40 bytes) up to which they are broadcast; they are counted.
BROADCAST_PARTS = 200_000
#: Items (an id and a number) up to which they are broadcast; they are counted.
BROADCAST_ITEMS = 500_000


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def characters(text: Column) -> Column:
    """As ``tokens``, but each character of an unspaced script is a word."""
    return F.regexp_extract_all(F.lower(text), F.lit(CHARACTERS), F.lit(0))


def _each_shingle(words: str, make, n: int = WORDS) -> Column:
    """``make(position)`` for each shingle of the array column ``words``; null where there is none."""
    count = F.size(words) - (n - 1)
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), make))


def hashes(words: str, n: int = WORDS) -> Column:
    col = F.col(words)
    return _each_shingle(words, lambda i: F.xxhash64(*[F.get(col, i + j) for j in range(n)]), n)


def shingles(words: str, n: int = WORDS) -> Column:
    col = F.col(words)
    return F.array_distinct(_each_shingle(words, lambda i: F.concat_ws(" ", *[F.get(col, i + j) for j in range(n)]), n))


def item_table(items: DataFrame, id_col: str = "item_id", text_col: str = "text", n: int = WORDS, cut=tokens) -> DataFrame:
    """(item, item_id, words, shingles, n) of each distinct item with a shingle; ``item`` tells rows apart."""
    rows = items.select(common.column(items, id_col).alias("item_id"), common.column(items, text_col).alias("text")).distinct()
    rows = rows.select(F.xxhash64("item_id", "text").alias("item"), "item_id", cut(F.col("text")).alias("words")).filter(F.size("words") >= n)
    return rows.withColumn("shingles", shingles("words", n)).withColumn("n", F.size("shingles"))


def unsearchable(items: DataFrame, text_col: str = "text", n: int = WORDS) -> DataFrame:
    """The items of too few words for a shingle."""
    return items.filter(F.coalesce(F.size(tokens(common.column(items, text_col))), F.lit(0)) < n)


def sketches(items: DataFrame, threshold: float = THRESHOLD, n: int = WORDS) -> DataFrame:
    """(item, hash): the bottom values of each item of ``item_table``."""
    keep = F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9) + 1
    bottom = F.slice(F.array_sort(F.array_distinct(hashes("words", n))), F.lit(1), keep.cast("int"))
    return items.select("item", F.explode(bottom).alias("hash"))


def contained(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, n: int = WORDS, id_col: str = "doc_id", text_col: str = "text", cut=tokens) -> DataFrame:
    """(doc_id, text_hash, item_id, n_shingles, n_shared, containment) of all pairs at the threshold."""
    table = common.shared_table(item_table(items, n=n, cut=cut), "items")
    sketch = common.shared_table(sketches(table, threshold, n), "sketches")
    top = sketch.agg(F.max("hash")).first()[0]
    keyed = docs.select(common.column(docs, id_col).alias("doc_id"), F.xxhash64(common.column(docs, text_col)).alias("text_hash"), cut(common.column(docs, text_col)).alias("words"))
    low = F.filter(hashes("words", n), lambda h: h <= F.lit(top if top is not None else -(1 << 63)))
    hits = met(keyed.select("doc_id", "text_hash", F.explode(low).alias("hash")), sketch, "hash", ["doc_id", "text_hash"], BROADCAST_SKETCH)
    pairs = common.shared_table(hits.select("doc_id", "text_hash", "item").distinct(), "candidates")
    by_doc = pairs.select(F.col("doc_id").alias("c_id"), F.col("text_hash").alias("c_hash")).distinct()
    texts = keyed.join(small(by_doc), keyed["doc_id"].eqNullSafe(by_doc["c_id"]) & (keyed["text_hash"] == by_doc["c_hash"]), "left_semi")
    parts = common.shared_table(table.select("item", F.explode("shingles").alias("shingle")), "item-shingles")
    own = texts.select("doc_id", "text_hash", F.explode(shingles("words", n)).alias("shingle")).withColumn("part", F.xxhash64("shingle"))
    own = met(own, parts.select(F.xxhash64("shingle").alias("part")).distinct(), "part", ["doc_id", "text_hash"], BROADCAST_SHINGLES)
    own = own.select(F.col("doc_id").alias("o_id"), F.col("text_hash").alias("o_hash"), F.col("shingle").alias("o_shingle")).distinct()
    asked = met(pairs, parts, "item", ["doc_id", "text_hash"], BROADCAST_PARTS)
    both = asked.join(own, asked["doc_id"].eqNullSafe(own["o_id"]) & (asked["text_hash"] == own["o_hash"]) & (asked["shingle"] == own["o_shingle"]))
    both = both.groupBy("doc_id", "text_hash", "item").agg(F.count("*").alias("n_shared"))
    both = met(both, table.select("item", "item_id", F.col("n").cast("long").alias("n_shingles")), "item", ["doc_id", "text_hash"], BROADCAST_ITEMS)
    both = both.select("doc_id", "text_hash", "item_id", "n_shingles", "n_shared", (F.col("n_shared") / F.col("n_shingles")).alias("containment"))
    return both.filter(F.col("n_shared") >= F.lit(threshold) * F.col("n_shingles") - 1e-9).distinct()


def contained_short(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, n: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> list[DataFrame]:
    """As ``contained``, of the items of too few words for it, by their number of words; none if there are no such items."""
    rest = unsearchable(items, n=n).select("item_id", "text").withColumn("size", F.least(F.size(characters(F.col("text"))), F.lit(n))).filter("size > 0")
    sizes = sorted(r[0] for r in rest.select("size").distinct().collect())
    return [contained(docs, rest.filter(F.col("size") == k), threshold, k, id_col, text_col, characters) for k in sizes]


def decontaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, n: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that contain no item; columns as in the input."""
    pairs = contained(docs, items, threshold, n, id_col, text_col)
    for more in contained_short(docs, items, threshold, n, id_col, text_col):
        pairs = pairs.union(more)
    found = common.shared_table(pairs.select("doc_id", "text_hash").distinct(), "leaks")
    return common.without(docs, found, id_col, text_col)
