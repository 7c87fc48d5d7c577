"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint has 64 bits, one per bit position of the XXH64 hashes (seed 42) of the text's word
shingles: set where more than half of the hashes have it set. Two fingerprints link where at most
``radius`` bits differ; the components of those links are the groups.

Candidates come from ball hashing. Every distinct fingerprint emits all variants within half the radius
and variants are shuffled; two fingerprints within the radius share a variant in the middle between
them. Over the whole 64 bits a radius of 4 takes 1 + 64 + 2016 = 2081 variants of each fingerprint,
about 33 KB of shuffle against a document of 2 KB. ``blocks`` therefore first splits the bits: of two
halves of fingerprints within 4 bits, one half differs in 2 bits at most, so that balls of radius 1 in
both halves (66 variants) meet as surely. ``blocks=1`` is the undivided form; both are exact, and the default is the same at
every size.

Fingerprints that share a variant are verified inside their group with a frontier that links what it
reaches, so a group of g members gives at most g - 1 links, not all pairs. Groups over ``HOT_GROUP``
are cut into blocks whose pairs become groups of their own. Components are found by alternating
large-star and small-star steps over written tables; nothing is collected on the driver.

Defined results: a null or word-less text has fingerprint zero and links like any other; a text of
fewer words than a shingle is one shingle; rows with equal ids are separate documents; a null id never
names a component unless the component has no other id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .common import small

SHINGLE = 4
RADIUS = 4
SEED = 42
HOT_GROUP = 32_768
#: Parts of the bits whose balls are shuffled.
BLOCKS = 2
#: Hashes that are counted at once; longer texts are counted in pieces.
AT_ONCE = 1 << 16


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The fingerprint as a signed 64-bit number. ``text`` is UTF-8; only A-Z are lower-cased."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    whole = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    if len(words) <= shingle:
        spans = [(0, len(whole))]
    else:
        spans = list(zip([0, *ends[: len(words) - shingle]], (e - 1 for e in ends[shingle - 1 :])))
    digest, counts = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for at in range(0, len(spans), AT_ONCE):
        found = b"".join([digest(whole[a:b], SEED) for a, b in spans[at : at + AT_ONCE]])
        counts += np.unpackbits(np.frombuffer(found, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(spans)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_hash, fp) of every row, written to the shared folder."""
    rows = docs.select(common.column(docs, id_col).alias("doc_id"), F.xxhash64(common.column(docs, text_col)).alias("text_hash"), common.column(docs, text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").cast(pa.large_binary())
            fps = pa.array([fingerprint(t.as_py(), shingle) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), fps], ["doc_id", "text_hash", "fp"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return common.shared_table(rows.mapInArrow(run, f"doc_id {kind}, text_hash long, fp long"), "simhash")


def masks(width: int, radius: int) -> list[int]:
    """All bit masks of ``width`` bits with at most ``radius`` set."""
    return [sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(width), r)]


def variants(fps: DataFrame, radius: int = RADIUS, blocks: int = 2) -> DataFrame:
    """(key, fp): of each block of each distinct fingerprint all variants within half the block's radius."""
    width = 64 // blocks
    ball = masks(width, (radius // blocks + 1) // 2)
    emitted = [F.struct(F.lit(b).alias("block"), F.lit(m - (1 << 64) if m >> 63 else m).cast("long").alias("mask")) for b in range(blocks) for m in ball]
    low = F.lit((1 << width) - 1 if blocks > 1 else -1).cast("long")
    out = fps.select("fp", F.explode(F.array(*emitted)).alias("v"))
    part = F.lit(0).cast("long")
    for b in range(blocks):
        part = F.when(F.col("v.block") == b, F.shiftrightunsigned(F.col("fp"), width * b).bitwiseAND(low)).otherwise(part)
    key = part.bitwiseXOR(F.col("v.mask"))
    return out.select((key if blocks == 1 else key + F.col("v.block") * F.lit(1 << width).cast("long")).alias("key"), "fp")


def _differing(a: np.ndarray, b) -> np.ndarray:
    """Differing bits; unsigned, as numpy counts the bits of a signed number's absolute value."""
    return np.bitwise_count((a ^ b).view(np.uint64))


def spanning(members: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join all members within the radius of each other, directly or by others."""
    rest, a, b = members, [], []
    while len(rest) > 1:
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            x = frontier.pop()
            near = _differing(rest, x) <= radius
            if near.any():
                got = rest[near]
                a.append(np.full(len(got), x, np.int64))
                b.append(got)
                frontier.extend(got)
                rest = rest[~near]
    return (np.concatenate(a), np.concatenate(b)) if a else (np.empty(0, np.int64), np.empty(0, np.int64))


def _verify(radius: int, hot: int):
    """Over rows (key, fp) sorted by key: verified links (a, b, false), or (key, fp, true) of groups over ``hot``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(a, b, flag: bool) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(np.full(len(a), flag))], ["a", "b", "hot"])

        keys, fps, over = np.empty(0, np.int64), np.empty(0, np.int64), None

        def groups(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
            same = keys[1:] == keys[:-1]
            starts = np.flatnonzero(np.concatenate(([True], ~same))) if len(keys) else np.empty(0, np.int64)
            sizes = np.diff(np.append(starts, len(keys)))
            pairs = starts[sizes == 2]
            near = _differing(fps[pairs], fps[pairs + 1]) <= radius
            links = [(fps[pairs][near], fps[pairs + 1][near])]
            for s, n in zip(starts[sizes > 2], sizes[sizes > 2]):
                if n > hot:
                    yield made(keys[s : s + n], fps[s : s + n], True)
                else:
                    links.append(spanning(fps[s : s + n], radius))
            a, b = np.concatenate([x for x, _ in links]), np.concatenate([x for _, x in links])
            both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
            yield made(both[:, 0], both[:, 1], False)

        for batch in batches:
            k, f = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            if over is not None:  # goes on with a group that is known to be hot
                n = int(np.searchsorted(k, over, side="right"))
                yield made(k[:n], f[:n], True)
                k, f = k[n:], f[n:]
                over = over if not len(k) else None
            keys, fps = np.concatenate([keys, k]), np.concatenate([fps, f])
            if not len(keys):
                continue
            last = int(np.searchsorted(keys, keys[-1], side="left"))  # the last group may go on in the next batch
            yield from groups(keys[:last], fps[:last])
            keys, fps = keys[last:], fps[last:]
            if len(keys) > hot:
                yield made(keys, fps, True)
                over, keys, fps = keys[0], keys[:0], fps[:0]
        yield from groups(keys, fps)

    return run


def links(fps: DataFrame, radius: int = RADIUS, blocks: int = 2, hot: int = HOT_GROUP) -> DataFrame:
    """(a, b) with a < b: verified links whose components are those of all links within the radius."""
    schema = "a long, b long, hot boolean"
    distinct = fps.select("fp").distinct()
    dealt = variants(distinct, radius, blocks).repartition("key").sortWithinPartitions("key", "fp")
    found = common.shared_table(dealt.mapInArrow(_verify(radius, hot), schema), "links")
    direct, large = found.filter("NOT hot").select("a", "b"), found.filter("hot")
    if large.isEmpty():
        return direct.distinct()
    large = large.select(F.col("a").alias("key"), F.col("b").alias("fp"))
    sizes = large.groupBy("key").agg(F.ceil(F.count("*") / hot).cast("int").alias("n"))
    cut = large.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    cut = cut.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "fp")
    dealt = cut.distinct().repartition("key").sortWithinPartitions("key", "fp")
    more = dealt.mapInArrow(_verify(radius, 1 << 40), schema).select("a", "b")
    return direct.union(more).distinct()


def stars(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b); the root is the smallest node of its component.

    Large-star links every larger neighbour of a node to the smallest of its neighbourhood, small-star
    every smaller one; both keep components, and after a number of rounds in the order of the logarithm
    of the component's size each node is linked to its root alone. Each round is a written table.
    """
    edges = common.shared_table(edges.filter("a <> b").select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).distinct(), "edges")
    state = None
    while True:
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())
        state = now
        both = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = common.shared_table(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), "m")
        joined = large.join(least, F.col("u") == F.col("c"))
        small = joined.select("u", F.col("m").alias("v")).union(joined.select(F.col("v").alias("u"), F.col("m").alias("v"))).filter("u <> v").distinct()
        old, edges = edges, common.shared_table(small, "small-star")
        common.release(old, large)


def components(fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(fp, component_id, best) of every fingerprint with more than one row or with a link.

    component_id is the smallest id of the component; best names one row of it by (doc_id, text_hash).
    """
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"))
    own = common.shared_table(fps.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("id"), best.alias("best")), "fingerprints")
    roots = common.shared_table(stars(links(own, radius, blocks)), "roots")
    linked = own.join(roots, own["fp"] == roots["node"]).select("fp", "id", "best", "root")
    of = linked.groupBy("root").agg(F.min("id").alias("component_id"), F.min("best").alias("best"))
    grouped = roots.join(of, "root").select(F.col("node").alias("fp"), "component_id", "best")
    copies = own.filter("n > 1").join(roots.select(F.col("node").alias("fp")), "fp", "left_anti").select("fp", F.col("id").alias("component_id"), "best")
    return common.shared_table(grouped.union(copies), "components")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(doc_id, text_hash, fp, component_id, stays) of every row; of rows with equal (doc_id, text_hash) all stay or none."""
    fps = fingerprints(docs, id_col, text_col, shingle)
    groups = components(fps, radius, blocks)
    out = fps.join(small(groups), "fp", "left")
    key: Column = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    return out.select("doc_id", "text_hash", "fp", F.coalesce("component_id", "doc_id").alias("component_id"), (F.col("best").isNull() | (F.col("best") == key)).alias("stays"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` without near duplicates: one row of each group stays, that of the smallest id.

    Repeated rows have equal fingerprints and count as copies. Columns are as in the input.
    """
    found = common.shared_table(near_duplicates(docs, id_col, text_col, **how), "decisions")
    rows, kinds = found.count(), found.select("doc_id", "text_hash").distinct().count()
    out = common.without(docs, found.filter("NOT stays").select("doc_id", "text_hash").distinct(), id_col, text_col)
    if rows > kinds:
        digest = common.spare(docs, "_bk_text")
        out = out.withColumn(digest, F.xxhash64(common.column(out, text_col))).dropDuplicates([id_col, digest]).drop(digest)
    return out
