"""Many patterns in many texts: an Aho-Corasick automaton in flat arrays, scanned in lanes.

The automaton is a dense table of (state, character class), made level by level of the trie with numpy. A batch of
texts is one stream of character classes with a separator between texts; the stream is cut into lanes that step through
the table together, each from so far before its own part that its state is right when that begins. A dictionary whose
table takes up to BOUND bytes is collected and its automaton broadcast. A larger one is dealt by pattern into parts of that
size: executors make the automata, and slices of the texts meet each of them in a cogroup, so that neither the driver nor
a task holds more than one part.

Hits are exact and overlapping, positions count code points from 0. Null texts and null or empty patterns have none; equal patterns
count once; a repeated text row gives its hits again.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_table

BOUND = 64 << 20
LANES = 8192
#: Code points that are scanned at once, but for a longer text.
AT_ONCE = 4 << 20
#: Bytes of texts that meet an automaton in one group, if there are several.
SLICE = 32 << 20


@dataclass(frozen=True)
class Automaton:
    """``step[state * classes + class]`` is the next state; of a state ``own`` is the pattern that ends there, or -1, ``link`` the
    longest other state that is its suffix and ends a pattern, or 0."""

    patterns: list[str]
    sizes: np.ndarray
    letters: np.ndarray
    step: np.ndarray
    own: np.ndarray
    link: np.ndarray

    @property
    def classes(self) -> int:
        return len(self.letters) + 1

    def scan(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, pattern, start) of all hits by numbers."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        starts = np.concatenate(([0], np.cumsum(sizes + 1)))
        points = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        at = np.searchsorted(self.letters, points)
        known = self.letters[np.minimum(at, len(self.letters) - 1)] == points
        classes = np.where(known, at + 1, 0).astype(np.int32)
        classes[starts[1:] - 1] = 0  # what is between texts is in no pattern
        warm = int(self.sizes.max()) - 1
        length = max(-(-len(classes) // LANES), 4 * warm, 64)
        lanes = -(-len(classes) // length)
        stream = np.zeros(warm + lanes * length, np.int32)
        stream[warm : warm + len(classes)] = classes
        grid = np.lib.stride_tricks.as_strided(stream, (lanes, warm + length), (4 * length, 4))
        states = np.empty((length, lanes), np.int32)
        state = np.zeros(lanes, np.int32)
        for t in range(warm + length):
            state = self.step[state.astype(np.int64) * self.classes + grid[:, t]]
            if t >= warm:
                states[t - warm] = state
        row, lane = np.nonzero((self.own[states] >= 0) | (self.link[states] > 0))
        state, end = states[row, lane].astype(np.int64), lane * length + row
        ends, found = [], []
        while len(state):
            own = self.own[state]
            ends.append(end[own >= 0])
            found.append(own[own >= 0])
            state = self.link[state].astype(np.int64)
            end, state = end[state > 0], state[state > 0]
        end, pattern = np.concatenate([np.zeros(0, np.int64), *ends]), np.concatenate([np.zeros(0, np.int64), *found]).astype(np.int64)
        text = np.searchsorted(starts, end, side="right") - 1
        return text, pattern, end - self.sizes[pattern] + 1 - starts[text]


def automaton(patterns: list[str]) -> Automaton:
    """Of distinct patterns that are not empty."""
    sizes = np.fromiter(map(len, patterns), np.int64, len(patterns))
    flat = np.frombuffer("".join(patterns).encode("utf-32-le", "surrogatepass"), np.uint32)
    letters = np.unique(flat)
    k = len(letters) + 1
    flat, first = np.searchsorted(letters, flat) + 1, np.cumsum(sizes) - sizes
    at, n = np.zeros(len(patterns), np.int64), 1
    levels, ending = [], []
    for depth in range(int(sizes.max())):
        active = np.flatnonzero(sizes > depth)
        key, inverse = np.unique(at[active] * k + flat[first[active] + depth], return_inverse=True)
        levels.append((np.arange(n, n + len(key)), key // k, key % k))
        at[active] = n + inverse
        n += len(key)
        ended = active[sizes[active] == depth + 1]
        ending.append((at[ended], ended))
    step, fail = np.zeros((n, k), np.int32), np.zeros(n, np.int64)
    own, link = np.full(n, -1, np.int32), np.zeros(n, np.int32)
    for states, which in ending:
        own[states] = which
    states, _, cls = levels[0]
    step[0, cls] = states
    for depth, (states, parent, cls) in enumerate(levels):
        if depth:
            fail[states] = step[fail[parent], cls]
        step[states] = step[fail[states]]
        link[states] = np.where(own[fail[states]] >= 0, fail[states], link[fail[states]])
        if depth + 1 < len(levels):  # the children's own steps come over those of the suffix
            child, of, by = levels[depth + 1]
            step[of, by] = child
    return Automaton(patterns, sizes, letters, step.ravel(), own, link)


def _scanned(machine: Automaton, ids: pa.Array, texts: pa.Array) -> Iterator[pa.RecordBatch]:
    names = pa.array(machine.patterns, pa.string())

    def out(at: list[int], part: list[str]) -> pa.RecordBatch:
        text, pattern, start = machine.scan(part)
        return pa.RecordBatch.from_arrays([ids.take(pa.array(np.array(at, np.int64)[text])), names.take(pa.array(pattern)), pa.array(start)], ["id", "pattern", "start"])

    at, part, size = [], [], 0
    for i, t in enumerate(texts):
        if (s := t.as_py()) is None:
            continue
        if part and size + len(s) > AT_ONCE:
            yield out(at, part)
            at, part, size = [], [], 0
        at.append(i)
        part.append(s)
        size += len(s)
    if part:
        yield out(at, part)


def parts(patterns: DataFrame, bound: int = BOUND) -> int:
    """How many automata of ``bound`` bytes the distinct patterns (pattern) take at most."""
    n = patterns.agg(F.coalesce(F.sum(F.length("pattern")), F.lit(0))).first()[0]
    k = patterns.select(F.explode(F.split("pattern", "")).alias("c")).distinct().count()
    return max(1, -(-(n + 1) * (k + 1) * 4 // bound))


def hits(texts: DataFrame, patterns: DataFrame, id_col: str = "doc_id", text_col: str = "text", pattern_col: str = "pattern", bound: int = BOUND) -> DataFrame:
    """(id, pattern, start) of all occurrences of all patterns in all texts."""
    spark = texts.sparkSession
    words = shared_table(patterns.select(F.col(pattern_col).alias("pattern")).filter("pattern <> ''").distinct(), "patterns")
    rows = texts.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, pattern string, start long"
    n = parts(words, bound)
    if n == 1:
        held = words.toArrow()["pattern"].to_pylist()  # their automaton takes ``bound`` bytes at most
        if not held:
            return spark.createDataFrame([], schema)
        sent = spark.sparkContext.broadcast(automaton(held))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield from _scanned(sent.value, b.column("id"), b.column("text"))

        return rows.mapInArrow(run, schema)

    def made(group: pa.Table) -> pa.Table:
        blob = pickle.dumps(automaton(group["pattern"].to_pylist()))
        return pa.table({"part": group["part"][:1], "machine": pa.array([blob], pa.large_binary()).cast(pa.binary())})

    machines = words.withColumn("part", F.pmod(F.xxhash64("pattern"), F.lit(n)).cast("int")).groupBy("part").applyInArrow(made, "part int, machine binary")
    machines = shared_table(machines, "automata")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    slices = max(1, -(-size // SLICE))
    dealt = rows.withColumn("slice", F.pmod(F.xxhash64("text", "id"), F.lit(slices)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    machines = machines.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))

    def met(texts_: pa.Table, machine: pa.Table) -> pa.Table:
        if not texts_.num_rows or not machine.num_rows:
            return pa.table({"id": texts_["id"][:0], "pattern": pa.array([], pa.string()), "start": pa.array([], pa.int64())})
        found = list(_scanned(pickle.loads(machine["machine"][0].as_py()), texts_["id"].combine_chunks(), texts_["text"]))
        return pa.Table.from_batches(found, pa.schema([pa.field("id", texts_["id"].type), ("pattern", pa.string()), ("start", pa.int64())]))

    return dealt.groupBy("part", "slice").cogroup(machines.groupBy("part", "slice")).applyInArrow(met, schema)
