"""Token ids in Parquet list columns.

A token set is a folder with ``data`` and ``manifest``. ``data`` has one row per document in ascending
order of ids over all part files: doc_id, part, offset (ids of the part before it), n_tokens, tokens. The
manifest has one row per part: its first id, its number of ids and the ids of all parts before it. Token
columns are dictionary-encoded (a vocabulary of 50,000 takes 16 bits an id), the other columns delta-
encoded; row groups and pages are small and have page indexes, so that a reader of doc_id and n_tokens
touches no token and a reader of few documents only their pages.

Texts are dealt by id ranges before they are encoded, so that each is shuffled and encoded once and each
file written once. The pre-tokenization of a byte-level vocabulary cuts a text where the class of its
characters changes; it is made here for whole batches at once, with the classes that the tokenizers library
tells. Distinct pieces are found by Arrow's dictionary encoding, the library's model encodes those that a
bounded memory of the worker does not have, and the ids of all pieces are gathered.

Defined results: a null text is empty and has the end id alone; null ids come first; rows with equal ids
follow each other in order of their texts' hashes; an empty table gives an empty token set.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .common import small

END = 2
ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 64 << 10
PAGE_ROWS = 1000
#: Remembered pieces per worker, of at most PIECE bytes: some 10 MB.
REMEMBER = 200_000
PIECE = 48
#: Bytes of texts that are cut at once; a longer text is cut in parts.
AT_ONCE = 2 << 20

LETTER, NUMBER, OTHER, WHITE, UNSEEN = range(5)
#: Where a long text may be parted: before white space or a comma or stop that no piece spans.
_PART = re.compile(rb"(?<=[0-9A-Za-z])[ \n]|(?<=[\xe5-\xe8][\x80-\xbf]{2})(?:\xe3\x80\x82|\xef\xbc\x8c)")
_BETWEEN = "\u2400"


def _symbols() -> np.ndarray:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin-1 ones for themselves,
    the others in their order from 256 on."""
    own = [chr(b).isprintable() and b not in (0x20, 0xA0, 0xAD) for b in range(256)]
    other = iter(range(256, 512))
    return np.array([b if own[b] else next(other) for b in range(256)], np.uint16)


_SYMBOLS = _symbols()
_encoders: dict[str, Encoder] = {}


def _gathered(starts: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``starts[r]`` to ``starts[r + 1]`` of ids, one after the other, and where each starts; its last is the end."""
    first = starts[rows]
    sizes = starts[rows + 1] - first
    to = np.concatenate(([0], np.cumsum(sizes)))
    at = np.repeat(first - to[:-1], sizes)
    at += np.arange(to[-1])
    return to, ids[at]


class Encoder:
    """A byte-level BPE of the tokenizers library with a memory of pieces: ``words``, and the ids of word i from
    ``starts[i]`` on."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.classes = np.full(0x110000, UNSEEN, np.uint8)
        self.words, self.starts, self.ids = pa.array([], pa.binary()), np.zeros(1, np.int64), np.empty(0, np.uint32)

    def kinds(self, points: np.ndarray) -> np.ndarray:
        """The class of each code point. Of one not seen before the library tells it: what is not cut between
        letters is a letter, and so on."""
        found = self.classes[points]
        if (new := found == UNSEEN).any():
            cut = self.tokenizer.pre_tokenizer.pre_tokenize_str
            for c in np.unique(points[new]).tolist():
                self.classes[c] = next((kind for kind, side in ((LETTER, "x"), (NUMBER, "1"), (OTHER, "!")) if len(cut(side + chr(c) + side)) == 1), WHITE)
            found = self.classes[points]
        return found

    def cuts(self, points: np.ndarray, heads: np.ndarray) -> np.ndarray:
        """Where the pieces of texts start, as pre-tokenization has them; ``heads`` are the starts of texts.

        A piece is a run of one class. The last space of a run of white space goes with what follows; another last
        white character stands alone, unless the text ends with it. 's, 't, 're, 've, 'm, 'll and 'd are pieces."""
        n, kind = len(points), self.kinds(points)
        head = np.zeros(n + 1, bool)
        head[heads] = head[n] = True
        start = head.copy()
        start[1:n] |= kind[1:] != kind[:-1]
        runs = np.flatnonzero(start)
        a, b = runs[:-1], runs[1:]
        last = b[(kind[a] == WHITE) & ~head[b]] - 1
        start[last] = True
        start[last[points[last] == 32] + 1] = False
        mark = a[(kind[a] == OTHER) & (b - a == 1) & ~head[b] & (points[a] == 39)]
        mark = mark[start[mark]]
        mark = mark[kind[mark + 1] == LETTER]
        next_ = points[mark + 1]
        third = np.minimum(mark + 2, n - 1)
        one = np.isin(next_, [ord(c) for c in "stmd"])
        two = ~head[mark + 2] & ((np.isin(next_, [ord("r"), ord("v")]) & (points[third] == ord("e"))) | ((next_ == ord("l")) & (points[third] == ord("l"))))
        start[mark[one | two] + 1] = False
        start[mark[one] + 2] = start[mark[two] + 3] = True
        return np.flatnonzero(start[:n])

    def learn(self, words: pa.BinaryArray) -> None:
        """Puts words that the memory does not have into it. The model's symbols stand for the words' bytes."""
        at = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
        raw = np.frombuffer(words.buffers()[2], np.uint8)[at[0] : at[-1]]
        text = np.full(len(raw) + len(words), ord(_BETWEEN), np.uint16)
        text[np.arange(len(raw)) + np.repeat(np.arange(len(words)), np.diff(at))] = _SYMBOLS[raw]
        model = self.tokenizer.model.tokenize
        found = [[t.id for t in model(w)] for w in text.astype("<u2").tobytes().decode("utf-16-le").split(_BETWEEN)[:-1]]
        self.words = pa.concat_arrays([self.words, words])
        self.starts = np.concatenate((self.starts, self.starts[-1] + np.cumsum([len(f) for f in found])))
        self.ids = np.concatenate((self.ids, np.fromiter(chain.from_iterable(found), np.uint32)))

    def run(self, data: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that lie in ``data`` one after the other up to ``ends``, and where those of each end."""
        points = np.frombuffer(data.decode().encode("utf-32-le"), np.uint32)
        if not len(points):
            return np.empty(0, np.uint32), np.zeros(len(ends), np.int64)
        place = np.arange(len(points) + 1, dtype=np.int32)  # the byte at which each character starts
        if len(points) < len(data):
            width = np.ones(len(points), np.uint8)
            for more in (0x80, 0x800, 0x10000):
                width += points >= more
            np.cumsum(width, out=place[1:])
        heads = np.searchsorted(place, np.concatenate(([0], ends[:-1])))
        cuts = place[self.cuts(points, heads[heads < len(points)])]
        to = np.append(cuts, np.int32(len(data)))
        pieces = pa.Array.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer(to), pa.py_buffer(data)]).dictionary_encode()
        words = pieces.dictionary
        known = pc.index_in(words, value_set=self.words)
        new = np.flatnonzero(known.is_null().to_numpy(zero_copy_only=False))
        row = known.fill_null(0).to_numpy().astype(np.int64)
        if len(new):
            row[new] = len(self.words) + np.arange(len(new))
            self.learn(words.take(pa.array(new)))
        at, ids = _gathered(self.starts, self.ids, row[pieces.indices.to_numpy()])
        if len(self.words) > REMEMBER or len(new) and pc.max(pc.binary_length(words)).as_py() > PIECE:
            self.forget(row, len(self.words) > REMEMBER)
        return ids, at[np.searchsorted(cuts, ends)]

    def forget(self, rows: np.ndarray, full: bool) -> None:
        """Keeps only words that are not too long; of a full memory ``rows``, what the last texts had."""
        keep = rows if full else np.arange(len(self.words))
        keep = keep[pc.binary_length(self.words).to_numpy()[keep] <= PIECE]
        self.words = self.words.take(pa.array(keep))
        self.starts, self.ids = _gathered(self.starts, self.ids, keep)

    def parts(self, text: bytes) -> Iterator[bytes]:
        """A long text in parts of some AT_ONCE bytes, parted where pieces end."""
        at = 0
        while at < len(text):
            cut = _PART.search(text, at + AT_ONCE) if len(text) - at > AT_ONCE else None
            yield text[at : cut.start() if cut else None]
            at = cut.start() if cut else len(text)

    def encoded(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Of some rows at a time their number, the ids of their texts, and where those of each end."""
        column = column.cast(pa.large_binary()).fill_null(b"")
        at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        raw, row = memoryview(column.buffers()[2] or b""), 0
        while row < len(column):
            to = max(row + 1, int(np.searchsorted(at, at[row] + AT_ONCE, side="right")) - 1)
            data, ends = bytes(raw[at[row] : at[to]]), at[row + 1 : to + 1] - at[row]
            if any(s in data for s in self.special) and to > row + 1:  # one by one
                to = row + 1
                data, ends = bytes(raw[at[row] : at[to]]), at[to : to + 1] - at[row]
            if any(s in data for s in self.special):
                ids = np.array(self.tokenizer.encode_batch_fast([data.decode()], add_special_tokens=False)[0].ids, np.uint32)
                yield 1, ids, np.array([len(ids)])
            elif len(data) > AT_ONCE:
                ids = np.concatenate([self.run(p, np.array([len(p)]))[0] for p in self.parts(data)])
                yield 1, ids, np.array([len(ids)])
            else:
                yield to - row, *self.run(data, ends)
            row = to

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        return [x.astype("<u4").tobytes() for _, ids, ends in self.encoded(pa.array(texts, pa.string())) for x in np.split(ids, ends)[:-1]]


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def write(docs: DataFrame, to: str, tokenizer: str, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode all texts of ``docs`` and write the token set ``to`` a folder that all executors share."""
    rows = docs.select(common.column(docs, id_col).alias("doc_id"), F.coalesce(common.column(docs, text_col).cast("string"), F.lit("")).alias("text"))
    # equal rows are told apart by their place in the input, so that many of them lie in many ranges
    order = ["doc_id", "_bk_hash", "_bk_row"]
    rows = rows.withColumn("_bk_hash", F.xxhash64("text")).withColumn("_bk_row", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("_bk_hash", "_bk_row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, offset = encoder(tokenizer), TaskContext.get().partitionId(), 0
        for b in batches:
            at = 0
            for rows_, ids, ends in encode.encoded(b.column("text")):
                tokens = pa.array(np.insert(ids, ends, end).view(np.int32))
                n = np.diff(ends, prepend=0) + 1
                to_ = np.cumsum(n)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], to_)), pa.int32()), tokens)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(at, rows_), pa.array(np.full(rows_, part, np.int32)), pa.array(offset + to_ - n), pa.array(n), lists], ["doc_id", "part", "offset", "n_tokens", "tokens"])
                at, offset = at + rows_, offset + int(to_[-1])
            pa.default_memory_pool().release_unused()

    kind = rows.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"doc_id {kind}, part int, offset long, n_tokens long, tokens array<int>")
    options = {"parquet.block.size": ROW_GROUP_BYTES, "parquet.page.size": PAGE_BYTES, "parquet.page.row.count.limit": PAGE_ROWS, "parquet.writer.version": "PARQUET_2_0"}
    options |= {f"parquet.enable.dictionary#{c}": "false" for c in ("doc_id", "part", "offset", "n_tokens")}
    out.write.options(**{k: str(v) for k, v in options.items()}).parquet(f"{to}/data")
    parts = docs.sparkSession.read.parquet(f"{to}/data").groupBy("part").agg(F.min("doc_id").alias("first_id"), F.sum("n_tokens").alias("n_tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts.select("part", "first_id", "n_tokens", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base")).write.parquet(f"{to}/manifest")


def read(spark: SparkSession, at: str) -> DataFrame:
    """(doc_id, start, n_tokens, tokens) of a token set; columns that are not asked for are not read."""
    data, manifest = spark.read.parquet(f"{at}/data"), spark.read.parquet(f"{at}/manifest").select("part", "base")
    return data.join(small(manifest), "part").select("doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "tokens")


def checksums(token_set: DataFrame) -> DataFrame:
    """``read``'s rows with ids_crc32 in place of tokens, and the length of the list that was read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("tokens")
            ids, at = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4"), np.asarray(lists.offsets) - lists.offsets[0].as_py()
            raw = memoryview(ids.tobytes())
            crc = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    kind = token_set.schema["doc_id"].dataType.simpleString()
    return token_set.mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")
