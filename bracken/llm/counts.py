"""Token counts by byte-pair merging with a heap and a linked list.

A word's symbols are its bytes. All adjacent pairs that can merge go into a heap by rank and place; the lowest is popped,
the pair becomes one symbol, its neighbours' new pairs are pushed, and what is popped stale is passed over. The
number of tokens is the number of bytes less that of merges; no identifiers are made. The vocabulary is a file of the
tokenizers library: lower case, words that end with a marked symbol, white space dropped.

A text is cut at white space. A worker remembers the counts of up to REMEMBER chunks of at most CHUNK characters; a chunk
of plain ASCII is cut into words here, another by the library's normalizer and pre-tokenizer. Special strings are
one token wherever they stand, as the library has it.

Defined results: a null text is empty and has no bytes and no tokens; empty texts and those of white space have no
tokens; a chunk of any length is merged whole, in time n log n; rows with equal ids are counted each; an empty
table gives an empty result. Columns of the input are kept but for those of the result's names.
"""

from __future__ import annotations

import heapq
import json
import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LIMIT = 2048
#: Remembered chunks per worker, of at most CHUNK characters: some 60 MB.
REMEMBER = 400_000
CHUNK = 48
#: Runs of what is not Unicode white space.
_CHUNKS = re.compile("[^\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")
#: Words of a lower-case ASCII chunk. Fixed pattern of the vocabulary.
_ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
_counters: dict[str, Counter] = {}


class Counter(dict):
    """Tokens of a chunk without white space, for each chunk seen lately."""

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        number, merges = model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.suffix = model.get("end_of_word_suffix") or ""
        #: The merges by their two symbols: rank and merged symbol.
        self.pairs = {(number[a], number[b]): (rank, number[a.removesuffix(self.suffix) + b]) for rank, (a, b) in enumerate(merges)}
        self.number = number
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.marks = [s[:2] for s in special]
        #: Words seen lately, of which chunks with other punctuation may be made.
        self.words: dict[str, int] = {}

    def __missing__(self, chunk: str) -> int:
        if self.special and any(m in chunk for m in self.marks):
            parts = self.special.split(chunk)
            n = len(parts) - 1 + sum(map(self.plain, filter(None, parts)))
        else:
            n = self.plain(chunk)
        if len(chunk) <= CHUNK:
            if len(self) >= REMEMBER:
                self.clear()
            self[chunk] = n
        return n

    def plain(self, chunk: str) -> int:
        """Tokens of a chunk without special strings."""
        if chunk.isascii() and chunk.isprintable():
            words = _ASCII_WORDS.findall(chunk.lower())
        else:
            words = [w for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(chunk))]
        return sum(map(self.word, words))

    def word(self, word: str) -> int:
        if (n := self.words.get(word)) is None:
            n = self.merged(word)
            if len(word) <= CHUNK:
                if len(self.words) >= REMEMBER:
                    self.words.clear()
                self.words[word] = n
        return n

    def merged(self, word: str) -> int:
        """Symbols of a word, whose characters stand for its bytes, after all merges."""
        n = len(word)
        if n == 1:
            return 1
        number, pairs = self.number, self.pairs
        symbols = [number[c] for c in word]
        symbols[-1] = number[word[-1] + self.suffix]
        heap = [(found[0], i) for i in range(n - 1) if (found := pairs.get((symbols[i], symbols[i + 1])))]
        if not heap:
            return n
        heapq.heapify(heap)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        count = n
        while heap:
            rank, i = heapq.heappop(heap)
            j = right[i]
            if symbols[i] < 0 or j == n:
                continue
            found = pairs.get((symbols[i], symbols[j]))
            if found is None or found[0] != rank:
                continue
            symbols[i], symbols[j] = found[1], -1
            count -= 1
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                if found := pairs.get((symbols[i], symbols[k])):
                    heapq.heappush(heap, (found[0], i))
            if (h := left[i]) >= 0 and (found := pairs.get((symbols[h], symbols[i]))):
                heapq.heappush(heap, (found[0], h))
        return count


def counted(docs: DataFrame, path: str, text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """``docs`` with n_bytes, n_tokens and over_limit of the texts, for the vocabulary at ``path`` on every worker."""

    @F.pandas_udf("long")
    def tokens(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if path not in _counters:
            _counters[path] = Counter(path)
        count = _counters[path].__getitem__
        for batch in texts:
            yield pd.Series([sum(map(count, _CHUNKS.findall(t))) for t in batch], dtype="int64")

    names = ("n_bytes", "n_tokens", "over_limit")
    text = F.coalesce(common.column(docs, text_col).cast("string"), F.lit(""))
    kept = [common.column(docs, c) for c in docs.columns if c.lower() not in names]
    out = docs.select(*kept, F.octet_length(text).cast("long").alias("n_bytes"), tokens(text).alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
