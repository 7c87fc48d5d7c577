"""Language identification by interpolated Kneser-Ney character models.

Each language has character models of orders 1 to ``ORDER`` with interpolated Kneser-Ney smoothing:
counts at the highest order, numbers of distinct left extensions below, one absolute discount per order.
All grams seen in any language are stored per order in one sorted array of 64-bit hashes (a bijection of
four 16-bit letter numbers, so without collisions) beside a matrix of the log probability in every
language and one of the back-off weight of the gram as a context. Equal leading bits of a hash give the
place in the array, so that a lookup is a few gathers for whole batches of text.

The language of a text is that of the lowest cross-entropy per character. Rejection is calibrated on
texts of the sample that the models have not seen: the confidence is the posterior at a fitted
temperature, lowered where the cross-entropy exceeds what the language's own texts reach, and
``rejected`` marks texts beyond that.

Letters are lower-cased and runs of other characters are one space. Models are fitted on a bounded
sample, at most ``SAMPLE`` different texts of a language by hash of id and text; of a text over ``LONGEST``
characters the fit reads as many, from its first letter on. All languages together give ``TEXTS`` texts and
``CHARACTERS`` characters at most, so that many languages give fewer of each, and the ``LANGUAGES`` of the most
texts are learned. Letters have numbers of 16 bits: of more than ``LETTERS`` that the sample has, the rarest count
as one letter. Every text is scored whole. Defined results: a text that is null or has no letter is ``und``
with score 0; so is every text if nothing can be learned; rows with equal ids are scored on their own, and in
the sample they are told apart by their texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .common import small

ORDER = 4
SAMPLE = 400
LONGEST = 20_000
#: Bounds of the sample over all languages.
LANGUAGES = 1000
TEXTS = 20_000
CHARACTERS = 40_000_000
#: Letters that are told apart.
LETTERS = 65_000
#: Characters that are scored at once.
AT_ONCE = 1 << 20
#: Length beyond which more text adds no confidence.
ENOUGH = 200

_ODD = np.uint64(0x9E3779B97F4A7C15)
_SPACE = 1  # number of the space; 0 is any letter that was not learned


def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x10000)])


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, lower-cased, other characters than letters as single spaces (0); and each
    text's number of code points, a leading space included. A text without a letter has none."""
    raw = [np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    sizes = np.array([len(r) + 1 for r in raw])
    whole = np.zeros(int(sizes.sum()), np.uint32)
    starts = np.cumsum(sizes) - sizes
    for s, r in zip(starts, raw):
        whole[s + 1 : s + 1 + len(r)] = r
    letter = _LETTER[np.minimum(whole, 0xFFFF)]
    wide = whole > 0xFFFF
    if wide.any():
        letter[wide] = [chr(c).isalpha() for c in whole[wide]]
    whole[~letter] = 0
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first of a run of others
    keep[starts] = True
    if len(starts):  # nothing after the last letter of a text
        place = np.arange(len(whole))
        keep &= place <= np.repeat(np.maximum(np.maximum.reduceat(np.where(letter, place, -1), starts), starts), sizes)
    has = np.add.reduceat(letter, starts) > 0 if len(starts) else np.empty(0, bool)
    kept = np.add.reduceat(keep, starts) if len(starts) else np.empty(0, np.int64)
    keep &= np.repeat(has, sizes)
    return whole[keep], np.where(has, kept, 0)


_LETTER = _letters()


@dataclass
class Grams:
    """The grams of an order: sorted hashes, where hashes of equal leading bits start, matrices by language."""

    hashes: np.ndarray
    first: np.ndarray
    shift: np.uint64
    deepest: int
    log_p: np.ndarray
    backoff: np.ndarray

    def find(self, hashed: np.ndarray) -> np.ndarray:
        """Rows of the hashes, -1 where absent."""
        at = self.first[(hashed >> self.shift).astype(np.int64)]
        out = np.where(self.hashes[at] == hashed, at, -1)
        for k in range(1, self.deepest):
            miss = np.flatnonzero(out < 0)
            if not len(miss):
                break
            near = np.minimum(at[miss] + k, len(self.hashes) - 1)
            out[miss] = np.where(self.hashes[near] == hashed[miss], near, -1)
        return out


def grams(keys: np.ndarray, log_p: np.ndarray, backoff: np.ndarray) -> Grams:
    hashed = keys * _ODD
    order = np.argsort(hashed)
    hashed = hashed[order]
    bits = max(4, int(np.ceil(np.log2(len(keys) + 1))) + 2)
    shift = np.uint64(64 - bits)
    lead = (hashed >> shift).astype(np.int64)
    first = np.minimum(np.searchsorted(lead, np.arange(1 << bits)), len(keys) - 1)
    return Grams(hashed, first, shift, int(np.bincount(lead).max()), log_p[order], backoff[order])


@dataclass
class Models:
    langs: list[str]
    learned: np.ndarray  # code points in order; their number is the place plus 2
    tables: list[Grams]  # by order, from 1
    temperature: float = 1.0
    limit: np.ndarray | None = None  # by language: cross-entropy in bits a character that its own texts reach

    def numbers(self, points: np.ndarray) -> np.ndarray:
        if not len(points):
            return np.empty(0, np.uint64)
        at = np.minimum(np.searchsorted(self.learned, points), len(self.learned) - 1)
        return np.where(points == 0, _SPACE, np.where(self.learned[at] == points, at + 2, 0)).astype(np.uint64)

    def log_probs(self, ids: np.ndarray, heads: np.ndarray) -> np.ndarray:
        """Of each character in each language. ``heads``: where texts start; grams do not cross it but see spaces."""
        n = len(ids)
        place = np.arange(n) - np.repeat(heads, np.diff(np.append(heads, n)))
        key = np.zeros(n, np.uint64)
        for back in range(ORDER - 1, -1, -1):
            before = np.empty(n, np.uint64)
            before[back:] = ids[: n - back] if back else ids
            if back:
                before[place < back] = _SPACE
            key = (key << np.uint64(16)) | before
        out = np.zeros((n, len(self.langs)), np.float32)
        rows = np.arange(n)
        for k in range(ORDER, 0, -1):
            part = key if k == ORDER else key & np.uint64((1 << 16 * k) - 1)
            at = self.tables[k - 1].find(part * _ODD)
            hit = at >= 0
            if len(rows) == n and hit.all():
                return out + self.tables[k - 1].log_p[at]
            out[rows[hit]] += self.tables[k - 1].log_p[at[hit]]
            rows, key = rows[~hit], part[~hit]
            if not len(rows) or k == 1:
                break
            context = self.tables[k - 2].find((key >> np.uint64(16)) * _ODD)
            seen = context >= 0
            out[rows[seen]] += self.tables[k - 2].backoff[context[seen]]
        return out

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bits a character by text and language, and the number of characters; texts are scored whole."""
        bits, sizes = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64)
        at = 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size + len(texts[to]) <= AT_ONCE):
                size += len(texts[to])
                to += 1
            points, n = codes(texts[at:to])
            sizes[at:to] = n
            some = np.flatnonzero(n)
            if len(some):
                heads = np.cumsum(n[some]) - n[some]
                sums = np.add.reduceat(self.log_probs(self.numbers(points), heads), heads, axis=0, dtype=np.float64)
                bits[at + some] = -sums / np.log(2) / n[some][:, None]
            at = to
        return bits, sizes

    def posterior(self, bits: np.ndarray, sizes: np.ndarray, temperature: float | None = None) -> np.ndarray:
        t = self.temperature if temperature is None else temperature
        weight = t * np.minimum(sizes, ENOUGH)[:, None] * np.log(2)
        z = -(bits - bits.min(axis=1, keepdims=True)) * weight
        e = np.exp(z)
        return e / e.sum(axis=1, keepdims=True)


def _counts(ids_by_text: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(keys, counts) by order: occurrences at the highest, distinct left extensions below."""
    padded = [np.concatenate((np.full(ORDER - 1, _SPACE, np.uint64), i)) for i in ids_by_text if len(i)]
    tops = []
    for p in padded:
        key = np.zeros(len(p) - ORDER + 1, np.uint64)
        for j in range(ORDER):
            key = (key << np.uint64(16)) | p[j : len(p) - ORDER + 1 + j]
        tops.append(key)
    keys, n = np.unique(np.concatenate(tops), return_counts=True)
    out = [(keys, n.astype(float))]
    for k in range(ORDER - 1, 0, -1):
        keys, n = np.unique(out[0][0] & np.uint64((1 << 16 * k) - 1), return_counts=True)
        out.insert(0, (keys, n.astype(float)))
    return out


class _Language:
    """Probabilities of one language for any keys."""

    def __init__(self, counts: list[tuple[np.ndarray, np.ndarray]], alphabet: int):
        self.levels, self.alphabet = [], alphabet
        for keys, n in counts:
            once, twice = (n == 1).sum(), (n == 2).sum()
            discount = float(np.clip(once / max(once + 2 * twice, 1), 0.1, 0.9))
            contexts, place = np.unique(keys >> np.uint64(16), return_inverse=True)
            total = np.bincount(place, n)
            kinds = np.bincount(place)
            self.levels.append((keys, n, discount, contexts, total, discount * kinds / total))

    def context(self, keys: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Total and back-off weight of the contexts of keys of order k; 0 and 1 where unseen."""
        _, _, _, contexts, total, weight = self.levels[k - 1]
        c = keys >> np.uint64(16)
        at = np.minimum(np.searchsorted(contexts, c), len(contexts) - 1)
        seen = contexts[at] == c
        return np.where(seen, total[at], 0), np.where(seen, weight[at], 1.0)

    def p(self, keys: np.ndarray, k: int) -> np.ndarray:
        if k == 0:
            return np.full(len(keys), 1 / self.alphabet)
        known, n, discount, *_ = self.levels[k - 1]
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        own = np.where(known[at] == keys, np.maximum(n[at] - discount, 0), 0)
        total, weight = self.context(keys, k)
        lower = self.p(keys & np.uint64((1 << 16 * (k - 1)) - 1) if k > 1 else keys, k - 1)
        return np.where(total > 0, own / np.maximum(total, 1), 0) + weight * lower


def fit(texts: list[str], langs: list[str]) -> Models | None:
    """Models and calibration; every fifth text of a language is kept from the models and calibrates."""
    names = sorted(set(langs))
    by = {name: [t for t, lang in zip(texts, langs) if lang == name] for name in names}
    points = {name: [codes([t])[0] for t in by[name]] for name in names}
    names = [name for name in names if any(map(len, points[name]))]
    if not names:
        return None
    learned, often = np.unique(np.concatenate([p for name in names for p in points[name]]), return_counts=True)
    learned = np.sort(learned[np.argsort(-often, kind="stable")][:LETTERS])
    learned = learned[learned > 0]
    models = Models(names, learned, [])
    languages = []
    for name in names:
        own = [models.numbers(p) for i, p in enumerate(points[name]) if i % 5 != 4 or len(points[name]) < 10]
        languages.append(_Language(_counts(own if any(map(len, own)) else [models.numbers(p) for p in points[name]]), len(learned) + 2))
    for k in range(1, ORDER + 1):
        keys = np.unique(np.concatenate([lang.levels[k - 1][0] for lang in languages] + ([np.arange(len(learned) + 2, dtype=np.uint64)] if k == 1 else [])))
        log_p = np.log(np.stack([lang.p(keys, k) for lang in languages], axis=1)).astype(np.float32)
        weights = [lang.context(keys << np.uint64(16), k + 1)[1] if k < ORDER else np.ones(len(keys)) for lang in languages]
        models.tables.append(grams(keys, log_p, np.log(np.stack(weights, axis=1)).astype(np.float32)))
    held = [(t, i) for i, name in enumerate(names) for t in by[name][4::5] if len(by[name]) >= 10] or [(t, i) for i, name in enumerate(names) for t in by[name]]
    bits, sizes = models.entropies([t for t, _ in held])
    truth = np.array([i for _, i in held])
    ok = sizes > 0
    bits, sizes, truth = bits[ok], sizes[ok], truth[ok]
    losses = [(-np.log(np.maximum(models.posterior(bits, sizes, t)[np.arange(len(truth)), truth], 1e-12)).mean(), t) for t in (0.02, 0.05, 0.1, 0.2, 0.5, 1.0)]
    models.temperature = min(losses)[1]
    own = bits[np.arange(len(truth)), truth]
    models.limit = np.array([(x.mean() + 4 * x.std() + 0.25) if len(x := own[(truth == i) & (sizes >= 20)]) else np.inf for i in range(len(names))])
    return models


def sample(docs: DataFrame, most: int = SAMPLE, longest: int = LONGEST, languages: int = LANGUAGES) -> tuple[list[str], list[str]]:
    """Different texts and their languages, at most ``most`` of each language by hash of id and text; held-out ids left
    out, as are texts without a letter. Of a text over ``longest`` characters as many, from its first letter on.

    The places of texts in this order are drawn over ids and hashes alone; the texts of those that are taken, whose
    number is bounded, are then looked up and gathered."""
    rows = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).filter(~common.held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    rows = rows.withColumn("hash", F.xxhash64("text"))
    keys = common.shared_table(rows.select("lang", "doc_id", "hash").distinct(), "language-keys")
    learned = common.shared_table(keys.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages), "languages")
    n = max(1, learned.count())
    most = min(most, max(1, TEXTS // n))
    longest = min(longest, max(1, CHARACTERS // (n * most)))
    drawn = F.xxhash64("doc_id", "hash")
    share = F.pmod(drawn, F.lit(1 << 30)) / float(1 << 30)
    some = keys.join(small(learned, languages), "lang").filter(share < F.lit(1.5 * most + 20) / F.col("n"))
    first = Window.partitionBy("lang").orderBy(drawn, "doc_id", "hash")
    taken = common.shared_table(some.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= most).drop("n"), "language-sample")
    head = F.when(F.length("text") > longest, F.left(F.regexp_replace("text", r"^\P{L}++", ""), F.lit(longest))).otherwise(F.col("text"))
    same = rows["lang"].eqNullSafe(taken["lang"]) & rows["doc_id"].eqNullSafe(taken["doc_id"]) & (rows["hash"] == taken["hash"])
    texts = rows.join(small(taken), same).select(taken["lang"].alias("lang"), "place", head.alias("text")).groupBy("lang", "place").agg(F.min("text").alias("text"))
    got = sorted(texts.collect())
    return [r["text"] for r in got], [r["lang"] for r in got]


def identified(docs: DataFrame, models: Models | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, cross_entropy, rejected) of every row."""
    rows = docs.select(common.column(docs, id_col).alias("doc_id"), common.column(docs, text_col).cast("string").alias("text"))
    held = docs.sparkSession.sparkContext.broadcast(models)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = held.value
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            if models is None:
                lang, score, bits, out = ["und"] * len(texts), np.zeros(len(texts)), [None] * len(texts), np.ones(len(texts), bool)
            else:
                table, sizes = models.entropies(texts)
                best = table.argmin(axis=1)
                bits = table[np.arange(len(texts)), best]
                over = np.maximum(bits - models.limit[best], 0)
                score = np.where(sizes > 0, models.posterior(table, sizes).max(axis=1) * np.exp(-over), 0.0)
                lang = [models.langs[i] if n else "und" for i, n in zip(best, sizes)]
                out = (over > 0) | (sizes == 0)
                bits = [float(x) if n else None for x, n in zip(bits, sizes)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(lang, pa.string()), pa.array(np.clip(score, 0, 1)), pa.array(bits, pa.float64()), pa.array(out)], ["doc_id", "lang_pred", "score", "cross_entropy", "rejected"])

    return rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, cross_entropy double, rejected boolean")
