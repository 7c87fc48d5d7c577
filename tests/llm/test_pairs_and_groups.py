"""SimHash, decontamination and mixing against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from bracken.llm import common, decontam, mixing, q02, q09, q10, simhash
from compare import connection, same

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_fingerprint(text, n=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return 0
    h = [xxhash.xxh64(" ".join(words[i : i + n]).encode(), seed=42).intdigest() for i in range(max(1, len(words) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def plain_components(ids, fps, radius=4):
    a = np.array(fps, np.uint64)
    up = list(range(len(a)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[i:] ^ a[i]) <= radius) + i:
            up[top(int(j))] = top(i)
    best = {}
    for i, d in enumerate(ids):
        if d is not None:
            best[top(i)] = min(best.get(top(i), d), d)
    return [best.get(top(i)) for i in range(len(ids))]


def test_op10_equals_brute_force(spark, sf):
    rows = common.table(spark, sf, "documents").select("doc_id", "text").collect()
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in q10.op10_simhash_near_dedup(spark, sf).collect()}
    fps = [plain_fingerprint(r.text) for r in rows]
    comps = plain_components([r.doc_id for r in rows], fps)
    assert got == {r.doc_id: (f"{f:016x}", c) for r, f, c in zip(rows, fps, comps)}


@pytest.mark.parametrize("text", ["", " \t\n", "One", "one two three", "A b C d", "É è É è É", "x " * 9, None, "\x1c a \x85 b"])
def test_fingerprints(text):
    assert simhash.fingerprint(None if text is None else text.encode()) % (1 << 64) == plain_fingerprint(text)


@pytest.mark.parametrize("blocks,hot", [(2, 1 << 15), (2, 3), (1, 1 << 15)])
def test_links_find_every_near_pair(spark, blocks, hot):
    rnd = random.Random(blocks * 100 + hot)
    fps = set()
    for _ in range(6):
        c = rnd.getrandbits(64)
        for _ in range(12 if blocks == 2 else 4):
            c ^= sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 4)))
            fps.add(c)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    found = simhash.links(df, 4, blocks, hot).collect()
    assert all(bin((r.a ^ r.b) & ((1 << 64) - 1)).count("1") <= 4 for r in found)
    root = {r.node: r.root for r in simhash.stars(simhash.links(df, 4, blocks, hot)).collect()}
    mine = plain_components(signed, fps)
    assert [root.get(f, f) for f in signed] == mine


def test_near_duplicate_edges(spark):
    long = "word " * 5000
    rows = [(5, ""), (3, None), (None, " "), (7, "a b c d e"), (7, "a b c d e"), (9, "A B c d e"), (4, long), (2, long + "x"), (None, "alone at last here now")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("extra"))
    got = Counter((r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect())
    fps = [plain_fingerprint(t) for _, t in rows]
    comps = plain_components([d for d, _ in rows], fps)
    assert got == Counter((d, c) for (d, _), c in zip(rows, comps))
    kept = simhash.deduplicated(df)
    assert kept.columns == df.columns and kept.count() == len(set(zip(comps, [f if c is None else 0 for f, c in zip(fps, comps)])))
    assert simhash.near_duplicates(df.limit(0)).count() == 0 and simhash.deduplicated(df.limit(0)).count() == 0


def test_stars_of_a_chain(spark):
    n = 60
    df = spark.createDataFrame([(i, i + 1) for i in range(n)], "a long, b long")
    assert {r.root for r in simhash.stars(df).collect()} == {0}


def test_op2_equals_sql(spark, sf):
    same(q02.op2_benchmark_decontamination(spark, sf), connection(sf), q02.ORACLES["op2_benchmark_decontamination"])


def test_containment_edges(spark):
    item = " ".join(f"w{i}" for i in range(24))  # 20 shingles, 16 are enough
    words = item.split()
    rows = [(1, "start " + item.upper() + "! end"), (2, " ".join(words[:20])), (3, " ".join(words[:19])), (4, None), (5, ""), (None, item), (6, item), (6, item), (7, "x " * 30_000 + item + " y" * 30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("words", F.lit(1)).withColumn("item_id", F.lit(2))
    items = spark.createDataFrame([(10, item), (10, item), (11, "too short"), (12, None)], "item_id long, text string")
    got = Counter((r.doc_id, r.item_id, r.n_shared) for r in decontam.contained(docs, items).collect())
    assert got == Counter([(1, 10, 20), (2, 10, 16), (None, 10, 20), (6, 10, 20), (7, 10, 20)])
    assert sorted(r.doc_id for r in decontam.decontaminated(docs, items).collect()) == [3, 4, 5]
    assert decontam.unsearchable(items).count() == 2
    assert decontam.contained(docs.limit(0), items).count() == 0 and decontam.contained(docs, items.limit(0)).count() == 0


def test_contained_items_are_found_at_any_place(spark):
    rnd = random.Random(2)
    vocab = [f"t{i}" for i in range(40)]
    items = [(i, " ".join(rnd.choices(vocab, k=rnd.randint(5, 60)))) for i in range(20)]
    docs = []
    for d in range(60):
        parts = rnd.choices(vocab, k=rnd.randint(0, 200))
        w = rnd.choice(items)[1].split()
        cut = w[: max(1, int(len(w) * rnd.choice([0.7, 0.8, 0.85, 0.9, 1.0])))]
        at = rnd.randint(0, len(parts))
        docs.append((d, " ".join(parts[:at] + cut + parts[at:])))
    sh = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    want = {(d, i) for d, t in docs for i, x in items if len(sh(x) & sh(t)) >= 0.8 * len(sh(x)) - 1e-9}
    got = decontam.contained(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want and want


def test_op9_equals_sql(spark, sf):
    same(q09.op9_source_mix(spark, sf), connection(sf), q09.ORACLES["op9_source_mix"])


def plain_mix(rows):
    import hashlib

    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    names = sorted({s for *_, s in rows}, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total = {s: sum(n for n, r in zip(size, rows) if r[2] == s) for s in names}
    target, free, rest = {}, set(names), sum(size)
    while True:
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * total[s] + 1e-9]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3.0 * total[s]
            rest -= 3 * total[s]
            free.discard(s)
        if not free:
            break
    key = [hashlib.md5(f"mix:{'null' if d is None else d}".encode()).hexdigest() for d, _, _ in rows]
    copies = []
    for s in names:
        so_far = 0
        for i in sorted((i for i, r in enumerate(rows) if r[2] == s), key=lambda i: (key[i], size[i])):
            so_far += size[i]
            if target[s] > 0:
                copies += [((e * total[s] + so_far) / target[s], names.index(s), e, key[i], size[i], i) for e in range(3)]
    taken, used = [0] * len(rows), 0
    for c in sorted(copies):
        used += c[4]
        if used > sum(size):
            break
        taken[c[5]] += c[4]
    return size, total, target, taken


def test_mix_equals_a_loop(spark):
    rnd = random.Random(8)
    rows = [(i, " ".join("w" * rnd.randint(1, 5) for _ in range(rnd.randint(0, 60))), rnd.choice(["a", "b", "b", "b", "é", "Z", None])) for i in range(300)]
    rows += [(1000, None, "a"), (1001, "", "empty"), (None, "one two", "a"), (1002, "x", "tiny")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("rank", F.lit(1)).withColumn("target", F.lit("t"))
    size, total, target, taken = plain_mix(rows)
    got = {r.doc_id: r for r in mixing.mix(df).collect()}
    for i, (d, _, s) in enumerate(rows):
        r = got[d]
        assert (r.mix_size, r.mix_source_size, r.mix_size * r.mix_copies) == (size[i], total[s], taken[i])
        assert abs(r.mix_target - target[s]) < 1e-6
    rows_out = mixing.expand(mixing.mix(df), ordered=True).collect()
    assert sum(r.mix_size for r in rows_out) == sum(taken) <= sum(size)
    assert [r.mix_finish for r in rows_out] == sorted(r.mix_finish for r in rows_out)


def test_mix_of_nothing_and_of_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a b", "s"), (1, "a b", "s"), (1, "a b", "s")], "doc_id long, text string, source string")
    assert mixing.mix(df.limit(0)).count() == 0
    assert sum(r.mix_size * r.mix_copies for r in mixing.mix(df).collect()) == 6
    empty = spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string")
    assert [r.mix_copies for r in mixing.mix(empty).collect()] == [0]


def test_many_sources_are_joined_with_salt(spark, monkeypatch):
    rows = [(i, "w " * (i % 7), f"s{i % 50}") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    a = sorted(map(tuple, mixing.mix(df).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 3)
    assert sorted(map(tuple, mixing.mix(df).collect())) == a
