"""The approximate index, the similarity join and many patterns against brute force."""

import random

import numpy as np
import pytest

from bracken.operators import cosine, ivf, patterns, vector


def frame(spark, v, start=0):
    return spark.createDataFrame([(start + i, [float(y) for y in x]) for i, x in enumerate(v)], "vec_id long, embedding array<float>")


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((30, 32))
    v = centres[rng.integers(0, 30, 3000)] + 0.4 * rng.standard_normal((3000, 32))
    return np.round(v, 3).astype(np.float32)


def nearest(v, q, k):
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    s = np.round(u[q] @ u.T, 6)
    s[np.arange(len(q)), q] = -9
    return {(i, j) for r, i in enumerate(q) for j in np.lexsort((np.arange(len(v)), -s[r]))[:k]}


def test_index_finds_nine_of_ten(spark, clustered):
    """Clusters probe few lists; each found score is exact; invalid rows are left out; a second search of the same index agrees."""
    df = frame(spark, clustered).unionByName(spark.createDataFrame([(9001, None), (9002, [0.0] * 32), (9003, [float("nan")] * 32), (9004, [1.0])], "vec_id long, embedding array<float>")).cache()
    index = ivf.build(df)
    assert index.model.probe < len(index.model.centroids) and index.vectors.count() == 3000
    q = list(range(0, 3000, 20))
    asked = df.filter("vec_id % 20 = 0 OR vec_id > 9000")
    got = ivf.search(index, asked).collect()
    want = nearest(clustered, q, 10)
    assert len({(r.query_id, r.doc) for r in got} & want) >= 0.9 * len(want) and len(got) == len(want)
    u = clustered.astype(float) / np.linalg.norm(clustered.astype(float), axis=1, keepdims=True)
    assert all(abs(r.score - u[r.query_id] @ u[r.doc]) < 2e-6 for r in got)
    exact = vector.topk(frame(spark, clustered), frame(spark, clustered).filter("vec_id % 20 = 0"), 10)
    assert ivf.recall(spark.createDataFrame(got), exact) >= 0.9
    all_lists = ivf.search(index, asked, probe=len(index.model.centroids), rerank=300)
    assert {(r.query_id, r.doc) for r in all_lists.collect()} == want


def test_index_of_the_given_vectors(spark, sf):
    """Vectors without clusters: the number of lists that are probed follows from the sample."""
    v = spark.read.parquet(f"{sf}/embeddings.parquet")
    q = v.filter("vec_id % 20 = 0")
    assert ivf.recall(ivf.search(ivf.build(v), q), vector.topk(v, q, 10)) >= 0.9


def test_index_of_little(spark):
    assert ivf.build(frame(spark, [])) is None and ivf.fit(frame(spark, [[0.0, 0.0]])) is None
    few = frame(spark, [[1, 0], [0.9, 0.1], [0, 1]])
    assert sorted((r.query_id, r.doc, r["rank"]) for r in ivf.search(ivf.build(few), few.filter("vec_id = 0"), 5).collect()) == [(0, 1, 0), (0, 2, 1)]


@pytest.mark.parametrize("hot", [2000, 3])
def test_links_of_near_vectors(spark, monkeypatch, hot):
    """Copies are one representative; near ones are found with the wanted recall, hot buckets cut or not."""
    monkeypatch.setattr(cosine, "HOT", hot)
    rng = np.random.default_rng(8)
    base = rng.standard_normal((120, 24))
    near = base[:60] + 0.25 * rng.standard_normal((60, 24))
    v = np.concatenate([base, near, base[:20], np.repeat(base[:1], 30, axis=0)]).astype(np.float32)
    df = frame(spark, v).unionByName(spark.createDataFrame([(900, [0.0] * 24), (901, None)], "vec_id long, embedding array<float>"))
    pairs, members = cosine.links(df, 0.85)
    u = v[:180].astype(float) / np.linalg.norm(v[:180].astype(float), axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    want = {(i, j): s[i, j] for i in range(180) for j in range(i + 1, 180) if s[i, j] >= 0.85}
    got = {(r.a, r.b): r.score for r in pairs.collect()}
    assert set(got) <= set(want) and len(got) >= 0.9 * len(want) > 20
    assert all(abs(got[p] - want[p]) < 2e-6 for p in got)
    m = {(r.rep, r.id) for r in members.collect()}
    assert m == {(i, i) for i in range(180)} | {(i, 180 + i) for i in range(20)} | {(0, 200 + i) for i in range(30)}


def test_bands_reach_their_recall(spark):
    """Pairs at exactly the least similarity."""
    rng = np.random.default_rng(9)
    a = rng.standard_normal((400, 16))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal((400, 16))
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    c = 0.9001 * a + np.sqrt(1 - 0.9001**2) * b
    pairs, _ = cosine.links(frame(spark, np.concatenate([a, c])), 0.9, recall=0.95)
    assert sum(r.b == r.a + 400 for r in pairs.collect()) >= 0.9 * 400


def test_cache_matches(spark):
    v = np.random.default_rng(1).standard_normal((40, 16)).astype(np.float32)
    cached = frame(spark, np.concatenate([v, v[:5]]))
    asked = frame(spark, np.concatenate([v[:10] + 0.01, -v[20:25]]), 100)
    got = sorted((r.query_id, r.hit) for r in cosine.matches(asked, cached, 0.92).collect())
    assert got == [(100 + i, i) for i in range(10)]
    assert cosine.matches(asked, cached.limit(0), 0.92).count() == 0


@pytest.mark.parametrize("within", [None, ["g"]])
def test_blocks_of_queries_meet_blocks_of_vectors(spark, monkeypatch, clustered, within):
    df = frame(spark, clustered[:400]).selectExpr("vec_id", "embedding", "vec_id % 3 AS g")
    q = df.filter("vec_id % 4 = 0")
    key = lambda d: sorted(map(tuple, d.collect()))
    want = key(vector.topk(df, q, 5, within=within))
    monkeypatch.setattr(vector, "QUERY_BLOCK", 32)
    monkeypatch.setattr(vector, "VECTOR_BLOCK", 64)
    assert key(vector.topk(df, q, 5, within=within)) == want and len(want) == 500


@pytest.mark.parametrize("bound", [64 << 20, 400])
def test_all_hits(spark, monkeypatch, bound):
    """One automaton, or many that meet slices of the texts."""
    monkeypatch.setattr(patterns, "SLICE", 500)
    rnd = random.Random(bound)
    words = sorted({"".join(rnd.choice("ab日") for _ in range(rnd.randrange(1, 6))) for _ in range(25)} | {"😀a", "\0"})
    texts = [(i, "".join(rnd.choice("ab日😀x\0") for _ in range(rnd.randrange(0, 80)))) for i in range(60)] + [(60, None), (61, ""), (5, "abab")]
    df = spark.createDataFrame(texts, "doc_id int, text string")
    p = spark.createDataFrame([(w,) for w in words + [None, "", words[0]]], "pattern string")
    assert (patterns.parts(p.filter("pattern <> ''").distinct(), bound) > 1) == (bound == 400)
    got = sorted(map(tuple, patterns.hits(df, p, bound=bound).collect()))
    assert got == sorted((i, w, k) for i, t in texts if t for w in words for k in range(len(t)) if t.startswith(w, k))
    assert patterns.hits(df, p.limit(0)).count() == 0 and patterns.hits(df.limit(0), p).count() == 0


def test_all_lists_are_exact_where_codes_are_equal(spark):
    """3,000 vectors differ by less than their codes tell: candidates by code would be drawn among equals."""
    import numpy as np

    rng = np.random.default_rng(3)
    base = rng.normal(size=16)
    rows = [(i, [float(x) for x in base + rng.normal(size=16) * 0.004]) for i in range(3000)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    key = lambda df: sorted((r.query_id, r["rank"], r.doc, r.score) for r in df.collect())
    q = v.filter("vec_id % 300 = 0")
    assert key(ivf.search_all(ivf.build(v, sample=200), q)) == key(vector.topk(v, q, 10))


def test_queries_are_copied_in_bounded_batches():
    import numpy as np
    import pyarrow as pa

    v = np.eye(8)[np.arange(3000) % 8]
    model = ivf.Model(np.random.default_rng(1).normal(size=(500, 8)), np.zeros((8, 256, 1)), 400, 1.0)
    batches = list(ivf._copies(model, pa.array(np.arange(3000)), v, 400))
    assert sum(b.num_rows for b in batches) == 3000 * 400 and max(b.num_rows for b in batches) <= ivf.COPIES
