"""op11, op12 and op13 against SQL, plain versions and the tokenizers library."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest

from bracken.llm import common, counts, peaks, q11, q12, q13, resample
from compare import connection, same


@pytest.mark.parametrize("q", [q11, q12])
def test_query_equals_sql(spark, sf, q):
    (name,) = q.QUERIES
    same(q.QUERIES[name](spark, sf), connection(sf), q.ORACLES[name])


# op11


def plain_peaks(rows):
    """(grp, moment, until, n_open, weight_open, high_open, is_peak) of changes by a walk over each group."""
    by = defaultdict(lambda: defaultdict(lambda: [0, 0]))
    for grp, moment, d, w in rows:
        by[grp][moment][0] += d
        by[grp][moment][1] += w
    out = []
    for grp, at in by.items():
        at = sorted((m, v) for m, v in at.items() if v != [0, 0])
        n = w = 0
        high, mine = None, []
        for i, (m, v) in enumerate(at):
            n, w = n + v[0], w + v[1]
            high = n if high is None else max(high, n)
            mine.append((grp, m, at[i + 1][0] if i + 1 < len(at) else None, n, w, high))
        out += [(*r, r[3] == high) for r in mine]
    return sorted(out, key=str)


@pytest.mark.parametrize("block, readers", [(64, 4096), (1, 4096), (4, 2), (1, 1)])
def test_changes_of_any_order(spark, monkeypatch, block, readers):
    """Trees to any depth and with many copies of a cell; groups of one moment, negative moments, a far one."""
    monkeypatch.setattr(peaks, "READERS", readers)
    rnd = random.Random(block)
    rows = [(rnd.choice([1, 1, 1, 2, -1]), rnd.randrange(-300, 600), rnd.choice([1, -1]), rnd.randrange(-5, 6)) for _ in range(900)]
    rows += [(7, 5000, 1, 3), (8, 1, 1, 2), (8, 1, -1, -2), (9, -299, -1, 0), (1, 123_456, 1, 1)]
    df = spark.createDataFrame(rows, "grp int, moment long, d_open long, d_weight long")
    assert sorted(map(tuple, peaks.concurrency(df, block).collect()), key=str) == plain_peaks(rows)


def shop(spark, sales, lines, clients):
    s = spark.createDataFrame(sales, "sale_id long, client_id long, total double, sold_at timestamp_ntz, grp string, start long")
    n = spark.createDataFrame(lines, "sale_id long, shipped_at timestamp_ntz, end long")
    c = spark.createDataFrame(clients, "key long, grp int")
    return peaks.concurrency(peaks.changes(peaks.open_sales(s, n), c))


def test_broken_sales_and_clashing_names(spark):
    t = datetime(2024, 1, 1)
    minute = int((t - datetime(1970, 1, 1)).total_seconds()) // 60
    sales = [
        (1, 10, 1.005, t, "x", 1), (1, 10, 1.005, t, "x", 1),  # repeated: counts twice
        (2, None, None, t + timedelta(seconds=59), "x", 1),  # no client, no total
        (None, 11, 2.5, t, None, None), (None, 11, 2.5, t, None, None),  # no id: never ends
        (3, 12, 5.0, None, "x", 1), (4, 12, 5.0, t + timedelta(days=30), "x", 1),  # no start; ends before it starts
        (5, 99, float("nan"), t, "x", 1), (6, 10, float("inf"), datetime(1960, 1, 1), "x", 1),
    ]
    lines = [(1, t, 0), (1, t + timedelta(days=1, seconds=30), 0), (1, None, 0), (None, t, 0), (4, t, 0), (77, t, 0)]
    clients = [(10, 3), (11, None), (None, 8), (12, 4)]
    end = minute + 8 * 1440
    old = int((datetime(1960, 1, 1) - datetime(1970, 1, 1)).total_seconds()) // 60
    plain = [(3, minute, 2, 200), (3, end, -2, -200), (-1, minute, 1, 0), (-1, minute, 2, 500), (-1, minute, 1, 0), (3, old, 1, 0)]
    want = plain_peaks(plain + [(-2, *r[1:]) for r in plain])
    assert sorted(map(tuple, shop(spark, sales, lines, clients).collect()), key=str) == want
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert sorted(map(tuple, shop(spark, sales, lines, clients).collect()), key=str) == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.mark.parametrize("lines, clients", [([], []), ([(1, datetime(2024, 1, 1), 0)], [(10, 3)])])
def test_no_sales_or_nothing_else(spark, lines, clients):
    assert shop(spark, [], lines, clients).count() == 0
    assert len(shop(spark, [(1, 10, 1.0, datetime(2024, 1, 1), "x", 1)], lines, clients).collect()) == (4 if lines else 2)


# op12


def plain_draw(docs, target, grams=1, buckets=10_000, min_words=20, percent=10, seed=2024):
    low = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    keep = lambda b: 48 <= b <= 57 or 97 <= b <= 122 or b >= 128

    def words(t):
        return bytes(b if keep(b) else 32 for b in (t or "").encode().translate(low)).split()

    def grams_of(t):
        w = words(t)
        return Counter(b" ".join(w[i : i + n]) for n in range(1, grams + 1) for i in range(len(w) - n + 1))

    s, t = Counter(), Counter()
    for into, texts in ((s, [d[1] for d in docs]), (t, target)):
        for x in texts:
            for f, k in grams_of(x).items():
                into[zlib.crc32(f) % buckets] += k
    S, T = s.total(), t.total()
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in s}
    out = []
    for i, x in docs:
        f = grams_of(x)
        weight = sum(k * gain[zlib.crc32(g) % buckets] for g, k in f.items()) // f.total() if f else 0
        h = int(hashlib.sha256(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(words(x)), f.total(), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = able[: len(able) * percent // 100]
    return sorted((tuple(r) + (next((k + 1 for k, d in enumerate(drawn) if d is r), None),) for r in out), key=str)


def texts():
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(60)] + ["Été", "日本", "ÀB", "it's", "A_b", "x" * 5000]
    return [(i, " ".join(rnd.choice(words) for _ in range(rnd.randrange(60)))) for i in range(120)]


@pytest.mark.parametrize("head", [0, 3000, 8 << 20])
@pytest.mark.parametrize("grams", [1, 3])
def test_draw_with_any_head(spark, monkeypatch, head, grams):
    """All features shuffled, some, none; batches handed on in pieces; ties of repeated ids; null ids and texts."""
    monkeypatch.setattr(resample, "HELD", 7)
    docs = texts() + [(None, "w1 " * 30), (3, "w2 " * 25), (200, None), (201, ""), (202, " .,; "), (5, texts()[5][1])]
    target = ["w1 w2 w3 w1", None, "", "日本 ÀB only here"]
    df = spark.createDataFrame([(*d, "no") for d in docs], "doc_id long, text string, weight string").repartition(3).cache()
    t = spark.createDataFrame([(x,) for x in target], "text string")
    got = resample.resampled(df, t, grams=grams, percent=30, head=head).collect()
    want = plain_draw(docs, target, grams, percent=30)
    assert sorted(map(tuple, got), key=str) == want
    df.unpersist()


def test_draw_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b " * 20)], "doc_id long, text string")
    assert resample.resampled(empty, some).count() == 0
    (r,) = resample.resampled(some, empty, percent=100).collect()
    assert tuple(r) == plain_draw([(1, "a b " * 20)], [], percent=100)[0] and r["rank"] == 1


# op13


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(q13.tokenizer_path())


def test_counts_are_the_librarys(spark, sf, library):
    text = {r.doc_id: r.text or "" for r in common.table(spark, sf, "documents").collect()}
    for r in q13.op13_token_counts(spark, sf).collect():
        n = len(library.encode(text[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text[r.doc_id].encode()), n, n > 2048)


def test_counts_of_odd_texts(spark, library):
    rnd = random.Random(2)
    pool = [chr(c) for c in [*range(0x250), *range(0x370, 0x530), *range(0x1E00, 0x2100), *range(0x3000, 0x3100), 0x4E2D, 0xAC00, 0x1F600, 0x1D400, 0x301, 0x308, 0x1100, 0x1161]]
    odd = ["".join(rnd.choice(pool) if rnd.random() < 0.5 else rnd.choice(" a'sStTrRleLvVmMdD1é,.<|endoftext|>") for _ in range(rnd.randrange(1, 15))) for _ in range(3000)]
    odd += ["", " \n\t ", "<|endoftext|>", "a<|startoftext|>b <|endoftext|><|endoftext|>", "<|endoftext", "ΑΣ ας ΣΑΣ İ ﬁ K", "é ä́", "x" * 20_000, "日本" * 3000, "\x00\x1f\x85\x1c"]
    df = spark.createDataFrame([(i, t, -1) for i, t in enumerate(odd)] + [(None, None, -1)], "id long, body string, N_TOKENS int")
    got = counts.counted(df, q13.tokenizer_path(), "body").collect()
    assert set(got[0].asDict()) == {"id", "body", "n_bytes", "n_tokens", "over_limit"}
    for r in got:
        assert r.n_tokens == len(library.encode(r.body or "", add_special_tokens=False).ids), r.body
        assert r.n_bytes == len((r.body or "").encode())
    assert counts.counted(df.limit(0), q13.tokenizer_path(), "body").count() == 0


def test_merging_is_that_of_the_lowest_rank_first(monkeypatch):
    """Against merging by a scan for the lowest pair, with a memory that is always full."""
    monkeypatch.setattr(counts, "REMEMBER", 3)
    c = counts.Counter(q13.tokenizer_path())
    rnd = random.Random(3)
    for _ in range(300):
        word = "".join(rnd.choice("aeinorst") for _ in range(rnd.randrange(1, 30)))
        s = [c.number[x] for x in word]
        s[-1] = c.number[word[-1] + "</w>"]
        while found := min(((c.pairs[p][0], i) for i, p in enumerate(zip(s, s[1:])) if p in c.pairs), default=None):
            i = found[1]
            s[i : i + 2] = [c.pairs[(s[i], s[i + 1])][1]]
        assert c[word] == len(s)
    assert len(c) <= 3
