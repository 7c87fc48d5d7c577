"""Null, repeated and hot ids, clashing names, and the plans beyond broadcast bounds."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from bracken.llm import common, decontam, langid, mixing, pii, preference, q08, rules, simhash, tokens

DOCS = "doc_id long, text string"


def test_the_sample_of_a_language_is_bounded_whatever_the_ids(spark):
    rows = [(None, f"abc abd {'a' * (i % 50)} {chr(97 + i % 26)}b{chr(97 + i // 26 % 26)}", "x") for i in range(20_000)] + [(7, "same text", "y")] * 3000
    df = spark.createDataFrame(rows, DOCS + ", lang string").repartition(8)
    got = Counter(langid.sample(df)[1])
    assert got["x"] <= langid.SAMPLE and got["x"] > 200 and got["y"] == 1
    assert langid.sample(df) == langid.sample(df.repartition(3))


def test_many_languages_share_the_sample(spark, monkeypatch):
    rows = [(i, f"{'abcdefghij'[i % 10] * 5} text {i}", f"l{i % 50}") for i in range(2000) if not 0 < i % 50 <= 2 or i < 500]
    df = spark.createDataFrame(rows, DOCS + ", lang string")
    monkeypatch.setattr(langid, "TEXTS", 120)
    monkeypatch.setattr(langid, "CHARACTERS", 600)
    texts, langs = langid.sample(df, languages=40)
    assert len(set(langs)) == 40 and max(Counter(langs).values()) <= 3 and sum(map(len, texts)) <= 600
    assert not {"l1", "l2"} & set(langs)  # those of the fewest texts


def test_null_ids_are_mixed_alike_in_every_run(spark):
    rnd = random.Random(4)
    rows = [(None, " ".join(rnd.choices("abcdef", k=rnd.randint(0, 6))), "hot") for _ in range(3000)] + [(i, "w " * (i % 9), rnd.choice(["hot", "b", None])) for i in range(900)]
    df = spark.createDataFrame(rows, DOCS + ", source string")
    runs = []
    for parts in (1, 5, 12):
        out = mixing.mix(df.repartition(parts)).collect()
        runs.append(Counter((r.doc_id, r.text, r.source, r.mix_copies) for r in out))
    assert runs[0] == runs[1] == runs[2]
    words = {s: sum(len((t or "").split()) for _, t, x in rows if x == s) for s in ("hot", "b", None)}
    taken = {s: sum(r.mix_size * r.mix_copies for r in out if r.source == s) for s in words}
    target = {r.source: r.mix_target for r in out}
    assert all(abs(taken[s] - target[s]) <= 12 for s in words) and sum(taken.values()) <= sum(words.values())


def test_a_hot_id_lies_in_many_slices(spark):
    df = spark.createDataFrame([(None, "a b", "s")] * 5000, DOCS + ", source string").repartition(4)
    placed = mixing._running(df.select(F.lit(1).alias("rank"), F.lit(2).alias("size"), F.monotonically_increasing_id().alias("row")), ["rank", "row"], ["size"], 256, ("rank",))
    got = placed.orderBy("_bk_seq").collect()
    assert [r._bk_to_size for r in got] == list(range(2, 10_001, 2))
    assert max(Counter(r._bk_seq >> 8 for r in got).values()) <= 256


def test_names_of_own_columns_survive(spark):
    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, text, "keep", "me"), (2, text + " other words here", "keep", "too"), (3, "bad", "x", "y")], DOCS + ", _bk_text string, _bk_hash string").withColumn("_bk_id", F.lit("id"))
    labels = spark.createDataFrame([], "doc_id long, quality int")
    items = spark.createDataFrame([(1, "bad")], "item_id long, text string")
    for out in (rules.accepted(df, labels), decontam.decontaminated(df, items), simhash.deduplicated(df)):
        got = out.collect()
        assert out.columns == df.columns and all(r["_bk_text"] in ("keep", "x") and r["_bk_id"] == "id" for r in got)
    assert sorted(r["_bk_hash"] for r in rules.accepted(df, labels).collect()) == ["me", "too"]
    twice = simhash.deduplicated(df.unionByName(df)).collect()
    assert Counter(r.doc_id for r in twice) == Counter(r.doc_id for r in simhash.deduplicated(df).collect())


def test_stages_keep_empty_tables(spark):
    df = spark.createDataFrame([], DOCS)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert rules.accepted(df, none).count() == decontam.decontaminated(df, spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")).count() == 0


def test_containment_beyond_the_broadcast_bounds(spark, monkeypatch):
    rnd = random.Random(9)
    vocab = [f"t{i}" for i in range(60)]
    items = [(i, " ".join(rnd.choices(vocab, k=rnd.randint(5, 40)))) for i in range(60)]
    every = " ".join(t for _, t in items)  # a long document with all items
    docs = [(d, " ".join(rnd.choices(vocab, k=30)) + " " + items[d % 60][1]) for d in range(80)] + [(100, every), (100, every), (None, every), (101, None)]
    d, i = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")
    a = Counter(decontam.contained(d, i).collect())
    for name in ("BROADCAST_SKETCH", "BROADCAST_SHINGLES", "BROADCAST_PARTS", "BROADCAST_ITEMS"):
        monkeypatch.setattr(decontam, name, 0)
    assert Counter(decontam.contained(d, i).collect()) == a and sum(r.doc_id == 100 for r in a) == 60


def test_the_undivided_ball_gives_the_same_groups(spark):
    rnd = random.Random(6)
    base = [rnd.choices("abcdefghijk", k=200) for _ in range(5)]
    rows = [(i, " ".join(w if rnd.random() > 0.01 else "zz" for w in base[i % 5])) for i in range(40)] + [(100, None)]
    df = spark.createDataFrame(rows, DOCS)
    a = Counter(map(tuple, simhash.near_duplicates(df).collect()))
    assert Counter(map(tuple, simhash.near_duplicates(df, blocks=1).collect())) == a


def test_turns_without_a_conversation_stand_alone(spark):
    rows = [(None, i % 3, "user" if i % 2 else None, f"t{i}") for i in range(50)] + [(2, 0, "user", "q"), (2, 1, "assistant", "r")]
    got = preference.every(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    alone = [r for r in got if r.conv_id is None]
    assert len(alone) == 50 and {r.status for r in alone} == {"no_id"} and {r.prompt for r in alone} == {f"<|{t[2] or 'unknown'}|>\n{t[3]}<|end|>\n" for t in rows[:50]}
    assert all((r.n_prefix, r.chosen, r.rejected) == (1, "", "") for r in alone)


def test_missing_sides_have_states_of_their_own(spark):
    turns = "array<struct<role:string,text:string>>"
    df = spark.createDataFrame([(1, [("user", "a")], None), (2, [], [("user", "a")]), (3, None, None)], f"pair_id int, chosen {turns}, rejected {turns}")
    assert {r.pair_id: r.status for r in preference.formatted(df).collect()} == {1: "chosen_only", 2: "rejected_only", 3: "identical"}


def test_equal_rows_lie_in_many_files(spark, tmp_path):
    df = spark.createDataFrame([(5, "the same text")] * 4000 + [(None, None), (4, "x"), (6, "y")], DOCS).repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tokens.write(df, str(tmp_path / "t"), q08.tokenizer_path())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = tokens.read(spark, str(tmp_path / "t")).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 4] + [5] * 4000 + [6]
    assert [r.start for r in got] == list(np.cumsum([0] + [r.n_tokens for r in got[:-1]]))
    assert spark.read.parquet(str(tmp_path / "t" / "data")).filter("doc_id = 5").select("part").distinct().count() > 1


@pytest.mark.parametrize("most", [1, 40, 1000])
def test_long_texts_in_parts(monkeypatch, most):
    from tokenizers import Tokenizer

    t, e = Tokenizer.from_file(q08.tokenizer_path()), tokens.Encoder(q08.tokenizer_path())
    monkeypatch.setattr(tokens, "AT_ONCE", most)
    rnd = random.Random(most)
    parts = ["word", " word", "  ", "\n\n", "it's", " they'll", "'", "12", "日本語", "。", "，", "é", ", ", "<|endoftext|>", " ", "ʼs"]
    texts = ["".join(rnd.choices(parts, k=rnd.randint(0, 80))) for _ in range(200)]
    assert e.encode(texts) == [np.array(x.ids, np.uint32).tobytes() for x in t.encode_batch(texts, add_special_tokens=False)]


def test_memory_of_pieces_is_bounded(monkeypatch):
    e = tokens.Encoder(q08.tokenizer_path())
    monkeypatch.setattr(tokens, "REMEMBER", 50)
    for i in range(20):
        e.encode([f"a{i} " + "x" * 1000 + " " + " ".join(f"w{i}q{j}" for j in range(10))])
        assert len(e.words) <= 100 and max(map(len, e.words.to_pylist())) <= tokens.PIECE


def test_untitled_names_and_numbers_of_persons(spark):
    rows = [(1, "call Alice Jones, ssn 123-45-6789; Jones said api_key=ab12 to Peter Brown"), (2, "Mrs Jones and 123-45-6789"), (3, "The Alice Band, 000-12-3456, 123-45-67890, Paris In Spring"), (4, "Malice Jones")]
    out = {r.doc_id: r for r in pii.replaced(spark.createDataFrame(rows, DOCS)).collect()}
    m = re.fullmatch(r"call (\w+) (\w+), ssn ((?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}); (\w+) said api_key=([a-z]{2}\d\d) to (\w+) (\w+)", out[1].text)
    assert m, out[1].text
    assert m[1] in pii.GIVEN["latin", "female"] and m[6] in pii.GIVEN["latin", "male"] and m[2] == m[4] != "Jones" and m[7] != "Brown" and m[3] != "123-45-6789" and m[5] != "ab12"
    assert out[2].text == f"Mrs {m[2]} and {m[3]}" and out[4].text == "Malice Jones"
    assert "000-12-3456" in out[3].text and "123-45-67890" in out[3].text and "Paris In Spring" in out[3].text


def test_keys(spark):
    df = spark.createDataFrame([(1, "mail some.one@mail.co")], DOCS)
    text = lambda key=None: pii.replaced(df, key=key).first().text
    assert text("a") == text("a") != text("b") and text() == text() not in (text("a"), text("surrogate-key"))
    spark.conf.set(pii.KEY_SETTING, "a")
    try:
        assert text() == text("a")
    finally:
        spark.conf.unset(pii.KEY_SETTING)


def test_met_without_a_broadcast(spark):
    left = spark.createDataFrame([(1, i) for i in range(50)] + [(None, 0), (2, 1)], "k int, v int")
    right = spark.createDataFrame([(1, "a"), (1, "b"), (3, "c")], "k int, w string")
    a, b = (Counter(map(tuple, common.met(left, right, "k", ["v"], n).select("k", "v", "w").collect())) for n in (10, 0))
    assert a == b and sum(a.values()) == 100
