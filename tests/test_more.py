"""Sources, sinks and evidence of the remaining operators."""

import json
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from bracken.operators import fusion, graph, meeting, pages, usage
from bracken.plans import registry
from bracken.sources import files, sinks
from compare import same


def test_readers_are_tried_in_order(spark, tmp_path):
    for name, content in (("a.pdf", b"two pages"), ("b.pdf", b"broken"), ("c.pdf", b" ")):
        (tmp_path / name).write_bytes(content)
    found, _ = files.scan(spark, str(tmp_path))

    def first(raw):
        if raw == b"broken":
            raise ValueError("not mine")
        return raw.decode().split()

    got = {(r.path.rsplit("/", 1)[1], r.page): (r.text, r.reader, r.warning) for r in files.cascade(found, [first, lambda raw: ["by the second" if raw.strip() else " "]]).collect()}
    assert got == {("a.pdf", 1): ("two", 0, None), ("a.pdf", 2): ("pages", 0, None), ("b.pdf", 1): ("by the second", 1, None), ("c.pdf", None): (None, None, "no_text_extracted")}


def test_scan_leaves_hidden_names_out(spark, tmp_path):
    (tmp_path / "in" / ".git").mkdir(parents=True)
    for name in ("in/a.PDF", "in/b.md", "in/.c.md", "in/.git/d.md", "in/e.docx", "in/f"):
        (tmp_path / name).write_text("x")
    kept, skipped = files.scan(spark, str(tmp_path / "in"))
    assert sorted(r.path.rsplit("/", 1)[1] for r in kept.collect()) == ["a.PDF", "b.md"]
    assert {r.ext: r.n for r in skipped.collect()} == {".docx": 1, "": 1}


def test_a_collection_is_read_alone(spark, tmp_path):
    rows = spark.createDataFrame([("a", i) for i in range(5)] + [("b", 9)], "collection string, id int")
    sinks.overwrite(rows, str(tmp_path / "c"))
    assert [r.id for r in files.collection(spark, str(tmp_path / "c"), "a", 3).collect()] == [0, 1, 2]
    assert files.collection(spark, str(tmp_path / "c"), "b").count() == 1


def test_a_malformed_graph_is_none(spark, tmp_path):
    good = {"entities": {"x": {"name": "X", "type": "person", "freq": 2}}, "relations": [{"h": "x", "r": "r", "t": "y", "w": 1, "e": "ev"}]}
    for name, text in (("good", json.dumps(good)), ("bad", json.dumps(good)[:-5]), ("other", "[1, 2]"), ("empty", "")):
        (tmp_path / name).write_text(text)
    ents, rels = files.graph(spark, str(tmp_path / "good"))
    assert [tuple(r) for r in ents.collect()] == [("x", "X", "person", 2)] and rels.first().t == "y"
    assert all(files.graph(spark, str(tmp_path / n)) is None for n in ("bad", "other", "empty", "missing"))


def test_publish_replaces_at_once(spark, tmp_path):
    at = str(tmp_path / "t")
    for n in (3, 5):
        sinks.publish(spark.range(n), at)
        assert spark.read.parquet(at).count() == n
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["t"]


def test_a_stream_resumes_from_its_cursor(spark, tmp_path):
    from bracken.streaming.run import drained

    spark.range(3).write.parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    assert drained(spark, source(), at=str(tmp_path / "s")).count() == 3
    spark.range(10, 12).write.mode("append").parquet(str(tmp_path / "in"))
    assert sorted(r.id for r in drained(spark, source(), at=str(tmp_path / "s")).collect()) == [0, 1, 2, 10, 11]


def test_evidence_is_added_once(spark):
    schema = "query_id int, pos int, doc int, text string"
    results = spark.createDataFrame([(1, 0, 5, "five"), (1, 1, 6, "six")], schema)
    evidence = spark.createDataFrame([(1, 0, 7, "five"), (1, 1, 8, "eight"), (1, 2, 9, "eight"), (2, 0, 5, "five")], schema)
    got = sorted((r.query_id, r.pos, r.doc, r.inferred) for r in fusion.with_evidence(results, evidence).collect())
    assert got == [(1, 0, 5, False), (1, 1, 6, False), (1, 2, 8, True), (2, 0, 5, True)]


def test_modes(spark):
    board = "query_id int, doc int, rank int, score double"
    near = spark.createDataFrame([(1, i, i, 1 - i / 10) for i in range(8)], board)
    words = spark.createDataFrame([(1, 9 - i, i, 5.0 - i) for i in range(5)], board)
    docs = spark.createDataFrame([(i, f"s{i}", f"text {i}") for i in range(9)], "doc int, source string, text string")
    q = spark.createDataFrame([(1, "text 8")], "query_id int, query string")
    run = lambda mode, *b: {r.doc: r for r in fusion.retrieved(mode, q, docs, *b).collect()}
    assert sorted(run("vector_only", near, words)) == list(range(6))
    full = run("full", near, words)
    assert len(full) == 6 and {r.mode for r in full.values()} == {"hybrid"} and {r.mode for r in run("full", None, words).values()} == {"lexical_only"}
    assert 9 in run("full", None, words) and run("full", None, words)[9].source == ""  # without metadata it stays
    t = fusion.trace(fusion.retrieved("full", q, docs, near, words)).collect()
    assert {r.doc: r["rank"] for r in t} == {d: r["rank"] for d, r in full.items()} and sum(r.anchor for r in t) == 3
    with pytest.raises(ValueError):
        fusion.retrieved("other", q, docs, near, words)
    assert fusion.depths() == (10, 20) and fusion.depths(12) == (12, 24) and fusion.depths(3, False) == (3, 6)


def test_a_page_of_margins_keeps_them(spark):
    rows = [(1, 1, 0, 1.0, 100.0, 10.0, "head"), (1, 1, 1, 50.0, 100.0, 10.0, "body"), (1, 2, 0, 1.0, 100.0, 10.0, "alone"), (1, 2, 1, 99.0, 100.0, 10.0, "12"), (1, 3, 0, 2.0, 100.0, 10.0, "x" * 31), (1, 3, 1, 3.0, 0.0, 10.0, "no height")]
    got = pages.body_lines(spark.createDataFrame(rows, "doc int, page int, pos int, y double, height double, size double, text string"))
    assert sorted((r.page, r.pos) for r in got.collect()) == [(1, 1), (2, 0), (3, 0), (3, 1)]


def test_only_the_start_of_a_run_aborts_it(spark):
    rows = [(1, i, 0) for i in range(7)] + [(2, 0, 0), (2, 1, 3)] + [(2, i, 0) for i in range(2, 12)] + [(3, i, 0) for i in range(4)]
    got = {r.run: r.stopped_at for r in graph.aborts(spark.createDataFrame(rows, "run int, ord int, n_triples int")).collect()}
    assert got == {1: 4, 2: None, 3: None}


def test_summaries_know_their_speakers(spark):
    schema = "run int, names array<string>, clashes array<struct<a:string,b:string,point:string>>, positions array<struct<name:string,stance:string>>, open array<string>, closing string, applications array<struct<name:string,scenario:string,application:string>>"
    row = (1, ["A", "B"], [("A", "B", "p"), ("A", "A", "p"), ("A", "C", "p"), ("A", "B", "谁赢")], None, None, None, [("A", "s", " "), ("A", "s" * 400, "u")])
    df = spark.createDataFrame([row, (2, None, [("X", "Y", "p")], None, ["胜出", " a\nb "], "x" * 900, None)], schema)
    one, two = meeting.summaries(df).orderBy("run").collect()
    assert [tuple(c) for c in one.clashes] == [("A", "B", "p")] and len(one.applications[0].scenario) == 300 and len(one.applications) == 1 and "发言" in one.closing
    assert [tuple(c) for c in two.clashes] == [("X", "Y", "p")] and two.open == ["a b"] and len(two.closing) == 800


def test_last_pairs_go_if_they_are_meant(spark):
    p = spark.createDataFrame([(c, t, f"q{t}", "a") for c in (1, 2, 3, 4) for t in (0, 2)], "conv_id int, turn int, question string, answer string")
    e = spark.createDataFrame([(1, "q2"), (2, "q0"), (3, None)], "conv_id int, expected string")
    assert sorted((r.conv_id, r.turn) for r in usage.popped(p, e).collect()) == [(1, 0), (2, 0), (2, 2), (3, 0), (4, 0), (4, 2)]


def test_lookups_reach_the_scan(spark, tmp_path):
    spark.range(100).withColumn("s", F.lit("a")).write.parquet(str(tmp_path / "t"))
    rows = usage.lookup(spark.read.parquet(str(tmp_path / "t")), {"s": "a"}, "id", F.lit(10), F.lit(20))
    plan = rows._jdf.queryExecution().toString()
    assert rows.count() == 10 and "GreaterThanOrEqual(id,10)" in plan and "EqualTo(s,a)" in plan


def test_keyed_state_lasts_over_triggers_and_expires(spark, tmp_path):
    from bracken.operators import limits
    from bracken.streaming import keyed
    from bracken.streaming.run import drained

    schema = "user_id long, event_id long, t double"
    rows = [(u, 100 * u + i, 40.0 * i + u) for u in (1, 2) for i in range(30)] + [(3, 900, 5.0), (3, 901, 400_000.0)]
    parts = [[r for r in rows if r[2] < 500], [r for r in rows if 500 <= r[2] < 2000], [r for r in rows if r[2] >= 2000]]
    for make, plan in ((lambda: limits.FixedWindow(1, 9), lambda e: keyed.limited(e, 1, 9, "1 minute")), (lambda: limits.SlidingLog(1), lambda e: keyed.limited_sliding(e, 1, "1 minute")), (lambda: limits.AnswerCache(100.0), lambda e: keyed.first_answers(e, 100.0, "1 minute"))):
        at = tmp_path / str(len(list(tmp_path.iterdir())))
        for part in parts:
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(at / "in"))
            got = drained(spark, plan(spark.readStream.schema(schema).parquet(str(at / "in"))), at=str(at / "s"))
        want = limits.limited(spark.createDataFrame(rows, schema), make)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("name", ["page_lines", "page_elements"])
def test_pages_of_large_part_keys(spark, sf, tmp_path, name):
    """Keys of seven digits: what SQL takes for a page number is one here too."""
    spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_quantity", "l_partkey", "l_suppkey").limit(900).withColumn("l_partkey", F.col("l_partkey") + 1_200_000).toPandas().to_parquet(tmp_path / "lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet')")
    same(registry.queries()[name](spark, str(tmp_path)), con, registry.oracle_sql()[name])


def test_work_of_small_rows_is_dealt_over_the_cores(spark, sf):
    """A table of one file: what is made of its rows is made in many tasks."""
    for name in ("meeting_summary", "code_bodies"):
        assert registry.queries()[name](spark, sf).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_a_text_of_a_summary_is_flattened_once(spark):
    """One trim for each of the nine kinds of text in arrays, and three for the closing; not one for each condition."""
    text = "struct<a:string,b:string,point:string>"
    df = spark.createDataFrame([], f"run long, names array<string>, clashes array<{text}>, positions array<struct<name:string,stance:string>>, open array<string>, closing string, applications array<struct<name:string,scenario:string,application:string>>")
    plan = meeting.summaries(df)._jdf.queryExecution().analyzed().toString()
    assert plan.count("btrim(") + plan.count("BTrim") <= 12


def test_mentions_are_aggregated_by_hash_before_keys_are_made(spark):
    """Equal names are one row before their key is made and before strings are compared; types, ties and spellings as ever."""
    rows = [(1, "Ann", "", "knows", "Bo", "person"), (2, "ann", "person", "knows", "BO", "cat"), (3, "Ann", "cat", "sees", "bo", "cat"), (4, "x", "", "is", "x", "")]
    df = spark.createDataFrame(rows, "ord long, h string, ht string, r string, t string, tt string")
    got = sorted(map(tuple, graph.entities(df).select("key", "name", "freq", "type").collect()))
    assert got == [("ann", "Ann", 3, "person"), ("bo", "Bo", 3, "cat"), ("x", "x", 2, "")]
    plan = graph.entities(df)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "keys=[name" in plan and "SortAggregate(key=[name" not in plan


def test_texts_of_the_union_are_not_shuffled(spark, sf):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = registry.queries()["evidence_union"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert re.search(r"BroadcastHashJoin \[doc#", plan) and not re.search(r"SortMergeJoin \[doc#", plan)
