import base64
import json
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from bracken.operators import dedup, rerank
from bracken.sources import files, markdown, sinks


def test_scan_and_decode(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.txt").write_bytes("荣格".encode("gb18030"))
    (tmp_path / "y.md").write_text("# t", encoding="utf-8")
    (tmp_path / "z.docx").write_bytes(b"1")
    (tmp_path / ".hidden.txt").write_bytes(b"1")
    found, skipped = files.scan(spark, str(tmp_path))
    got = {r.ext: r.t for r in found.select("ext", files.decoded(F.col("content")).alias("t")).collect()}
    assert got == {".txt": "荣格", ".md": "# t"}
    assert [tuple(r) for r in skipped.collect()] == [(".docx", 1)]
    ok, bad = files.accepted(found, 3)
    assert ok.count() == 1 and [r.reason for r in bad.collect()] == ["size"]


def test_note_and_lorebook():
    n = files.note("---\nname: A\n---\nintro\n## One\nx\n## Two\ny\nz")
    assert n == {"head": {"name": "A"}, "sections": {"": "intro", "One": "x", "Two": "y\nz"}}
    assert files.lorebook("cat: a: b\n  more\n：x\ndog：d\nbad") == [{"keyword": "cat", "content": "a: b\nmore"}, {"keyword": "dog", "content": "d"}]
    assert files.lorebook('[{"keyword": "k", "content": "c"}, {"keyword": ""}]') == [{"keyword": "k", "content": "c"}]


def png(kind, key, text):
    body = key.encode() + b"\0" + (b"\0" + zlib.compress(text) if kind == b"zTXt" else text)
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I4s", len(body), kind) + body + b"\0\0\0\0"


@pytest.mark.parametrize("kind", [b"tEXt", b"zTXt"])
def test_cards(kind):
    raw = base64.b64encode(json.dumps({"name": " N ", "role": "r", "lorebook": [{"keyword": "k", "content": "c"}, 3]}).encode())
    assert files.card(png(kind, "chara", raw)) == {"name": "N", "role": "r", "background": "", "lorebook": [{"keyword": "k", "content": "c"}]}
    assert files.card(png(kind, "other", raw)) is None and files.card(b"no") is None


def test_markdown():
    text = "# A\npara\nmore\n\n- x\n- y\n\n| a |\n| b |\n```py\ndef f(): pass\n```\nend"
    kinds = [(e["kind"], e["content"]) for e in markdown.elements(text)]
    assert kinds == [("heading", "A"), ("paragraph", "para\nmore"), ("list", "- x\n- y"), ("table", "| a |\n| b |"), ("paragraph", "end"), ("code", "def f(): pass")]
    assert [e["kind"] for e in markdown.elements(text, code_last=False)][-2:] == ["code", "paragraph"]


def test_definitions(spark):
    df = spark.createDataFrame([("class A:\n  def f(self):\n    pass\nfunction g() {}",)], "c string")
    assert df.select(markdown.definitions(F.col("c"))).first()[0] == ["A", "f", "g"]


def test_overwrite_checks_first(spark, tmp_path):
    path = str(tmp_path / "c")
    a = spark.createDataFrame([("x", 1), ("y", 2)], "collection string, v int")
    sinks.overwrite(a, path)
    with pytest.raises(ValueError):
        sinks.overwrite(spark.createDataFrame([("x", None)], "collection string, v int"), path, F.col("v").isNotNull())
    sinks.overwrite(spark.createDataFrame([("x", 5)], "collection string, v int"), path)
    assert sorted((r.collection, r.v) for r in spark.read.parquet(path).collect()) == [("x", 5), ("y", 2)]
    new = spark.createDataFrame([("y", 9)], "collection string, v int")
    assert sorted(r.v for r in sinks.merged(a, new, ["collection"]).collect()) == [1, 9]


def test_shallowest_path_stays(spark):
    f = spark.createDataFrame([("a/b/c.txt", "1"), ("z/c.txt", "1"), ("y/c.txt", "1"), ("q.txt", "2")], "path string, sha string")
    assert {r.path: r.keeper for r in dedup.shallowest(f).collect()} == {"a/b/c.txt": "y/c.txt", "z/c.txt": "y/c.txt", "y/c.txt": "y/c.txt", "q.txt": "q.txt"}


def test_cross_format(spark):
    rows = [(1, "红书（扫描版）", ".pdf", 200, 200_000), (2, "红书", ".txt", 0, 150_000), (3, "金花", ".pdf", 200, 200_000), (4, "金花", ".txt", 0, 50_000), (5, "哲学树", ".pdf", 50, 200_000), (6, "哲学树", ".txt", 0, 190_000)]
    got = {r.file_id: r.dropped for r in dedup.cross_format(spark.createDataFrame(rows, "file_id int, stem string, ext string, pages int, chars long")).collect()}
    assert [k for k, v in got.items() if v] == [1]


def test_rerank_and_embedding_cache(spark):
    p = spark.createDataFrame([("q", "a"), ("q", "bb"), ("q", "bb"), ("r", "c")], "query string, text string")
    got = {(r.query, r.text): r.rerank for r in rerank.scored(p, lambda q, t: [float(len(x)) for x in t]).collect()}
    assert got == {("q", "a"): 1.0, ("q", "bb"): 2.0, ("r", "c"): 1.0}
    t = spark.createDataFrame([(1, "x"), (2, "y")], "id int, text string")
    cache = t.filter("id = 1").select(rerank.cache_key("v", "m", F.col("text")).alias("key"), F.array(F.lit(9.0).cast("float")).alias("vec"))
    got = {r.id: list(r.vec) for r in rerank.embedded(t, cache, lambda x: [[1.0]] * len(x), "v", "m").collect()}
    assert got == {1: [9.0], 2: [1.0]}


def test_a_write_for_an_old_version_is_refused(spark, tmp_path, monkeypatch):
    """Two writers read one version; one wins, the other reads again. A writer that passes the first look loses at the marker."""
    import pytest
    from pyspark.sql import functions as F

    from bracken.sources import sinks

    at = str(tmp_path / "t")
    assert sinks.current(spark, at) == (0, None)
    assert sinks.replace_if(spark.range(3), at, 0) == 1
    version, rows = sinks.current(spark, at)
    assert sinks.replace_if(rows.select(F.col("id") + 10), at, version) == 2
    with pytest.raises(sinks.Conflict):
        sinks.replace_if(rows.limit(1), at, version)
    assert rows.count() == 3  # readers keep what they read
    found = sinks._versions
    monkeypatch.setattr(sinks, "_versions", lambda *a: (*found(*a)[:2], ["000000001"]))
    with pytest.raises(sinks.Conflict):
        sinks.replace_if(rows, at, 1)
    monkeypatch.undo()
    version, rows = sinks.current(spark, at)
    assert version == 2 and sorted(r[0] for r in rows.collect()) == [10, 11, 12]
    assert len(list((tmp_path / "t").glob("rows-*"))) == 2
