"""Folders of notes and cards: round trips, commits, ranges of ids."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from bracken.sources import folders


@pytest.fixture(scope="module", autouse=True)
def known(spark):
    folders.register(spark)


def saved(df, path, kind="bracken_notes", mode="append"):
    df.write.format(kind).mode(mode).save(str(path))
    return df.sparkSession.read.format(kind).load(str(path))


def numbered(spark, first, end):
    return spark.range(first, end, 1, 2).select("id", F.create_map(F.lit("n"), F.col("id").cast("string")).alias("head"), F.create_map(F.lit("T"), F.lit("a\n\nb")).alias("sections"))


def test_rows_come_back_as_they_are(spark, tmp_path):
    rows = [(1, {"a": "1: x", "b": ""}, {"": "lead", "One": "t\n\n# not a section", "Two": ""}), (1, {}, {}), (2, {"k": "ä—中"}, {"S": "x"})]
    got = saved(spark.createDataFrame(rows, ", ".join(folders.Notes.columns)), tmp_path)
    assert sorted(((r["id"], r["head"], r["sections"]) for r in got.collect()), key=str) == sorted(rows, key=str)


def test_cards_of_any_text(spark, tmp_path):
    rows = [(1, '{"name": "é"}'), (2, ""), (3, None), (3, "x" * 100_000)]
    got = saved(spark.createDataFrame(rows, "id long, card string"), tmp_path, "bracken_cards")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(rows, key=str)
    assert {open(p, "rb").read(8) for p in glob.glob(f"{tmp_path}/part-*/*.png")} == {b"\x89PNG\r\n\x1a\n"}


def test_a_row_that_would_change_fails_the_write_and_leaves_no_rows(spark, tmp_path):
    good = numbered(spark, 0, 4)
    assert saved(good, tmp_path).count() == 4
    bad = good.withColumn("sections", F.create_map(F.lit("T"), F.lit("a\n## b")))
    for rows in (bad, good.withColumn("id", F.when(F.col("id") > 0, F.col("id")))):
        with pytest.raises(Exception, match="read back as it is"):
            saved(rows, tmp_path)
        assert spark.read.format("bracken_notes").load(str(tmp_path)).count() == 4
    with pytest.raises(Exception, match="columns are"):
        saved(spark.range(3).withColumnRenamed("id", "other"), tmp_path)


def test_append_overwrite_and_what_no_commit_names(spark, tmp_path):
    assert saved(numbered(spark, 0, 5), tmp_path).count() == 5
    assert saved(numbered(spark, 5, 8), tmp_path).count() == 8
    os.makedirs(tmp_path / "part-lost")
    (tmp_path / "part-lost" / "000000000000.list").write_text("[99]")
    assert spark.read.format("bracken_notes").load(str(tmp_path)).count() == 8
    assert {r["id"] for r in saved(numbered(spark, 20, 22), tmp_path, mode="overwrite").collect()} == {20, 21}
    assert saved(numbered(spark, 0, 0), tmp_path).count() == 2
    assert saved(numbered(spark, 0, 0), tmp_path / "none").count() == 0
    assert spark.read.format("bracken_notes").load(str(tmp_path / "missing")).count() == 0


def test_ranges_leave_blocks_unopened(spark, tmp_path):
    n = 3 * folders.BLOCK
    got = saved(numbered(spark, 0, n), tmp_path)
    reader = lambda low, high: folders.FolderReader(str(tmp_path), folders.Notes, low, high)
    assert len(reader(None, None).partitions()) == 4  # two tasks of one and a half blocks
    (block,) = reader(11, 12).partitions()
    assert [x[0] for x in reader(11, 12).read(block)] == [11, 12]
    assert [list(reader(n, None).read(b)) for b in reader(n, None).partitions()] == [[]]
    # queries of one frame with different filters, one after another and in one plan
    assert [got.filter(c).count() for c in ("id = 7", "true", "id < 2 OR id > 2997", "id IS NULL")] == [1, n, 4, 0]
    assert sorted(r["id"] for r in got.filter("id = 7").union(got.filter("id = 8")).collect()) == [7, 8]
    load = lambda **o: spark.read.format("bracken_notes").options(**o).load(str(tmp_path))
    assert [load(low=2998).count(), load(high=4).count(), load(low=5, high=5).first()["head"], load(low=9, high=8).count()] == [2, 5, {"n": "5"}, 0]
    # what is not asked for is not opened: its files may even be gone
    for p in glob.glob(f"{tmp_path}/part-*/*.md"):
        if not p.endswith("000000000007.md"):
            os.unlink(p)
    assert load(low=7, high=7).first()["head"] == {"n": "7"}
