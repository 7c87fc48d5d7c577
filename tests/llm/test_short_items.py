"""Benchmark items of fewer than five words."""

from pyspark.sql import functions as F

import corpus_pipeline
from bracken.llm import decontam


def test_short_items_are_found(spark, tmp_path):
    items = [(1, "Red fox"), (2, "法国的首都是哪里"), (3, "ประเทศไทย"), (4, "..."), (5, None), (6, "solo")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, "a red, FOX!"), (2, "fox red"), (3, "请问法国的首都是哪里呢?"), (4, "法国的首都"), (5, "xx ประเทศไทย"), (6, "solos"), (7, "going solo"), (8, None), (None, "the red fox"), (9, "redfox")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("size", F.lit(3))
    out = corpus_pipeline.decontamination(spark, docs, str(tmp_path))
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [2, 4, 6, 8, 9]
    bench = spark.read.parquet(f"{tmp_path}/benchmark.parquet")
    assert {(r.doc_id, r.item_id) for pairs in decontam.contained_short(docs, bench) for r in pairs.collect()} == {(1, 1), (None, 1), (3, 2), (5, 3), (7, 6)}


def test_the_query_finds_them_and_equals_sql(spark, sf, tmp_path):
    import duckdb

    from bracken.llm import q02
    from compare import same

    items = [(1, "Red fox"), (2, "法国的首都是哪里"), (3, "ประเทศไทย"), (4, "..."), (5, None), (6, "solo"), (7, "one two three four"), (8, "one two three four five six")]
    rows = [(1, "a red, FOX!"), (2, "fox red"), (3, "请问法国的首都是哪里呢?"), (4, "法国的首都是"), (5, "xx ประเทศไทย"), (6, "solos"), (7, "going solo"), (8, None), (9, "zero one two three four"), (10, "one two three four five six")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    for t in ("benchmark", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    got = q02.op2_benchmark_decontamination(spark, str(tmp_path))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(1, 1), (3, 2), (5, 3), (7, 6), (9, 7), (10, 7), (10, 8)}
    same(got, con, q02.SQL)
