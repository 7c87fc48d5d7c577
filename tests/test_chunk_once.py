"""Sentences of a long element are cut once, whatever uses them."""

from bracken.operators import chunk


def test_sentences_are_cut_once(spark):
    pages = spark.createDataFrame([("a", 1, "One. Two. " * 300)], "doc string, page_num long, text string")
    cut = chunk.page_chunks(pages)
    plan = cut._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
    got = cut.orderBy("piece").collect()
    assert [r.piece for r in got] == [0, 1] and all(r.has_overlap for r in got)
