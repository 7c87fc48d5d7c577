"""Folds that build arrays."""

import time

import pytest
from pyspark.sql import functions as F

from bracken.functions import arrays
from bracken.operators import chunk


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 1000])
def test_folds_of_any_length(spark, n):
    items = F.array(*map(F.lit, range(n))) if n < 2 else F.sequence(F.lit(0), F.lit(n - 1))
    items = items.cast("array<int>")
    even_sums = arrays.folded(items, F.lit(0), lambda s, x: (s + x, F.when(x % 2 == 0, s)), "int")
    (got,) = spark.range(1).select(even_sums.alias("a"), arrays.blocks(items, 100).alias("b")).collect()
    assert got.a == [sum(range(i)) for i in range(0, n, 2)]
    assert [x for b in got.b for x in b] == list(range(n)) and all(len(b) == 100 for b in got.b[:-1])


def test_null_array(spark):
    none = F.lit(None).cast("array<int>")
    assert spark.range(1).select(arrays.folded(none, F.lit(0), lambda s, x: (s, x), "int").alias("a")).first().a is None


def test_long_documents_take_time_in_proportion(spark):
    """Lines that are chunks of their own, so that there are as many chunks as lines."""

    def took(n):
        line = F.concat(F.repeat(F.lit("word "), F.lit(150)), F.lit("end"))
        text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(line, i.cast("string"))), "\n")
        d = spark.range(1).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), text.alias("text")).repartition(1)
        began = time.time()
        assert chunk.chunked(chunk.elements(d)).count() >= n - 1
        return time.time() - began

    took(10)
    once, twice = took(5000), took(10000)
    assert twice < 2.3 * once + 1
