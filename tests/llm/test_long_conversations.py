"""A conversation of very many turns."""

import time

from pyspark.sql import functions as F

from bracken.llm import preference


def test_time_grows_in_proportion(spark):
    def took(n):
        turn = lambda i: F.struct(F.when(i % 2 == 0, "assistant").otherwise("user").alias("role"), F.concat(F.lit("text "), i.cast("string")).alias("text"))
        d = spark.range(1).select(F.col("id").alias("pair_id"), F.transform(F.sequence(F.lit(1), F.lit(n)), turn).alias("chosen")).withColumn("rejected", F.slice("chosen", 1, 3)).repartition(1)
        began = time.time()
        (r,) = preference.formatted(d).collect()
        first, last = r.chosen_spans[0], r.chosen_spans[-1]
        assert len(r.chosen_spans) == n // 2 - 1 and r.chosen[first.start : first.end] == "text 4<|end|>\n" and r.chosen[last.start : last.end] == f"text {n}<|end|>\n"
        return time.time() - began

    took(10)
    once, twice = took(20_000), took(40_000)
    assert twice < 2.3 * once + 1
