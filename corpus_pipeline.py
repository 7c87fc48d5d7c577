"""The corpus pipeline: five stages, each over all that its predecessor kept, written and read between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bracken.llm import common, decontam, mixing, q08, rules, simhash, tokens


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the trees reject go."""
    return rules.accepted(docs, common.table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the smallest id stays."""
    return simhash.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontam.decontaminated(docs, common.table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document has as many rows as the mix takes copies of it."""
    return mixing.expand(mixing.mix(docs)).select(*docs.columns)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token set of all copies, as read back from its files: doc_id, start, n_tokens, ids_crc32."""
    to = common.shared_path(spark, "tokens")
    tokens.write(docs, to, str(q08.tokenizer_path()))
    return tokens.checksums(tokens.read(spark, to))


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", source_mix),
    ("token-ID / binary output", token_files),
]

#: The trees of the first stage, SimHash and the tokenizer are not in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again before the next."""
    docs = common.table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        before, docs = docs, common.shared_table(stage(spark, docs, sf_dir), f"stage{i}")
        common.release(before)
    return docs
