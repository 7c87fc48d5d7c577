"""op13: tokens of every document. Tests compare with the library's own encoding."""

from pyspark.sql import DataFrame, SparkSession

from . import common, counts


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return counts.counted(docs, str(tokenizer_path())).select("doc_id", "n_bytes", "n_tokens", "over_limit")


QUERIES = {"op13_token_counts": op13_token_counts}
ORACLES: dict[str, str] = {}
