"""op8: all documents as token ids in files, read back. Tests encode again without pieces."""

from pyspark.sql import DataFrame, SparkSession

from . import common, tokens


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    to = common.shared_path(spark, "tokens")
    tokens.write(common.table(spark, sf_dir, "documents").select("doc_id", "text"), to, str(tokenizer_path()))
    return tokens.checksums(tokens.read(spark, to))


QUERIES = {"op8_token_files": op8_token_files}
ORACLES: dict[str, str] = {}
