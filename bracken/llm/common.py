"""What the training-data operators share: inputs, written intermediate tables, folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import release, shared_path, shared_table, table

__all__ = ["release", "shared_path", "shared_table", "table"]

#: White space between words everywhere in this package: the space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"

#: Tables of up to so many rows of two longs (8 MB) are broadcast; their rows are counted first.
BROADCAST_ROWS = 500_000
SALTS = 16


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` for a broadcast if it has at most so many rows, which is counted; else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def met(left: DataFrame, right: DataFrame, on: str, deal: list[str], rows: int) -> DataFrame:
    """``left`` joined with ``right`` on one column. ``right`` is broadcast if it has at most so many rows; else rows of
    ``left`` with one value of ``on``, of which there may be many, are dealt over SALTS tasks by ``deal``."""
    if right.limit(rows + 1).count() <= rows:
        return left.join(F.broadcast(right), on)
    left = left.withColumn("_bk_salt", F.pmod(F.xxhash64(*deal), F.lit(SALTS)).cast("int"))
    right = right.withColumn("_bk_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.join(right, [on, "_bk_salt"]).drop("_bk_salt")


def without(docs: DataFrame, gone: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` whose id and text's hash are not in ``gone`` (id, hash), whatever their columns' names."""
    gone_id, gone_hash = (gone[c] for c in gone.columns)
    same = column(docs, id_col).eqNullSafe(gone_id) & F.xxhash64(column(docs, text_col)).eqNullSafe(gone_hash)
    return docs.join(small(gone), same, "left_anti")


def spare(docs: DataFrame, name: str) -> str:
    """A name that no column of ``docs`` has."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id's text leaves 1 modulo 3; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def n_words(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def column(df: DataFrame, name: str) -> Column:
    """A column by its exact name, dots and all."""
    return df["`" + name.replace("`", "``") + "`"]
