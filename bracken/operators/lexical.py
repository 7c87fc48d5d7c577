"""Lexical search: a relational inverted index, Okapi BM25, top-k."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import profiles as P
from ..functions import text as T
from ..session import shared_table, small

#: Terms up to which a query's postings are looked up by value; their number is bounded by this.
FEW_TERMS = 1000


@dataclass(frozen=True)
class Index:
    """A written inverted index: ``postings`` (term, doc, tf, dl), of which the row without a term tells a document's
    length; ``stats`` (term, df, idf). Within a file rows are sorted by term, so that few terms read few pages."""

    postings: DataFrame
    stats: DataFrame
    corpus: DataFrame


def tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, words): TXT-01 tokens of each document."""
    return docs.select(F.col(id_col).alias("doc"), T.index_tokens(F.col(text_col)).alias("words"))


def postings(toks: DataFrame) -> DataFrame:
    """(term, doc, tf, dl); a row without a term for each document."""
    marked = toks.select("doc", F.size("words").alias("dl"), F.explode(F.concat("words", F.array(F.lit(None).cast("string")))).alias("term"))
    return marked.groupBy("term", "doc", "dl").agg(F.count("*").alias("tf"))


def term_stats(counts: DataFrame, epsilon: float = P.BM25_EPSILON) -> DataFrame:
    """DM-06, MTH-01 over (term, df), the row without a term counting all documents: (term, df, idf). A negative idf
    becomes epsilon times the mean of all idf before."""
    n = counts.filter("term IS NULL").select(F.col("df").alias("n_docs"))
    raw = counts.filter("term IS NOT NULL").crossJoin(F.broadcast(n)).withColumn("raw", F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))  # one row
    mean = raw.agg(F.avg("raw").alias("mean_idf"))
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, epsilon * F.col("mean_idf")).otherwise(F.col("raw")).alias("idf"))


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """Tokenise the corpus once and write its index."""
    posts = shared_table(postings(tokens(docs, id_col, text_col)).sortWithinPartitions("term", "doc"), "postings")
    counts = shared_table(posts.groupBy("term").agg(F.count("*").alias("df")), "document-frequencies")
    stats = shared_table(term_stats(counts), "term-stats")
    return Index(posts, stats, posts.filter("term IS NULL").agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl")))


def _asked(queries: DataFrame, query_id: str, text_col: str) -> DataFrame:
    return queries.select(F.col(query_id).alias("query_id"), F.explode(T.index_tokens(F.col(text_col))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def _wanted(index: Index, asked: DataFrame) -> DataFrame:
    """Postings of the terms that are asked for; few terms are looked up in the files."""
    terms = asked.select("term").distinct()
    few = [r[0] for r in terms.limit(FEW_TERMS + 1).collect()]
    if len(few) <= FEW_TERMS:
        return index.postings.filter(F.col("term").isin(few))
    return index.postings.join(small(terms), "term", "left_semi")


def bm25(docs: DataFrame | Index, queries: DataFrame, id_col: str = "doc_id", query_id: str = "query_id", text_col: str = "text", k1: float = P.BM25_K1, b: float = P.BM25_B) -> DataFrame:
    """RET-01: (query_id, doc, score) of all documents with a query's term; scores have six decimals. A table of
    documents is indexed first. Postings of query terms alone are shuffled."""
    at = docs if isinstance(docs, Index) else index(docs, id_col, text_col)
    asked = _asked(queries, query_id, text_col)
    hits = _wanted(at, asked).crossJoin(F.broadcast(at.corpus.select("avgdl")))  # one row
    gain = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    weighted = small(asked).join(at.stats.select("term", "idf"), "term")
    scored = hits.withColumn("gain", gain).join(small(weighted), "term")
    return scored.groupBy("query_id", "doc").agg(F.round(F.sum(F.col("qtf") * F.col("idf") * F.col("gain")), 6).alias("score"))


def top(scores: DataFrame, k: int, positive: bool = True) -> DataFrame:
    """TOP-01, WIN-01: adds rank from 0; the first k by score, ties by document; then positive scores only."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc")
    out = scores.withColumn("rank", F.row_number().over(w) - 1).filter(F.col("rank") < k)
    return out.filter("score > 0") if positive else out
