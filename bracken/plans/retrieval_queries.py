"""Queries of lexical, vector and hybrid retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import profiles as P
from ..functions import text as T
from ..operators import chunk, fusion, segments, vector
from ..session import shared_path, shared_table, table

POOL, FETCH = fusion.depths()


def _docs(spark, sf) -> DataFrame:
    return table(spark, sf, "documents")


def _queries(spark, sf) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _index(spark, sf) -> segments.Index:
    """The index of the documents, which follows their files."""
    return segments.following(_docs(spark, sf), sf)


def bm25_term_stats(spark, sf):
    return _index(spark, sf).stats.select("term", "df", F.round("idf", 6).alias("idf"))


def _ranked(found: DataFrame) -> DataFrame:
    return found.select("query_id", F.col("doc").alias("doc_id"), F.col("rank").cast("long").alias("rank"), "score")


def bm25_topk(spark, sf):
    return _ranked(segments.search(_index(spark, sf), _queries(spark, sf), 10))


def bm25_after_changes(spark, sf):
    """SNK-03, RET-01: an index of all sources but one gets that one appended, loses a language, is merged and loses another;
    documents without a language stay."""
    docs = _docs(spark, sf)
    late = F.coalesce(F.col("source") == "src1", F.lit(False))
    index = segments.create(docs.filter(~late), shared_path(spark, "changed-index"))
    index = segments.append(index, docs.filter(late))
    index = segments.merge(segments.delete(index, docs.filter("lang = 'de'")))
    index = segments.delete(index, docs.filter("lang = 'fr'"))
    return _ranked(segments.search(index, _queries(spark, sf), 10))


def vector_topk(spark, sf):
    v = table(spark, sf, "embeddings")
    return vector.topk(v, v.filter("vec_id % 20 = 0"), 10).select("query_id", F.col("doc").alias("vec_id"), F.col("rank").cast("long").alias("rank"), "score")


def vector_validation(spark, sf):
    v = table(spark, sf, "embeddings")
    zero = F.transform("embedding", lambda x: x * F.when(F.col("vec_id") % 7 == 0, 0).otherwise(1))
    return v.select("vec_id", vector.invalid(zero, 64).alias("invalid"))


def source_weights(spark, sf):
    kind = fusion.source_type(F.col("source"))
    return _docs(spark, sf).select("doc_id", kind.alias("source_type"), fusion.source_weight(kind).alias("weight"))


def source_distribution(spark, sf):
    return source_weights(spark, sf).groupBy("source_type").agg(F.count("*").alias("n"))


def retag_report(spark, sf):
    """AGG-06, SNK-04: distribution before and after new rules, and what changed."""
    new = (("src1", "oral"), ("src3", "original"))
    d = _docs(spark, sf).select(fusion.source_type(F.col("source")).alias("before"), fusion.source_type(F.col("source"), new).alias("after"))
    return d.groupBy("before", "after").agg(F.count("*").alias("n"), F.count_if(F.col("before") != F.col("after")).alias("changed"))


def _routes(spark, sf) -> tuple[DataFrame, DataFrame]:
    """The two boards, written once for all that a query makes of them. The vector of the same number stands for the embedding of a
    document, and of a query."""
    queries = _queries(spark, sf)
    v = table(spark, sf, "embeddings")
    known = v.join(_docs(spark, sf).select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    near = vector.topk(known, v.join(queries.select(F.col("query_id").alias("vec_id")), "vec_id", "left_semi"), FETCH, itself=True)
    return shared_table(near, "near"), shared_table(segments.search(_index(spark, sf), queries, FETCH), "words")


def _boards(spark, sf) -> DataFrame:
    return fusion.routes(*_routes(spark, sf))[0].select("query_id", "class", "doc", "rank")


def _weights(spark, sf) -> DataFrame:
    return source_weights(spark, sf).select(F.col("doc_id").alias("doc"), "weight")


def rrf_fusion(spark, sf):
    return fusion.fused(_boards(spark, sf), _weights(spark, sf)).select("query_id", F.col("doc").alias("doc_id"), "score", F.col("vector_rank").cast("long").alias("vector_rank"), F.col("bm25_rank").cast("long").alias("bm25_rank"))


def rrf_contrib(spark, sf):
    f = fusion.fused(_boards(spark, sf), _weights(spark, sf))
    return f.select("query_id", F.col("doc").alias("doc_id"), F.explode("contrib").alias("class", "part"))


def _selected(spark, sf, mode: str = "full", vectors: bool = True, routes: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    near, words = routes or _routes(spark, sf)
    d = _docs(spark, sf).select(F.col("doc_id").alias("doc"), "source", "text")
    return fusion.retrieved(mode, _queries(spark, sf).withColumnRenamed("text", "query"), d, near if vectors else None, words, _weights(spark, sf))


def hybrid_two_segment(spark, sf):
    return _selected(spark, sf).select("query_id", F.col("doc").alias("doc_id"), F.col("rank").cast("long").alias("rank"), F.col("rrf_rank").cast("long").alias("rrf_rank"), "score", "rerank")


def retrieval_modes(spark, sf):
    """RET-10, RET-07: what each mode returns, and what is left without vectors."""
    routes = _routes(spark, sf)
    runs = [_selected(spark, sf, mode, routes=routes) for mode in ("full", "vector_only", "agent")] + [_selected(spark, sf, vectors=False, routes=routes)]
    out = runs[0]
    for r in runs[1:]:
        out = out.unionByName(r)
    return out.select("mode", "query_id", F.col("doc").alias("doc_id"), F.col("rank").cast("long").alias("rank"))


def retrieval_trace(spark, sf):
    t = fusion.trace(_selected(spark, sf))
    return t.select("query_id", F.col("doc").alias("doc_id"), *[F.col(c).cast("long").alias(c) for c in ("vector_rank", "bm25_rank", "rrf_rank", "rank", "moved")], "anchor", "mode")


def returned_sources(spark, sf):
    """MIS-15: source types of what a query returns."""
    return _selected(spark, sf).groupBy("query_id", fusion.source_type(F.col("source")).alias("source_type")).agg(F.count("*").alias("n"))


def rank_swap(spark, sf):
    """JN-19, SET-07, RET-08: the selection against the plain fused order, by query."""
    routes = _routes(spark, sf)
    f = fusion.fused(fusion.routes(*routes)[0].select("query_id", "class", "doc", "rank"), _weights(spark, sf))
    plain = f.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(*fusion.fused_order()))).filter("r <= 6")
    a = plain.groupBy("query_id").agg(F.collect_set("doc").alias("a"))
    b = _selected(spark, sf, routes=routes).groupBy("query_id").agg(F.collect_set("doc").alias("b"))
    both = a.join(b, "query_id", "full")
    n = F.size(F.array_intersect("a", "b"))
    return both.select("query_id", n.cast("long").alias("overlap"), F.round(n / F.size(F.array_union("a", "b")), 6).alias("jaccard"))


def _evidence(spark, sf) -> DataFrame:
    s = _selected(spark, sf)
    return s.select("query_id", F.col("rank").alias("pos"), (F.col("doc") % 3 == 0).alias("inferred"), "source", F.regexp_replace("text", "[.!?]$", "").alias("text"), F.concat(F.lit(" and "), F.left("source", F.lit(4)), F.lit(". ")).alias("tail"))


def numbering_two_series(spark, sf):
    return fusion.numbered(_evidence(spark, sf)).select("query_id", F.col("pos").cast("long").alias("pos"), "inferred", "label")


def context_assembly(spark, sf):
    return fusion.contexts(_evidence(spark, sf))


def cont_tail(spark, sf):
    """WIN-03, JN-13: the sentence that goes on after a cut, where next text starts with the last 100 characters."""
    d = _docs(spark, sf).select("doc_id", "text")
    parts = d.select("doc_id", F.explode(F.sequence(F.lit(0), F.greatest(F.floor((F.length("text") - 1) / 400), F.lit(0)))).alias("part"), "text")
    start = F.greatest(F.col("part") * 400 - F.when(F.col("part") % 4 == 3, 90).otherwise(100), F.lit(0))
    chunks = parts.select("doc_id", F.col("part").cast("long").alias("part"), F.substring("text", (start + 1).cast("int"), ((F.col("part") + 1) * 400 - start).cast("int")).alias("chunk"))
    nxt = F.lead("chunk").over(Window.partitionBy("doc_id").orderBy("part"))
    chunks = chunks.withColumn("nxt", nxt)
    rest = F.ltrim(F.substring("nxt", F.lit(101), F.length("nxt")))
    first = F.regexp_extract(rest, r"^(?s)([^.!?]*[.!?])", 1)
    fits = (F.length("chunk") > 100) & (F.left("nxt", F.lit(100)) == F.right("chunk", F.lit(100)))
    return chunks.filter("nxt IS NOT NULL").select("doc_id", "part", F.when(fits, F.when(first != "", first).otherwise(rest)).otherwise("").alias("cont_tail"))


def fixed_slice_overlap(spark, sf):
    """WIN-02: pieces of 1000 characters, each after the last 100 of the piece before as it was."""
    d = _docs(spark, sf).select("doc_id", "text")
    parts = d.select("doc_id", F.explode(F.sequence(F.lit(0), F.greatest(F.floor((F.length("text") - 1) / 1000), F.lit(0)))).alias("part"), "text")
    own = parts.select("doc_id", F.col("part").cast("long").alias("part"), F.substring("text", (F.col("part") * 1000 + 1).cast("int"), F.lit(1000)).alias("own"))
    prev = F.lag("own").over(Window.partitionBy("doc_id").orderBy("part"))
    return own.withColumn("p", prev).select("doc_id", "part", F.md5(F.when(F.col("p").isNull(), F.col("own")).otherwise(F.concat(F.right("p", F.lit(100)), F.lit("\n"), "own"))).alias("chunk_md5"))


def chunk_documents(spark, sf):
    c = chunk.chunked(chunk.elements(_docs(spark, sf).select("doc_id", "text", "source")))
    return c.select("doc_id", "source", F.col("ordinal").cast("long").alias("ordinal"), "heading", F.array_join("element_types", ",").alias("element_types"), F.col("char_length").cast("long").alias("char_length"), F.col("total_length").cast("long").alias("total_length"), "has_overlap", "overlap_source", F.md5("text").alias("text_md5"))


def semantic_cache(spark, sf):
    """SET-05: questions are the vectors whose number divides by 20; all others are cached."""
    v = table(spark, sf, "embeddings")
    return vector.cache_hits(v, v.filter("vec_id % 20 = 0"), 0.35).select("query_id", "hit", "score")


def page_chunks(spark, sf):
    """RET-17: a page is a chunk; one that is too long is cut, and its pieces keep its number."""
    d = _docs(spark, sf)
    pages = d.select(F.col("source").alias("doc"), F.col("doc_id").alias("page_num"), "text")
    c = chunk.page_chunks(pages)
    return c.select("doc", "page_num", F.col("piece").cast("long").alias("piece"), F.col("char_length").cast("long").alias("char_length"), "has_overlap", F.md5("text").alias("text_md5"))


QUERIES = {f.__name__: f for f in (bm25_term_stats, bm25_topk, bm25_after_changes, vector_topk, vector_validation, source_weights, source_distribution, retag_report, rrf_fusion, rrf_contrib, hybrid_two_segment, rank_swap, retrieval_modes, retrieval_trace, returned_sources, semantic_cache, page_chunks, numbering_two_series, context_assembly, cont_tail, fixed_slice_overlap, chunk_documents)}

_TOK = r"regexp_extract_all(regexp_replace(text, '([\x{4e00}-\x{9fff}])', ' \1 ', 'g'), '\S+')"
_STATS = f"""tok AS (SELECT doc_id, {_TOK} AS w FROM documents), dl AS (SELECT doc_id, len(w) AS dl FROM tok), word AS (SELECT doc_id, unnest(w) AS term FROM tok),
tf AS (SELECT term, doc_id, count(*) AS tf FROM word GROUP BY ALL), dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
raw AS (SELECT term, df, ln((SELECT count(*) FROM documents) - df + 0.5) - ln(df + 0.5) AS raw FROM dfs),
stats AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw)"""
_BM25 = f"""{_STATS}, qw AS (SELECT item_id AS query_id, unnest({_TOK}) AS term FROM benchmark), q AS (SELECT query_id, term, count(*) AS qtf FROM qw GROUP BY ALL),
bm AS (SELECT query_id, doc_id, round(sum(qtf * idf * (tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / (SELECT avg(dl) FROM dl))))), 6) AS score FROM q JOIN tf USING (term) JOIN stats USING (term) JOIN dl USING (doc_id) GROUP BY query_id, doc_id),
bmr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1 AS rank FROM bm)"""
_KIND = "CASE " + " ".join(f"WHEN contains(source, '{p}') THEN '{k}'" for p, k in P.SOURCE_RULES) + " ELSE 'unknown' END"
_WEIGHT = "CASE kind " + " ".join(f"WHEN '{k}' THEN {w}::DOUBLE" for k, w in P.SOURCE_WEIGHTS.items()) + " END"
_FUSED = f"""{_BM25}, vs AS (SELECT item_id AS query_id, v.vec_id AS doc_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score FROM benchmark JOIN embeddings q ON q.vec_id = item_id, embeddings v WHERE v.vec_id IN (SELECT doc_id FROM documents)),
vsr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1 AS rank FROM vs),
sw AS (SELECT doc_id, kind, {_WEIGHT} AS weight FROM (SELECT doc_id, {_KIND} AS kind FROM documents)),
board AS (SELECT query_id, 'bm25' AS class, doc_id, rank FROM bmr WHERE rank < 20 AND score > 0 UNION ALL SELECT query_id, 'vector', doc_id, rank FROM vsr WHERE rank < 20),
part AS (SELECT query_id, class, doc_id, rank, weight / (60 + rank + 1) AS part FROM board JOIN sw USING (doc_id)),
fused AS (SELECT query_id, doc_id, round(sum(part), 9) AS score, min(rank) FILTER (class = 'vector') AS vector_rank, min(rank) FILTER (class = 'bm25') AS bm25_rank FROM part GROUP BY query_id, doc_id)"""
_SELECT = f"""{_FUSED}, fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vector_rank NULLS LAST, bm25_rank NULLS LAST, doc_id) - 1 AS rrf_rank FROM fused),
qt AS (SELECT item_id AS query_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS terms FROM benchmark),
rr AS (SELECT fr.*, d.source, d.text, CASE WHEN rrf_rank >= 3 THEN round(len(list_filter(terms, lambda t: contains(lower(substr(d.text, 1, 500)), t))) / greatest(len(terms), 1), 6) END AS rerank FROM fr JOIN documents d USING (doc_id) JOIN qt USING (query_id) WHERE rrf_rank < 10),
sel AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_rank >= 3, CASE WHEN rrf_rank < 3 THEN rrf_rank END, rerank DESC, rrf_rank) - 1 AS rank FROM rr),
picked AS (SELECT * FROM sel WHERE rank < 6)"""
_EVIDENCE = f"""{_SELECT}, ev AS (SELECT query_id, rank AS pos, doc_id % 3 = 0 AS inferred, source, regexp_replace(text, '[.!?]$', '') AS text, ' and ' || left(source, 4) || '. ' AS tail FROM picked),
num AS (SELECT *, CASE WHEN inferred THEN '[G' ELSE '[' END || CAST(row_number() OVER (PARTITION BY query_id, inferred ORDER BY pos) AS VARCHAR) || ']' AS label FROM ev)"""
_LEXICAL = """lx AS (SELECT query_id, doc_id, round(weight / (61 + rank), 9) AS score, rank FROM bmr JOIN sw USING (doc_id) WHERE rank < 20 AND score > 0), lr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank, doc_id) - 1 AS rrf_rank FROM lx),
ll AS (SELECT lr.query_id, doc_id, rrf_rank, CASE WHEN rrf_rank >= 3 THEN round(len(list_filter(terms, lambda t: contains(lower(substr(d.text, 1, 500)), t))) / greatest(len(terms), 1), 6) END AS rerank FROM lr JOIN documents d USING (doc_id) JOIN qt USING (query_id) WHERE rrf_rank < 10),
lp AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_rank >= 3, CASE WHEN rrf_rank < 3 THEN rrf_rank END, rerank DESC, rrf_rank) - 1 AS rank FROM ll)"""


def _stripped(text: str) -> str:
    return rf"regexp_replace({text}, '^[\s\p{{Z}}\x{{85}}\x0b]+|[\s\p{{Z}}\x{{85}}\x0b]+$', '', 'g')"


_SENT = rf"list_filter(list_transform(regexp_extract_all(content, '[^。！？.!?\n]*[。！？.!?]|[^。！？.!?\n]+'), lambda s: {_stripped('s')}), lambda s: s <> '')"


def _packed(name: str, src: str, keys: str) -> str:
    """Recursion over ``src`` (keys, seq, n, alone): the run that each row is in."""
    on = " AND ".join(f"x.{k} = f.{k}" for k in keys.split(", "))
    cols = ", ".join(f"x.{k}" for k in keys.split(", "))
    return f"""{name} AS (SELECT {keys}, seq, 1 AS run, n AS held, alone AS closed FROM {src} WHERE seq = 1
 UNION ALL SELECT {cols}, x.seq, CASE WHEN f.closed OR x.alone OR f.held + x.n > 1000 THEN run + 1 ELSE run END, CASE WHEN f.closed OR x.alone OR f.held + x.n > 1000 THEN x.n ELSE f.held + x.n END, x.alone FROM {name} f JOIN {src} x ON {on} AND x.seq = f.seq + 1)"""


def _tail(name: str, src: str, keys: str) -> str:
    """Of ``src`` (keys, j, text) the pieces, the last ones as one up to 500 characters."""
    return f"""{name}_s AS (SELECT *, sum(length(text) + 2) OVER (PARTITION BY {keys} ORDER BY j DESC) - 2 AS suffix FROM {src}),
{name}_c AS (SELECT {keys}, coalesce(max(j) FILTER (suffix >= 500), 1) AS cut FROM {name}_s GROUP BY {keys}),
{name} AS (SELECT {keys}, least(j, cut) AS j, string_agg(text, chr(10) || chr(10) ORDER BY j) AS text FROM {name}_s JOIN {name}_c USING ({keys}) GROUP BY {keys}, least(j, cut))"""


def _chunks(src: str) -> str:
    """Chunks (doc_id, j, text) of ``src`` (doc_id, p, content)."""
    return f"""el AS MATERIALIZED (SELECT doc_id, p, content, length(content) AS n, length(content) > 1000 AS alone, p AS seq FROM ({src})),
sn AS (SELECT doc_id, p, unnest({_SENT}) AS s, generate_subscripts({_SENT}, 1) AS k FROM el WHERE alone),
sl AS (SELECT doc_id, p, k, length(s) > 1000 AS alone, unnest(CASE WHEN length(s) > 1000 THEN list_transform(range(0, (length(s) - 1) // 1000 + 1), lambda i: substr(s, i * 1000 + 1, 1000)) ELSE [s] END) AS s, unnest(range(0, (length(s) - 1) // 1000 + 1)) AS i FROM sn),
su AS MATERIALIZED (SELECT doc_id, p, s, alone, length(s) AS n, row_number() OVER (PARTITION BY doc_id, p ORDER BY k, i) AS seq FROM sl),
{_packed("sf", "su", "doc_id, p")},
sp AS (SELECT doc_id, p, run AS j, string_agg(s, '' ORDER BY seq) AS text FROM sf JOIN su USING (doc_id, p, seq) GROUP BY ALL),
{_tail("st", "sp", "doc_id, p")},
{_packed("ef", "el", "doc_id")},
ep AS (SELECT doc_id, run, 0 AS sub, string_agg(content, chr(10) || chr(10) ORDER BY seq) AS text FROM ef JOIN el USING (doc_id, seq) WHERE NOT alone GROUP BY ALL
 UNION ALL SELECT doc_id, run, st.j, st.text FROM ef JOIN el USING (doc_id, seq) JOIN st USING (doc_id, p) WHERE alone),
eo AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY run, sub) AS j, text FROM ep),
{_tail("ch", "eo", "doc_id")}"""


_RT = r"regexp_replace(text, '\s+$', '')"
_TAIL = r"regexp_replace(tail, '^\s+|\s+$', '', 'g')"

ORACLES = {
    "bm25_term_stats": f"""WITH d AS MATERIALIZED (SELECT unnest(list_distinct({_TOK})) AS term FROM documents), dfs AS MATERIALIZED (SELECT term, count(*) AS df FROM d GROUP BY term), n AS (SELECT count(*) AS n FROM documents),
 raw AS MATERIALIZED (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM dfs CROSS JOIN n), m AS (SELECT avg(raw) AS m FROM raw) SELECT term, df, round(CASE WHEN raw < 0 THEN 0.25 * m ELSE raw END, 6) AS idf FROM raw CROSS JOIN m""",
    "retrieval_modes": f"""WITH {_SELECT}, {_LEXICAL} SELECT 'hybrid' AS mode, query_id, doc_id, rank FROM picked UNION ALL SELECT 'agent hybrid', query_id, doc_id, rank FROM picked UNION ALL SELECT 'vector_only', query_id, doc_id, rank FROM vsr WHERE rank < 6 UNION ALL SELECT 'lexical_only', query_id, doc_id, rank FROM lp WHERE rank < 6""",
    "retrieval_trace": f"WITH {_SELECT} SELECT query_id, doc_id, vector_rank, bm25_rank, rrf_rank, rank, rrf_rank - rank AS moved, rrf_rank < 3 AS anchor, 'hybrid' AS mode FROM picked",
    "returned_sources": f"WITH {_SELECT} SELECT query_id, {_KIND} AS source_type, count(*) AS n FROM picked GROUP BY ALL",
    "semantic_cache": """WITH s AS (SELECT q.vec_id AS query_id, v.vec_id AS hit, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, hit) AS rn FROM s) SELECT query_id, CASE WHEN score >= 0.35 THEN hit END AS hit, score FROM r WHERE rn = 1""",
    "chunk_documents": f"""WITH RECURSIVE {_chunks("SELECT doc_id, unnest(l) AS content, generate_subscripts(l, 1) AS p FROM (SELECT doc_id, list_filter(string_split_regex(text, chr(10) || '+'), lambda x: trim(x) <> '') AS l FROM documents)")},
 lk AS (SELECT doc_id, row_number() OVER w - 1 AS ordinal, text, right(lag(text) OVER w, 100) AS before FROM ch WINDOW w AS (PARTITION BY doc_id ORDER BY j))
 SELECT doc_id, source, ordinal, '' AS heading, 'paragraph' AS element_types, length(lk.text) AS char_length, length(lk.text) + coalesce(length(before) + 1, 0) AS total_length, before IS NOT NULL AS has_overlap, '' AS overlap_source, md5(coalesce(before || chr(10), '') || lk.text) AS text_md5 FROM lk JOIN documents USING (doc_id)""",
    "page_chunks": f"""WITH RECURSIVE {_chunks(f"SELECT doc_id, {_stripped('text')} AS content, 1 AS p FROM documents WHERE {_stripped('text')} <> ''")},
 lk AS (SELECT doc_id, row_number() OVER w - 1 AS piece, count(*) OVER (PARTITION BY doc_id) AS n, text, right(lag(text) OVER w, 100) AS before FROM ch WINDOW w AS (PARTITION BY doc_id ORDER BY j)),
 fl AS (SELECT *, {_stripped("coalesce(before || chr(10), '') || text")} AS t FROM lk)
 SELECT source AS doc, doc_id AS page_num, piece, length(t) AS char_length, n > 1 AS has_overlap, md5(t) AS text_md5 FROM fl JOIN documents USING (doc_id)""",
    "bm25_topk": f"WITH {_BM25} SELECT query_id, doc_id, rank, score FROM bmr WHERE rank < 10 AND score > 0",
    "bm25_after_changes": f"WITH live AS MATERIALIZED (SELECT * FROM documents WHERE lang IS NULL OR lang NOT IN ('de', 'fr')), {_BM25.replace('FROM documents', 'FROM live')} SELECT query_id, doc_id, rank, score FROM bmr WHERE rank < 10 AND score > 0",
    "vector_topk": """WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) - 1 AS rank FROM s) SELECT query_id, vec_id, rank, score FROM r WHERE rank < 10""",
    "vector_validation": "SELECT vec_id, vec_id % 7 = 0 AS invalid FROM embeddings",
    "source_weights": f"SELECT doc_id, kind AS source_type, {_WEIGHT} AS weight FROM (SELECT doc_id, {_KIND} AS kind FROM documents)",
    "source_distribution": f"SELECT {_KIND} AS source_type, count(*) AS n FROM documents GROUP BY 1",
    "retag_report": f"SELECT before, after, count(*) AS n, count(*) FILTER (before <> after) AS changed FROM (SELECT {_KIND} AS before, CASE WHEN contains(source, 'src1') THEN 'oral' WHEN contains(source, 'src3') THEN 'original' ELSE 'unknown' END AS after FROM documents) GROUP BY before, after",
    "rrf_fusion": f"WITH {_FUSED} SELECT query_id, doc_id, score, vector_rank, bm25_rank FROM fused",
    "rrf_contrib": f"WITH {_FUSED} SELECT query_id, doc_id, class, round(part, 9) AS part FROM part",
    "hybrid_two_segment": f"WITH {_SELECT} SELECT query_id, doc_id, rank, rrf_rank, score, rerank FROM picked",
    "rank_swap": f"WITH {_SELECT}, a AS (SELECT query_id, list(doc_id) AS a FROM fr WHERE rrf_rank < 6 GROUP BY query_id), b AS (SELECT query_id, list(doc_id) AS b FROM picked GROUP BY query_id) SELECT query_id, len(list_intersect(a, b)) AS overlap, round(len(list_intersect(a, b)) / len(list_distinct(a || b)), 6) AS jaccard FROM a FULL JOIN b USING (query_id)",
    "numbering_two_series": f"WITH {_EVIDENCE} SELECT query_id, pos, inferred, label FROM num",
    "context_assembly": f"""WITH {_EVIDENCE}, t AS (SELECT *, CASE WHEN {_TAIL} <> '' AND {_RT} <> '' AND NOT regexp_matches({_RT}, '[{P.STITCH_ENDS}]$') AND regexp_matches(right({_RT}, 8), '[\\p{{L}}\\p{{N}}]') THEN {_RT} || chr(10) || {_TAIL} ELSE text END AS full_text FROM num)
 SELECT query_id, string_agg(label || ' (' || source || ') ' || full_text, chr(10) ORDER BY pos) AS context, string_agg(label || ' ' || source, chr(10) ORDER BY pos) AS sources FROM t GROUP BY query_id""",
    "cont_tail": r"""WITH p AS (SELECT doc_id, text, unnest(range(0, greatest((length(text) - 1) // 400, 0) + 1)) AS part FROM documents), s AS (SELECT *, greatest(part * 400 - CASE WHEN part % 4 = 3 THEN 90 ELSE 100 END, 0) AS st FROM p),
 c AS (SELECT doc_id, part, substr(text, st + 1, (part + 1) * 400 - st) AS chunk FROM s), n AS (SELECT *, lead(chunk) OVER (PARTITION BY doc_id ORDER BY part) AS nxt FROM c), r AS (SELECT *, ltrim(substr(nxt, 101), ' ') AS rest FROM n WHERE nxt IS NOT NULL),
 f AS (SELECT *, regexp_extract(rest, '^([^.!?]*[.!?])', 1) AS first FROM r) SELECT doc_id, part, CASE WHEN length(chunk) > 100 AND left(nxt, 100) = right(chunk, 100) THEN CASE WHEN first <> '' THEN first ELSE rest END ELSE '' END AS cont_tail FROM f""",
    "fixed_slice_overlap": "WITH p AS (SELECT doc_id, text, unnest(range(0, greatest((length(text) - 1) // 1000, 0) + 1)) AS part FROM documents), o AS (SELECT doc_id, part, substr(text, part * 1000 + 1, 1000) AS own FROM p), l AS (SELECT *, lag(own) OVER (PARTITION BY doc_id ORDER BY part) AS p FROM o) SELECT doc_id, part, md5(CASE WHEN p IS NULL THEN own ELSE right(p, 100) || chr(10) || own END) AS chunk_md5 FROM l",
}
