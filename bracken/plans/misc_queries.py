"""Queries of the remaining small operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import structured as S
from ..functions import text as T
from ..operators import dedup, filters, ingest, meeting, rerank
from ..session import table
from ..sources import files, markdown, sinks
from . import retrieval_queries


def message_assembly(spark, sf):
    c = table(spark, sf, "conversations")
    part = F.when(F.col("turn") == 0, "query").when(F.col("role") == "system", "persona").when(F.col("turn") % 3 == 0, "evidence").otherwise("history")
    return S.messages(c.select(F.col("conv_id").alias("request"), part.alias("part"), F.col("turn").alias("pos"), "text")).select("request", F.md5("text").alias("text_md5"), "chars")


def summary_slots(spark, sf):
    p = table(spark, sf, "part")
    text = F.concat(F.lit("2: "), "p_name", F.lit("\n1： "), "p_type", F.lit(" \n2: again\n7: far"))
    slots = S.summary_slots(text, 3)
    return p.select("p_partkey", F.get(slots, F.lit(0)).alias("a"), F.get(slots, F.lit(1)).alias("b"), F.get(slots, F.lit(2)).alias("c"))


def page_prefix(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", S.page_prefix(F.col("p_brand"), F.col("p_name"), F.col("p_size"), F.lit(50), F.col("p_type")).alias("prefix"), S.filled("I am {{char}}.", F.col("p_name")).alias("greeting"))


def dpi_choice(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.groupBy("l_orderkey").agg(F.max("l_extendedprice").alias("longest"), F.max("l_quantity").alias("w"), F.min("l_quantity").alias("h")).select("l_orderkey", T.dpi(F.col("longest") / 2).alias("dpi"), filters.spread(F.col("w"), F.col("h")).alias("spread"))


def budget_gate(spark, sf):
    o = table(spark, sf, "customer")
    used, bidders = F.col("c_custkey") % 17, F.col("c_custkey") % 5
    return o.select("c_custkey", meeting.attempts(used, bidders).alias("attempts"), meeting.stops(used, bidders, F.lit(12)).alias("stops"))


def job_status(spark, sf):
    c = table(spark, sf, "customer")
    return c.select("c_custkey", S.job_status(F.col("c_custkey") % 2 == 0, F.col("c_custkey") % 3 == 0, F.when(F.col("c_custkey") % 5 == 0, "running").otherwise("none")).alias("status"))


def cache_keys(spark, sf):
    return table(spark, sf, "documents").select("doc_id", rerank.cache_key("v1", "m", F.col("text")).alias("key"))


def file_routes(spark, sf):
    p = table(spark, sf, "part")
    ext = F.element_at(F.array(*map(F.lit, (".pdf", ".md", ".py", ".csv", ".bin"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    return p.select("p_partkey", files.reader(ext).alias("reader"), T.without_extension(F.concat("p_name", ext)).alias("title"))


def code_definitions(spark, sf):
    p = table(spark, sf, "part")
    code = F.concat(F.lit("class A"), F.col("p_partkey").cast("string"), F.lit(":\n    def f"), F.col("p_size").cast("string"), F.lit("(self): pass\nfunction g() {}"))
    return p.select("p_partkey", F.array_join(markdown.definitions(code), ",").alias("names"))


def markdown_elements(spark, sf):
    d = table(spark, sf, "documents")
    text = F.concat(F.lit("# "), "source", F.lit("\n"), "text", F.lit("\n\n- one\n- two\n```py\nx = 1\n```\nend"))
    return d.select("doc_id", F.posexplode(markdown.parsed(text)).alias("pos", "e")).select("doc_id", "pos", "e.kind", "e.level", "e.content")


def merged_rows(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_type", "value")
    old = e.groupBy("user_id", "event_type").agg(F.min("value").alias("value"))
    new = e.filter("value > 100").groupBy("user_id", "event_type").agg(F.max("value").alias("value"))
    return sinks.merged(old, new, ["user_id", "event_type"])


def loose_json(spark, sf):
    e = table(spark, sf, "events")
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("so: ```json\n"), "props", F.lit("\n```"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("I say "), "props", F.lit(" {"))).otherwise("none")
    return e.select("event_id", F.get_json_object(S.loose_json(raw), "$.k").cast("long").alias("k"))


def strict_json(spark, sf):
    """TXT-23: what is wrong with an object, if anything is."""
    e = table(spark, sf, "events")
    raw = F.when(F.col("event_id") % 4 == 0, F.col("props")).when(F.col("event_id") % 4 == 1, '{"k": 1, "k": 2}').when(F.col("event_id") % 4 == 2, '{"k": NaN}').otherwise('{"k": true}')
    return e.select("event_id", S.strict_error(raw, {"k": "int"}).alias("error"))


def decoded_texts(spark, sf):
    """SRC-02, SRC-03: bytes in two encodings by the first decoder that fits."""
    d = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("书 "), F.regexp_replace("text", "[^\\x00-\\x7f]", "x")).alias("text"))
    raw = F.when(F.col("doc_id") % 2 == 0, F.encode("text", "UTF-8")).otherwise(F.concat(F.unhex(F.lit("CAE9")), F.encode(F.substring("text", 2, 1 << 30), "UTF-8")))
    return d.select("doc_id", F.md5(files.decoded(raw)).alias("text_md5"), files.text_chars(raw).cast("long").alias("chars"))


def shallowest_files(spark, sf):
    """TOP-09: of equal files the one of the shallowest path stays."""
    p = table(spark, sf, "part")
    path = F.concat(F.repeat(F.lit("/d"), (F.col("p_partkey") % 4 + 1).cast("int")), F.lit("/f"), F.col("p_partkey").cast("string"))
    return dedup.shallowest(p.select(path.alias("path"), (F.col("p_partkey") % 97).alias("sha"))).select("path", "keeper")


def rerank_scores(spark, sf):
    """RET-05: a scorer of heads of texts; a query with one candidate is not asked."""
    q = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("query"))
    d = table(spark, sf, "documents").select((F.col("doc_id") % 60).alias("item_id"), "doc_id", "text").filter("doc_id < 60 OR item_id % 3 <> 0")
    pairs = q.join(d, "item_id")
    return rerank.scored(pairs, lambda qs, ts: [float(len(a) + len(b)) for a, b in zip(qs, ts)], 20).select("item_id", "doc_id", "rerank")


def ingest_chunks(spark, sf):
    """RET-12 with an embedder that counts, and a cache that has some of the texts."""
    d = table(spark, sf, "documents").select("doc_id", "text", "source")
    cache = ingest.ingested(d.filter("doc_id % 10 = 0"), spark.createDataFrame([], "key string, vec array<float>"), lambda ts: [[-1.0, 0.0]] * len(ts), "v1", "m").select("key", "vec").distinct()
    out = ingest.ingested(d, cache, lambda ts: [[float(len(t)), float(t.count("a"))] for t in ts], "v1", "m")
    return out.select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), "source_type", F.col("vec")[0].cast("double").alias("a"), F.col("vec")[1].cast("double").alias("b"))


QUERIES = {f.__name__: f for f in (message_assembly, summary_slots, page_prefix, dpi_choice, budget_gate, job_status, cache_keys, file_routes, code_definitions, markdown_elements, merged_rows, loose_json, strict_json, decoded_texts, shallowest_files, rerank_scores, ingest_chunks)}
ORACLES = {
    "markdown_elements": r"""WITH d AS (SELECT doc_id, '# ' || source || chr(10) || text || chr(10) || chr(10) || '- one' || chr(10) || '- two' AS t FROM documents), l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS p FROM d),
 k AS (SELECT *, CASE WHEN regexp_full_match(line, '\s*') THEN 'blank' WHEN regexp_matches(line, '^#{1,6}\s+.') THEN 'heading' WHEN regexp_matches(line, '^\s*\|') THEN 'table' WHEN regexp_matches(line, '^\s*(?:[-*+]|\d+[.)])\s+') THEN 'list' ELSE 'paragraph' END AS kind FROM l),
 n AS (SELECT *, CASE WHEN kind = 'heading' OR kind <> lag(kind, 1, '') OVER w THEN 1 ELSE 0 END AS new FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY p)), i AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS island FROM n),
 e AS (SELECT doc_id, island, kind, string_agg(line, chr(10) ORDER BY p) AS c FROM i WHERE kind <> 'blank' GROUP BY ALL),
 o AS (SELECT doc_id, island, kind, CASE WHEN kind = 'heading' THEN length(regexp_extract(c, '^(#+)', 1)) ELSE 0 END AS level, CASE WHEN kind = 'heading' THEN regexp_extract(c, '^#{1,6}\s+(.+?)\s*#*$', 1) ELSE regexp_replace(c, '^\s+|\s+$', '', 'g') END AS content FROM e UNION ALL SELECT doc_id, 1000000, 'paragraph', 0, 'end' FROM documents UNION ALL SELECT doc_id, 1000001, 'code', 0, 'x = 1' FROM documents)
 SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY island) - 1 AS pos, kind, level, content FROM o""",
    "strict_json": "SELECT event_id, CASE event_id % 4 WHEN 1 THEN 'duplicate key' WHEN 2 THEN 'constant NaN' WHEN 3 THEN 'type of k' END AS error FROM events",
    "decoded_texts": "WITH d AS (SELECT doc_id, '书 ' || regexp_replace(text, '[^\\x00-\\x7f]', 'x', 'g') AS t FROM documents) SELECT doc_id, md5(t) AS text_md5, length(regexp_replace(t, '[\\s\\x0b\\x1c-\\x1f]', '', 'g')) AS chars FROM d",
    "shallowest_files": "WITH f AS (SELECT repeat('/d', CAST(p_partkey % 4 + 1 AS INT)) || '/f' || CAST(p_partkey AS VARCHAR) AS path, p_partkey % 97 AS sha, p_partkey % 4 AS depth FROM part) SELECT path, first_value(path) OVER (PARTITION BY sha ORDER BY depth, path) AS keeper FROM f",
    "rerank_scores": "WITH p AS (SELECT item_id, b.text AS query, doc_id, left(d.text, 20) AS head FROM benchmark b JOIN documents d ON d.doc_id % 60 = item_id WHERE doc_id < 60 OR doc_id % 60 % 3 <> 0), n AS (SELECT query, count(DISTINCT head) AS n FROM p GROUP BY query) SELECT item_id, doc_id, CASE WHEN n = 1 THEN 1.0 ELSE length(query) + length(head) END::DOUBLE AS rerank FROM p JOIN n USING (query)",
    "ingest_chunks": "WITH RECURSIVE " + retrieval_queries._chunks("SELECT doc_id, unnest(l) AS content, generate_subscripts(l, 1) AS p FROM (SELECT doc_id, list_filter(string_split_regex(text, chr(10) || '+'), lambda x: trim(x) <> '') AS l FROM documents)") + f""", lk AS (SELECT doc_id, row_number() OVER w - 1 AS ordinal, text, right(lag(text) OVER w, 100) AS before FROM ch WINDOW w AS (PARTITION BY doc_id ORDER BY j)),
 ft AS (SELECT doc_id, ordinal, coalesce(before || chr(10), '') || text AS t FROM lk), kn AS (SELECT DISTINCT t FROM ft WHERE doc_id % 10 = 0)
 SELECT doc_id, ordinal, {retrieval_queries._KIND} AS source_type, CASE WHEN kn.t IS NULL THEN length(ft.t) ELSE -1 END::DOUBLE AS a, CASE WHEN kn.t IS NULL THEN length(ft.t) - length(replace(ft.t, 'a', '')) ELSE 0 END::DOUBLE AS b FROM ft JOIN documents USING (doc_id) LEFT JOIN kn ON kn.t = ft.t""",
    "message_assembly": "WITH p AS (SELECT conv_id AS request, turn, text, CASE WHEN turn = 0 THEN 6 WHEN role = 'system' THEN 1 WHEN turn % 3 = 0 THEN 3 ELSE 4 END AS o FROM conversations WHERE text <> '') SELECT request, md5(string_agg(text, chr(10) || chr(10) ORDER BY o, turn)) AS text_md5, CAST(sum(length(text)) AS BIGINT) AS chars FROM p GROUP BY request",
    "summary_slots": "SELECT p_partkey, p_type AS a, p_name AS b, '' AS c FROM part",
    "page_prefix": "SELECT p_partkey, '[' || p_brand || '] ' || p_name || ', page ' || CAST(p_size AS VARCHAR) || ' of 50 (' || p_type || ')' AS prefix, 'I am ' || p_name || '.' AS greeting FROM part",
    "dpi_choice": "WITH g AS (SELECT l_orderkey, max(l_extendedprice) / 2 AS x, max(l_quantity) AS w, min(l_quantity) AS h FROM lineitem GROUP BY l_orderkey) SELECT l_orderkey, list_filter([300, 200, 150, 100, 72, 50, 30], lambda d: x * d / 72 <= 8000)[1] AS dpi, w > h AND w / h >= 1.2 AS spread FROM g",
    "budget_gate": "SELECT c_custkey, CAST(least(3, floor((c_custkey % 17) / greatest(c_custkey % 5, 1))) AS INT) AS attempts, CASE WHEN c_custkey % 17 + c_custkey % 5 + 1 > 12 THEN 'before bids' WHEN c_custkey % 17 + 1 > 12 THEN 'after bids' END AS stops FROM customer",
    "job_status": "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'building' WHEN c_custkey % 2 = 0 THEN 'done' WHEN c_custkey % 3 = 0 THEN 'interrupted' ELSE 'idle' END AS status FROM customer",
    "cache_keys": "SELECT doc_id, left(sha256('v1' || chr(31) || 'm' || chr(31) || text), 16) AS key FROM documents",
    "file_routes": "SELECT p_partkey, ['pdf', 'markdown', 'code', 'text', 'try text'][p_partkey % 5 + 1] AS reader, p_name || CASE p_partkey % 5 WHEN 2 THEN '.py' WHEN 4 THEN '.bin' ELSE '' END AS title FROM part",
    "code_definitions": "SELECT p_partkey, 'A' || CAST(p_partkey AS VARCHAR) || ',f' || CAST(p_size AS VARCHAR) || ',g' AS names FROM part",
    "merged_rows": "WITH o AS (SELECT user_id, event_type, min(value) AS v FROM events GROUP BY 1, 2), n AS (SELECT user_id, event_type, max(value) AS v FROM events WHERE value > 100 GROUP BY 1, 2) SELECT user_id, event_type, coalesce(n.v, o.v) AS value FROM o LEFT JOIN n USING (user_id, event_type)",
    "loose_json": "SELECT event_id, CASE WHEN event_id % 3 < 2 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events",
}
