"""Queries over text: filters, scalar functions, HTML, sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import profiles as P
from ..functions import text as T
from ..operators import dedup, filters
from ..session import table

L = P.LATIN
STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def _s(x: str) -> str:
    return STRIP.format(x)


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


KIND = f"""CASE WHEN length(t) < {L.min_any} THEN 'fragment' WHEN regexp_matches(t, '{L.strong}') THEN 'copyright'
 WHEN len(list_distinct(regexp_extract_all(t, '{L.boilerplate}'))) >= 2 THEN 'copyright' WHEN len(regexp_extract_all(t, '{L.toc_line}')) >= 3 THEN 'toc'
 WHEN length(t) < 100 AND regexp_matches(t, '{L.publishing}') THEN 'publication_fragment' ELSE '' END"""
LISTED = f"""({_s("x")} <> '' AND (regexp_matches({_s("x")}, '{L.toc_line}') OR (length({_s("x")}) <= 40 AND NOT regexp_matches({_s("x")}, '{L.sentence_end}') AND regexp_matches({_s("x")}, '{L.toc_head}'))
 OR regexp_matches({_s("x")}, '{L.strong}') OR regexp_matches({_s("x")}, '{L.boilerplate}')))"""
LINES = f"{_s(f'''array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT {LISTED}), chr(10))''')}"
CLEAN = f"""WITH a AS (SELECT doc_id, text, {_s("text")} AS t FROM documents), b AS (SELECT doc_id, text, {KIND} AS kind, {LINES} AS rest FROM a),
c AS (SELECT *, length(rest) >= {L.min_useful} AND len(regexp_extract_all(rest, '{L.sentence_end}')) / length(rest) * 100 >= {L.min_density} AS ok FROM b),
d AS (SELECT doc_id, kind, CASE WHEN kind = '' THEN text WHEN ok THEN rest ELSE '' END AS cleaned FROM c) """


def front_matter_kind(spark, sf):
    return _docs(spark, sf).select("doc_id", T.front_matter_kind(F.col("text"), L).alias("kind"))


def strip_lines(spark, sf):
    return _docs(spark, sf).select("doc_id", F.md5(T.strip_front_matter_lines(F.col("text"), L)).alias("rest_md5"), F.length(T.strip_front_matter_lines(F.col("text"), L)).cast("long").alias("rest_chars"))


def clean_chunk(spark, sf):
    return filters.cleaned(_docs(spark, sf), L).select("doc_id", "kind", F.md5("cleaned").alias("cleaned_md5"), F.length("cleaned").cast("long").alias("char_length"))


def drop_histogram(spark, sf):
    return filters.drop_histogram(filters.cleaned(_docs(spark, sf), L))


def noise_lines(spark, sf):
    noise = F.concat_ws("\n", F.lit(""), F.col("doc_id").cast("string"), F.lit("~ 12 ~"), F.lit("2020.1.2"), F.lit("* * *"), F.lit("定价： 10 元"), F.lit("仅供 试读"), F.lit("a line of text"))
    lines = _docs(spark, sf).select("doc_id", F.posexplode(F.split(F.concat("text", noise), "\n")).alias("pos", "line"))
    return lines.filter(T.is_ocr_noise(F.col("line")) | T.is_vision_noise(F.col("line"))).select("doc_id", F.col("pos").cast("long").alias("pos"), "line")


_C = "regexp_replace(line, '\\s+', '', 'g')"
NOISE = f"""({_C} = '' OR regexp_full_match({_C}, '\\d{{1,6}}') OR regexp_full_match({_C}, '[~～\\-—·*※＝=]+\\d{{1,4}}[~～\\-—·*※＝=]+') OR regexp_full_match({_C}, '\\d{{2,4}}[./]\\d{{1,2}}(?:[./]\\d{{1,2}})?')
 OR (length({_C}) <= 8 AND regexp_full_match({_C}, '[^\\p{{L}}\\p{{N}}]+')) OR (length({_C}) < 50 AND regexp_matches({_C}, '{"|".join(P.OCR_NOISE)}')) OR regexp_matches({_C}, '{"|".join(P.VISION_NOISE)}'))"""


def toc_docs(spark, sf):
    return _docs(spark, sf).select("doc_id", T.is_toc_page(F.split("text", "\n")).alias("is_toc"))


def char_ratios(spark, sf):
    return _docs(spark, sf).select("doc_id", F.round(T.mark_ratio(F.col("text"), "éèêñß"), 6).alias("mark_ratio"), (T.mark_ratio(F.col("text"), "éèêñß") >= P.MOJIBAKE_RATIO).alias("marked"), F.round(T.bad_ratio(F.col("text")), 6).alias("bad_ratio"))


LATIN_TERMS = ("stupid", "idiot", "pathetic")


def banned_terms(spark, sf):
    return _docs(spark, sf).select("doc_id", T.contains_any(F.col("text"), LATIN_TERMS).alias("banned"), F.md5(T.refused(F.col("text"), LATIN_TERMS)).alias("output_md5"))


EXCLUDE = (("ring", "jewellery"), ("red", "colour"), ("small", "size"))


def exclusion_rules(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_name")
    return filters.excluded(part, "p_name", EXCLUDE, ("large widget",)).filter("reason IS NOT NULL")


def needs_vision(spark, sf):
    pages = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("doc"), F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")).alias("page"), (F.col("l_quantity") * 8).alias("chars"))
    return filters.needs_vision(pages)


def screenshots(spark, sf):
    li = table(spark, sf, "lineitem")
    return filters.screenshots(li.select(F.col("l_orderkey").alias("doc"), (F.col("l_quantity") + 1).alias("w"), ((F.col("l_quantity") + 1) * (F.col("l_linenumber") + 1)).alias("h")))


def field_definitions(spark, sf):
    raw = table(spark, sf, "events").select(F.col("user_id").alias("save_id"), F.col("event_id").alias("ordinal"), F.concat("event_type", (F.col("event_id") % 3).cast("string")).alias("name"), F.when(F.col("value") > 20, "number").when(F.col("value") > 5, "tag").alias("kind"))
    return filters.field_definitions(raw)


def slugs(spark, sf):
    return table(spark, sf, "part").select("p_partkey", filters.slug(F.col("p_name")).alias("slug"), filters.is_account(F.col("p_brand")).alias("is_account"))


def sentence_split(spark, sf):
    return _docs(spark, sf).select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence")).select("doc_id", F.col("pos").cast("long").alias("pos"), "sentence")


def index_tokens(spark, sf):
    tok = _docs(spark, sf).select("doc_id", T.index_tokens(F.col("text")).alias("w"))
    return tok.select("doc_id", F.size("w").cast("long").alias("n_tokens"), F.md5(F.array_join("w", " ")).alias("tokens_md5"))


def entity_keys(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", T.entity_key(F.concat("c_name", F.lit(" "), "c_mktsegment")).alias("key"))


def continuation_need(spark, sf):
    c = F.regexp_replace("text", "[^ ]*[aeiou.]$", "")
    return _docs(spark, sf).select("doc_id", T.needs_continuation(c, ".!?").alias("needs"), T.ends_sentence(c, ".!?;").alias("ends"))


def query_budget(spark, sf):
    return _docs(spark, sf).select("doc_id", T.bounded(F.col("text")).alias("query"), T.bullet(F.col("text")).alias("bullet"))


def joined_lines(spark, sf):
    return _docs(spark, sf).select("doc_id", F.md5(T.joined_lines(F.split("text", "\n"))).alias("joined_md5"))


def triple_lines(spark, sf):
    c = table(spark, sf, "customer")
    line = F.when(F.col("c_custkey") % 3 == 0, F.concat_ws("|", "c_name", F.lit("Person"), F.lit("buys in"), "c_mktsegment", F.lit("concept"), F.lit("row|"), F.col("c_custkey").cast("string"))).when(F.col("c_custkey") % 3 == 1, F.concat_ws("|", "c_name", F.lit("lives"), "c_nationkey", F.lit("a|b"))).otherwise(F.concat_ws("|", F.lit("x"), F.lit("is"), F.lit("X "), F.lit("self")))
    out = c.select("c_custkey", T.triple(line).alias("t"))
    return out.filter("t IS NOT NULL").select("c_custkey", "t.h", "t.ht", "t.r", "t.t", "t.tt", "t.e")


def citation_stats(spark, sf):
    from pyspark.sql import Column  # noqa: F401

    d = _docs(spark, sf)
    cited = F.concat("text", F.lit(" ["), (F.col("doc_id") % 9).cast("string"), F.lit("] [G"), (F.col("doc_id") % 4).cast("string"), F.lit("] ["), (F.col("doc_id") % 5).cast("string"), F.lit("]"))
    plain, graph = T.citations(cited)
    return d.select("doc_id", F.size(plain).cast("long").alias("n_plain"), F.size(graph).cast("long").alias("n_graph"), F.exists(plain, lambda x: x > 6).alias("out_of_range"))


SCORES = ("4", "4分", "4/5", "4/10", "4.0", "4.5", "true", "0", "6", " 3 / 5 分", "", "x")


def score_normalise(spark, sf):
    raw = table(spark, sf, "labels").select("doc_id", F.element_at(F.array(*map(F.lit, SCORES)), (F.col("doc_id") % len(SCORES) + 1).cast("int")).alias("raw"))
    return raw.select("doc_id", "raw", T.score(F.col("raw")).alias("score"))


RAW = ("1.256", "true", "nan", "Infinity", "", " ", "2e9", "-3.14159", "abc", "7")


def value_coercion(spark, sf):
    raw = table(spark, sf, "part").select("p_partkey", F.element_at(F.array(*map(F.lit, RAW)), (F.col("p_partkey") % len(RAW) + 1).cast("int")).alias("raw"))
    return raw.select("p_partkey", T.coerced_number(F.col("raw")).alias("number"), F.left(T.strip("raw"), F.lit(24)).alias("tag"), T.masked(F.concat("raw", F.col("p_partkey").cast("string"))).alias("masked"))


def html_strip(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.strip_html(F.col("html")).alias("plain"))


def html_paragraphs(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.posexplode(T.html_blocks(F.col("html"))).alias("pos", "block")).select("page_id", F.col("pos").cast("long").alias("pos"), "block")


def snippet_topk(spark, sf):
    return filters.snippets(html_paragraphs(spark, sf))


def exact_dups(spark, sf):
    return dedup.exact_groups(_docs(spark, sf).select("doc_id", "text"))


def content_id_dups(spark, sf):
    return dedup.content_ids(_docs(spark, sf).select("doc_id", "source", "text"))


def title_normalise(spark, sf):
    stem = F.concat("p_name", F.lit("（"), "p_type", F.lit("）_"), F.when(F.col("p_size") % 2 == 0, "扫描版").otherwise("第3版pdf"), F.lit(".txt"))
    return table(spark, sf, "part").select("p_partkey", T.normalise_title(stem).alias("title"))


def cross_format_dedup(spark, sf):
    p = table(spark, sf, "part")
    files = p.select(F.col("p_partkey").alias("file_id"), F.concat("p_name", F.floor(F.col("p_partkey") / 2).cast("string"), F.when(F.col("p_partkey") % 2 == 0, "扫描版").otherwise("")).alias("stem"), F.when(F.col("p_partkey") % 2 == 0, ".pdf").otherwise(".txt").alias("ext"), (F.col("p_size") * 4).alias("pages"), (F.col("p_retailprice") * 120).cast("long").alias("chars"))
    files = files.withColumn("stem", F.regexp_replace(F.col("stem"), "^[a-z ]+", "book"))
    return dedup.cross_format(files).select("file_id", "title", "dropped")


def ordered_distinct(spark, sf):
    lines = F.array_distinct(F.filter(F.transform(F.split("text", "\n"), T.strip), lambda x: x != ""))
    return _docs(spark, sf).select("doc_id", F.size(lines).cast("long").alias("n_lines"), F.md5(F.array_join(lines, "\n")).alias("lines_md5"))


def font_heading_pick(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("doc"), (F.col("l_quantity") / 2 + 6).alias("size"), F.col("l_linenumber").cast("long").alias("chars"))
    return filters.heading_sizes(li)


QUERIES = {f.__name__: f for f in (front_matter_kind, strip_lines, clean_chunk, drop_histogram, noise_lines, toc_docs, char_ratios, banned_terms, exclusion_rules, needs_vision, screenshots, field_definitions, slugs, sentence_split, index_tokens, entity_keys, continuation_need, query_budget, joined_lines, triple_lines, citation_stats, score_normalise, value_coercion, html_strip, html_paragraphs, snippet_topk, exact_dups, content_id_dups, title_normalise, cross_format_dedup, ordered_distinct, font_heading_pick)}

_PLAIN = _s(r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '(?i)&[a-z]+;', ' ', 'g'), '\s+', ' ', 'g')")
_BLOCKS = (
    """SELECT page_id, unnest(list_transform(regexp_extract_all(html, '(?is)<li[^>]*class="[^"]*b_algo[^"]*"[^>]*>.*?</li>') || regexp_extract_all(html, '(?is)<div[^>]*class="[^"]*c-abstract[^"]*"[^>]*>.*?</div>') || regexp_extract_all(html, '(?is)<td[^>]*class="[^"]*result-snippet[^"]*"[^>]*>.*?</td>')
 || regexp_extract_all(html, '(?is)<p[^>]*>(.*?)</p>', 1), lambda h: """ + _PLAIN.format("h") + ")) AS block, "
)
_PARAGRAPHS = _BLOCKS + "generate_subscripts(regexp_extract_all(html, '(?is)<li[^>]*class=\"[^\"]*b_algo[^\"]*\"[^>]*>.*?</li>') || regexp_extract_all(html, '(?is)<div[^>]*class=\"[^\"]*c-abstract[^\"]*\"[^>]*>.*?</div>') || regexp_extract_all(html, '(?is)<td[^>]*class=\"[^\"]*result-snippet[^\"]*\"[^>]*>.*?</td>') || regexp_extract_all(html, '(?is)<p[^>]*>(.*?)</p>', 1), 1) - 1 AS pos FROM pages"
_TITLE = "regexp_replace(regexp_replace(regexp_replace({}, '" + P.TITLE_BRACKETS + "', '', 'g'), '" + P.TITLE_PUNCTUATION.replace("'", "''") + "', '', 'g'), '(?:\\.?(?:" + P.TITLE_TAIL + "))*\\.?$', '')"

ORACLES = {
    "front_matter_kind": f"WITH a AS (SELECT doc_id, {_s('text')} AS t FROM documents) SELECT doc_id, {KIND} AS kind FROM a",
    "strip_lines": f"SELECT doc_id, md5({LINES}) AS rest_md5, CAST(length({LINES}) AS BIGINT) AS rest_chars FROM documents",
    "clean_chunk": CLEAN + "SELECT doc_id, kind, md5(cleaned) AS cleaned_md5, length(cleaned) AS char_length FROM d",
    "drop_histogram": CLEAN + "SELECT kind AS reason, count(*) AS n_chunks, count(*) FILTER (cleaned = '') AS n_dropped FROM d WHERE kind <> '' GROUP BY kind",
    "noise_lines": f"WITH l AS (SELECT doc_id, unnest(string_split(text || chr(10) || concat_ws(chr(10), CAST(doc_id AS VARCHAR), '~ 12 ~', '2020.1.2', '* * *', '定价： 10 元', '仅供 试读', 'a line of text'), chr(10))) AS line, generate_subscripts(string_split(text || repeat(chr(10), 7), chr(10)), 1) - 1 AS pos FROM documents) SELECT doc_id, CAST(pos AS BIGINT) AS pos, line FROM l WHERE {NOISE}",
    "toc_docs": r"WITH a AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) SELECT doc_id, len(l) >= 5 AND len(list_filter(list_transform(l, lambda x: regexp_replace(x, '\s+', '', 'g')), lambda c: c <> '' AND length(c) < 40 AND regexp_matches(c, '\d+$'))) >= greatest(3, CAST(floor(len(l) * 0.4) AS INT)) AS is_toc FROM a",
    "char_ratios": r"WITH a AS (SELECT doc_id, text, substr(text, 1, 3000) AS s FROM documents), b AS (SELECT *, length(regexp_replace(s, '[^éèêñß]', '', 'g')) / length(s) AS r FROM a) SELECT doc_id, round(r, 6) AS mark_ratio, r >= 0.02 AS marked, round(len(regexp_extract_all(text, '[\x{fffd}\x{e000}-\x{f8ff}\x00-\x08\x0b-\x1f\x7f-\x{9f}]')) / greatest(length(text), 1), 6) AS bad_ratio FROM b",
    "banned_terms": f"WITH a AS (SELECT doc_id, text, regexp_matches(text, 'stupid|idiot|pathetic') AS banned FROM documents) SELECT doc_id, banned, md5(CASE WHEN banned THEN '{P.REFUSAL}' ELSE text END) AS output_md5 FROM a",
    "exclusion_rules": "SELECT * FROM (SELECT p_partkey, p_name, CASE WHEN p_name = 'large widget' THEN 'listed' WHEN contains(p_name, 'ring') THEN 'jewellery' WHEN contains(p_name, 'red') THEN 'colour' WHEN contains(p_name, 'small') THEN 'size' END AS reason FROM part) WHERE reason IS NOT NULL",
    "needs_vision": """WITH p AS (SELECT l_suppkey AS doc, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS page, l_quantity * 8 AS chars, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem),
 s AS (SELECT * FROM p WHERE page = 1 OR page = n OR (page - 1) % greatest(1, n // 12) = 0) SELECT doc, count(*) AS n_sampled, round(avg(CASE WHEN chars >= 200 THEN 1.0 ELSE 0.0 END), 6) AS ok_ratio, avg(CASE WHEN chars >= 200 THEN 1.0 ELSE 0.0 END) < 0.5 AS needs_vision FROM s GROUP BY doc""",
    "screenshots": "SELECT l_orderkey AS doc, bool_and((l_quantity + 1) * (l_linenumber + 1) / (l_quantity + 1) >= 3.0) AS is_screenshot FROM lineitem GROUP BY l_orderkey",
    "field_definitions": "WITH r AS (SELECT user_id AS save_id, event_id AS ordinal, event_type || CAST(event_id % 3 AS VARCHAR) AS name, CASE WHEN value > 20 THEN 'number' WHEN value > 5 THEN 'tag' END AS kind FROM events), n AS (SELECT *, row_number() OVER (PARTITION BY save_id, name ORDER BY ordinal) AS rn FROM r WHERE regexp_full_match(name, '[A-Za-z][A-Za-z0-9_]{0,23}')) SELECT save_id, name, coalesce(kind, 'number') AS kind, ordinal FROM n WHERE rn = 1",
    "slugs": "SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, regexp_full_match(p_brand, '[A-Za-z0-9_]{3,32}') AS is_account FROM part",
    "sentence_split": f"WITH a AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([。！？.!?])', '\\1' || chr(10), 'g'), chr(10)), lambda x: {_s('x')}), lambda x: x <> '') AS s FROM documents) SELECT doc_id, unnest(s) AS sentence, generate_subscripts(s, 1) - 1 AS pos FROM a",
    "index_tokens": r"WITH a AS (SELECT doc_id, regexp_extract_all(regexp_replace(text, '([\x{4e00}-\x{9fff}])', ' \1 ', 'g'), '\S+') AS w FROM documents) SELECT doc_id, len(w) AS n_tokens, md5(array_to_string(w, ' ')) AS tokens_md5 FROM a",
    "entity_keys": "SELECT c_custkey, regexp_replace(lower(c_name || ' ' || c_mktsegment), '[^a-z0-9_]', '', 'g') AS key FROM customer",
    "continuation_need": r"WITH a AS (SELECT doc_id, regexp_replace(regexp_replace(text, '[^ ]*[aeiou.]$', ''), '\s+$', '') AS t FROM documents) SELECT doc_id, t <> '' AND NOT regexp_matches(t, '[.!?]$') AND regexp_matches(right(t, 8), '[\p{L}\p{N}]') AS needs, regexp_matches(t, '[.!?;]$') AS ends FROM a",
    "query_budget": f"SELECT doc_id, CASE WHEN length(text) <= 450 THEN text ELSE substr(text, 1, 223) || '...' || right(text, 224) END AS query, '- ' || {_s(chr(39).join(['regexp_replace(substr(text, 1, 150), ', chr(92) + 's+', ', ', ' ', ', ', 'g', ')']))} AS bullet FROM documents",
    "joined_lines": f"SELECT doc_id, md5(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: {_s('x')}), lambda x: x <> ''), ' ')) AS joined_md5 FROM documents",
    "triple_lines": "SELECT c_custkey, c_name AS h, CASE c_custkey % 3 WHEN 0 THEN 'person' ELSE '' END AS ht, CASE c_custkey % 3 WHEN 0 THEN 'buys in' ELSE 'lives' END AS r, CASE c_custkey % 3 WHEN 0 THEN c_mktsegment ELSE CAST(c_nationkey AS VARCHAR) END AS t, CASE c_custkey % 3 WHEN 0 THEN 'concept' ELSE '' END AS tt, CASE c_custkey % 3 WHEN 0 THEN 'row||' || CAST(c_custkey AS VARCHAR) ELSE 'a|b' END AS e FROM customer WHERE c_custkey % 3 < 2",
    "citation_stats": r"WITH a AS (SELECT doc_id, text || ' [' || CAST(doc_id % 9 AS VARCHAR) || '] [G' || CAST(doc_id % 4 AS VARCHAR) || '] [' || CAST(doc_id % 5 AS VARCHAR) || ']' AS t FROM documents), b AS (SELECT doc_id, list_distinct(regexp_extract_all(t, '\[(\d+)\]', 1)) AS p, list_distinct(regexp_extract_all(t, '\[G(\d+)\]', 1)) AS g FROM a) SELECT doc_id, len(p) AS n_plain, len(g) AS n_graph, len(list_filter(p, lambda x: CAST(x AS INT) > 6)) > 0 AS out_of_range FROM b",
    "score_normalise": "WITH v AS (SELECT doc_id, ['4','4分','4/5','4/10','4.0','4.5','true','0','6',' 3 / 5 分','','x'][doc_id % 12 + 1] AS raw FROM labels) SELECT doc_id, raw, CASE WHEN raw IN ('4', '4分', '4/5', '4.0') THEN 4 WHEN raw = ' 3 / 5 分' THEN 3 END AS score FROM v",
    "value_coercion": "WITH v AS (SELECT p_partkey, ['1.256','true','nan','Infinity','',' ','2e9','-3.14159','abc','7'][p_partkey % 10 + 1] AS raw FROM part) SELECT p_partkey, CASE raw WHEN '1.256' THEN 1.26::DOUBLE WHEN '2e9' THEN 1e6::DOUBLE WHEN '-3.14159' THEN -3.14::DOUBLE WHEN '7' THEN 7.0::DOUBLE END AS number, left(trim(raw), 24) AS tag, CASE WHEN length(raw || CAST(p_partkey AS VARCHAR)) <= 8 THEN '****' ELSE left(raw || CAST(p_partkey AS VARCHAR), 4) || '****' || right(raw || CAST(p_partkey AS VARCHAR), 4) END AS masked FROM v",
    "html_strip": f"SELECT page_id, {_PLAIN.format('html')} AS plain FROM pages",
    "html_paragraphs": _PARAGRAPHS,
    "snippet_topk": f"WITH b AS ({_PARAGRAPHS}), c AS (SELECT page_id, pos, {_s('block')} AS snippet FROM b), k AS (SELECT *, row_number() OVER (PARTITION BY page_id, left(snippet, 40) ORDER BY pos) AS d FROM c WHERE length(snippet) BETWEEN 25 AND 360), r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS rank FROM k WHERE d = 1) SELECT page_id, rank, snippet FROM r WHERE rank <= 8",
    "exact_dups": "WITH h AS (SELECT doc_id, sha256(text) AS sha, length(text) AS n FROM documents), g AS (SELECT n, sha, count(*) AS copies, min(doc_id) AS keeper FROM h GROUP BY n, sha HAVING count(*) > 1) SELECT doc_id, keeper, copies FROM h JOIN g USING (n, sha)",
    "content_id_dups": "SELECT md5(substr(text, 1, 200)) AS content_id, count(*) AS n_chunks, min(doc_id) AS first_id FROM documents GROUP BY 1",
    "title_normalise": "SELECT p_partkey, " + _TITLE.format("p_name || '（' || p_type || '）_' || CASE WHEN p_size % 2 = 0 THEN '扫描版' ELSE '第3版pdf' END || '.txt'") + " AS title FROM part",
    "cross_format_dedup": """WITH f AS (SELECT p_partkey AS file_id, 'book' || CAST(p_partkey // 2 AS VARCHAR) AS title, CASE WHEN p_partkey % 2 = 0 THEN '.pdf' ELSE '.txt' END AS ext, p_size * 4 AS pages, CAST(trunc(p_retailprice * 120) AS BIGINT) AS chars FROM part WHERE p_partkey % 2 = 0 OR TRUE),
 g AS (SELECT title, count(*) FILTER (ext = '.pdf') AS np, count(*) FILTER (ext = '.txt') AS nt, max(pages) FILTER (ext = '.pdf') AS pages, max(chars) FILTER (ext = '.pdf') AS pc, max(chars) FILTER (ext = '.txt') AS tc FROM f GROUP BY title)
 SELECT file_id, title, ext = '.pdf' AND np = 1 AND nt = 1 AND g.pages >= 100 AND pc >= 100000 AND tc >= 0.5 * pc AS dropped FROM f JOIN g USING (title) WHERE file_id % 2 = 0 OR title IS NOT NULL""",
    "ordered_distinct": f"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents), s AS (SELECT doc_id, {_s('line')} AS x, min(pos) AS pos FROM l WHERE {_s('line')} <> '' GROUP BY ALL) SELECT d.doc_id, count(x) AS n_lines, md5(coalesce(string_agg(x, chr(10) ORDER BY pos), '')) AS lines_md5 FROM documents d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id",
    "font_heading_pick": """WITH h AS (SELECT l_suppkey AS doc, round(l_quantity / 2 + 6, 1) AS size, CAST(sum(l_linenumber) AS BIGINT) AS chars, count(*) AS lines FROM lineitem GROUP BY 1, 2), b AS (SELECT doc, arg_max(size, chars * 1000 + size) AS body, sum(lines) AS total FROM h GROUP BY doc),
 k AS (SELECT h.doc, size, body FROM h JOIN b USING (doc) WHERE size >= 1.12 * body AND lines <= 0.06 * total) SELECT doc, body, size, dense_rank() OVER (PARTITION BY doc ORDER BY size DESC) AS level FROM k""",
}
