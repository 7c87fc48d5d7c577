"""The Chinese profile of the front-matter filter, its terms and its marks, over documents that have its words in them.

Documents are in Latin script. Sentence ends become Chinese ones, and lines of contents, publication data, boilerplate and terms are put in
where the document's number says so; the same expressions make the texts in SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import profiles as P
from ..functions import text as T
from ..operators import filters
from ..session import table

C = P.CHINESE
#: What is put before a text: by number, a line of contents, of publication data, of boilerplate, or nothing.
_HEADS = {
    1: "concat('目 录', chr(10), '第一章 ', source, ' ........ 12', chr(10), '第2节 ', source, '……… 3', chr(10), '三、', lang, '------ 101', chr(10))",
    2: "concat('图书在版编目', chr(10), source, chr(10))",
    3: "concat('责任编辑 ', source, chr(10), '封面设计', chr(10), source, '。', chr(10))",
    4: "concat('定价 ', doc_id, chr(10))",
    5: "concat('特约编辑特约编辑 ', source, chr(10))",
    6: "concat('CIP  数据', chr(10))",
}
_BODY = "replace(replace(coalesce(text, ''), '. ', '。'), '! ', '！')"
#: Every seventh short text is cut to a fragment of its own, every ninth to one of publication data.
_BODY = f"CASE WHEN doc_id % 13 = 0 THEN source WHEN doc_id % 17 = 0 THEN concat('出版社 ', source, ' ', lang, ' 定价 ', doc_id, ' ', source, ' 印张') ELSE {_BODY} END"
_CASES = " ".join(f"WHEN {n} THEN {x}" for n, x in _HEADS.items())
_TEXT = f"concat(CASE doc_id % 8 {_CASES} ELSE '' END, {_BODY})"


def _docs(spark, sf):
    d = table(spark, sf, "documents").withColumns({c: F.coalesce(c, F.lit("")) for c in ("source", "lang")})
    return d.select("doc_id", F.expr(_TEXT).alias("text"))


def chinese_cleaned(spark, sf):
    """FLT-01, FLT-02, FLT-03: why a text is front matter, the text without its lines, and what is kept."""
    d = filters.cleaned(_docs(spark, sf).withColumn("rest", F.md5(T.strip_front_matter_lines(F.col("text"), C))), C)
    return d.select("doc_id", "kind", F.col("rest").alias("rest_md5"), F.md5("cleaned").alias("cleaned_md5"), F.length("cleaned").cast("long").alias("char_length"))


def chinese_drops(spark, sf):
    """FLT-04: how many texts of each kind there are, and how many of them go."""
    return filters.drop_histogram(filters.cleaned(_docs(spark, sf), C))


def _talk(spark, sf):
    terms = F.array(*map(F.lit, P.BANNED))
    c = table(spark, sf, "conversations")
    word = F.when((F.col("conv_id") + F.col("turn")) % 5 == 0, F.element_at(terms, ((F.col("conv_id") + F.col("turn")) % len(P.BANNED) + 1).cast("int"))).otherwise("")
    return c.select("conv_id", "turn", F.concat(F.coalesce("text", F.lit("")), word).alias("text"))


def refused_turns(spark, sf):
    """FLT-10 with its terms: turns that are refused, and what is said instead."""
    return _talk(spark, sf).select("conv_id", "turn", T.contains_any(F.col("text")).alias("banned"), F.md5(T.refused(F.col("text"))).alias("output_md5"))


def doubly_decoded(spark, sf):
    """FLT-08 with its marks: the share of marks at the start of texts, and whether a text counts as doubly decoded."""
    marks = F.when(F.col("doc_id") % 3 == 0, F.substring(F.lit(P.MOJIBAKE_MARKS), 1, 7)).otherwise("")
    d = table(spark, sf, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), marks).alias("text"))
    return d.select("doc_id", F.round(T.mark_ratio(F.col("text")), 6).alias("mark_ratio"), (T.mark_ratio(F.col("text")) >= P.MOJIBAKE_RATIO).alias("marked"))


QUERIES = {f.__name__: f for f in (chinese_cleaned, chinese_drops, refused_turns, doubly_decoded)}

_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_X = _STRIP.format("x")
_LISTED = f"""({_X} <> '' AND (regexp_matches({_X}, '{C.toc_line}') OR (length({_X}) <= 40 AND NOT regexp_matches({_X}, '{C.sentence_end}') AND regexp_matches({_X}, '{C.toc_head}'))
 OR regexp_matches({_X}, '{C.strong}') OR regexp_matches({_X}, '{C.boilerplate}')))"""
_REST = _STRIP.format(f"array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT {_LISTED}), chr(10))")
_CLEANED = f"""WITH d AS (SELECT doc_id, text, coalesce(source, '') AS source, coalesce(lang, '') AS lang FROM documents), m AS (SELECT doc_id, {_TEXT} AS text FROM d),
 a AS (SELECT *, {_STRIP.format("text")} AS t FROM m),
 b AS (SELECT *, {_REST} AS rest, CASE WHEN length(t) < {C.min_any} THEN 'fragment' WHEN regexp_matches(t, '{C.strong}') THEN 'copyright' WHEN len(list_distinct(regexp_extract_all(t, '{C.boilerplate}'))) >= 2 THEN 'copyright'
  WHEN len(regexp_extract_all(t, '{C.toc_line}')) >= 3 THEN 'toc' WHEN length(t) < 100 AND regexp_matches(t, '{C.publishing}') THEN 'publication_fragment' ELSE '' END AS kind FROM a),
 c AS (SELECT *, CASE WHEN kind = '' THEN text WHEN length(rest) >= {C.min_useful} AND len(regexp_extract_all(rest, '{C.sentence_end}')) / length(rest) * 100 >= {C.min_density} THEN rest ELSE '' END AS cleaned FROM b)"""
_TERMS = "['" + "', '".join(P.BANNED) + "']"
ORACLES = {
    "chinese_cleaned": f"{_CLEANED} SELECT doc_id, kind, md5(rest) AS rest_md5, md5(cleaned) AS cleaned_md5, length(cleaned) AS char_length FROM c",
    "chinese_drops": f"{_CLEANED} SELECT kind AS reason, count(*) AS n_chunks, count(*) FILTER (cleaned = '') AS n_dropped FROM c WHERE kind <> '' GROUP BY kind",
    "refused_turns": f"""WITH a AS (SELECT conv_id, turn, concat(text, CASE WHEN (conv_id + turn) % 5 = 0 THEN {_TERMS}[(conv_id + turn) % {len(P.BANNED)} + 1] ELSE '' END) AS text FROM conversations), b AS (SELECT *, regexp_matches(text, '{"|".join(P.BANNED)}') AS banned FROM a)
 SELECT conv_id, turn, banned, md5(CASE WHEN banned THEN '{P.REFUSAL}' ELSE text END) AS output_md5 FROM b""",
    "doubly_decoded": f"""WITH a AS (SELECT doc_id, substr(concat(text, CASE WHEN doc_id % 3 = 0 THEN '{P.MOJIBAKE_MARKS[:7]}' ELSE '' END), 1, {P.MOJIBAKE_CHARS}) AS s FROM documents),
 b AS (SELECT doc_id, CASE WHEN length(s) > 0 THEN length(regexp_replace(s, '[^{P.MOJIBAKE_MARKS}]', '', 'g')) / length(s) ELSE 0.0 END AS r FROM a) SELECT doc_id, round(r, 6) AS mark_ratio, r >= {P.MOJIBAKE_RATIO} AS marked FROM b""",
}
