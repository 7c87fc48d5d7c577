"""Text operators as functions from columns to columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import profiles as P

CJK = r"[\x{4e00}-\x{9fff}]"


#: All white space of Unicode.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE))


def compact(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+", "")


def front_matter_kind(text: Column, p: P.FrontMatter = P.CHINESE) -> Column:
    """FLT-01: copyright, toc, publication_fragment, fragment or empty; the first that holds."""
    t = strip(F.coalesce(text, F.lit("")))
    return (
        F.when(F.length(t) < p.min_any, "fragment")
        .when(t.rlike(p.strong), "copyright")
        .when(F.size(F.array_distinct(F.regexp_extract_all(t, F.lit(p.boilerplate), F.lit(0)))) >= 2, "copyright")
        .when(F.regexp_count(t, F.lit(p.toc_line)) >= 3, "toc")
        .when((F.length(t) < 100) & t.rlike(p.publishing), "publication_fragment")
        .otherwise("")
    )


def _is_listed(line: Column, p: P.FrontMatter) -> Column:
    s = strip(line)
    toc = s.rlike(p.toc_line) | ((F.length(s) <= 40) & ~s.rlike(p.sentence_end) & s.rlike(p.toc_head))
    return (s != "") & (toc | s.rlike(p.strong) | s.rlike(p.boilerplate))


def strip_front_matter_lines(text: Column, p: P.FrontMatter = P.CHINESE) -> Column:
    """FLT-02: the text without lines of contents and boilerplate."""
    lines = F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n")
    return strip(F.array_join(F.filter(lines, lambda x: ~_is_listed(x, p)), "\n"))


def body_density(text: Column, p: P.FrontMatter = P.CHINESE) -> Column:
    """Sentence ends per 100 characters."""
    return F.when(F.length(text) > 0, F.regexp_count(text, F.lit(p.sentence_end)) / F.length(text) * 100).otherwise(0.0)


def clean_chunk(text: Column, p: P.FrontMatter = P.CHINESE) -> tuple[Column, Column]:
    """FLT-03: (text, kind). Text that is not front matter stays; of front matter what reads like a body stays."""
    kind, rest = front_matter_kind(text, p), strip_front_matter_lines(text, p)
    ok = (F.length(rest) >= p.min_useful) & (body_density(rest, p) >= p.min_density)
    return F.when(kind == "", text).when(ok, rest).otherwise(""), kind


def is_ocr_noise(line: Column) -> Column:
    """FLT-05 on one line."""
    c = compact(line)
    return (
        (c == "")
        | c.rlike(P.NUMBER_LINE)
        | c.rlike(P.FRAMED_NUMBER)
        | c.rlike(P.DATE_LINE)
        | ((F.length(c) <= 8) & c.rlike(r"(?U)^[\W_]+$"))
        | ((F.length(c) < 50) & c.rlike("|".join(P.OCR_NOISE)))
    )


def is_vision_noise(line: Column) -> Column:
    """FLT-07 on one line, without FLT-05."""
    c = compact(line)
    return (c == "") | c.rlike("|".join(P.VISION_NOISE))


def is_toc_page(lines: Column) -> Column:
    """FLT-06 on an array of lines."""
    like = F.filter(lines, lambda x: (F.length(compact(x)) < 40) & compact(x).rlike(r"\d+$") & (compact(x) != ""))
    return (F.size(lines) >= 5) & (F.size(like) >= F.greatest(F.lit(3), F.floor(F.size(lines) * 0.4).cast("int")))


def mark_ratio(text: Column, marks: str = P.MOJIBAKE_MARKS, first: int = P.MOJIBAKE_CHARS) -> Column:
    """FLT-08: share of marks in the first characters."""
    s = F.substring(text, 1, first)
    return F.when(F.length(s) > 0, (F.length(s) - F.length(F.translate(s, marks, ""))) / F.length(s)).otherwise(0.0)


def bad_ratio(text: Column) -> Column:
    """FLT-09: share of replacement, private-use and control characters."""
    return F.regexp_count(text, F.lit(r"[\x{fffd}\x{e000}-\x{f8ff}\x00-\x08\x0b-\x1f\x7f-\x{9f}]")) / F.greatest(F.length(text), F.lit(1))


def contains_any(text: Column, terms: tuple[str, ...] = P.BANNED) -> Column:
    """FLT-10, input side."""
    out = F.lit(False)
    for t in terms:
        out = out | F.coalesce(text, F.lit("")).contains(t)
    return out


def refused(text: Column, terms: tuple[str, ...] = P.BANNED, refusal: str = P.REFUSAL) -> Column:
    """FLT-10, output side."""
    return F.when(contains_any(text, terms), refusal).otherwise(text)


def index_tokens(text: Column) -> Column:
    """TXT-01: each Chinese character, and runs of other characters between white space."""
    spaced = F.regexp_replace(F.coalesce(text, F.lit("")), f"({CJK})", " $1 ")
    return F.regexp_extract_all(spaced, F.lit(r"(?U)\S+"), F.lit(0))


def entity_key(name: Column) -> Column:
    """TXT-02."""
    return F.regexp_replace(F.lower(name), r"(?U)[^\w]", "")


def sentences(text: Column) -> Column:
    """TXT-03."""
    cut = P.SENTENCE_CUT
    parts = F.regexp_extract_all(text, F.lit(f"[^{cut}\\n]*+[{cut}]|[^{cut}\\n]++"), F.lit(0))
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def ends_sentence(text: Column, ends: str = P.STITCH_ENDS) -> Column:
    """TXT-05."""
    return F.regexp_replace(text, r"(?U)\s+$", "").rlike(f"[{ends}]$")


def needs_continuation(text: Column, ends: str = P.STITCH_ENDS) -> Column:
    """TXT-06: the end is cut inside a sentence."""
    tail = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+$", "")
    return (tail != "") & ~tail.rlike(f"[{ends}]$") & F.right(tail, F.lit(8)).rlike(r"[\p{L}\p{N}]")


def with_continuation(text: Column, source: Column, tail: Column) -> tuple[Column, Column]:
    """TXT-07: (text, what was added); sources in markdown are left alone."""
    cont = strip(F.coalesce(tail, F.lit("")))
    joins = ~F.lower(F.coalesce(source, F.lit(""))).rlike(r"\.(?:md|markdown)$") & (cont != "") & needs_continuation(text)
    return F.when(joins, F.concat(F.regexp_replace(text, r"(?U)\s+$", ""), F.lit("\n"), cont)).otherwise(text), F.when(joins, cont).otherwise("")


def bounded(text: Column, most: int = 450, between: str = "...") -> Column:
    """TXT-08: head and tail of a long query."""
    head = (most - len(between)) // 2
    tail = most - len(between) - head
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, head), F.lit(between), F.right(text, F.lit(tail))))


def bullet(text: Column, most: int = 150) -> Column:
    """TXT-09."""
    return F.concat(F.lit("- "), strip(F.regexp_replace(F.substring(text, 1, most), r"(?U)\s+", " ")))


def font_size(raw: Column) -> Column:
    """TXT-10: one decimal; what is no number is 0."""
    return F.round(F.coalesce(raw.try_cast("double"), F.lit(0.0)), 1)


def joined_lines(lines: Column) -> Column:
    """TXT-11: no space where either side of a line break is Chinese."""
    touch = f"^{CJK}$"

    def add(acc: Column, x: Column) -> Column:
        near = F.right(acc, F.lit(1)).rlike(touch) | F.substring(x, 1, 1).rlike(touch)
        return F.when(acc == "", x).when(x == "", acc).when(near, F.concat(acc, x)).otherwise(F.concat(acc, F.lit(" "), x))

    return F.aggregate(F.transform(lines, strip), F.lit(""), add)


def strip_html(html: Column) -> Column:
    """TXT-16."""
    out = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    out = F.regexp_replace(out, r"<[^>]+>", " ")
    out = F.regexp_replace(out, r"(?i)&[a-z]+;", " ")
    return strip(F.regexp_replace(out, r"(?U)\s+", " "))


def html_blocks(html: Column) -> Column:
    """TXT-17: texts of result containers, then of paragraphs."""
    found = [F.regexp_extract_all(html, F.lit(p), F.lit(0)) for p in P.RESULT_BLOCKS] + [F.regexp_extract_all(html, F.lit(P.PARAGRAPH), F.lit(1))]
    return F.transform(F.concat(*found), strip_html)


def without_extension(name: Column) -> Column:
    """TXT-18."""
    return F.regexp_replace(name, r"(?i)\.(?:pdf|md|markdown|txt|docx?|csv|json)$", "")


def normalise_title(stem: Column) -> Column:
    """SET-03: brackets and punctuation go, then known endings as long as there is one."""
    s = F.regexp_replace(F.regexp_replace(stem, P.TITLE_BRACKETS, ""), P.TITLE_PUNCTUATION, "")
    return F.regexp_replace(s, rf"(?:\.?(?:{P.TITLE_TAIL}))*\.?$", "")


def score(value: Column) -> Column:
    """TXT-21: whole scores of 1 to 5, also as '4分' or '4/5'; null otherwise."""
    pattern = r"^\s*([+-]?\d+(?:\.\d+)?)\s*分?(?:\s*/\s*(\d+(?:\.\d+)?)\s*分?)?\s*$"
    n, of = F.regexp_extract(value, pattern, 1).try_cast("double"), F.regexp_extract(value, pattern, 2)
    ok = value.rlike(pattern) & ((of == "") | (of.try_cast("double") == 5)) & (n >= 1) & (n <= 5) & (n == F.floor(n))
    return F.when(ok, n.cast("int"))


def coerced_number(raw: Column) -> Column:
    """TXT-25: two decimals within a million; null for what is no finite number."""
    n = raw.try_cast("double")
    ok = n.isNotNull() & ~F.isnan(n) & (F.abs(n) != float("inf")) & ~F.lower(raw).isin("true", "false") & (strip(raw) != "")
    return F.when(ok, F.round(F.greatest(F.lit(-1e6), F.least(F.lit(1e6), n)), 2))


def masked(secret: Column) -> Column:
    """TXT-26: never the whole secret."""
    return F.when(F.coalesce(F.length(secret), F.lit(0)) == 0, "").when(F.length(secret) <= 8, F.lit("****")).otherwise(F.concat(F.left(secret, F.lit(4)), F.lit("****"), F.right(secret, F.lit(4))))


def triple(line: Column) -> Column:
    """TXT-19: struct(h, ht, r, t, tt, e) of a line of pipes, six columns or four; evidence may hold pipes."""
    kinds = F.array(*map(F.lit, ("person", "concept", "work", "event", "place", "organization")))
    known = lambda c: F.when(F.array_contains(kinds, F.lower(c)), F.lower(c)).otherwise("")

    def named(parts: Column) -> Column:
        wide = F.struct(parts[0].alias("h"), known(parts[1]).alias("ht"), parts[2].alias("r"), parts[3].alias("t"), known(parts[4]).alias("tt"), parts[5].alias("e"))
        slim = F.struct(parts[0].alias("h"), F.lit("").alias("ht"), parts[1].alias("r"), parts[2].alias("t"), F.lit("").alias("tt"), parts[3].alias("e"))
        return F.when(F.size(parts) == 6, wide).when(F.size(parts) == 4, slim)

    def sound(t: Column) -> Column:
        return F.when((t["h"] != "") & (t["t"] != "") & (t["r"] != "") & (entity_key(t["h"]) != entity_key(t["t"])), t)

    six = F.split(line, r"\|", 6)
    typed = (F.size(six) == 6) & F.array_contains(kinds, F.lower(strip(F.get(six, F.lit(1)))))
    parts = F.transform(F.when(typed, six).otherwise(F.split(line, r"\|", 4)), strip)
    # a list of one binds what is made, so that it is evaluated once
    return F.get(F.transform(F.transform(F.array(parts), named), sound), F.lit(0))


def citations(text: Column) -> tuple[Column, Column]:
    """TXT-20: distinct numbers cited as [n], and as [Gk]."""
    plain = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.cast("int")))
    graph = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"\[G(\d+)\]"), F.lit(1)), lambda x: x.cast("int")))
    return plain, graph


def cost(prompt_chars: Column, completion_chars: Column, prompt_tokens: Column, completion_tokens: Column, price_in: float = 1.0, price_out: float = 2.0) -> Column:
    """AGG-22: tokens are 0.75 of the characters unless given; prices are per million."""
    pt = F.coalesce(prompt_tokens, (prompt_chars * F.lit(0.75)).cast("long"))
    ct = F.coalesce(completion_tokens, (completion_chars * F.lit(0.75)).cast("long"))
    return F.round(pt / 1e6 * price_in + ct / 1e6 * price_out, 6)


def dpi(longest_pt: Column, ladder: tuple[int, ...] = (300, 200, 150, 100, 72, 50, 30), pixels: int = 8000, least: int = 30) -> Column:
    """MTH-03: the first of the ladder that keeps the longest side within the pixels."""
    return F.get(F.filter(F.array(*map(F.lit, ladder)), lambda d: (longest_pt * d / 72 <= pixels) & (d >= least)), F.lit(0))
