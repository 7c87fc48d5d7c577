"""JSON from model output: tolerant and strict; summaries; messages.

Duplicate keys, constants that are no JSON and braces inside strings need a parser that tells them, which the engine's
own JSON functions are not; a text is parsed where it lies, in Arrow batches.
"""

from __future__ import annotations

import json
import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _balanced(text: str) -> str | None:
    depth, start, quoted, escaped = 0, -1, False, False
    for i, c in enumerate(text):
        if quoted:
            quoted, escaped = (escaped or c != '"'), c == "\\" and not escaped
            continue
        if c == '"' and depth:
            quoted = True
        elif c == "{":
            start = i if not depth else start
            depth += 1
        elif c == "}" and depth:
            depth -= 1
            if not depth:
                return text[start : i + 1]
    return None


def loose_object(text: str | None) -> dict | None:
    """TXT-22: the whole text, a fenced block, or the first balanced braces."""
    t = (text or "").strip()
    fenced = re.search(r"```(?:json)?\s*(.*?)```", t, re.S)
    for candidate in (t, fenced[1] if fenced else None, _balanced(t)):
        try:
            if candidate and isinstance(found := json.loads(candidate), dict):
                return found
        except json.JSONDecodeError:
            continue
    return None


def strict_object(text: str | None, fields: dict[str, type | tuple]) -> tuple[dict | None, str | None]:
    """TXT-23: (object, error): no duplicate key, no NaN or Infinity, no unknown field, types as given; a bool is no number."""

    def once(pairs: list) -> dict:
        if len({k for k, _ in pairs}) < len(pairs):
            raise ValueError("duplicate key")
        return dict(pairs)

    def constant(name: str) -> float:
        raise ValueError(f"constant {name}")

    try:
        found = json.loads(text or "", object_pairs_hook=once, parse_constant=constant)
    except json.JSONDecodeError:
        return None, "not JSON"
    except ValueError as e:
        return None, str(e)
    if not isinstance(found, dict):
        return None, "not an object"
    for k, v in found.items():
        if k not in fields:
            return None, f"unknown field {k}"
        kinds = fields[k] if isinstance(fields[k], tuple) else (fields[k],)
        if isinstance(v, bool) and bool not in kinds or not isinstance(v, kinds) or isinstance(v, float) and not math.isfinite(v):
            return None, f"type of {k}"
    return found, None


def strict_error(text: Column, fields: dict[str, str]) -> Column:
    """TXT-23: what is wrong with an object of the given fields (int, float, str or bool), null if nothing is."""
    kinds = {"int": int, "float": (int, float), "str": str, "bool": bool}

    @F.pandas_udf("string")
    def parse(t: pd.Series) -> pd.Series:
        return t.map(lambda x: strict_object(x, {k: kinds[v] for k, v in fields.items()})[1])

    return parse(text)


def loose_json(text: Column) -> Column:
    @F.pandas_udf("string")
    def parse(t: pd.Series) -> pd.Series:
        return t.map(lambda x: json.dumps(o) if (o := loose_object(x)) is not None else None)

    return parse(text)


def summary_slots(text: Column, slots: int) -> Column:
    """TXT-24: an array of the lines 'n: summary' by their number; the first line of a number counts."""
    lines = F.regexp_extract_all(text, F.lit(r"(?m)^\s*\[?(\d+)\]?\s*[:：.]\s*(.+?)\s*$"), F.lit(0))
    number = lambda x: F.regexp_extract(x, r"(\d+)", 1).cast("int")
    body = lambda x: F.regexp_extract(x, r"^\s*\[?\d+\]?\s*[:：.]\s*(.+?)\s*$", 1)
    return F.transform(F.sequence(F.lit(1), F.lit(slots)), lambda n: F.coalesce(F.get(F.transform(F.filter(lines, lambda x: number(x) == n), body), F.lit(0)), F.lit("")))


def page_prefix(person: Column, title: Column, page: Column, pages: Column, kind: Column) -> Column:
    """TXT-27."""
    return F.format_string("[%s] %s, page %d of %d (%s)", person, title, page, pages, kind)


def filled(template: str, name: Column) -> Column:
    """TXT-29."""
    return F.replace(F.lit(template), F.lit("{{char}}"), name)


#: MIS-18: the order of a request's parts.
PARTS = ("persona", "memory", "evidence", "history", "directive", "query")


def messages(parts: DataFrame) -> DataFrame:
    """MIS-18, MIS-11 over (request, part, pos, text): the request's text in order, and its number of characters."""
    order = F.array_position(F.array(*map(F.lit, PARTS)), F.col("part"))
    rows = parts.withColumn("_o", order).filter("_o > 0 AND text <> ''")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_o", "pos", "text"))), lambda x: x["text"]), "\n\n")
    return rows.groupBy("request").agg(joined.alias("text"), F.sum(F.length("text")).alias("chars"))


def job_status(has_file: Column, has_temp: Column, job: Column) -> Column:
    """MIS-16."""
    return F.when(job == "running", "building").when(has_file, "done").when(has_temp, "interrupted").otherwise("idle")


def verdict_free(entries: Column, words: tuple[str, ...]) -> Column:
    """MIS-12: the entries without a verdict word."""
    return F.filter(entries, lambda e: ~e.rlike("|".join(words)))
