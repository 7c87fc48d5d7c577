"""Block elements of markdown, definitions in code.

Blocks depend on what is open before them (a fence, a list), line by line, which no expression over columns has; a
document is parsed as a whole where it lies, in Arrow batches.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

ELEMENTS = "array<struct<kind:string,level:int,content:string,language:string>>"
_LIST = re.compile(r"^\s*(?:[-*+]|\d+[.)])\s+")


def elements(text: str, code_last: bool = True) -> list[dict]:
    """TXT-14: headings, paragraphs, lists, tables and fenced code; code comes last unless asked otherwise."""
    out, code, held, kind = [], [], [], ""

    def flush() -> None:
        nonlocal held, kind
        if held:
            out.append({"kind": kind, "level": 0, "content": "\n".join(held).strip(), "language": ""})
        held, kind = [], ""

    lines, i = (text or "").split("\n"), 0
    while i < len(lines):
        line = lines[i]
        if line.lstrip().startswith("```"):
            flush()
            language, body, i = line.strip()[3:].strip(), [], i + 1
            while i < len(lines) and not lines[i].lstrip().startswith("```"):
                body.append(lines[i])
                i += 1
            (code if code_last else out).append({"kind": "code", "level": 0, "content": "\n".join(body), "language": language})
        elif not line.strip():
            flush()
        elif m := re.match(r"^(#{1,6})\s+(.+?)\s*#*$", line):
            flush()
            out.append({"kind": "heading", "level": len(m[1]), "content": m[2], "language": ""})
        else:
            now = "table" if line.lstrip().startswith("|") else "list" if _LIST.match(line) else "list" if kind == "list" and line[0] in " \t" else "paragraph"
            if held and now != kind:
                flush()
            kind = now
            held.append(line)
        i += 1
    flush()
    return out + code


def parsed(text: Column, code_last: bool = True) -> Column:
    @F.pandas_udf(ELEMENTS)
    def parse(t: pd.Series) -> pd.Series:
        return t.map(lambda x: elements(x, code_last))

    return parse(text)


def definitions(code: Column) -> Column:
    """TXT-15: names of classes and functions of Python, and of functions of other languages."""
    return F.regexp_extract_all(code, F.lit(r"(?m)^\s*(?:async\s+)?(?:def|class|function|func|fn)\s+([A-Za-z_]\w*)"), F.lit(1))
