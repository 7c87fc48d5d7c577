"""Definitions of code with their whole bodies, as a table function.

A definition's body ends where a line is indented no deeper than its header, which depends on all headers that are open before it;
a text is read once, line by line, with a stack of them, where it lies. Texts are not shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

HEADER = re.compile(r"(async\s+def|def|class)\s+([^\W\d]\w*)")
TAB = 8
#: Characters of bodies that a task hands on at once.
HELD = 16 << 20
QUOTES = ('"""', "'''")


def _scan(line: str, quote: str, depth: int) -> tuple[str, int, bool]:
    """Which triple quote is open, how many brackets are, and whether the line goes on by a backslash, after ``line``."""
    i = 0
    while i < len(line):
        if quote:
            end = line.find(quote, i)
            if end < 0:
                return quote, depth, False
            if (end - len(line[:end].rstrip("\\"))) % 2:
                i = end + 1
                continue
            i, quote = end + 3, ""
        elif line.startswith(QUOTES, i):
            quote, i = line[i : i + 3], i + 3
        elif (c := line[i]) in "'\"":
            i += 1
            while i < len(line) and line[i] != c:
                i += 2 if line[i] == "\\" else 1
            i += 1
        elif c == "#":
            return "", depth, False
        else:
            depth = depth + 1 if c in "([{" else max(depth - 1, 0) if c in ")]}" else depth
            i += 1
    return quote, depth, not quote and line.endswith("\\")


def units(text: str | None) -> Iterator[tuple[str, str, int, int, int, str]]:
    """(name, kind, depth, first line, last line, body) of each definition in order of their ends, inner before outer.

    Lines count from 1. Decorators right above a header at its indentation belong to it; blank lines and comments at the end do not.
    Names are dotted by the definitions around them. Text within triple quotes or brackets neither opens nor ends anything.
    """
    lines = (text or "").split("\n")
    lines = [x.removesuffix("\r") for x in lines]
    open_: list[tuple[int, int, str, str]] = []  # indentation, first line, name, kind
    quote, depth, goes_on, last, above = "", 0, False, 0, None
    for n, line in enumerate(lines, 1):
        bare = line.strip()
        if quote or depth or goes_on:
            quote, depth, goes_on = _scan(line, quote, depth)
            last = n if bare else last
            continue
        if not bare or bare.startswith("#"):
            continue
        indent = len(line.expandtabs(TAB)) - len(line.expandtabs(TAB).lstrip())
        while open_ and indent <= open_[-1][0]:
            yield _closed(open_, last, lines)
        if bare.startswith("@"):
            above = above if above and above[0] == indent else (indent, n)
        elif m := HEADER.match(bare):
            first = above[1] if above and above[0] == indent else n
            name = ".".join([*(o[2] for o in open_[-1:]), m[2]])
            open_.append((indent, first, name, "class" if m[1] == "class" else "function"))
            above = None
        else:
            above = None
        quote, depth, goes_on = _scan(line, quote, depth)
        last = n
    while open_:
        yield _closed(open_, last, lines)


def _closed(open_: list, last: int, lines: list[str]) -> tuple[str, str, int, int, int, str]:
    _, first, name, kind = open_.pop()
    return name, kind, len(open_), first, last, "\n".join(lines[first - 1 : last])


class Definitions:
    """Over a text and, if it is to be given, a constant that tells whether bodies are wanted; without them the column is missing."""

    @staticmethod
    def analyze(text: AnalyzeArgument, bodies: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not isinstance(text.dataType, StringType):
            raise ValueError(f"definitions are read from text, not from {text.dataType.simpleString()}")
        schema = StructType().add("name", StringType()).add("kind", StringType())
        for c in ("depth", "first_line", "last_line"):
            schema = schema.add(c, IntegerType())
        if bodies is None or bodies.value:
            schema = schema.add("body", StringType())
        return AnalyzeResult(schema)

    def eval(self, text: str | None, bodies: bool = True) -> Iterator[tuple]:
        for u in units(text):
            yield u if bodies else u[:5]


def definitions(docs: DataFrame, text: str = "text", bodies: bool = True) -> DataFrame:
    """TXT-15: the rows of ``docs``, each with the definitions (name, kind, depth, first_line, last_line, body) of its text; rows
    without any are left out. Columns of ``docs`` of the same names go before: the new ones are in a struct ``definition`` then."""
    if not isinstance(docs.schema[text].dataType, StringType):
        raise AnalysisException(f"definitions are read from text, not from {docs.schema[text].dataType.simpleString()}")
    own = [(n, t) for n, t in (("name", "string"), ("kind", "string"), ("depth", "int"), ("first_line", "int"), ("last_line", "int"), ("body", "string")) if bodies or n != "body"]
    new = pa.schema([(n, pa.string() if t == "string" else pa.int32()) for n, t in own])
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a batch at a time, not a call for each row
        for b in batches:
            rows, made, size = [], [], 0
            for i, t in enumerate(b.column(at)):
                for u in units(t.as_py()):
                    rows.append(i)
                    made.append(u)
                    size += len(u[5])
                if size > HELD:
                    yield out(b, rows, made)
                    rows, made, size = [], [], 0
            yield out(b, rows, made)

    def out(b: pa.RecordBatch, rows: list, made: list) -> pa.RecordBatch:
        columns = [pa.array([u[j] for u in made], f.type) for j, f in enumerate(new)]
        taken = b.take(pa.array(rows, pa.int64()))
        return pa.RecordBatch.from_arrays([*taken.columns, *columns], names=[*(f"_c{i}" for i in range(b.num_columns)), *new.names])

    renamed = docs.toDF(*[f"_c{i}" for i in range(len(docs.columns))])
    schema = StructType([*renamed.schema, *(StructField(n, StringType() if t == "string" else IntegerType()) for n, t in own)])
    found = renamed.mapInArrow(run, schema)
    back = [F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)]
    if not set(new.names) & set(docs.columns):
        return found.select(*back, *new.names)
    return found.select(*back, F.struct(*new.names).alias("definition"))


def register(docs: DataFrame, name: str = "code_definitions") -> None:
    """Gives SQL the table function: SELECT ... FROM files, LATERAL code_definitions(text, true)."""
    # rows, not Arrow: an Arrow table function makes a table of every single row
    docs.sparkSession.udtf.register(name, F.udtf(Definitions, useArrow=False))


def names(found: DataFrame, key: str) -> DataFrame:
    """(key, names) of each text: its definitions' names in order of their first lines."""
    row: Column = F.sort_array(F.collect_list(F.struct("first_line", F.col("depth"), "name")))
    return found.groupBy(key).agg(F.array_join(F.transform(row, lambda x: x["name"]), ",").alias("names"))
