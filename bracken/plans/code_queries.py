"""Queries over definitions of code, which is made from parts so that nesting, decorators, quotes and indentation vary."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import dealt, table
from ..sources import code

#: The same expression in Spark and DuckDB: a class with a method (which holds a function in every third part), a function, and lines outside.
_CLASS = "concat('@register', chr(10), 'class Part', p_partkey, '(', replace(p_brand, '#', ''), '):', chr(10))"
_NOTE = "concat('    ', repeat(chr(34), 3), p_name, chr(10), 'def not_code(): ', p_type, chr(10), repeat(chr(34), 3), chr(10), chr(10))"
_NOTE = f"CASE WHEN p_size % 2 = 0 THEN {_NOTE} ELSE '' END"
_INNER = "concat('        def inner', p_size, '(y):', chr(10), '            return y + ', p_size)"
_METHOD = "concat('    async def size', p_size, '(self,', chr(10), 'unit=', p_size, '):', chr(10))"
_TAIL = "concat('        return (', p_size, ' *', chr(10), 'unit)')"
_METHOD = f"concat({_METHOD}, CASE WHEN p_partkey % 3 = 0 THEN concat({_INNER}, chr(10), chr(10)) ELSE '' END, {_TAIL})"
_FUNC = "concat('def price', p_partkey, '():', chr(10), chr(9), 'return ', p_size, '  # ', p_type)"
_BETWEEN = "concat(chr(10), chr(10), '# ', p_brand, chr(10), 'limit = ', p_size, chr(10))"
_CODE = f"concat('import os', chr(10), {_CLASS}, {_NOTE}, {_METHOD}, {_BETWEEN}, {_FUNC}, chr(10), chr(10), '# end', chr(10))"


def _files(spark, sf):
    return dealt(table(spark, sf, "part").select("p_partkey", "p_brand", "p_name", "p_type", "p_size")).select("p_partkey", F.expr(_CODE).alias("code"))


def code_bodies(spark, sf):
    """TXT-15: every definition with its body."""
    found = code.definitions(_files(spark, sf), "code")
    return found.select("p_partkey", "name", "kind", "depth", "body")


def code_outline(spark, sf):
    """TXT-15 in SQL, without bodies: where definitions begin and end."""
    files = _files(spark, sf)
    code.register(files, "bracken_definitions")
    return spark.sql("SELECT p_partkey, name, kind, first_line, last_line FROM {files}, LATERAL bracken_definitions(code, false)", files=files)


QUERIES = {f.__name__: f for f in (code_bodies, code_outline)}
_LINES = "(length({0}) - length(replace({0}, chr(10), '')))"
_UNITS = f"""p AS (SELECT *, {_CLASS} AS cls, {_NOTE} AS note, {_METHOD} AS method, {_INNER} AS inside, {_FUNC} AS func FROM part),
 c AS (SELECT *, 2 AS top, 4 + {_LINES.format("note")} AS at_method, cls || note || method AS whole FROM p),
 u AS (SELECT p_partkey, 'Part' || p_partkey AS name, 'class' AS kind, 0 AS depth, whole AS body, top AS first_line FROM c
 UNION ALL SELECT p_partkey, 'Part' || p_partkey || '.size' || p_size, 'function', 1, method, at_method FROM c
 UNION ALL SELECT p_partkey, 'Part' || p_partkey || '.size' || p_size || '.inner' || p_size, 'function', 2, inside, at_method + 2 FROM c WHERE p_partkey % 3 = 0
 UNION ALL SELECT p_partkey, 'price' || p_partkey, 'function', 0, func, top + {_LINES.format("whole")} + 4 FROM c)"""
ORACLES = {
    "code_bodies": f"WITH {_UNITS} SELECT p_partkey, name, kind, CAST(depth AS INT) AS depth, body FROM u",
    "code_outline": f"WITH {_UNITS} SELECT p_partkey, name, kind, CAST(first_line AS INT) AS first_line, CAST(first_line + {_LINES.format('body')} AS INT) AS last_line FROM u",
}
