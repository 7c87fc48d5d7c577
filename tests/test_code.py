"""Definitions of code: an indentation stack, texts that only look like code, the table function's schemas."""

import ast
import textwrap

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from bracken.sources import code


def by_ast(text):
    """The same from Python's own parser, for code that it reads."""
    lines, out = text.split("\n"), []

    def visit(node, around):
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                first = min([child.lineno, *(d.lineno for d in child.decorator_list)])
                name = ".".join([*around[-1:], child.name])
                kind = "class" if isinstance(child, ast.ClassDef) else "function"
                out.append((name, kind, len(around), first, child.end_lineno, "\n".join(lines[first - 1 : child.end_lineno])))
                visit(child, [*around, name])
            else:
                visit(child, around)

    visit(ast.parse(text), [])
    return sorted(out)


SAMPLES = [
    "def f():\n    return 1\n\n\nx = 2\n\n\nclass A(B):\n    y = 3\n\n    @property\n    def g(self):\n        # note\n        return self.y\n\n    # end\n\n\ndef h(): return 0\n",
    "@first\n@second\nasync def f(\n    a,\nb=(1, 2),\n):\n    '''text\ndef no(): pass\n'''\n    def inner():\n        return 'def also_no():'\n    return inner\n",
    "if True:\n    def f():\n\t    pass\nelse:\n    class C:\n        def f(self):\n            s = \"#\" + '(' + \"\\\"\"\n            return s\n",
    "def f():\n    x = 1 + \\\n2\n    return x\n\ny = [\ndef_ for def_ in ()\n]\n",
    "",
    "x = 1",
]


@pytest.mark.parametrize("text", SAMPLES)
def test_units_equal_the_parser(text):
    assert sorted(code.units(text)) == by_ast(text)


def test_own_sources_equal_the_parser():
    import pathlib

    for path in sorted(pathlib.Path(code.__file__).parents[1].glob("*/*.py")):
        text = path.read_text()
        assert sorted(code.units(text)) == by_ast(text), path


def test_text_that_is_no_code():
    assert list(code.units(None)) == []
    assert list(code.units("class of 1999\n\nwe def(initely) agree")) == [("of", "class", 0, 1, 1, "class of 1999")]
    broken = list(code.units('def f():\n    """never closed\nclass A:\n'))
    assert [(u[0], u[4]) for u in broken] == [("f", 3)]
    assert [u[5] for u in code.units("def f():\r\n    pass\r\n")] == ["def f():\n    pass"]


def test_rows_columns_and_sql(spark):
    text = textwrap.dedent("""\
        class A:
            def f(self):
                pass
        """)
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "x = 1"), (1, text)], "id long, text string")
    got = code.definitions(docs).select("id", "name", "depth", "first_line", "last_line").collect()
    assert sorted(map(tuple, got)) == sorted([(1, "A", 0, 1, 3), (1, "A.f", 1, 2, 3)] * 2)
    assert "body" not in code.definitions(docs, bodies=False).columns
    assert code.names(code.definitions(docs.filter("id = 1").limit(1)), "id").first()["names"] == "A,A.f"
    clash = code.definitions(docs.withColumn("name", F.lit("mine")))
    assert clash.columns == ["id", "text", "name", "definition"] and {r["definition"]["name"] for r in clash.collect()} == {"A", "A.f"}
    assert code.definitions(docs.limit(0)).count() == 0
    code.register(docs, "units_of")
    assert spark.sql("SELECT count(*) FROM units_of('def f(): pass', true)").first()[0] == 1
    with pytest.raises(AnalysisException, match="read from text"):
        code.definitions(docs, "id").collect()


def test_time_grows_with_the_lines():
    import time

    def took(n):
        text = "\n".join(f"def f{i}(x):\n    return x + {i}\n" for i in range(n))
        began = time.perf_counter()
        assert sum(1 for _ in code.units(text)) == n
        return time.perf_counter() - began

    took(1000)
    assert took(40_000) < 4 * took(20_000) + 0.2
