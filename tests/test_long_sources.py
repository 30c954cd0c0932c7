"""Long sources are parsed in parts that together say what the whole says."""

from __future__ import annotations

import ast

import pytest

from lodestone.functions import python_source

ODD = '''# odd
import a, b.c
from x import (
y,
z)
@deco(1)
def f(
    a: int = g(),
) -> str:
    h(1)(k)
    def inner():
        r()
    inner()
s = """
def notadef():
import no
class Nope:
"""
t = f"""
import {
f(1)
}
"""
class C(Base):
    async def m(self):
        self.n.o()
try:
    pass
except E:
    go()
else:
    no()
@a
@b
async def q(): return w()
class f: pass
def C():
    m()
if q:
    def late(): z()
'''


@pytest.mark.parametrize("newline", ["\n", "\r\n"])
def test_parts_say_what_the_whole_says(newline):
    source = ODD.replace("\n", newline)
    whole = python_source.parse("m/a.py", source)
    for size in range(1, len(source), 7):
        found = list(python_source.parts("m/a.py", source, size))
        entities = [e for kind in ("class", "function") for x in found for e in x["entities"] if e["type"] == kind]
        assert [entities] + [[y for x in found for y in x[k]] for k in ("imports", "calls")] == [whole[k] for k in ("entities", "imports", "calls")]
    assert len(list(python_source.parts("m/a.py", source, 1))) > 4


def long_source() -> str:
    many = "".join(f"def f{k}():\n    def one():\n        pass\n    one()\n    f{k // 2}()\n    nowhere.g{k}()\n" for k in range(6000))
    return f"from short import given\nclass f7:\n    pass\n{many}class f9:\n    def m(self):\n        given()\n        self.m()\nimport short\n"


def test_long_files(spark):
    from lodestone.plans import codegraph
    from lodestone.sources import repository

    source = long_source()
    files = {"long.py": source, "short.py": "def given():\n    pass\n", "broken.py": source + "def bad(:\n"}
    df = spark.createDataFrame([(p, bytearray(s.encode())) for p, s in files.items()], "file_path string, content binary")
    rows = repository.parsed(df).orderBy("file_path", "part").collect()
    own = [r for r in rows if r.file_path == "long.py"]
    whole = python_source._walk("long", ast.parse(source), source.split("\n"), 0)
    assert len(own) > 1 and [r.part for r in own] == list(range(len(own))) and max(len(r.calls) for r in own) < len(whole["calls"]) / 1.5
    for k in ("imports", "calls"):
        got = {r.before[k] + i: x.asDict() for r in own for i, x in enumerate(r[k])}
        assert [got[i] for i in range(len(got))] == whole[k]
    got = {i + r.before["classes" if e.type == "class" else "functions"]: e.asDict() for r in own for i, e in enumerate(r.entities)}
    assert [got[i] for i in range(len(got))] == whole["entities"]
    assert [(r.recovered, len(r.calls), len(r.entities)) for r in rows if r.file_path == "broken.py"] == [(True, 0, 12004)]

    code = codegraph.build(repository.parsed(df))
    c = code.coverage.first()
    assert (c.files, c.calls_observed, c.calls_resolved, c.calls_ambiguous) == (3, 18002, 12002, 0) and c.calls_unresolved == 6000
    edges = {(r.src, r.dst): (r["count"], r.source_lines) for r in code.edges.where("type = 'calls' and src like 'long%'").collect()}
    assert edges["long.py::f5", "long.py::f5.one"] == (1, [37]) and edges["long.py::f5", "long.py::f2"] == (1, [38]) and ("long.py::f9.m", "short.py::given") in edges and len(edges) == 12002
    types = {r.id: r.type for r in code.nodes.where("id in ('long.py::f7', 'long.py::f9')").collect()}
    assert types == {"long.py::f7": "function", "long.py::f9": "function"}
