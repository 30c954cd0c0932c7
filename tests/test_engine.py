"""The code path on a small repository of its own, with values worked out by hand."""

from __future__ import annotations

import os
import subprocess
from datetime import date

import pytest
from pyspark.sql import functions as F

FILES = {
    "app.py": "from shop.cart import add_item, total\nimport shop.stock as stock\n\n\ndef main():\n    add_item(1)\n    add_item(2)\n    stock.reserve(3)\n    unknown()\n\n\nmain()\n",
    "shop/__init__.py": "# shop\n",
    "shop/cart.py": "from .stock import reserve\nfrom . import prices\n\n\nclass Cart:\n    def add(self, x):\n        self.check(x)\n        return reserve(x)\n\n    def check(self, x):\n        return prices.of(x)\n\n\ndef add_item(x):\n    cart = Cart()\n    cart.add(x)\n    return cart\n\n\ndef total(items):\n    def one(i):\n        return prices.of(i)\n    return sum(one(i) for i in items)\n",
    "shop/stock.py": "from shop.cart import Cart\nimport os.path\n\n\ndef reserve(n):\n    return os.path.join('a', str(n))\n\n\ndef forgotten():\n    pass\n",
    "shop/prices.py": "def of(x):\n    return x\n",
    "alone.py": "class Nobody:\n    pass\n",
    "web/view.ts": "import { total } from '../shop/total';\nimport * as fmt from './format';\n\nexport function show(a: number): string {\n  return fmt.money(helper(a));\n}\nconst helper = (x) => x + 1;\nclass Page {\n  render() { return show(1); }\n}\n",
    "web/format.js": "export function money(x) { return '$' + x; }\n",
    "main.go": 'import "fmt"\nfunc Run(a int) {\n  if (a) {\n}\ntype X struct\nstruct Y\n',
    "node_modules/skip.py": "def no(): pass\n",
    "broken.py": "def fine():\n    pass\n\ndef bad(:\n",
    "notes.txt": "not code",
}


def git(root, *args, day=None):
    env = os.environ | ({"GIT_AUTHOR_DATE": f"2024-01-{day:02}T00:00:00Z", "GIT_COMMITTER_DATE": f"2024-01-{day:02}T00:00:00Z"} if day else {})
    subprocess.run(["git", "-C", str(root), "-c", "user.name=Ann", "-c", "user.email=ann@example.org", *args], check=True, capture_output=True, env=env)


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    for path, source in FILES.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(source)
    (root / "latin.py").write_bytes(b"x = '\xe9'\n")
    git(root, "init", "-q")
    git(root, "add", "-A")
    git(root, "commit", "-qm", "first", day=1)
    for day in (2, 3, 4):
        for path in ("shop/stock.py", "shop/prices.py"):
            with (root / path).open("a") as f:
                f.write(f"# {day}\n")
        git(root, "commit", "-qam", f"change {day}", day=day)
    return root


@pytest.fixture(scope="module")
def engine(spark, repo):
    from lodestone.api import Engine

    return Engine.analyze(spark, str(repo))


def edges_of(engine, kind):
    return {(r.src, r.dst): r for r in engine.code.edges.where(f"type = '{kind}'").collect()}


def test_scan_and_counts(engine):
    found = engine.counts()
    assert found["languages"] == {"python": 7, "typescript": 1, "javascript": 1, "go": 1}
    assert found["entities"] == {"module": 10, "function": 16, "class": 4}
    assert sorted(engine.warnings()) == ["1 file(s) were read by line rules: declarations and imports only", "broken.py has syntax errors; it is analysed in part"]
    assert engine.coverage()["cycle_components_skipped"] == 0


def test_imports(engine):
    got = {k: r.resolution for k, r in edges_of(engine, "imports").items()}
    assert got == {
        ("app.py", "shop/cart.py"): "exact", ("app.py", "shop/stock.py"): "exact", ("shop/cart.py", "shop/stock.py"): "exact", ("shop/cart.py", "shop/prices.py"): "exact",
        ("shop/stock.py", "shop/cart.py"): "exact", ("web/view.ts", "web/format.js"): "exact",
    }


def test_calls(engine):
    got = {k: (r["count"], r.resolution, list(r.source_lines)) for k, r in edges_of(engine, "calls").items()}
    assert got == {
        ("app.py::main", "shop/cart.py::add_item"): (2, "exact", [6, 7]), ("app.py::main", "shop/stock.py::reserve"): (1, "exact", [8]), ("shop/cart.py::Cart.add", "shop/cart.py::Cart.check"): (1, "inferred", [7]),
        ("shop/cart.py::Cart.add", "shop/stock.py::reserve"): (1, "exact", [8]), ("shop/cart.py::Cart.check", "shop/prices.py::of"): (1, "exact", [11]), ("shop/cart.py::add_item", "shop/cart.py::Cart"): (1, "exact", [15]),
        ("shop/cart.py::total", "shop/cart.py::total.one"): (1, "exact", [23]), ("shop/cart.py::total.one", "shop/prices.py::of"): (1, "exact", [22]), ("web/view.ts::show", "web/format.js::money"): (1, "exact", [5]),
        ("web/view.ts::show", "web/view.ts::helper"): (1, "exact", [5]), ("web/view.ts::Page.render", "web/view.ts::show"): (1, "exact", [9]),
    }
    c = engine.coverage()
    assert c["calls_observed"] == c["calls_resolved"] + c["calls_unresolved"] + c["calls_ambiguous"] and c["calls_ambiguous"] == 0


def test_rules(engine):
    assert [list(r.path) for r in engine.cycles().collect()] == [["shop/cart.py", "shop/stock.py"]]
    dead = {r.id for r in engine.dead().collect()}
    assert {"shop/stock.py::forgotten", "alone.py::Nobody", "broken.py::fine", "broken.py::bad"} <= dead and "app.py::main" not in dead
    assert {r.id for r in engine.orphans().collect()} == {"alone.py", "broken.py", "web/view.ts"}
    found = engine.issues().orderBy("rank").collect()
    assert (found[0].type, found[0].severity) == ("circular_dependency", "high") and (found[-1].type, found[-1].severity) == ("orphan_file", "low")
    assert found[0].description == "Circular dependency: shop/cart.py → shop/stock.py → shop/cart.py" and list(found[0].files) == ["shop/cart.py", "shop/stock.py"] and "third" in found[0].suggestion
    assert all(r.description and r.suggestion and r.files and r.source for r in found)
    dead = next(r for r in found if r.subject == "shop/stock.py")
    assert list(dead.entities) == ["forgotten"] and "forgotten" in dead.description
    assert engine.issues(["nothing"]).collect() == [] and {r.type for r in engine.issues(["orphan_file", "x"]).collect()} == {"orphan_file"}


def test_metrics(engine):
    pairs = {r.pair: r.score for r in engine.metric("coupling").collect()}
    assert pairs["shop/cart.py <-> shop/stock.py"] == 3 and pairs["app.py <-> shop/cart.py"] == 3
    ranks = {r.id: r.score for r in engine.metric("pagerank").collect()}
    assert sum(ranks.values()) == pytest.approx(1, abs=1e-3)
    hot = {r.path: r.frequency for r in engine.metric("hotspots").collect()}
    assert hot["shop/stock.py"] == 4 and hot["app.py"] == 1
    assert {r.author for r in engine.metric("ownership", 3).collect()} == {"Ann"}
    assert {r.section for r in engine.metric("summary").collect()} == {"pagerank", "centrality", "complexity"}
    with pytest.raises(ValueError):
        engine.metric("other")


def test_search_and_trace(engine):
    found = engine.search("CART", "class").collect()
    assert [(r.id, list(r.called_by)) for r in found] == [("shop/cart.py::Cart", ["add_item"])]
    with pytest.raises(ValueError):
        engine.search("x" * 121)
    steps, more = engine.trace("main", "forward", 1)
    assert [(r.place, r.node, r.parent, r.relationship, r.resolution, list(r.source_lines), r.name) for r in steps.collect()] == [
        (1, "shop/cart.py::add_item", "app.py::main", "calls", "exact", [6, 7], "add_item"), (2, "shop/stock.py::reserve", "app.py::main", "calls", "exact", [8], "reserve"),
    ] and more
    back, more = engine.trace("of", "backward", 5)
    assert {r.node for r in back.collect()} == {"shop/cart.py::Cart.check", "shop/cart.py::total.one", "shop/cart.py::Cart.add", "shop/cart.py::total"} and not more
    assert engine.trace("no such name")[0].collect() == []


def test_history(engine, repo):
    from lodestone.sources.repository import NotFound

    c = engine.context("shop/stock.py", date(2024, 1, 10))
    assert c["frequency"] == 4 and c["age"]["days_since"] == 6
    assert c["co_changed"][0]["other"] == "shop/prices.py" and c["co_changed"][0]["together"] == 4
    assert [x["message"] for x in c["commits"]] == ["change 4", "change 3", "change 2", "first"] and c["owners"][0]["percentage"] == 100
    for bad in ("../x", "nothing.py"):
        with pytest.raises(NotFound):
            engine.context(bad)


def test_failing_rule(spark):
    from lodestone.operators import issues

    def bad():
        raise RuntimeError("no such thing")

    cycles = spark.createDataFrame([(["a", "b", "c"], 3)], "path array<string>, length long")
    got = issues.detected(spark, {"dead_code": bad, "circular_dependency": lambda: cycles}).orderBy("rank").collect()
    assert [(r.type, r.severity) for r in got] == [("circular_dependency", "high"), ("dead_code", "low")] and "no such thing" in got[1].description and "interface" in got[0].suggestion


def test_diagrams(engine):
    for kind, scope in (("architecture", None), ("call_flow", "main"), ("dependencies", "shop/cart.py"), ("layers", None), ("hotspot_map", None)):
        drawn = engine.visualize(kind, scope)
        assert drawn.startswith("graph TD\n")
    assert "style shop_cart_py fill:#6f9" in engine.visualize("dependencies", "cart.py")
    assert "-.->|calls|" in engine.visualize("call_flow", "main")
    drawn = engine.visualize("call_flow", "no such thing at all")
    assert 'error_node["Error: nothing is named no ..."]' in drawn and "%% nothing is named no such thing at all" in drawn
    assert "error_node" in engine.visualize("architecture", "no such folder") and "error_node" in engine.visualize("call_flow") and "error_node" in engine.visualize("dependencies", " ")
    few = __import__("lodestone.operators.diagrams", fromlist=["x"]).dependencies(engine.code.nodes, engine.code.edges, lambda: engine.ranks, "shop/cart.py", 2)
    assert few.count("imports") >= 1 and len([x for x in few.split("\n") if "[" in x]) == 2
    hot = engine.visualize("hotspot_map").split("\n")
    assert hot[1].strip().startswith("shop_prices_py[") and "style shop_prices_py fill:#ff5252" in drawn + "\n".join(hot) and hot[2].strip().startswith("shop_stock_py[")
    assert "fill:" in engine.visualize("layers") and 'subgraph layer_1["' in engine.visualize("layers")


def test_community_names(spark):
    from lodestone.operators import diagrams, issues

    rows = [(1, "src/routes/users.py"), (1, "main.py"), (2, "src/services/accounts.py"), (2, "src/services/deep/a.py"), (3, "src/a.py"), (3, "src/b.py"), (4, "a.py"), (5, "pkg/my-tool_kit/a.py"), (6, "x/a.py"), (6, "y/b.py")]
    got = {r.community: r.name for r in issues.community_names(spark.createDataFrame(rows, "community int, path string")).collect()}
    assert got == {1: "API Layer", 2: "Service Layer", 5: "My Tool Kit"}
    nodes = spark.createDataFrame([(p, "module", p, p) for _, p in rows], "id string, type string, file_path string, name string").distinct()
    edges = spark.createDataFrame([("main.py", "src/services/accounts.py", "imports")], "src string, dst string, type string")
    ranks = nodes.select("id", F.lit(0.1).alias("score"))
    members = spark.createDataFrame([(p, str(c)) for c, p in rows], "id string, community string")
    names = {str(c): n for c, n in got.items()}
    drawn = diagrams.layers(nodes, edges, ranks, members, names, 6)
    assert '["API Layer"]' in drawn and "fill:#e1f5fe" in drawn and '["Layer ' in drawn and drawn.count("subgraph") == 6
    assert 'subgraph group_2["Service Layer"]' in diagrams.architecture(nodes, edges, ranks, members, names, 20)
    assert diagrams.layers(nodes.limit(0), edges, ranks, members, {}, 5).count("error_node") == 1


def test_diagram_ids(spark):
    import re

    from lodestone.operators import diagrams, text

    names = ["end", "foo.bar", "foo/bar", "foo_bar_2", "123-start", "!!!"]
    chosen = spark.createDataFrame([(n, "module", n) for n in names], "id string, type string, name string")
    d = diagrams.Drawing()
    rows = d.take(chosen)
    assert d.ids["end"] == "node_end" and d.ids["123-start"] == "node_123_start" and d.ids["!!!"] == "unknown" and d.ids["foo_bar_2"] == "foo_bar_2"
    assert len(set(d.ids.values())) == 6 and all(re.fullmatch("[A-Za-z][A-Za-z0-9_]*", x) for x in d.ids.values()) and d.ids["foo.bar"].startswith("foo_bar_") and len(rows) == 6
    got = chosen.select(text.diagram_id(F.col("id")).alias("x")).collect()
    assert [r.x for r in got] == ["node_end", "foo_bar", "foo_bar", "foo_bar_2", "node_123_start", "unknown"]
    said = spark.createDataFrame([('a"\n<b>&c\\d',)], "n string").select(text.diagram_label(F.col("n")).alias("x")).first().x
    assert said == "a&quot; &lt;b&gt;&amp;c&#92;d"


def test_snapshot(spark, repo, tmp_path):
    from lodestone.api import Engine
    from lodestone.sources import repository, snapshot

    cache = str(tmp_path / "cache")
    assert not Engine.analyze(spark, str(repo), cache=cache).reused
    again = Engine.analyze(spark, str(repo), cache=cache)
    assert again.reused and again.counts()["entities"]["module"] == 10
    assert snapshot.load(spark, cache, "0" * 40) is None and snapshot.load(spark, cache, None) is None and not snapshot.save(again.code, cache, None)
    mark = next((tmp_path / "cache" / f"v{snapshot.VERSION}" / repository.head(str(repo)) / "done").glob("part-*"))
    mark.write_text("{}")
    (mark.parent / f".{mark.name}.crc").unlink(missing_ok=True)
    assert snapshot.load(spark, cache, repository.head(str(repo))) is None


def test_scratch(spark):
    from pathlib import Path

    from lodestone.sources import scratch

    t = scratch.scratch(spark.range(3), "some")
    where = Path(t._scratch.removeprefix("file:"))
    assert t.count() == 3 and where.exists()
    scratch.forget(t)
    scratch.forget(t)
    scratch.forget(spark.range(1))
    assert not where.exists()
    from types import SimpleNamespace as Of

    def session(master, **conf):
        none = Of(isDefined=lambda: False)
        return Of(conf=Of(get=lambda k, other="/w": conf.get(k.rpartition(".")[2], other)), sparkContext=Of(master=master, _jsc=Of(sc=lambda: Of(getCheckpointDir=lambda: none))))

    assert scratch.folder(session("local[4]")) == "/w/_scratch" and scratch.folder(session("yarn", dir="s3://x/")) == "s3://x"
    for master in ("yarn", "spark://h:1", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            scratch.folder(session(master))


def test_scope_and_limits(spark, repo, tmp_path):
    from lodestone.sources import repository

    assert {r.file_path for r in repository.scan(spark, str(repo), "shop").select("file_path").collect()} == {f"shop/{x}.py" for x in ("__init__", "cart", "stock", "prices")}
    for bad in ("..", "/etc", "app.py"):
        with pytest.raises(repository.NotFound):
            repository.scan(spark, str(repo), bad)
    with pytest.raises(repository.TooLarge):
        repository.scan(spark, str(repo), limits=repository.Limits(files=3))
    (tmp_path / "x.py").write_text("")
    assert repository.head(str(tmp_path)) is None and repository.commits(spark, str(tmp_path)).collect() == [] and repository.blame(spark, str(tmp_path), ["x.py"]).collect() == []


def test_listing(spark):
    from lodestone.sources import repository

    rows = [("a/b.py", 5), ("node_modules/x.py", 5), ("a/x.egg-info/y.py", 5), ("yarn.lock", 5), ("big.py", 600_000), ("B.TSX", 1), ("m.kt", 1), ("notes.txt", 1), (".py", 1), ("d.tar.go", 2)]
    got = {r.file_path: r.language for r in repository.wanted(spark.createDataFrame(rows, "file_path string, size long")).collect()}
    assert got == {"a/b.py": "python", "B.TSX": "typescript", "m.kt": "kt", "d.tar.go": "go"}
    every = repository.supported_extensions()
    assert every == sorted(every) and {".py", ".tsx", ".scala"} <= set(every) and all(repository.language_of(e) for e in every)


def test_line_rules_as_a_plan(spark):
    """The plan over texts and the parser of one text find the same."""
    from lodestone.functions import line_source

    source = {
        ("A.java", "java"): 'import x.y.Z;\npublic static int add(int a) {\n  if (a) {\n  return go(a);\nclass B {\npublic class C {\nimport "q";\r\n',
        ("m.rs", "rs"): "fn run(a) {\nstruct Y {\nuse z;\nfrom a import b, c\nimport d, e\nELSE foo(\nwhile(\n  new Thing(x)\nvector<int, 3> make(int a)\n" + "a " * 1200 + "f(\n",
        ("n.go", "go"): 'import "fmt"\nfunc Run(a int) {\n\ntype X struct\nenum E\nfrom x import y\nunit tests(',
    }
    df = spark.createDataFrame([(p, t, lang) for (p, lang), t in source.items()] + [("none.go", None, "go")], "file_path string, text string, language string")
    got = {}
    for r in line_source.found(df).collect():
        got.setdefault(r.file_path, set()).add((r.kind, r.name) if r.kind == "import" else (r.kind, r.name, r.line_no))
    want = {}
    for (p, lang), t in source.items():
        one = line_source.parse(p, t, lang)
        want[p] = {(e["type"], e["name"], e["line_start"]) for e in one["entities"]} | {("import", i["target_module"]) for i in one["imports"]}
    assert got == want and ("function", "make", 9) in got["m.rs"] and ("import", "d") in got["m.rs"] and not any(x[1] == "Thing" for x in got["m.rs"])


def test_python_details():
    from lodestone.functions import python_source

    p = python_source.parse("a.py", "import a, b.c\nfrom x import y as z\n@deco(1)\ndef f(\n    a: int = g(),\n) -> str:\n    h(1)(k)\n    t[i]()\n    'x'.join(q)\n    def inner():\n        r()\n    lam = lambda: s()\n\nclass C:\n    async def m(self):\n        self.n.o()\n")
    assert [(e["name"], e["type"], e["line_start"], e["line_end"]) for e in p["entities"]] == [("C", "class", 14, 16), ("f", "function", 4, 12), ("f.inner", "function", 10, 11), ("C.m", "function", 15, 16)]
    assert p["entities"][1]["signature"] == "def f( a: int = g(), ) -> str"
    assert {(c["caller"], c["callee"], c["callee_path"]) for c in p["calls"]} == {("f", "g", "g"), ("f", "h", "h"), ("f", "h", None), ("f", "i", None), ("f", "join", None), ("f.inner", "r", "r"), ("f", "s", "s"), ("C.m", "o", "self.n.o")}
    assert [(i["target_module"], i["local_names"], i["is_from"]) for i in p["imports"]] == [("a", ["a"], False), ("b.c", ["b"], False), ("x", ["z"], True)]


def test_other_languages():
    from lodestone.functions import line_source, script_source

    p = line_source.parse("A.java", 'import x.y.Z;\npublic static int add(int a) {\n  if (a) {\n  return go(a);\nclass B {\npublic class C {\n', "java")
    assert [(e["name"], e["type"]) for e in p["entities"]] == [("add", "function"), ("B", "class")] and p["imports"][0]["target_module"] == "x.y.Z"
    s = script_source.parse("a.js", "import d, { a as b } from 'm';\nimport * as n from \"./k\";\nconst f = async (x) => {\n  g(x); new H();\n  function inner() { z.y(); }\n};\nclass K {\n  async go(a) { this.run(`t${a}`); }\n}\nconst one = y => two(y);\n")
    assert {(e["name"], e["type"]) for e in s["entities"]} == {("f", "function"), ("inner", "function"), ("K", "class"), ("K.go", "function"), ("one", "function")}
    assert {(c["caller"], c["callee"], c["callee_path"]) for c in s["calls"]} == {("f", "g", "g"), ("inner", "y", "z.y"), ("K.go", "run", "this.run"), ("one", "two", "two")}
    assert [(i["target_module"], i["imported_names"], i["local_names"], i["is_from"]) for i in s["imports"]] == [("m", ["a"], ["b"], True), ("./k", [], ["n"], False)]
    assert script_source.parse("b.ts", "function f() { (")["recovered"]
