"""Values of graph algorithms on small graphs worked out by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lodestone.operators import algorithms, graph, history, text

WEIGHTS = [("m", "r", 2), ("m", "h", 2), ("r", "s", 1), ("s", "u", 2), ("s", "p", 4), ("h", "s", 1), ("h", "u", 2), ("u", "p", 2), ("p", "u", 1)]
NODES = [*"mrhsup", "x1", "x2", "x3", "x4", "x5"]


@pytest.fixture(scope="module")
def nodes(spark):
    return spark.createDataFrame([(n,) for n in NODES], "id string")


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([(a, b, w, 1.0 / w) for a, b, w in WEIGHTS], "src string, dst string, weight long, distance double")


def test_pagerank(nodes, edges):
    got = {r.id: round(r.score, 6) for r in algorithms.pagerank(nodes, edges).collect()}
    assert got == {"u": 0.373013, "p": 0.372209, "s": 0.058111, "r": 0.031667, "h": 0.031667} | {n: 0.022222 for n in ("m", "x1", "x2", "x3", "x4", "x5")}
    assert algorithms.pagerank(nodes.limit(0), edges).collect() == []


def test_betweenness(nodes, edges):
    got = {r.id: r.score for r in algorithms.betweenness(nodes, edges).collect()}
    assert got == {"h": 0.027778, "s": 0.022222, "u": 0.022222, "r": 0.005556} | {n: 0.0 for n in ("m", "p", "x1", "x2", "x3", "x4", "x5")}
    few = {r.id: r.score for r in algorithms.betweenness(nodes, edges, exact=5, samples=11).collect()}
    assert few == got


def test_cycles_and_trace(spark, edges):
    assert [(list(r.path), r.length) for r in algorithms.cycles(edges).collect()] == [(["p", "u"], 2)]
    ring = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (2, 1), (3, 3), (3, 4)], "src long, dst long")
    assert [list(r.path) for r in algorithms.cycles(ring).collect()] == [[1, 2], [1, 2, 3]]
    steps, more = algorithms.trace(edges, "m", 1)
    assert [(r.place, r.node, r.depth, r.parent) for r in steps.collect()] == [(1, "h", 1, "m"), (2, "r", 1, "m")] and more
    steps, more = algorithms.trace(edges, "m", 3)
    assert {r.node: r.depth for r in steps.collect()} == {"h": 1, "r": 1, "s": 2, "u": 2, "p": 3} and not more
    few, more = algorithms.trace(edges, "m", 3, steps=3)
    assert [r.node for r in few.collect()] == ["h", "r", "s"] and more
    assert algorithms.trace(edges, None)[0].collect() == [] and not algorithms.trace(edges, "nobody")[1]
    labelled = edges.where("src in ('m', 's')").select("src", "dst", F.lit("calls").alias("type"), F.lit("tree").alias("source"), F.lit("exact").alias("resolution"), F.array(F.lit(3)).alias("source_lines"))
    labelled = labelled.unionByName(labelled.where("src = 's' and dst = 'u'").withColumn("type", F.lit("imports")).withColumn("src", F.lit("r")))
    steps, _ = algorithms.trace(labelled, "u", 2, "both")
    assert [(r.depth, r.node, r.parent, r.relationship, r.resolution, r.source_lines) for r in steps.collect()] == [(1, "r", "u", "imports", "exact", [3]), (1, "s", "u", "calls", "exact", [3]), (2, "m", "r", "calls", "exact", [3]), (2, "p", "s", "calls", "exact", [3])]
    assert {r.node for r in algorithms.reach(edges, "s", 9, "backward").collect()} == {"h", "r", "m"}
    assert {r.node: r.depth for r in algorithms.reach(edges, "r", 9, "both").collect()} == {"m": 1, "s": 1, "h": 2, "u": 2, "p": 2}
    assert algorithms.reach(edges, "nobody", 3).collect() == []


def simple_cycles(edges: set, longest: int) -> list:
    out = []

    def walk(path):
        for a, b in edges:
            if a == path[-1]:
                if b == path[0] and len(path) > 1:
                    out.append(path)
                elif b > path[0] and b not in path and len(path) < longest:
                    walk([*path, b])

    for n in {a for a, _ in edges}:
        walk([n])
    return sorted(out, key=lambda p: (len(p), p))


def test_cycles_are_bounded(spark):
    import random

    r = random.Random(3)
    some = {(a, b) for a, b in ((r.randrange(14), r.randrange(14)) for _ in range(34)) if a != b} | {(20, 21), (21, 22), (22, 20), (21, 20), (30, 31)}
    want = simple_cycles(some, 10)
    got, skipped = algorithms.bounded_cycles(spark.createDataFrame(list(some), "src long, dst long"))
    assert [list(x.path) for x in got.collect()] == want[:100] and len(want) > 5 and skipped.first().skipped == 0
    dense = [(a, b) for a in range(200) for b in range(200) if a != b and (a + b) % 3 == 0] + [(1000, 1001), (1001, 1000)]
    got, skipped = algorithms.bounded_cycles(spark.createDataFrame(dense, "src long, dst long"))
    assert [list(x.path) for x in got.collect()] == [[1000, 1001]] and skipped.first().skipped == 2  # multiples of 3, and all others
    whole = [(a, b) for a in range(10) for b in range(10) if a != b]
    got = algorithms.cycles(spark.createDataFrame(whole, "src long, dst long")).collect()
    assert len(got) == 100 and {x.length for x in got} == {2, 3}
    none, skipped = algorithms.bounded_cycles(spark.createDataFrame([(1, 2)], "src long, dst long"))
    assert none.collect() == [] and skipped.first().skipped == 0


def test_communities(spark):
    groups = [(a, b, 1) for g in (0, 10) for a in range(g, g + 4) for b in range(g, g + 4) if a < b] + [(3, 10, 1)]
    edges = spark.createDataFrame(groups, "src long, dst long, weight long")
    nodes = spark.range(15).select("id")
    for method in (algorithms.communities, algorithms.propagated):
        got = {r.id: r.community for r in method(nodes, edges).collect()}
        assert {n: got[n] for n in (0, 1, 2, 3)} == dict.fromkeys(range(4), 0) and {got[n] for n in (10, 11, 12, 13)} == {10} and got[14] == 14
    with pytest.raises(ValueError, match="propagated"):
        algorithms.communities(nodes, edges, most=5)


def test_god_class(spark):
    members = spark.createDataFrame([("C", "C"), ("C", "C.a"), ("C", "C.b")], "cls string, id string")
    calls = [(f"out{k}", "C.a") for k in range(6)] + [("C.b", f"dep{k}") for k in range(5)] + [("C.a", "C.b"), ("out0", "C.b")]
    got = graph.god_classes(members, spark.createDataFrame(calls, "src string, dst string")).collect()
    assert [(r.cls, r.callers, r.dependencies, r.total) for r in got] == [("C", 6, 5, 11)]
    assert graph.god_classes(members, spark.createDataFrame(calls[1:-1], "src string, dst string")).collect() == []


def test_accumulate(spark):
    rows = [("a", "b", "calls", "exact" if k else "inferred", 30 - k, k) for k in range(25)] + [("a", "b", "calls", "exact", 30, 99)]
    got = graph.accumulate(spark.createDataFrame(rows, "src string, dst string, type string, resolution string, line int, seq long")).collect()
    assert [(r["count"], r.resolution, list(r.source_lines)) for r in got] == [(26, "inferred", list(range(30, 10, -1)))]


def test_history(spark):
    rows = [(s, k, f"2024-01-0{k} 12:00:00", p) for k, (s, paths) in enumerate([("c1", "abz"), ("c2", "ab"), ("c3", "ab"), ("c4", "a")], 1) for p in paths]
    commits = spark.createDataFrame(rows, "sha string, seq long, ts string, path string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert {(r.path, r.other, r.together, r.percentage) for r in history.co_changes(commits).collect()} == {("a", "b", 3, 75.0), ("b", "a", 3, 100.0)}
    import random
    from collections import Counter, defaultdict

    rnd = random.Random(7)
    made = {(s, p) for s in range(60) for p in rnd.sample(range(12), rnd.choice([1, 2, 3, 12]))}
    files, total, both = defaultdict(set), Counter(p for _, p in made), Counter()
    for s, p in made:
        files[s].add(p)
    for ps in files.values():
        both.update((a, b) for a in ps for b in ps if a != b)
    for pct in (0.0, 15.0, 50.0, 60.0):
        want = {(a, b, n) for (a, b), n in both.items() if n >= 3 and 100 * n >= pct * total[a]}
        for wide in (256, 2):
            got = history.co_changes(spark.createDataFrame(list(made), "sha long, path long"), percent=pct, most=99, wide=wide)
            assert {(r.path, r.other, r.together) for r in got.collect()} == want and (want or pct > 50)
    assert {r.path: r.frequency for r in history.frequency(history.recent_commits(commits, 2)).collect()} == {"a": 2, "b": 1}
    assert {r.path: r.frequency for r in history.frequency(commits, 3).collect()} == {"a": 3, "b": 3, "z": 1}


def test_cascade_and_suffixes(spark):
    names = spark.createDataFrame([("core",), ("app.core",), ("lib.store",)], "name string")
    targets = spark.createDataFrame([("re",), ("core",), ("none",)], "target string")
    assert {(r.target, r.name) for r in text.ends_with(targets, names).collect()} == {("re", "core"), ("re", "app.core"), ("re", "lib.store"), ("core", "core"), ("core", "app.core")}
    asked = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d")], "request long, target string")
    one = spark.createDataFrame([("a", "x"), ("b", "x"), ("b", "y")], "target string, owner string")
    two = spark.createDataFrame([("a", "z"), ("b", "z"), ("c", "w")], "target string, owner string")
    got = {r.request: (r.status, r.owner) for r in text.cascade(asked, [("exact", one), ("inferred", two)]).collect()}
    assert got == {1: ("exact", "x"), 2: ("ambiguous", None), 3: ("inferred", "w"), 4: ("unresolved", None)}


def test_aliases(spark):
    files = spark.createDataFrame([("src/pkg/__init__.py",), ("pkg2/__init__.py",), ("lib/core.py",), ("core.py",)], "file_path string")
    got = {}
    for r in text.aliases(files).collect():
        got.setdefault(r.alias, set()).add((r.file_path, r.exact))
    assert got["src.pkg"] == {("src/pkg/__init__.py", True)} and "pkg" not in got and got["pkg2"] == {("pkg2/__init__.py", True)}
    assert got["core"] == {("lib/core.py", False), ("core.py", True)} and got["src.lib.core"] == {("lib/core.py", False)} and got["pkg.__init__"] == {("src/pkg/__init__.py", False)}


def test_entry_points(spark):
    names = {"main": True, "mainly": False, "handle_x": True, "handler": False, "Cls.get_a": True, "getter": False, "getX": True, "test_a": True, "on_a": True, "once": False}
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", graph.is_entry_point(F.col("n")).alias("e"))
    assert {r.n: r.e for r in df.collect()} == names
