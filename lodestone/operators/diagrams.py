"""Mermaid diagrams of small selections of a graph. Selections are top-k, so what is collected here has a few dozen rows."""

from __future__ import annotations

import hashlib
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import algorithms, text

KINDS = ("architecture", "call_flow", "dependencies", "layers", "hotspot_map")
#: Colours of hotspots by band, of the node a diagram starts from and of its centre, and of layers by a word in their name.
HEAT = {"hot": "#ff5252", "warm": "#ffab40", "mild": "#fff176", "cold": "#69f0ae"}
START, CENTRE = "#f96", "#6f9"
LAYER_FILL = {"API": "#e1f5fe", "Service": "#fff3e0", "Data": "#e8f5e9", "Utility": "#f3e5f5", "Test": "#fce4ec"}
OTHER_FILL = "#f5f5f5"
#: How a node is drawn by type, and an edge.
SHAPES = {"class": '{0}(["{1}"])', "function": '{0}("{1}")', "module": '{0}["{1}"]'}
ARROWS = {"calls": "-.->|calls|", "imports": "-->|imports|"}


class Drawing:
    """Lines of a diagram; nodes get identifiers of their own as they are added."""

    def __init__(self):
        self.lines: list[str] = ["graph TD"]
        self.ids: dict[str, str] = {}

    def take(self, chosen: DataFrame, *order) -> list:
        """The rows of a small selection (id, type, name and more) with labels; their identifiers are those of text.diagram_id(), and where
        several share one, each has a digest of its id after it."""
        rows = chosen.withColumns({"__base": text.diagram_id(F.col("id")), "__label": text.diagram_label(F.col("name"))}).orderBy(*(order or ("id",))).collect()
        self.ids |= identifiers({r["id"]: r["__base"] for r in rows})
        return rows

    def nodes(self, rows, indent: str = "") -> None:
        for r in rows:
            self.add(indent + SHAPES.get(r["type"], SHAPES["module"]).format(self.ids[r["id"]], r["__label"]))

    def group(self, name: str, title: str, rows, fill: str | None = None) -> None:
        self.add(f'subgraph {name}["{title}"]')
        self.nodes(rows, "    ")
        self.add("end")
        if fill:
            self.fill(name, fill)

    def edges(self, edges: DataFrame, keep=lambda e: True) -> None:
        chosen = list(self.ids)
        for e in edges.where(F.col("src").isin(chosen) & F.col("dst").isin(chosen)).select("src", "dst", "type").distinct().orderBy("type", "src", "dst").collect():
            if keep(e):
                self.add(f"{self.ids[e['src']]} {ARROWS.get(e['type'], ARROWS['imports'])} {self.ids[e['dst']]}")

    def fill(self, name: str, colour: str) -> None:
        self.add(f"style {name} fill:{colour}")

    def add(self, line: str) -> None:
        self.lines.append(f"    {line}")

    def __str__(self) -> str:
        return "\n".join(self.lines)


def identifiers(bases: dict[str, str]) -> dict[str, str]:
    """Different identifiers for names with given ones: those that several share get as much of the name's digest as tells all apart."""
    shared = {b for b, n in Counter(bases.values()).items() if n > 1}
    for size in range(6, 65):
        out = {name: f"{b}_{hashlib.sha256(name.encode()).hexdigest()[:size]}" if b in shared else b for name, b in bases.items()}
        if len(set(out.values())) == len(out):
            return out
    raise ValueError("two names have one digest")


def error(message: str) -> str:
    """A diagram of one node that says what is wrong, with the whole message in a comment."""
    d = Drawing()
    flat = " ".join(message.split()).replace("`", "'")
    shown = f"Error: {flat}"
    shown = shown if len(shown) <= 30 else f"{shown[:27]}..."
    for a, b in text.ESCAPES:
        shown = shown.replace(a, b)
    d.add(SHAPES["module"].format("error_node", shown))
    d.add(f"%% {flat}")
    return str(d)


def find(nodes: DataFrame, wanted: str, kind: str | None = None) -> str | None:
    """The id that a text means: an id, else a name or path whatever the case, else one that has it; the least of several."""
    q = wanted.lower()
    own = nodes if kind is None else nodes.where((F.col("type") == "module") if kind == "module" else (F.col("type") != "module"))
    name, path = F.lower("name"), F.lower("file_path")
    order = F.when(F.col("id") == wanted, 0).when((name == q) | (path == q), 1).when(name.contains(q) | path.contains(q), 2)
    best = own.select("id", order.alias("o")).where("o is not null").orderBy("o", "id").first()
    if best is None and kind is not None:
        return find(nodes, wanted)
    return best and best["id"]


def select(nodes: DataFrame, ranks: DataFrame, degree: DataFrame, n: int) -> DataFrame:
    """The n nodes of highest rank, then degree, then by id."""
    return important(nodes, ranks, degree).orderBy(F.desc("rank"), F.desc("degree"), "id").limit(n)


def important(nodes: DataFrame, ranks: DataFrame, degree: DataFrame) -> DataFrame:
    """nodes with rank and degree, 0 where there is none."""
    return nodes.join(ranks.select("id", F.col("score").alias("rank")), "id", "left").join(degree, "id", "left").fillna(0, ["rank", "degree"])


def degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id")))
    return ends.groupBy("id").agg(F.count("*").alias("degree"))


def architecture(nodes, edges, ranks, communities, names: dict, n: int, scope: str | None = None) -> str:
    """The n most important modules by community, under the communities' names."""
    modules = nodes.where("type = 'module'")
    if scope:
        modules = modules.where(F.lower("file_path").contains(scope.lower()))
    d = Drawing()
    rows = d.take(select(modules, ranks, degrees(edges), n).join(communities, "id", "left"), "community", "id")
    if not rows:
        return error("No modules are available")
    groups: dict = {}
    for r in rows:
        groups.setdefault(r["community"] or r["id"], []).append(r)
    for k, (c, group) in enumerate(groups.items(), 1):
        d.group(f"group_{k}", names.get(c) or f"Group {k}", group)
    d.edges(edges)
    return str(d)


def call_flow(nodes, edges, start: str, n: int) -> str:
    """The first n entities that calls lead to, by depth, then by id."""
    flow = edges.where("type = 'calls'")
    near = algorithms.reach(flow, start, n).orderBy("depth", "node").limit(max(0, n - 1))
    chosen = [start, *(r["node"] for r in near.collect())]
    d = Drawing()
    d.nodes(d.take(nodes.where(F.col("id").isin(chosen))))
    d.edges(flow)
    d.fill(d.ids[start], START)
    return str(d)


def dependencies(nodes, edges, ranks, centre: str, n: int) -> str:
    """A module with what it imports and what imports it; if these are more than n, the most important ones. ranks is a function, as few need it."""
    touching = edges.where((F.col("type") == "imports") & ((F.col("src") == centre) | (F.col("dst") == centre)) & (F.col("src") != F.col("dst")))
    near = touching.select(F.when(F.col("src") == centre, F.col("dst")).otherwise(F.col("src")).alias("id")).distinct()
    most = max(0, n - 1)
    if near.limit(most + 1).count() > most:
        near = select(nodes.join(near, "id", "left_semi"), ranks(), degrees(edges), most)
    chosen = [centre, *(r["id"] for r in near.select("id").collect())]
    d = Drawing()
    d.nodes(d.take(nodes.where(F.col("id").isin(chosen))))
    d.edges(touching)
    d.fill(d.ids[centre], CENTRE)
    return str(d)


def hotspot_map(modules: DataFrame, edges: DataFrame, frequency: DataFrame, ranks: DataFrame, n: int) -> str:
    """The n modules that change most often (frequency: path, frequency), then of the highest rank, then by id, coloured by their place."""
    if frequency.isEmpty():
        return error("No change history is available")
    often = modules.join(frequency.withColumnRenamed("path", "file_path"), "file_path", "left").fillna(0, ["frequency"])
    order = [F.desc("frequency"), F.desc("rank"), F.asc("id")]
    d = Drawing()
    rows = d.take(often.join(ranks.select("id", F.col("score").alias("rank")), "id", "left").fillna(0, ["rank"]).orderBy(*order).limit(max(1, n)), *order)
    if not rows:
        return error("No modules are available")
    d.nodes(rows)
    d.edges(edges.where("type = 'imports'"))
    for k, r in enumerate(rows, 1):
        band = next((b for b, part in zip(HEAT, (0.2, 0.5, 0.8), strict=False) if k / len(rows) <= part), "cold")
        d.fill(d.ids[r["id"]], HEAT[band])
    return str(d)


def layers(nodes, edges, ranks, communities, names: dict, n: int) -> str:
    """The n largest communities share n nodes in proportion to their sizes, one each at least; what is left goes to the most important nodes of
    all. Only edges between communities are drawn."""
    modules = important(nodes.where("type = 'module'").join(communities, "id"), ranks, degrees(edges)).cache()
    sizes = {r["community"]: r["n"] for r in modules.groupBy("community").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "community").limit(n).collect()}
    if not sizes:
        return error("No modules are available")
    total, order = sum(sizes.values()), [F.desc("rank"), F.desc("degree"), F.asc("id")]
    chosen: set = set()
    for c, size in sizes.items():
        share = min(max(1, n * size // total), n - len(chosen))
        chosen |= {r["id"] for r in modules.where(F.col("community") == c).orderBy(*order).limit(max(0, share)).select("id").collect()}
    rest = modules.where(~F.col("id").isin(list(chosen)) & F.col("community").isin(list(sizes))).orderBy(*order).limit(n - len(chosen))
    chosen |= {r["id"] for r in rest.select("id").collect()}
    d = Drawing()
    home, groups = {}, {c: [] for c in sizes}
    for r in d.take(modules.where(F.col("id").isin(list(chosen)))):
        home[r["id"]] = r["community"]
        groups[r["community"]].append(r)
    for k, (c, rows) in enumerate(((c, rows) for c, rows in groups.items() if rows), 1):
        title = names.get(c) or f"Layer {k}"
        d.group(f"layer_{k}", title, rows, next((colour for word, colour in LAYER_FILL.items() if word in title), OTHER_FILL))
    d.edges(edges.where("type = 'imports'"), lambda e: home[e["src"]] != home[e["dst"]])
    modules.unpersist()
    return str(d)
