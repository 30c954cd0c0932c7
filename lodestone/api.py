"""The seven questions about a repository, answered from DataFrames. Each Engine is one analysis; nothing is global."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, timezone
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import algorithms, diagrams, graph, history, issues
from lodestone.plans import codegraph
from lodestone.sources import repository, snapshot
from lodestone.sources.repository import Limits, NotFound

METRICS = ("pagerank", "centrality", "complexity", "coupling", "hotspots", "ownership", "summary")
_clamp = lambda n, lo, hi: max(lo, min(hi, n))


@dataclass
class Engine:
    """An analysed repository. Make one with Engine.analyze()."""

    spark: SparkSession
    root: str
    code: codegraph.CodeGraph
    limits: Limits
    scope: str | None = None
    reused: bool = False

    @classmethod
    def analyze(cls, spark: SparkSession, root: str, scope: str | None = None, cache: str | None = None, limits: Limits | None = None) -> Engine:
        """Scan, parse and resolve; with a cache folder, a graph of the same commit is read if nothing has changed since."""
        limits = limits or Limits()
        commit = repository.head(root) if cache and not scope else None
        if commit and repository.is_clean(root, ".lodestone") and (kept := snapshot.load(spark, cache, commit)):
            return cls(spark, root, kept, limits, scope, True)
        code = codegraph.build(repository.parsed(repository.scan(spark, root, scope, limits)))
        if commit and repository.is_clean(root, ".lodestone"):
            snapshot.save(code, cache, commit)
        return cls(spark, root, code, limits, scope)

    # Projections

    @cached_property
    def modules(self) -> DataFrame:
        return self.code.nodes.where("type = 'module'")

    @cached_property
    def module_edges(self) -> DataFrame:
        return graph.module_graph(self.code.edges, self.code.nodes.select("id", "file_path")).cache()

    @cached_property
    def import_edges(self) -> DataFrame:
        return self.module_edges.where("import_count > 0").select("src", "dst")

    @cached_property
    def ranks(self) -> DataFrame:
        return algorithms.pagerank(self.modules.select("id"), self.module_edges.select("src", "dst", "weight")).cache()

    @cached_property
    def centrality(self) -> DataFrame:
        return algorithms.betweenness(self.modules.select("id"), self.module_edges).cache()

    @cached_property
    def communities(self) -> DataFrame:
        return algorithms.communities(self.modules.select("id"), self.module_edges).cache()

    # 1. Overview

    def counts(self) -> dict:
        n = {r["type"]: r["n"] for r in graph.counts_by(self.code.nodes, "type").collect()}
        e = {r["type"]: r["n"] for r in graph.counts_by(self.code.edges, "type", "count").collect()}
        return {"entities": n, "edges": e, "languages": {r["language"]: r["n"] for r in graph.counts_by(self.code.files, "language").collect()}}

    @cached_property
    def names(self) -> dict:
        """Names of communities for diagrams; those that have none are numbered there."""
        members = self.communities.join(self.modules.select("id", F.col("file_path").alias("path")), "id")
        return {r["community"]: r["name"] for r in issues.community_names(members.select("community", "path")).limit(self.limits.files).collect()}

    def coverage(self) -> dict:
        """Counters of what was read and resolved, and of import components that are too large to be searched for cycles."""
        return self.code.coverage.first().asDict() | {"cycle_components_skipped": self._cycles[1].first()["skipped"]}

    def warnings(self) -> list[str]:
        out = [r["warning"] for r in self.code.files.where("warning is not null").select("warning").orderBy("warning").limit(self.limits.files).collect()]
        if self.modules.limit(self.limits.many_files + 1).count() > self.limits.many_files:
            out.append(f"more than {self.limits.many_files} files; consider a folder of them")
        c = self.coverage()
        told = {
            "line_files": "file(s) were read by line rules: declarations and imports only", "calls_ambiguous": "call(s) have several possible targets and stay unresolved",
            "imports_ambiguous": "import(s) have several possible targets and stay unresolved", "cycle_components_skipped": "component(s) of imports are too large to be searched for cycles",
        }
        out += [f"{c[k]} {what}" for k, what in told.items() if c[k]]
        if self.scope:
            out.append(f"only {self.scope} was analysed; relations to other files are missing")
        return out

    def layers(self) -> list[str]:
        return [r["layer"] for r in issues.layers(self.communities.select("community", F.col("id").alias("path"))).orderBy("layer").collect()]

    def health(self) -> dict:
        span = self.code.nodes.where("type <> 'module' and source <> 'regex-fallback'").agg(F.avg("span")).first()[0]
        return {"cycles": self.cycles().count(), "dead": self.dead().count(), "god_classes": self.god_classes().count(), "orphans": self.orphans().count(), "bottlenecks": issues.bottlenecks(self.centrality).count(), "avg_span": round(span or 0.0, 6)}

    # 2. Search, 3. trace

    def search(self, query: str, type_: str | None = None, limit: int = 20) -> DataFrame:
        """id, type, name, file_path, relevance, calls and called_by: names in order."""
        found = graph.search(self.code.nodes, query, type_, limit)
        names = self.code.nodes.select(F.col("id").alias("other"), F.col("name").alias("other_name"))
        flow = self.code.edges.where("type = 'calls'")
        side = lambda a, b, out: flow.select(F.col(a).alias("id"), F.col(b).alias("other")).join(names, "other").groupBy("id").agg(F.array_sort(F.collect_set("other_name")).alias(out))
        none = F.array().cast("array<string>")
        out = found.join(side("src", "dst", "calls"), "id", "left").join(side("dst", "src", "called_by"), "id", "left")
        return out.select("id", "type", "name", "file_path", "relevance", F.coalesce("calls", none).alias("calls"), F.coalesce("called_by", none).alias("called_by")).orderBy("relevance", F.lower("name"), "file_path", "id")

    def trace(self, name: str, direction: str = "forward", depth: int = 5) -> tuple[DataFrame, bool]:
        """(steps, whether there is more): see algorithms.trace(), with type, name, file_path and line_start of each node. An unknown name has no steps."""
        if direction not in ("forward", "backward", "both"):
            raise ValueError("direction is forward, backward or both")
        start = diagrams.find(self.code.nodes, name)
        steps, more = algorithms.trace(self.code.edges, start, _clamp(depth, 1, 15), direction)
        known = self.code.nodes.select(F.col("id").alias("node"), F.col("type").alias("node_type"), "name", "file_path", "line_start")
        return known.join(F.broadcast(steps), "node").orderBy("place"), more  # a few steps

    # 4. Issues

    @cached_property
    def _cycles(self) -> tuple[DataFrame, DataFrame]:
        return algorithms.bounded_cycles(self.import_edges)

    def cycles(self) -> DataFrame:
        return self._cycles[0]

    def dead(self) -> DataFrame:
        return graph.dead(self.code.nodes, self.code.edges)

    def orphans(self) -> DataFrame:
        return graph.orphans(self.code.nodes, self.code.edges)

    def god_classes(self) -> DataFrame:
        classes = self.code.nodes.where("type = 'class'").select(F.col("id").alias("cls"), "file_path", F.col("name").alias("cls_name"))
        # a member's name begins with its class's: join on the prefixes of each name, not on startswith
        names = F.split("name", "\\.")
        inside = self.code.nodes.where("type = 'function'").select("id", "file_path", F.explode(F.transform(F.sequence(F.lit(1), F.size(names)), lambda k: F.array_join(F.slice(names, F.lit(1), k), "."))).alias("cls_name"))
        members = classes.select("cls", F.col("cls").alias("id")).unionByName(inside.join(classes, ["file_path", "cls_name"]).select("cls", "id"))
        return graph.god_classes(members.distinct(), self.code.edges)

    def issues(self, types: list[str] | None = None) -> DataFrame:
        """type, severity, subject, description, suggestion, files, entities, source, rank. Unknown types are passed over; a rule that fails gives an issue that says so."""
        known = {
            "circular_dependency": lambda: self.cycles(),
            "dead_code": lambda: issues.dead_by_file(self.dead()),
            "god_class": lambda: issues.god_severity(self.god_classes()),
            "bottleneck": lambda: issues.bottlenecks(self.centrality),
            "orphan_file": lambda: issues.orphans(self.orphans()),
            "high_coupling": lambda: issues.high_coupling(graph.coupling(self._file_edges(), 10)),
        }
        self.module_edges  # noqa: B018  (made once, before the rules run side by side)
        return issues.detected(self.spark, {t: f for t, f in known.items() if types is None or t in types})

    # 5. Metrics

    def _file_edges(self) -> DataFrame:
        return self.module_edges.select("src", "dst", F.col("weight").alias("count"))

    def _history(self) -> DataFrame:
        return repository.commits(self.spark, self.root, self.limits)

    def metric(self, name: str = "pagerank", n: int = 15) -> DataFrame:
        n = _clamp(n, 1, 15)
        best = lambda df: graph.top(df, n, F.desc("score"), F.asc("id"))
        if name == "pagerank":
            return best(self.ranks.select("id", F.round("score", 6).alias("score")))
        if name == "centrality":
            return best(self.centrality)
        if name == "complexity":
            return graph.largest(self.code.nodes.where("type <> 'module'"), n)
        if name == "coupling":
            return graph.coupling(self._file_edges(), n)
        if name == "hotspots":
            spans = self.code.nodes.groupBy(F.col("file_path").alias("path")).agg(F.sum(F.when(F.col("type") != "module", F.col("span")).otherwise(0)).alias("span"))
            return graph.top(history.hotspots(self._history(), spans), n, F.desc("score"), F.asc("path"))
        if name == "ownership":
            few = [r["id"] for r in self.metric("pagerank", n).collect()]
            return graph.top(history.main_owner(repository.blame(self.spark, self.root, few, self.limits)), n, F.desc("percentage"), F.asc("path"))
        if name == "summary":
            parts = [self.metric(m, 5).select(F.lit(m).alias("section"), "id", F.col("score").cast("double").alias("score"), "rank") for m in ("pagerank", "centrality", "complexity")]
            return parts[0].unionByName(parts[1]).unionByName(parts[2])
        raise ValueError(f"a metric is one of {', '.join(METRICS)}")

    # 6. Diagrams

    def visualize(self, kind: str = "architecture", scope: str | None = None, n: int = 15) -> str:
        """A Mermaid diagram; one that says so, if there is nothing to draw."""
        n = _clamp(n, 5, 25)
        nodes, edges = self.code.nodes, self.code.edges
        if kind == "architecture":
            return diagrams.architecture(nodes, edges, self.ranks, self.communities, self.names, n, scope)
        if kind in ("call_flow", "dependencies"):
            if not scope or not scope.strip():
                return diagrams.error(f"{kind} needs a name as its scope")
            start = diagrams.find(nodes, scope, "entity" if kind == "call_flow" else "module")
            if start is None:
                return diagrams.error(f"nothing is named {scope}")
            return diagrams.call_flow(nodes, edges, start, n) if kind == "call_flow" else diagrams.dependencies(nodes, edges, lambda: self.ranks, start, n)
        if kind == "layers":
            return diagrams.layers(nodes, edges, self.ranks, self.communities, self.names, n)
        if kind == "hotspot_map":
            return diagrams.hotspot_map(self.modules, edges, history.frequency(self._history()), self.ranks, n)
        raise ValueError(f"a diagram is one of {', '.join(diagrams.KINDS)}")

    # 7. History of a file

    def context(self, path: str, as_of: date | None = None, entity: str | None = None) -> dict:
        """The history of a file. Git knows no entities: one that is named changes nothing but the note in `source`."""
        path = repository.inside(self.root, path)
        if self.modules.where(F.col("file_path") == path).isEmpty():
            raise NotFound(f"{path} is not among the analysed files")
        own = repository.commits(self.spark, self.root, self.limits, path).where(F.col("path") == path)
        as_of = as_of or datetime.now(timezone.utc).date()
        pairs = history.co_changes(self._history(), of=[path])
        return {
            "frequency": sum(r["frequency"] for r in history.frequency(own).collect()),
            "age": next((r.asDict() for r in history.age(own, as_of).collect()), None),
            "commits": [r.asDict() for r in own.orderBy(F.desc("seq")).select(F.substring("sha", 1, 8).alias("sha"), F.date_format("ts", "yyyy-MM-dd").alias("day"), "author", "message").limit(10).collect()],
            "owners": [r.asDict() for r in history.ownership(repository.blame(self.spark, self.root, [path], self.limits)).orderBy(F.desc("lines"), "author").collect()],
            "co_changed": [r.asDict() for r in pairs.orderBy("rank").collect()],
            "source": f"git log, {self.limits.commits} newest commits" + ("; of the whole file, as history knows no entities" if entity else ""),
        }
