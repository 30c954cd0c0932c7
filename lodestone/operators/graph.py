"""Edges, counts, projections and rankings of an attributed graph.

Nodes: id, type, file_path, name, span, source, seq. Edges: src, dst, type, count and any others. Every ranking is a
top-k over (score descending, then an explicit order), so that Spark keeps k rows a task and never sorts everything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.sources.scratch import scratch

#: Names that count as entry points, tried on a full name and its last segment.
ENTRY_POINTS = "^(main$|app$|cli$|__main__$|test_|conftest$|(get|post|put|delete|patch)(_|[A-Z]|$)|handle(_|[A-Z]|$)|on_|setup$|teardown$|index$|route_)"
#: Stems of files that nothing needs to import.
ROOT_STEMS = ("__init__", "main", "setup", "conftest")
#: Bands of a line span, and of a betweenness score.
SPANS = ((50, "very large"), (20, "large"))


def top(df: DataFrame, n: int, *order: Column, rank: str = "rank") -> DataFrame:
    """The first n rows by order, numbered from 1."""
    few = df.orderBy(*order).limit(n)
    return few.withColumn(rank, F.row_number().over(Window.orderBy(*order)).cast("long"))


def placed(df: DataFrame, *order: Column, place: str = "place") -> DataFrame:
    """df with its rows' places (from 0) in an order: sorted by ranges, numbered within each range, and moved by the sizes of those before.

    A window over everything would sort it in one task; here the only table that is broadcast has a row for each range."""
    ranges = scratch(df.orderBy(*order).withColumn("__range", F.spark_partition_id()), "ranges")
    sizes = ranges.groupBy("__range").agg(F.count("*").alias("__n"))
    before = sizes.select("__range", F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    within = ranges.withColumn("__at", F.row_number().over(Window.partitionBy("__range").orderBy(*order)) - 1)
    return within.join(F.broadcast(before), "__range").withColumn(place, F.col("__at") + F.col("__before")).drop("__range", "__at", "__before")


def accumulate(calls: DataFrame, keep: int = 20) -> DataFrame:
    """One edge for each (src, dst, type) of observed calls (src, dst, type, resolution, line, seq): how often, `exact` only if all are, and
    the first `keep` distinct lines in order of arrival."""
    lines = calls.groupBy("src", "dst", "type", "line").agg(F.min("seq").alias("seq"), F.count("*").alias("n"), F.min(F.when(F.col("resolution") == "exact", 1).otherwise(0)).alias("exact"))
    key = ["src", "dst", "type"]
    total = lines.groupBy(*key).agg(F.sum("n").alias("count"), F.min("exact").alias("exact"))
    first = lines.withColumn("r", F.row_number().over(Window.partitionBy(*key).orderBy("seq", "line"))).where(F.col("r") <= keep)
    first = first.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("seq", "line"))).alias("lines"))  # `keep` at most
    label = F.when(F.col("exact") == 1, "exact").otherwise("inferred")
    return total.join(first, key).select(*key, "count", label.alias("resolution"), F.transform("lines", lambda x: x["line"]).alias("source_lines"))


def known_callers(calls: DataFrame, nodes: DataFrame) -> DataFrame:
    """Calls whose caller is a node."""
    return calls.join(nodes.select(F.col("id").alias("src")), "src", "left_semi")


def counts_by(df: DataFrame, column: str, of: str | None = None, name: str = "n") -> DataFrame:
    """Rows, or the sum of a column, for each value of a column."""
    return df.groupBy(column).agg((F.sum(of) if of else F.count("*")).cast("long").alias(name))


def module_graph(edges: DataFrame, home: DataFrame) -> DataFrame:
    """Edges of nodes as edges of their files (home: id, file_path), without those within a file: import_count, call_count, weight and distance.

    An edge adds its count, 1 at least."""
    of = lambda side: home.select(F.col("id").alias(side), F.col("file_path").alias(f"{side}_file"))
    both = edges.join(of("src"), "src").join(of("dst"), "dst").where("src_file <> dst_file")
    n = F.greatest(F.coalesce("count", F.lit(1)), F.lit(1))
    found = both.groupBy(F.col("src_file").alias("src"), F.col("dst_file").alias("dst")).agg(
        F.sum(F.when(F.col("type") == "imports", n).otherwise(0)).cast("long").alias("import_count"), F.sum(F.when(F.col("type") == "calls", n).otherwise(0)).cast("long").alias("call_count")
    )
    weight = F.col("import_count") + F.col("call_count")
    return found.withColumn("weight", weight).withColumn("distance", F.lit(1.0) / weight)


def coupling(edges: DataFrame, n: int | None = 15) -> DataFrame:
    """pair (`a <-> b`, a before b), score: the counts of all edges between two files, either way; the n largest."""
    a, b = F.least("src", "dst"), F.greatest("src", "dst")
    pairs = edges.where("src <> dst").groupBy(a.alias("a"), b.alias("b")).agg(F.sum("count").cast("long").alias("score"))
    pairs = pairs.select(F.concat("a", F.lit(" <-> "), "b").alias("pair"), "score")
    return top(pairs, n, F.desc("score"), F.asc("pair")) if n else pairs


def band(score: Column, limits=SPANS, rest: str = "moderate") -> Column:
    out = F.lit(rest)
    for limit, name in reversed(limits):
        out = F.when(score > limit, name).otherwise(out)
    return out


def largest(nodes: DataFrame, n: int = 15) -> DataFrame:
    """The n nodes of the largest span, with its band."""
    return top(nodes.select("id", F.col("span").cast("long").alias("score")), n, F.desc("score"), F.asc("id")).withColumn("interpretation", band(F.col("score")))


def search(nodes: DataFrame, text: str, type_: str | None = None, limit: int = 20, longest: int = 120) -> DataFrame:
    """Nodes whose name or path has a literal text, whatever the case: exact names first, then names, then paths."""
    if len(text) > longest:
        raise ValueError(f"a search text has at most {longest} characters")
    q, name, path = text.lower(), F.lower("name"), F.lower("file_path")
    found = nodes.where(name.contains(q) | path.contains(q))
    if type_:
        found = found.where(F.col("type") == type_)
    found = found.withColumn("relevance", F.when(name == q, 0).when(name.contains(q), 1).otherwise(2).cast("long"))
    return found.orderBy("relevance", name, "file_path", "id").limit(max(1, min(limit, 20)))


def is_entry_point(name: Column) -> Column:
    return name.rlike(ENTRY_POINTS) | F.element_at(F.split(name, "\\."), -1).rlike(ENTRY_POINTS)


def dead(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Functions and classes, parsed and not just matched, that no edge enters and whose name is no entry point."""
    own = nodes.where(F.col("type").isin("function", "class") & (F.coalesce("source", F.lit("")) != "regex-fallback") & ~is_entry_point(F.col("name")))
    return own.join(edges.select(F.col("dst").alias("id")), "id", "left_anti")


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Modules that nothing imports, other than roots and entry points."""
    stem = F.regexp_extract("file_path", "([^/]*?)(\\.[^./]*)?$", 1)
    own = nodes.where((F.col("type") == "module") & (F.coalesce("source", F.lit("")) != "regex-fallback")).where(~stem.isin(*ROOT_STEMS) & ~is_entry_point(stem))
    return own.join(edges.where("type = 'imports'").select(F.col("dst").alias("id")), "id", "left_anti")


def god_classes(members: DataFrame, edges: DataFrame, over: int = 10) -> DataFrame:
    """Classes (members: cls, id) with more than `over` distinct nodes outside that call them or that they call."""
    inside = members.select(F.col("cls").alias("own"), F.col("id").alias("near"))
    calls = edges.select("src", "dst")
    callers = calls.join(members, calls.dst == members.id).select("cls", F.col("src").alias("near"), F.lit(1).alias("caller"))
    callees = calls.join(members, calls.src == members.id).select("cls", F.col("dst").alias("near"), F.lit(0).alias("caller"))
    near = callers.unionByName(callees).distinct()
    near = near.join(inside.withColumnRenamed("own", "cls"), ["cls", "near"], "left_anti")
    out = near.groupBy("cls").agg(F.sum("caller").cast("long").alias("callers"), F.sum(1 - F.col("caller")).cast("long").alias("dependencies"))
    return out.withColumn("total", F.col("callers") + F.col("dependencies")).where(F.col("total") > over)
