"""Parsed files to an attributed graph: nodes, import and call edges, and how much of it is resolved.

Both resolutions are cascades: requests go through stages in order; the first stage with any candidate decides, and it
resolves only if that candidate is the only one. Nothing is guessed: other requests count as ambiguous or unresolved."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators import graph, text
from lodestone.sources.scratch import scratch


@dataclass(frozen=True)
class CodeGraph:
    """nodes: id, type, file_path, name, span, line_start, line_end, signature, source, seq. edges: src, dst, type, count, source,
    resolution, source_lines. coverage: one row of counters. files: a row for each file that was parsed, without its lists."""

    files: DataFrame
    nodes: DataFrame
    edges: DataFrame
    coverage: DataFrame


def nodes_of(parts: DataFrame) -> DataFrame:
    """Modules and entities of parsed files. Of entities with the same id the later one's attributes count."""
    modules = parts.where("part = 0").select(
        F.col("file_path").alias("id"), F.lit("module").alias("type"), "file_path", F.regexp_extract("file_path", "([^/]*?)(\\.[^./]*)?$", 1).alias("name"), F.col("n_lines").alias("span"),
        F.lit(1).alias("line_start"), F.col("n_lines").alias("line_end"), F.lit(None).cast("string").alias("signature"), F.when(F.col("parse_method") == "tree", "tree").otherwise("regex-fallback").alias("source"), F.lit(-1).alias("seq"),
    )
    each = parts.select("file_path", "before", F.posexplode("entities").alias("at", "e"))
    each = each.withColumn("seq", F.col("at") + F.when(F.col("e.type") == "class", F.col("before.classes")).otherwise(F.col("before.functions")))
    each = each.select(
        F.concat_ws("::", "file_path", "e.name").alias("id"), "e.type", "file_path", "e.name", F.col("e.complexity").alias("span"), "e.line_start", "e.line_end", "e.signature", "e.source", "seq",
    )
    last = each.groupBy("id").agg(F.max_by(F.struct(*[c for c in each.columns if c != "id"]), "seq").alias("e"))
    return modules.unionByName(last.select("id", "e.*"))


def _parents(path: Column, up: Column) -> Column:
    parts = F.split(path, "/")
    keep = F.greatest(F.size(parts) - 1 - up, F.lit(0))
    return F.slice(parts, F.lit(1), keep)


def _candidates(target: Column, source: Column) -> Column:
    """The names that a target may go by, in order."""
    up = F.size(F.regexp_extract_all(F.regexp_extract(target, "^(\\.\\./)*", 0), F.lit("\\.\\./"), F.lit(0)))
    rest = F.regexp_replace(F.regexp_replace(target, "^(\\.\\./)+", ""), "^\\./", "")
    script = F.when(target.rlike("^\\.\\.?/"), F.concat_ws("/", _parents(source, up), rest))
    dots = F.length(F.regexp_extract(target, "^\\.*", 0))
    tail = F.regexp_replace(F.regexp_replace(target, "^\\.+", ""), "^/+", "")
    relative = F.when((dots > 0) & (tail != ""), F.concat_ws("/", _parents(source, F.greatest(dots - 1, F.lit(0))), tail))
    base = F.filter(F.transform(F.array(script, relative, tail), lambda c: F.regexp_replace(c, "^/+|/+$", "")), lambda c: c.isNotNull() & (c != ""))

    def forms(c):
        bare = F.regexp_replace(c, "\\.[^./]*$", "")
        return F.array(c, bare, F.replace(bare, F.lit("."), F.lit("/")), F.replace(bare, F.lit("/"), F.lit(".")))

    return F.flatten(F.transform(base, forms))


def modules_named(requests: DataFrame, files: DataFrame) -> DataFrame:
    """requests (source, target) with status (resolved, ambiguous, external), owner and exact."""
    known = scratch(text.aliases(files.select("file_path")), "aliases")
    clean = F.replace(F.regexp_replace(F.trim("target"), "^[\"']+|[\"']+$", ""), F.lit("\\"), F.lit("/"))
    asked = requests.select("source", "target").distinct().withColumn("raw", clean).where("raw <> ''")
    tries = asked.select("source", "target", F.posexplode(_candidates(F.col("raw"), F.col("source"))).alias("stage", "alias"))
    hits = tries.join(known, "alias").groupBy("source", "target", "stage").agg(F.count_distinct("file_path").alias("n"), F.min("file_path").alias("owner"), F.max("exact").alias("exact"))
    first = hits.groupBy("source", "target").agg(F.min_by(F.struct("n", "owner", "exact"), "stage").alias("x"))
    rest = asked.join(first, ["source", "target"], "left_anti")
    tail = F.regexp_replace(F.replace(F.regexp_replace(F.regexp_replace("raw", "^\\.+", ""), "^/+", ""), F.lit("/"), F.lit(".")), "^\\.+|\\.+$", "")
    rest = rest.select("source", F.col("target").alias("asked"), tail.alias("target")).where("target <> ''")
    names = known.select(F.replace("alias", F.lit("/"), F.lit(".")).alias("name"), "file_path").distinct()
    ends = text.ends_with(rest, names.select("name").distinct()).join(names, "name")
    loose = rest.join(ends, "target").groupBy("source", F.col("asked").alias("target")).agg(F.count_distinct("file_path").alias("n"), F.min("file_path").alias("owner"))
    both = first.select("source", "target", "x.*").unionByName(loose.withColumn("exact", F.lit(False)))
    status = F.when(F.col("n").isNull(), "external").when(F.col("n") > 1, "ambiguous").otherwise("resolved")
    found = requests.select("source", "target").distinct().join(both, ["source", "target"], "left")
    return found.select("source", "target", status.alias("status"), F.when(F.col("n") == 1, F.col("owner")).alias("owner"), F.coalesce("exact", F.lit(False)).alias("exact"))


def build(parsed: DataFrame) -> CodeGraph:
    """The graph of parsed files (see PARSED in lodestone.sources.repository)."""
    parts = scratch(parsed.where("language is not null"), "parts")
    files = parts.where("part = 0").select("file_path", "language", "n_lines", "parse_method", "recovered", "warning")
    nodes = scratch(nodes_of(parts), "nodes")

    # Imports: the target, and of from-imports each name as a child module.
    each = parts.select(F.col("file_path").alias("source"), "parse_method", "before", F.posexplode("imports").alias("at", "i"))
    each = each.select("source", "parse_method", (F.col("before.imports") + F.col("at")).alias("at"), "i.*")
    locals_ = F.when(F.size("local_names") > 0, F.col("local_names")).otherwise(F.col("imported_names"))
    pairs = F.when(F.col("is_from"), F.transform("imported_names", lambda n, k: F.struct(n.alias("name"), F.coalesce(F.try_element_at(locals_, k + 1), n).alias("local"))))
    pairs = pairs.otherwise(F.when(F.size(locals_) > 0, F.array(F.struct(F.col("target_module").alias("name"), locals_[0].alias("local")))).otherwise(F.array().cast("array<struct<name:string,local:string>>")))
    each = scratch(each.withColumn("pairs", pairs), "imports")
    named = each.select("source", "parse_method", "at", "target_module", "is_from", F.explode("pairs").alias("p")).select("source", "parse_method", "at", "target_module", "is_from", "p.*").where("name <> '' and name <> '*'")
    trimmed = F.trim("target_module")
    child = F.when(trimmed == "", F.col("name")).when(trimmed.rlike("^\\.+$"), F.concat(trimmed, "name")).otherwise(F.concat(F.regexp_replace(trimmed, "\\.+$", ""), F.lit("."), "name"))
    named = named.withColumn("child", F.when(F.col("is_from"), child))
    asked = each.select("source", F.col("target_module").alias("target")).unionByName(named.where("child is not null").select("source", F.col("child").alias("target")))
    answers = scratch(modules_named(asked, files), "answers")
    good = answers.where("status = 'resolved'").select("source", "target", "owner", "exact")
    direct = each.join(good.withColumnRenamed("target", "target_module"), ["source", "target_module"]).select("source", "parse_method", "at", "owner", "exact")
    children = named.join(good.withColumnRenamed("target", "child"), ["source", "child"])
    to = direct.unionByName(children.select("source", "parse_method", "at", "owner", "exact")).groupBy("source", "parse_method", "at", "owner").agg(F.min("exact").alias("exact"))
    label = lambda exact: F.when(exact, "exact").otherwise("inferred")
    provenance = F.when(F.col("parse_method") == "tree", "tree").otherwise("regex-fallback")
    imports = to.groupBy(F.col("source").alias("src"), F.col("owner").alias("dst"), provenance.alias("source")).agg(F.count("*").alias("count"), label(F.min("exact")).alias("resolution"))
    imports = imports.select("src", "dst", F.lit("imports").alias("type"), "count", "source", "resolution", F.array().cast("array<int>").alias("source_lines"))

    whole = named.join(good.withColumnRenamed("target", "target_module"), ["source", "target_module"]).select("source", "local", "owner", F.when(F.col("is_from"), F.col("name")).alias("exported"), "exact")
    bindings = whole.unionByName(children.select("source", "local", "owner", F.lit(None).cast("string").alias("exported"), "exact")).where("trim(local) <> ''").distinct()

    # Calls: the lexical scope, then the file, then what imports bind. All but the scope depends on the file and on what is called, so it is
    # looked up once for each such request, and only calls with an answer are dealt out with their lines.
    calls = parts.select(F.col("file_path").alias("source"), "before", F.posexplode("calls").alias("at", "c"))
    calls = calls.select("source", (F.col("before.calls") + F.col("at") + 1).alias("seq"), "c.caller", "c.callee", F.coalesce("c.callee_path", "c.callee").alias("full"), "c.line")
    functions = nodes.where("type <> 'module'").select("id", "type", "file_path", "name", F.element_at(F.split("name", "\\."), -1).alias("last"))
    path, request = F.filter(F.split("full", "\\."), lambda p: p != ""), ["source", "callee", "full"]
    asked = scratch(calls.select(*request).distinct(), "requests").withColumn("path", path).withColumn("own", (F.size("path") <= 1) | F.element_at("path", 1).isin("self", "cls", "this"))
    local = asked.where("own")
    in_file = functions.select(F.col("file_path").alias("source"), "name", "last", "id")
    stage = lambda df, k, exact: df.select(*request, F.lit(k).alias("stage"), "id", exact.alias("exact"))
    found = [stage(local.join(in_file.withColumnRenamed("name", "callee"), ["source", "callee"]), 1, F.lit(True))]
    found.append(stage(local.join(in_file.withColumnRenamed("last", "callee"), ["source", "callee"]).where("name <> callee"), 2, F.lit(False)))
    bound = asked.withColumn("local", F.element_at("path", 1)).where("size(path) > 0").join(bindings, ["source", "local"])
    single = F.size("path") <= 1
    bound = bound.where(F.when(single, F.col("exported").isNotNull()).otherwise(F.col("exported").isNull())).withColumn("name", F.when(single, F.col("exported")).otherwise(F.element_at("path", -1)))
    bound = bound.join(functions.select(F.col("file_path").alias("owner"), "name", "id"), ["owner", "name"])
    found.append(stage(bound, 3, F.col("exact")))
    every = reduce(DataFrame.unionByName, found).groupBy(*request, "stage", "id").agg(F.min("exact").alias("exact"))
    decided = every.groupBy(*request, "stage").agg(F.count("*").alias("n"), F.min("id").alias("dst"), F.min("exact").alias("exact")).groupBy(*request).agg(F.min_by(F.struct("n", "dst", "exact"), "stage").alias("x"))
    # Scopes: what is defined within a function of the file, by that function's name and the rest of its own.
    names = F.split("name", "\\.")
    cuts = in_file.where("name <> last").select("source", "id", names.alias("names"), F.explode(F.sequence(F.lit(1), F.size(names) - 1)).alias("depth"))
    cuts = cuts.select("source", "id", "depth", F.array_join(F.slice("names", F.lit(1), F.col("depth")), ".").alias("prefix"), F.array_join(F.slice("names", F.col("depth") + 1, F.size("names")), ".").alias("callee"))
    parents = functions.where("type = 'function'").select(F.col("file_path").alias("source"), F.col("name").alias("prefix"))
    scopes = cuts.join(parents, ["source", "prefix"]).groupBy("source", "callee").agg(F.collect_list(F.struct("depth", "id", "prefix")).alias("scopes"))
    scoped = local.join(scopes, ["source", "callee"]).select(*request, "scopes")
    known = scratch(decided.join(scoped, request, "full"), "answers")
    around = F.filter("scopes", lambda s: (F.col("caller") == s["prefix"]) | F.startswith("caller", F.concat(s["prefix"], F.lit("."))))
    innermost = F.array_max(F.transform(around, lambda s: F.struct(s["depth"].alias("depth"), s["id"].alias("id"))))["id"]
    taken = F.when(innermost.isNotNull(), F.struct(F.lit(1).cast("long").alias("n"), innermost.alias("dst"), F.lit(True).alias("exact"))).otherwise(F.col("x"))
    met = calls.join(known, request).select(F.concat_ws("::", "source", "caller").alias("src"), "seq", "line", taken.alias("x")).where("x is not null")
    resolved = scratch(met.select("src", "seq", "line", "x.*"), "resolved")
    observed = resolved.where("n = 1").select("src", "dst", F.lit("calls").alias("type"), label(F.col("exact")).alias("resolution"), "line", "seq")
    call_edges = graph.accumulate(observed).withColumn("source", F.lit("tree")).select("src", "dst", "type", "count", "source", "resolution", "source_lines")
    edges = scratch(imports.unionByName(call_edges), "edges")

    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0).cast("long"))
    covered = resolved.agg(count(F.col("n") == 1).alias("calls_resolved"), count(F.col("n") > 1).alias("calls_ambiguous"))
    of_calls = parts.agg(count(F.size("calls")).alias("calls_observed"))
    rest = F.col("calls_observed") - F.col("calls_resolved") - F.col("calls_ambiguous")
    covered = covered.join(F.broadcast(of_calls)).select("calls_observed", "calls_resolved", rest.alias("calls_unresolved"), "calls_ambiguous")
    of_files = files.agg(F.count("*").alias("files"), count(F.col("parse_method") == "tree").alias("tree_files"), count(F.col("parse_method") != "tree").alias("line_files"), count(F.col("recovered")).alias("recovered_files"))
    of_imports = answers.agg(count(F.col("status") == "ambiguous").alias("imports_ambiguous"))
    coverage = covered.join(F.broadcast(of_files)).join(F.broadcast(of_imports))  # one row each
    return CodeGraph(files, nodes, edges, coverage)
