"""Rules that turn graph findings into issues, bands and layer names."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import graph
from lodestone.sources.scratch import scratch

SEVERITIES = ("high", "medium", "low")
ORDER = ("circular_dependency", "dead_code", "god_class", "bottleneck", "orphan_file", "high_coupling")
#: The layer that a directory's name stands for.
LAYERS = {
    "routes": "API Layer", "api": "API Layer", "endpoints": "API Layer", "views": "API Layer", "handlers": "API Layer",
    "services": "Service Layer", "business": "Service Layer", "logic": "Service Layer", "core": "Service Layer",
    "models": "Data/Model Layer", "schemas": "Data/Model Layer", "entities": "Data/Model Layer", "domain": "Data/Model Layer",
    "repositories": "Data Access Layer", "db": "Data Access Layer", "database": "Data Access Layer", "dal": "Data Access Layer", "store": "Data Access Layer",
    "utils": "Utility Layer", "helpers": "Utility Layer", "common": "Utility Layer", "shared": "Utility Layer", "lib": "Utility Layer",
    "tests": "Test Layer", "test": "Test Layer", "spec": "Test Layer", "config": "Configuration Layer", "settings": "Configuration Layer",
}


def bands(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """key, band by place: the first fifth is hot, up to half warm, up to four fifths mild, the rest cold."""
    n = df.agg(F.count("*").alias("n"))
    places = graph.placed(df, *order).join(F.broadcast(n))
    part = (F.col("place") + 1) / F.col("n")
    return places.select(key, F.when(part <= 0.2, "hot").when(part <= 0.5, "warm").when(part <= 0.8, "mild").otherwise("cold").alias("band"))


def dead_by_file(dead: DataFrame) -> DataFrame:
    own = dead.groupBy("file_path").agg(F.count("*").cast("long").alias("n"), F.array_sort(F.collect_list("name")).alias("names"))
    return own.select("file_path", "n", F.when(F.col("n") >= 3, "medium").otherwise("low").alias("severity"), F.array_join("names", ", ").alias("names"))


def orphans(files: DataFrame, shown: int = 10) -> DataFrame:
    """One row: the first files by name, how many more there are, and their number; none without orphans."""
    first = files.select("id").orderBy("id").limit(shown).agg(F.array_join(F.array_sort(F.collect_list("id")), ", ").alias("first"))
    n = files.agg(F.count("*").cast("long").alias("n"))
    more = F.when(F.col("n") > shown, F.concat(F.lit(", and "), (F.col("n") - shown).cast("string"), F.lit(" more"))).otherwise("")
    return first.join(F.broadcast(n)).where("n > 0").select(F.concat("first", more).alias("files"), "n")


def god_severity(gods: DataFrame) -> DataFrame:
    return gods.withColumn("severity", F.when(F.col("total") > 20, "high").otherwise("medium"))


def bottlenecks(scores: DataFrame, n: int = 5, over: float = 0.1) -> DataFrame:
    """Of the n nodes of highest betweenness those above a score."""
    best = scores.orderBy(F.desc("score"), "id").limit(n).where(F.col("score") > over)
    return best.withColumn("severity", F.when(F.col("score") > 0.3, "high").otherwise("medium"))


def high_coupling(pairs: DataFrame, over: int = 5) -> DataFrame:
    return pairs.where(F.col("score") > over).select("pair", "score", F.when(F.col("score") > 10, "high").otherwise("medium").alias("severity"))


#: What to do about an issue, by rule; of a cycle of two files, and of others.
ADVICE = {
    "circular_dependency": ("Move what both files need into a third one.", "Cut the cycle at one import, by an interface or a module of shared types."),
    "dead_code": "Look for reflection, framework hooks and callers outside the repository; remove it if there are none.",
    "god_class": "Split the class along its responsibilities.",
    "bottleneck": "See whether traffic really passes here; if so, divide the module or go through an abstraction.",
    "orphan_file": "Keep it if it is run by itself; otherwise it can go.",
    "high_coupling": "Put an interface or events between the two files.",
}
FOUND_BY = {"circular_dependency": "strong-components", "dead_code": "no-inbound-edge", "god_class": "degree", "bottleneck": "betweenness", "orphan_file": "no-inbound-import", "high_coupling": "edge-counts"}


def described(name: str, df: DataFrame) -> DataFrame:
    """Findings of a rule as issues: type, severity, subject, description, suggestion, files, entities, source.

    Findings, by rule: circular_dependency: path (array); dead_code: file_path, n, severity, names; god_class: cls, callers, dependencies, total, severity and, if
    known, file_path; bottleneck: id, score, severity; orphan_file: files, n and, if known, all; high_coupling: pair, score, severity."""
    none, text = F.array().cast("array<string>"), lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    c, has = F.col, set(df.columns)
    severity, entities, advice = c("severity") if "severity" in has else F.lit("high" if name == "circular_dependency" else "low"), none, F.lit(ADVICE[name] if isinstance(ADVICE[name], str) else "")
    if name == "circular_dependency":
        subject, files = F.array_join(F.array_append("path", c("path")[0]), " → "), c("path")
        say = text("Circular dependency: ", subject)
        advice = F.when(F.size("path") == 2, ADVICE[name][0]).otherwise(ADVICE[name][1])
    elif name == "dead_code":
        subject, files, entities = c("file_path"), F.array("file_path"), F.split("names", ", ")
        say = text(c("n"), " declaration(s) in ", subject, " that nothing seems to use: ", c("names"))
    elif name == "god_class":
        subject, entities = c("cls"), F.array("cls")
        files = F.array("file_path") if "file_path" in has else F.array(F.regexp_extract("cls", "^(.*?)(::|$)", 1))
        say = text("Class ", subject, " is used by ", c("callers"), " and uses ", c("dependencies"), " others (", c("total"), " together)")
    elif name == "bottleneck":
        subject, files = c("id"), F.array("id")
        say = text("Many paths lead through ", subject, ": betweenness ", F.format_number("score", 3))
    elif name == "orphan_file":
        subject, files = F.lit("orphans"), c("all") if "all" in has else F.split(F.regexp_replace("files", ", and [0-9]+ more$", ""), ", ")
        say = text(c("n"), " file(s) that no other file imports: ", c("files"))
    else:
        subject, files = c("pair"), F.split("pair", " <-> ")
        say = text(subject, " refer to each other ", c("score"), " times")
    return df.select(F.lit(name).alias("type"), severity.alias("severity"), subject.alias("subject"), say.alias("description"), advice.alias("suggestion"), files.alias("files"), entities.alias("entities"), F.lit(FOUND_BY[name]).alias("source"))


ISSUE = "type string, severity string, subject string, description string, suggestion string, files array<string>, entities array<string>, source string"


def detected(spark: SparkSession, rules: dict, most: int = 30) -> DataFrame:
    """The issues of all rules (name -> function that gives its findings), see ranked(). Each rule runs by itself, side by side with the others, so that one that
    fails gives an issue of low severity that says so, and the others theirs."""

    def run(rule) -> DataFrame:
        name, find = rule
        try:
            return scratch(described(name, find()), "issues")
        except Exception as e:  # whatever goes wrong in one rule
            what = str(e).strip().split("\n")[0][:300]
            row = (name, "low", name, f"{name} could not be looked for: {what}", "Analyse the repository again.", [], [], "rules")
            return spark.createDataFrame([row], ISSUE)

    with ThreadPoolExecutor(max(1, len(rules))) as pool:  # the rules' jobs share the cluster
        each = list(pool.map(run, rules.items()))
    return ranked(reduce(DataFrame.unionByName, each) if each else spark.createDataFrame([], ISSUE), most)


def ranked(found: DataFrame, most: int = 30) -> DataFrame:
    """found with its rank: by severity, then by rule, then by subject; the first `most`."""
    place = lambda c, names: F.array_position(F.array(*(F.lit(x) for x in names)), F.col(c))
    order = [place("severity", SEVERITIES), place("type", ORDER), F.col("subject")]
    return graph.top(found, most, *order)


def community_names(members: DataFrame) -> DataFrame:
    """community, name of those communities (community, path) whose members below a folder share one: the last known directory, else the innermost one as a title. Files
    in the root don't count; `src`, `app` and `lib` say nothing."""
    parts = members.select("community", F.filter(F.split(F.replace("path", F.lit("\\"), F.lit("/")), "/"), lambda p: p != "").alias("p"))
    parts = parts.where(F.size("p") > 1).select("community", F.slice("p", F.lit(1), F.size("p") - 1).alias("parts"))
    known, last = _shared(parts)
    title = F.initcap(F.regexp_replace(last, "[_-]", " "))
    name = F.when(F.size(known) > 0, F.element_at(known, -1)).when(~F.lower(title).isin("src", "app", "lib"), title)
    return _common(parts).select("community", name.alias("name")).where("name is not null")


def _common(parts: DataFrame) -> DataFrame:
    """community, shared: the directories that all its members begin with; none without any."""
    ends = parts.groupBy("community").agg(F.min("parts").alias("a"), F.max("parts").alias("b"))  # what the least and the greatest share, all share
    size = F.least(F.size("a"), F.size("b"))
    same = F.aggregate(F.sequence(F.lit(0), size - 1), F.lit(0), lambda n, i: F.when((n == i) & (F.col("a")[i] == F.col("b")[i]), n + 1).otherwise(n))
    return ends.withColumn("shared", F.slice("a", F.lit(1), same)).where(F.size("shared") > 0)


def _shared(parts: DataFrame) -> tuple[Column, Column]:
    """(the layers that the shared directories stand for, the innermost of them)."""
    names = F.create_map(*(F.lit(x) for kv in LAYERS.items() for x in kv))
    return F.filter(F.transform("shared", lambda p: names[F.lower(p)]), lambda x: x.isNotNull()), F.element_at("shared", -1)


def layers(members: DataFrame) -> DataFrame:
    """layer: names for communities (community, path), by the last known directory that all members share, else its title."""
    parts = members.select("community", F.slice(F.split("path", "/"), 1, F.greatest(F.size(F.split("path", "/")) - 1, F.lit(1))).alias("parts"))
    known, last = _shared(parts)
    title = F.initcap(F.replace(last, F.lit("_"), F.lit(" ")))
    return _common(parts).select(F.when(F.size(known) > 0, F.element_at(known, -1)).otherwise(title).alias("layer")).distinct()
