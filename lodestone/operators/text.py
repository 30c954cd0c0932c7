"""Rows out of text: lines, declarations and imports by rule, module aliases, and the cascade that resolves targets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that a diagram keeps for itself, and escapes in labels in the order they apply.
RESERVED = ("class", "classdef", "click", "direction", "end", "flowchart", "graph", "linkstyle", "style", "subgraph")
ESCAPES = (("&", "&amp;"), ("\\", "&#92;"), ('"', "&quot;"), ("<", "&lt;"), (">", "&gt;"))


def line_count(text: Column) -> Column:
    """Newlines and one."""
    return (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")


def lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, line_no (from 1), line."""
    return docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(F.col(text_col), "\n")).alias("k", "line")).select("id", (F.col("k") + 1).cast("long").alias("line_no"), "line")


def inventory(rows: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """rows (with a column line) that a rule matches, with its kind and what its first group captures, which is never empty. The first rule that
    matches wins; each is tried once."""
    hit = lambda k, pattern: F.transform(F.filter(F.array(F.regexp_extract("line", pattern, 1)), lambda x: x != ""), lambda x: F.struct(F.lit(k).alias("kind"), x.alias("name")))
    first = F.coalesce(*(F.get(hit(k, pattern), F.lit(0)) for k, pattern in rules))
    return rows.withColumn("__hit", first).where("__hit is not null").select(*(c for c in rows.columns if c != "line"), "__hit.kind", "__hit.name")


def links(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """id, target: the distinct non-empty targets of href attributes."""
    return pages.select(F.col(id_col).alias("id"), F.explode(F.array_distinct(F.regexp_extract_all(html_col, F.lit('href="([^"]*)"'), F.lit(1)))).alias("target")).where("target <> ''")


def aliases(files: DataFrame) -> DataFrame:
    """alias, file_path, exact, n_owners: the names by which a module may be imported.

    Path without suffix, with slashes and dots, and its stem; below src/ also without it, elsewhere also with it; of a
    package's __init__ also the package. exact marks the module's own path, not its stem or src forms."""
    path = F.regexp_replace("file_path", "\\.[^./]*$", "")
    dots = lambda c: F.replace(c, F.lit("/"), F.lit("."))
    stem = F.element_at(F.split(path, "/"), -1)
    inner, package = F.regexp_replace(path, "^src/", ""), F.regexp_replace(path, "/__init__$", "")
    is_src, is_package = path.startswith("src/"), path.endswith("/__init__")
    other = F.when(is_src, inner).otherwise(F.concat(F.lit("src/"), path))
    plain = [(path, True), (dots(path), True), (stem, False), (other, False), (dots(other), False), (F.when(is_package, package), True), (F.when(is_package, dots(package)), True)]
    each = files.select("file_path", F.explode(F.array(*(F.struct(a.alias("alias"), F.lit(e).alias("exact")) for a, e in plain))).alias("x"))
    own = each.select("file_path", "x.alias", "x.exact").where("alias is not null and alias <> ''").groupBy("alias", "file_path").agg(F.max("exact").alias("exact"))
    owners = own.groupBy("alias").agg(F.count("*").cast("long").alias("n_owners"))
    return own.join(owners, "alias")


def ends_with(targets: DataFrame, names: DataFrame) -> DataFrame:
    """targets (target) with every name (name) that ends with it.

    Not by comparing all with all: each name is cut to the lengths that targets have, which gives an equi-join."""
    sizes = targets.select(F.length("target").alias("size")).distinct()
    sizes = sizes.agg(F.array_sort(F.collect_set("size")).alias("sizes"))  # as many as there are lengths
    tails = names.join(F.broadcast(sizes)).select("name", F.explode(F.filter("sizes", lambda n: n <= F.length("name"))).alias("size"))
    tails = tails.select("name", F.substring("name", F.length("name") - F.col("size") + 1, F.col("size")).alias("target"))
    return targets.select("target").distinct().join(tails, "target")


def cascade(requests: DataFrame, stages: list[tuple[str, DataFrame]]) -> DataFrame:
    """request, target, status, owner: the first stage that has any owner decides: one owner resolves, several are ambiguous.

    requests: request, target. Stages in order: (status, DataFrame of target, owner)."""
    each = reduce(DataFrame.unionByName, [df.select("target", "owner", F.lit(k).alias("stage")).distinct() for k, (_, df) in enumerate(stages)])
    found = each.groupBy("target", "stage").agg(F.count("*").alias("n"), F.min("owner").alias("owner")).groupBy("target").agg(F.min(F.struct("stage", "n", "owner")).alias("x"))
    name = F.element_at(F.array(*(F.lit(s) for s, _ in stages)), F.col("x.stage") + 1)
    status = F.when(F.col("x").isNull(), "unresolved").when(F.col("x.n") > 1, "ambiguous").otherwise(name)
    return requests.join(found, "target", "left").select("request", "target", status.alias("status"), F.when(F.col("x.n") == 1, F.col("x.owner")).alias("owner"))


def diagram_id(text: Column) -> Column:
    """An identifier for a diagram: other characters as `_`, none at the ends, never empty, a reserved word or begun by a digit."""
    base = F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9_]", "_"), "^_+|_+$", "")
    base = F.when(base == "", F.lit("unknown")).otherwise(base)
    return F.when(base.rlike("^[0-9]") | F.lower(base).isin(*RESERVED), F.concat(F.lit("node_"), base)).otherwise(base)


def diagram_label(text: Column, longest: int = 30) -> Column:
    """A label cut to `longest` characters, with `...`; runs of control characters become a space, and what ends a quoted label is escaped."""
    cut = F.when(F.length(text) > longest, F.concat(F.substring(text, 1, longest - 3), F.lit("..."))).otherwise(text)
    cut = F.regexp_replace(cut, "[\\x00-\\x1f\\x7f]+", " ")
    for a, b in ESCAPES:
        cut = F.replace(cut, F.lit(a), F.lit(b))
    return cut
