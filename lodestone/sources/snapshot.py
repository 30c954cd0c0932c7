"""A graph kept as Parquet, keyed by the commit it was made of and the version of its form, in any folder that Spark writes to."""

from __future__ import annotations

import json
from dataclasses import fields

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lodestone.plans.codegraph import CodeGraph
from lodestone.sources.scratch import is_local

VERSION = 2


def _place(spark: SparkSession, folder: str, commit: str) -> str:
    """The folder of a commit's graph. A path without a scheme is a local one on a local master, and on a cluster one of its default file system."""
    if "://" not in folder and not folder.startswith("file:") and is_local(spark):
        folder = f"file://{folder}"
    return f"{folder.rstrip('/')}/v{VERSION}/{commit}"


def save(graph: CodeGraph, folder: str, commit: str | None) -> bool:
    """Write the graph below folder; not without a commit. The mark is written last, so a broken write is never read."""
    if not commit:
        return False
    spark = graph.nodes.sparkSession
    to = _place(spark, folder, commit)
    mark = f"{to}/done"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(mark)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    for f in fields(graph):
        getattr(graph, f.name).write.mode("overwrite").parquet(f"{to}/{f.name}")
    spark.createDataFrame([(json.dumps({"version": VERSION, "commit": commit}),)], "value string").coalesce(1).write.mode("overwrite").text(mark)
    return True


def load(spark: SparkSession, folder: str, commit: str | None) -> CodeGraph | None:
    """The graph of a commit, None if there is none of this version or its edges lead nowhere."""
    if not commit:
        return None
    to = _place(spark, folder, commit)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{to}/done")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    try:
        mark = json.loads("".join(r["value"] for r in spark.read.text(f"{to}/done").collect()))  # one line
    except ValueError:
        return None
    if mark.get("version") != VERSION or mark.get("commit") != commit:
        return None
    graph = CodeGraph(*(spark.read.parquet(f"{to}/{f.name}") for f in fields(CodeGraph)))
    ends = graph.edges.select(F.explode(F.array("src", "dst")).alias("id"))
    return graph if ends.join(graph.nodes.select("id"), "id", "left_anti").isEmpty() else None
