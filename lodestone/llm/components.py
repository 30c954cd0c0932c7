"""Distributed connected components by alternating large and small stars.

First each task joins what is connected by its own edges, so few rounds are left. Every round is two aggregations (combined before the shuffle) and two equi-joins that adaptive execution can split
where a hub has very many edges; no node's neighbours are ever gathered into a row or a task. The edges of a round are
written to the shared scratch folder, so an executor lost later costs only that round. The driver sees whether a
round has left stars only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import forget, scratch


def _is_settled(edges: DataFrame) -> bool:
    """Whether the edges (u, v), v < u, are stars: each u has one v, and no v is a u. Then v is the least of its component."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    each = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return each.where("up > 1 or (up > 0 and down > 0)").limit(1).count() == 0


#: Edges that a task holds at most before it passes its stars on.
HELD = 1 << 20


def _stars(u, v):
    """The components of edges between numbers as stars: (each node but the least, the least)."""
    import numpy as np

    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    to = np.arange(len(nodes))
    while True:
        low = np.minimum(to[a], to[b])
        if (to[a] == low).all() and (to[b] == low).all():
            break
        for ends in (to[a], to[b]):
            np.minimum.at(to, ends, low)
        while (to[to] != to).any():
            to = to[to]
    out = np.flatnonzero(to != np.arange(len(nodes)))
    return nodes[out], nodes[to[out]]


def _joined(batches):
    """Edges (u, v) as stars of what a task's own edges connect; in parts, if these are more than HELD."""
    import numpy as np
    import pyarrow as pa

    def rows(u, v):
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    u = v = np.zeros(0, dtype=np.int64)
    for batch in batches:
        u, v = np.concatenate([u, batch.column(0).to_numpy()]), np.concatenate([v, batch.column(1).to_numpy()])
        if len(u) > HELD:
            u, v = _stars(u, v)
            if len(u) > HELD // 2:
                yield rows(u, v)
                u = v = u[:0]
    if len(u):
        yield rows(*_stars(u, v))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Columns node and component (the smallest node of its component), a row for each node with an edge to another.

    Edges with a null end and loops are left out; repeated edges count once; no edges give no rows. Raises if the
    rounds, logarithmic in the longest path for real graphs, don't end."""
    x, y = F.col(a), F.col(b)
    e = edges.select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).where(x.isNotNull() & y.isNotNull() & (x != y))
    e = scratch(e.distinct(), "edges")
    if dict(e.dtypes) == {"u": "bigint", "v": "bigint"}:
        e = scratch(e.mapInArrow(_joined, "u long, v long"), "edges")
    for _ in range(max_rounds):
        if _is_settled(e):
            break
        near = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = near.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("v"))
        rest = large.join(least.withColumnRenamed("v", "m"), "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        last = e
        e = scratch(least.unionByName(rest).where(F.col("u") != F.col("v")).distinct(), "edges")
        forget(last)
    else:
        raise RuntimeError(f"components did not settle within {max_rounds} rounds")
    out = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return out.unionByName(out.select(F.col("component").alias("node"), "component").distinct())
