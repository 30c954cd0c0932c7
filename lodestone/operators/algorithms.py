"""Iterative graph algorithms as loops of joins and aggregations, and betweenness with sources dealt to tasks.

The lineage of a loop is cut in each round by a table in the shared checkpoint folder; nothing is collected but
counts and a walk's few steps. Betweenness and communities hold the graph in memory and refuse graphs above a stated bound."""

from __future__ import annotations

import random
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from lodestone.operators import graph
from lodestone.sources.scratch import forget, scratch

DAMPING, ROUNDS = 0.85, 100
#: Edges that are broadcast at most (about 64 MB).
BROADCAST_EDGES = 2_000_000


#: Rounds of a loop after which its lineage is cut by a table in the shared folder.
CUT = 5


@contextmanager
def _settings(spark: SparkSession, **values):
    """Settings of the session (dots as double underscores) that hold for a while."""
    keys = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS, tolerance: float | None = 1e-6) -> DataFrame:
    """id, score of nodes (id) by weighted edges (src, dst, weight), the mass of dead ends spread evenly.

    Ends after `rounds`, or when the scores change by less than tolerance a node in sum (tolerance None: never before). Edges are dealt by
    source once and stay so, and scores by the same rule in as many partitions, so a round shuffles only what nodes give, summed in each task."""
    spark = nodes.sparkSession
    n = nodes.count()
    if not n:
        return nodes.select("id", F.lit(0.0).alias("score"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    edges = scratch(edges.select("src", "dst", "weight"), "weighted")
    # adaptive execution would merge partitions in some rounds and not in others, so that scores and edges were dealt in different ways; a
    # round has nothing else for it to plan anew
    with _settings(spark, spark__sql__adaptive__enabled="false"):
        out = edges.groupBy("src").agg(F.sum("weight").alias("total"))
        share = edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("share"), F.lit(False).alias("own"), F.lit(False).alias("dead"))
        # each node also has an edge to itself that gives nothing but hands its score on, so that a round reads the scores once
        own = nodes.join(out.select(F.col("src").alias("id"), "total"), "id", "left").select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias("share"), F.lit(True).alias("own"), F.col("total").isNull().alias("dead"))
        share = scratch(share.unionByName(own), "share").repartition(parts, "src").cache()
        ranks, lost, held, kept = nodes.select("id", F.lit(1.0 / n).alias("score")).repartition(parts, "id"), share.where("dead").count() / n, [], None
        for k in range(1, rounds + 1):
            met = share.join(ranks.hint("shuffle_hash"), F.col("src") == F.col("id")).groupBy("dst").agg(F.sum(F.col("score") * F.col("share")).alias("given"), F.max(F.when(F.col("own"), F.col("score"))).alias("old"), F.max("dead").alias("dead"))
            new = met.where("old is not null").select(F.col("dst").alias("id"), ((1 - damping) / n + damping * (F.col("given") + lost / n)).alias("score"), "old", "dead")
            if k % CUT == 0:  # what came before is no longer read
                before, kept = kept, scratch(new, "ranks")
                for df in held:
                    df.unpersist()
                forget(before)
                new, held = kept.repartition(parts, "id"), []
            new = new.cache()
            moved, lost = new.agg(F.sum(F.abs(F.col("score") - F.col("old"))), F.coalesce(F.sum(F.when(F.col("dead"), F.col("score"))), F.lit(0.0))).first()
            ranks = new.select("id", "score")
            held.append(new)
            if tolerance is not None and moved < n * tolerance:
                break
        done = scratch(ranks, "ranks")
    for df in (*held, share):
        df.unpersist()
    forget(kept)
    forget(edges)
    return done


def betweenness(nodes: DataFrame, edges: DataFrame, exact: int = 250, samples: int = 100, seed: int = 0) -> DataFrame:
    """id, score: the part of shortest directed paths (by distance) through each node, normalised by (n - 1)(n - 2).

    Up to `exact` nodes every node is a source, else `samples` random ones, scaled up. Sources are dealt to tasks."""
    n = nodes.count()
    if edges.limit(BROADCAST_EDGES + 1).count() > BROADCAST_EDGES:
        raise ValueError(f"betweenness takes at most {BROADCAST_EDGES} edges")
    near: dict = {}
    for r in edges.select("src", "dst", "distance").orderBy("src", "dst").toLocalIterator():
        near.setdefault(r[0], []).append((r[1], r[2]))
    shared = edges.sparkSession.sparkContext.broadcast(near)
    ids = nodes.select("id").orderBy("id")
    if n > exact:
        chosen = random.Random(seed).sample(range(n), samples)
        ids = graph.placed(nodes.select("id"), F.col("id")).where(F.col("place").isin(chosen)).select("id")

    def brandes(batches):
        import heapq

        import pandas as pd

        for batch in batches:
            total: dict = {}
            for s in batch["id"]:
                dist, paths, before, order, queue = {}, {s: 1.0}, {s: []}, [], [(0.0, 0, s)]
                seen, k = {s: 0.0}, 1
                while queue:
                    d, _, v = heapq.heappop(queue)
                    if v in dist:
                        continue
                    dist[v] = d
                    order.append(v)
                    for w, length in shared.value.get(v, ()):
                        e = d + length
                        if w not in dist and (w not in seen or e < seen[w]):
                            seen[w] = e
                            heapq.heappush(queue, (e, k, w))
                            k += 1
                            paths[w], before[w] = paths[v], [v]
                        elif w not in dist and e == seen[w]:
                            paths[w] += paths[v]
                            before[w].append(v)
                owed: dict = {}
                for w in reversed(order):
                    for v in before[w]:
                        owed[v] = owed.get(v, 0.0) + paths[v] / paths[w] * (1 + owed.get(w, 0.0))
                    if w != s:
                        total[w] = total.get(w, 0.0) + owed.get(w, 0.0)
            if total:
                yield pd.DataFrame({"id": list(total), "part": list(total.values())})

    kind = nodes.schema["id"].dataType.simpleString()
    tasks = min(max(1, n if n <= exact else samples), 4 * edges.sparkSession.sparkContext.defaultParallelism)
    parts = ids.repartition(tasks).mapInPandas(brandes, f"id {kind}, part double").groupBy("id").agg(F.sum("part").alias("part"))
    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 0.0
    if n > exact:
        scale *= n / samples
    return nodes.select("id").join(parts, "id", "left").select("id", F.round(F.coalesce("part", F.lit(0.0)) * scale, 6).alias("score"))


def reach(edges: DataFrame, start, depth: int, direction: str = "forward") -> DataFrame:
    """node, depth: nodes that lead from (forward), to (backward) or either way (both) `start`, at their least depth of 1 to `depth`."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    near = {"forward": edges.select("src", "dst"), "backward": back, "both": edges.select("src", "dst").unionByName(back)}[direction].distinct()
    near = scratch(near, "near")
    first = near.where(F.col("src") == start).limit(1).select(F.lit(start).alias("node"), F.lit(0).cast("long").alias("depth"))
    seen, front = first, first
    for d in range(1, depth + 1):
        front = front.join(near, front.node == near.src).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti").select("node", F.lit(d).cast("long").alias("depth"))
        front = scratch(front, "front")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen.where("depth > 0")


def trace(edges: DataFrame, start, depth: int = 5, direction: str = "forward", steps: int = 15) -> tuple[DataFrame, bool]:
    """(the first `steps` steps of a breadth-first walk from start, whether there is more).

    Steps: place, depth, node, parent, and of the edge that was taken relationship, source, resolution and source_lines, as far as edges
    have them. Order: by the parent's place, edges out before edges in, then by node; a node is reached once. There is more if the
    steps ran out, or a node at the last depth has a neighbour that was not reached. Each depth joins the edges with the few nodes of the one before."""
    spark = edges.sparkSession
    has = set(edges.columns)
    label = [(F.col(c) if c in has else F.lit(None).cast(t)).alias(a) for c, a, t in (("type", "relationship", "string"), ("source", "source", "string"), ("resolution", "resolution", "string"), ("source_lines", "source_lines", "array<int>"))]
    out = edges.select(F.col("src").alias("parent"), F.col("dst").alias("node"), F.lit(0).alias("side"), *label)
    back = edges.select(F.col("dst").alias("parent"), F.col("src").alias("node"), F.lit(1).alias("side"), *label)
    near = {"forward": out, "backward": back, "both": out.unionByName(back)}[direction]
    kind = edges.schema["src"].dataType
    front, seen, found, more = [(start, 0)], [start], [], False
    table = lambda rows: F.broadcast(spark.createDataFrame(rows, StructType([StructField("parent", kind), StructField("p", LongType())])))  # noqa: E731  (`steps` rows at most)
    order = ["p", "side", "node", "relationship"]
    for d in range(1, depth + 1):
        if start is None:
            break
        best = near.where(~F.col("node").isin(seen)).join(table(front), "parent").groupBy("node").agg(F.min(F.struct(*order, "parent", "source", "resolution", "source_lines")).alias("e"))
        rows = best.select("e.*").orderBy(*order).limit(steps - len(found) + 1).collect()
        if len(found) + len(rows) >= steps:
            rows, more = rows[: steps - len(found)], True
        front = [(r["node"], len(found) + k) for k, r in enumerate(rows, 1)]
        found += [(p, d, r["node"], r["parent"], r["relationship"], r["source"], r["resolution"], r["source_lines"]) for (_, p), r in zip(front, rows, strict=True)]
        seen += [r["node"] for r in rows]
        if more or not rows:
            break
    else:
        more = bool(front) and start is not None and not near.where(~F.col("node").isin(seen)).join(table(front), "parent").isEmpty()
    columns = [StructField("place", LongType()), StructField("depth", LongType()), StructField("node", kind), StructField("parent", kind)]
    columns += [StructField(c, StringType()) for c in ("relationship", "source", "resolution")] + [StructField("source_lines", edges.schema["source_lines"].dataType if "source_lines" in has else ArrayType(IntegerType()))]
    return spark.createDataFrame(found, StructType(columns)), more


def strong_components(edges: DataFrame) -> DataFrame:
    """id, component (its least id) of the nodes of edges (src, dst) that lie on a cycle of two nodes or more.

    Again and again: nodes without edges in or out go; each other node gets the least id that reaches it; a node with its own id is the root
    of those that have its id and reach it. Every step is a join and an aggregation; only whether anything is left is asked."""
    left = scratch(edges.select("src", "dst").where("src <> dst").distinct(), "left")
    found = None

    def settled(make, first: DataFrame, name: str) -> DataFrame:
        """make(state) until it has as much as before; make gives (state, a number that ends to change)."""
        state, before = first, None
        while True:
            seen, made = Observation(), make(state)
            # counted as it is written
            new = scratch(made.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*made.columns).cast("decimal(20,0)")).alias("sum")), name)
            now = seen.get
            if state is not first:
                forget(state)
            if now == before:
                return new
            state, before = new, now

    def trimmed(e: DataFrame) -> DataFrame:
        ins, outs = e.select(F.col("dst").alias("src")).distinct(), e.select(F.col("src").alias("dst")).distinct()
        return e.join(ins, "src", "left_semi").join(outs, "dst", "left_semi").select("src", "dst")

    while True:
        left = settled(trimmed, left, "left")
        if left.isEmpty():
            break
        e = left

        def lower(state: DataFrame, e=e) -> DataFrame:
            come = e.join(state.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id"), "least")
            return state.unionByName(come).groupBy("id").agg(F.min("least").alias("least"))

        own = e.select(F.col("src").alias("id")).unionByName(e.select(F.col("dst").alias("id"))).distinct()
        least = settled(lower, own.select("id", F.col("id").alias("least")), "least")
        of = lambda side: least.select(F.col("id").alias(side), F.col("least").alias(f"{side}_least"))  # noqa: B023, E731
        inside = scratch(e.join(of("src"), "src").join(of("dst"), "dst").where("src_least = dst_least").select("src", "dst"), "inside")

        def reaching(state: DataFrame, inside=inside) -> DataFrame:
            more = inside.join(state.select(F.col("id").alias("dst")), "dst").select(F.col("src").alias("id"))
            return state.unionByName(more).distinct()

        back = settled(reaching, least.where("id = least").select("id"), "back")
        whole = scratch(least.join(back, "id").select("id", F.col("least").alias("component")), "whole")
        found = whole if found is None else found.unionByName(whole)
        gone = whole.select("id")
        left = scratch(left.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst"), "left")
    if found is None:
        kind = edges.schema["src"].dataType.simpleString()
        return edges.sparkSession.createDataFrame([], f"id {kind}, component {kind}")
    sizes = found.groupBy("component").agg(F.count("*").alias("n")).where("n > 1")
    return found.join(sizes.select("component"), "component", "left_semi").select("id", "component")


def _cycles_of(edges: list[tuple], longest: int, most: int):
    """Simple cycles of 2 to `longest` nodes as lists that begin with their least node, by length, then in order; `most` at most."""
    near: dict = {}
    into: dict = {}
    for a, b in sorted(set(edges)):
        near.setdefault(a, []).append(b)
        into.setdefault(b, []).append(a)
    homes = {}  # of each least node: how far each larger one is from it, going back
    for s in near:
        far, level = {s: 0}, [s]
        while level:
            level = sorted({p for v in level for p in into.get(v, ()) if p > s and p not in far})
            far |= dict.fromkeys(level, max(far.values()) + 1) if level else {}
        homes[s] = far
    found = []
    for length in range(2, longest + 1):
        for s in sorted(near):
            far, path = homes[s], [s]
            walks = [iter(near[s])]
            while walks:
                step = next(walks[-1], None)
                if step is None:
                    walks.pop()
                    path.pop()
                elif len(path) == length:
                    if step == s:
                        found.append(list(path))
                        if len(found) >= most:
                            return found
                elif step in far and step != s and far[step] <= length - len(path) and step not in path:
                    path.append(step)
                    walks.append(iter(near.get(step, ())))
    return found


def bounded_cycles(edges: DataFrame, longest: int = 10, most: int = 100, max_nodes: int = 100, max_edges: int = 500) -> tuple[DataFrame, DataFrame]:
    """(path, length: simple cycles of 2 to `longest` nodes, the shortest `most`; skipped: one row, how many components were not searched).

    Cycles lie within strong components. One of more than max_nodes nodes or max_edges edges may have more cycles than could ever be listed; it
    is skipped and counted. Each other is searched in one task, which has max_edges rows at most and stops after `most` cycles. A path begins with its least node."""
    parts = scratch(strong_components(edges), "components")
    of = lambda side: parts.select(F.col("id").alias(side), F.col("component").alias(f"{side}_of"))
    inside = edges.select("src", "dst").where("src <> dst").distinct().join(of("src"), "src").join(of("dst"), "dst").where("src_of = dst_of")
    inside = scratch(inside.select(F.col("src_of").alias("component"), "src", "dst"), "inside")
    sizes = parts.groupBy("component").agg(F.count("*").alias("n")).join(inside.groupBy("component").agg(F.count("*").alias("m")), "component")
    sizes = scratch(sizes.select("component", ((F.col("n") <= max_nodes) & (F.col("m") <= max_edges)).alias("small")), "sizes")
    kind = edges.schema["src"].dataType.simpleString()

    def search(rows):
        import pandas as pd

        return pd.DataFrame({"path": (paths := _cycles_of(list(zip(rows["src"].tolist(), rows["dst"].tolist(), strict=True)), longest, most)), "length": [len(p) for p in paths]}, columns=["path", "length"])

    few = inside.join(sizes.where("small").select("component"), "component", "left_semi")
    found = few.groupBy("component").applyInPandas(search, f"path array<{kind}>, length long")
    skipped = sizes.where("not small").agg(F.count("*").cast("long").alias("skipped"))
    return scratch(found.orderBy("length", "path").limit(most), "cycles").orderBy("length", "path"), scratch(skipped, "skipped")


def cycles(edges: DataFrame, longest: int = 10, most: int = 100, max_nodes: int = 100, max_edges: int = 500) -> DataFrame:
    """path, length of bounded_cycles()."""
    return bounded_cycles(edges, longest, most, max_nodes, max_edges)[0]


def louvain(nodes: list, weights: dict, seed: int = 0) -> dict:
    """node -> community by Louvain's method: nodes move where modularity gains most, then communities become nodes, until nothing gains.

    weights: (a, b) -> weight of an undirected graph, each pair once; (a, a) is a loop."""
    home = {n: n for n in nodes}
    while True:
        near: dict = {n: {} for n in nodes}
        degree = dict.fromkeys(nodes, 0.0)
        for (a, b), w in weights.items():
            degree[a] += w
            degree[b] += w
            if a != b:
                near[a][b] = near[a].get(b, 0.0) + w
                near[b][a] = near[b].get(a, 0.0) + w
        total = sum(degree.values())
        if not total:
            return home
        own, sums = {n: n for n in nodes}, dict(degree)
        order, moved, changed = list(nodes), True, False
        random.Random(seed).shuffle(order)
        while moved:
            moved = False
            for n in order:
                to: dict = {}
                for m, w in near[n].items():
                    to[own[m]] = to.get(own[m], 0.0) + w
                sums[own[n]] -= degree[n]
                gain = lambda c, n=n, to=to: to.get(c, 0.0) - degree[n] * sums[c] / total  # noqa: B023, E731
                best = max(to, key=gain, default=own[n])
                if gain(best) > gain(own[n]) + 1e-12:
                    own[n], moved, changed = best, True, True
                sums[own[n]] += degree[n]
        if not changed:
            return home
        home = {n: own[c] for n, c in home.items()}
        merged: dict = {}
        for (a, b), w in weights.items():
            pair = tuple(sorted((own[a], own[b]), key=str))
            merged[pair] = merged.get(pair, 0.0) + w
        weights, nodes = merged, sorted(set(own.values()), key=str)


def communities(nodes: DataFrame, edges: DataFrame, seed: int = 0, most: int = 2_000_000) -> DataFrame:
    """id, community (the least id in it) of the undirected graph (src, dst, weight), by Louvain's method.

    The graph is held on the driver, so one of more than `most` nodes and edges together is refused; propagated() is another method, for any size."""
    spark = nodes.sparkSession
    if nodes.limit(most + 1).count() + edges.limit(most + 1).count() > most:
        raise ValueError(f"communities takes at most {most} nodes and edges; use propagated()")
    weights: dict = {}
    for a, b, w in edges.select("src", "dst", "weight").orderBy("src", "dst").toLocalIterator():
        pair = (min(a, b), max(a, b))
        weights[pair] = weights.get(pair, 0.0) + w
    home = louvain([r[0] for r in nodes.select("id").orderBy("id").toLocalIterator()], weights, seed)
    least: dict = {}
    for n, c in home.items():
        least[c] = min(n, least.get(c, n))
    kind = nodes.schema["id"].dataType.simpleString()
    return spark.createDataFrame([(n, least[c]) for n, c in home.items()], f"id {kind}, community {kind}")


def propagated(nodes: DataFrame, edges: DataFrame, rounds: int = 20, seed: int = 0) -> DataFrame:
    """id, community (the least id in it): label propagation by weight over the undirected graph, ties to the least label.

    Every other node, by a seeded hash, moves in each round, so that labels do not swing."""
    both = edges.select("src", "dst", "weight").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")).where("src <> dst")
    both = scratch(both.groupBy("src", "dst").agg(F.sum("weight").alias("weight")), "both")
    labels, still = scratch(nodes.select("id", F.col("id").alias("label")), "labels"), 0
    for k in range(rounds):
        votes = both.join(labels.select(F.col("id").alias("dst"), "label"), "dst").groupBy("src", "label").agg(F.sum("weight").alias("w"))
        best = votes.groupBy("src").agg(F.min_by("label", F.struct(-F.col("w"), "label")).alias("best"))
        moves = F.pmod(F.xxhash64("id", F.lit(seed + k // 2)), F.lit(2)) == k % 2
        new = labels.join(best, labels.id == best.src, "left").select("id", F.when(moves, F.coalesce("best", "label")).otherwise(F.col("label")).alias("label"), F.col("label").alias("old"))
        new = scratch(new, "labels")
        labels = new.drop("old")
        still = still + 1 if new.where("label <> old").isEmpty() else 0
        if still == 2:  # neither half moves
            break
    least = labels.groupBy("label").agg(F.min("id").alias("community"))
    return labels.join(least, "label").select("id", "community")
