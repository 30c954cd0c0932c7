"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

1. Each source has a target: a share of the budget by its weight, at most `cap` times its size; what is above is
   reshared by weight until nothing is (water-filling over the sources).
2. The targets are turned into whole blocks of equal tokens: the highest quotients target / (2k + 1) get a block each,
   found as the rounded multiples of one divisor and not block by block.
3. A source is dealt by a seeded hash of its documents into shards of bounded size, and its blocks are apportioned
   again to its shards by their sizes, which gives a whole quota for each shard.
4. In a shard the documents stand in seeded order and their tokens form its blocks. With quota q of n blocks every block is
   taken floor(q / n) times and q mod n consecutive ones, from a seeded place on, once more.

A hot source only has more shards. Sources are a table, however many there are: the water level is found by sums over it, and the blocks by one
divisor for which rounding gives just too few, and a sorted choice of the quotients next in line. The driver sees single numbers; only the shards of one
source, at most about MAX_SHARDS in all, come together in a task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import n_words, scratch
from lodestone.operators import graph

#: Tokens in a shard at least, and shards at most (besides one for each source): a shard is as large as these need.
SHARD_TOKENS = 1 << 19
MAX_SHARDS = 1 << 16
#: Tokens in a block at most.
BLOCK = 256


def targets(sizes: list[float], weights: list[float], budget: float, cap: float = 2.0) -> list[float]:
    """Shares of the budget by weight, each at most cap times its size; what is above is reshared among the others."""
    out, free, left = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0], float(budget)
    while free:
        unit = left / sum(weights[i] for i in free)
        full = [i for i in free if unit * weights[i] > cap * sizes[i]]
        if not full:
            for i in free:
                out[i] = unit * weights[i]
            break
        for i in full:
            out[i] = cap * sizes[i]
            left -= out[i]
        free = [i for i in free if i not in set(full)]
    return out


def sainte_lague(votes: list[float], seats: int, most: list[int] | None = None) -> list[int]:
    """Seats by the highest quotients votes / 1, / 3, / 5 ...; ties go to the earlier one; none gets more than `most`.

    A divisor is sought by bisection at which rounding votes / divisor gives just fewer seats than wanted; the last few
    go by their quotients."""
    n = len(votes)
    most = most or [seats] * n
    seats = min(seats, sum(m for v, m in zip(votes, most, strict=True) if v > 0))
    if seats <= 0:
        return [0] * n

    def at(divisor: float) -> list[int]:
        # the k-th seat has the quotient votes / (2k - 1): so many of them are above 1 / divisor
        return [min(m, max(0, math.floor((v * divisor + 1) / 2))) for v, m in zip(votes, most, strict=True)]

    lo, hi = 0.0, 1.0 / max(votes)
    while sum(at(hi)) < seats:
        lo, hi = hi, hi * 2
    for _ in range(200):
        mid = (lo + hi) / 2
        if not lo < mid < hi:
            break
        lo, hi = (mid, hi) if sum(at(mid)) < seats else (lo, mid)
    out = at(lo)
    import heapq

    heap = [(-v / (2 * s + 1), i) for i, (v, s, m) in enumerate(zip(votes, out, most, strict=True)) if v > 0 and s < m]
    heapq.heapify(heap)
    for _ in range(seats - sum(out)):
        _, i = heapq.heappop(heap)
        out[i] += 1
        if out[i] < most[i]:
            heapq.heappush(heap, (-votes[i] / (2 * out[i] + 1), i))
    return out


def _first(row, default=0.0):
    return [default if x is None else x for x in row]


def source_targets(per: DataFrame, weights: tuple[float, ...], budget: float, cap: float) -> DataFrame:
    """per (_source, n) with k (its place by code point, null last) and target; see targets()."""
    placed = graph.placed(per, F.col("_source").isNull(), F.col("_source"), place="k")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("k") % len(weights) + 1).cast("int"))
    placed = scratch(placed.withColumn("w", weight), "sources")
    total, all_w = _first(placed.where("n > 0").agg(F.sum("n"), F.sum("w")).first())
    left, unit = float(budget) * total, 0.0
    level = left / all_w if all_w else 0.0
    while level > unit:  # it only rises, as each round more sources are full
        unit = level
        full = F.lit(unit) * F.col("w") > cap * F.col("n")
        taken, free = _first(placed.where("n > 0").agg(F.sum(F.when(full, cap * F.col("n"))), F.sum(F.when(~full, F.col("w")))).first())
        level = (left - taken) / free if free else unit
    return placed.select("_source", "n", "k", F.when(F.col("n") > 0, F.least(F.lit(unit) * F.col("w"), cap * F.col("n"))).otherwise(F.lit(0.0)).cast("double").alias("target"))


def source_quotas(sources: DataFrame, seats: int, most: Column) -> DataFrame:
    """sources (k, target) with quota: see sainte_lague(); most: what a source gets at most."""
    sources = scratch(sources.withColumn("_most", F.when(F.col("target") > 0, most).otherwise(0).cast("long")), "seats")
    votes, n, room = _first(sources.where("_most > 0").agg(F.sum("target"), F.count("*"), F.sum("_most")).first())
    seats = min(seats, int(room))
    # rounding by this divisor gives n / 2 seats too many at most, and n too few
    divisor = votes / (seats - n / 2) if seats > n / 2 else None
    begun = F.least(F.floor(F.col("target") / divisor + 0.5), F.col("_most")).cast("long") if divisor else F.lit(0).cast("long")
    sources = sources.withColumn("quota", begun)
    while True:
        sources = scratch(sources, "seats")
        missing = seats - int(_first(sources.agg(F.sum("quota")).first())[0])
        if missing <= 0:
            return sources.drop("_most")
        # as many of the next quotients of each as it can win now, and then the highest of all
        more = F.least(F.col("_most") - F.col("quota"), F.ceil(2 * missing * F.col("target") / votes).cast("long") + 2)
        tries = sources.where("quota < _most").select("k", "target", F.explode(F.sequence(F.col("quota"), F.col("quota") + more - 1)).alias("s"))
        tries = graph.placed(tries.select("k", (F.col("target") / (2 * F.col("s") + 1)).alias("q"), "s"), F.desc("q"), F.asc("k"), F.asc("s"))
        won = tries.where(F.col("place") < missing).groupBy("k").agg(F.count("*").alias("won"))
        sources = sources.join(won, "k", "left").withColumn("quota", F.col("quota") + F.coalesce("won", F.lit(0))).drop("won")


def _shard_quotas(rows):
    """The quota of a source for each of its shards (_tokens, _blocks, quota, _cap)."""
    rows = rows.sort_values("_shard")
    rows["_quota"] = sainte_lague([float(n) for n in rows["_tokens"]], int(rows["quota"].iloc[0]), [int(c) * int(b) for c, b in zip(rows["_cap"], rows["_blocks"], strict=True)])
    return rows[["s", "_shard", "_tokens", "_blocks", "_quota"]]


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (3.0, 1.0, 2.0), budget: float = 1.5, cap: float = 2.0, seed: int = 17, block: int = BLOCK, shard_tokens: int = SHARD_TOKENS, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken and the columns in `keep`; a row for each row of docs.

    Sources by code point, null as a source of its own and last, have the weights in turn; together they share `budget`
    times all words. A null or empty text has size 0 and is taken 0 times; a source without words has target 0. Rows with
    null or repeated ids are documents of their own; ties go by a hash of the text and of what is kept, so that reruns agree. Very long texts are
    counted whole. No rows give no rows. A document's `taken` is at most cap (a whole number) times its size."""
    tie, also = F.xxhash64(F.col(text_col)), F.xxhash64(F.lit(0), *(F.col(c) for c in keep))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("_source"), n_words(F.col(text_col)).alias("size"), tie.alias("_tie"), also.alias("_also"), F.struct(F.lit(0).alias("_"), *keep).alias("_keep"))
    if not keep:  # else the words are counted again, so that texts are not written once more
        rows = scratch(rows, "sizes")
    per = scratch(rows.groupBy("_source").agg(F.sum("size").alias("n")), "sources")
    sources = scratch(source_targets(per, weights, budget, cap), "targets")
    total, aims, least = _first(sources.agg(F.sum("n"), F.sum("target"), F.min(F.when(F.col("target") > 0, F.col("target")))).first())
    tokens = block
    while tokens > 1 and 0 < least < 64 * tokens:
        tokens //= 2
    blocks = lambda n: F.ceil(F.col(n) / tokens).cast("long")
    sources = source_quotas(sources, round(aims / tokens), int(cap) * blocks("n"))
    shard_tokens = max(shard_tokens, -(-int(total) // MAX_SHARDS))
    shards = F.greatest(F.ceil(F.col("n") / shard_tokens), F.lit(1)).cast("int")
    sources = scratch(sources.select(F.col("k").alias("s"), F.col("_source").alias("_name"), F.col("n").cast("long").alias("source_size"), "target", shards.alias("shards"), "quota"), "quotas")
    marked = rows.join(sources, rows["_source"].eqNullSafe(sources["_name"])).drop("_source", "_name")
    order = F.xxhash64("doc_id", F.lit(seed))
    marked = marked.withColumn("_shard", F.pmod(F.xxhash64("doc_id", "size", "_tie", F.lit(seed + 1)), "shards").cast("int"))
    each = marked.groupBy("s", "_shard", "shards", "quota").agg(F.sum("size").cast("long").alias("_tokens")).where("_tokens > 0").withColumn("_blocks", blocks("_tokens"))
    each = scratch(each.withColumn("_cap", F.lit(int(cap))), "shards")
    alone = each.where("shards = 1").select("s", "_shard", "_tokens", "_blocks", F.col("quota").alias("_quota"))
    dealt = each.where("shards > 1").groupBy("s").applyInPandas(_shard_quotas, "s long, _shard int, _tokens long, _blocks long, _quota long")
    quota = scratch(alone.unionByName(dealt), "quota")
    marked = marked.drop("quota", "shards").join(quota, ["s", "_shard"], "left")
    place = Window.partitionBy("s", "_shard").orderBy(order, "doc_id", "size", "_tie", "_also").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum("size").over(place)
    first = F.pmod(F.xxhash64("s", "_shard", F.lit(seed + 2)), "_blocks")
    spare = F.col("_quota") % F.col("_blocks")
    # Tokens [lo, hi) and, if it goes over the end, [0, over) of the shard are taken once more.
    marked = marked.withColumns({"_end": end, "_first": first, "_spare": spare})
    lo, hi = F.col("_first") * tokens, F.least((F.col("_first") + F.col("_spare")) * tokens, F.col("_tokens"))
    over = F.greatest(F.col("_first") + F.col("_spare") - F.col("_blocks"), F.lit(0)) * tokens
    begin = F.col("_end") - F.col("size")
    shared = lambda a, b: F.greatest(F.least(F.col("_end"), b) - F.greatest(begin, a), F.lit(0))
    taken = F.col("size") * F.floor(F.col("_quota") / F.col("_blocks")) + shared(lo, hi) + shared(F.lit(0), over)
    return marked.select("doc_id", "size", "source_size", "target", F.coalesce(taken, F.lit(0)).cast("long").alias("taken"), *(F.col("_keep")[c].alias(c) for c in keep))
