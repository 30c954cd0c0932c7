"""N-gram Jaccard join by prefix trees: which texts have nearly the same set of word n-grams.

1. Every text becomes the set of its distinct n-grams (64-bit hashes); texts with one and the same set are one member.
2. All n-grams have one global order: those that a counting sketch over all texts shows as common come last, the more
   the commoner, then by hash. Two sets that reach the threshold share an n-gram among the first |x| - ceil(t |x|) + 1 of each. As
   passages that many texts share stand last, a text that shares no more than such passages has none in its head.
3. N-grams that stand in the head of two different sets name a bundle: their smallest member leads it, and every set
   that shares such an n-gram with it belongs to it. So each pair that can link meets in a bundle, and the n-grams of a
   cluster, which mostly have the same smallest member, give one bundle or a few and not one for each n-gram.
4. Most members share just a passage. Each set's n-grams are counted by buckets, about eight to a bucket; the sum of the lesser counts
   of two sets is no less than what they share, so members for which no other of the bundle can reach the threshold go
   before any text is moved.
5. A bundle is processed in blocks of bounded size, the leader in each. A block's sets go one by one, shortest first,
   through a trie of those before: shared beginnings are compared once, and a subtree goes as soon as the n-grams that
   remain can't reach the threshold, or all it holds is already in the same component.
6. First every text is sent to one of its bundles only. Links that join two components of a block go to connected
   components. Bundles whose members are then in different components are compared again, so no link is lost. A bundle
   of more n-grams than a block holds is dealt by size class, as sets that link are of one class or adjoining ones, and by
   blocks within a class; only if more than one component is left in it, pairs of such blocks are compared, by signatures first.
   By step 2 its n-grams are common ones, so its members have next to no rare n-grams at all.

No pairs of a group are listed: a block gives fewer links than it has members. Texts are moved only for members that are
left after step 4, found by a Bloom table of bounded size and then by their ids."""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import forget, maybe, scratch, slices, small_batches, without
from lodestone.llm.components import connected_components

#: The sketch has 2**SKETCH_BITS counters, which come in SLICES parts.
SKETCH_BITS, SLICES = 24, 64
#: Digests that a task remembers, to send equal sets once.
REMEMBERED = 200_000
#: N-grams in a block of a bundle: those of some hundred texts, or of one very long one.
BLOCK = 1 << 18


class Trie:
    """A radix tree of sets, each a tuple of n-gram ranks ascending by the global order."""

    __slots__ = ("ids", "kids", "least", "most", "one", "seg")

    def __init__(self, seg, ids, least, most, one):
        self.seg, self.kids, self.ids, self.least, self.most, self.one = seg, {}, ids, least, most, one


def _head(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _links(members: list, percent: int, parent: list[int]) -> Iterator[tuple[int, int]]:
    """members: arrays of order keys, ascending, shortest array first; parent: their union-find. Yields pairs that joined two classes."""
    import numpy as np

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    root = Trie(np.zeros(0, dtype=np.uint64), [], 1 << 60, 0, -1)
    for me, x in enumerate(members):
        n = len(x)
        # Traverse: (node, overlap so far, depth so far).
        stack = [(k, 0, 0) for k in root.kids.values()]
        while stack:
            node, over, depth = stack.pop()
            if node.most * 100 < percent * n or (node.one >= 0 and find(node.one) == find(me)):
                continue
            need = -(-percent * (n + node.least) // (100 + percent))
            seg, dead, at, size = node.seg, False, 0, len(node.seg)
            step = max(24, node.most - need + 2)
            while at < size:
                part = seg[at : at + step]
                pos = np.searchsorted(x, part)
                pos[pos == n] = n - 1
                over += int(np.count_nonzero(x[pos] == part))
                at += len(part)
                if over + min(node.most - depth - at, n - over) < need:
                    dead = True
                    break
                step = size
            if dead:
                continue
            depth += size
            for i in node.ids:
                if 100 * over >= percent * (n + depth - over):
                    p, q = find(me), find(i)
                    if p != q:
                        parent[p] = q
                        yield me, i
            stack += [(k, over, depth) for k in node.kids.values()]
        # Insert.
        node, at = root, 0
        mine = find(me)
        while True:
            node.least, node.most = min(node.least, n), max(node.most, n)
            if node.one >= 0 and find(node.one) != mine:
                node.one = -1
            if at == n:
                node.ids.append(me)
                break
            kid = node.kids.get(key := int(x[at]))
            if kid is None:
                node.kids[key] = Trie(x[at:], [me], n, n, me)
                break
            m = min(len(kid.seg), n - at)
            differs = np.flatnonzero(kid.seg[:m] != x[at : at + m])
            same = int(differs[0]) if len(differs) else m
            if same < len(kid.seg):  # split the edge
                top = Trie(kid.seg[:same], [], kid.least, kid.most, kid.one)
                kid.seg = kid.seg[same:]
                top.kids[int(kid.seg[0])] = kid
                node.kids[key] = kid = top
            node, at = kid, at + same


def _signature(x) -> bytes:
    """How many n-grams each bucket has, with about eight n-grams to a bucket: 16 to 1024 buckets, a power of two."""
    import numpy as np

    size = min(1024, max(16, 1 << (len(x) // 8).bit_length()))
    return np.minimum(np.bincount((x & np.uint64(size - 1)).astype(np.int64), minlength=size), 255).astype(np.uint8).tobytes()


def _scan(width: int, bits: int):
    """For each text its set's size, digest and signature, and at the end of the task the sketch in slices: how many sets have an
    n-gram of each bucket."""

    def run(batches):
        import zlib

        import numpy as np
        import pyarrow as pa
        import xxhash

        from lodestone.llm import shingles

        counts = np.zeros(1 << bits, dtype=np.uint16)
        names = ["id", "n", "d1", "d2", "sig", "slice", "seen"]
        every, held = [], 0

        def add():
            at, n = np.unique((np.concatenate(every) >> np.uint64(64 - bits)).astype(np.uint32), return_counts=True)
            counts[at] = np.minimum(counts[at].astype(np.int64) + n, 65535)

        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            for at, n, data, ends in slices(batch, "text"):
                size, one, two = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
                sigs = [None] * n
                for k, x in enumerate(shingles.sets(data, ends, width)):
                    if len(x):
                        every.append(x)
                        held += len(x)
                        d = xxhash.xxh3_128_digest(x.tobytes())
                        size[k] = len(x)
                        one[k], two[k] = np.frombuffer(d, dtype=np.int64)
                        sigs[k] = _signature(x)
                if held > 1 << 19:
                    add()
                    every, held = [], 0
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), pa.array(size), pa.array(one), pa.array(two), pa.array(sigs, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names)
        if every:
            add()
        if kind is not None:
            n = min(SLICES, len(counts))
            packed = []
            for x in counts.reshape(n, -1):  # the places that are not 0, as distances, and their counts, each split into bytes of one weight
                at = np.flatnonzero(x)
                both = (np.diff(at, prepend=0).astype(np.uint32), x[at])
                packed.append(zlib.compress(len(at).to_bytes(4, "little") + b"".join(v.view(np.uint8).reshape(len(v), v.itemsize).T.tobytes() for v in both), 1))
            none = pa.nulls(n, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.nulls(n, kind), none, none, none, pa.nulls(n, pa.binary()), pa.array(np.arange(n, dtype=np.int32)), pa.array(packed, pa.binary())], names=names)

    return run


def _rank_slices(size: int):
    """Rows sorted by slice: for each slice of the sketch, of `size` buckets, a rank for each bucket, 0 for what is not clearly above the middle one, then by
    thirds of doublings of what is."""
    return lambda batches: _ranked(batches, size)


def _ranked(batches, size: int):
    import zlib

    import numpy as np
    import pyarrow as pa

    def ranked(total):
        middle = float(np.median(total))
        above = (total - middle) / (4 * math.sqrt(max(middle, 4.0)))  # chance alone gives few at four deviations, and those do no harm
        rank = np.floor(np.log2(np.maximum(above, 0.5)) * 3) + 1
        return np.clip(rank, 0, 31).astype(np.uint8).tobytes()

    now, total, out = None, None, []
    for batch in batches:
        for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if k != now:
                if now is not None:
                    out.append((now, ranked(total)))
                now, total = k, np.zeros(size, dtype=np.int64)
            raw = zlib.decompress(data)
            n = int.from_bytes(raw[:4], "little")
            steps, seen = (np.frombuffer(raw, np.uint8, n * width, lo).reshape(width, n).T.copy().view(kind).ravel() for lo, width, kind in ((4, 4, np.uint32), (4 + 4 * n, 2, np.uint16)))
            total[np.cumsum(steps.astype(np.int64))] += seen
    if now is not None:
        out.append((now, ranked(total)))
    if out:
        a, b = zip(*out, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.binary())], names=["slice", "ranks"])


def _ranks(spark: SparkSession, sketch: DataFrame, bits: int):
    """Broadcast a byte for each bucket of the sketch; the driver sees these bytes, 2**SKETCH_BITS of them at most."""
    import numpy as np

    rows = sketch.repartition(SLICES, "slice").sortWithinPartitions("slice").mapInArrow(_rank_slices(max(1, (1 << bits) // SLICES)), "slice int, ranks binary").collect()
    table = b"".join(bytes(r.ranks) for r in sorted(rows))
    return spark.sparkContext.broadcast(np.frombuffer(table or bytes(2), dtype=np.uint8))


def _order(x, ranks):
    """The set x (ascending hashes) in the global order, as keys that ascend by it: the rank of its bucket, then the hash."""
    import numpy as np

    r = ranks[(x >> np.uint64(64 - (len(ranks).bit_length() - 1))).astype(np.int64)]
    if not r.any():
        return x >> np.uint64(5)
    return np.sort((r.astype(np.uint64) << np.uint64(59)) | (x >> np.uint64(5)))


def _heads(width: int, percent: int, ranks):
    """For each set the n-grams of its head; of equal sets that a task remembers only the first."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        from lodestone.llm import shingles

        table, had = ranks.value, set()
        for batch in batches:
            for _, _, data, ends in slices(batch, "text"):
                tokens, who = [], []
                for x in shingles.sets(data, ends, width):
                    if not len(x) or (d := xxhash.xxh3_128_digest(x.tobytes())[:8]) in had:
                        continue
                    if len(had) >= REMEMBERED:
                        had.clear()
                    had.add(d)
                    head = _order(x, table)[: _head(len(x), percent)]
                    tokens.append(head)
                    who.append(np.full(len(head), np.frombuffer(d, dtype=np.int64)[0]))
                if tokens:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(who))], names=["token", "d1"])

    return run


def _blocks(width: int, percent: int, ranks):
    """Rows sorted by bundle and block, each with d1, comp and a text: the links found in each block. A text whose set is not
    that of d1 (another of the same id) is passed over."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        from lodestone.llm import shingles

        table = ranks.value

        def solve(ids, sets, comps):
            members = {i: (x, c) for i, x, c in zip(ids, sets, comps, strict=True)}
            order = sorted(members, key=lambda i: (len(members[i][0]), i))
            if len(order) < 2:
                return
            first: dict[int, int] = {}
            parent = [first.setdefault(members[i][1], k) for k, i in enumerate(order)]
            for p, q in _links([members[i][0] for i in order], percent, parent):
                yield order[p], order[q]

        def out(pairs):
            a, b = zip(*pairs, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        now, ids, sets, comps, pairs = None, [], [], [], []
        for batch in batches:
            keys = list(zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("bundle", "block", "d1", "comp")), strict=True))
            for at, _, data, ends in slices(batch, "text"):
                for k, x in enumerate(shingles.sets(data, ends, width)):
                    bundle, block, i, c = keys[at + k]
                    if now != (bundle, block):
                        pairs += solve(ids, sets, comps)
                        now, ids, sets, comps = (bundle, block), [], [], []
                    if np.frombuffer(xxhash.xxh3_128_digest(x.tobytes())[:8], dtype=np.int64)[0] == i:
                        ids.append(i)
                        sets.append(_order(x, table))
                        comps.append(c)
            if len(pairs) > 10_000:
                yield out(pairs)
                pairs = []
        pairs += solve(ids, sets, comps)
        if pairs:
            yield out(pairs)

    return run


def _may_link(n, sigs, comp, percent: int):
    """Which of some sets may link with another of a different component; n: sizes, ascending; sigs: their signatures."""
    import numpy as np

    good = np.zeros(len(n), dtype=bool)
    size = np.array([len(x) for x in sigs])
    to = np.searchsorted(n, n * 100 // percent, side="right")
    # Signatures of one size stand together, as n ascends; larger ones are folded to that of the lesser set of a pair.
    for z in np.unique(size):
        own = np.flatnonzero(size == z)
        lo, hi = own[0], max(int(to[own].max()), own[-1] + 1)
        folded = np.stack([np.frombuffer(x, dtype=np.uint8).reshape(-1, z).sum(axis=0, dtype=np.uint16) for x in sigs[lo:hi]])
        full = np.array([len(x) > z or x.count(b"\xff") > 0 for x in sigs[lo:hi]]) & (folded.max(axis=1) >= 255)
        for k in own:
            at = np.arange(k + 1, to[k])
            at = at[(comp[at] != comp[k]) & ~(good[at] & good[k])]
            if len(at):
                shared = np.minimum(folded[at - lo], folded[k - lo]).sum(axis=1, dtype=np.int64)
                close = ((100 + percent) * shared >= percent * (n[at] + n[k])) | full[at - lo] | full[k - lo]
                if close.any():
                    good[k] = True
                    good[at[close]] = True
    return good


def _possible(percent: int, kind: str):
    """Rows sorted by bundle and block, each with d1, comp, rep, n and sig: those that may link with another of their block and not of their component."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        names = ["bundle", "block", "d1", "comp", "rep"]
        types = None

        def solve(rows):
            rows = sorted(rows, key=lambda r: (r[5], r[2]))
            if len(rows) < 2 or rows[0][2] == rows[-1][2]:
                return []
            good = _may_link(np.array([r[5] for r in rows]), [r[6] for r in rows], np.array([r[3] for r in rows]), percent)
            return [r[:5] for r, g in zip(rows, good, strict=True) if g]

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        now, rows, out = None, [], []
        for batch in batches:
            types = types or [batch.schema.field(batch.schema.get_field_index(c)).type for c in names]
            for r in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (*names, "n", "sig")), strict=True):
                if r[:2] != now:
                    out += solve(rows)
                    now, rows = r[:2], []
                rows.append(r)
            if len(out) > 10_000:
                yield batch_of(out)
                out = []
        out += solve(rows)
        if out:
            yield batch_of(out)

    return run, f"bundle long, block string, d1 long, comp long, rep {kind}"


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, percent: int = 85, block: int = BLOCK, sketch_bits: int = SKETCH_BITS) -> DataFrame:
    """Columns id, n_shingles, component_id, a row for each row of docs: the size of the text's set of `width`-word shingles
    and the smallest id that links reach. Two texts link when 100 * |intersection| >= percent * |union|.

    Null, empty and blank texts have the empty set and link with nothing; a null id stays null in both columns and takes
    no part in links. Rows that repeat an id are one node, which all their texts link to. Ids are of any type that has an
    order. Other columns of docs are not looked at. Ties go to the smaller id. Very long texts are taken one at a time. No rows give no rows.
    `block`: n-grams that a block of a bundle holds."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    seen = scratch(small_batches(rows).mapInArrow(_scan(width, sketch_bits), f"id {kind}, n long, d1 long, d2 long, sig binary, slice int, seen binary"), "sets")
    sized = seen.where("slice is null").select("id", "n", "d1", "d2", "sig")
    ranks = _ranks(spark, seen.where("slice is not null").select("slice", "seen"), sketch_bits)
    named_sets = sized.where("n > 0 and id is not null")
    of_set = scratch(named_sets.groupBy("d1", "d2", "n").agg(F.min("id").alias("rep"), F.first("sig").alias("sig")), "distinct")

    named = rows.where("id is not null")
    heads = small_batches(named.select("text")).mapInArrow(_heads(width, percent, ranks), "token long, d1 long")
    shared = heads.groupBy("token").agg(F.min("d1").alias("bundle"), F.max("d1").alias("other")).where("bundle < other").select("token", "bundle")
    pairs = scratch(heads.join(shared, "token").where("d1 != bundle").select("bundle", "d1").distinct(), "bundles")

    step = math.log(100 / percent) * 1.0001  # sets that link are of one class of sizes or of adjoining ones
    members = pairs.unionByName(pairs.select("bundle", F.col("bundle").alias("d1")).distinct())
    placed = members.join(of_set.drop("d2"), "d1").withColumns({"cls": F.floor(F.log("n") / step).cast("int"), "leads": F.col("d1") == F.col("bundle")})
    placed = scratch(placed, "placed")
    forget(pairs)
    at, own = ["bundle", "block"], F.concat_ws(".", "cls", "i")
    row = ["d1", "rep", "n", "sig"]

    sizes = placed.groupBy("bundle").agg(F.sum("n").alias("m"))
    wide = scratch(sizes.where(F.col("m") > block).select("bundle"), "wide")
    narrow = placed.join(wide, "bundle", "left_anti").select("bundle", F.lit("0").alias("block"), *row, F.col("d1").alias("comp"))
    of_wide = placed.join(wide, "bundle", "left_semi")
    counts = of_wide.groupBy("bundle", "cls").agg(F.ceil(F.sum("n") / F.lit(block)).cast("int").alias("blocks"))
    dealt = of_wide.join(counts, ["bundle", "cls"]).withColumn("i", F.pmod(F.xxhash64("d1"), "blocks").cast("int"))
    dealt = scratch(dealt.select("bundle", "cls", "i", *row, "leads"), "dealt")

    def beside(rows: DataFrame) -> DataFrame:
        """rows once for each other block of their size class and the adjoining ones, which is `to`."""
        near = rows.withColumn("to_cls", F.explode(F.array(F.col("cls") - 1, F.col("cls"), F.col("cls") + 1)))
        near = near.join(counts.select("bundle", F.col("cls").alias("to_cls"), "blocks"), ["bundle", "to_cls"])
        near = near.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        return near.withColumn("to", F.concat_ws(".", "to_cls", "j")).where(F.col("to") != own)

    alone = F.col("d1").alias("comp")
    leaders = beside(dealt.where("leads")).select("bundle", F.col("to").alias("block"), *row, alone)
    first = narrow.unionByName(dealt.select("bundle", own.alias("block"), *row, alone)).unionByName(leaders)

    def possible(rows: DataFrame) -> DataFrame:
        sorted_rows = rows.repartition(*at).sortWithinPartitions(*at)
        return scratch(small_batches(sorted_rows).select(*at, "d1", "comp", "rep", "n", "sig").mapInArrow(*_possible(percent, kind)), "members")

    def linked(rows: DataFrame) -> DataFrame:
        texts = maybe(named, "id", rows.select("rep").distinct())
        sorted_rows = rows.join(texts, F.col("rep") == F.col("id")).repartition(*at).sortWithinPartitions(*at)
        return scratch(small_batches(sorted_rows).select(*at, "d1", "comp", "text").mapInArrow(_blocks(width, percent, ranks), "a long, b long"), "links")

    stay = possible(first)
    once = stay.groupBy("d1").agg(F.min(F.struct(*at, "comp", "rep")).alias("to")).select("to.bundle", "to.block", "d1", "to.comp", "to.rep")
    leading = stay.join(dealt.where("leads").select("bundle", "d1"), ["bundle", "d1"], "left_semi").select(*at, "d1", "comp", "rep")
    links = linked(scratch(once.unionByName(leading).distinct(), "sent"))
    # the sets of the texts of one id belong together
    several = named_sets.groupBy("id").agg(F.min("d1").alias("a"), F.max("d1").alias("z")).where("a < z").select("id", "a")
    same = named_sets.select("id", "d1").join(several, "id").where("a != d1").select("a", F.col("d1").alias("b"))
    comps = connected_components(links.unionByName(same.distinct()))

    def apart(rows: DataFrame) -> DataFrame:
        """Of rows, with the components so far, the bundles that hold more than one."""
        now = rows.join(comps.withColumnRenamed("node", "d1"), "d1", "left").withColumn("comp", F.coalesce("component", "d1")).drop("component")
        split = now.groupBy("bundle").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("bundle")
        return now.join(split, "bundle", "left_semi")

    rest = apart(stay.drop("comp").join(of_set.select("d1", "n", "sig"), "d1")).select(*at, *row, "comp")
    grid = beside(apart(dealt)).select("bundle", F.concat_ws("-", F.least(own, "to"), F.greatest(own, "to")).alias("block"), *row, "comp")
    rest = possible(rest.unionByName(grid))
    if not rest.isEmpty():
        more = linked(rest)
        comps = connected_components(more.unionByName(comps.select(F.col("node").alias("a"), F.col("component").alias("b"))))

    met = comps.join(of_set.select("d1", "d2", "n", "rep"), F.col("node") == F.col("d1"))
    least = met.groupBy("component").agg(F.min("rep").alias("least"))
    label = met.join(least, "component").select("d1", "d2", "n", "least")
    label = scratch(of_set.join(label, ["d1", "d2", "n"], "left").select("d1", "d2", "n", F.coalesce("least", "rep").alias("component")), "labels")  # a join of its own can be split where very many texts are equal
    out = sized.select("id", "n", "d1", "d2").join(label, ["d1", "d2", "n"], "left")
    return out.select("id", F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """docs without near copies: of each component the rows of the smallest id stay (all of them, if that id is repeated).
    Rows without an id or without words stay."""
    found = jaccard_components(docs, id_col, text_col, width, percent)
    return without(docs, id_col, found.where("id is not null and component_id != id").select("id"))
