"""Substring deduplication by content-defined chunks: a gear hash cuts, a digest finds repeats.

The gear hash of a place sums a random number for each of the last 16 bytes, each shifted by its distance, so a cut
depends on nothing but these bytes: after an insertion the cuts are the same again 16 bytes on. All hashes of a run of
texts are computed at once by doubling (windows of 1, 2, 4, 8, 16 bytes). A place is a cut if the hash's top bits are
zero and no such place stands within the `least` bytes before it; longer stretches without a cut are cut every `most` bytes.
Chunks are then grouped by 96 bits of a digest; adjoining chunks that repeat form one span. A repeated passage is seen from its first
cut to its last: what it lacks on either side is part of the next chunk, so half of that chunk's words are added before a span is held against
`min_words` (34), which stands for passages of about 45 words and more; shorter ones are left alone, as chance or boilerplate words.

The first place of a chunk is never removed, so no text is lost, whatever the order in which passages meet."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import only, scratch, sifted, slices, small_batches, without

MASK_BITS, LEAST, MOST, MIN_WORDS = 4, 8, 1024, 34
_WINDOW = 16
#: Words of a neighbouring chunk that are told at most.
_NEAR = 31


def _gears():
    """A 16-bit number for each byte by a linear congruential rule."""
    import numpy as np

    out, x = [], 0x2545F491
    for _ in range(256):
        for _ in range(3):
            x = (x * 6364136223846793005 + 1442695040888963407) & ((1 << 64) - 1)
        out.append(x >> 48)
    return np.array(out, dtype=np.uint16)


def cuts(data: bytes, ends: list[int], mask_bits: int = MASK_BITS, least: int = LEAST, most: int = MOST):
    """Ends of all chunks of the texts that lie one after the other in data; each text's end is one."""
    import numpy as np

    n = len(data)
    h = _gears()[np.frombuffer(data, dtype=np.uint8)]
    w = 1
    while w < _WINDOW:
        h[w:] += h[:-w] << np.uint16(w)  # the right side is computed before it is added
        w *= 2
    at = np.flatnonzero(h >> np.uint16(16 - mask_bits) == 0) + 1
    ends = np.asarray(ends, dtype=np.int64)
    text = np.searchsorted(ends, at, side="left")  # a cut at a text's end belongs to that text
    begin = ends[np.maximum(text, 1) - 1]
    at, text = at[inside := (at - begin >= _WINDOW) & (at < n)], text[inside]  # the window lies in the text
    far = np.ones(len(at), dtype=bool)
    far[1:] = (at[1:] - at[:-1] >= least) | (text[1:] != text[:-1])
    all_cuts = np.union1d(at[far], ends[1:])
    all_cuts = all_cuts[all_cuts > 0]
    start = np.concatenate([[0], all_cuts[:-1]]) if len(all_cuts) else all_cuts
    long = np.flatnonzero(all_cuts - start > most)
    if len(long):
        more = [np.arange(start[k] + most, all_cuts[k], most) for k in long]
        all_cuts = np.union1d(all_cuts, np.concatenate(more))
    return all_cuts


def _word_starts(data: bytes, ends: list[int]):
    """1 at each byte that begins a word."""
    import numpy as np

    b = np.frombuffer(data, dtype=np.uint8)
    space = (b == 32) | ((b >= 9) & (b <= 13))
    first = ~space
    first[1:] &= space[:-1]
    cut = np.asarray(ends[1:-1], dtype=np.int64)
    cut = cut[cut < len(b)]
    first[cut] = ~space[cut]
    return first.astype(np.int32)


def _chunks(mask_bits: int, least: int, most: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        for batch in batches:
            for at, n, data, ends in slices(batch, "text"):
                if not data:
                    continue
                stop = cuts(data, ends, mask_bits, least, most)
                start = np.concatenate([[0], stop[:-1]])
                text = np.searchsorted(np.asarray(ends), start, side="right") - 1
                digest, view = xxhash.xxh3_128_digest, memoryview(data)
                d = np.frombuffer(b"".join(digest(view[a:b]) for a, b in zip(start.tolist(), stop.tolist(), strict=True)), dtype=np.uint64).reshape(-1, 2)
                one, two = d[:, 0], (d[:, 1] & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)
                base = np.asarray(ends, dtype=np.int64)[text]
                words = np.add.reduceat(_word_starts(data, ends), start).astype(np.int64)
                order = np.lexsort((two, one, text))
                later = np.zeros(len(d), dtype=np.int64)
                later[order[1:]] = (one[order[1:]] == one[order[:-1]]) & (two[order[1:]] == two[order[:-1]]) & (text[order[1:]] == text[order[:-1]])
                near = np.minimum(words, _NEAR)
                same = text[1:] == text[:-1]
                before, after = np.zeros_like(near), np.zeros_like(near)
                before[1:], after[:-1] = near[:-1] * same, near[1:] * same
                info = (start - base) << 32 | (stop - start) << 21 | words << 11 | later << 10 | before << 5 | after
                keys = [batch.column(k).slice(at, n).take(pa.array(text)) for k in (0, 2)]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(info), pa.array(one.view(np.int64)), pa.array(two)], names=["doc_id", "sub", "info", "digest", "more"])

    return run


def _part(info, shift: int, bits: int):
    """A number that is packed in info: start (32, 32), size (21, 11), words (11, 10), later (10, 1), words of the chunk before (5, 5) and after (0, 5)."""
    return F.shiftright(info, shift).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")


def _subs(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text, sub of rows with an id, the ids that stand in several rows). sub tells texts of one id apart: a hash of the
    text where rows repeat the id, else 0."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    again = scratch(rows.groupBy("doc_id").count().where("count > 1").select("doc_id"), "again")
    zero = F.lit(0).cast("long").alias("sub")
    if again.isEmpty():
        return rows.select("doc_id", "text", zero), again
    sure, maybe, ids, same = sifted(rows, "doc_id", again, 1 << 18)
    met = maybe.join(ids.hint("merge"), same, "left")
    sub = F.when(F.col("__id").isNotNull(), F.shiftrightunsigned(F.xxhash64("text"), 8)).otherwise(0).cast("long")
    return sure.select("doc_id", "text", zero).union(met.select("doc_id", "text", sub)), again


def _pieces(rows: DataFrame, mask_bits: int, least: int, most: int) -> DataFrame:
    kind = rows.schema["doc_id"].dataType.simpleString()
    if not least <= most < 2048:
        raise ValueError("chunks have fewer than 2048 bytes")
    return small_batches(rows).mapInArrow(_chunks(mask_bits, least, most), f"doc_id {kind}, sub long, info long, digest long, more int")


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask_bits: int = MASK_BITS, least: int = LEAST, most: int = MOST) -> DataFrame:
    """doc_id, sub, later, start, size, words (that begin in it), digest, more (32 further bits of it): the chunks of every whole text, in UTF-8 bytes. Null
    and empty texts have none, and neither have rows with a null id. later is 1 if the chunk stands earlier in its text too."""
    info = F.col("info")
    each = _pieces(_subs(docs, id_col, text_col)[0], mask_bits, least, most)
    return each.select("doc_id", "sub", _part(info, 10, 1).alias("later"), _part(info, 32, 32).alias("start"), _part(info, 21, 11).alias("size"), _part(info, 11, 10).alias("words"), "digest", "more")


def _spans(docs: DataFrame, id_col: str, text_col: str, mask_bits: int, least: int, most: int, min_words: int) -> DataFrame:
    rows, again = _subs(docs, id_col, text_col)
    each = _pieces(rows, mask_bits, least, most)
    repeated = not again.isEmpty()
    place = F.struct("doc_id", "sub") if repeated else F.col("doc_id")
    shared = each.groupBy("digest", "more").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    info = F.col("info")
    here = (place == F.col("first")) & (_part(info, 10, 1) == 0)
    found = each.join(shared, ["digest", "more"]).select("doc_id", "sub", "info", (F.col("first.doc_id") if repeated else F.col("first")).alias("first_doc"), here.alias("here"))
    if repeated:  # rows alike in id and text: only one of them can be the first place
        found = found.groupBy(*found.columns).agg(F.count("*").cast("int").alias("copies"))
        found = found.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).withColumn("here", F.col("here") & (F.col("copy") == 1)).drop("copies")
    else:
        found = found.withColumn("copy", F.lit(1))
    text = ["doc_id", "sub", "copy"]
    found = found.select(*text, "info", "first_doc", "here", _part(info, 32, 32).alias("start"), (_part(info, 32, 32) + _part(info, 21, 11)).alias("end"))
    in_text = Window.partitionBy(*text).orderBy("info")
    apart = F.coalesce(F.col("start") != F.lag("end").over(in_text), F.lit(True))
    turns = apart | (F.col("here") != F.lag("here").over(in_text))
    so_far = in_text.rowsBetween(Window.unboundedPreceding, 0)
    found = found.withColumns({"apart": apart.cast("int"), "turns": turns.cast("int")}).withColumns({"part": F.sum("apart").over(so_far), "piece": F.sum("turns").over(so_far)})
    pieces = found.groupBy(*text, "part", "piece").agg(
        F.first("here").alias("here"), F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n_chunks"), F.sum(_part(info, 11, 10)).alias("n_words"),
        F.min_by("first_doc", "info").alias("first_doc"), F.min_by(_part(info, 5, 5), "info").alias("before"), F.max_by(_part(info, 0, 5), "info").alias("after"),
    )
    in_part = Window.partitionBy(*text, "part").orderBy("piece")
    whole = Window.partitionBy(*text, "part")
    edge = F.when(F.lag("piece").over(in_part).isNull(), F.col("before") / 2).otherwise(0.0) + F.when(F.lead("piece").over(in_part).isNull(), F.col("after") / 2).otherwise(0.0)
    pieces = pieces.withColumn("about", F.col("n_words") + edge)
    pieces = pieces.withColumns({"all": F.sum("about").over(whole), "goes": ~F.col("here") & (F.col("about") >= min_words)}).where(F.col("all") >= min_words)
    pieces = pieces.withColumn("opens", F.coalesce(F.col("goes") != F.lag("goes").over(in_part), F.lit(True)).cast("int"))
    pieces = pieces.withColumn("span", F.sum("opens").over(in_part.rowsBetween(Window.unboundedPreceding, 0)))
    spans = pieces.groupBy(*text, "part", "span").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n_chunks").alias("n_chunks"), F.sum("n_words").alias("n_words"),
        F.min_by("first_doc", "start").alias("first_doc"), (~F.first("goes")).alias("keep"), F.sum("about").alias("about"),
    )
    return spans.where(F.col("about") >= min_words)


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask_bits: int = MASK_BITS, least: int = LEAST, most: int = MOST, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, start, end, n_chunks, n_words, first_doc, keep: spans of UTF-8 bytes whose chunks stand in other places too, of the same text as well.

    A chunk's first place is its first in the text of the smallest id (of rows that repeat an id, in an order of their texts, then in one copy of a
    text). Adjoining chunks that repeat, of `min_words` or more, are reported, cut where that changes what becomes of them: keep is false
    for a run of min_words or more none of whose chunks stands in its first place, which removed() takes out; it is true for all others, so the
    first place of every chunk stays. first_doc is the smallest id that has the span's first chunk. Null and empty texts have no spans; rows
    with a null id are not reported and don't count. Ids are of any type that has an order; other columns are not looked at. A very long text is
    worked on alone. No rows give no rows."""
    return _spans(docs, id_col, text_col, mask_bits, least, most, min_words).select("doc_id", "start", "end", "n_chunks", "n_words", "first_doc", "keep")


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask_bits: int = MASK_BITS, least: int = LEAST, most: int = MOST, min_words: int = MIN_WORDS) -> DataFrame:
    """docs, all columns and rows, without the spans that repeats() does not keep. Cuts never fall into a character. Rows with a null id
    or text, and those without such spans, stay as they are and are not shuffled."""
    gone = _spans(docs, id_col, text_col, mask_bits, least, most, min_words).where("not keep")
    gone = scratch(gone.groupBy("doc_id", "sub", "copy").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans")), "gone")
    ids = gone.select("doc_id")
    rest = without(docs, id_col, ids)
    cut = only(docs, id_col, ids)
    mark = lambda c: F.col(f"`__{c}`")
    _, again = _subs(docs, id_col, text_col)
    texts = cut.join(again.select(F.col("doc_id").alias("__again")).distinct(), cut[id_col] == mark("again"), "left")
    texts = texts.withColumn("__sub", F.when(mark("again").isNotNull(), F.shiftrightunsigned(F.xxhash64(text_col), 8)).otherwise(0).cast("long"))
    texts = texts.withColumn("__copy", F.row_number().over(Window.partitionBy(id_col, "__sub").orderBy(F.xxhash64(*docs.columns))))
    met = gone.select(F.col("doc_id").alias("__id"), F.col("sub").alias("__s"), F.col("copy").alias("__c"), F.col("spans").alias("__spans"))
    texts = texts.join(met, (texts[id_col] == mark("id")) & (mark("sub") == mark("s")) & (mark("copy") == mark("c")), "left")
    names, at = docs.columns, docs.columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        def inside(raw: bytes, k: int) -> bool:
            return k < len(raw) and raw[k] & 0xC0 == 0x80

        for batch in batches:
            out = []
            for text, spans in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                if text is not None and spans:
                    raw, last, kept = text.encode(), 0, []
                    for s in spans:
                        a, z = s["start"], s["end"]
                        while inside(raw, a):
                            a += 1
                        while inside(raw, z):
                            z -= 1
                        kept.append(raw[last:a])
                        last = max(a, z)
                    text = b"".join([*kept, raw[last:]]).decode()
                out.append(text)
            columns = [pa.array(out, batch.schema.field(k).type) if k == at else batch.column(k) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rest.union(small_batches(texts.select(*docs.columns, "__spans")).mapInArrow(run, docs.schema))
