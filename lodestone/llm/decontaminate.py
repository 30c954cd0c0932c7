"""Benchmark decontamination: which documents hold which benchmark items, however long the document.

Containment of an item in a document: the part of the item's distinct word shingles that the document has too.
Items are partitioned by the size of their shingle set (powers of two). In a partition whose largest set has u
shingles, an item's MinHash sketch is its floor((1 - t) u) + 1 smallest shingle hashes: a document that contains at
least t of the item lacks fewer shingles than that, so it has one of the sketch for certain. Documents need no sketch,
whatever their length: their shingle hashes probe the sketches, and each candidate pair is then verified with the
shingles themselves. An item of fewer words than a shingle has is one shingle, all its words, in a partition of its own
for each number of words, and documents are read for shingles of that many words too if there is such an item.

All of it is DataFrame functions. What is broadcast are Bloom tables of bounded size, of the sketches, the candidate documents and the
items' shingles; what they let pass meets the tables themselves by joins, at every size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import only, scratch, without

WIDTH = 5
THRESHOLD = 0.8


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[\\p{L}\\p{N}]+"), F.lit(0))


def _places(w: Column, width: int, each) -> Column:
    """each(place) for every place at which a shingle begins; null where there are fewer words than a shingle has."""
    return F.when(F.size(w) >= width, F.transform(F.sequence(F.lit(0), F.size(w) - width), each))


def shingle_hashes(w: Column, width: int = WIDTH) -> Column:
    """Hashes of all shingles; the number of words is hashed too, so that those of short items stand apart."""
    return _places(w, width, lambda i: F.xxhash64(F.lit(width), *(w[i + k] for k in range(width))))


def shingles(w: Column, width: int = WIDTH) -> Column:
    return F.array_distinct(_places(w, width, lambda i: F.concat_ws(" ", *(w[i + k] for k in range(width)))))


def _of_widths(w: Column, widths: list[int], each) -> Column:
    """The arrays each(w, width) of several widths as one."""
    none = F.array()
    parts = [F.coalesce(each(w, k), none.cast("array<bigint>") if each is shingle_hashes else none.cast("array<string>")) for k in widths]
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def sketches(items: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """item_id, h: the sketch of each item; items: item_id, words, n (distinct shingles, more than none)."""
    # items of fewer words than a shingle: -1, -2 ... by their words
    part = F.when(F.size("words") < width, -F.size("words")).otherwise(F.floor(F.log2("n")).cast("int"))
    sized = items.withColumn("part", part)
    depth = sized.groupBy("part").agg((F.floor(F.max("n") * (1 - threshold) + 1e-9) + 1).cast("int").alias("depth"))
    short = F.coalesce(*(F.when(F.size("words") == k, shingle_hashes(F.col("words"), k)) for k in range(1, width)), shingle_hashes(F.col("words"), width))
    hashes = F.array_sort(F.array_distinct(short))
    return sized.withColumn("hashes", hashes).join(F.broadcast(depth), "part").select("item_id", F.explode(F.slice("hashes", F.lit(1), F.col("depth"))).alias("h"))  # a row a power of two


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", width: int = WIDTH, threshold: float = THRESHOLD, least_words: int = 1) -> DataFrame:
    """doc_id, item_id, n_shingles (of the item), n_found (of those, in the document), containment; a row for each pair with
    containment >= threshold.

    Nulls and texts without words are in no pair, and neither are rows with a null id or items of fewer than `least_words` words. An item of fewer
    than `width` words has one shingle, all its words in order. Rows that repeat an id count as one document or item that has the shingles of
    all of them. Ids are of any type. Very long texts are probed whole; ties don't arise, as every pair counts. Other columns are not looked at.
    An empty table on either side gives no rows."""
    own = benchmark.select(F.col(item_col).alias("item_id"), words(F.col(item_text)).alias("words")).where(F.col("item_id").isNotNull() & (F.size("words") >= max(1, least_words)))
    whole = F.when(F.size("words") < width, F.array(F.array_join("words", " "))).otherwise(shingles(F.col("words"), width))
    own = scratch(own.withColumn("short", F.least(F.size("words"), F.lit(width))), "benchmark")
    widths = sorted(r["short"] for r in own.select("short").distinct().collect()) or [width]  # `width` numbers at most
    item_shingles = scratch(own.select("item_id", F.explode(whole).alias("shingle")).distinct(), "items")
    item_sizes = item_shingles.groupBy("item_id").agg(F.count("*").alias("n"))
    # each text of an item has a sketch deep enough for the shingles of all its texts
    probe = scratch(sketches(own.join(item_sizes, "item_id"), width, threshold).distinct(), "sketches")

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null")
    hashed = rows.select("doc_id", words(F.col("text")).alias("words")).select("doc_id", F.explode(_of_widths(F.col("words"), widths, shingle_hashes)).alias("h"))
    candidates = scratch(only(hashed, "h", probe.select("h")).join(probe, "h").select("doc_id", "item_id").distinct(), "candidates")

    texts = only(rows, "doc_id", candidates.select("doc_id")).select("doc_id", words(F.col("text")).alias("words"))
    held = texts.select("doc_id", F.explode(_of_widths(F.col("words"), widths, shingles)).alias("shingle"))
    held = only(held, "shingle", item_shingles.select("shingle")).distinct()
    found = held.join(item_shingles, "shingle").join(candidates, ["doc_id", "item_id"])
    counts = found.groupBy("doc_id", "item_id").agg(F.count("*").alias("n_found"))
    out = counts.join(item_sizes, "item_id").withColumn("containment", F.col("n_found") / F.col("n"))
    return out.where(F.col("n_found") >= F.ceil(F.col("n") * threshold - 1e-9)).select("doc_id", "item_id", F.col("n").alias("n_shingles"), "n_found", "containment")


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", least_words: int = WIDTH, **options) -> DataFrame:
    """docs without those that contain an item of `least_words` words or more, as an answer of a word or two stands in clean documents too;
    rows with a null id or text stay."""
    return without(docs, id_col, contaminated(docs, benchmark, id_col, least_words=least_words, **options).select("doc_id"))
