"""Shared helpers: reading tables, counting words, and batches for Python workers."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.scratch import forget, scratch  # noqa: F401  (for the operators)

#: A word of the word rule: what stands between white space (space and 0x09-0x0D).
WORD = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text):
    """Number of words of a text column; 0 for null."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


#: Bytes of a batch that a Python worker gets, and rows of a Bloom table at most (about 12 MB when broadcast).
BATCH_BYTES, BLOOM_ROWS = 8 << 20, 1 << 18


def small_batches(df: DataFrame) -> DataFrame:
    """df, after lowering the session's bytes in an Arrow batch to BATCH_BYTES: long texts come few at a time."""
    spark, key = df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
    return df


def _place(key, rows: int) -> tuple:
    """Where a Bloom table of so many rows keeps a key: its row, and three of the row's 64 bits."""
    h, bits = F.xxhash64(key, F.lit(5)), None
    for k in (0, 6, 12):
        one = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright(h, k), F.lit(64)).cast("int"))
        bits = one if bits is None else bits.bitwiseOR(one)
    return F.pmod(F.xxhash64(key, F.lit(7)), F.lit(rows)), bits


def sifted(df: DataFrame, column: str, ids: DataFrame, most: int) -> tuple[DataFrame, DataFrame, DataFrame, object]:
    """(rows of df whose `column` is for certain not among ids, all others, the ids as a table, the condition that meets them).

    A blocked Bloom table of the ids tells them apart. It has `most` rows at most, whatever the number of ids, so it can be broadcast; with
    more ids it lets more rows pass as others."""
    kind = df.schema[column].dataType
    ids = scratch(ids.select(F.col(ids.columns[0]).cast(kind).alias("__id")).where("__id is not null").distinct(), "ids")
    rows, n = min(1024, most), ids.count()
    while rows * 8 < n and rows < most:
        rows = min(most, rows * 2)
    word, bits = _place(F.col("__id"), rows)
    bloom = ids.groupBy(word.alias("__word")).agg(F.bit_or(bits).alias("__bits"))
    word, bits = _place(df[column], rows)
    maybe = (word == bloom["__word"]) & (bloom["__bits"].bitwiseAND(bits) == bits)
    return df.join(F.broadcast(bloom), maybe, "left_anti"), df.join(F.broadcast(bloom), maybe, "left_semi"), ids, df[column] == ids["__id"]


def maybe(df: DataFrame, column: str, ids: DataFrame, most: int = BLOOM_ROWS) -> DataFrame:
    """Rows of df whose `column` may be among ids: all that are, and a few others, for a join that tells."""
    return sifted(df, column, ids, most)[1]


def without(df: DataFrame, column: str, ids: DataFrame, most: int = BLOOM_ROWS) -> DataFrame:
    """Rows of df whose `column` is not among ids (one column); rows with a null stay. Only rows that a Bloom table of the
    ids holds back are shuffled to meet the ids themselves."""
    sure, others, ids, same = sifted(df, column, ids, most)
    return sure.union(others.join(ids.hint("merge"), same, "left_anti"))


def only(df: DataFrame, column: str, ids: DataFrame, most: int = BLOOM_ROWS) -> DataFrame:
    """Rows of df whose `column` is among ids (one column), in the same way."""
    _, others, ids, same = sifted(df, column, ids, most)
    return others.join(ids.hint("merge"), same, "left_semi")


def slices(batch, column: str, most: int = 1 << 20) -> Iterator[tuple[int, int, bytes, list[int]]]:
    """Cut a batch into runs of rows with about `most` bytes of text: (first row, rows, bytes, offsets); null is empty.

    A longer text is a run of its own, so memory follows the longest text and not the batch."""
    import numpy as np
    import pyarrow as pa

    texts = batch.column(batch.schema.get_field_index(column))
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    n = len(texts)
    if not n:
        return
    _, offs, data = texts.buffers()
    ends = np.frombuffer(offs, dtype=np.int64, count=texts.offset + n + 1)[texts.offset :]
    view = memoryview(data) if data is not None else memoryview(b"")
    at = 0
    while at < n:
        to = int(np.searchsorted(ends, ends[at] + most, side="right")) - 1
        to = min(n, max(to, at + 1))
        lo, hi = int(ends[at]), int(ends[to])
        yield at, to - at, bytes(view[lo:hi]), (ends[at : to + 1] - lo).tolist()
        at = to
