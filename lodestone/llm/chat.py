"""Logged conversations: snapshots that a longer one begins with go, and what is left is rendered.

A chat that is logged after each exchange leaves a conversation for each prefix of it. Each turn gets a rolling hash of
all turns up to it (128 bits: the exclusive or of hashes of place, role and text, which is a prefix sum). A conversation whose
last hash is some longer conversation's hash at the same place is a snapshot of it and goes by an anti-join; of equal
conversations the smallest id stays. Prefix sums go over blocks of `block` turns and then over the blocks, so a
conversation with very many turns is spread over tasks too. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import scratch

BLOCK = 512
#: Roles as they are rendered; others are rendered under their own name.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: What a marker in a turn's own text is rendered as, so that no text can close its turn and open another; `<|` is how every marker begins.
MARKER, SHOWN = "<|", "<\\|"


def _plain(text: Column) -> Column:
    return F.replace(text, F.lit(MARKER), F.lit(SHOWN))


def _hashes(place: Column, role: Column, text: Column) -> list[Column]:
    # a null has a mark of its own, so it differs from the empty text
    parts = [place, F.coalesce(role, F.lit("\u0000")), role.isNull(), F.coalesce(text, F.lit("\u0000")), text.isNull()]
    return [F.xxhash64(F.lit(k), *parts) for k in (11, 23)]


def prefixes(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """conv_id, place (1, 2, ...), role, text, h1, h2: each turn with the hash of all turns up to it.

    Order: by turn (null first), then role and text, so that ties and repeated rows have an order of their own."""
    rows = turns.select(F.col(id_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text")).where("conv_id is not null")
    # blocks follow the turn numbers; equal numbers stay in one
    rows = rows.withColumn("block", F.floor(F.coalesce(F.col("turn"), F.lit(-1)) / block))
    inner = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text")
    sofar = inner.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)

    counts = rows.groupBy("conv_id", "block").agg(F.count("*").alias("c"))
    counts = counts.select("conv_id", "block", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("skipped"))
    placed = rows.withColumn("inner", F.row_number().over(inner)).join(counts, ["conv_id", "block"])
    placed = placed.withColumn("place", F.col("inner") + F.col("skipped"))
    one, two = _hashes(F.col("place"), F.col("role"), F.col("text"))
    placed = placed.select("conv_id", "block", "turn", "role", "text", "place", one.alias("x1"), two.alias("x2"))
    folded = placed.groupBy("conv_id", "block").agg(F.bit_xor("x1").alias("b1"), F.bit_xor("x2").alias("b2"))
    folded = folded.select("conv_id", "block", *(F.coalesce(F.bit_xor(c).over(before), F.lit(0).cast("long")).alias(c) for c in ("b1", "b2")))
    by_place = Window.partitionBy("conv_id", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = placed.withColumns({"s1": F.bit_xor("x1").over(by_place), "s2": F.bit_xor("x2").over(by_place)}).join(folded, ["conv_id", "block"])
    return out.select("conv_id", "place", "role", "text", F.col("s1").bitwiseXOR(F.col("b1")).alias("h1"), F.col("s2").bitwiseXOR(F.col("b2")).alias("h2"))


def maximal(turns: DataFrame, **columns) -> tuple[DataFrame, DataFrame]:
    """(the prefixes of all conversations, conv_id and n_turns of those that stay)."""
    each = scratch(prefixes(turns, **columns), "prefixes")
    sizes = each.groupBy("conv_id").agg(F.max("place").alias("n_turns"))
    last = each.join(sizes, "conv_id")
    ends = last.where("place = n_turns").select("conv_id", "n_turns", "h1", "h2")
    inner = last.where("place < n_turns").select(F.col("place").alias("n_turns"), "h1", "h2").distinct()
    first = ends.groupBy("n_turns", "h1", "h2").agg(F.min("conv_id").alias("conv_id"))
    return each, first.join(inner, ["n_turns", "h1", "h2"], "left_anti").select("conv_id", "n_turns")


def rendered(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    r"""conv_id, n_turns, chat: the maximal conversations, each as one text.

    A null role is rendered as `user` and a null text as an empty one, though they count as different when conversations
    are compared. Rows with a null conversation id are left out. Repeated rows are turns of their own. Turns need
    not begin at a certain number nor be without gaps: their order counts. A `<|` in a text or role is rendered as `<\|`, and line breaks in a role as a space, so that turns
    can't be forged. Conversations of very many turns are hashed in blocks; only the rows of one turn number are sorted together. Of equal conversations the smallest id
    stays. Other columns are not looked at. No rows give no rows."""
    each, stay = maximal(turns, id_col=id_col, turn_col=turn_col, role_col=role_col, text_col=text_col, block=block)
    role = F.regexp_replace(_plain(F.coalesce("role", F.lit("user"))), "[\\r\\n]+", " ")
    turn = F.concat(F.lit(OPEN), role, F.lit("\n"), _plain(F.coalesce("text", F.lit(""))), F.lit(CLOSE))
    kept = each.join(stay, "conv_id").select("conv_id", "n_turns", F.struct("place", turn.alias("turn")).alias("t"))
    chats = kept.groupBy("conv_id", "n_turns").agg(F.array_sort(F.collect_list("t")).alias("all"))
    return chats.select("conv_id", "n_turns", F.array_join(F.transform("all", lambda t: t["turn"]), "\n").alias("chat"))
