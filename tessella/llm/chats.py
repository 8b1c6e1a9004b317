"""Chat formatting (operator 8): cumulative-snapshot collapse, then rendering, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import stored


def render_turn(role: Column, text: Column) -> Column:
    """One turn of the rendered chat; markers inside a text are broken up so that they stay text."""
    safe = lambda c: F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("<|"), F.lit("< |"))
    return F.concat(F.lit("<|"), safe(role), F.lit("|>\n"), safe(text), F.lit("\n<|end|>\n"))


_FIRST = -(1 << 62)


def _turns(turns: DataFrame) -> DataFrame:
    number = F.coalesce(F.col("turn").cast("long"), F.lit(_FIRST)).alias("turn")
    return turns.where(F.col("conv_id").isNotNull()).select("conv_id", number, F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))


def _hash(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col("role").isNull(), "role", F.col("text").isNull(), "text")


def prefixes(turns: DataFrame) -> DataFrame:
    """A row for each prefix of each conversation: conv_id, n (its turns), a, b (its rolling hashes), last (is it the whole).

    The hash of a prefix is the exclusive or of its turns' hashes, each with the turn's place in it: a running
    window value, so a conversation of any length takes constant memory.
    """
    t = _turns(turns).select("conv_id", "turn", _hash(1).alias("a"), _hash(2).alias("b"))
    t = t.repartition("conv_id").dropDuplicates(["conv_id", "turn", "a", "b"])
    by = Window.partitionBy("conv_id").orderBy("turn", "a", "b")
    placed = t.withColumn("n", F.row_number().over(by)).withColumn("last", F.lead("n").over(by).isNull())
    h = placed.withColumn("a", F.xxhash64("n", "a")).withColumn("b", F.xxhash64("b", "n"))
    running = Window.partitionBy("conv_id").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return h.select("conv_id", "n", F.bit_xor("a").over(running).alias("a"), F.bit_xor("b").over(running).alias("b"), "last")


def collapse(turns: DataFrame) -> DataFrame:
    """Maximal conversations: conv_id, n_turns, n_copies, n_snapshots.

    A log that writes a conversation after every turn holds snapshots, each a prefix of a longer one. Conversations whose
    whole hash is that of a proper prefix of another are dropped by an anti-join. Of equal conversations the one of the
    least id stays; n_copies counts them. n_snapshots counts the dropped conversations that are prefixes of this one.

    Turns are ordered by number (null first); rows repeated in all four columns count once. A null text or role is a
    value of its own. Rows without conv_id belong to no conversation. Only hashes are shuffled and joined; equal
    conversations and equal prefixes are merged before any join.
    """
    rolled = stored(prefixes(turns), "prefixes")
    key = ["a", "b", "n"]
    whole = stored(rolled.where("last").groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies")), "conversations")
    proper = rolled.where(~F.col("last"))
    maximal = whole.join(proper.select(*key).distinct(), key, "left_anti")
    dropped = whole.select(*key, F.col("n_copies").alias("dropped"))
    absorbed = proper.join(dropped, key).groupBy("conv_id").agg(F.sum("dropped").alias("n_snapshots"))
    out = maximal.join(absorbed, "conv_id", "left")
    return out.select("conv_id", F.col("n").cast("long").alias("n_turns"), "n_copies", F.coalesce("n_snapshots", F.lit(0)).cast("long").alias("n_snapshots"))


def format_chats(turns: DataFrame) -> DataFrame:
    """The maximal conversations, rendered: conv_id, n_turns, n_copies, n_snapshots, chat.

    As collapse(); an empty table gives no rows. Each turn is rendered as a role marker, the text and an end
    marker. Texts travel once, after the anti-join. Further columns of `turns` are ignored.
    """
    kept = stored(collapse(turns), "maximal")
    turn = F.struct("turn", _hash(1).alias("a"), _hash(2).alias("b"), "role", "text")
    chats = _turns(turns).join(kept.select("conv_id"), "conv_id", "left_semi").groupBy("conv_id").agg(F.array_sort(F.collect_set(turn)).alias("turns"))
    chats = chats.select("conv_id", F.array_join(F.transform("turns", lambda x: render_turn(x["role"], x["text"])), "").alias("chat"))
    return kept.join(chats, "conv_id").select("conv_id", "n_turns", "n_copies", "n_snapshots", "chat")
