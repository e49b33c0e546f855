"""Chat formatting: collapse cumulative snapshots, then render.

A log often holds a conversation several times, each time some turns longer. Every turn
prefix gets a rolling 128-bit hash; a conversation whose whole hash is a proper prefix of
another one is dropped by an anti-join, equal conversations keep the smallest id, and only
the maximal conversations' texts are gathered and rendered. Hashes, not texts, are shuffled
until then. Functions of DataFrames only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Turn markers of the rendered form.
OPEN, CLOSE, END = "<|", "|>", "<|end|>"
UNKNOWN_ROLE = "unknown"


def _turn_hash(salt: int) -> Column:
    parts = []
    for name in ("role", "text"):
        parts += [F.col(name).isNull(), F.coalesce(F.col(name), F.lit(""))]
    return F.xxhash64(F.lit(salt), *parts)


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """(conv_id, position, n_turns, h1, h2): the hash of each conversation's first turns.

    Turns are ordered by ``turn``, then role, then text hash; a turn logged again word for
    word under the same number counts once. The hash of a prefix is the running exclusive-or
    of its turns' hashes, each salted with its position, twice with different salts.
    """
    hashed = turns.select("conv_id", "turn", "role", _turn_hash(1).alias("t1"), _turn_hash(2).alias("t2"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "t1", "t2")
    own = F.struct("turn", "role", "t1", "t2")
    once = hashed.withColumn("__before", F.lag(own).over(order)).filter(
        F.col("__before").isNull() | ~own.eqNullSafe(F.col("__before"))
    )
    placed = once.withColumn("position", F.row_number().over(order))
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.max("position").over(Window.partitionBy("conv_id"))
    return placed.select(
        "conv_id",
        "position",
        last.alias("n_turns"),
        F.bit_xor(F.xxhash64("position", "t1")).over(running).alias("h1"),
        F.bit_xor(F.xxhash64("position", "t2")).over(running).alias("h2"),
    )


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies) of conversations that no other one continues.

    Of equal conversations the smallest id stays (null is larger than any id) and
    ``n_copies`` counts all of them. Hot prefixes meet as one row per task.
    """
    prefixes = prefix_hashes(turns)
    whole = (
        prefixes.filter("position = n_turns")
        .groupBy("n_turns", "h1", "h2")
        .agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    )
    continued = (
        prefixes.filter("position < n_turns")
        .select(F.col("position").alias("n_turns"), "h1", "h2")
        .distinct()
    )
    kept = whole.join(continued, ["n_turns", "h1", "h2"], "left_anti")
    return kept.select("conv_id", "n_turns", "n_copies")


def formatted(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies, rendered) of the maximal conversations.

    ``turns`` has conv_id, turn, role and text; further columns don't matter. Null ids form
    one conversation, null turns come first, a null role is rendered as ``unknown``, a null
    text as empty. Markers inside texts are broken up by a blank, so that no text can open
    a turn. An empty table gives an empty result. The rendered row of a conversation is the
    one thing that grows with its length.
    """
    kept = maximal_conversations(turns).withColumnRenamed("conv_id", "__conv")
    role = F.coalesce("role", F.lit(UNKNOWN_ROLE))
    text = F.replace(F.coalesce("text", F.lit("")), F.lit(OPEN), F.lit("< |"))
    shown = F.concat(F.lit(OPEN), role, F.lit(CLOSE + "\n"), text, F.lit("\n" + END + "\n"))
    hashes = (_turn_hash(1).alias("t1"), _turn_hash(2).alias("t2"))
    message = F.struct("turn", "role", *hashes, shown.alias("shown"))
    lines = F.transform(F.array_sort(F.collect_set("__message")), lambda m: m["shown"])
    return (
        turns.select("conv_id", message.alias("__message"))
        .join(kept, F.col("conv_id").eqNullSafe(F.col("__conv")))
        .groupBy("conv_id", "n_turns", "n_copies")
        .agg(F.array_join(lines, "").alias("rendered"))
    )
