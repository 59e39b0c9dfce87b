"""Chat formatting after collapsing cumulative snapshots.

Logs often hold a conversation several times, once after every turn. A rolling hash of each prefix of turns
names all the states a conversation went through; a conversation whose whole state is a proper prefix of
another one is a snapshot and goes, and of equal conversations the one with the smallest id stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def render(turns: DataFrame, start: str = "<|im_start|>", end: str = "<|im_end|>", conv_col: str = "conv_id", turn_col: str = "turn",
           role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, n_turns, n_copies (equal conversations, itself included) and rendered, for every maximal conversation.

    Rows without a conversation id belong to no conversation and are left out. Repeated rows count once. Turns go by
    number (NULL first), then role and text; NULL role or text is empty. A conversation becomes one value, so it must
    fit a row; nothing else brings the rows of a key together: states and prefixes are reduced to distinct hashes
    before they are compared.
    """
    rows = turns.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text")).distinct()
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    # The place is part of each turn's hash, so the exclusive or of the hashes so far names the ordered prefix.
    placed = rows.withColumn("place", F.row_number().over(order))
    hashed = placed.select("conv_id", "place", F.xxhash64(F.lit(1), "place", "role", "text").alias("h"), F.xxhash64(F.lit(2), "text", "role", "place").alias("g"))
    states = hashed.select("conv_id", "place", *[F.bit_xor(c).over(Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)).alias(c) for c in ("h", "g")])
    last = states.groupBy("conv_id").agg(F.max(F.struct("place", "h", "g")).alias("s")).select("conv_id", F.col("s.place").alias("n_turns"), "s.h", "s.g")
    ends = last.groupBy("n_turns", "h", "g").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    lengths = last.select("conv_id", "n_turns")
    prefixes = (states.join(lengths, "conv_id").filter("place < n_turns").select(F.col("place").alias("n_turns"), "h", "g").distinct())
    maximal = ends.join(prefixes, ["n_turns", "h", "g"], "left_anti").select("conv_id", "n_turns", "n_copies")
    told = (placed.join(maximal, "conv_id").groupBy("conv_id", "n_turns", "n_copies")
            .agg(F.array_sort(F.collect_list(F.struct("place", "role", "text"))).alias("turns")))
    return told.select("conv_id", "n_turns", "n_copies", F.array_join(F.transform("turns", lambda t: F.concat(
        F.lit(start), t["role"], F.lit("\n"), t["text"], F.lit(f"{end}\n"))), "").alias("rendered"))
