"""Messages of conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def without_plots(messages: DataFrame) -> DataFrame:
    """Messages other than plots."""
    return messages.where("role != 'plot'")


def last_messages(messages: DataFrame, n: int = 3) -> DataFrame:
    """The last ``n`` non-plot messages of every conversation, numbered in their order.

    The rank filter limits each conversation before the shuffle.
    """
    newest = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    kept = (
        without_plots(messages)
        .withColumn("_rn", F.row_number().over(newest))
        .where(F.col("_rn") <= n)
        .drop("_rn")
    )
    in_order = Window.partitionBy("conv_id").orderBy("turn")
    return kept.withColumn("position", F.row_number().over(in_order))


def last_by_role(messages: DataFrame) -> DataFrame:
    """The last text of each role in each conversation."""
    return messages.groupBy("conv_id", "role").agg(F.max_by("text", "turn").alias("text"))


def role_map(messages: DataFrame) -> DataFrame:
    """One map per conversation: role to last text."""
    last = last_by_role(messages)
    pairs = F.array_sort(F.collect_list(F.struct("role", "text")))  # one entry per role
    return last.groupBy("conv_id").agg(F.map_from_entries(pairs).alias("messages"))


def latest_question(messages: DataFrame) -> DataFrame:
    """Text of the last message of each conversation."""
    return messages.groupBy("conv_id").agg(F.max_by("text", "turn").alias("question"))
