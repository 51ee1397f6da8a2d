"""Seeded uniform and weighted samples, token budgets."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from reviewmill.fixed_values import PAYLOAD_TOKENS, TOKEN_SAMPLE_ROWS
from reviewmill.functions.hashing import exponential_key, seeded_uniform
from reviewmill.functions.text import Tokenizer, token_count
from reviewmill.operators.joins import sized
from reviewmill.operators.selection import lowest
from reviewmill.session import cut_lineage

GROUP = ("category", "company", "similarity_query")


def _uniform(seed: int, row_key: Sequence[str]) -> Column:
    return seeded_uniform(seed, *[F.col(c) for c in row_key])


def uniform_sample(
    df: DataFrame, n: int = TOKEN_SAMPLE_ROWS, seed: int = 0, row_key: Sequence[str] = ("id",)
) -> DataFrame:
    """Exactly min(n, rows) rows, each equally likely; the same rows on every run.

    The rows found stay in their tasks, however many they are.
    """
    return lowest(df, [_uniform(seed, row_key), *row_key], n)


def group_weights(df: DataFrame, group: Sequence[str] = GROUP) -> DataFrame:
    """Rows and share of the whole per group.

    The total is summed from the grouped counts, so the table is read once.
    """
    counts = df.groupBy(*group).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("weight", F.col("n") / total)


def _counts(df: DataFrame, group: Sequence[str]) -> DataFrame:
    """Rows of each group, written once."""
    named = [F.col(c).alias(f"_g_{c}") for c in group]
    return cut_lineage(df.groupBy(*group).agg(F.count("*").alias("_n")).select(*named, "_n"))


def _keyed(df: DataFrame, counts: DataFrame, seed: int, group: Sequence[str], row_key: Sequence[str]) -> DataFrame:
    """``df`` with the weighted ``sampling_key`` of every row; ``counts`` are broadcast if measured small."""
    same_group = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in group])
    key = exponential_key(_uniform(seed, row_key), F.col("_n"))
    return df.join(sized(counts), same_group).select(*df.columns, key.alias("sampling_key"))


def sampling_keys(
    df: DataFrame,
    seed: int = 0,
    group: Sequence[str] = GROUP,
    row_key: Sequence[str] = ("id",),
) -> DataFrame:
    """Row keys with their weighted sampling key: a row weighs as much as its group is large.

    The counts are written once and measured. If they are small they are broadcast, and no
    row is shuffled; otherwise the join on the group shuffles rows and a very large
    group is split at run time.
    """
    keys = df.select(*dict.fromkeys([*row_key, *group]))
    return _keyed(keys, _counts(df, group), seed, group, row_key).select(*row_key, "sampling_key")


def weighted_sample(
    df: DataFrame,
    n: int,
    seed: int = 0,
    group: Sequence[str] = GROUP,
    row_key: Sequence[str] = ("id",),
) -> DataFrame:
    """``n`` rows without replacement, weighted by the share of their group.

    The greatest sampling key of the sample is found by counting ranges of keys, which reads keys and
    groups only; the sample is then one filter of the table.
    """
    return _weighted(df, _counts(df, group), n, seed, group, row_key)


def _weighted(df: DataFrame, counts: DataFrame, n: int, seed: int, group: Sequence[str], row_key: Sequence[str]) -> DataFrame:
    keyed = _keyed(df, counts, seed, group, row_key)
    return lowest(keyed, ["sampling_key", *row_key], n).select(*df.columns)


def average_tokens(
    df: DataFrame,
    content: str = "content",
    seed: int = 0,
    row_key: Sequence[str] = ("id",),
    tokenizer: Tokenizer = token_count,
) -> DataFrame:
    """One row: mean number of tokens over a uniform sample."""
    sample = uniform_sample(df.select(*row_key, content), TOKEN_SAMPLE_ROWS, seed, row_key)
    return sample.agg(F.avg(tokenizer(F.col(content))).alias("avg_tokens"))


def sample_budget(
    df: DataFrame,
    max_tokens: int = PAYLOAD_TOKENS,
    content: str = "content",
    seed: int = 0,
    row_key: Sequence[str] = ("id",),
    tokenizer: Tokenizer = token_count,
) -> DataFrame:
    """One row: rows in the table, mean tokens, and how many rows the budget allows.

    If no sampled row has a token, a row counts as one, so the budget is never without end.
    """
    mean = average_tokens(df, content, seed, row_key, tokenizer).scalar()
    sized = df.agg(F.count("*").alias("n_rows")).withColumn("avg_tokens", mean)
    budget = F.when(F.col("avg_tokens") > 0, F.floor(F.lit(max_tokens) / F.col("avg_tokens"))).when(
        F.col("n_rows") > 0, F.lit(max_tokens).cast("bigint")
    )
    return sized.withColumn("budget", budget)


def representative_sample(
    df: DataFrame,
    max_tokens: int = PAYLOAD_TOKENS,
    content: str = "content",
    seed: int = 0,
    group: Sequence[str] = GROUP,
    row_key: Sequence[str] = ("id",),
    tokenizer: Tokenizer = token_count,
) -> DataFrame:
    """Rows that together have about ``max_tokens`` tokens; all rows if they fit.

    The budget (three numbers) is computed first, as it decides between the whole table
    and a sample of known size. Where the budget's sample has no token at all, at most
    ``max_tokens`` rows are returned.
    """
    counts = _counts(df, group)
    mean = average_tokens(df, content, seed, row_key, tokenizer).first().avg_tokens
    n_rows = counts.agg(F.sum("_n")).first()[0] or 0
    budget = math.floor(max_tokens / mean) if mean else max_tokens
    if budget > n_rows or not n_rows:
        return df
    return _weighted(df, counts, budget, seed, group, row_key)


def sample_requests(
    found: DataFrame,
    max_tokens: int = PAYLOAD_TOKENS,
    content: str = "content",
    seed: int = 0,
    group: Sequence[str] = GROUP,
    row_key: Sequence[str] = ("similarity_query", "id"),
    tokenizer: Tokenizer = token_count,
) -> DataFrame:
    """:func:`representative_sample` of every request's rows at once.

    ``found`` has the rows retrieved for each ``request_id``, whose number is bounded, so a request is sampled
    within one task. Each has the rows it would have alone.
    """
    request = Window.partitionBy("request_id")
    drawn = request.orderBy("_uniform", *row_key)
    tokens = F.when(F.col("_drawn") <= TOKEN_SAMPLE_ROWS, tokenizer(F.col(content)))
    rows = found.withColumn("_uniform", _uniform(seed, row_key)).withColumn("_drawn", F.row_number().over(drawn))
    rows = rows.withColumns(
        {
            "_mean": F.avg(tokens).over(request),
            "_rows": F.count("*").over(request),
            "_n": F.count("*").over(Window.partitionBy("request_id", *group)),
        }
    )
    budget = F.when(F.col("_mean") > 0, F.floor(F.lit(max_tokens) / F.col("_mean"))).otherwise(F.lit(max_tokens))
    weighted = request.orderBy(exponential_key(F.col("_uniform"), F.col("_n")), *row_key)
    rows = rows.withColumns({"_budget": budget, "_place": F.row_number().over(weighted)})
    return rows.where((F.col("_place") <= F.col("_budget")) | (F.col("_budget") > F.col("_rows"))).select(*found.columns)
