"""Periods of a selection: bounds, granularity, gap-free calendars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from reviewmill.functions.dates import (
    GRANULARITIES,
    granularity_of,
    period_label,
    period_start,
    period_starts,
)


def period_bounds(df: DataFrame, column: str = "timestamp") -> DataFrame:
    """One row: first and last timestamp of the selection; rows of a cube have a last one of their own."""
    last = "last_ts" if "last_ts" in df.columns else column
    return df.agg(F.min(column).alias("first_ts"), F.max(last).alias("last_ts"))


def pick_granularity(df: DataFrame, column: str = "timestamp") -> DataFrame:
    """One row: the granularity the span of the selection calls for."""
    chosen = granularity_of(F.col("first_ts"), F.col("last_ts"))
    return period_bounds(df, column).select(chosen.alias("granularity"))


def with_periods(
    df: DataFrame, selection: DataFrame, granularity: str | None = None, column: str = "timestamp"
) -> DataFrame:
    """Add ``granularity`` and ``period_start`` to the rows of ``df`` that have a timestamp.

    Without a fixed granularity it is that of ``selection``, found by a scalar subquery
    which reads the timestamp and the filter columns only; the plan stays lazy.
    """
    if granularity is not None and granularity not in GRANULARITIES:
        raise ValueError(f"Unknown granularity: {granularity}")
    chosen = F.lit(granularity) if granularity else pick_granularity(selection, column).scalar()
    return (
        df.where(F.col(column).isNotNull())
        .withColumn("granularity", chosen)
        .withColumn("period_start", period_start(F.col(column), F.col("granularity")))
    )


def fill_gaps(df: DataFrame, measures: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Add the missing periods between the first and last of each key, measures set to 0.

    ``df`` is aggregated by key, ``granularity`` and ``period_start``: at most one row per
    key and period, so a window holds no more rows than the calendar has days, however many
    reviews a key has. Each row is repeated for the empty periods up to the next one, which
    needs no join with a calendar.
    """
    order = Window.partitionBy(*keys).orderBy("period_start")
    following = F.date_sub(F.lead("period_start").over(order), 1)
    spans = df.withColumn("_last", F.coalesce(following, F.col("period_start")))
    starts = period_starts(F.col("period_start"), F.col("_last"), F.col("granularity"))
    filled = spans.select(
        *keys, *measures, "granularity", F.posexplode(starts).alias("_gap", "_start")
    )
    return filled.select(
        *keys,
        period_label(F.col("_start"), F.col("granularity")).alias("period"),
        *[
            F.when(F.col("_gap") == 0, F.col(m)).otherwise(F.lit(0)).alias(m)
            for m in measures
        ],
    )
