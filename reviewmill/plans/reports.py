"""The rating reports. Each is one lazy plan over the selected reviews."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from reviewmill.fixed_values import (
    REPORT_CATEGORY_STARS,
    REPORT_COMPANY_STARS,
    REPORT_COMPARE_SERIES,
    REPORT_LABELS,
    REPORT_RATING_SERIES,
    REPORT_RATING_SHARE,
    STARS,
)
from reviewmill.functions.codes import category_label
from reviewmill.functions.text import axis_label, bar_label
from reviewmill.operators.periods import fill_gaps, with_periods

REVIEWS = "n_reviews"  # of a row of a cube (sources.versions.cube), which may take the place of reviews


def _count(df: DataFrame, test: Column | None = None) -> Column:
    """Reviews that pass a test; a row of a cube stands for ``n_reviews`` of them."""
    if REVIEWS not in df.columns:
        return F.count("*") if test is None else F.count_if(test)
    counted = F.col(REVIEWS) if test is None else F.when(test, F.col(REVIEWS))
    return F.coalesce(F.sum(counted), F.lit(0).cast("bigint"))


def _mean(df: DataFrame) -> Column:
    if REVIEWS not in df.columns:
        return F.avg("rating")
    rated = F.sum(F.when(F.col("rating").isNotNull(), F.col(REVIEWS)))
    return F.sum(F.col("rating") * F.col(REVIEWS)) / rated


def _star_counts(df: DataFrame) -> list[Column]:
    return [_count(df, F.col("rating") == s).alias(f"stars_{s}") for s in STARS]


def _percent(part: Column, whole: Column, digits: int) -> Column:
    """Half-even rounded percentage; NULL when there is nothing to divide by."""
    return F.when(whole != 0, F.bround(part / whole * 100, digits))


def _of_companies(df: DataFrame, companies: Sequence[str]) -> DataFrame:
    return df.where(F.col("company").isin(list(companies))) if companies else df


def rating_share(df: DataFrame, companies: Sequence[str] = ()) -> DataFrame:
    """Count and percentage (1 digit) of each rating, in rating order."""
    counts = df.where("rating IS NOT NULL").groupBy("rating").agg(_count(df).alias("count"))
    total = F.sum("count").over(Window.partitionBy())  # one row per rating value
    return counts.select(
        "rating", "count", _percent(F.col("count"), total, 1).alias("percentage")
    ).sortWithinPartitions("rating")  # the window left a single partition


def category_stars(df: DataFrame, companies: Sequence[str] = ()) -> DataFrame:
    """Star counts of the five labelled categories; all labels appear, in label order."""
    codes = F.array(*[F.lit(code) for _, code in REPORT_LABELS])
    # One row without a rating per label, so that labels without reviews are counted as 0.
    labels = df.sparkSession.range(1).select(
        F.explode(codes).alias("category"), F.lit(None).cast("int").alias("rating")
    )
    measures = [c for c in ("category", "rating", REVIEWS) if c in df.columns]
    rated = df.where(F.col("category").isin([code for _, code in REPORT_LABELS])).select(*measures)
    counts = (
        rated.unionByName(labels, allowMissingColumns=True)
        .groupBy(F.col("category").alias("category_code"))
        .agg(*_star_counts(df), _count(df, F.col("rating").isNotNull()).alias("total"))
    )
    # At most one row per label is left.
    return (
        counts.withColumn("category", category_label(F.col("category_code")))
        .select("category_code", "category", *[f"stars_{s}" for s in STARS], "total")
        .coalesce(1)
        .sortWithinPartitions("category_code")
    )


def rating_series(
    df: DataFrame, companies: Sequence[str] = (), granularity: str | None = None
) -> DataFrame:
    """Mean, star counts and star percentages (2 digits) per period, without gaps."""
    stars = [f"stars_{s}" for s in STARS]
    per_period = (
        with_periods(df, df, granularity)
        .groupBy("granularity", "period_start")
        .agg(
            _mean(df).alias("mean_rating"),
            *_star_counts(df),
            _count(df, F.col("rating").between(0, 5)).alias("rated"),
        )
    )
    filled = fill_gaps(per_period, ["mean_rating", *stars, "rated"])
    return filled.select(
        "period",
        F.coalesce("mean_rating", F.lit(0.0)).alias("mean_rating"),
        *stars,
        *[_percent(F.col(f"stars_{s}"), F.col("rated"), 2).alias(f"pct_stars_{s}") for s in STARS],
    ).sortWithinPartitions("period")  # the window left a single partition


def diverging_counts(
    df: DataFrame, companies: Sequence[str] = (), granularity: str | None = None
) -> DataFrame:
    """Star counts per period in long form, one and two stars negative."""
    series = rating_series(df, companies, granularity)
    bars = [
        F.struct(
            F.lit(s).alias("rating"),
            (-F.col(f"stars_{s}") if s <= 2 else F.col(f"stars_{s}")).alias("signed_count"),
        )
        for s in STARS
    ]
    return series.select("period", F.inline(F.array(*bars)))


def compare_series(
    df: DataFrame, companies: Sequence[str] = (), granularity: str | None = None
) -> DataFrame:
    """Mean (1 digit, and 2 digits for drawing) and count per company and period.

    Every company has its own calendar, from its first to its last period; the granularity
    is that of the whole selection.
    """
    per_period = (
        with_periods(_of_companies(df, companies), df, granularity)
        .where("company IS NOT NULL")
        .groupBy("company", "granularity", "period_start")
        .agg(_mean(df).alias("mean"), _count(df, F.col("rating").isNotNull()).alias("count"))
    )
    filled = fill_gaps(per_period, ["mean", "count"], keys=["company"])
    mean = F.coalesce("mean", F.lit(0.0))
    return filled.select(
        "company",
        "period",
        F.bround(mean, 1).alias("mean"),
        F.bround(mean, 2).alias("trace_mean"),
        "count",
    )


def _company_totals(df: DataFrame, companies: Sequence[str]) -> DataFrame:
    return (
        _of_companies(df, companies)
        .where("company IS NOT NULL")
        .groupBy("company")
        .agg(*_star_counts(df), _count(df, F.col("rating").isNotNull()).alias("count"), _mean(df).alias("mean"))
    )


def company_stars_pct(df: DataFrame, companies: Sequence[str] = ()) -> DataFrame:
    """Percentage (1 digit) of each star per company."""
    return _company_totals(df, companies).select(
        "company",
        *[_percent(F.col(f"stars_{s}"), F.col("count"), 1).alias(f"pct_stars_{s}") for s in STARS],
    )


def company_star_bars(df: DataFrame, companies: Sequence[str] = ()) -> DataFrame:
    """One row per company and star given: count, share and label."""
    bars = [
        F.struct(F.lit(s).alias("rating"), F.col(f"stars_{s}").alias("star_count")) for s in STARS
    ]
    long = (
        _company_totals(df, companies)
        .select("company", F.col("count").alias("total"), F.inline(F.array(*bars)))
        .where("star_count > 0")
    )
    share = F.col("star_count") / F.col("total")
    return long.select(
        "company",
        "rating",
        F.col("star_count").alias("count"),
        share.alias("pct"),
        bar_label(share, F.col("star_count")).alias("label"),
    )


def company_summary(df: DataFrame, companies: Sequence[str] = ()) -> DataFrame:
    """Mean (2 digits), number of reviews and axis label per company."""
    return _company_totals(df, companies).select(
        "company",
        F.bround("mean", 2).alias("mean"),
        "count",
        axis_label(F.col("company"), F.col("mean"), F.col("count")).alias("axis_label"),
    )


Report = Callable[..., DataFrame]

REPORTS: dict[str, Report] = {
    REPORT_RATING_SERIES: rating_series,
    REPORT_CATEGORY_STARS: category_stars,
    REPORT_RATING_SHARE: rating_share,
    REPORT_COMPARE_SERIES: compare_series,
    REPORT_COMPANY_STARS: company_stars_pct,
}


def report(df: DataFrame, name: str, companies: Sequence[str] = ()) -> DataFrame:
    """The report of that name over the selected reviews."""
    if name not in REPORTS:
        raise ValueError(f"Unknown report: {name}")
    return REPORTS[name](df, companies)
