"""Period series against the calendar of pandas, on random reviews."""

import random
from datetime import datetime, timedelta

import pandas as pd
import pytest

from reviewmill.plans import reports

FREQUENCY = {"day": "D", "week": "W", "month": "ME"}


def random_reviews(seed, days, n):
    gen = random.Random(seed)
    start = datetime(2023, 11, 3) + timedelta(days=gen.randrange(60))
    edges = [timedelta(hours=23, minutes=59, seconds=59), timedelta(0), timedelta(hours=12)]
    return [
        (
            gen.choice("AB"),
            start + timedelta(days=gen.randrange(days)) + gen.choice(edges),
            gen.randint(1, 5),
            gen.choice([0, 1, None]),
        )
        for _ in range(n)
    ]


def expected(rows, granularity):
    frame = pd.DataFrame(rows, columns=["company", "timestamp", "rating", "category"])
    out = []
    for company, part in frame.groupby("company"):
        periods = part.groupby(pd.Grouper(key="timestamp", freq=FREQUENCY[granularity]))["rating"]
        means, counts = periods.mean().fillna(0).round(1), periods.count()
        out += [(company, p.date(), means[p], int(counts[p])) for p in counts.index]
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("days, granularity", [(40, "day"), (100, "week"), (900, "month")])
def test_compare_series(spark, seed, days, granularity):
    rows = random_reviews(seed, days, 25)
    df = spark.createDataFrame(rows, "company string, timestamp timestamp, rating int, category int")
    got = reports.compare_series(df, granularity=granularity).drop("trace_mean").collect()
    assert sorted(tuple(r) for r in got) == expected(rows, granularity)


@pytest.mark.parametrize("seed", range(3))
def test_rating_series_percentages(spark, seed):
    rows = random_reviews(seed, 400, 60)
    df = spark.createDataFrame(rows, "company string, timestamp timestamp, rating int, category int")
    frame = pd.DataFrame(rows, columns=["company", "timestamp", "rating", "category"])
    month = frame["timestamp"].dt.to_period("M")
    counts = pd.crosstab(month, frame["rating"]).reindex(
        pd.period_range(month.min(), month.max(), freq="M"), fill_value=0
    )
    share = (counts.div(counts.sum(axis=1), axis=0) * 100).round(2)
    got = reports.rating_series(df, granularity="month").toPandas()
    assert [p.strftime("%Y-%m") for p in got["period"]] == [str(p) for p in counts.index]
    for star in range(1, 6):
        if star in counts:
            assert got[f"stars_{star}"].tolist() == counts[star].tolist()
            assert got[f"pct_stars_{star}"].fillna(-1).tolist() == share[star].fillna(-1).tolist()
