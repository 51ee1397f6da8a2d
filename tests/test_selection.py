"""The lowest rows and deep pages by range counts."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from reviewmill.operators import filters, sampling, selection

SCHEMA = "id string, n bigint, x double, t timestamp, note string"


def rows(n, seed=1):
    draw = random.Random(seed)
    start = datetime(2020, 1, 1)
    return [
        (
            "".join(draw.choices("abé€z0", k=draw.randrange(0, 6))),
            draw.choice([None, -5, 0, 7, 2**62, -(2**62), draw.randrange(-50, 50)]),
            draw.choice([0.0, 1e-300, -1e300, 1e300, draw.gauss(0, 1), None]),
            start + timedelta(seconds=draw.randrange(10**6)) if draw.random() < 0.9 else None,
            f"note {i % 7}",
        )
        for i in range(n)
    ]


def last(value, kind=0):
    return (value is None, value if value is not None else kind)


ORDERS = {
    "texts": (["id"], lambda r: (last(r[0], ""),)),
    "numbers": (["n"], lambda r: (last(r[1]),)),
    "doubles": (["x"], lambda r: (last(r[2]),)),
    "times": (["t"], lambda r: (last(r[3], datetime(2020, 1, 1)),)),
    "several": (["n", "id", "x"], lambda r: (last(r[1]), last(r[0], ""), last(r[2]))),
}


@pytest.mark.parametrize("name", ORDERS)
def test_lowest_against_sorting(spark, name):
    order, key = ORDERS[name]
    data = rows(300)
    df = spark.createDataFrame(data, SCHEMA).repartition(5).cache()
    # texts are ordered by their UTF-8 bytes, which for these signs is the order of Python
    ranked = sorted(data, key=key)
    for n in (1, 150, 299):
        found = [tuple(r) for r in selection.lowest(df, order, n, few=5).collect()]
        assert sorted(map(key, found)) == [key(r) for r in ranked[:n]]
        assert not Counter(map(repr, found)) - Counter(map(repr, data))
    again = selection.lowest(df.repartition(2), order, 37, few=5).collect()
    assert Counter(map(repr, again)) == Counter(map(repr, selection.lowest(df, order, 37, few=5).collect()))
    df.unpersist()


def test_pages_against_sorting(spark):
    data = [(f"k{random.Random(i).randrange(10**9)}", i, 0.0, None, "") for i in range(400)]
    df = spark.createDataFrame(data, SCHEMA).repartition(4)
    ranked = sorted(r[0] for r in data)
    for offset in (0, 150, 395, 1000):
        assert [r.id for r in selection.page(df, ["id"], offset, 10, few=20).collect()] == ranked[offset : offset + 10]
    pages = [r.id for offset in range(0, 400, 200) for r in filters.page(df, offset, 200).collect()]
    assert pages == ranked


def test_many_equal_rows(spark):
    df = spark.range(1000).select(F.lit("same").alias("id"), (F.col("id") % 3).alias("n"), F.lit("x").alias("note"))
    for n in (1, 400):
        assert selection.lowest(df, ["id"], n, few=50).count() == n
    assert selection.lowest(df, ["id", "n"], 400, few=50).groupBy("n").count().collect()[0]["count"] > 0
    assert [r.n for r in selection.page(df, ["id", "n"], 330, 10, few=20).collect()] == [0] * 4 + [1] * 6


def test_no_rows(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert selection.lowest(df, ["x", "id"], 5).count() == 0 and selection.page(df, ["id"], 50_000, 5).count() == 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_sample_of_a_million_rows_stays_in_its_tasks(spark):
    table = spark.range(3_000_000).select(
        F.col("id").cast("string").alias("id"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 50).cast("string")).alias("category"),
        F.lit("C").alias("company"),
        F.lit("q").alias("similarity_query"),
    )
    found = sampling.weighted_sample(table, 1_000_000, seed=3)
    text = plan(found)
    assert "TakeOrdered" not in text and "GlobalLimit" not in text and "SinglePartition" not in text
    counted = found.groupBy((F.col("category") == "hot").alias("hot")).count().collect()
    assert sum(r["count"] for r in counted) == 1_000_000
    assert {r.hot: r["count"] for r in counted}[True] > 600_000  # a third of the rows, most of the weight
    deep = filters.page(table, 2_500_000, 100)
    assert "SinglePartition" not in plan(deep) and deep.count() == 100
    ids = sorted(map(str, range(3_000_000)))
    assert [r.id for r in deep.collect()] == ids[2_500_000:2_500_100]
    assert sampling.uniform_sample(table, 700_000).count() == 700_000
