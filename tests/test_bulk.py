"""Many requests in one job give what each gives alone."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from reviewmill.operators import neighbours
from reviewmill.plans import actions

REVIEW = "id string, company string, category int, timestamp timestamp, content string, embedding array<float>"


def table(spark):
    rows = []
    for i in range(120):
        vector = None if i % 11 == 0 else [float(i % 13), float(i % 7), float("nan") if i % 29 == 0 else 1.0]
        time = None if i % 17 == 0 else datetime(2023, 1 + i % 12, 1 + i % 28)
        rows.append((f"r{i}", f"C{i % 4}", None if i % 5 == 0 else i % 5 - 1, time, f"text {i} " * (i % 9), vector))
    return spark.createDataFrame(rows, REVIEW).repartition(4)


REQUESTS = [
    ("all", None, None, None, None),
    ("lists", [], [], "2023-03-01", None),
    ("company", ["C1", "C1", "C3"], None, None, "2023-09-01"),
    ("both", ["C2"], [1, 3], "2023-02-01", "2023-11-30"),
    ("category", None, [-1, 2], None, None),
    ("nothing", ["C9"], None, None, None),
    ("silent", ["C1"], None, None, None),
]
QUERIES = [
    *[(name, f"q{i}", [float(i), 2.0 * i, 1.0]) for name in ("all", "lists", "company", "both", "nothing") for i in range(3)],
    ("category", "q1", [1.0, 2.0, 1.0]),
    ("category", "no vector", None),
]


def frames(spark):
    requests = spark.createDataFrame(
        REQUESTS, "request_id string, companies array<string>, categories array<int>, start_date string, end_date string"
    )
    return requests, spark.createDataFrame(QUERIES, "request_id string, similarity_query string, q_embedding array<double>")


@pytest.mark.parametrize("held_bytes", [neighbours.REQUEST_BYTES, 200])
def test_retrieved_as_alone(spark, held_bytes):
    reviews = table(spark).cache()
    requests, queries = frames(spark)
    found = neighbours.retrieve_requests(requests, queries, reviews, total=12, held_bytes=held_bytes)
    got = sorted((tuple(r) for r in found.collect()), key=repr)
    wanted = []
    for name, companies, categories, start, end in REQUESTS:
        metadata = actions.Metadata(companies or (), start, end, categories or ())
        asked = queries.where(F.col("request_id") == name).drop("request_id")
        if asked.isEmpty():
            continue
        alone = neighbours.retrieve(asked, actions.select_reviews(reviews, metadata), total=12)
        wanted += [(name, *r) for r in alone.collect()]
    assert [r[:6] for r in got] == [r[:6] for r in sorted(wanted, key=repr)]
    assert len(got) == 60 and not {r[0] for r in got} & {"nothing", "silent"}
    reviews.unpersist()


@pytest.mark.parametrize("max_tokens", [30, 100_000])
def test_payloads_as_alone(spark, max_tokens):
    reviews = table(spark).cache()
    requests, queries = frames(spark)
    found = actions.analyse_requests(reviews, requests, queries, max_tokens, total=30, seed=5)
    got = {(r.request_id, r.company, r.category, r.similarity_query): r.reviews for r in found.collect()}
    wanted = {}
    for name, companies, categories, start, end in (REQUESTS[0], REQUESTS[3], REQUESTS[4]):
        asked = queries.where(F.col("request_id") == name).drop("request_id")
        metadata = actions.Metadata(companies or (), start, end, categories or ())
        alone = actions.analyse_reviews(reviews, asked, metadata, max_tokens, total=30, seed=5)
        wanted.update({(name, r.company, r.category, r.similarity_query): r.reviews for r in alone.collect()})
    assert {k: v for k, v in got.items() if k[0] in ("all", "both", "category")} == wanted and wanted
    reviews.unpersist()


def test_category_names_and_no_requests(spark):
    reviews = table(spark)
    requests, queries = frames(spark)
    named = requests.where("request_id = 'category'").withColumn("categories", F.array(F.lit("counseling")))
    codes = requests.where("request_id = 'category'").withColumn("categories", F.array(F.lit(2)))
    one, other = (sorted(actions.analyse_requests(reviews, r, queries).collect(), key=repr) for r in (named, codes))
    assert one == other and one
    assert actions.analyse_requests(reviews, requests.limit(0), queries).count() == 0


def test_more_queries_than_reviews_get_one_each(spark):
    queries = spark.range(7).select(F.col("id").cast("string").alias("similarity_query"), F.array(F.col("id").cast("double"), F.lit(1.0), F.lit(1.0)).alias("q_embedding"))
    assert neighbours.retrieve(queries, table(spark), total=3).count() == 7


def test_reviews_are_neither_shuffled_nor_repeated(spark):
    requests, queries = frames(spark)
    rows = requests.select("companies", "categories", F.col("start_date").cast("timestamp").alias("first"), F.col("end_date").cast("timestamp").alias("last")).collect()
    numbered = [neighbours.Row(number=i, **r.asDict()) for i, r in enumerate(rows)]
    meant = neighbours._reviews_of_requests(table(spark).coalesce(1), numbered, "id", "embedding")
    assert meant.select("_key").distinct().count() == meant.count() == 120
    plan = meant._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
