"""What the physical plans look like."""

import re

import pytest
from pyspark.sql import functions as F

from reviewmill.catalog.queries import QUERIES
from reviewmill.operators import filters, joins, maintenance
from reviewmill.plans import reports
from reviewmill.schema import COMPANY, REVIEW, conform
from reviewmill.sources import fixtures, tables


def plan(df):
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "10000")
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, sf_dir, tmp_path_factory):
    rows = fixtures.order_reviews(spark, sf_dir).withColumn("content", F.col("company"))
    rows = conform(rows, REVIEW).withColumn("created_at", F.lit("2024-01-01").cast("timestamp"))
    return tables.write_reviews(rows, str(tmp_path_factory.mktemp("plans") / "review"))


@pytest.mark.parametrize("name", sorted(reports.REPORTS))
def test_reports_read_only_what_they_need(spark, stored, name):
    text = plan(reports.report(tables.read_reviews(spark, stored), name))
    columns = set(re.findall(r"(\w+):", ",".join(re.findall(r"ReadSchema: struct<([^>]*)>", text))))
    assert columns <= {"company", "timestamp", "rating", "category"}


def test_filters_reach_the_scan(spark, stored):
    test = filters.review_predicate(["NATION_1"], ["counseling"], "1996-01-01", "1996-12-31", mode="all")
    text = plan(tables.read_reviews(spark, stored, "1996-01-01", "1996-12-31").where(test))
    assert "GreaterThanOrEqual(timestamp,1996-01-01" in text and "EqualTo(company,NATION_1)" in text
    assert re.search(r"PartitionFilters: \[.*month", text)


def test_limited_search_sends_the_found_ids_to_the_scan(spark, stored):
    text = plan(filters.review_search(tables.read_reviews(spark, stored), cols=["id", "content"], limit=5))
    assert "PushedFilters: [In(id, [" in text and "Join" not in text


def test_larger_limits_are_a_top_n_over_narrow_rows(spark, stored, monkeypatch):
    monkeypatch.setattr(joins, "PUSHED_KEYS", 3)
    text = plan(filters.review_search(tables.read_reviews(spark, stored), cols=["id", "content"], limit=5))
    assert "BroadcastHashJoin [id" in text
    inner = text[text.index("BroadcastExchange") :]
    assert "TakeOrderedAndProject" in inner and "content" not in inner


def test_granularity_is_computed_once(spark, stored):
    df = reports.compare_series(tables.read_reviews(spark, stored))
    df.collect()
    final = plan(df).split("Initial Plan")[0]
    assert final.count("functions=[min(timestamp") == 1


def test_group_total_reuses_the_grouped_counts(spark, sf_dir):
    df = QUERIES["group_weights"](spark, sf_dir)
    df.collect()
    assert "ReusedExchange" in plan(df).split("Initial Plan")[0]


def test_small_company_table_is_broadcast(spark, sf_dir, stored):
    companies = conform(fixtures.companies(spark, sf_dir), COMPANY)
    text = plan(maintenance.with_company(tables.read_reviews(spark, stored), companies))
    assert "BroadcastHashJoin [company_id" in text and "Exchange hashpartitioning(company_id" not in text


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith("stream")))
def test_no_query_compares_all_pairs(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text
