from datetime import datetime

import pytest
from pyspark.sql import functions as F

from reviewmill.functions import codes, dates
from reviewmill.operators import filters

ROWS = [
    ("1", "A", datetime(2024, 1, 1), 5, 0, "x"),
    ("2", "A", datetime(2024, 1, 2), 4, 1, "y"),
    ("3", "B", datetime(2024, 1, 3, 0, 0), 3, 4, "z"),
    ("4", "B", datetime(2024, 1, 3, 0, 1), 2, None, None),
    ("5", "C", datetime(2024, 1, 3, 0, 1), 1, -1, ""),
]


@pytest.fixture
def reviews(spark):
    return spark.createDataFrame(
        ROWS, "id string, company string, timestamp timestamp, rating int, category int, content string"
    )


def ids(df):
    return [r.id for r in df.collect()]


def test_equals_skips_absent_values_but_not_zero(reviews):
    assert ids(reviews.where(filters.equals_predicate({"company": "", "rating": None}))) == list("12345")
    assert ids(reviews.where(filters.equals_predicate({"category": 0}))) == ["1"]
    assert ids(reviews.where(filters.equals_predicate({"company": "B", "rating": 3}))) == ["3"]


def test_membership_any_all_and_empty(reviews):
    members = {"company": ["A"], "category": [4, 1], "rating": []}
    assert ids(reviews.where(filters.membership_predicate(members))) == ["1", "2", "3"]
    assert ids(reviews.where(filters.membership_predicate(members, "all"))) == ["2"]
    assert ids(reviews.where(filters.membership_predicate({"company": []}))) == list("12345")
    with pytest.raises(ValueError):
        filters.membership_predicate(members, "some")


def test_end_date_means_its_midnight(reviews):
    assert ids(reviews.where(filters.date_predicate("2024-01-02", "2024-01-03"))) == ["2", "3"]
    assert ids(reviews.where(filters.date_predicate(None, "2024-01-01"))) == ["1"]
    assert ids(reviews.where(filters.date_predicate("2024-01-03", ""))) == ["3", "4", "5"]
    assert ids(reviews.where(filters.date_predicate())) == list("12345")


def test_search_orders_newest_first_and_limits(reviews):
    found = filters.review_search(reviews, cols=["id", "timestamp"], limit=3)
    assert ids(found) == ["4", "5", "3"]
    wide = filters.review_search(reviews, cols=["id", "content"], limit=2)
    assert [tuple(r) for r in wide.collect()] == [("4", None), ("5", "")]
    assert filters.review_search(reviews, members={"company": ["B"]}).columns == reviews.columns


def test_request_predicate_maps_category_names(reviews):
    found = reviews.where(filters.review_predicate(categories=["Customer service", "Gebyrer/renter"]))
    assert ids(found) == ["2", "3"]
    with pytest.raises(ValueError):
        filters.review_predicate(categories=["weather"])


def test_paging(reviews, spark):
    assert ids(filters.page(reviews, offset=1, limit=2)) == ["2", "3"]
    assert ids(filters.page_after(reviews, "3", limit=1)) == ["4"]
    assert ids(filters.page_after(reviews, limit=1)) == ["1"]
    assert ids(filters.lookup(reviews, "4")) == ["4"]
    wanted = spark.createDataFrame([("5",), ("1",), ("1",), ("9",)], "id string")
    assert sorted(ids(filters.lookup_many(reviews, wanted))) == ["1", "5"]


def test_codes(spark):
    df = spark.sql("SELECT explode(array(-1, 0, 1, 4, 9, NULL)) AS c").select(
        codes.category_name(F.col("c")).alias("name"), codes.category_label(F.col("c")).alias("label")
    )
    assert [tuple(r) for r in df.collect()] == [
        ("other", ""), ("other", "Andet"), ("customer service", "Kundeservice"),
        ("fees and interest rates", "Gebyrer/renter"), (None, None), ("other", None),
    ]


def test_lenient_dates(spark):
    given = ["2023-01-02", "2023-02", "1/5/2023", "20230105", "5 January 2023", "2023-01-02 10:00:00", "", "soon", None]
    given += ["2023-1-5", "Jan 5, 2023", "2023-01-05T10:00:00Z", "05-01-2023", "2023-01-05 10:00:00.123+02:00", "5 Jan 2023"]
    df = spark.createDataFrame([(t,) for t in given], "t string")
    got = [None if r.d is None else r.d.isoformat() for r in df.select(dates.parse_date(F.col("t")).alias("d")).collect()]
    assert got == ["2023-01-02", "2023-02-01", "2023-01-05", "2023-01-05", "2023-01-05", "2023-01-02", None, None, None, *["2023-01-05"] * 3, "2023-05-01", "2023-01-05", "2023-01-05"]


def test_epoch_milliseconds_round_half_to_even(spark):
    df = spark.sql("SELECT timestamp_micros(x) AS t FROM VALUES (1500), (2500), (2600), (-1) AS v(x)")
    assert [r.ms for r in df.select(dates.epoch_ms(F.col("t")).alias("ms")).collect()] == [2, 2, 3, 0]


def test_filter_text_leaves_out_absent_parts(spark):
    df = spark.createDataFrame(
        [(["A'b"], [1, 2], "2024-01-01", "2024-02-01"), ([], [], "", "2024-02-01"), ([], [], "", "")],
        "c array<string>, k array<int>, s string, e string",
    ).select(filters.filter_text(F.col("c"), F.col("k"), F.col("s"), F.col("e")).alias("f"))
    assert [r.f for r in df.collect()] == [
        "company IN ('A''b') AND category IN (1, 2) AND timestamp BETWEEN '2024-01-01' AND '2024-02-01'",
        "timestamp <= '2024-02-01'",
        "",
    ]
