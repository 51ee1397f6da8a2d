from datetime import date, datetime, timedelta

import pytest

from reviewmill.fixed_values import REPORT_LABELS
from reviewmill.functions import dates
from reviewmill.operators import periods
from reviewmill.plans import actions, reports

SCHEMA = "company string, timestamp timestamp, rating int, category int"


def frame(spark, rows):
    return spark.createDataFrame(
        [(c, datetime.fromisoformat(t), r, k) for c, t, r, k in rows], SCHEMA
    )


@pytest.mark.parametrize("name", sorted(reports.REPORTS))
def test_no_rows_give_an_empty_report(spark, name):
    df = reports.report(frame(spark, []), name)
    expected = len(REPORT_LABELS) if "category" in name else 0
    assert df.count() == expected


def test_unknown_report_is_an_error(spark):
    with pytest.raises(ValueError):
        reports.report(frame(spark, []), "pie")
    with pytest.raises(ValueError):
        actions.build_reports(frame(spark, []), actions.Metadata(), ["pie"])


def test_rating_share_rounds_to_one_digit(spark):
    rows = [("A", "2024-01-01", r, 0) for r in (1, 5, 5)]
    got = reports.rating_share(frame(spark, rows)).collect()
    assert [tuple(r) for r in got] == [(1, 1, 33.3), (5, 2, 66.7)]


def test_category_report_keeps_all_labels_and_leaves_out_unlabelled_rows(spark):
    rows = [("A", "2024-01-01", 5, 1), ("A", "2024-01-01", 1, None), ("A", "2024-01-01", 1, -1)]
    got = reports.category_stars(frame(spark, rows)).collect()
    assert [r.category for r in got] == [label for label, _ in REPORT_LABELS]
    assert [r.total for r in got] == [0, 1, 0, 0, 0]
    assert got[1].stars_5 == 1 and got[1].stars_1 == 0


def test_month_series_fills_gaps_with_zero_and_null_percent(spark):
    rows = [("A", "2023-01-31T23:30:00", 5, 0), ("A", "2023-01-01", 4, 0), ("A", "2023-08-15", 1, 0)]
    got = reports.rating_series(frame(spark, rows)).collect()
    assert [r.period for r in got] == [
        date(2023, m, d) for m, d in [(1, 31), (2, 28), (3, 31), (4, 30), (5, 31), (6, 30), (7, 31), (8, 31)]
    ]
    assert (got[0].mean_rating, got[0].stars_4, got[0].stars_5, got[0].pct_stars_5) == (4.5, 1, 1, 50.0)
    assert (got[1].mean_rating, got[1].stars_1, got[1].pct_stars_1) == (0.0, 0, None)


def test_week_closes_on_sunday_night(spark):
    sunday, monday = "2024-03-03T23:59:59.999", "2024-03-04T00:00:00"
    rows = [("A", "2024-01-10", 3, 0), ("A", sunday, 4, 0), ("A", monday, 5, 0)]
    got = reports.compare_series(frame(spark, rows)).collect()
    by_period = {r.period: (r["mean"], r["count"]) for r in got}
    assert by_period[date(2024, 3, 3)] == (4.0, 1)
    assert by_period[date(2024, 3, 10)] == (5.0, 1)
    assert min(by_period) == date(2024, 1, 14)
    assert by_period[date(2024, 2, 4)] == (0.0, 0)


@pytest.mark.parametrize(
    "span, expected",
    [
        (timedelta(days=44, hours=23, minutes=59), "day"),
        (timedelta(days=45), "week"),
        (timedelta(days=149, hours=23, minutes=59), "week"),
        (timedelta(days=150), "month"),
        (timedelta(0), "day"),
    ],
)
def test_granularity_follows_the_exact_span(spark, span, expected):
    start = datetime(2024, 1, 1, 12)
    rows = [("A", start.isoformat(), 3, 0), ("A", (start + span).isoformat(), 3, 0)]
    assert periods.pick_granularity(frame(spark, rows)).first()[0] == expected


def test_each_company_has_its_own_calendar(spark):
    rows = [
        ("A", "2024-01-02", 2, 0),
        ("A", "2024-01-05", 3, 0),
        ("B", "2024-01-10", 5, 0),
        ("C", "2024-01-10", 5, 0),
    ]
    got = reports.compare_series(frame(spark, rows), ["A", "B", "nobody"]).collect()
    assert sorted((r.company, r.period.day, r["count"]) for r in got) == [
        ("A", 2, 1), ("A", 3, 0), ("A", 4, 0), ("A", 5, 1), ("B", 10, 1)
    ]


def test_no_company_given_means_all(spark):
    rows = [("A", "2024-01-02", 2, 0), ("B", "2024-01-10", 5, 0)]
    assert {r.company for r in reports.company_stars_pct(frame(spark, rows)).collect()} == {"A", "B"}
    assert {r.company for r in reports.company_stars_pct(frame(spark, rows), ["B"]).collect()} == {"B"}


def test_granularity_uses_the_whole_selection_not_the_named_companies(spark):
    rows = [("A", "2024-01-02", 2, 0), ("A", "2024-01-05", 2, 0), ("B", "2024-12-10", 5, 0)]
    got = reports.compare_series(frame(spark, rows), ["A"]).collect()
    assert [r.period for r in got] == [date(2024, 1, 31)]


def test_means_round_half_to_even(spark):
    quarter = [("A", "2024-01-02", r, 0) for r in (1, 1, 1, 2)]  # 1.25 -> 1.2
    three = [("B", "2024-01-02", r, 0) for r in (1, 2, 2, 2)]  # 1.75 -> 1.8
    got = reports.compare_series(frame(spark, quarter + three)).collect()
    assert {r.company: r["mean"] for r in got} == {"A": 1.2, "B": 1.8}


def test_bars_and_labels(spark):
    rows = [("A", "2024-01-02", r, 0) for r in (5, 5, 1)]
    bars = reports.company_star_bars(frame(spark, rows)).collect()
    assert [(r.rating, r["count"], r.label) for r in bars] == [
        (1, 1, "% 33.3<br># 1"), (5, 2, "% 66.7<br># 2")
    ]
    assert reports.company_summary(frame(spark, rows)).first().axis_label == "A <br> ☆3.67 <br> #3"


def test_diverging_counts_are_negative_for_low_stars(spark):
    rows = [("A", "2024-01-02", r, 0) for r in (1, 2, 5)]
    got = reports.diverging_counts(frame(spark, rows)).collect()
    assert {r.rating: r.signed_count for r in got} == {1: -1, 2: -1, 3: 0, 4: 0, 5: 1}


def test_fixed_granularity_is_checked(spark):
    with pytest.raises(ValueError):
        reports.rating_series(frame(spark, []), granularity="year")
    assert dates.GRANULARITIES == ("day", "week", "month")
