from datetime import datetime

import pytest
from pyspark.sql import functions as F

from reviewmill.operators import joins, maintenance
from reviewmill.plans import ingest
from reviewmill.schema import COMPANY, REVIEW, conform
from reviewmill.sources import tables

T1, T2, T3 = datetime(2024, 1, 1), datetime(2024, 1, 2), datetime(2024, 3, 5, 10)


def now():
    return F.lit("2024-06-01 00:00:00").cast("timestamp")


@pytest.fixture(params=[(1000, 1000), (-1, 1000), (-1, -1)], ids=["pushed", "broadcast", "shuffled"])
def sizes(request, monkeypatch):
    """All strategies: few keys sent to the scan, small sides broadcast, every side shuffled."""
    pushed, broadcast = request.param
    monkeypatch.setattr(joins, "PUSHED_KEYS", pushed)
    monkeypatch.setattr(joins, "BROADCAST_ROWS", broadcast)


def stored(spark):
    rows = [("a", 1, "A", T1, T1, "old", 5, 3, 1), ("b", 2, "B", T2, T1, "kept", 4, None, None)]
    return spark.createDataFrame(
        rows,
        "id string, company_id int, company string, timestamp timestamp, created_at timestamp, "
        "content string, rating int, likes int, category int",
    )


def batch(spark, rows):
    return spark.createDataFrame(rows, "id string, timestamp timestamp, rating int")


def test_upsert_sets_given_columns_and_defaults_new_rows(spark, sizes):
    got = maintenance.upsert(
        stored(spark), batch(spark, [("a", T3, 1), ("c", T2, 2), ("c", T3, 3)]), batch_ts=now()
    )
    rows = {r.id: r for r in got.collect()}
    assert set(rows) == {"a", "b", "c"} and got.columns == stored(spark).columns
    assert (rows["a"].rating, rows["a"].content, rows["a"].created_at) == (1, "old", T1)
    assert (rows["b"].rating, rows["b"].content) == (4, "kept")
    assert (rows["c"].rating, rows["c"].content, rows["c"].created_at) == (3, "", datetime(2024, 6, 1))
    assert rows["c"].company is None


def test_the_order_of_deliveries_does_not_matter(spark, sizes):
    deliveries = [[("a", T3, 1)], [("a", T2, 2), ("a", T2, 3)], [("n", T2, 4)], [("n", T1, 5), ("b", T1, 1)]]
    found = set()
    for order in ([0, 1, 2, 3], [3, 2, 1, 0], [1, 3, 0, 2]):
        table = stored(spark)
        for number in order:
            table = maintenance.upsert(table, batch(spark, deliveries[number]), batch_ts=now())
        found.add(tuple(sorted((r.id, r.timestamp, r.rating) for r in table.collect())))
    assert found == {(("a", T3, 1), ("b", T2, 4), ("n", T2, 4))}
    late = maintenance.upsert(stored(spark), batch(spark, [("a", datetime(2023, 1, 1), 1)]), version=None)
    assert {r.rating for r in late.where("id = 'a'").collect()} == {1}


def test_tied_versions_have_one_winner(spark, sizes):
    rows = [("n", T1, rating) for rating in range(1, 6)]
    found = {
        maintenance.upsert(stored(spark), batch(spark, rows[i:] + rows[:i]).repartition(i + 1)).where("id = 'n'").first().rating
        for i in range(5)
    }
    assert len(found) == 1


def test_set_null_overwrites(spark, sizes):
    change = spark.createDataFrame([("a", T1, None)], "id string, timestamp timestamp, likes int")
    rows = {r.id: r for r in maintenance.update(stored(spark), change).collect()}
    assert rows["a"].likes is None and rows["a"].rating == 5


def test_update_ignores_unknown_keys(spark, sizes):
    got = maintenance.update(stored(spark), batch(spark, [("a", T1, 2), ("z", T1, 2)]))
    assert {r.id: r.rating for r in got.collect()} == {"a": 2, "b": 4}


def test_insert_refuses_known_and_repeated_keys(spark, sizes):
    with pytest.raises(ValueError, match="Duplicate key: a"):
        maintenance.insert(stored(spark), batch(spark, [("a", T1, 2)]))
    with pytest.raises(ValueError, match="Duplicate key: n"):
        maintenance.insert(stored(spark), batch(spark, [("n", T1, 2), ("n", T2, 2)]))
    got = maintenance.insert(stored(spark), batch(spark, [("n", T1, 2)]), batch_ts=now())
    assert {r.id: r.content for r in got.collect()} == {"a": "old", "b": "kept", "n": ""}


def test_delete(spark, sizes):
    keys = spark.createDataFrame([("a",), ("a",), ("q",)], "id string")
    assert [r.id for r in maintenance.delete(stored(spark), keys).collect()] == ["b"]


def test_changed_compares_id_and_timestamp(spark, sizes):
    incoming = batch(spark, [("a", T1, 1), ("b", T3, 1), ("c", T1, 1)])
    assert sorted(r.id for r in maintenance.changed(incoming, stored(spark)).collect()) == ["b", "c"]
    older = batch(spark, [("b", T1, 1)])
    assert maintenance.changed(older, stored(spark)).count() == 0


def test_small_batch_does_not_shuffle_the_target(spark):
    change = batch(spark, [("a", T3, 1)])
    plan = maintenance.update(stored(spark), change)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_size_check_counts_bytes(spark):
    wide = spark.createDataFrame([("x" * 1000,)] * 10, "t string")
    nested = spark.createDataFrame([(["x" * 1000], ("y" * 500,))], "a array<string>, s struct<t:string>")
    assert joins.measure(nested).bytes > 1500
    assert joins.measure(wide) == (10, 10_000) and joins.measure(wide.limit(0)) == (0, 0)
    assert joins.Size(10, 10_000).small and joins.Size(10).few
    assert not joins.Size(joins.BROADCAST_ROWS + 1).small
    assert not joins.Size(10, joins.BROADCAST_BYTES + 1).small
    assert not joins.Size(joins.PUSHED_KEYS + 1).few


def test_reviews_are_stored_by_month_and_read_by_date(spark, tmp_path):
    path = tables.write_reviews(stored(spark), str(tmp_path / "v1"))
    found = tables.read_reviews(spark, path, "2024-01-01", "2024-01-31")
    assert found.schema.names == REVIEW.names and found.count() == 2
    assert "PartitionFilters: [isnotnull(month" in found._jdf.queryExecution().executedPlan().toString()
    assert tables.read_reviews(spark, path, "2024-02-01").count() == 0


def test_publish_switches_versions(spark, tmp_path):
    first = tables.write_reviews(stored(spark), str(tmp_path / "v1"))
    tables.publish(spark, "published_reviews", first)
    newer = maintenance.delete(
        conform(spark.table("published_reviews"), REVIEW), spark.createDataFrame([("a",)], "id string")
    )
    tables.publish(spark, "published_reviews", tables.write_reviews(newer, str(tmp_path / "v2")))
    assert [r.id for r in spark.table("published_reviews").collect()] == ["b"]


def test_new_companies_get_the_next_ids(spark):
    companies = conform(
        spark.createDataFrame([(7, "A", "a.dk", "DK")], "id int, name string, homepage string, country string"),
        COMPANY,
    )
    unit = (
        '{"displayName":"%s","identifyingName":"%s","stars":4.5,"trustScore":4.4,'
        '"numberOfReviews":3,"location":{"country":"DK"}}'
    )
    html = '<script type="application/json">{"props":{"pageProps":{"newestBusinessUnits":[%s]}}}</script>'
    listed = ",".join(unit % pair for pair in [("A new", "a.dk"), ("B", "b.dk"), ("C", "c.dk"), ("D", "d.dk")])
    pages = spark.createDataFrame([(1, html % listed)], "page_id long, html string")
    got = {r.homepage: (r.id, r.name) for r in ingest.ingest_companies(companies, pages).collect()}
    assert got == {"a.dk": (7, "A new"), "b.dk": (8, "B"), "c.dk": (9, "C"), "d.dk": (10, "D")}


def test_exported_tables_are_read_with_their_types(spark, tmp_path):
    (tmp_path / "company.csv").write_text(
        'id,name,homepage,country,embedding\n1,"A ""x"",\nB",a.dk,DK,"[0.5,-1]"\n2,C,c.dk,DK,\n'
    )
    got = tables.read_export(spark, str(tmp_path / "company.csv"), COMPANY).collect()
    assert [tuple(r) for r in got] == [(1, 'A "x",\nB', "a.dk", "DK", [0.5, -1.0]), (2, "C", "c.dk", "DK", None)]


def test_schemas_make_empty_tables(spark):
    assert tables.empty_table(spark, REVIEW).schema.names == REVIEW.names
