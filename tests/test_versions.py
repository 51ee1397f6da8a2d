"""Versioned month folders: edits, stops within them, pruning behind the published name."""

import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from reviewmill.plans import actions, adhoc, reports
from reviewmill.schema import REVIEW, conform
from reviewmill.sources import versions

JAN, FEB, MAR = datetime(2024, 1, 10), datetime(2024, 2, 10), datetime(2024, 3, 10)
NOW = datetime(2024, 6, 1)


def reviews(spark, rows):
    """(id, time, rating) as reviews."""
    schema = "id string, timestamp timestamp, rating int"
    rows = spark.createDataFrame(rows, schema).withColumns(
        {"company": F.concat(F.lit("C"), "rating"), "company_id": F.lit(1), "created_at": F.lit(NOW), "content": F.lit("x")}
    )
    return conform(rows, REVIEW)


def batch(spark, rows):
    return reviews(spark, rows).select("id", "timestamp", "rating", "company", "company_id")


def plan(df):
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "10000")
    return df._jdf.queryExecution().executedPlan().toString()


def read(spark, name):
    return sorted((r.id, r.timestamp, r.rating) for r in spark.table(name).collect())


@pytest.fixture
def store(spark, tmp_path, request):
    name = f"rv_{abs(hash(request.node.name))}"
    rows = [("a", JAN, 1), ("b", JAN, 2), ("c", FEB, 3), ("d", FEB, 4), ("e", MAR, 5), ("n", None, 1)]
    yield versions.create(spark, str(tmp_path / "store"), name, reviews(spark, rows))
    spark.sql(f"DROP FUNCTION {name}s_between")
    spark.sql(f"DROP VIEW {name}")
    spark.sql(f"DROP VIEW {name}_months")


def edits(spark, store):
    moved = batch(spark, [("a", MAR, 9), ("z", FEB, 9), ("c", datetime(2024, 1, 1), 9)])
    return {
        "insert": lambda: versions.insert(store, batch(spark, [("x", FEB, 7), ("y", None, 8)]), batch_ts=F.lit(NOW)),
        "update": lambda: versions.update(store, batch(spark, [("a", MAR, 9), ("q", JAN, 9)])),
        "upsert": lambda: versions.upsert(store, moved, batch_ts=F.lit(NOW)),
        "delete": lambda: versions.delete(store, spark.createDataFrame([("c",), ("d",), ("q",), ("n",)], "id string")),
        "compact": lambda: versions.compact(store, most_folders=0),
    }


OLD = [("a", JAN, 1), ("b", JAN, 2), ("c", FEB, 3), ("d", FEB, 4), ("e", MAR, 5)]
NEW = {
    "insert": [*OLD, ("x", FEB, 7)],
    "update": [("a", MAR, 9), *OLD[1:]],
    "upsert": [("a", MAR, 9), *OLD[1:], ("z", FEB, 9)],
    "delete": [OLD[0], OLD[1], OLD[4]],
    "compact": OLD,
}
UNDATED = {"insert": [("n", 1), ("y", 8)], "delete": []}
TOUCHED = {
    "insert": [None, "2024-02"],
    "update": ["2024-01", "2024-03"],
    "upsert": ["2024-01", "2024-02", "2024-03"],
    "delete": [None, "2024-02"],
    "compact": [None, "2024-01", "2024-02", "2024-03"],
}


def state(spark, name):
    rows = spark.table(name)
    return read(spark, name) if rows.where("timestamp IS NULL").isEmpty() else (
        sorted((r.id, r.timestamp, r.rating) for r in rows.where("timestamp IS NOT NULL").collect()),
        sorted((r.id, r.rating) for r in rows.where("timestamp IS NULL").collect()),
    )


def wanted(edit=None):
    dated, undated = (NEW[edit], UNDATED.get(edit, [("n", 1)])) if edit else (OLD, [("n", 1)])
    return (sorted(dated), undated) if undated else sorted(dated)


@pytest.mark.parametrize("edit", list(NEW))
def test_edits_and_stops_after_each_step(spark, store, monkeypatch, edit):
    class Stopped(Exception):
        pass

    def stopping(step):
        def run(*args):
            getattr(versions, f"real{step}")(*args)
            raise Stopped

        return run

    assert state(spark, store.name) == wanted()
    for step in ("_write_data", "_write_counts", "_write_state"):
        with monkeypatch.context() as patch:
            patch.setattr(versions, f"real{step}", getattr(versions, step), raising=False)
            patch.setattr(versions, step, stopping(step))
            with pytest.raises(Stopped):
                edits(spark, store)[edit]()
        assert state(spark, store.name) == wanted()  # what was written is not part of the table
    with monkeypatch.context() as patch:
        patch.setattr(versions, "real_publish", versions._publish, raising=False)
        patch.setattr(versions, "_publish", stopping("_publish"))
        with pytest.raises(Stopped):
            edits(spark, store)[edit]()
    assert state(spark, store.name) == wanted(edit)
    left = {f.version for f in versions.folders(store)}
    assert versions.vacuum(store, older_than_hours=0) > 0
    assert state(spark, store.name) == wanted(edit) and {f.version for f in versions.folders(store)} == left


@pytest.mark.parametrize("edit", list(NEW))
def test_only_touched_months_are_written(spark, store, edit):
    before = {f.version: f.month for f in versions.folders(store)}
    assert edits(spark, store)[edit]() == TOUCHED[edit]
    after = {f.version: f.month for f in versions.folders(store)}
    kept = {month for month in before.values() if month not in TOUCHED[edit]}
    assert {before[v] for v in before.keys() & after.keys()} >= kept
    if edit == "insert":  # nothing is written again, folders are added
        assert before.keys() < after.keys()
    assert sum(f.n_rows for f in versions.folders(store)) == spark.table(store.name).count()
    assert state(spark, store.name) == wanted(edit)
    if edit in ("update", "upsert", "delete"):  # repeating an edit changes nothing
        edits(spark, store)[edit]()
        assert state(spark, store.name) == wanted(edit)


def test_a_reader_keeps_the_state_it_began_with(spark, store):
    before = spark.table(store.name)
    edits(spark, store)["delete"]()
    assert before.count() == 6 and spark.table(store.name).count() == 3


def test_inserting_known_or_repeated_keys_is_an_error(spark, store):
    for rows in ([("a", JAN, 1)], [("x", JAN, 1), ("x", FEB, 2)]):
        with pytest.raises(ValueError, match="Duplicate key"):
            versions.insert(store, batch(spark, rows))
    assert state(spark, store.name) == wanted()


def test_an_edit_over_another_state_stops(spark, store, monkeypatch):
    write = versions._write_state

    def meanwhile(*args):
        monkeypatch.setattr(versions, "_write_state", write)
        edits(spark, store)["insert"]()
        return write(*args)

    monkeypatch.setattr(versions, "_write_state", meanwhile)
    with pytest.raises(RuntimeError, match="edited meanwhile"):
        edits(spark, store)["delete"]()
    assert state(spark, store.name) == wanted("insert")


def test_everything_deleted_and_inserted_again(spark, store):
    rows = reviews(spark, [(k, t, r) for k, t, r in OLD])
    versions.delete(store, spark.table(store.name).select("id"))
    assert spark.table(store.name).count() == 0 and versions.folders(store) == []
    assert spark.sql(f"SELECT * FROM {store.name}s_between()").count() == 0
    versions.insert(store, rows)
    assert read(spark, store.name) == OLD
    assert versions.delete(store, spark.createDataFrame([], "id string")) == []


def test_folders_of_a_month_are_put_together(spark, store):
    for i in range(4):
        versions.insert(store, batch(spark, [(f"x{i}", FEB, 7)]))
    assert versions.compact(store, most_folders=5) == []
    assert versions.compact(store, most_folders=4) == ["2024-02"]
    assert [f.month for f in versions.folders(store)].count("2024-02") == 1
    assert spark.table(store.name).count() == 10


def test_months_are_pruned_behind_the_name(spark, store):
    dates = actions.Metadata(start_date="2024-02-05", end_date="2024-02-28")
    found = actions.select_reviews(store.name, dates)
    text = f"SELECT count(*) AS n FROM {store.name}s_between('2024-02-05', last => '2024-02-28')"
    for df in (found, adhoc.run_sql(spark, text)):
        filters = re.search(r"PartitionFilters: \[(.*?)\], PushedFilters", plan(df))[1]
        assert "month" in filters and ">= 2024-02" in filters and "<= 2024-02" in filters and "version" in filters
    assert sorted(r.id for r in found.collect()) == ["c", "d"] and found.columns == REVIEW.names
    assert adhoc.run_sql(spark, text).first().n == 2
    everything = spark.sql(f"SELECT * FROM {store.name}s_between()")
    assert everything.count() == 6 and everything.columns == REVIEW.names
    with pytest.raises(ValueError):
        adhoc.run_sql(spark, f"SELECT * FROM {store.name}s_between('2024-02-05', 1, 2)")


def test_created_tables_are_empty_and_typed(spark, tmp_path):
    for name in ("review", "company"):
        spark.catalog.dropTempView(name)  # temporary views of other tests hide stored ones
    store = versions.create_tables(spark, str(tmp_path))
    assert spark.table("review").count() == 0 and spark.table("company").count() == 0
    assert [f.dataType for f in spark.table("review").schema] == [f.dataType for f in REVIEW]
    versions.insert(store, reviews(spark, [(f"r{i}", JAN if i % 2 else MAR, 1) for i in range(5)]))
    assert spark.table("review").count() == 5
    assert versions.between(spark, "review", start_date="2023-01-01").count() == 5
    assert versions.between(spark, "review", "2024-03-01", "2024-03-31").count() == 3
    spark.sql("DROP FUNCTION reviews_between")
    for name in ("review", "review_months", "company"):
        spark.sql(f"DROP VIEW {name}")


def reports_of(rows, metadata):
    selected = actions.select_reviews(rows, metadata)
    made = {name: reports.report(selected, name, metadata.companies) for name in reports.REPORTS}
    made["bars"] = reports.company_star_bars(selected)
    made["diverging"] = reports.diverging_counts(selected)
    return {name: sorted(map(repr, df.collect())) for name, df in made.items()}


def test_reports_over_the_cube_equal_those_over_the_table(spark, store):
    rows = [(f"k{i}", datetime(2023, 1 + i % 12, 2 + i % 2, *((0, 0) if i % 3 else (i % 24, i % 60))), 1 + i % 5) for i in range(300)]
    versions.insert(store, reviews(spark, rows).withColumn("category", (F.col("rating") * 7 % 6 - 1).cast("int")))
    versions.upsert(store, batch(spark, [(f"k{i}", datetime(2024, 1, 1 + i % 3), 1 + i % 4) for i in range(0, 300, 7)]), batch_ts=F.lit(NOW))
    versions.delete(store, spark.range(0, 300, 11).select(F.concat(F.lit("k"), "id").alias("id")))
    table, cube = spark.table(store.name), versions.cube(spark, store.name)
    assert cube.agg(F.sum("n_reviews")).first()[0] == table.count() and cube.count() < table.count()
    for metadata in (
        actions.Metadata(),
        actions.Metadata(["C1", "C3"], "2023-04-02", "2023-05-03"),
        actions.Metadata(start_date="2023-06-01", end_date="2023-09-03", categories=["counseling"]),
        actions.Metadata(["nobody"]),
    ):
        assert reports_of(cube, metadata) == reports_of(table, metadata)
    part = versions.cube(spark, store.name, "2023-04-02", "2023-05-03")
    assert "month" in plan(part) and reports_of(part, actions.Metadata(None, "2023-04-02", "2023-05-03")) == reports_of(
        table, actions.Metadata(None, "2023-04-02", "2023-05-03")
    )
