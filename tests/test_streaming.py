from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewmill.schema import REVIEW
from reviewmill.streaming import jobs, store

FACTS = T.StructType([REVIEW[c] for c in ("id", "company", "timestamp", "rating")])
STORED = T.StructType([*FACTS.fields, REVIEW["created_at"], REVIEW["content"], REVIEW["likes"]])
START = datetime(2024, 1, 1)


def deliveries():
    """Three files: some reviews are repeated, some come back edited with a later time."""
    def row(i, edit=0):
        return (f"r{i}", "AB"[i % 2], START + timedelta(hours=7 * i, minutes=edit), (i + edit) % 5 + 1)

    return [
        [row(i) for i in range(0, 20)],
        [row(i) for i in range(10, 30)] + [row(3, 1), row(3, 2)],
        [row(i) for i in range(25, 40)] + [row(30, 1)],
    ]


def final_state():
    newest = {}
    for file in deliveries():
        for r in file:
            if r[0] not in newest or r[2] > newest[r[0]][2]:
                newest[r[0]] = r
    return newest


def write(spark, path, files):
    for rows in files:
        spark.createDataFrame(rows, FACTS).coalesce(1).write.mode("append").parquet(path)


def run(spark, source, target, **options):
    jobs.ingest(
        jobs.read_files(spark, source, FACTS, files_per_batch=1), target, STORED, **options
    ).awaitTermination()
    return {r.id: r for r in store.read_current(spark, target, STORED, ["id"]).collect()}


def test_stream_upsert_equals_batch(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "store")
    write(spark, source, deliveries())
    got = run(spark, source, target)
    want = final_state()
    assert {k: (r.timestamp, r.rating) for k, r in got.items()} == {k: (r[2], r[3]) for k, r in want.items()}
    assert all(r.content == "" and r.created_at is not None for r in got.values())


def test_stream_upsert_goes_on_after_a_restart_and_skips_unchanged_rows(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "store")
    seen = []

    def count(df):
        seen.append(df.count())
        return df

    for n, rows in enumerate(deliveries()):
        write(spark, source, [rows])
        got = run(spark, source, target, enrich=count)
    assert len(got) == 40 and got["r3"].timestamp.minute == 2
    assert seen == [20, 11, 10]  # ids new or edited: r0-r19, r20-r29 and r3, r30-r39


def test_repeated_batch_changes_nothing(spark, tmp_path):
    target = str(tmp_path / "store")
    merge = jobs.merge_batch(target, STORED)
    (tmp_path / "store").mkdir()
    first, second, _ = [spark.createDataFrame(rows, FACTS) for rows in deliveries()]
    merge(first, 0)
    merge(second, 1)
    once = sorted(store.read_current(spark, target, STORED, ["id"]).drop("created_at").collect())
    merge(second, 1)
    assert sorted(store.read_current(spark, target, STORED, ["id"]).drop("created_at").collect()) == once


def test_compacted_store_goes_on(spark, tmp_path):
    target, compacted = str(tmp_path / "store"), str(tmp_path / "store2")
    (tmp_path / "store").mkdir()
    first, second, third = [spark.createDataFrame(rows, FACTS) for rows in deliveries()]
    merge = jobs.merge_batch(target, STORED)
    merge(first, 0)
    merge(second, 1)
    store.compact(spark, target, STORED, ["id"], compacted)
    jobs.merge_batch(compacted, STORED)(third, 0)
    got = store.read_current(spark, compacted, STORED, ["id"]).collect()
    want = final_state()
    assert {r.id: (r.timestamp, r.rating) for r in got} == {k: (r[2], r[3]) for k, r in want.items()}


def test_a_small_batch_reads_few_buckets(spark, tmp_path):
    target = str(tmp_path / "store")
    (tmp_path / "store").mkdir()
    merge = jobs.merge_batch(target, STORED)
    rows = [(f"k{i}", "A", START, 1) for i in range(2000)]
    merge(spark.createDataFrame(rows, FACTS), 0)
    small = spark.createDataFrame([("k7", "A", START + timedelta(days=1), 5), ("new", "A", START, 2)], FACTS)
    found = store.read_versions(spark, target, STORED, 1, store.buckets_of(small, "id"))
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert found.select(F.input_file_name()).distinct().count() <= 2 < store.BUCKETS
    merge(small, 1)
    written = {p.parent.name for p in (tmp_path / "store" / "batch_id=1").rglob("*.parquet")}
    assert len(written) <= 2
    current = store.read_current(spark, target, STORED, ["id"])
    plan = current._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SortMergeJoin" not in plan
    assert current.count() == 2001 and current.where("id = 'k7'").first().rating == 5


def test_deduplication(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    once = [deliveries()[0], deliveries()[0][5:], deliveries()[0][:5]]
    write(spark, source, once)
    stream = jobs.read_files(spark, source, FACTS, files_per_batch=1)
    jobs.write_files(jobs.deduplicate(stream, "30 days"), target).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(target).collect()) == sorted(r[0] for r in once[0])


@pytest.mark.parametrize("granularity", ["day", "week"])
@pytest.mark.parametrize("order", [(0, 1, 2), (2, 0, 1)])
def test_windows_equal_batch_in_any_order_of_files(spark, tmp_path, granularity, order):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    files = deliveries()
    write(spark, source, [files[i] for i in order])
    stream = jobs.read_files(spark, source, FACTS, files_per_batch=1)
    jobs.write_windows(jobs.rating_windows(stream, granularity, "90 days"), target).awaitTermination()
    got = store.read_current(spark, target, jobs.WINDOW_SCHEMA, jobs.WINDOW_KEY)
    start = F.trunc("timestamp", "week") if granularity == "week" else F.to_date("timestamp")
    want = (
        spark.createDataFrame([r for f in files for r in f], FACTS)
        .groupBy("company", start.alias("period_start"))
        .agg(F.sum("rating").alias("rating_sum"), F.count("rating").alias("count"))
    )
    assert sorted(got.drop("period").collect()) == sorted(want.collect())
    if granularity == "week":
        assert {r.period.weekday() for r in got.collect()} == {6}


def test_rows_later_than_the_watermark_are_dropped(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    (tmp_path / "out").mkdir()
    schema = FACTS
    late = [("late", "A", START, 5)]
    for rows in ([("a", "A", START, 1)], [("b", "A", START + timedelta(days=30), 1)], late):
        write(spark, source, [rows])
        stream = jobs.read_files(spark, source, schema)
        jobs.write_windows(jobs.rating_windows(stream, "day", "1 day"), target).awaitTermination()
    got = store.read_current(spark, target, jobs.WINDOW_SCHEMA, jobs.WINDOW_KEY).collect()
    assert sorted((r.period.day, r["count"]) for r in got) == [(1, 1), (31, 1)]


def test_unknown_window_is_refused(spark):
    with pytest.raises(ValueError):
        jobs.rating_windows(spark.createDataFrame([], FACTS), "month", "1 day")


def test_late_deliveries_are_a_batch_each_however_many_files_they_have(spark, sf_dir, tmp_path, monkeypatch):
    from reviewmill.catalog import queries

    seen = []
    write_batch = store.write_batch
    monkeypatch.setattr(jobs, "write_batch", lambda rows, path, batch_id, *a: seen.append(batch_id) or write_batch(rows, path, batch_id, *a))
    spark.read.parquet(f"{sf_dir}/events.parquet").repartition(5).write.parquet(str(tmp_path / "events.parquet"))
    found = queries.QUERIES["stream_upsert_late"](spark, str(tmp_path))
    assert sorted(found.collect()) == sorted(queries.QUERIES["stream_upsert_late"](spark, sf_dir).collect())
    assert seen == [0, 1, 0, 1]
