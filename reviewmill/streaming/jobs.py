"""Streaming jobs over files of reviews."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from reviewmill.operators.joins import measure, only_keys, sized
from reviewmill.operators.maintenance import changed, last_delivery, upsert_unique
from reviewmill.streaming.store import (
    BATCH,
    BUCKETS,
    buckets_of,
    checkpoint_of,
    newest,
    read_versions,
    write_batch,
)

# Weeks start on Monday; windows are counted from 1970-01-01, a Thursday.
_WINDOWS = {"day": ("1 day", None), "week": ("7 days", "4 days")}


def read_files(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    name_filter: str | None = None,
    files_per_batch: int | None = None,
) -> DataFrame:
    """A stream of parquet files."""
    reader = spark.readStream.schema(schema)
    if name_filter:
        reader = reader.option("pathGlobFilter", name_filter)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def deduplicate(reviews: DataFrame, delay: str, key: str = "id", ts: str = "timestamp") -> DataFrame:
    """First delivery of each review; a key is remembered for ``delay``, so state is bounded."""
    return reviews.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def rating_windows(reviews: DataFrame, granularity: str, delay: str) -> DataFrame:
    """Mean and count per company and day or week; rows later than ``delay`` are dropped.

    Months differ in length and are summed up from the days, by :func:`months_of`.
    """
    if granularity not in _WINDOWS:
        raise ValueError(f"Unknown granularity: {granularity}")
    length, offset = _WINDOWS[granularity]
    period = F.window("timestamp", length, startTime=offset)
    return (
        reviews.withWatermark("timestamp", delay)
        .groupBy("company", period.alias("w"))
        .agg(F.sum("rating").alias("rating_sum"), F.count("rating").alias("count"))
        .select(
            "company",
            F.to_date("w.start").alias("period_start"),
            F.date_sub(F.to_date("w.end"), 1).alias("period"),
            "rating_sum",
            "count",
        )
    )


WINDOW_SCHEMA = T.StructType(
    [
        T.StructField("company", T.StringType()),
        T.StructField("period_start", T.DateType()),
        T.StructField("period", T.DateType()),
        T.StructField("rating_sum", T.LongType()),
        T.StructField("count", T.LongType()),
    ]
)
WINDOW_KEY = ("company", "period_start")


def write_windows(windows: DataFrame, store: str) -> StreamingQuery:
    """Keep the newest state of every window in ``store``; processes what is available."""
    return (
        windows.writeStream.outputMode("update")
        .foreachBatch(lambda rows, batch_id: write_batch(rows, store, batch_id))
        .option("checkpointLocation", checkpoint_of(store))
        .trigger(availableNow=True)
        .start()
    )


def write_files(rows: DataFrame, path: str) -> StreamingQuery:
    """Append to parquet files; processes what is available."""
    return (
        rows.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint_of(path))
        .trigger(availableNow=True)
        .start()
    )


def months_of(days: DataFrame) -> DataFrame:
    """Months of the stored days of :func:`rating_windows`, shown under their last day."""
    start = F.trunc("period_start", "month").cast("date")
    return (
        days.groupBy("company", start.alias("period_start"))
        .agg(F.sum("rating_sum").alias("rating_sum"), F.sum("count").alias("count"))
        .select("company", "period_start", F.last_day("period_start").alias("period"), "rating_sum", "count")
    )


def merge_batch(
    store: str,
    schema: T.StructType,
    key: str = "id",
    version: str = "timestamp",
    enrich: Callable[[DataFrame], DataFrame] | None = None,
    buckets: int = BUCKETS,
) -> Callable[[DataFrame, int], None]:
    """Micro-batch function: detect changes against the store, enrich, upsert.

    The buckets of the batch are scanned for its keys and versions; whole rows are read only
    for reviews that came back changed, and nothing of the store is shuffled if the batch
    is small. ``enrich`` (for example the embedder) sees new and changed rows only.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark, kept = batch.sparkSession, []

        def keep(df: DataFrame) -> DataFrame:
            kept.append(df.persist())
            return df

        try:
            batch = keep(batch)
            size = measure(batch)
            versions = read_versions(spark, store, schema, batch_id, buckets_of(batch, key, buckets))
            present = only_keys(versions.select(key, version, BATCH), batch, [key], size)
            known = keep(newest(present, [key]))
            incoming = last_delivery(batch, key, [F.col(version).desc_nulls_last()])
            fresh = changed(incoming, known, key, version, size)
            fresh = keep(enrich(fresh) if enrich else fresh)
            edited = fresh.select(key).join(sized(known.select(key)), key, "left_semi")
            stored = newest(only_keys(versions, edited, [key], measure(edited)), [key])
            write_batch(upsert_unique(stored, fresh, measure(fresh), key, version=version), store, batch_id, key, buckets)
        finally:
            for df in kept:
                df.unpersist()

    return merge


def ingest(
    reviews: DataFrame,
    store: str,
    schema: T.StructType,
    enrich: Callable[[DataFrame], DataFrame] | None = None,
) -> StreamingQuery:
    """Upsert a stream of reviews into ``store``; processes what is available."""
    return (
        reviews.writeStream.foreachBatch(merge_batch(store, schema, enrich=enrich))
        .option("checkpointLocation", checkpoint_of(store))
        .trigger(availableNow=True)
        .start()
    )
