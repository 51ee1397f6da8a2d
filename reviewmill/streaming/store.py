"""Keyed results of a stream, kept as one folder of changed rows per micro-batch.

A micro-batch writes only the rows it changed and never touches older folders; a repeated batch
overwrites its own. With a key the rows of a folder lie in buckets by key hash, and a micro-batch reads
only the buckets that its keys fall into, so its cost follows the batch. Readers take the newest row of
each key: which rows are outdated is found from keys and batch numbers alone, and whole rows are
neither shuffled nor sorted. The stream's own checkpoint lies in the same place, which ties batch
numbers to the store.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from reviewmill.operators.joins import latest_per_key, sized
from reviewmill.session import cut_lineage
from reviewmill.sources.tables import bloom_filter, read_table

BATCH, BUCKET = "batch_id", "bucket"
BUCKETS = 8  # a bucket should hold about a file of rows; the number is fixed for a store


def checkpoint_of(store: str) -> str:
    return f"{store}/_checkpoint"


def bucket_of(key: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def write_batch(rows: DataFrame, store: str, batch_id: int, key: str | None = None, buckets: int = BUCKETS) -> None:
    """Write the rows of one micro-batch, in buckets if there is a key, with a Bloom filter on it."""
    path = f"{store}/{BATCH}={batch_id}"
    if key is None:
        rows.write.mode("overwrite").parquet(path)
        return
    bucketed = rows.withColumn(BUCKET, bucket_of(F.col(key), buckets)).hint("rebalance", F.col(BUCKET))
    bucketed.write.mode("overwrite").partitionBy(BUCKET).options(**bloom_filter(key)).parquet(path)


def read_versions(
    spark: SparkSession,
    store: str,
    schema: T.StructType,
    before: int | None = None,
    buckets: Sequence[int] | None = None,
) -> DataFrame:
    """All stored versions, or those of batches before a given one, or of some buckets."""
    stored = T.StructType([*schema.fields, T.StructField(BATCH, T.LongType()), T.StructField(BUCKET, T.IntegerType())])
    rows = read_table(spark, store, stored)
    if before is not None:
        rows = rows.where(F.col(BATCH) < before)
    if buckets is not None:
        rows = rows.where(F.col(BUCKET).isin(list(buckets)))
    return rows.drop(BUCKET)


def buckets_of(keys: DataFrame, key: str, buckets: int = BUCKETS) -> list[int]:
    """Buckets that the keys fall into."""
    return sorted(row[0] for row in keys.select(bucket_of(F.col(key), buckets)).distinct().collect())


def newest(versions: DataFrame, key: Sequence[str]) -> DataFrame:
    """The newest version of each key, for rows of few keys."""
    return latest_per_key(versions, key, [F.col(BATCH).desc()]).drop(BATCH)


def read_current(
    spark: SparkSession, store: str, schema: T.StructType, key: Sequence[str]
) -> DataFrame:
    """The present state of the store; keys are unique within a batch.

    Keys with several versions are found from keys and batch numbers. They are broadcast if measured small, and
    whole rows then stay where they are.
    """
    versions = read_versions(spark, store, schema)
    known = [F.col(c).alias(f"_k_{c}") for c in key]
    last = versions.groupBy(*known).agg(F.max(BATCH).alias("_last"), F.count("*").alias("_versions"))
    last = sized(cut_lineage(last.where("_versions > 1").drop("_versions")))
    outdated = F.col(BATCH) < F.col("_last")
    for c in key:
        outdated = outdated & versions[c].eqNullSafe(F.col(f"_k_{c}"))
    return versions.join(last, outdated, "left_anti").drop(BATCH)


def compact(
    spark: SparkSession, store: str, schema: T.StructType, key: Sequence[str], path: str, buckets: int = BUCKETS
) -> None:
    """Start a new store at ``path`` from the present state, as the batch before the first; buckets are written whole."""
    write_batch(read_current(spark, store, schema, key), path, -1, key[0], buckets)
