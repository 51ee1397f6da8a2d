"""Insert, upsert, update, delete and change detection on whole tables.

Every function returns the new table as a DataFrame; write it to a new path and publish
that (``sources.tables``). A batch that is small when measured is broadcast, so the big
table is scanned but never shuffled; a big batch is joined by shuffling both sides. A
column present in the batch counts as set, also where it holds NULL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from reviewmill.operators.joins import Size, any_order, latest_per_key, measure, only_keys, sized
from reviewmill.session import cut_lineage


def with_insert_defaults(batch: DataFrame, batch_ts: Column | None = None) -> DataFrame:
    """Fill what a new review gets by default: its creation time and an empty text."""
    now = F.current_timestamp() if batch_ts is None else batch_ts
    created = F.coalesce(F.col("created_at"), now) if "created_at" in batch.columns else now
    batch = batch.withColumn("created_at", created)
    return batch if "content" in batch.columns else batch.withColumn("content", F.lit(""))


def last_delivery(batch: DataFrame, key: str, newest: Sequence | None = None) -> DataFrame:
    """One row per key, the newest; rows of one time are told apart by their content."""
    order = newest or [F.col("timestamp").desc_nulls_last()]
    return latest_per_key(batch, [key], [*order, *[c.desc() for c in any_order(batch)]])


def set_columns(
    target: DataFrame, batch: DataFrame, key: str, small: bool, version: str | None = None
) -> DataFrame:
    """Target with the columns of the batch, except where the stored ``version`` is greater."""
    given = [c for c in batch.columns if c in target.columns and c != key]
    source = batch.select(
        key, *[F.col(c).alias(f"_new_{c}") for c in given], F.lit(True).alias("_matched")
    )
    joined = target.join(F.broadcast(source) if small else source, key, "left")
    wins = F.col("_matched")
    if version in given:
        # a version that is not set loses against one that is
        older = F.col(version).isNotNull() & F.coalesce(F.col(f"_new_{version}") < F.col(version), F.lit(True))
        wins = wins & ~older
    return joined.select(
        *[
            F.when(wins, F.col(f"_new_{c}").cast(target.schema[c].dataType))
            .otherwise(F.col(c))
            .alias(c)
            if c in given
            else F.col(c)
            for c in target.columns
        ]
    )


def insert(
    target: DataFrame, batch: DataFrame, key: str = "id", batch_ts: Column | None = None
) -> DataFrame:
    """Target plus the batch; a key that is already there, or given twice, is an error."""
    twice = batch.groupBy(key).count().where("count > 1").select(key)
    known = only_keys(target.select(key), batch, [key], measure(batch.select(key)))
    duplicate = twice.union(known).first()
    if duplicate is not None:
        raise ValueError(f"Duplicate key: {duplicate[0]}")
    rows = with_insert_defaults(batch, batch_ts)
    return target.unionByName(rows, allowMissingColumns=True).select(*target.columns)


def update(
    target: DataFrame, batch: DataFrame, key: str = "id", newest: Sequence | None = None
) -> DataFrame:
    """Target with the batch's columns set on rows of the same key; other keys are ignored."""
    batch = cut_lineage(last_delivery(batch, key, newest))
    return set_columns(target, batch, key, measure(batch).small)


def upsert(
    target: DataFrame,
    batch: DataFrame,
    key: str = "id",
    newest: Sequence | None = None,
    batch_ts: Column | None = None,
    version: str | None = "timestamp",
) -> DataFrame:
    """Update rows whose key is known, insert the others with their defaults.

    ``newest`` orders the rows of a key that is given more than once; the first wins. A stored
    row with a greater ``version`` stays, so batches may come in any order; None lets every
    batch win. The batch is written once, as it is measured and then joined twice.
    """
    batch = cut_lineage(last_delivery(batch, key, newest))
    return upsert_unique(target, batch, measure(batch), key, batch_ts, version)


def upsert_unique(
    target: DataFrame,
    batch: DataFrame,
    size: Size,
    key: str = "id",
    batch_ts: Column | None = None,
    version: str | None = "timestamp",
) -> DataFrame:
    """:func:`upsert` of a batch of known size without repeated keys.

    New keys are found with a scan of the target's key column only.
    """
    known = only_keys(target.select(key), batch, [key], size)
    if size.small:
        known = F.broadcast(known)  # keys are unique in the target: no more than in the batch
    fresh = with_insert_defaults(batch.join(known, key, "left_anti"), batch_ts)
    fresh = fresh.select(*[c for c in fresh.columns if c in target.columns])
    updated = set_columns(target, batch, key, size.small, version)
    return updated.unionByName(fresh, allowMissingColumns=True)


def delete(target: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    """Target without the rows of the given keys."""
    keys = keys.select(key)
    return target.join(sized(keys), key, "left_anti")


def changed(
    incoming: DataFrame,
    target: DataFrame,
    key: str = "id",
    version: str = "timestamp",
    size: Size | None = None,
) -> DataFrame:
    """Incoming rows that are new, or whose version is greater than the stored one.

    An older delivery that arrives late is no change, so the state does not depend on the order
    of arrival. ``size`` bounds the incoming rows, if a bound is known already.
    """
    stored = target.select(key, version)
    if size is None:  # written once, as it is measured, looked up and joined
        incoming = cut_lineage(incoming)
        size = measure(incoming.select(key))
    if size.small:
        # Keys are unique in the target, so no more rows are left than came in.
        stored = F.broadcast(only_keys(stored, incoming, [key], size))
    stored = stored.select(F.col(key).alias("_key"), F.col(version).alias("_version"))
    known = (F.col(key) == F.col("_key")) & (
        F.col(version).isNull() | (F.col("_version") >= F.col(version)).eqNullSafe(F.lit(True))
    )
    return incoming.join(stored, known, "left_anti")


def with_company(reviews: DataFrame, companies: DataFrame) -> DataFrame:
    """Reviews with name and country of their company.

    A company table that is small when measured is broadcast and no review is shuffled;
    otherwise both sides are, and very large companies are split at run time.
    """
    names = companies.select(
        F.col("id").alias("company_id"), F.col("name").alias("company_name"), "country"
    )
    return reviews.join(sized(names), "company_id")
