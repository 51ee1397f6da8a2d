"""Reviews in versioned month folders, edited without overwriting anything.

A store lies under one root: ``data/month=.../version=...`` holds reviews, ``states/<commit>`` the list of
folders that make up the table after a commit. An edit writes new folders, then a new state, and at last
replaces one view. Until that moment readers see the old folders, from it on the new ones; a stop
before it leaves folders that no state names, which :func:`vacuum` removes, and the edit can be repeated.

An update or a delete writes the months in which its keys are stored, found with a scan of keys; an
insert, and the new rows of an upsert, only add a folder to their months. Months of many folders are put
together by :func:`compact`. Nothing that an edit does not touch is read beyond its key column, or written.

Beside each folder lies its share of a cube, ``cube/month=.../version=...``: reviews counted by company, category, day and
rating. It is written with the folder and named by the same state, so reports over :func:`cube` equal those over the
reviews after every edit, and an edit counts only what it writes.

Three names are published for a store ``review``: the view ``review``, the view ``review_months`` with the month
(the one that is replaced), and the table function ``reviews_between(first, last)``, which derives the filter on
months from the dates. All of them read only current folders, by partition filters. One writer at a time: an
edit that finds another state than it began with stops before it publishes.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from reviewmill.operators.joins import Size, measure, only_keys
from reviewmill.operators.maintenance import (
    insert as inserted,
    last_delivery,
    set_columns,
    upsert_unique,
    with_insert_defaults,
)
from reviewmill.schema import COMPANY, REVIEW, conform
from reviewmill.session import cut_lineage
from reviewmill.sources.tables import (
    MONTH_COLUMN,
    bloom_filter,
    empty_table,
    month_of,
    month_predicate,
    publish,
)

VERSION = "version"
STATE = "reviewmill.state"
STORED = T.StructType([*REVIEW.fields, T.StructField(MONTH_COLUMN, T.StringType()), T.StructField(VERSION, T.StringType())])
FOLDERS = T.StructType(
    [
        T.StructField(MONTH_COLUMN, T.StringType()),
        T.StructField(VERSION, T.StringType()),
        T.StructField("n_rows", T.LongType()),
    ]
)
CUBE = T.StructType(
    [
        *[REVIEW[name] for name in ("company", "category", "rating", "timestamp")],
        T.StructField("last_ts", T.TimestampType()),
        T.StructField("n_reviews", T.LongType()),
        T.StructField(MONTH_COLUMN, T.StringType()),
        T.StructField(VERSION, T.StringType()),
    ]
)
MOST_FOLDERS = 8  # of a month before it is put together


class Store(NamedTuple):
    """A store and the name it is published under."""

    spark: SparkSession
    root: str
    name: str

    @property
    def data(self) -> str:
        return f"{self.root}/data"

    @property
    def counts(self) -> str:
        return f"{self.root}/cube"


class Folder(NamedTuple):
    """A current folder; reviews without a time have the month None."""

    month: str | None
    version: str
    n_rows: int


def create(spark: SparkSession, root: str, name: str = "review", rows: DataFrame | None = None) -> Store:
    """A new store under ``root``, empty or with ``rows``, published as ``name``."""
    store = Store(spark, root, name)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in REVIEW)
    named = ", ".join(f"`{c}`" for c in REVIEW.names)
    _publish(store, _write_state(store, "empty", []), [])
    spark.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT {named} FROM {name}_months")
    spark.sql(
        f"""CREATE OR REPLACE FUNCTION {name}s_between(first TIMESTAMP DEFAULT NULL, last TIMESTAMP DEFAULT NULL)
        RETURNS TABLE ({columns}) RETURN SELECT {named} FROM {name}_months
        WHERE (first IS NULL OR (month >= date_format(first, 'yyyy-MM') AND timestamp >= first))
          AND (last IS NULL OR (month <= date_format(last, 'yyyy-MM') AND timestamp <= last))"""
    )
    if rows is not None:
        _commit(store, [], rows, _state(store))
    return store


def create_tables(spark: SparkSession, root: str) -> Store:
    """Empty company and review tables under ``root``, published as ``company`` and ``review``."""
    path = f"{root}/company-0"
    empty_table(spark, COMPANY).write.mode("errorifexists").parquet(path)
    publish(spark, "company", path)
    return create(spark, f"{root}/review")


def between(spark: SparkSession, name: str = "review", start_date=None, end_date=None) -> DataFrame:
    """Reviews published as ``name`` within inclusive dates; only the months of the range are read."""
    rows = spark.table(f"{name}_months").where(month_predicate(start_date, end_date))
    if start_date:
        rows = rows.where(F.col("timestamp") >= F.lit(start_date).cast("timestamp"))
    if end_date:
        rows = rows.where(F.col("timestamp") <= F.lit(end_date).cast("timestamp"))
    return rows.drop(MONTH_COLUMN)


def opened(spark: SparkSession, name: str = "review") -> Store:
    """The store that is published as ``name``."""
    unnamed = Store(spark, "", name)
    return unnamed._replace(root=_state(unnamed).rsplit("/states/", 1)[0])


def cube(spark: SparkSession, name: str = "review", start_date=None, end_date=None) -> DataFrame:
    """Reviews published as ``name``, counted: the reports and :func:`plans.actions.select_reviews` take it for reviews.

    A row stands for ``n_reviews`` of one company, category, day and rating, ``timestamp`` and ``last_ts`` are the first and last
    of them; reviews of midnight are counted apart, so that an end date takes the same reviews as in the table.
    """
    store = opened(spark, name)
    chosen = folders(store)
    if not chosen:
        return spark.createDataFrame([], CUBE).drop(MONTH_COLUMN, VERSION)
    rows = spark.read.schema(CUBE).parquet(store.counts).where(F.col(VERSION).isin([f.version for f in chosen]))
    return rows.where(month_predicate(start_date, end_date)).drop(MONTH_COLUMN, VERSION)


def folders(store: Store) -> list[Folder]:
    """The current folders, a few for each month."""
    return _folders(store, _state(store))


def _state(store: Store) -> str:
    """Path of the current state, a property of the published view."""
    found = store.spark.sql(f"SHOW TBLPROPERTIES {store.name}_months").where(F.col("key") == STATE)
    return found.first().value


def _folders(store: Store, state: str) -> list[Folder]:
    rows = store.spark.read.schema(FOLDERS).json(state).collect()
    return [Folder(*row) for row in rows]


def read(store: Store, months: Iterable[str | None] | None = None, of: list[Folder] | None = None) -> DataFrame:
    """Current reviews with their month, of all months or of some."""
    chosen = folders(store) if of is None else of
    if months is not None:
        wanted = set(months)
        chosen = [f for f in chosen if f.month in wanted]
    if not chosen:
        return store.spark.createDataFrame([], STORED).drop(VERSION)
    rows = store.spark.read.schema(STORED).parquet(store.data)
    return rows.where(F.col(VERSION).isin([f.version for f in chosen])).drop(VERSION)


def _write_data(store: Store, rows: DataFrame, commit: str) -> list[Folder]:
    """Step 1: new folders, one for each month of ``rows``; a large month is split over many tasks."""
    month = month_of(F.col("timestamp"))
    version = F.concat(F.lit(f"{commit}-"), F.coalesce(month, F.lit("none")))
    rows = conform(rows, REVIEW).withColumns({MONTH_COLUMN: month, VERSION: version})
    rows = rows.hint("rebalance", F.col(MONTH_COLUMN)).sortWithinPartitions(MONTH_COLUMN, "company", "timestamp")
    rows.write.partitionBy(MONTH_COLUMN, VERSION).options(**bloom_filter("id")).mode("append").parquet(store.data)
    if not _exists(store, store.data):
        return []
    written = store.spark.read.schema(STORED).parquet(store.data).where(F.col(VERSION).startswith(f"{commit}-"))
    counts = written.groupBy(MONTH_COLUMN, VERSION).agg(F.count("*").alias("n_rows")).collect()
    return [Folder(*row) for row in counts]


def _write_counts(store: Store, new: list[Folder]) -> None:
    """Step 1, continued: the counts of the new folders, read from their narrow columns."""
    if not new:
        return
    rows = store.spark.read.schema(STORED).parquet(store.data).where(F.col(VERSION).isin([f.version for f in new]))
    day = F.to_date("timestamp").alias("_day")
    midnight = (F.col("timestamp") == F.date_trunc("day", "timestamp")).alias("_midnight")
    counted = rows.groupBy("company", "category", "rating", day, midnight, MONTH_COLUMN, VERSION).agg(
        F.min("timestamp").alias("timestamp"), F.max("timestamp").alias("last_ts"), F.count("*").alias("n_reviews")
    )
    counted = counted.select(*CUBE.names).hint("rebalance", MONTH_COLUMN)
    counted.write.partitionBy(MONTH_COLUMN, VERSION).mode("append").parquet(store.counts)


def _write_state(store: Store, commit: str, current: list[Folder]) -> str:
    """Step 2: the folders of the table after the commit."""
    path = f"{store.root}/states/{commit}"
    store.spark.createDataFrame(current, FOLDERS).coalesce(1).write.json(path)
    return path


def _publish(store: Store, state: str, current: list[Folder]) -> None:
    """Step 3: the new state becomes the table."""
    if current:
        named = ", ".join(f"`{c}`" for c in REVIEW.names)
        versions = ", ".join(f"'{f.version}'" for f in sorted(current, key=lambda f: f.version))
        text = f"SELECT {named}, CAST({MONTH_COLUMN} AS string) AS {MONTH_COLUMN} FROM parquet.`{store.data}` WHERE {VERSION} IN ({versions})"
    else:
        nothing = ", ".join(f"CAST(NULL AS {f.dataType.simpleString()}) AS `{f.name}`" for f in STORED if f.name != VERSION)
        text = f"SELECT {nothing} WHERE false"
    store.spark.sql(f"CREATE OR REPLACE VIEW {store.name}_months TBLPROPERTIES ('{STATE}' = '{state}') AS {text}")


def _commit(store: Store, replaced: Sequence[str | None], rows: DataFrame, before: str) -> list[str | None]:
    """Put ``rows`` in place of the ``replaced`` months; returns all months that were written or emptied."""
    commit = f"c{uuid.uuid4().hex[:16]}"
    new = _write_data(store, rows, commit)
    _write_counts(store, new)
    if not new and not replaced:
        return []
    current = [f for f in _folders(store, before) if f.month not in set(replaced)] + new
    state = _write_state(store, commit, current)
    if _state(store) != before:
        raise RuntimeError(f"{store.name} was edited meanwhile; repeat the edit")
    _publish(store, state, current)
    return sorted({f.month for f in new}.union(replaced), key=lambda m: m or "")


def _edit(store: Store, batch: DataFrame, size: Size, key: str, change: Callable[[DataFrame], DataFrame]) -> list[str | None]:
    """Replace the months in which keys of ``batch`` are stored by what ``change`` makes of them."""
    before = _state(store)
    current = _folders(store, before)
    keys = read(store, of=current).select(key, MONTH_COLUMN)
    months = [row[0] for row in only_keys(keys, batch, [key], size).select(MONTH_COLUMN).distinct().collect()]
    rows = change(read(store, months, current).drop(MONTH_COLUMN))
    return _commit(store, months, rows, before)


def insert(store: Store, batch: DataFrame, key: str = "id", batch_ts: Column | None = None) -> list[str | None]:
    """Add new reviews as folders of their own; a key that is stored, or given twice, is an error."""
    before = _state(store)
    batch = cut_lineage(batch)
    stored = read(store, of=_folders(store, before)).select(key)
    inserted(stored, batch.select(key), key, batch_ts)  # raises before anything is written
    return _commit(store, [], with_insert_defaults(batch, batch_ts), before)


def update(store: Store, batch: DataFrame, key: str = "id", newest: Sequence | None = None) -> list[str | None]:
    """Set the batch's columns on stored reviews; unknown keys are ignored, a new time moves a review."""
    batch = cut_lineage(last_delivery(batch, key, newest))
    size = measure(batch)
    return _edit(store, batch, size, key, lambda rows: set_columns(rows, batch, key, size.small))


def upsert(
    store: Store, batch: DataFrame, key: str = "id", newest: Sequence | None = None, batch_ts: Column | None = None
) -> list[str | None]:
    """Update known reviews and insert the others; a stored review with a later time stays."""
    batch = cut_lineage(last_delivery(batch, key, newest))
    size = measure(batch)
    return _edit(store, batch, size, key, lambda rows: upsert_unique(rows, batch, size, key, batch_ts))


def delete(store: Store, keys: DataFrame, key: str = "id") -> list[str | None]:
    """Remove reviews by key."""
    keys = cut_lineage(keys.select(key).distinct())
    size = measure(keys)
    gone = F.broadcast(keys) if size.small else keys
    return _edit(store, keys, size, key, lambda rows: rows.join(gone, key, "left_anti"))


def compact(store: Store, most_folders: int = MOST_FOLDERS) -> list[str | None]:
    """Put together the months that have more than ``most_folders`` folders."""
    before = _state(store)
    current = _folders(store, before)
    counts: dict[str | None, int] = {}
    for folder in current:
        counts[folder.month] = counts.get(folder.month, 0) + 1
    months = [month for month, n in counts.items() if n > most_folders]
    if not months:
        return []
    return _commit(store, months, read(store, months, current).drop(MONTH_COLUMN), before)


def _hadoop(store: Store, path: str):
    found = store.spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(store.spark._jsc.hadoopConfiguration())


def _exists(store: Store, path: str) -> bool:
    found, system = _hadoop(store, path)
    return system.exists(found)


def vacuum(store: Store, older_than_hours: float = 24) -> int:
    """Delete folders that the current state does not name and that are older than the given time.

    The time protects readers of the state before and an edit that is being written.
    """
    named = {f.version for f in folders(store)}
    latest = store.spark._jvm.java.lang.System.currentTimeMillis() - int(older_than_hours * 3_600_000)
    removed = 0
    for place in (store.data, store.counts):
        pattern, system = _hadoop(store, f"{place}/{MONTH_COLUMN}=*/{VERSION}=*")
        for status in system.globStatus(pattern) or []:
            version = status.getPath().getName().split("=", 1)[1]
            if version not in named and status.getModificationTime() <= latest:
                removed += bool(system.delete(status.getPath(), True))
    return removed
