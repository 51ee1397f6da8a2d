"""Helpers shared by the operators of this package."""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from reviewmill.session import shared_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def worker_cache(name: str, build: Callable, version: str = ""):
    """What ``build`` returned the first time in this Python worker.

    Only the last thing asked for is kept, so stages that follow each other do not add up.

    Task functions are pickled by value, so their own module variables start anew in every
    task; a module registered in ``sys.modules`` stays as long as the worker is reused.
    """
    kept = vars(sys.modules.setdefault("_reviewmill_worker", ModuleType("_reviewmill_worker")))
    if kept.get("_wanted") != (name, version):
        kept.pop("_found", None)
        pa.default_memory_pool().release_unused()
        kept["_found"] = build()
        kept["_wanted"] = (name, version)
    return kept["_found"]


def free_worker_cache() -> None:
    """Give back what an earlier stage kept in this worker; for tasks that keep nothing themselves."""
    kept = sys.modules.get("_reviewmill_worker")
    if kept is not None:
        vars(kept).pop("_found", None)
        vars(kept).pop("_wanted", None)
    pa.default_memory_pool().release_unused()


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that fewer texts are Python objects at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def sliced_by_bytes(batches: Iterator[pa.RecordBatch], column: int, most: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose texts have at most ``most`` bytes together, or are a single one."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def _longs(values: list[int]) -> str:
    return "array(" + ",".join(f"{v}L" for v in values) + ")" if values else "array(0L)"


def block_of(key: Column, bounds: list[int]) -> Column:
    """How many of the ascending ``bounds`` are at most ``key``; NULL keys get block 0.

    The bounds are literals in groups of about the square root of their number, so a row
    costs two short searches however many blocks there are.
    """
    if not bounds:
        return F.lit(0)
    key = key.cast("bigint")
    width = max(1, math.isqrt(len(bounds)))
    groups = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    before = F.size(F.filter(F.expr(_longs([g[0] for g in groups])), lambda b: b <= key))
    inner = F.expr("array(" + ",".join(map(_longs, groups)) + ")")
    within = F.size(F.filter(F.element_at(inner, F.greatest(before, F.lit(1))), lambda b: b <= key))
    return F.when(key.isNull() | (before == 0), 0).otherwise((before - 1) * width + within).cast("int")


def key_bounds(df: DataFrame, key: str, weight: Column, per_block: int) -> list[int]:
    """Keys that cut ``df`` into ascending ranges of about ``per_block`` summed ``weight``.

    One pass; what reaches the driver is one number for each block.
    """
    total = df.agg(F.sum(weight)).first()[0] or 0
    blocks = max(1, math.ceil(total / per_block))
    if blocks == 1:
        return []
    shares = [i / blocks for i in range(1, blocks)]
    found = df.agg(F.percentile_approx(F.col(key).cast("bigint"), shares, max(10_000, 20 * blocks)))
    return sorted(set(found.first()[0] or []))


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder, so that later steps read the columns they need."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
