"""Join helpers that look at sizes before choosing a strategy."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import count
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row, Window, functions as F
from pyspark.sql import types as T

from reviewmill.session import cut_lineage

# A side is broadcast only if it was found to be within both bounds.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 * 1024 * 1024
# So few keys are sent to the scan as an IN filter, where statistics and Bloom filters of
# the files rule out row groups; a join would read the whole table for them.
PUSHED_KEYS = 1000
# Keys beyond a broadcast are marked in bitmaps: so many bits for each key, and so many at most in all.
MAP_PARTS, KEY_BITS, MAP_BITS = 64, 12, 1 << 29


class Size(NamedTuple):
    """Measured rows and bytes of a frame."""

    rows: int
    bytes: int = 0

    @property
    def small(self) -> bool:
        return self.rows <= BROADCAST_ROWS and self.bytes <= BROADCAST_BYTES

    @property
    def few(self) -> bool:
        return self.rows <= PUSHED_KEYS


def _row_bytes(df: DataFrame) -> Column:
    total = F.lit(0).cast("bigint")
    for field in df.schema:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            size = F.octet_length(column)
        elif isinstance(field.dataType, T.ArrayType) and isinstance(field.dataType.elementType, T.NumericType):
            size = F.size(column) * 8
        elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            size = F.octet_length(F.to_json(F.struct(column)))
        else:
            size = F.lit(8)
        total = total + F.coalesce(size, F.lit(0))
    return total


def measure(df: DataFrame) -> Size:
    """Rows and bytes of ``df``, counted by one aggregation, not estimated."""
    found = df.agg(F.count("*").alias("rows"), F.sum(_row_bytes(df)).alias("size")).first()
    return Size(found.rows, found.size or 0)


def sized(df: DataFrame) -> DataFrame:
    """``df``, marked for broadcast if it is small; otherwise the join shuffles both sides."""
    return F.broadcast(df) if measure(df).small else df


def _spots(on: Sequence[str], bits: int) -> list[Column]:
    """Part of the bitmaps that a key belongs to, and its two bits there."""
    return [F.pmod(F.xxhash64(*on, F.lit(seed)), F.lit(most)) for seed, most in ((0, MAP_PARTS), (1, bits), (2, bits))]


def _bitmaps(keys: DataFrame, on: Sequence[str], bits: int) -> DataFrame:
    """``_part`` and ``_words``, the bits of its keys."""

    def marked(pdf: pd.DataFrame) -> pd.DataFrame:
        found = np.zeros(bits, bool)
        found[pdf["_first"]] = True
        found[pdf["_second"]] = True
        words = np.packbits(found, bitorder="little").view(np.int64)
        return pd.DataFrame({"_part": pdf["_part"].iloc[:1], "_words": [words]})

    spots = keys.select(*(c.alias(n) for c, n in zip(_spots(on, bits), ("_part", "_first", "_second"))))
    return spots.groupBy("_part").applyInPandas(marked, "_part bigint, _words array<bigint>")


def split_by_keys(df: DataFrame, keys: DataFrame, on: Sequence[str], rows: int) -> tuple[DataFrame, DataFrame]:
    """Rows of ``df`` that hit the bitmaps of the ``rows`` keys, and those that surely have no key."""
    bits = 64 * max(1, min(rows * KEY_BITS, MAP_BITS) // MAP_PARTS // 64)
    part, first, second = _spots(on, bits)
    words = next(n for n in (f"_map{i}" for i in count()) if not {n, f"{n}_part"} & set(df.columns))
    held = cut_lineage(_bitmaps(keys, on, bits))
    held = held.select(F.col("_part").alias(f"{words}_part"), F.col("_words").alias(words))

    def hit(spot: Column) -> Column:
        word = F.get(F.col(words), F.shiftright(spot, 6).cast("int"))
        return F.getbit(word, F.pmod(spot, F.lit(64)).cast("int")) == 1

    marked = df.join(F.broadcast(held), part == F.col(f"{words}_part"), "left")
    marked = marked.select(*df.columns, F.coalesce(hit(first) & hit(second), F.lit(False)).alias(words))
    return marked.where(words).drop(words), marked.where(~F.col(words)).drop(words)


def join_keys(df: DataFrame, keys: DataFrame, on: Sequence[str], how: str) -> DataFrame:
    """``df`` joined (``inner``, ``left_semi``, ``left_anti``) with ``keys``, narrow rows found in ``df``.

    Keys that are not small are marked in bitmaps first, which every task holds. Only rows that
    hit them are shuffled, those with a key and two or three in a hundred of the others, so most
    wide rows without a key stay where they are.
    """
    size = measure(keys)
    if size.small:
        return df.join(F.broadcast(keys), list(on), how)
    likely, others = split_by_keys(df, keys, on, size.rows)
    found = likely.join(keys, list(on), how)
    return found.unionByName(others) if how == "left_anti" else found


def _among(df: DataFrame, column: str, rows: Sequence[Row]) -> DataFrame:
    values = {row[column] for row in rows} - {None}
    return df.where(F.col(column).isin(sorted(values)))


def only_keys(df: DataFrame, keys: DataFrame, on: Sequence[str], size: Size) -> DataFrame:
    """Rows of ``df`` whose key occurs in ``keys``, a frame of at most the given size.

    Few keys become a filter of the scan, small ones a broadcast; in neither case is ``df``
    shuffled.
    """
    keys = keys.select(*on)
    if size.few:
        rows = keys.distinct().collect()
        for column in on:
            df = _among(df, column, rows)
        if len(on) == 1:
            return df
        keys = df.sparkSession.createDataFrame(rows, keys.schema)
    return df.join(F.broadcast(keys) if size.small else keys, list(on), "left_semi")


def fetch(df: DataFrame, found: DataFrame, key: str, n: int) -> DataFrame:
    """Rows of ``df`` joined with ``found``, the at most ``n`` rows of a top-n."""
    if Size(n).few:
        rows = found.collect()
        found = df.sparkSession.createDataFrame(rows, found.schema)
        df = _among(df, key, rows)
    return df.join(F.broadcast(found) if Size(n).small else found, key)


def latest_per_key(df: DataFrame, keys: Sequence[str], newest: Sequence) -> DataFrame:
    """One row per key, the first in the order ``newest``.

    The rank filter becomes a group limit before the shuffle, so a key repeated very often
    sends one row per task.
    """
    order = Window.partitionBy(*keys).orderBy(*newest)
    return df.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


def any_order(df: DataFrame) -> list[Column]:
    """An order of rows that differ, the same on every run: a 64-bit hash of all columns."""
    columns = [
        F.to_json(F.col(f"`{f.name}`")) if isinstance(f.dataType, T.MapType) else F.col(f"`{f.name}`")
        for f in df.schema
    ]
    return [F.xxhash64(*columns)]


def lowest_rows(df: DataFrame, order: Sequence, n: int, key: str) -> DataFrame:
    """The ``n`` rows lowest in ``order``, complete; no two rows share a ``key``.

    Only keys and order columns take part in the top-n; the wide columns are fetched
    afterwards for the rows that won.
    """
    return only_keys(df, df.orderBy(*order).limit(n).select(key), [key], Size(n))
