"""The lowest ``n`` rows, and the rows at an offset, found by counting ranges.

The ``n``-th row of an order is narrowed down in rounds: the range that still holds it is cut into
buckets, one aggregation counts each, and the bucket with the ``n``-th row is the next range. Numbers
are cut into buckets of equal width, texts by the two bytes after what all of them begin with; what
reaches the driver are counts and bounds of at most ``BUCKETS`` or 65,536 buckets. When a range has few rows,
one top-n of these gives the exact row. The result is a predicate, so no row is shuffled, the rows found stay
in their tasks however many they are, and an offset costs the same at the end as at the beginning.
"""

from __future__ import annotations

import os.path
from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

BUCKETS = 4096
FEW_ROWS = 10_000


class Place(NamedTuple):
    """A range of an order: equal ``fixed`` columns, then ``low`` to ``high`` of the next one."""

    fixed: list
    low: object
    high: object
    before: int  # rows before the range
    inside: int


def _names(order: Sequence) -> list[str]:
    return [f"_o{i}" for i in range(len(order))]


def _ordered(df: DataFrame, order: Sequence[str | Column]) -> tuple[DataFrame, list[str]]:
    """``df`` with the columns of the order; NULLs come last, by a column of their own."""
    columns: list[Column] = []
    for part in order:
        column = F.col(part) if isinstance(part, str) else part
        kind = df.select(column.alias("c")).schema["c"].dataType
        if isinstance(kind, (T.TimestampType, T.DateType)):
            column, kind = F.unix_micros(column.cast("timestamp")), T.LongType()
        empty = F.lit("") if isinstance(kind, T.StringType) else F.lit(0).cast(kind)
        columns += [column.isNull().cast("int"), F.coalesce(column, empty)]
    names = _names(columns)
    return df.withColumns(dict(zip(names, columns))), names


def _range(names: Sequence[str], place: Place) -> Column:
    tests = [F.col(name) == F.lit(value) for name, value in zip(names, place.fixed)]
    if len(place.fixed) < len(names):
        column = F.col(names[len(place.fixed)])
        tests += [column >= F.lit(place.low), column <= F.lit(place.high)]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def _bucket(column: Column, low, high) -> Column:
    """Ascending bucket of a value between ``low`` and ``high``, which fall into different ones."""
    if isinstance(low, str):
        shared = len(os.path.commonprefix([low.encode(), high.encode()]))
        return F.hex(F.substring(column.cast("binary"), shared + 1, 2))
    width = (high - low) / BUCKETS
    if isinstance(low, int) and high - low < 1 << 62 or isinstance(low, float) and 0 < width < float("inf"):
        return F.least(F.floor((column - F.lit(low)) / F.lit(width)), F.lit(BUCKETS - 1))
    middle = (low + high) // 2 if isinstance(low, int) else low / 2 + high / 2
    return (column > F.lit(middle if low <= middle < high else low)).cast("int")


def locate(ordered: DataFrame, names: Sequence[str], n: int, few: int = FEW_ROWS) -> Place | None:
    """A range of at most ``few`` rows, or of equal ones, that holds row ``n`` (from 0); None beyond the last."""
    ends = [f(name).alias(f"{f.__name__}_{name}") for name in names for f in (F.min, F.max)]
    whole = ordered.agg(F.count("*").alias("rows"), *ends).first()
    if n >= whole.rows:
        return None
    bounds = [(whole[f"min_{name}"], whole[f"max_{name}"]) for name in names]
    place = Place([], *bounds[0], 0, whole.rows)
    while place.inside > few:
        column = F.col(names[len(place.fixed)])
        if place.low == place.high:
            fixed = [*place.fixed, place.low]
            if len(fixed) == len(names):
                return Place(fixed, None, None, place.before, place.inside)
            place = Place(fixed, *_ends(ordered, names, fixed, bounds), place.before, place.inside)
            continue
        counted = (
            ordered.where(_range(names, place))
            .groupBy(_bucket(column, place.low, place.high).alias("bucket"))
            .agg(F.count("*").alias("rows"), F.min(column).alias("low"), F.max(column).alias("high"))
            .collect()
        )
        before = place.before
        for part in sorted(counted, key=lambda row: row.bucket):
            if before + part.rows > n:
                place = Place(place.fixed, part.low, part.high, before, part.rows)
                break
            before += part.rows
    return place


def _ends(ordered: DataFrame, names: Sequence[str], fixed: list, bounds: list) -> tuple:
    """Least and greatest of the next column among the rows with the fixed ones."""
    low, high = bounds[len(fixed)]
    if low == high:
        return low, high
    same = _range(names[: len(fixed)], Place(fixed, None, None, 0, 0))
    column = F.col(names[len(fixed)])
    return tuple(ordered.where(same).agg(F.min(column), F.max(column)).first())


def _compared(names: Sequence[str], values: Sequence) -> tuple[Column, Column]:
    """Whether a row lies before ``values``, and whether it equals them."""
    before, same = F.lit(False), F.lit(True)
    for name, value in zip(reversed(names), reversed(values)):
        column, bound = F.col(name), F.lit(value)
        before = (column < bound) | ((column == bound) & before)
        same = (column == bound) & same
    return before, same


def lowest(df: DataFrame, order: Sequence[str | Column], n: int, unique: bool = False, few: int = FEW_ROWS) -> DataFrame:
    """The ``n`` rows lowest in ``order``, in no particular order; rows without a value come last.

    Orders are numbers, times, dates or texts, without NaN. Rows that are equal in the order are told apart by a
    hash of all their columns, so the same rows are found on every run; ``unique`` says that there are none.
    """
    if n <= 0:
        return df.limit(0)
    ordered, names = _ordered(df, order)
    place = Place([], None, None, 0, 0) if n <= few else locate(ordered, names, n - 1, few)
    if place is None:
        return df
    if len(place.fixed) < len(names):
        inside = ordered if n <= few else ordered.where(_range(names, place))
        last = inside.select(*names).orderBy(*names).offset(n - 1 - place.before).limit(2).collect()
        if not last:
            return df
        lower, same = _compared(names, list(last[0]))
        if unique or len(last) < 2 or last[0] != last[1]:
            return ordered.where(lower | same).drop(*names)
        before = place.before + inside.where(lower).count()
    else:
        lower, same = _compared(names, place.fixed)
        before = place.before
    equal = ordered.where(same).drop(*names)
    return ordered.where(lower).drop(*names).unionByName(_of_equal(equal, n - before, few))


def _of_equal(rows: DataFrame, n: int, few: int) -> DataFrame:
    """``n`` of rows that are equal in the order, by a hash of all columns."""
    columns = [
        F.to_json(F.col(f"`{f.name}`")) if isinstance(f.dataType, T.MapType) else F.col(f"`{f.name}`") for f in rows.schema
    ]
    ordered = rows.withColumn("_hash", F.xxhash64(*columns))
    place = locate(ordered, ["_hash"], n - 1, few)
    if place is None:
        return rows
    low = place.fixed[0] if place.fixed else place.low
    below = ordered.where(F.col("_hash") < F.lit(low))
    inside = ordered.where(_range(["_hash"], place)).orderBy("_hash").limit(n - place.before)
    return below.unionByName(inside).drop("_hash")


def page(df: DataFrame, order: Sequence[str | Column], offset: int, limit: int, few: int = FEW_ROWS) -> DataFrame:
    """``limit`` rows from ``offset`` on, in order; rows before the page are counted, not sorted."""
    ordered, names = _ordered(df, order)
    if offset + limit <= few:
        return ordered.orderBy(*names).offset(offset).limit(limit).drop(*names)
    place = locate(ordered, names, offset, few)
    if place is None:
        return df.limit(0)
    first = list(place.fixed) if len(place.fixed) == len(names) else [*place.fixed, place.low]
    earlier, _ = _compared(names[: len(first)], first)
    rest = ordered.where(~earlier).orderBy(*names).offset(offset - place.before).limit(limit)
    return rest.drop(*names)
