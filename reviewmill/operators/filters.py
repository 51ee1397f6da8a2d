"""Review selection: projections, predicates, order, limit, paging."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from datetime import date, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from reviewmill.fixed_values import PAGE_SIZE
from reviewmill.functions.codes import category_codes
from reviewmill.operators import selection
from reviewmill.operators.joins import lowest_rows, measure, only_keys

DateLike = str | date | datetime | None

# Columns too wide to be carried through a top-n.
WIDE = {"content", "embedding"}


def project(df: DataFrame, cols: Sequence[str] = ()) -> DataFrame:
    """The named columns; none named means all."""
    return df.select(*cols) if cols else df


def _absent(value) -> bool:
    return value is None or value == ""


def equals_predicate(equals: Mapping[str, object]) -> Column:
    """All columns equal their value; absent values ("" and None) do not filter, 0 does."""
    tests = [F.col(name) == F.lit(value) for name, value in equals.items() if not _absent(value)]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def membership_predicate(members: Mapping[str, Iterable], mode: str = "any") -> Column:
    """Columns lie in their lists: any of them (default) or all; empty lists do not filter."""
    if mode not in ("any", "all"):
        raise ValueError(f"Unknown mode: {mode}")
    tests = [F.col(name).isin(list(values)) for name, values in members.items() if values]
    if not tests:
        return F.lit(True)
    return reduce((lambda a, b: a | b) if mode == "any" else (lambda a, b: a & b), tests)


def date_predicate(
    start_date: DateLike = None, end_date: DateLike = None, column: str = "timestamp"
) -> Column:
    """Inclusive bounds; a plain end date means its midnight."""
    ts = F.col(column)
    test = F.lit(True)
    if not _absent(start_date):
        test = test & (ts >= F.lit(start_date).cast("timestamp"))
    if not _absent(end_date):
        test = test & (ts <= F.lit(end_date).cast("timestamp"))
    return test


def review_predicate(
    companies: Sequence[str] = (),
    categories: Sequence[str | int] = (),
    start_date: DateLike = None,
    end_date: DateLike = None,
    mode: str = "any",
) -> Column:
    """Predicate of a request's metadata; category names are turned into codes."""
    members = {"company": companies, "category": category_codes(categories)}
    return membership_predicate(members, mode) & date_predicate(start_date, end_date)


def newest_first(df: DataFrame, column: str = "timestamp", key: str = "id") -> DataFrame:
    """Newest rows first, ties by key."""
    return df.orderBy(F.col(column).desc(), F.col(key))


def review_search(
    df: DataFrame,
    equals: Mapping[str, object] | None = None,
    members: Mapping[str, Iterable] | None = None,
    start_date: DateLike = None,
    end_date: DateLike = None,
    cols: Sequence[str] = (),
    limit: int | None = None,
    mode: str = "any",
) -> DataFrame:
    """Filter, order newest first, limit, project.

    Rows are ordered where the order shows: when the timestamp is among the columns asked
    for, or a limit has to choose (a top-n, not a full sort). Texts and vectors are read
    for the chosen rows only after the top-n.
    """
    found = df.where(
        equals_predicate(equals or {})
        & membership_predicate(members or {}, mode)
        & date_predicate(start_date, end_date)
    )
    if limit and WIDE.intersection(cols or df.columns):
        found = lowest_rows(found, [F.col("timestamp").desc(), "id"], limit, "id")
    if limit or "timestamp" in cols:
        found = newest_first(found)
    if limit:
        found = found.limit(limit)
    return project(found, cols)


def lookup(df: DataFrame, key, column: str = "id") -> DataFrame:
    """The row with one key value."""
    return df.where(F.col(column) == F.lit(key))


def lookup_many(df: DataFrame, keys: DataFrame, column: str = "id") -> DataFrame:
    """All rows whose key occurs in ``keys``."""
    keys = keys.select(column)
    return only_keys(df, keys, [column], measure(keys))


def page(df: DataFrame, offset: int = 0, limit: int = PAGE_SIZE, key: str = "id") -> DataFrame:
    """One page of the table in key order; a deep page is found by counting ranges of keys."""
    return selection.page(df, [key], offset, limit)


def page_after(df: DataFrame, last_key=None, limit: int = PAGE_SIZE, key: str = "id") -> DataFrame:
    """The page that follows ``last_key``; deep pages cost no more than the first."""
    rest = df if last_key is None else df.where(F.col(key) > F.lit(last_key))
    return rest.orderBy(key).limit(limit)


def _quoted(value: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(value, F.lit("'"), F.lit("''")), F.lit("'"))


def filter_text(
    companies: Column, categories: Column, start_date: Column, end_date: Column
) -> Column:
    """The AND predicate of one request per row, as SQL text over the review table.

    ``companies`` is an array of names, ``categories`` an array of codes; the dates are
    strings or dates. A part that is absent is left out.
    """
    start, end = F.nullif(start_date.cast("string"), F.lit("")), F.nullif(end_date.cast("string"), F.lit(""))
    company_part = F.when(
        F.size(companies) > 0,
        F.concat(F.lit("company IN ("), F.array_join(F.transform(companies, _quoted), ", "), F.lit(")")),
    )
    category_part = F.when(
        F.size(categories) > 0,
        F.concat(
            F.lit("category IN ("),
            F.array_join(F.transform(categories, lambda c: c.cast("string")), ", "),
            F.lit(")"),
        ),
    )
    date_part = (
        F.when(
            start.isNotNull() & end.isNotNull(),
            F.concat(F.lit("timestamp BETWEEN "), _quoted(start), F.lit(" AND "), _quoted(end)),
        )
        .when(start.isNotNull(), F.concat(F.lit("timestamp >= "), _quoted(start)))
        .when(end.isNotNull(), F.concat(F.lit("timestamp <= "), _quoted(end)))
    )
    return F.concat_ws(" AND ", company_part, category_part, date_part)
