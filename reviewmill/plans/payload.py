"""Texts handed on for analysis: grouped payloads, CSV, previews, prompt rows."""

from __future__ import annotations

import string
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from reviewmill.fixed_values import PREVIEW_ROWS

PAYLOAD_KEYS = ("company", "category", "similarity_query")
PAYLOAD_BYTES = 16 * 1024 * 1024


def review_payload(
    sample: DataFrame,
    keys: Sequence[str] = PAYLOAD_KEYS,
    order: Sequence[str] = ("rn", "id"),
    content: str = "content",
) -> DataFrame:
    """Review texts per company, category and query; rows with a missing key are left out.

    ``sample`` is a budgeted sample, so a group holds no more rows than the budget.
    """
    complete = sample.where(" AND ".join(f"{k} IS NOT NULL" for k in keys))
    ranked = F.sort_array(F.collect_list(F.struct(*order, F.col(content).alias("_text"))))
    return complete.groupBy(*keys).agg(F.transform(ranked, lambda r: r["_text"]).alias("reviews"))


def payload_json(payload: DataFrame, keys: Sequence[str] = PAYLOAD_KEYS, max_bytes: int = PAYLOAD_BYTES) -> DataFrame:
    """One row: the whole payload of a request as a JSON array, groups in key order.

    A payload is one text for one prompt; one that was measured to have more than ``max_bytes`` is an error.
    """
    size = payload.agg(F.sum(F.octet_length(F.to_json(F.struct(*keys, "reviews"))))).first()[0] or 0
    if size > max_bytes:
        raise ValueError(f"a payload of {size} bytes is no prompt; draw a smaller sample")
    groups = F.sort_array(F.collect_list(F.struct(*keys, "reviews")))
    return payload.agg(F.to_json(groups, {"ignoreNullFields": "false"}).alias("payload"))


def json_lines(df: DataFrame) -> DataFrame:
    """Every row as one JSON object; NULLs and non-ASCII letters are kept."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def csv_header(df: DataFrame) -> str:
    return ",".join(df.columns)


def csv_lines(df: DataFrame) -> DataFrame:
    """CSV text of a report, one line per row, the header first."""
    header = df.sparkSession.range(1).select(F.lit(csv_header(df)).alias("line"))
    return header.union(df.select(F.to_csv(F.struct("*")).alias("line")))


def write_csv(df: DataFrame, path: str) -> None:
    """The report as CSV files with a header."""
    df.write.mode("errorifexists").option("header", True).csv(path)


def as_text(df: DataFrame) -> DataFrame:
    """All columns as strings; NULL stays NULL. Repeated names are numbered."""
    seen: dict[str, int] = {}
    names = []
    for name in df.columns:
        seen[name] = seen.get(name, 0) + 1
        names.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    by_place = df.toDF(*[f"_{i}" for i in range(len(names))])
    return by_place.select(*[F.col(f"_{i}").cast("string").alias(name) for i, name in enumerate(names)])


def preview(df: DataFrame, n: int = PREVIEW_ROWS) -> DataFrame:
    """The first ``n`` rows as text."""
    return as_text(df.limit(n))


def fill_template(template: str, values: Mapping[str, Column]) -> Column:
    """Text of a ``$name`` template with a column in place of each name; NULL prints nothing."""
    parts, end = [], 0
    for match in string.Template.pattern.finditer(template):
        parts.append(F.lit(template[end : match.start()]))
        name = match.group("named") or match.group("braced")
        if name:
            parts.append(F.coalesce(values[name].cast("string"), F.lit("")))
        elif match.group("escaped"):
            parts.append(F.lit("$"))
        else:
            raise ValueError(f"Bad placeholder in template: {template!r}")
        end = match.end()
    parts.append(F.lit(template[end:]))
    return F.concat(*parts)


def optional(part: Column, before: str = "", after: str = "") -> Column:
    """``part`` with text around it, or nothing when it is NULL or empty."""
    return F.when(F.coalesce(F.length(part), F.lit(0)) > 0, F.concat(F.lit(before), part, F.lit(after)))


def company_phrase(companies: Column) -> Column:
    """"company: X" for one company, "companies: X, Y" for several, NULL for none."""
    return F.when(F.size(companies) == 1, F.concat(F.lit("company: "), companies[0])).when(
        F.size(companies) > 1, F.concat(F.lit("companies: "), F.array_join(companies, ", "))
    )
