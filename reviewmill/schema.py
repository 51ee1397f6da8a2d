"""Schemas of the tables and the cast that brings any frame to one of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

VECTOR = T.ArrayType(T.FloatType())

COMPANY = T.StructType(
    [
        T.StructField("id", T.IntegerType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("homepage", T.StringType(), False),
        T.StructField("country", T.StringType(), False),
        T.StructField("embedding", VECTOR),
    ]
)

REVIEW = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("company_id", T.IntegerType(), False),
        T.StructField("company", T.StringType(), False),
        T.StructField("timestamp", T.TimestampType(), False),
        T.StructField("created_at", T.TimestampType(), False),
        T.StructField("content", T.StringType()),
        T.StructField("rating", T.IntegerType(), False),
        T.StructField("likes", T.IntegerType()),
        T.StructField("category", T.IntegerType()),
        T.StructField("embedding", VECTOR),
    ]
)

MESSAGE = T.StructType(
    [
        T.StructField("conv_id", T.LongType(), False),
        T.StructField("turn", T.LongType(), False),
        T.StructField("role", T.StringType(), False),
        T.StructField("text", T.StringType()),
    ]
)

METADATA = T.StructType(
    [
        T.StructField("companies", T.ArrayType(T.StringType())),
        T.StructField("start_date", T.StringType()),
        T.StructField("end_date", T.StringType()),
        T.StructField("categories", T.ArrayType(T.StringType())),
    ]
)

# JSON carried by a scraped page.
PAGE_REVIEW = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("rating", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("likes", T.IntegerType()),
        T.StructField("dates", T.StructType([T.StructField("publishedDate", T.StringType())])),
    ]
)
PAGE_COMPANY = T.StructType(
    [
        T.StructField("displayName", T.StringType()),
        T.StructField("identifyingName", T.StringType()),
        T.StructField("stars", T.DoubleType()),
        T.StructField("trustScore", T.DoubleType()),
        T.StructField("numberOfReviews", T.IntegerType()),
        T.StructField("location", T.StructType([T.StructField("country", T.StringType())])),
    ]
)


def page_json(**lists: T.StructType) -> T.StructType:
    """Schema of the page JSON, holding only the named lists of records."""
    fields = [T.StructField(name, T.ArrayType(record)) for name, record in lists.items()]
    page_props = T.StructType([T.StructField("pageProps", T.StructType(fields))])
    return T.StructType([T.StructField("props", page_props)])


def conform(df: DataFrame, schema: T.StructType, renames: dict[str, str] | None = None) -> DataFrame:
    """Select the columns of ``schema`` in order, cast; columns ``df`` lacks become NULL."""
    source_of = {new: old for old, new in (renames or {}).items()}
    columns = []
    for field in schema:
        source = source_of.get(field.name, field.name)
        column = F.col(source) if source in df.columns else F.lit(None)
        columns.append(column.cast(field.dataType).alias(field.name))
    return df.select(*columns)
