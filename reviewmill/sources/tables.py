"""Reading, writing and publishing the stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession, functions as F
from pyspark.sql import types as T

from reviewmill.functions.vectors import vector_from_text
from reviewmill.schema import REVIEW, conform

MONTH_COLUMN = "month"


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A whole table; a declared schema saves the footer scan that infers one."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(path)


def read_export(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A table exported from a database as CSV with a header; vectors are bracketed texts.

    Texts may hold line breaks, so a file is read by one task: export many files.
    """
    texts = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
    rows = (
        spark.read.schema(texts)
        .options(header=True, multiLine=True, escape='"', enforceSchema=False)
        .csv(path)
    )
    return rows.select(
        *[
            (
                vector_from_text(F.col(f.name))
                if isinstance(f.dataType, T.ArrayType)
                else F.col(f.name).cast(f.dataType)
            ).alias(f.name)
            for f in schema
        ]
    )


def empty_table(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def bloom_filter(column: str, rows_per_group: int = 100_000) -> dict[str, str]:
    """Writer options that let a scan skip row groups by values of ``column``."""
    return {
        f"parquet.bloom.filter.enabled#{column}": "true",
        f"parquet.bloom.filter.expected.ndv#{column}": str(rows_per_group),
    }


def write_reviews(df: DataFrame, path: str) -> str:
    """Reviews as parquet by month, so that date filters read only the months they need.

    Rebalancing gives each month files of about the advisory size: small months are put
    together in one task, a month that holds much of the table is split over many. Sorted
    by company, row groups can be skipped by company; Bloom filters skip them by id.
    """
    _by_month(df).mode("errorifexists").parquet(path)
    return path


def _by_month(df: DataFrame) -> DataFrameWriter:
    by_month = conform(df, REVIEW).withColumn(MONTH_COLUMN, month_of(F.col("timestamp")))
    balanced = by_month.hint("rebalance", F.col(MONTH_COLUMN))
    ordered = balanced.sortWithinPartitions(MONTH_COLUMN, "company", "timestamp")
    return ordered.write.partitionBy(MONTH_COLUMN).options(**bloom_filter("id"))


def month_of(timestamp: Column) -> Column:
    return F.date_format(timestamp, "yyyy-MM")


def _stored(spark: SparkSession, path: str) -> DataFrame:
    """Stored reviews with their month."""
    return spark.read.schema(T.StructType([*REVIEW.fields, T.StructField(MONTH_COLUMN, T.StringType())])).parquet(path)


def month_predicate(start_date=None, end_date=None):
    """Partition filter that goes with a date range."""
    month, test = F.col(MONTH_COLUMN), F.lit(True)
    if start_date:
        test = test & (month >= F.date_format(F.lit(start_date).cast("timestamp"), "yyyy-MM"))
    if end_date:
        test = test & (month <= F.date_format(F.lit(end_date).cast("timestamp"), "yyyy-MM"))
    return test


def read_reviews(spark: SparkSession, path: str, start_date=None, end_date=None) -> DataFrame:
    """Stored reviews, limited to the months of a date range."""
    return _stored(spark, path).where(month_predicate(start_date, end_date)).drop(MONTH_COLUMN)


def publish(spark: SparkSession, name: str, path: str) -> None:
    """Point the catalog view ``name`` at a finished path.

    New table versions go to new paths; readers see the old one until the view is
    replaced, and nothing is overwritten while it is read. The month is not part of the view.
    """
    columns = ", ".join(f"`{c}`" for c in spark.read.parquet(path).columns if c != MONTH_COLUMN)
    spark.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT {columns} FROM parquet.`{path}`")
