"""Review tables derived from the test tables (orders, events, documents, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One review per order: month granularity, all category codes, NULL categories and likes."""
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    code = F.col("o_custkey") % 7
    return (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("o_orderkey").cast("string").alias("id"),
            F.col("c_nationkey").alias("company_id"),
            F.col("n_name").alias("company"),
            F.col("o_orderdate").cast("timestamp").alias("timestamp"),
            F.substring("o_orderpriority", 1, 1).cast("int").alias("rating"),
            F.when(code != 6, code - 1).cast("int").alias("category"),
            F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey") % 11).cast("int").alias("likes"),
        )
    )


def event_reviews(events: DataFrame) -> DataFrame:
    """One review per event: times of day, day granularity; also used on a stream."""
    return events.select(
        F.col("event_id").cast("string").alias("id"),
        F.col("user_id").cast("int").alias("company_id"),
        F.col("event_type").alias("company"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        (F.col("event_id") % 5 + 1).cast("int").alias("rating"),
        (F.col("user_id") % 5).cast("int").alias("category"),
    )


def text_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One review per document, with its vector where there is one."""
    documents = table(spark, sf_dir, "documents")
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    lang = F.col("lang")
    return documents.join(vectors, F.col("doc_id") == F.col("vec_id"), "left").select(
        F.col("doc_id").cast("string").alias("id"),
        F.col("source").alias("company"),
        F.col("text").alias("content"),
        (F.col("doc_id") % 5 + 1).cast("int").alias("rating"),
        F.when(lang == "en", 0).when(lang == "de", 1).when(lang == "fr", 2).otherwise(4).alias("category"),
        "embedding",
    )


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One company per nation."""
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return (
        nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .join(vectors, F.col("n_nationkey") == F.col("vec_id"), "left")
        .select(
            F.col("n_nationkey").alias("id"),
            F.col("n_name").alias("name"),
            F.lower("n_name").alias("homepage"),
            F.col("r_name").alias("country"),
            "embedding",
        )
    )


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two vectors standing in for embedded query texts."""
    return (
        table(spark, sf_dir, "embeddings")
        .where(F.col("vec_id").isin(3, 7))
        .select(
            F.col("vec_id").cast("string").alias("similarity_query"),
            F.col("embedding").alias("q_embedding"),
        )
    )
