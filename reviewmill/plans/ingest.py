"""Batch ingest: scraped pages into the stored review and company tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from reviewmill.operators.embedding import Embedder, embed_text
from reviewmill.operators.joins import sized
from reviewmill.operators.maintenance import changed, upsert
from reviewmill.session import cut_lineage
from reviewmill.sources.pages import extract_companies, extract_reviews


def numbered(df: DataFrame, order: str, first: Column) -> DataFrame:
    """Add consecutive ids in the order of a unique column, counting within range partitions.

    The ranges are written once, so that the row numbers and the partition sizes they are
    offset by belong together.
    """
    ranged = df.repartitionByRange(order).withColumn("_part", F.spark_partition_id())
    stored = cut_lineage(ranged)
    sizes = stored.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(order))
    return (
        stored.withColumn("_row", within)
        .join(F.broadcast(offsets), "_part")
        .withColumn("id", (first + F.col("_before") + F.col("_row") - 1).cast("int"))
        .drop("_part", "_row", "_before")
    )


def ingest_companies(
    companies: DataFrame, pages: DataFrame, embedder: Embedder | None = None
) -> DataFrame:
    """Company table after the companies listed on the pages were updated or added.

    Companies are known by their homepage; a new one gets the next free id.
    """
    listed = extract_companies(pages).select("name", "homepage", "country")
    listed = cut_lineage(embed_text(listed, "name", "embedding", embedder))
    ids = companies.select("homepage", "id")
    fresh = listed.join(sized(ids), "homepage", "left_anti")
    next_id = companies.agg(F.coalesce(F.max("id"), F.lit(0)) + 1).scalar()
    known = upsert(companies, listed.join(sized(ids), "homepage", "left_semi"), "homepage", ["name"])
    return known.unionByName(numbered(fresh, "homepage", next_id).select(*companies.columns))


def ingest_reviews(
    reviews: DataFrame,
    companies: DataFrame,
    pages: DataFrame,
    embedder: Embedder | None = None,
    batch_ts: Column | None = None,
) -> DataFrame:
    """Review table after the reviews on the pages were added or updated.

    Only new and changed reviews are embedded.
    """
    incoming = extract_reviews(pages, companies).drop("source")
    fresh = changed(cut_lineage(incoming), reviews)
    fresh = embed_text(fresh, "content", "embedding", embedder)
    return upsert(reviews, fresh, batch_ts=batch_ts)
