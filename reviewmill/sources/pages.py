"""Reviews, companies and links taken from tables of scraped pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from reviewmill.fixed_values import JSON_SCRIPT_TYPE, NEXT_PAGE_ELEMENT, REVIEW_PAGES
from reviewmill.operators.joins import latest_per_key, sized
from reviewmill.schema import PAGE_COMPANY, PAGE_REVIEW, page_json

JSON_ELEMENT = rf"""(?is)<(\w+)\b[^>]*\btype=["']{JSON_SCRIPT_TYPE}["'][^>]*>(.*?)</\1\s*>"""
NEXT_ELEMENT = rf"""(?is)<[^>]*\bname=["']{NEXT_PAGE_ELEMENT}["'][^>]*>"""
HREF = r"""(?is)\bhref=["']([^"']*)["']"""
HOMEPAGE_IN_URL = r"/review/([^/?#]+)"
PAGE_IN_URL = r"[?&]page=(\d+)"


def _page_props(html: Column, schema: T.StructType) -> Column:
    """``pageProps`` of the first JSON element; NULL if there is none or it cannot be read."""
    return F.from_json(F.regexp_extract(html, JSON_ELEMENT, 2), schema)["props"]["pageProps"]


def page_reviews(pages: DataFrame) -> DataFrame:
    """One row per review on each page; pages without reviews give none."""
    props = _page_props(F.col("html"), page_json(reviews=PAGE_REVIEW))
    found = pages.select(
        F.regexp_extract("url", HOMEPAGE_IN_URL, 1).alias("homepage"),
        F.explode(props["reviews"]).alias("r"),
    )
    return found.select(
        F.col("r.id").alias("id"),
        "homepage",
        F.try_to_timestamp(F.col("r.dates.publishedDate")).alias("timestamp"),
        F.col("r.text").alias("content"),
        F.col("r.rating").alias("rating"),
        F.col("r.likes").alias("likes"),
        F.lit("scraped").alias("source"),
    )


def extract_reviews(pages: DataFrame, companies: DataFrame) -> DataFrame:
    """Reviews of all pages with the company their page belongs to."""
    names = companies.select(
        "homepage", F.col("id").alias("company_id"), F.col("name").alias("company")
    )
    return (
        page_reviews(pages)
        .join(sized(names), "homepage")
        .select(
            "id", "company_id", "company", "timestamp", "content", "rating", "likes", "source"
        )
    )


def unknown_companies(pages: DataFrame, companies: DataFrame) -> DataFrame:
    """Reviews whose page belongs to no known company, to be looked at: :func:`extract_reviews` leaves them out."""
    return page_reviews(pages).join(sized(companies.select("homepage")), "homepage", "left_anti")


def extract_companies(pages: DataFrame) -> DataFrame:
    """Companies listed on the pages, one row per homepage (the latest page wins)."""
    props = _page_props(F.col("html"), page_json(newestBusinessUnits=PAGE_COMPANY))
    listed = pages.select("page_id", F.explode(props["newestBusinessUnits"]).alias("c")).select(
        "page_id",
        F.col("c.displayName").alias("name"),
        F.col("c.identifyingName").alias("homepage"),
        F.col("c.stars").alias("stars"),
        F.col("c.trustScore").alias("trust_score"),
        F.col("c.numberOfReviews").alias("n_reviews"),
        F.col("c.location.country").alias("country"),
    )
    return latest_per_key(listed, ["homepage"], [F.col("page_id").desc(), "name"]).drop("page_id")


def next_page_link(html: Column, host: str) -> Column:
    """Address of the following page, or NULL on the last one."""
    element = F.regexp_extract(html, NEXT_ELEMENT, 0)
    href = F.replace(F.regexp_extract(element, HREF, 1), F.lit("&amp;"), F.lit("&"))
    return F.when(href != "", F.concat(F.lit(host), href))


def page_links(html: Column) -> Column:
    """All link targets of a page, in order."""
    return F.regexp_extract_all(html, F.lit(HREF), F.lit(1))


def with_page_facts(pages: DataFrame) -> DataFrame:
    """Add the homepage a page belongs to, its number, and whether it lists any reviews."""
    props = _page_props(F.col("html"), page_json(reviews=PAGE_REVIEW))
    number = F.regexp_extract("url", PAGE_IN_URL, 1)
    return pages.select(
        "*",
        F.regexp_extract("url", HOMEPAGE_IN_URL, 1).alias("homepage"),
        F.when(number == "", F.lit(1)).otherwise(number.try_cast("int")).alias("page_no"),
        F.coalesce(F.size(props["reviews"]) > 0, F.lit(False)).alias("has_reviews"),
    )


def cap_pages(
    pages: DataFrame,
    key: str = "company",
    order: str = "page_no",
    has_reviews: str = "has_reviews",
    max_pages: int = REVIEW_PAGES,
) -> DataFrame:
    """The first ``max_pages`` pages of each company, ending before the first empty one.

    The rank filter limits every company before the shuffle, so the running minimum that
    follows sees at most ``max_pages`` rows of one company.
    """
    in_order = Window.partitionBy(key).orderBy(order)
    first = pages.withColumn("_rn", F.row_number().over(in_order)).where(F.col("_rn") <= max_pages)
    so_far = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        first.withColumn("_open", F.min(F.col(has_reviews).cast("int")).over(so_far))
        .where("_open = 1")
        .drop("_rn", "_open")
    )
