"""One function per operator: ``(spark, sf_dir) -> DataFrame`` over the whole test tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from reviewmill.fixed_values import (
    REPORT_CATEGORY_STARS,
    REPORT_COMPANY_STARS,
    REPORT_COMPARE_SERIES,
    REPORT_RATING_SERIES,
    REPORT_RATING_SHARE,
)
from reviewmill.functions import codes, dates, text, vectors
from reviewmill.operators import (
    conversations,
    embedding,
    filters,
    maintenance,
    neighbours,
    periods,
    requests,
    sampling,
    selection,
)
from reviewmill.plans import actions, adhoc, ingest, payload, reports
from reviewmill.schema import REVIEW, conform
from reviewmill.session import shared_path
from reviewmill.sources import fixtures, pages, tables, versions
from reviewmill.streaming import jobs, store

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

BATCH_TIME = "2024-06-01 12:00:00"
WEEK_SPAN = ("1999-01-01", "1999-04-30")
SAMPLE_SEED = 11
SAMPLE_TOKENS = 50_000


def query(function: Query) -> Query:
    """Register a query; zone-free timestamps of the test tables are read as UTC."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return function(spark, sf_dir)

    QUERIES[function.__name__] = run
    return run


def _plain(df: DataFrame) -> DataFrame:
    """Timestamps without a zone, the form the comparison reads."""
    return df.select(
        *[
            F.col(f.name).cast("timestamp_ntz").alias(f.name)
            if isinstance(f.dataType, T.TimestampType)
            else F.col(f.name)
            for f in df.schema
        ]
    )


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.event_reviews(fixtures.table(spark, sf_dir, "events"))


def _sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.text_reviews(spark, sf_dir).drop("embedding")
    return rows.withColumn("similarity_query", F.col("rating").cast("string"))


# --- scans, paging, schema -------------------------------------------------------------


@query
def scan_reviews(spark, sf_dir):
    return _plain(fixtures.order_reviews(spark, sf_dir))


@query
def lookup_by_id(spark, sf_dir):
    return _plain(filters.lookup(fixtures.order_reviews(spark, sf_dir), "1234"))


@query
def lookup_many(spark, sf_dir):
    lineitem = fixtures.table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    wanted = lineitem.select(F.col("l_orderkey").cast("string").alias("id"))
    return _plain(filters.lookup_many(fixtures.order_reviews(spark, sf_dir), wanted))


@query
def page_reviews(spark, sf_dir):
    return _plain(filters.page(fixtures.order_reviews(spark, sf_dir), offset=200))


@query
def deep_page(spark, sf_dir):
    """A page far into the table, found by counting ranges of keys."""
    return _plain(selection.page(fixtures.order_reviews(spark, sf_dir), ["id"], offset=1200, limit=50, few=100))


@query
def newest_rows(spark, sf_dir):
    """Many newest rows, left in their tasks."""
    rows = fixtures.order_reviews(spark, sf_dir)
    return _plain(selection.lowest(rows, [-F.unix_micros("timestamp"), "id"], 1100, unique=True, few=100))


@query
def page_after_key(spark, sf_dir):
    return _plain(filters.page_after(fixtures.order_reviews(spark, sf_dir), "1234"))


@query
def conform_schema(spark, sf_dir):
    return _plain(conform(fixtures.order_reviews(spark, sf_dir), REVIEW).drop("embedding"))


# --- table maintenance -----------------------------------------------------------------


def _target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conform(fixtures.order_reviews(spark, sf_dir), REVIEW).drop("embedding")


def _open_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = fixtures.table(spark, sf_dir, "orders").where("o_orderstatus = 'P'")
    return orders.select(F.col("o_orderkey").cast("string").alias("id"))


def _new_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).drop("category")
    return rows.withColumn("id", F.concat(F.lit("e"), "id"))


def _upsert_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two deliveries of every open order (the later one counts) and all events as new reviews."""
    known = _target(spark, sf_dir).join(_open_orders(spark, sf_dir), "id")
    first = known.select("id", "company_id", "company", "timestamp", "rating")
    later = first.withColumn("timestamp", F.col("timestamp") + F.expr("INTERVAL 1 DAY")).withColumn(
        "rating", 6 - F.col("rating")
    )
    return first.unionByName(later).unionByName(_new_reviews(spark, sf_dir))


@query
def insert_reviews(spark, sf_dir):
    batch_ts = F.lit(BATCH_TIME).cast("timestamp")
    target, batch = _target(spark, sf_dir), _new_reviews(spark, sf_dir)
    return _plain(maintenance.insert(target, batch, batch_ts=batch_ts))


@query
def upsert_reviews(spark, sf_dir):
    batch_ts = F.lit(BATCH_TIME).cast("timestamp")
    return _plain(
        maintenance.upsert(_target(spark, sf_dir), _upsert_batch(spark, sf_dir), batch_ts=batch_ts)
    )


@query
def upsert_out_of_order(spark, sf_dir):
    """The later deliveries are merged first; the earlier ones then change nothing."""
    batch_ts = F.lit(BATCH_TIME).cast("timestamp")
    batch, target = _upsert_batch(spark, sf_dir), _target(spark, sf_dir)
    known = target.select("id", F.col("timestamp").alias("_stored"))
    late = batch.join(known, "id", "left").where("_stored IS NULL OR timestamp > _stored").drop("_stored")
    first = maintenance.upsert(target, late, batch_ts=batch_ts)
    return _plain(maintenance.upsert(first, batch, batch_ts=batch_ts))


def _stored_reviews(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> versions.Store:
    """The target in a store of its own, published under a name of its own."""
    rows = _target(spark, sf_dir) if rows is None else rows
    root = shared_path(spark, "reviews")
    return versions.create(spark, root, f"review_{root.rsplit('-', 1)[1]}", rows)


def _published(store: versions.Store, *without: str) -> DataFrame:
    return _plain(store.spark.table(store.name).drop("embedding", *without))


@query
def merge_stored_months(spark, sf_dir):
    """Reviews stored by month, a batch merged into the months it touches, and read by name."""
    store = _stored_reviews(spark, sf_dir)
    versions.upsert(store, _upsert_batch(spark, sf_dir), batch_ts=F.lit(BATCH_TIME).cast("timestamp"))
    return _published(store)


@query
def update_stored_months(spark, sf_dir):
    store = _stored_reviews(spark, sf_dir)
    versions.update(store, _upsert_batch(spark, sf_dir))
    return _published(store)


@query
def delete_stored_months(spark, sf_dir):
    """Reviews deleted from their months, months put together, old folders removed."""
    store = _stored_reviews(spark, sf_dir)
    versions.delete(store, _open_orders(spark, sf_dir))
    versions.compact(store, most_folders=0)
    versions.vacuum(store, older_than_hours=0)
    return _published(store)


@query
def insert_stored_months(spark, sf_dir):
    store = _stored_reviews(spark, sf_dir)
    versions.insert(store, _new_reviews(spark, sf_dir), batch_ts=F.lit(BATCH_TIME).cast("timestamp"))
    return _published(store)


def _edited_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a store after an upsert and a delete."""
    store = _stored_reviews(spark, sf_dir)
    versions.upsert(store, _upsert_batch(spark, sf_dir), batch_ts=F.lit(BATCH_TIME).cast("timestamp"))
    versions.delete(store, spark.table(store.name).where("company = 'NATION_3'").select("id"))
    return versions.cube(spark, store.name)


@query
def cube_rating_share(spark, sf_dir):
    return reports.rating_share(_edited_cube(spark, sf_dir))


@query
def cube_category_stars(spark, sf_dir):
    return reports.category_stars(_edited_cube(spark, sf_dir))


@query
def cube_compare_series(spark, sf_dir):
    return reports.compare_series(_edited_cube(spark, sf_dir))


@query
def cube_rating_series(spark, sf_dir):
    return reports.rating_series(_edited_cube(spark, sf_dir))


@query
def published_between(spark, sf_dir):
    """Reviews of a published table within dates, by the name alone."""
    store = _stored_reviews(spark, sf_dir)
    found = actions.select_reviews(store.name, actions.Metadata(start_date="1996-02-10", end_date="1997-05-20"))
    return _plain(found.select("id", "company", "timestamp", "rating", "category"))


@query
def sql_reviews_between(spark, sf_dir):
    """Ad-hoc text over the table function of a published table."""
    store = _stored_reviews(spark, sf_dir)
    return adhoc.run_sql(
        spark,
        f"SELECT company, count(*) AS n_reviews FROM {store.name}s_between('1999-03-01', '1999-06-15') GROUP BY company",
    )


@query
def update_reviews(spark, sf_dir):
    return _plain(maintenance.update(_target(spark, sf_dir), _upsert_batch(spark, sf_dir)))


@query
def delete_reviews(spark, sf_dir):
    return _plain(maintenance.delete(_target(spark, sf_dir), _open_orders(spark, sf_dir)))


@query
def changed_reviews(spark, sf_dir):
    return _plain(maintenance.changed(_upsert_batch(spark, sf_dir), _target(spark, sf_dir)))


# --- pages -----------------------------------------------------------------------------


def _script(records: Column, name: str) -> Column:
    json = F.to_json(F.struct(F.struct(F.struct(records.alias(name)).alias("pageProps")).alias("props")))
    return F.concat(
        F.lit('<html><body><script type="application/json">'), json, F.lit("</script></body></html>")
    )


def _review_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scraped pages holding up to 20 reviews of one company each."""
    rows = fixtures.order_reviews(spark, sf_dir)
    record = F.struct(
        "id",
        "rating",
        F.concat(F.lit("Order «"), "id", F.lit("»\nrated")).alias("text"),
        "likes",
        F.struct(F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'.000Z'").alias("publishedDate")).alias(
            "dates"
        ),
    )
    page_id = F.floor(F.col("id").cast("bigint") / 20)
    return (
        rows.groupBy(F.lower("company").alias("homepage"), page_id.alias("page_id"))
        .agg(F.collect_list(record).alias("reviews"))
        .select(
            "page_id",
            F.format_string("https://reviews.example/review/%s?page=%d", "homepage", F.col("page_id") + 1).alias("url"),
            _script(F.col("reviews"), "reviews").alias("html"),
        )
    )


@query
def extract_reviews(spark, sf_dir):
    companies = fixtures.companies(spark, sf_dir)
    return _plain(pages.extract_reviews(_review_pages(spark, sf_dir), companies))


@query
def unknown_company_reviews(spark, sf_dir):
    """Reviews on pages of companies that are not in the company table."""
    known = fixtures.companies(spark, sf_dir).where("id < 10")
    return pages.unknown_companies(_review_pages(spark, sf_dir), known).select("id", "homepage", "rating")


def _company_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages listing customers as companies; every one is listed again, with other stars, later."""
    customer = fixtures.table(spark, sf_dir, "customer")
    nation = fixtures.table(spark, sf_dir, "nation")
    listed = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    listed = listed.withColumn("listing", F.explode(F.array(F.lit(0), F.lit(1))))
    record = F.struct(
        F.col("c_name").alias("displayName"),
        F.lower("c_name").alias("identifyingName"),
        (F.col("c_custkey") % 5 + F.col("listing") / 2).alias("stars"),
        F.col("c_acctbal").alias("trustScore"),
        F.col("c_custkey").cast("int").alias("numberOfReviews"),
        F.struct(F.col("n_name").alias("country")).alias("location"),
    )
    page_id = F.floor(F.col("c_custkey") / 20) * 2 + F.col("listing")
    return (
        listed.groupBy(page_id.alias("page_id"))
        .agg(F.collect_list(record).alias("units"))
        .select("page_id", _script(F.col("units"), "newestBusinessUnits").alias("html"))
    )


@query
def extract_companies(spark, sf_dir):
    return pages.extract_companies(_company_pages(spark, sf_dir))


@query
def next_page_link(spark, sf_dir):
    path = F.regexp_extract("url", r"^https?://[^/]+(/[^#]*)", 1)
    href = F.when(F.contains(F.col("url"), F.lit("page=")), F.concat(F.lit(' href="'), path, F.lit('"')))
    button = F.concat(
        F.lit('<a class="next" name="pagination-button-next"'), F.coalesce(href, F.lit("")), F.lit(">Next</a>")
    )
    html = F.concat("html", button)
    return fixtures.table(spark, sf_dir, "pages").select(
        "page_id", pages.next_page_link(html, "https://reviews.example").alias("next_url")
    )


@query
def page_links(spark, sf_dir):
    links = pages.page_links(F.col("html"))
    return fixtures.table(spark, sf_dir, "pages").select(
        "page_id", F.posexplode(links).alias("pos", "link")
    )


@query
def cap_pages(spark, sf_dir):
    crawled = fixtures.table(spark, sf_dir, "pages").select(
        F.regexp_extract("url", "^https?://([^/]+)", 1).alias("company"),
        F.col("page_id").alias("page_no"),
        (F.length("html") > 2000).alias("has_reviews"),
    )
    return pages.cap_pages(crawled).select("company", "page_no")


@query
def ingest_reviews(spark, sf_dir):
    """All reviews scraped into a table that holds the open orders, some of them with other dates."""
    stored = _target(spark, sf_dir).join(_open_orders(spark, sf_dir), "id")
    moved = F.when(F.col("rating") == 1, F.col("timestamp") - F.expr("INTERVAL 1 DAY"))
    stored = stored.withColumn("timestamp", F.coalesce(moved, F.col("timestamp")))
    stored = conform(stored, REVIEW)
    found = ingest.ingest_reviews(
        stored,
        fixtures.companies(spark, sf_dir),
        _review_pages(spark, sf_dir),
        batch_ts=F.lit(BATCH_TIME).cast("timestamp"),
    )
    return _plain(found.withColumn("dim", F.size("embedding")).drop("embedding"))


@query
def ingest_companies(spark, sf_dir):
    """The nations' companies after customers were listed; customers become new companies."""
    found = ingest.ingest_companies(
        fixtures.companies(spark, sf_dir), _company_pages(spark, sf_dir)
    )
    return found.select("id", "name", "homepage", "country")


@query
def capped_reviews(spark, sf_dir):
    """Reviews on the first pages of every company."""
    crawled = pages.with_page_facts(_review_pages(spark, sf_dir))
    kept = pages.cap_pages(crawled, key="homepage")
    found = pages.extract_reviews(kept, fixtures.companies(spark, sf_dir))
    return found.select("id", "company", "rating")


# --- text output -----------------------------------------------------------------------


@query
def report_csv(spark, sf_dir):
    return payload.csv_lines(reports.rating_share(fixtures.order_reviews(spark, sf_dir)))


@query
def sql_preview(spark, sf_dir):
    adhoc.register(review=fixtures.order_reviews(spark, sf_dir))
    found = adhoc.run_sql(
        spark, "SELECT company, rating, likes FROM review ORDER BY CAST(id AS bigint) LIMIT 50"
    )
    return payload.preview(found)


@query
def review_payload(spark, sf_dir):
    rows = _sample_rows(spark, sf_dir).withColumn(
        "category", codes.category_name(F.col("category"))
    )
    sample = sampling.weighted_sample(rows, 100, SAMPLE_SEED).withColumn("rn", F.col("id").cast("int"))
    grouped = payload.review_payload(sample)
    return grouped.select(
        "company",
        "category",
        "similarity_query",
        F.size("reviews").alias("n_reviews"),
        F.array_join("reviews", "\n--\n").alias("reviews"),
    )


@query
def review_payload_json(spark, sf_dir):
    """The payload as JSON, read back."""
    rows = _sample_rows(spark, sf_dir).withColumn(
        "category", codes.category_name(F.col("category"))
    )
    sample = sampling.weighted_sample(rows, 100, SAMPLE_SEED).withColumn("rn", F.col("id").cast("int"))
    text_row = payload.payload_json(payload.review_payload(sample))
    record = "array<struct<company string, category string, similarity_query string, reviews array<string>>>"
    parsed = text_row.select(F.inline(F.from_json("payload", record)))
    return parsed.select("company", "category", "similarity_query", F.explode("reviews").alias("content"))


# --- projections and filters -----------------------------------------------------------


@query
def project_cols(spark, sf_dir):
    return filters.project(fixtures.order_reviews(spark, sf_dir), ["id", "company", "rating"])


@query
def filter_equals(spark, sf_dir):
    test = filters.equals_predicate({"category": 0, "rating": 5, "company": "", "likes": None})
    return fixtures.order_reviews(spark, sf_dir).where(test).select("id", "company", "rating", "category")


MEMBERS = {"company": ["NATION_3", "NATION_7"], "category": [1, 4], "rating": []}


@query
def filter_in_any(spark, sf_dir):
    test = filters.membership_predicate(MEMBERS)
    return fixtures.order_reviews(spark, sf_dir).where(test).select("id", "company", "category")


@query
def filter_in_all(spark, sf_dir):
    test = filters.membership_predicate(MEMBERS, mode="all")
    return fixtures.order_reviews(spark, sf_dir).where(test).select("id", "company", "category")


@query
def filter_dates(spark, sf_dir):
    """All four forms of the date filter, counted by company in one pass."""
    forms = {
        "both": filters.date_predicate("1997-01-01", "1998-06-15"),
        "start": filters.date_predicate("1999-07-01", ""),
        "end": filters.date_predicate(None, "1996-02-29"),
        "none": filters.date_predicate(),
    }
    rows = fixtures.order_reviews(spark, sf_dir)
    return rows.groupBy("company").agg(
        *[F.count_if(test).alias(f"n_{name}") for name, test in forms.items()]
    )


@query
def review_search(spark, sf_dir):
    found = filters.review_search(
        fixtures.order_reviews(spark, sf_dir),
        equals={"rating": 4},
        members=MEMBERS,
        start_date="1996-01-01",
        end_date="2000-12-31",
        cols=["id", "company", "timestamp", "category"],
        limit=150,
    )
    return _plain(found)


@query
def filter_text(spark, sf_dir):
    rows = fixtures.order_reviews(spark, sf_dir)
    day = F.date_format("timestamp", "yyyy-MM-dd")
    companies = F.when(F.col("rating") > 1, F.array("company", F.lit("O'Neil"))).otherwise(F.array())
    categories = F.when(F.col("category").isNotNull(), F.array("category")).otherwise(F.array())
    start = F.when(F.col("rating") > 2, day).otherwise("")
    end = F.when(F.col("likes").isNotNull(), day)
    return rows.select("id", filters.filter_text(companies, categories, start, end).alias("filter"))


@query
def newest_reviews(spark, sf_dir):
    return _plain(filters.newest_first(fixtures.order_reviews(spark, sf_dir)).limit(100))


# --- joins and neighbours --------------------------------------------------------------


@query
def review_company_join(spark, sf_dir):
    rows = fixtures.order_reviews(spark, sf_dir).select("id", "company_id", "rating")
    return maintenance.with_company(rows, fixtures.companies(spark, sf_dir))


@query
def knn_single(spark, sf_dir):
    """Rows nearest to one vector, more of them than have a vector at sf0.01."""
    vector = fixtures.query_vectors(spark, sf_dir).where("similarity_query = '3'").first().q_embedding
    found = neighbours.nearest_one(fixtures.text_reviews(spark, sf_dir), vector, 600)
    return found.select("id", F.round("dist", 6).alias("dist"))


@query
def knn_reviews(spark, sf_dir):
    found = neighbours.retrieve(
        fixtures.query_vectors(spark, sf_dir), fixtures.text_reviews(spark, sf_dir)
    )
    return found.withColumn("dist", F.round("dist", 6))


@query
def knn_all_vectors(spark, sf_dir):
    """The five vectors nearest to each vector."""
    vecs = fixtures.table(spark, sf_dir, "embeddings").withColumn("id", F.col("vec_id"))
    found = neighbours.nearest(vecs, vecs, 5, query_key="vec_id", query_vector="embedding")
    return found.withColumn("dist", F.round("dist", 6))


@query
def nearest_company(spark, sf_dir):
    mentions = fixtures.table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("mention"), "embedding"
    )
    found = neighbours.nearest_name(mentions, fixtures.companies(spark, sf_dir))
    return found.withColumn("dist", F.round("dist", 6))


@query
def knn_lsh(spark, sf_dir):
    """Approximate neighbours of every vector among all vectors."""
    vecs = fixtures.table(spark, sf_dir, "embeddings").withColumn("id", F.col("vec_id"))
    found = neighbours.nearest_lsh(vecs, vecs, 5, query_key="vec_id", query_vector="embedding")
    return found.withColumn("dist", F.round("dist", 6))


@query
def knn_lsh_recall(spark, sf_dir):
    """Whether the approximate search finds at least 0.95 of the exact neighbours, and all of them in number."""
    vecs = fixtures.table(spark, sf_dir, "embeddings").withColumn("id", F.col("vec_id"))
    names = {"query_key": "vec_id", "query_vector": "embedding"}
    exact, found = (search(vecs, vecs, 5, **names) for search in (neighbours.nearest, neighbours.nearest_lsh))
    both = exact.select("vec_id", "id").join(found.select("vec_id", "id", F.lit(1).alias("hit")), ["vec_id", "id"], "left")
    counted = both.agg(F.count("*").alias("n"), F.count("hit").alias("hits"))
    return counted.select(F.col("n").alias("n_neighbours"), (F.col("hits") >= 0.95 * F.col("n")).alias("recall_reached"))


@query
def knn_blocks(spark, sf_dir):
    """Neighbours where neither side is held by a task: blocks against blocks."""
    vecs = fixtures.table(spark, sf_dir, "embeddings").withColumn("id", F.col("vec_id"))
    found = neighbours.nearest(vecs, vecs, 5, query_key="vec_id", query_vector="embedding", held=50, block=150)
    return found.withColumn("dist", F.round("dist", 6))


# --- reports ---------------------------------------------------------------------------


@query
def report_rating_share(spark, sf_dir):
    return reports.rating_share(fixtures.order_reviews(spark, sf_dir))


@query
def report_category_stars(spark, sf_dir):
    return reports.category_stars(fixtures.order_reviews(spark, sf_dir))


@query
def ts_ratings_month(spark, sf_dir):
    return reports.rating_series(fixtures.order_reviews(spark, sf_dir))


@query
def ts_ratings_week(spark, sf_dir):
    span = filters.date_predicate(*WEEK_SPAN)
    return reports.rating_series(fixtures.order_reviews(spark, sf_dir).where(span))


@query
def ts_ratings_day(spark, sf_dir):
    return reports.rating_series(_events(spark, sf_dir))


@query
def ts_ratings_fixed_day(spark, sf_dir):
    return reports.rating_series(fixtures.order_reviews(spark, sf_dir), granularity=dates.DAY)


@query
def ts_diverging_counts(spark, sf_dir):
    return reports.diverging_counts(fixtures.order_reviews(spark, sf_dir))


@query
def ts_compare(spark, sf_dir):
    return reports.compare_series(fixtures.order_reviews(spark, sf_dir))


@query
def ts_compare_week(spark, sf_dir):
    """Requested companies and a weekly span; a company without reviews gives no rows."""
    span = filters.date_predicate(*WEEK_SPAN)
    wanted = ["NATION_1", "NATION_2", "NATION_99"]
    return reports.compare_series(fixtures.order_reviews(spark, sf_dir).where(span), wanted)


@query
def ts_compare_day(spark, sf_dir):
    return reports.compare_series(_events(spark, sf_dir))


@query
def report_company_stars_pct(spark, sf_dir):
    return reports.company_stars_pct(fixtures.order_reviews(spark, sf_dir))


@query
def company_star_bars(spark, sf_dir):
    bars = reports.company_star_bars(fixtures.order_reviews(spark, sf_dir))
    return bars.withColumn("pct", F.round("pct", 9))


@query
def company_summary(spark, sf_dir):
    return reports.company_summary(fixtures.order_reviews(spark, sf_dir))


@query
def period_bounds(spark, sf_dir):
    return _plain(periods.period_bounds(_events(spark, sf_dir)))


@query
def pick_granularity(spark, sf_dir):
    """Granularity of three selections, side by side."""
    rows = fixtures.order_reviews(spark, sf_dir)
    spans = {
        "whole": rows,
        "weeks": rows.where(filters.date_predicate(*WEEK_SPAN)),
        "days": rows.where(filters.date_predicate("1999-01-01", "1999-02-10")),
    }
    found = [
        periods.pick_granularity(part).select(F.lit(name).alias("span"), "granularity")
        for name, part in spans.items()
    ]
    return found[0].union(found[1]).union(found[2])


@query
def reports_without_rows(spark, sf_dir):
    """Every report of a selection that no review passes: no rows, but for the labels of categories."""
    rows = fixtures.order_reviews(spark, sf_dir)
    built = actions.build_reports(rows, actions.Metadata(["nobody"], "1999-01-01"), list(reports.REPORTS))
    counts = [df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("report"), "n_rows") for name, df in built.items()]
    return reduce(DataFrame.unionByName, counts)


@query
def report_values_by_name(spark, sf_dir):
    """Reports of a request by their names, one measure of each row."""
    rows = fixtures.order_reviews(spark, sf_dir)
    metadata = actions.Metadata(["NATION_4", "NATION_9"], "1996-01-01", "1998-12-31")
    measures = {
        REPORT_CATEGORY_STARS: (F.col("category"), F.col("total")),
        REPORT_RATING_SHARE: (F.col("rating").cast("string"), F.col("count")),
        REPORT_RATING_SERIES: (F.col("period").cast("string"), F.col("stars_1") + 10 * F.col("stars_5")),
        REPORT_COMPARE_SERIES: (F.concat_ws("|", "company", "period"), F.col("count")),
        REPORT_COMPANY_STARS: (F.col("company"), F.round(10 * F.col("pct_stars_3")).cast("bigint")),
    }
    built = actions.build_reports(rows, metadata, list(measures))
    parts = [
        df.select(F.lit(name).alias("report"), measures[name][0].alias("row"), measures[name][1].cast("bigint").alias("measure"))
        for name, df in built.items()
    ]
    return reduce(DataFrame.unionByName, parts)


@query
def report_by_name(spark, sf_dir):
    """All five reports of a request, their rows counted."""
    rows = fixtures.order_reviews(spark, sf_dir)
    metadata = actions.Metadata(["NATION_4", "NATION_9"], "1996-01-01", "1998-12-31", ["counseling"])
    names = [
        REPORT_RATING_SERIES,
        REPORT_CATEGORY_STARS,
        REPORT_RATING_SHARE,
        REPORT_COMPARE_SERIES,
        REPORT_COMPANY_STARS,
    ]
    built = actions.build_reports(rows, metadata, names)
    counts = [
        df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("report"), "n_rows")
        for name, df in built.items()
    ]
    result = counts[0]
    for part in counts[1:]:
        result = result.union(part)
    return result


# --- sampling --------------------------------------------------------------------------


@query
def group_weights(spark, sf_dir):
    weights = sampling.group_weights(_sample_rows(spark, sf_dir))
    return weights.withColumn("weight", F.round("weight", 9))


@query
def uniform_sample(spark, sf_dir):
    return sampling.uniform_sample(_sample_rows(spark, sf_dir), seed=SAMPLE_SEED).select(
        "id", "company", "rating", "content"
    )


@query
def avg_letters(spark, sf_dir):
    """Mean length of the sampled texts: letters in place of tokens."""
    found = sampling.average_tokens(_sample_rows(spark, sf_dir), seed=SAMPLE_SEED, tokenizer=F.length)
    return found.withColumn("avg_tokens", F.round("avg_tokens", 6))


@query
def avg_tokens(spark, sf_dir):
    found = sampling.average_tokens(_sample_rows(spark, sf_dir), seed=SAMPLE_SEED)
    return found.withColumn("avg_tokens", F.round("avg_tokens", 6))


@query
def sample_budget(spark, sf_dir):
    found = sampling.sample_budget(_sample_rows(spark, sf_dir), SAMPLE_TOKENS, seed=SAMPLE_SEED)
    return found.withColumn("avg_tokens", F.round("avg_tokens", 6))


@query
def weighted_sample(spark, sf_dir):
    return sampling.weighted_sample(_sample_rows(spark, sf_dir), 100, SAMPLE_SEED).select(
        "id", "company", "category", "similarity_query"
    )


@query
def weighted_sample_large(spark, sf_dir):
    """Most of the table, weighted by company and category."""
    rows = fixtures.order_reviews(spark, sf_dir)
    return sampling.weighted_sample(rows, 1300, SAMPLE_SEED, group=("company", "category")).select("id", "company", "category")


@query
def representative_sample(spark, sf_dir):
    rows = _sample_rows(spark, sf_dir)
    return sampling.representative_sample(rows, SAMPLE_TOKENS, seed=SAMPLE_SEED)


@query
def analyse_reviews(spark, sf_dir):
    """Retrieval, budgeted sample and payload in one request."""
    found = actions.analyse_reviews(
        fixtures.text_reviews(spark, sf_dir).withColumn("timestamp", F.lit(None).cast("timestamp")),
        fixtures.query_vectors(spark, sf_dir),
        max_tokens=SAMPLE_TOKENS // 2,
        seed=SAMPLE_SEED,
    )
    return found.select(
        "company", "category", "similarity_query", F.array_join("reviews", "\n--\n").alias("reviews")
    )


def _request_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """300 requests: companies, categories and dates, each of them missing for some."""
    n, source = F.col("id"), lambda i: F.concat(F.lit("src"), i.cast("string"))
    requests = spark.range(300).select(
        F.concat(F.lit("r"), n).alias("request_id"),
        F.when(n % 3 != 0, F.array(source(n % 20), source((n * 7) % 20))).alias("companies"),
        F.when(n % 4 == 1, F.array((n % 5).cast("int"))).alias("categories"),
        F.when(n % 5 != 0, F.make_date(F.lit(2023), (n % 12 + 1).cast("int"), F.lit(1))).cast("string").alias("start_date"),
        F.when(n % 7 == 2, F.lit("2023-10-15")).alias("end_date"),
    )
    return requests


@query
def analyse_requests(spark, sf_dir):
    """300 requests with two queries each in one job: retrieval, budgeted sample and payload."""
    n = F.col("doc_id")
    time = F.timestamp_seconds(F.unix_seconds(F.lit("2023-01-01").cast("timestamp")) + (n % 365) * 86_400)
    docs = fixtures.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), time.alias("timestamp"))
    reviews = fixtures.text_reviews(spark, sf_dir).join(docs, "id")
    vectors = fixtures.table(spark, sf_dir, "embeddings").where("vec_id < 40").select(
        F.col("vec_id").cast("string").alias("similarity_query"), F.col("embedding").alias("q_embedding"), "vec_id"
    )
    requests = _request_rows(spark, sf_dir)
    number = F.substring("request_id", 2, 9).cast("bigint")
    pairs = requests.select("request_id", F.explode(F.array(number % 37, 37 + number % 3)).alias("vec_id"))
    queries = pairs.join(F.broadcast(vectors), "vec_id")
    found = actions.analyse_requests(reviews, requests, queries, max_tokens=SAMPLE_TOKENS // 10, total=30, seed=SAMPLE_SEED)
    return found.select(
        "request_id", "company", "category", "similarity_query", F.md5(F.array_join("reviews", "\n--\n")).alias("reviews")
    )


# --- scalar functions ------------------------------------------------------------------


@query
def decode_category(spark, sf_dir):
    code = F.col("category")
    return fixtures.order_reviews(spark, sf_dir).select(
        "id",
        "category",
        codes.category_name(code).alias("category_name"),
        codes.category_label(code).alias("label"),
    )


@query
def encode_category(spark, sf_dir):
    code = F.col("category")
    names = fixtures.order_reviews(spark, sf_dir).select(
        "id",
        F.upper(codes.category_name(code)).alias("category_name"),
        codes.category_label(code).alias("label"),
    )
    return names.select(
        "id",
        codes.category_code(F.col("category_name")).alias("from_name"),
        codes.category_code(F.col("label")).alias("from_label"),
    )


@query
def clean_text(spark, sf_dir):
    return fixtures.table(spark, sf_dir, "documents").select(
        "doc_id", text.clean_text(F.col("text")).alias("content")
    )


@query
def strip_sql(spark, sf_dir):
    wrapped = F.concat(F.lit(' "\n'), "text", F.lit('"\n "'))
    return fixtures.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", text.strip_sql(wrapped).alias("stripped")
    )


@query
def token_count(spark, sf_dir):
    return fixtures.table(spark, sf_dir, "documents").select(
        "doc_id", text.token_count(F.col("text")).alias("n_tokens")
    )


@query
def vector_l2(spark, sf_dir):
    """Distance of every vector to the one with the next id."""
    left = fixtures.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    right = left.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    dist = vectors.l2_distance(F.col("embedding"), F.col("other"))
    return left.join(right, "vec_id").select("vec_id", F.round(dist, 6).alias("dist"))


def _letter_embedder(df: DataFrame, text: str, vector: str) -> DataFrame:
    """Another embedder: the length of a text, and its length without the letter e."""
    lengths = F.array(F.length(text), F.length(F.replace(F.col(text), F.lit("e"), F.lit(""))))
    return df.withColumn(vector, lengths.cast("array<float>"))


@query
def embed_by_letters(spark, sf_dir):
    """Vectors of a plugged-in embedder."""
    docs = fixtures.table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = embedding.embed_text(docs, "text", embedder=_letter_embedder)
    return rows.select("doc_id", F.col("embedding")[0].alias("letters"), F.col("embedding")[1].alias("without_e"))


@query
def embed_text(spark, sf_dir):
    """Default embedding of every document, described by its length and norm."""
    rows = embedding.embed_text(fixtures.table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    squares = F.aggregate(
        "embedding", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")
    )
    return rows.select(
        "doc_id", F.size("embedding").alias("dim"), F.round(F.sqrt(squares), 4).alias("norm")
    )


@query
def embed_text_words(spark, sf_dir):
    """Default embedding against its words: their order does not matter, each word fills one place at most."""
    docs = fixtures.table(spark, sf_dir, "documents").select("doc_id", "text")
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    docs = docs.withColumn("words", words).withColumn("reversed", F.array_join(F.reverse("words"), " "))
    both = embedding.embed_text(embedding.embed_text(docs, "text", "one"), "reversed", "other")
    dot = F.aggregate(F.zip_with("one", "other", lambda x, y: x.cast("double") * y), F.lit(0.0), lambda a, b: a + b)
    filled = F.size(F.filter("one", lambda x: x != 0))
    return both.select(
        "doc_id",
        F.round(dot, 4).alias("likeness"),
        ((filled <= F.size(F.array_distinct("words"))) & ((filled > 0) == (F.size("words") > 0))).alias("places"),
    )


@query
def parse_dates(spark, sf_dir):
    """Order dates written in different forms and read again."""
    ts = F.col("timestamp")
    written = (
        F.when(F.col("category") == 0, F.date_format(ts, "M/d/yyyy"))
        .when(F.col("category") == 1, F.date_format(ts, "yyyy-MM"))
        .when(F.col("category") == 2, F.date_format(ts, "d MMMM yyyy"))
        .when(F.col("category") == 3, F.lit(""))
        .when(F.col("category") == 4, F.concat(F.lit("about "), F.date_format(ts, "yyyy")))
        .otherwise(F.date_format(ts, "yyyy-MM-dd"))
    )
    return fixtures.order_reviews(spark, sf_dir).select("id", dates.parse_date(written).alias("date"))


@query
def parse_written_dates(spark, sf_dir):
    """Order dates in forms with parts in any order: names, ordinals, day first, two-digit years."""
    ts = F.col("timestamp")
    forms = ["d/M/yyyy", "EEEE d MMMM yyyy", "MMMM d, yyyy", "d-MMM-yy", "yyyy MMM d", "MM/dd/yy", "MMM yyyy", "yyyyMMdd"]
    kind = F.col("company_id") % (len(forms) + 1)
    written = reduce(lambda rest, i: F.when(kind == i, F.date_format(ts, forms[i])).otherwise(rest), range(len(forms)), F.concat(F.date_format(ts, "MMMM d"), F.lit("th, the year "), F.year(ts)))
    return fixtures.order_reviews(spark, sf_dir).select("id", dates.parse_date(written).alias("date"))


@query
def epoch_ms(spark, sf_dir):
    return _events(spark, sf_dir).select("id", dates.epoch_ms(F.col("timestamp")).alias("ms"))


# --- requests --------------------------------------------------------------------------


@query
def parse_metadata(spark, sf_dir):
    """Metadata JSON written per order and read again; orders without likes carry broken JSON."""
    rows = fixtures.order_reviews(spark, sf_dir)
    record = F.struct(
        F.array("company", F.lit("Å & Ø")).alias("companies"),
        F.date_format("timestamp", "yyyy-MM-dd").alias("start_date"),
        F.lit("").alias("end_date"),
        F.array(codes.category_name(F.col("category"))).alias("categories"),
    )
    json = F.when(F.col("likes").isNull(), F.lit('{"companies": [')).otherwise(F.to_json(record))
    parsed = requests.request_metadata(rows.select(F.col("id").alias("request_id"), json.alias("metadata")))
    return parsed.select(
        "request_id",
        F.array_join("companies", "|").alias("companies"),
        "start_date",
        "end_date",
        F.array_join("categories", "|").alias("categories"),
    )


@query
def resolve_companies(spark, sf_dir):
    """Mentions, written in other case, resolved to company names by their default embedding."""
    rows = fixtures.order_reviews(spark, sf_dir)
    record = F.struct(
        F.array(F.lower("company"), F.lit("Nation 7")).alias("companies"),
        F.date_format("timestamp", "yyyy-MM-dd").alias("start_date"),
    )
    asked = rows.select(F.col("id").alias("request_id"), F.to_json(record).alias("metadata"))
    known = embedding.embed_text(fixtures.companies(spark, sf_dir).drop("embedding"), "name")
    found = requests.resolve_companies(requests.request_metadata(asked), known)
    return found.select("request_id", F.array_join("companies", "|").alias("companies"), "start_date")


def _plan_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan per order: four forms, one of them with escapes, one without any array."""
    rows = fixtures.order_reviews(spark, sf_dir)
    sql = F.concat(F.lit("\"SQL: ['Rating of "), "company", F.lit(": how high?']\""))
    plot = F.lit(
        f"\"PLOT: ['{REPORT_RATING_SERIES}', '{REPORT_RATING_SHARE}']\""
    )
    analyse = F.lit("'ANALYSE REVIEWS: [\"Lange ventetider p\\u00e5 svar\", \"Ros til\\tpersonalet\"]'")
    plan = (
        F.when(F.col("rating") <= 2, F.concat(F.lit("Steps ["), sql, F.lit("] done")))
        .when(F.col("rating") == 3, F.concat(F.lit("[\n"), plot, F.lit(", "), analyse, F.lit(",\n ]")))
        .when(F.col("rating") == 4, F.lit("[ ]"))
        .otherwise(F.lit("no plan"))
    )
    return rows.select(F.col("id").alias("request_id"), plan.alias("plan"))


@query
def parse_plan(spark, sf_dir):
    return requests.parse_plan(_plan_texts(spark, sf_dir))


@query
def plan_steps(spark, sf_dir):
    steps = requests.plan_steps(requests.parse_plan(_plan_texts(spark, sf_dir)))
    return steps.select("request_id", "step_no", "action", F.array_join("args", "|").alias("args"))


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question per order about its company, a category and a date."""
    rows = fixtures.order_reviews(spark, sf_dir)
    category = codes.category_name(F.col("category"))
    question = F.concat(
        F.lit("How has "),
        "company",
        F.lit(" (or nation_2) been rated for "),
        F.initcap(category),
        F.lit(" since "),
        F.date_format("timestamp", "yyyy-MM-dd"),
        F.when(F.col("likes").isNotNull(), F.lit(" and until 2001-12-31?")).otherwise("?"),
    )
    return rows.select(F.col("id").alias("request_id"), question.alias("question"))


@query
def mention_extract(spark, sf_dir):
    found = requests.extract_mentions(_questions(spark, sf_dir), fixtures.companies(spark, sf_dir))
    return found.select(
        "request_id",
        F.array_join("companies", "|").alias("companies"),
        "start_date",
        "end_date",
        F.array_join("categories", "|").alias("categories"),
    )


PROMPT = "About $companies.\n${dates}Question: $question"


@query
def prompt_rows(spark, sf_dir):
    rows = fixtures.order_reviews(spark, sf_dir)
    companies = F.when(F.col("rating") == 1, F.array("company", F.lit("Z"))).otherwise(F.array("company"))
    start = F.when(F.col("likes").isNotNull(), F.date_format("timestamp", "yyyy-MM-dd"))
    text_column = payload.fill_template(
        PROMPT,
        {
            "companies": payload.company_phrase(companies),
            "dates": payload.optional(start, "Since ", ".\n"),
            "question": F.concat(F.lit("rating of "), "id"),
        },
    )
    return rows.select("id", text_column.alias("prompt"))


# --- conversations ---------------------------------------------------------------------


@query
def last_messages(spark, sf_dir):
    return conversations.last_messages(fixtures.table(spark, sf_dir, "conversations"))


@query
def last_by_role(spark, sf_dir):
    return conversations.last_by_role(fixtures.table(spark, sf_dir, "conversations"))


@query
def latest_question(spark, sf_dir):
    return conversations.latest_question(fixtures.table(spark, sf_dir, "conversations"))


# --- streaming -------------------------------------------------------------------------


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = fixtures.table(spark, sf_dir, "events").schema
    return fixtures.event_reviews(jobs.read_files(spark, sf_dir, schema, "events.parquet"))


@query
def stream_upsert(spark, sf_dir):
    """Events, and a later edit of every purchase, upserted into a store."""
    reviews = _event_stream(spark, sf_dir)
    edits = (
        _event_stream(spark, sf_dir)
        .where("company = 'purchase'")
        .withColumn("timestamp", F.col("timestamp") + F.expr("INTERVAL 1 HOUR"))
        .withColumn("rating", 6 - F.col("rating"))
    )
    path = shared_path(spark, "reviews")
    stored = T.StructType(
        [*reviews.schema.fields, REVIEW["created_at"], REVIEW["content"], REVIEW["likes"]]
    )
    jobs.ingest(reviews.unionByName(edits), path, stored).awaitTermination()
    current = store.read_current(spark, path, stored, ["id"])
    return _plain(current.drop("created_at"))


@query
def stream_upsert_late(spark, sf_dir):
    """The same deliveries as files, one micro-batch each, the later edits before the events."""
    reviews = fixtures.event_reviews(fixtures.table(spark, sf_dir, "events"))
    edits = (
        reviews.where("company = 'purchase'")
        .withColumn("timestamp", F.col("timestamp") + F.expr("INTERVAL 1 HOUR"))
        .withColumn("rating", 6 - F.col("rating"))
    )
    source, path = shared_path(spark, "deliveries"), shared_path(spark, "reviews")
    edits.write.parquet(source)
    first = len(spark.read.parquet(source).inputFiles())
    reviews.write.mode("append").parquet(source)
    files = len(spark.read.parquet(source).inputFiles())
    stored = T.StructType([*reviews.schema.fields, REVIEW["created_at"], REVIEW["content"], REVIEW["likes"]])
    # a large delivery has many files; a micro-batch for each of them would look up the store as often
    arriving = jobs.read_files(spark, source, reviews.schema, files_per_batch=max(first, files - first))
    jobs.ingest(arriving, path, stored).awaitTermination()
    return _plain(store.read_current(spark, path, stored, ["id"]).drop("created_at"))


@query
def stream_ingest_pages(spark, sf_dir):
    """Pages arriving as files; their reviews extracted and upserted into a store."""
    source, path = shared_path(spark, "pages"), shared_path(spark, "scraped")
    _review_pages(spark, sf_dir).write.parquet(source)
    arriving = jobs.read_files(spark, source, tables.read_table(spark, source).schema)
    reviews = pages.extract_reviews(arriving, fixtures.companies(spark, sf_dir)).drop("source")
    stored = T.StructType([*reviews.schema.fields, REVIEW["created_at"]])
    jobs.ingest(reviews, path, stored).awaitTermination()
    return _plain(store.read_current(spark, path, stored, ["id"]).drop("created_at"))


@query
def stream_dedup(spark, sf_dir):
    twice = _event_stream(spark, sf_dir).union(_event_stream(spark, sf_dir))
    path = shared_path(spark, "deduplicated")
    once = jobs.deduplicate(twice, "60 days")
    jobs.write_files(once, path).awaitTermination()
    return _plain(tables.read_table(spark, path, once.schema))


def _stream_windows(spark: SparkSession, sf_dir: str, granularity: str) -> DataFrame:
    windows = jobs.rating_windows(_event_stream(spark, sf_dir), granularity, "60 days")
    path = shared_path(spark, f"windows-{granularity}")
    jobs.write_windows(windows, path).awaitTermination()
    current = store.read_current(spark, path, jobs.WINDOW_SCHEMA, jobs.WINDOW_KEY)
    return current.select(
        "company", "period", "count", F.round(F.col("rating_sum") / F.col("count"), 9).alias("mean")
    )


@query
def stream_ratings_day(spark, sf_dir):
    return _stream_windows(spark, sf_dir, dates.DAY)


@query
def stream_ratings_week(spark, sf_dir):
    return _stream_windows(spark, sf_dir, dates.WEEK)


@query
def stream_ratings_month(spark, sf_dir):
    """Months summed up from the days that a stream has stored."""
    path = shared_path(spark, "windows-month")
    windows = jobs.rating_windows(_event_stream(spark, sf_dir), dates.DAY, "60 days")
    jobs.write_windows(windows, path).awaitTermination()
    months = jobs.months_of(store.read_current(spark, path, jobs.WINDOW_SCHEMA, jobs.WINDOW_KEY))
    return months.select("company", "period", "count", F.round(F.col("rating_sum") / F.col("count"), 9).alias("mean"))


# --- ad-hoc SQL ------------------------------------------------------------------------


def _run_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    adhoc.register(
        review=fixtures.order_reviews(spark, sf_dir), company=fixtures.companies(spark, sf_dir)
    )
    return adhoc.run_sql(spark, sql)


@query
def sql_top_company(spark, sf_dir):
    return _run_sql(spark, sf_dir, adhoc.top_company_sql("1998-01-01"))


@query
def sql_most_reviews(spark, sf_dir):
    return _run_sql(spark, sf_dir, adhoc.most_reviews_sql())


@query
def sql_rating_trend(spark, sf_dir):
    return _run_sql(spark, sf_dir, adhoc.rating_trend_sql("NATION_5", "1998-01-01"))


@query
def sql_compare_set(spark, sf_dir):
    return _run_sql(spark, sf_dir, adhoc.compare_set_sql(["NATION_1", "NATION_2", "NATION_3"]))
