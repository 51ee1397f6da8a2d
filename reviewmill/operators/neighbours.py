"""Exact nearest neighbours by Euclidean distance, and an opt-in approximate form."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Row, Window, functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from reviewmill.fixed_values import RETRIEVED_REVIEWS
from reviewmill.functions import topk
from reviewmill.functions.codes import category_name
from reviewmill.functions.vectors import l2_distance, vector_literal
from reviewmill.operators.joins import Size, fetch, measure, sized
from reviewmill.session import cut_lineage

cloudpickle.register_pickle_by_value(topk)

# At most this many vectors are held by a task; larger sides are cut into blocks.
HELD_VECTORS = 5000
HELD_BYTES = 64 * 1024 * 1024
BLOCK_VECTORS = 20_000
COPIES = 8  # of a row, where small blocks are asked for; more only if blocks would not fit a task
SPREAD = 2.4  # width of a bucket in standard deviations
MERGES = 64  # parts in which the rows found for a query are merged first
REQUEST_BYTES = 32 * 1024 * 1024  # of requests and their queries that every task holds


def nearest_one(
    df: DataFrame, query: Sequence[float], k: int, vector: str = "embedding", key: str = "id"
) -> DataFrame:
    """The ``k`` rows nearest to one query vector, nearest first; rows without a vector come last.

    Keys and vectors go through a top-n plan (every task keeps ``k`` rows, nothing is sorted
    as a whole); the other columns are fetched for the rows found.
    """
    dist = l2_distance(F.col(vector), vector_literal(query))
    order = [F.col("dist").asc_nulls_last(), key]
    top = df.select(key, dist.alias("dist")).orderBy(*order).limit(k)
    return fetch(df, top, key, k).orderBy(*order)


def _block(df: DataFrame, own: str, other: str, key: str, blocks: Column, copies: Column) -> DataFrame:
    """Give each row its block by key hash, and a copy for every block of the other side."""
    return df.withColumn(own, F.pmod(F.xxhash64(key), blocks).cast("int")).withColumn(
        other, F.explode(F.sequence(F.lit(0), copies - 1))
    )


def _n_blocks(size: Size, block: int) -> int:
    """Blocks that a side is cut into.

    Each row is copied for every block of the other side, so blocks of ``block`` rows are made as long as they
    are at most ``COPIES``. Of a larger table blocks get larger, up to what a task may hold.
    """
    needed = max(math.ceil(size.rows / max(block, BLOCK_VECTORS)), math.ceil(size.bytes / HELD_BYTES))
    return max(1, needed, min(math.ceil(size.rows / block), COPIES))


def _pairs_schema(q: DataFrame, b: DataFrame) -> T.StructType:
    return T.StructType(
        [
            T.StructField("_query", q.schema["_query"].dataType),
            T.StructField("_rank", T.IntegerType()),
            T.StructField("_dist", T.DoubleType()),
            T.StructField("_key", b.schema["_key"].dataType),
        ]
    )


def _result(rank: str, query_key: str, key: str) -> list[Column]:
    names = {"_query": query_key, rank: "rn", "_key": key, "_dist": "dist"}
    return [F.col(old).alias(new) for old, new in names.items()]


def _best(found: DataFrame, query: Sequence[str], k: Column) -> DataFrame:
    """The ``k`` best of each query, ranked in ``_rn``.

    Tasks return up to ``k`` rows for each query. These are first cut in ``MERGES`` hashed parts of a query, so
    that no reducer receives the rows of all tasks, then among at most ``k`` rows of each part.
    """
    order = [F.col("_dist").asc_nulls_last(), "_key"]
    part = F.pmod(F.xxhash64("_key"), F.lit(MERGES))
    within = Window.partitionBy(*query, "_part").orderBy(*order)
    parts = found.withColumn("_part", part).withColumn("_rn", F.row_number().over(within)).where(F.col("_rn") <= k)
    whole = Window.partitionBy(*query).orderBy(*order)
    return parts.drop("_part").withColumn("_rn", F.row_number().over(whole)).where(F.col("_rn") <= k)


def _ranked(found: DataFrame, k: int, query_key: str, key: str) -> DataFrame:
    """The ``k`` best of each query; tasks and groups have returned at most ``k`` each."""
    return _best(found, ["_query"], F.lit(k)).select(*_result("_rn", query_key, key))


def nearest(
    queries: DataFrame,
    base: DataFrame,
    k: int,
    query_key: str = "similarity_query",
    query_vector: str = "q_embedding",
    key: str = "id",
    vector: str = "embedding",
    held: int = HELD_VECTORS,
    block: int = BLOCK_VECTORS,
    held_bytes: int = HELD_BYTES,
) -> DataFrame:
    """The ``k`` base rows nearest to each query: columns query, ``rn``, key, ``dist``.

    Exact; keys are unique on both sides. Rows without a vector come last, ties are broken
    by key. Only keys and vectors reach the Python workers. A side that was measured to have
    at most ``held`` rows and ``held_bytes`` bytes is held by every task:

    * few queries: one pass over the base, each task returns ``k`` rows per query;
    * small base: one pass over the queries, no shuffle;
    * otherwise both sides are hashed into blocks of about ``block`` rows (larger ones where a row would be
      copied more than ``COPIES`` times), and each pair of blocks is one group that returns ``k`` rows per
      query. This measures all pairs; where that is too much, :func:`nearest_lsh` trades exactness for speed.
    """
    q = queries.select(F.col(query_key).alias("_query"), F.col(query_vector).alias("_vector"))
    b = base.select(F.col(key).alias("_key"), F.col(vector).alias("_vector"))
    out = _pairs_schema(q, b)

    def held_by_tasks(size: Size) -> bool:
        return size.rows <= held and size.bytes <= held_bytes

    of_queries = measure(q)
    queries_held = held_by_tasks(of_queries)
    of_base = None if queries_held else measure(b)
    base_held = of_base is not None and held_by_tasks(of_base)
    if queries_held:
        found = b.mapInArrow(topk.scan_base(q.toArrow(), k), out)
    elif base_held:
        found = q.mapInArrow(topk.scan_queries(b.toArrow(), k), out)
    else:
        n_blocks = F.lit(_n_blocks(of_queries, block)), F.lit(_n_blocks(of_base, block))
        left = _block(q, "_qb", "_rb", "_query", *n_blocks).groupBy("_qb", "_rb")
        right = _block(b, "_rb", "_qb", "_key", *reversed(n_blocks)).groupBy("_qb", "_rb")
        found = left.cogroup(right).applyInPandas(topk.scan_blocks(k), out)
    if base_held:
        return found.select(*_result("_rank", query_key, key))
    return _ranked(found, k, query_key, key)


def retrieve(
    queries: DataFrame, reviews: DataFrame, total: int = RETRIEVED_REVIEWS, **columns: str
) -> DataFrame:
    """Reviews most similar to each query, ``total`` divided evenly among the queries.

    Of more queries than that each gets one. A review found by several queries appears once for
    each. Categories become names.
    """
    n = queries.count()
    k = max(1, total // n) if n else 1
    top = nearest(queries, reviews, k, **columns)
    query_key, key = columns.get("query_key", "similarity_query"), columns.get("key", "id")
    texts = reviews.select(key, "company", "category", "content")
    return fetch(texts, top, key, max(n, total)).select(
        query_key,
        "rn",
        key,
        "company",
        category_name(F.col("category")).alias("category"),
        "content",
        "dist",
    )


def _reviews_of_requests(reviews: DataFrame, requests: list, key: str, vector: str) -> DataFrame:
    """``_key``, ``_vector`` and ``_requests``, the numbers of the requests whose filters a review passes.

    Filters are looked up by company and by category, so a review is compared with the requests that name it
    and those without lists, and appears once, however many requests it is for.
    """
    spark = reviews.sparkSession
    kind = "array<struct<number: int, first: timestamp, last: timestamp>>"
    span = [(r.number, r.first, r.last) for r in requests]
    given = {"company": [], "category": [], "_any": []}
    for request, dates in zip(requests, span):
        given["company"] += [(name, *dates) for name in set(request.companies or ())]
        given["category"] += [(code, *dates) for code in set(request.categories or ())]
        if not request.companies and not request.categories:
            given["_any"].append((0, *dates))
    narrow = reviews.select(
        F.col(key).alias("_key"), F.col(vector).alias("_vector"), "company", "category", F.col("timestamp").alias("_time"), F.lit(0).alias("_any")
    )
    lists = []
    for name, rows in given.items():
        if not rows:
            continue
        value = narrow.schema[name].dataType.simpleString()
        table = spark.createDataFrame(rows, f"value {value}, number int, first timestamp, last timestamp")
        grouped = table.groupBy("value").agg(F.collect_list(F.struct("number", "first", "last")).alias(f"_of_{name}"))
        # at most REQUEST_BYTES, as are the requests themselves
        narrow = narrow.join(F.broadcast(grouped), F.col(name) == F.col("value"), "left").drop("value")
        lists.append(F.coalesce(F.col(f"_of_{name}"), F.array().cast(kind)))
    if not lists:
        return narrow.select("_key", "_vector", F.array().cast("array<int>").alias("_requests")).limit(0)

    def meant(r: Column) -> Column:
        return (r["first"].isNull() | (F.col("_time") >= r["first"])) & (r["last"].isNull() | (F.col("_time") <= r["last"]))

    found = F.array_distinct(F.transform(F.filter(F.concat(*lists), meant), lambda r: r["number"]))
    return narrow.select("_key", "_vector", found.alias("_requests")).where(F.size("_requests") > 0)


def retrieve_requests(
    requests: DataFrame,
    queries: DataFrame,
    reviews: DataFrame,
    total: int = RETRIEVED_REVIEWS,
    key: str = "id",
    vector: str = "embedding",
    held_bytes: int = REQUEST_BYTES,
) -> DataFrame:
    """:func:`retrieve` for many requests at once: its columns, led by ``request_id``.

    ``requests`` has ``request_id``, ``companies``, ``categories`` (codes), ``start_date`` and ``end_date``; a review is meant by a
    request if its company or its category is listed, or nothing is, and it lies within the inclusive dates.
    ``queries`` has ``request_id``, ``similarity_query`` and ``q_embedding``. Every task holds the requests and searches its reviews for all of
    them, so reviews are read once and not shuffled; requests of more than ``held_bytes`` are cut into blocks, with one
    pass over the reviews each.
    """
    spark = reviews.sparkSession
    asked = queries.groupBy("request_id").agg(
        F.sort_array(F.collect_list(F.struct(F.col("similarity_query").alias("name"), F.col("q_embedding").alias("asked")))).alias("queries")
    )
    joined = requests.select(
        "request_id",
        "companies",
        F.col("categories").cast("array<int>").alias("categories"),
        F.col("start_date").cast("timestamp").alias("first"),
        F.col("end_date").cast("timestamp").alias("last"),
    ).join(asked, "request_id")
    joined = cut_lineage(joined)
    size = F.octet_length(F.to_json(F.struct("companies", "categories"))) + F.aggregate(
        "queries", F.lit(0), lambda n, q: n + F.octet_length(q["name"]) + 8 * F.size(q["asked"])
    )
    weight = joined.agg(F.sum(size)).first()[0] or 0
    blocks = max(1, math.ceil(weight / held_bytes))
    parts = []
    for block in range(blocks):
        rows = joined.where(F.pmod(F.xxhash64("request_id"), F.lit(blocks)) == block).collect()
        parts.append(_retrieved(spark, rows, reviews, total, key, vector, requests.schema["request_id"].dataType))
    found = cut_lineage(reduce(DataFrame.unionByName, parts))
    texts = reviews.select(F.col(key).alias("_key"), "company", "category", "content")
    return texts.join(sized(found), "_key").select(
        "request_id",
        F.col("_query").alias("similarity_query"),
        F.col("_rn").alias("rn"),
        F.col("_key").alias(key),
        "company",
        category_name(F.col("category")).alias("category"),
        "content",
        F.col("_dist").alias("dist"),
    )


def _retrieved(spark, rows: list, reviews: DataFrame, total: int, key: str, vector: str, id_type: T.DataType) -> DataFrame:
    """``request_id``, ``_query``, ``_rn``, ``_key`` and ``_dist`` for a block of requests."""
    numbered = [Row(number=i, companies=r.companies, categories=r.categories, first=r["first"], last=r["last"]) for i, r in enumerate(rows)]
    plain = {
        i: (max(1, total // len(r.queries)), [q.name for q in r.queries], [q.asked for q in r.queries]) for i, r in enumerate(rows)
    }
    meant = _reviews_of_requests(reviews, numbered, key, vector)
    kind = meant.schema["_key"].dataType
    schema = f"_request int, _k int, _query string, _dist double, _key {kind.simpleString()}"
    found = meant.mapInArrow(topk.scan_requests(spark.sparkContext.broadcast(plain), to_arrow_type(kind)), schema)
    best = _best(found, ["_request", "_query"], F.col("_k"))
    ids = spark.createDataFrame(
        [(i, r.request_id) for i, r in enumerate(rows)],
        T.StructType([T.StructField("_request", T.IntegerType()), T.StructField("request_id", id_type)]),
    )
    return best.join(F.broadcast(ids), "_request").select("request_id", "_query", "_rn", "_key", "_dist")


def nearest_name(
    mentions: DataFrame,
    companies: DataFrame,
    mention_key: str = "mention",
    mention_vector: str = "embedding",
) -> DataFrame:
    """Each mention with the name of the most similar company; ties by company id."""
    top = nearest(
        mentions, companies, 1, query_key=mention_key, query_vector=mention_vector
    )
    names = companies.select("id", "name")
    return top.join(sized(names), "id").select(mention_key, "name", "id", "dist")


def nearest_lsh(
    queries: DataFrame,
    base: DataFrame,
    k: int,
    spread: float = SPREAD,
    tables: int = 8,
    width: int = 2,
    candidates: int = 800,
    seed: int = 7,
    query_key: str = "similarity_query",
    query_vector: str = "q_embedding",
    key: str = "id",
    vector: str = "embedding",
    block: int = BLOCK_VECTORS,
) -> DataFrame:
    """Approximate neighbours: nearest rows in the random-projection buckets around the query.

    For many queries against a large base, where :func:`nearest` would measure all pairs and
    a missed neighbour is acceptable. A bucket is ``spread`` standard deviations of the base's projections wide, which are
    measured. Of every table the query's own bucket and its neighbours are probed in the order of their margins, as
    long as the buckets before hold fewer than ``candidates`` rows for each neighbour asked for. Queries for which fewer than ``k`` rows
    were found this way are searched exactly. Rows without a finite vector are left out, queries without one have no rows.

    A bucket is searched in blocks of about ``block`` rows, each giving ``k`` rows per query;
    a bucket holding much of the base is split over many groups and no pairs are written.
    """
    q = queries.select(F.col(query_key).alias("_query"), F.col(query_vector).alias("_vector")).where("_vector IS NOT NULL")
    b = base.select(F.col(key).alias("_key"), F.col(vector).alias("_vector")).where("_vector IS NOT NULL")
    out = _pairs_schema(q, b)
    first = b.select(F.size("_vector")).first()
    if first is None or q.isEmpty():
        return q.sparkSession.createDataFrame([], out).select(*_result("_rank", query_key, key))
    planes = np.random.default_rng(seed).standard_normal((tables, width, first[0]))
    sums = b.select("_vector").mapInArrow(topk.spread_of(planes), "n double, sum double, squares double")
    n, total, squares = sums.agg(F.sum("n"), F.sum("sum"), F.sum("squares")).first()
    length = spread * math.sqrt(max(0.0, squares / n - (total / n) ** 2)) if n else 0.0
    length = length or 1.0  # all base vectors project to one place

    kinds = [df.schema[0].dataType.simpleString() for df in (q, b)]
    kind = q.schema["_vector"].dataType.simpleString(), b.schema["_vector"].dataType.simpleString()
    probed = q.mapInArrow(topk.probe_rows(planes, length), f"_name {kinds[0]}, _vector {kind[0]}, _buckets array<bigint>, _margins array<double>")
    hashed = b.mapInArrow(topk.hash_rows(planes, length), f"_name {kinds[1]}, _vector {kind[1]}, _buckets array<bigint>")
    hashed = hashed.select(F.col("_name").alias("_key"), "_vector", F.explode("_buckets").alias("_bucket"))
    sizes = cut_lineage(hashed.groupBy("_bucket").agg(F.count("*").alias("_rows")))
    probes = probed.select(F.col("_name").alias("_query"), F.explode(F.arrays_zip("_buckets", "_margins")).alias("_p"))
    probes = probes.groupBy("_query", F.col("_p._buckets").alias("_bucket")).agg(F.min("_p._margins").alias("_margin"))
    # a query has tables * (1 + 2 * width * width) probes at most
    nearer = Window.partitionBy("_query").orderBy("_margin", "_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_rows").over(nearer), F.lit(0))
    probes = probes.join(sized(sizes), "_bucket").withColumn("_before", before)
    probes = cut_lineage(probes.where(F.col("_before") < candidates * k).select("_query", "_bucket", "_rows"))
    asked = probes.groupBy("_bucket").agg(
        F.ceil(F.count("*") / block).cast("int").alias("_q_blocks"), F.ceil(F.max("_rows") / block).cast("int").alias("_b_blocks")
    )
    asked = sized(cut_lineage(asked))
    q_rows = probes.select("_query", "_bucket").join(sized(q), "_query").join(asked, "_bucket")
    left = _block(q_rows, "_qb", "_rb", "_query", F.col("_q_blocks"), F.col("_b_blocks"))
    right = _block(hashed.join(asked, "_bucket"), "_rb", "_qb", "_key", F.col("_b_blocks"), F.col("_q_blocks"))
    group = ["_bucket", "_qb", "_rb"]
    found = left.groupBy(*group).cogroup(right.groupBy(*group)).applyInPandas(topk.scan_blocks(k), out)
    once = found.groupBy("_query", "_key").agg(F.min("_dist").alias("_dist"))
    ranked = cut_lineage(_ranked(once, k, query_key, key))
    full = ranked.where(F.col("rn") == k).select(F.col(query_key).alias("_query"))
    short = cut_lineage(probed.select(F.col("_name").alias("_query"), "_vector").join(sized(full), "_query", "left_anti"))
    if short.isEmpty():
        return ranked
    finite = F.forall("_vector", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    exact = nearest(short, b.where(finite), k, "_query", "_vector", "_key", "_vector", block=block)
    exact = exact.select(F.col("_query").alias(query_key), "rn", F.col("_key").alias(key), "dist")
    few = short.select(F.col("_query").alias(query_key))
    return ranked.join(sized(few), query_key, "left_anti").select(*exact.columns).unionByName(exact)
