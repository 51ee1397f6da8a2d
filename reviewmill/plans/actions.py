"""What the steps of a request plan do with the data."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from reviewmill.fixed_values import (
    ACTION_ANALYSE,
    ACTION_PLOT,
    ACTION_SQL,
    PAYLOAD_TOKENS,
    RETRIEVED_REVIEWS,
)
from reviewmill.functions.codes import category_code
from reviewmill.functions.text import Tokenizer, token_count
from reviewmill.operators.embedding import Embedder, embed_text
from reviewmill.operators.filters import project, review_predicate
from reviewmill.operators.neighbours import nearest_one, retrieve, retrieve_requests
from reviewmill.operators.requests import parse_plan, plan_steps
from reviewmill.operators.sampling import representative_sample, sample_requests
from reviewmill.plans.adhoc import preview_sql, register
from reviewmill.plans.payload import PAYLOAD_KEYS, review_payload
from reviewmill.plans.reports import REPORTS, report
from reviewmill.session import cut_lineage
from reviewmill.sources.versions import between


@dataclass(frozen=True)
class Metadata:
    """Filters of one request; nothing given means no filter."""

    companies: Sequence[str] = ()
    start_date: str | None = None
    end_date: str | None = None
    categories: Sequence[str | int] = ()


def select_reviews(reviews: DataFrame | str, metadata: Metadata) -> DataFrame:
    """Reviews a request is about; of a store published as ``reviews`` only the months of its dates are read."""
    if isinstance(reviews, str):
        reviews = between(SparkSession.active(), reviews, metadata.start_date, metadata.end_date)
    return reviews.where(
        review_predicate(
            metadata.companies, metadata.categories, metadata.start_date, metadata.end_date
        )
    )


def build_reports(
    reviews: DataFrame | str, metadata: Metadata, names: Sequence[str]
) -> dict[str, DataFrame]:
    """The named reports over the selected reviews, each a lazy plan; no rows give empty reports."""
    unknown = [name for name in names if name not in REPORTS]
    if unknown:
        raise ValueError(f"Unknown report: {unknown[0]}")
    selected = select_reviews(reviews, metadata)
    return {name: report(selected, name, metadata.companies) for name in names}


def analyse_reviews(
    reviews: DataFrame | str,
    queries: DataFrame,
    metadata: Metadata = Metadata(),
    max_tokens: int = PAYLOAD_TOKENS,
    total: int = RETRIEVED_REVIEWS,
    seed: int = 0,
    tokenizer: Tokenizer = token_count,
) -> DataFrame:
    """Retrieve, sample within the token budget, and group the texts.

    ``queries`` holds ``similarity_query`` and ``q_embedding``. The retrieved rows (at most
    ``total``) are written once, as sampling reads them several times.
    """
    found = cut_lineage(retrieve(queries, select_reviews(reviews, metadata), total))
    sample = representative_sample(
        found, max_tokens, seed=seed, row_key=("similarity_query", "id"), tokenizer=tokenizer
    )
    return review_payload(sample)


def analyse_requests(
    reviews: DataFrame,
    requests: DataFrame,
    queries: DataFrame,
    max_tokens: int = PAYLOAD_TOKENS,
    total: int = RETRIEVED_REVIEWS,
    seed: int = 0,
    tokenizer: Tokenizer = token_count,
) -> DataFrame:
    """:func:`analyse_reviews` for a table of requests in one job: its rows, led by ``request_id``.

    ``requests`` holds the metadata as rows (``operators.requests.request_metadata``, companies resolved, category
    names or codes), ``queries`` the ``similarity_query`` and ``q_embedding`` of each. A request without a query has no rows.
    """
    if requests.schema["categories"].dataType.elementType == T.StringType():
        requests = requests.withColumn("categories", F.transform("categories", category_code))
    found = cut_lineage(retrieve_requests(requests, queries, reviews, total))
    sample = sample_requests(found, max_tokens, seed=seed, tokenizer=tokenizer)
    return review_payload(sample, ("request_id", *PAYLOAD_KEYS))


def query_table(reviews: DataFrame, texts: Sequence[str], embedder: Embedder | None = None) -> DataFrame:
    """Query texts with their vectors, in the form :func:`analyse_reviews` takes."""
    rows = F.explode(F.array(*[F.lit(t) for t in texts]).cast("array<string>"))
    queries = reviews.sparkSession.range(1).select(rows.alias("similarity_query"))
    return embed_text(queries, "similarity_query", "q_embedding", embedder)


def similar_reviews(
    reviews: DataFrame,
    text: str,
    limit: int,
    metadata: Metadata = Metadata(),
    cols: Sequence[str] = (),
    embedder: Embedder | None = None,
) -> DataFrame:
    """The selected reviews most similar to a text, nearest first."""
    vector = query_table(reviews, [text], embedder).first().q_embedding
    found = nearest_one(select_reviews(reviews, metadata), vector, limit)
    return project(found, cols)


def run_step(
    action: str,
    args: Sequence[str],
    metadata: Metadata,
    tables: Mapping[str, DataFrame],
    embedder: Embedder | None = None,
):
    """Result of one plan step: SQL previews, reports by name, or a review payload.

    ``tables`` holds ``review`` and ``company``. The arguments of an SQL step are queries,
    not questions.
    """
    reviews = tables["review"]
    if action == ACTION_SQL:
        register(**tables)
        return [dict(query=sql, result=preview_sql(reviews.sparkSession, sql)) for sql in args]
    if action == ACTION_PLOT:
        return build_reports(reviews, metadata, args)
    if action == ACTION_ANALYSE:
        return analyse_reviews(reviews, query_table(reviews, args, embedder), metadata)
    raise ValueError(f"Unexpected action: {action}")


def run_plan(
    plan: str,
    metadata: Metadata,
    tables: Mapping[str, DataFrame],
    embedder: Embedder | None = None,
) -> list[tuple[str, object]]:
    """Results of all steps of one request's plan text, as (action, result) in step order."""
    spark = tables["review"].sparkSession
    request = spark.createDataFrame([("request", plan)], "request_id string, plan string")
    steps = plan_steps(parse_plan(request)).orderBy("step_no").collect()
    return [(s.action, run_step(s.action, s.args or [], metadata, tables, embedder)) for s in steps]
