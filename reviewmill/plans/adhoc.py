"""Ad-hoc SQL over the review and company tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.errors import PySparkException
from py4j.protocol import Py4JError

from reviewmill.fixed_values import INVALID_SQL, PREVIEW_ROWS
from reviewmill.plans.payload import as_text


def register(**tables: DataFrame) -> None:
    """Make frames available to SQL under the given names (``review=...``, ``company=...``)."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def run_sql(spark: SparkSession, sql: str) -> DataFrame:
    """The lazy result of one query; anything that is not a valid query is a ValueError.

    The text is used as a subquery, so statements that change tables are refused.
    """
    text = sql.strip(' "\n').rstrip("; \n")
    try:
        return spark.sql(f"SELECT * FROM (\n{text}\n) AS result")
    except (PySparkException, Py4JError) as error:
        raise ValueError(INVALID_SQL) from error


def preview_sql(spark: SparkSession, sql: str, n: int = PREVIEW_ROWS) -> list[dict]:
    """Run the query and return its first ``n`` rows as text; failures at run time count too."""
    result = run_sql(spark, sql)
    try:
        return [row.asDict() for row in as_text(result.limit(n)).collect()]
    except (PySparkException, Py4JError) as error:
        raise ValueError(INVALID_SQL) from error


# Sample questions as SQL. Written for the Spark dialect; they hold in PostgreSQL as well.
TOP_COMPANY = """
SELECT company, avg(rating) AS mean_rating, count(*) AS n_reviews
FROM review
WHERE timestamp >= '{start}'
GROUP BY company
ORDER BY mean_rating DESC, company
LIMIT 1
"""

MOST_REVIEWS = """
SELECT company, count(*) AS n_reviews
FROM review
GROUP BY company
ORDER BY n_reviews DESC, company
LIMIT 1
"""

RATING_TREND = """
SELECT CAST(date_trunc('month', timestamp) AS date) AS month,
       avg(rating) AS mean_rating, count(*) AS n_reviews
FROM review
WHERE company = '{company}' AND timestamp >= '{start}'
GROUP BY CAST(date_trunc('month', timestamp) AS date)
ORDER BY month
"""

COMPARE_SET = """
SELECT company, avg(rating) AS mean_rating, count(*) AS n_reviews,
       count(*) FILTER (WHERE rating >= 4) AS n_positive
FROM review
WHERE company IN ({companies})
GROUP BY company
ORDER BY mean_rating DESC, company
"""


def _text(value: str) -> str:
    return str(value).replace("\\", "\\\\").replace("'", "\\'")


def top_company_sql(start: str) -> str:
    """Company with the highest mean rating since a date."""
    return TOP_COMPANY.format(start=_text(start))


def most_reviews_sql() -> str:
    """Company with the most reviews."""
    return MOST_REVIEWS


def rating_trend_sql(company: str, start: str) -> str:
    """Monthly ratings of one company since a date."""
    return RATING_TREND.format(company=_text(company), start=_text(start))


def compare_set_sql(companies) -> str:
    """Ratings of the given companies, best first."""
    return COMPARE_SET.format(companies=", ".join(f"'{_text(c)}'" for c in companies))
