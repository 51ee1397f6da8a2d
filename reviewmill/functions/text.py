"""Text clean-up, token counts and display labels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from reviewmill.fixed_values import AXIS_LABEL, BAR_LABEL

# A run of letters, up to three digits, or a run of other signs counts as one token.
TOKEN_PATTERN = r"\p{L}+|\p{N}{1,3}|[^\s\p{L}\p{N}]+"

Tokenizer = Callable[[Column], Column]


def clean_text(text: Column) -> Column:
    """Newlines become spaces (done before embedding)."""
    return F.translate(text, "\n", " ")


def strip_sql(text: Column) -> Column:
    """Remove spaces, double quotes and newlines at both ends."""
    return F.btrim(text, F.lit(' "\n'))


def token_count(text: Column) -> Column:
    """Approximate number of tokens of ``text``.

    The exact vocabulary is a download, so this counts word-like pieces. Callers who
    have the vocabulary pass a pandas UDF wherever a ``tokenizer`` is accepted.
    """
    return F.regexp_count(text, F.lit(TOKEN_PATTERN)).cast("bigint")


def axis_label(company: Column, mean: Column, count: Column) -> Column:
    """Company with its mean (2 digits) and number of reviews."""
    return F.format_string(AXIS_LABEL, company, F.bround(mean, 2).cast("string"), count)


def bar_label(share: Column, count: Column) -> Column:
    """Percent (1 digit) and number of reviews of one bar."""
    return F.format_string(BAR_LABEL, F.bround(share * 100, 1).cast("string"), count)
