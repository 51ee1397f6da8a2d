"""Vector expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F
from pyspark.sql import types as T


def l2_distance(left: Column, right: Column) -> Column:
    """Euclidean distance in double precision; NULL when either vector is NULL."""
    squares = F.zip_with(
        left,
        right,
        lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")),
    )
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda total, x: total + x))


def vector_literal(values) -> Column:
    """A vector as a constant column."""
    return F.array(*[F.lit(float(v)) for v in values])


def vector_from_text(text: Column) -> Column:
    """Vector from its bracketed text form, e.g. ``[0.1,0.2]``; unreadable text gives NULL."""
    return F.from_json(text, T.ArrayType(T.FloatType()))
