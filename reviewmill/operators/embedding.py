"""Text to vector, with a pluggable embedder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from reviewmill.fixed_values import VECTOR_DIM
from reviewmill.functions.text import clean_text

# Takes a frame with the columns given to `embed_text`, returns it with the vector column added.
Embedder = Callable[[DataFrame, str, str], DataFrame]


def hashing_embedder(dim: int = VECTOR_DIM) -> Embedder:
    """Unit-length hashed word counts: a stand-in with the interface of a remote model.

    Its vectors are not those of any language model. A model is plugged in by passing a
    function of the same form, usually a pandas UDF over batches of texts.
    """

    def embed(df: DataFrame, text: str, vector: str) -> DataFrame:
        from pyspark.ml import Pipeline
        from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer
        from pyspark.ml.functions import vector_to_array

        words = RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"[^\p{L}\p{N}]+")
        counts = HashingTF(inputCol="_words", outputCol="_counts", numFeatures=dim)
        unit = Normalizer(inputCol="_counts", outputCol="_unit")
        out = Pipeline(stages=[words, counts, unit]).fit(df).transform(df)
        return out.withColumn(vector, vector_to_array("_unit", "float32")).drop(
            "_words", "_counts", "_unit"
        )

    return embed


def embed_text(
    df: DataFrame, text: str = "content", vector: str = "embedding", embedder: Embedder | None = None
) -> DataFrame:
    """Add the vector of a text column; newlines count as spaces, a missing text as empty."""
    cleaned = df.withColumn("_text", F.coalesce(clean_text(F.col(text)), F.lit("")))
    return (embedder or hashing_embedder())(cleaned, "_text", vector).drop("_text")
