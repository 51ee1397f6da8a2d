"""The dealt operators as queries over the whole test tables: ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from reviewmill.llm import (
    byte_bpe,
    imatch,
    language_id,
    merkle,
    multi_index,
    ngram_join,
    packing,
    page_text,
    pii,
    sharding,
    token_store,
    url_reputation,
    word_runs,
)
from reviewmill.llm.common import table
from reviewmill.session import shared_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


@query
def op1_karmarkar_karp_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight shards of near equal bytes; equal texts stay together."""
    found = sharding.shard_documents(table(spark, sf_dir, "documents"), shards=8)
    return found.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


@query
def op2_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return imatch.fingerprint_documents(table(spark, sf_dir, "documents"))


@query
def op3_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors found for every vector whose key is divisible by 100."""
    return multi_index.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


@query
def op4_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every document."""
    return pii.find(table(spark, sf_dir, "documents"))


@query
def op5_token_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids in files, each document compressed by itself with a shared dictionary, read back."""
    path = public_tokenizers.path("word_bpe_49k.json")
    folder = token_store.write(table(spark, sf_dir, "documents"), path, shared_path(spark, "ids"), end_id=1)
    found = token_store.read(spark, folder)
    return found.select("doc_id", "start", "n_tokens", "ids_crc32")


@query
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learnt from those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(~language_id.held_out(F.col("doc_id"))))
    found = language_id.predict(docs, model)
    return found.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query
def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and what they decode to, as digests."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    found = byte_bpe.encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    decoded = byte_bpe.decode(F.col("ids"), byte_bpe.read_ranks(path))
    return found.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        "ids_sha256",
        F.sha2(decoded, 256).alias("decoded_sha256"),
    )


@query
def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack_documents(table(spark, sf_dir, "documents"), path)


@query
def op9_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page; a page is labelled when the document that its path numbers is."""
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    number = F.regexp_extract(url_reputation.path_of(F.col("url")), r"^/[a-z]+/([0-9]+)", 1)
    numbered = pages.select("page_id", number.try_cast("bigint").alias("doc_id"))
    good = (F.col("quality") == 1) & (F.col("toxic") == 0)
    outcomes = numbered.where("doc_id IS NOT NULL").distinct().join(labels.select("doc_id", good.alias("good")), "doc_id")
    return url_reputation.judge_urls(pages, outcomes)


@query
def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents that are linked by 85 % of their 4-word shingles."""
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=85)


@query
def op11_repair_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words; a tenth of the documents is made to repeat itself first."""
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    number = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8"))
    draw, n = F.floor(number / 10), word_runs.n_words(text)
    first = (draw % n).cast("int")
    period = (F.floor((n - first) / (3 + draw % 8)) + 1).cast("int")
    repeating = word_runs.looped(text, first, period)
    changed = F.when((number % 10 == 0) & (n > 0), repeating).otherwise(text)
    found = word_runs.runs_of(docs, text=changed)
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    best = F.col("longest")
    return found.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.floor(1000 * best["length"] / best["period"]).cast("bigint").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(line, lambda c: F.concat(c, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query
def op12_tag_path_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return page_text.extract(table(spark, sf_dir, "pages"))


@query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proof of every document, folded with the text of every other one tampered with."""
    docs = table(spark, sf_dir, "documents")
    number = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8"))
    text = F.replace(F.col("text"), F.lit("\n"), F.lit(""))
    tampered = merkle.leaf_of([text if c == "text" else c for c in merkle.COLUMNS])
    found = merkle.verified(docs, F.when(number % 2 == 0, tampered))
    return found.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        F.sha2(merkle.proof_text(F.col("path")), 256).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
