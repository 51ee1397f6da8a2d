"""Approximate nearest neighbours with an inverted multi-index.

Vectors are cut into two halves and each half is quantised by its own codebook; a pair of
centroids is a cell. A query measures its halves against both codebooks and walks the pairs of
centroids in order of summed distance with a heap until their cells hold enough entries, which
are measured exactly in double precision.

How many are enough is a share of the index, found on the sample that the codebooks are fitted
on (at most ``SAMPLE`` entries, lowest hashes): the share at which the walk meets ``RECALL`` of
the true neighbours of ``TRIALS`` sampled vectors. Clustered vectors need little; vectors
without any structure need much of the index, as with every method.

Equal vectors are one entry that carries its lowest keys, as many as could be asked for, so a
vector that fills a third of the table is one entry too, on both sides. Every entry is indexed.
A walk takes, for each centroid of the first half, the centroids of the second half in order up
to some number. So a query goes once to each such row of cells with that number. Rows are
searched in blocks of bounded size on either side, each pair of blocks returning the ``k`` best
of each query; no pairs are written.

If the cells visited hold fewer than ``k`` others, the walk goes on until they do or the index is
exhausted, so a query gets all candidates there are if these are fewer than ``k``.

Defined results
---------------
* Vectors that are NULL, empty, zero, or hold NULL or non-finite components take no part, neither
  do those of another length than the most common one (of several, the greatest).
* Keys may be repeated: rows with the key of a query are not its neighbours; repeated keys of
  candidates are found once for each distinct vector. NULL keys take no part.
* Ties in distance go to the smaller key. An empty table or no query gives an empty result.
* Columns other than the named ones are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from reviewmill.llm.common import stored
from reviewmill.operators.joins import sized
from reviewmill.session import cut_lineage

SAMPLE = 20_000
TRIALS = 100
RECALL = 0.97
CHUNK = 4_096
MAX_CENTROIDS = 256
CENTROID_ENTRIES = 16  # entries for each centroid, at least
ROUNDS = 10
BLOCK_ENTRIES = 20_000
BLOCK_QUERIES = 2_000


class Books(NamedTuple):
    """Centroids of the first and of the second half, and the entries in each cell."""

    first: np.ndarray
    second: np.ndarray
    counts: np.ndarray  # first x second


def _distances(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    squares = (vectors * vectors).sum(axis=1)[:, None] + (centroids * centroids).sum(axis=1)[None, :]
    return np.maximum(squares - 2.0 * vectors @ centroids.T, 0.0)


def _nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of every vector and its squared distance, in chunks of bounded size."""
    place, least = np.empty(len(vectors), np.int64), np.empty(len(vectors))
    for start in range(0, len(vectors), CHUNK):
        distances = _distances(vectors[start : start + CHUNK], centroids)
        place[start : start + CHUNK] = distances.argmin(axis=1)
        least[start : start + CHUNK] = distances.min(axis=1)
    return place, least


def codebook(vectors: np.ndarray, size: int, rounds: int = ROUNDS, seed: int = 1) -> np.ndarray:
    """Centroids by Lloyd's rounds; a centroid left without vectors moves to the farthest one."""
    random = np.random.default_rng(seed)
    size = max(1, min(size, len(vectors)))
    centroids = vectors[random.choice(len(vectors), size, replace=False)].copy()
    for _ in range(rounds):
        nearest, least = _nearest(vectors, centroids)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, vectors)
        counts = np.bincount(nearest, minlength=size)
        centroids = sums / np.maximum(counts, 1)[:, None]
        empty = np.flatnonzero(counts == 0)
        if len(empty):
            centroids[empty] = vectors[np.argsort(-least, kind="stable")[: len(empty)]]
    return centroids


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.astype(np.float64).reshape(len(column), dim)


def _halves(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    half = (matrix.shape[1] + 1) // 2
    return matrix[:, :half], matrix[:, half:]


def fit(vectors: np.ndarray, size: int, k: int, recall: float = RECALL, trials: int = TRIALS) -> tuple[Books, float]:
    """Codebooks of sampled vectors, and the share of an index that a walk has to meet."""
    a, b = _halves(vectors)
    books = Books(codebook(a, size), codebook(b, size), np.zeros((0, 0), np.int32))
    tried = vectors[: min(trials, len(vectors))]
    squares = _distances(tried, vectors)
    squares[np.arange(len(tried)), np.arange(len(tried))] = np.inf
    true = np.argsort(squares, axis=1, kind="stable")[:, :k]
    own_a, own_b = _halves(tried)
    summed = _distances(own_a, books.first)[:, _nearest(a, books.first)[0]]
    summed += _distances(own_b, books.second)[:, _nearest(b, books.second)[0]]
    met = np.sort(summed, axis=1)
    at = np.concatenate([np.searchsorted(m, s[t], side="right") for m, s, t in zip(met, summed, true)])
    return books, float(np.quantile(at, recall)) / len(vectors)


def _assign(shared, dim: int):
    """Task function: the row and the column of the cell of every entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = Books(*shared.value)
        for batch in batches:
            first, second = _halves(_matrix(batch.column(0), dim))
            places = [pa.array(_nearest(h, c)[0]) for h, c in ((first, books.first), (second, books.second))]
            yield pa.RecordBatch.from_arrays([*places, *batch.columns], ["row", "col", "vector", "keys"])

    return run


def walk(first: np.ndarray, second: np.ndarray, counts: np.ndarray, wanted: int) -> np.ndarray:
    """Cells in order of summed distance until they hold ``wanted`` entries.

    Returns, for every centroid of the first half, how many of the second half were taken, in
    order of their distance.
    """
    by_first, by_second = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    a, b = first[by_first].tolist(), second[by_second].tolist()
    held_in = counts[by_first][:, by_second].tolist()
    heap, reached, held = [(a[0] + b[0], 0, 0)], [0] * len(a), 0
    while heap and held < wanted:
        _, i, j = heapq.heappop(heap)
        reached[i] = j + 1
        held += held_in[i][j]
        # a pair follows when both its neighbours before it are taken
        if i + 1 < len(a) and reached[i + 1] == j:
            heapq.heappush(heap, (a[i + 1] + b[j], i + 1, j))
        if j + 1 < len(b) and (i == 0 or reached[i - 1] > j + 1):
            heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
    out = np.zeros(len(a), np.int64)
    out[by_first] = reached
    return out


def _visit(shared, dim: int, wanted: int):
    """Task function: the rows of cells that each distinct query vector visits, and how far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = Books(*shared.value)
        for batch in batches:
            first, second = _halves(_matrix(batch.column(1), dim))
            a, b = _distances(first, books.first), _distances(second, books.second)
            for i in range(len(a)):
                reached = walk(a[i], b[i], books.counts, wanted)
                rows = np.flatnonzero(reached)
                place = pa.array(np.full(len(rows), i))
                arrays = [pa.array(rows), pa.array(reached[rows]), batch.column(0).take(place), batch.column(1).take(place)]
                yield pa.RecordBatch.from_arrays(arrays, ["row", "reached", "query", "vector"])

    return run


def _search(shared, dim: int, keep: int):
    """Group function: the nearest entries of each query of a block within a block of a row."""

    def run(queries: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        out: list[list] = [[], [], []]
        if len(queries) and len(entries):
            centroids = Books(*shared.value).second
            base = np.array(entries["vector"].tolist(), dtype=np.float64).reshape(-1, dim)
            lowest = np.array([keys[0] for keys in entries["keys"]])
            order = np.argsort(lowest, kind="stable")
            base, keys, cols = base[order], entries["keys"].to_numpy()[order], entries["col"].to_numpy()[order]
            asked = np.array(queries["vector"].tolist(), dtype=np.float64).reshape(-1, dim)
            near_cols = np.argsort(_distances(_halves(asked)[1], centroids), axis=1, kind="stable")
            for i, (query, reached) in enumerate(zip(queries["query"], queries["reached"])):
                taken = np.zeros(len(centroids), bool)
                taken[near_cols[i, :reached]] = True
                met = np.flatnonzero(taken[cols])
                differ = base[met] - asked[i]
                scores = np.sqrt((differ * differ).sum(axis=1))
                near = np.argsort(scores, kind="stable")[:keep]  # entries are in order of their lowest key
                out[0] += [query] * len(near)
                out[1] += scores[near].tolist()
                out[2] += [list(k) for k in keys[met[near]]]
        columns = zip(("query", "score", "keys"), out, ("int64", "float64", "object"))
        return pd.DataFrame({name: pd.Series(values, dtype=kind) for name, values, kind in columns})

    return run


def _valid(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0)


def _entries(vectors: DataFrame, most: int) -> DataFrame:
    """One row for each distinct vector with its ``most`` lowest distinct keys."""
    lowest = Window.partitionBy("vector").orderBy("key")
    distinct = vectors.groupBy("vector", "key").agg(F.lit(1).alias("_one"))
    ranked = distinct.withColumn("_rank", F.row_number().over(lowest)).where(F.col("_rank") <= most)
    return ranked.groupBy("vector").agg(F.sort_array(F.collect_list("key")).alias("keys"))


def search(
    rows: DataFrame,
    is_query: Column,
    k: int = 10,
    key: str = "vec_id",
    vector: str = "embedding",
    recall: float = RECALL,
    max_centroids: int = MAX_CENTROIDS,
    sample: int = SAMPLE,
    block_entries: int = BLOCK_ENTRIES,
    block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """``query_id``, ``rank``, key and ``score`` of the ``k`` nearest found for each query row."""
    spark = rows.sparkSession
    named = rows.select(
        F.col(key).cast("bigint").alias("key"),
        F.col(vector).cast("array<double>").alias("vector"),
        is_query.alias("is_query"),
    ).where(_valid(F.col("vector")) & F.col("key").isNotNull())
    sizes = named.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    out = f"query_id bigint, rank int, {key} bigint, score double"
    if sizes is None:
        return spark.createDataFrame([], out)
    dim = sizes.dim
    named = named.where(F.size("vector") == dim)
    entries = stored(_entries(named.select("key", "vector"), k + 1), "entries")
    n = entries.count()
    lowest = entries.select("vector").orderBy(F.xxhash64("vector"), "vector").limit(sample)
    fitted = np.array(lowest.toArrow().column(0).combine_chunks().flatten()).reshape(-1, dim)
    size = min(max_centroids, max(1, len(fitted) // CENTROID_ENTRIES))
    books, share = fit(fitted, size, k, recall)

    # the codebooks and the counts of the cells are bounded by max_centroids
    shared = spark.sparkContext.broadcast(tuple(books))  # plain, as broadcasts are not pickled by value
    schema = "row bigint, col bigint, vector array<double>, keys array<bigint>"
    celled = stored(entries.mapInArrow(_assign(shared, dim), schema), "cells")
    counts = np.zeros((len(books.first), len(books.second)), np.int32)
    for cell in celled.groupBy("row", "col").count().collect():
        counts[cell["row"], cell["col"]] = cell["count"]
    shared = spark.sparkContext.broadcast(tuple(books._replace(counts=counts)))

    queries = named.where("is_query").select("vector", F.col("key").alias("query_id")).distinct()
    keyed = stored(queries.groupBy("vector").agg(F.min("query_id").alias("query")), "queries").select("query", "vector")
    wanted = max(k + 1, math.ceil(share * n))
    schema = "row bigint, reached bigint, query bigint, vector array<double>"
    visits = stored(keyed.mapInArrow(_visit(shared, dim, wanted), schema), "visits")

    def block_counts(df: DataFrame, per_block: int, name: str) -> DataFrame:
        return df.groupBy("row").agg(F.ceil(F.count("*") / per_block).cast("int").alias(name))

    both = block_counts(visits, block_queries, "q_blocks").join(block_counts(celled, block_entries, "e_blocks"), "row")
    both = sized(cut_lineage(both))

    def dealt(df: DataFrame, own: str, others: str, hashed: str, mine: str, copies: str) -> DataFrame:
        block = F.pmod(F.xxhash64(hashed), F.col(own)).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.col(others) - 1))
        return df.join(both, "row").withColumn(mine, block).withColumn(copies, every)

    group = ["row", "q_block", "e_block"]
    left = dealt(visits, "q_blocks", "e_blocks", "query", "q_block", "e_block").select(*group, "reached", "query", "vector")
    right = dealt(celled, "e_blocks", "q_blocks", "vector", "e_block", "q_block").select(*group, "col", "vector", "keys")
    found = left.groupBy(*group).cogroup(right.groupBy(*group)).applyInPandas(
        _search(shared, dim, k + 1), "query bigint, score double, keys array<bigint>"
    )
    # the k + 1 nearest entries of a query hold its k nearest others, whichever entry is its own
    by_score = Window.partitionBy("query").orderBy("score", F.element_at("keys", 1))
    best = found.withColumn("_rank", F.row_number().over(by_score)).where(F.col("_rank") <= k + 1)
    near = best.groupBy("query").agg(F.collect_list(F.struct("score", "keys")).alias("near"))
    asked = queries.join(keyed, "vector").select("query", "query_id")
    pairs = F.flatten(
        F.transform("near", lambda e: F.transform(e["keys"], lambda i: F.struct(e["score"].alias("score"), i.alias("id"))))
    )
    others = F.filter(pairs, lambda p: p["id"] != F.col("query_id"))
    top = F.slice(F.array_sort(others), 1, k)
    answered = near.join(asked, "query").select("query_id", F.posexplode(top).alias("pos", "hit"))
    return answered.select(
        "query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("hit.id").alias(key), F.col("hit.score").alias("score")
    )
