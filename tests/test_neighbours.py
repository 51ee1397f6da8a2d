import math
import random
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from reviewmill.functions import topk
from reviewmill.operators import joins, neighbours
from reviewmill.sources import fixtures

SCHEMA = "id string, embedding array<float>"
QUERY_SCHEMA = "similarity_query string, q_embedding array<float>"


def make(seed, n, dim=4, missing=0.2, prefix="r"):
    gen = random.Random(seed)
    out = []
    for i in range(n):
        vector = None if gen.random() < missing else [gen.choice([0.0, 0.25, 0.5, 1.0]) for _ in range(dim)]
        out.append((f"{prefix}{i}", vector))
    return out


def brute(queries, base, k):
    out = []
    for name, q in queries:
        def dist(v):
            return math.inf if v is None or q is None else math.dist(q, v)

        best = sorted((dist(v), key) for key, v in base)[:k]
        out += [
            (name, rn, key, None if math.isinf(d) else round(d, 9))
            for rn, (d, key) in enumerate(best, 1)
        ]
    return sorted(out, key=repr)


def found(df):
    return sorted(
        ((r[0], r[1], r[2], None if r[3] is None else round(r[3], 9)) for r in df.collect()), key=repr
    )


@pytest.mark.parametrize("k", [1, 7, 300])
@pytest.mark.parametrize("held, block", [(1000, 100), (100, 100), (3, 20)])
def test_every_strategy_equals_brute_force(spark, k, held, block):
    queries, base = make(1, 110 if held == 100 else 9, prefix="q"), make(2, 90)
    if held == 100:
        assert len(queries) > held >= len(base)  # the base is held
    got = neighbours.nearest(
        spark.createDataFrame(queries, QUERY_SCHEMA),
        spark.createDataFrame(base, SCHEMA).repartition(5),
        k,
        held=held,
        block=block,
    )
    assert found(got) == brute(queries, base, k)


@pytest.mark.parametrize("pushed", [-1, 1000])
def test_single_query_puts_missing_vectors_last(spark, monkeypatch, pushed):
    monkeypatch.setattr(joins, "PUSHED_KEYS", pushed)
    base = [("a", None), ("b", [1.0, 1.0]), ("c", [0.0, 0.0]), ("d", None)]
    got = neighbours.nearest_one(spark.createDataFrame(base, SCHEMA), [0.0, 0.0], 3)
    assert [r.id for r in got.collect()] == ["c", "b", "a"]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert ("TakeOrderedAndProject" in plan) == (pushed < 0)  # otherwise it has run already


@pytest.mark.parametrize("queries", [1, 5])
def test_empty_base(spark, queries):
    asked = spark.createDataFrame([(str(i), [0.0]) for i in range(queries)], QUERY_SCHEMA)
    assert neighbours.nearest(asked, spark.createDataFrame([], SCHEMA), 2, held=3).count() == 0


def test_double_vectors(spark):
    base = spark.createDataFrame([("a", [1e-9]), ("b", [2e-9])], "id string, embedding array<double>")
    asked = spark.createDataFrame([(str(i), [2e-9]) for i in range(3)], "similarity_query string, q_embedding array<double>")
    for held, block in ((10, 10), (2, 1), (1, 1)):
        got = neighbours.nearest(asked, base, 1, held=held, block=block).collect()
        assert [(r.id, r.dist) for r in got] == [("b", 0.0)] * 3


def reviews(spark, n=40):
    data = [
        (key, f"C{i % 3}", i % 6 - 1 if i % 5 else None, f"text {i}", vector)
        for i, (key, vector) in enumerate(make(3, n))
    ]
    return spark.createDataFrame(
        data, "id string, company string, category int, content string, embedding array<float>"
    )


def test_retrieve_divides_the_budget_and_keeps_repeated_reviews(spark):
    queries = spark.createDataFrame([("x", [0.0] * 4), ("y", [0.0] * 4), ("z", [1.0] * 4)], QUERY_SCHEMA)
    got = neighbours.retrieve(queries, reviews(spark), total=20).collect()
    per_query = {q: {r.id for r in got if r.similarity_query == q} for q in "xyz"}
    assert {q: len(ids) for q, ids in per_query.items()} == {"x": 6, "y": 6, "z": 6}
    assert per_query["x"] == per_query["y"]
    assert {r.category for r in got} <= {
        "other", "customer service", "counseling", "mobile/web bank", "fees and interest rates"
    }


def test_retrieve_without_queries_is_empty(spark):
    got = neighbours.retrieve(spark.createDataFrame([], QUERY_SCHEMA), reviews(spark))
    assert got.collect() == []
    assert got.columns[:3] == ["similarity_query", "rn", "id"]


def test_more_queries_than_the_budget_get_one_row_each(spark):
    queries = spark.createDataFrame([(str(i), [float(i)] * 4) for i in range(4)], QUERY_SCHEMA)
    rows = [(f"r{i}", [float(i)] * 4) for i in range(6)]
    reviews = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(None).cast(t) for c, t in (("company", "string"), ("category", "int"), ("content", "string"))})
    found = neighbours.retrieve(queries, reviews, total=3).collect()
    assert sorted((r.similarity_query, r.id) for r in found) == [(str(i), f"r{i}") for i in range(4)]


def test_a_side_is_held_by_its_bytes(spark):
    """Whatever the strategy, the result is the same; a side above the bytes is never held."""
    queries, base = make(1, 40, prefix="q"), make(2, 30)
    asked, rows = spark.createDataFrame(queries, QUERY_SCHEMA), spark.createDataFrame(base, SCHEMA)
    wanted = brute(queries, base, 3)
    for held_bytes, form in ((10**9, "MapInArrow"), (0, "FlatMapCoGroupsInPandas")):
        got = neighbours.nearest(asked, rows, 3, block=20, held_bytes=held_bytes)
        assert form in got._jdf.queryExecution().executedPlan().toString() and found(got) == wanted


def test_lsh_searches_short_queries_exactly(spark):
    """Buckets so narrow that hardly any holds two rows: all neighbours are found nevertheless."""
    queries, base = make(4, 12, prefix="q", missing=0), make(5, 40, missing=0)
    asked, rows = spark.createDataFrame(queries, QUERY_SCHEMA), spark.createDataFrame(base, SCHEMA)
    got = neighbours.nearest_lsh(asked, rows, 30, spread=1e-6, tables=2)
    assert found(got) == brute(queries, base, 30)


def test_nearest_name_breaks_ties_by_id(spark):
    companies = spark.createDataFrame(
        [(1, "A", [1.0, 0.0]), (2, "B", [0.0, 1.0]), (3, "A2", [1.0, 0.0]), (4, "N", None)],
        "id int, name string, embedding array<float>",
    )
    mentions = spark.createDataFrame(
        [("a?", [0.9, 0.0]), ("b?", [0.0, 0.8])], "mention string, embedding array<float>"
    )
    got = neighbours.nearest_name(mentions, companies)
    assert {r.mention: r.name for r in got.collect()} == {"a?": "A", "b?": "B"}


def test_vectors_of_different_length_are_refused(spark):
    base = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [1.0])], SCHEMA).coalesce(1)
    queries = spark.createDataFrame([("q", [0.0, 0.0])], QUERY_SCHEMA)
    with pytest.raises(Exception, match="differ in length"):
        neighbours.nearest(queries, base, 1).collect()


def found_pairs(df):
    return {(r[0], r[2]) for r in df.collect()}


def test_lsh_recall_and_exact_distances(spark, sf_dir):
    vecs = fixtures.table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("id"), "embedding"
    )
    queries = vecs.toDF("similarity_query", "q_embedding")
    exact = neighbours.nearest(queries, vecs, 5)
    approx = neighbours.nearest_lsh(queries, vecs, 5)
    pairs = found_pairs(exact)
    assert len(pairs & found_pairs(approx)) >= 0.9 * len(pairs)
    far = approx.join(exact.withColumnRenamed("dist", "d"), ["similarity_query", "id"])
    assert far.where("abs(dist - d) > 1e-9").count() == 0


def test_lsh_splits_a_bucket_that_holds_everything(spark):
    """One long bucket: the blocks of it together give the exact result."""
    queries, base = make(4, 30, prefix="q", missing=0), make(5, 60, missing=0)
    asked, rows = spark.createDataFrame(queries, QUERY_SCHEMA), spark.createDataFrame(base, SCHEMA)
    got = neighbours.nearest_lsh(asked, rows, 4, spread=1000.0, tables=64, width=1, block=7)
    assert found(got) == brute(queries, base, 4)


def test_lsh_leaves_out_missing_vectors(spark):
    base = spark.createDataFrame([("a", None), ("b", [1.0, 0.0])], SCHEMA)
    asked = spark.createDataFrame([("q", [1.0, 0.0]), ("n", None)], QUERY_SCHEMA)
    assert found(neighbours.nearest_lsh(asked, base, 5)) == [("q", 1, "b", 0.0)]


def test_vectors_that_are_not_finite_rank_last(spark):
    base = [("a", [1.0, 0.0]), ("b", [math.nan, 0.0]), ("c", None), ("d", [math.inf, 1.0])]
    queries = [("q", [1.0, 1.0]), ("n", [math.nan, 1.0])]
    rows = spark.createDataFrame(base, SCHEMA), spark.createDataFrame(queries, QUERY_SCHEMA)
    got = found(neighbours.nearest(rows[1], rows[0], 3))
    assert got == sorted(
        [("q", 1, "a", 1.0), ("q", 2, "b", None), ("q", 3, "c", None)]
        + [("n", rn, key, None) for rn, key in enumerate("abc", 1)],
        key=repr,
    )


def test_approximate_search_without_queries_or_base(spark):
    none = spark.createDataFrame([], QUERY_SCHEMA), spark.createDataFrame([("a", [1.0])], SCHEMA)
    assert neighbours.nearest_lsh(none[0], none[1], 2).count() == 0
    one = spark.createDataFrame([("q", [1.0])], QUERY_SCHEMA), spark.createDataFrame([("a", None)], SCHEMA)
    assert neighbours.nearest_lsh(one[0], one[1], 2).count() == 0


def test_small_blocks_do_not_copy_rows_without_bound(spark, monkeypatch):
    """However small the blocks asked for, a row has few copies, and all pairs are measured."""
    counts, block = [], neighbours._block

    def counted(df, *args):
        copied = block(df, *args)
        counts.append((df.count(), copied.count()))
        return copied

    monkeypatch.setattr(neighbours, "_block", counted)
    queries, base = make(1, 45, prefix="q"), make(2, 60)
    asked, rows = spark.createDataFrame(queries, QUERY_SCHEMA), spark.createDataFrame(base, SCHEMA)
    assert found(neighbours.nearest(asked, rows, 3, held=5, block=2)) == brute(queries, base, 3)
    assert len(counts) == 2 and all(copies <= 8 * n for n, copies in counts)


def test_blocks_are_no_larger_than_a_task_may_hold():
    assert neighbours._n_blocks(joins.Size(1_000_000, 500_000_000), 150) == 50
    assert neighbours._n_blocks(joins.Size(10_000, 100 * neighbours.HELD_BYTES), 20_000) == 100
    assert neighbours._n_blocks(joins.Size(1_000, 1_000), 150) == 7


@pytest.mark.parametrize("copies", [False, True])
def test_a_pair_of_blocks_is_measured_in_slices(copies):
    """Memory follows the vectors of two blocks, not their pairs; also where all rows are copies."""
    rng = np.random.default_rng(3)
    vectors = np.zeros((12_000, 8), np.float32) if copies else rng.standard_normal((12_000, 8)).astype(np.float32)
    base = pd.DataFrame({"_key": np.arange(12_000), "_vector": list(vectors)})
    asked = pd.DataFrame({"_query": np.arange(70), "_vector": list(vectors[:70])})
    tracemalloc.start()
    got = topk.scan_blocks(2)(asked, base)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < (16_000_000 if copies else 10_000_000)
    nearest = got[got["_rank"] == 1]
    assert nearest["_dist"].tolist() == [0.0] * 70
    assert nearest["_key"].tolist() == ([0] * 70 if copies else list(range(70)))
