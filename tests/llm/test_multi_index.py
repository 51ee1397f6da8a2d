import numpy as np
from pyspark.sql import functions as F

from reviewmill.llm import multi_index

SCHEMA = "vec_id bigint, embedding array<float>, label int"
NEAREST = "query_id bigint, rank int, vec_id bigint, score double"


def brute_force(rows, k):
    valid = [
        (i, np.array(v, dtype=np.float32).astype(float))
        for i, v in rows
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v) and len(v) == 6
    ]
    found = set()
    for query, own in valid:
        if query % 100 == 0:
            near = sorted({(float(np.sqrt(((own - v) ** 2).sum())), i) for i, v in valid if i != query})[:k]
            found |= {(query, rank, i, score) for rank, (score, i) in enumerate(near, 1)}
    return found


def search(spark, rows, **options):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).withColumns({"key": F.lit(1), "row": F.lit(2)})
    return multi_index.search(df, F.col("vec_id") % 100 == 0, k=10, **options)


def recall(found, wanted):
    hits = {(q, i) for q, _, i, _ in found} & {(q, i) for q, _, i, _ in wanted}
    return len(hits) / len(wanted)


def test_recall_ties_copies_and_invalid_vectors(spark):
    random = np.random.default_rng(3)
    rows = [(i, random.normal(size=6).astype(np.float32).tolist()) for i in range(1500)]
    hot = [1.0, 2.0, 0.5, 0.0, 1.0, 1.0]
    rows += [(i, hot) for i in range(1500, 2400)]  # a vector that fills a third of the table
    rows += [(3000, None), (3001, [0.0] * 6), (3100, [float("nan")] + [1.0] * 5), (3002, [float("inf")] + [1.0] * 5)]
    rows += [(3003, [None] + [1.0] * 5), (3004, []), (3200, [1.0, 2.0]), (None, hot), (5, rows[5][1])]
    found = {tuple(r) for r in search(spark, rows, block_entries=200, block_queries=4).collect()}
    wanted = brute_force(rows, 10)
    assert len(found) == len(wanted)
    assert recall(found, wanted) >= 0.9
    exact = {(q, i): s for q, _, i, s in wanted}
    assert all(abs(exact[q, i] - s) < 1e-12 for q, _, i, s in found if (q, i) in exact)
    of_copies = sorted(r for r in found if r[0] == 1600)
    assert [(rank, i, s) for _, rank, i, s in of_copies] == [(n, 1499 + n, 0.0) for n in range(1, 11)]


def test_everything_is_found_when_there_is_little(spark):
    rows = [(100 * i, [float(i), 1.0, 0.0, 0.0, 2.0, 0.0]) for i in range(5)]
    assert {tuple(r) for r in search(spark, rows).collect()} == brute_force(rows, 10)
    assert search(spark, [(1, [1.0, 2.0])]).count() == 0
    assert search(spark, []).count() == 0
    single = [(i, [float(i + 1)]) for i in range(0, 300, 50)]
    assert search(spark, single).where("query_id = 100 AND rank = 1").first().vec_id == 50


def test_walk_takes_cells_in_order_of_distance():
    random = np.random.default_rng(1)
    first, second, counts = random.random(7), random.random(9), random.integers(0, 4, (7, 9))
    for wanted in (1, 10, 40, 10_000):
        reached = multi_index.walk(first, second, counts, wanted)
        order = sorted((first[i] + second[j], i, j) for i in range(7) for j in range(9))
        held, taken = 0, np.zeros(7, int)
        for _, i, j in order:
            if held >= wanted:
                break
            held += counts[i, j]
            taken[i] += 1
        assert reached.tolist() == taken.tolist()
