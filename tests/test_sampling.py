import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from reviewmill.operators import sampling
from reviewmill.plans import payload

SCHEMA = "id string, category string, company string, similarity_query string, content string"


def make(spark, sizes, content="four words of text"):
    rows, n = [], 0
    for group, size in sizes.items():
        for _ in range(size):
            rows.append((f"r{n}", group, "C", None if group == "none" else "q", content))
            n += 1
    return spark.createDataFrame(rows, SCHEMA)


def test_uniform_sample_is_exact_and_repeatable(spark):
    df = make(spark, {"a": 50})
    one = {r.id for r in sampling.uniform_sample(df, 20, seed=1).collect()}
    assert len(one) == 20 and one == {r.id for r in sampling.uniform_sample(df.repartition(3), 20, seed=1).collect()}
    assert one != {r.id for r in sampling.uniform_sample(df, 20, seed=2).collect()}
    assert sampling.uniform_sample(df, 80).count() == 50


def test_weights_cover_missing_keys(spark):
    got = sampling.group_weights(make(spark, {"a": 3, "none": 1})).collect()
    assert {r.category: (r.n, r.weight) for r in got} == {"a": (3, 0.75), "none": (1, 0.25)}
    assert sampling.weighted_sample(make(spark, {"a": 3, "none": 1}), 4).count() == 4


def test_weighted_sample_prefers_large_groups(spark):
    """The first row drawn lies in a group of size s with probability s*s / sum of squares."""
    df = make(spark, {"big": 30, "small": 10}).cache()
    draws = Counter()
    keys = [
        sampling.sampling_keys(df, seed).orderBy("sampling_key").limit(1).withColumn("seed", F.lit(seed))
        for seed in range(60)
    ]
    union = keys[0]
    for other in keys[1:]:
        union = union.union(other)
    for row in union.join(df.select("id", "category"), "id").collect():
        draws[row.category] += 1
    assert sum(draws.values()) == 60
    assert 45 <= draws["big"] <= 60  # expected 54 of 60


def test_inclusion_is_even_within_a_group(spark):
    df = make(spark, {"a": 10}).cache()
    seen = Counter()
    for seed in range(30):
        seen.update(r.id for r in sampling.weighted_sample(df, 5, seed).collect())
    assert len(seen) == 10 and sum(seen.values()) == 150
    assert all(6 <= n <= 24 for n in seen.values())


def test_budget_decides_between_all_and_a_sample(spark):
    df = make(spark, {"a": 30, "b": 10})  # four tokens each
    assert sampling.representative_sample(df, max_tokens=40).count() == 10
    assert sampling.representative_sample(df, max_tokens=43).count() == 10
    assert sampling.representative_sample(df, max_tokens=160).count() == 40
    assert sampling.representative_sample(df, max_tokens=1000).count() == 40
    row = sampling.sample_budget(df, 43).first()
    assert (row.n_rows, row.avg_tokens, row.budget) == (40, 4.0, 10)


def test_mean_below_one_token_may_need_more_rows_than_tokens(spark):
    df = make(spark, {"a": 5}).union(make(spark, {"b": 95}, content="")).select(
        F.monotonically_increasing_id().cast("string").alias("id"), "category", "company", "similarity_query", "content"
    )  # mean 0.2 tokens, so 10 tokens allow 50 rows
    assert sampling.representative_sample(df, max_tokens=10).count() == 50


@pytest.mark.parametrize("sizes", [{}, {"a": 4}])
def test_empty_table_and_empty_texts_are_returned_whole(spark, sizes):
    df = make(spark, sizes, content="")
    assert sampling.representative_sample(df, max_tokens=10).count() == sum(sizes.values())


def test_few_texts_do_not_lift_the_budget(spark):
    rows = [(f"r{i}", "a", "C", "q", "some words" if i % 1000 == 7 else "") for i in range(20_000)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sampling.sample_budget(df, 100).first().avg_tokens < 1
    assert sampling.representative_sample(df, max_tokens=100).count() <= 15_000
    empty = spark.createDataFrame([r[:4] + ("",) for r in rows[:2_000]], SCHEMA)
    assert sampling.representative_sample(empty, max_tokens=100).count() == 100


def test_repeated_keys_do_not_add_rows(spark):
    rows = [(f"r{i % 4}", "a", "C", f"q{i}", "text") for i in range(200)]
    df = spark.createDataFrame(rows, SCHEMA)
    for n in (1, 3, 60, 200, 300):
        one = sorted(sampling.uniform_sample(df, n, seed=3).collect())
        assert len(one) == min(n, 200)
        assert one == sorted(sampling.uniform_sample(df.repartition(7), n, seed=3).collect())
        assert sampling.weighted_sample(df, n, 1, group=("category",)).count() == min(n, 200)


def test_other_tokenizer(spark):
    df = make(spark, {"a": 10}, content="abcd")
    got = sampling.representative_sample(df, 12, tokenizer=F.length)
    assert got.count() == 3


def test_sample_plan_neither_shuffles_nor_sorts_texts(spark):
    df = make(spark, {"a": 10})
    plan = sampling.weighted_sample(df, 3)._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if re.search("TakeOrdered|Exchange hash|Exchange Single|Sort ", line)]


def test_payload_groups_in_order_and_drops_missing_keys(spark):
    rows = [("A", "x", "q", 2, "2", "zwei"), ("A", "x", "q", 1, "9", "één"), ("A", None, "q", 3, "3", "no"), ("B", "x", "q", 4, "4", None)]
    df = spark.createDataFrame(
        rows, "company string, category string, similarity_query string, rn int, id string, content string"
    )
    grouped = payload.review_payload(df)
    assert {r.company: r.reviews for r in grouped.collect()} == {"A": ["één", "zwei"], "B": [None]}
    text = payload.payload_json(grouped).first().payload
    assert text.startswith('[{"company":"A","category":"x","similarity_query":"q","reviews":["één","zwei"]}')


def test_a_payload_beyond_its_bytes_is_an_error(spark):
    df = make(spark, {"a": 50}).withColumn("rn", F.lit(1))
    grouped = payload.review_payload(df)
    assert payload.payload_json(grouped, max_bytes=5_000).count() == 1
    with pytest.raises(ValueError, match="bytes"):
        payload.payload_json(grouped, max_bytes=500)


def test_csv_preview_and_template(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b", c', None), (2, "æ", 0.5)], "n int, t string, x double")
    assert [r.line for r in payload.csv_lines(df).collect()] == ["n,t,x", '1,"a \\"b\\", c",', "2,æ,0.5"]
    payload.write_csv(df, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    assert [r.asDict() for r in payload.preview(df, 1).collect()] == [{"n": "1", "t": 'a "b", c', "x": None}]
    filled = payload.fill_template("$n of ${t}: $$1$x", {c: F.col(c) for c in df.columns})
    assert [r.p for r in df.select(filled.alias("p")).collect()] == ['1 of a "b", c: $1', "2 of æ: $10.5"]
    with pytest.raises(KeyError):
        payload.fill_template("$unknown", {})
