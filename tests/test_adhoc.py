from datetime import datetime

import pytest

from reviewmill.fixed_values import (
    ACTION_ANALYSE,
    ACTION_PLOT,
    ACTION_SQL,
    INVALID_SQL,
    REPORT_RATING_SHARE,
)
from reviewmill.functions.vectors import vector_from_text
from reviewmill.operators.embedding import embed_text, hashing_embedder
from reviewmill.plans import actions, adhoc


@pytest.fixture
def tables(spark):
    texts = ["god service", "dårlig rådgivning", "høje gebyrer", "god app"]
    rows = [
        (str(i), 1 + i % 2, "AB"[i % 2], datetime(2024, 1, 1 + i), t, 5 - i, i)
        for i, t in enumerate(texts)
    ]
    review = spark.createDataFrame(
        rows,
        "id string, company_id int, company string, timestamp timestamp, content string, rating int, category int",
    )
    return {"review": embed_text(review), "company": spark.createDataFrame([(1, "A")], "id int, name string")}


def test_sql_runs_and_previews_as_text(spark, tables):
    adhoc.register(**tables)
    got = adhoc.preview_sql(spark, ' "SELECT company, avg(rating) AS m FROM review GROUP BY company ORDER BY company;"\n')
    assert got == [{"company": "A", "m": "4.0"}, {"company": "B", "m": "3.0"}]
    ordered = adhoc.run_sql(spark, "SELECT id FROM review ORDER BY rating -- worst first")
    assert [r.id for r in ordered.collect()] == ["3", "2", "1", "0"]


def test_repeated_and_odd_column_names(spark, tables):
    adhoc.register(**tables)
    joined = "SELECT a.id, b.id, a.rating AS `x``y.z` FROM review a JOIN review b ON a.company = b.company WHERE a.id = '0' AND b.id = '2'"
    assert adhoc.preview_sql(spark, joined) == [{"id": "0", "id_2": "2", "x`y.z": "5"}]


@pytest.mark.parametrize(
    "sql",
    [
        "SELEC 1",
        "SELECT nothing FROM review",
        "SELECT 1/0",
        "DROP VIEW review",
        "SELECT CAST(content AS int) FROM review",
        "",
    ],
)
def test_every_failure_is_the_same_error(spark, tables, sql):
    adhoc.register(**tables)
    with pytest.raises(ValueError, match=INVALID_SQL):
        adhoc.preview_sql(spark, sql)
    assert spark.table("review").count() == 4


def test_sample_questions(spark, tables):
    adhoc.register(**tables)
    assert adhoc.run_sql(spark, adhoc.top_company_sql("2024-01-04")).first().company == "B"
    assert adhoc.run_sql(spark, adhoc.most_reviews_sql()).first().n_reviews == 2
    assert adhoc.run_sql(spark, adhoc.rating_trend_sql("A", "2024-01-01")).first().mean_rating == 4.0
    assert adhoc.run_sql(spark, adhoc.compare_set_sql(["A", "O'x"])).count() == 1


def test_steps_of_a_plan(spark, tables):
    metadata = actions.Metadata(companies=["A"])
    sql = actions.run_step(ACTION_SQL, ["SELECT count(*) AS n FROM review"], metadata, tables)
    assert sql == [{"query": "SELECT count(*) AS n FROM review", "result": [{"n": "4"}]}]
    plots = actions.run_step(ACTION_PLOT, [REPORT_RATING_SHARE], metadata, tables)
    assert [tuple(r) for r in plots[REPORT_RATING_SHARE].collect()] == [(3, 1, 50.0), (5, 1, 50.0)]
    again = actions.run_step(ACTION_PLOT, [REPORT_RATING_SHARE], metadata, tables)
    assert again[REPORT_RATING_SHARE].count() == 2  # the metadata is unchanged
    payload = actions.run_step(ACTION_ANALYSE, ["god", "gebyrer"], metadata, tables)
    found = {(r.similarity_query, r.company) for r in payload.collect()}
    assert found == {("god", "A"), ("gebyrer", "A")}
    with pytest.raises(ValueError, match="Unexpected action"):
        actions.run_step("SING", [], metadata, tables)


def test_similar_reviews(spark, tables):
    got = actions.similar_reviews(tables["review"], "Gebyrer!", 2, cols=["id", "content"])
    assert got.columns == ["id", "content"] and got.first().content == "høje gebyrer" and got.count() == 2
    only = actions.similar_reviews(tables["review"], "gebyrer", 5, actions.Metadata(companies=["B"]))
    assert {r.company for r in only.collect()} == {"B"}


def test_whole_plan(spark, tables):
    plan = f"""["{ACTION_PLOT}: ['{REPORT_RATING_SHARE}']", "{ACTION_SQL}: ['SELECT max(rating) AS best FROM review']"]"""
    got = actions.run_plan(plan, actions.Metadata(companies=["B"]), tables)
    assert [action for action, _ in got] == [ACTION_PLOT, ACTION_SQL]
    assert got[0][1][REPORT_RATING_SHARE].count() == 2
    assert got[1][1][0]["result"] == [{"best": "5"}]
    assert actions.run_plan("nothing to do", actions.Metadata(), tables) == []


def test_no_query_texts_give_an_empty_payload(spark, tables):
    assert actions.run_step(ACTION_ANALYSE, [], actions.Metadata(), tables).count() == 0


def test_embedder_is_pluggable_and_the_default_has_unit_length(spark):
    df = spark.createDataFrame([("a\nb",), ("",), (None,)], "content string")
    got = [r.embedding for r in embed_text(df, embedder=hashing_embedder(16)).collect()]
    assert [len(v) for v in got] == [16, 16, 16]
    assert abs(sum(x * x for x in got[0]) - 1) < 1e-6 and sum(got[1]) == 0

    def lengths(frame, text, vector):
        return frame.selectExpr("*", f"array(CAST(length({text}) AS float)) AS {vector}")

    assert [r.embedding for r in embed_text(df, embedder=lengths).collect()] == [[3.0], [0.0], [0.0]]


def test_vector_text(spark):
    df = spark.createDataFrame([("[0.5,-1,2e-1]",), (None,), ("x",)], "v string")
    got = [r.v for r in df.select(vector_from_text(df.v).alias("v")).collect()]
    assert [round(x, 6) for x in got[0]] == [0.5, -1.0, 0.2] and got[1:] == [None, None]
