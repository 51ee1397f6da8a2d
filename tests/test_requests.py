import random
import re

import pytest
from pyspark.sql import functions as F

from reviewmill.operators import conversations, requests
from reviewmill.operators.embedding import embed_text

PLANS = [
    ("""Plan: ["SQL: ['How many shops closed?']"]""", ["SQL: ['How many shops closed?']"]),
    ("""[\n  'PLOT: ["a", "b"]' ,\n"ANALYSE REVIEWS: ['slow delivery']", \n ] and so on""", ['PLOT: ["a", "b"]', "ANALYSE REVIEWS: ['slow delivery']"]),
    ("First [1] and [x], then ['a', \"b\"] and ['c']", ["a", "b"]),
    ("[ ]", []),
    ("no array", []),
    ("['open", []),
    (r"""['it\'s', "a \"b\" \\ c"]""", ["it's", 'a "b" \\ c']),
    (r"""["a\tb\r\nc", "S\u00f8nd\xe5g", "\ud83d\ude00", "\q\\n", "bl\u00e5 b\u00E6r"]""", ["a\tb\r\nc", "Søndåg", "😀", "\\q\\n", "blå bær"]),
    ("""['two ' "parts", 'one']""", ["two parts", "one"]),
    ("['" + "x" * 100_000 + "']", ["x" * 100_000]),
    ("[" + ", ".join(f"'s{i}'" for i in range(100_000)) + ",]", [f"s{i}" for i in range(100_000)]),
    ("[" + "'a' " * 5_000 + "]", ["a" * 5_000]),
    ("[" * 500_000 + "]" * 500_000, []),
    ('["' * 500_000, []),
    ("['" + "\\n" * 100_000 + "']", ["\n" * 100_000]),
]


@pytest.mark.parametrize("text, expected", PLANS)
def test_plan_text(spark, text, expected):
    df = spark.createDataFrame([("q", text)], "request_id string, plan string")
    got = requests.parse_plan(df).orderBy("step_no").collect()
    assert [r.step for r in got] == expected
    assert [r.step_no for r in got] == list(range(len(expected)))


def test_step_splits_at_the_first_colon_only(spark):
    steps = [(0, "SQL: ['Rating: how?', \"b\"]"), (1, " PLOT :[]"), (2, "STOP")]
    df = spark.createDataFrame([("q", n, s) for n, s in steps], "request_id string, step_no int, step string")
    got = requests.plan_steps(df).orderBy("step_no").collect()
    assert [(r.action, r.args) for r in got] == [("SQL", ["Rating: how?", "b"]), ("PLOT", []), ("STOP", None)]


def test_metadata(spark):
    texts = [
        '{"companies":["A"],"start_date":"2023-01-01","end_date":"","categories":["counseling"]}',
        "not json",
        '{"companies":[]}',
    ]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "request_id string, metadata string")
    got = requests.request_metadata(df).orderBy("request_id").collect()
    assert got[0].companies == ["A"] and got[0].start_date.isoformat() == "2023-01-01" and got[0].end_date is None
    assert got[0].categories == ["counseling"]
    assert (got[1].companies, got[1].start_date, got[1].categories) == ([], None, [])


def test_mentions(spark):
    companies = spark.createDataFrame(
        [("Nordisk Bank",), ("Bank",), ("Havets",), ("Mågens Sparekasse A/S",), ("Måne",)], "name string"
    )
    questions = [
        ("1", "Hvordan har NORDISK  bank klaret sig siden 2023-01-01, mobile/web bank?"),
        ("2", "Mågens Sparekasse A/S eller Havets? Måneskin! 2022-02-03 til 2022-05-06"),
        ("3", "something other"),
        ("4", ""),
    ]
    df = spark.createDataFrame(questions, "request_id string, question string")
    got = {r.request_id: r for r in requests.extract_mentions(df, companies).collect()}
    assert got["1"].companies == ["Bank", "Nordisk Bank"] and got["1"].categories == ["mobile/web bank"]
    assert (got["1"].start_date, got["1"].end_date) == ("2023-01-01", "")
    assert got["2"].companies == ["Havets", "Mågens Sparekasse A/S"]
    assert (got["2"].start_date, got["2"].end_date) == ("2022-02-03", "2022-05-06")
    assert got["3"].companies == [] and got["3"].categories == [] and got["4"].companies == []


def test_companies_are_resolved_in_order(spark):
    companies = embed_text(
        spark.createDataFrame([(1, "Nordisk Bank"), (2, "Solskin Forsikring")], "id int, name string"), "name"
    )
    rows = [("1", ["solskin", "nordisk bank", "solskin"]), ("2", [])]
    df = spark.createDataFrame(rows, "request_id string, companies array<string>")
    got = {r.request_id: r.companies for r in requests.resolve_companies(df, companies).collect()}
    assert got == {"1": ["Solskin Forsikring", "Nordisk Bank", "Solskin Forsikring"], "2": []}


@pytest.fixture
def messages(spark):
    roles = ["system", "user", "plot", "assistant", "user", "plot"]
    rows = [(1, t, role, f"{role}{t}") for t, role in enumerate(roles)] + [(2, 0, "user", "hello")]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_last_messages_skip_plots_and_keep_order(messages):
    got = conversations.last_messages(messages)
    assert [(r.conv_id, r.position, r.text) for r in got.orderBy("conv_id", "position").collect()] == [
        (1, 1, "user1"), (1, 2, "assistant3"), (1, 3, "user4"), (2, 1, "hello")
    ]
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()


def test_last_by_role_and_latest(messages):
    maps = {r.conv_id: r.messages for r in conversations.role_map(messages).collect()}
    assert maps[1] == {"system": "system0", "user": "user4", "plot": "plot5", "assistant": "assistant3"}
    latest = {r.conv_id: r.question for r in conversations.latest_question(messages).collect()}
    assert latest == {1: "plot5", 2: "hello"}
    assert conversations.without_plots(messages).where(F.col("role") == "plot").count() == 0


@pytest.mark.parametrize("tree_bytes", [requests.TREE_BYTES, 0], ids=["held", "joined"])
def test_names_against_brute_force(spark, tree_bytes):
    draw = random.Random(4)
    words = ["bank", "of", "the", "nord", "a", "æ-x", "B", "sø"]
    names = {" ".join(draw.choices(words, k=draw.randrange(1, 5))) for _ in range(60)} | {"The  Bank", "??", ""}
    texts = [None, "", "the", "?!"] + [" ".join(draw.choices([*words, "the,", "BANK", "(of)"], k=draw.randrange(0, 30))) for _ in range(80)]
    companies = spark.createDataFrame(list(enumerate(sorted(names))), "id int, name string")
    asked = spark.createDataFrame(list(enumerate(texts)), "request_id long, question string")
    found = requests.extract_mentions(asked, companies, tree_bytes)
    got = {r.request_id: r.companies for r in found.collect()}

    def normal(text):
        return " " + " ".join(re.findall(r"\w+", (text or "").lower())) + " "

    assert got == {
        i: sorted(n for n in names if normal(n).strip() and normal(n) in normal(text)) for i, text in enumerate(texts)
    }
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert tree_bytes == 0 or "Exchange" not in plan and "Generate" not in plan
