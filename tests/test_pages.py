from datetime import datetime

from pyspark.sql import functions as F

from reviewmill.sources import pages

REVIEWS = (
    '{"props":{"pageProps":{"reviews":['
    '{"id":"r1","rating":5,"text":"Sød & rar","likes":2,"dates":{"publishedDate":"2024-01-02T03:04:05.000Z"}},'
    '{"id":"r2","rating":1,"text":"to\\nlinjer","likes":null,"dates":{"publishedDate":"yesterday"}}]}}}'
)


def page(script):
    return f"<html><head><script>var a=1;</script></head><body>{script}</body></html>"


def table(spark, htmls, url="https://x.example/review/shop.dk?page=2"):
    return spark.createDataFrame([(i, url, h) for i, h in enumerate(htmls)], "page_id long, url string, html string")


def test_reviews_come_from_the_first_json_element(spark):
    first = f'<script id="d" type="application/json" nonce>{REVIEWS}</script>'
    other = '<script type="application/json">{"props":{"pageProps":{"reviews":[{"id":"no"}]}}}</script>'
    companies = spark.createDataFrame([(4, "Shop", "shop.dk")], "id int, name string, homepage string")
    got = pages.extract_reviews(table(spark, [page(first + other)]), companies).orderBy("id").collect()
    assert [(r.id, r.company_id, r.company, r.rating, r.likes) for r in got] == [
        ("r1", 4, "Shop", 5, 2), ("r2", 4, "Shop", 1, None)
    ]
    assert got[0].timestamp == datetime(2024, 1, 2, 3, 4, 5) and got[1].timestamp is None
    assert got[0].content == "Sød & rar" and got[1].content == "to\nlinjer"


def test_pages_without_readable_json_give_no_rows(spark):
    broken = '<script type="application/json">{"props": oops</script>'
    empty = '<script type="application/json">{"props":{"pageProps":{"reviews":[]}}}</script>'
    assert pages.page_reviews(table(spark, [page(""), page(broken), page(empty), None])).count() == 0


def test_long_json_is_read_whole(spark):
    text = "æ" * 200_000
    json = '{"props":{"pageProps":{"reviews":[{"id":"big","text":"%s"}]}}}' % text
    got = pages.page_reviews(table(spark, [page(f"<script type='application/json'>{json}</script>")]))
    assert len(got.first().content) == 200_000


def test_next_page_link(spark):
    htmls = [
        '<a href="/x">x</a><a class="b" name="pagination-button-next" href="/review/a?page=2&amp;s=1">n</a>',
        '<a name="pagination-button-next">n</a><a href="/y">y</a>',
        '<a href="/y">y</a>',
        "<a href='/review/b?page=3' name='pagination-button-next'>",
    ]
    df = table(spark, htmls).select("page_id", pages.next_page_link(F.col("html"), "https://h").alias("u"))
    assert [r.u for r in df.orderBy("page_id").collect()] == [
        "https://h/review/a?page=2&s=1", None, None, "https://h/review/b?page=3"
    ]


def test_pages_are_capped_and_end_at_the_first_empty_one(spark):
    rows = [("a", n, n != 4) for n in range(1, 8)] + [("b", n, True) for n in range(1, 8)] + [("c", 1, False)]
    df = spark.createDataFrame(rows, "company string, page_no int, has_reviews boolean")
    got = pages.cap_pages(df, max_pages=5)
    assert sorted((r.company, r.page_no) for r in got.collect()) == [
        ("a", 1), ("a", 2), ("a", 3), ("b", 1), ("b", 2), ("b", 3), ("b", 4), ("b", 5)
    ]
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()


def test_page_facts(spark):
    full = page(f'<script type="application/json">{REVIEWS}</script>')
    empty = page('<script type="application/json">{"props":{"pageProps":{"reviews":[]}}}</script>')
    rows = [("https://h/review/a.dk", full), ("https://h/review/a.dk?x=1&page=12", empty), ("https://h/", "")]
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], "page_id long, url string, html string")
    got = pages.with_page_facts(df).orderBy("page_id").select("homepage", "page_no", "has_reviews").collect()
    assert [tuple(r) for r in got] == [("a.dk", 1, True), ("a.dk", 12, False), ("", 1, False)]
