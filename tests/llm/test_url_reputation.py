import duckdb
from pyspark.sql import functions as F
from samples import rows_of

from reviewmill.llm import url_reputation
from reviewmill.llm.oracles import ORACLES
from reviewmill.llm.queries import QUERIES

PAGES = "page_id bigint, url string"


def judge(spark, rows, outcomes=(), **options):
    pages = spark.createDataFrame(list(rows), PAGES).withColumns({"host": F.lit(1), "name": F.lit(2), "n": F.lit(3)})
    known = spark.createDataFrame(list(outcomes), "page_id bigint, good boolean")
    return url_reputation.judge_urls(pages, known, **options)


def test_parts_and_rules(spark):
    cases = {
        "https://WWW.Example.NET/en/x?q#f": ("www.example.net", "/en/x", "example.net/en/", "allow"),
        "http://a.net/x": ("a.net", "/x", "net/", "block"),
        "http://a.net": ("a.net", "", None, "allow"),
        "http://b.example.com/de/1": ("b.example.com", "/de/1", "example.com/de/", "block"),
        "http://bexample.com/de/1": ("bexample.com", "/de/1", None, "allow"),
        "http://x.org/fr/": ("x.org", "/fr/", "org/fr/", "allow"),
        "http://x.org/FR/": ("x.org", "/FR/", None, "allow"),
        "x://ÄB.org?a/b": ("Äb.org", "", None, "allow"),
        "http://h#a://b/c": ("h", "", None, "allow"),
        "no url": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        "://": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "http://" + "a." * 5000 + "net/" + "p" * 9000: ("a." * 5000 + "net", "/" + "p" * 9000, "net/", "block"),
    }
    found = judge(spark, [*enumerate(cases), (0, list(cases)[0]), (None, "http://a.net/")])
    by_id = {r.page_id: tuple(r)[1:5] for r in found.collect()}
    assert [by_id[i] for i in range(len(cases))] == list(cases.values())
    assert by_id[None] == ("a.net", "/", "net/", "block")
    assert found.count() == len(cases) + 2


def test_reputation_shrinks_to_domain_and_suffix(spark):
    rows, outcomes = [], []

    def add(host, good, bad):
        for i in range(max(1, good + bad)):
            rows.append((len(rows), f"http://{host}/{i}"))
            if i < good + bad:
                outcomes.append((len(rows) - 1, i < good))

    for i in range(20):
        add(f"good{i}.fine.com", 20, 1)
        add(f"bad{i}.foul.com", 1, 20)
    add("new.foul.com", 0, 0)
    add("new.fine.com", 0, 0)
    add("new.other.com", 0, 0)
    verdict = {r.host: r.verdict for r in judge(spark, rows, outcomes).collect()}
    assert verdict["good3.fine.com"] == "allow" and verdict["bad3.foul.com"] == "block"
    assert verdict["new.foul.com"] == "block"  # by its domain
    assert verdict["new.fine.com"] == verdict["new.other.com"] == "allow"


def test_suffix_and_domain(spark):
    cases = {
        "www.shop.co.uk": ("co.uk", "shop.co.uk"),
        "co.uk": ("co.uk", "co.uk"),
        "xco.uk": ("uk", "xco.uk"),
        "shop.example.com:8080": ("com", "example.com"),
        "jo:pw@a.shop.com.au:80": ("com.au", "shop.com.au"),
        "43.21.141.162:8000": ("43.21.141.162", "43.21.141.162"),
        "[2001:db8::1]:443": ("[2001:db8::1]", "[2001:db8::1]"),
        "x.y.city.kawasaki.jp": ("jp", "kawasaki.jp"),
        "localhost": ("localhost", "localhost"),
        "": ("", ""),
    }
    hosts = spark.createDataFrame([(h,) for h in cases], "host string")
    found = {r[0]: (r[1], r[2]) for r in hosts.select("host", *url_reputation.levels_of(F.col("host"))).collect()}
    assert found == cases
    own = url_reputation.levels_of(F.col("host"), ["uk", "city.kawasaki.jp"])
    found = {r[0]: (r[1], r[2]) for r in hosts.select("host", *own).collect()}
    assert found["x.y.city.kawasaki.jp"] == ("city.kawasaki.jp", "y.city.kawasaki.jp")
    assert found["www.shop.co.uk"] == ("uk", "co.uk")


def test_unrelated_sites_share_no_domain(spark):
    rows, outcomes = [], []
    for i in range(40):
        for n, host in enumerate((f"h{i}.foul.co.uk", f"h{i}.fine.co.uk", f"h{i}.bad.com")):
            for _ in range(20):
                rows.append((len(rows), f"http://{host}/"))
                outcomes.append((len(rows) - 1, n == 1))
    for host in ("new.foul.co.uk", "new.fine.co.uk", "new.other.co.uk", "new.bad.com:8080"):
        rows.append((len(rows), f"http://{host}/"))
    verdict = {r.host: r.verdict for r in judge(spark, rows, outcomes).collect()}
    assert verdict["new.foul.co.uk"] == verdict["new.bad.com:8080"] == "block"
    assert verdict["new.fine.co.uk"] == verdict["new.other.co.uk"] == "allow"


def test_one_bad_page_is_not_enough_where_hosts_are_alike(spark):
    rows = [(i, f"http://h{i % 40}.mixed.com/{i}") for i in range(801)]
    outcomes = [(i, i % 3 > 0) for i in range(800)] + [(800, False)]
    rows[800] = (800, "http://single.mixed.com/")
    assert {r.verdict for r in judge(spark, rows, outcomes).collect()} == {"allow"}


def test_empty_tables_and_useless_labels(spark):
    assert judge(spark, []).count() == 0
    rows = [(1, "http://a.com/"), (1, "http://a.com/"), (2, "http://b.com/")]
    found = judge(spark, rows, [(None, True), (2, None), (9, False)])
    assert {(r.host, r.n_labelled, r.verdict) for r in found.collect()} == {("a.com", 0, "allow"), ("b.com", 0, "allow")}
    assert len(rows_of(found)) == 3


def test_query_equals_its_sql_on_hosts_and_labels_of_all_kinds(spark, tmp_path):
    hosts = [f"{name}.{site}" for name in ("a", "www", "x.y") for site in ("one.co.uk", "two.co.uk", "one.com", "bad.com.au", "org.uk", "co.uk", "net")]
    hosts += ["one.com:8080", "user:pw@one.co.uk", "a@b@two.co.uk:", "10.0.0.1", "10.0.0.1:99", "[::1]:80", "1.2.3.4.5", "co.uk.", "", ".com", "x..co.uk", "ACME.Co.UK"]
    rows, labels = [], []
    for i, host in enumerate(hosts):
        for j in range(12):
            rows.append((100 * i + j, f"http://{host}/en/{100 * i + j}?q"))
            quality, toxic = ((1, 0), (0, 0), (0, None), (1, None), (None, 1), (None, 0), (None, None), (0, 1))[(i * j + j) % 8]
            if (i + j) % 5:
                labels.append((100 * i + j, 0 if "bad" in host or i % 7 == 3 else quality, toxic))
    rows += [(None, "http://one.com/en/3"), (7, "http://a.one.co.uk/en/7"), (8, None), (9, "no url"), (10, "http://other.co.uk/en/11")]
    spark.createDataFrame(rows, PAGES).write.parquet(str(tmp_path / "pages.parquet"))
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    found = QUERIES["op9_url_reputation"](spark, str(tmp_path))
    duck = duckdb.connect()
    for name in ("pages", "labels"):
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    result = duck.execute(ORACLES["op9_url_reputation"])
    columns = [c[0] for c in result.description]
    wanted = sorted(result.fetchall(), key=repr)
    assert rows_of(found.select(*columns)) == wanted
    at = columns.index("verdict")
    assert {row[at] for row in wanted} == {"allow", "block"} and len(wanted) == len(rows)


def test_main_path_has_no_python_workers(spark, sf_dir):
    plan = QUERIES["op9_url_reputation"](spark, sf_dir)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "InArrow"))
