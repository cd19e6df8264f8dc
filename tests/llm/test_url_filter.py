import datetime
import random

import duckdb
import pytest
from weftline.llm.queries import ORACLES, QUERIES
from weftline.llm.url_filter import filter_urls, intervals

D = datetime.date
ENTRY = "list string, value string, day date, listed boolean"
CAPTURE = "page_id long, url string, fetched date, Active string"


def test_intervals(spark):
    rows = [("a", "X.com/", D(2024, 1, 5), True), ("a", "x.com", D(2024, 1, 9), True), ("a", "x.com", D(2024, 2, 1), False), ("a", "x.com", D(2024, 3, 1), False),
            ("a", "x.com", D(2024, 4, 1), False), ("a", "x.com", D(2024, 4, 1), True), ("b", "x.com", D(2024, 1, 1), False), ("b", None, D(2024, 1, 1), True),
            (None, "x.com", D(2024, 1, 1), True), ("b", "y.com", None, True), ("b", "", D(2024, 1, 1), True), ("b", "z.com", D(2024, 1, 1), None)]
    got = sorted(map(tuple, intervals(spark.createDataFrame(rows, ENTRY)).collect()), key=str)
    assert got == [("a", "x.com", D(2024, 1, 5), D(2024, 2, 1)), ("a", "x.com", D(2024, 4, 1), None)]


def _brute(url, at, spans):
    if url is None or at is None or "://" not in url:
        return []
    rest = url.split("://", 1)[1]
    for mark in "?#":
        rest = rest.split(mark)[0]
    host, slash, path = rest.partition("/")
    host = host.rpartition("@")[2].split(":")[0].lower().rstrip(".")
    whole = (host + slash + path).rstrip("/")
    fits = lambda v: host and (host == v or host.endswith("." + v) or whole == v or whole.startswith(v + "/"))
    return sorted((name, v, a) for name, v, a, b in spans if fits(v) and a <= at and (b is None or at < b))


@pytest.mark.parametrize("limit", [100_000, 3, 0])
def test_equals_brute_force(spark, limit):
    rnd = random.Random(4)
    hosts = ["a.com", "b.a.com", "c.b.a.com", "aa.com", "d.org"]
    day = lambda: D(2024, 1, 1) + datetime.timedelta(rnd.randrange(60))
    entries = spark.createDataFrame([(rnd.choice("xy"), rnd.choice([*hosts, "a.com/p", "b.a.com/p/q", "com"]), day(), rnd.random() < 0.6) for _ in range(60)], ENTRY)
    urls = [f"http{rnd.choice(['', 's'])}://{rnd.choice(hosts)}{rnd.choice(['', ':80'])}{rnd.choice(['', '/', '/p', '/pp', '/p/q/', '/p/qq?x=/p', '#top'])}" for _ in range(150)]
    urls += [None, "", "no url", "http://", "HTTP://u:p@B.A.com./p", "https://a.com/" + "p/" * 50_000, urls[0], urls[0]]
    rows = [(i % 100, u, None if i == 7 else day(), "mine") for i, u in enumerate(urls)]
    spans = [tuple(r) for r in intervals(entries).collect()]
    out = filter_urls(spark.createDataFrame(rows, CAPTURE), entries, limit=limit)
    assert out.columns == ["page_id", "url", "fetched", "active", "blocked"]
    got = sorted(((r.page_id, r.url, r.fetched, [tuple(x) for x in r.active], r.blocked) for r in out.collect()), key=str)
    want = sorted(((i, u, at, hit := _brute(u, at, spans), bool(hit)) for i, u, at, _ in rows), key=str)
    assert got == want and any(r[4] for r in want)


def test_empty(spark):
    none, some = spark.createDataFrame([], ENTRY), spark.createDataFrame([(1, "http://a.com", D(2024, 1, 1), "")], CAPTURE)
    assert [r.blocked for r in filter_urls(some, none).collect()] == [False]
    assert filter_urls(some.limit(0), none).count() == 0


def test_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    df = QUERIES["op3_urls"](spark, sf)
    want = sorted(con.execute(f"SELECT {', '.join(df.columns)} FROM ({ORACLES['op3_urls']})").fetchall())
    assert sorted(map(tuple, df.collect())) == want and 0 < sum(r[3] for r in want) < len(want)
