import random

import pytest

from granary.llm.queries import RULES, oracle_sql, queries
from granary.llm.url_filter import components, normal, parse_rule, url_filter

SCHEMA = "page_id long, url string, html string, node string, root string"


def page(i, url, html=""):
    return (i, url, html, "n", "r")


def canonical(url):
    return f'<html><head><link href="{url}" rel="canonical"></head></html>'


def test_hosts_paths_and_longest_rule(spark):
    pages = [page(0, "http://A.Example.com/en/7?x"), page(1, "https://x.com/en/70"), page(2, "https://example.net/de/81#top"), page(3, "https://q.net/de/8"), page(4, None), page(5, "no scheme/en/"), page(6, "http://org/es/"), page(7, "http://borg/es/"), page(8, "http://h"), page(9, "")]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter(spark.createDataFrame(pages, SCHEMA), RULES).collect()}
    assert got[0] == ("a.example.com", "/en/7", "example.com/en/7", "allow")
    assert got[1] == ("x.com", "/en/70", "com/en/", "block")
    assert got[2] == ("example.net", "/de/81", "example.net/de/8", "block")
    assert got[3] == ("q.net", "/de/8", "net/de/", "allow")
    assert got[4] == got[5] == got[9] == ("", "", None, "allow")
    assert got[6][2:] == ("org/es/", "block") and got[7][2:] == (None, "allow") and got[8] == ("h", "", None, "allow")


def test_decisions_spread_with_allow_first(spark):
    pages = [
        page(1, "http://bad.com/en/1"),
        page(2, "http://alias.info/a", canonical("http://bad.com/en/1")),
        page(3, "http://alias.info/b", '<META http-equiv="refresh" content="0; url=/a">'),
        page(4, "http://mixed.info/", canonical("http://www.example.com/en/7")),
        page(5, "http://other.info/", canonical("http://mixed.info/#part")),
        page(6, "http://evil.com/en/9", canonical("http://mixed.info/")),
        page(7, "http://free.info/", None),
        page(7, "http://free.info/", None),
    ]
    out = url_filter(spark.createDataFrame(pages, SCHEMA), RULES).collect()
    got = {r.page_id: (r.verdict, r.spread) for r in out}
    assert len(out) == 8
    assert got == {1: ("block", False), 2: ("block", True), 3: ("block", True), 4: ("allow", True), 5: ("allow", True), 6: ("block", False), 7: ("allow", False)}
    extra = spark.createDataFrame([("http://free.info/", "http://bad.com/en/1"), (None, "x")], "src string, dst string")
    assert {r.verdict for r in url_filter(spark.createDataFrame(pages, SCHEMA), RULES, extra).filter("page_id = 7").collect()} == {"block"}
    assert url_filter(spark.createDataFrame(pages, SCHEMA).limit(0), RULES).count() == 0


@pytest.mark.parametrize(
    ("alias", "html"),
    [
        ("http://alias.info/case", canonical("HTTP://Bad.COM/en/1")),
        ("http://bad.com/x/dots", canonical("../en/./1")),
        ("http://alias.info/base", '<base href="http://bad.com/en/">' + canonical("1")),
        ("http://alias.info", canonical("http://bad.com/en/1")),
    ],
)
def test_decisions_reach_aliases_written_otherwise(spark, alias, html):
    # the last: a page that another names with a path of /
    pages = [page(1, "http://bad.com/en/1"), page(2, alias, html), page(3, "http://third.info/a", canonical("http://ALIAS.info/"))]
    got = {r.page_id: (r.verdict, r.spread) for r in url_filter(spark.createDataFrame(pages, SCHEMA), RULES).collect()}
    assert got[1] == ("block", False) and got[2] == ("block", True)
    assert got[3] == (("block", True) if alias == "http://alias.info" else ("allow", False))


def test_normal_form(spark):
    want = {"HTTP://H.com": "http://h.com/", "http://h?q": "http://h/?q", "http://h/a/../../b/.#f": "http://h/b/", "http://h/..": "http://h/", "http://h/A/%2e?x=/../": "http://h/A/%2e?x=/../", "no scheme/../a": "no scheme/../a", "": ""}
    rows = spark.createDataFrame([(u,) for u in want], "u string")
    assert {r.u: r.n for r in rows.select("u", normal(rows.u).alias("n")).collect()} == want


def test_components_match_union_find(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(300, i) for i in range(301, 360)] + [(i, i + 1) for i in range(400, 430)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for e in edges if e[0] != e[1] for x in e}
    assert got == {x: find(x) for x in linked}


def test_bad_rules():
    with pytest.raises(ValueError):
        parse_rule("deny com/")


@pytest.mark.parametrize(
    ("alias", "html", "blocked"),
    [
        ("http://bad.com/x?a=1", canonical("?b=2"), False),
        ("http://alias.info/q", '<link rel="up canonical" href="http://bad.com/en/1">', True),
        ("http://alias.info/q", "<link rel=canonical href=http://bad.com/en/1>", True),
        ("http://alias.info/q", '<link rel="noncanonical" href="http://bad.com/en/1">', False),
        ("http://alias.info/q", "<!-- " + canonical("http://bad.com/en/1") + " -->", False),
    ],
)
def test_links_that_count(spark, alias, html, blocked):
    got = {r.page_id: r.verdict for r in url_filter(spark.createDataFrame([page(1, "http://bad.com/en/1"), page(2, alias, html)], SCHEMA), RULES).collect()}
    assert got == {1: "block", 2: "block" if blocked else "allow"}


def test_sql_walks_the_same_edges(spark, tmp_path):
    """The registered SQL against the query on pages full of redirects: chains, rings, hubs, mixed decisions."""
    duckdb = pytest.importorskip("duckdb")
    rng = random.Random(8)
    hosts = ["bad.com", "www.example.com", "q.net", "example.net", "org", "free.info", "Alias.INFO"]
    url = lambda: f"{rng.choice(['http', 'HTTPS'])}://{rng.choice(hosts)}{rng.choice(['/en/', '/de/', '/es/', '/x/'])}{rng.randrange(12)}{rng.choice(['', '?p', '#f'])}"
    link = lambda: rng.choice([url(), url(), f"/en/{rng.randrange(9)}", f"{rng.randrange(9)}", "?z", "//free.info/x/1"])
    html = lambda: rng.choice([None, "", canonical(link()), f"<META content='0;URL={link()}' http-equiv='refresh'>", f"<base href='{url()}'>" + canonical(link()), f"<!--{canonical(url())}-->"])
    pages = [(i, url(), html()) for i in range(250)] + [(300, None, canonical("http://bad.com/en/1")), (301, "", None), (302, "http://free.info", canonical("http://bad.com/en/1"))]
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    got = queries()["op1_url_filter"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    want = con.execute(oracle_sql()["op1_url_filter"]).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
    spread = url_filter(spark.createDataFrame(pages, "page_id long, url string, html string"), RULES).filter("spread").groupBy("verdict").count().collect()
    assert {r.verdict for r in spread} == {"allow", "block"}
