"""URL filters: rules, aliases, awkward urls; equal to plain code and SQL."""

import random

import duckdb
import pytest
from pyspark.sql import types as T

from factloom.llm import oracles, url_filters
from factloom.llm.queries import QUERIES
from tests.compare import canonical, duck, of_frame, of_sql

SCHEMA = T.StructType([T.StructField("page_id", T.LongType()), *(T.StructField(c, T.StringType()) for c in ("url", "html", "host", "path", "rule", "node", "component", "verdict"))])


def pages(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * 6) for r in rows], SCHEMA)


def rules(spark, given=url_filters.RULES):
    return spark.createDataFrame(list(given), "host string, path string, verdict string")


def canon(target, form='<link rel="canonical" href="{}">'):
    return "<html><head>" + form.format(target) + "</head><body>canonical</body></html>"


def refresh(target):
    return f"<META HTTP-EQUIV='Refresh' content=\"0; URL={target}\">"


ROWS = [
    (0, "http://a.net/x", None),
    (1, "https://A.Example.NET/en/1?q=1#top", ""),
    (2, "http://example.com/de/9", "<p>"),
    (3, "http://sub.example.com/de", canon("//example.com/de/9")),
    (4, "https://other.edu/1", canon("http://EXAMPLE.com/de/9#f")),
    (5, "https://other.edu/2", canon("/1", "<LINK href='{}' rel=canonical>")),
    (6, "https://other.edu/d/3", refresh("../x?a=1&amp;b=2")),
    (7, "https://other.edu/d/../x?a=1&b=2", "refresh"),
    (8, "https://free.edu/a", canon("http://b.org/fr/1")),
    (9, "https://free.edu/b", refresh("https://free.edu/a")),
    (10, "http://free.edu/b", canon("http://z.net/9")),
    (11, None, canon("http://z.net/9")),
    (12, "no scheme", canon("http://z.net/9")),
    (13, "http://", canon("http://z.net/9")),
    (14, "http://z.net", canon("mailto:x@z.net")),
    (15, "http://notexample.com/de/1", canon("#here")),
    (16, "http://net/", canon("http://net/")),
    (16, "http://net/", canon("http://net/")),
    (None, "ftp://x.org/fr/1 a", '<link rel="shortcut canonical" href=" http://y.edu/é ">'),
    (18, "http://y.edu/é", "<meta charset=x>"),
    (19, "http://c.edu/" + "p" * 100_000, "<link " * 20_000),
]


def plain(rows, given=url_filters.RULES):
    """Aliases by repeated merging, edges given by hand below are those of ROWS."""
    sql = oracles.url_filters_sql()
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    return of_sql(con, sql)


def test_rules_and_aliases(spark):
    got = {r.page_id: (r.host, r.path[:20], r.rule, r.verdict) for r in url_filters.filter_urls(pages(spark, ROWS), rules(spark)).collect()}
    assert got[0] == ("a.net", "/x", "net/", "block")
    assert got[1] == ("a.example.net", "/en/1", "example.net/en/", "allow")
    assert got[2] == ("example.com", "/de/9", "example.com/de/", "block")
    assert got[3] == ("sub.example.com", "/de", None, "block")
    assert got[4][3] == "block" and got[5][3] == "block"
    assert got[6][3] == got[7][3] == "allow"
    # blocked by one alias and allowed by another: allow wins
    assert got[8][3] == got[9][3] == got[10][3] == "allow"
    assert got[11] == ("", "", None, "allow") and got[12] == ("", "", None, "allow") and got[13] == ("", "", None, "allow")
    assert got[14] == ("z.net", "", None, "allow") and got[15][2:] == (None, "allow") and got[16][3] == "block"
    assert got[None] == ("x.org", "/fr/1 a", "org/fr/", "allow") and got[18][2:] == (None, "allow") and got[19][3] == "allow"


def test_equals_sql_on_awkward_pages(spark):
    assert of_frame(url_filters.filter_urls(pages(spark, ROWS), rules(spark))) == plain(ROWS)


@pytest.mark.parametrize("seed", [1, 2])
def test_chains_stars_and_redirect_tables_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    hosts = ["a.net", "m.example.net", "example.com", "b.edu", "c.edu", "d.edu", "e.org"]
    urls = [f"http://{rng.choice(hosts)}/{rng.choice(['en', 'de', 'fr', 'xx'])}/{i}" for i in range(300)]
    edges = [(rng.choice(urls), rng.choice(urls)) for _ in range(60)] + [(urls[i], urls[i + 1]) for i in range(200, 240)] + [(urls[i], urls[250]) for i in range(251, 299)]
    rows = [(i, u, canon(v)) for i, (u, v) in enumerate(edges[:90])] + [(1000 + i, u, None) for i, u in enumerate(urls)]
    table = spark.createDataFrame(edges[90:] + [(None, urls[0]), ("x", urls[1])], "from_url string, to_url string")
    got = url_filters.filter_urls(pages(spark, rows), rules(spark), table).collect()
    group = {u: u for u in urls}

    def root(u):
        while group[u] != u:
            u = group[u]
        return u

    for u, v in edges:
        group[root(u)] = root(v)

    def rule(u):
        host, _, path = u.removeprefix("http://").partition("/")
        fit = [(len(h + p), h + p, v) for h, p, v in url_filters.RULES if (host == h or host.endswith("." + h)) and ("/" + path).startswith(p)]
        return max(fit)[1:] if fit else (None, None)

    said = {}
    for u in urls:
        said.setdefault(root(u), set()).add(rule(u)[1])
    want = {i: (rule(u)[0], rule(u)[1] or next((v for v in ("allow", "block") if v in said[root(u)]), "allow")) for i, u, _ in rows}
    assert {r.page_id: (r.rule, r.verdict) for r in got} == want and len(got) == len(rows)


def test_empty_table(spark):
    got = url_filters.filter_urls(pages(spark, []), rules(spark))
    assert got.columns == ["page_id", "host", "path", "rule", "verdict", "component"] and got.isEmpty()
    assert [tuple(r)[3:5] for r in url_filters.filter_urls(pages(spark, ROWS[:1]), rules(spark, [("x", "/", "block")])).collect()] == [(None, "allow")]


def test_query_equals_sql(spark, sf):
    got = QUERIES["op13_url_filters"](spark, sf)
    assert of_frame(got) == of_sql(duck(sf), oracles.ORACLES["op13_url_filters"])
    assert canonical(["n"], [(got.count(),)]) == canonical(["n"], [(spark.read.parquet(f"{sf}/pages.parquet").count(),)])
