from __future__ import annotations

from compare import connect, difference
from thinjoin.llm.queries import ORACLES, QUERIES
from thinjoin.llm.url_filter import judge_urls


def page(i, url, html=""):
    return (i, url, html)


CANON = '<html><link rel="canonical" href="{}"></html>'
PAGES = [
    page(1, "https://a.shop.net/x?b=1#top", CANON.format("http://mirror.com/de/1")),
    page(2, "http://b.net/1", '<meta http-equiv="refresh" content="0; url=https://A.shop.net/x?b=1">'),
    page(3, "http://c.net", CANON.format("//b.net/1")),
    page(4, "http://d.net/x/y", CANON.format("z")),
    page(5, "http://d.net/x/z"),
    page(6, "http://news.org/", CANON.format("http://mirror.com/de/2")),
    page(7, "http://e.net/", CANON.format("http://news.org/")),
    page(8, "HTTP://WWW.Example.ORG/es/1"),
    page(9, "http://example.org/en/12"),
    page(10, "http://notexample.org/es/"),
    page(11, None, CANON.format("http://mirror.com/de/1")),
    page(12, "no url", None),
    page(12, "no url", None),
    page(13, "http://x.com/fr/"),
    page(14, "http://mirror.com/de/1"),
    page(15, "", ""),
    page(16, "http://f.net/", CANON.format("http://f.net/")),
    page(17, "http://good.net/a", CANON.format("/login?next=http://shop.com/de/x")),
    page(18, "http://h.net/", CANON.format("http://k.net/?a=1&amp;b=2")),
    page(19, "http://k.net/?a=1&b=2", CANON.format("http://mirror.com/de/9")),
    page(None, "http://b.net/1"),
]


def verdicts(spark, rows):
    found = judge_urls(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()
    return {(r["page_id"]): (r["host"], r["path"], r["rule"], r["verdict"], r["reason"]) for r in found}, len(found)


def test_rules_and_classes(spark):
    found, n = verdicts(spark, PAGES)
    assert n == len(PAGES)
    assert found[1] == ("a.shop.net", "/x", None, "block", "class")
    assert found[2][3:] == found[3][3:] == found[None][3:] == ("block", "class")
    assert found[3][:2] == ("c.net", "")
    assert found[4][3:] == found[5][3:] == ("allow", "none")
    assert found[6][2:] == ("org/", "allow", "rule")
    assert found[7][3:] == ("allow", "none")  # its class holds an explicit allow
    assert found[8] == ("www.example.org", "/es/1", "example.org/es/", "block", "rule")
    assert found[9][2:4] == ("example.org/en/1", "block")
    assert found[10][2:4] == ("org/", "allow")
    assert found[11] == found[12] == found[15] == ("", "", None, "allow", "none")
    assert found[13][2:4] == ("com/fr/", "allow")
    assert found[14][2:4] == ("com/de/", "block")
    assert found[17][3:] == ("allow", "none")  # a url in the query is not where the link leads
    assert found[18][3:] == found[19][3:] == ("block", "class")


def test_long_chain_and_hub(spark):
    rows = [page(i, f"http://n{i}.net/", CANON.format(f"http://n{i + 1}.net/")) for i in range(40)]
    rows += [page(1000 + i, f"http://m{i}.net/", CANON.format("http://n40.net/")) for i in range(300)]
    rows.append(page(40, "http://n40.net/", CANON.format("http://z.com/de/")))
    found, _ = verdicts(spark, rows)
    assert {v[3] for v in found.values()} == {"block"}


def test_empty_table_and_extra_columns(spark):
    assert verdicts(spark, [])[1] == 0
    rows = spark.createDataFrame([(1, "http://a.com/de/", None, "x", 2)], "page_id int, url string, html string, verdict string, node int")
    assert judge_urls(rows).collect()[0]["verdict"] == "block"


def test_edges_from_elsewhere(spark):
    pages = spark.createDataFrame([page(1, "http://a.net/")], "page_id int, url string, html string")
    edges = spark.createDataFrame([("http://a.net/", "http://b.com/de/"), ("http://a.net/", None)], "source string, target string")
    assert judge_urls(pages, edges=edges).collect()[0]["verdict"] == "block"


def test_sql(spark, folder):
    connection = connect(folder)
    assert difference(QUERIES["op1_url_filter"](spark, folder), connection, ORACLES["op1_url_filter"]) is None
    import duckdb
    import pyarrow as pa

    other = duckdb.connect()
    columns = list(zip(*PAGES, strict=True))
    other.register("pages", pa.table({"page_id": pa.array(columns[0]), "url": pa.array(columns[1]), "html": pa.array(columns[2])}))
    pages = spark.createDataFrame(PAGES, "page_id bigint, url string, html string")
    assert difference(judge_urls(pages), other, ORACLES["op1_url_filter"]) is None
