"""Every registered query against its SQL twin on the smallest tables."""

import html
import math
import re
from datetime import datetime

import duckdb
import pytest

from pagemill.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return str(v) if isinstance(v, datetime) else v


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf_dir, duck, name):
    out = catalog.QUERIES[name](spark, sf_dir)
    names = sorted(out.columns)
    rows = sorted(repr([plain(r[c]) for c in names]) for r in out.collect())
    assert rows
    if name in catalog.ORACLES:
        got = duck.execute(catalog.ORACLES[name])
        columns = [d[0] for d in got.description]
        assert sorted(columns) == names
        at = [columns.index(c) for c in names]
        assert rows == sorted(repr([plain(r[k]) for k in at]) for r in got.fetchall())


def test_list_counters_of_a_long_order(spark, tmp_path):
    spark.createDataFrame([(1, 7), (2, 7)], "o_orderkey long, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    lines = [(1, k, k, 1) for k in range(1, 251)] + [(2, 1, 1, 1)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = catalog.QUERIES["list_counters_2level"](spark, str(tmp_path)).collect()
    want = [(1, "1.")] + [(1 + k, f"1.{k}") for k in range(1, 251)] + [(252, "2."), (253, "2.1")]
    assert sorted((x.ord, x.label) for x in got) == sorted(want)


def test_headings_with_character_references(spark):
    """Every page of sf0.01, by pattern and the standard library's decoding."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "html").collect()
    h1 = {p.page_id: re.search("(?s)<h1[^>]*>(.*?)</h1>", p.html) for p in pages}
    want = {k: " ".join(html.unescape(re.sub("<[^>]*>", "", m[1])).split()) for k, m in h1.items() if m}
    got = {x.page_id: x.heading for x in catalog.QUERIES["page_headings"](spark, "/root/testdata/sf0.01").collect()}
    assert any("&" in m[1] for m in h1.values() if m) and got == want


ODD_PAGES = [
    (1, "<title>a&amp;b&amp</title><h1>x&amp;y &lt;i&gt; &am</h1>"),
    (2, "<title>&amp;&amp</title><h1 class='t'>&copy; 1 &middot;\n &quot;z&quot;&amp</h1><h1>second</h1>"),
    (3, "<title></title><h1></h1><h1>later</h1>"),
    (4, "<p>neither</p>"),
    (5, None),
    (6, "<title>\u00a0a \t b \u2003</title><h1>\x1c\u00a0<b>bold</b> of <i>two</i> </h1>"),
    (6, "<title>same id</title><h1>same id &#39;</h1>"),
]


def odd_pages_agree(spark, path, name):
    spark.createDataFrame(ODD_PAGES, "page_id long, html string").coalesce(1).write.parquet(f"{path}/pages.parquet")
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW pages AS SELECT * FROM '{path}/pages.parquet/*.parquet'")
        want = c.execute(catalog.ORACLES[name]).fetchall()
    assert sorted(map(repr, map(tuple, catalog.QUERIES[name](spark, str(path)).collect()))) == sorted(map(repr, want))


def test_headings_of_odd_pages(spark, tmp_path):
    """References cut before their semicolon, empty and missing headings, null pages, an id twice."""
    odd_pages_agree(spark, tmp_path, "page_headings")


def test_titles_of_odd_pages(spark, tmp_path):
    odd_pages_agree(spark, tmp_path, "page_titles")
