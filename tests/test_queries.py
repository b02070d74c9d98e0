"""Every registered query against its SQL in DuckDB on the smallest tables."""

import os
import re
from pathlib import Path

import pytest

duckdb = pytest.importorskip("duckdb")
DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))

from webharvest import plans  # noqa: E402
from webharvest.operators import extract, rules  # noqa: E402


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def _text(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.skipif(not DATA.exists(), reason="no tables")
@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, db, name):
    df = plans.queries()[name](spark, str(DATA))
    rows = [tuple(r) for r in df.collect()]
    if name not in plans.oracle_sql():
        assert df.columns
        return
    cursor = db.execute(plans.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    want = cursor.fetchall()
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    got = sorted(tuple(_text(r[df.columns.index(c)]) for c in order) for r in rows)
    assert got == sorted(tuple(_text(r[names.index(c)]) for c in order) for r in want)


def both(spark, name, folder):
    """Sorted rows of a query and of its SQL on a folder of tables."""
    con = duckdb.connect()
    for f in folder.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}/*.parquet'")
    df = plans.queries()[name](spark, str(folder))
    cursor = con.execute(plans.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    want = sorted(str(dict(sorted(zip(names, r)))) for r in cursor.fetchall())
    return sorted(str(dict(sorted(r.asDict().items()))) for r in df.collect()), want


@pytest.fixture(scope="module")
def cut_references(spark, tmp_path_factory):
    """Pages whose texts hold character references without a semicolon, one cut too short to be one, and the page's own domain."""
    texts = ("Said by&amp;&amp;&amp", "A &quot&amp;lt; b&am", "x&ampy &lt 3 &gt", "By a.b@mail.Example.com too", "- example.com on example.com |")
    html = (
        '<html lang="en"><head><title>{0}</title></head><body><nav><ul><li><a href="/a">one</a></li><li><a href="/b">{0}</a></li></ul></nav>'
        "<article><h1>{0}</h1><p>{0} of the and</p><p>of the and to {0}</p></article></body></html>"
    )
    rows = [(k, f"http://www.example.com/en/{k}", html.format(t)) for k, t in enumerate(texts * 7)]  # every text in each layout and with each title
    folder = tmp_path_factory.mktemp("references")
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(folder / "pages.parquet"))
    return folder


def test_title_with_cut_references(spark, cut_references):
    got, want = both(spark, "h9_title", cut_references)
    assert got == want and any("'Said by&&&'" in x for x in got) and any("'By a.b@mail. too'" in x for x in got)


def test_items_with_cut_references(spark, cut_references):
    got, want = both(spark, "j12_item_parser", cut_references)
    assert got == want and any("Said by&&& of the and" in x for x in got) and any("'title': 'By a.b@mail. too'" in x for x in got)


def test_rule_values_with_cut_references(spark, cut_references):
    got, want = both(spark, "j3_xpath_rule", cut_references)
    assert got == want and any("'heading': 'Said by&&&'" in x for x in got)


@pytest.fixture(scope="module")
def blanks(spark, tmp_path_factory):
    """Pages with a blank heading, with a title or without one, with an article without text, and with a blank link."""
    html = (
        '<html lang="en"><head><title>{1}</title></head><body><nav><ul><li><a href="/a">one</a></li><li><a href="/b">{0}</a></li></ul></nav>'
        "<article><h1>{0}</h1><p>{2}</p></article></body></html>"
    )
    texts = (("", "", "of the and"), (" \n", "Title of", "of the and"), ("Head", "Title", ""), ("", "", " "))
    rows = [(k, f"http://www.example.com/en/{k}", html.format(*texts[k % 4])) for k in range(84)]  # each in every layout and with each title
    folder = tmp_path_factory.mktemp("blanks")
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(folder / "pages.parquet"))
    return folder


def test_items_of_blank_pages(spark, blanks):
    got, want = both(spark, "j12_item_parser", blanks)
    assert got == want and any("'title': None" in x for x in got) and any("'title': 'Title of'" in x for x in got) and any("'content': ''" in x for x in got)
    got, want = both(spark, "h9_title", blanks)
    assert got == want and any("'title': None" in x for x in got) and any("'title': 'Title of'" in x for x in got)


def test_rule_values_of_blank_links(spark, blanks):
    got, want = both(spark, "j3_xpath_rule", blanks)
    assert got == want and sum("'second': None" in x for x in got) == 63 and any("'second': 'Head'" in x for x in got)


def python_steps(df):
    """The names of the Python functions of a plan, one for each step."""
    return sorted(re.findall(r"ArrowEvalPython \[(\w+)\(", df._jdf.queryExecution().optimizedPlan().toString()))


def test_subdomain_sites_read_links_once(spark):
    """A page is parsed once for its own subdomain and for the others; rows of equal links stay, with their titles or none."""
    assert python_steps(plans.queries()["h4_subdomain_sites"](spark, str(DATA))) == ["_first_links", "parsed"]
    at = "http://www.e.com/p"
    links = [
        (1, at, 1, "http://www.e.com/a", "A"), (1, at, 2, "http://www.e.com/a", None), (1, at, 3, "http://www.e.com/a", "A"),
        (1, at, 4, "http://b.e.com/x", "X"), (1, at, 5, "http://b.e.com/", "B"), (1, at, 6, "http://c.e.com/1", None),
        (1, at, 7, "http://other.org/", "O"), (1, at, 8, None, "N"), (None, at, 1, "http://www.e.com/a", "A"), (2, None, 1, "http://www.e.com/a", "A"),
    ]
    rows = spark.createDataFrame(links, "page_id long, page_url string, pos int, link string, title string")
    got = sorted(((r.page_id, r.link, r.title) for r in extract.subdomain_sites(rows).collect()), key=str)
    assert got == sorted(
        [(1, "http://www.e.com/a", "A"), (1, "http://www.e.com/a", None), (1, "http://www.e.com/a", "A"), (1, "http://b.e.com", "B"),
         (1, "http://c.e.com", None), (None, "http://www.e.com/a", "A")], key=str
    )


def test_lists_are_resolved_once(spark):
    """Links are resolved in one step; unusable ones leave their places free, repeats stay, pages without html or address have no rows."""
    assert python_steps(plans.queries()["j13_list_parser"](spark, str(DATA))) == ["_all_links", "parsed"]
    html = '<a href=" a ">A</a><a href="/">no</a><a href="//[x">no</a><a href=" ">no</a><a>no</a><a href="/b">B</a><a href="a"></a>'
    rows = spark.createDataFrame([(1, "http://e.com/d/p", html), (2, None, html), (3, "http://e.com/", None), (4, "http://e.com/", "")], "page_id long, url string, html string")
    df = rules.parse_lists(rows)
    assert df.columns == ["page_id", "pos", "title", "url"] and df.schema["pos"].dataType.simpleString() == "int"
    got = sorted(tuple(r) for r in df.collect())
    assert got == [(1, 0, "A", "http://e.com/d/a"), (1, 3, "B", "http://e.com/b"), (1, 4, "", "http://e.com/d/a")]


def test_bloom_filter_with_colliding_keys(spark, tmp_path):
    """A key whose bits are all set by another one is not new; also an empty key, a null and characters of several bytes."""
    from webharvest.operators.dedupe import BLOOM_BITS, BLOOM_SEEDS

    def bits(key):
        out = []
        for seed in range(BLOOM_SEEDS):
            h = 0
            for c in key:
                h = (h * (1 + seed) + ord(c)) % BLOOM_BITS
            out.append(h)
        return out

    probe = "k"  # a single character has one bit, its code point, which other keys of that sum can set
    keys = {0: "5", 1: probe, 2: "\x01j", 3: "", 4: "ä中😀", 5: "ä中😀", 7: "new", 9: None, 10: "é", 11: "é"}
    # the bits of "k": 107 for every seed; "\x01j" sets 107 by seed 0
    assert set(bits(probe)) == {107} and bits(keys[2])[0] == 107
    rows = [(k, u, "") for k, u in keys.items()]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got, want = both(spark, "d2_bloom_filter", tmp_path)
    assert got == want and "{'is_new': False, 'unid': 'k'}" in got and "{'is_new': True, 'unid': 'new'}" in got and len(got) == 7
