"""Hand-derived cases of functions and operators."""

from urllib.parse import urljoin as std_join

import pytest
from pyspark.sql import functions as F

from webharvest.functions import nodes, patterns, selectors, times, urls
from webharvest.operators import articles as A
from webharvest.operators import dedupe as D
from webharvest.operators import extract as H
from webharvest.operators import frontier as P
from webharvest.operators import query as Q
from webharvest.operators import rules as J
from webharvest.streaming import streams as ST

NOW = 820454400


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_urls(spark):
    def u(text):
        return F.lit(text).cast("string")

    assert one(spark, urls.domain(u("http://a.b.example.co.uk/x"))) == "example.co.uk"
    assert one(spark, urls.subdomain(u("http://a.b.example.co.uk:80/x"))) == "a.b"
    assert one(spark, urls.domain(u("http://10.0.0.1/x"))) is None
    assert one(spark, urls.domain(u(None))) is None
    assert one(spark, urls.filter_query(u("http://e.com/a?b=2&a=1&c=&b=3#f"), exclude=["x"])) == "http://e.com/a?a=1&b=2#f"
    assert one(spark, urls.filter_query(u("http://e.com/a?b=2#f"))) == "http://e.com/a#f"
    once = one(spark, urls.filter_query(u("http://e.com/?z=%41+b&a=~*"), exclude=["q"]))
    assert once == "http://e.com/?a=~%2A&z=A+b" and one(spark, urls.filter_query(u(once), exclude=["q"])) == once
    assert one(spark, urls.resolve(u("javascript:x"), u("http://e.com/"))) is None
    for link in ("../b", "?q=1", "//h/x", "#f", "http://z/"):
        assert one(spark, urls.urljoin(u("http://e.com/d/a"), u(link))) == std_join("http://e.com/d/a", link)


def test_patterns():
    assert patterns.pcre_to_regex("/a.b/is") == "(?is)a.b"
    assert patterns.rule_to_pattern("a[*]b[x]c")[0] == "a.*?b(.+?)c"
    with pytest.raises(ValueError):
        patterns.rule_to_pattern("[r=x](a[/r]")


def test_dates(spark):
    cases = {
        "1996-1-1 00:00": NOW, "刚刚": NOW - 3, "15分钟前": NOW - 900, "昨天 10:00": NOW - 86400 + 36000, "2天前": NOW - 2 * 86400, "": None,
        "nonsense": None, "1月2日": NOW + 86400, "12-3-4": 1078272000 + 86400 * 0 + 254188800, "820454400": NOW, "Jan 01 1996": NOW,
        "1996-01-01T08:00:00+08:00": NOW
    }
    for text, want in cases.items():
        got = one(spark, times.parse_date(F.lit(text), NOW))
        if text == "12-3-4":
            want = one(spark, F.unix_timestamp(F.lit("2012-03-04 00:00:00")))
        assert got == want, text


def test_html_repair():
    got = nodes.parse("<ul><li>a<li>b</ul><p>x<p>y<script>var t='</p>';</script><b>z")
    assert [n["tag"] for n in got] == ["ul", "li", "li", "p", "p", "script", "b"]
    assert [n["text"] for n in got if n["tag"] in ("li", "p")] == ["a", "b", "x", "yz"]
    assert nodes.parse(None) == [] and nodes.parse("") == []
    odd = nodes.parse("<A HREF='x>y' title=\"q &amp; r\" title=2 hidden>t &lt; u</a> 3 < 4<title>a<b</title><!-- <p> --><i>z<!-- open <b>")
    assert [(n["tag"], n["text"]) for n in odd] == [("a", "t < u"), ("title", "a<b"), ("i", "z")]
    assert odd[0]["attrs"] == {"href": "x>y", "title": "q & r", "hidden": ""}
    assert len(nodes.parse('<a b="' * 20_000)) == 0 and len(nodes.parse('<a b=">" ' * 20_000)) == 0
    with pytest.raises(ValueError):
        selectors.compile_css("a:hover")
    with pytest.raises(ValueError):
        selectors.compile_xpath("//a[count(b)<3]")


PAGE = """<html><head><title>River rises - Example</title><meta property="og:title" content="River rises - Example">
<meta property="og:site_name" content="Example"><meta property="og:type" content="article"><meta property="article:section" content="News">
<script type="application/ld+json">{"@context":"http://schema.org","@type":"ReportageNewsArticle","headline":"Other"}</script></head>
<body><a href="/list">All</a><a href="/list">Again</a><a href="http://blog.example.com/">Blog</a><a href="http://other.org/x">Out</a><a href="#top">Top</a>
<article><p>The river is high and the town is wet.</p><ul><li>one thing</li></ul><p><a href="/a">only</a> <a href="/b">links</a></p></article></body></html>"""


def test_page_extraction(spark):
    url = "http://www.example.com/news/1.html"
    pages = spark.createDataFrame(
        [(1, url, PAGE), (2, url, None)], "page_id long, url string, html string"
    ).withColumn("nodes", nodes.html_nodes("html"))
    n, at = F.col("nodes"), F.col("url")
    top = F.get(F.filter(n, lambda x: x["tag"] == "article"), 0)["order"]
    got, empty = pages.select(
        H.raw_title(n, at).alias("raw"), H.clean_title(H.raw_title(n, at), n, at).alias("title"), H.open_graph(n).alias("og"), F.get_json_object(H.json_ld(n), "$.headline").alias("ld"),
        H.article_text(n, top).alias("content"), H.content_links(n, top).alias("links"), "page_id",
    ).orderBy("page_id").collect()
    assert (got.raw, got.title, got.ld) == ("River rises - Example", "River rises", "Other")
    assert got.og == {"title": "River rises - Example", "site_name": "Example", "type": "article", "article:section": "News"}
    assert got.content == "The river is high and the town is wet.\n\n• one thing" and got.links == ["/a", "/b"]
    assert (empty.raw, empty.ld) == (None, None)
    links = H.page_links(pages)
    same_host, same_domain = H.link_class(F.col("link"), F.col("page_url"))
    rows = {r.link: (r.title, r.h, r.d) for r in links.select("link", "title", same_host.alias("h"), same_domain.alias("d")).collect()}
    home = "http://www.example.com"
    assert rows == {
        home + "/list": ("All", True, True), home + "/a": ("only", True, True), home + "/b": ("links", True, True),
        "http://blog.example.com/": ("Blog", False, True), "http://other.org/x": ("Out", False, False)
    }
    assert {
        (r.link, r.title) for r in H.subdomain_sites(links).where("not link like '%www%'").collect()
    } == {("http://blog.example.com", "Blog")}


def test_authors_and_list_links(spark):
    marked = '<b itemprop="author">Jo Lindt</b><b itemprop="author">Al</b><a href="javascript:go()">J</a><a href="/x#y">H</a><a href="/plain">P</a>'
    rows = [(1, marked), (2, "<p> 来源：Daily</p>"), (3, "<p>none</p>"), (4, None)]
    pages = spark.createDataFrame(rows, "page_id long, html string").withColumn("nodes", nodes.html_nodes("html"))
    n, at = F.col("nodes"), F.lit("http://www.example.com/")
    got = pages.select(
        "page_id", H.item_author(H.authors(n, F.col("html"), at)).alias("author"),
        F.transform(H.list_links(n, at), lambda x: x["url"]).alias("links")
    ).orderBy("page_id").collect()
    assert [r.author for r in got] == ["Al", "Daily", None, None]
    assert [r.links for r in got] == [["/plain"], [], [], []]


def test_json_rules(spark):
    text = '{"key1":["value11","value12","value13"],"key2":[{"key21":"value211","key22":"value212"},{"key21":"value221","key22":"value222"}],"key3":[{"key31":[{"key311":"value311","key312":"value312"}]}]}'
    df = spark.createDataFrame([(text,), ("cb(" + text + ")",), (None,)], "t string")
    assert [
        tuple(r) for r in J.json_rule(df, "t", {"filter": "$.key2", "item": {"a": "$.key21", "b": "$.key22"}}).select("a", "b").collect()
    ] == [("value211", "value212"), ("value221", "value222")] * 2
    assert [r["value"] for r in J.json_rule(df, "t", {"filter": "key1.-1"}).collect()] == ["value13"] * 2


def test_where_keeps_nulls(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "k int, v string")
    assert [r.k for r in df.where(Q.where(("v", "<>", "a"))).orderBy("k").collect()] == [2, 3]
    assert [r.k for r in df.where(Q.where({"v": ["a", None]})).orderBy("k").collect()] == [1, 2]
    assert df.where(Q.where([])).count() == 3


def test_route_slices_cover_tasks(spark):
    tasks = spark.range(1, 1001).select(
        F.col("id").alias("uuid"), F.lit("m").alias("mode"), F.lit("6").alias("frequency"), F.lit(1).alias("status"),
        F.lit(0).cast("long").alias("expire"), F.lit(0).cast("long").alias("plantime")
    )
    slices = spark.createDataFrame(
        [("m", "6", o, 100) for o in range(0, 1000, 100)], "mode string, frequency string, offset long, count long"
    )
    got = [r.uuid for r in P.batch_slices(tasks, slices, NOW).collect()]
    assert sorted(got) == list(range(1, 1001))


def test_first_seen_and_upsert(spark):
    rows = spark.createDataFrame([("a", 3), ("a", 1), ("b", 2)], "unid string, ctime long")
    out = {
        (r.unid, r.ctime): (r.inserted, r.seen_ctime) for r in D.insert_if_absent(
            rows, spark.createDataFrame([("b", 0)], "unid string, ctime long")
        ).collect()
    }
    assert out == {("a", 1): (True, 1), ("a", 3): (False, 1), ("b", 2): (False, 0)}
    pages = spark.createDataFrame([(1, 2, "y"), (1, 1, "x"), (2, 1, None)], "rid int, page int, content string")
    assert {r.rid: r.content for r in A.join_pages(pages).collect()} == {1: "x\r\n\r\ny", 2: ""}


def test_first_seen_of_a_hot_key(spark):
    rows = spark.range(4000).select(
        F.when(F.col("id") % 4 == 0, F.concat(F.lit("k"), F.col("id"))).otherwise("hot").alias("unid"), (4000 - F.col("id")).alias("ctime"),
        F.create_map(F.lit("a"), F.lit(1)).alias("m")
    )
    twins = rows.unionByName(rows)
    out = D.insert_if_absent(twins, None)
    assert out.columns == [*rows.columns, "inserted", "seen_ctime"] and out.count() == 8000
    assert out.where("inserted").count() == 1001
    hot = out.where("unid = 'hot'").agg(
        F.count_if("inserted").alias("n"), F.min("seen_ctime").alias("a"), F.max("seen_ctime").alias("b")
    ).first()
    assert tuple(hot) == (1, 1, 1)
    nulls = D.insert_if_absent(spark.createDataFrame([(None, 1), (None, 2)], "unid string, ctime long"), None)
    assert sorted((r.ctime, r.inserted) for r in nulls.collect()) == [(1, True), (2, False)]


def test_ids_by_a_string_key(spark):
    rows = spark.range(500).select(F.md5(F.col("id").cast("string")).alias("k"))
    got = [r.k for r in Q.assign_ids(rows, ["k"], rows=60).orderBy("uuid").collect()]
    assert got == sorted(got) and Q.assign_ids(rows, ["k"], rows=60).agg(
        F.min("uuid"), F.max("uuid"), F.count_distinct("uuid")
    ).first()[:] == (1, 500, 500)


def test_slices_over_many_ranges(spark):
    tasks = spark.range(1, 1001).select(
        F.col("id").alias("uuid"), F.lit("m").alias("mode"), F.lit("6").alias("frequency"), F.lit(1).alias("status"),
        F.lit(0).cast("long").alias("expire"), F.lit(0).cast("long").alias("plantime")
    )
    slices = spark.createDataFrame([("m", "6", 150, 100), ("m", "6", 250, 30)], "mode string, frequency string, offset long, count long")
    assert sorted(r.uuid for r in P.batch_slices(tasks, slices, NOW, rows=90).collect()) == list(range(151, 281))


def test_streams(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text('{"mode":"list","uid":1,"seq":1}\n{"mode":"list","uid":1,"seq":2}\nnot json\n')
    messages = ST.read_messages(spark, "json", str(folder))
    q = messages.writeStream.format("memory").queryName("messages").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("messages").where("mode = 'list'").count() == 2 and spark.table("messages").where("mode is null").count() == 1
    runs = messages.where("mode = 'list'").select(F.col("uid").alias("uuid"), F.col("seq").alias("run"))
    q = ST.run_history(runs).writeStream.format("memory").queryName("history").outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.table("history").collect()] == [(1, [1, 2])]


def test_partitioned_tables(spark, tmp_path):
    from webharvest.sources import tables as S

    rows = spark.createDataFrame([("a", NOW), ("b", NOW + 40 * 86400), ("c", NOW + 3)], "acid string, ctime long")
    S.write_table(S.conform(rows, "articles"), str(tmp_path / "articles"), "articles")
    assert {p.name for p in (tmp_path / "articles").glob("ym=*")} == {"ym=199601", "ym=199602"}
    assert {r.acid for r in S.read_months(spark, str(tmp_path / "articles"), "articles", NOW, NOW + 86400).collect()} == {"a", "c"}
    seen = spark.createDataFrame([("aa", 1), ("b1", 2)], "unid string, ctime long")
    S.write_table(seen, str(tmp_path / "unique"), "unique")
    assert [tuple(r) for r in S.seen_of(spark, str(tmp_path / "unique"), seen.where("unid = 'b1'")).collect()] == [("b1", 2)]


def test_reads_are_pruned(spark, tmp_path):
    from webharvest.sources import tables as S

    def scan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    rows = spark.createDataFrame([("a", NOW, "m0"), ("b", NOW + 40 * 86400, "m1")], "acid string, ctime long, mode string")
    S.write_table(S.conform(rows, "articles"), str(tmp_path / "articles"), "articles")
    plan = scan(S.read_months(spark, str(tmp_path / "articles"), "articles", NOW, NOW + 86400))
    assert "PartitionFilters: [isnotnull(ym" in plan and "199601" in plan
    S.write_table(S.conform(rows, "spider_task"), str(tmp_path / "tasks"), "spider_task")
    assert S.read_modes(spark, str(tmp_path / "tasks"), "m1").count() == 1
    assert "PartitionFilters: [isnotnull(mode" in scan(S.read_modes(spark, str(tmp_path / "tasks"), "m1"))


def files(folder, *batches):
    """JSON files, a micro-batch each, in the order of their times."""
    import json
    import os

    folder.mkdir()
    for k, rows in enumerate(batches):
        path = folder / f"{k}.json"
        path.write_text("\n".join(json.dumps(r) for r in rows))
        os.utime(path, (1_600_000_000 + k, 1_600_000_000 + k))
    return str(folder)


def test_first_seen_over_batches_and_history(spark, tmp_path):
    source = files(
        tmp_path / "in", [{"unid": "a", "ctime": 5}, {"unid": "b", "ctime": 3}, {"unid": "a", "ctime": 4}],
        [{"unid": "b", "ctime": 1}, {"unid": "c", "ctime": 9}, {"unid": "old", "ctime": 8}]
    )
    stream = spark.readStream.schema("unid string, ctime long").option("maxFilesPerTrigger", 1).json(source)
    history = str(tmp_path / "history")
    spark.createDataFrame([("old", 0)], "unid string, ctime long").write.parquet(history)
    work = ST.first_seen_batch(lambda batch: spark.read.parquet(history), lambda new, epoch: new.write.mode("append").parquet(history))
    stream.writeStream.foreachBatch(work).trigger(availableNow=True).option(
        "checkpointLocation", str(tmp_path / "c1")
    ).start().awaitTermination()
    assert sorted(tuple(r) for r in spark.read.parquet(history).collect()) == [("a", 4), ("b", 3), ("c", 9), ("old", 0)]
    assert sorted(r.unid for r in ST.run_available(ST.first_seen(stream)).collect()) == ["a", "b", "c", "old"]


def test_attempts_and_runs_are_kept_over_batches(spark, tmp_path):
    source = files(
        tmp_path / "in", [{"task": "t", "class": "Timeout", "seq": 2}, {"task": "t", "class": "Timeout", "seq": 1}],
        [{"task": "t", "class": "Timeout", "seq": 3}, {"task": "u", "class": "Timeout", "seq": 4}]
    )
    stream = spark.readStream.schema("task string, class string, seq long").option("maxFilesPerTrigger", 1).json(source)
    rows = ST.run_available(ST.with_attempts(stream)).orderBy("seq").collect()
    assert [(r.task, r.seq, r.attempt, r.epoch) for r in rows] == [("t", 1, 1, 0), ("t", 2, 2, 0), ("t", 3, 3, 1), ("u", 4, 1, 1)]
    runs = stream.select(F.when(F.col("task") == "t", 1).otherwise(2).cast("long").alias("uuid"), (F.col("seq") * 10).alias("run"))
    kept = {(r.uuid, r.epoch): r.runs for r in ST.run_available(ST.run_history(runs, kept=2), "update").collect()}
    assert kept == {(1, 0): [10, 20], (1, 1): [20, 30], (2, 1): [40]}


def test_daily_counts_with_late_rows(spark, tmp_path):
    days = [
        [{"ts": "1996-01-01T10:00:00"}], [{"ts": "1996-01-02T01:00:00"}, {"ts": "1996-01-01T23:00:00"}], [{"ts": "1996-01-09T00:00:00"}],
        [{"ts": "1996-01-09T01:00:00"}], [{"ts": "1996-01-01T00:00:00"}]
    ]
    stream = spark.readStream.schema("ts timestamp").option("maxFilesPerTrigger", 1).json(files(tmp_path / "in", *days))
    rows = ST.run_available(ST.daily_articles(stream, "ts"), "update")
    last = {str(r.day): r.articles for r in rows.groupBy("day").agg(F.max_by("articles", "epoch").alias("articles")).collect()}
    assert last == {"1996-01-01": 2, "1996-01-02": 1, "1996-01-09": 2}  # the last row comes after the bound


def test_content_of_a_page_without_a_known_container(spark):
    said = "the river is high and the town is wet with the rain of the night"
    page = f"""<html lang="en"><body><nav><ul><li><a href="/x">x</a></li></ul></nav><div id="wrap"><div><p>{said} zero</p></div>
<div><p><a href="/z">{said}</a></p></div><p>Lead</p><div id="main"><p>{said} one</p><p>{said} two</p><div><a href="/q">more</a></div>
<table><tr><td>1</td></tr></table><ul><li>item</li></ul><p>{said} three</p></div></div></body></html>"""
    rows = spark.createDataFrame(
        [(1, page), (2, None), (3, "<p>short</p>")], "page_id long, html string"
    ).withColumn("nodes", nodes.html_nodes("html"))
    got = {
        r.page_id: r.c for r in rows.select(
            "page_id", H.content(F.col("nodes"), F.lit("http://e.com/")).alias("c")
        ).collect()
    }
    assert got[1].text == "\n\n".join([f"{said} zero", "Lead", f"{said} one", f"{said} two", "• item", f"{said} three"])
    assert (got[2].top, got[2].text, got[3].text) == (None, None, None)


def test_stopword_tables(spark):
    from webharvest.functions import text as T

    table = spark.createDataFrame([("sv", "Och"), ("sv", "att"), ("sv", "att"), (None, "x"), ("nl", "")], "lang string, word string")
    lists = T.stopword_lists(table)
    assert lists == {"sv": ["att", "och"]}
    assert one(spark, T.stopwords_by_language(F.lit("Och det, att vara"), F.lit("sv-SE"), lists)) == 2
    with pytest.raises(ValueError):
        T.stopword_lists(table, most=1)
    texts = spark.createDataFrame([("a b", "en"), ("a c", "en"), ("a", "en"), (None, "en"), ("z", "de")], "text string, lang string")
    assert {tuple(r) for r in T.frequent_words(texts, share=0.5).collect()} == {("en", "a"), ("de", "z")}


def test_selectors_match_nested_and_indexed_steps(spark):
    page = '<div class="a b" id="top"><ul><li>1</li><li class="x y">2</li></ul><ul><li>3</li><li>4</li><li>5</li></ul><p title="t-1">p</p></div>'
    rows = spark.createDataFrame([(page,)], "html string").withColumn("n", nodes.html_nodes("html"))
    cases = {
        "@css:div.b > ul li": ["1", "2", "3", "4", "5"], "@css:ul:eq(1) li": ["3", "4", "5"], "@css:li:last": ["5"], "@css:#top li.y": ["2"], "@css:li:eq(-2)": ["4"], "@css:p[title^=t], li.x": ["2", "p"],
        "@xpath://ul/li[1]": ["1", "3"], "//ul[2]/li[last()]/text()": ["5"], "/div/ul/li[3]": ["5"], "//*[@class='x y']": ["2"], "//p[contains(@title,'-1')]/@title": ["t-1"], "//nav": [],
    }
    got = rows.select(*[selectors.selector(rule, F.col("n")).alias(str(k)) for k, rule in enumerate(cases)]).first()
    assert list(got) == list(cases.values())


def test_article_text_of_layouts(spark):
    """Text comes out once and in order whatever elements hold it; what only chaff holds is not lost."""
    said = "the river is high and the town is wet with the rain of the night"
    cases = {
        "<article>one<br>two <b>bold</b> and <a href='/x'>link</a> end<p>three</p>four</article>": ["one", "two bold and link end", "three", "four"],
        "<article><div>text</div></article>": ["text"],
        "<article><div>a<div>b</div>c</div></article>": ["a", "b", "c"],
        f"<table><tr><td>{said}</td><td>{said} too</td></tr></table>": [said, f"{said} too"],
        "<article><dl><dt>term</dt><dd>meaning</dd></dl></article>": ["term", "meaning"],
        "<article><blockquote><p>said</p>cite</blockquote><ul><li>x<ul><li>y</li></ul></li></ul></article>": ["said", "cite", "• x", "• y"],
        "<article><h1>Title</h1><h2>Head</h2><p>a<p>b<script>no</script><select><option>no</select></article>": ["Head", "a", "b"],
        "<article><p><a href='/1'>all</a> <a href='/2'>links</a></p><p>kept</p><div><a href='/q'>more</a></div></article>": ["kept"],
    }
    rows = spark.createDataFrame(list(enumerate(cases)), "k int, html string").withColumn("n", nodes.html_nodes("html"))
    got = {r.k: r.text for r in rows.select("k", H.content(F.col("n"), F.lit("http://e.com/"))["text"].alias("text")).collect()}
    assert got == {k: "\n\n".join(want) for k, want in enumerate(cases.values())}


def test_parsing_keeps_places_and_long_tags():
    page = "<div id=a><p>x<p>y</div><ul><li>é<li>z</ul><br><b>open"
    got = nodes.parse(page)
    assert [page[n["start"] : n["end"]] for n in got] == [
        "<div id=a><p>x<p>y</div>", "<p>x", "<p>y", "<ul><li>é<li>z</ul>", "<li>é", "<li>z", "<br>", "<b>open"
    ]
    wide = "<div " + " ".join(f"a{k}='{k} > {k}'" for k in range(3000)) + ">text</div>"
    assert [(n["tag"], len(n["attrs"]), n["text"]) for n in nodes.parse(wide)] == [("div", 3000, "text")]
    deep = nodes.parse("<a href=x>" * 3000 + "t")
    assert deep[0]["links"] == 2999 and deep[0]["last"] == 2999


def test_stopword_counters():
    from webharvest.functions import content

    zh = content.counter("zh", {"zh": ["的", "中央", "中", "我们", "们"]})
    assert zh("中央的我们") == 5 and zh("中的中") == 2 and zh("") == 0
    assert content.counter("en")("The river, and THE town!") == 3 == content.counter("xx")("The river, and THE town!")
    assert content.language(nodes.parse("<html lang=DE-at>")) == "de" and content.language([]) == "en"
    assert content.language(nodes.parse('<meta name=lang content="fr">')) == "fr"


STORE = """{"shop":{"books":[{"title":"A","price":8.5,"tags":["x","y"]},{"title":"B","price":12,"isbn":"0-1"},{"title":"C","price":9,"isbn":"0-2"}],
"cart":{"color":"red","price":20}},"odd key":[1,2,3,4,5],"html":["<b>x</b><i>1</i>","<b>y</b>"]}"""


def test_json_paths(spark):
    cases = {
        "$.shop.books[*].title": '["A","B","C"]', "$..price": "[8.5,12,9,20]", "$..books[?(@.price>8.9)].title": '["B","C"]', "$.shop..isbn": '["0-1","0-2"]',
        "$['odd key'][1:3]": "[2,3]", "$['odd key'][::2]": "[1,3,5]", "$['odd key'][-2:]": "[4,5]", "$['odd key'][0,-1]": "[1,5]", "$.shop.books[0]['title','price']": '["A",8.5]',
        "$..books[?(@.isbn && @.price<10)].title": "C", "$..books[?(!(@.isbn) || @.title=='B')].title": '["A","B"]', "$..books[?(@.tags.length==2)].title": "A",
        "$..books[(@.length-1)].title": "C", "shop.books[-1].title": "C", "$.shop.*.color": "red", "$..nothing": None, "$..tags[*]": '["x","y"]', "$.shop.books[?(@.price!=9)].price": "[8.5,12]",
    }
    row = spark.createDataFrame([(STORE,)], "s string")
    got = row.select(*[J.json_path(F.col("s"), path).alias(str(k)) for k, path in enumerate(cases)]).first()
    assert dict(zip(cases, got)) == cases
    for bad in ("$.a[?(@.b ~ 1)]", "$.a[?(1)]", "$.a[", "$.a[::0]", "$.a.[b", "$.a[(@.x)]", "$..", "$.a b"):
        with pytest.raises(ValueError):
            J.json_path(F.col("s"), bad)
    rows = J.json_rule(row, "s", {"filter": "$.html", "item": {"b": "@css:b", "i": "@xpath://i/text()", "r": "@reg:<b>[t]</b>"}})
    assert [tuple(r) for r in rows.select("b", "i", "r").collect()] == [("x", "1", "x"), ("y", None, "y")]
    odd = spark.createDataFrame([("no json",), (None,), ("[1,[2,{\"k\":[]}]]",)], "s string").select(J.json_path(F.col("s"), "$..k")).collect()
    assert [r[0] for r in odd] == [None, None, "[]"]


SHELF = """<div id=main class="a b"><h2>One</h2><p lang=en-US>first <b>bold</b></p><p class="x">second, with comma</p><div class=box><p>third</p>
<a href="/1" title="x, y">L1</a><a href="/2">L2</a> tail</div><h2>Two</h2><p>fourth<br>line</p><ul><li>1<li class=on>2<li>3<li>4<li>5</ul></div><p>outside</p>"""


def test_selector_grammar(spark):
    rows = spark.createDataFrame([(SHELF,)], "html string").withColumn("n", nodes.html_nodes("html"))
    cases = {
        "@css:h2 + p": ["first bold", "fourth line"], "@css:h2 ~ p.x": ["second, with comma"], "@css:a[title='x, y'], li.on": ["L1", "2"],
        "@css:p:not(.x, [lang])": ["third", "fourth line", "outside"], "@css:li:nth-child(2n+1)": ["1", "3", "5"], "@css:li:nth-child(-n+2)": ["1", "2"],
        "@css:li:nth-last-child(2)": ["4"], "@css:li:first-child, li:last-child": ["1", "5"], "@css:p:contains('third')": ["third"], "@css:li:gt(2)": ["4", "5"],
        "@css:li:lt(-3)": ["1", "2"], "@css:[lang|=en]": ["first bold"], "@css:#main > div > p": ["third"], "@css:a[href!='/1']": ["L2"], "@css:li:odd": ["2", "4"],
        "//a[@href='/1' or @href='/2']": ["L1", "L2"], "//a[@href and not(@title)]": ["L2"], "//p[text()='third']": ["third"], "//p[starts-with(text(),'sec')]": ["second, with comma"],
        "//h2[.='Two']/following-sibling::p[1]": ["fourth line"], "//h2/following-sibling::p[1]": ["first bold", "fourth line"], "//b/..": ["first bold"], "//li[position()<=2]": ["1", "2"],
        "//li[@class='on']/preceding-sibling::li[1]": ["1"], "//b/ancestor::div/h2[last()]": ["Two"], "//div[@class='box']/text()": ["tail"], "//li[last()-1]": ["4"],
        "//a[contains(@title, ', y')]/@href": ["/1"], "//li[.>3]": ["4", "5"], "//p[normalize-space(text())='outside']": ["outside"], "//div/div//text()": ["tail", "third", "L1", "L2"],
        "/div/p[@class='x' and (contains(.,'comma') or @no)]": ["second, with comma"], "//li[not(contains(.,'1') or .='2')][1]": ["3"],
    }
    got = rows.select(*[selectors.selector(rule, F.col("n")).alias(str(k)) for k, rule in enumerate(cases)]).first()
    assert dict(zip(cases, got)) == cases
    for bad in ("@css:p:hover", "@css:", "@css:p >", "@css:a[b", "@css:p:not(a b)", "//p[count(a)=1]", "//p[1][@x]", "//p[@a='x]", "//p/", "//child::p/attribute::x", "//p/text()/b"):
        with pytest.raises(ValueError):
            selectors.selector(bad, F.col("n"))
    rules = {
        "html": {"filter": "@css:p[lang]", "target": "html"}, "outer": {"filter": "@css:li.on", "target": "outer"},
        "grep": {"filter": "@css:p", "grep": {"pattern": "^(third|four)"}}, "equal": {"filter": "//a", "target": "href", "grep": {"target": "title", "params": "x, y"}},
        "left": {"filter": "@css:li", "not_": ".on, :first-child", "eq": -1}, "is": {"filter": "@css:p", "is_": ".x"}, "match": {"filter": "@css:a", "match": r'href="/(\d)"'},
    }
    one_row = rows.select(*[J.rule_values(r, F.col("html"), F.lit("http://e.com/"), F.col("n")).alias("_" + k) for k, r in rules.items()]).first()
    assert {k[1:]: v for k, v in one_row.asDict().items()} == {
        "html": ["first <b>bold</b>"], "outer": ["<li class=on>2"], "grep": ["third", "fourth line"], "equal": ["/1"], "left": ["5"], "is": ["second, with comma"],
        "match": ["1", "2"],
    }


def test_selectors_against_a_plain_matcher(spark):
    """Combinators and node tests on random trees, each node held to the definition."""
    import random

    r = random.Random(4)

    def tree(depth):
        tag = r.choice(["div", "span", "b", "i"])
        inner = "".join(tree(depth - 1) for _ in range(r.randrange(4))) if depth else r.choice(["t", "u", ""])
        return f"<{tag} class='{r.choice('xyz')} {r.choice('pq')}'>{inner}</{tag}>"

    pages = ["".join(tree(3) for _ in range(3)) for _ in range(12)]

    def plain(page, pairs, sign):
        ns = nodes.parse(page)
        up = lambda n: ns[n["parent"]] if n["parent"] >= 0 else None
        kin = lambda n: [m for m in ns if m["parent"] == n["parent"]]

        def reach(n):
            if sign == ">":
                return [up(n)] if up(n) else []
            if sign == " ":
                out = []
                while n := up(n):
                    out.append(n)
                return out
            before = [m for m in kin(n) if m["order"] < n["order"]]
            return before[-1:] if sign == "+" else before

        return [n["order"] for n in ns if pairs[1](n, kin(n)) and any(pairs[0](m, kin(m)) for m in reach(n))]

    simple = {
        "div": lambda n, k: n["tag"] == "div", ".x": lambda n, k: "x" in n["attrs"]["class"].split(), ":not(.p)": lambda n, k: "p" not in n["attrs"]["class"].split(),
        "b:nth-child(2n)": lambda n, k: n["tag"] == "b" and (k.index(n) + 1) % 2 == 0, ":contains(t)": lambda n, k: "t" in n["text"], "*": lambda n, k: True,
        "span:last-child": lambda n, k: n["tag"] == "span" and k[-1] is n, "[class^=z]": lambda n, k: n["attrs"]["class"].startswith("z"),
    }
    rows = spark.createDataFrame(list(enumerate(pages)), "k int, html string").withColumn("n", nodes.html_nodes("html"))
    pairs = [(a, sign, b) for a in simple for b in simple for sign in "> +~" if r.random() < 0.15]
    got = rows.select("k", *[selectors.elements(f"@css:{a}{s}{b}", F.col("n"))[0].alias(f"c{i}") for i, (a, s, b) in enumerate(pairs)]).collect()
    for row in got:
        for i, (a, sign, b) in enumerate(pairs):
            assert row[f"c{i}"] == plain(pages[row.k], (simple[a], simple[b]), sign), (a, sign, b)


def test_public_suffixes(spark):
    """Cases of the published check, under rules of its form, and random hosts against the published steps."""
    import random

    from webharvest.functions.suffixes import SuffixRules, default_rules, suffix_rules

    lines = """// list
com
biz
uk.com
cn
com.cn
公司.cn
ac
jp
ac.jp
kyoto.jp
ide.kyoto.jp
*.kobe.jp
!city.kobe.jp
*.ck
!www.ck
us
k12.ak.us
// ===BEGIN PRIVATE DOMAINS===
blogspot.com
*.compute.amazonaws.com""".split("\n")
    rules = SuffixRules(lines)
    cases = {
        "com": None, "example.com": "example.com", "b.example.com": "example.com", "a.b.example.com": "example.com", "uk.com": None, "example.uk.com": "example.uk.com",
        "a.b.example.uk.com": "example.uk.com", "example": None, "example.example": "example.example", "a.b.example.example": "example.example", "test.ac": "test.ac",
        "jp": None, "test.jp": "test.jp", "www.test.jp": "test.jp", "ac.jp": None, "www.test.ac.jp": "test.ac.jp", "kyoto.jp": None, "b.ide.kyoto.jp": "b.ide.kyoto.jp",
        "a.b.ide.kyoto.jp": "b.ide.kyoto.jp", "c.kobe.jp": None, "b.c.kobe.jp": "b.c.kobe.jp", "a.b.c.kobe.jp": "b.c.kobe.jp", "city.kobe.jp": "city.kobe.jp",
        "www.city.kobe.jp": "city.kobe.jp", "ck": None, "test.ck": None, "b.test.ck": "b.test.ck", "www.ck": "www.ck", "www.www.ck": "www.ck", "test.us": "test.us",
        "www.test.us": "test.us", "ak.us": "ak.us", "test.k12.ak.us": "test.k12.ak.us", "食狮.公司.cn": "食狮.公司.cn", "www.xn--85x722f.xn--55qx5d.cn": "xn--85x722f.xn--55qx5d.cn",
        "公司.cn": None, "a.blogspot.com": "a.blogspot.com", "x.eu.compute.amazonaws.com": "x.eu.compute.amazonaws.com", "eu.compute.amazonaws.com": None, "amazonaws.com": "amazonaws.com",
        "comx.com": "comx.com", "a.comx": "a.comx",
    }
    r, labels = random.Random(8), "com uk cn jp kobe city www ck us k12 ak a b example blogspot kyoto ide ac".split()
    hosts = list(cases) + [".".join(r.choice(labels) for _ in range(r.randrange(1, 6))) for _ in range(600)]
    df = spark.createDataFrame([(h,) for h in hosts], "h string")
    more = default_rules()
    got = df.select("h", rules.domain(F.col("h")).alias("d"), more.domain(F.col("h")).alias("e")).collect()
    for row in got:
        assert row.d == rules.plain_domain(row.h), row
        assert row.e == more.plain_domain(row.h), row
        if row.h in cases:
            assert row.d == cases[row.h], row
    assert SuffixRules(lines, private=False).plain_domain("a.blogspot.com") == "blogspot.com"
    read = suffix_rules(spark.createDataFrame([("com",), ("*.ck",), (None,)], "rule string"))
    assert read.plain_domain("a.b.ck") == "a.b.ck"
    with pytest.raises(ValueError):
        suffix_rules(df.withColumnRenamed("h", "rule"), most=5)
    with pytest.raises(ValueError):
        SuffixRules(["a.*.b"])
    urls_ = {"http://a.shop.co.il/": "shop.co.il", "http://a.com.ar": "a.com.ar", "http://a.b.github.io/x": "b.github.io", "http://1.2.3.4/": None, "http://localhost/": None}
    for url, want in urls_.items():
        assert one(spark, urls.domain(F.lit(url))) == want, url
    assert one(spark, urls.typeinfo(F.lit("http://shop.co.il/")))["subdomain"] == "www.shop.co.il"


def test_several_details_of_an_article(spark):
    old = spark.createDataFrame([("a", "", "x", "c", 0, None, 0, 0), ("b", "t", "x", "c", 5, None, 0, 0)],
                                "rid string, title string, author string, channel string, pubtime long, content string, status int, utime long")
    new = spark.createDataFrame(
        [("a", "first", "", None, 10, "early"), ("a", "", "late", None, 20, ""), ("a", "second", None, None, 0, "none"), ("a", "first", "", None, 10, "early")],
        "rid string, title string, author string, channel string, pubtime long, content string"
    )
    got = {r.rid: (r.title, r.author, r.channel, r.pubtime, r.content, r.status) for r in A.merge_detail(old, new, 99).collect()}
    assert got == {"a": ("first", "late", "c", 20, "early", 2), "b": ("t", "x", "c", 5, None, 0)}


def test_bad_rule_patterns_are_named_and_left_out(spark):
    rules = spark.createDataFrame(
        [(1, "e.com", "", "[a-", 1), (2, "e.com", "", r"/x/\d+", 1), (3, "e.com", "", None, 1), (4, "e.com", "", "(?P<n>x)", 1)],
        "uuid int, domain string, subdomain string, pattern string, status int"
    )
    assert {r.uuid for r in J.bad_patterns(rules).collect()} == {1, 4}
    articles = spark.createDataFrame([("r", "http://www.e.com/x/12"), ("s", "http://www.e.com/y")], "rid string, url string")
    assert {r.rid: r.rule_id for r in J.match_detail_rules(articles, rules).collect()} == {"r": 2, "s": 2}
    checked = articles.withColumn("rule_id", F.when(F.col("rid") == "r", 2).otherwise(1))
    assert {r.rid: r.rule_ok for r in J.check_rule(checked, rules).collect()} == {"r": True, "s": False}


def test_dates_with_words_before_the_time(spark):
    page = "<p>发布时间：2021-03-04 (updated today at) 10:20</p>"
    assert one(spark, times.find_date(F.lit(page))) == "2021-03-04 (updated today at) 10:20"


def test_seen_set_is_joined_where_it_lies(spark, tmp_path):
    """No exchange stands between the history's files and the join; a replayed epoch gives the same rows and adds nothing."""
    from webharvest.sources.seen import SeenSet

    seen = SeenSet(spark, "seen_by_test", f"file://{tmp_path}/seen", buckets=8)
    batch = [(f"k{k % 40}" if k % 7 else None, k) for k in range(200)]
    rows = spark.createDataFrame(batch, "unid string, ctime long")
    seen.add(spark.createDataFrame([(f"k{k}", 1000 + k) for k in range(10)], "unid string, ctime long"))
    for key, value in (("spark.sql.adaptive.enabled", "false"), ("spark.sql.autoBroadcastJoinThreshold", "-1")):
        spark.conf.set(key, value)
    try:
        plan = seen.mark(rows)._jdf.queryExecution().executedPlan().treeString().split("\n")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    depth = lambda line: len(line) - len(line.lstrip(" :+-*0123456789()"))
    at = next(k for k, line in enumerate(plan) if "FileScan parquet" in line and "seen_by_test" in line)
    above, width = [], depth(plan[at])
    for line in reversed(plan[:at]):
        if depth(line) < width:
            above.append(line)
            width = depth(line)
        if "Join" in line and above and above[-1] == line:
            break
    assert "Join" in above[-1] and not any("Exchange" in line for line in above), above
    first = {}
    for unid, ctime in batch:
        if unid and (unid not in first or ctime < first[unid]):
            first[unid] = ctime
    known = {f"k{k}": 1000 + k for k in range(10)}
    for _ in range(2):  # the second run is a replay
        got = seen.insert(rows, 5).collect()
        assert {(r.unid, r.ctime) for r in got if r.inserted and r.unid} == {(u, t) for u, t in first.items() if u not in known}
        assert all(r.seen_ctime == known.get(r.unid, first.get(r.unid)) for r in got if r.unid)
        assert seen.rows().count() == 40 and seen.rows().where("epoch = 5").count() == 30
    assert not any(r.inserted for r in seen.insert(rows.where("unid is not null"), 6).collect()) and seen.rows().count() == 40
    write = seen.sink(f"file://{tmp_path}/out")
    for _ in range(2):
        write(spark.createDataFrame([("new", 1), ("new", 2), ("k1", 3)], "unid string, ctime long"), 7)
        assert [tuple(r) for r in spark.read.parquet(f"file://{tmp_path}/out").select("unid", "ctime", "epoch").collect()] == [("new", 1, 7)]
    assert seen.rows().count() == 41
    seen.drop()


def test_bitmap_answers_as_the_bits_do(spark):
    known, asked = [f"k{k}" for k in range(300)] + [None, ""], [f"k{k}" for k in range(250, 700)] + ["é😀", "", None, "k1", "k1"]
    df = lambda keys: spark.createDataFrame([(k,) for k in keys], "unid string")

    def offsets(key, bits, hashes):
        out = []
        for seed in range(hashes):
            h = 0
            for c in key:
                h = (h * (1 + seed) + ord(c)) % bits
            out.append(h)
        return out

    for bits, hashes in ((1 << 22, 6), (5000, 3)):
        table = D.bloom_bits(df(known), bits=bits, hashes=hashes)
        got = {r.unid: r.is_new for r in D.bloom_check(df(asked), table, bits=bits, hashes=hashes).collect()}
        on = {b for k in known if k is not None for b in offsets(k, bits, hashes)}
        assert got == {k: any(b not in on for b in offsets(k, bits, hashes)) for k in asked if k is not None}
    with pytest.raises(ValueError):
        D.bloom_check(df(asked), table, bits=1 << 40)


def test_upsert_rewrites_only_the_months_it_touches(spark, tmp_path):
    from webharvest.sources import tables as S

    path, day = f"file://{tmp_path}/articles", 86400
    rows = [(f"a{k}", f"t{k}", (k % 3) * 31 * day, 1) for k in range(30)]  # months 197001 to 197003
    kind = "acid string, title string, ctime long, utime long"
    S.write_table(S.conform(spark.createDataFrame(rows, kind), "articles"), path, "articles")
    files = lambda: {p.name: p.parent.name for p in tmp_path.rglob("*.parquet")}
    before = files()
    incoming = spark.createDataFrame([("a1", "new", 999 * day, 5), ("a1", "older", 999 * day, 4), ("a4", None, 999 * day, 5), ("n", "first", 100 * day, 5)], kind)
    for _ in range(2):
        assert S.upsert_months(spark, path, incoming) == ["197002", "197004"]
    after = files()
    assert {n for n, ym in before.items() if ym != "ym=197002"} <= set(after) and not {n for n, ym in before.items() if ym == "ym=197002"} & set(after)
    got = {r.acid: (r.title, r.ctime, r.ym) for r in S.read_table(spark, path, "articles").collect()}
    assert len(got) == 31 and got["a1"] == ("new", 31 * day, "197002") and got["a4"] == ("t4", 31 * day, "197002")
    assert got["n"] == ("first", 100 * day, "197004") and got["a0"] == ("t0", 0, "197001")
    assert S.upsert_months(spark, path, incoming.limit(0)) == []


def test_charsets_of_undeclared_pages(spark):
    """Texts of seven encodings, whole and in parts of 30 characters: all whole ones and over 0.95 of the parts are told apart."""
    texts = {
        "gb18030": "我们在这里说的是一个国家的发展，人们对生活有了新的要求。他说，这个时候大家都会来到这里，看看自己的工作是不是可以做得更好。中国的经济在过去的几年里发展得很快。",
        "big5": "我們在這裡說的是一個國家的發展，人們對生活有了新的要求。他說，這個時候大家都會來到這裡，看看自己的工作是不是可以做得更好。台灣的經濟在過去的幾年裡發展得很快。",
        "shift_jis": "これは日本語の文章です。東京の天気は今日も晴れていて、多くの人が公園に出かけました。新しいニュースが毎日インターネットで読まれています。",
        "euc_jp": "政府は来年の予算について話し合いを始めました。会議では、教育と医療のための費用を増やすことが決まりました。",
        "euc_kr": "오늘 서울의 날씨는 맑고 기온은 어제보다 조금 높을 것으로 보입니다. 정부는 새로운 경제 정책을 발표하고 시장의 반응을 기다리고 있다고 말했다.",
        "windows-1251": "Сегодня в Москве прошла встреча министров, на которой обсуждали новый закон о связи. По словам участников, решение будет принято до конца года.",
        "koi8-r": "Учёные рассказали о результатах исследования, которое продолжалось несколько лет и охватило многие города страны.",
    }
    pages = [(name, t.encode(name), t) for name, t in texts.items()]
    pages += [(name, t[k : k + 30].encode(name), t[k : k + 30]) for name, t in texts.items() for k in range(0, len(t) - 30, 5)]
    pages += [("utf-8", "é ß 中".encode(), "é ß 中"), ("declared", b'<meta charset="gb2312">' + "镕".encode("gb18030"), '<meta charset="gb2312">镕'), ("none", None, None)]
    rows = spark.createDataFrame([(k, p[1]) for k, p in enumerate(pages)], "k int, b binary")
    got = {r.k: r.t for r in rows.select("k", nodes.decode_page("b").alias("t")).collect()}
    right = [got[k] == text for k, (_, _, text) in enumerate(pages)]
    assert all(right[: len(texts)]) and all(right[-3:]) and sum(right) > 0.95 * len(right), [p for p, ok in zip(pages, right) if not ok]


def test_pages_are_parsed_in_slices(spark):
    """A task holds the nodes of some pages at once, whatever the size of the batch that it is sent; nulls and large pages among them."""
    import pyarrow as pa
    from webharvest.functions.nodes import SLICE_BYTES, _columns, _parser, _slices, html_nodes, parse

    pages = [None if k % 7 == 3 else f"<div id='d{k}'><p>text {k}</p></div>" * (1 + k % 5 * 40) for k in range(300)]
    pages[10] = "<p>" + "x" * SLICE_BYTES + "</p>"
    cut = list(_slices(pa.array(pages, pa.string())))
    assert [x for c in cut for x in c.to_pylist()] == pages and not list(_slices(pa.array([], pa.string())))
    assert all(sum(len(x or "") for x in c.to_pylist()) <= SLICE_BYTES for c in cut if len(c) > 1) and len(cut) > 2
    parsed = list(_parser(spark.sparkContext.applicationId, None, "null").func(iter([pa.array(pages, pa.string())])))
    assert len(parsed) == len(cut)
    some = [*range(0, 20), *range(280, 300)]
    want = _columns([parse(pages[k]) for k in some]).to_pylist()
    assert [x for c in parsed for x in c.to_pylist()][:20] == want[:20]
    rows = spark.createDataFrame(list(enumerate(pages)), "k long, html string").coalesce(1)
    got = {r.k: (r.n, r.t) for r in rows.select("k", html_nodes("html").alias("x")).selectExpr("k", "size(x) n", "try_element_at(x, -1).text t").collect()}
    assert len(got) == 300 and got[3] == (0, None)
    assert all(got[k] == (len(parse(pages[k])), f"text {k}") for k in some if pages[k] and k != 10)


def _frontier(spark, n=200, w=90):
    urls_ = spark.range(1, n + 1).selectExpr(
        "id uuid", "1L pid", "1L sid", "id % 4 tid", "concat('u', id) url", "id % 3 ruleId", "if(id % 2 = 0, 60L, 0L) expire"
    )
    words = spark.range(1, w + 1).selectExpr(
        "id uuid", "case when id % 9 = 0 then null else id % 6 end tid", "if(id % 3 = 0, '2', '') frequency", "if(id % 5 = 0, 30L, 0L) expire"
    )
    rules = spark.sql("SELECT id uuid, if(id = 1, '4', '1') frequency FROM range(1, 3)")
    tasks = spark.range(1, n + 1).where("id % 3 = 0").selectExpr("'m' mode", "id uid", "explode(array(1L, 5L, 6L, 9L)) kid")
    return urls_, words, tasks, rules


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_search_tasks_by_keyword_never_move_the_pairs(spark):
    u, w, t, r = _frontier(spark)
    kinds = spark.sql("SELECT id tid FROM range(0, 3)")
    df = P.new_search_tasks_by_keyword(w, kinds, u, t, r, "m", 1000)
    words = [(x.uuid, x.tid or 0) for x in w.collect()]
    have = {(x.uid, x.kid) for x in t.collect()}
    want = {(x.uuid, k) for x in u.collect() for k, tid in words if x.tid < 3 and tid in (0, x.tid)} - have
    rows = df.collect()
    assert {(x.uid, x.kid) for x in rows} == want and len(rows) == len(want)
    # the only join that leaves rows out looks at no pairs
    assert "LeftAnti" not in _plan(df)


def test_pairs_are_made_in_many_tasks(spark):
    """Few urls in one partition and few keywords: the pairs are dealt before they are made, whatever join Spark takes."""
    u, w, t, r = _frontier(spark)
    df = P.reconciled_tasks(u.coalesce(1), w, r, "m", 1000)
    words = {(x.uuid, x.tid): x for x in w.where("tid > 0").collect()}
    want = {(x.uuid, k) for x in u.collect() for k, tid in words if tid == x.tid}
    rows = df.collect()
    assert {(x.uid, x.kid) for x in rows} == want and len(rows) == len(want)
    assert df.where("uid > 0").select(F.spark_partition_id().alias("p")).distinct().count() > 8
    assert {x.frequency for x in rows if x.uid % 3 == 1 and x.kid % 3 == 0} == {"2"}
