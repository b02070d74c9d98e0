"""Page and rule queries on `pages`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.nodes import attr, decode_page, html_nodes, tags
from ..operators import extract as H
from ..operators import rules as J
from .registry import NOW, query, spread, table
from .url_queries import DOMAIN, PATH, SUB, _counts


def nodes(spark, d) -> DataFrame:
    """pages with their nodes, parsed once."""
    return spread(table(spark, d, "pages")).withColumn("nodes", html_nodes("html"))


def marked(spark, d, html: Column) -> DataFrame:
    """pages with their html changed by an expression, parsed."""
    return spread(table(spark, d, "pages")).withColumn("html", html).withColumn("nodes", html_nodes("html"))


def ident(text: str) -> Column:
    """A piece of html in which {} stands for the page id."""
    parts = text.split("{}")
    out = [F.lit(parts[0])]
    for part in parts[1:]:
        out += [F.col("page_id").cast("string"), F.lit(part)]
    return F.concat(*out)


def plain(html: str) -> str:
    """SQL of the text of a piece of html without scripts; these references count without their semicolon too, as in HTML."""
    bare = f"regexp_replace(replace({html}, '<br>', chr(10)), '<[^>]*>', '', 'g')"
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("amp", "&")):
        bare = f"regexp_replace({bare}, '&{name};?', '{char}', 'g')"
    return f"trim(regexp_replace({bare}, '\\s+', ' ', 'g'))"


ORIGIN = "regexp_extract(url, '^([a-z]+://[^/?#]*)', 1)"
LINKS = """regexp_extract_all(html, '<a href="([^"]*)">[^<]*</a>', 1)"""
TITLES = """regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1)"""
ANCHORS = f"""(SELECT page_id, url, unnest({LINKS}) AS href, unnest({TITLES}) AS raw, unnest(range(len({LINKS}))) AS pos FROM pages)"""
USABLE = "href <> '/' AND href <> '' AND NOT starts_with(href, '#') AND NOT starts_with(lower(href), 'javascript')"
#: First of equal links of a page, resolved; all links of the pages start with one slash.
PAGE_LINKS = f"""(SELECT page_id, any_value(url) AS url, {ORIGIN} || href AS link, arg_min({plain("raw")}, pos) AS title FROM {ANCHORS} WHERE {USABLE} GROUP BY page_id, {ORIGIN} || href)"""
#: The paragraphs of the article: page_id, language, place, text.
PARAGRAPHS = f"""(SELECT page_id, lang, i, {plain("raw")} AS text FROM (SELECT page_id, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang,
unnest(string_split(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '<p>')[2:]) AS raw, unnest(range(len(string_split(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '<p>')) - 1)) AS i FROM pages))"""
STOPS = f"(CASE lang WHEN 'de' THEN {_counts('de')} WHEN 'fr' THEN {_counts('fr')} WHEN 'es' THEN {_counts('es')} ELSE {_counts('en')} END)::INT"
#: Layouts of an article by page id modulo 7: paragraphs, plain blocks, cells, bare text between line breaks, paragraphs between
#: bare text, list items, blocks in blocks; (name of the text's element, its end, what stands before the first and behind the last text).
LAYOUTS = (
    ("<p>", "</p>", "", ""), ("<div>", "</div>", "", ""), ("<td>", "</td>", "<table><tr>", "</table>"), ("<br>", "", "", ""),
    ("<p>", "</p>", "Lead {}", "<hr>Tail {}"), ("<li>", "</li>", "<ul>", "</ul>"),
    ("<section><div><span>", "</span></div></section>", "<div><div>", "</div></div>")
)


def laid_out(html: Column) -> Column:
    """The page with its article in the layout of its id."""
    out = html
    for k, (start, end, before, behind) in enumerate(LAYOUTS):
        article = F.replace(F.replace(html, F.lit("<p>"), F.lit(start)), F.lit("</p>"), F.lit(end))
        article = F.replace(
            F.replace(article, F.lit("</h1>"), F.concat(F.lit("</h1>"), ident(before))), F.lit("</article>"),
            F.concat(ident(behind), F.lit("</article>"))
        )
        out = F.when(F.col("page_id") % len(LAYOUTS) == k, article).otherwise(out)
    return out


CONTENT = f"(SELECT page_id, string_agg(text, chr(10) || chr(10) ORDER BY i) AS content FROM {PARAGRAPHS} WHERE text <> '' GROUP BY page_id)"


#: The content of the pages in their layouts: every text once, in order.
LAID_OUT = """(SELECT page_id, nullif(concat_ws(chr(10) || chr(10), CASE WHEN page_id % 7 = 4 THEN 'Lead ' || page_id END,
CASE WHEN page_id % 7 = 5 THEN '• ' || replace(content, chr(10) || chr(10), chr(10) || chr(10) || '• ') ELSE content END,
CASE WHEN page_id % 7 = 4 THEN 'Tail ' || page_id END), '') AS content FROM pages LEFT JOIN """ + CONTENT + " USING (page_id))"


def order_of(tag: str) -> str:
    """SQL of the order of the first node of a tag: the start tags before it."""
    return f"len(regexp_extract_all(split_part(html, '<{tag}>', 1), '<[a-z][a-z0-9]*[ >]'))::INT"


@query(
    r"""SELECT page_id, len(regexp_extract_all(html, '<a [^>]*href='))::INT AS anchors, len(regexp_extract_all(html, '<li[ >]'))::INT AS items, len(regexp_extract_all(html, '<meta '))::INT AS metas FROM pages"""
)
def h1_nodes(spark, d):
    n = F.col("nodes")
    return nodes(spark, d).select(
        "page_id", F.size(F.filter(tags(n, "a"), lambda x: attr(x, "href").isNotNull())).alias("anchors"),
        F.size(tags(n, "li")).alias("items"), F.size(tags(n, "meta")).alias("metas")
    )


@query(f"""SELECT page_id, count(*) AS links, min(title) AS least_title FROM {PAGE_LINKS} GROUP BY page_id""")
def h2_page_links(spark, d):
    return H.page_links(nodes(spark, d)).groupBy("page_id").agg(F.count("*").alias("links"), F.min("title").alias("least_title"))


def with_far_links(spark, d) -> DataFrame:
    """Pages with a link to another domain and two to another subdomain of their own domain."""
    other = F.regexp_extract("url", r"://[^/?#]*?([^./?#]+\.[^./?#]+)(?:[/?#]|$)", 1)
    shop = F.concat(F.lit('<a href="//shop.'), other)
    far = F.concat(F.lit('<a href="https://elsewhere.test/x">E</a>'), shop, F.lit('/y">Y</a>'), shop, F.lit('/">Root</a>'))
    return marked(spark, d, F.concat("html", far))


FAR = f"""(SELECT page_id, url, link, title FROM {PAGE_LINKS} UNION ALL SELECT page_id, url, 'https://elsewhere.test/x', 'E' FROM pages
UNION ALL SELECT page_id, url, regexp_extract(url, '^([a-z]+://)', 1) || 'shop.' || {DOMAIN} || '/y', 'Y' FROM pages UNION ALL SELECT page_id, url, regexp_extract(url, '^([a-z]+://)', 1) || 'shop.' || {DOMAIN} || '/', 'Root' FROM pages)"""


@query(
    f"""SELECT page_id, link, NOT contains(link, '//elsewhere.test/') AND ({SUB} = '' OR NOT contains(link, '://shop.')) AS same_subdomain, NOT contains(link, '//elsewhere.test/') AS same_domain FROM {FAR}"""
)
def h3_link_class(spark, d):
    same_host, same_domain = H.link_class(F.col("link"), F.col("page_url"))
    return H.page_links(with_far_links(spark, d)).select(
        "page_id", "link", same_host.alias("same_subdomain"), same_domain.alias("same_domain")
    )


@query(f"""SELECT page_id, link, title FROM {FAR} WHERE NOT contains(link, '//elsewhere.test/') AND ({SUB} = '' OR NOT contains(link, '://shop.'))
UNION ALL SELECT page_id, regexp_extract(url, '^([a-z]+://)', 1) || 'shop.' || {DOMAIN}, 'Root' FROM pages WHERE {SUB} <> ''""")
def h4_subdomain_sites(spark, d):
    return H.subdomain_sites(H.page_links(with_far_links(spark, d)))


DATED = ("/2021/0304/12345678.html", "/2021/03/05/x.html")


@query(f"""SELECT page_id, {plain("raw")} AS title, href AS url FROM {ANCHORS} WHERE page_id % 2 = 1 AND href <> '' AND NOT contains(href, '#')
UNION ALL SELECT page_id, 'D', unnest(['{DATED[0]}', '{DATED[1]}']) FROM pages WHERE page_id % 2 = 0""")
def h5_list_links(spark, d):
    dated = F.when(F.col("page_id") % 2 == 0, "".join(f'<a href="{x}">D</a>' for x in DATED)).otherwise("")
    rows = marked(spark, d, F.concat("html", dated))
    return rows.select("page_id", F.explode(H.list_links(F.col("nodes"), F.col("url"))).alias("l")).select("page_id", "l.title", "l.url")


@query(
    r"""SELECT page_id, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang, lower(regexp_extract(html, '<meta charset="([^"]*)"', 1)) AS encoding, lower(regexp_extract(url, '://([^/?#:]*)', 1)) AS domain FROM pages"""
)
def h6_metas(spark, d):
    return nodes(spark, d).select(
        "page_id", H.metas(F.col("nodes"), F.col("url")).alias("m")
    ).select("page_id", "m.lang", "m.encoding", "m.domain")


@query(
    """SELECT page_id, unnest(['title', 'type', 'article:tag']) AS key, unnest(['U' || page_id, 'article', 't' || page_id]) AS value FROM pages"""
)
def h7_open_graph(spark, d):
    meta = '<meta property="og:title" content="T{}"><meta property="og:type" content="article"><meta property="article:tag" content="t{}"><meta property="video:tag" content="v"><meta property="og:title" content="U{}">'
    rows = marked(spark, d, F.concat(ident(meta), F.col("html")))
    return rows.select("page_id", F.explode_outer(H.open_graph(F.col("nodes"))).alias("key", "value"))


@query("""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '{"@context":"http://schema.org","@type":"ReportageNewsArticle","headline":"H' || page_id || '"}' END AS json FROM pages""")
def h8_json_ld(spark, d):
    """Objects of another type, another context and in arrays; every other page has its object behind others in an array."""
    one = '{"@context":"http://schema.org","@type":"%s","headline":"%s"}'
    kind = F.when(F.col("page_id") % 3 == 0, ident(one % ("ReportageNewsArticle", "H{}"))).otherwise(one % ("WebPage", "W"))
    other = one.replace("schema.org", "other.org") % ("ReportageNewsArticle", "no")
    listed = F.concat(F.lit(f'[{one % ("WebPage", "x")},{other},'), kind, F.lit("]"))
    mark = '<script type="application/ld+json">'
    script = F.concat(F.lit(f"{mark}{other}</script>{mark}"), F.when(F.col("page_id") % 2 == 0, listed).otherwise(kind), F.lit("</script>"))
    return marked(spark, d, F.concat(script, F.col("html"))).select("page_id", H.json_ld(F.col("nodes")).alias("json"))


#: SQL of the words of a title (h1) without the page's registered domain, wherever and in whatever case it stands.
BARE_WORDS = "list_filter(string_split(regexp_replace(h1, regexp_escape(domain), '', 'gi'), ' '), lambda x: x <> '')"
#: SQL of a page's title: its h1, else its title element; NULL where both are blank.
H1 = f"""coalesce(nullif({plain("regexp_extract(html, '<h1>([^<]*)</h1>', 1)")}, ''), nullif({plain("regexp_extract(html, '<title>([^<]*)</title>', 1)")}, ''))"""


@query(f"""WITH t AS (SELECT page_id, {DOMAIN} AS domain, {H1} AS h1 FROM pages),
w AS (SELECT *, list_filter({BARE_WORDS}, lambda x, i: NOT (i = 1 AND x IN ('|', '-', '»', ':'))) AS words FROM t)
SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'Story ' || page_id || ' | ' || domain ELSE h1 END AS raw_title,
CASE WHEN page_id % 3 = 0 THEN 'Story ' || page_id ELSE array_to_string(CASE WHEN words[-1] IN ('|', '-', '»', ':') THEN words[:-2] ELSE words END, ' ') END AS title FROM w""")
def h9_title(spark, d):
    other = F.regexp_extract("url", r"://[^/?#]*?([^./?#]+\.[^./?#]+)(?:[/?#]|$)", 1)
    story = F.concat(ident('<meta property="og:title" content="Story {} | '), other, F.lit('">'))
    rows = marked(spark, d, F.concat(F.when(F.col("page_id") % 3 == 0, story).otherwise(""), F.col("html")))
    raw = H.raw_title(F.col("nodes"), F.col("url"))
    return rows.select("page_id", raw.alias("raw_title"), H.clean_title(raw, F.col("nodes"), F.col("url")).alias("title"))


@query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'A' || page_id % 1000 WHEN 1 THEN 'Src' || page_id ELSE NULL END AS author FROM pages")
def h10_author(spark, d):
    small = F.concat(F.lit("A"), (F.col("page_id") % 1000).cast("string"))
    by_mark = F.concat(F.lit('<b itemprop="author">Jo Lindt</b><b itemprop="author">'), small, F.lit("</b>"))
    mark = F.when(
        F.col("page_id") % 3 == 0, F.concat(by_mark, F.lit("<i> 来源：Other</i>"))
    ).when(F.col("page_id") % 3 == 1, ident("<i> 来源：Src{}</i>")).otherwise("")
    rows = marked(spark, d, F.concat(F.col("html"), mark))
    return rows.select("page_id", H.item_author(H.authors(F.col("nodes"), F.col("html"), F.col("url"))).alias("author"))


@query("SELECT page_id, 978307200 + 86400 * (page_id % 300) AS pubtime FROM pages")
def h11_publish_time(spark, d):
    stamped = F.concat(
        F.lit('<meta property="article:published_time" content="'),
        F.date_format(F.timestamp_seconds(978307200 + 86400 * (F.col("page_id") % 300)), "yyyy-MM-dd"), F.lit('">'), F.col("html")
    )
    rows = table(spark, d, "pages").withColumn("html", stamped).withColumn("nodes", html_nodes("html"))
    return rows.select("page_id", H.publish_time(F.col("nodes"), F.col("html"), F.col("url"), NOW).alias("pubtime"))


@query(
    """SELECT page_id, 0 AS scripts, (page_id % 2)::INT AS navs, (page_id % 2 * len(regexp_extract_all(html, '<li>')))::INT AS items FROM pages"""
)
def h12_clean(spark, d):
    kind = F.when(F.col("page_id") % 2 == 0, '<nav class="navbar">').otherwise('<nav class="main">')
    clean = H.clean_nodes(F.col("nodes"))
    rows = marked(spark, d, F.replace("html", F.lit("<nav>"), kind))
    return rows.select(
        "page_id", F.size(tags(clean, "script", "style")).alias("scripts"), F.size(tags(clean, "nav")).alias("navs"),
        F.size(tags(clean, "li")).alias("items")
    )


@query(
    "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN false WHEN l_quantity::INT % 10 = 0 THEN true ELSE (l_quantity::INT % 7)::DOUBLE / (l_quantity::INT % 10) * (l_linenumber - 1) >= 1.0 END AS dense FROM lineitem"
)
def h13_link_density(spark, d):
    q = F.col("l_quantity").cast("int")
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber",
        H.link_density((q % 10).cast("double"), (q % 7).cast("double"), F.col("l_linenumber") - 1).alias("dense")
    )


SCORES = f"""(WITH s AS (SELECT *, {STOPS} AS stops FROM {PARAGRAPHS}),
n AS (SELECT *, coalesce(max(stops) OVER (PARTITION BY page_id ORDER BY i ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 0) > 5 AS boosted FROM s),
g AS (SELECT *, row_number() OVER w - 1 AS nth, count(*) OVER (PARTITION BY page_id) AS total, sum(boosted::INT) OVER w AS k FROM n WHERE stops > 2 WINDOW w AS (PARTITION BY page_id ORDER BY i)),
u AS (SELECT page_id, trunc(stops + CASE WHEN total > 15 AND total - nth <= 0.25 * total THEN CASE WHEN (0.25 * total - (total - nth)) ** 2 > 40 THEN 5.0 ELSE -((0.25 * total - (total - nth)) ** 2) END WHEN boosted THEN 50.0 / k ELSE 0.0 END)::INT AS up FROM g)
SELECT page_id, sum(up)::INT AS own, sum(trunc(up / 2.0))::INT AS half FROM u GROUP BY page_id)"""


@query(f"""SELECT page_id, CASE WHEN page_id % 2 = 1 THEN {order_of("article")} WHEN own > half THEN {order_of("article")} ELSE CASE WHEN half IS NOT NULL THEN {order_of("body")} END END AS top_order, greatest(own, half) AS score
FROM pages LEFT JOIN {SCORES} USING (page_id)""")
def h14_best_node(spark, d):
    """Every other page without its known container, whose node must then be found by its score."""
    bare = F.replace(F.replace("html", F.lit("<article>"), F.lit("<div>")), F.lit("</article>"), F.lit("</div>"))
    rows = marked(spark, d, F.when(F.col("page_id") % 2 == 0, bare).otherwise(F.col("html")))
    return H.best_nodes(rows)


@query(f"""SELECT page_id, CASE WHEN page_id % 2 = 0 THEN {order_of("article")} ELSE {order_of("body")} + 1 END AS container FROM pages""")
def h15_known_container(spark, d):
    body = F.when(F.col("page_id") % 2 == 1, '<body><div itemprop="articleBody">x</div>').otherwise("<body>")
    rows = marked(spark, d, F.replace("html", F.lit("<body>"), body))
    return rows.select("page_id", H.known_container(F.col("nodes"), F.col("url")).alias("container"))


SAID = "the of and to in"


@query(f"""WITH s AS (SELECT *, {STOPS} AS stops FROM {PARAGRAPHS}), m AS (SELECT page_id, floor(avg(stops) FILTER (stops > 2)) AS mean FROM s GROUP BY page_id),
c AS (SELECT page_id, {STOPS} AS stops FROM (SELECT page_id, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang, '{SAID}' AS text FROM pages))
SELECT page_id, CASE WHEN c.stops > coalesce(mean, 100000) * 0.30 THEN '{SAID}|' ELSE '' END || 'Lead ' || page_id AS recovered FROM c LEFT JOIN m USING (page_id)""")
def h16_siblings(spark, d):
    """A block of a paragraph, one of a link and a paragraph before the article, which is made a plain block."""
    before = ident(f'<div><p>{SAID}</p></div><div><p><a href="/z">{SAID}</a></p></div><p>Lead {{}}</p><div id="main">')
    rows = marked(spark, d, F.replace("html", F.lit("<article>"), before))
    n = F.col("nodes")
    top = F.get(F.filter(n, lambda x: attr(x, "id") == "main"), 0)["order"]
    return rows.select("page_id", F.array_join(H.sibling_text(n, top), "|").alias("recovered"))


@query(f"SELECT page_id, content FROM {LAID_OUT}")
def h17_article_text(spark, d):
    """Seven layouts; a block of links and a table without paragraphs inside an article with other text are no content."""
    chaff = '<article><div><p><a href="/q">more</a></p></div><table><tr><td>1</td></tr></table>'
    mixed = (F.col("page_id") % 7).isin(0, 3, 4, 5)
    rows = marked(
        spark, d, F.replace(laid_out(F.col("html")), F.lit("<article>"), F.when(mixed, chaff).otherwise("<article>"))
    ).withColumn("top", H.known_container(F.col("nodes"), F.col("url")))
    return rows.select("page_id", F.nullif(H.article_text(F.col("nodes"), F.col("top")), F.lit("")).alias("content"))


@query("SELECT page_id, (2 + (page_id % 3 > 0)::INT) AS n_tags FROM pages")
def h18_tags(spark, d):
    more = F.when(F.col("page_id") % 3 == 0, '<a rel="tag" href="/w">two</a>').otherwise(ident('<a rel="tag" href="/w">t{}</a>'))
    tagged = F.concat(
        F.col("html"), F.lit('<a rel="tag" href="/x">one</a><a rel="tag" href="/y">two</a><a rel="tag" href="/z">one</a>'), more
    )
    return marked(spark, d, tagged).select("page_id", F.size(H.tag_texts(F.col("nodes"))).alias("n_tags"))


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN '/in/' || page_id ELSE '/in/' || page_id || ',/more' END AS links FROM pages")
def h19_content_links(spark, d):
    inner = F.concat(
        ident('<article><a href="/in/{}">x</a>'), F.when(F.col("page_id") % 2 == 1, '<p><a href="/more">y</a></p>').otherwise("")
    )
    rows = marked(spark, d, F.replace("html", F.lit("<article>"), inner)).withColumn("top", H.known_container(F.col("nodes"), F.col("url")))
    return rows.select("page_id", F.array_join(H.content_links(F.col("nodes"), F.col("top")), ",").alias("links"))


@query("""SELECT page_id, 1 + (page_id % 2)::INT AS tweets, CASE WHEN page_id % 2 = 0 THEN 'youtube' ELSE 'vimeo' END AS provider, (300 + page_id % 500)::INT AS width, '360' AS height,
'https://www.' || CASE WHEN page_id % 2 = 0 THEN 'youtube' ELSE 'vimeo' END || '.com/e/' || page_id AS src FROM pages""")
def h20_embeds(spark, d):
    odd = F.col("page_id") % 2 == 1
    tweet = F.when(
        odd, '<blockquote class="twitter-tweet">a</blockquote><blockquote class="twitter-tweet">b</blockquote>'
    ).otherwise('<blockquote class="twitter-tweet">hi</blockquote>')
    frame = F.concat(
        F.lit('<iframe src="https://www.'), F.when(odd, "vimeo").otherwise("youtube"), ident('.com/e/{}" width="'),
        (300 + F.col("page_id") % 500).cast("string"), F.lit('" height="360"></iframe>')
    )
    rows = marked(spark, d, F.concat(F.col("html"), tweet, F.lit('<iframe src="https://x.test/"></iframe>'), frame))
    found = rows.select("page_id", F.size(H.tweets(F.col("nodes"))).alias("tweets"), F.get(H.videos(F.col("nodes")), 0).alias("v"))
    return found.select("page_id", "tweets", "v.provider", "v.width", F.col("v.height").cast("string").alias("height"), "v.src")


@query("SELECT page_id, '/i/' || page_id || '.png' AS image FROM pages")
def h21_image(spark, d):
    marked = F.concat(
        F.lit('<img src="/ads/1.png"><img src="/i/'), F.col("page_id").cast("string"), F.lit('.png">'),
        F.regexp_replace("html", "<img[^>]*>", "")
    )
    return table(spark, d, "pages").select("page_id", H.image(html_nodes(marked)).alias("image"))


@query(f"""SELECT page_id, {ORIGIN} || '/top/' || page_id || '.pdf' AS file FROM pages
UNION ALL SELECT page_id, regexp_replace({ORIGIN} || {PATH}, '[^/]*$', '') || 'near/' || page_id || '.docx' FROM pages WHERE page_id % 2 = 0""")
def h22_attachments(spark, d):
    near = F.when(
        F.col("page_id") % 2 == 0, ident('<a class="att" href="near/{}.docx">n</a>')
    ).otherwise('<a class="att" href="page.html">n</a>')
    rows = marked(spark, d, F.concat(F.col("html"), ident('<a class="att" href="/top/{}.pdf">t</a><a href="/other.pdf">o</a>'), near))
    links = J.custom_match("@css:a.att", F.col("html"), F.col("url"), "href", F.col("nodes"))
    return H.attachments(rows, links).select("page_id", "file")


@query("SELECT page_id, lower(regexp_extract(html, '<meta charset=\"([^\"]*)\"', 1)) AS charset, md5(html) AS digest FROM pages")
def h23_charset(spark, d):
    return table(spark, d, "pages").select(
        "page_id", H.declared_charset(F.col("html")).alias("charset"), F.md5(decode_page(F.encode("html", "utf-8"))).alias("digest")
    )


@query("SELECT page_id, contains(url, '/en/') OR contains(html, 'class=\"ad\"') AS blocked FROM pages")
def h24_blocked(spark, d):
    return nodes(spark, d).select("page_id", H.blocked(F.col("url"), F.col("nodes"), "/en/[*]", ("class", "^ad$")).alias("blocked"))


@query("""SELECT event_id, k, '[' || k || ',' || k || ']' AS deep, CASE WHEN k::INT >= 50 THEN k END AS big, '[' || (event_id + 1) || ',' || (event_id + 2) || ']' AS tail,
'<' || k || '>' AS mark FROM (SELECT event_id, json_extract_string(props, '$.k') AS k FROM events)""")
def j1_json_rule(spark, d):
    """A row rule, recursive descent, a filter, a slice, and a selector inside a value."""
    k = F.get_json_object("props", "$.k")
    body = F.concat(
        F.lit('cb({"data":['), F.col("props"), F.lit('],"x":{"y":['), F.col("props"), F.lit(']},"n":['),
        F.concat_ws(",", F.col("event_id"), F.col("event_id") + 1, F.col("event_id") + 2), F.lit('],"html":["<i>no</i><b class=k>&lt;'), k, F.lit('></b>"]})')
    )
    wrapped = table(spark, d, "events").select("event_id", body.alias("body"))
    inner = J.unwrap_jsonp(F.col("body"))
    paths = {"deep": "$..k", "big": "$.data[?(@.k>=50)].k", "tail": "$.n[1:]"}
    rows = wrapped.withColumns({name: J.json_path(inner, path) for name, path in paths.items()})
    marked_ = J.json_rule(wrapped, "body", {"filter": "$.html", "item": {"mark": "@css:b.k"}}).select("event_id", "mark")
    keys = J.json_rule(rows, "body", {"filter": "$.data", "item": {"k": "$.k"}})
    return keys.join(marked_, "event_id").select("event_id", "k", *paths, "mark")


@query(
    "SELECT page_id, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title, len(regexp_extract_all(html, '<p>'))::INT AS paragraphs FROM pages"
)
def j2_regex_rule(spark, d):
    h = F.col("html")
    return table(spark, d, "pages").select(
        "page_id", J.regex_rule(h, "@reg:<title>[t]</title>").alias("title"),
        F.size(J.regex_rule(h, "@reg:<p>", many=True)).alias("paragraphs")
    )


SECOND = f"{plain(TITLES + '[2]')}"


@query(
    f"""SELECT page_id, len(regexp_extract_all(html, '<li><a href="[^"]*"'))::INT AS items, nullif({SECOND}, '') AS second, {LINKS}[-1] AS last, {plain("regexp_extract(html, '<h1>([^<]*)</h1>', 1)")} AS heading, len(list_filter({LINKS}, lambda x: starts_with(x, '/') AND NOT (contains(x, 'a') OR x = '/the')))::INT AS some,
coalesce({SECOND} <> '', false) AS has_next FROM pages"""
)
def j3_xpath_rule(spark, d):
    def rule(path):
        return J.custom_match(path, F.col("html"), F.col("url"), nodes=F.col("nodes"))

    return nodes(spark, d).select(
        "page_id", F.size(rule("@xpath://nav/ul/li/a/@href")).alias("items"), F.get(rule("//nav/ul/li[2]/a/text()"), 0).alias("second"),
        F.get(rule("/html/body/nav//li[last()]/a/@href"), 0).alias("last"), F.get(rule("//article/h1"), 0).alias("heading"),
        F.size(rule("//a[starts-with(@href,'/') and not(contains(@href,'a') or @href='/the')]/@href")).alias("some"),
        (F.size(rule("//li[1]/following-sibling::li[1]/a[.!='']")) > 0).alias("has_next"),
    )


@query(f"""SELECT page_id, {LINKS}[1] AS first, {SECOND} AS second, {LINKS}[-1] AS last, 1 + len({LINKS})::INT AS either,
regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS source, greatest(len({LINKS}) - 2, 0)::INT AS later, CASE WHEN len({LINKS}) > 0 THEN {LINKS}[1] END AS matched FROM pages""")
def j4_css_rule(spark, d):
    def rule(path, target="text"):
        return J.custom_match(path, F.col("html"), F.col("url"), target, F.col("nodes"))

    return nodes(spark, d).select(
        "page_id", F.get(
            rule("@css:nav > ul > li:eq(0) a", "href"), 0
        ).alias("first"), F.get(rule("@css:nav li:eq(1) > a"), 0).alias("second"),
        F.get(rule("@css:ul a[href]:last", "href"), 0).alias("last"), F.size(rule("@css:div.ad, nav a")).alias("either"),
        F.get(rule("@css:article > h1:not(.x):first-child", "html"), 0).alias("source"), F.size(rule("@css:li:nth-child(n+2) + li > a")).alias("later"),
        F.get(J.rule_values({"filter": "@css:li a", "eq": 0, "match": '<a href="([^"]*)"'}, F.col("html"), F.col("url"), F.col("nodes")), 0).alias("matched"),
    )


@query("SELECT page_id, 'news' AS channel, regexp_extract(url, 'example\\.([a-z]+)/', 1) AS top FROM pages")
def j5_constant_and_url(spark, d):
    return table(spark, d, "pages").select(
        "page_id", F.get(J.custom_match("@value:news", F.col("html"), F.col("url")), 0).alias("channel"),
        F.get(J.custom_match("@url:example.[top]/", F.col("html"), F.col("url")), 0).alias("top")
    )


@query(
    "SELECT c_custkey, 'id-' || regexp_extract(c_name, '#0*([0-9]+)', 1) || '!' AS patched FROM customer WHERE regexp_matches(c_name, '#0*[0-9]')"
)
def j6_post_process(spark, d):
    return table(spark, d, "customer").where(F.regexp_like("c_name", F.lit("#0*[0-9]"))).select(
        "c_custkey", J.post_process(F.col("c_name"), {"extract": "#[r=z]0*[/r][r=n][0-9]+[/r]", "patch": "[x]"}).alias("zeros"),
        J.post_process(F.regexp_extract("c_name", "#0*([0-9]+)", 1), {"patch": "id-[x]!"}).alias("patched")
    ).drop("zeros")


@query("""WITH o AS (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS a, list(o_orderstatus ORDER BY o_orderkey)[1:2] AS b FROM orders GROUP BY o_custkey)
SELECT o_custkey, unnest(a) AS k, unnest(list_transform(range(1, len(a) + 1), lambda i: coalesce(b[i], b[-1]))) AS s FROM o""")
def j7_columns_to_rows(spark, d):
    grouped = table(spark, d, "orders").groupBy("o_custkey").agg(
        F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))).alias("x")
    )
    rows = J.columns_to_rows(
        {"k": F.transform("x", lambda v: v["o_orderkey"]), "s": F.slice(F.transform("x", lambda v: v["o_orderstatus"]), 1, 2)}, extend=True
    )
    return grouped.select("o_custkey", F.explode(rows).alias("r")).select("o_custkey", "r.k", "r.s")


@query("SELECT page_id, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS raw, 'x' AS kind FROM pages")
def j8_custom_rules(spark, d):
    rules = {"raw": {"filter": "@reg:<title>[t]</title>"}, "kind": {"filter": "@value:x"}}
    return J.custom_rules(table(spark, d, "pages"), rules).select("page_id", "raw", "kind")


RULES = "(VALUES (1, 'example.com', '', '/en/', 1), (2, 'example.com', '', '/de/', 1), (3, 'example.net', '', NULL, 1), (4, 'example.com', NULL, '/fr/', 0), (5, 'example.org', 'www.ththen.example.org', NULL, 1), (6, 'example.org', '', NULL, 1)) r(uuid, domain, subdomain, pattern, status)"


def detail_rules(spark) -> DataFrame:
    return spark.sql(
        f"SELECT CAST(uuid AS LONG) uuid, domain, subdomain, pattern, status FROM {RULES.removeprefix('(').replace(') r(', ' AS r(')}"
    )


@query(f"""WITH u AS (SELECT page_id, url, {DOMAIN} AS d, CASE WHEN {SUB} = '' THEN 'www' ELSE {SUB} END || '.' || {DOMAIN} AS s FROM pages),
c AS (SELECT page_id, uuid, row_number() OVER (PARTITION BY page_id ORDER BY CASE WHEN subdomain = s THEN 0 ELSE 1 END, NOT coalesce(regexp_matches(url, pattern), false), uuid) AS k FROM u JOIN {RULES} ON d = domain AND status = 1 AND (coalesce(subdomain, '') = '' OR subdomain = s))
SELECT u.page_id, uuid::BIGINT AS rule_id FROM u LEFT JOIN c ON u.page_id = c.page_id AND k = 1""")
def j9_match_detail_rule(spark, d):
    return J.match_detail_rules(
        table(spark, d, "pages").select("page_id", "url"), detail_rules(spark), "page_id"
    ).select("page_id", "rule_id")


@query(
    f"""SELECT page_id, coalesce({DOMAIN} = domain AND coalesce(CASE WHEN {SUB} = '' THEN 'www' ELSE {SUB} END || '.' || {DOMAIN} = nullif(subdomain, ''), true) AND coalesce(regexp_matches(url, pattern), true), false) AS rule_ok FROM pages JOIN {RULES} ON uuid = 1 + page_id % 6"""
)
def j10_check_rule(spark, d):
    rows = table(spark, d, "pages").select("page_id", "url", (1 + F.col("page_id") % 6).alias("rule_id"))
    return J.check_rule(rows, detail_rules(spark)).select("page_id", "rule_ok")


@query(
    f"""SELECT page_id, CASE WHEN CASE WHEN {SUB} = '' THEN 'www' ELSE {SUB} END || '.' || {DOMAIN} = 'www.ththen.example.com' THEN 7 WHEN {DOMAIN} = 'example.com' THEN 1 WHEN {DOMAIN} = 'example.net' THEN 2 ELSE 99 END AS "mediaType" FROM pages"""
)
def j11_media_type(spark, d):
    types = spark.sql(
        "SELECT * FROM VALUES ('example.com', '', 1), ('example.net', NULL, 2), ('example.com', 'www.ththen.example.com', 7) AS t(domain, subdomain, mediaType)"
    )
    return J.media_types(table(spark, d, "pages").select("page_id", "url"), types).select("page_id", "mediaType")


@query(f"""WITH t AS (SELECT page_id, url, {DOMAIN} AS domain, {H1} AS h1 FROM pages),
w AS (SELECT *, list_filter({BARE_WORDS}, lambda x, i: NOT (i = 1 AND x IN ('|', '-', '»', ':'))) AS words FROM t)
SELECT page_id, url, array_to_string(CASE WHEN words[-1] IN ('|', '-', '»', ':') THEN words[:-2] ELSE words END, ' ') AS title, 'A' || page_id AS author, 978307200 + 86400 * (page_id % 300) AS pubtime, coalesce(content, '') AS content FROM w LEFT JOIN {LAID_OUT} USING (page_id)""")
def j12_item_parser(spark, d):
    """Articles of seven layouts.  The date stands beside the content node, an earlier one elsewhere in the page."""
    day = F.date_format(F.timestamp_seconds(978307200 + 86400 * (F.col("page_id") % 300)), "yyyy-MM-dd")
    mark = F.concat(F.lit("<div><i>发布时间："), day, F.lit(" 00:00 </i>"), ident('<b itemprop="author">A{}</b><article>'))
    page = F.replace(F.replace(laid_out(F.col("html")), F.lit("<article>"), mark), F.lit("</article>"), F.lit("</article></div>"))
    page = F.replace(page, F.lit("<nav>"), F.lit("<nav><i>发布时间：1999-01-02 00:00 </i>"))
    return J.parse_items(spread(table(spark, d, "pages")).withColumn("html", page), NOW)


@query(
    f"""SELECT page_id, pos, title, url FROM (SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1)::INT AS pos, href, {plain("raw")} AS title, {ORIGIN} || href AS url FROM {ANCHORS} WHERE href <> '' AND NOT contains(href, '#')) WHERE href <> '/'"""
)
def j13_list_parser(spark, d):
    return J.parse_lists(table(spark, d, "pages"))
