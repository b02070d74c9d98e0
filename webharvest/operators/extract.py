"""Page extraction over node arrays: links, metadata, title, author, dates, content.

`nodes` is a column made once a page by functions.nodes.html_nodes; everything here is a Column expression over
it, or a DataFrame function where the result is rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import times, urls
from ..functions.nodes import attr, by_attr, tags
from ..functions.patterns import preg

# Title splitters, meta author marks, publish date marks, article containers, by-domain rules, tag links, bad image names.
TITLE_SPLITTERS = ("|", "-", "»", ":")
AUTHOR_MARKS = (("itemprop", "author", "text"), ("itemprop", "publisher", "text"), ("property", "article:author", "content"))
AUTHOR_PATTERN = r"[>\x20]\x20*（?来源\x20*[：:]\x20*(?:<[^>]+>)?([^<>\s）&]+)）?"
DATE_MARKS = (
    ("property", "rnews:datePublished", "content"), ("property", "article:published_time", "content"),
    ("name", "OriginalPublicationDate", "content"), ("itemprop", "datePublished", "datetime"),
    ("name", "published_time_telegram", "content")
)
CONTAINERS = (("class", "short-story"), ("itemprop", "articleBody"), ("class", "post-content"), ("class", "g-content"))
CONTAINERS_BY_DOMAIN = {
    "qq.com": ("class", "content-article"), "sina.com.cn": ("id", "article"), "ifeng.com": ("id", "yc_con_txt"),
    "163.com": ("class", "post_text")
}
TITLE_SCRIPTS = {"mp.weixin.qq.com": r'var\s+msg_title\s*=\s*"([^"]+)";', "toutiao.com": r"title:\s+(?:'|\")([^'\"]+)(?:'|\").*"}
AUTHOR_SCRIPTS = {
    "qq.com": r'"media"\s*:\s*"([^"]+)"', "mp.weixin.qq.com": r'var\s+nickname\s*=\s*"([^"]+)";',
    "toutiao.com": r"source:\s+(?:'|\")([^'\"]+)(?:'|\").*"
}
TAG_LINKS = r"/tag/|/tags/|/topic/|\?keyword="
#: Children of a content node that are never chaff.
KEPT_CHILDREN = ("p", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6")
#: Children that are part of the text around them, and elements whose own text is not written out.
INLINE = tuple(
    "a abbr b bdi bdo big br cite code del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split()
)
UNWRITTEN = tuple("button h1 head iframe object option script select style textarea title".split())
ATTACHMENT = r"(?i)\.(?:pdf|docx?|xlsx?|pptx?|zip|rar|7z)(?:$|[?#])"
VIDEO_HOSTS = ("youtube", "vimeo", "dailymotion", "kewego")
BAD_IMAGES = r"\.html|\.gif|\.ico|button|twitter\.jpg|facebook\.jpg|ap_buy_photo|digg\.jpg|digg\.png|delicious\.png|facebook\.png|reddit\.jpg|doubleclick|diggthis|diggThis|adserver|/ads/|ec\.atdmt\.com|mediaplex\.com|adsatt|view\.atdmt"


# ---- links ---------------------------------------------------------------------------------------------------


def page_links(pages: DataFrame, page: str = "page_id", url: str = "url", nodes: str = "nodes") -> DataFrame:
    """(page, page_url, pos, link, title): links of each page, resolved, the first of equal ones kept; found inside the page's row."""
    anchors = F.filter(
        tags(F.col(nodes), "a"), lambda n: urls.usable_link(attr(n, "href")) & ~F.startswith(F.trim(attr(n, "href")), F.lit("#"))
    )
    raw = F.transform(anchors, lambda n: F.struct(n["order"].alias("pos"), F.trim(attr(n, "href")).alias("href"), n["text"].alias("title")))
    rows = pages.select(page, F.col(url).alias("page_url"), raw.alias("_raw"))
    rows = rows.withColumn("_links", urls.first_links(F.col("page_url"), F.col("_raw.href")))
    each = F.filter(
        F.zip_with(
            "_raw", "_links", lambda a, link: F.struct(a["pos"].alias("pos"), link.alias("link"), a["title"].alias("title"))
        ), lambda x: x["link"].isNotNull()
    )
    return rows.select(page, "page_url", F.inline(each))


def link_class(link: Column, page_url: Column) -> tuple[Column, Column]:
    """(same_subdomain, same_domain) of a link; if the page's host has no subdomain, links of its domain count as both."""
    domain = urls.domain(page_url)
    same_domain = F.coalesce(urls.domain(link) == domain, F.lit(False))
    same_host = F.coalesce(urls.host(link) == urls.host(page_url), F.lit(False))
    bare = F.coalesce(urls.subdomain(page_url) == "", F.lit(False))
    return same_host | (bare & same_domain), same_domain


def subdomain_sites(links: DataFrame, page: str = "page_id") -> DataFrame:
    """(page, link, title): links of the page's own subdomain, and one for each other subdomain of its domain.

    A subdomain's title is that of its last root-page link, else of its first link.  The links are read once: those of the
    own subdomain go through the same grouping, each with all its titles.
    """
    same_host, same_domain = link_class(F.col("link"), F.col("page_url"))
    rows = links.withColumns({"_host": same_host, "_domain": same_domain}).where("_host or _domain")
    label = F.regexp_extract(urls.subdomain(F.col("link")), r"([^.]+)$", 1)
    root = F.regexp_like("link", F.lit(r"^[^:]+://[^/?#]+/?$"))
    site = F.concat(
        F.regexp_extract("link", r"^([^:]+://)", 1), label, F.when(label != "", F.lit(".")).otherwise(F.lit("")), urls.domain(F.col("link"))
    )
    rolled = rows.groupBy(page, "_host", F.when(F.col("_host"), F.col("link")).otherwise(site).alias("link")).agg(
        F.collect_list(F.when(F.col("_host"), F.struct("title"))).alias("_own"),
        F.coalesce(F.max_by("title", F.when(root, F.col("pos"))), F.min_by("title", "pos")).alias("_title")
    )
    return rolled.select(page, "link", F.explode(F.when(F.col("_host"), F.col("_own.title")).otherwise(F.array("_title"))).alias("title"))


def list_links(nodes: Column, base: Column) -> Column:
    """Article links of a list page, array of struct(title, url): the first detail pattern that any link matches supplies all; else all plain links."""
    anchors = F.filter(tags(nodes, "a"), lambda n: attr(n, "href").isNotNull())
    plain = F.filter(
        anchors,
        lambda n: ~F.regexp_like(
            attr(n, "href"), F.lit(r"^\s*javascript.*")
        ) & ~F.contains(attr(n, "href"), F.lit("#")) & (F.trim(attr(n, "href")) != "")
    )
    out = plain
    for pattern in reversed(urls.DETAIL_PATTERNS):
        hits = by_attr(anchors, "href", pattern, "a")
        out = F.when(F.size(hits) > 0, hits).otherwise(out)
    return F.transform(out, lambda n: F.struct(n["text"].alias("title"), attr(n, "href").alias("url")))


# ---- metadata ------------------------------------------------------------------------------------------------


def meta_content(nodes: Column, name: str, key: str = "name") -> Column:
    """content of the first meta whose name (or property) is the given one, trimmed; NULL if none."""
    hits = F.filter(tags(nodes, "meta"), lambda n: F.lower(attr(n, key)) == name.lower())
    return F.trim(attr(F.get(hits, 0), "content"))


def first_text(nodes: Column, *names: str) -> Column:
    return F.nullif(F.get(tags(nodes, *names), 0)["text"], F.lit(""))


def page_language(nodes: Column) -> Column:
    """Two letters of the language that a page names, lower case; NULL if it names none."""
    header = F.filter(tags(nodes, "meta"), lambda n: F.lower(attr(n, "http-equiv")) == "content-language")
    named = F.coalesce(
        F.nullif(attr(F.get(tags(nodes, "html"), 0), "lang"), F.lit("")), attr(F.get(header, 0), "content"), meta_content(nodes, "lang")
    )
    return F.lower(F.substring(named, 1, 2))


def metas(nodes: Column, url: Column) -> Column:
    """struct(description, keywords, lang, favicon, canonical, domain, encoding)."""
    favicon = attr(F.get(F.filter(tags(nodes, "link"), lambda n: F.regexp_like(attr(n, "rel"), F.lit("(?i)icon"))), 0), "href")
    canonical = attr(F.get(F.filter(tags(nodes, "link"), lambda n: F.lower(attr(n, "rel")) == "canonical"), 0), "href")
    charset = F.coalesce(
        attr(F.get(F.filter(tags(nodes, "meta"), lambda n: attr(n, "charset").isNotNull()), 0), "charset"),
        F.nullif(
            F.regexp_extract(
                attr(
                    F.get(F.filter(tags(nodes, "meta"), lambda n: F.regexp_like(attr(n, "content"), F.lit("(?i)charset="))), 0), "content"
                ),
                r"(?i)charset=([\w-]+)", 1
            ),
            F.lit("")
        )
    )
    return F.struct(
        meta_content(nodes, "description").alias("description"), meta_content(nodes, "keywords").alias("keywords"), page_language(nodes).alias("lang"), favicon.alias("favicon"),
        F.coalesce(urls.urljoin(url, canonical), url).alias("canonical"), urls.host(url).alias("domain"), F.lower(charset).alias("encoding"),
    )


def open_graph(nodes: Column) -> Column:
    """map of og:* and of <type>:* for the first og:type; the last value of a repeated key."""
    kind = meta_content(nodes, "og:type", "property")
    hits = F.filter(
        tags(nodes, "meta"),
        lambda n: F.coalesce(
            F.startswith(attr(n, "property"), F.lit("og:")) | F.startswith(attr(n, "property"), F.concat(kind, F.lit(":"))), F.lit(False)
        ) & attr(n, "content").isNotNull()
    )
    entries = F.transform(
        hits, lambda n: F.struct(F.regexp_replace(attr(n, "property"), "^og:", "").alias("k"), attr(n, "content").alias("v"))
    )
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["k"] == e["k"]))
    return F.map_from_entries(last)


def json_ld(nodes: Column, kind: str = "ReportageNewsArticle") -> Column:
    """JSON text of the first ld+json object of the given @type in schema.org's @context; NULL if none or unreadable.  A script may hold one or an array of them."""
    scripts = F.transform(F.filter(tags(nodes, "script"), lambda n: attr(n, "type") == "application/ld+json"), lambda n: n["text"])
    objects = F.flatten(
        F.transform(
            scripts, lambda text: F.when(
                F.startswith(text, F.lit("[")),
                F.coalesce(F.transform(F.from_json(text, "array<variant>"), lambda v: F.to_json(v)), F.array().cast("array<string>"))
            ).otherwise(F.array(text))
        )
    )
    return F.get(
        F.filter(
            objects, lambda o: (F.get_json_object(o, "$.@type") == kind) &
            F.regexp_like(F.get_json_object(o, "$.@context"), F.lit(r"^https?://schema\.org/?$"))
        ), 0
    )


# ---- title, author, date -----------------------------------------------------------------------------------


def _script_match(nodes: Column, url: Column, patterns: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for host, pattern in patterns.items():
        hits = F.filter(F.transform(tags(nodes, "script"), lambda n: F.regexp_extract(n["text"], pattern, 1)), lambda s: s != "")
        out = F.when(urls.from_any_domain(url, [host]), F.get(hits, 0)).otherwise(out)
    return out


def raw_title(nodes: Column, url: Column, rule: Column | None = None) -> Column:
    singles = None
    for h in ("h1", "h2", "h3", "h4", "h5", "h6"):
        n = F.size(tags(nodes, h))
        step = F.when(n > 1, F.lit(None).cast("string")).when(n == 1, first_text(nodes, h))
        singles = F.when(n > 0, step) if singles is None else singles.when(n > 0, step)
    parts = [
        _script_match(nodes, url, TITLE_SCRIPTS), _og(nodes, "title"), F.get_json_object(json_ld(nodes), "$.headline"),
        meta_content(nodes, "headline"), singles, first_text(nodes, "title")
    ]
    return F.coalesce(*([F.nullif(rule, F.lit(""))] if rule is not None else []), *parts)


def _og(nodes: Column, key: str) -> Column:
    """The last og:<key> of a page; NULL if none or empty."""
    hits = F.filter(tags(nodes, "meta"), lambda n: attr(n, "property") == "og:" + key)
    return F.nullif(attr(F.try_element_at(hits, F.lit(-1)), "content"), F.lit(""))


def clean_title(title: Column, nodes: Column, url: Column) -> Column:
    """Without site name, domain and splitters at the ends."""
    site = F.coalesce(_og(nodes, "site_name"), F.get_json_object(json_ld(nodes), "$.publisher.name"))
    cut = urls.let(
        F.struct(title.alias("t"), site.alias("s")),
        lambda x: F.when(F.nullif(x["s"], F.lit("")).isNotNull(), F.replace(x["t"], x["s"])).otherwise(x["t"])
    )
    bare = urls.let(
        cut, lambda t: F.coalesce(F.regexp_replace(t, F.concat(F.lit("(?i)\\Q"), urls.domain(url), F.lit("\\E")), F.lit("")), t)
    )
    words = F.filter(F.split(F.trim(bare), r"\s+"), lambda w: w != "")
    words = urls.let(words, lambda w: F.when(F.get(w, 0).isin(*TITLE_SPLITTERS), F.slice(w, 2, F.size(w))).otherwise(w))
    words = urls.let(
        words,
        lambda w: F.when(
            F.try_element_at(w, F.lit(-1)).isin(*TITLE_SPLITTERS), F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0)))
        ).otherwise(w)
    )
    return F.array_join(words, " ")


def authors(nodes: Column, html: Column, url: Column, rule: Column | None = None) -> Column:
    """Author texts: by rule, by script, by marks, by the word for "source"."""
    script = _script_match(nodes, url, AUTHOR_SCRIPTS)
    found = F.array_distinct(F.regexp_extract_all(html, F.lit(AUTHOR_PATTERN), F.lit(1)))
    for name, value, take in reversed(AUTHOR_MARKS):
        hits = by_attr(nodes, name, "^" + value + "$")
        texts = F.filter(
            F.transform(hits, lambda n: n["text"] if take == "text" else attr(n, take)), lambda x: F.coalesce(x, F.lit("")) != ""
        )
        found = F.when(F.size(texts) > 0, texts).otherwise(found)
    found = F.when(script.isNotNull(), F.array(script)).otherwise(found)
    return F.when(F.nullif(rule, F.lit("")).isNotNull(), F.array(rule)).otherwise(found) if rule is not None else found


def item_author(names: Column) -> Column:
    """The shortest; of equal lengths the first."""
    return F.array_min(F.transform(names, lambda x, i: F.struct(F.length(x).alias("n"), i.alias("i"), x.alias("x"))))["x"]


def publish_time(
    nodes: Column, html: Column, url: Column, now: Column | int, rule: Column | None = None, around: Column | None = None
) -> Column:
    """Epoch seconds: by rule, og, JSON-LD, meta marks, a time tag, around the content, the page, the URL."""
    def read(text: Column) -> Column:
        return urls.let(text, lambda t: times.parse_date(F.coalesce(times.find_date(t), t), now))

    marks = [attr(F.get(by_attr(nodes, a, "^" + v + "$"), 0), c) for a, v, c in DATE_MARKS]
    texts = [F.get_json_object(json_ld(nodes), "$.datePublished"), *marks, first_text(nodes, "time")]
    texts = ([rule] if rule is not None else []) + texts
    text = F.coalesce(*[F.nullif(t, F.lit("")) for t in texts])
    found = F.coalesce(*([times.find_date(around)] if around is not None else []), times.find_date(html))
    return F.coalesce(read(text), times.parse_date(found, now), urls.date_from_url(url))


# ---- content -------------------------------------------------------------------------------------------------


def clean_nodes(nodes: Column) -> Column:
    """Nodes without scripts, styles, page furniture and social boxes (whole subtrees)."""
    return F.filter(nodes, lambda n: ~n["junk"])


def link_density(words: Column, link_words: Column, links: Column) -> Column:
    """link words / words * links >= 1; without links false, without words true."""
    return F.when(links == 0, False).when(words == 0, True).otherwise(link_words / words * links >= 1.0)


def content_scores(nodes: Column) -> Column:
    """Scores of content nodes, array of struct(order, score, source), as functions.content finds them; source: the first node that gave to it."""
    return F.transform(
        F.filter(nodes, lambda n: n["score"].isNotNull()),
        lambda n: F.struct(n["order"].alias("order"), n["score"].alias("score"), n["source"].alias("source"))
    )


def best_node(scores: Column) -> Column:
    """struct(score, order) of the highest score, the one whose first giver comes first among equal ones; NULL without scores."""
    best = F.array_max(F.transform(scores, lambda x: F.struct(x["score"], (-x["source"]).alias("early"), (-x["order"]).alias("o"))))
    return urls.let(best, lambda b: F.struct(b["score"].alias("score"), (-b["o"]).alias("order")))


def best_nodes(pages: DataFrame, page: str = "page_id", url: str = "url", nodes: str = "nodes") -> DataFrame:
    """(page, top_order, score): a known article container if there is one, else the node of the highest score, the first of equal ones."""
    known = known_container(F.col(nodes), F.col(url))
    best = best_node(content_scores(F.col(nodes)))
    return pages.select(page, known.alias("known"), best.alias("best")).select(
        page, F.coalesce("known", "best.order").alias("top_order"), F.col("best.score").alias("score")
    )


def known_container(nodes: Column, url: Column) -> Column:
    """Order of the first known article container; NULL if none."""
    clean = clean_nodes(nodes)
    hits = [
        F.when(urls.from_any_domain(url, [d]), F.get(by_attr(clean, a, "^" + v + "$"), 0)["order"]) for d,
        (a, v) in CONTAINERS_BY_DOMAIN.items()
    ]
    hits += [F.get(by_attr(clean, a, "^" + v + "$"), 0)["order"] for a, v in CONTAINERS]
    return F.coalesce(*hits, F.get(tags(clean, "article"), 0)["order"])


def inside(nodes: Column, top: Column) -> Column:
    """The clean nodes below a node, itself included."""
    def below(x: Column) -> Column:
        return F.filter(clean_nodes(nodes), lambda n: (n["order"] >= x["a"]) & (n["order"] <= x["b"]))

    return urls.let(urls.let(top, lambda t: F.struct(t.alias("a"), F.get(nodes, t)["last"].alias("b"))), below)


def _without_chaff(below: Column, top: Column) -> Column:
    """The nodes below a content node (`top`, its order) without those of its children that are no content.

    Text of the content node itself, inline elements, paragraphs, lists and headings stay; another child goes if it
    holds a link, or (but for td) if it holds no paragraph with text or scores under 8 % of the content node.
    """

    def spans(least: Column) -> Column:
        def chaff(n: Column) -> Column:
            weak = ~n["told"] | (F.coalesce(n["score"], F.lit(0)) < least)
            return (n["parent"] == top) & ~n["tag"].isin(*KEPT_CHILDREN, *INLINE) & ((n["links"] > 0) | ((n["tag"] != "td") & weak))

        return F.transform(F.filter(below, chaff), lambda n: F.struct(n["order"].alias("a"), n["last"].alias("b")))

    least = 0.08 * F.coalesce(F.get(below, 0)["score"], F.lit(0))
    return urls.let(
        urls.let(least, spans),
        lambda out: F.when(F.size(out) == 0, below).otherwise(
            F.filter(below, lambda n: ~F.exists(out, lambda s: (n["order"] >= s["a"]) & (n["order"] <= s["b"])))
        )
    )


def _written(below: Column) -> Column:
    """The stretches of text of some nodes in document order, those of list items with a bullet; link-dense ones, h1 and forms dropped."""
    def bulleted(n: Column) -> Column:
        return F.transform(
            F.filter(n["blocks"], lambda b: ~b["dense"]), lambda b: F.struct(
                b["place"].alias("place"), F.when(n["tag"] == "li", F.concat(F.lit("• "), b["text"])).otherwise(b["text"]).alias("text")
            )
        )

    own = F.filter(below, lambda n: (F.size(n["blocks"]) > 0) & ~n["tag"].isin(*UNWRITTEN))
    return F.array_join(F.transform(F.array_sort(F.flatten(F.transform(own, bulleted))), lambda b: b["text"]), "\n\n")


def article_text(nodes: Column, top: Column) -> Column:
    """The text of a content node in document order, its stretches between block boundaries joined by blank lines.

    Every text counts once: of paragraphs, cells, plain blocks, and what stands in the content node itself, also between
    line breaks.  Chaff, link-dense stretches and h1 are dropped, list items get a bullet.  Where nothing is left without the
    chaff, the chaff is the text.
    """

    def text(below: Column) -> Column:
        return urls.let(
            _written(_without_chaff(below, F.get(below, 0)["order"])), lambda t: F.when(t == "", _written(below)).otherwise(t)
        )

    return urls.let(inside(nodes, top), text)


def sibling_text(nodes: Column, top: Column, share: float = 0.30) -> Column:
    """Texts before the content node that belong to it, array in document order.

    Of its earlier siblings, paragraphs with text; and, inside other siblings, paragraphs that are not link-dense
    and whose stopwords exceed `share` of the mean of the content node's own (of those with over two stopwords).
    """

    def base(own: Column) -> Column:
        return urls.let(
            own, lambda k: F.when(F.size(k) > 0, F.floor(F.aggregate(k, F.lit(0), lambda s, v: s + v) / F.size(k))).otherwise(100000)
        )

    def recovered(x: Column) -> Column:
        own = F.filter(
            x["told"], lambda n: (n["order"] >= x["top"]) & (n["order"] <= x["last"]) & ~n["dense"] & (n["stops"] > 2)
        )
        earlier = F.filter(x["told"], lambda n: (n["order"] > x["parent"]) & (n["last"] < x["top"]) & (n["text"] != ""))
        good = urls.let(
            base(F.transform(own, lambda n: n["stops"])),
            lambda m: F.filter(earlier, lambda n: (n["parent"] == x["parent"]) | (~n["dense"] & (n["stops"] > m * share)))
        )
        return F.transform(good, lambda n: n["text"])

    start = urls.let(
        top, lambda t: F.struct(
            t.alias("top"), F.get(nodes, t)["last"].alias("last"), F.get(nodes, t)["parent"].alias("parent"),
            tags(clean_nodes(nodes), "p").alias("told")
        )
    )
    return F.coalesce(urls.let(start, recovered), F.array().cast("array<string>"))


def content(nodes: Column, url: Column) -> Column:
    """struct(top, text): the content node and the article text.

    A known container is taken as it is, without its chaff; else the node of the highest score, with the texts
    recovered before it.
    """
    none = F.array().cast("array<string>")

    def text(x: Column) -> Column:
        own = article_text(nodes, x["top"])
        before = F.when(x["known"], none).otherwise(sibling_text(nodes, x["top"]))
        joined = F.array_join(F.concat(before, urls.let(own, lambda t: F.when(t != "", F.array(t)).otherwise(none))), "\n\n")
        return F.struct(x["top"].alias("top"), F.when(x["top"].isNotNull(), joined).alias("text"))

    start = urls.let(
        known_container(nodes, url), lambda known: F.struct(
            F.coalesce(known, best_node(content_scores(nodes))["order"]).alias("top"), known.isNotNull().alias("known")
        )
    )
    return urls.let(start, text)


def tag_texts(nodes: Column) -> Column:
    """Distinct texts of a[rel=tag], else of links whose address looks like a tag page."""
    def texts(hits: Column) -> Column:
        return F.array_distinct(F.filter(F.transform(hits, lambda n: n["text"]), lambda t: t != ""))

    marked = by_attr(nodes, "rel", "^tag$", "a")
    return F.when(F.size(marked) > 0, texts(marked)).otherwise(texts(by_attr(nodes, "href", TAG_LINKS, "a")))


def content_links(nodes: Column, top: Column) -> Column:
    return F.filter(F.transform(tags(inside(nodes, top), "a"), lambda n: attr(n, "href")), lambda h: h.isNotNull())


def tweets(nodes: Column) -> Column:
    """Texts of embedded tweets."""
    return F.transform(by_attr(nodes, "class", "twitter-tweet"), lambda n: n["text"])


def videos(nodes: Column) -> Column:
    """struct(embed, provider, src, width, height) of embedded videos of known hosts."""
    pattern = "(" + "|".join(VIDEO_HOSTS) + ")"
    frames = F.filter(
        tags(nodes, "iframe", "embed", "object", "video"),
        lambda n: F.regexp_like(F.coalesce(attr(n, "src"), attr(n, "data"), F.lit("")), F.lit(pattern))
    )

    def one(n: Column) -> Column:
        src = F.coalesce(attr(n, "src"), attr(n, "data"))
        return F.struct(
            n["tag"].alias("embed"), F.regexp_extract(src, pattern, 1).alias("provider"), src.alias("src"),
            attr(n, "width").try_cast("int").alias("width"), attr(n, "height").try_cast("int").alias("height")
        )

    return F.transform(frames, one)


def image(nodes: Column) -> Column:
    """Image named by the page: link[rel=image_src], og:image, JSON-LD, else the first picture with a usable name."""
    named = attr(F.get(F.filter(tags(nodes, "link"), lambda n: attr(n, "rel") == "image_src"), 0), "href")
    pictures = F.filter(
        F.transform(tags(nodes, "img"), lambda n: attr(n, "src")), lambda s: s.isNotNull() & ~F.regexp_like(s, F.lit(BAD_IMAGES))
    )
    return F.coalesce(F.nullif(named, F.lit("")), _og(nodes, "image"), F.get_json_object(json_ld(nodes), "$.image.url"), F.get(pictures, 0))


def attachments(pages: DataFrame, links: Column, pattern: str | None = ATTACHMENT, page: str = "page_id", url: str = "url") -> DataFrame:
    """(page, pos, file): the links of a rule (an array column, see rules.custom_match) that fit the pattern, resolved against the page's address.

    Unusable links and what cannot be resolved are left out; without a pattern every link of the rule counts.
    """
    each = pages.select(page, F.col(url).alias("_base"), F.posexplode(links).alias("pos", "_link"))
    kept = each.where(F.regexp_like("_link", F.lit(pattern))) if pattern else each
    return kept.select(page, "pos", urls.resolve(F.col("_link"), F.col("_base")).alias("file")).where("file is not null")


def declared_charset(html: Column) -> Column:
    """Charset name of a meta or XML declaration, lower case; NULL if none."""
    found = F.coalesce(
        F.nullif(F.regexp_extract(html, r"(?i)<meta[^>]*charset\s*=\s*[\"']?([\w-]+)", 1), F.lit("")),
        F.nullif(F.regexp_extract(html, r"(?i)^\s*<\?xml[^>]*encoding\s*=\s*[\"']([\w-]+)", 1), F.lit(""))
    )
    return F.lower(found)


def blocked(final_url: Column, nodes: Column, url_rule: str | None = None, element: tuple[str, str] | None = None) -> Column:
    """Whether a page is a block page: its final URL matches a page pattern, or a node (attribute, value regex) exists."""
    out = F.lit(False)
    if url_rule:
        out = out | preg(final_url, url_rule).isNotNull()
    if element:
        out = out | (F.size(by_attr(nodes, *element)) > 0)
    return out
