"""URL, text and time queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import patterns, text, times, urls
from .registry import NOW, query, spread, table

HOST = r"lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1))"
DOMAIN = rf"regexp_extract({HOST}, '([^.]+\.[^.]+)$', 1)"
SUB = rf"regexp_replace(left({HOST}, length({HOST}) - length({DOMAIN})), '\.$', '')"
BASE = "regexp_extract(url, '^([^?#]*)', 1)"
QUERY = r"regexp_extract(url, '^[^?#]*\?([^#]*)', 1)"
FRAGMENT = "regexp_extract(url, '(#.*)$', 1)"
PATH = "regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"


def _filtered(test: str) -> str:
    """SQL of a URL whose query keeps the sorted pairs that pass a test on p (key=value)."""
    pairs = f"array_to_string(list_sort(list_filter(string_split({QUERY}, '&'), lambda p: p <> '' AND {test})), '&')"
    return f"{BASE} || CASE WHEN {pairs} <> '' THEN '?' || {pairs} ELSE '' END || {FRAGMENT}"


@query(f"SELECT page_id, {DOMAIN} AS domain, {SUB} AS subdomain FROM pages")
def u1_parse_domain(spark, d):
    return table(spark, d, "pages").select(
        "page_id", urls.domain(F.col("url")).alias("domain"), urls.subdomain(F.col("url")).alias("subdomain")
    )


@query(f"SELECT page_id, {DOMAIN} AS domain, CASE WHEN {SUB} = '' THEN 'www' ELSE {SUB} END || '.' || {DOMAIN} AS subdomain FROM pages")
def u2_typeinfo(spark, d):
    return table(spark, d, "pages").select("page_id", urls.typeinfo(F.col("url")).alias("t")).select("page_id", "t.domain", "t.subdomain")


@query(
    f"""SELECT page_id, {BASE} || '?' || array_to_string(list_sort(list_concat(list_filter(string_split({QUERY}, '&'), lambda p: p <> '' AND NOT starts_with(p, 'page=')), ['page=9', 'q=a+b%2A~c'])), '&') || {FRAGMENT} AS built FROM pages"""
)
def u3_build_query(spark, d):
    return table(spark, d, "pages").select("page_id", urls.build_query(F.col("url"), {"page": "9", "q": "a b*~c"}).alias("built"))


@query(
    f"""SELECT page_id, {_filtered("starts_with(p, 'page=')")} AS kept, {_filtered("NOT starts_with(p, 'utm_source=')")} AS dropped, {BASE} || {FRAGMENT} AS bare FROM pages"""
)
def u4_filter_query(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select(
        "page_id", urls.filter_query(u, keep=["page"]).alias("kept"), urls.filter_query(u, exclude=["utm_source"]).alias("dropped"),
        urls.filter_query(u).alias("bare")
    )


@query(
    "SELECT p_partkey, 'a[b][0]=' || p_partkey || '&name=' || replace(replace(replace(p_name, '%', '%25'), ' ', '+'), '#', '%23') AS encoded FROM part"
)
def u5_url_encode(spark, d):
    params = F.create_map(
        F.lit("name"), F.col("p_name"), F.lit("a[b][0]"), F.col("p_partkey").cast("string"), F.lit("none"), F.lit(None).cast("string")
    )
    return table(spark, d, "part").select("p_partkey", urls.encode_params(params).alias("encoded"))


@query(
    f"""SELECT page_id, regexp_replace({_filtered("NOT regexp_matches(p, '^(r|_|rm|f|callback|utm_source)=')")}, '#top$', '') AS cleaned FROM pages"""
)
def u6_clean_url(spark, d):
    return table(spark, d, "pages").select("page_id", urls.clean_url(F.col("url"), ["utm_source"], ["#top$"]).alias("cleaned"))


#: Kinds of links beside those of the pages: relative, parent, query alone, other host, absolute, script, blank.
KINDS = ("near/x.html", "../up", "?q=1", "//cdn.test/a b", "https://other.test/p", "javascript:go()", "")


@query(rf"""WITH l AS (SELECT page_id, url, unnest(list_concat(regexp_extract_all(html, '<a href="([^"]*)"', 1), [{", ".join(f"'{k}'" for k in KINDS)}])) AS link FROM pages),
p AS (SELECT *, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS origin, {PATH} AS path FROM l)
SELECT page_id, link, CASE WHEN link IN ('', '/') OR starts_with(link, 'javascript') THEN NULL WHEN starts_with(link, '//') THEN regexp_extract(url, '^([a-z]+:)', 1) || link WHEN starts_with(link, '/') THEN origin || link WHEN starts_with(link, 'https://') THEN link
WHEN starts_with(link, '?') THEN origin || path || link WHEN starts_with(link, '../') THEN origin || regexp_replace(regexp_replace(path, '[^/]*$', ''), '[^/]+/$', '') || link[4:] ELSE origin || regexp_replace(path, '[^/]*$', '') || link END AS resolved FROM p""")
def u7_resolve_urls(spark, d):
    found = F.concat(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1)), F.array(*[F.lit(k) for k in KINDS]))
    links = table(spark, d, "pages").select("page_id", "url", F.explode(found).alias("link"))
    return links.select("page_id", "link", urls.resolve(F.col("link"), F.col("url")).alias("resolved"))


@query(
    "SELECT c_custkey, 'http://x.com/' || c_nationkey || '/{other}?k=' || replace(c_name, '#', '%23') AS by_format, 'http://x.com/n' || c_nationkey || '+' AS by_regex, 'http://x.com/?n=' || c_nationkey || '&z=1' AS by_get FROM customer"
)
def u8_build_url(spark, d):
    n = F.col("c_nationkey")
    return table(spark, d, "customer").select(
        "c_custkey", urls.build_url("http://x.com/{n}/{other}?k={k}", {"n": n, "k": F.col("c_name")}).alias("by_format"),
        urls.build_url("http://x.com/n0+", {"0+": n}, "replace").alias("by_regex"),
        urls.build_url("http://x.com/?z=1", {"n": n}, "get").alias("by_get")
    )


IDENTITY = f"""md5(CASE WHEN {SUB} = '' THEN regexp_replace({BASE}, '^([a-z]+://)', '\\1www.') ELSE {BASE} END || CASE WHEN regexp_extract({QUERY}, '(?:^|&)(page=[^&]*)', 1) <> '' THEN '?' || regexp_extract({QUERY}, '(?:^|&)(page=[^&]*)', 1) ELSE '' END || {FRAGMENT})"""


@query(f"SELECT page_id, {IDENTITY} AS unid FROM pages")
def u9_article_identity(spark, d):
    return table(spark, d, "pages").select("page_id", urls.article_id(F.col("url"), {"query": ["page"]}).alias("unid"))


@query(
    r"""SELECT page_id, nullif(regexp_extract(url, '(?si)example\.(.+?)/', 1), '') AS top, nullif(regexp_extract(url, '(?si)/.*?/([0-9]+)', 1), '') AS number FROM pages"""
)
def u10_page_pattern(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select(
        "page_id", patterns.preg(u, "example.[top]/").alias("top"), patterns.preg(u, "/[*]/[r=id][0-9]+[/r]").alias("number")
    )


@query(r"SELECT page_id, regexp_replace(url, '(?si)example\.(com|net)/', 'site.\1/') AS moved FROM pages")
def u11_rule_substitution(spark, d):
    return table(spark, d, "pages").select(
        "page_id", patterns.rule_to_subitem("example.[r=t]com|net[/r]/=>site.[t]/", F.col("url")).alias("moved")
    )


DETAIL = "regexp_matches(url, '(?i)" + "|".join(f"(?:{p})" for p in urls.DETAIL_PATTERNS) + "')"
TOP = "regexp_matches(url, '(?i)" + "|".join(f"(?:{p})" for p in urls.TOP_PATTERNS) + "')"


@query(f"SELECT page_id, {DETAIL} AS is_detail, {TOP} AS is_top FROM pages")
def u12_detail_and_top(spark, d):
    return table(spark, d, "pages").select(
        "page_id", urls.is_detail(F.col("url")).alias("is_detail"), urls.is_top_link(F.col("url")).alias("is_top")
    )


@query(rf"""SELECT page_id, CASE WHEN {PATH} IN ('', '/') AND {QUERY} = '' AND {SUB} IN ('', 'www') THEN 0.99 WHEN {PATH} IN ('', '/') AND {QUERY} = '' THEN 0.95 WHEN {DETAIL} THEN 0.0 WHEN {TOP} THEN 0.99
WHEN ends_with({PATH}, '/') THEN round(greatest(0.0, 0.95 - 0.2 * len(list_filter(string_split({PATH}, '/'), lambda p: p <> ''))), 2) WHEN regexp_matches({PATH}, '(?i)/(?:index|list|default)[^/]*\.[a-z]+$') THEN 0.94 END::DOUBLE AS score FROM pages""")
def u13_top_link_score(spark, d):
    return table(spark, d, "pages").select("page_id", urls.top_link_score(F.col("url")).cast("double").alias("score"))


@query(
    f"SELECT page_id, ({HOST} = 'example.com' OR ends_with({HOST}, '.example.com') OR {HOST} = 'example.org' OR ends_with({HOST}, '.example.org')) AS mine FROM pages"
)
def u14_from_any_domain(spark, d):
    return table(spark, d, "pages").select("page_id", urls.from_any_domain(F.col("url"), ["example.com", "Example.org"]).alias("mine"))


@query(
    "SELECT doc_id, md5(array_to_string(list_transform(string_split(text, ''), lambda c: CASE WHEN c = '' THEN '' WHEN unicode(c) > 127 THEN url_encode(c) ELSE c END), '')) AS quoted FROM documents"
)
def u15_quote_non_ascii(spark, d):
    return spread(table(spark, d, "documents")).select("doc_id", F.md5(urls.quote_non_ascii(F.col("text"))).alias("quoted"))


@query(
    "SELECT o_orderkey, epoch(o_orderdate::TIMESTAMP)::BIGINT + CASE WHEN year(o_orderdate) < 2000 THEN NULL ELSE 0 END AS dashed, epoch((o_orderdate + INTERVAL 20 YEAR)::TIMESTAMP)::BIGINT AS shifted, epoch((o_orderdate + INTERVAL 20 YEAR)::TIMESTAMP)::BIGINT AS packed FROM orders"
)
def u16_date_in_url(spark, d):
    day = F.col("o_orderdate").cast("date")
    later = F.add_months(day, 240)

    def url(x, form):
        return F.concat(F.lit("http://x.com/"), F.date_format(x, form), F.lit("/a.html"))

    return table(spark, d, "orders").select(
        "o_orderkey", urls.date_from_url(url(day, "yyyy-M-d")).alias("dashed"), urls.date_from_url(url(later, "yyyy-M-d")).alias("shifted"),
        urls.date_from_url(url(later, "yyyyMMdd")).alias("packed")
    )


@query("SELECT page_id, replace(replace(url, '#top', '#!top'), '#!', '?_escaped_fragment_=') AS candidate FROM pages")
def u17_escaped_fragment(spark, d):
    return table(spark, d, "pages").select(
        "page_id", urls.escaped_fragment(F.replace("url", F.lit("#top"), F.lit("#!top"))).alias("candidate")
    )


@query(
    f"SELECT page_id, nullif(regexp_extract({QUERY}, '(?:^|&)page=([^&]*)', 1), '') AS page, nullif(regexp_extract({QUERY}, '(?:^|&)ref=([^&]*)', 1), '') AS ref FROM pages"
)
def u18_query_map(spark, d):
    m = urls.query_map(F.col("url"))
    return table(spark, d, "pages").select(
        "page_id", F.try_element_at(m, F.lit("page")).alias("page"), F.try_element_at(m, F.lit("ref")).alias("ref")
    )


@query(
    """SELECT doc_id, length(regexp_replace(text, '[[:punct:]]', '', 'g'))::INT AS unpunctuated, md5(regexp_replace(text, '[ \\t\\n\\r\\x0b\\x0c]', '', 'g')) AS packed FROM documents"""
)
def x1_punctuation_and_space(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", F.length(text.remove_punctuation(F.col("text"))).alias("unpunctuated"),
        F.md5(text.remove_spaces(F.col("text"))).alias("packed")
    )


@query(
    """SELECT doc_id, md5(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\x0b]+', ' ', 'g'))) AS trimmed, length(regexp_replace(regexp_replace(replace(text, chr(9), ''), '[\\r\\n][ \\t\\n\\r\\f\\x0b]*', chr(13) || chr(10), 'g'), '^[ \\t\\n\\r\\f\\x0b]+|[ \\t\\n\\r\\f\\x0b]+$', '', 'g'))::INT AS line_chars FROM documents"""
)
def x2_normalise_lines(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", F.md5(text.inner_trim(F.col("text"))).alias("trimmed"), F.length(text.normalise_lines(F.col("text"))).alias("line_chars")
    )


def _counts(lang: str) -> str:
    words = ", ".join(f"'{w}'" for w in text.STOPWORDS[lang])
    return f"len(list_filter(string_split_regex(lower(regexp_replace(text, '[[:punct:]]', '', 'g')), '[ \\t\\n\\r\\f\\x0b]'), lambda w: list_contains([{words}], w)))"


@query(
    f"SELECT doc_id, len(string_split_regex(regexp_replace(text, '[[:punct:]]', '', 'g'), '[ \\t\\n\\r\\f\\x0b]'))::INT AS words, (CASE lang WHEN 'de' THEN {_counts('de')} WHEN 'fr' THEN {_counts('fr')} WHEN 'es' THEN {_counts('es')} ELSE {_counts('en')} END)::INT AS stopwords FROM documents"
)
def x3_stopwords(spark, d):
    return spread(table(spark, d, "documents")).select(
        "doc_id", text.word_count(F.col("text")).alias("words"), text.stopwords_by_language(F.col("text"), F.col("lang")).alias("stopwords")
    )


@query("""WITH o AS (SELECT o_orderkey, o_orderdate::DATE AS day, epoch(o_orderdate::DATE::TIMESTAMP)::BIGINT AS t FROM orders)
SELECT o_orderkey, t AS dashed, t AS slashed, t AS chinese, t + 11045 AS timed, t - 28800 + 11045 AS zoned, t + 11040 AS english, 820454400 - (1 + o_orderkey % 90) * 86400 AS days_ago, 820454400 - (1 + o_orderkey % 90) * 60 AS minutes_ago, t AS two_digit FROM o""")
def x4_parse_dates(spark, d):
    """Nine spellings of a date; one parser reads them all, an array of texts at a time."""
    day = F.col("o_orderdate").cast("date")
    n = (1 + F.col("o_orderkey") % 90).cast("string")

    def at(form, tail=""):
        return F.concat(F.date_format(day, form), F.lit(tail))

    spellings = {
        "dashed": at("yyyy-M-d"), "slashed": at("yyyy/MM/dd"), "chinese": at("yyyy年M月d日"), "timed": at("yyyy-MM-dd", " 03:04:05"), "zoned": at("yyyy-MM-dd", "T03:04:05+08:00"),
        "english": F.concat(
            F.date_format(day, "MMM dd"), F.lit(" 03:04 "), F.date_format(day, "yyyy")
        ), "days_ago": F.concat(n, F.lit("天前")), "minutes_ago": F.concat(n, F.lit("分钟前")), "two_digit": at("yy-M-d"),
    }
    read = F.transform(F.array(*spellings.values()), lambda t: times.parse_date(t, NOW))
    rows = spread(table(spark, d, "orders")).select("o_orderkey", read.alias("read"))
    return rows.select("o_orderkey", *[F.get("read", k).alias(name) for k, name in enumerate(spellings)])


@query("SELECT o_orderkey, strftime(o_orderdate::DATE + INTERVAL 20 YEAR, '%Y-%m-%d') || ' 10:20' AS found FROM orders")
def x5_find_date(spark, d):
    day = F.add_months(F.col("o_orderdate").cast("date"), 240)
    page = F.concat(F.lit("<div>2001-02-03 </div><p>发布时间："), F.date_format(day, "yyyy-MM-dd"), F.lit(" 10:20</p>"))
    return table(spark, d, "orders").select("o_orderkey", times.find_date(page).alias("found"))


@query("SELECT doc_id, md5(text) AS digest, md5(base64(encode(text))) AS encoded, md5(text) AS decoded FROM documents")
def x6_digests(spark, d):
    packed = text.base64_encode(F.col("text"))
    return table(spark, d, "documents").select(
        "doc_id", text.md5_hex(F.col("text")).alias("digest"), F.md5(packed).alias("encoded"),
        F.md5(text.base64_decode(packed)).alias("decoded")
    )


@query("SELECT doc_id, len(regexp_extract_all(text, '(?i)\\bthe\\b'))::INT AS n FROM documents")
def x7_delimited_regex(spark, d):
    return table(spark, d, "documents").select("doc_id", F.regexp_count("text", F.lit(patterns.pcre_to_regex("/\\bthe\\b/iu"))).alias("n"))
