"""URL functions as Column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .patterns import preg
from .suffixes import SuffixRules, default_rules

# Query keys that vary at random, patterns of board pages and of article pages.
RANDOM_KEYS = ("r", "_", "rm", "f", "callback")
TOP_PATTERNS = (r"/thread\.php\?fid=\d+", r"/forum\.php\?gid=\d+", r"(forum-|list-funinfo-)")
DETAIL_PATTERNS = (
    r"(20[012][0-9]|19[789][0-9]).?([1-9]|0[1-9]|1[012]).?([1-9]|0[1-9]|[12][0-9]|3[01]).*?\.[a-z]{3,5}",
    r"(mod=viewthread.*?tid=|read.*?tid=|viewnews-|blog-id-|do=blog&id=|thread-|post-funinfo-)",
    r"\d{2}/\d{4}/\d{2}/[\_\-\d\w]{10,}\.[a-z]{3,5}",
    r"\d{8}/[\_\-\d\w]{10,}\.[a-z]{3,5}",
    r"/\d{4}-\d{1,2}-\d{1,2}/",
    r"/[a-z0-9]{10,}/$",
    r"article/details/\d{6,}",
    r"/content\.[a-z]{3,5}",
    r"\d+\.s?html?$",
    r"/p/[a-z0-9]+(?:\?.+)?",
)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value evaluated once, so that nested expressions stay small."""
    return F.get(F.transform(F.array(value), use), 0)


def host(url: Column) -> Column:
    """Lower-cased host without user and port; NULL without a host."""
    h = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.when(h != "", h)


def _base_query(url: Column) -> tuple[Column, Column, Column]:
    """(before ?, query, fragment with #)."""
    return F.regexp_extract(url, r"^([^?#]*)", 1), F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), F.regexp_extract(url, r"(#.*)$", 1)


def quote_plus(text: Column) -> Column:
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def domain(url: Column, rules: SuffixRules | None = None) -> Column:
    """Registered domain of a URL: public suffix and one label; NULL for IP addresses, single labels, suffixes and no host."""
    return let(host(url), lambda h: F.when(~F.regexp_like(h, F.lit(r"^[0-9.]+$")), (rules or default_rules()).domain(h)))


def subdomain(url: Column, rules: SuffixRules | None = None) -> Column:
    """Labels before the registered domain; empty if there are none, NULL without a registered domain."""
    return let(
        F.struct(host(url).alias("h"), domain(url, rules).alias("d")), lambda x: F.when(
            x["d"].isNotNull(), F.regexp_replace(F.substring(x["h"], F.lit(1), F.length(x["h"]) - F.length(x["d"])), r"\.$", "")
        )
    )


def typeinfo(url: Column, rules: SuffixRules | None = None) -> Column:
    """struct(domain, subdomain): the full subdomain host, `www.` and the domain where there is none."""
    return let(
        F.struct(host(url).alias("h"), domain(url, rules).alias("d")), lambda x: F.struct(
            x["d"].alias("domain"), F.when(x["h"] == x["d"], F.concat(F.lit("www."), x["d"])).when(x["d"].isNotNull(), x["h"]).alias("subdomain")
        )
    )


def _pairs(query: Column) -> Column:
    """Query parts as struct(k, v, i), blank values and parts without = dropped."""
    parts = F.filter(F.split(query, "&"), lambda p: F.regexp_like(p, F.lit("^[^=]+=.")))
    return F.transform(
        parts, lambda p,
        i: F.struct(F.regexp_extract(p, "^([^=]*)=", 1).alias("k"), F.regexp_extract(p, "^[^=]*=(.*)$", 1).alias("v"), i.alias("i"))
    )


def _decoded(value: Column) -> Column:
    return F.coalesce(F.try_url_decode(value), value)


def _first_by_key(pairs: Column) -> Column:
    ordered = F.array_sort(pairs)
    return F.filter(ordered, lambda p, i: (i == 0) | (F.get(ordered, i - 1)["k"] != p["k"]))


def _join(base: Column, pairs: Column, fragment: Column) -> Column:
    query = F.array_join(F.transform(pairs, lambda p: F.concat(p["k"], F.lit("="), quote_plus(_decoded(p["v"])))), "&")
    return F.concat(base, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")), fragment)


def build_query(url: Column, params: dict[str, str | Column]) -> Column:
    """Merge params into the query: same keys replaced, of repeated keys the first value kept, blanks dropped, keys sorted, values quoted."""
    base, query, fragment = _base_query(url)
    new = {k: (v if isinstance(v, Column) else F.lit(v)).cast("string") for k, v in params.items()}
    old = F.filter(_first_by_key(_pairs(query)), lambda p: ~p["k"].isin(*new)) if new else _first_by_key(_pairs(query))
    old = F.transform(old, lambda p: F.struct(p["k"].alias("k"), quote_plus(_decoded(p["v"])).alias("v")))
    added = [F.struct(F.lit(k).alias("k"), quote_plus(v).alias("v")) for k, v in new.items()]
    pairs = F.array_sort(F.filter(F.concat(old, F.array(*added)) if added else old, lambda p: p["v"] != ""))
    joined = F.array_join(F.transform(pairs, lambda p: F.concat(p["k"], F.lit("="), p["v"])), "&")
    return F.concat(base, F.when(joined != "", F.concat(F.lit("?"), joined)).otherwise(F.lit("")), fragment)


def filter_query(url: Column, keep: Sequence[str] = (), exclude: Sequence[str] = ()) -> Column:
    """Keep only the listed keys, or drop the listed ones; with neither list the query is emptied."""
    base, query, fragment = _base_query(url)
    pairs = _first_by_key(_pairs(query))
    if keep:
        pairs = F.filter(pairs, lambda p: p["k"].isin(*keep))
    elif exclude:
        pairs = F.filter(pairs, lambda p: ~p["k"].isin(*exclude))
    else:
        return F.concat(base, fragment)
    return _join(base, pairs, fragment)


def encode_params(params: Column) -> Column:
    """map<string,string> (nested keys written as a[b][0]) to a sorted, quoted query string; NULL values dropped."""
    entries = F.array_sort(F.filter(F.map_entries(params), lambda e: e["value"].isNotNull()))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), quote_plus(e["value"]))), "&")


def clean_url(url: Column, extra_keys: Sequence[str] = (), remove: Sequence[str] = ()) -> Column:
    """Drop randomly varying query keys, then remove regular expressions."""
    out = filter_query(url, exclude=[*RANDOM_KEYS, *extra_keys])
    for pattern in remove:
        out = F.regexp_replace(out, pattern, "")
    return out


def urljoin(base: Column | str, link: Column | str) -> Column:
    """RFC 3986 resolution, stdlib rules; NULL in, NULL out, and NULL for what cannot be resolved."""
    return F.pandas_udf(_urljoin, T.StringType())(base, link)


def _urljoin(base: pd.Series, link: pd.Series) -> pd.Series:
    from urllib.parse import urljoin as join

    def one(b, u):
        if b is None or u is None:
            return None
        try:
            return join(b, u)
        except ValueError:
            return None

    return pd.Series([one(b, u) for b, u in zip(base, link)], dtype=object)


def first_links(base: Column | str, links: Column | str) -> Column:
    """The links of an array resolved against one address, NULL for those that cannot be and for repeats of an earlier one."""
    return F.arrow_udf(_first_links, "array<string>")(base, links)


def all_links(base: Column | str, links: Column | str) -> Column:
    """The links of an array resolved against one address, NULL for those that cannot be."""
    return F.arrow_udf(_all_links, "array<string>")(base, links)


def _first_links(base: pa.Array, links: pa.Array) -> pa.Array:
    return _joined(base, links, True)


def _all_links(base: pa.Array, links: pa.Array) -> pa.Array:
    return _joined(base, links, False)


def _joined(base: pa.Array, links: pa.Array, once: bool) -> pa.Array:
    from urllib.parse import urljoin as join

    out = []
    for b, some in zip(base.to_pylist(), links.to_pylist()):
        met: set[str] = set()
        row: list[str | None] = []
        for u in some or ():
            try:
                found = join(b, u) if b is not None and u is not None else None
            except ValueError:
                found = None
            row.append(None if found in met else found)
            if once and found is not None:
                met.add(found)
        out.append(None if some is None else row)
    return pa.array(out, pa.list_(pa.string()))


def usable_link(link: Column) -> Column:
    """Whether a parsed link is worth resolving: not empty, not javascript, not `/`."""
    t = F.trim(link)
    return F.coalesce((t != "") & (t != "/") & ~F.startswith(F.lower(t), F.lit("javascript")), F.lit(False))


def resolve(link: Column, base: Column, template: str | None = None) -> Column:
    """Absolute URL of a parsed link; by template ({url} stands for the link) if one is given; NULL for unusable links."""
    out = F.replace(F.lit(template), F.lit("{url}"), link) if template else urljoin(base, F.trim(link))
    return F.when(usable_link(link), out)


def build_url(template: str, params: dict[str, Column], mode: str = "format") -> Column:
    """`format`: {k} replaced by quoted values, unknown ones kept; `replace`: each key is a regular expression; `get`: keys go to the query."""
    if mode == "get":
        return build_query(F.lit(template), params)
    out = F.lit(template)
    for k, v in params.items():
        v = v.cast("string")
        out = F.replace(out, F.lit("{" + k + "}"), quote_plus(v)) if mode == "format" else F.regexp_replace(out, F.lit(k), v)
    return out


def article_id(url: Column, unique: dict | None = None, data: Sequence[Column] = ()) -> Column:
    """MD5 identity of an article: `www.` added, then unique['url'] (page pattern), unique['query'] (keys kept) and further data."""
    unique = unique or {}
    full = F.when(subdomain(url) == "", F.regexp_replace(url, r"^([A-Za-z][A-Za-z0-9+.-]*://)", "$1www.")).otherwise(url)
    if unique.get("url"):
        full = F.coalesce(preg(full, unique["url"]), full)
    if "query" in unique:
        full = filter_query(full, keep=unique["query"])
    return F.md5(F.concat(full, *[F.coalesce(d.cast("string"), F.lit("")) for d in data]))


def is_detail(url: Column) -> Column:
    return F.regexp_like(url, F.lit("(?i)" + "|".join(f"(?:{p})" for p in DETAIL_PATTERNS)))


def is_top_link(url: Column) -> Column:
    return F.regexp_like(url, F.lit("(?i)" + "|".join(f"(?:{p})" for p in TOP_PATTERNS)))


def top_link_score(url: Column) -> Column:
    """How likely a URL is a list page: root or www 0.99, subdomain root 0.95, article 0, board 0.99, directory less 0.2 a level, index file 0.94, else NULL."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    root = path.isin("", "/") & (query == "")
    depth = F.size(F.filter(F.split(path, "/"), lambda p: p != ""))
    named = F.regexp_like(path, F.lit(r"(?i)/(?:index|list|default)[^/]*\.[a-z]+$"))
    return (
        F.when(root & subdomain(url).isin("", "www"), 0.99)
        .when(root, 0.95)
        .when(is_detail(url), 0.0)
        .when(is_top_link(url), 0.99)
        .when(F.endswith(path, F.lit("/")), F.round(F.greatest(F.lit(0.0), 0.95 - 0.2 * depth), 2))
        .when(named, 0.94)
    )


def from_any_domain(url: Column, domains: Sequence[str]) -> Column:
    h = host(url)
    out = F.lit(False)
    for d in domains:
        out = out | (h == d.lower()) | F.endswith(h, F.lit("." + d.lower()))
    return F.coalesce(out, F.lit(False))


def quote_non_ascii(url: Column) -> Column:
    """Percent-quote the UTF-8 bytes of non-ASCII characters only."""
    return F.array_join(
        F.transform(F.split(url, ""), lambda c: F.when(F.regexp_like(c, F.lit(r"[^\x00-\x7F]")), F.url_encode(c)).otherwise(c)), ""
    )


def date_from_url(url: Column) -> Column:
    """Epoch seconds of the first 20xx-m-d, else of the first 20xxMMDD; NULL if there is no valid one."""
    dashed = F.regexp_extract(url, r"(20[012]\d-\d{1,2}-\d{1,2})", 1)
    packed = F.regexp_extract(url, r"(20[012]\d[01]\d[0123]\d)", 1)
    return F.coalesce(
        F.unix_timestamp(F.try_to_timestamp(dashed, F.lit("yyyy-M-d"))), F.unix_timestamp(F.try_to_timestamp(packed, F.lit("yyyyMMdd")))
    )


def escaped_fragment(url: Column) -> Column:
    return F.replace(url, F.lit("#!"), F.lit("?_escaped_fragment_="))


def query_map(url: Column, decode: bool = True) -> Column:
    """Query of a URL, or a bare query string, as a map; of repeated keys the first value."""
    query = F.when(F.contains(url, F.lit("?")), _base_query(url)[1]).otherwise(url)
    return F.map_from_entries(F.transform(_first_by_key(_pairs(query)), lambda p: F.struct(p["k"], _decoded(p["v"]) if decode else p["v"])))
