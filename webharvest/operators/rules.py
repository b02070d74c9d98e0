"""Rule-driven extraction: JSON, regular expression, path and selector rules; post-processing; rule matching."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.jsonpath import PLAIN, path_hits
from ..functions.nodes import html_nodes
from ..functions.patterns import preg, rule_to_pattern
from ..functions.selectors import elements, selector, taken
from . import extract

DEFAULT_MEDIA_TYPE = 99


def unwrap_jsonp(text: Column) -> Column:
    """The JSON inside `name(...)`; other text as it is."""
    inner = F.regexp_extract(text, r"(?s)^\s*[\w.$]+\s*\((.*)\)\s*;?\s*$", 1)
    return F.when(inner != "", inner).otherwise(text)


def json_path(text: Column, path: str) -> Column:
    """JSON text at a path; `[-1]` and `.-1` take the last element of an array.

    Paths of names and indices are built-in expressions; wildcards, slices, unions, quoted names, recursive descent
    and filters are followed by functions.jsonpath, where one hit stands for itself and several are an array.  A path
    that is not supported raises when the plan is made.
    """
    if not PLAIN.match(path.strip()):
        return path_hits(text, path)
    steps = re.sub(r"\.(-?\d+)(?=\.|$|\[)", r"[\1]", path.removeprefix("$").removeprefix("."))
    out, at = text, 0
    for m in re.finditer(r"\[-1\]", steps):
        part = steps[at : m.start()]
        out = F.get_json_object(out, _dollar(part)) if part.strip(".") else out
        out = F.try_element_at(_array(out), F.lit(-1))
        at = m.end()
    rest = steps[at:]
    return F.get_json_object(out, _dollar(rest)) if rest.strip(".") else out


def _dollar(path: str) -> str:
    path = path.strip(".")
    return "$" + path if path.startswith("[") else "$." + path


def _array(text: Column) -> Column:
    """Elements of a JSON array as JSON texts, strings without quotes; anything else is one element."""
    parsed = F.from_json(text, "array<variant>")
    each = F.transform(parsed, lambda v: F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v)))
    return F.when(F.startswith(F.ltrim(text), F.lit("[")), each).when(text.isNotNull(), F.array(text))


def json_rows(text: Column, filter_path: str | None = None) -> Column:
    """Elements at a path, an array of JSON texts."""
    source = unwrap_jsonp(text)
    return _array(json_path(source, filter_path) if filter_path else source)


def json_rule(df: DataFrame, column: str, rule: Mapping) -> DataFrame:
    """Rows by a JSON rule set {filter, item: {name: rule}}; without items one column `value` of the hits.  Other columns stay.

    An item's rule is a path into the row; or, where the row is a text, `@css:`, `@xpath:` or `@reg:`, whose first hit counts.
    """
    exploded = df.withColumn("_row", F.explode(json_rows(F.col(column), rule.get("filter"))))
    items = rule.get("item")
    if not items:
        return exploded.withColumnRenamed("_row", "value")
    row = F.col("_row")

    def value(rule: str) -> Column:
        if rule.startswith(("@css:", "@xpath:", "@reg:")):
            return F.get(custom_match(rule, row, F.lit(None).cast("string")), 0)
        return json_path(row, rule.removeprefix("@json:"))

    return exploded.withColumns({name: value(rule) for name, rule in items.items()}).drop("_row")


def regex_rule(text: Column, rule: str, many: bool = False) -> Column:
    """`@reg:` rule in the page-pattern language: the first match, or all as an array."""
    rule = rule.removeprefix("@reg:")
    if not many:
        return preg(text, rule)
    pattern, names = rule_to_pattern(rule)
    group = 1 if names or re.compile(pattern).groups else 0
    return F.transform(F.regexp_extract_all(text, F.lit("(?si)" + pattern), F.lit(group)), lambda x: F.trim(x))


def custom_match(rule: str, html: Column, url: Column, target: str = "text", nodes: Column | None = None) -> Column:
    """Values of a rule as an array: @value: a constant, @url: from the URL, @reg: from the page, @css: and @xpath: (or bare paths) from its nodes.

    nodes: the parsed page, if there is one; rules of one projection share the parse in any case.
    """
    if rule.startswith("@value:"):
        return F.array(F.lit(rule[7:]))
    if rule.startswith("@url:"):
        return F.filter(F.array(preg(url, rule[5:])), lambda x: x.isNotNull())
    if rule.startswith("@reg:"):
        return regex_rule(html, rule, many=True)
    return selector(rule, html_nodes(html) if nodes is None else nodes, target, html)


def _among(orders: Column, fit: Column, inside: bool) -> Column:
    return urls.let(
        F.struct(orders.alias("o"), fit.alias("f")),
        lambda x: F.filter(x["o"], lambda k: F.array_contains(x["f"], k) == F.lit(inside))
    )


def rule_values(rule: Mapping, html: Column, url: Column, nodes: Column) -> Column:
    """Values of a rule {filter, target, ...} as an array.

    For element rules (`@css:`, `@xpath:`) further: `is_` and `not_`, CSS that the elements have to fit or not; `grep`
    {target, pattern or params}, which keeps elements whose value matches, equals, or is not empty; `eq`, a place among
    what is left (negative from the end); `match`, a pattern of which the first group in the element's own source counts.
    """
    kept = {"is_", "not_", "grep", "eq", "match"} & {k for k, v in rule.items() if v is not None}
    source = rule["filter"]
    if not kept or source.startswith(("@value:", "@url:", "@reg:")):
        return custom_match(source, html, url, rule.get("target", "text"), nodes)

    def values(ns: Column) -> Column:
        orders, final = elements(source, ns)
        for name in ("is_", "not_"):
            if rule.get(name):
                orders = _among(orders, elements("@css:" + rule[name], ns)[0], name == "is_")
        found = F.transform(orders, lambda k: F.get(ns, k))
        if grep := rule.get("grep"):
            def good(n: Column) -> Column:
                value = taken(n, grep.get("target", "text"), html)
                if grep.get("pattern"):
                    return F.coalesce(F.regexp_like(value, F.lit(grep["pattern"])), F.lit(False))
                return F.coalesce(value == grep["params"] if grep.get("params") is not None else value != "", F.lit(False))

            found = F.filter(found, good)
        if rule.get("eq") is not None:
            at = int(rule["eq"])
            found = urls.let(found, lambda f: F.filter(f, lambda _, i: i == (F.lit(at) if at >= 0 else F.size(f) + at)))
        if rule.get("match"):
            if re.compile(rule["match"]).groups < 1:
                raise ValueError(f"a match needs a group: {rule['match']!r}")
            read = lambda n: F.nullif(F.regexp_extract(taken(n, "outer", html), rule["match"], 1), F.lit(""))
        else:
            target = final[1:] if final and final.startswith("@") else rule.get("target", "text")
            read = lambda n: taken(n, target, html)
        return F.filter(F.transform(found, read), lambda v: v.isNotNull())

    return urls.let(nodes, values)


def post_process(value: Column, rule: Mapping, callback: Callable[[Column], Column] | None = None) -> Column:
    """`extract` pattern, then `patch` template ([x] stands for the value), else `prefix` and `suffix`; NULL and empty values stay; a callback comes last."""
    out = value
    if rule.get("extract"):
        out = preg(out, rule["extract"])
    if rule.get("patch"):
        out = F.replace(F.lit(rule["patch"]), F.lit("[x]"), out)
    elif rule.get("prefix") or rule.get("suffix"):
        out = F.concat(F.lit(rule.get("prefix", "")), out, F.lit(rule.get("suffix", "")))
    out = F.when(value.isNull() | (value == ""), value).otherwise(out)
    return callback(out) if callback else out


def columns_to_rows(columns: Mapping[str, Column], extend: bool = False) -> Column:
    """Arrays of different lengths to an array of structs; short ones padded by NULL, or by their last value with `extend`."""
    size = F.greatest(*[F.coalesce(F.size(c), F.lit(0)) for c in columns.values()], F.lit(0))
    at = F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))

    def row(i: Column) -> Column:
        return F.struct(
            *[
                (F.when((i >= F.size(c)) & F.lit(extend), F.try_element_at(c, F.lit(-1))).otherwise(F.get(c, i))).alias(name) for name,
                c in columns.items()
            ]
        )

    return F.transform(at, row)


def custom_rules(
    pages: DataFrame, rules: Mapping[str, Mapping], html: str = "html", url: str = "url", items: bool = False, only_one: bool = False
) -> DataFrame:
    """Free-form rule set {name: {filter, target, extract, patch, ...}}: one record a page, or rows with items=True.  A page is parsed once for all rules."""
    staged = pages.withColumn("_nodes", html_nodes(F.col(html)))
    values = {
        name: _each(rule_values(rule, F.col(html), F.col(url), F.col("_nodes")), rule) for name,
        rule in rules.items()
    }
    if not items:
        return staged.withColumns({name: F.get(v, 0) for name, v in values.items()}).drop("_nodes")
    staged = staged.withColumns({f"_{name}": v for name, v in values.items()})
    rows = columns_to_rows({name: F.col(f"_{name}") for name in values})
    rows = F.slice(rows, 1, 1) if only_one else rows
    return staged.withColumn("_row", F.explode(rows)).select(*pages.columns, *[F.col(f"_row.{name}").alias(name) for name in values])


def _each(found: Column, rule: Mapping) -> Column:
    return F.transform(found, lambda x: post_process(x, rule))


def bad_patterns(rules: DataFrame, key: str = "uuid", pattern: str = "pattern") -> DataFrame:
    """(uuid, pattern, error) of the rules whose pattern is no regular expression; the others can be run."""
    @F.arrow_udf("string")
    def error(patterns: pa.Array) -> pa.Array:
        out = []
        for text in patterns.to_pylist():
            try:
                if text is not None:
                    re.compile(text)
                # written in no dialect but Python's
                out.append("not supported: (?P or (?(" if text and re.search(r"\(\?(?:P|\()", text) else None)
            except (re.error, RecursionError, OverflowError) as e:
                out.append(str(e))
        return pa.array(out, pa.string())

    return rules.select(key, pattern, error(F.col(pattern)).alias("error")).where("error IS NOT NULL")


def match_detail_rules(articles: DataFrame, rules: DataFrame, key: str = "rid") -> DataFrame:
    """articles with rule_id, the detail rule of each.

    rules: (uuid, domain, subdomain, pattern as a Java regex or NULL, status).  Active rules of the subdomain come
    first, the first that matches by uuid, else the first; the domain's (blank subdomain) only if the subdomain has none.
    Rules with a bad pattern are left out; bad_patterns() names them.
    """
    rules = rules.join(bad_patterns(rules).select("uuid"), "uuid", "left_anti")
    info = urls.typeinfo(F.col("url"))
    rows = articles.select(key, "url", info["domain"].alias("_domain"), info["subdomain"].alias("_sub"))
    live = rules.where("status = 1").select(
        F.col("uuid").alias("rule_id"), F.col("domain").alias("_domain"), F.nullif(F.col("subdomain"), F.lit("")).alias("_rule_sub"),
        "pattern"
    )
    level = F.when(F.col("_rule_sub") == F.col("_sub"), 0).when(F.col("_rule_sub").isNull(), 1)
    hit = F.coalesce(F.regexp_like("url", F.col("pattern")), F.lit(False))
    best = rows.join(live, "_domain").withColumn("_level", level).where("_level is not null").groupBy(key).agg(
        F.min(F.struct("_level", (~hit).alias("missed"), "rule_id")).alias("_best")
    )
    return articles.join(best.select(key, F.col("_best.rule_id").alias("rule_id")), key, "left")


def check_rule(articles: DataFrame, rules: DataFrame) -> DataFrame:
    """articles (url, rule_id) with rule_ok: domain equal, subdomain equal if set, pattern matches if set; a rule with a bad pattern fits nothing."""
    rules = rules.join(bad_patterns(rules).select("uuid"), "uuid", "left_anti")
    info = urls.typeinfo(F.col("url"))
    side = rules.select(
        F.col("uuid").alias("rule_id"), F.col("domain").alias("_d"), F.nullif(F.col("subdomain"), F.lit("")).alias("_s"),
        F.col("pattern").alias("_p")
    )
    ok = (F.col("_d") == info["domain"]) & F.coalesce(F.col("_s") == info["subdomain"], F.lit(True)) & F.coalesce(
        F.regexp_like("url", F.col("_p")), F.lit(True)
    )
    return articles.join(side, "rule_id", "left").withColumn("rule_ok", F.coalesce(ok, F.lit(False))).drop("_d", "_s", "_p")


def media_types(articles: DataFrame, types: DataFrame) -> DataFrame:
    """articles with mediaType: of the subdomain, else of the domain with blank subdomain, else 99."""
    info = urls.typeinfo(F.col("url"))
    own = types.where("coalesce(subdomain, '') <> ''").groupBy(F.col("subdomain").alias("_sub")).agg(F.min("mediaType").alias("_own"))
    general = types.where("coalesce(subdomain, '') = ''").groupBy(F.col("domain").alias("_domain")).agg(F.min("mediaType").alias("_general"))
    rows = articles.withColumns({"_sub": info["subdomain"], "_domain": info["domain"]})
    return rows.join(own, "_sub", "left").join(general, "_domain", "left").withColumn(
        "mediaType", F.coalesce("_own", "_general", F.lit(DEFAULT_MEDIA_TYPE))
    ).drop("_sub", "_domain", "_own", "_general")


def parse_items(
    pages: DataFrame, now: int, rules: Mapping[str, Mapping] | None = None, page: str = "page_id", url: str = "url", html: str = "html",
    lang: str | None = None, lists=None
) -> DataFrame:
    """Item parser: (page, url, title, author, pubtime, content, rule fields); title, author, pubtime and content are always there.

    A page is parsed once and all fields are read from its nodes inside its row.  Stopwords are those of the
    page's own language (`lang` overrides it), of `lists` where given.
    """
    rules = rules or {}
    n, at, source = F.col("_nodes"), F.col(url), F.col(html)
    staged = pages.select(page, url, html, html_nodes(source, lang, lists).alias("_nodes"))
    given = {
        f"_r_{name}": F.get(_each(rule_values(rule, source, at, n), rule), 0) for name,
        rule in rules.items()
    }
    staged = staged.withColumns({"_content": extract.content(n, at), **given})

    def rule(name: str) -> Column | None:
        return F.col(f"_r_{name}") if name in rules else None

    around = F.get(n, F.get(n, F.col("_content.top"))["parent"])["text"]
    text = F.col("_content.text") if rule("content") is None else F.coalesce(rule("content"), F.col("_content.text"))
    return staged.select(
        page, url,
        extract.clean_title(extract.raw_title(n, at, rule("title")), n, at).alias("title"),
        extract.item_author(extract.authors(n, source, at, rule("author"))).alias("author"),
        extract.publish_time(n, source, at, now, rule("pubtime"), around).alias("pubtime"),
        text.alias("content"),
        *[rule(name).alias(name) for name in rules if name not in ("title", "author", "pubtime", "content")],
    )


def parse_lists(
    pages: DataFrame, rules: Mapping[str, Mapping] | None = None, page: str = "page_id", url: str = "url", html: str = "html"
) -> DataFrame:
    """List parser: rows (page, pos, title, url, ...) by rules, else by detection; addresses resolved, unusable ones dropped."""
    if rules:
        source = pages.select(page, F.col(url).alias("_base"), F.col(html).alias("_html"))
        rows = custom_rules(source, rules, "_html", "_base", items=True).drop("_html")
        return rows.withColumn("url", urls.resolve(F.col("url"), F.col("_base"))).where("url is not null").drop("_base")
    staged = pages.select(page, F.col(url).alias("_base"), extract.list_links(html_nodes(F.col(html)), F.col(url)).alias("_found"))
    usable = F.transform("_found", lambda x: F.when(urls.usable_link(x["url"]), F.trim(x["url"])))
    staged = staged.withColumn("_links", urls.all_links(F.col("_base"), usable))  # in the page's row: beside a filter on rows it would run twice
    each = F.transform(F.arrays_zip("_found", "_links"), lambda x, i: F.struct(i.alias("pos"), x["_found"]["title"].alias("title"), x["_links"].alias("url")))
    return staged.select(page, F.inline(F.filter(each, lambda x: x["url"].isNotNull())))
