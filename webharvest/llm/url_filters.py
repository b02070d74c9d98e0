"""URL filters: explicit rules first, then empirical-Bayes host reputation.

Labelled outcomes of pages are counted by host.  Bad rates are shrunk level by level through beta-binomial
priors: suffix towards the whole, registered domain towards its suffix, host towards its domain.  The strength
of each level's prior is estimated from the spread between its groups (moments).  A host is blocked if the
lower posterior bound of its bad rate is over the limit.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.suffixes import default_rules
from ..functions.urls import let
from ._tables import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (action, host, path prefix)
RULES = (
    ("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("block", "net", "/de/"), ("block", "example.net", "/de/8"),
    ("block", "org", "/es/")
)
#: Hosts without a registered domain: they are their own, under an empty suffix, so that no host shares their outcomes.
ADDRESS = r"^(?:[0-9.]+|\[.*)$"
#: Markup that is no text; and marks of noise in what remains, entities as they are written.
MARKUP = r"(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>|<[^>]*>"
NOISE = r"[*#$%]{3}|&amp;&amp;&amp;|!!| \| "


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for a null or other text."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From the end of the host up to ?, # or the end."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def domain_of(host: Column) -> Column:
    """Registered domain: the public suffix and one label before it; the host itself if it has no more labels or is an address."""
    return F.when(F.regexp_like(host, F.lit(ADDRESS)), host).otherwise(F.coalesce(default_rules().domain(host), host))


def suffix_of(domain: Column) -> Column:
    """What follows the first dot of a registered domain; empty if there is none and for addresses."""
    named = (F.instr(domain, ".") > 0) & ~F.regexp_like(domain, F.lit(ADDRESS))
    return F.when(named, F.regexp_extract(domain, r"^[^.]*\.(.*)$", 1)).otherwise(F.lit(""))


def noisy_page(html: Column, per_char: float = 0.002) -> Column:
    """The default outcome of a page, 1 bad: symbol runs, doubled marks and table bars per character of its text; null pages have none."""
    text = F.regexp_replace(html, MARKUP, "")
    return F.when(
        html.isNotNull(), let(text, lambda t: (F.regexp_count(t, F.lit(NOISE)).cast("double") > F.length(t) * F.lit(per_char)).cast("long"))
    )


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, action) of the longest rule that fits; null fields if none does.  Ties: the earlier rule."""
    choice = F.struct(F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("action"))
    for action, name, prefix in reversed(sorted(rules, key=lambda r: -len(r[1] + r[2]))):
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(prefix))
        choice = F.when(fits, F.struct(F.lit(name + prefix).alias("rule"), F.lit(action).alias("action"))).otherwise(choice)
    return choice


def _strength(n: str, bad: str) -> Column:
    """struct(k, m): prior strength and mean of a level, from the spread of its groups' rates about the common mean."""
    some = F.col(n) > 0

    def total(x: Column) -> Column:
        return F.sum(F.when(some, x))

    groups, size, hits = F.count_if(some), total(F.col(n)), total(F.col(bad))
    squares, spreads = total(F.col(n).cast("double") * F.col(n)), total(F.col(bad).cast("double") * F.col(bad) / F.col(n))
    mean = F.try_divide(hits, size)
    inner = mean * (1 - mean)
    spread = spreads - size * mean * mean - (groups - 1) * inner
    room = (size - F.try_divide(squares, size) - (groups - 1)) * inner
    rho = F.least(F.lit(0.9), F.greatest(F.lit(0.01), F.coalesce(F.try_divide(spread, room), F.lit(0.01))))
    return F.struct((1 / rho - 1).alias("k"), F.coalesce(mean, F.lit(0.5)).alias("m"))


def host_reputation(outcomes: DataFrame) -> DataFrame:
    """(host, n, bad, rate, lower): posterior mean and lower bound of the bad rate of every host in `outcomes` (host, bad).

    lower: the mean less 1.645 standard deviations of the beta posterior, the normal approximation of its 5 %
    quantile.  Rows whose outcome is null are counted for nothing, but their hosts get the rate of their domain.
    Counting is a plain sum by host, so a host with most of the rows is no burden; the pages are counted once.
    """
    hosts = outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("bad"))
    hosts = hosts.withColumn("domain", domain_of(F.regexp_replace("host", r":[0-9]*$", "")))
    hosts = cut(hosts.withColumn("suffix", suffix_of(F.col("domain"))))
    domains = cut(hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("dn"), F.sum("bad").alias("db")))
    suffixes = cut(domains.groupBy("suffix").agg(F.sum("dn").alias("sn"), F.sum("db").alias("sb")))
    # two numbers a level
    (s_k, s_mean), (d_k, _), (h_k, _) = (
        df.agg(_strength(n, b).alias("x")).first()["x"] for df, n, b in ((suffixes, "sn", "sb"), (domains, "dn", "db"), (hosts, "n", "bad"))
    )
    chain = hosts.join(domains, ["suffix", "domain"]).join(suffixes, "suffix")
    chain = chain.withColumn("s_rate", (F.col("sb") + s_k * s_mean) / (F.col("sn") + s_k))
    chain = chain.withColumn("d_rate", (F.col("db") + d_k * F.col("s_rate")) / (F.col("dn") + d_k))
    chain = chain.withColumn("rate", (F.col("bad") + h_k * F.col("d_rate")) / (F.col("n") + h_k))
    deviation = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n") + h_k + 1))
    return chain.select("host", "n", "bad", "rate", (F.col("rate") - 1.645 * deviation).alias("lower"))


def judge_urls(
    pages: DataFrame, *, outcome: Column | None = None, rules=RULES, limit: float = 0.2, id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """(page_id, host, path, rule, verdict, rate, lower): allow or block for every row of `pages`.

    A null url, or one without ://, has an empty host and path and is judged by the reputation of the empty
    host.  Repeated rows are judged alike; further columns are ignored.
    """
    outcome = noisy_page(F.col("html")) if outcome is None else outcome
    rows = pages.select(
        F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"), outcome.alias("bad")
    )
    rows = cut(rows)
    known = host_reputation(rows.select("host", "bad"))
    judged = rows.drop("bad").join(known, "host").withColumn("choice", rule_for(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce("choice.action", F.when(F.col("lower") > limit, "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", F.col("choice.rule").alias("rule"), verdict.alias("verdict"), "rate", "lower")


def oracle(limit: float = 0.2, rules=RULES) -> str:
    """DuckDB SQL of judge_urls(pages, rules=rules) with the default outcome."""
    known = default_rules()
    exact, wild, but = ("[" + ", ".join(f"'{x}'" for x in sorted(names)) + "]" for names in (known.exact, known.wild, known.exceptions))
    tail, rest = (f"array_to_string(l[len(l) - k + {k}:], '.')" for k in (1, 2))
    cases = " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN {{0}}".replace("{0}", f"'{a}|{h}{p}'") for a, h,
        p in sorted(rules, key=lambda r: -len(r[1] + r[2]))
    )

    def level(table: str, n: str, b: str, name: str) -> str:
        mean = f"(sum({b}) / sum({n}))"
        inner = f"({mean} * (1 - {mean}))"
        return f"""{name} AS (SELECT 1 / least(0.9, greatest(0.01, coalesce((sum({b}::DOUBLE * {b} / {n}) - sum({n}) * {mean} * {mean} - (count(*) - 1) * {inner}) / nullif((sum({n}) - sum({n} * {n}) / sum({n}) - (count(*) - 1)) * {inner}, 0), 0.01))) - 1 AS k, coalesce({mean}, 0.5) AS m FROM {table} WHERE {n} > 0)"""

    return rf"""
WITH r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END AS rest, CASE WHEN html IS NOT NULL THEN regexp_replace(html, '{MARKUP}', '', 'g') END AS text FROM pages),
u AS (SELECT page_id, (len(regexp_extract_all(text, '{NOISE}'))::DOUBLE > length(text) * 0.002::DOUBLE)::BIGINT AS bad, coalesce(translate(regexp_extract(rest, '^[^/?#]*', 0), '{UPPER}', '{LOWER}'), '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM r),
h0 AS (SELECT host, count(bad)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS b, regexp_replace(host, ':[0-9]*$', '') AS bare FROM u GROUP BY host),
l0 AS (SELECT *, string_split(bare, '.') AS l FROM h0),
l1 AS (SELECT *, list_filter(range(1, len(l) + 1), lambda k: list_contains({but}, {tail})) AS but, list_max(list_transform(range(1, len(l) + 1), lambda k: CASE WHEN k = 1 OR list_contains({exact}, {tail}) OR list_contains({wild}, {rest}) THEN k ELSE 0 END)) AS longest FROM l0),
l2 AS (SELECT *, CASE WHEN len(but) > 0 THEN but[1] - 1 ELSE longest END AS size FROM l1),
h1 AS (SELECT host, n, b, bare, CASE WHEN regexp_matches(bare, '{ADDRESS}') OR len(l) <= size OR list_contains(l[len(l) - size:], '') THEN bare ELSE array_to_string(l[len(l) - size:], '.') END AS domain FROM l2),
h AS (SELECT *, CASE WHEN contains(domain, '.') AND NOT regexp_matches(domain, '{ADDRESS}') THEN regexp_extract(domain, '^[^.]*\.(.*)$', 1) ELSE '' END AS suffix FROM h1),
d AS (SELECT suffix, domain, sum(n) AS dn, sum(b) AS db FROM h GROUP BY ALL),
s AS (SELECT suffix, sum(dn) AS sn, sum(db) AS sb FROM d GROUP BY ALL),
{level("s", "sn", "sb", "ks")}, {level("d", "dn", "db", "kd")}, {level("h", "n", "b", "kh")},
c AS (SELECT host, n, (b + kh.k * ((db + kd.k * ((sb + ks.k * ks.m) / (sn + ks.k))) / (dn + kd.k))) / (n + kh.k) AS rate, kh.k AS k FROM h JOIN d USING (suffix, domain) JOIN s USING (suffix), ks, kd, kh),
v AS (SELECT page_id, host, path, CASE {cases} END AS choice FROM u)
SELECT page_id, host, path, split_part(choice, '|', 2) AS rule, coalesce(split_part(choice, '|', 1), CASE WHEN rate - 1.645 * sqrt(rate * (1 - rate) / (n + k + 1)) > {limit} THEN 'block' ELSE 'allow' END) AS verdict FROM v JOIN c USING (host)"""
