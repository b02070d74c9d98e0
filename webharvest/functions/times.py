"""Date text to epoch seconds, and publish dates in page text, as Column expressions.

`now` is epoch seconds, a Column or a number.  Texts without a zone are in the session zone; a zone in the text is honoured.
Relative times take the whole number; days, weeks, months (30 d) and years (365 d) ago start at midnight.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .urls import let

MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
_TIME = r"\d{1,2}:\d{2}(?::\d{2})?"
# Patterns of a publish date, best first: after a label, before the word for "published", date with time, date between
# tags, date before blanks and a tag.
_DATE = (
    r"((?:(?:(?:(?:20)?[012]\d)|(?:19)?[98]\d)年\d{1,2}月\d{1,2}日?(?:\D*\d{2}:\d{2}(?::\d{2})?)?)|(?:(?:(?:(?:20)?[012]\d)|(?:19)?[9]\d)-\d{1,2}-\d{1,2}(?:\D*\d{1,2}:\d{2}(?::\d{2})?)?)|"
    r"(?:(?:(?:(?:20)?[012]\d)|(?:19)?[9]\d)\/\d{1,2}\/\d{1,2}(?:\D*\d{1,2}:\d{2}(?::\d{2})?)?))"
)
DATE_RULES = (
    r"[\>\s;](?:(?:本文)?发布于|发表于|发布(?:时间|日期)|日期|时间)\s*(?:\:|：)?\s*" + _DATE,
    _DATE + r"\s*发布",
    r"((?:(?:(?:(?:20)?[012]\d)|(?:19)?[98]\d)年\d{1,2}月\d{1,2}日\D?\d{2}:\d{2}(?::\d{2})?)|(?:(?:(?:(?:20)?[012]\d)|(?:19)?[9]\d)-\d{1,2}-\d{1,2} \d{1,2}:\d{2}(?::\d{2})?)|"
    r"(?:(?:(?:(?:20)?[012]\d)|(?:19)?[9]\d)\/\d{1,2}\/\d{1,2} \d{1,2}:\d{2}(?::\d{2})?))",
    r"\>\s*" + _DATE + r"[\s&\<]",
    r"[\s\>;]((?:(?:(?:(?:20)?[012]\d)|(?:19)?[9]\d)-\d{1,2}-\d{1,2}(?:\D*\d{1,2}:\d{2}(?::\d{2})?)?)|(?:(?:(?:(?:20)?[012]\d)|(?:19)?[9]\d)\/\d{1,2}\/\d{1,2}(?:\D*\d{1,2}:\d{2}(?::\d{2})?)?))"
    r"(?:\040|&nbsp;)+\<",
)


def _stamp(x: Column) -> Column:
    """Epoch seconds of struct(y, m, d, clock, zone): digits, a clock text h:m[:s] or "", a zone text +hh:mm or ""; NULL if invalid."""
    year = F.when(F.length(x["y"]) == 2, F.concat(F.when(x["y"] >= "70", "19").otherwise("20"), x["y"])).otherwise(x["y"])
    parts = F.split(x["clock"], ":")
    time = F.when(x["clock"] == "", "00:00:00").otherwise(
        F.concat_ws(":", F.lpad(parts[0], 2, "0"), parts[1], F.coalesce(F.lpad(F.get(parts, 2), 2, "0"), F.lit("00")))
    )
    text = F.concat(year, F.lit("-"), F.lpad(x["m"], 2, "0"), F.lit("-"), F.lpad(x["d"], 2, "0"), F.lit(" "), time, x["zone"])
    return let(
        text,
        lambda v: F.unix_timestamp(
            F.try_to_timestamp(v, F.when(F.length(v) == 19, "yyyy-MM-dd HH:mm:ss").otherwise("yyyy-MM-dd HH:mm:ssXXX"))
        )
    )


def _zone(text: Column) -> Column:
    z = F.regexp_extract(text, r":\d{2}\s*(Z|[+-]\d{2}:?\d{2})\b", 1)
    return F.when(
        (z != "") & (z != "Z") & ~F.contains(z, F.lit(":")), F.concat(F.substring(z, 1, 3), F.lit(":"), F.substring(z, 4, 2))
    ).otherwise(z)


def _relative(text: Column, now: Column) -> Column:
    midnight = F.unix_timestamp(F.date_trunc("day", F.timestamp_seconds(now)))
    n = F.regexp_extract(text, r"(\d+)\s*(?:秒|分钟|小时|天|周|个?月|年)前", 1).try_cast("long")
    clock = F.regexp_extract(text, rf"({_TIME})", 1)
    parts = F.split(clock, ":")
    seconds = F.when(clock == "", 0).otherwise(
        parts[0].try_cast("long") * 3600 + F.get(parts, 1).try_cast("long") * 60 + F.coalesce(F.get(parts, 2).try_cast("long"), F.lit(0))
    )
    out = F.when(F.contains(text, F.lit("刚刚")), now - 3)
    for word, size, at_midnight in (
        ("秒前", 1, False), ("分钟前", 60, False), ("小时前", 3600, False), ("天前", 86400, True), ("周前", 7 * 86400, True), ("月前", 30 * 86400, True),
        ("年前", 365 * 86400, True)
    ):
        out = out.when(F.contains(text, F.lit(word)), (midnight if at_midnight else now) - n * size)
    for word, days in (("今天", 0), ("昨天", 1), ("前天", 2)):
        out = out.when(F.contains(text, F.lit(word)), midnight - days * 86400 + seconds)
    return out


def parse_date(text: Column, now: Column | int) -> Column:
    """Epoch seconds of a date text; NULL for an empty or unreadable one."""
    now = (now if isinstance(now, Column) else F.lit(now)).cast("long")
    return let(F.trim(text), lambda t: _parse(t, now))


def _parse(t: Column, now: Column) -> Column:
    """The date of a text by its family: every family but the relative ones gives year, month, day, clock and zone, which are read once."""
    today = F.date_format(F.timestamp_seconds(now), "yyyy-MM-dd")
    this_year = F.substring(today, 1, 4)
    clock, zone, none, first = F.regexp_extract(t, rf"({_TIME})", 1), _zone(t), F.lit(""), F.lit("1")

    def has(*words: str) -> Column:
        return reduce(or_, (F.contains(t, F.lit(w)) for w in words))

    def part(k: int, pattern: str) -> Column:
        return F.regexp_extract(t, pattern, k)

    def date(y: Column, m: Column, d: Column, c: Column, z: Column) -> Column:
        return F.struct(y.alias("y"), m.alias("m"), d.alias("d"), c.alias("clock"), z.alias("zone"))

    def family(pattern: str, order: str, c: Column, z: Column) -> Column:
        """The date whose letters of `order` (y, m, d) are the groups of the pattern; a missing year is this one, a missing day the first."""
        at = {letter: part(k, pattern) for k, letter in enumerate(order, 1)}
        return date(at.get("y", this_year), at["m"], at.get("d", first), c, z)

    cn, cn_month, cn_short = r"(\d{4}|\d{2})年\s*(\d{1,2})月\s*(\d{1,2})日?", r"(\d{4}|\d{2})年\s*(\d{1,2})月", r"^(\d{1,2})月(\d{1,2})日"
    full, year_month, short = r"^(\d{4}|\d{2})[-/.](\d{1,2})[-/.](\d{1,2})(?!\d)", r"^(\d{4})[-/.](\d{1,2})$", r"^(\d{1,2})[-/.](\d{1,2})(?![-/.\d])"
    english = r"(?i)\b([A-Za-z]{3,9})\.? (\d{1,2}),? (?:" + _TIME + r" ?)?(?:[+-]\d{4} )?(\d{4})\b"
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.substring(part(1, english), 1, 3))).cast("string")
    english_zone = F.regexp_replace(part(1, r"([+-]\d{4}) \d{4}$"), r"^(...)(..)$", "$1:$2")
    relative = has("前", "刚刚", "今天", "昨天") & F.regexp_like(t, F.lit("刚刚|(?:秒|分钟|小时|天|周|月|年)前|今天|昨天|前天"))

    def fits(pattern: str) -> Column:
        return F.regexp_like(t, F.lit(pattern))

    # a search for plain words, or for three letters, spares most texts the patterns of other families
    found = (
        F.when(has("年") & fits(cn), family(cn, "ymd", clock, zone))
        .when(has("年") & fits(cn_month), family(cn_month, "ym", none, none))
        .when(has("月") & fits(cn_short), family(cn_short, "md", clock, none))
        .when(relative, F.lit(None))
        .when(fits("[A-Za-z]{3}") & fits(english), date(part(3, english), month, part(2, english), clock, english_zone))
        .when(fits(full), family(full, "ymd", clock, zone))
        .when(fits(year_month), family(year_month, "ym", none, none))
        .when(fits(short), family(short, "md", clock, none))
        .when(fits(rf"^{_TIME}$"), date(this_year, F.substring(today, 6, 2), F.substring(today, 9, 2), clock, none))
    )
    return let(found, lambda x: F.when(x.isNotNull(), _stamp(x)).when(relative, _relative(t, now)).when(fits(r"^\d+$"), t.try_cast("long")))


def find_date(page: Column) -> Column:
    """The text of the publish date in a page: by the first rule with any hit, its only hit or its first one with a time; NULL if none."""

    def choose(hits: Column) -> Column:
        timed = F.get(F.filter(hits, lambda h: F.contains(h, F.lit(":"))), 0)
        return F.when(F.size(hits) == 1, hits[0]).otherwise(timed)

    def first_rule(p: Column, rules: tuple[str, ...]) -> Column:
        """Hits of the first rule with any; a later rule is tried only where the ones before have none."""
        hits = F.regexp_extract_all(p, F.lit(rules[0]), F.lit(1))
        return let(hits, lambda h: F.when(F.size(h) > 0, h).otherwise(first_rule(p, rules[1:]))) if len(rules) > 1 else hits

    dated = let(page, lambda p: F.when(F.regexp_like(p, F.lit(r"\d[-/年]\d")), first_rule(p, DATE_RULES)))
    return let(dated, choose)
