"""Compilers of the page-pattern mini-language and of delimited regular expressions to Java regex strings (driver side)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPECIAL = re.compile(r"([.\\+?^$(){}|\[\]])")
_TOKEN = re.compile(r"\[r=(?P<rname>\w+)\](?P<regex>.*?)\[/r\]|\[\*\]|\[(?P<name>\w+)\]", re.S)


def _java_group(pattern: str) -> str:
    """(?P<name>...) and inner capturing groups as plain non-capturing ones, so that group numbers stay ours."""
    return re.sub(r"(?<!\\)\((?!\?)", "(?:", re.sub(r"\(\?P<\w+>", "(?:", pattern))


def rule_to_pattern(rule: str) -> tuple[str, dict[str, int]]:
    """`a[*]b[name]c` and `[r=name]regex[/r]` to (regex, group number of each name).

    [*] matches anything, [name] captures anything, both as little as possible; other text is literal.
    A rule that starts with `regex:` is a regular expression already.
    """
    if rule.startswith("regex:"):
        return _validated(re.sub(r"\(\?P<\w+>", "(", rule[6:])), {}
    out, names, at = [], {}, 0
    for m in _TOKEN.finditer(rule):
        out.append(_SPECIAL.sub(r"\\\1", rule[at : m.start()]))
        at = m.end()
        if m.group(0) == "[*]":
            out.append(".*?")
            continue
        name = m.group("rname") or m.group("name")
        names.setdefault(name, len(names) + 1)
        out.append(f"({_java_group(m.group('regex'))})" if m.group("rname") else "(.+?)" if m.end() < len(rule) else "(.+)")
    out.append(_SPECIAL.sub(r"\\\1", rule[at:]))
    return _validated("".join(out)), names


def _validated(pattern: str) -> str:
    """The pattern, after a check that it compiles; a bad rule fails here and not inside a job."""
    try:
        re.compile(pattern)
    except re.error as e:
        raise ValueError(f"not a regular expression: {pattern!r}: {e}") from e
    return pattern


def preg(data: Column, rule: str) -> Column:
    """First match of a page pattern, stripped: its first captured part, else the whole match; NULL if none."""
    pattern, names = rule_to_pattern(rule)
    full = "(?si)" + pattern
    group = 1 if names or re.compile(pattern).groups else 0
    return F.when(F.regexp_like(data, F.lit(full)), F.trim(F.regexp_extract(data, full, group)))


def rule_to_subitem(rule: str, subject: Column) -> Column:
    """Substitution rule `pattern=>replacement`; [name] in the replacement stands for the captured part."""
    left, _, right = rule.partition("=>")
    pattern, names = rule_to_pattern(left)
    replacement = re.sub(r"([\\$])", r"\\\1", right)
    for name, number in names.items():
        replacement = replacement.replace(f"[{name}]", f"${number}")
    return F.regexp_replace(subject, "(?si)" + pattern, replacement)


def pcre_to_regex(pattern: str) -> str:
    """`/regex/flags` to `(?flags)regex`; other text is returned as it is.  Flags i, m, s and x are kept."""
    m = re.fullmatch(r"([/#~@!%])(.*)\1([a-zA-Z]*)", pattern, re.S)
    if not m:
        return pattern
    flags = "".join(f for f in "imsx" if f in m.group(3))
    return _validated((f"(?{flags})" if flags else "") + m.group(2))
