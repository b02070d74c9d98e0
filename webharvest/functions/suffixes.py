"""Public suffixes and registered domains, by rules in the published form: `com.ar`, `*.ck`, `!www.ck`.

The rules become one trie over labels, the last label first, and the trie one regular expression that takes the
longest suffix of a host in a single pass; so a lookup costs the length of the suffix, whatever the number of rules.
Lists are read from lines or from a table; a short list is built in.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Registries that register names under second levels, with those second levels.
SECOND_LEVELS = {
    "com net org gov edu": "af ag ai al ar az ba bb bh bm bn bo br bs bt by bz cn co cu do dm dz ec eg es et fj ge gh gi gn gp gr gt gu hk hn ht iq jo kg ki km "
    "ky kz lb lc lk lr lv ly mg mk ml mo ms mt mu mv mw mx my na ng ni nr om pa pe pf ph pk pl pr ps pt py qa ro sa sb sc sd sg sh sl sn so sv sy tj tm tn "
    "to tr tt tw ua uy vc ve vi vn vu ws ye zm",
    "ac mil": "cn", "com net org edu gov id asn": "au", "co org me ac gov ltd plc net sch nhs police": "uk", "co ne or ac go ad ed gr lg": "jp",
    "co net org ac govt geek gen iwi maori school": "nz", "co net org gov ac firm gen ind edu res mil nic": "in", "co ne or go ac re pe hs ms es sc mil": "kr",
    "idv": "tw hk", "co net org gov ac edu law mil nom school web": "za", "gob": "mx ar pe es cl ec gt hn ni pa sv ve bo py", "co org net ac gov k12 muni idf": "il",
    "ac co go in mi net or": "th", "ac biz co go mil my net or sch web": "id", "ac co go info me mobi ne or sc": "ke", "ac co go me mil ne or sc": "tz",
    "ac co com go ne or org sc": "ug", "ac co ed fi go or sa": "cr", "ac co gv or": "at", "ac co edu gov in org": "rs", "ac co gov mil org": "zw", "co org": "bw",
    "co ed gv it og pb": "ao", "co com net org ac": "im", "gub mil": "uy", "adm adv art blog eng ind inf jus leg mil mp tur tv": "br", "biz info name": "tr pk tt az",
    "asso com gouv nom prm tm": "fr", "ac net org sch gov co id": "ir", "msk spb com org net": "ru", "co org net gov edu info": "hu",
}
# Wildcard and exception rules of registries.
WILDCARDS = "*.bd *.ck !www.ck *.er *.fk *.jm *.kh *.mm *.np *.pg".split() + [
    rule for city in "kawasaki kitakyushu kobe nagoya sapporo sendai yokohama".split() for rule in (f"*.{city}.jp", f"!city.{city}.jp")
]
# Suffixes in scripts of their own.
NATIVE = "中国 中國 公司.cn 网络.cn 網絡.cn 香港 公司.香港 教育.香港 政府.香港 組織.香港 網絡.香港 台湾 台灣 한국 рф бг срб укр ไทย მდ भारत".split()
# Hosting services that give names to their customers.
PRIVATE = (
    "github.io gitlab.io bitbucket.io blogspot.com herokuapp.com netlify.app vercel.app web.app firebaseapp.com pages.dev workers.dev appspot.com "
    "azurewebsites.net cloudfront.net s3.amazonaws.com *.compute.amazonaws.com fly.dev glitch.me surge.sh readthedocs.io weebly.com neocities.org"
).split()
_BEGIN_PRIVATE = "===BEGIN PRIVATE DOMAINS==="


def _ascii(label: str) -> str:
    return label if label.isascii() else "xn--" + label.encode("punycode").decode("ascii")


class _Node:
    def __init__(self):
        self.children: dict[str, _Node] = {}
        self.ends = self.any = False
        self.exceptions: set[str] = set()


def _letters(words: dict[str, str]) -> str:
    """A pattern of one of the words, each followed by its own pattern, without trying words of another first letter."""
    if "" in words:
        rest = {w: p for w, p in words.items() if w}
        return f"(?:{_letters(rest)}|{words['']})" if rest else words[""]
    groups: dict[str, dict[str, str]] = {}
    for word, pattern in words.items():
        groups.setdefault(word[0], {})[word[1:]] = pattern
    parts = [re.escape(letter) + _letters(group) for letter, group in sorted(groups.items())]
    return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"


class SuffixRules:
    """Rules of the published form.  A label in a script of its own is known in that script and in its ASCII form.

    Lines of the published file can be passed as they are: comments and empty lines are skipped, and with private=False
    what stands behind the mark of private domains.
    """

    def __init__(self, lines: Iterable[str], private: bool = True):
        self.exact: set[str] = set()
        self.wild: set[str] = set()
        self.exceptions: set[str] = set()
        for line in lines:
            if _BEGIN_PRIVATE in line and not private:
                break
            rule = line.split("//")[0].strip().lower()
            if not rule:
                continue
            rule = rule.split()[0].strip(".")
            kind = self.exceptions if rule[0] == "!" else self.wild if rule.startswith("*.") else self.exact
            rule = rule.removeprefix("!").removeprefix("*.")
            if not rule or "*" in rule or "!" in rule:
                raise ValueError(f"not a suffix rule: {line!r}")
            kind |= {rule, ".".join(map(_ascii, rule.split(".")))}
        root = _Node()

        def at(rule: str) -> _Node:
            node = root
            for label in reversed(rule.split(".")):
                node = node.children.setdefault(label, _Node())
            return node

        for rule in self.exact:
            at(rule).ends = True
        for rule in self.wild:
            at(rule).any = True
        for rule in self.exceptions:
            label, _, rest = rule.partition(".")
            at(rest).exceptions.add(label)
        #: The longest suffix of a host whose labels are in reverse order, and one label more.
        self.pattern = rf"^(?>{self._below(root)}|[^.]+)\.[^.]+"

    def _below(self, node: _Node, depth: int = 1) -> str:
        """A pattern of what can follow a node: its children, each with the longest of what follows it."""
        words = {}
        for label, child in node.children.items():
            further = [self._below(child, depth + 1)] if child.children else []
            but = rf"(?:{'|'.join(map(re.escape, sorted(child.exceptions)))})(?=\.|$)"
            if child.any:
                further.append((rf"(?!{but})" if child.exceptions else "") + r"[^.]+")
            more = rf"\.(?:{'|'.join(further)})" if further else ""
            if child.exceptions:  # what stands before an exception is a suffix
                more = rf"(?:{more}|(?=\.{but}))"
            if more and (child.ends or depth == 1):
                more = f"(?:{more})?"
            words[label] = more + r"(?=\.|$)"
        return _letters(words) if words else "(?!)"

    def domain(self, host: Column) -> Column:
        """Registered domain of a lower-case host: its public suffix and one label; NULL where there is no such label."""
        def turned(h: Column) -> Column:
            return F.array_join(F.reverse(F.split(h, r"\.")), ".")

        return turned(F.nullif(F.regexp_extract(turned(host), self.pattern, 0), F.lit("")))

    def suffix(self, host: Column) -> Column:
        """Public suffix of a lower-case host that has a registered domain."""
        return F.regexp_extract(self.domain(host), r"^[^.]*\.(.*)$", 1)

    def plain_domain(self, host: str) -> str | None:
        """The same by the published steps, for tests: the longest rule that fits, exceptions before all, else the last label."""
        labels = host.split(".")
        if "" in labels:
            return None
        size = 1
        for k in range(1, len(labels) + 1):
            tail = ".".join(labels[-k:])
            if tail in self.exceptions:
                size = k - 1
                break
            if tail in self.exact or k > 1 and ".".join(labels[1 - k :]) in self.wild:
                size = k
        return ".".join(labels[-size - 1 :]) if len(labels) > size else None


def suffix_rules(table: DataFrame, column: str = "rule", most: int = 50_000) -> SuffixRules:
    """Rules of a table with a rule in each row; a table of more than `most` rows is refused, none is cut."""
    rows = [r[0] for r in table.select(column).where(F.col(column).isNotNull()).limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"over {most} suffix rules")
    return SuffixRules(rows)


@lru_cache(maxsize=1)
def default_rules() -> SuffixRules:
    pairs = [f"{second}.{top}" for seconds, tops in SECOND_LEVELS.items() for second in seconds.split() for top in tops.split()]
    return SuffixRules([*pairs, *WILDCARDS, *NATIVE, *PRIVATE])
