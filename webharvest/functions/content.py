"""What the content search needs of a page's nodes, found in one pass where the page is parsed.

Stretches of text between block boundaries, stopwords of paragraphs, link density, and the scores that paragraphs give
to the nodes above them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import lru_cache

import ahocorasick

from .text import PUNCTUATION, STOPWORDS, STOPWORDS_ZH

#: Tags whose text can count for a content node, in the order in which they are taken.
CANDIDATES = ("p", "pre", "td")
_DROP = str.maketrans("", "", PUNCTUATION)


class _Counter:
    """Stopwords of a text: of spaced languages its words that are stopwords, of zh the different stopwords that it holds."""

    def __init__(self, lang: str, words: Sequence[str]):
        self.lang, self.words = lang, frozenset(words)
        if lang == "zh":
            self.automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
            for word in self.words:
                self.automaton.add_word(word)
            self.automaton.make_automaton()
            # a stopword inside another one is met at the same place or before it
            self.inner = {w: {v for v in self.words if v in w} for w in self.words}

    def __call__(self, text: str) -> int:
        if self.lang != "zh":
            return sum(w in self.words for w in text.lower().translate(_DROP).split(" "))
        met: set[str] = set()
        for end, size in self.automaton.iter(text):
            word = text[end - size + 1 : end + 1]
            if word not in met:
                met |= self.inner[word]
        return len(met)


@lru_cache(maxsize=64)
def _counter(lang: str, words: tuple[str, ...]) -> _Counter:
    return _Counter(lang, words)


def counter(lang: str, lists: Mapping[str, Sequence[str]] | None = None) -> _Counter:
    """The counter of a language; one without a list takes English."""
    words = (lists or {}).get(lang) or (STOPWORDS_ZH if lang == "zh" else STOPWORDS.get(lang))
    return _counter(lang, tuple(words or (lists or {}).get("en") or STOPWORDS["en"]))


def language(nodes: list[dict]) -> str:
    """Two letters of the language that a page names, lower case; en if it names none."""
    root = next((n["attrs"].get("lang") for n in nodes if n["tag"] == "html"), None)
    metas = [n["attrs"] for n in nodes if n["tag"] == "meta"]
    header = next((m.get("content") for m in metas if (m.get("http-equiv") or "").lower() == "content-language"), None)
    named = next((m.get("content") for m in metas if (m.get("name") or "").lower() == "lang"), None)
    found = next((x for x in (root or None, header, named.strip() if named is not None else None) if x is not None), "en")
    return found[:2].lower()


def is_dense(zh: bool, text: str, links: int, words: int, chars: int) -> bool:
    """Whether a text is mostly links: link words / words * links >= 1; words of zh are characters."""
    if not links:
        return False
    size = (len(text) if zh else text.count(" ") + 1) if text else 0
    return not size or (chars if zh else words) / size * links >= 1.0


def _blocks(nodes: list[dict], pieces: list[tuple[int, str]], breaks: set[int], boundary: frozenset[str], zh: bool) -> None:
    """`blocks` of every node: (place, text, dense) of the stretches of text that it is the innermost block of."""
    raw = {n["order"] for n in nodes if n["tag"] in ("script", "style", "noscript")}
    link, owner = [], []  # of each node: the link that it is in, the innermost block
    for n in nodes:
        up = n["parent"]
        link.append(n["order"] if n["tag"] == "a" else link[up] if up >= 0 else -1)
        owner.append(n["order"] if n["tag"] in boundary or up < 0 else owner[up])
        n["blocks"] = []
    bounds = sorted(b for b in breaks if b < len(pieces)) + [len(pieces)]
    for a, b in zip(bounds, bounds[1:]):
        inside = [(k, t) for k, t in pieces[a:b] if k not in raw]
        text = " ".join("".join(t for _, t in inside).split())
        if not text:
            continue
        linked: dict[int, str] = {}
        for k, t in inside:
            if link[k] >= 0:
                linked[link[k]] = linked.get(link[k], "") + t
        said = [t.split() for t in linked.values()]
        dense = is_dense(zh, text, len(linked), sum(map(len, said)), sum(len(" ".join(w)) for w in said))
        nodes[owner[next(k for k, t in inside if t.strip())]]["blocks"].append((a, text, dense))


def _scores(nodes: list[dict], zh: bool) -> None:
    """`score` and `source`: what candidates give to a node, and the first that gave; None where none did.

    Candidates (p, pre, td; not link-dense; more than two stopwords, of zh more than three characters) give their
    stopwords and boost to the parent, half of it to the grandparent.  Boost: 50/k for the k-th candidate one of
    whose three nearest earlier sibling paragraphs has over five stopwords; among over 15 candidates the last
    quarter is lowered.
    """
    earlier: dict[int, list[int]] = {}
    boosted = set()
    for n in nodes:
        before = earlier.setdefault(n["parent"], [])
        if any(stops > 5 for stops in before[-3:]):
            boosted.add(n["order"])
        if n["tag"] == "p" and not n["junk"]:
            before.append(n["stops"])
    good = [
        n for tag in CANDIDATES for n in nodes
        if n["tag"] == tag and not n["junk"] and not n["dense"] and (len(n["text"]) > 3 if zh else n["stops"] > 2)
    ]
    total, tail, nth = len(good), 0.25 * len(good), 0
    for i, n in enumerate(good):
        boost = 0.0
        if n["order"] in boosted:
            nth += 1
            boost = 50.0 / nth
        if total > 15 and total - i <= tail:
            b = tail - (total - i)
            boost = 5.0 if b * b > 40 else -b * b
        up = int(n["stops"] + boost)
        parent = n["parent"]
        grand = nodes[parent]["parent"] if parent >= 0 else -1
        for to, score in ((parent, up), (grand, int(up / 2))):
            if to >= 0:
                node = nodes[to]
                node["score"] = (node["score"] or 0) + score
                node["source"] = n["order"] if node["source"] is None else min(node["source"], n["order"])


def add_content(
    nodes: list[dict], pieces: list[tuple[int, str]], breaks: set[int], boundary: frozenset[str], lang: str | None = None,
    lists: Mapping[str, Sequence[str]] | None = None
) -> None:
    """Adds to every node its `blocks`; `stops`, the stopwords of candidates; `dense`, whether it is mostly links; `told`, whether
    it holds a paragraph with text; and `score` with `source`."""
    lang = (lang or language(nodes))[:2].lower()
    zh, count = lang == "zh", counter(lang, lists)
    for n in nodes:
        n["dense"] = is_dense(zh, n["text"], n["links"], n["link_words"], n["link_chars"])
        n["stops"] = count(n["text"]) if n["tag"] in CANDIDATES and not n["junk"] else 0
        n["told"], n["score"], n["source"] = False, None, None
    for n in nodes:
        if n["tag"] == "p" and n["text"] and not n["junk"]:
            up = n["parent"]
            while up >= 0 and not nodes[up]["told"]:
                nodes[up]["told"] = True
                up = nodes[up]["parent"]
    _blocks(nodes, pieces, breaks, boundary, zh)
    _scores(nodes, zh)
