"""HTML pages to flat node arrays (one vectorised helper), and rule selectors over them as Column expressions.

Rules of repair: script and style hold raw text; comments are dropped; an open p, li, td, th, tr, option, dt or
dd is closed by the next one of its kind, and p by any block; end tags without a start are ignored; what is
still open at the end is closed there.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Mapping, Sequence
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type

from .content import add_content
from .urls import let

_INT, _TEXT, _FLAG = pa.int32(), pa.string(), pa.bool_()
#: A stretch of text between two block boundaries: its place in the page, and whether it is mostly links.
_BLOCK_ROW = pa.struct([("place", _INT), ("text", _TEXT), ("dense", _FLAG)])
_NODE_ROW = pa.struct(
    [(n, _INT) for n in ("order", "parent", "last", "depth", "start", "inner", "inner_end", "end", "nth", "nth_last")]
    + [("tag", _TEXT), ("attrs", pa.map_(_TEXT, _TEXT)), ("text", _TEXT), ("own", _TEXT), ("junk", _FLAG), ("dense", _FLAG), ("told", _FLAG)]
    + [(n, _INT) for n in ("links", "link_words", "link_chars", "stops", "score", "source")]
    + [("blocks", pa.list_(_BLOCK_ROW))]
)
NODES = T.ArrayType(from_arrow_type(_NODE_ROW))
#: Bytes of html whose nodes a task holds at once, and what a page counts for beside its own: a page's nodes take some forty times its html.
SLICE_BYTES, PAGE_BYTES = 1 << 19, 256
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()
)
CLOSES = {
    "li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}, "dt": {"dt", "dd"},
    "dd": {"dt", "dd"}
}
STOPS = {
    "li": {"ul", "ol"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "tr": {"table", "tbody", "thead"}, "option": {"select"}, "dt": {"dl"},
    "dd": {"dl"}
}
# Ids, classes and names of page furniture, and of social and caption boxes.
JUNK = (
    r"^side$|combx|retweet|mediaarticlerelated|menucontainer|navbar|storytopbar-bucket|utility-bar|inline-share-tools|comment|PopularQuestions|contact|foot|footer|Footer|footnote|cnn_strycaptiontxt|cnn_html_slideshow|cnn_strylftcntnt|^links$|meta$|shoutbox|sponsor"
    r"|tags|socialnetworking|socialNetworking|cnnStryHghLght|cnn_stryspcvbx|^inset$|pagetools|post-attributes|welcome_form|contentTools2|the_answers|communitypromo|runaroundLeft|subscribe|vcard|articleheadings|date|^print$|popup|author-dropdown|tools|socialtools|byline"
    r"|konafilter|KonaFilter|breadcrumbs|^fn$|wp-caption-text|legende|ajoutVideo|timestamp|js_replies|disclaim"
)
SOCIAL = (r"^caption$", r" google ", r"^[^entry-]more.*$", r"[^-]facebook", r"facebook-broadcasting", r"[^-]twitter")


#: Comments, declarations, tags (end mark, name, attributes); anything else is text.
#: Possessive, so that a tag is read once; where one finds no end mark outside quotes, there is none behind it either.
TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:\s++|/|[^\s/>=]++(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?)?|=)*+)(>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s/>=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"'][^\s>]*+))?)?")
#: Elements whose content is text up to their end tag; in the last two, character references count.
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in ("script", "style", "title", "textarea")}


#: Elements at whose start and end a stretch of text ends, beside a br.
BOUNDARY = BLOCK | frozenset(
    "body button caption center dd details dt fieldset figcaption figure html iframe legend li object option select summary tbody td textarea tfoot th thead title tr"
    .split()
)


class _Builder:
    def __init__(self, junk: re.Pattern):
        self.nodes: list[dict] = []
        self.open: list[int] = []
        self.junk = junk
        self.pieces: list[tuple[int, str]] = []  # (open node, text) in order
        self.breaks: set[int] = {0}  # pieces before which a block begins or ends
        self.begin = self.at = 0  # of the last tag

    def feed(self, page: str) -> None:
        at = 0
        while m := TOKEN.search(page, at):
            if m[2] is not None and not m[4]:
                break  # it never ends: it and all behind it is text
            self.handle_data(unescape(page[at : m.start()]))
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            self.begin, self.at = m.start(), at
            if m[1]:
                self.handle_endtag(tag)
                continue
            self.handle_starttag(tag, [(k.lower(), unescape(a or b or c)) for k, a, b, c in ATTRIBUTE.findall(m[3])], m.start())
            if m[3].endswith("/") and tag not in VOID:
                self.begin = at
                self.handle_endtag(tag)
            elif tag in RAW_END:
                end = RAW_END[tag].search(page, at)
                text = page[at : end.start() if end else len(page)]
                self.handle_data(text if tag in ("script", "style") else unescape(text))
                at += len(text)
        self.handle_data(unescape(page[at:]))
        self.begin = self.at = len(page)

    def _close_to(self, position: int, end: int | None = None) -> None:
        for k in self.open[position:]:
            node = self.nodes[k]
            node["last"] = len(self.nodes) - 1
            node["stop"] = len(self.pieces)
            node["inner_end"] = self.begin if end is None else end
            node["end"] = self.at if end is None else end
            if node["tag"] in BOUNDARY:
                self.breaks.add(len(self.pieces))
        del self.open[position:]

    def handle_starttag(self, tag, attrs, start):
        if tag in BLOCK:
            for i in range(len(self.open) - 1, -1, -1):
                if self.nodes[self.open[i]]["tag"] == "p":
                    self._close_to(i, start)
                    break
                if self.nodes[self.open[i]]["tag"] in ("td", "li", "div", "article", "section", "body"):
                    break
        for i in range(len(self.open) - 1, -1, -1):
            name = self.nodes[self.open[i]]["tag"]
            if name in STOPS.get(tag, ()):
                break
            if name in CLOSES.get(tag, ()):
                self._close_to(i, start)
                break
        values = dict(reversed(attrs))
        parent = self.open[-1] if self.open else -1
        up = self.nodes[parent] if parent >= 0 else None
        bad = bool(up and up["junk"]) or tag in ("script", "style", "noscript") or (
            tag not in ("html", "body", "article") and any(
                self.junk.search(values.get(a, "")) for a in ("id", "class", "name") if values.get(a)
            )
        )
        if tag in BOUNDARY:
            self.breaks.add(len(self.pieces))
        self.nodes.append(
            {
                "order": len(self.nodes), "parent": parent, "last": len(self.nodes), "depth": len(self.open), "tag": tag, "attrs": values,
                "junk": bad, "first": len(self.pieces), "stop": len(self.pieces), "start": start, "inner": self.at,
                "inner_end": self.at, "end": self.at
            }
        )
        if tag not in VOID:
            self.open.append(len(self.nodes) - 1)
        elif tag == "br" and self.open:
            self.pieces.append((self.open[-1], "\n"))
            self.breaks.add(len(self.pieces))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.nodes[self.open[i]]["tag"] == tag:
                self._close_to(i + 1, self.begin)
                self._close_to(i)
                return

    def handle_data(self, data):
        if self.open and data:
            self.pieces.append((self.open[-1], data))


@lru_cache(maxsize=4)
def _junk(extra: str) -> re.Pattern:
    return re.compile("|".join([JUNK, *SOCIAL, *([extra] if extra else [])]), re.I)


def _texts(builder: _Builder) -> None:
    """`text` of every node, its inner text with single spaces, scripts and styles left out but for their own; `own`, the
    text directly in it; `nth` and `nth_last`, its place among its siblings from either end."""
    nodes, pieces = builder.nodes, builder.pieces
    raw = {n["order"] for n in nodes if n["tag"] in ("script", "style")}
    places, parts, size, spaced = [0], [], 0, True
    for node, text in pieces:
        if node not in raw:
            words = text.split()
            if not words:
                text = "" if spaced or not text else " "
            else:
                text = ("" if spaced or not text[0].isspace() else " ") + " ".join(words) + (" " if text[-1].isspace() else "")
            if text:
                parts.append(text)
                size += len(text)
                spaced = text[-1] == " "
        places.append(size)
    whole = "".join(parts)
    own: dict[int, list[str]] = {}
    for node, text in pieces:
        own.setdefault(node, []).append(text)
    children: dict[int, list[dict]] = {}
    for n in nodes:
        children.setdefault(n["parent"], []).append(n)
    for siblings in children.values():
        for k, n in enumerate(siblings):
            n["nth"], n["nth_last"] = k + 1, len(siblings) - k
    for n in nodes:
        n["own"] = " ".join("".join(own.get(n["order"], ())).split())
        if n["order"] in raw:
            n["text"] = " ".join("".join(t for _, t in pieces[n["first"] : n["stop"]]).split())
        else:
            n["text"] = whole[places[n["first"]] : places[n["stop"]]].strip()


def parse(html: str | None, extra_junk: str = "", lang: str | None = None, lists: Mapping[str, Sequence[str]] | None = None) -> list[dict]:
    """Nodes in document order.

    `order` is a node's place in the array, `last` the order of its last descendant, `start` and `end` its place in
    the page, `inner` and `inner_end` that of its content, `text` its inner text with single spaces; `links`, `link_words` and `link_chars` count the links below it
    and their text; `blocks` are the stretches of text that it is the innermost block of.  `stops`, `dense`, `told`,
    `score` and `source` are described in `content`; they go by `lang`, else by the page's own language, and by `lists`.
    """
    builder = _Builder(_junk(extra_junk))
    builder.feed(html or "")
    builder._close_to(0)
    _texts(builder)
    out = builder.nodes
    for n in out:
        n["links"] = n["link_words"] = n["link_chars"] = 0
    for n in reversed(out):  # what is below a node comes behind it
        if n["parent"] >= 0:
            up, link = out[n["parent"]], n["tag"] == "a"
            up["links"] += n["links"] + link
            up["link_words"] += n["link_words"] + (len(n["text"].split()) if link else 0)
            up["link_chars"] += n["link_chars"] + (len(n["text"]) if link else 0)
    add_content(out, builder.pieces, builder.breaks, BOUNDARY, lang, lists)
    return out


_FIELDS = [(f.name, f.type) for f in _NODE_ROW if f.name not in ("attrs", "blocks")]


def _columns(pages: list[list[dict]]) -> pa.Array:
    """The nodes of many pages as one Arrow array, made column by column."""
    rows = [n for page in pages for n in page]
    columns = {name: pa.array([n[name] for n in rows], kind) for name, kind in _FIELDS}
    ends = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(n["attrs"]) for n in rows], out=ends[1:])
    columns["attrs"] = pa.MapArray.from_arrays(
        pa.array(ends), pa.array([k for n in rows for k in n["attrs"]], _TEXT), pa.array([v for n in rows for v in n["attrs"].values()], _TEXT)
    )
    blocks = [b for n in rows for b in n["blocks"]]
    ends = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(n["blocks"]) for n in rows], out=ends[1:])
    fields = [pa.array([b[k] for b in blocks], f.type) for k, f in enumerate(_BLOCK_ROW)]
    columns["blocks"] = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(fields, fields=list(_BLOCK_ROW)))
    ends = np.zeros(len(pages) + 1, np.int32)
    np.cumsum([len(p) for p in pages], out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([columns[f.name] for f in _NODE_ROW], fields=list(_NODE_ROW)))


def _slices(html: pa.Array, most: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """The array in slices of about `most` bytes of html, a page at least."""
    at, size = 0, 0
    for k, n in enumerate(pc.fill_null(pc.binary_length(html), 0).to_pylist()):
        if k > at and size + n > most:
            yield html.slice(at, k - at)
            at, size = k, 0
        size += n + PAGE_BYTES
    if at < len(html):
        yield html.slice(at)


@lru_cache(maxsize=8)
def _parser(application: str, lang: str | None, lists: str):
    """One function object per Spark application and options, so that Spark sees equal calls on a page as one and parses it once."""
    known = json.loads(lists)

    @F.arrow_udf(NODES)
    def parsed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for html in batches:
            for some in _slices(html):
                yield _columns([parse(x, lang=lang, lists=known) for x in some.to_pylist()])

    return parsed


def html_nodes(html: Column | str, lang: str | None = None, lists: Mapping[str, Sequence[str]] | None = None) -> Column:
    """The nodes of each page; a null page has none.

    Content is scored with the stopwords of `lang`, else of the language that the page names, else of English;
    `lists` (language to words) replace or extend the built-in stopwords.
    """
    return _parser(SparkContext.getOrCreate().applicationId, lang, json.dumps(lists))(html)


def tags(nodes: Column, *names: str) -> Column:
    return F.filter(nodes, lambda n: n["tag"].isin(*names))


def by_attr(nodes: Column, attr: str, value: str, tag: str | None = None) -> Column:
    """Nodes whose attribute matches a case-insensitive regular expression."""
    def test(n: Column) -> Column:
        hit = F.coalesce(F.regexp_like(F.try_element_at(n["attrs"], F.lit(attr)), F.lit("(?i)" + value)), F.lit(False))
        return hit & (n["tag"] == tag) if tag else hit

    return F.filter(nodes, test)


def attr(node: Column, name: str) -> Column:
    return F.try_element_at(node["attrs"], F.lit(name))


#: Encodings of pages that declare none, each with characters that are frequent in its texts and about their share there.
FREQUENT = {
    "gb18030": ("的一是不了在人有我他这个们中来上大为和国地到以说时要就出会可也你对生能而子那得于着下自之年过发后作里", 0.25),
    "big5": ("的一是不了在人有我他這個們中來上大為和國地到以說時要就出會可也你對生能而子那得於著下自之年過發後作裡", 0.25),
    "shift_jis": ("のにはをたがでてとしれさいるなもこまらりかくっよスンルトラドイアクリー、。", 0.5),
    "euc_jp": ("のにはをたがでてとしれさいるなもこまらりかくっよスンルトラドイアクリー、。", 0.5),
    "euc_kr": ("이다는을가에의로고하지은를한서도기사자리있어나그대시인정수해것들", 0.45),
    "windows-1251": ("оеаинтсрвлкмдпуяыьгзбчйхжш", 0.85),
    "koi8-r": ("оеаинтсрвлкмдпуяыьгзбчйхжш", 0.85),
}
_FREQUENT = {name: (frozenset(chars), share) for name, (chars, share) in FREQUENT.items()}


def likely_charset(content: bytes) -> str | None:
    """The encoding whose frequent characters a text has most of, among those that can decode it whole; NULL if none has a third of its usual share."""
    best = (0.33, None)
    for name, (chars, share) in _FREQUENT.items():
        try:
            text = content.decode(name)
        except UnicodeDecodeError:
            continue
        odd = [c for c in text if c > "\x7f"]
        if odd:
            best = max(best, (sum(c in chars for c in odd) / len(odd) / share, name), key=lambda x: x[0])
    return best[1]


def decode_page(content: Column | str) -> Column:
    """Bytes of a page to text by its declared charset (gb2312 read as gb18030), else UTF-8, else by likely_charset, else gbk, else with replacements."""
    return F.arrow_udf(_decode, T.StringType())(content)


def _decode(content: pa.Array) -> pa.Array:
    def one(b: bytes | None) -> str | None:
        if b is None:
            return None
        m = re.search(rb"(?:charset|encoding)\s*=\s*[\"']?([\w-]+)", b[:4096], re.I)
        declared = m[1].decode("ascii", "ignore").lower() if m else ""
        for name in (declared, "utf-8", None, "gbk"):
            try:
                name = likely_charset(b) if name is None else "gb18030" if name in ("gb2312", "gbk") else name
                if name:
                    return b.decode(name)
            except (LookupError, UnicodeDecodeError):
                continue
        return b.decode("utf-8", "replace")

    return pa.array([one(b) for b in content.to_pylist()], pa.string())
