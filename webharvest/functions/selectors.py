"""CSS and XPath rules over node arrays, as Column expressions.

A rule is parsed when the plan is made: into steps, each an axis, tests of a node and an index among the hits.  What is
outside the grammar raises there.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .nodes import attr
from .urls import let

Test = Callable[[Column], Column]
_STRING = r"'[^']*'|\"[^\"]*\""
_IDENT = r"-?[A-Za-z_\u0080-\U0010ffff][\w\u0080-\U0010ffff-]*"


@dataclass
class Step:
    """`index`: a place among the hits, or what keeps some of them by place; `among`: places count among all hits, those of one
    parent, or those of one node that the step starts at (of backward axes from its end)."""

    axis: str
    tests: list[Test]
    index: int | Callable[[Column, Column], Column] | None = None
    among: str = "all"


#: Whether node n stands in an axis of c; both have order, last and parent.
AXES: dict[str, Callable[[Column, Column], Column]] = {
    "descendant": lambda c, n: (n["order"] > c["order"]) & (n["order"] <= c["last"]),
    "self": lambda c, n: n["order"] == c["order"],
    "descendant-or-self": lambda c, n: (n["order"] >= c["order"]) & (n["order"] <= c["last"]),
    "child": lambda c, n: n["parent"] == c["order"],
    "parent": lambda c, n: n["order"] == c["parent"],
    "ancestor": lambda c, n: (n["order"] < c["order"]) & (n["last"] >= c["last"]) & (n["last"] >= c["order"]),
    "ancestor-or-self": lambda c, n: (n["order"] <= c["order"]) & (n["last"] >= c["order"]),
    "next": lambda c, n: (n["parent"] == c["parent"]) & (n["order"] == c["last"] + 1),
    "following-sibling": lambda c, n: (n["parent"] == c["parent"]) & (n["order"] > c["order"]),
    "preceding-sibling": lambda c, n: (n["parent"] == c["parent"]) & (n["order"] < c["order"]),
    "following": lambda c, n: n["order"] > c["last"],
    "preceding": lambda c, n: n["last"] < c["order"],
}


class _Source:
    def __init__(self, text: str):
        self.text, self.at = text, 0

    def take(self, pattern: str) -> re.Match | None:
        m = re.compile(pattern).match(self.text, self.at)
        if m:
            self.at = m.end()
        return m

    def need(self, pattern: str) -> re.Match:
        m = self.take(pattern)
        if not m:
            raise self.error()
        return m

    def error(self) -> ValueError:
        return ValueError(f"selector not supported: {self.text!r} at {self.text[self.at :]!r}")

    @property
    def over(self) -> bool:
        return self.at >= len(self.text)


def _unquoted(text: str) -> str:
    return text[1:-1] if text[:1] in ("'", '"') else text


def _true(test: Column) -> Column:
    return F.coalesce(test, F.lit(False))


def _named(tag: str) -> list[Test]:
    return [] if tag == "*" else [lambda n: n["tag"] == tag.lower()]


def _has_attr(name: str, op: str | None, value: str) -> Test:
    def test(n: Column) -> Column:
        have, want = attr(n, name), F.lit(value)
        if op is None:
            return have.isNotNull()
        if op in ("*=", "^=", "$=", "~=") and not value:
            return F.lit(False)
        return _true(
            {
                "=": lambda: have == want,
                "!=": lambda: have.isNull() | (have != want),
                "*=": lambda: F.contains(have, want),
                "^=": lambda: F.startswith(have, want),
                "$=": lambda: F.endswith(have, want),
                "~=": lambda: F.array_contains(F.split(have, r"\s+"), value),
                "|=": lambda: (have == want) | F.startswith(have, F.lit(value + "-")),
            }[op]()
        )

    return test


def _nth(formula: str, field: str, source: _Source) -> Test:
    """Test of :nth-child and its kind: a number, odd, even or an+b."""
    text = formula.replace(" ", "").lower()
    text = {"odd": "2n+1", "even": "2n"}.get(text, text)
    m = re.fullmatch(r"(?:([+-]?\d*)n)?([+-]?\d+)?", text)
    if not text or not m:
        raise source.error()
    a = 0 if m[1] is None else int(m[1] + "1") if m[1] in ("", "+", "-") else int(m[1])
    b = int(m[2] or 0)
    if a == 0:
        return lambda n: n[field] == b
    return lambda n: ((n[field] - b) % abs(a) == 0) & ((n[field] - b >= 0) if a > 0 else (n[field] - b <= 0))


class _Css(_Source):
    def alternatives(self, end: str = "") -> list[list[Step]]:
        out = [self.steps(end)]
        while self.take(r"\s*,\s*"):
            out.append(self.steps(end))
        return out

    def steps(self, end: str) -> list[Step]:
        self.take(r"\s*")
        out, axis = [], "descendant"
        if m := self.take(r"([>+~])\s*"):
            axis = self.axis(m[1])
        while True:
            out.append(self.compound(axis))
            if self.over or re.compile(r"\s*(?:,|$" + (rf"|{end}" if end else "") + ")").match(self.text, self.at):
                self.take(r"\s*$")
                return out
            axis = self.axis(self.need(r"\s*([>+~])\s*|\s+")[1])

    @staticmethod
    def axis(sign: str | None) -> str:
        return {None: "descendant", ">": "child", "+": "next", "~": "following-sibling"}[sign]

    def compound(self, axis: str) -> Step:
        step, begin = Step(axis, []), self.at
        if m := self.take(rf"\*|{_IDENT}"):
            step.tests += _named(m[0])
        while True:
            if m := self.take(r"#([\w\u0080-\U0010ffff-]+)"):
                step.tests.append(_has_attr("id", "=", m[1]))
            elif m := self.take(r"\.([\w\u0080-\U0010ffff-]+)"):
                step.tests.append(_has_attr("class", "~=", m[1]))
            elif m := self.take(rf"\[\s*([\w:-]+)\s*(?:([*^$~|!]?=)\s*({_STRING}|[^\]\"'\s]*)\s*)?\]"):
                step.tests.append(_has_attr(m[1].lower(), m[2], _unquoted(m[3] or "")))
            elif m := self.take(r":([\w-]+)"):
                self.pseudo(m[1], step)
            elif self.at == begin:
                raise self.error()
            else:
                return step

    def pseudo(self, name: str, step: Step) -> None:
        places = {"first": 0, "last": -1}
        fields = {"nth-child": "nth", "nth-last-child": "nth_last"}
        plain: dict[str, Test] = {
            "first-child": lambda n: n["nth"] == 1, "last-child": lambda n: n["nth_last"] == 1,
            "only-child": lambda n: (n["nth"] == 1) & (n["nth_last"] == 1),
            "empty": lambda n: (n["last"] == n["order"]) & (n["inner"] == n["inner_end"]),
            "parent": lambda n: (n["last"] > n["order"]) | (n["inner"] < n["inner_end"]),
            "header": lambda n: n["tag"].isin("h1", "h2", "h3", "h4", "h5", "h6"),
            "checked": lambda n: attr(n, "checked").isNotNull(), "selected": lambda n: attr(n, "selected").isNotNull(),
            "disabled": lambda n: attr(n, "disabled").isNotNull(),
        }
        if name in places or name in ("even", "odd", "eq", "lt", "gt"):
            if step.index is not None:
                raise self.error()
            if name in places:
                step.index = places[name]
            elif name in ("even", "odd"):
                step.index = lambda i, size: i % 2 == int(name == "odd")
            else:
                k = int(self.need(r"\(\s*(-?\d+)\s*\)")[1])
                at = lambda size: F.lit(k) if k >= 0 else size + k
                step.index = k if name == "eq" else (lambda i, size: i < at(size)) if name == "lt" else (lambda i, size: i > at(size))
        elif name in plain:
            step.tests.append(plain[name])
        elif name in fields:
            step.tests.append(_nth(self.need(r"\(([^)]*)\)")[1], fields[name], self))
        elif name == "contains":
            want = _unquoted(self.need(rf"\(\s*({_STRING}|[^()]*?)\s*\)")[1])
            step.tests.append(lambda n: F.contains(n["text"], F.lit(want)))
        elif name in ("not", "is", "matches"):
            self.need(r"\(")
            inner = self.alternatives(r"\)")
            self.need(r"\s*\)")
            if any(len(steps) > 1 or steps[0].index is not None or steps[0].axis != "descendant" for steps in inner):
                raise self.error()
            either = [steps[0].tests for steps in inner]
            test = lambda n: _any(_passes(n, tests) for tests in either)
            step.tests.append((lambda n: ~test(n)) if name == "not" else test)
        else:
            raise self.error()


def _any(tests) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def _passes(node: Column, tests: list[Test]) -> Column:
    out = F.lit(True)
    for test in tests:
        out = out & _true(test(node))
    return out


def compile_css(selector: str) -> list[list[Step]]:
    """Alternatives, each a list of steps; anything outside the grammar raises."""
    source = _Css(selector.strip())
    out = source.alternatives()
    if not source.over:
        raise source.error()
    return out


class _XPath(_Source):
    def path(self) -> tuple[list[Step], str | None]:
        steps: list[Step] = []
        if not self.text.startswith(("/", "(")) and not self.text.startswith("."):
            self.text = "//" + self.text
        self.take(r"\.(?=/)")
        while not self.over:
            axis = "descendant" if self.need(r"//?")[0] == "//" else "child"
            if m := self.take(r"@([\w:-]+|\*)$|text\(\)$|string\(\)$"):
                final = "string()" if m[0] in ("string()",) else m[0]
                if axis == "descendant" and steps:
                    steps.append(Step("descendant-or-self", []))
                elif axis == "descendant":
                    steps.append(Step("descendant", []))
                return steps, final
            steps.append(self.step(axis, not steps))
        return steps, None

    def step(self, axis: str, first: bool) -> Step:
        if not first and axis == "child" and self.take(r"\.\."):
            return Step("parent", [])
        if m := self.take(r"([a-z-]+)::"):
            if m[1] not in AXES or m[1] in ("next",):
                raise self.error()
            if axis == "descendant" and m[1] not in ("descendant", "descendant-or-self"):
                raise self.error()  # each of all nodes' own axis
            axis = m[1]
        if first and axis not in ("child", "descendant"):
            raise self.error()
        name = self.need(rf"\*|node\(\)|{_IDENT}")[0]
        step = Step(axis, _named("*" if name == "node()" else name), among="parent" if axis in ("child", "descendant") else "start")
        while self.take(r"\[\s*"):
            if m := self.take(r"(\d+)\s*\]"):
                self.place(step, int(m[1]) - 1)
            elif m := self.take(r"last\(\)\s*(?:-\s*(\d+)\s*)?\]"):
                self.place(step, -1 - int(m[1] or 0))
            elif m := self.take(r"position\(\)\s*(=|!=|<=|>=|<|>)\s*(\d+)\s*\]"):
                self.place(step, _position(m[1], int(m[2])))
            else:
                if step.index is not None:
                    raise self.error()  # a test of what an index has picked
                step.tests.append(self.either())
                self.need(r"\s*\]")
        return step

    def place(self, step: Step, index) -> None:
        if step.index is not None:
            raise self.error()
        step.index = index

    def either(self) -> Test:
        tests = [self.every()]
        while self.take(r"\s+or\s+"):
            tests.append(self.every())
        return lambda n: _any(_true(t(n)) for t in tests)

    def every(self) -> Test:
        tests = [self.test()]
        while self.take(r"\s+and\s+"):
            tests.append(self.test())
        return lambda n: _passes(n, tests)

    def test(self) -> Test:
        if self.take(r"\s*not\s*\(\s*"):
            inner = self.either()
            self.need(r"\s*\)")
            return lambda n: ~_true(inner(n))
        if self.take(r"\s*\(\s*"):
            inner = self.either()
            self.need(r"\s*\)")
            return inner
        if m := self.take(r"\s*(contains|starts-with|ends-with)\s*\(\s*"):
            value = self.value()
            want = _unquoted(self.need(rf"\s*,\s*({_STRING})\s*\)")[1])
            how = {"contains": F.contains, "starts-with": F.startswith, "ends-with": F.endswith}[m[1]]
            return lambda n: how(value(n), F.lit(want))
        value = self.value()
        if m := self.take(rf"\s*(!?=|<=|>=|<|>)\s*({_STRING}|-?\d+(?:\.\d+)?)"):
            number = m[2][0] not in "'\""
            if m[1] in ("<", ">", "<=", ">=") and not number:
                raise self.error()
            want = F.lit(float(m[2])) if number else F.lit(_unquoted(m[2]))
            have = (lambda n: value(n).try_cast("double")) if number else value
            how = {"=": "__eq__", "!=": "__ne__", "<": "__lt__", ">": "__gt__", "<=": "__le__", ">=": "__ge__"}[m[1]]
            return lambda n: getattr(have(n), how)(want)
        return lambda n: value(n).isNotNull() & (value(n) != "") if value.__name__ != "attribute" else value(n).isNotNull()

    def value(self) -> Test:
        if m := self.take(r"\s*@([\w:-]+)"):
            name = m[1].lower()

            def attribute(n: Column) -> Column:
                return attr(n, name)

            return attribute
        if self.take(r"\s*text\(\)"):
            return lambda n: n["own"]
        if self.take(r"\s*(?:string\(\s*\.?\s*\)|\.(?![./]))"):
            return lambda n: n["text"]
        if self.take(r"\s*normalize-space\(\s*"):
            if self.take(r"\)"):
                return lambda n: n["text"]
            inner = self.value()
            self.need(r"\s*\)")
            return lambda n: F.trim(F.regexp_replace(inner(n), r"\s+", " "))
        if m := self.take(r"\s*string-length\(\s*"):
            inner = self.value()
            self.need(r"\s*\)")
            return lambda n: F.length(inner(n)).cast("string")
        raise self.error()


def _position(sign: str, k: int) -> Callable[[Column, Column], Column]:
    how = {"=": "__eq__", "!=": "__ne__", "<": "__lt__", ">": "__gt__", "<=": "__le__", ">=": "__ge__"}[sign]
    return lambda i, size: getattr(i + 1, how)(k)


def compile_xpath(path: str) -> tuple[list[Step], str | None]:
    """(steps, final @attribute or text()); /tbody steps are dropped; anything outside the grammar raises."""
    source = _XPath(re.sub(r"/tbody(?=/|$)", "", path.strip()))
    steps, final = source.path()
    if not steps and final is None:
        raise source.error()
    return steps, final


def select(nodes: Column, steps: list[Step]) -> Column:
    """Orders of the nodes that the steps reach, in document order."""

    def places(found: Column) -> Column:
        return F.transform(found, lambda n: F.struct(n["order"].alias("order"), n["last"].alias("last"), n["parent"].alias("parent")))

    def reached(start: Column | None, step: Step) -> Column:
        def test(n: Column) -> Column:
            if start is None:
                return (n["parent"] == -1 if step.axis == "child" else F.lit(True)) & _passes(n, step.tests)
            return F.exists(start, lambda c: AXES[step.axis](c, n)) & _passes(n, step.tests)

        return places(F.filter(nodes, test))

    def picked(step: Step, i: Column, size: Column) -> Column:
        if isinstance(step.index, int):
            return i == (F.lit(step.index) if step.index >= 0 else size + step.index)
        return step.index(i, size)

    def from_each(start: Column, step: Step) -> Column:
        back = step.axis.startswith(("ancestor", "preceding"))

        def own(c: Column) -> Column:
            hits = places(F.filter(nodes, lambda n: AXES[step.axis](c, n) & _passes(n, step.tests)))
            return let(F.reverse(hits) if back else hits, lambda h: F.filter(h, lambda _, i: picked(step, i, F.size(h))))

        return F.array_sort(F.array_distinct(F.flatten(F.transform(start, own))))

    def among(hits: Column, step: Step) -> Column:
        if step.among == "all":
            return F.filter(hits, lambda _, i: picked(step, i, F.size(hits)))

        def own(h: Column) -> Column:
            return F.filter(hits, lambda o: o["parent"] == h["parent"])

        return F.filter(
            hits, lambda h: let(own(h), lambda same: picked(step, F.size(F.filter(same, lambda o: o["order"] < h["order"])), F.size(same)))
        )

    def follow(start: Column | None, rest: list[Step]) -> Column:
        if not rest:
            return F.transform(start, lambda c: c["order"])
        step = rest[0]
        if step.index is not None and step.among == "start":
            hits = from_each(start, step)
        else:
            hits = reached(start, step)
            hits = hits if step.index is None else let(hits, lambda h: among(h, step))
        return let(hits, lambda now: follow(now, rest[1:]))

    return follow(None, steps)


def elements(rule: str, nodes: Column) -> tuple[Column, str | None]:
    """(orders of the elements of a rule `@css:...`, `@xpath:...` or a bare path, final @attribute or text())."""
    if rule.startswith("@css:"):
        alternatives, final = compile_css(rule[5:]), None
    else:
        steps, final = compile_xpath(rule.removeprefix("@xpath:"))
        alternatives = [steps]
    found = [select(nodes, steps) for steps in alternatives]
    return found[0] if len(found) == 1 else F.array_sort(F.array_distinct(F.concat(*found))), final


def taken(node: Column, target: str, html: Column | None = None) -> Column:
    """What is taken of a node: `text`, its `html` (the inner source) or `outer` source, or an attribute."""
    if target in ("html", "outer"):
        if html is None:
            raise ValueError(f"the target {target} needs the source of the page")
        a, b = ("inner", "inner_end") if target == "html" else ("start", "end")
        return F.substring(html, node[a] + 1, node[b] - node[a])
    return node["text"] if target == "text" else attr(node, target)


def selector(rule: str, nodes: Column, target: str = "text", html: Column | None = None) -> Column:
    """Values of a rule `@css:...`, `@xpath:...` or a bare path over parsed nodes, array of strings; a page without nodes has none.

    target: `text`, `html` or `outer` (the source of a node without or with its own tags, for which the page's source is
    given), or an attribute name.
    """

    def values(ns: Column) -> Column:
        orders, final = elements(rule, ns)
        if final == "text()":
            read = lambda n: F.when(n["own"] != "", n["own"])
            if not target == "text":
                raise ValueError(f"a rule that ends in text() has no {target}: {rule!r}")
        else:
            take = final[1:] if final and final.startswith("@") else "text" if final else target
            read = lambda n: taken(n, take, html)
        each = F.transform(orders, lambda k: let(F.get(ns, k), read))
        return F.filter(each, lambda v: v.isNotNull())

    return let(nodes, values)
