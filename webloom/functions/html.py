"""A small tree of HTML with selectors, for use inside Arrow functions.

CSS: type, *, .class, #id, [a], [a=v] and with ~= ^= $= *=, :contains(x), :first-child, :last-child,
:nth-child(n), the combinators space > + ~, groups by comma, and at the end ::text or ::attr(name).
XPath: . .. / // names, *, @name, text(), unions by |, and predicates [n], [last()], [@a], [@a="v"],
[text()="v"], [contains(@a, "v")], [contains(text() or ., "v")].
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Callable, Collection, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html.entities import html5
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Tags that end an open <p>, and those that end an open tag of their own kind within a parent.
_ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_ENDS = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

#: A reference, whole or not; what stands for its & where it is a text: no decoded text holds a lone surrogate.
_REFERENCE, _PLAIN = re.compile(r"&(#?[A-Za-z0-9]+)(;?)"), "\ud800"


@dataclass(eq=False)
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    parent: Node | None = None
    children: list[Node | str] = field(default_factory=list)

    def elements(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]

    def walk(self) -> Iterator[Node]:
        """Descendants in document order, without recursion."""
        stack = self.elements()[::-1]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(node.elements()[::-1])

    def texts(self) -> list[str]:
        return [c for c in self.children if isinstance(c, str)]

    def text(self) -> str:
        out: list[str] = []
        stack: list[Node | str] = self.children[::-1]
        while stack:
            c = stack.pop()
            if isinstance(c, str):
                out.append(c)
            else:
                stack.extend(c.children[::-1])
        return "".join(out)

    def outer(self) -> str:
        out: list[str] = []
        stack: list[Node | str | tuple[str]] = [self]
        while stack:
            c = stack.pop()
            if isinstance(c, tuple):
                out.append(c[0])
            elif isinstance(c, str):
                out.append(_html.escape(c, quote=False))
            else:
                out.append(f"<{c.tag}{''.join(f' {k}="{_html.escape(v)}"' for k, v in c.attrs.items())}>")
                if c.tag not in VOID:
                    stack.append((f"</{c.tag}>",))
                    stack.extend(c.children[::-1])
        return "".join(out)

    def siblings(self) -> list[Node]:
        return self.parent.elements() if self.parent else [self]


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#document")

    def _close_open(self, kinds: set[str], within: set[str]) -> None:
        node = self.at
        while node.parent and node.tag not in within:
            if node.tag in kinds:
                self.at = node.parent
            node = node.parent

    def handle_starttag(self, tag: str, attrs: list) -> None:
        tag = _restored(tag)
        if tag in _ENDS_P:
            node = self.at
            while node.parent and node.tag != "p" and node.tag not in ("div", "td", "li", "article", "body"):
                node = node.parent
            if node.tag == "p":
                self.at = node.parent
        if tag in _ENDS:
            self._close_open(*_ENDS[tag])
        node = Node(tag, {_restored(k): _restored(v) if v is not None else "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        tag = _restored(tag)
        node = self.at
        while node.parent and node.tag != tag:
            node = node.parent
        if node.parent:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        data = _restored(data)
        if self.at.children and isinstance(self.at.children[-1], str):
            self.at.children[-1] += data
        else:
            self.at.children.append(data)


def _restored(text: str) -> str:
    return text.replace(_PLAIN, "&")


def parse(text: str, references: Collection[str] | None = None) -> Node:
    """The tree of a document; damaged markup gives some tree, never an error.

    A named reference counts if its semicolon is there; one that was cut short, as "&amp", stays as it is written.
    references: names of the only ones that count, as "amp"; None: all of HTML, and numbers.
    """

    def marked(m: re.Match) -> str:
        if references is None:
            counts = m[1][0] == "#" or (m[2] and f"{m[1]};" in html5)
        else:
            counts = m[2] and m[1] in references
        return m[0] if counts else _PLAIN + m[0][1:]

    builder = _Builder()
    try:
        builder.feed(_REFERENCE.sub(marked, text))
        builder.close()
    except (AssertionError, ValueError):
        pass
    return builder.root


# CSS

_SIMPLE = re.compile(
    r"""(?P<tag>\*|[A-Za-z][\w-]*)|\.(?P<cls>[\w-]+)|\#(?P<id>[\w-]+)"""
    r"""|\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[~^$*]?=)\s*(?:"(?P<dq>[^"]*)"|'(?P<sq>[^']*)'|(?P<bare>[^\]\s]+))\s*)?\]"""
    r"""|:contains\(\s*(?:"(?P<cdq>[^"]*)"|'(?P<csq>[^']*)'|(?P<cbare>[^)]*))\s*\)|:(?P<pos>first-child|last-child)|:nth-child\(\s*(?P<nth>\d+)\s*\)"""
)
Test = Callable[[Node], bool]


def _attr_test(name: str, op: str | None, value: str) -> Test:
    def test(n: Node) -> bool:
        got = n.attrs.get(name)
        if got is None or not op:
            return got is not None
        if op == "=":
            return got == value
        if op == "~=":
            return value in got.split()
        return bool(value) and {"^=": got.startswith(value), "$=": got.endswith(value), "*=": value in got}[op]

    return test


def _simple(m: re.Match) -> Test:
    g = m.groupdict()
    if g["tag"]:
        return (lambda n: True) if g["tag"] == "*" else lambda n, t=g["tag"].lower(): n.tag == t
    if g["cls"]:
        return lambda n, c=g["cls"]: c in n.attrs.get("class", "").split()
    if g["id"]:
        return lambda n, i=g["id"]: n.attrs.get("id") == i
    if g["attr"]:
        return _attr_test(g["attr"].lower(), g["op"], next((g[k] for k in ("dq", "sq", "bare") if g[k] is not None), ""))
    if g["pos"]:
        return lambda n, k=0 if g["pos"] == "first-child" else -1: n.siblings()[k] is n
    if g["nth"]:
        return lambda n, k=int(g["nth"]): 0 < k <= len(n.siblings()) and n.siblings()[k - 1] is n
    words = next((g[k] for k in ("cdq", "csq", "cbare") if g[k] is not None), "")
    return lambda n: words in n.text()


@dataclass(frozen=True)
class Css:
    """Alternatives, each a chain of (combinator, tests), and what to give of a match."""

    groups: tuple
    gives: str = ""
    name: str = ""


@lru_cache(512)
def compile_css(rule: str) -> Css:
    groups, gives, name = [], "", ""
    for part in _split_commas(rule):
        if m := re.search(r"::(text|attr\(\s*([\w:-]+)\s*\))\s*$", part):
            gives, name, part = ("text", "", part[: m.start()]) if m[1] == "text" else ("attr", m[2].lower(), part[: m.start()])
        steps, tests, combinator, at = [], [], " ", 0
        part = part.strip() or "*"
        while at < len(part):
            if m := _SIMPLE.match(part, at):
                tests.append(_simple(m))
            elif m := re.compile(r"\s*([>+~])\s*|\s+").match(part, at):
                if tests:
                    steps.append((combinator, tuple(tests)))
                tests, combinator = [], m[1] or " "
            else:
                raise ValueError(f"unknown selector at {part[at:]!r} in {rule!r}")
            at = m.end()
        groups.append((*steps, (combinator, tuple(tests))))
    return Css(tuple(groups), gives, name)


def _split_commas(rule: str) -> list[str]:
    parts, depth, quote, at = [], 0, "", 0
    for i, c in enumerate(rule):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif c == "," and not depth:
            parts.append(rule[at:i])
            at = i + 1
    return [*parts, rule[at:]]


def _reached(nodes: list[Node], combinator: str) -> Iterator[Node]:
    for n in nodes:
        if combinator == " ":
            yield from n.walk()
        elif combinator == ">":
            yield from n.elements()
        else:
            after = n.siblings()
            after = after[next(i for i, s in enumerate(after) if s is n) + 1 :]
            yield from after[:1] if combinator == "+" else after


def css_nodes(scope: Node, rule: Css) -> list[Node]:
    """Matches within scope, each once, in document order."""
    found: dict[int, Node] = {}
    for steps in rule.groups:
        nodes = [scope]
        for combinator, tests in steps:
            seen: dict[int, Node] = {}
            for n in _reached(nodes, combinator):
                if id(n) not in seen and all(t(n) for t in tests):
                    seen[id(n)] = n
            nodes = list(seen.values())
        found |= {id(n): n for n in nodes}
    if len(found) > 1:
        return [n for n in scope.walk() if id(n) in found]
    return list(found.values())


def css(scope: Node, rule: str) -> list[str]:
    """All values: texts, attributes or outer html of the matches."""
    compiled = compile_css(rule)
    nodes = css_nodes(scope, compiled)
    if compiled.gives == "text":
        return [t for n in nodes for t in n.texts()]
    if compiled.gives == "attr":
        return [n.attrs[compiled.name] for n in nodes if compiled.name in n.attrs]
    return [n.outer() for n in nodes]


# XPath

_STEP = re.compile(r"""(//|/)?(\.\.|\.|@[\w:-]+|@\*|text\(\)|\*|[A-Za-z][\w-]*)((?:\[[^\]]*\])*)""")
_PREDICATE = re.compile(r"""\[\s*(?:(?P<n>\d+)|(?P<last>last\(\))|(?:contains\(\s*(?P<in>@[\w:-]+|text\(\)|\.)\s*,\s*(?P<q>["'])(?P<part>.*?)(?P=q)\s*\))|(?P<what>@[\w:-]+|text\(\)|\.)\s*(?:=\s*(?P<q2>["'])(?P<value>.*?)(?P=q2))?)\s*\]""")


def _strings(n: Node, what: str) -> list[str]:
    if what == "text()":
        return n.texts()
    if what == ".":
        return [n.text()]
    return [n.attrs[what[1:].lower()]] if what[1:].lower() in n.attrs else []


def _predicates(text: str) -> list[dict]:
    out, at = [], 0
    while at < len(text):
        m = _PREDICATE.match(text, at)
        if not m:
            raise ValueError(f"unknown predicate {text[at:]!r}")
        out.append(m.groupdict())
        at = m.end()
    return out


def _passes(nodes: list[Node], p: dict) -> list[Node]:
    if p["n"]:
        return nodes[int(p["n"]) - 1 : int(p["n"])]
    if p["last"]:
        return nodes[-1:]
    if p["in"]:
        return [n for n in nodes if any(p["part"] in s for s in _strings(n, p["in"])[:1])]
    return [n for n in nodes if (p["value"] in _strings(n, p["what"]) if p["value"] is not None else _strings(n, p["what"]))]


@lru_cache(512)
def compile_xpath(rule: str) -> tuple:
    paths = []
    for path in re.split(r"\s*\|\s*(?![^\[]*\])", rule.strip()):
        steps, at = [], 0
        while at < len(path):
            m = _STEP.match(path, at)
            if not m:
                raise ValueError(f"unknown path at {path[at:]!r}")
            steps.append((m[1] or "", m[2], tuple(map(_frozen, _predicates(m[3])))))
            at = m.end()
        paths.append(tuple(steps))
    return tuple(paths)


def _frozen(p: dict) -> tuple:
    return tuple(sorted(p.items(), key=lambda x: x[0]))


def _walked(scope: Node, rule: str) -> Iterator[tuple[list[Node], list[str] | None]]:
    """For each alternative of a path its nodes, and its values if it ends in texts or attributes."""
    for steps in compile_xpath(rule):
        nodes, values = [scope], None
        if steps and steps[0][0]:
            while nodes[0].parent:
                nodes = [nodes[0].parent]
        for slash, name, predicates in steps:
            if name.startswith("@"):
                pool = [x for n in nodes for x in ([n, *n.walk()] if slash == "//" else [n])]
                values = [v for n in pool for k, v in n.attrs.items() if name == "@*" or k == name[1:].lower()]
            elif name == "text()":
                pool = [x for n in nodes for x in ([n, *n.walk()] if slash == "//" else [n])]
                values = [t for n in pool for t in n.texts()]
            elif name == ".":
                continue
            elif name == "..":
                nodes = list({id(n.parent): n.parent for n in nodes if n.parent}.values())
            else:
                seen: dict[int, Node] = {}
                for n in nodes:
                    parents = [n, *n.walk()] if slash == "//" else [n]
                    for parent in parents:
                        some = [c for c in parent.elements() if name == "*" or c.tag == name.lower()]
                        for p in predicates:
                            some = _passes(some, dict(p))
                        seen |= {id(c): c for c in some}
                nodes = list(seen.values())
        yield nodes, values


def bound(rule: str, variables: dict[str, str]) -> str:
    """A path with $name replaced by the variable's value in quotes; an unknown name is an error."""
    def value(m: re.Match) -> str:
        if m[1] not in variables:
            raise ValueError(f"no variable ${m[1]}")
        text = variables[m[1]] or ""
        if '"' in text and "'" in text:
            raise ValueError(f"${m[1]} has both kinds of quotes")
        return f"'{text}'" if '"' in text else f'"{text}"'

    return re.sub(r"\$([A-Za-z_][\w-]*)", value, rule)


def xpath(scope: Node, rule: str) -> list[str]:
    """All values of a path, in document order within each alternative."""
    out: list[str] = []
    for nodes, values in _walked(scope, rule):
        out += values if values is not None else [n.outer() for n in nodes if n.parent or n is not scope]
    return out


def xpath_nodes(scope: Node, rule: str) -> list[Node]:
    """The elements of a path, each once, in document order."""
    found = {id(n) for nodes, values in _walked(scope, rule) if values is None for n in nodes if n is not scope}
    root = scope
    while root.parent:
        root = root.parent
    return [n for n in root.walk() if id(n) in found]
