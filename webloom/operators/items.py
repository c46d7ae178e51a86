"""Items: what to take from a page, the schema that follows, and one Arrow function that takes it.

A rule gives the first match as a text, or in brackets ("[rule]") all matches as an array.
A rule may be a list: the rule, then processors for its field.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.functions.html import Node, bound, compile_css, css, css_nodes, parse, xpath, xpath_nodes
from webloom.functions.processors import Processor, processor

Rule = str | list


@dataclass
class ItemSpec:
    """Rules by field.

    inline: field to another spec, whose divider makes it an array.  default: values, or functions without arguments
    that give one for each item.  extra_from_meta: keys of the page's meta that
    replace extra fields or are added to them as texts; True: those that extra has.  references: names of the only character
    references that are decoded in a page, as "amp"; None: all.
    """

    name: str = "Item"
    css: dict[str, Rule] = field(default_factory=dict)
    xpath: dict[str, Rule] = field(default_factory=dict)
    re: dict[str, Rule] = field(default_factory=dict)
    inline: dict[str, ItemSpec] = field(default_factory=dict)
    default: dict[str, Any] = field(default_factory=dict)
    extra: dict[str, Any] = field(default_factory=dict)
    extra_from_meta: bool | list[str] = False
    divider: str | None = None
    store: bool = False
    custom: Callable[[DataFrame], DataFrame] | None = None
    bound: dict[str, list[str | Processor]] = field(default_factory=dict)
    references: list[str] | None = None

    def bind(self, name: str | None = None, map: bool = False) -> Callable:  # noqa: A002
        """Decorator: a processor for a field; of process_x for x. The bound ones replace those in the field's rule."""

        def put(f: Processor) -> Processor:
            target = name or f.__name__.removeprefix("process_")
            self.bound.setdefault(target, []).append((lambda c: F.transform(c, f)) if map else f)
            return f

        return put

    @classmethod
    def nested(cls, rule: Any, name: str = "Item", divider: str | None = None) -> ItemSpec:
        """A spec from one nested rule.

        A text is a rule (a path where it begins with / or ./, css otherwise), a list of one text gives all matches,
        a dict gives fields, a list of one dict with a "divider" gives an array of items.  What isn't a dict goes to the field `item`.
        """
        spec = cls(name=name, divider=divider)
        for key, value in (rule if isinstance(rule, dict) else {"item": rule}).items():
            many = isinstance(value, list)
            value = value[0] if many else value
            if isinstance(value, dict):
                inner = dict(value)
                at = inner.pop("divider", None)
                if many and not at:
                    raise ValueError(f"the items of {key!r} need a divider")
                spec.inline[key] = cls.nested(inner, key, at if many else None)
            else:
                kind = spec.xpath if value.startswith(("/", "./")) else spec.css
                kind[key] = f"[{value}]" if many else value
        return spec

    def steps(self) -> dict[str, list[str | Processor]]:
        """Processors by field."""
        found = {k: list(r[1:]) for rules in (self.css, self.xpath, self.re) for k, r in rules.items() if isinstance(r, list) and len(r) > 1}
        return found | self.bound

    def plain(self) -> dict:
        """What the Arrow function needs: data only."""
        rules = {kind: {k: r[0] if isinstance(r, list) else r for k, r in getattr(self, kind).items()} for kind in ("css", "xpath", "re")}
        return rules | {"inline": {k: s.plain() for k, s in self.inline.items()}, "default": self.default, "extra": self.extra, "divider": self.divider, "references": self.references}

    def from_meta(self) -> list[str]:
        """Keys that come from meta: a rule for the same field would overwrite them."""
        keys = list(self.extra) if self.extra_from_meta is True else list(self.extra_from_meta or [])
        return [k for k in keys if not any(k in rules for rules in (self.css, self.xpath, self.re, self.inline))]

    def schema(self) -> T.StructType:
        """Fields in the order in which they are first assigned."""
        types: dict[str, T.DataType] = {k: _type_of(v) for k, v in self.extra.items()}
        types |= {k: T.StringType() for k in self.from_meta() if k not in types}
        for k, s in self.inline.items():
            types[k] = T.ArrayType(s.schema()) if s.divider else s.schema()
        types |= {k: _type_of(v) for k, v in self.default.items() if k not in self.extra}
        for many in (False, True):
            for kind in ("css", "xpath", "re"):
                for k, r in getattr(self, kind).items():
                    if _bracketed(r)[1] == many:
                        types[k] = T.ArrayType(T.StringType()) if many else T.StringType()
        return T.StructType([T.StructField(k, t) for k, t in types.items()])


def _type_of(value: Any) -> T.DataType:
    value = value() if callable(value) else value
    if isinstance(value, bool):
        return T.BooleanType()
    if isinstance(value, int):
        return T.LongType()
    if isinstance(value, float):
        return T.DoubleType()
    if isinstance(value, list):
        return T.ArrayType(_type_of(value[0]) if value else T.StringType())
    return T.StringType()


def _bracketed(rule: Rule) -> tuple[str, bool]:
    text = (rule[0] if isinstance(rule, list) else rule).strip()
    return (text[1:-1], True) if text.startswith("[") and text.endswith("]") and not re.match(r"\[[\w:-]+([~^$*]?=[^\]]*)?\]$", text) else (text, False)


def _regex_all(scope: Node, pattern: str) -> list[str]:
    out = []
    for m in re.finditer(pattern, scope.outer() if scope.parent else "".join(c if isinstance(c, str) else c.outer() for c in scope.children)):
        out += [g for g in m.groups()] if m.re.groups else [m[0]]
    return out


_FINDERS = {"css": css, "xpath": xpath, "re": _regex_all}


def _variables(spec: dict) -> bool:
    """Whether a path has variables."""
    return any("$" in _bracketed(r)[0] for r in spec["xpath"].values()) or any(map(_variables, spec["inline"].values()))


def take(scope: Node, spec: dict, variables: dict[str, str] | None = None) -> dict:
    """The fields of one item. Later kinds overwrite earlier ones, also with nothing. variables: those of paths, as $name."""
    out = dict(spec["extra"])
    for k, inner in spec["inline"].items():
        parts = [take(s, inner, variables) for s in scopes(scope, inner["divider"])]
        out[k] = parts if inner["divider"] else parts[0]
    out |= {k: v() if callable(v) else v for k, v in spec["default"].items() if k not in spec["extra"]}
    for many in (False, True):
        for kind, find in _FINDERS.items():
            for k, rule in spec[kind].items():
                text, all_of = _bracketed(rule)
                if all_of == many:
                    found = find(scope, bound(text, variables or {}) if kind == "xpath" and "$" in text else text)
                    out[k] = found if many else found[0] if found else None
    return out


def scopes(scope: Node, divider: str | Callable[[Node], list[Node]] | None) -> list[Node]:
    """Parts of a page: matches of a css rule, or of a path where it begins with / or ./, or what a function gives; the whole without a divider."""
    if not divider:
        return [scope]
    if callable(divider):
        return divider(scope)
    if divider.startswith(("/", "./")):
        return xpath_nodes(scope, divider)
    return css_nodes(scope, compile_css(divider))


def taker(spec: ItemSpec, divider: str | None = None) -> Callable[..., Column]:
    """Column function: html (and meta, whose values are the variables of paths) to an array of the items' structs."""
    plain = spec.plain()
    schema = T.ArrayType(spec.schema())

    def items(text: str | None, meta: dict[str, str] | None) -> str:
        if text is None:
            return "[]"
        root = parse(text, plain["references"])
        return json.dumps([take(s, plain, meta) for s in scopes(root, divider or plain["divider"])], ensure_ascii=False)

    @F.pandas_udf(T.StringType())
    def all_of(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for html in pages:
            yield pd.Series([items(text, None) for text in html], dtype=object)

    @F.pandas_udf(T.StringType())
    def all_with(pages: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for html, meta in pages:
            yield pd.Series([items(text, json.loads(m) if m else {}) for text, m in zip(html, meta, strict=True)], dtype=object)

    def column(html: Column, meta: Column | None = None) -> Column:
        found = all_with(html, F.to_json(meta)) if meta is not None and _variables(plain) else all_of(html)
        return F.from_json(found, schema)

    return column


def spawn(pages: DataFrame, spec: ItemSpec, divider: str | None = None, html: str = "html", keep: list[str] | None = None, meta: str | None = None) -> DataFrame:
    """One row for each match of the divider, or one for the page without one.

    Columns: those to keep, item_pos (from 0), family, and item, a struct; after the processors also _dropped,
    the names of fields that are absent.  All rules of a page run in one Arrow function, on the html alone.
    """
    keep = [c for c in pages.columns if c != html] if keep is None else keep
    items = pages.select(*keep, taker(spec, divider)(F.col(html), F.col(meta) if meta else None).alias("_items"))
    # outer, as the plain form has the optimizer parse pages twice, to leave out those without items before
    rows = items.select(*keep, F.posexplode_outer("_items").alias("item_pos", "item")).where(F.col("item_pos").isNotNull())
    if meta:
        for k in spec.from_meta():
            rows = rows.withColumn("item", F.col("item").withField(k, F.coalesce(F.col(meta)[k].try_cast(spec.schema()[k].dataType), F.col("item")[k])))
    rows = process(rows, spec.steps()).withColumn("family", F.lit(spec.name))
    return spec.custom(rows) if spec.custom else rows


def process(rows: DataFrame, steps: dict[str, list[str | Processor]], item: str = "item") -> DataFrame:
    """Run the processors of each field; fields that go are named in _dropped, rows that go are filtered.

    All fields are computed from the item as it came, in one projection.  "a>b" as a name: what the processors make of
    field a goes to field b, which is absent where they drop it; a stays.
    """
    values: dict[str, Column] = {}
    absent: dict[str, Column] = {}
    gone = F.lit(False)
    for name, fs in steps.items():
        source, _, target = name.partition(">")
        value, name = F.col(item)[source], target or source  # noqa: PLW2901
        for f in map(processor, fs):
            if hasattr(f, "drops"):
                absent[name] = absent.get(name, F.lit(False)) | f.drops(value)
            if hasattr(f, "drops_item"):
                gone = gone | (~absent.get(name, F.lit(False)) & f.drops_item(value))
            value = f(value)
        values[name] = F.when(~absent[name], value) if name in absent else value
    changed = F.col(item)
    for name, value in values.items():
        changed = changed.withField(name, value)
    names = F.array(*(F.when(a, F.lit(n)) for n, a in absent.items())) if absent else F.array()
    out = rows.withColumns({item: changed, "_dropped": F.array_compact(names.cast("array<string>")), "_gone": gone})
    return out.where(~F.col("_gone")).drop("_gone")


def to_json(item: Column | str = "item", dropped: Column | str = "_dropped") -> Column:
    """The item as JSON: null fields are written, dropped ones are not.

    Where fields were dropped the text is read as a map of its outermost fields, so names inside of nested items and
    texts are not touched.
    """
    item, dropped = (F.col(c) if isinstance(c, str) else c for c in (item, dropped))
    text = F.to_json(item, {"ignoreNullFields": "false"})
    fields = F.from_json(text, "map<string,variant>")
    rest = F.to_json(F.map_filter(fields, lambda k, _: ~F.array_contains(dropped, k)), {"ignoreNullFields": "false"})
    return F.when(F.size(dropped) > 0, rest).otherwise(text)
