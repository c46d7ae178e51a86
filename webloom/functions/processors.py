"""Field processors: functions from column to column.

Each `name(...)` returns a processor, a function that takes a Column and gives a Column.
Results follow the semantics in SURVEY section 2.5 to the letter, also where these look
odd; `strict=True` gives the sensible result.
"""

from __future__ import annotations

import re as _re
from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

Processor = Callable[[Column], Column]

#: White space as Python's strip() sees it.
_STRIPPED = r"[\s\x1c-\x1f\x{85}\p{Z}]"

registry: dict[str, Callable[..., Processor]] = {}


def register(name: str | None = None) -> Callable:
    """Make a processor factory known under a name, for the string form."""

    def put(f: Callable[..., Processor]) -> Callable[..., Processor]:
        registry[name or f.__name__.rstrip("_")] = f
        return f

    return put


def use(more: dict[str, Callable[..., Processor]]) -> None:
    """Register several."""
    registry.update(more)


def processor(what: str | Processor) -> Processor:
    """A processor from a function or from "name" or "name:a,b"; arguments in strings are strings."""
    if callable(what):
        return what
    name, colon, rest = what.partition(":")
    if name not in registry:
        raise KeyError(f"no processor named {name!r}")
    return registry[name](*(rest.split(",") if colon else ()))


def chain(c: Column, *steps: str | Processor) -> Column:
    """Apply processors one after the other."""
    for s in steps:
        c = processor(s)(c)
    return c


def truthy(c: Column, kind: T.DataType) -> Column:
    """Whether a value counts as true: not null, empty, zero or false."""
    if isinstance(kind, T.StringType | T.BinaryType):
        test = F.length(c) > 0
    elif isinstance(kind, T.BooleanType):
        test = c
    elif isinstance(kind, T.NumericType):
        test = c != 0
    elif isinstance(kind, T.ArrayType | T.MapType):
        test = F.size(c) > 0
    else:
        test = c.isNotNull()
    return F.coalesce(test, F.lit(False))


@register()
def first() -> Processor:
    """First element of an array; null where it is empty or null."""
    return lambda c: F.try_element_at(c, F.lit(1))


def _strip_text(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)^{_STRIPPED}+|{_STRIPPED}+$", "")


@register()
def strip(kind: T.DataType | str = "string") -> Processor:
    """White space off both ends of texts, also inside arrays and the values of maps and structs."""
    kind = T.StringType() if kind == "string" else kind

    def apply(c: Column, k: T.DataType) -> Column:
        if isinstance(k, T.StringType):
            return _strip_text(c)
        if isinstance(k, T.ArrayType):
            return F.transform(c, lambda x: apply(x, k.elementType))
        if isinstance(k, T.MapType):
            return F.transform_values(c, lambda _, v: apply(v, k.valueType))
        if isinstance(k, T.StructType):
            return F.when(c.isNotNull(), F.struct(*(apply(c[f.name], f.dataType).alias(f.name) for f in k)))
        return c

    return lambda c: apply(c, kind)


@register("map")
def map_(f: str | Processor, *args: str) -> Processor:
    """A processor, or a registered one by name, on each element."""
    step = processor(":".join([f, ",".join(args)]) if isinstance(f, str) and args else f)
    return lambda c: F.transform(c, step)


@register("filter")
def filter_(test: Processor | None = None, kind: T.DataType | None = None) -> Processor:
    """Elements for which the test holds; by default those that count as true (texts, unless kind says otherwise)."""
    return lambda c: F.filter(c, test or (lambda x: truthy(x, kind or T.StringType())))


@register()
def re(regex: str, group: int | str = 0) -> Processor:
    """A group of the first match, null without one."""
    java = java_regex(regex)
    return lambda c: F.when(c.rlike(java), F.regexp_extract(c, java, _group(regex, group)))


@register()
def re_groups(regex: str, default: Column | None = None) -> Processor:
    """All groups of the first match as an array."""
    java, n = java_regex(regex), _re.compile(regex).groups
    none = F.lit(None) if default is None else default
    return lambda c: F.when(c.rlike(java), F.array(*(F.regexp_extract(c, java, i + 1) for i in range(n)))).otherwise(none)


@register()
def re_groupdict(regex: str, default: Column | None = None) -> Processor:
    """Named groups of the first match as a map."""
    java, names = java_regex(regex), _re.compile(regex).groupindex
    none = F.lit(None) if default is None else default

    def apply(c: Column) -> Column:
        pairs = [x for name, i in names.items() for x in (F.lit(name), F.regexp_extract(c, java, i))]
        return F.when(c.rlike(java), F.create_map(*pairs)).otherwise(none)

    return apply


def _group(regex: str, group: int | str) -> int:
    named = _re.compile(regex).groupindex
    return named[group] if group in named else int(group)


def _java_name(m: _re.Match) -> str:
    """A name for Java, which has letters and digits only; different names stay different."""
    return m[1].replace("Z", "ZZ").replace("_", "Zu")


def java_regex(regex: str) -> str:
    """A Python expression for Java: named groups, Unicode classes, and a dot that stops at newlines only."""
    named = _re.sub(r"\(\?P<(\w+)>", lambda m: f"(?<{_java_name(m)}>", regex)
    return "(?Ud)" + _re.sub(r"\(\?P=(\w+)\)", lambda m: f"\\k<{_java_name(m)}>", named)


@register()
def default(value: Any, kind: T.DataType | None = None) -> Processor:
    """The value where the field counts as false."""
    return lambda c: F.when(truthy(c, kind or T.StringType()), c).otherwise(F.lit(value))


@register()
def replace(old: str, new: str = "", count: int | str = -1) -> Processor:
    """Literal replacement; a count of 0 or more limits how many, from the left."""
    count = int(count)
    if count < 0:
        return lambda c: F.replace(c, F.lit(old), F.lit(new)) if old else F.regexp_replace(c, "", new)
    if not old:
        return lambda c: _replace_some(c, F.lit(old), F.lit(new), F.lit(count))

    def apply(c: Column) -> Column:
        parts = F.split(c, _re.escape(old), -1)
        head, tail = F.slice(parts, 1, count + 1), F.slice(parts, count + 2, F.greatest(F.size(parts) - count - 1, F.lit(0)))
        return F.when(F.size(tail) > 0, F.concat(F.array_join(head, new), F.lit(old), F.array_join(tail, old))).otherwise(F.array_join(head, new)) if count else c

    return apply


@F.pandas_udf(T.StringType())
def _replace_some(text: pd.Series, old: pd.Series, new: pd.Series, count: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else t.replace(o, n, int(k)) for t, o, n, k in zip(text, old, new, count, strict=True)], dtype=object)


@register("try")
def try_(*steps: str | Processor, succeeded: list[Processor] | None = None) -> Processor:
    """The result of the first processor that succeeds.

    A processor on columns fails by giving null (use try_ casts); where null is a result, give a
    test for each step in `succeeded`.
    """
    chosen = [processor(s) for s in steps]

    def apply(c: Column) -> Column:
        if succeeded is None:
            return F.coalesce(*(s(c) for s in chosen))
        out = F.lit(None)
        for s, ok in reversed(list(zip(chosen, succeeded, strict=True))):
            out = F.when(ok(c), s(c)).otherwise(out)
        return out

    return apply


# Numbers and dates. The expressions that texts are matched with, from the start.
FLOAT = r"\D*(\d*\.?\d*).*"
INT = r"\D*(\d+).*"
DATE = r".*(\d\d\d\d)\D+(0?[1-9]|1[0-2])\D+(0?[1-9]|[12][0-9]|3[01]).*"
DATETIME = r".*(\d\d\d\d)\D+(0?[1-9]|1[0-2])\D+(0?[1-9]|[12][0-9]|3[01])\D+(00|[0-9]|1[0-9]|2[0-3]):([0-9]|[0-5][0-9]):([0-9]|[0-5][0-9]).*"
_STRICT_DATE = r"(?<!\d)(\d{4})[-/.](1[0-2]|0?[1-9])[-/.](3[01]|[12][0-9]|0?[1-9])(?!\d)"
_STRICT_TIME = r"[T\s]+(2[0-3]|[01]?[0-9]):([0-5]?[0-9])(?::([0-5]?[0-9]))?"


def _from_start(regex: str) -> str:
    return "^(?:" + java_regex(regex) + ")"


def _part(c: Column, regex: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), regex, group), F.lit(""))


_STRICT_FLOAT, _STRICT_INT = r"[-+]?(?:\d[\d,]*\.?\d*|\.\d+)", r"[-+]?\d[\d,]*"


def _on_error(value: Processor, matched: Processor, drop: bool | str, keep: bool | str) -> Processor:
    """What happens without a match: null, or the field goes (drop), or the text stays (keep; the result is a text then)."""

    def apply(c: Column) -> Column:
        return F.when(matched(c), value(c).cast("string")).otherwise(c) if _flag(keep) and not _flag(drop) else value(c)

    if _flag(drop):
        apply.drops = lambda c: ~matched(c)  # type: ignore[attr-defined]
    return apply


def _flag(value: bool | str) -> bool:
    return bool(value)


def _matches(java: str) -> Processor:
    return lambda c: F.coalesce(c, F.lit("")).rlike(java)


@register()
def to_float(error_drop: bool = False, error_keep: bool = False, regex: str | None = None, strict: bool = False) -> Processor:
    """The first number in a text; signs and thousands are lost. strict: both count."""
    if strict:
        return _on_error(lambda c: F.replace(F.regexp_extract(c, _STRICT_FLOAT, 0), F.lit(","), F.lit("")).try_cast("double"), _matches(_STRICT_FLOAT), error_drop, error_keep)
    java = _from_start(regex or FLOAT)
    found = lambda c: F.regexp_extract(F.coalesce(c, F.lit("")), java, 1).rlike(r"\d")
    return _on_error(lambda c: F.when(found(c), _part(c, java, 1)).try_cast("double"), found, error_drop, error_keep)


@register()
def to_int(error_drop: bool = False, error_keep: bool = False, regex: str | None = None, strict: bool = False) -> Processor:
    """The first digits in a text; a sign is lost. strict: signs and thousands count. Null where a long can't hold it."""
    java = _STRICT_INT if strict else _from_start(regex or INT)
    value = (lambda c: F.replace(F.regexp_extract(c, java, 0), F.lit(","), F.lit("")).try_cast("bigint")) if strict else (lambda c: _part(c, java, 1).try_cast("bigint"))
    return _on_error(value, _matches(java), error_drop, error_keep)


@register()
def to_date(error_drop: bool = False, error_keep: bool = False, regex: str | None = None, strict: bool = False) -> Processor:
    """The last date on the first line; of two-digit days without a leading zero only the first digit counts.

    strict: all of the day counts.  Impossible dates are null.
    """
    java = java_regex(_STRICT_DATE) if strict else _from_start(regex or DATE)

    def value(c: Column) -> Column:
        y, m, d = (_part(c, java, i + 1) for i in range(3))
        return F.when(d.isNotNull(), F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))).try_cast("date")

    return _on_error(value, _matches(java), error_drop, error_keep)


@register()
def to_datetime(error_drop: bool = False, error_keep: bool = False, with_time: bool = False, regex: str | None = None, strict: bool = False) -> Processor:
    """As to_date, at midnight; with_time also hours, minutes and seconds, of which only the first digit counts, and hours 01 to 09 don't match.

    strict: all digits count, and seconds may be missing.
    """
    if not with_time:
        day = to_date(False, False, regex, strict)
        java = java_regex(_STRICT_DATE) if strict else _from_start(regex or DATE)
        return _on_error(lambda c: day(c).cast("timestamp_ntz"), _matches(java), error_drop, error_keep)
    java = java_regex(_STRICT_DATE + _STRICT_TIME) if strict else _from_start(regex or DATETIME)

    def value(c: Column) -> Column:
        y, mo, d, h, mi, s = (_part(c, java, i + 1) for i in range(6))
        day = F.concat_ws("-", y, F.lpad(mo, 2, "0"), F.lpad(d, 2, "0"))
        time = F.concat_ws(":", F.lpad(h, 2, "0"), F.lpad(mi, 2, "0"), F.lpad(F.coalesce(s, F.lit("0")), 2, "0"))
        return F.when(h.isNotNull(), F.concat_ws(" ", day, time)).try_cast("timestamp_ntz")

    return _on_error(value, _matches(java), error_drop, error_keep)


@register()
def drop(test: Processor | None = None, kind: T.DataType | None = None) -> Processor:
    """Remove the field where the test fails (by default: where it counts as false)."""
    keep = test or (lambda c: truthy(c, kind or T.StringType()))

    def apply(c: Column) -> Column:
        return F.when(keep(c), c)

    apply.drops = lambda c: ~F.coalesce(keep(c), F.lit(False))  # type: ignore[attr-defined]
    return apply


@register()
def drop_item(test: Processor | None = None, kind: T.DataType | None = None) -> Processor:
    """Remove the row where the test fails."""
    keep = test or (lambda c: truthy(c, kind or T.StringType()))

    def apply(c: Column) -> Column:
        return c

    apply.drops_item = lambda c: ~F.coalesce(keep(c), F.lit(False))  # type: ignore[attr-defined]
    return apply
