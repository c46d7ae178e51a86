"""Handlers: steps on rows of a family, in order of priority, and merges of settings."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Step = Callable[[DataFrame], DataFrame]
#: Positions: start of a run, before and after the execution of rows, end of a run.
START, BEFORE, AFTER, CLOSE = 0, 1, 2, 3


@dataclass
class Handler:
    """Steps for rows whose families contain `family`."""

    name: str = ""
    family: str = "_Default"
    priority: int = 500
    on_start: Callable[[], None] | None = None
    before: Step | None = None
    after: Step | None = None
    on_close: Callable[[], None] | None = None

    def __post_init__(self) -> None:
        self.name = self.name or type(self).__name__


@dataclass
class Middleware:
    """Handlers by name; a name that is there already is ignored, and priority 0 turns one off."""

    handlers: list[Handler] = field(default_factory=list)

    def append(self, handler: Handler) -> None:
        if handler.priority and all(h.name != handler.name for h in self.handlers):
            self.handlers.append(handler)

    def register(self, family: str | None = None, position: int | None = None, priority: int | None = None) -> Callable:
        """Decorator for handler classes, handlers and functions (a step after, by default)."""

        def put(what: Any) -> Any:
            if inspect.isclass(what) and issubclass(what, Handler):
                made = what(name=what.__name__)
            elif isinstance(what, Handler):
                made = what
            elif callable(what):
                part = {START: "on_start", BEFORE: "before", AFTER: "after", CLOSE: "on_close"}[AFTER if position is None else position]
                made = Handler(name=what.__name__, **{part: what})
            else:
                raise TypeError(f"not a handler: {what!r}")
            made.family = family or made.family
            made.priority = made.priority if priority is None else priority
            self.append(made)
            return what

        return put

    def configure(self, settings: dict[str, int | bool]) -> None:
        """Priorities by handler name: a number, True for the handler's own, or 0 or False for off."""
        kept = []
        for h in self.handlers:
            value = settings.get(h.name, True)
            if value is True:
                kept.append(h)
            elif value:
                h.priority = int(value)
                kept.append(h)
        self.handlers = kept

    def ordered(self, family: str | None = None) -> list[Handler]:
        """By priority, the highest first; equal ones in the order in which they came."""
        return sorted((h for h in self.handlers if family is None or h.family in (family, "_Default")), key=lambda h: -h.priority)

    def run(self, rows: DataFrame, position: int) -> DataFrame:
        """Each step on the rows of its family; other rows pass by. A handler of _Default gets all rows."""
        for h in self.ordered():
            step = h.before if position == BEFORE else h.after
            if step is None:
                continue
            if h.family == "_Default":
                rows = step(rows)
                continue
            mine = F.coalesce(F.array_contains("families", h.family), F.lit(False))
            rows = step(rows.where(mine)).unionByName(rows.where(~mine), allowMissingColumns=True)
        return rows

    def start(self) -> None:
        for h in self.ordered():
            if h.on_start:
                h.on_start()

    def close(self) -> None:
        for h in self.ordered():
            if h.on_close:
                h.on_close()


def dispatch(rows: DataFrame, handlers: DataFrame) -> DataFrame:
    """(rows..., handler, step): which handlers run on which rows, and as which step; as data.

    handlers: name, family, priority.  Rows: families, an array.
    """
    from pyspark.sql import Window

    each = rows.withColumn("_family", F.explode(F.array_distinct("families")))
    on = each.join(handlers.where(F.col("priority") != 0).withColumnRenamed("family", "_family").withColumnRenamed("name", "handler"), "_family")
    w = Window.partitionBy(*[c for c in rows.columns if c != "families"]).orderBy(F.col("priority").desc(), "handler")
    return on.withColumn("step", F.row_number().over(w)).drop("_family")


def merge_maps(*maps: Column | str) -> Column:
    """Maps in one; of equal keys the last counts. Null maps are empty."""
    empty = F.create_map().cast("map<string,string>")
    cols = [F.coalesce(F.col(m) if isinstance(m, str) else m, empty) for m in maps]

    def two(a: Column, b: Column) -> Column:
        return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)

    return reduce(two, cols)


def merge_headers(crawler: Column | str, request: Column | str) -> Column:
    """Headers, compared in lower case; the request's count."""
    low = lambda m: F.transform_keys(F.coalesce(F.col(m) if isinstance(m, str) else m, F.create_map().cast("map<string,string>")), lambda k, _: F.lower(k))
    return merge_maps(low(crawler), low(request))


def merge_settings(*levels: dict[str, Any]) -> dict[str, Any]:
    """Defaults, user's settings, crawler's settings: a shallow merge in which dicts are merged one level deep, the later counting."""
    out: dict[str, Any] = {}
    for level in levels:
        for k, v in level.items():
            out[k] = {**out[k], **v} if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def merge_dicts(a: dict, b: dict) -> dict:
    """A merge of all levels; b counts."""
    return {**a, **{k: merge_dicts(a[k], v) if isinstance(v, dict) and isinstance(a.get(k), dict) else v for k, v in b.items()}}
