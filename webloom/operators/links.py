"""Links of pages: follow, paginate, and parsers that go by url patterns."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.functions.html import css, parse
from webloom.functions.processors import java_regex
from webloom.functions.urls import absolute_url, hrefs
from webloom.operators.items import ItemSpec, spawn

NATIVE_RULES = ("a::attr(href)",)


def _finder(rule: str) -> Callable[[Column], Column]:
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def find(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for html in pages:
            yield pd.Series([[] if t is None else css(parse(t), rule) for t in html], dtype=object)

    return find


def page_links(pages: DataFrame, rule: str = "a::attr(href)", limit: int = 0, html: str = "html", url: str = "url", keep: list[str] | None = None, native: bool = True) -> DataFrame:
    """(keep..., pos, href, dst): links that a rule finds on each page, absolute; at most `limit` of each (0: all).

    Empty links are left out before they are counted.  The plain rule for all links is done in the JVM; other
    rules need the tree.  The limit is applied before links become rows.
    """
    keep = [c for c in pages.columns if c != html] if keep is None else keep
    found = hrefs(html) if native and rule in NATIVE_RULES else _finder(rule)(F.col(html))
    found = F.filter(found, lambda x: F.length(x) > 0)
    rows = pages.select(*dict.fromkeys([*keep, url]), found.alias("_found"))
    rows = rows.withColumn("_found", F.slice("_found", 1, limit) if limit else F.col("_found"))
    # outer, as the plain form has the optimizer look for links twice, to leave out pages without any before
    rows = rows.select(*dict.fromkeys([*keep, url]), F.posexplode_outer("_found").alias("pos", "href")).where(F.col("pos").isNotNull())
    return rows.withColumn("dst", absolute_url(url, "href")).select(*keep, "pos", "href", "dst")


def requests(links: DataFrame, callback: Column | str | None, priority: int = 0, pass_meta: bool = False) -> DataFrame:
    """Links as requests: url, method, callback, priority, meta (that of the page, if it is to be passed)."""
    name = F.lit(callback).cast("string") if callback is None or isinstance(callback, str) else callback
    meta = F.col("meta") if pass_meta and "meta" in links.columns else F.create_map().cast("map<string,string>")
    more = [c for c in links.columns if c not in ("url", "method", "callback", "priority", "meta", "dst")]
    return links.select(F.col("dst").alias("url"), F.lit("GET").alias("method"), name.alias("callback"), F.lit(priority).alias("priority"), meta.alias("meta"), *more)


def follow(pages: DataFrame, rule: str, callback: str | None = None, limit: int = 0, pass_meta: bool = False, **where: str) -> DataFrame:
    """A request for each link of the rule."""
    return requests(page_links(pages, rule, limit, **where), callback, pass_meta=pass_meta)


def paginate(pages: DataFrame, rule: str, limit: int = 0, pass_meta: bool = False, **where: str) -> DataFrame:
    """As follow, but the new requests have the callback of the page (column callback)."""
    return requests(page_links(pages, rule, limit, **where), F.col("callback"), pass_meta=pass_meta)


@dataclass
class Parser:
    """Pages whose url a pattern is found in give items, and links that patterns are found in.

    in_pattern: empty for all pages.  follow_patterns: a link is given once for each that is found in it.
    """

    in_pattern: str = ""
    follow_patterns: list[str] = field(default_factory=list)
    css_divider: str | None = None
    item: ItemSpec | None = None
    callbacks: list[Callable[[DataFrame], DataFrame]] = field(default_factory=list)

    def matches(self, url: Column | str = "url") -> Column:
        url = F.col(url) if isinstance(url, str) else url
        return url.rlike(java_regex(self.in_pattern)) if self.in_pattern else F.lit(True)

    def pages(self, responses: DataFrame) -> DataFrame:
        """Filtered before any html is looked at."""
        ok = F.coalesce(F.col("ok"), F.lit(False)) if "ok" in responses.columns else F.lit(True)
        return responses.where(self.matches() & ok)

    def items(self, responses: DataFrame) -> DataFrame | None:
        return spawn(self.pages(responses), self.item, self.css_divider) if self.item else None

    def links(self, responses: DataFrame) -> DataFrame | None:
        """Links are found once and then compared with all patterns."""
        if not self.follow_patterns:
            return None
        return by_patterns(page_links(self.pages(responses)), self.follow_patterns)


def by_patterns(links: DataFrame, patterns: list[str], dst: str = "dst") -> DataFrame:
    """Add `pattern` (its number, from 0): a row for each pattern that is found in the link."""
    hits = F.array_compact(F.array(*(F.when(F.col(dst).rlike(java_regex(p)), F.lit(i)) for i, p in enumerate(patterns))))
    return links.withColumn("pattern", F.explode(hits))
