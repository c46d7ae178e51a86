"""A fluent way to describe a crawl; `run` lowers it to a Crawl."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.operators.items import ItemSpec, Rule, spawn
from webloom.operators.links import page_links
from webloom.plans.crawl import Crawl, Result, _only, seeds
from webloom.plans.service import Service
from webloom.plans.settings import Settings
from webloom.sources import sinks

#: Columns of responses that outputs carry on.
_KEEP = ["url", "seq", "meta", "callback"]


class ChainItem:
    """Rules of an item; what becomes of items of this family."""

    def __init__(self, family: str = "Item") -> None:
        self.spec = ItemSpec(name=family)
        self.sinks: list[Callable[[DataFrame], None]] = []

    def extra(self, **values: Any) -> ChainItem:
        self.spec.extra |= values
        return self

    def extra_from_meta(self, *keys: str) -> ChainItem:
        self.spec.extra_from_meta = list(keys) or True
        return self

    def store(self) -> ChainItem:
        """Keep the items of this family for Result.storage."""
        self.spec.store = True
        return self

    def css(self, field: str, rule: str, *steps: Any) -> ChainItem:
        return self._rule("css", field, rule, steps)

    def xpath(self, field: str, rule: str, *steps: Any) -> ChainItem:
        return self._rule("xpath", field, rule, steps)

    def re(self, field: str, rule: str, *steps: Any) -> ChainItem:
        return self._rule("re", field, rule, steps)

    def _rule(self, kind: str, field: str, rule: str, steps: tuple) -> ChainItem:
        value: Rule = [rule, *steps] if steps else rule
        getattr(self.spec, kind)[field] = value
        return self

    def rule(self, rule: Any) -> ChainItem:
        """A nested rule for the whole item; see ItemSpec.nested."""
        nested = ItemSpec.nested(rule, self.spec.name)
        for part in ("css", "xpath", "inline"):
            getattr(self.spec, part).update(getattr(nested, part))
        return self

    def inline(self, field: str, item: ChainItem, divider: str | None = None) -> ChainItem:
        self.spec.inline[field] = item.spec
        item.spec.divider = divider
        return self

    def process(self, step: Callable[[DataFrame], DataFrame]) -> ChainItem:
        self.spec.custom = step
        return self

    def to_table(self, path: str, key: str | None = None) -> ChainItem:
        """Items as rows of a table; with a key, fields are merged by it."""
        self.sinks.append(lambda items: sinks.upsert(items, path, key, "_order") if key else sinks.insert(items.drop("_order"), path))
        return self

    def to_json(self, path: str) -> ChainItem:
        self.sinks.append(lambda items: sinks.to_json_lines(items.select(F.to_json(F.struct(*[c for c in items.columns if c != "_order"])).alias("json")), path))
        return self

    def debug(self) -> ChainItem:
        self.sinks.append(sinks.log_items)
        return self


class ChainRequest:
    """Requests, and what is done with their responses."""

    def __init__(self, *urls: str) -> None:
        self.urls: list[tuple[str, str]] = [(u, "GET") for u in urls]
        self.rows: DataFrame | None = None
        self.options: dict[str, Any] = {}
        self.steps: list[tuple[str, dict]] = []
        self.custom: list[Callable[[DataFrame], dict[str, DataFrame]]] = []

    def get(self, *urls: str) -> ChainRequest:
        self.urls += [(u, "GET") for u in urls]
        return self

    def request(self, url: str, method: str = "GET") -> ChainRequest:
        """A url with its method; those of get have GET."""
        self.urls.append((url, method))
        return self

    def table(self, rows: DataFrame) -> ChainRequest:
        """First requests from a table with url, and any other columns of the frontier."""
        self.rows = rows
        return self

    def meta(self, **values: str) -> ChainRequest:
        self.options["meta"] = self.options.get("meta", {}) | values
        return self

    def kwargs(self, **values: Any) -> ChainRequest:
        """Options of seeds: priority, dont_filter, ancestor, status_allowed."""
        self.options |= values
        return self

    def status_allowed(self, statuses: list[int] | None) -> ChainRequest:
        self.options["status_allowed"] = statuses
        return self

    def callback(self, f: Callable[[DataFrame], dict[str, DataFrame]]) -> ChainRequest:
        """f: responses to {"items": ..., "requests": ...}."""
        self.custom.append(f)
        return self

    add_callback = callback

    def spawn(self, item: ChainItem, divider: str | None = None, allowed: list[int] | None = None, xpath: str | None = None) -> ChainRequest:
        """Items from responses with these statuses (200 unless told otherwise), one for each match of divider, a css rule, or of xpath."""
        divider = divider or (xpath if xpath is None or xpath.startswith(("/", "./")) else f"./{xpath}")
        self.steps.append(("spawn", {"item": item, "divider": divider, "allowed": [200] if allowed is None else allowed}))
        return self

    def follow(self, rule: str, limit: int = 0, pass_meta: bool = False) -> ChainRequest:
        """The next stage: requests for links. What is said from here on is about their responses."""
        stage = ChainRequest()
        stage.parent = self  # type: ignore[attr-defined]
        self.steps.append(("follow", {"rule": rule, "limit": limit, "pass_meta": pass_meta, "stage": stage}))
        return stage

    def paginate(self, rule: str, limit: int = 0, pass_meta: bool = False) -> ChainRequest:
        """Requests for links whose responses are treated as those of this stage."""
        self.steps.append(("follow", {"rule": rule, "limit": limit, "pass_meta": pass_meta, "stage": self}))
        return self

    def root(self) -> ChainRequest:
        at = self
        while hasattr(at, "parent"):
            at = at.parent
        return at


class ChainCrawler:
    """Settings and first requests."""

    def __init__(self) -> None:
        self.settings: dict[str, Any] = {}
        self.requests: list[ChainRequest] = []

    def conf(self, **values: Any) -> ChainCrawler:
        self.settings |= values
        return self

    def concurrency(self, per_host: int | None = None, special: dict[str, int] | None = None) -> ChainCrawler:
        return self.conf(max_requests_per_host=per_host, max_requests_special_host=special or {})

    def delay(self, seconds: float, special: dict[str, float] | None = None) -> ChainCrawler:
        return self.conf(download_delay=seconds, download_delay_special_host=special or {})

    def retry(self, tries: int) -> ChainCrawler:
        return self.conf(max_tries=tries)

    def use(self, *requests: ChainRequest) -> ChainCrawler:
        self.requests += [r.root() for r in requests]
        return self

    add = use

    def lowered(self, archive: DataFrame) -> tuple[Crawl, DataFrame, list[ChainItem]]:
        """(crawl, seeds, items with sinks)."""
        spark = archive.sparkSession
        names: dict[int, str] = {}
        callbacks: dict[str, Callable] = {}
        items: list[ChainItem] = []

        def lower(stage: ChainRequest) -> str:
            if id(stage) in names:
                return names[id(stage)]
            name = names[id(stage)] = f"stage{len(names)}"
            steps = [(kind, {**step, "to": lower(step["stage"])} if kind == "follow" else step) for kind, step in stage.steps]
            items.extend(step["item"] for kind, step in steps if kind == "spawn")
            for i, (kind, step) in enumerate(steps):
                callbacks[f"{name}/{i}"] = (name, _spawner(step) if kind == "spawn" else _follower(step, i))
            for i, f in enumerate(stage.custom):
                callbacks[f"{name}/custom{i}"] = (name, f)
            return name

        start = None
        for r in self.requests:
            urls = spark.createDataFrame([(i, *x) for i, x in enumerate(dict.fromkeys(r.urls))], "seq long, url string, method string")
            own = seeds(spark, urls, callback=lower(r), **r.options)
            if r.rows is not None:
                own = own.unionByName(seeds(spark, r.rows, callback=lower(r), **r.options))
            start = own if start is None else start.unionByName(own)
        if start is None:
            raise ValueError("no requests")
        return _StagedCrawl(archive, settings=Settings.of(self.settings), stages=callbacks), start, items

    def run(self, archive: DataFrame, folder: str | None = None) -> Result:
        """Crawl the archive, and hand the items of each family to its sinks."""
        crawl, start, items = self.lowered(archive)
        result = crawl.run(start, folder)
        result.stores = {i.spec.name: i.spec.schema().simpleString() for i in items if i.spec.store}
        for item in {id(i): i for i in items}.values():
            for sink in item.sinks:
                rows = result.items_of(item.spec.schema().simpleString(), item.spec.name)
                sink(rows.select("item.*", F.struct("hop", "page_seq").alias("_order")))
        return result

    def query(self, archive: DataFrame, urls: list[str]) -> Result:
        """Crawl these urls with the first stage's steps, past the dedupe, as one lineage of their own."""
        crawl, _, _ = self.lowered(archive)
        first = next(iter(crawl.stages.values()))[0]
        return crawl.run(seeds(archive.sparkSession, urls, callback=first, ancestor="web@" + uuid.uuid4().hex, dont_filter=True))

    def web(self, archive: DataFrame, port: int = 8079) -> Service:
        """A service that answers GET /add?url=... with the items of such a crawl. An answer is meant to be small: it goes through the driver."""
        return Service(lambda urls: [json.loads(r.item) for r in self.query(archive, urls).items.toLocalIterator()], port).start()


class _StagedCrawl(Crawl):
    """Several callbacks for each stage."""

    def __init__(self, archive: DataFrame, settings: Settings, stages: dict[str, tuple[str, Callable]]) -> None:
        super().__init__(archive, settings=settings)
        self.stages = stages

    def _steps(self) -> Iterator[Callable]:
        for name, f in self.stages.values():
            yield _only(f, F.col("callback") == name)


def _spawner(step: dict) -> Callable[[DataFrame], dict[str, DataFrame]]:
    def run(responses: DataFrame) -> dict[str, DataFrame]:
        good = responses.where(F.col("status").isin(step["allowed"])) if step["allowed"] else responses
        rows = spawn(good, step["item"].spec, step["divider"], keep=_KEEP, meta="meta")
        return {"items": rows.withColumnRenamed("seq", "page_seq")}

    return run


def _follower(step: dict, number: int) -> Callable[[DataFrame], dict[str, DataFrame]]:
    def run(responses: DataFrame) -> dict[str, DataFrame]:
        links = page_links(responses, step["rule"], step["limit"], keep=_KEEP)
        meta = F.col("meta") if step["pass_meta"] else F.create_map().cast("map<string,string>")
        return {"requests": links.select(F.col("dst").alias("url"), F.col("seq").alias("page_seq"), F.lit(step["to"]).alias("callback"), meta.alias("meta"), (F.col("pos") * 100 + number).alias("pos"))}

    return run
