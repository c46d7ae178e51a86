"""A crawl as a loop over hops: frontier, fetch from an archive, callbacks, items and new requests.

Each hop is a few joins over the whole batch.  What a hop makes is written to a folder that all
executors share and counts once the hop is committed, so lineage is cut and a run can be taken
up again wherever it was stopped.

Time in a crawl of an archive is its own: a hop takes a second, and where no task is due the clock goes to
the next that is.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.functions.urls import canonical_url, fingerprint, host
from webloom.operators import frontier
from webloom.operators.control import FAILURE, SUCCESS, after_attempt, response_ok, status_accepted
from webloom.operators.links import Parser
from webloom.operators.middleware import AFTER, BEFORE, Middleware, merge_maps
from webloom.plans.settings import Settings
from webloom.sources.archive import fetch
from webloom.sources.shared import Steps, append, shared_dir

FRONTIER = "url string, method string, fingerprint string, priority int, exetime double, seq long, dont_filter boolean, callback string, family string, meta map<string,string>, ancestor string, status_allowed array<int>, hop int, tries int, recrawl double, ignore_exception boolean"
VISITED = "url string, method string, fingerprint string, hop int, status int, tries int, accepted boolean, ok boolean, callback string, family string, meta map<string,string>, ancestor string, seq long, signal string, flag int, time double"
ITEMS = "page_seq long, hop int, family string, item string"
_RAN = "fingerprint string, dont_filter boolean"
_SIGNALS = "page_seq long, signal string, defer double, recrawl double, immediately boolean"


def seeds(spark: SparkSession, urls: list[str] | DataFrame, callback: str = "parse", priority: int = 0, meta: dict[str, str] | None = None, ancestor: str | None = None, dont_filter: bool = False, status_allowed: list[int] | None = None, method: str = "GET", recrawl: float | None = None, ignore_exception: bool = False, family: str = "Response") -> DataFrame:
    """A frontier of first requests; a DataFrame may have any of the frontier's columns, url at least.

    seq is the order of arrival.  A run numbers its tasks anew, so tables whose seq overlap may be put together.  recrawl: seconds
    after which a finished request comes again.  family: that of its response, by which callbacks may be chosen.
    """
    df = urls if isinstance(urls, DataFrame) else spark.createDataFrame([(u,) for u in urls], "url string")
    defaults = {
        "method": F.lit(method), "family": F.lit(family), "tries": F.lit(0), "recrawl": F.lit(recrawl), "ignore_exception": F.lit(ignore_exception), "priority": F.lit(priority), "exetime": F.lit(0.0), "seq": F.monotonically_increasing_id(), "dont_filter": F.lit(dont_filter), "callback": F.lit(callback), "ancestor": F.lit(ancestor), "hop": F.lit(None),
        "meta": F.create_map(*(F.lit(x) for kv in (meta or {}).items() for x in kv)), "status_allowed": F.array(*map(F.lit, status_allowed)) if status_allowed is not None else F.lit(None),
    }
    for name, value in defaults.items():
        if name not in df.columns:
            df = df.withColumn(name, value)
        elif name == "callback":
            df = df.withColumn(name, F.coalesce(name, F.lit(callback)))
    return conform(df)


def _names(schema: str) -> list[str]:
    return T._parse_datatype_string(schema).names


def conform(df: DataFrame) -> DataFrame:
    """The frontier's columns, with fingerprints."""
    df = df.withColumn("fingerprint", fingerprint("url", F.col("method")))
    return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in T._parse_datatype_string(FRONTIER)))


Callback = Callable[[DataFrame], dict[str, DataFrame]]


@dataclass
class Crawl:
    """What a crawl does with responses, which come from an archive or from a fetcher (see sources.live).

    callbacks: by the name that a request has; family_callbacks: by the family of its response, after them; parsers come
    first.  Each takes responses and returns any of

    - requests: url and page_seq (the seq of the response that made them), and any of the frontier's columns;
    - items: page_seq, family and item;
    - signals: page_seq and signal (see control.outcome: skip, reschedule, drop, or an error), and any of defer, recrawl
      (seconds) and immediately.  The steps after a signal still run and the first signal counts, unless it is raised
      immediately: then later steps don't get the response.

    A status that isn't accepted and an error that a callback signals are retried at once, max_tries times, if the request
    doesn't ignore exceptions; rescheduled requests and recrawls come when their time has come.  All pass the dedupe.
    incoming: called with the number of each hop, gives seeds that have come since, or None.
    also_seen: folders of other runs, whose requests count as seen.
    """

    archive: DataFrame | None
    callbacks: dict[str, Callback] = field(default_factory=dict)
    parsers: list[Parser] = field(default_factory=list)
    middleware: Middleware = field(default_factory=Middleware)
    settings: Settings = field(default_factory=Settings)
    fetcher: Callable[[DataFrame], DataFrame] | None = None
    family_callbacks: dict[str, Callback] = field(default_factory=dict)
    incoming: Callable[[int], DataFrame | None] | None = None
    also_seen: list[str] = field(default_factory=list)

    def run(self, start: DataFrame, folder: str | None = None) -> Result:
        """Go on until no request is left that is to run, or for max_hops hops; Result.pending has what is left.

        A folder with an earlier run is taken up after its last whole hop, and start is added to what was pending there.
        """
        spark = start.sparkSession
        folder = folder or f"{shared_dir(spark)}/webloom-crawl-{uuid.uuid4().hex}"
        steps = Steps(spark, folder)
        self.middleware.start()
        hops, now = 0, float(steps.notes[-1]["now"]) if steps.notes else -1.0
        tasks = steps.read("pending", FRONTIER, 1)
        while self.settings.max_hops is None or hops < self.settings.max_hops:
            hop, path = len(steps.notes), steps.begin()
            new = self.incoming(hop) if self.incoming else None
            if not hops or new is not None:
                for more in (start if not hops else None, new):
                    tasks = tasks if more is None else tasks.unionByName(conform(more))
                tasks = append(tasks, f"{path}/tasks")
            earliest = self._earliest(tasks)
            if earliest is None:
                if new is not None or not hops:
                    append(tasks, f"{path}/pending")
                    steps.commit(path, ["pending"], now=now)
                break
            now = max(now + 1, earliest)
            tables, ran = self._hop(tasks, steps, path, hop, now)
            steps.commit(path, tables, now=now)
            tasks, hops = steps.read("pending", FRONTIER, 1), hops + 1
            if not ran and tasks.isEmpty():  # all that came had been seen
                break
        else:
            if not hops:  # no hop was asked for: the start is pending
                path = steps.begin()
                append(tasks.unionByName(start), f"{path}/pending")
                steps.commit(path, ["pending"], now=now)
        self.middleware.close()
        return Result(spark, folder)

    def _earliest(self, tasks: DataFrame) -> float | None:
        """When the next task is due; None if a run may end. Recrawls alone don't keep it going, unless up to `until`."""
        until = self.settings.until
        # what comes again has been visited, so it has a hop, and its tries begin anew
        again = F.coalesce((F.col("recrawl") > 0) & (F.col("tries") == 0) & F.col("hop").isNotNull(), F.lit(False))
        wanted = ~again if until is None else ~again | (F.col("exetime") <= until)
        return tasks.where(wanted).agg(F.min(F.coalesce("exetime", F.lit(0.0)))).first()[0]

    def _hop(self, tasks: DataFrame, steps: Steps, path: str, hop: int, now: float) -> tuple[list[str], bool]:
        """Run what is due; the names of the tables that were written, and whether anything ran."""
        later, batch = self._next_batch(tasks, steps, path, hop, now)
        responses = self._responses(batch, f"{path}/responses")
        pending, items, signals = later, None, None
        stopped = None
        for k, f in enumerate(self._steps()):
            made = f(responses if stopped is None else responses.join(stopped, F.col("seq") == F.col("page_seq"), "left_anti"))
            if made.get("items") is not None:
                rows = made["items"].withColumns({"hop": F.lit(hop), "families": F.array("family", F.lit("Item"), F.lit("Task"))})
                rows = self.middleware.run(rows, AFTER).select("page_seq", "hop", "family", F.to_json("item", {"ignoreNullFields": "false"}).alias("item"))
                items = rows if items is None else items.unionByName(rows)
            if made.get("requests") is not None:
                pending = pending.unionByName(self._requests(made["requests"], responses, now))
            if made.get("signals") is not None:
                found = append(_signals(made["signals"], k), f"{path}/signals-{k}")
                signals = found if signals is None else signals.unionByName(found)
                stopped = signals.where("immediately").select("page_seq").distinct()
        again = self._ended(responses, signals, now, f"{path}/ended")
        tables = ["pending", "batch", "ended"]
        if items is not None:
            append(items, f"{path}/items")
            tables.append("items")
        append(pending.unionByName(again), f"{path}/pending")
        return tables, not batch.isEmpty()

    def _next_batch(self, tasks: DataFrame, steps: Steps, path: str, hop: int, now: float) -> tuple[DataFrame, DataFrame]:
        """(tasks that wait, tasks to run now): due, accepted by the dedupe, within the caps of hosts and batch."""
        limits = self.settings
        ran = steps.read("batch", _RAN)
        for folder in self.also_seen:
            ran = ran.unionByName(Steps(tasks.sparkSession, folder).read("batch", _RAN))
        seen = ran.where(~F.col("dont_filter")).select("fingerprint")
        tasks = tasks.withColumns({"exetime": F.coalesce("exetime", F.lit(0.0)), "dont_filter": F.coalesce("dont_filter", F.lit(False))})
        later = frontier.waiting(tasks, now)
        accepted, _ = frontier.produce(frontier.due(tasks, now), seen, "exetime", "seq")
        capped = limits.max_requests_per_host or limits.max_requests_special_host
        if capped or limits.batch:
            accepted = append(accepted.withColumn("_own", F.monotonically_increasing_id()), f"{path}/accepted")
            picked = accepted
            if capped:
                hosts = accepted.withColumn("_host", F.coalesce(host("url"), F.lit("")))
                picked = frontier.host_cap(hosts, limits.max_requests_per_host, "_host", limits.max_requests_special_host).drop("_host")
            if limits.batch:
                picked = frontier.pop(picked, float("inf"), limits.batch)
            picked = append(picked, f"{path}/picked")
            later = later.unionByName(accepted.join(picked.select("_own"), "_own", "left_anti").select(*tasks.columns))
            accepted = picked.drop("_own")
        # a number of its own for each task: steps and partitions differ, so no two of a run are alike
        number = F.lit(hop).cast("long") * 2**51 + F.monotonically_increasing_id()
        return later, append(accepted.withColumns({"hop": F.when(F.col("tries") > 0, F.col("hop")).otherwise(F.lit(hop)), "seq": number}), f"{path}/batch")

    def _responses(self, batch: DataFrame, path: str) -> DataFrame:
        batch = self.middleware.run(batch.withColumn("families", F.array(F.lit("Request"), F.lit("Task"))), BEFORE).drop("families")
        batch = batch.withColumnRenamed("tries", "_before")
        fetched = self.fetcher(batch) if self.fetcher else fetch(batch, self.archive)
        allowed = F.lit(None).cast("array<int>") if self.settings.status_allowed is None else F.array(*map(F.lit, self.settings.status_allowed)).cast("array<int>")
        # a fetcher may have tried several times
        tries = F.col("_before") + (F.greatest(F.col("tries"), F.lit(1)) - 1 if "tries" in fetched.columns else 0)
        accepted = status_accepted("status", allowed, "status_allowed")
        return append(fetched.withColumns({"tries": tries.cast("int"), "ok": response_ok("status", "status_allowed"), "accepted": accepted}).drop("_before"), path)

    def _steps(self) -> Iterator[Callback]:
        """Parsers, callbacks by name and callbacks by family, each on its own responses."""
        for p in self.parsers:
            yield _parsing(p)
        for name, f in self.callbacks.items():
            yield _only(f, F.col("callback") == name)
        for family, f in self.family_callbacks.items():
            yield _only(f, F.col("family") == family)

    def parse(self, responses: DataFrame) -> list[dict[str, DataFrame]]:
        """What the steps make of responses that come from somewhere else, without a crawl; all count as ok."""
        given = {"seq": F.monotonically_increasing_id(), "callback": F.lit("parse"), "family": F.lit("Response"), "meta": F.create_map().cast("map<string,string>"), "status": F.lit(200), "ok": F.lit(True)}
        for name, value in given.items():
            if name not in responses.columns:
                responses = responses.withColumn(name, value)
        responses = append(responses, f"{shared_dir(responses.sparkSession)}/webloom-parse-{uuid.uuid4().hex}")
        return [f(responses) for f in self._steps()]

    def _ended(self, responses: DataFrame, signals: DataFrame | None, now: float, path: str) -> DataFrame:
        """Requests that come again. What becomes of each after this attempt is written."""
        rows = responses.drop("html", "page_id")
        if signals is None:
            rows = rows.withColumns({"signal": F.lit(None).cast("string"), "defer": F.lit(None).cast("double")})
        else:
            first = signals.groupBy("page_seq").agg(F.min_by(F.struct("signal", "defer", "recrawl"), F.struct(~F.col("immediately"), F.col("step"))).alias("_first"))
            rows = rows.join(first, F.col("seq") == F.col("page_seq"), "left")
            rows = rows.withColumns({"signal": F.col("_first.signal"), "defer": F.col("_first.defer"), "recrawl": F.coalesce("_first.recrawl", "recrawl")}).drop("_first", "page_seq")
        rows = rows.withColumn("signal", F.when(F.col("accepted"), F.col("signal")).otherwise(F.lit("status")))
        ended = after_attempt(rows.withColumn("_tried", F.col("tries")), now, self.settings.max_tries)
        ended = ended.withColumnRenamed("tries", "next_tries").withColumns({"tries": F.col("_tried") + 1, "time": F.lit(now)}).drop("_tried")
        again = append(ended, path).where(F.col("next_exetime").isNotNull())
        again = again.withColumns({"tries": F.col("next_tries"), "exetime": F.col("next_exetime"), "dont_filter": F.lit(True)})
        return again.select(*_names(FRONTIER))

    def _requests(self, new: DataFrame, responses: DataFrame, now: float) -> DataFrame:
        """Requests with what they inherit: the response's meta under their own, and its ancestor."""
        parents = responses.select(F.col("seq").alias("page_seq"), F.col("meta").alias("_meta"), F.col("ancestor").alias("_ancestor"))
        for name, value in {"exetime": F.lit(None).cast("double"), "meta": F.create_map().cast("map<string,string>"), "ancestor": F.lit(None).cast("string"), "callback": F.lit("parse"), "pos": F.lit(0)}.items():
            if name not in new.columns:
                new = new.withColumn(name, value)
        rows = new.join(parents, "page_seq", "left").withColumns({"meta": merge_maps("_meta", "meta"), "ancestor": F.coalesce("_ancestor", "ancestor")}).drop("_meta", "_ancestor")
        # a hash of where a request comes from: the same in every attempt, unlike a running number
        rows = rows.withColumns({"seq": F.xxhash64("page_seq", "url", "pos", "callback"), "exetime": F.coalesce("exetime", F.lit(now))})
        return seeds(new.sparkSession, rows)


def _signals(found: DataFrame, step: int) -> DataFrame:
    for name, value in {"defer": F.lit(None), "recrawl": F.lit(None), "immediately": F.lit(False)}.items():
        if name not in found.columns:
            found = found.withColumn(name, value)
    return found.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in T._parse_datatype_string(_SIGNALS)), F.lit(step).alias("step"))


def _only(f: Callback, which: Column) -> Callback:
    return lambda responses: f(responses.where(F.col("ok") & which))


def _parsing(p: Parser) -> Callback:
    def run(responses: DataFrame) -> dict[str, DataFrame]:
        good = responses.where("ok")
        items, links = p.items(good.drop("fingerprint")), p.links(good)
        made = {} if items is None else {"items": items.withColumn("page_seq", F.col("seq"))}
        if links is not None:
            made["requests"] = links.select(F.col("dst").alias("url"), F.col("seq").alias("page_seq"), F.lit("parse").alias("callback"), "pos")
        return made

    return run


@dataclass
class Result:
    """Tables of a run.

    visited: attempts after which a request was over, without their html; items: (page_seq, hop, family, item as JSON); pending: what is left.
    stores: schemas of the families whose items are kept for `storage`.
    """

    spark: SparkSession
    folder: str

    stores: dict[str, str] = field(default_factory=dict)

    @property
    def visited(self) -> DataFrame:
        return self._table("ended", VISITED).where(F.col("flag").isin(SUCCESS, FAILURE))

    @property
    def items(self) -> DataFrame:
        return self._table("items", ITEMS)

    @property
    def pending(self) -> DataFrame:
        return self._table("pending", FRONTIER, 1)

    @property
    def finished(self) -> bool:
        """Whether nothing is left to do. False where max_hops ended the run, and where recrawls are due later."""
        return self.pending.isEmpty()

    def _table(self, name: str, schema: str, last: int | None = None) -> DataFrame:
        return Steps(self.spark, self.folder).read(name, schema, last)

    def storage(self) -> dict[str, DataFrame]:
        """Items by family, of the families that are to be stored."""
        return {family: self.items_of(schema, family).select("item.*") for family, schema in self.stores.items()}

    def items_of(self, schema: str, family: str | None = None) -> DataFrame:
        rows = self.items if family is None else self.items.where(F.col("family") == family)
        return rows.select("page_seq", "hop", "family", F.from_json("item", schema).alias("item"))

    def counts(self) -> DataFrame:
        """(family, n_fail, n_success). Each attempt at a request gives a response that succeeds, also where the request fails in the end."""
        visited = self.visited
        requests = visited.agg(F.count_if(~F.col("accepted")).alias("n_fail"), F.count_if("accepted").alias("n_success")).withColumn("family", F.lit("Request"))
        responses = visited.agg(F.coalesce(F.sum("tries"), F.lit(0)).alias("n_success")).select(F.lit(0).cast("long").alias("n_fail"), "n_success", F.lit("Response").alias("family"))
        items = self.items.groupBy("family").agg(F.lit(0).cast("long").alias("n_fail"), F.count("*").alias("n_success"))
        return requests.unionByName(responses).unionByName(items).select("family", "n_fail", "n_success")

    def lineage(self, ancestor: str) -> DataFrame:
        """What a request and its descendants visited."""
        return self.visited.where(F.col("ancestor") == ancestor)


def reachable(edges: DataFrame, start: DataFrame, max_hops: int | None = None) -> DataFrame:
    """(url, hop): canonical urls reached from the starts over (src, dst), each with its first hop.

    Joins of new urls with the edges, less those seen; every hop is written to the shared folder, and all that were
    seen are read as one table.  It goes on until nothing new is reached; with max_hops, what is farther is left out.
    """
    spark = edges.sparkSession
    folder = f"{shared_dir(spark)}/webloom-reach-{uuid.uuid4().hex}"
    edges = append(edges.select(canonical_url("src").alias("src"), canonical_url("dst").alias("dst")).distinct(), f"{folder}/edges")
    new = append(start.select(canonical_url("url").alias("url")).distinct().withColumn("hop", F.lit(0)), f"{folder}/hops/hop=0")
    hop = 0
    while not new.isEmpty() and (max_hops is None or hop < max_hops):
        hop += 1
        found = spark.read.schema("url string").parquet(*(f"{folder}/hops/hop={k}" for k in range(hop)))
        step = new.join(edges, new.url == edges.src).select(F.col("dst").alias("url")).distinct()
        new = append(step.join(found, "url", "left_anti").withColumn("hop", F.lit(hop)), f"{folder}/hops/hop={hop}")
    return spark.read.schema("url string, hop int").parquet(*(f"{folder}/hops/hop={k}" for k in range(hop + 1)))
