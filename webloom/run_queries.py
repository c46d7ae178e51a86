"""Queries over whole runs: crawls with signals, stops and late seeds, the fluent API, sinks and handlers; with DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions import processors as x
from webloom.functions import urls
from webloom.operators import control, counters, frontier, lineage, links
from webloom.operators.items import ItemSpec, process, spawn, to_json
from webloom.operators.middleware import AFTER, BEFORE, Handler, Middleware
from webloom.plans import crawl
from webloom.plans.chain import ChainCrawler, ChainItem, ChainRequest
from webloom.plans.settings import Settings
from webloom.queries import CANONICAL, ORACLES, epoch, query, table
from webloom.sources import archive, sinks
from webloom.sources.shared import shared_dir


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/webloom-{name}-{uuid.uuid4().hex}"


def _seeds(pages: DataFrame, **columns) -> DataFrame:
    return crawl.seeds(pages.sparkSession, pages.select("url", F.col("page_id").alias("seq"), *(c.alias(n) for n, c in columns.items())))


def _signalling(responses: DataFrame) -> dict[str, DataFrame]:
    """0: nothing, 1: skip, 2: put off once, 3: an error twice, 4: an error always, 5: an item dropped."""
    tries, case = F.col("tries"), F.col("meta")["case"].cast("int")
    signal = F.when(case == 1, "skip").when((case == 2) & (tries < 1), "reschedule").when((case == 3) & (tries < 2), "error").when(case == 4, "error").when(case == 5, "drop")
    rows = responses.select(F.col("seq").alias("page_seq"), signal.alias("signal"), F.lit(50.0).alias("defer"))
    return {"signals": rows.where("signal IS NOT NULL")}


@query(f"""SELECT url, CASE k WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 4 THEN 4 ELSE 1 END AS tries, CASE k WHEN 4 THEN 0 ELSE 1 END AS flag, CASE k WHEN 2 THEN 50 WHEN 3 THEN 2 WHEN 4 THEN 3 ELSE 0 END AS at
FROM (SELECT {CANONICAL} AS url, min(page_id) % 6 AS k FROM pages GROUP BY 1)""")
def crawl_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What callbacks signal, in a crawl: skipped, put off, retried, given up."""
    pages = table(spark, sf_dir, "pages")
    start = _seeds(pages, meta=F.create_map(F.lit("case"), (F.col("page_id") % 6).cast("string")))
    done = crawl.Crawl(pages, callbacks={"parse": _signalling}).run(start).visited
    return done.select(urls.canonical_url("url").alias("url"), "tries", "flag", F.col("time").cast("int").alias("at"))


@query(f"""SELECT url, tries, accepted, flag FROM (SELECT {CANONICAL} AS url, min(page_id) % 3 AS k FROM pages GROUP BY 1), LATERAL (SELECT CASE k WHEN 0 THEN 4 ELSE 1 END AS tries, k <> 0 AS accepted, CASE k WHEN 1 THEN 1 WHEN 2 THEN 1 ELSE 0 END AS flag)""")
def crawl_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statuses that nobody accepts are retried and given up; those that a request allows are not."""
    pages = table(spark, sf_dir, "pages")
    start = _seeds(pages, status_allowed=F.when(F.col("page_id") % 3 == 2, F.array(F.lit(500))), meta=F.create_map(F.lit("k"), (F.col("page_id") % 3).cast("string")))

    def answer(batch: DataFrame) -> DataFrame:
        return batch.withColumns({"status": F.when(F.col("meta")["k"] == "1", 200).otherwise(500), "html": F.lit("")})

    done = crawl.Crawl(None, fetcher=answer).run(start).visited
    return done.select(urls.canonical_url("url").alias("url"), "tries", "accepted", "flag")


@query(f"SELECT url, CASE WHEN k = 0 THEN 1 ELSE 2 END AS n_steps FROM (SELECT {CANONICAL} AS url, min(page_id) % 2 AS k FROM pages GROUP BY 1)")
def crawl_immediately(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After a signal the other steps still run, unless it is raised immediately; callbacks by name, then by family."""
    pages = table(spark, sf_dir, "pages")
    note = lambda rows: rows.select(F.col("seq").alias("page_seq"), F.lit("Step").alias("family"), F.struct("url").alias("item"))

    def first(responses: DataFrame) -> dict[str, DataFrame]:
        signals = responses.select(F.col("seq").alias("page_seq"), F.lit("skip").alias("signal"), (F.col("meta")["k"] == "0").alias("immediately"))
        return {"items": note(responses), "signals": signals}

    run = crawl.Crawl(pages, callbacks={"parse": first}, family_callbacks={"Response": lambda r: {"items": note(r)}})
    done = run.run(_seeds(pages, meta=F.create_map(F.lit("k"), (F.col("page_id") % 2).cast("string"))))
    return done.items_of("url string").groupBy(urls.canonical_url("item.url").alias("url")).agg(F.count("*").alias("n_steps"))


@query(ORACLES["crawl_archive_links"])
def crawl_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """crawl_archive_links, one hop at a time: each call takes up what the last one left."""
    pages, folder = table(spark, sf_dir, "pages"), _folder(spark, "resumed")
    parsers = [links.Parser(in_pattern="example", follow_patterns=["^https?://"])]
    start = _seeds(pages, meta=F.create_map(F.lit("origin"), urls.origin("url")))
    one = crawl.Crawl(pages, parsers=parsers, settings=Settings(max_hops=1))
    result = one.run(start, folder)
    while not result.finished:
        result = one.run(start.limit(0), folder)
    return result.visited.select(urls.canonical_url("url").alias("url"), "hop", "status", "ok", F.col("meta")["origin"].alias("origin"))


@query(f"SELECT {CANONICAL} AS url, CASE WHEN min(page_id % 2) = 0 THEN 0 ELSE 1 END AS hop FROM pages GROUP BY 1")
def crawl_incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds that come as files while the crawl runs."""
    pages, folder = table(spark, sf_dir, "pages"), _folder(spark, "incoming")

    def incoming(hop: int) -> DataFrame:
        if hop < 2:
            pages.where(F.col("page_id") % 2 == hop).select("url").write.mode("append").text(f"{folder}/seeds")
        return crawl.seeds(spark, archive.fresh_seeds(spark, f"{folder}/seeds", f"{folder}/state"))

    done = crawl.Crawl(pages, incoming=incoming).run(_seeds(pages).limit(0))
    return done.visited.select(urls.canonical_url("url").alias("url"), "hop")


@query(f"WITH s AS (SELECT {CANONICAL} AS url, min(page_id % 2) AS k FROM pages GROUP BY 1) SELECT url, CASE k WHEN 0 THEN 'one' ELSE 'two' END AS run FROM s")
def crawl_shared_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a second run leaves out what the first has seen."""
    pages, folder = table(spark, sf_dir, "pages"), _folder(spark, "shared")
    one = crawl.Crawl(pages).run(_seeds(pages.where("page_id % 2 = 0")), folder).visited
    two = crawl.Crawl(pages, also_seen=[folder]).run(_seeds(pages)).visited
    each = lambda df, name: df.select(urls.canonical_url("url").alias("url"), F.lit(name).alias("run"))
    return each(one, "one").unionByName(each(two, "two"))


@query(f"SELECT {CANONICAL} AS url, count(*) AS n_visits, max(page_id % 2) = 1 AS odd FROM pages WHERE page_id % 2 = 1 GROUP BY 1")
def crawl_past_the_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """requests that aren't filtered are all visited."""
    pages = table(spark, sf_dir, "pages")
    start = crawl.seeds(spark, pages.select("url", (F.col("page_id") % 2 == 1).alias("dont_filter"), F.col("page_id").alias("seq")))
    done = crawl.Crawl(pages).run(start.where("dont_filter")).visited
    return done.groupBy(urls.canonical_url("url").alias("url")).agg(F.count("*").alias("n_visits"), F.max(F.lit(True)).alias("odd"))


@query(f"""WITH s AS (SELECT {CANONICAL} AS url, min(page_id) AS first, max(page_id) AS last FROM pages GROUP BY 1)
SELECT url, 'POST' AS method, 'p' || first AS label, 'web' AS site, strlen(html) AS size FROM s JOIN (SELECT page_id, html FROM pages) p ON p.page_id = s.last""")
def chain_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fluent API: requests with method and meta, items with constants and meta, kept in a table."""
    pages = table(spark, sf_dir, "pages")
    item = ChainItem("Page").extra(site="web").extra_from_meta("label").store()
    item.spec.custom = lambda rows: rows.withColumn("item", F.col("item").withField("url", F.col("url")))
    first = ChainRequest().table(pages.select("url", F.col("page_id").alias("seq"), F.lit("POST").alias("method"), F.create_map(F.lit("label"), F.concat(F.lit("p"), F.col("page_id").cast("string"))).alias("meta"))).spawn(item)
    sizes: list[DataFrame] = []
    first.callback(lambda r: sizes.append(r.select("seq", "url", "method", F.octet_length("html").alias("size"))) or {})
    result = ChainCrawler().use(first).run(pages)
    visits = result.visited.select("seq", urls.canonical_url("url").alias("url"), "method")
    items = result.items_of("site string, label string, url string", "Page").select(F.col("page_seq").alias("seq"), "item.label", "item.site")
    return visits.join(items, "seq").join(sizes[0].select("seq", "size"), "seq").select("url", "method", "label", "site", F.col("size").cast("long").alias("size"))


@query("SELECT user_id, last(event_type ORDER BY event_id) FILTER (WHERE event_id % 2 = 0) AS a, last(event_type ORDER BY event_id) FILTER (WHERE event_id % 2 = 1) AS b, max(event_id) AS at FROM events GROUP BY 1")
def upsert_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3, K8: two batches with different columns are merged into a stored table."""
    e, path = table(spark, sf_dir, "events"), _folder(spark, "upsert")
    sinks.upsert(e.where("event_id % 2 = 0").select("user_id", F.col("event_type").alias("a"), F.col("event_id").alias("at")), path, "user_id", "at")
    sinks.upsert(e.where("event_id % 2 = 1").select("user_id", F.col("event_type").alias("b"), F.col("event_id").alias("at")), path, "user_id", "at")
    return spark.read.parquet(path).select("user_id", "a", "b", "at")


@query("SELECT event_type AS family, 2 * count(*) AS n, 2 * sum(user_id)::BIGINT AS total FROM events GROUP BY 1")
def insert_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2, K5: items are inserted twice, duplicates too, into a table for each family."""
    rows, path = table(spark, sf_dir, "events").select(F.col("event_type").alias("family"), "user_id"), _folder(spark, "families")
    sinks.collect_families(rows, path)
    sinks.collect_families(rows, path)
    stored = spark.read.parquet(path)
    return stored.groupBy("family").agg(F.count("*").alias("n"), F.sum("user_id").alias("total"))


@query("SELECT page_id, strlen(html) AS size, md5(html) AS digest FROM pages")
def save_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies as files, read again; what is there already isn't asked for."""
    pages, folder = table(spark, sf_dir, "pages"), _folder(spark, "files")
    rows = pages.select("page_id", F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("file_name"), F.col("html").cast("binary").alias("body"), F.lit(200).alias("status"))
    for _ in range(2):
        left = archive.not_there_yet(rows, folder)
        sinks.save_files(left.withColumn("where", F.concat(F.lit(f"{folder}/"), "file_name")))
    files = spark.read.format("binaryFile").load(folder)
    return files.select(F.regexp_extract("path", r"(\d+)\.html$", 1).cast("long").alias("page_id"), F.col("length").alias("size"), F.md5("content").alias("digest"))


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'request' ELSE 'normal' END AS queue, event_type <> 'click' OR event_id % 7 = 0 OR event_id = min(event_id) FILTER (WHERE event_type = 'click' AND event_id % 7 <> 0) OVER (PARTITION BY user_id) AS accepted FROM events")
def submit_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """requests go through the dedupe, other tasks don't; each row says whether it was taken."""
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "click", F.array(F.lit("Request"), F.lit("Task"))).otherwise(F.array(F.lit("Task")))
    rows = e.select(F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("fingerprint"), (F.col("event_id") % 7 == 0).alias("dont_filter"), kind.alias("families"))
    return frontier.submitted(rows).select(F.col("seq").alias("event_id"), "queue", "accepted")


@query("SELECT event_id, -1 AS tries, true AS dont_filter FROM events")
def put_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cancelled tasks: the attempt doesn't count, and they pass the dedupe."""
    rows = table(spark, sf_dir, "events").select("event_id", F.lit(0).alias("tries"), F.lit(False).alias("dont_filter"))
    return frontier.put_back(rows)


@query("SELECT event_id, epoch_us(ts) / 1e6 + 2.5 * (row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) - 1) AS start FROM events")
def host_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """when the tasks of a host may start, one after the other."""
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.lit(0).alias("priority"), epoch().alias("exetime"), F.col("user_id").alias("host"))
    return frontier.spaced(rows, F.lit(2.5)).select(F.col("seq").alias("event_id"), "start")


@query("SELECT count(*) FILTER (WHERE event_type = 'click') - count(*) FILTER (WHERE event_type = 'purchase') AS in_flight FROM events")
def in_flight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: tasks that have begun and not ended."""
    kind = F.col("event_type")
    return counters.in_flight(table(spark, sf_dir, "events").select(F.when(kind == "click", 1).when(kind == "purchase", -1).otherwise(0).alias("delta")))


@query("SELECT event_id, CASE event_type WHEN 'click' THEN (user_id + 1) * 2 WHEN 'error' THEN user_id * 2 + 100 ELSE user_id * 2 END AS n FROM events")
def handler_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered steps run by priority on the rows of their family; one that is turned off doesn't."""
    m = Middleware()
    m.register()(Handler("all", priority=400, after=lambda df: df.withColumn("n", F.col("n") * 2)))
    m.register("click", AFTER, 900)(lambda df: df.withColumn("n", F.col("n") + 1))
    m.register("error", BEFORE, 100)(Handler("early", after=lambda df: df.withColumn("n", F.col("n") + 100)))
    m.register("error")(Handler("off", priority=500, after=lambda df: df.withColumn("n", F.lit(-1).cast("long"))))
    m.append(Handler("never", priority=0, after=lambda df: df.limit(0)))
    m.configure({"off": 0, "all": True})
    rows = table(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("long").alias("n"), F.array("event_type", F.lit("Task")).alias("families"))
    return m.run(rows, AFTER).select("event_id", "n")


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'Special' ELSE 'Response' END AS family FROM pages")
def response_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Family of a response, which its request may name."""
    named = F.when(F.col("page_id") % 3 == 0, "Special")
    return table(spark, sf_dir, "pages").select("page_id", lineage.response_family(named).alias("family"))


@query("SELECT doc_id, text FROM documents")
def body_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of bodies by their encoding; half of them in UTF-16."""
    other = F.col("doc_id") % 2 == 1
    rows = table(spark, sf_dir, "documents").select("doc_id", F.when(other, F.encode("text", "UTF-16LE")).otherwise(F.col("text").cast("binary")).alias("body"), F.when(other, "utf-16-le").alias("encoding"))
    return rows.select("doc_id", archive.text_of("body").alias("text"))


@query("SELECT page_id, url AS u, upper(url) AS v, CASE WHEN page_id % 2 = 0 THEN 'w' ELSE 'v' END AS last FROM pages")
def process_to_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What processors make of one field goes to another; a bound step replaces the rule's own; JSON without dropped fields."""
    spec = ItemSpec("I", css={"w": ["title::text", "strip"]})

    @spec.bind("w")
    def process_w(c):
        return c

    keep = F.struct(F.col("url").alias("u"), F.lit(None).cast("string").alias("v"), F.when(F.col("page_id") % 2 == 0, "x").alias("w"))
    rows = table(spark, sf_dir, "pages").select("page_id", keep.alias("item"))
    made = process(rows, {"u>v": [F.upper], "w": [*spec.steps()["w"], x.drop(lambda c: c.isNotNull())]})
    fields = F.json_object_keys(to_json())
    return made.select("page_id", "item.u", "item.v", F.element_at(fields, -1).alias("last"))


@query(f"WITH s AS (SELECT max(page_id) AS page_id FROM pages GROUP BY {CANONICAL} HAVING count(*) FILTER (WHERE page_id = 0) > 0) SELECT 200 AS status, strlen(html) AS size FROM pages JOIN s USING (page_id)")
def send_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request on its own."""
    pages = table(spark, sf_dir, "pages")
    url = pages.where("page_id = 0").first().url
    return archive.send(spark, url, pages).select("status", F.octet_length("html").cast("long").alias("size"))


@query("SELECT event_id, CASE user_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN -2 ELSE CASE WHEN event_id % 6 <= 3 THEN -1 ELSE 0 END END AS flag FROM events")
def attempt_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flag of an attempt by its signal: skipped and dropped ones succeed, others are put off, retried or given up."""
    u = F.col("user_id") % 4
    signal = F.when(u == 0, "skip").when(u == 1, "drop").when(u == 2, "reschedule").otherwise("error")
    e = table(spark, sf_dir, "events").withColumns({"signal": signal, "tries": F.col("event_id") % 6})
    return e.select("event_id", control.outcome("signal", "tries", F.lit(False)).alias("flag"))
