import heapq
import json
import random

import pytest
from pyspark.sql import functions as F

from webloom.functions import processors as x
from webloom.operators import control, counters, frontier, lineage, links, middleware
from webloom.operators.items import ItemSpec, process, spawn, to_json
from webloom.operators.links import Parser


def task_rows(n=400, seed=1):
    r = random.Random(seed)
    return [(i, float(r.randrange(50)), r.randrange(4), r.random() < 0.2, f"f{r.randrange(80)}", f"h{r.choice((0, 0, 0, 1, 2))}") for i in range(n)]


TASKS = "seq long, exetime double, priority int, dont_filter boolean, fingerprint string, host string"


def test_dedupe_as_a_set(spark):
    first = spark.createDataFrame([(i, 0.0, 0, False, str(i), "h") for i in range(1000)], TASKS)
    new, seen = frontier.produce(first)
    assert new.count() == seen.count() == 1000
    again = spark.createDataFrame([(0, 0.0, 0, False, "999", "h"), (1, 0.0, 0, False, "1000", "h"), (2, 0.0, 0, False, "1000", "h")], TASKS)
    assert [r.seq for r in frontier.produce(again, seen)[0].collect()] == [1]


def test_produce_like_a_loop(spark):
    rows = task_rows()
    known = {"f1", "f2"}
    want, seen = [], set(known)
    for r in rows:
        if r[3] or r[4] not in seen:
            want.append(r[0])
            if not r[3]:
                seen.add(r[4])
    df = spark.createDataFrame(rows, TASKS).repartition(3)
    new, recorded = frontier.produce(df, spark.createDataFrame([(k,) for k in known], "fingerprint string"))
    assert sorted(r.seq for r in new.collect()) == want
    assert {r[0] for r in recorded.collect()} == seen - known


def test_bypass_twice(spark):
    rows = [(0, 0.0, 0, True, "a", "h"), (1, 0.0, 0, True, "a", "h"), (2, 0.0, 0, False, "a", "h"), (3, 0.0, 0, None, "a", "h")]
    assert sorted(r.seq for r in frontier.produce(spark.createDataFrame(rows, TASKS))[0].collect()) == [0, 1, 2]


def test_order_is_that_of_the_score(spark):
    rows = task_rows()
    heap = [(-(r[2] * 1e10 - r[1]), r[0]) for r in rows]
    heapq.heapify(heap)
    df = spark.createDataFrame(rows, TASKS).repartition(4)
    assert [r.seq for r in frontier.ordered(df).collect()] == [heapq.heappop(heap)[1] for _ in rows]
    assert [r.seq for r in df.orderBy(frontier.score().desc(), "seq").collect()] == [r.seq for r in frontier.ordered(df).collect()]
    assert frontier.pop(df, 10.0, 5).count() == 5
    n = frontier.lengths(df, 10.0).first()
    assert n.n_ready + n.n_waiting == n.n_total == 400 and n.n_ready == frontier.due(df, 10.0).count()


def test_priorities(spark):
    df = spark.createDataFrame([(1, 0.0, 3), (2, 0.0, 1), (3, 0.0, 3), (4, 0.0, 2)], "seq long, exetime double, priority int")
    assert [r.seq for r in frontier.ordered(df).collect()] == [1, 3, 4, 2]


def test_caps(spark):
    df = spark.createDataFrame(task_rows(), TASKS)
    got = frontier.host_cap(df, 7).groupBy("host").count().collect()
    assert all(r["count"] == 7 for r in got) and len(got) == 3
    best = [r.seq for r in frontier.ordered(df.where("host = 'h0'")).limit(7).collect()]
    assert sorted(r.seq for r in frontier.host_cap(df, 7).where("host = 'h0'").collect()) == sorted(best)
    some = {r.host: r["count"] for r in frontier.host_cap(df, None, special={"h1": 3, "1": 2}).groupBy("host").count().collect()}
    assert some["h1"] == 2 and some["h0"] > 100


def test_delays(spark):
    df = spark.createDataFrame([("a.x.com",), ("b.com",), (None,)], "host string")
    assert [r[0] for r in df.select(frontier.host_delay("host", {"x": 1.0, ".com": 2.0, "q": 9.0}, 0.5)).collect()] == [3.0, 2.0, 0.5]
    r = df.select(frontier.jittered(F.lit(10.0), 1).alias("j")).collect()
    assert all(8 <= v.j <= 12 for v in r)
    starts = frontier.spaced(spark.createDataFrame([(0, 5.0, 1, "h"), (1, 5.0, 2, "h")], "seq long, exetime double, priority int, host string"), F.lit(2.0)).collect()
    assert {v.seq: v.start for v in starts} == {1: 5.0, 0: 7.0}


def test_recrawl_and_reschedule(spark):
    df = spark.createDataFrame([(1, 3, 100.0, 60, 0.0, False), (2, 1, 100.0, None, 0.0, False), (3, 1, 100.0, 0, 0.0, False)], "seq long, tries int, last_crawl_time double, recrawl int, exetime double, dont_filter boolean")
    again = frontier.recrawls(df).collect()
    assert [(r.seq, r.tries, r.exetime, r.dont_filter) for r in again] == [(1, 0, 160.0, True)]
    assert {(r.tries, r.dont_filter) for r in frontier.put_back(df).collect()} == {(2, True), (0, True)}
    put = frontier.reschedule(df, 10.0, 5.0, F.lit(9)).collect()
    assert {(r.exetime, r.dont_filter, r.recrawl) for r in put} == {(15.0, True, 9)}


@pytest.mark.parametrize(
    ("crawler", "request_", "status", "ok", "retried"),
    [(None, None, 200, True, False), ([5], [6], 200, True, False), (None, None, 404, False, True), (None, [], 404, True, False), (None, [404], 404, True, False), ([], None, 404, False, False), ([404], None, 404, False, False), ([500], [301], 404, False, True), (None, None, None, False, True)],
)
def test_status(spark, crawler, request_, status, ok, retried):
    df = spark.createDataFrame([(crawler, request_, status)], "c array<int>, r array<int>, s int")
    row = df.select(control.response_ok("s", "r").alias("ok"), (~control.status_accepted("s", "c", "r")).alias("retried")).first()
    assert (row.ok, row.retried) == (ok, retried)


def test_attempts(spark):
    rows = [(["error"] * 9, False, 4), (["error", "ok"], False, 2), (["error"] * 9, True, 1), (["skip"], False, 1), (["reschedule", "ok"], False, 2), ([], False, 1), (["drop"], False, 1), (["error"] * 3 + ["ok"], False, 4)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, o array<string>, ignored boolean, want int").coalesce(1)
    for r in df.withColumn("n", control.executions("o", F.col("ignored"))).collect():
        assert r.n == r.want, r
    state = spark.createDataFrame([("error", 0, False, 0.0, 0, None), ("error", 3, False, 0.0, 0, 60), ("reschedule", 0, False, 0.0, 7, None), (None, 1, False, 0.0, 0, 5)], "signal string, tries int, ignore_exception boolean, exetime double, defer int, recrawl int").coalesce(1)
    got = [(r.flag, r.tries, r.next_exetime) for r in control.after_attempt(state, 100.0).collect()]
    assert got == [(-1, 1, 100.0), (0, 0, 160.0), (-2, 1, 107.0), (1, 0, 105.0)]


def test_counters(spark):
    log = spark.createDataFrame([("a", 1, "2024-01-01 00:00:05"), ("a", 0, "2024-01-01 00:00:50"), ("a", -1, "2024-01-01 00:00:50"), ("b", 1, "2024-01-01 00:01:00")] + [("c", 1, "2024-01-01 00:02:00")] * 65, "family string, flag int, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert {(r.family, r.n_fail, r.n_success) for r in counters.family_counts(log).collect()} == {("a", 1, 1), ("b", 0, 1), ("c", 0, 65)}
    rates = counters.rate_per_window(log)
    assert {(r.family, r.n_success, r.per_min) for r in rates.collect()} == {("a", 1, 0), ("b", 1, 0), ("c", 65, 120)}
    assert {(r.family, r.total_success) for r in counters.running_counts(rates).collect()} == {("a", 1), ("b", 1), ("c", 65)}
    events = spark.createDataFrame([("x", "add", None), ("x", "add", None), ("x", "done", 1), ("x", "done", -2), ("y", "add", None), ("y", "done", 0)], "ancestor string, event string, flag int")
    left = counters.ancestor_unfinished(events.withColumn("delta", counters.unfinished_delta("event", "flag"))).collect()
    assert {(r.ancestor, r.unfinished) for r in left} == {("x", 1), ("y", 0)}
    assert counters.in_flight(events.limit(0).withColumn("delta", F.lit(1))).first()[0] == 0


# Items

QUOTES = """<div class="quote"><span class="text">“A”</span><small class="author"> Ann </small><a class="tag">x</a><a class="tag">y</a></div>
<div class="quote"><span class="text">“B”</span><small class="author"></small></div><li class="next"><a href="/page/2/">Next</a></li>"""


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(1, "http://q.example/page/1/", QUOTES), (2, "http://q.example/other", "<p>nothing"), (3, None, None)], "page_id long, url string, html string")


def test_quotes(spark, pages):
    spec = ItemSpec("Quote", css={"text": ["span.text::text", "strip", "replace:“,", "replace:”,"], "tags": "[a.tag::text]"}, xpath={"author": [".//small[@class='author']/text()", "strip", "default:nobody"]}, extra={"site": "q"})
    rows = spawn(pages, spec, ".quote").orderBy("item_pos").collect()
    assert [(r.page_id, r.item.text, r.item.tags, r.item.author, r.item.site, r.family) for r in rows] == [(1, "A", ["x", "y"], "Ann", "q", "Quote"), (1, "B", [], "nobody", "q", "Quote")]


def test_order_of_fields(spark, pages):
    spec = ItemSpec(css={"a": ".absent::text", "all": "[span.text::text]"}, default={"a": "d", "b": "d", "c": "d"}, extra={"c": "extra"}, re={"r": "“(.)”", "every": "[“(.)”]"}, inline={"q": ItemSpec(css={"t": "span::text"}), "qs": ItemSpec(css={"t": "span::text"}, divider=".quote")})
    item = spawn(pages.where("page_id = 1"), spec).first().item
    assert item.a is None and item.b == "d" and item.c == "extra" and item.r == "A" and item.every == ["A", "B"] and item["all"] == ["“A”", "“B”"]
    assert item.q.t == "“A”" and [x_.t for x_ in item.qs] == ["“A”", "“B”"]


def test_drops_and_json(spark):
    df = spark.createDataFrame([(1, "a", ""), (2, "", "b"), (3, None, None)], "id long, k string, v string").select("id", F.struct("k", "v").alias("item"))
    rows = process(df, {"v": ["drop"], "k": [x.drop_item(lambda c: c.isNotNull())]}).withColumn("json", to_json())
    assert {(r.id, tuple(r._dropped), r.json) for r in rows.collect()} == {(1, ("v",), '{"k":"a"}'), (2, (), '{"k":"","v":"b"}')}
    keep = process(df, {"v": ["to_int:,1"]}).where("id = 2").first()
    assert keep.item.v == "b" and keep._dropped == []


def test_bind(spark, pages):
    spec = ItemSpec(css={"text": ["span.text::text", "strip"], "tags": "[a.tag::text]"})

    @spec.bind()
    def process_text(c):
        return F.upper(c)

    @spec.bind("tags", map=True)
    def shout(c):
        return F.concat(c, F.lit("!"))

    row = spawn(pages.where("page_id = 1"), spec, ".quote").orderBy("item_pos").first()
    assert row.item.text == "“A”" and row.item.tags == ["x!", "y!"]


def test_follow(spark, pages):
    got = links.follow(pages, "li.next a::attr(href)", "parse").collect()
    assert [(r.url, r.callback, r.pos) for r in got] == [("http://q.example/page/2/", "parse", 0)]
    more = pages.withColumn("html", F.lit("<a href=''>0</a><a href='/1'>1</a><a href='/2'>2</a>")).withColumn("callback", F.lit("again"))
    assert sorted(r.url for r in links.paginate(more.where("page_id = 1"), "a::attr(href)", limit=1).collect()) == ["http://q.example/1"]
    slow = links.page_links(more, "a::attr(href)", native=False).select("page_id", "pos", "dst").collect()
    assert sorted(map(tuple, slow), key=repr) == sorted(map(tuple, links.page_links(more).select("page_id", "pos", "dst").collect()), key=repr)


def test_parser(spark, pages):
    spec = ItemSpec("Quote", css={"text": "span.text::text"})
    parser = Parser(in_pattern=r"/page/\d+", follow_patterns=[r"/page/\d+/$", "q", "zzz"], css_divider=".quote", item=spec)
    assert parser.items(pages).count() == 2
    assert sorted((r.dst, r.pattern) for r in parser.links(pages).collect()) == [("http://q.example/page/2/", 0), ("http://q.example/page/2/", 1)]
    assert Parser(item=spec).pages(pages.withColumn("ok", F.col("page_id") == 2)).count() == 1


# Middleware and lineage


def test_middleware(spark):
    rows = spark.createDataFrame([(1, ["Item", "Task"]), (2, ["Request", "Task"])], "id int, families array<string>").withColumn("log", F.lit(""))
    m = middleware.Middleware()

    @m.register("Item", priority=100)
    def late(df):
        return df.withColumn("log", F.concat("log", F.lit("late ")))

    @m.register("Item", priority=900)
    def early(df):
        return df.withColumn("log", F.concat("log", F.lit("early ")))

    @m.register("Task", position=middleware.BEFORE)
    def before(df):
        return df.withColumn("log", F.concat("log", F.lit("before ")))

    m.append(middleware.Handler(name="late", after=early))
    m.append(middleware.Handler(name="off", after=early, priority=0))
    assert [h.name for h in m.ordered()] == ["early", "before", "late"]
    assert {r.id: r.log for r in m.run(rows, middleware.AFTER).collect()} == {1: "early late ", 2: ""}
    assert {r.log for r in m.run(rows, middleware.BEFORE).collect()} == {"before "}
    m.configure({"early": 1, "before": False})
    assert [h.name for h in m.ordered()] == ["late", "early"]
    with pytest.raises(TypeError):
        m.register()(3)


def test_merges(spark):
    assert middleware.merge_dicts({"a": {"b": 1, "c": 2}, "d": 1}, {"a": {"c": 3}, "e": 4}) == {"a": {"b": 1, "c": 3}, "d": 1, "e": 4}
    assert middleware.merge_settings({"h": {"a": 1}, "n": 1}, {"h": {"b": 2}, "n": 2}) == {"h": {"a": 1, "b": 2}, "n": 2}
    df = spark.createDataFrame([({"a": "1", "b": "1"}, {"b": "2"}), (None, {"b": "2"}), ({"a": "1"}, None)], "p map<string,string>, c map<string,string>").coalesce(1)
    assert [r[0] for r in df.select(lineage.inherited_meta("p", "c")).collect()] == [{"a": "1", "b": "2"}, {"b": "2"}, {"a": "1"}]
    assert json.dumps({"x": 1})


def test_response_family(spark):
    df = spark.createDataFrame([("Page",), (None,)], "f string").coalesce(1)
    assert [r[0] for r in df.select(lineage.response_family("f")).collect()] == ["Page", "Response"]
