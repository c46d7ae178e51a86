import json
import threading
import urllib.error
import urllib.request
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from webloom.operators.items import ItemSpec
from webloom.operators.links import Parser
from webloom.operators.middleware import Handler, Middleware
from webloom.plans import crawl
from webloom.plans.chain import ChainCrawler, ChainItem, ChainRequest
from webloom.plans.settings import Settings
from webloom.sources import archive, live, shared, sinks


def quote(n, following=None):
    more = f'<li class="next"><a href="{following}">Next</a></li>' if following else ""
    return f'<div class="quote"><span class="text"> Q{n} </span><a href="/tag/t{n % 2}#top">tag</a></div>{more}'


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(1, "http://q.example/page/1/", quote(1, "/page/2/")), (2, "http://q.example/page/2/", quote(2, "/page/3/#x")), (3, "http://q.example/page/3/", quote(3, "/page/1/?")), (4, "http://q.example/tag/t0", "<a href='/page/1/'>back</a>"), (5, "http://q.example/tag/t1", "<a href='/missing'>gone</a>")]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def visits(result):
    return sorted((r.url, r.hop, r.status) for r in result.visited.collect())


def test_crawl_by_parsers(spark, pages):
    spec = ItemSpec("Quote", css={"text": ["span.text::text", "strip"]})
    parsers = [Parser(in_pattern="/page/", follow_patterns=["/page/", "/tag/"], css_divider=".quote", item=spec), Parser(in_pattern="/tag/", follow_patterns=["."])]
    result = crawl.Crawl(pages, parsers=parsers).run(crawl.seeds(spark, ["http://q.example/page/1/"], meta={"from": "start"}, ancestor="a"))
    assert visits(result) == [("http://q.example/missing", 2, 404), ("http://q.example/page/1/", 0, 200), ("http://q.example/page/2/", 1, 200), ("http://q.example/page/3/#x", 2, 200), ("http://q.example/tag/t0#top", 2, 200), ("http://q.example/tag/t1#top", 1, 200)]
    assert sorted(r.item.text for r in result.items_of("text string", "Quote").collect()) == ["Q1", "Q2", "Q3"]
    assert {(r.family, r.n_fail, r.n_success) for r in result.counts().collect()} == {("Request", 1, 5), ("Response", 0, 9), ("Quote", 0, 3)}
    assert {(r.meta["from"], r.ancestor) for r in result.visited.collect()} == {("start", "a")}
    assert result.lineage("a").count() == 6 and result.lineage("b").count() == 0


def test_crawl_goes_on_where_it_stopped(spark, pages, tmp_path):
    parsers = [Parser(follow_patterns=["/page/"])]
    one = crawl.Crawl(pages, parsers=parsers, settings=Settings(max_hops=1))
    start = crawl.seeds(spark, ["http://q.example/page/1/"])
    assert len(visits(one.run(start, f"{tmp_path}/run"))) == 1
    assert len(visits(one.run(start.limit(0), f"{tmp_path}/run"))) == 2
    rest = crawl.Crawl(pages, parsers=parsers).run(start, f"{tmp_path}/run")
    assert [v[0] for v in visits(rest)] == ["http://q.example/page/1/", "http://q.example/page/2/", "http://q.example/page/3/#x"]


class Stopped(Exception):
    pass


@pytest.mark.parametrize("at", [0, 2, 3, 5, 8])
def test_a_run_that_is_stopped_anywhere_is_taken_up(spark, pages, tmp_path, monkeypatch, at):
    """An error after each of the writes of a run in turn; the next run ends as one that nothing stopped."""
    spec = ItemSpec("Quote", css={"text": ["span.text::text", "strip"]})
    parsers = [Parser(in_pattern="/page/", follow_patterns=["/page/"], css_divider=".quote", item=spec)]
    one = crawl.Crawl(pages, parsers=parsers, settings=Settings(max_tries=0))
    start = crawl.seeds(spark, ["http://q.example/page/1/", "http://q.example/none"])
    writes = []

    def failing(df, path, mode="errorifexists"):
        out = shared.append(df, path, mode)
        writes.append(path)
        if len(writes) == 3 * at + 1:
            raise Stopped
        return out

    monkeypatch.setattr(crawl, "append", failing)
    stopped = False
    try:
        one.run(start, f"{tmp_path}/run")
    except Stopped:
        stopped = True
    monkeypatch.setattr(crawl, "append", shared.append)
    result = one.run(start, f"{tmp_path}/run")
    assert sorted(v[0] for v in visits(result)) == ["http://q.example/none", "http://q.example/page/1/", "http://q.example/page/2/", "http://q.example/page/3/#x"]
    assert sorted(r.item.text for r in result.items_of("text string").collect()) == ["Q1", "Q2", "Q3"]
    assert result.finished
    assert stopped


def test_a_step_counts_once_its_marker_is_there(spark, tmp_path):
    steps = shared.Steps(spark, str(tmp_path))
    path = steps.begin()
    shared.append(spark.createDataFrame([(1,)], "a int"), f"{path}/t")
    assert shared.Steps(spark, str(tmp_path)).read("t", "a int").count() == 0
    other = shared.Steps(spark, str(tmp_path))
    steps.commit(path, ["t"], now=2.5)
    again = shared.Steps(spark, str(tmp_path))
    assert again.read("t", "a int").count() == 1 and again.notes[0]["now"] == 2.5
    with pytest.raises(RuntimeError):
        other.commit(path, ["t"])


def responding(**signals):
    """A callback that gives signals by url, and an item for each response."""

    def run(responses):
        rows = responses.select("url", "tries", F.col("seq").alias("page_seq"))
        signal = F.lit(None).cast("string")
        for part, (what, most) in signals.items():
            signal = F.when(F.contains("url", F.lit(part)) & (F.col("tries") < most), what).otherwise(signal)
        made = rows.withColumns({"signal": signal, "defer": F.lit(50.0)})
        return {"items": rows.select("page_seq", F.lit("Seen").alias("family"), F.struct("url").alias("item")), "signals": made.where("signal IS NOT NULL").drop("url", "tries")}

    return run


def test_signals_decide_what_becomes_of_a_request(spark, pages):
    urls = [f"http://q.example/page/{i}/" for i in (1, 2, 3)] + ["http://q.example/tag/t0", "http://q.example/tag/t1", "http://q.example/none"]
    signals = {"page/1": ("skip", 9), "page/2": ("reschedule", 1), "page/3": ("broken", 2), "tag/t0": ("broken", 99), "tag/t1": ("drop", 9)}
    result = crawl.Crawl(pages, callbacks={"parse": responding(**signals)}).run(crawl.seeds(spark, urls))
    got = {r.url.removeprefix("http://q.example/"): (r.tries, r.flag, r.accepted, r.hop) for r in result.visited.collect()}
    # 4 executions of what never goes well; a reschedule counts as an attempt and comes 50 seconds later
    assert got == {"page/1/": (1, 1, True, 0), "page/2/": (2, 1, True, 0), "page/3/": (3, 1, True, 0), "tag/t0": (4, 0, True, 0), "tag/t1": (1, 1, True, 0), "none": (4, 0, False, 0)}
    assert {r.url: r.time for r in result.visited.collect()}["http://q.example/page/2/"] == 50.0
    assert result.finished
    ignored = crawl.Crawl(pages, callbacks={"parse": responding(**signals)}).run(crawl.seeds(spark, urls[3:4], ignore_exception=True))
    assert [(r.tries, r.flag) for r in ignored.visited.collect()] == [(1, 0)]


def test_first_signal_counts_and_an_immediate_one_ends_the_steps(spark, pages):
    def saying(what, now):
        return lambda responses: {"signals": responses.select(F.col("seq").alias("page_seq"), F.lit(what).alias("signal"), F.lit(now).alias("immediately"))}

    seen = lambda responses: {"items": responses.select(F.col("seq").alias("page_seq"), F.lit("S").alias("family"), F.struct("url").alias("item"))}
    start = crawl.seeds(spark, ["http://q.example/tag/t0"])
    settings = Settings(max_tries=0)
    late = crawl.Crawl(pages, callbacks={"parse": saying("skip", False)}, family_callbacks={"Response": seen}, settings=settings).run(start)
    assert late.items.count() == 1 and [r.signal for r in late.visited.collect()] == ["skip"]
    at_once = crawl.Crawl(pages, callbacks={"parse": saying("broken", True)}, family_callbacks={"Response": seen, "Other": seen}, settings=settings).run(start)
    assert at_once.items.count() == 0 and [(r.signal, r.flag) for r in at_once.visited.collect()] == [("broken", 0)]


def test_recrawls_and_late_tasks(spark, pages):
    start = crawl.seeds(spark, spark.createDataFrame([("http://q.example/tag/t0", 0.0, 100.0), ("http://q.example/tag/t1", 1000.0, None)], "url string, exetime double, recrawl double"))
    once = crawl.Crawl(pages).run(start)
    # recrawls go on while another task waits, at each hop that is due, and don't keep the run going
    assert [r.time for r in once.visited.collect() if r.url.endswith("t1")] == [1000.0] and once.pending.count() == 1
    until = crawl.Crawl(pages, settings=Settings(until=250.0)).run(start)
    assert sorted(r.time for r in until.visited.collect() if r.url.endswith("t0"))[:3] == [0.0, 100.0, 200.0]
    assert not until.finished and [r.recrawl for r in until.pending.collect()] == [100.0]


def test_a_run_says_what_is_left(spark, pages):
    result = crawl.Crawl(pages, parsers=[Parser(follow_patterns=["/page/"])], settings=Settings(max_hops=1)).run(crawl.seeds(spark, ["http://q.example/page/1/"]))
    assert not result.finished and [r.url for r in result.pending.collect()] == ["http://q.example/page/2/"]


def test_runs_share_what_they_have_seen_and_take_seeds_as_they_come(spark, pages, tmp_path):
    archive.push_seeds(spark, ["http://q.example/page/1/"], f"{tmp_path}/seeds")

    def incoming(hop):
        if hop == 1:
            archive.push_seeds(spark, ["http://q.example/page/3/", "http://q.example/page/1/"], f"{tmp_path}/seeds")
        return crawl.seeds(spark, archive.fresh_seeds(spark, f"{tmp_path}/seeds", f"{tmp_path}/state"))

    one = crawl.Crawl(pages, incoming=incoming).run(crawl.seeds(spark, ["http://q.example/tag/t0"]), f"{tmp_path}/one")
    assert sorted((r.url[17:], r.hop) for r in one.visited.collect()) == [("page/1/", 0), ("page/3/", 1), ("tag/t0", 0)]
    two = crawl.Crawl(pages, also_seen=[f"{tmp_path}/one"]).run(crawl.seeds(spark, ["http://q.example/page/1/", "http://q.example/page/2/"]))
    assert [r.url[17:] for r in two.visited.collect()] == ["page/2/"]


def test_parse_without_a_crawl(spark, pages):
    made = crawl.Crawl(None, parsers=[Parser(follow_patterns=["/page/"], item=ItemSpec("Q", css={"t": "span::text"}))]).parse(pages.where("page_id < 3"))
    assert made[0]["requests"].count() == 2 and sorted(r.item.t for r in made[0]["items"].collect()) == [" Q1 ", " Q2 "]


def test_caps_delay_but_lose_nothing(spark, pages):
    parsers = [Parser(follow_patterns=["/page/", "/tag/", "missing"])]
    start = crawl.seeds(spark, [f"http://q.example/page/{i}/" for i in (1, 2, 3)])
    slow = crawl.Crawl(pages, parsers=parsers, settings=Settings(max_requests_per_host=1, max_hops=20)).run(start)
    fast = crawl.Crawl(pages, parsers=parsers).run(start)
    assert {v[0].split("#")[0] for v in visits(slow)} == {v[0].split("#")[0] for v in visits(fast)}
    assert [v[1] for v in sorted(visits(slow), key=lambda v: v[1])] == list(range(len(visits(slow))))
    batched = crawl.Crawl(pages, parsers=parsers, settings=Settings(batch=2, max_hops=20)).run(start)
    assert len(visits(batched)) == len(visits(fast))


def test_callbacks_and_handlers(spark, pages):
    def again(responses):
        return {"items": responses.select(F.col("seq").alias("page_seq"), F.lit("Size").alias("family"), F.struct(F.length("html").alias("n")).alias("item"))}

    m = Middleware([Handler("double", "Size", after=lambda df: df.withColumn("item", F.struct((F.col("item.n") * 2).alias("n"))))])
    result = crawl.Crawl(pages, callbacks={"size": again}, middleware=m).run(crawl.seeds(spark, ["http://q.example/tag/t0", "http://q.example/nowhere"], callback="size"))
    assert [json.loads(r.item) for r in result.items.collect()] == [{"n": 2 * len("<a href='/page/1/'>back</a>")}]


def test_allowed_statuses(spark, pages):
    seen = []

    def note(responses):
        return {"items": responses.select(F.col("seq").alias("page_seq"), F.lit("S").alias("family"), F.struct("status").alias("item"))}

    for allowed, n in ((None, 0), ([], 1), ([404], 1), ([500], 0)):
        result = crawl.Crawl(pages, callbacks={"parse": note}).run(crawl.seeds(spark, ["http://q.example/nowhere"], status_allowed=allowed))
        assert result.items.count() == n
    assert not seen


def test_reachable_with_cycles(spark):
    edges = spark.createDataFrame([("http://a/", "http://b/#x"), ("http://b/", "http://a/"), ("http://b/", "http://c/?z=1&a=2"), ("http://c/?a=2&z=1", "http://c/?a=2&z=1"), ("http://d/", "http://e/")], "src string, dst string")
    got = crawl.reachable(edges, spark.createDataFrame([("http://a/#q",)], "url string")).collect()
    assert sorted(map(tuple, got)) == [("http://a/", 0), ("http://b/", 1), ("http://c/?a=2&z=1", 2)]


def test_settings():
    s = Settings.of({"MAX_TRIES": 3, "request_config": {"a": 1}}, {"max_tries": 5, "request_config": {"b": 2}})
    assert s.max_tries == 5 and s.request_config == {"a": 1, "b": 2}
    with pytest.raises(KeyError):
        Settings.of({"no_such": 1})


def test_chain(spark, pages, tmp_path):
    item = ChainItem("Quote").css("text", "span.text::text", "strip").extra(site="q").extra_from_meta("label", "text").to_table(f"{tmp_path}/quotes", key="text").to_json(f"{tmp_path}/lines")
    tag = ChainItem("Tag").css("links", "[a::attr(href)]")
    first = ChainRequest("http://q.example/page/1/").meta(label="L").spawn(item, ".quote").paginate("li.next a::attr(href)", pass_meta=True)
    first.follow(".quote > a::attr(href)").spawn(tag)
    result = ChainCrawler().conf(max_hops=8).use(first).run(pages)
    rows = spark.read.parquet(f"{tmp_path}/quotes").collect()
    assert sorted((r.text, r.site, r.label) for r in rows) == [("Q1", "q", "L"), ("Q2", "q", "L"), ("Q3", "q", "L")]
    assert spark.read.text(f"{tmp_path}/lines").count() == 3
    assert sorted(r.item.links[0] for r in result.items_of("links array<string>", "Tag").collect()) == ["/missing", "/page/1/"]
    service = ChainCrawler().use(ChainRequest("http://unused/").spawn(tag)).web(pages, port=0)
    try:
        def ask(path):
            try:
                with urllib.request.urlopen(f"http://127.0.0.1:{service.port}{path}", timeout=120) as r:
                    return r.status, json.load(r)
            except urllib.error.HTTPError as e:
                with e:
                    return e.code, json.load(e)

        assert ask("/add?url=http%3A%2F%2Fq.example%2Ftag%2Ft0") == (200, {"items": [{"links": ["/page/1/"]}]})
        assert ask("/add?url=http%3A%2F%2Fq.example%2Fnowhere")[0] == 400 and ask("/add")[0] == 400 and ask("/else")[0] == 404
    finally:
        service.stop()
    with pytest.raises(ValueError):
        ChainCrawler().run(pages)


def test_requests_of_a_chain_keep_their_meta_and_method(spark, pages):
    tag = ChainItem("Tag").xpath("href", "./@href | ./a/@href").extra_from_meta("label").store()
    a = ChainRequest("http://q.example/tag/t0").meta(label="A").spawn(tag)
    b = ChainRequest().request("http://q.example/tag/t1", "POST").meta(label="B").spawn(tag, xpath="//a")
    a.follow("a::attr(href)", pass_meta=True).spawn(ChainItem("Page").extra_from_meta("label"))
    b.follow("a::attr(href)", pass_meta=True)
    result = ChainCrawler().use(a, b).run(pages)
    assert sorted((r.url[17:], r.method, r.meta["label"]) for r in result.visited.collect()) == [("missing", "GET", "B"), ("page/1/", "GET", "A"), ("tag/t0", "GET", "A"), ("tag/t1", "POST", "B")]
    assert sorted((r.href, r.label) for r in result.storage()["Tag"].collect()) == [("/missing", "B"), ("/page/1/", "A")]
    assert list(result.storage()) == ["Tag"]


def test_send(spark, pages):
    row = archive.send(spark, "http://q.example/tag/t1#frag", pages).first()
    assert row.status == 200 and "missing" in row.html and row.meta == {}
    assert archive.send(spark, "http://q.example/x", pages).first().status == 404


def test_archive_with_copies(spark):
    pages = spark.createDataFrame([(1, "http://a/?x=1&y=2", "old", 200), (2, "http://a/?y=2&x=1#f", "new", 500)], "page_id long, url string, html string, status int")
    row = archive.fetch(spark.createDataFrame([("http://a/?y=2&x=1",)], "url string"), pages).first()
    assert (row.html, row.status) == ("new", 500)


def test_files(spark, tmp_path):
    df = spark.createDataFrame([("http://a/b/c.png?x=1", None), ("http://a/b/c.tar.gz", "name"), ("http://a/noext", "name")], "url string, fname string").coalesce(1)
    assert [tuple(r) for r in df.select(archive.file_name("url"), archive.file_name("url", "fname")).collect()] == [("c.png", "c.png"), ("c.tar.gz", "name.gz"), ("noext", "name")]
    bodies = spark.createDataFrame([(f"{tmp_path}/d/one.bin", b"1", 200), (f"{tmp_path}/d/two.bin", b"2", 404), (None, b"3", 200)], "where string, body binary, status int")
    assert sinks.save_files(bodies) == 1 and (tmp_path / "d/one.bin").read_bytes() == b"1" and not (tmp_path / "d/two.bin").exists()
    left = archive.not_there_yet(spark.createDataFrame([("one.bin",), ("two.bin",)], "file_name string"), f"{tmp_path}/d")
    assert [r[0] for r in left.collect()] == ["two.bin"]
    assert archive.not_there_yet(left, f"{tmp_path}/none").count() == 1


def test_json_bodies(spark):
    df = spark.createDataFrame([(b'{"slideshow": {"author": "A", "slides": [{"title": "t", "items": ["x"]}]}}',)], "body binary")
    assert df.select(F.try_variant_get(archive.json_of("body"), "$.slideshow.slides[0].items[0]", "string")).first()[0] == "x"


def test_upserts(spark, tmp_path):
    path = f"{tmp_path}/t"
    schema = "key long, a string, b string, at long"
    sinks.upsert(spark.createDataFrame([(1, "x", None, 1), (1, None, "y", 2), (2, "z", None, 1)], schema), path, "key", "at")
    sinks.upserting(path, "key", "at")(spark.createDataFrame([(1, "n", None, 3), (3, None, None, 3)], schema), 0)
    want = [(1, "n", "y", 3), (2, "z", None, 1), (3, None, None, 3)]
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == want
    sinks.upsert(spark.createDataFrame([(1, "n", None, 3)], schema), path, "key", "at")
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == want
    sinks.insert(spark.createDataFrame([(1,), (1,)], "a long"), f"{tmp_path}/i")
    sinks.insert(spark.createDataFrame([(1,)], "a long"), f"{tmp_path}/i")
    assert spark.read.parquet(f"{tmp_path}/i").count() == 3
    sinks.collect_families(spark.createDataFrame([("A", 1), ("B", 2)], "family string, v int"), f"{tmp_path}/f")
    assert spark.read.parquet(f"{tmp_path}/f/family=A").count() == 1
    assert shared.read_if_there(spark, f"{tmp_path}/none", "a int") is None


def test_upserts_keep_columns_and_survive_a_stop(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/t"
    sinks.upsert(spark.createDataFrame([(1, "x", "y", 1)], "key long, x string, y string, at long"), path, "key", "at")
    sinks.upsert(spark.createDataFrame([(1, "n", "z", 2)], "key long, x string, z string, at long"), path, "key", "at")
    rows = lambda: [r.asDict() for r in spark.read.parquet(path).collect()]
    assert rows() == [{"key": 1, "x": "n", "y": "y", "z": "z", "at": 2}]
    for name in ("rename", "delete"):
        for nth in (1, 2):
            calls = []

            def failing(spark, *paths, f=getattr(sinks, name), calls=calls, nth=nth):
                calls.append(paths)
                if len(calls) == nth:
                    raise OSError("stopped")
                f(spark, *paths)

            monkeypatch.setattr(sinks, name, failing)
            try:
                sinks.upsert(spark.createDataFrame([(nth, name, 9)], "key long, x string, at long"), path, "key", "at")
            except OSError:
                pass
            monkeypatch.undo()
            sinks.upsert(spark.createDataFrame([(nth, name, 9)], "key long, x string, at long"), path, "key", "at")
            assert {r["key"]: r["x"] for r in rows()}[nth] == name and {r["key"]: r["y"] for r in rows()}[1] == "y"
            assert not shared.exists(spark, f"{path}.old")


def test_items_can_be_logged(spark, caplog):
    with caplog.at_level("INFO", "webloom.items"):
        sinks.log_items(spark.createDataFrame([(1,)], "a int"))
    assert "'a': 1" in caplog.text


def test_nested_rules(spark, pages):
    spec = ItemSpec.nested({"text": ".quote .text::text", "links": ["//a/@href"], "all": [{"divider": ".quote", "t": "span::text"}], "one": {"t": "span::text"}})
    from webloom.operators.items import spawn

    item = spawn(pages.where("page_id = 1"), spec).first().item
    assert item.text == " Q1 " and item.links == ["/tag/t1#top", "/page/2/"] and item["all"][0].t == " Q1 " and item.one.t == " Q1 "
    assert spawn(pages.where("page_id = 4"), ItemSpec.nested("a::text")).first().item["item"] == "back"
    assert ChainItem("X").rule({"a": "a::text"}).css("b", "b::text").spec.css == {"a": "a::text", "b": "b::text"}
    with pytest.raises(ValueError):
        ItemSpec.nested({"a": [{"b": "c"}]})


def test_rules_with_variables_defaults_and_targets(spark, pages):
    from webloom.operators.items import process, spawn, to_json

    spec = ItemSpec("I", xpath={"mine": "//a[@href=$link]/text()"}, default={"at": lambda: 7, "x": "y"})
    df = pages.where("page_id < 3").select("url", "html", F.create_map(F.lit("link"), F.lit("/page/2/")).alias("meta"))
    rows = spawn(df, spec, meta="meta").collect()
    assert sorted((r.item.mine or "", r.item["at"], r.item.x) for r in rows) == [("", 7, "y"), ("Next", 7, "y")]
    parts = spawn(pages.where("page_id = 1"), ItemSpec("P", xpath={"t": "./text()"}), "//div/a | //span").collect()
    assert [r.item.t for r in parts] == [" Q1 ", "tag"]
    every = spawn(pages.where("page_id = 1"), ItemSpec("P", xpath={"t": "./text()"}), lambda root: [n for n in root.walk() if n.tag == "a"]).collect()
    assert [r.item.t for r in every] == ["tag", "Next"]
    made = spark.createDataFrame([((" a ", None, 1.5, ("x", None)),)], "item struct<x:string,t:string,n:double,inner:struct<x:string,y:string>>")
    dropped = process(made, {"x>t": ["strip"], "x": ["drop"]})
    assert json.loads(dropped.select(to_json()).first()[0]) == {"x": " a ", "t": "a", "n": 1.5, "inner": {"x": "x", "y": None}}
    nested = spark.createDataFrame([(("x", 'q","t":null,"', 10.0, ("x", None)), ["x", "n"])], "item struct<x:string,t:string,n:double,inner:struct<x:string,y:string>>, _dropped array<string>")
    assert nested.select(to_json()).first()[0] == '{"t":"q\\",\\"t\\":null,\\"","inner":{"x":"x","y":null}}'


def test_live_requests(spark):
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(200 if self.path == "/ok" else 404)
            self.send_header("Content-Type", "text/html; charset=latin-1")
            self.end_headers()
            self.wfile.write(b"caf\xe9" + self.headers.get("X-Own", "").encode())

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_address[1]}"
    try:
        df = spark.createDataFrame([(1, f"{base}/ok", {"X-Own": "!"}), (2, f"{base}/no", None), (3, "http://127.0.0.1:1/", None), (4, "nonsense", None)], "n int, url string, headers map<string,string>")
        got = {r.n: r for r in live.fetch_live(df, 2, delay=0.01, timeout=5).collect()}
        assert got[1].response_status == 200 and bytes(got[1].response_body) == b"caf\xe9!" and got[1].response_encoding == "latin-1"
        assert got[2].response_status == 404 and got[3].response_status is None and got[3].response_error and got[4].response_error
        text = live.fetch_live(df.where("n = 1"), 1).select(archive.text_of("response_body", "response_encoding")).first()[0]
        assert text == "café!" or text == "café"
        assert live.fetch_live(df.where("n = 2"), 1, tries=4).first().response_tries == 4
        assert live.fetch_live(df.where("n = 2"), 1, tries=4, allowed=[404]).first().response_tries == 1
        settings = Settings(max_tries=1, download_delay=0.01)
        got = crawl.Crawl(None, settings=settings, fetcher=live.fetcher(2, settings)).run(crawl.seeds(spark, [f"{base}/ok", f"{base}/no"]))
        assert sorted((r.status, r.tries, r.accepted) for r in got.visited.collect()) == [(200, 1, True), (404, 2, False)]
        assert live.fetch_live(df.where("n = 1"), 1, max_bytes=2).first().response_error == "body is too large"
    finally:
        server.shutdown()
