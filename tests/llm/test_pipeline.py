import random
from collections import defaultdict

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tests.llm import brute  # noqa: E402
from webloom.llm.bpe import parse_ranks  # noqa: E402
from webloom.llm.line_dedup import MIN_SITES  # noqa: E402
from webloom.llm.quality import assess  # noqa: E402
from webloom.llm.queries import tokenizer  # noqa: E402


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghijklm") for _ in range(r.randrange(2, 8)))
    items = [(i, " ".join(word() for _ in range(14))) for i in range(6)]
    rows = []
    for i in range(240):
        lines = [" ".join(word() for _ in range(12)).capitalize() + "." for _ in range(r.randrange(1, 6))]
        if i % 5 == 0:
            lines.append("Shared on every site of all of them")
        if i % 40 == 1:
            lines.append(items[i // 40][1].title())
        if i % 30 == 2:
            lines = ["###".join(word() for _ in range(30)) + " $$$ &&&" for _ in lines]
        rows.append((i, "\n".join(lines), "en", f"s{i % 13}", 0))
    rows += [(500 + i, rows[i * 7][1], "en", "copy", 0) for i in range(20)] + [(900, rows[11][1].replace("a", "A", 1), "en", "s1", 0), (500, rows[0][1], "en", "copy", 0), (901, None, None, None, None), (None, "few words", "en", "s1", 0)]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), rows, items


def plain(spark, path, rows, items):
    kept = {(x.doc_id, x.digest): x.kept for x in assess(spark.read.parquet(f"{path}/documents.parquet")).collect()}
    from pyspark.sql import functions as F

    from webloom.llm.common import row_keys

    digest = {(x.doc_id, x.text): x.d for x in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text", row_keys()[1].alias("d")).collect()}
    assert F
    rows = [r for r in rows if kept[r[0], digest[r[0], r[1]]]]
    sites = defaultdict(set)
    for r in rows:
        for line in (r[1] or "").split("\n"):
            if line.split():
                sites[line].add(r[3])
    clean = [(r[0], "\n".join(x for x in r[1].split("\n") if len(sites[x]) < MIN_SITES)) for r in rows]
    groups = {}
    for (d, t), (_, _, c) in zip(clean, brute.op6(clean)):
        if d == c:
            groups.setdefault(c, (d, t))
    clean = list(groups.values())
    hit = {x[0] for x in brute.op2(clean, items) if x[5]}
    return [(d, t) for d, t in clean if d not in hit], hit, sites


def test_pipeline(spark, tables):
    import tiktoken

    path, rows, items = tables
    want, hit, sites = plain(spark, path, rows, items)
    assert hit and max(map(len, sites.values())) >= MIN_SITES and len(want) < 240
    content, pattern = tokenizer()
    encoder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=parse_ranks(content), special_tokens={})
    found = {r.doc_id: r for r in corpus_pipeline.run(spark, path).collect()}
    assert set(found) == {d for d, _ in want}
    for d, t in want:
        assert found[d].decoded_sha256 == brute.sha(t.encode())
        assert list(memoryview(bytes(found[d].ids)).cast("I")) == encoder.encode_ordinary(t)


def test_stages_keep_columns_and_take_anything(spark, tables):
    path = tables[0]
    rows = [(None, None, None, None, "x", 1), (1, "", "", "", "y", 2), (1, "", "", "", "y", 2), (2, "w " * 3000, "en", "s", None, None)]
    schema = "doc_id long, text string, lang string, source string, _doc string, n_lines int"
    for some in (rows, []):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            df = spark.createDataFrame(some, schema)
            out = stage(spark, df, path)
            assert out.columns == df.columns
            assert out.count() <= len(some)
        assert corpus_pipeline.STAGES[-1][1](spark, spark.createDataFrame(some, schema), path).count() == len(some)
