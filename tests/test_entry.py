"""Every query with SQL agrees with DuckDB on the smallest tables; the rest still works without the optional files."""

import math
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ROOT = Path(__file__).resolve().parents[1]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def views():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return bytes(v).hex() if isinstance(v, bytes | bytearray) else v


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_agrees_with_sql(spark, views, name):
    df = entry.queries()[name](spark, SF)
    want = views.sql(entry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    found = sorted(([plain(r[c]) for c in columns] for r in df.collect()), key=repr)
    place = [want.columns.index(c) for c in columns]
    assert found == sorted(([plain(r[i]) for i in place] for r in want.fetchall()), key=repr)
    assert found


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_of_the_core_has_sql():
    assert not {n for n in entry.queries() if n not in entry.oracle_sql() and not n.startswith("op") and n != "pipeline"}


def test_map_reaches_every_word(spark):
    got = {r.doc_id: r.words for r in entry.queries()["proc_map"](spark, SF).collect()}
    want = {r.doc_id: r.text.replace("e", "E") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert got == want and any(len(t.split(" ")) > 20 for t in want.values())


def test_crawl_records_the_links_it_follows(spark):
    rows = entry.queries()["crawl_archive_links"](spark, SF).collect()
    assert {(r.hop, r.status) for r in rows} == {(0, 200), (1, 404)} and len({r.url for r in rows}) == len(rows)


def test_works_without_the_optional_files(tmp_path):
    for name in ("webloom", "__spark_entry__.py", "corpus_pipeline.py"):
        copy = shutil.copytree if (ROOT / name).is_dir() else shutil.copy
        copy(ROOT / name, tmp_path / name)
    shutil.rmtree(tmp_path / "webloom/llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') for n in q) and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})


def test_works_without_a_package_that_the_operators_need(tmp_path):
    (tmp_path / "ahocorasick.py").write_text("raise ImportError('not installed')")
    code = "import warnings; warnings.simplefilter('ignore'); import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and not any(n.startswith('op') for n in q) and 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": f"{tmp_path}:{ROOT}"})
