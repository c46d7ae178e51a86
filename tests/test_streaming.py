import time

import pytest
from pyspark.sql import functions as F

from webloom.sources import archive
from webloom.streaming import frontier_stream as fs


@pytest.fixture
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(key)


def write(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))


def run(df, tmp_path, name, mode="append"):
    df.writeStream.format("parquet").option("path", f"{tmp_path}/{name}").option("checkpointLocation", f"{tmp_path}/{name}-state").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{tmp_path}/{name}")


TASKS = "fingerprint string, dont_filter boolean, ts timestamp"


def test_dedupe_over_batches(spark, tmp_path):
    write(spark, [("a", False, None), ("a", False, None), ("b", True, None)], TASKS, tmp_path / "in")
    stream = spark.readStream.schema(TASKS).parquet(str(tmp_path / "in"))
    assert sorted(r[0] for r in run(fs.produce(stream), tmp_path, "out").collect()) == ["a", "b"]
    write(spark, [("a", False, None), ("b", True, None), ("b", False, None), ("c", None, None)], TASKS, tmp_path / "in")
    assert sorted(r[0] for r in run(fs.produce(stream), tmp_path, "out").collect()) == ["a", "b", "b", "b", "c"]


def test_dedupe_with_a_horizon(spark, tmp_path):
    at = lambda s: F.lit(s).cast("timestamp")
    df = spark.range(1)
    rows = df.select(F.lit("a").alias("fingerprint"), F.lit(False).alias("dont_filter"), at("2024-01-01 00:00:00").alias("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(TASKS).parquet(str(tmp_path / "in"))
    got = run(fs.dedupe(stream, event_time="ts", horizon="1 hour"), tmp_path, "out")
    assert got.count() == 1


def test_rates(spark, tmp_path):
    rows = [("a", 1, f"2024-01-01 00:0{i}:10") for i in range(4)] + [("a", 0, "2024-01-01 00:00:20"), ("a", -1, "2024-01-01 00:00:20")]
    spark.createDataFrame(rows, "family string, flag int, ts string").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("family string, flag int, ts timestamp").parquet(str(tmp_path / "in"))
    got = run(fs.rates(stream), tmp_path, "out").orderBy("window_start").collect()
    assert [(r.n_success, r.n_fail) for r in got[:2]] == [(1, 1), (1, 0)]


def test_debounce_like_its_batch(spark, tmp_path, rocksdb):
    rows = [("t", float(s), ok) for s, ok in ((0, False), (1, True), (3, True), (10, True), (12, False), (30, False), (31, True))] + [("u", 5.0, True)]
    write(spark, rows, "token string, ts double, ok boolean", tmp_path / "in")
    want = [("t", 0.0, False), ("t", 1.0, True), ("t", 12.0, False), ("t", 30.0, False), ("t", 31.0, True), ("u", 5.0, True)]
    batch = fs.debounce_batch(spark.read.parquet(str(tmp_path / "in")), 10.0)
    assert sorted(map(tuple, batch.collect())) == want
    stream = spark.readStream.schema("token string, ts double, ok boolean").parquet(str(tmp_path / "in"))
    assert sorted(map(tuple, run(fs.debounce(stream, 10.0), tmp_path, "out").collect())) == want


def test_gate_holds_tasks(spark, tmp_path, rocksdb):
    now = time.time()
    write(spark, [("h", now - 5, "due"), ("h", now + 3, "soon"), ("g", now + 9999, "late")], "host string, exetime double, task string", tmp_path / "in")
    stream = spark.readStream.schema("host string, exetime double, task string").parquet(str(tmp_path / "in"))
    q = fs.gate(stream).writeStream.format("memory").queryName("gated").trigger(processingTime="1 second").option("checkpointLocation", f"{tmp_path}/state").start()
    try:
        until = time.time() + 60
        while time.time() < until and spark.table("gated").count() < 2:
            time.sleep(0.5)
        assert sorted(r.task for r in spark.table("gated").collect()) == ["due", "soon"]
    finally:
        q.stop()


def test_recrawls_feed_the_gate(spark, tmp_path):
    write(spark, [("h", 10.0, 5, "t"), ("h", 10.0, None, "u")], "host string, last_crawl_time double, recrawl int, task string", tmp_path / "in")
    stream = spark.readStream.schema("host string, last_crawl_time double, recrawl int, task string").parquet(str(tmp_path / "in"))
    assert [tuple(r) for r in run(fs.recrawls(stream), tmp_path, "out").collect()] == [("h", 15.0, "t")]


def test_seed_stream(spark, tmp_path):
    archive.push_seeds(spark, ["http://a/", "http://a/", " http://b/ ", ""], f"{tmp_path}/seeds")
    assert sorted(r.url for r in run(archive.seed_stream(spark, f"{tmp_path}/seeds"), tmp_path, "out").collect()) == ["http://a/", "http://b/"]
