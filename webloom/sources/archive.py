"""Where pages and seeds come from: an archive in place of a network."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions.urls import canonical_url, decode_leniently
from webloom.sources.shared import append, exists, shared_dir


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """pages(page_id, url, html) from Parquet."""
    return spark.read.parquet(path)


def fetch(requests: DataFrame, archive: DataFrame, url: str = "url", html: str = "html", status: Column | None = None) -> DataFrame:
    """Requests with status and html: a lookup by canonical url; 404 and null where the archive has no such page.

    Of several pages with one canonical url that with the largest page_id counts, or any where there is no page_id.  archive may
    have a `status` column (200 otherwise).
    """
    columns = archive.columns
    rows = requests.withColumn("_canonical", canonical_url(url))
    slim = archive.select(canonical_url(url).alias("_canonical"), (F.col("page_id") if "page_id" in columns else F.lit(0)).cast("long").alias("_id"))
    pages = archive.select(*(c.alias(n) for n, c in {"_canonical": canonical_url(url), "_id": F.col("page_id").cast("long") if "page_id" in columns else F.lit(0).cast("long"), "_html": F.col(html), "_status": F.col("status").cast("int") if "status" in columns else F.lit(200)}.items()))
    # the page that counts is found among those asked for, by urls and ids alone. That table is written, so its size is
    # known: under the broadcast threshold no html moves before the join, beyond it the batch is in proportion to the archive
    latest = slim.join(rows.select("_canonical").distinct(), "_canonical", "left_semi").groupBy("_canonical").agg(F.max(F.coalesce("_id", F.lit(-(2**63)))).alias("_id"))
    latest = append(latest, f"{shared_dir(requests.sparkSession)}/webloom-fetch-{uuid.uuid4().hex}")
    mine = pages.withColumn("_id", F.coalesce("_id", F.lit(-(2**63)))).join(latest, ["_canonical", "_id"], "left_semi").dropDuplicates(["_canonical"])
    out = rows.join(mine, "_canonical", "left").drop("_canonical", "_id")
    found = F.coalesce(F.col("_status"), F.lit(404)) if status is None else status
    return out.withColumns({"status": found, "html": F.col("_html")}).drop("_status", "_html")


def send(spark: SparkSession, url: str, archive: DataFrame) -> DataFrame:
    """One request on its own: a row, with empty meta. The filter reaches the archive's scan as an expression, so only one page is shuffled."""
    one = spark.createDataFrame([(url,)], "url string")
    return fetch(one, archive.where(canonical_url("url") == canonical_url(F.lit(url)))).withColumn("meta", F.create_map().cast("map<string,string>"))


def text_of(body: str, encoding: str = "encoding") -> Column:
    """Text of a body: the JVM's decoder where it is valid UTF-8, the lenient one otherwise."""
    utf8 = F.lower(F.coalesce(F.col(encoding), F.lit("utf-8"))).isin("utf-8", "utf8")
    fine = utf8 & F.is_valid_utf8(F.col(body).cast("string"))
    return F.when(fine, F.col(body).cast("string")).otherwise(decode_leniently(F.when(~fine, F.col(body)), F.col(encoding)))


def json_of(body: Column | str) -> Column:
    """Parsed JSON as a variant; an error where it isn't JSON."""
    c = F.col(body) if isinstance(body, str) else body
    return F.parse_json(c.cast("string"))


def seed_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Urls from text files as they arrive, a line each."""
    return spark.readStream.format("text").load(folder).select(F.trim("value").alias("url")).where("url <> ''")


def fresh_seeds(spark: SparkSession, folder: str, state: str) -> DataFrame:
    """All urls that have come so far; a call reads only the files that are new since the last with this state folder.

    A crawl's dedupe leaves out those it has had.
    """
    path = f"{state}/urls"
    query = seed_stream(spark, folder).select(F.col("url").alias("value")).writeStream.format("text").option("path", path)
    query.option("checkpointLocation", f"{state}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.text(path).select(F.col("value").alias("url")).distinct() if exists(spark, path) else spark.createDataFrame([], "url string")


def push_seeds(spark: SparkSession, urls: list[str], folder: str) -> None:
    """Add urls to the folder of a seed stream; a url counts once in a call."""
    spark.createDataFrame([(u,) for u in urls], "value string").distinct().write.mode("append").text(folder)


def file_name(url: Column | str, fname: Column | str | None = None) -> Column:
    """Name of a downloaded file: the last part of the path; fname replaces the stem and keeps the extension."""
    u = F.col(url) if isinstance(url, str) else url
    base = F.element_at(F.split(F.substring_index(u, "?", 1), "/"), -1)
    if fname is None:
        return base
    name = F.col(fname) if isinstance(fname, str) else fname
    extension = F.regexp_extract(base, r"(\.[^.]*)$", 1)
    return F.when(name.isNull(), base).otherwise(F.concat(name, extension))


def not_there_yet(requests: DataFrame, folder: str, name: str = "file_name") -> DataFrame:
    """Requests whose file isn't in the folder; contents aren't read."""
    spark = requests.sparkSession
    if not exists(spark, folder):
        return requests
    there = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias(name))
    return requests.join(there, name, "left_anti").select(*requests.columns)
