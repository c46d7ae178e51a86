"""Where items go: tables, JSON lines, files, and upserts that merge fields."""

from __future__ import annotations

import logging
import os
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.sources.shared import append, delete, exists, rename

log = logging.getLogger("webloom.items")


def to_json_lines(items: DataFrame, path: str, column: str = "json") -> None:
    """One JSON text in a line."""
    items.select(F.col(column).alias("value")).write.mode("append").text(path)


def insert(items: DataFrame, path: str) -> None:
    """A row for each item, duplicates too."""
    items.write.mode("append").parquet(path)


def merged(items: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key: of each field the last value that isn't null.

    An aggregate, so rows of a hot key are combined before they are shuffled.  Rows with a null key are one key.
    """
    fields = [c for c in items.columns if c not in (key, order)]
    last = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in fields]
    return items.groupBy(key).agg(F.max(order).alias(order), *last).select(*items.columns)


def upsert(items: DataFrame, path: str, key: str, order: str) -> None:
    """Merge items into a table: new keys are added, fields that new items have replace old ones, others stay.

    Columns that only the table or only the items have stay too.  The new table is written beside the old one, which is
    moved away before the new one takes its place and is deleted last: a call that was stopped leaves a whole table, and
    the next call puts it in its place.
    """
    spark, new, old = items.sparkSession, f"{path}.new", f"{path}.old"
    recover(spark, path)
    both = items
    if exists(spark, path):
        both = spark.read.parquet(path).unionByName(items, allowMissingColumns=True)
    append(merged(both, key, order), new, "overwrite")
    if exists(spark, path):
        rename(spark, path, old)
    rename(spark, new, path)
    delete(spark, old)


def recover(spark: SparkSession, path: str) -> None:
    """Finish an upsert that was stopped while it changed tables. `.old` is there only after `.new` is whole."""
    if not exists(spark, f"{path}.old"):
        return
    if not exists(spark, path):
        rename(spark, f"{path}.new", path)
    delete(spark, f"{path}.old")


def upserting(path: str, key: str, order: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch. A batch that comes twice changes nothing the second time."""
    return lambda batch, _: upsert(batch, path, key, order)


def collect_families(items: DataFrame, folder: str) -> None:
    """A table for each family, as partitions of one."""
    items.write.mode("append").partitionBy("family").parquet(folder)


def log_items(items: DataFrame, most: int = 20) -> None:
    """Log a few items; a look, not a sink."""
    for row in items.limit(most).toLocalIterator():
        log.info("%s", row.asDict(True))


def save_files(responses: DataFrame, name: str = "where", body: str = "body", status: str = "status") -> int:
    """Write the bodies of responses with status 200 to the paths they name, on the executors; how many.

    Paths must be where all executors can write: local or mounted ones, or URIs of a file system that Arrow knows; any
    other is an error.  A file is written beside its place and then moved there.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(*batch.columns, strict=True):
                _save(path.as_py(), content.as_py())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    good = responses.where((F.col(status) == 200) & F.col(name).isNotNull() & F.col(body).isNotNull()).select(name, F.col(body).cast("binary"))
    return good.mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def _save(path: str, content: bytes) -> None:
    parts = urlparse(path)
    part = f".{uuid.uuid4().hex}.part"
    if parts.scheme in ("", "file"):
        target = unquote(parts.path) if parts.scheme else path
        os.makedirs(os.path.dirname(target), exist_ok=True)
        with open(target + part, "wb") as f:
            f.write(content)
        os.replace(target + part, target)
        return
    system, target = fs.FileSystem.from_uri(path)
    system.create_dir(os.path.dirname(target), recursive=True)
    with system.open_output_stream(target + part) as f:
        f.write(content)
    system.move(target + part, target)
