"""Helpers that the pipeline operators share."""

from __future__ import annotations

import atexit
import gc
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A null document id counts as the largest id; digests keep it apart from a real one.
NULL_ID = 2**63 - 1


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir, or one of our own where it is unset (tests)."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        checkpoint = spark.sparkContext._jsc.sc().getCheckpointDir()
        if checkpoint.isDefined():
            return checkpoint.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        conf = "file://" + tempfile.mkdtemp(prefix="webloom-")
        spark.sparkContext.setCheckpointDir(conf)
    return conf.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # noqa: BLE001  the session has already gone
        pass


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/webloom-{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def spool(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: lineage is cut, and the planner knows its size.

    So a join with it is a broadcast only if it is under spark.sql.autoBroadcastJoinThreshold.  Where
    a table grows with the rows it is joined to, a merge hint has the join done alike at every size.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._spooled = path
    return out


def _drop(spark: SparkSession, name: str) -> None:
    try:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    except Exception:  # noqa: BLE001  the session has already gone
        pass


def spool_by(df: DataFrame, name: str, column: str, buckets: int) -> DataFrame:
    """As spool, in files by hash of a column: joins and groups by it with as many partitions need not move the rows again."""
    table = f"webloom_{name}_{uuid.uuid4().hex}"
    path = shared_path(df.sparkSession, name)
    df.write.bucketBy(buckets, column).option("path", path).format("parquet").saveAsTable(table)
    atexit.register(_drop, df.sparkSession, table)
    out = df.sparkSession.table(table)
    out._spooled = path
    return out


def discard(*spooled: DataFrame) -> None:
    """Delete what spool or spool_by wrote, once nothing reads it any more."""
    for df in spooled:
        _delete(df.sparkSession, df._spooled)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more.

    Spark's cleaner waits for the driver's garbage collection.  The first one frees what Python has let
    go of, the second what that held.
    """
    for _ in range(2):
        gc.collect()
        time.sleep(0.3)
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def utf8(text: str | Column) -> Column:
    """UTF-8 bytes of a text column; null is empty. Python then gets bytes and decodes nothing it need not."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("binary")


def unique_ids(docs: DataFrame, doc_id: str) -> bool:
    """Whether no id but null stands in two rows."""
    ids = docs.select(F.col(doc_id).cast("long").alias("id")).where(F.col("id").isNotNull())
    return ids.groupBy("id").count().where(F.col("count") > 1).isEmpty()


def row_keys(doc_id: str = "doc_id", text: str = "text", unique: bool = False) -> tuple[Column, Column]:
    """(id, digest): rows that share both hold the same id and text, and so the same result.

    The digest is 128 bits of the SHA-256 of the text, others for null ids than for real ones; a null text is empty.
    unique: real ids are known to be in one row each, so they need none; theirs is zero, and takes no room in packets.
    """
    number = F.col(doc_id).cast("long")
    whole = F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    digest = F.substring(whole, F.when(number.isNull(), 17).otherwise(1), F.lit(16))
    if unique:
        digest = F.when(number.isNull(), digest).otherwise(F.lit(bytes(16)))
    return F.coalesce(number, F.lit(NULL_ID)), digest
