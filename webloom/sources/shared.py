"""Tables in a folder that all executors share."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a new local folder where it is unset, as in tests."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    checkpoint = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not checkpoint.isDefined():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="webloom-"))
        checkpoint = spark.sparkContext._jsc.sc().getCheckpointDir()
    return checkpoint.get().rstrip("/")


def file_system(spark: SparkSession, path: str):
    """(Hadoop's file system of a path, the path as it wants it)."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def exists(spark: SparkSession, path: str) -> bool:
    system, hadoop = file_system(spark, path)
    return system.exists(hadoop)


def rename(spark: SparkSession, old: str, new: str) -> None:
    system, hadoop = file_system(spark, old)
    if not system.rename(hadoop, file_system(spark, new)[1]):
        raise OSError(f"{old} could not be renamed to {new}")


def delete(spark: SparkSession, path: str) -> None:
    system, hadoop = file_system(spark, path)
    system.delete(hadoop, True)


def append(df: DataFrame, path: str, mode: str = "errorifexists") -> DataFrame:
    """Write, and read again: lineage is cut."""
    df.write.mode(mode).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_if_there(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame | None:
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else None


class Steps:
    """Steps of a run in a folder.

    The tables of a step are written to a folder of their own; they count once a marker, written last and moved
    into place, names them.  What a step that was stopped has left is not looked at again.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.notes: list[dict] = []
        while exists(spark, self._marker(len(self.notes))):
            text = spark.read.text(self._marker(len(self.notes)), wholetext=True).first()[0]
            self.notes.append(json.loads(text))

    def _marker(self, step: int) -> str:
        return f"{self.folder}/commits/{step:06d}.json"

    def begin(self) -> str:
        """Where the tables of the next step go."""
        return f"{self.folder}/steps/{len(self.notes):06d}-{uuid.uuid4().hex}"

    def commit(self, path: str, tables: list[str], **note) -> None:
        marker = self._marker(len(self.notes))
        system, hadoop = file_system(self.spark, f"{marker}.{uuid.uuid4().hex}")
        out = system.create(hadoop)
        note |= {"path": path, "tables": tables}
        out.write(bytearray(json.dumps(note).encode()))
        out.close()
        if exists(self.spark, marker):
            raise RuntimeError(f"another run is writing to {self.folder}")
        rename(self.spark, hadoop.toString(), marker)
        self.notes.append(note)

    def read(self, name: str, schema: str | T.StructType, last: int | None = None) -> DataFrame:
        """A table of all steps (of the last ones) in one scan."""
        notes = self.notes if last is None else self.notes[-last:]
        paths = [f"{n['path']}/{name}" for n in notes if name in n["tables"]]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
