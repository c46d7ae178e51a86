"""The frontier as a stream: dedupe, tasks that wait for their time, recrawls, debouncing, rates."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from webloom.operators.control import FAILURE, SUCCESS


def dedupe(stream: DataFrame, fingerprint: str = "fingerprint", event_time: str | None = None, horizon: str | None = None) -> DataFrame:
    """The first task of each fingerprint. Without a horizon all fingerprints are remembered for ever, in the state store.

    With a horizon a fingerprint is forgotten that long after the watermark has passed it, so state is bounded.
    """
    if event_time and horizon:
        return stream.withWatermark(event_time, horizon).dropDuplicatesWithinWatermark([fingerprint])
    return stream.dropDuplicates([fingerprint])


def produce(stream: DataFrame, **options: str) -> DataFrame:
    """Dedupe for tasks that don't bypass it; the others pass and aren't remembered."""
    bypass = F.coalesce(F.col("dont_filter"), F.lit(False))
    return dedupe(stream.where(~bypass), **options).unionByName(stream.where(bypass))


def rates(stream: DataFrame, ts: str = "ts", every: str = "60 seconds", late: str = "60 seconds", family: str = "family", flag: str = "flag") -> DataFrame:
    """(family, window_start, n_success, n_fail) of each period, once the watermark has passed it."""
    parts = stream.withWatermark(ts, late).groupBy(family, F.window(ts, every).alias("w")).agg(F.count_if(F.col(flag) == SUCCESS).alias("n_success"), F.count_if(F.col(flag) == FAILURE).alias("n_fail"))
    return parts.select(family, F.col("w.start").alias("window_start"), "n_success", "n_fail")


class Gate(StatefulProcessor):
    """Holds tasks until their time; a timer for each distinct time, keyed by host so that state is spread."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "due_ms long", "tasks array<string>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentProcessingTimeInMs()
        for part in rows:
            due = (part["exetime"].fillna(0) * 1000).astype("int64")  # a task without a time is due
            ready = part[due <= now]
            if len(ready):
                yield pd.DataFrame({"host": key[0], "task": ready["task"]})
            later = due > now
            for at, tasks in part[later].groupby(due[later])["task"]:
                known = list(self.held.getValue((int(at),))[0]) if self.held.containsKey((int(at),)) else []
                self.held.updateValue((int(at),), (known + tasks.tolist(),))
                self.handle.registerTimer(int(at))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at = (expiredTimerInfo.getExpiryTimeInMs(),)
        if self.held.containsKey(at):  # only what falls due at this time is read
            tasks = list(self.held.getValue(at)[0])
            self.held.removeKey(at)
            yield pd.DataFrame({"host": key[0], "task": tasks})

    def close(self) -> None:
        pass


def gate(stream: DataFrame) -> DataFrame:
    """(host, task) of tasks as they fall due. stream: host, exetime (epoch seconds), task (a text). Needs the RocksDB state store."""
    return stream.select("host", "exetime", "task").groupBy("host").transformWithStateInPandas(statefulProcessor=Gate(), outputStructType="host string, task string", outputMode="Append", timeMode="ProcessingTime")


def recrawls(finished: DataFrame) -> DataFrame:
    """Stream of finished tasks to the tasks that are due again later; feed it to the gate."""
    again = finished.where(F.coalesce("recrawl", F.lit(0)) > 0)
    return again.select("host", (F.col("last_crawl_time") + F.col("recrawl")).alias("exetime"), "task")


class Debounce(StatefulProcessor):
    """Passes a signal if the last one that was handled with success is at least ttl seconds older; a failure doesn't count as handled."""

    def __init__(self, ttl: float) -> None:
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "ts double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for part in rows:
            passed = []
            last = self.last.get()[0] if self.last.exists() else None
            for ts, ok in part.sort_values("ts")[["ts", "ok"]].itertuples(index=False):
                if last is None or ts - last >= self.ttl:
                    passed.append((key[0], ts, bool(ok)))
                    last = ts if ok else last
            if last is not None:
                self.last.update((last,))
            if passed:
                yield pd.DataFrame(passed, columns=["token", "ts", "ok"])

    def close(self) -> None:
        pass


def debounce(stream: DataFrame, ttl: float) -> DataFrame:
    """(token, ts, ok) of the signals that are handled. stream: token, ts (seconds), ok (whether handling would succeed)."""
    return stream.select("token", "ts", "ok").groupBy("token").transformWithStateInPandas(statefulProcessor=Debounce(ttl), outputStructType="token string, ts double, ok boolean", outputMode="Append", timeMode="None")


def _debounced(ttl: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, last = object(), None
        for batch in batches:
            passed = []
            for row, (own, ts, ok) in enumerate(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                if own != token:
                    token, last = own, None
                if last is None or ts - last >= ttl:
                    passed.append(row)
                    last = ts if ok else last
            yield batch.take(pa.array(passed, pa.int64()))

    return run


def debounce_batch(signals: DataFrame, ttl: float) -> DataFrame:
    """The same over a table: a fold over the sorted signals of each token, which holds one number at a time."""
    rows = signals.select("token", F.col("ts").cast("double").alias("ts"), F.coalesce("ok", F.lit(False)).alias("ok")).repartition("token").sortWithinPartitions("token", "ts", "ok")
    return rows.mapInArrow(_debounced(ttl), rows.schema)
