"""Fetching over HTTP on the executors; off unless asked for, as an archive is the usual source."""

from __future__ import annotations

import random
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions.urls import host
from webloom.operators.frontier import host_delay
from webloom.plans.settings import Settings
from webloom.sources.archive import text_of

RESPONSE = ("status int", "headers array<struct<k:string,v:string>>", "encoding string", "body binary", "error string", "tries int")


def request_once(url: str, method: str, headers: dict[str, str], data: bytes | None, timeout: float, most: int) -> dict:
    """One request; an HTTP error is a response, anything else that fails is an error without status. At most `most` bytes are read; more is an error."""
    try:
        made = urllib.request.Request(url, data=data, headers=headers, method=method)
        try:
            with urllib.request.urlopen(made, timeout=timeout) as got:  # noqa: S310
                return _response(got, most)
        except urllib.error.HTTPError as got:
            with got:
                return _response(got, most)
    except Exception as e:  # noqa: BLE001  whatever a server or a url does, the other rows go on
        return {"status": None, "headers": [], "encoding": None, "body": None, "error": f"{type(e).__name__}: {e}"}


def _response(got, most: int) -> dict:
    body = got.read(most + 1)
    over = len(body) > most
    return {"status": got.status, "headers": [{"k": k.lower(), "v": v} for k, v in got.headers.items()], "encoding": got.headers.get_content_charset(), "body": None if over else body, "error": "body is too large" if over else None}


def _accepted(status: int | None, lists: list[list[int] | None]) -> bool:
    """200, or what one of the lists allows; an empty list allows all."""
    return status is not None and (status == 200 or any(x is not None and (not x or status in x) for x in lists))


def _fetcher(columns: list[str], headers: dict[str, str], allowed: list[int] | None, tries: int, timeout: float, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: dict[str, float] = {}
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                host, own = r["_host"], {**headers, **dict(r.get("headers") or [])}
                for attempt in range(1, tries + 1):
                    wait = ready.get(host, 0) - time.monotonic()
                    if wait > 0:
                        time.sleep(wait)
                    got = request_once(r["url"], r.get("method") or "GET", own, r.get("data"), timeout, most)
                    ready[host] = time.monotonic() + r["_delay"] * random.uniform(0.8, 1.2)
                    if _accepted(got["status"], [allowed, r.get("status_allowed")]):
                        break
                r |= {f"_{k}": v for k, v in got.items()} | {"_tries": attempt}
            kinds = {"status": pa.int32(), "headers": pa.list_(pa.struct([("k", pa.string()), ("v", pa.string())])), "encoding": pa.string(), "body": pa.binary(), "error": pa.string(), "tries": pa.int32()}
            kept = [batch.column(batch.schema.get_field_index(c)) for c in columns]
            made = [pa.array([r[f"_{k}"] for r in rows], kind) for k, kind in kinds.items()]
            yield pa.RecordBatch.from_arrays([*kept, *made], [*columns, *(f"response_{k}" for k in kinds)])

    return run


def fetch_live(requests: DataFrame, parallel: int, headers: dict[str, str] | None = None, delay: float | Column = 0.0, allowed: list[int] | None = None, tries: int = 1, timeout: float = 30.0, max_bytes: int = 64 << 20) -> DataFrame:
    """Requests with response_status, _headers, _encoding, _body, _error and _tries.

    A host belongs to one task, so its requests follow each other by the delay, give or take a fifth; `parallel` tasks
    run side by side.  A status that neither `allowed` nor the request's status_allowed accepts is tried again, `tries`
    times in all.  requests: url, and where present method, headers (map), data and status_allowed.
    """
    columns = requests.columns
    wait = F.lit(float(delay)) if isinstance(delay, int | float) else delay.cast("double")
    rows = requests.withColumn("_host", F.coalesce(host("url"), F.lit(""))).withColumn("_delay", F.coalesce(wait, F.lit(0.0))).repartition(parallel, "_host")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema), *(f"response_{c}" for c in RESPONSE)])
    return rows.mapInArrow(_fetcher(columns, headers or {}, allowed, tries, timeout, max_bytes), schema)


def fetcher(parallel: int, settings: Settings) -> Callable[[DataFrame], DataFrame]:
    """For a crawl: requests to responses with status, html and tries, by the delays, tries and headers of the settings."""

    def run(batch: DataFrame) -> DataFrame:
        hosted = batch.withColumn("_at", F.coalesce(host("url"), F.lit("")))
        delay = host_delay("_at", settings.download_delay_special_host, settings.download_delay)
        got = fetch_live(hosted, parallel, settings.request_config.get("headers"), delay, settings.status_allowed, settings.max_tries + 1, settings.request_config.get("timeout", 30.0))
        return got.select(*batch.columns, F.col("response_status").alias("status"), text_of("response_body", "response_encoding").alias("html"), F.col("response_tries").alias("tries"))

    return run
