"""The frontier: tasks that wait, are deduplicated, ordered, gated and capped.

A frontier is a DataFrame with at least `fingerprint`, `priority`, `exetime` (epoch
seconds) and `seq` (order of arrival), and `dont_filter` where rows may bypass dedupe.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCORE_PER_PRIORITY = 1e10


def unseen(tasks: DataFrame, seen: DataFrame) -> DataFrame:
    """Tasks whose fingerprint isn't in `seen` (column fingerprint)."""
    return tasks.join(seen.select("fingerprint"), "fingerprint", "left_anti").select(*tasks.columns)


def first_of_each(tasks: DataFrame, *order: str) -> DataFrame:
    """One task for each fingerprint, the first by `order`: an aggregate, so that copies are combined before the shuffle."""
    rest = [c for c in tasks.columns if c != "fingerprint"]
    least = tasks.groupBy("fingerprint").agg(F.min_by(F.struct(*rest), F.struct(*(order or ("seq",)))).alias("_row"))
    return least.select(*(F.col("fingerprint") if c == "fingerprint" else F.col(f"_row.{c}").alias(c) for c in tasks.columns))


def produce(tasks: DataFrame, seen: DataFrame | None = None, *order: str) -> tuple[DataFrame, DataFrame]:
    """(accepted tasks, fingerprints newly seen).

    A task is accepted if it bypasses dedupe (dont_filter), or if its fingerprint is neither in `seen` nor
    that of an earlier task that doesn't bypass.  Tasks that bypass are not recorded as seen.  Null flags are false.
    """
    bypass = F.coalesce(F.col("dont_filter"), F.lit(False))
    filtered = tasks.where(~bypass)
    if seen is not None:
        filtered = unseen(filtered, seen)
    new = first_of_each(filtered, *order)
    return new.unionByName(tasks.where(bypass)), new.select("fingerprint")


def submitted(tasks: DataFrame, seen: DataFrame | None = None, *order: str) -> DataFrame:
    """All tasks with where each goes and whether it was taken: `queue` (request for tasks of that family, normal for others) and `accepted`.

    Requests go through the dedupe; other tasks are always taken.
    """
    rows = tasks.withColumns({"queue": F.when(F.array_contains("families", "Request"), "request").otherwise("normal"), "_own": F.monotonically_increasing_id()})
    is_request = F.col("queue") == "request"
    least = F.struct(*(order or ("seq",)), "_own")
    filtered = is_request & ~F.coalesce(F.col("dont_filter"), F.lit(False))
    first = rows.where(filtered).groupBy("fingerprint").agg(F.min(least).alias("_first"))
    if seen is not None:
        first = unseen(first, seen)
    rows = rows.join(first, "fingerprint", "left")
    return rows.withColumn("accepted", ~filtered | F.coalesce(least == F.col("_first"), F.lit(False))).drop("_own", "_first").select(*tasks.columns, "queue", "accepted")


def score(priority: Column | str = "priority", exetime: Column | str = "exetime") -> Column:
    """Larger comes first: priority above all, then the earlier time."""
    p, t = (F.col(c) if isinstance(c, str) else c for c in (priority, exetime))
    return p * F.lit(SCORE_PER_PRIORITY) - t


def pop_order() -> list[Column]:
    """Priority, then time, then arrival; a total order."""
    return [F.col("priority").desc(), F.col("exetime").asc(), F.col("seq").asc()]


def ordered(tasks: DataFrame) -> DataFrame:
    return tasks.orderBy(*pop_order())


def pop(tasks: DataFrame, now: float | Column, n: int) -> DataFrame:
    """The n tasks that are due and come first: a top-n, not a sort of the whole frontier."""
    return due(tasks, now).orderBy(*pop_order()).limit(n)


def due(tasks: DataFrame, now: float | Column) -> DataFrame:
    """Tasks whose time has come."""
    return tasks.where(F.col("exetime") <= (F.lit(now) if isinstance(now, int | float) else now))


def waiting(tasks: DataFrame, now: float | Column) -> DataFrame:
    return tasks.where(F.col("exetime") > (F.lit(now) if isinstance(now, int | float) else now))


def lengths(tasks: DataFrame, now: float | Column) -> DataFrame:
    """One row: n_ready, n_waiting, n_total."""
    ready = F.col("exetime") <= (F.lit(now) if isinstance(now, int | float) else now)
    return tasks.agg(F.count_if(ready).alias("n_ready"), F.count_if(~ready).alias("n_waiting"), F.count("*").alias("n_total"))


def host_cap(tasks: DataFrame, limit: int | None, host: str = "host", special: dict[str, int] | None = None) -> DataFrame:
    """At most `limit` tasks of each host, the first in order; `special` limits count for hosts that contain the key.

    Several keys may be part of a host: the least of their limits holds, instead of the general one.  limit
    None: no general limit.  The rank is also compared with the largest limit, a constant, so that each task keeps
    that many tasks of a host at most before the shuffle: a host with a third of all tasks does no harm.
    """
    special = special or {}
    most = max([v for v in (limit, *special.values()) if v is not None], default=None)
    if most is None:
        return tasks
    ranked = tasks.withColumn("_cap", special_limit(host, special, limit))
    free = ranked.where(F.col("_cap").isNull()).drop("_cap") if limit is None else None
    ranked = ranked.where(F.col("_cap").isNotNull()) if limit is None else ranked
    ranked = ranked.withColumn("_n", F.row_number().over(Window.partitionBy(host).orderBy(*pop_order()))).where(F.col("_n") <= most)
    best = ranked.where(F.col("_n") <= F.col("_cap")).drop("_n", "_cap")
    return best if free is None else best.unionByName(free)


def special_limit(host: str, special: dict[str, int], otherwise: int | None) -> Column:
    """Least limit among the keys that a host contains, else the general one."""
    found = [F.when(F.contains(F.col(host), F.lit(k)), F.lit(v)) for k, v in special.items()]
    general = F.lit(otherwise).cast("int")
    if not found:
        return general
    return F.coalesce(F.least(*found) if len(found) > 1 else found[0], general)


def host_delay(host: str, special: dict[str, float], otherwise: float = 0.0) -> Column:
    """Seconds to wait before a fetch: the sum over the keys that a host contains, else the general delay."""
    if not special:
        return F.lit(float(otherwise))
    hits = [F.contains(F.col(host), F.lit(k)) for k in special]
    total = F.lit(0.0)
    anyone = F.lit(False)
    for hit, seconds in zip(hits, special.values(), strict=True):
        total = total + F.when(hit, float(seconds)).otherwise(0.0)
        anyone = anyone | F.coalesce(hit, F.lit(False))
    return F.when(anyone, total).otherwise(float(otherwise))


def jittered(delay: Column, seed: int | None = None) -> Column:
    """The delay times a factor from 0.8 to 1.2, to hundredths."""
    return F.round(delay * (F.lit(0.8) + F.lit(0.4) * F.rand(seed)), 2)


def spaced(tasks: DataFrame, delay: Column, host: str = "host", period: float = 3600.0) -> DataFrame:
    """Add `start`: when each task may run if those of its host follow each other by the delay.

    Places are counted within periods of time and priorities, and from the numbers of tasks in those before, so that the
    tasks of a busy host are sorted in many parts.
    """
    rows = tasks.withColumn("_part", F.floor(F.col("exetime") / period))
    before = Window.partitionBy(host).orderBy(F.col("priority").desc(), F.col("_part")).rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(host, "priority", "_part").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    sizes = sizes.select(F.col(host).alias("_host"), F.col("priority").alias("_priority"), F.col("_part").alias("_at"), "_before")
    rows = rows.join(sizes, F.col(host).eqNullSafe(F.col("_host")) & F.col("priority").eqNullSafe(F.col("_priority")) & F.col("_part").eqNullSafe(F.col("_at")))
    place = F.row_number().over(Window.partitionBy(host, "priority", "_part").orderBy(*pop_order())) - 1 + F.col("_before")
    return rows.withColumn("start", F.col("exetime") + place * delay).select(*tasks.columns, "start")


def recrawls(finished: DataFrame) -> DataFrame:
    """Tasks to run again: tries 0, time = last_crawl_time + recrawl, past the dedupe.

    finished: tasks that succeeded or failed for good; rows without recrawl seconds don't come back.
    """
    again = finished.where(F.coalesce(F.col("recrawl"), F.lit(0)) > 0)
    return again.withColumns({"tries": F.lit(0), "exetime": F.col("last_crawl_time") + F.col("recrawl"), "dont_filter": F.lit(True)})


def reschedule(tasks: DataFrame, now: float, defer: Column | float = 0.0, recrawl: Column | None = None) -> DataFrame:
    """Tasks put off: they run `defer` seconds from now, past the dedupe, with a new recrawl where one is given."""
    defer = F.lit(float(defer)) if isinstance(defer, int | float) else defer
    out = tasks.withColumns({"exetime": F.lit(float(now)) + defer, "dont_filter": F.lit(True)})
    return out if recrawl is None else out.withColumn("recrawl", F.coalesce(recrawl, F.col("recrawl")))


def put_back(cancelled: DataFrame) -> DataFrame:
    """Tasks that were cancelled while they ran: the attempt doesn't count, and they pass the dedupe."""
    return cancelled.withColumns({"tries": F.col("tries") - 1, "dont_filter": F.lit(True)})
