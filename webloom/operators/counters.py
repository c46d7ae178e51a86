"""Counters over a log of tasks: (family, ancestor, flag, ts), or events that add and finish tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def family_counts(log: DataFrame, family: str = "family", flag: str = "flag") -> DataFrame:
    """(family, n_fail, n_success); flags other than 0 and 1 don't count."""
    return log.groupBy(family).agg(F.count_if(F.col(flag) == 0).alias("n_fail"), F.count_if(F.col(flag) == 1).alias("n_success"))


def unfinished_delta(event: Column | str, flag: Column | str) -> Column:
    """1 where a task is added; -1 where one ends or is retried (it is added again); 0 where it is put off."""
    e, f = (F.col(c) if isinstance(c, str) else c for c in (event, flag))
    return F.when(e == "add", 1).when(f == -2, 0).otherwise(-1)


def ancestor_unfinished(events: DataFrame, ancestor: str = "ancestor") -> DataFrame:
    """(ancestor, unfinished) from events with a `delta`; a lineage is done at 0."""
    return events.groupBy(ancestor).agg(F.sum("delta").cast("long").alias("unfinished"))


def in_flight(events: DataFrame) -> DataFrame:
    """One row: tasks that have begun and not ended, from a `delta`."""
    return events.agg(F.coalesce(F.sum("delta"), F.lit(0)).cast("long").alias("in_flight"))


def rate_per_window(log: DataFrame, ts: str = "ts", every: str = "60 seconds", family: str = "family", flag: str = "flag", divisor: int = 30) -> DataFrame:
    """(family, window_start, n_success, n_fail, per_min): counts in each period, and the rate that the status line shows.

    per_min is int(successes / divisor) * 60; the divisor is 30 whatever the period.
    """
    parts = log.groupBy(family, F.window(ts, every).alias("w")).agg(F.count_if(F.col(flag) == 1).alias("n_success"), F.count_if(F.col(flag) == 0).alias("n_fail"))
    return parts.select(family, F.col("w.start").alias("window_start"), "n_success", "n_fail", (F.floor(F.col("n_success") / divisor) * 60).cast("long").alias("per_min"))


def running_counts(windows: DataFrame, family: str = "family") -> DataFrame:
    """Add totals so far to the periods of rate_per_window."""
    w = Window.partitionBy(family).orderBy("window_start").rowsBetween(Window.unboundedPreceding, 0)
    return windows.withColumns({"total_success": F.sum("n_success").over(w), "total_fail": F.sum("n_fail").over(w)})
