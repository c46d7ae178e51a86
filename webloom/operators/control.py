"""Status checks, and what becomes of a task after an attempt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Executions counted before a task is given up: retries go on while tries <= MAX_TRIES, so there are MAX_TRIES + 1.
MAX_TRIES = 3

SUCCESS, FAILURE, RETRY, RESCHEDULE = 1, 0, -1, -2


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def response_ok(status: Column | str, request_allowed: Column | str) -> Column:
    """Callbacks run for status 200, and for what the request allows; an empty array allows all, null nothing more."""
    s, allowed = _col(status), _col(request_allowed)
    more = allowed.isNotNull() & ((F.size(allowed) == 0) | F.array_contains(allowed, s))
    return F.coalesce((s == 200) | more, F.lit(False))


def status_accepted(status: Column | str, crawler_allowed: Column | str, request_allowed: Column | str) -> Column:
    """No retry is due: what response_ok accepts, and what the crawler allows in the same way."""
    return response_ok(status, request_allowed) | response_ok(status, crawler_allowed)


def outcome(signal: Column | str, tries: Column | str, ignore_exception: Column | str, max_tries: int = MAX_TRIES) -> Column:
    """Flag of an attempt: 1 success, 0 failure, -1 retry, -2 reschedule.

    signal: null or 'ok', 'skip' (a success), 'reschedule', 'drop' (an item dropped: a success), or anything else,
    an error.  An error is retried unless it is ignored or tries, counted from 1 in the first execution, is over max_tries.
    """
    s = F.coalesce(_col(signal), F.lit("ok"))
    again = ~F.coalesce(_col(ignore_exception), F.lit(False)) & (_col(tries) <= max_tries)
    return F.when(s.isin("ok", "skip", "drop"), SUCCESS).when(s == "reschedule", RESCHEDULE).when(again, RETRY).otherwise(FAILURE)


def after_attempt(tasks: DataFrame, now: float, max_tries: int = MAX_TRIES) -> DataFrame:
    """Add `flag`, and for tasks that run again their next state.

    tasks: signal, tries (before the attempt), ignore_exception, exetime, defer, recrawl.  Adds flag; tries after
    the attempt; next_exetime (null where the task is over): now for a retry, now + defer for a reschedule, and
    last_crawl_time + recrawl where a finished task is due again, with tries at 0.
    """
    tasks = tasks.withColumn("tries", F.col("tries") + 1)
    tasks = tasks.withColumn("flag", outcome("signal", "tries", "ignore_exception", max_tries))
    over = F.col("flag").isin(SUCCESS, FAILURE)
    again = over & (F.coalesce(F.col("recrawl"), F.lit(0)) > 0)
    when = F.when(F.col("flag") == RETRY, F.lit(float(now))).when(F.col("flag") == RESCHEDULE, F.lit(float(now)) + F.coalesce(F.col("defer"), F.lit(0))).when(again, F.lit(float(now)) + F.col("recrawl"))
    return tasks.withColumns({"next_exetime": when, "tries": F.when(again, 0).otherwise(F.col("tries"))})


def executions(outcomes: Column | str, ignore_exception: Column | str | None = None, max_tries: int = MAX_TRIES) -> Column:
    """How often a task runs, if its attempts end as the array of signals says (attempts beyond the array succeed)."""
    ignored = F.lit(False) if ignore_exception is None else F.coalesce(_col(ignore_exception), F.lit(False))
    limit = F.when(ignored, 1).otherwise(max_tries + 1)
    state = F.struct(F.lit(0).alias("runs"), F.lit(0).alias("tries"), F.lit(False).alias("over"))

    def step(a: Column, signal: Column) -> Column:
        tries = a["tries"] + 1
        good = signal.isin("ok", "skip", "drop")
        over = good | (~signal.isin("reschedule") & (tries >= limit))
        return F.when(a["over"], a).otherwise(F.struct((a["runs"] + 1).alias("runs"), tries.alias("tries"), over.alias("over")))

    end = F.aggregate(_col(outcomes), state, step)
    return F.when(end["over"], end["runs"]).otherwise(end["runs"] + 1)
