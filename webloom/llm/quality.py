"""Quality rules with robust multivariate outliers (operator 5).

Counts of each text give a base verdict and a vector of transformed statistics.
For each language and source, means and covariances are estimated by concentration
steps over all rows: distances, the three quarters of rows that are nearest, their
means and covariances, again until no determinant moves.  Of three starts the one
that ends with the least determinant counts.  Texts far from the estimate go.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import row_keys, spool, utf8

#: Mean word length, symbols, distinct words, capitals, punctuation; and the least deviation that each counts as.
FEATURES = ("f_length", "f_symbols", "f_distinct", "f_capitals", "f_punctuation")
FLOORS = (0.02, 0.03, 0.05, 0.02, 0.02)
#: Median of the chi-square distribution with five degrees of freedom.
MEDIAN = 4.3515
#: Share of rows that an estimate rests on, most steps, the change of a determinant's logarithm that counts as none, rows a
#: group needs (else it joins the rest of its language, then of all), and the distance from which on texts go. That is far
#: beyond any quantile of the chi-square distribution, as statistics of clean texts have heavier tails than a normal one.
SHARE, STEPS, STILL, LEAST_ROWS, CUT = 0.75, 8, 0.01, 40, 13.0
#: Distances of short texts shrink by words / (words + SHORT).
SHORT = 20
#: Distances are counted in bins, so many to a factor of e.
_BINS = 64.0

_SPACE = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"
_CAPITALS = bytes(range(65, 91))
_PUNCTUATION = b".,!?;:"


def repeated_words(ids: np.ndarray, distinct: int) -> int:
    """Words in five-word windows that stand twice or more; window codes are exact."""
    n = len(ids) - 4
    if n < 2:
        return 0
    if distinct <= 4096:
        code = ids[:n]
        for k in range(1, 5):
            code = (code << 12) | ids[k : n + k]
    else:
        _, pair = np.unique(ids[:-1] * distinct + ids[1:], return_inverse=True)
        size = int(pair.max()) + 1
        _, four = np.unique(pair[:-2] * size + pair[2:], return_inverse=True)
        code = four[:n] * distinct + ids[4:]
    order = np.argsort(code, kind="stable")
    same = code[order[1:]] == code[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(n + 5, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + 5, -1)
    return int((np.cumsum(edge) > 0).sum())


def counts(body: bytes) -> tuple[int, int, int, int, int, int, int, int]:
    """Words, their code points, symbols, repeated lines, repeated words, distinct words, capitals, punctuation."""
    words = body.split()
    n = len(words)
    letters = body.translate(None, _SPACE)
    chars = len(letters) if letters.isascii() else len(letters.decode("utf-8", "replace"))
    lines = [x for x in body.split(b"\n") if x.strip(_SPACE)]
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    less = lambda what: len(letters) - len(letters.translate(None, what))
    return n, chars, less(_SYMBOLS), len(lines) - len(set(lines)), repeated_words(ids, max(1, len(number))), len(number), less(_CAPITALS), less(_PUNCTUATION)


_STATS = "doc_id long, doc long, digest binary, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, " + ", ".join(f"{f} double" for f in FEATURES)


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([counts(x.as_py()) for x in batch.column(5)], np.int64).reshape(-1, 8)
        n, chars, symbols, _, _, distinct, capitals, punctuation = found.T
        words, letters = np.maximum(n, 1), np.maximum(chars, 1)
        features = (np.log(letters / words), np.sqrt(symbols / letters), np.log(np.maximum(distinct, 1) / words), np.sqrt(capitals / letters), np.sqrt(punctuation / letters))
        names = [x.strip().split()[0] for x in _STATS.split(",")]
        yield pa.RecordBatch.from_arrays([*batch.columns[:5], *(pa.array(found[:, i]) for i in range(5)), *(pa.array(x, pa.float64()) for x in features)], names)


_PAIRS = [(i, j) for i in range(len(FEATURES)) for j in range(i, len(FEATURES))]
_ESTIMATE = "g string, mean array<double>, inverse array<double>, determinant double"


def _estimates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of each group to its means and the inverse of its covariances; a row for each group."""
    p = len(FEATURES)
    for batch in batches:
        rows = []
        for g, n, sums, products in zip(*batch.columns, strict=True):
            n, mean = n.as_py(), np.array(sums.as_py()) / n.as_py()
            second = np.zeros((p, p))
            for (i, j), v in zip(_PAIRS, products.as_py(), strict=True):
                second[i, j] = second[j, i] = v
            spread = second / n - np.outer(mean, mean) + np.diag(np.square(FLOORS))
            rows.append((g.as_py(), mean.tolist(), np.linalg.inv(spread).ravel().tolist(), float(np.linalg.det(spread))))
        columns = list(zip(*rows, strict=True)) or [()] * 4
        kinds = (pa.string(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["g", "mean", "inverse", "determinant"])


def _distance() -> Column:
    """Squared Mahalanobis distance by the columns mean and inverse."""
    p = len(FEATURES)
    off = [F.col(f) - F.col("mean")[i] for i, f in enumerate(FEATURES)]
    total = F.lit(0.0)
    for i, j in _PAIRS:
        total = total + off[i] * off[j] * F.col("inverse")[i * p + j] * (1.0 if i == j else 2.0)
    return F.greatest(total, F.lit(0.0))


def _quantile(rows: DataFrame, share: float) -> DataFrame:
    """(g, limit, part): the bin of d2 in which that share of the rows is reached, and which part of the bin's rows it takes.

    From a histogram, so it is the same whatever the partitions.  Rows of one bin are ties: each counts for the same part.
    """
    bins = rows.groupBy("g", "bin").agg(F.count("*").alias("n"))
    over = bins.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("bin", "n"))).alias("bins"), F.sum("n").alias("rows"))
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(-1000).alias("bin"), F.lit(0.0).alias("part"))
    target = F.col("rows") * share

    def step(a: Column, x: Column) -> Column:
        return F.when(a["seen"] >= target, a).otherwise(F.struct((a["seen"] + x["n"]).alias("seen"), x["bin"].alias("bin"), F.least(F.lit(1.0), (target - a["seen"]) / x["n"]).alias("part")))

    found = F.aggregate("bins", start, step)
    return over.select("g", found["bin"].alias("limit"), found["part"].alias("part"))


def _bin() -> Column:
    return F.floor(F.log(F.least(F.col("d2"), F.lit(1e12)) + 1e-6) * _BINS).cast("int").alias("bin")


def _groups(stats: DataFrame, least_rows: int) -> DataFrame:
    """(lang, source, g): the group that each language and source belongs to, null where even all small ones are too few."""
    each = stats.groupBy("lang", "source").agg(F.count("*").alias("n"))
    each = spool(each, "groups")
    small = each.where(F.col("n") < least_rows).groupBy("lang").agg(F.sum("n").alias("rest"))
    others = small.where(F.col("rest") < least_rows).agg(F.sum("rest")).first()[0] or 0
    joined = each.join(small.withColumnRenamed("lang", "l"), F.col("lang").eqNullSafe(F.col("l")), "left")
    name = F.to_json(F.struct("lang", "source"), {"ignoreNullFields": "false"})
    g = F.when(F.col("n") >= least_rows, name).when(F.col("rest") >= least_rows, F.to_json(F.struct("lang"), {"ignoreNullFields": "false"})).when(F.lit(others >= least_rows), F.lit("others"))
    return spool(joined.select("lang", "source", g.alias("g")), "names")


def _with_groups(stats: DataFrame, groups: DataFrame, how: str = "inner") -> DataFrame:
    named = groups.select(F.col("lang").alias("l"), F.col("source").alias("s"), "g")
    return stats.join(named, F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s")), how).drop("l", "s")


def assess(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", cut: float = CUT, least_rows: int = LEAST_ROWS) -> DataFrame:
    """Counts and verdict of each text.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance
    (null for texts that fail the base rules and for groups with too few rows), group (what the estimate rests on: a
    language and source, a language, all others, or null), doc and digest (the row's key), a row for each input row.  Estimates rest on the texts that pass the base rules.  Null text has no
    words and fails; null languages and sources are groups like any other.  A group under least_rows rows
    joins the small ones of its language, then those of all languages; where these are too few, only the base
    rules decide.  Other columns are not read.
    """
    key, digest = row_keys(doc_id, text)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), key.alias("doc"), digest.alias("digest"), F.col(lang).cast("string").alias("lang"), F.col(source).cast("string").alias("source"), utf8(text).alias("body"))
    stats = rows.mapInArrow(_statistics, _STATS)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    stats = spool(stats.withColumn("base_failed", failed), "statistics")
    good = stats.where(~F.col("base_failed"))
    groups = _groups(good, least_rows)
    grouped = _with_groups(good.select("lang", "source", *FEATURES), groups).where(F.col("g").isNotNull()).drop("lang", "source")

    def estimated(rows: DataFrame) -> DataFrame:
        w = F.col("weight")
        sums = rows.groupBy("g").agg(F.sum(w).alias("n"), F.array(*(F.sum(w * F.col(f)) for f in FEATURES)).alias("sums"), F.array(*(F.sum(w * F.col(FEATURES[i]) * F.col(FEATURES[j])) for i, j in _PAIRS)).alias("products"))
        return spool(sums.mapInArrow(_estimates, _ESTIMATE), "estimates")

    # medians and deviations from them, feature by feature, give a first ordering by each of three norms
    middle = spool(grouped.groupBy("g").agg(*(F.percentile_approx(f, 0.5, 1000).alias(f"m_{f}") for f in FEATURES)), "medians")
    first = grouped.join(middle, "g")
    off = spool(first.groupBy("g").agg(*(F.first(f"m_{f}").alias(f"m_{f}") for f in FEATURES), *(F.percentile_approx(F.abs(F.col(f) - F.col(f"m_{f}")), 0.5, 1000).alias(f"d_{f}") for f in FEATURES)), "deviations")
    terms = [F.abs(F.col(f) - F.col(f"m_{f}")) / F.greatest(1.4826 * F.col(f"d_{f}"), F.lit(floor)) for f, floor in zip(FEATURES, FLOORS, strict=True)]
    norms = F.array(sum((t * t for t in terms[1:]), terms[0] * terms[0]), F.greatest(*terms), sum(terms[1:], terms[0]))
    measured = grouped.join(off, "g").select(F.col("g").alias("name"), *FEATURES, F.posexplode(norms).alias("start", "d2"))
    measured = measured.withColumn("g", F.concat_ws("#", "start", "name")).select("g", *FEATURES, "d2", _bin())
    starts = grouped.select(F.col("g").alias("name"), *FEATURES, F.explode(F.array(*map(F.lit, range(3)))).alias("start"))
    starts = starts.withColumn("g", F.concat_ws("#", "start", "name")).select("g", *FEATURES)
    estimate = None
    for _ in range(STEPS):
        limit = spool(_quantile(measured, SHARE), "limit")
        weight = F.when(F.col("bin") < F.col("limit"), 1.0).otherwise(F.col("part"))
        before, estimate = estimate, estimated(measured.join(limit, "g").where(F.col("bin") <= F.col("limit")).withColumn("weight", weight))
        if before is not None:
            old = before.select("g", F.col("determinant").alias("old"))
            if estimate.join(old, "g").where(F.abs(F.log(F.col("determinant") / F.col("old"))) > STILL).isEmpty():
                break
        measured = starts.join(estimate, "g").withColumn("d2", _distance()).select("g", *FEATURES, "d2", _bin())
    # of the three estimates of a group that with the least determinant counts
    best = estimate.groupBy(F.expr("substr(g, 3)").alias("g")).agg(F.min_by(F.struct("mean", "inverse"), "determinant").alias("e"))
    estimate = spool(best.select("g", "e.mean", "e.inverse"), "estimate")
    measured = grouped.join(estimate, "g").withColumn("d2", _distance()).select("g", "d2", _bin())
    half = spool(_quantile(measured, 0.5).select("g", F.exp((F.col("limit") + F.col("part")) / _BINS).alias("half")).join(estimate, "g"), "final")
    scored = _with_groups(stats, groups, "left").join(half, "g", "left")
    d2 = _distance() / F.col("half") * MEDIAN * F.col("n_words") / (F.col("n_words") + SHORT)
    scored = scored.withColumn("distance", F.when(~F.col("base_failed"), F.sqrt(d2)))
    kept = ~F.col("base_failed") & (F.col("distance").isNull() | (F.col("distance") <= cut))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "distance", F.col("g").alias("group"), "doc", "digest")
