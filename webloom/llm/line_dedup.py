"""Removal of lines that many sites have (operator 10).

A HyperLogLog sketch of the sites of each line, merged by the aggregation,
tells on how many sites it stands.  Lines whose estimate is near the threshold
are counted exactly.  All steps are DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import row_keys, spool

MIN_SITES = 10
#: 2 ** LG_K registers: a standard error of 3.3 %.
LG_K = 10
#: Estimates within this factor of the threshold (six standard errors) are replaced by exact counts.
NEAR = 1.25


def _line_keys(line: str) -> list[Column]:
    return [F.xxhash64(line).alias("h1"), F.hash(line).alias("h2")]


def _lines(docs: DataFrame, text: str, *more: Column) -> DataFrame:
    """A row for each line that isn't white space."""
    # outer, as the plain form has the optimizer split texts twice, to leave out null ones before
    lines = docs.select(*more, F.posexplode_outer(F.split(text, "\n", -1)).alias("pos", "line"))
    return lines.where(F.col("line").rlike(r"[^\x20\x09-\x0D]"))


def boilerplate(docs: DataFrame, text: str = "text", site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """(h1, h2) of the lines that stand on at least min_sites sites; a null site is a site."""
    lines = _lines(docs, text, F.xxhash64(site).alias("site")).select(*_line_keys("line"), "site")
    spread = lines.groupBy("h1", "h2").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("sites"))
    seen = spool(spread.where(F.col("sites") >= min_sites / NEAR), "spread")
    sure = seen.where(F.col("sites") > min_sites * NEAR).select("h1", "h2")
    near = spool(seen.where(F.col("sites") <= min_sites * NEAR).select("h1", "h2"), "near")
    exact = lines.join(near, ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.countDistinct("site").alias("sites"))
    return spool(sure.unionByName(exact.where(F.col("sites") >= min_sites).select("h1", "h2")), "boilerplate")


def _free(name: str, taken: list[str]) -> str:
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def remove_boilerplate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", site: str = "source", min_sites: int = MIN_SITES) -> tuple[DataFrame, str, str]:
    """Remove lines that stand on min_sites sites or more, wherever they stand.

    Returns the rows with all their columns and a new text, and the names of two more columns:
    lines before, and lines removed.  Lines end at newlines and are compared as they are; lines of
    white space stay.  Null texts stay null, with no lines; a null site counts as one site.  Two names that
    clash with columns of docs get underscores.
    """
    columns = docs.columns
    one, two, at, n, gone = (_free(x, columns) for x in ("_one", "_two", "_at", "n_lines", "n_removed"))
    key, digest = row_keys(doc_id, text)
    lines = _lines(docs, text, key.alias("doc"), digest.alias("digest")).select("doc", "digest", "pos", *_line_keys("line"))
    found = lines.join(boilerplate(docs, text, site, min_sites), ["h1", "h2"])
    found = spool(found.groupBy("doc", "digest").agg(F.collect_set("pos").alias("pos")), "hits")
    hits = found.select(F.col("doc").alias(one), F.col("digest").alias(two), F.col("pos").alias(at))
    rows = docs.withColumns({one: key, two: digest}).join(hits.hint("merge"), [one, two], "left")
    parts = F.split(text, "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(at))
    rows = rows.withColumns({
        n: F.when(F.col(text).isNull(), 0).otherwise(F.size(parts)).cast("long"),
        gone: F.when(F.col(at).isNull(), 0).otherwise(F.size(at)).cast("long"),
        text: F.when(F.col(at).isNull(), F.col(text)).otherwise(F.array_join(F.transform(kept, lambda i: F.get(parts, i)), "\n")),
    })
    return rows.select(*columns, n, gone), n, gone


SQL = rf"""
WITH lines AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents),
boilerplate AS (
  SELECT line FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
  GROUP BY line HAVING count(DISTINCT coalesce(source, chr(1))) >= {MIN_SITES}),
kept AS (
  SELECT doc_id, count(*) AS n_lines, count(b.line) AS n_removed,
         coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE b.line IS NULL), '') AS kept
  FROM lines l LEFT JOIN boilerplate b ON l.line = b.line GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
