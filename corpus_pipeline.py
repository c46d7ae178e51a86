"""The training-data pipeline: quality rules, line removal, near-duplicates, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents, whatever these are beside doc_id, text, lang and source.

Rows are known by id and 128 bits of a digest of id and text, so rows that repeat both fare alike, and null ids or
equal ids with different texts don't mix.  Null texts are empty, null languages and sources are values like any other,
and an empty table goes through as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm.bpe import encode
from webloom.llm.common import row_keys, spool
from webloom.llm.decontamination import find_contamination
from webloom.llm.line_dedup import remove_boilerplate
from webloom.llm.quality import assess
from webloom.llm.queries import tokenizer
from webloom.llm.simhash import near_duplicates


def _free(name: str, taken: list[str]) -> str:
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def _keyed(docs: DataFrame) -> tuple[DataFrame, str, str]:
    one, two = (_free(n, docs.columns) for n in ("_doc", "_digest"))
    key, digest = row_keys()
    return docs.withColumns({one: key, two: digest}), one, two


def _joined(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """docs with or without the rows that have a (doc, digest) of keys."""
    rows, one, two = _keyed(docs)
    keys = spool(keys.select(F.col("doc").alias(one), F.col("digest").alias(two)).distinct(), "keys")
    return rows.join(keys.hint("merge"), [one, two], how).select(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the outlier test keep. Empty and null texts fail; rows that repeat stay or go together."""
    return _joined(docs, assess(docs).where(~F.col("kept")), "left_anti")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that stand on many sites; n_chars follows the text. A text may end up empty; a null one stays null."""
    rows, _, _ = remove_boilerplate(docs)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component: that with the smallest doc_id (a null one is the largest); of rows that repeat it, one.

    Of rows with that id and different texts that with the smallest digest stays.
    """
    keepers = near_duplicates(docs).where("keeper")
    rows, one, two = _keyed(_joined(docs, keepers, "left_semi"))
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    # an aggregate, so that rows which repeat a keeper are combined before they meet; texts of any kind of column compare
    order = F.to_json(F.struct(*others)) if others else F.lit("")
    kept = rows.groupBy(one, two).agg(F.min_by(F.struct(*docs.columns), order).alias("row"))
    return kept.select(*(F.col("row")[c].alias(c) for c in docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs. Texts without words stay; rows that repeat stay or go together."""
    found = find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _joined(docs, found.where("contaminated"), "left_anti")


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text (unsigned 32-bit, little-endian), their number, and digests of ids and of the decoded text; a row for each document."""
    return encode(docs, *tokenizer())


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("bpe_tokens", bpe_tokens),
]

#: SQL has no SimHash, robust estimate or merge table; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = spool(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
