"""Queries that apply the operators of this subpackage to the shared tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm import line_dedup
from webloom.llm.bpe import encode, read_ranks
from webloom.llm.decontamination import find_contamination
from webloom.llm.pii import find_personal_data
from webloom.llm.quality import assess
from webloom.llm.sharding import assign_shards
from webloom.llm.simhash import near_duplicates
from webloom.llm.sql import ORACLES
from webloom.llm.substring_dedup import remove_repeated_windows
from webloom.llm.suffix_dedup import remove_repeated_bytes
from webloom.llm.warc import read_archives, write_archives

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(ranks_path: str | None = None) -> tuple[bytes, str]:
    """(content of the rank file, pattern) of the public tokenizer; ranks_path overrides where the file is."""
    import public_tokenizers

    return read_ranks(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of `documents` that 50-byte strings of smaller documents cover."""
    return remove_repeated_bytes(_table(spark, sf_dir, "documents")).drop("kept")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of `documents` in occurrences of windows of `benchmark` items."""
    return find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("items", "doc", "digest")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of `documents` that 13-word windows of smaller documents cover."""
    return remove_repeated_windows(_table(spark, sf_dir, "documents")).drop("kept")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in `documents`."""
    return find_personal_data(_table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of `documents`."""
    return assess(_table(spark, sf_dir, "documents")).drop("doc", "digest")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components of `documents`."""
    return near_duplicates(_table(spark, sf_dir, "documents")).drop("doc", "digest")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`documents` encoded and decoded by a public byte-level BPE."""
    return encode(_table(spark, sf_dir, "documents"), *tokenizer(), with_ids=False)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`documents` dealt to 40 shards."""
    return assign_shards(_table(spark, sf_dir, "documents"), 40)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`pages` written to archives and read again."""
    pages = _table(spark, sf_dir, "pages")
    return read_archives(write_archives(pages, least=0), with_payload=False).drop("url", "record_id")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`documents` without lines that stand on ten sites or more."""
    rows, n_lines, n_removed = line_dedup.remove_boilerplate(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.col(n_lines).alias("n_lines"), F.col(n_removed).alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_suffix_dedup, op2_decontamination, op3_substring_dedup, op4_pii, op5_quality_rules, op6_simhash, op7_bpe, op8_sharding, op9_warc, op10_line_dedup)}

__all__ = ["ORACLES", "QUERIES"]
