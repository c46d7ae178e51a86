"""Reproducible shuffle into shards by a Feistel permutation (operator 8).

Rows get gapless numbers from 0, a Feistel network over a square of at least as
many places permutes them, and a number that lands beyond the last row walks its
cycle until it is back.  Shard and slot are computed from the permuted number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.llm.common import spool

ROUNDS = 4
#: A walk visits each place beyond the last row once at most: 2 * side of them.  For under 1024 rows
#: that is under this; for more, a walk of this length has a chance below 2 ** -250, and is an error.
WALKS = 66
#: Numbers that one array holds at most, where rows that agree in all columns get one each.
RUN = 10_000
#: Rows meant for one numbering bucket; at most MOST_BUCKETS of them.
BUCKET_ROWS, MOST_BUCKETS = 20_000, 4096


def _side(rows: int) -> int:
    side = max(1, int(rows**0.5))
    while side * side < rows:
        side += 1
    return side


def _rounds(left: Column, right: Column, side: int, seed: int) -> tuple[Column, Column]:
    for k in range(ROUNDS):
        left, right = right, F.pmod(left + F.pmod(F.xxhash64(right, F.lit(seed * ROUNDS + k)), F.lit(side)), F.lit(side))
    return left, right


def permute(df: DataFrame, number: str, rows: int, seed: int, to: str) -> DataFrame:
    """Add `to`: a permutation of the numbers 0 to rows - 1."""
    side = _side(rows)
    names = set(df.columns)
    half = next(f"_half{i}" for i in range(len(names) + 1) if f"_half{i}" not in names)
    df = df.withColumn(half, F.struct(F.floor(F.col(number) / side).cast("long").alias("l"), F.pmod(F.col(number), F.lit(side)).cast("long").alias("r")))
    for k in range(ROUNDS):  # a projection for each round, as an expression would double with each
        left, right = F.col(half)["l"], F.col(half)["r"]
        df = df.withColumn(half, F.struct(right.alias("l"), F.pmod(left + F.pmod(F.xxhash64(right, F.lit(seed * ROUNDS + k)), F.lit(side)), F.lit(side)).alias("r")))

    def place(h: Column) -> Column:
        return h["l"] * side + h["r"]

    def step(h: Column, _: Column) -> Column:
        left, right = _rounds(h["l"], h["r"], side, seed)
        return F.when(place(h) < rows, h).otherwise(F.struct(left.alias("l"), right.alias("r")))

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), F.col(half), step)
    return df.withColumn(to, F.when(place(F.col(half)) < rows, place(F.col(half))).when(place(walked) < rows, place(walked)).otherwise(F.raise_error(F.lit("a walk is too long")).cast("long"))).drop(half)


def assign_shards(docs: DataFrame, shards: int = 40, seed: int = 7, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Deal rows to shards in a reproducible random order; counts differ by one at most (law `rows`).

    Returns doc_id, size (UTF-8 bytes of the text, none for null, plus 16), text_crc32 (0 for null or
    empty), law, shard, slot (gapless from 0 in each shard) and grown_shard (null: only the law `key`
    has it), a row for each input row.  The order depends on ids, sizes, checksums and seed alone,
    not on partitions.  Rows that agree in all three are counted, then numbered one after the other,
    so repeated rows and null ids need no task of their own: a long run of numbers is dealt to tasks in parts
    of RUN.  An empty table gives none.  Other columns are not read.
    """
    content = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), (F.octet_length(content) + 16).cast("long").alias("size"), F.crc32(content).alias("text_crc32"))
    keys = ["doc_id", "size", "text_crc32"]
    counted = spool(rows.groupBy(*keys).agg(F.count("*").alias("n")), "rows")
    total = counted.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, min(MOST_BUCKETS, total // BUCKET_ROWS))
    counted = counted.withColumn("h", F.xxhash64(*keys, F.lit(seed))).withColumn("bucket", F.pmod("h", F.lit(buckets)))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # over MOST_BUCKETS rows at most
    offsets = counted.groupBy("bucket").agg(F.sum("n").alias("inside")).select("bucket", F.coalesce(F.sum("inside").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("bucket").orderBy("h", *keys).rowsBetween(Window.unboundedPreceding, -1)
    numbered = counted.withColumn("first", F.coalesce(F.sum("n").over(within), F.lit(0))).join(F.broadcast(offsets), "bucket")
    numbered = spool(numbered.select(*keys, "n", (F.col("offset") + F.col("first")).alias("begin")), "numbered")
    long = numbered.where(F.col("n") > RUN).select(*keys, "n", "begin", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(RUN).cast("long"))).alias("at"))
    long = long.select(*keys, F.least(F.lit(RUN), F.col("n") - F.col("at")).alias("n"), (F.col("begin") + F.col("at")).alias("begin")).repartition("begin")
    runs = numbered.where(F.col("n") <= RUN).unionByName(long)
    numbered = runs.select(*keys, F.explode(F.sequence("begin", F.col("begin") + F.col("n") - 1)).alias("number"))
    dealt = permute(numbered, "number", total, seed, "place")
    return dealt.select(*keys, F.lit("rows").alias("law"), F.pmod("place", F.lit(shards)).cast("int").alias("shard"), F.floor(F.col("place") / shards).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
