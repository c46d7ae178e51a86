"""Benchmark decontamination by a prefix-filtered set join (operator 2).

An item's windows are sets of shingles ordered by rarity over all documents.  As
a window must be contained whole, one prefix token is necessary: its rarest
shingle.  Documents' shingles are joined with prefix tokens; where one meets, the
window must fit into the document around it (length and position), and its words
are then compared.  What documents send is thinned out by a Bloom filter of
bounded size, so the plan is the same for a benchmark of any size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import row_keys, spool, utf8
from webloom.llm.packets import mix

WINDOW = 10
SHINGLE = 3
#: Bits of a filter for each token, and in all: between 8 KB and 32 MB. A fuller filter lets more through to the join.
TOKEN_BITS, LEAST_BITS, MOST_BITS = 16, 16, 28
_PAGE = 1 << 13
#: Bytes of text in one round of array work, and of a long text that are hashed at once.
_BLOCK_BYTES, _SLICE = 2 << 20, 1 << 20
_BASE = 0x9E3779B97F4A7C15
#: Lower-cases A-Z; whatever else is ASCII but no digit or letter ends a word.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_ODD = (np.arange(1, SHINGLE + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_PROBES = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))


def words_of(body: bytes) -> list[bytes]:
    return body.translate(_FOLD).split()


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


class _Words:
    """Where the words of a folded text are, and a hash of each: a polynomial in its bytes, from differences of one running sum."""

    def __init__(self) -> None:
        self.table = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def of(self, folded: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(begin, end, hash) of each word; a long text is taken a slice at a time."""
        found, a = [], 0
        while a < len(folded):
            b = folded.find(b" ", a + _SLICE)
            b = b if b >= 0 else len(folded)
            if b - a > len(self.up):
                self.up, self.down = _powers(_BASE, b - a), _powers(pow(_BASE, -1, 2**64), b - a)
            data = np.frombuffer(folded, np.uint8, b - a, a)
            edge = np.diff((data != 32).view(np.int8), prepend=0, append=0)
            begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            total = np.zeros(b - a + 1, np.uint64)
            np.cumsum(self.table[data] * self.up[: b - a], out=total[1:])
            found.append((begin + a, end + a, mix((total[end] - total[begin]) * self.down[begin] + (end - begin).astype(np.uint64))))
            a = b
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if len(found) > 1 else found[0]


def tokens(h: np.ndarray, size: int) -> np.ndarray:
    """Tokens of `size` neighbouring words, from their hashes."""
    n = max(0, len(h) - size + 1)
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out = mix((out ^ h[k : k + n]) * _ODD[k])
    return out


def probes(token: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(token * p) >> np.uint64(64 - bits) for p in _PROBES]


def passes(token: np.ndarray, table: np.ndarray, bits: int) -> np.ndarray:
    """Places of the tokens that the filter may hold; most others fall at the first probe."""
    left = np.arange(len(token))
    for p in _PROBES:
        at = (token[left] * p) >> np.uint64(64 - bits)
        left = left[(table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1]
    return left


def _bloom(rows: DataFrame) -> tuple[Broadcast, int]:
    """A filter of the column token; its pages are put together by an aggregation, and it has at most 2 ** MOST_BITS bits."""
    bits = min(MOST_BITS, max(LEAST_BITS, int(rows.count() * TOKEN_BITS).bit_length()))

    def paged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << (bits - 3), np.uint8)
        for batch in batches:
            for at in probes(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), bits):
                np.bitwise_or.at(table, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        pages = table.reshape(-1, min(_PAGE, len(table)))
        used = np.flatnonzero(pages.any(axis=1))
        for a in range(0, len(used), 64):
            some = used[a : a + 64]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([pages[i].tobytes() for i in some], pa.binary())], ["page", "bits"])

    def joined(table: pa.Table) -> pa.Table:
        both = np.bitwise_or.reduce([np.frombuffer(x.as_py(), np.uint8) for x in table.column("bits")])
        return pa.table({"page": table.column("page").slice(0, 1).cast(pa.int32()), "bits": pa.array([both.tobytes()], pa.binary())})

    table = np.zeros(1 << (bits - 3), np.uint8)
    pages = rows.select("token").mapInArrow(paged, "page int, bits binary").groupBy("page").applyInArrow(joined, "page int, bits binary")
    for page, found in pages.toLocalIterator():
        table[page * _PAGE : page * _PAGE + len(found)] = np.frombuffer(bytes(found), np.uint8)
    return rows.sparkSession.sparkContext.broadcast(table), bits


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, body) to windows with all their tokens: (item, words, size, tokens)."""
    find = _Words()
    for batch in batches:
        rows = []
        for item, body in zip(*batch.columns[:2], strict=True):
            folded = body.as_py().translate(_FOLD)
            words, h = folded.split(), find.of(folded)[2]
            for a in range(max(1, len(words) - WINDOW + 1) if words else 0):
                own = words[a : a + WINDOW]
                rows.append((item.as_py(), b" ".join(own), len(own), tokens(h[a : a + WINDOW], min(SHINGLE, len(own))).view(np.int64).tolist()))
                if len(rows) >= 4000:
                    yield _window_batch(rows)
                    rows = []
        if rows:
            yield _window_batch(rows)


def _window_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    kinds = (pa.string(), pa.binary(), pa.int32(), pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["item", "words", "size", "tokens"])


@dataclass
class _Block:
    """Some texts one after the other: other columns and number of words of each, and begin, end and hash of all words."""

    rows: list[tuple]
    counts: np.ndarray
    folded: bytes
    begin: np.ndarray
    end: np.ndarray
    hashes: np.ndarray

    def words(self, a: int, b: int) -> bytes:
        """Words a to b, joined by single spaces."""
        return b" ".join(self.folded[self.begin[a] : self.end[b - 1]].split())


def _blocks(batches: Iterator[pa.RecordBatch], body: int) -> Iterator[_Block]:
    find = _Words()
    rows, texts, size = [], [], 0

    def block() -> _Block:
        folded = b" ".join(texts).translate(_FOLD)
        begin, end, h = find.of(folded)
        stop = np.cumsum(np.fromiter((len(x) + 1 for x in texts), np.int64, len(texts)))
        return _Block(rows, np.diff(np.searchsorted(begin, stop), prepend=0), folded, begin, end, h)

    for batch in batches:
        rest = [c for i, c in enumerate(batch.columns) if i != body]
        for k, text in enumerate(batch.column(body)):
            rows.append(tuple(c[k].as_py() for c in rest))
            texts.append(text.as_py())
            size += len(texts[-1])
            if size >= _BLOCK_BYTES:
                yield block()
                rows, texts, size = [], [], 0
    if rows:
        yield block()


def _candidates(h: np.ndarray, counts: np.ndarray, sizes: list[int], table: np.ndarray, bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(size, position, row, token) of shingles inside one row that the filter lets through."""
    owner = np.repeat(np.arange(len(counts)), counts)
    for size in sizes:
        found = tokens(h, size)
        at = passes(found, table, bits)
        at = at[owner[at] == owner[at + size - 1]]
        yield size, at, owner[at], found[at]


def _counter(sizes: list[int], bloom: Broadcast, bits: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, 0):
            for _, _, _, found in _candidates(block.hashes, block.counts, sizes, bloom.value, bits):
                token, n = np.unique(found, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n, pa.int64())], ["token", "n"])

    return run


_SENT = "row long, doc_id long, doc long, digest binary, n_words long, token long, at int, lead int, context binary"


def _sender(sizes: list[int], bloom: Broadcast, bits: int) -> Callable:
    """A row for each document, and one for each shingle that may be a prefix token, with the words around it."""
    names = [x.strip().split()[0] for x in _SENT.split(",")]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 36
        for block in _blocks(batches, 3):
            rows, counts = block.rows, block.counts
            yield batch_of([(number + i, *row, int(n), None, None, None, None) for i, (row, n) in enumerate(zip(rows, counts.tolist(), strict=True))])
            begin = np.cumsum(counts) - counts
            for size, at, row, token in _candidates(block.hashes, counts, sizes, bloom.value, bits):
                low = np.maximum(begin[row], at - (WINDOW - size))
                high = np.minimum((begin + counts)[row], at + WINDOW)
                out = []
                for a, k, t, lo, hi in zip(at.tolist(), row.tolist(), token.view(np.int64).tolist(), low.tolist(), high.tolist(), strict=True):
                    out.append((number + k, None, None, None, None, t, a - int(begin[k]), a - lo, block.words(lo, hi)))
                    if len(out) >= 10_000:
                        yield batch_of(out)
                        out = []
                if out:
                    yield batch_of(out)
            number += len(rows)

    return run


def _result(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, n_words, spans, items, doc, digest) to the result."""
    for batch in batches:
        rows = []
        for doc, n_words, spans, items in zip(*batch.columns[:4], strict=True):
            hit, end = 0, 0
            for span in sorted((s["start"], s["start"] + s["size"]) for s in spans.as_py() or ()):
                hit += max(0, span[1] - max(span[0], end))
                end = max(end, span[1])
            found = sorted({i for s in items.as_py() or () for i in s or ()})
            rows.append((doc.as_py(), n_words.as_py(), hit, len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), hit > 0, found))
        columns = list(zip(*rows, strict=True)) or [()] * 7
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.string()))
        names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items"]
        yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)), *batch.columns[4:]], [*names, "doc", "digest"])


RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>, doc long, digest binary"


def find_contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Which words of each document lie in an occurrence of an item's window of 10 words.

    Returns doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items (sorted), doc and digest (the
    row's key), a row for each input row.  An item of under 10 words is one window; one with none has none.  Null text has
    no words; a null item id is written as an empty string.  Repeated items count once.  Tables may be empty.
    """
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), utf8(item_text).alias("body")).distinct()
    windows = items.mapInArrow(_windows, "item string, words binary, size int, tokens array<long>")
    windows = spool(windows.groupBy("words").agg(F.first("size").alias("size"), F.first("tokens").alias("tokens"), F.collect_set("item").alias("items")), "windows")
    sizes = sorted(min(SHINGLE, r[0]) for r in windows.select(F.least("size", F.lit(SHINGLE))).distinct().collect())
    known = spool(windows.select(F.explode("tokens").alias("token")).distinct(), "tokens")
    key, digest = row_keys(doc_id, text)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), key.alias("doc"), digest.alias("digest"), utf8(text).alias("body"))

    # how often each token stands in all documents; windows with one that never does are in none
    counted = rows.select("body").mapInArrow(_counter(sizes, *_bloom(known)), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    counts = spool(counted, "counts")
    places = windows.select("words", F.posexplode("tokens").alias("offset", "token"))
    rarest = places.join(counts, "token", "left").groupBy("words").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "token")).alias("least")).where(F.col("least.n") > 0)
    prefixes = windows.join(rarest, "words").select(F.col("least.token").alias("token"), F.col("least.offset").alias("offset"), F.decode("words", "UTF-8").alias("words"), "size", "items")
    prefixes = spool(prefixes, "prefixes")

    sent = spool(rows.mapInArrow(_sender(sizes, *_bloom(prefixes.select("token").distinct())), _SENT), "shingles")
    hits = sent.where(F.col("token").isNotNull()).select("row", "token", "at", "lead", F.split(F.decode("context", "UTF-8"), " ").alias("context"))
    first = F.col("lead") - F.col("offset")
    fits = (first >= 0) & (first + F.col("size") <= F.size("context"))
    same = F.array_join(F.slice("context", F.greatest(first, F.lit(0)) + 1, F.col("size")), " ") == F.col("words")
    # rows of a frequent token are many on the side of documents alone; the planner divides such partitions
    found = hits.join(prefixes, "token").where(fits & same).select("row", F.struct((F.col("at") - F.col("offset")).alias("start"), "size").alias("span"), "items")
    found = spool(found.groupBy("row").agg(F.collect_set("span").alias("spans"), F.collect_set("items").alias("items")), "found")
    each = sent.where(F.col("token").isNull()).select("row", "doc_id", "n_words", "doc", "digest")
    return each.join(found.hint("merge"), "row", "left").select("doc_id", "n_words", "spans", "items", "doc", "digest").mapInArrow(_result, RESULT)
