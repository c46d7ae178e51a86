"""Super-k-mer packets, for repeated windows of bytes or of words.

Consecutive windows with the same minimiser (the least hash among the k-mers of
a window) travel as one string.  Equal windows have equal minimisers, so they
meet in the bucket that the minimiser names.  A task packs what it has for a
bucket into one compressed row.  Of equal strings in a chunk only those of the
smallest document travel: the others are known to repeat it.  A bucket that is
too large is cut again with a longer k-mer, up to the window itself, and dealt anew.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import discard, release, row_keys, spool, utf8

#: Bytes of strings that a task gathers before it sends its packets: at least the first, and as many for each bucket as
#: a packet should have, up to the second.
CHUNK_BYTES, PACKET_BYTES, MOST_CHUNK_BYTES = 24 << 20, 8 << 10, 128 << 20
#: Bytes of text that one round of array work takes.
BLOCK_BYTES = 1 << 20
#: Raw bytes of strings meant for one bucket; one with over twice as many is cut again.
BUCKET_BYTES = 40 << 20
#: Stretches of a document (its starts without so many bits) that are dealt to parts on their own.
STRETCH = 20
#: Longest run of windows in one string.
MAX_RUN = 2048

_STRINGS, _SPANS, _LEFT = 0, 1, 2


def mix(h: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash."""
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(32))


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` neighbours, by doubling."""
    done = 1
    while done * 2 <= width:
        h = np.minimum(h[:-done], h[done:])
        done *= 2
    return np.minimum(h[: len(h) - (width - done)], h[width - done :]) if done < width else h


def runs(least: np.ndarray, owner: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first window, windows) of each run: one owner, one minimiser, at most MAX_RUN windows."""
    if not len(least):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | (owner[1:] != owner[:-1]) | (valid[1:] != valid[:-1])
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, len(least)))
    keep = valid[first]
    first, length = first[keep], length[keep]
    if len(length) and length.max() > MAX_RUN:
        parts = -(-length // MAX_RUN)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        first, length = np.repeat(first, parts) + nth * MAX_RUN, np.repeat(length, parts)
        length = np.minimum(MAX_RUN, length - nth * MAX_RUN)
    return first, length


@dataclass
class Chunk:
    """Strings that one task has gathered: whose (id, digest in two halves), from which window on, how many windows, minimiser."""

    strings: list[bytes] = field(default_factory=list)
    columns: list[list[np.ndarray]] = field(default_factory=list)
    size: int = 0

    def add(self, strings: list[bytes], *columns: np.ndarray) -> None:
        self.strings += strings
        self.columns.append(list(columns))
        self.size += sum(map(len, strings))

    def arrays(self) -> list[np.ndarray]:
        return [np.concatenate(x) for x in zip(*self.columns, strict=True)]


def halves(digest: bytes) -> tuple[int, int]:
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def pack(arrays: list[np.ndarray], strings: list[bytes] | None = None, level: int | None = None) -> bytes:
    """Arrays (differences of neighbours compress better) and strings as one compressed value."""
    n = len(arrays[0])
    parts = [np.array([n, len(arrays)], "<i8").tobytes()]
    parts += [np.diff(a.astype("<i8"), prepend=0).astype("<i8").tobytes() for a in arrays]
    if strings is not None:
        parts += [np.fromiter(map(len, strings), "<i8", n).tobytes(), *strings]
    return zstandard.ZstdCompressor(level=level or (3 if strings is None else 6)).compress(b"".join(parts))


def unpack(value: bytes, with_strings: bool) -> tuple[list[np.ndarray], list[bytes]]:
    raw = zstandard.ZstdDecompressor().decompress(value)
    n, k = np.frombuffer(raw, "<i8", 2).tolist()
    at = 16
    arrays = []
    for _ in range(k):
        arrays.append(np.cumsum(np.frombuffer(raw, "<i8", n, at)))
        at += 8 * n
    if not with_strings:
        return arrays, []
    ends = np.cumsum(np.frombuffer(raw, "<i8", n, at)) + at + 8 * n
    at += 8 * n
    return arrays, [raw[a:b] for a, b in zip([at, *ends.tolist()[:-1]], ends.tolist(), strict=True)] if n else []


def unpacked_size(value: bytes) -> int:
    return zstandard.frame_content_size(value)


Spans = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _others(*keys: np.ndarray) -> np.ndarray:
    """Where a sorted sequence of keys begins a new one."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


def merged(doc: np.ndarray, one: np.ndarray, two: np.ndarray, start: np.ndarray, end: np.ndarray) -> Spans:
    """Union of the half-open spans of each row (document and digest), in order."""
    if not len(doc):
        return doc, one, two, start, end
    order = np.lexsort((start, two, one, doc))
    doc, one, two, start, end = doc[order], one[order], two[order], start[order], end[order]
    other = _others(doc, one, two)
    shift = np.cumsum(other) << 40  # documents one after the other on one line
    reach = np.maximum.accumulate(end + shift)
    new = other.copy()
    new[1:] |= (start + shift)[1:] > reach[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], one[first], two[first], start[first], reach[last] - shift[last]


def distinct(arrays: list[np.ndarray], strings: list[bytes], width: int) -> tuple[np.ndarray, Spans]:
    """(rows that go on, spans of the others): of equal strings those of the smallest document, each place once."""
    doc, one, two, start, windows = arrays[:5]
    n = len(strings)
    first: dict[bytes, int] = {}
    same = np.fromiter(map(first.setdefault, strings, range(n)), np.int64, n)
    del first
    smallest = doc.copy()
    np.minimum.at(smallest, same, doc)
    repeats = doc > smallest[same]
    travel = ~repeats
    if len(np.flatnonzero(travel & (same != np.arange(n)))):  # the smallest document has the string twice, or its row is there twice
        both = np.flatnonzero(travel)
        order = both[np.lexsort((start[both], two[both], one[both], same[both]))]
        travel[order[~_others(same[order], one[order], two[order], start[order])]] = False
    known = np.flatnonzero(repeats)
    spans = (doc[known], one[known], two[known], start[known], start[known] + windows[known] + width - 1)
    return np.flatnonzero(travel), merged(*spans)


_NAMES = ["bucket", "kind", "packet"]
_SCHEMA = "bucket int, kind int, packet binary"


def _row(bucket: int, kind: int, packet: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([kind], pa.int32()), pa.array([packet], pa.binary())], _NAMES)


def send(chunk: Chunk, buckets: int, width: int, parts: int | None = None, level: int | None = None) -> Iterator[pa.RecordBatch]:
    """The packets of a chunk: a row for each bucket, and rows of spans already known to repeat, for so many parts (None: buckets)."""
    if not chunk.strings:
        return
    arrays, strings = chunk.arrays(), chunk.strings
    least = arrays[5]
    at, known = distinct(arrays, strings, width)
    bucket = (least % np.uint64(buckets)).astype(np.int64)
    at = at[np.argsort(bucket[at], kind="stable")]
    cut = np.flatnonzero(np.diff(bucket[at], prepend=-1))
    for a, b in zip(cut.tolist(), [*cut.tolist()[1:], len(at)], strict=True):
        mine = at[a:b]
        tag = (least[mine] >> np.uint64(40)).astype(np.int64)
        yield _row(int(bucket[mine[0]]), _STRINGS, pack([*(x[mine] for x in arrays[:5]), tag], [strings[i] for i in mine.tolist()], level))
    yield from dealt(known, parts or buckets)


def dealt(spans: Spans, parts: int) -> Iterator[pa.RecordBatch]:
    """Spans as a packed row for each part that documents are dealt to."""
    doc, one = spans[:2]
    if not len(doc):
        return
    part = (mix(doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + one.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    cut = np.flatnonzero(np.diff(part[order], prepend=-1))
    for a, b in zip(cut.tolist(), [*cut.tolist()[1:], len(order)], strict=True):
        x = order[a:b]
        yield _row(int(part[x[0]]), _SPANS, pack([column[x] for column in spans]))


def dealt_strings(columns: list[np.ndarray], strings: list[bytes], parts: int) -> Iterator[pa.RecordBatch]:
    """Strings (id, digest in two halves, start) as a packed row for each part that stretches of documents are dealt to."""
    doc, one, _, start = columns
    if not len(doc):
        return
    part = (mix(doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + one.astype(np.uint64) + mix((start >> STRETCH).astype(np.uint64))) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    cut = np.flatnonzero(np.diff(part[order], prepend=-1))
    for a, b in zip(cut.tolist(), [*cut.tolist()[1:], len(order)], strict=True):
        x = order[a:b]
        yield _row(int(part[x[0]]), _LEFT, pack([c[x] for c in columns], [strings[i] for i in x.tolist()]))


def mapper(cut: Callable[[Iterable[tuple[int, int, int, bytes]], int], Iterator[Chunk]], buckets: int, width: int, parts: int | None = None, level: int | None = None):
    """For mapInArrow over (doc, digest, body). cut: (documents, bytes of a chunk) to chunks of strings. parts: see send; level: of compression."""
    size = min(MOST_CHUNK_BYTES, max(CHUNK_BYTES, buckets * PACKET_BYTES))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, bytes]]:
        for batch in batches:
            for doc, digest, body in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                yield doc.as_py(), *halves(digest.as_py()), body.as_py()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in cut(documents(batches), size):
            yield from send(chunk, buckets, width, parts, level)

    return run


def merge_part(table: pa.Table) -> pa.Table:
    """For applyInArrow over the spans of a part: the merged spans of each row."""
    got = [unpack(x.as_py(), False)[0] for x in table.column("packet")]
    doc, one, two, start, end = merged(*(np.concatenate(x) for x in zip(*got, strict=True)))
    first = np.flatnonzero(_others(doc, one, two))
    spans = [np.concatenate([start[a:b], end[a:b]]).astype("<i8").tobytes() for a, b in zip(first.tolist(), [*first.tolist()[1:], len(doc)], strict=True)]
    digest = [x.tobytes() + y.tobytes() for x, y in zip(one[first].astype("<i8"), two[first].astype("<i8"), strict=True)]
    return pa.table({"doc": pa.array(doc[first], pa.int64()), "digest": pa.array(digest, pa.binary()), "spans": pa.array(spans, pa.binary())})


Covered = Callable[..., tuple[np.ndarray, np.ndarray]]


def resolved(arrays: list[np.ndarray], strings: list[bytes], covered: Covered | None, near: Callable | None, width: int) -> tuple[list[Spans], tuple[list[np.ndarray], list[bytes]]]:
    """(spans of what a smaller document has too, strings that are left), among strings that one bucket holds.

    Without covered, what is left are the stretches of strings that near gives, of those that are no copies of a smaller
    document's string.
    """
    doc, one, two, start, windows, tag = arrays
    order = np.lexsort((doc, tag))
    first = np.flatnonzero(np.diff(tag[order], prepend=-1))
    several = np.minimum.reduceat(doc[order], first) != np.maximum.reduceat(doc[order], first)
    order = order[np.repeat(several, np.diff(np.append(first, len(order))))]
    doc, one, two, start, windows, tag = (x[order] for x in arrays)
    strings = [strings[i] for i in order.tolist()]
    n, seen = len(strings), {}
    same = np.fromiter(map(seen.setdefault, strings, range(n)), np.int64, n)
    del seen
    smallest = doc.copy()
    np.minimum.at(smallest, same, doc)
    whole = np.flatnonzero(doc > smallest[same])
    out = [(doc[whole], one[whole], two[whole], start[whole], start[whole] + windows[whole] + width - 1)]
    only = np.flatnonzero(same == np.arange(n))
    if len(only):  # a string that is alone with its minimiser has been dealt with
        first = np.flatnonzero(np.diff(tag[only], prepend=-1))
        several = np.minimum.reduceat(smallest[only], first) != np.maximum.reduceat(smallest[only], first)
        only = only[np.repeat(several, np.diff(np.append(first, len(only))))]
    rest = np.flatnonzero(doc == smallest[same])
    rest = rest[np.argsort(same[rest], kind="stable")]
    taken, left = [[x[:0] for x in (doc, one, two, start)]], []
    for part in tag_groups(tag[only], np.fromiter((len(strings[i]) for i in only.tolist()), np.int64, len(only))):
        mine = only[part]
        if near and covered:
            mine = mine[near([strings[i] for i in mine.tolist()], smallest[mine])]
        if not len(mine):
            continue
        if covered:
            which, window = covered([strings[i] for i in mine.tolist()], smallest[mine], windows[mine])
            count = np.ones(len(which), np.int64)
        elif near:
            which, window, count = near([strings[i] for i in mine.tolist()], smallest[mine])
        else:
            which, window, count = np.arange(len(mine)), np.zeros(len(mine), np.int64), windows[mine]
        if not len(which):
            continue
        # every row of the smallest document that has the string gets its spans
        a = np.searchsorted(same[rest], mine[which], "left")
        times = np.searchsorted(same[rest], mine[which], "right") - a
        row = rest[np.repeat(a, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)]
        window, end = np.repeat(window, times), np.repeat(window + count + width - 1, times)
        begin = start[row] + window
        if covered:
            out.append((doc[row], one[row], two[row], begin, begin + width))
        else:
            taken.append([doc[row], one[row], two[row], begin])
            left += [strings[i][x:y] for i, x, y in zip(row.tolist(), window.tolist(), end.tolist(), strict=True)]
    return out, ([np.concatenate(x) for x in zip(*taken, strict=True)], left)


def reducer(covered: Covered | None, near: Callable | None, cut_again: Callable[[list[np.ndarray], list[bytes], Chunk], None] | None, width: int, buckets: int, most: int | None = None, parts: int | None = None):
    """For applyInArrow over the packets of a bucket, as a stream; gives packed spans, and strings to deal anew.

    covered: (strings, document, windows of each) to (string, window) arrays of those whose
    content also starts in a smaller document; strings are distinct and share minimisers.  None: strings that are left are
    given, in one packet.
    near: (strings, documents) to those that can share a window with another document's; None: all.  Without covered it
    gives their stretches that can, as arrays of string, first window and windows.
    cut_again: adds the strings, cut by a longer k-mer, to a chunk; None where nothing is left to cut.
    most: bytes of strings that are held at once.  Equal strings are combined before they count.
    parts: of spans; None: as many as buckets.
    """
    parts = parts or buckets
    limit = 2 * BUCKET_BYTES if most is None else most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays, strings, size, bound, cutting, chunk = [], [], 0, limit, False, Chunk()
        for batch in batches:
            sent = pc.not_equal(batch.column("kind"), _STRINGS)
            yield batch.select(_NAMES).filter(sent)
            for packet in batch.column("packet").filter(pc.invert(sent)):
                more, found = unpack(packet.as_py(), True)
                if not cutting:
                    arrays.append(more)
                    strings += found
                    size += sum(map(len, found))
                    if size <= bound:
                        continue
                    held = [np.concatenate(x) for x in zip(*arrays, strict=True)]
                    at, known = distinct(held, strings, width)
                    yield from dealt(known, parts)
                    more, found = [x[at] for x in held], [strings[i] for i in at.tolist()]
                    size = sum(map(len, found))
                    cutting = cut_again is not None and size > limit // 2
                    if not cutting:
                        arrays, strings, bound = [more], found, max(limit, 2 * size)
                        continue
                    arrays, strings = [], []
                for a in range(0, len(found), 1 << 14):  # a few at a time, as what is cut again is longer
                    cut_again([x[a : a + (1 << 14)] for x in more], found[a : a + (1 << 14)], chunk)
                    if chunk.size >= CHUNK_BYTES:
                        yield from send(chunk, buckets, width, parts)
                        chunk = Chunk()
        if cutting:
            yield from send(chunk, buckets, width, parts)
        elif strings:
            found, left = resolved([np.concatenate(x) for x in zip(*arrays, strict=True)], strings, covered, near, width)
            for spans in found:
                yield from dealt(merged(*(x.astype(np.int64) for x in spans)), parts)
            yield from dealt_strings(*left, 1)

    return run


def tag_groups(tag: np.ndarray, size: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[slice]:
    """Cut a sequence in tag order into slices of about `most` bytes; a tag is never divided."""
    if not len(tag):
        return
    bound = np.append(np.flatnonzero(np.diff(tag, prepend=-1)), len(tag))
    total = np.append(0, np.cumsum(size))
    a = 0
    while a < len(bound) - 1:
        b = max(a + 1, int(np.searchsorted(total[bound], total[bound[a]] + most, "right")) - 1)
        yield slice(int(bound[a]), int(bound[b]))
        a = b


def settled(docs: DataFrame, doc_id: str, text: str, cut, again: list, covered, near, width: int, growth: float, most: int | None = None, together: int = 1, unique: bool = False) -> tuple[list[DataFrame], int]:
    """(tables of bucket, kind and packet: spans by part, and strings that are left; number of parts for spans).

    growth: bytes of strings for each byte of text.  again: for each further level, what cuts the strings of a bucket that
    is too large.  near: for each level, see reducer.  together: buckets that the size of the texts needs for each part of spans.
    unique: see row_keys.
    """
    spark = docs.sparkSession
    key, digest = row_keys(doc_id, text, unique)
    slim = docs.select(key.alias("doc"), digest.alias("digest"), utf8(text).alias("body"))
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    sized = max(2 * spark.sparkContext.defaultParallelism, -(-int(total * growth) // BUCKET_BYTES))
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), sized)
    parts = buckets if together == 1 else max(2 * spark.sparkContext.defaultParallelism, sized // together)
    # without digests packets are so much smaller that the middle level of compression does
    packets, found = slim.mapInArrow(mapper(cut, buckets, width, parts, 3 if unique else None), _SCHEMA), []
    for level, cut_again in enumerate([*again, None]):
        out = spool(packets.groupBy("bucket").applyInArrow(reducer(covered, near[level] if near else None, cut_again, width, buckets, most, parts), _SCHEMA), "packets")
        found.append(out)
        packets = out.where(F.col("kind") == _STRINGS)
        if packets.isEmpty():
            break
    del packets
    release(spark)
    return found, parts


def spans_of(tables: list[DataFrame]) -> DataFrame:
    """(doc, digest, spans) from tables with spans by part."""
    spans = reduce(DataFrame.unionByName, [t.where(F.col("kind") == _SPANS) for t in tables])
    return spool(spans.groupBy("bucket").applyInArrow(merge_part, "doc long, digest binary, spans binary"), "spans")


def find_spans(docs: DataFrame, doc_id: str, text: str, cut, again: list, covered, near, width: int, growth: float, most: int | None = None) -> DataFrame:
    """(doc, digest, spans) of rows with repeated windows; see settled."""
    tables, _ = settled(docs, doc_id, text, cut, again, covered, near, width, growth, most)
    spans = spans_of(tables)
    discard(*tables)
    release(docs.sparkSession)
    return spans


def with_spans(docs: DataFrame, spans: DataFrame, doc_id: str, text: str, unique: bool = False) -> DataFrame:
    """(doc_id, body, spans) of every row. unique: see row_keys."""
    key, digest = row_keys(doc_id, text, unique)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), key.alias("doc"), digest.alias("digest"), utf8(text).alias("body"))
    return rows.join(spans.hint("merge"), ["doc", "digest"], "left").select("doc_id", "body", "spans")


def union_of(spans: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """The spans that merge_part wrote."""
    both = np.frombuffer(spans or b"", "<i8").reshape(2, -1)
    return both[0], both[1]
