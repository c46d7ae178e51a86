"""Byte-level BPE by merge replay over the pieces of the whole corpus (operator 7).

Texts are cut into pieces, and blocks of texts become numbers of pieces.  Each block
sends its distinct pieces to buckets, by hash, so a piece is encoded once for all
texts: an inverted index leads from each pair of tokens to the places in all words of
the bucket where it stands, ranks are applied from the lowest up, and only the
neighbours of a merged pair are looked at again.  The ids go back to the blocks.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import release, spool, spool_by, utf8

#: Characters of text in a block, longest text that is cut at once, bytes of words that are replayed together, and
#: bytes of text for which there is a bucket.
BLOCK, _LONGEST, REPLAYED, BUCKET_BYTES = 5_000_000, 1_000_000, 2 << 20, 16 << 20
#: The pattern whose pieces can be found by the standard library in texts up to U+00FF, and never go on before a single space.
KNOWN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Letters and digits up to U+00FF, for the pattern in a form that the standard library knows.
_LETTERS, _NUMBERS, _SPACES = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def parse_ranks(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in content.splitlines() if line)}


#: Stand for the gap between words and for a token that has become part of the one before it; no token has such an id.
_GAP, _GONE = (1 << 20) - 1, (1 << 20) - 2


class Pairs:
    """Pairs of tokens that together are a token, and its rank: by the left token, and by the right one.

    Each is a table in rows: of token t the other tokens (in order) and the ranks from start[t] to start[t + 1].
    """

    def __init__(self, ranks: dict[bytes, int]) -> None:
        found = []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    found.append((left, right, rank))
        left, right, rank = np.array(found, np.int64).reshape(-1, 3).T
        most = max(ranks.values(), default=-1) + 1
        self.with_right = self._rows(left, right, rank, most)
        self.with_left = self._rows(right, left, rank, most)
        self.bytes = np.array([ranks[bytes([i])] for i in range(256)])
        self.first = np.full((257, 257), -1, np.int32)  # the gap is byte 256
        of = {int(r): i for i, r in enumerate(self.bytes)}
        for x, y, r in found:
            if x in of and y in of:
                self.first[of[x], of[y]] = r
        # tokens in pairs that come before the token itself
        self.early = {int(t) for t, r in [*zip(left, rank, strict=True), *zip(right, rank, strict=True)] if r < t}

    @staticmethod
    def _rows(one: np.ndarray, other: np.ndarray, rank: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((other, one))
        return np.searchsorted(one[order], np.arange(most + 1)), other[order], rank[order]

    @staticmethod
    def look(rows: tuple[np.ndarray, np.ndarray, np.ndarray], token: int, others: np.ndarray) -> np.ndarray:
        """Ranks of a token with each of the others, -1 where they are no token."""
        a, b = rows[0][token], rows[0][token + 1]
        if a == b:
            return np.full(len(others), -1, np.int64)
        keys = rows[1][a:b]
        at = np.minimum(np.searchsorted(keys, others), b - a - 1)
        return np.where(keys[at] == others, rows[2][a:b][at], -1)


class _Line:
    """Words one after the other, with gaps; linked neighbours; and the inverted index from a pair's rank to its places."""

    def __init__(self, words: list[bytes], pairs: Pairs) -> None:
        self.pairs = pairs
        size = np.fromiter(map(len, words), np.int64, len(words))
        self.first = np.cumsum(size + 1) - size
        self.last = self.first + size - 1
        units = np.full(int(self.last[-1]) + 2, 256, np.int64)
        inside = np.ones(len(units), bool)
        inside[0] = inside[-1] = inside[self.first - 1] = False
        units[inside] = np.frombuffer(b"".join(words), np.uint8)
        self.token = np.append(pairs.bytes, _GAP).astype(np.int32)[units]
        self.after, self.before = np.arange(1, len(units) + 1, dtype=np.int32), np.arange(-1, len(units) - 1, dtype=np.int32)
        self.current = np.append(pairs.first[units[:-1], units[1:]], np.int32(-1))  # rank of the pair that begins here
        del units, inside
        self.places: dict[int, list[np.ndarray]] = {}
        self.heap: list[int] = []
        at = np.flatnonzero(self.current >= 0).astype(np.int32)
        self.note(self.current[at], at)

    def note(self, ranks: np.ndarray, at: np.ndarray) -> None:
        order = np.argsort(ranks, kind="stable")
        ranks, at = ranks[order], at[order]
        cut = np.flatnonzero(np.diff(ranks, prepend=-1))
        for rank, part in zip(ranks[cut].tolist(), np.split(at, cut[1:]), strict=True) if len(at) else ():
            if rank in self.places:
                self.places[rank].append(part)
            else:
                self.places[rank] = [part]
                heapq.heappush(self.heap, rank)

    def merge(self, rank: int, p: np.ndarray) -> None:
        """Merge the pairs that begin at p, of which no two overlap, and look at the neighbours again."""
        q = self.after[p]
        n = self.after[q]
        self.token[p], self.token[q] = rank, _GONE
        self.current[q] = -1
        self.after[p], self.before[n] = n, p
        m = self.before[p]
        self.current[p] = right = self.pairs.look(self.pairs.with_right, rank, self.token[n])
        self.current[m] = left = self.pairs.look(self.pairs.with_left, rank, self.token[m])
        keep, too = right >= 0, left >= 0
        self.note(np.concatenate([right[keep], left[too]]), np.concatenate([p[keep], m[too]]))

    def run(self) -> None:
        while self.heap:
            rank = heapq.heappop(self.heap)
            p = np.unique(np.concatenate(self.places.pop(rank)))
            p = p[self.current[p] == rank]
            if not len(p):
                continue
            if rank in self.pairs.early:  # a new pair may come first: the first place of each word, then look again
                word = np.searchsorted(self.first, p, "right")
                lead = np.diff(word, prepend=-1) != 0
                self.merge(rank, p[lead])
                self.note(np.full((~lead).sum(), rank), p[~lead])
                continue
            # of overlapping pairs (one token three times or more) the first, the third and so on
            nth = np.arange(len(p))
            alone = np.append(True, self.after[p[:-1]] != p[1:])
            self.merge(rank, p[(nth - np.maximum.accumulate(np.where(alone, nth, 0))) % 2 == 0])

    def ids(self) -> tuple[bytes, list[int]]:
        """All ids, and where each word's end."""
        stay = self.token < _GONE
        return self.token[stay].astype("<u4").tobytes(), (np.cumsum(stay)[self.last] * 4).tolist()


def replay(words: list[bytes], ranks: dict[bytes, int], pairs: Pairs) -> list[bytes]:
    """Ids of each word (unsigned 32-bit, little-endian), by merges over all words in rank order."""
    out = [b""] * len(words)
    rest = []
    for k, word in enumerate(words):
        if (rank := ranks.get(word)) is not None:
            out[k] = rank.to_bytes(4, "little")
        elif word:
            rest.append(k)
    if rest:
        line = _Line([words[k] for k in rest], pairs)
        line.run()
        ids, ends = line.ids()
        for k, i, j in zip(rest, [0, *ends[:-1]], ends, strict=True):
            out[k] = ids[i:j]
    return out


def replayed(words: list[bytes], ranks: dict[bytes, int], pairs: Pairs) -> list[bytes]:
    """replay, over parts of about REPLAYED bytes: words don't touch each other."""
    out, a, size = [], 0, 0
    for b, word in enumerate(words, 1):
        size += len(word)
        if size >= REPLAYED or b == len(words):
            out += replay(words[a:b], ranks, pairs)
            a, size = b, 0
    return out


class Cutter:
    """Cuts texts into pieces by a pattern."""

    def __init__(self, pattern: str) -> None:
        self.known = pattern == KNOWN_PATTERN
        self.any = regex.compile(pattern)
        # a pattern with groups gives its groups in findall, so pieces are whole matches
        self.all = self.any.findall if not self.any.groups else lambda text: [m[0] for m in self.any.finditer(text)]
        if self.known:
            narrow = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{_SPACES}{_LETTERS}{_NUMBERS}]").replace(r"\p{L}", f"[{_LETTERS}]").replace(r"\p{N}", f"[{_NUMBERS}]").replace(r"\S", f"[^{_SPACES}]").replace(r"\s", f"[{_SPACES}]")
            self.narrow = re.compile(narrow).findall

    def cut(self, text: str) -> list[str]:
        if self.known:
            try:
                text.encode("latin-1")
                return self.narrow(text)
            except UnicodeEncodeError:
                pass
        return self.all(text)

    def parts(self, text: str) -> Iterator[list[str]]:
        """The pieces of a text, some at a time if it is long."""
        for part in sections(text) if self.known else (text,):
            yield self.cut(part)


def sections(text: str) -> Iterator[str]:
    """A long text in parts, cut before single spaces, where no piece of KNOWN_PATTERN goes on."""
    at = 0
    while len(text) - at > _LONGEST:
        found = re.compile(r"(?<=\S) (?=\S)").search(text, at + _LONGEST)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:] if at else text


class _Numbers(dict):
    def __missing__(self, piece: str) -> int:
        value = self[piece] = len(self)
        return value


def _values(parts: list[bytes]) -> bytes:
    """Some values as one compressed value."""
    sizes = np.array([len(parts), *map(len, parts)], "<i8").tobytes()
    return zstandard.ZstdCompressor(level=9).compress(b"".join([sizes, *parts]))


def _unvalued(value: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(value)
    n = int.from_bytes(raw[:8], "little")
    ends = np.cumsum(np.frombuffer(raw, "<i8", n, 8)) + 8 * (n + 1)
    return [raw[a:b] for a, b in zip([8 * (n + 1), *ends.tolist()[:-1]], ends.tolist(), strict=True)]


def _planes(x: np.ndarray) -> bytes:
    """Numbers with their lowest bytes first, then the next: this compresses better."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _unplaned(value: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(value, np.uint8).reshape(4, -1).T).view("<u4").ravel()


_TEXTS = -1
_SENT = "block long, bucket int, packet binary"
_NAMES = ["block", "bucket", "packet"]


def _row(block: int, bucket: int, packet: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([bucket], pa.int32()), pa.array([packet], pa.binary())], _NAMES)


def _sender(pattern: str, buckets: int):
    """Texts to blocks: a row of texts as numbers of pieces, and a row of distinct pieces for each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(pattern)
        block = TaskContext.get().partitionId() << 32

        def sent(block: int, docs: list, texts: list[list[np.ndarray]], known: _Numbers) -> Iterator[pa.RecordBatch]:
            counts = np.array([sum(map(len, x)) for x in texts], "<i8")
            numbers = np.concatenate([np.empty(0, np.int64), *(x for text in texts for x in text)]).astype(np.int64)
            order = np.argsort(-np.bincount(numbers, minlength=len(known)), kind="stable")  # frequent pieces get small numbers
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            pieces = list(known)
            pieces = [pieces[i].encode() for i in order.tolist()]
            of = np.fromiter((xxhash.xxh64_intdigest(p) % buckets for p in pieces), "<i4", len(pieces))
            ids = np.array([x or 0 for x in docs], "<i8").tobytes() + bytes(x is None for x in docs)
            yield _row(block, _TEXTS, _values([ids, counts.tobytes(), of.tobytes(), _planes(place[numbers])]))
            by = np.argsort(of, kind="stable")
            cut = np.flatnonzero(np.diff(of[by], prepend=-1))
            for a, b in zip(cut.tolist(), [*cut.tolist()[1:], len(by)][: len(cut)], strict=True):
                yield _row(block, int(of[by[a]]), _values([pieces[i] for i in by[a:b].tolist()]))

        docs, texts, known, size = [], [], _Numbers(), 0
        for batch in batches:
            for doc, body in zip(batch.column(0), batch.column(1), strict=True):
                text = body.as_py().decode("utf-8", "replace")
                docs.append(doc.as_py())
                texts.append([np.fromiter(map(known.__getitem__, pieces), np.uint32, len(pieces)) for pieces in cutter.parts(text)])
                size += len(text)
                if size >= BLOCK:
                    yield from sent(block, docs, texts, known)
                    docs, texts, known, size, block = [], [], _Numbers(), 0, block + 1
        if docs:
            yield from sent(block, docs, texts, known)

    return run


_pairs: dict[bytes, tuple[dict[bytes, int], Pairs]] = {}


def _merges(content: bytes) -> tuple[dict[bytes, int], Pairs]:
    key = hashlib.sha256(content).digest()
    if key not in _pairs:
        _pairs.clear()
        ranks = parse_ranks(content)
        _pairs[key] = (ranks, Pairs(ranks))
    return _pairs[key]


def _replayer(content: bytes):
    """For applyInArrow over a bucket: its distinct pieces are encoded together; ids of the pieces in each packet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        asked: list[tuple[int, int, np.ndarray]] = []
        for batch in batches:
            for block, bucket, packet in zip(*batch.select(_NAMES).columns, strict=True):
                pieces = _unvalued(packet.as_py())
                asked.append((block.as_py(), bucket.as_py(), np.fromiter((known.setdefault(p, len(known)) for p in pieces), np.int32, len(pieces))))
        ids = replayed(list(known), *_merges(content))
        size = np.fromiter(map(len, ids), "<i8", len(ids)) // 4
        for block, bucket, which in asked:
            yield _row(block, bucket, _values([size[which].tobytes(), _planes(np.frombuffer(b"".join([ids[i] for i in which.tolist()]), "<u4"))]))

    return run


def _ranges(first: np.ndarray, times: np.ndarray) -> np.ndarray:
    """first, first + 1, ... for each, `times` of them."""
    return np.repeat(first - np.cumsum(times) + times, times) + np.arange(times.sum())


def _joiner(content: bytes, with_ids: bool):
    """For a cogroup of the texts of a block with the ids of its pieces."""
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()] + [pa.binary()] * with_ids

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        tokens: dict[int, bytes] = {rank: token for token, rank in _merges(content)[0].items()}
        found = {b.as_py(): [x for x in _unvalued(p.as_py())] for b, p in zip(answers.column("bucket"), answers.column("packet"), strict=True)}
        rows: list[tuple] = []
        for packet in texts.column("packet"):
            who, counts, of, numbers = _unvalued(packet.as_py())
            counts, of, numbers = np.frombuffer(counts, "<i8"), np.frombuffer(of, "<i4"), _unplaned(numbers).astype(np.int64)
            ids, null = np.frombuffer(who, "<i8", len(counts)), np.frombuffer(who, np.uint8, offset=8 * len(counts))
            order = np.argsort(of, kind="stable")
            buckets = np.unique(of).tolist()
            size = np.empty(len(of), np.int64)
            size[order] = np.concatenate([np.empty(0, np.int64), *(np.frombuffer(found[b][0], "<i8") for b in buckets)])
            flat = np.concatenate([np.empty(0, "<u4"), *(_unplaned(found[b][1]) for b in buckets)])
            first = np.empty(len(of), np.int64)
            first[order] = np.cumsum(size[order]) - size[order]
            end = np.cumsum(counts)
            a = 0
            while a < len(counts):  # some texts at a time
                b = max(a + 1, int(np.searchsorted(end, end[a] - counts[a] + 500_000, "right")))
                mine = numbers[end[a] - counts[a] : end[b - 1]]
                times = size[mine]
                all_ids = flat[_ranges(first[mine], times)]
                stop = np.append(0, np.cumsum(times))[end[a:b] - (end[a] - counts[a])].tolist()
                for k, i, j in zip(range(a, b), [0, *stop[:-1]], stop, strict=True):
                    own = all_ids[i:j]
                    raw = own.tobytes()
                    decoded = hashlib.sha256()
                    for at in range(0, len(own), 1 << 20):
                        decoded.update(b"".join([tokens[x] for x in own[at : at + (1 << 20)].tolist()]))
                    rows.append((None if null[k] else int(ids[k]), j - i, hashlib.sha256(raw).hexdigest(), decoded.hexdigest(), raw)[: len(names)])
                a = b
        columns = list(zip(*rows, strict=True)) or [()] * len(names)
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return run


def encode(docs: DataFrame, ranks: bytes, pattern: str, doc_id: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """Encode every text and decode it again.

    ranks: content of a file of base64 tokens and ranks.  pattern: how texts are cut before the merges.
    Returns doc_id, n_tokens, ids_sha256, decoded_sha256 and, with_ids, ids (unsigned 32-bit little-endian),
    a row for each input row, rows that repeat included.  Null text is empty, with no ids; null ids stay null.
    Special tokens are ordinary text.  An empty table gives none.  Other columns are not read.  A block sends
    a piece once, however often it stands there, so a frequent piece is no task's burden.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), utf8(text).alias("body"))
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(total) // BUCKET_BYTES))
    # texts meet the ids of their pieces by block: they are written where they are to be joined
    sent = spool_by(rows.mapInArrow(_sender(pattern, buckets), _SENT), "pieces", "block", buckets)
    pieces = sent.where(F.col("bucket") != _TEXTS)
    ids = spool(pieces.groupBy("bucket").applyInArrow(_replayer(ranks), _SENT), "ids")
    release(spark)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids
    return sent.where(F.col("bucket") == _TEXTS).groupBy("block").cogroup(ids.groupBy("block")).applyInArrow(_joiner(ranks, with_ids), schema)
