"""Removal of repeated 13-word windows by super-k-mer partitioning (operator 3).

Consecutive windows that share a minimiser of three words travel as one packed
string to its bucket (see packets), where the windows are sorted by a hash of
their word numbers and neighbours are compared word by word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from webloom.llm import packets
from webloom.llm.packets import BLOCK_BYTES, Chunk, mix, runs, sliding_min

WIDTH = 13
KMER = 3
#: Words of the k-mers by which buckets that are too large are cut again, level by level.
LONGER = (8, 13)
_ODD = (np.arange(1, WIDTH + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
#: Most words a task keeps the hashes of.
_CACHED = 1_000_000


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHED:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def _block(texts: list[tuple[int, int, int, int, list[bytes]]], hashes: _Hashes, chunk: Chunk, kmer: int = KMER) -> None:
    """texts: (id, digest in two halves, number of the first word, words)."""
    words = [w for x in texts for w in x[4]]
    if len(words) < WIDTH:
        return
    count = np.fromiter((len(x[4]) for x in texts), np.int64, len(texts))
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = len(words) - kmer + 1
    mers = np.zeros(n, np.uint64)
    for k in reversed(range(kmer)):
        mers = mix(h[k : k + n] * _ODD[k] + mers)
    least = sliding_min(mers, WIDTH - kmer + 1)
    owner = np.repeat(np.arange(len(texts)), count)
    begin = np.cumsum(count) - count
    first, length = runs(least, owner[: len(least)], owner[: len(least)] == owner[WIDTH - 1 : WIDTH - 1 + len(least)])
    if not len(first):
        return
    raw = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    a, b = (end - size)[first], end[first + length + WIDTH - 2]
    of = owner[first]
    doc, one, two, start = (np.array([x[i] for x in texts], np.int64)[of] for i in range(4))
    chunk.add([raw[i:j] for i, j in zip(a.tolist(), b.tolist(), strict=True)], doc, one, two, start + first - begin[of], length, least[first])


def cutter(kmer: int):
    """Adds strings to a chunk, cut by minimisers of `kmer` words."""

    def cut_again(arrays: list[np.ndarray], strings: list[bytes], chunk: Chunk) -> None:
        doc, one, two, start = (x.tolist() for x in arrays[:4])
        _block(list(zip(doc, one, two, start, (s.split(b" ") for s in strings), strict=True)), _Hashes(), chunk, kmer)

    return cut_again


#: Words of a long text that are taken at once.
_PIECE = 200_000


def cut(documents: Iterable[tuple[int, int, int, bytes]], most: int) -> Iterator[Chunk]:
    """Documents to chunks of strings."""
    hashes, chunk, texts, size = _Hashes(), Chunk(), [], 0
    for doc, one, two, body in documents:
        words = body.split()
        for at in range(0, max(0, len(words) - WIDTH + 1), _PIECE):
            piece = words if len(words) <= _PIECE else words[at : at + _PIECE + WIDTH - 1]
            texts.append((doc, one, two, at, piece))
            size += len(body) if piece is words else sum(map(len, piece))
            if size >= BLOCK_BYTES:
                _block(texts, hashes, chunk)
                texts, size = [], 0
                if chunk.size >= most:
                    yield chunk
                    chunk = Chunk()
    if texts:
        _block(texts, hashes, chunk)
    yield chunk


def covered(strings: list[bytes], doc: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(string, offset) of the 13-word windows that a smaller document has too."""
    words = b" ".join(strings).split(b" ")
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    begin = np.cumsum(windows + WIDTH - 1) - (windows + WIDTH - 1)
    which = np.repeat(np.arange(len(strings)), windows)
    offset = np.arange(len(which)) - np.repeat(np.cumsum(windows) - windows, windows)
    at = begin[which] + offset
    h = np.zeros(len(at), np.uint64)
    mixed = mix(ids.astype(np.uint64) + np.uint64(1))
    for k in range(WIDTH):
        h += mixed[at + k] * _ODD[k]
    order = np.argsort(h, kind="stable")
    equal = h[order[1:]] == h[order[:-1]]
    new = np.append(True, ~equal)
    for k in range(WIDTH):
        new[1:] |= ids[at[order[1:]] + k] != ids[at[order[:-1]] + k]
    if (new[1:] & equal).any():  # two contents with one hash: sort by the words themselves
        order = np.lexsort([ids[at + k] for k in range(WIDTH)])
        new = np.zeros(len(order), bool)
        new[0] = True
        for k in range(WIDTH):
            new[1:] |= ids[at[order[1:]] + k] != ids[at[order[:-1]] + k]
    first = np.flatnonzero(new)
    docs = doc[which[order]]
    least = np.minimum.reduceat(docs, first)
    hit = order[docs > np.repeat(least, np.diff(np.append(first, len(order))))]
    return which[hit], offset[hit]


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, rows = [], []
        for doc, body, spans in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
            ids.append(doc.as_py())
            words = body.as_py().split()
            start, end = packets.union_of(spans.as_py())
            kept, at = [], 0
            for a, b in zip(start.tolist(), end.tolist(), strict=True):
                kept += words[at:a]
                at = b
            kept += words[at:]
            rest = b" ".join(kept)
            rows.append((len(words), len(words) - len(kept), hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "replace")))
        columns = list(zip(*rows, strict=True)) or [()] * 4
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])


def remove_repeated_windows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", most: int | None = None) -> DataFrame:
    """Remove words in 13-word windows that also start in a document with a smaller id.

    Returns doc_id, n_words, n_removed, kept_sha256 and kept (the words that stay, joined by a
    space), a row for each input row.  Words are runs of anything but ASCII white space.  Null text
    has no words.  A null id counts as the largest; rows with the same id take nothing from each
    other.  Texts under 13 words stay.  Other columns are not read, whatever their names.  A bucket with over
    `most` bytes of strings is cut by longer k-mers and dealt anew, so that a frequent minimiser has no task of its own.
    """
    spans = packets.find_spans(docs, doc_id, text, cut, [cutter(k) for k in LONGER], covered, None, WIDTH, growth=3.0, most=most)
    return packets.with_spans(docs, spans, doc_id, text).mapInArrow(_cleaned, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
