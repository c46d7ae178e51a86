"""SimHash near-duplicates with vantage-point trees (operator 6).

Different fingerprints are divided by their distances from vantage points.  A
fingerprint goes to the near side of a vantage point if its distance is at most the
radius, else to the far side, and to the near side as well if it is within 3 of the
radius: by the triangle inequality no pair is lost.  Shards hold the leaves of the
upper tree; one that is too large is divided by a tree of its own and dealt to tasks
anew.  In a shard the division goes on until sets are small enough to compare.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import row_keys, spool, utf8

BITS = 3
SEED = 42
SHINGLE = 3
#: Fingerprints that the upper tree is fitted on (about), those meant for a shard, most levels of the upper tree.
SAMPLE, SHARD, LEVELS = 400_000, 8192, 16
#: Shards with more than so many times SHARD fingerprints are divided again, in so many rounds at most.
LARGE, ROUNDS = 4, 8
#: Copies of a fingerprint's row when it is joined to documents, so that those of one fingerprint go to several tasks.
SALTS = 8
#: Sets of this size are compared directly.
SMALL = 512
_BLOCK = 100_000


def _shingle_hashes(words: list[bytes]) -> list[int]:
    digest = xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        return [digest(b" ".join(words), SEED)] if words else []
    return [digest(s, SEED) for s in map(b" ".join, zip(words, words[1:], words[2:], strict=False))]


class _Counter:
    """Adds up the bits of hashes, a block at a time, so that a long text needs no more memory."""

    def __init__(self) -> None:
        self.n, self.bits = 0, np.zeros(64, np.int64)

    def add(self, hashes: np.ndarray) -> None:
        for a in range(0, len(hashes), _BLOCK):
            part = hashes[a : a + _BLOCK].astype(">u8").view(np.uint8).reshape(-1, 8)
            self.bits += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
            self.n += len(part)


def fingerprints(texts: list[bytes]) -> np.ndarray:
    """A 64-bit fingerprint of each text, as uint64."""
    out = np.zeros(len(texts), np.uint64)
    weights = np.uint64(1) << np.arange(63, -1, -1, dtype=np.uint64)
    group: list[int] = []
    counts: list[int] = []
    at: list[int] = []

    def flush() -> None:
        if not group:
            return
        bits = np.unpackbits(np.array(group, np.uint64).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        n = np.array(counts)
        total = np.add.reduceat(bits, np.cumsum(n) - n, axis=0, dtype=np.int32)
        out[at] = ((2 * total > n[:, None]) * weights).sum(axis=1, dtype=np.uint64)
        group.clear(), counts.clear(), at.clear()

    for i, body in enumerate(texts):
        words = body.lower().split()
        if len(words) > _BLOCK:
            counter = _Counter()
            for a in range(0, len(words) - SHINGLE + 1, _BLOCK):
                counter.add(np.array(_shingle_hashes(words[a : a + _BLOCK + SHINGLE - 1]), np.uint64))
            out[i] = ((2 * counter.bits > counter.n) * weights).sum(dtype=np.uint64)
            continue
        if hashes := _shingle_hashes(words):
            group += hashes
            counts.append(len(hashes))
            at.append(i)
            if len(group) >= _BLOCK:
                flush()
    flush()
    return out


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = fingerprints(batch.column(3).to_pylist()).view(np.int64)
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.int64())], ["doc_id", "doc", "digest", "fp"])


def distance(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    return np.bitwise_count(a ^ b)


@dataclass
class Node:
    """A vantage point with its radius, or a leaf with its number."""

    point: int = 0
    radius: int = 0
    near: Node | None = None
    far: Node | None = None
    leaf: int = -1


def choose(points: np.ndarray) -> tuple[int, int] | None:
    """The vantage point and radius, of a few, that divide best: few in both parts, neither part too large."""
    best, least = None, 0.97
    sample = points[:: max(1, len(points) // 2000)]
    for v in points[np.linspace(0, len(points) - 1, 8).astype(int)]:
        below = np.cumsum(np.bincount(distance(sample, v), minlength=65 + BITS)) / len(sample)
        for radius in range(64):
            near, far = below[radius + BITS], 1 - below[radius]
            # pairs to compare at the next level, where one part is compared with itself
            cost = near * near + far * far
            if 0 < far < 1 and near < 1 and cost < least:
                best, least = (int(v), radius), cost
    return best


def grow(points: np.ndarray, levels: int, leaves: list[int]) -> Node:
    """The upper tree over a sample; each level has about twice the parts."""
    found = choose(points) if levels and len(points) >= 64 else None
    if not found:
        leaves.append(len(leaves))
        return Node(leaf=leaves[-1])
    d = distance(points, np.uint64(found[0]))
    near = grow(points[d <= found[1] + BITS], levels - 1, leaves)
    return Node(*found, near, grow(points[d > found[1]], levels - 1, leaves))


def route(points: np.ndarray, node: Node) -> Iterator[tuple[int, np.ndarray]]:
    """(leaf, points) of all leaves that the points go to."""
    if node.leaf >= 0 or not len(points):
        if len(points):
            yield node.leaf, points
        return
    d = distance(points, np.uint64(node.point))
    yield from route(points[d <= node.radius + BITS], node.near)
    yield from route(points[d > node.radius], node.far)


def _stars(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of each point to the least one of its component, among few points."""
    close = distance(points[:, None], points[None, :]) <= BITS
    if close.sum() == len(points):
        return points[:0], points[:0]
    label = np.arange(len(points))
    while True:
        new = np.where(close, label[None, :], len(points)).min(axis=1)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(points)))
    return points[moved], points[label[moved]]


def _spread(points: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that connect all pairs within BITS, where nothing divides the points: what is in reach is taken, and goes on from there.

    A point is compared with those alone that nothing has reached, so a dense set costs little: it is soon in reach as a whole.
    """
    rest = points
    while len(rest):
        wave, rest = rest[:1], rest[1:]
        while len(wave) and len(rest):
            reached = []
            for a in range(0, len(wave), 64):
                close = distance(wave[a : a + 64, None], rest[None, :]) <= BITS
                hit = close.any(axis=0)
                if hit.any():
                    yield rest[hit], wave[a + close[:, hit].argmax(axis=0)]
                    reached.append(rest[hit])
                    rest = rest[~hit]
                if not len(rest):
                    break
            wave = np.concatenate(reached) if reached else rest[:0]


def links(points: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that connect all pairs within BITS, for different points; stars, not all pairs."""
    if len(points) <= SMALL:
        yield _stars(points)
        return
    found = choose(points)
    if not found:
        yield from _spread(points)
        return
    d = distance(points, np.uint64(found[0]))
    yield from links(points[d <= found[1] + BITS])
    yield from links(points[d > found[1]])


def _router(tree: Node):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def packed() -> pa.RecordBatch:
            found = list(route(np.concatenate(held).view(np.uint64), tree))
            return _packed(found)

        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False))
            if sum(map(len, held)) >= 500_000:
                yield packed()
                held.clear()
        if held:
            yield packed()

    return run


_FOUND = "leaf long, points binary, u long, v long"


def _packed(found: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1].tobytes() for x in found], pa.binary())], ["leaf", "points"])


def _linker(most: int | None):
    """For applyInArrow over a leaf: its links; or, where it has over `most` points and can be divided, new leaves."""

    def run(table: pa.Table) -> pa.Table:
        points = np.unique(np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in table.column("points")]))
        if most is not None and len(points) > most:
            leaves: list[int] = []
            tree = grow(points, int(np.ceil(np.log2(len(points) / most))) + 1, leaves)
            if len(leaves) > 1:
                leaf = table.column("leaf")[0].as_py()
                named = [(xxhash.xxh64_intdigest(f"{leaf}/{k}") >> 1, some) for k, some in route(points, tree)]
                empty = [pa.nulls(len(named), pa.int64())] * 2
                return pa.table([*_packed(named).columns, *empty], ["leaf", "points", "u", "v"])
        pairs = [np.stack(x) for x in links(points) if len(x[0])]
        a, b = (np.unique(np.concatenate(pairs, axis=1), axis=1) if pairs else np.empty((2, 0), np.uint64)).view(np.int64)
        return pa.table([pa.nulls(len(a), pa.int64()), pa.nulls(len(a), pa.binary()), pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["leaf", "points", "u", "v"])

    return run


def _all_links(shards: DataFrame, most: int) -> DataFrame:
    """(u, v) of all leaves. Those that are too large come back divided, and are dealt again."""
    edges = None
    for k in range(ROUNDS + 1):
        out = spool(shards.groupBy("leaf").applyInArrow(_linker(most if k < ROUNDS else None), _FOUND), "links")
        found, shards = out.where(F.col("points").isNull()).select("u", "v"), out.where(F.col("points").isNotNull()).select("leaf", "points")
        edges = found if edges is None else edges.unionByName(found)
        if shards.isEmpty():
            break
    return edges


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(u, root) of all nodes in edges (u > v) but the roots: the least node of each component, by stars.

    Each round links the neighbours of a node to the least of them, first the larger ones, then the smaller
    ones; edges never become more, and rounds go with the logarithm of a component's size.
    """
    edges = spool(edges.distinct(), "edges")
    before = _state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = spool(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v"))
        edges = spool(large.distinct(), "large")
        least = spool(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
        joined = edges.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
        edges = spool(small.where(F.col("u") != F.col("v")).distinct(), "small")
        after = _state(edges)
        if after == before:
            return edges.select("u", F.col("v").alias("root"))
        before = after


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shard: int = SHARD) -> DataFrame:
    """Components of texts whose fingerprints differ in at most three bits.

    Returns doc_id, fingerprint (16 hexadecimal digits), component_id (least id in reach), keeper (whether
    the row is the one of its component that stays), doc and digest (the row's key), a row for each input
    row.  Null text has no words; texts with none have fingerprint 0 and are linked like any other.  A null
    id counts as the largest, and a component with no other has a null component_id.  Rows that repeat the id
    and text of a keeper are keepers too.  Equal fingerprints are one before they are compared, so a group of
    copies is a point.  The upper tree is fitted on about SAMPLE fingerprints, a quarter of them at most (those with small hashes); it decides
    how work is divided, not what is found.
    """
    key, digest = row_keys(doc_id, text)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), key.alias("doc"), digest.alias("digest"), utf8(text).alias("body"))
    prints = spool(rows.mapInArrow(_fingerprint, "doc_id long, doc long, digest binary, fp long"), "fingerprints")
    each = spool(prints.groupBy("fp").agg(F.min(F.struct("doc", "digest")).alias("first"), F.min("doc_id").alias("id")), "points")
    n = each.count()
    levels = min(LEVELS, max(0, int(np.ceil(np.log2(max(1, n) / shard)))))
    # chosen by hash: the same in every run, and no more rows from many tasks than from few
    share = int(min(0.25, SAMPLE / max(1, n)) * 2**31)
    sample = [r[0] for r in each.where(F.pmod(F.xxhash64("fp"), F.lit(2**31)) < share).select("fp").collect()] if levels else []
    tree = grow(np.sort(np.array(sample, np.int64)).view(np.uint64), levels, [])
    shards = each.select("fp").mapInArrow(_router(tree), "leaf long, points binary")
    found = components(_all_links(shards, LARGE * shard))
    member = each.join(found, F.col("fp") == F.col("u"), "left").select("fp", "first", "id", F.coalesce("root", "fp").alias("root"))
    member = spool(member, "members")
    least = spool(member.groupBy("root").agg(F.min("first").alias("least"), F.min("id").alias("id")), "least")
    named = spool(member.join(least, "root").select("fp", least["least"], least["id"]), "named")
    salted = named.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    result = prints.withColumn("salt", F.pmod(F.xxhash64("doc", "digest"), F.lit(SALTS)).cast("int")).join(salted, ["fp", "salt"])
    keeper = (F.col("doc") == F.col("least.doc")) & (F.col("digest") == F.col("least.digest"))
    return result.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("id").alias("component_id"), keeper.alias("keeper"), "doc", "digest")
