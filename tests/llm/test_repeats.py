import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import types as T

from tests.llm import brute
from webloom.llm import packets, substring_dedup, suffix_dedup
from webloom.llm.common import row_keys, unique_ids
from webloom.llm.line_dedup import remove_boilerplate
from webloom.llm.substring_dedup import remove_repeated_windows
from webloom.llm.suffix_dedup import remove_repeated_bytes

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("bucket", T.IntegerType())])


def fixture_rows(seed=5):
    r = random.Random(seed)
    vocabulary = ["the", "of", "été", "on", "and", "in", "erth", "naïve", "rain", "x"]
    passage = " ".join(r.choice(vocabulary) for _ in range(70))
    rows = []
    for i in range(60):
        words = [r.choice(vocabulary) + str(r.randrange(4)) for _ in range(r.randrange(0, 60))]
        text = " ".join(words)
        if i % 3 == 0:
            text = text[:40] + passage[r.randrange(10) : 200 + r.randrange(60)] + "\n" + text[40:]
        rows.append((i * 7 % 61, text))
    rows += [(100, rows[3][1]), (101, rows[3][1]), (-5, rows[7][1]), (None, rows[9][1]), (None, rows[9][1]), (None, passage * 3), (200, None), (201, ""), (202, "ab " * 900), (203, "ab " * 700), (202, "ab " * 900), (204, "a" * 49), (205, "a" * 50), (206, "a" * 51), (205, passage)]
    return rows


@pytest.mark.parametrize("letters", [1, 2, 5])
@pytest.mark.parametrize("n", [0, 1, 49, 50, 51, 60, 400])
def test_levels_rank_all_strings_of_fifty_bytes(n, letters):
    """The four sorts one after the other, without a cluster: ranks of all 50-byte strings are those of their contents."""
    r = random.Random(n + letters)
    text = lambda k: bytes(r.choice(b"\x00ab\xffz"[:letters]) for _ in range(k))
    strings = [text(r.randrange(n + 1)) for _ in range(12)] + [text(n)]
    strings += [x[r.randrange(9) :] for x in strings]
    number = np.arange(len(strings))
    seg = suffix_dedup.Segments(number, number, number, number, strings)
    names = np.zeros(len(seg.data), np.int64)
    for level in (suffix_dedup.Triples(), suffix_dedup.Bottom(), suffix_dedup.Sample(), suffix_dedup.Text()):
        at, fields = level.keys(seg, names)
        order, rank = level.order(fields)
        content = [seg.raw[i : i + level.depth] for i in at.tolist()]
        place = {c: i for i, c in enumerate(sorted(set(content)))}
        assert rank.tolist() == [place[c] for c in content]
        assert (np.diff(rank[order]) >= 0).all()
        names = np.zeros(len(seg.data), np.int64)
        names[at] = rank


def run(spark, rows, f, columns):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA).repartition(3)
    return sorted((tuple(x) for x in f(df).select(*columns).collect()), key=repr)


def test_repeated_bytes(spark):
    rows = fixture_rows()
    got = run(spark, rows, remove_repeated_bytes, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
    assert got == sorted(brute.op1(rows), key=repr)


def test_repeated_windows(spark):
    rows = fixture_rows(6)
    got = run(spark, rows, remove_repeated_windows, ["doc_id", "n_words", "n_removed", "kept_sha256"])
    assert got == sorted(brute.op3(rows), key=repr)


def found_by_packets(module, rows, width, most):
    """Bytes or words removed by document, by the steps without Spark; levels as find_spans takes them."""
    digest = [bytes(15) + bytes([1])] * len(rows)
    batch = pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows], pa.int64()), pa.array(digest, pa.binary()), pa.array([(t or "").encode() for _, t in rows], pa.binary())], ["doc", "digest", "body"])
    sent = list(packets.mapper(module.cut, 1, width)(iter([batch])))
    levels, spans = 0, []
    for cut_again in [*map(module.cutter, module.LONGER), None]:
        out = [r for b in packets.reducer(module.covered, None if levels else getattr(module, "near", None), cut_again, width, 1, most)(iter(sent)) for r in b.to_pylist()]
        spans += [r["packet"] for r in out if r["kind"] == packets._SPANS]
        sent = [packets._row(**r) for r in out if r["kind"] == packets._STRINGS]
        levels += 1
        if not sent:
            break
    found = packets.merge_part(pa.table({"packet": pa.array(spans, pa.binary())})).to_pylist() if spans else []
    return {r["doc"]: int(np.subtract(*packets.union_of(r["spans"])[::-1]).sum()) for r in found}, levels


@pytest.mark.parametrize(("module", "width", "plain"), [(substring_dedup, 13, brute.op3)])
@pytest.mark.parametrize("most", [10**9, 3000, 500])
def test_small_blocks_and_large_buckets(monkeypatch, module, width, plain, most):
    """The steps without Spark: texts in small pieces, chunks of a few strings, one bucket that is cut again."""
    monkeypatch.setattr(module, "BLOCK_BYTES", 120)
    monkeypatch.setattr(packets, "CHUNK_BYTES", 900)
    monkeypatch.setattr(packets, "MOST_CHUNK_BYTES", 900)
    monkeypatch.setattr(packets, "MAX_RUN", 7)
    if module is substring_dedup:
        monkeypatch.setattr(module, "_PIECE", 29)
    rows = [(d, t) for i, (d, t) in enumerate(fixture_rows(7)) if d is not None and d not in [x for x, _ in fixture_rows(7)[:i]]]
    found, levels = found_by_packets(module, rows, width, most)
    assert found == {r[0]: r[2] for r in plain(rows) if r[2]}
    assert levels == (1 if most > 10**6 else 3)


def test_a_frequent_minimiser_with_different_neighbours(spark):
    """Half the rows have one phrase between words of their own, so their strings differ and meet in one bucket."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    rows = [(i, " ".join([*(word() for _ in range(9)), *(["under the terms of this licence you may"] if i % 2 else []), *(word() for _ in range(9))])) for i in range(300)]
    rows += [(1000 + i, rows[i][1]) for i in range(0, 300, 29)]
    columns = ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert run(spark, rows, lambda df: remove_repeated_windows(df, most=2000), columns) == sorted(brute.op3(rows), key=repr)


def test_one_passage_in_half_the_texts(spark, monkeypatch):
    """Small blocks and ranges: a passage of 50 bytes and more is one key from each block."""
    monkeypatch.setattr(packets, "BUCKET_BYTES", 3000)
    monkeypatch.setattr(packets, "STRETCH", 5)
    r = random.Random(8)
    letters = lambda n: "".join(r.choice("abcdé ") for _ in range(n))
    passage = letters(90)
    rows = [(i, letters(r.randrange(90)) + passage[r.randrange(30) : r.randrange(60, 91)] * (i % 2) + letters(r.randrange(60))) for i in range(120)]
    rows += [(500 + i, rows[i * 7][1]) for i in range(12)] + [(600, "ab" * 400), (601, "ba" * 300), (602, "a" * 300)]
    assert run(spark, rows, remove_repeated_bytes, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]) == sorted(brute.op1(rows), key=repr)


def test_null_ids_and_the_largest_id(spark):
    text = "the same text of more than fifty bytes, and of more than thirteen words in all, stands here"
    rows = [(2**63 - 1, text), (None, text), (None, text + " x"), (4, text), (2**63 - 1, "y " + text)]
    assert run(spark, rows, remove_repeated_windows, ["doc_id", "n_words", "n_removed", "kept_sha256"]) == sorted(brute.op3(rows), key=repr)
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA)
    assert df.select(*row_keys()).distinct().count() == 5


def test_empty_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert remove_repeated_bytes(df).collect() == []
    assert remove_repeated_windows(df).collect() == []


def test_long_runs_are_divided():
    least = np.zeros(5000, np.uint64)
    first, length = packets.runs(least, np.zeros(5000, int), np.ones(5000, bool))
    assert length.sum() == 5000 and length.max() <= packets.MAX_RUN and first.tolist() == [0, 2048, 4096]


def test_phrases_that_stand_several_times(spark):
    """One text has a phrase several times, the other only the end of it and what follows."""
    rows = []
    for period in (17, 23, 29, 35):
        r = random.Random(period)
        letters = lambda n, r=r: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
        for i in range(40):
            phrase, rest = letters(period), letters(60)
            pair = [letters(30) + phrase * r.randrange(2, 5) + rest, letters(40) + (phrase * 2)[-r.randrange(16, 35) :] + rest[: r.randrange(34, 61)] + letters(30)]
            rows += [(1000 * period + 2 * i + j, t) for j, t in enumerate(r.sample(pair, 2))]
    assert run(spark, rows, remove_repeated_bytes, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]) == sorted(brute.op1(rows), key=repr)


def test_rows_without_ids_whose_hashes_agree_in_31_bits(spark):
    passage, other = "".join(map(chr, range(65, 125))), "".join(map(chr, range(124, 64, -1)))
    low = lambda t: xxhash.xxh64_intdigest(t.encode(), 42) & 0x7FFFFFFF
    by_hash = {low(t): t for t in (f"{passage}\n{i}" for i in range(200_000))}
    b = next(t for t in (f"{other}\n{i}" for i in range(200_000)) if low(t) in by_hash)
    a = by_hash[low(b)]
    rows = [(1, passage), (None, a), (None, b)]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA)
    assert df.select(*row_keys()).distinct().count() == 3
    assert run(spark, rows, remove_repeated_bytes, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]) == sorted(brute.op1(rows), key=repr)
    sites = spark.createDataFrame([(d, t, s) for s, (d, t) in [(f"s{i}", (i, passage)) for i in range(12)] + [("s0", (None, a)), ("s0", (None, b))]], "doc_id long, text string, source string")
    cleaned, _, gone = remove_boilerplate(sites)
    assert sorted(r[gone] for r in cleaned.where("doc_id IS NULL").collect()) == [0, 1]


def test_strings_that_are_left_are_few_packets(spark, monkeypatch):
    """A packet for each bucket and level, not for each bucket and part of texts, whose number grew with the square of the size (F1)."""
    monkeypatch.setattr(packets, "BUCKET_BYTES", 3000)
    left = []

    def sorted_spans(df, buckets, whole=suffix_dedup._sorted_spans):
        left.append((df.count(), len({r[0] for r in df.select("bucket").collect()}), buckets))
        return whole(df, buckets)

    monkeypatch.setattr(suffix_dedup, "_sorted_spans", sorted_spans)
    rows = fixture_rows(9)
    columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert run(spark, rows, remove_repeated_bytes, columns) == sorted(brute.op1(rows), key=repr)
    sized = -(-int(sum(len((t or "").encode()) for _, t in rows) * 3.7) // 3000)
    count, _, buckets = left[0]
    assert count <= 3 * max(8, sized) and buckets <= max(8, sized // 4)


@pytest.mark.parametrize("kmer", [16, 32, 50])
def test_only_windows_that_may_be_shared_are_left(kmer):
    """Of two texts that agree on some bytes around a minimiser all common windows stay, and nothing where it is 40 bytes (F1)."""
    r = random.Random(kmer)
    letters = lambda n: bytes(r.choice(b"abcdefghijklmnop") for _ in range(n))
    hashes = lambda t: suffix_dedup.kmer_hashes(suffix_dedup.eights(np.frombuffer(t, np.uint8)), len(t), kmer)
    slack, tried = 50 - kmer, 0
    while tried < 60:
        text = letters(50 + slack)  # all of its windows hold what is in the middle
        common = r.choice([40, 50, 53, 60])
        a = r.randrange(max(1, 50 + slack - common + 1))
        other = letters(a) + text[a : a + common] + letters(max(0, 50 + slack - a - common))
        if hashes(text).argmin() != slack or hashes(other).argmin() != slack or hashes(text).min() != hashes(other).min():
            if kmer < 50 or common >= 50:
                continue
        tried += 1
        which, first, count = suffix_dedup.shared(kmer)([text, other], np.array([1, 2]))
        got = {(i, k) for i, f, n in zip(which.tolist(), first.tolist(), count.tolist(), strict=True) for k in range(f, f + n)}
        want = {(i, k) for k in range(slack + 1) if text[k : k + 50] == other[k : k + 50] for i in (0, 1)}
        assert got >= want
        assert common > 40 or got == want == set()


def test_no_digests_in_packets_where_ids_are_unique(spark):
    """Ids that stand in one row each need no digest beside them; null ids keep theirs (op1's disk)."""
    rows = fixture_rows(11)
    rows = [(d, t) for i, (d, t) in enumerate(rows) if d is None or d not in [x for x, _ in rows[:i]]]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA)
    assert unique_ids(df, "doc_id") and not unique_ids(df.union(df), "doc_id")
    found = df.select("doc_id", row_keys(unique=True)[1].alias("digest")).collect()
    assert all((bytes(r.digest) == bytes(16)) == (r.doc_id is not None) for r in found)
    columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert run(spark, rows, remove_repeated_bytes, columns) == sorted(brute.op1(rows), key=repr)
