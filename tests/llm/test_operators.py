import base64
import functools
import hashlib
import io
import itertools
import json
import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tests.llm import brute
from webloom.llm import bpe, decontamination, pii, quality, sharding, simhash, warc
from webloom.llm.line_dedup import remove_boilerplate
from webloom.llm.queries import tokenizer

DOCS = T.StructType([T.StructField(n, k) for n, k in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_words", T.IntegerType()), ("doc", T.StringType()), ("digest", T.StringType()), ("pos", T.StringType()), ("h1", T.LongType()))])


def docs(spark, rows, parts=3):
    """rows: (doc_id, text) or (doc_id, text, lang, source); with columns whose names clash."""
    return spark.createDataFrame([(*r, *("en", "s")[len(r) - 2 :], 1, "x", "y", "z", 3) if len(r) < 4 else (*r, 1, "x", "y", "z", 3) for r in rows], DOCS).repartition(parts)


def text_rows(seed=3, n=80):
    r = random.Random(seed)
    vocabulary = [a + b for a in ("th", "er", "ó", "in", "Ou") for b in ("e", "on", "ing", "ß")]
    rows = []
    for i in range(n):
        words = [r.choice(vocabulary) for _ in range(r.randrange(1, 60))]
        rows.append((i, r.choice((" ", "\n", "\t")).join(words)))
        if i % 4 == 0:
            words[r.randrange(len(words))] += "x"
            rows.append((1000 + i, " ".join(words)))
    return rows + [(5, rows[5][1]), (None, None), (None, "a b"), (7777, None), (7778, ""), (7779, " \n "), (7780, "one two"), (7781, "one two"), (7782, "word " * 5000), (7783, "x" * 30000)]


def got(df, *columns):
    return sorted((tuple(x) for x in df.select(*columns).collect()), key=repr)


# 2


def contamination_tables():
    r = random.Random(1)
    words = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(r.choice(words) for _ in range(r.choice((1, 2, 3, 5, 9, 10, 11, 25))))) for i in range(25)]
    items += [(3, items[3][1]), (77, items[3][1]), (None, "alone here"), (80, None), (81, "...")]
    rows = []
    for i in range(60):
        text = [r.choice(words) for _ in range(r.randrange(40))]
        if i % 3 == 0:
            text[5:5] = items[r.randrange(25)][1].upper().split()
        rows.append((i, "-".join(text)))
    return rows + [(None, items[20][1]), (None, None), (5, items[21][1]), (99, ("w1 " * 3000))], items


@pytest.mark.parametrize("bits", [decontamination.MOST_BITS, 6])
def test_contamination(spark, monkeypatch, bits):
    """Also with a filter that lets all through."""
    monkeypatch.setattr(decontamination, "MOST_BITS", bits)
    monkeypatch.setattr(decontamination, "_BLOCK_BYTES", 900)
    monkeypatch.setattr(decontamination, "_SLICE", 70)
    rows, items = contamination_tables()
    rows += [(2**63 - 1, rows[3][1]), (2**63 - 1, "q " + rows[3][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = decontamination.find_contamination(docs(spark, rows), bench)
    want = brute.op2(rows, [("" if i is None else i, t) for i, t in items])
    assert got(df, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == sorted(want, key=repr)
    assert any(w[2] for w in want)


def test_contamination_of_nothing(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    rows, items = contamination_tables()
    assert {r.n_hit for r in decontamination.find_contamination(docs(spark, rows), none).collect()} == {0}
    assert decontamination.find_contamination(docs(spark, []), spark.createDataFrame(items, "item_id long, text string")).collect() == []


# 4


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="ab0123456789@.-+ ()%é_", max_size=60))
def test_base_spans(text):
    assert [(a, b, k) for a, b, k, base in pii.spans(text) if base] == brute.op4(text)


def test_more_spans():
    text = 'x token = "24be64439e3e49cf46b2d7c90f3602a3" y IBAN: GB82 WEST 1234 5698 7654 32. SSN 123-45-6789 ftp://joe:pw@host.example/a http://host/a@b'
    assert [(text[a:b], k) for a, b, k, base in pii.spans(text) if not base] == [("24be64439e3e49cf46b2d7c90f3602a3", "secret"), ("GB82 WEST 1234 5698 7654 32", "iban"), ("123-45-6789", "ssn"), ("ftp://joe:pw@host.example/a", "url")]
    assert [s for s in pii.spans("the token economy, an account of ibanez, ssn unknown, http://plain.example/") if not s[3]] == []


def test_accounts_are_marked_to_their_end():
    r = random.Random(4)
    for size, country in ((22, "DE"), (27, "FR"), (31, "MT"), (20, "ZZ")):
        for _ in range(300):
            own = "".join(r.choice("0123456789") for _ in range(size - 4))
            check = 98 - int(own + "".join(str(int(c, 36)) for c in country) + "00") % 97
            number = f"{country}{check:02}{own}"
            for form in (number, " ".join(number[i : i + 4] for i in range(0, size, 4))):
                text = f"IBAN: {form}, as above"
                assert [text[a:b] for a, b, k, _ in pii.spans(text) if k == "iban"] == [form]


def test_long_addresses_are_marked_to_their_end():
    text = "x ftp://joe:pw@host.example/" + "a" * 9000 + " y"
    assert [(a, b) for a, b, k, _ in pii.spans(text) if k == "url"] == [(2, len(text) - 2)]
    begin = time.process_time()
    assert [s for s in pii.spans("http://" * 60000) if s[2] == "url"] == []
    assert time.process_time() - begin < 10


def test_personal_data(spark):
    rows = [(1, "mail joe.x@mail.example.com or +1 (743) 555-3824"), (None, None), (2, ""), (3, "4111 1111 1111 1111 at 10.0.0.1" + " 1" * 5000), (1, "mail joe.x@mail.example.com or +1 (743) 555-3824")]
    found = got(pii.find_personal_data(docs(spark, rows)), "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")
    want = []
    for d, t in rows:
        base = brute.op4(t or "")
        n = Counter(k for _, _, k in base)
        want.append((d, n["email"], n["ip"], n["card"], n["phone"], brute.sha(",".join(f"{k}:{a}:{b}" for a, b, k in base).encode())))
    assert found == sorted(want, key=repr)
    assert pii.find_personal_data(docs(spark, [])).collect() == []
    more = pii.find_personal_data(docs(spark, [(1, "SSN 123-45-6789, token = 24be64439e3e49cf46b2d7c90f3602a3 and ftp://joe:pw@host.example/a")])).first()
    assert (more.n_ssn, more.n_secret, more.n_url, more.n_iban) == (1, 1, 1, 0)


# 5


def test_quality_counts(spark):
    rows = text_rows() + [(8000, "a b c d e f g h i j a b c d e f\n" * 3), (8001, "# * $ & | < > % é\n\n#\n#\n \n ")]
    df = quality.assess(docs(spark, rows))
    assert got(df, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == sorted(((d, *brute.op5(t)) for d, t in rows), key=repr)
    assert all(not (r.base_failed and r.kept) for r in df.collect())
    assert quality.assess(docs(spark, [])).collect() == []


def test_many_distinct_words_repeat():
    ids = np.array([*range(5000), *range(10, 20)])
    assert quality.repeated_words(ids, 5000) == 20
    assert quality.repeated_words(np.zeros(7, np.int64), 1) == 7


def test_outliers_go_and_clean_texts_stay(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 9)))
    clean = [(i, " ".join(word() for _ in range(60)).capitalize() + ".", "en" if i % 3 else None, f"s{i % 2}") for i in range(300)]
    junk = [(1000 + i, " ".join(word().upper() + "###" for _ in range(60)), "en", f"s{i % 2}") for i in range(12)]
    rare = [(2000, " ".join(word() for _ in range(60)), "xx", "one")]
    kept = {x.doc_id: x.kept for x in quality.assess(docs(spark, clean + junk + rare)).collect()}
    assert all(kept[i] for i in range(300)) and not any(kept[1000 + i] for i in range(12)) and kept[2000]


def features_of(text):
    n, chars, symbols, _, _, distinct, capitals, punctuation = quality.counts(text.encode())
    return [np.log(chars / n), np.sqrt(symbols / chars), np.log(distinct / n), np.sqrt(capitals / chars), np.sqrt(punctuation / chars)]


def test_distances_are_those_of_a_plain_estimate(spark):
    """Groups of their own, with outliers and with many ties; a group's distances agree with the plain estimate, and so do verdicts."""
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 9)))
    rows = []
    for i in range(360):
        words = [word() for _ in range(r.randrange(40, 90))]
        text = " ".join(words).capitalize() + "." * r.randrange(3)
        if i % 31 == 7:
            text = " ".join(w.upper() + "#$" for w in words)
        rows.append((i, text, "en", f"s{i % 3}"))
    rows += [(1000 + i, rows[0][1], "en", "s0") for i in range(90)]
    found = {x.doc_id: x for x in quality.assess(docs(spark, rows)).collect()}
    for source in ("s0", "s1", "s2"):
        mine = [x for x in rows if x[3] == source and not found[x[0]].base_failed]
        assert {found[x[0]].group for x in mine} == {json.dumps({"lang": "en", "source": source}, separators=(",", ":"))}
        words = np.array([len(x[1].split()) for x in mine])
        plain = np.sqrt(brute.mcd(np.array([features_of(x[1]) for x in mine]), np.array(quality.FLOORS), quality.SHARE, quality.MEDIAN) * words / (words + quality.SHORT))
        own = np.array([found[x[0]].distance for x in mine])
        assert np.abs(np.log(own / plain)).max() < 0.15
        assert [bool(found[x[0]].kept) for x in mine] == (plain <= quality.CUT).tolist()
        assert 0 < (plain > quality.CUT).sum() < 20
    small = quality.assess(docs(spark, rows), least_rows=500).collect()
    assert {x.group for x in small if not x.base_failed} == {None}


# 6


def test_simhash(spark):
    rows = text_rows()
    want = brute.op6(rows)
    assert got(simhash.near_duplicates(docs(spark, rows), shard=8), "doc_id", "fingerprint", "component_id") == sorted(want, key=repr)
    kept = [r for r in simhash.near_duplicates(docs(spark, rows)).collect() if r.keeper]
    assert len({r.component_id for r in kept}) == len({w[2] for w in want})
    assert simhash.near_duplicates(docs(spark, [])).collect() == []


def test_long_texts_have_the_same_fingerprint(monkeypatch):
    text = " ".join(f"w{i % 977}" for i in range(5000)).encode()
    whole = simhash.fingerprints([text, b"", b"One"])
    monkeypatch.setattr(simhash, "_BLOCK", 700)
    assert (simhash.fingerprints([text, b"", b"One"]) == whole).all()
    assert int(whole[0]) == brute.fingerprint(text.decode())


@pytest.mark.parametrize("small", [4, 64])
def test_links_lose_no_pair(monkeypatch, small):
    monkeypatch.setattr(simhash, "SMALL", small)
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    flips = [base]
    for _ in range(6):
        b = rng.choice(base, 40)
        for _ in range(2):
            b = b ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64))
        flips.append(b)
        base = np.concatenate([base, b])
    points = np.unique(np.concatenate([*flips, np.arange(40, dtype=np.uint64)]))
    label = {int(p): int(p) for p in points}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for tree_points in (points, points[::3]):
        tree = simhash.grow(tree_points, 3, [])
        for _, shard in simhash.route(points, tree):
            for a, b in simhash.links(shard):
                for x, y in zip(a.tolist(), b.tolist()):
                    label[find(x)] = find(y)
    for i, p in enumerate(points):
        for q in points[simhash.distance(points, p) <= 3]:
            assert find(int(p)) == find(int(q))
    groups = defaultdict(set)
    for p in points:
        groups[find(int(p))].add(int(p))
    for g in groups.values():  # no false links: each group is connected by true pairs
        g = np.array(sorted(g), np.uint64)
        seen = {0}
        todo = [0]
        while todo:
            i = todo.pop()
            for j in np.flatnonzero(simhash.distance(g, g[i]) <= 3).tolist():
                if j not in seen:
                    seen.add(j), todo.append(j)
        assert len(seen) == len(g)


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(100, 50), (101, 50)], "u long, v long")
    assert sorted(map(tuple, simhash.components(edges).collect())) == [(i, 0) for i in range(1, 41)] + [(100, 50), (101, 50)]


def all_connected(points):
    """Components of points by comparing all pairs, as the least point of each."""
    label = np.arange(len(points))
    close = simhash.distance(points[:, None], points[None, :]) <= simhash.BITS
    while True:
        new = np.where(close, label[None, :], len(points)).min(axis=1)
        if (new == label).all():
            return points[label]
        label = new


def connected(points, pairs):
    root = {int(x): int(x) for x in points}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(int(a)), find(int(b))))
        root[b] = a
    return np.array([find(int(x)) for x in points], np.uint64)


def ball(center, radius):
    return np.unique(np.array([center ^ sum(1 << b for b in bits) for k in range(radius + 1) for bits in itertools.combinations(range(0, 64, 3), k)], np.uint64))


@pytest.mark.parametrize("points", [ball(2**40 + 5, 3), np.concatenate([ball(7, 1), ball(7 ^ 0b11111 << 30, 1), ball(2**60, 2)]), np.random.default_rng(2).integers(0, 2**63, 1500).astype(np.uint64)])
def test_points_that_nothing_divides(points):
    points = np.unique(points)
    for f in (simhash._spread, simhash.links):
        pairs = [(a, b) for x in f(points) for a, b in zip(*x, strict=True)]
        assert (connected(points, pairs) == all_connected(points)).all()


def test_large_shards_are_divided_again(spark):
    r = np.random.default_rng(4)
    points = r.integers(0, 2**63, 3000).astype(np.uint64)
    points = np.unique(np.concatenate([points, points[:900] ^ (np.uint64(1) << r.integers(0, 63, 900).astype(np.uint64))]))
    shards = spark.createDataFrame([(1, points[:2000].tobytes()), (1, points[2000:].tobytes())], "leaf long, points binary")
    pairs = [(np.int64(x.u).view(np.uint64), np.int64(x.v).view(np.uint64)) for x in simhash._all_links(shards, 700).collect()]
    assert (connected(points, pairs) == connected(points, [(a, b) for x in simhash.links(points) for a, b in zip(*x, strict=True)])).all()


# 7


#: Patterns of public tokenizers: the one of the rank file, one whose classes hold \\p{L}, and a plain one.
PATTERNS = [bpe.KNOWN_PATTERN, r"(?i:'s|'t|'re|'ve|'m|'ll|'d)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+", r"\s*(\S+)|\s+"]


@functools.cache
def merges():
    ranks = bpe.parse_ranks(tokenizer()[0])
    return ranks, bpe.Pairs(ranks)


def test_the_known_pattern_is_that_of_the_rank_file():
    assert tokenizer()[1] == bpe.KNOWN_PATTERN


@pytest.mark.parametrize("pattern", PATTERNS)
@settings(max_examples=200, deadline=None)
@given(text=st.one_of(st.text(max_size=80), st.text(alphabet=" \t\n\x0b\x1c\x85\xa0ab'sSllé12²½.,!?", max_size=80)))
def test_bpe_agrees(pattern, text):
    import tiktoken

    ranks, pairs = merges()
    pieces = [p for part in bpe.Cutter(pattern).parts(text) for p in part]
    ids = b"".join(bpe.replay([p.encode() for p in pieces], ranks, pairs))
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    assert list(memoryview(ids).cast("I")) == own.encode_ordinary(text)


@pytest.mark.parametrize("pattern", PATTERNS)
@pytest.mark.parametrize("block", [16_000_000, 700])
def test_bpe_of_tables(spark, monkeypatch, pattern, block):
    import tiktoken

    monkeypatch.setattr(bpe, "BLOCK", block)
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=merges()[0], special_tokens={})
    rows = text_rows() + [(7790, "the of " * 9000), (7791, "日本語 naïve 'll")]
    df = bpe.encode(docs(spark, rows), tokenizer()[0], pattern)
    want = []
    for d, t in rows:
        ids = own.encode_ordinary(t or "")
        want.append((d, len(ids), brute.sha(np.array(ids, "<u4").tobytes()), brute.sha((t or "").encode())))
    assert got(df, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)
    assert bpe.encode(docs(spark, []), *tokenizer()).collect() == []
    assert [(r.doc_id, r.n_tokens) for r in bpe.encode(docs(spark, [(1, None)]), *tokenizer()).collect()] == [(1, 0)]


def test_sections_keep_pieces(monkeypatch):
    monkeypatch.setattr(bpe, "_LONGEST", 50)
    text = "ab  cd 'll x  " * 30 + "y" * 200 + " z"
    parts = list(bpe.sections(text))
    assert "".join(parts) == text and len(parts) > 3
    cutter = bpe.Cutter(bpe.KNOWN_PATTERN)
    assert [p for x in parts for p in cutter.cut(x)] == cutter.cut(text)


def test_merges_in_any_order_of_ranks():
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 300, b"abc": 260, b"bc": 400, b"aa": 270, b"aaa": 265}
    import tiktoken

    pairs = bpe.Pairs(ranks)
    assert pairs.early
    own = tiktoken.Encoding("o", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    r = random.Random(3)
    words = ["".join(r.choice("abc") for _ in range(r.randrange(1, 15))) for _ in range(300)]
    assert [list(memoryview(x).cast("I")) for x in bpe.replay([w.encode() for w in words], ranks, pairs)] == [own.encode_ordinary(w) for w in words]
    assert bpe.replayed([w.encode() for w in words], ranks, pairs) == bpe.replay([w.encode() for w in words], ranks, pairs)
    for w in words:
        assert list(memoryview(bpe.replay([w.encode()], ranks, pairs)[0]).cast("I")) == own.encode_ordinary(w)


# 8


def test_shards(spark):
    rows = text_rows()
    df = sharding.assign_shards(docs(spark, rows), 7)
    found = df.collect()
    assert len(found) == len(rows) and {r.law for r in found} == {"rows"}
    by = defaultdict(list)
    for r in found:
        by[r.shard].append(r.slot)
        assert r.grown_shard is None
    sizes = [len(x) for x in by.values()]
    assert set(by) <= set(range(7)) and max(sizes) - min(sizes) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
    want = Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in found) == want
    again = sharding.assign_shards(docs(spark, rows, 5), 7).collect()
    assert sorted(map(repr, found)) == sorted(map(repr, again))
    assert sorted(map(repr, sharding.assign_shards(docs(spark, rows), 7, seed=8).collect())) != sorted(map(repr, found))
    assert sharding.assign_shards(docs(spark, [])).collect() == []


def feistel(spark, n, seed):
    """The permutation by plain loops; only the hash of a half is Spark's."""
    side = sharding._side(n)
    hashes = [[r[0] for r in spark.range(side).select(F.xxhash64("id", F.lit(seed * sharding.ROUNDS + k))).collect()] for k in range(sharding.ROUNDS)]
    out = []
    for i in range(n):
        left, right = divmod(i, side)
        while True:
            for k in range(sharding.ROUNDS):
                left, right = right, (left + hashes[k][right] % side) % side
            if left * side + right < n:
                break
        out.append(left * side + right)
    return out


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 100, 1023, 5000])
def test_permutation(spark, n):
    out = sharding.permute(spark.range(n), "id", n, 3, "to").collect()
    assert [r.to for r in sorted(out)] == feistel(spark, n, 3)
    assert sorted(r.to for r in out) == list(range(n))


def test_shard_and_slot_are_those_of_the_permuted_number(spark):
    rows = [(i, "x" * (i % 5)) for i in range(90)]
    found = {(r.shard, r.slot): r.doc_id for r in sharding.assign_shards(docs(spark, rows), 7).collect()}
    order = spark.createDataFrame([(i, len("x" * (i % 5)) + 16, zlib.crc32(b"x" * (i % 5))) for i, _ in rows], "doc_id long, size long, text_crc32 long")
    keys = ["doc_id", "size", "text_crc32"]
    by_hash = [r.doc_id for r in order.orderBy(F.xxhash64(*keys, F.lit(7)), *keys).collect()]
    assert [found[p % 7, p // 7] for p in feistel(spark, 90, 7)] == by_hash


def test_many_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RUN", 10)
    found = sharding.assign_shards(docs(spark, [(1, "same")] * 205 + [(i, "x") for i in range(40)]), 6).collect()
    assert len(found) == 245 and sorted(r.shard + 6 * r.slot for r in found) == list(range(245))


# 9


def test_archives(spark):
    rows = [(1, "http://a/", "<p>é</p>"), (2, "http://b/", "<p>é</p>"), (3, None, None), (4, "http://d/", ""), (5, "http://e/", "x" * 100000), (9, "http://f/", "<p>é</p>"), (9, "http://f/", "<p>é</p>"), (None, "http://g/", "<p>é</p>"), (None, "http://h/", "alone"), (None, "http://h/", "alone")]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, sha1 string, size int").repartition(3)
    archives = warc.write_archives(pages)
    df = warc.read_archives(archives)
    want = []
    for p, u, h in rows:
        body = (h or "").encode()
        ids = [q for q, _, g in rows if (g or "").encode() == body and q is not None]
        revisit = bool(ids) and p != max(ids)
        want.append((p, u or "", len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response", max(ids) if revisit else None, None if revisit else body))
    found = [(*r[:6], None if r.payload is None else bytes(r.payload)) for r in df.collect()]
    assert sorted(found, key=repr) == sorted(want, key=repr)
    assert warc.read_archives(warc.write_archives(pages.limit(0))).collect() == []
    one = warc.read_archives(warc.write_archives(pages, least=20)).collect()
    assert {r.record_type for r in one if r.payload_bytes < 20} == {"response"}


def records(data, step=7, keep=True):
    return list(warc.read_records(io.BytesIO(data), keep, step))


@pytest.mark.parametrize("step", [1, 7, 1 << 16])
def test_damage_is_found(step):
    good = warc.record(1, "http://a/", b"payload", None, False)
    assert [(r["page_id"], r["payload"]) for r in records(warc.member(good) * 2, step)] == [(1, b"payload")] * 2
    for bad in (good.replace(b"payload", b"Payload"), good[:-4], good.replace(b"Content-Length: ", b"Content-Length: 1", 1), b"junk\r\n\r\n", b"junk"):
        with pytest.raises(warc.Damaged):
            records(warc.member(bad), step)
    for bad in (warc.member(good)[:-20], warc.member(good) + b"junk"):
        with pytest.raises(warc.Damaged):
            records(bad, step)


def foreign(kind, block, *more, kind_of="application/http; msgtype=response"):
    head = ["WARC/1.0", f"WARC-Type: {kind}", "WARC-Record-ID: <urn:uuid:12345678-0000-0000-0000-000000000000>", *more, f"Content-Type: {kind_of}", f"Content-Length: {len(block)}"]
    return warc.member("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")


@pytest.mark.parametrize("step", [1, 7, 1 << 16])
def test_archives_of_others(step):
    """No digests, other types of records, other identifiers, bodies in chunks, hexadecimal digests, folded lines, empty bodies."""
    sha = lambda x: base64.b32encode(hashlib.sha1(x).digest()).decode()
    chunked = b"4;x=y\r\nab\r\n\r\n3\r\ncde\r\n0\r\nTrailer: x\r\n\r\n"
    data = b"".join([
        foreign("warcinfo", b"software: x\r\n", kind_of="application/warc-fields"),
        foreign("request", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n"),
        foreign("response", b"HTTP/1.1 200 OK\r\nX: y\r\n\r\nbody", "WARC-Target-URI: http://a/"),
        foreign("response", b"HTTP/1.1 200 OK\r\nTransfer-Encoding:\r\n chunked\r\n\r\n" + chunked, f"WARC-Payload-Digest: sha1:{sha(chunked)}"),
        foreign("response", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked, "WARC-Payload-Digest: sha256:" + hashlib.sha256(b"ab\r\ncde").hexdigest()),
        foreign("response", b"HTTP/1.1 304 Not Modified\r\n\r\n", "WARC-Payload-Digest: crc99:whatever"),
        foreign("resource", b"plain", f"WARC-Block-Digest: SHA-1:{hashlib.sha1(b'plain').hexdigest()}", kind_of="text/plain"),
        foreign("metadata", b"", kind_of="application/warc-fields"),
        foreign("revisit", b"HTTP/1.1 200 OK\r\nContent-Length: 9\r\n\r\n", f"WARC-Payload-Digest: sha1:{sha(b'x')}", "WARC-Refers-To: <urn:uuid:1>"),
        foreign("revisit", b""),
    ])
    found = [(r["record_type"], r["payload_bytes"], r["payload"], r["page_id"], r["refers_to"]) for r in records(data, step)]
    assert found == [
        ("warcinfo", 13, b"software: x\r\n", None, None), ("request", 0, b"", None, None), ("response", 4, b"body", None, None),
        ("response", 7, b"ab\r\ncde", None, None), ("response", 7, b"ab\r\ncde", None, None), ("response", 0, b"", None, None),
        ("resource", 5, b"plain", None, None), ("metadata", 0, b"", None, None), ("revisit", 9, None, None, None), ("revisit", None, None, None, None),
    ]
    assert [r["payload_digest"] for r in records(data, step)][2:4] == [sha(b"body"), sha(b"ab\r\ncde")]
    for bad in (foreign("response", b"HTTP/1.1 200 OK\r\nContent-Length: 9\r\n\r\nbody"), foreign("resource", b"plain", "WARC-Block-Digest: md5:00", kind_of="text/plain"), foreign("response", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n9\r\nab")):
        with pytest.raises(warc.Damaged):
            records(bad, step)


def test_a_payload_that_half_the_pages_have(spark):
    rows = [(i, f"http://h/{i}", "" if i % 2 else f"<p>{i}") for i in range(400)]
    df = warc.read_archives(warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string")), with_payload=False)
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in df.collect()) == [(i, "revisit" if i % 2 and i < 399 else "response", 399 if i % 2 and i < 399 else None) for i in range(400)]


# 10


def test_boilerplate(spark):
    rows = [(i, f"Common line\nown {i}\n\n own too\nnearly" if i < 9 else f"Common line\nown {i}\nCommon line", "en", f"s{i % 12}") for i in range(24)]
    rows += [(50, None, "en", None), (51, "", "en", "s1"), (52, "Common line", "en", None), (52, "Common line", "en", None), (None, "x\nCommon line", None, None)]
    df, n, gone = remove_boilerplate(docs(spark, rows))
    assert n == "n_lines" and set(df.columns) == {*DOCS.names, n, gone}
    want = []
    for d, t, _, _ in rows:
        lines = [] if t is None else t.split("\n")
        kept = [x for x in lines if x != "Common line"]
        want.append((d, None if t is None else "\n".join(kept), len(lines), len(lines) - len(kept)))
    assert got(df, "doc_id", "text", n, gone) == sorted(want, key=repr)
    assert remove_boilerplate(docs(spark, []))[0].collect() == []


def test_boilerplate_is_exact_near_the_threshold(spark):
    rows = [(k * 100 + i, f"line {k}", "en", f"s{i}") for k in range(2, 30) for i in range(k)]
    df, _, gone = remove_boilerplate(docs(spark, rows), min_sites=12)
    assert {r.doc_id // 100 for r in df.where(F.col(gone) > 0).collect()} == set(range(12, 30))
