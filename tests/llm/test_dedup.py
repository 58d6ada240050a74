from __future__ import annotations

import collections
import random
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

sys.path.insert(0, str(Path(__file__).parent))
import brute

from tidegrid.llm import debruijn_dedup, exact_dedup, repeats, rolling, simhash, suffix_dedup
from tidegrid.llm.common import components


def rows(df, *names):
    return sorted(map(str, (tuple(r[n] for n in names) for r in df.collect())))


@given(st.sets(st.integers(0, 2**40), min_size=1, max_size=300))
@settings(max_examples=60, deadline=None)
def test_golomb_code_round_trip(values):
    values = np.array(sorted(values), np.uint64)
    k, data = exact_dedup.golomb_encode(values)
    assert (exact_dedup.golomb_decode(len(values), k, data) == values).all()
    assert exact_dedup.golomb_decode(0, *exact_dedup.golomb_encode(values[:0])).size == 0


def test_golomb_code_is_short():
    values = np.unique(np.random.default_rng(1).integers(0, 2**26, 1000).astype(np.uint64))
    _, data = exact_dedup.golomb_encode(values)
    assert len(data) * 8 / len(values) < 19  # 26 bits spread over 2**10 values need about 16 + 1.6


def test_exact_dedup(odd, odd_rows, nothing):
    found = exact_dedup.exact_dedup(odd)
    names = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert tuple(found.columns) == names
    assert rows(found, *names) == sorted(map(str, brute.exact(odd_rows)))
    assert exact_dedup.exact_dedup(nothing).count() == 0


def test_exchange_names_every_repeat(spark):
    n = 3000
    df = spark.range(n).selectExpr("id AS uid", "xxhash64(id % 2500) AS fp").cache()
    found = {r.uid for r in exact_dedup.fingerprint_suspects(df).collect()}
    assert {i for i in range(n) if i < 500 or i >= 2500} <= found
    assert len(found) < 1000 + 20


def test_hot_fingerprint(spark):
    df = spark.range(5000).selectExpr("id AS uid", "IF(id % 3 = 0, 1L, xxhash64(id)) AS fp")
    assert exact_dedup.fingerprint_suspects(df).where("fp = 1").count() == 1667


def test_drop_copies(odd, odd_rows, nothing):
    left = exact_dedup.drop_copies(odd)
    assert left.columns == odd.columns
    kept = sorted((str(i), s) for i, _, _, k, s in brute.exact(odd_rows) if k)
    assert sorted((str(r.doc_id), brute.sha(brute.SPACE.sub(" ", r.text or ""))) for r in left.collect()) == kept
    assert exact_dedup.drop_copies(nothing).count() == 0


def test_simhash(odd, odd_rows, nothing):
    found = simhash.near_duplicates(odd)
    names = ("doc_id", "fingerprint", "component_id")
    assert tuple(found.columns) == names
    assert rows(found, *names) == sorted(map(str, brute.near(odd_rows)))
    assert simhash.near_duplicates(nothing).count() == 0


def test_simhash_in_chunks(monkeypatch):
    text = " ".join(map(str, range(500)))
    whole = simhash.simhash(text.encode())
    monkeypatch.setattr(simhash, "CHUNK", 7)
    assert simhash.simhash(text.encode()) == whole == brute.simhash(text)


def test_ball_links_connect_all_within_two_bits(spark):
    rng = random.Random(3)
    prints = [rng.getrandbits(64) for _ in range(20)]
    for p in list(prints):
        for _ in range(6):
            p ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64))
            prints.append(p)
    prints = sorted(set(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = simhash.fingerprint_links(spark.createDataFrame([(s,) for s in signed], "fp long"))
    pairs = [(r.u % 2**64, r.v % 2**64) for r in links.collect()]
    assert all((a ^ b).bit_count() <= 2 for a, b in pairs)
    root = {r.node % 2**64: r.root for r in components(links).collect()}
    expected = brute.classes(prints)
    for i, a in enumerate(prints):
        for j in range(i):
            assert (expected[i] == expected[j]) == (root.get(a, a) == root.get(prints[j], prints[j]))
    with pytest.raises(ValueError, match="even"):
        simhash.fingerprint_links(links, 3)


def test_components_of_a_path_a_star_and_nothing(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, 6 + i) for i in range(50)] + [(9, 9)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {**dict.fromkeys(range(100, 161), 100), **dict.fromkeys(range(5, 56), 5)}
    assert components(spark.createDataFrame([(1, 1)], "u long, v long")).count() == 0


def test_drop_near_copies_keeps_one_of_each_class(odd, odd_rows, nothing):
    left = simhash.drop_near_copies(odd)
    assert left.columns == odd.columns
    root = brute.classes([brute.simhash(t) for _, t in odd_rows])
    texts = {t: r for (_, t), r in zip(odd_rows, root, strict=True)}
    kept = [(r.doc_id, texts[r.text]) for r in left.collect()]
    assert {c for _, c in kept} == set(root)
    for doc, c in kept:
        ids = [i for (i, _), r in zip(odd_rows, root, strict=True) if r == c and i is not None]
        assert doc == (min(ids) if ids else None)
    assert len(set(kept)) == len(set(root))
    assert simhash.drop_near_copies(nothing).count() == 0


@pytest.mark.parametrize("part", [7, 4_000_000])
def test_suffix_sort_on_random_strings(part, monkeypatch):
    """Runs, whole copies and sorted runs together find exactly the repeated windows."""
    monkeypatch.setattr(rolling, "PART", part)
    rng = random.Random(5)
    for _ in range(60):
        window, gram = rng.choice([6, 10, 20]), rng.choice([2, 3])
        base = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 60))) for _ in range(rng.randint(1, 5))]
        docs = []
        for _ in range(rng.randint(1, 8)):
            x = bytearray(b"".join(rng.choice(base) for _ in range(rng.randint(0, 3))))
            if x and rng.random() < 0.6:
                x[rng.randrange(len(x))] = rng.choice(b"abc")
            docs.append(bytes(x))
        count = collections.Counter(x[i : i + window] for x in docs for i in range(len(x) - window + 1))
        wanted = {(d, i) for d, x in enumerate(docs) for i in range(len(x) - window + 1) if count[x[i : i + window]] > 1}
        places = []
        for d, x in enumerate(docs):
            for a, b, q, k in zip(*(v.tolist() for v in rolling.window_runs(rolling.byte_symbols(x), window, gram)), strict=True):
                places.append((k % 2**63, x[a : b + window - 1], d, a, b - a, q - a))
        copies = collections.Counter((k, c) for k, c, *_ in places)
        number = {c: i for i, c in enumerate(copies)}
        distinct = sorted({(k, number[k, c], n, q, c) for k, c, _, _, n, q in places})
        found = {(d, a + i) for k, c, d, a, n, _ in places if copies[k, c] > 1 for i in range(n)}
        if distinct:
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
            table = pa.table([pa.array(c, t) for c, t in zip(zip(*distinct, strict=True), types, strict=True)], names=["key", "digest", "n", "anchor", "content"])
            for r in suffix_dedup.sort_runs(window)(table).to_pylist():
                found |= {(d, a + i) for k, c, d, a, _, _ in places if number[k, c] == r["digest"] for i in range(r["a"], r["b"])}
        assert found == wanted


def test_mergesort_orders_suffixes():
    rng = random.Random(2)
    contents = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 30))) for _ in range(97)]
    groups = np.array([rng.randrange(3) for _ in contents])
    anchors = np.array([rng.randrange(len(c)) for c in contents])
    order = suffix_dedup.Suffixes(contents, anchors, groups, 5).sorted()
    keys = [(groups[i], contents[i][anchors[i] :]) for i in order]
    assert keys == sorted(keys)
    assert sorted(order.tolist()) == list(range(97))


def test_equal_hashes_with_other_bytes_are_not_taken(monkeypatch):
    monkeypatch.setattr(suffix_dedup.Suffixes, "hashes", lambda self, at, size: np.zeros(len(at), np.uint64))
    contents = [b"abcdefgh", b"abcdxfgh"]
    s = suffix_dedup.Suffixes(contents, np.array([0, 0]), np.array([0, 0]), 6)
    runs, _ = suffix_dedup.verified(s, contents, np.array([0]), np.array([1]), np.array([0]))
    assert len(runs) == 0


@pytest.mark.parametrize("limit", [1, 2, 4096])
def test_substring_dedup(odd, odd_rows, nothing, limit):
    names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    found = suffix_dedup.dedup_substrings(odd, window=40, gram=6, limit=limit)
    assert tuple(found.columns) == names
    assert rows(found, *names) == sorted(map(str, brute.removed(odd_rows, 40, False)))
    assert suffix_dedup.dedup_substrings(nothing, window=40, gram=6, limit=limit).count() == 0


@pytest.mark.parametrize(("window", "gram"), [(8, 3), (35, 8), (2, 1)])
def test_span_dedup(odd, odd_rows, nothing, window, gram):
    names = ("doc_id", "n_words", "n_removed", "n_spans", "kept_sha256")
    found = debruijn_dedup.dedup_spans(odd, window=window, gram=gram)
    assert tuple(found.columns) == names
    assert rows(found, *names) == sorted(map(str, brute.removed(odd_rows, window, True)))
    assert debruijn_dedup.dedup_spans(nothing, window=window, gram=gram).count() == 0


def test_kept_text(odd):
    found = debruijn_dedup.dedup_spans(odd, window=8, gram=3, with_text=True).collect()
    assert all(brute.sha(bytes(r.kept)) == r.kept_sha256 for r in found)


def test_paths_end_at_branches(spark):
    """Two runs share x-y-z and part behind z: one path of three edges at each place."""
    edge = "key long, digest long, w int, edge long, proof long, prev long, next long"
    data = [(1, d, w, e, e, p, n) for d, tail in ((1, 8), (2, 9)) for w, (e, p, n) in enumerate([(5, None, 6), (6, 5, 7), (7, 6, tail), (tail, 7, None)])]
    paths = debruijn_dedup.repeated_paths(spark.createDataFrame(data, edge)).collect()
    assert sorted((r.digest, r.a, r.b, r.edge) for r in paths) == [(1, 0, 3, 5), (2, 0, 3, 5)]


def test_words_and_bytes_of_null():
    assert len(repeats.Words(None)) == len(repeats.Bytes(None)) == 0
    assert repeats.Words(b" a  b ").kept(np.array([True, False])) == b"b"
