"""Quality rules (operator 12) and centroid clustering (operator 13) against plain versions."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import sys
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

sys.path.insert(0, str(Path(__file__).parent))
import brute

from tidegrid.llm import centroid_clusters as cc
from tidegrid.llm import quality_rules as qr

# --- quality rules ------------------------------------------------------------------------------------------------------


def plain_measures(text):
    text = text or ""
    words = brute.split_words(text)
    windows = collections.defaultdict(list)
    for i in range(len(words) - 7):
        windows[tuple(words[i : i + 8])].append(i)
    covered = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if brute.split_words(x)]
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), len(lines),
        sum(any(c.isalpha() for c in w) for w in words), sum(len(w) > 1 and w.isupper() for w in words), sum(a == b for a, b in zip(words, words[1:], strict=False)),
    )


BITS = ["a", "b", "A", "AB", " ", "  ", "\n", "\t", "\x0b", "#", "|", "é", "\x1c", "\x85", " ", "漢字", "1", "ab cd ef gh ij kl mn op ", "\na b\n"]


@given(st.lists(st.sampled_from(BITS), max_size=60).map("".join))
@settings(max_examples=300, deadline=None)
def test_measures(text):
    assert qr.measures(text) == plain_measures(text)


@given(st.lists(st.integers(0, 3), max_size=80), st.integers(1, 11))
@settings(max_examples=300, deadline=None)
def test_repeated_words_of_every_window(numbers, window):
    windows = collections.Counter(tuple(numbers[i : i + window]) for i in range(len(numbers) - window + 1))
    covered = {j for i in range(len(numbers) - window + 1) if windows[tuple(numbers[i : i + window])] > 1 for j in range(i, i + window)}
    assert qr.repeated_words(np.array(numbers, np.int64), window) == len(covered)


def test_long_texts_in_parts(monkeypatch):
    text = " ".join(random.Random(1).choice(["ab", "CD", "|", "longer\nline"]) for _ in range(3000)) + "x" * 500
    whole = qr.measures(text)
    monkeypatch.setattr(qr, "PART", 50)
    assert qr.measures(text) == whole == plain_measures(text)


def test_ledger_and_policy(spark, odd, odd_rows, nothing):
    found = qr.quality_digest(odd)
    want = []
    for i, t in odd_rows:
        m = plain_measures(t)
        base = m[0] < 20 or 100 * m[4] > 30 * m[0]
        want.append(str((i, *m, base)))
    rows = found.collect()
    assert sorted(str(tuple(r[c] for c in ("doc_id", *qr.MEASURES, "base_failed"))) for r in rows) == sorted(want)
    assert all(r.kept == (r.fail_bits == 0) and (not r.base_failed or not r.kept) for r in rows)
    assert qr.quality_digest(nothing).count() == 0
    assert qr.drop_failed(odd).columns == odd.columns
    kept = collections.Counter(r.doc_id for r in rows if r.kept)
    assert collections.Counter(r.doc_id for r in qr.drop_failed(odd).collect()) == kept
    assert qr.drop_failed(nothing).count() == 0


def test_ablations_equal_policies_without_the_rule(spark):
    masks = [random.Random(7).getrandbits(len(qr.RULES)) & random.Random(i).getrandbits(len(qr.RULES)) for i in range(200)]
    rows = spark.createDataFrame([(m,) for m in masks], "fail_bits long")
    found = {(r.policy, r.rule): r for r in qr.ablations(rows).collect()}
    assert set(found) == {(p, n) for p, names in qr.POLICIES.items() for n in names}
    for (policy, rule), r in found.items():
        names = qr.POLICIES[policy]
        rest = qr.mask_of([n for n in names if n != rule])
        assert r.n_docs == len(masks)
        assert r.n_kept == sum(m & qr.mask_of(names) == 0 for m in masks) == qr.apply_policy(rows, names).where("kept").count()
        assert r.n_kept_without == sum(m & rest == 0 for m in masks)
        assert r.n_failed == sum(m & qr.mask_of([rule]) != 0 for m in masks)
    none = qr.ablations(rows.where("fail_bits < 0")).collect()
    assert len(none) == len(found) and all(r.n_docs == 0 for r in none)


def test_junk_fails_and_prose_stays(spark):
    rng = random.Random(2)
    prose = [" ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8))) for _ in range(120)) for _ in range(20)]
    junk = ["| a " * 60, "WORDS IN CAPITALS " * 20, "same same same same " * 20, "a\n" * 100, "$$$ ### " * 40, "x" * 3000, "few words"]
    docs = spark.createDataFrame(list(enumerate([*prose, *junk])), "doc_id long, text string")
    kept = {r.doc_id for r in qr.quality_digest(docs).where("kept").collect()}
    assert kept == set(range(len(prose)))


# --- centroid clustering ------------------------------------------------------------------------------------------------


def plain_clusters(rows, k, rounds, size):
    """(vec_id, cluster, distance, cluster inertia, inertia, digest) with Python's own numbers."""
    kept = [(i, [math.floor(256 * float(c)) for c in x]) for i, x in rows if x is not None and len(x) == size and all(c is not None and math.isfinite(c) for c in x)]
    name = lambda i: hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest()
    centroids = [x for _, x in sorted(kept, key=lambda r: (r[0] is None, name(r[0]), r[1]))[:k]]

    def nearest(x):
        away = [sum((a - b) ** 2 for a, b in zip(x, c, strict=True)) for c in centroids]
        return away.index(min(away)), min(away)

    for _ in range(rounds):
        members = collections.defaultdict(list)
        for _, x in kept:
            members[nearest(x)[0]].append(x)
        for c, own in members.items():
            centroids[c] = [sum(x[d] for x in own) // len(own) for d in range(size)]
    found = [(i, *nearest(x)) for i, x in kept]
    inertia = collections.Counter()
    for _, c, away in found:
        inertia[c] += away
    return sorted(str((i, c, away, inertia[c], sum(inertia.values()), brute.sha(",".join(map(str, centroids[c]))))) for i, c, away in found)


NAMES = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def as_rows(df):
    assert tuple(df.columns) == NAMES
    return sorted(str(tuple(r)) for r in df.collect())


def vectors():
    rng = random.Random(9)
    middle = [[rng.gauss(0, 3) for _ in range(6)] for _ in range(4)]
    rows = [(i, [c + rng.gauss(0, 0.3) for c in rng.choice(middle)]) for i in range(300)]
    rows += [(1000 + i, list(rows[5][1])) for i in range(150)] + [rows[7]] * 5 + [(None, rows[8][1]), (None, rows[9][1])]
    rows += [(2000, None), (2001, []), (2002, [1.0] * 5), (2003, [1.0] * 5 + [None]), (2004, [1.0] * 5 + [float("nan")]), (2005, [float("inf")] * 6), (2006, [-1e5] * 6)]
    return rows


@pytest.mark.parametrize(("k", "block"), [(7, 256), (40, 16)])
def test_clusters(spark, monkeypatch, k, block):
    monkeypatch.setattr(cc, "BLOCK", block)
    monkeypatch.setattr(cc, "TASK", 50)
    rows = vectors()
    table = spark.createDataFrame([(i, x, 1, 2, 3) for i, x in rows], "vec_id long, embedding array<double>, x int, cluster int, key int")
    assert as_rows(cc.cluster_vectors(table, k, 3, 6)) == plain_clusters(rows, k, 3, 6)
    few = table.where("vec_id < 3")
    assert as_rows(cc.cluster_vectors(few, k, 3, 6)) == plain_clusters([r for r in rows if r[0] in (0, 1, 2)], k, 3, 6)
    assert cc.cluster_vectors(table.where("vec_id = 2000"), k, 3, 6).count() == 0


def test_components_too_large_for_the_scale_are_set_to_the_limit(spark):
    table = spark.createDataFrame([(1, [1e300, -1e300]), (2, [0.5, -0.001])], "vec_id long, embedding array<double>")
    found = {r.vec_id: r for r in cc.usable(table, "vec_id", "embedding", 2).collect()}
    assert list(found[1].x) == [cc.LIMIT, -cc.LIMIT] and list(found[2].x) == [128, -1]


@given(st.integers(0, 2**31))
@settings(max_examples=60, deadline=None)
def test_candidates_hold_every_nearest_centroid(seed):
    rng = np.random.default_rng(seed)
    x, c = rng.integers(-50, 50, (40, 5)), rng.integers(-60, 60, (12, 5))
    number, away = cc.nearest(x, c, x.min(0), x.max(0))
    want = ((x[:, None] - c) ** 2).sum(2)
    assert (number == want.argmin(1)).all() and (away == want.min(1)).all()
    far = x * 2**20
    assert (cc.nearest(far, c * 2**20, far.min(0), far.max(0))[0] == want.argmin(1)).all()


@pytest.mark.parametrize(("n", "bits"), [(2, 3), (3, 2), (4, 1)])
def test_hilbert_neighbours_touch(n, bits):
    """All places in order of their keys: each next one differs by one step in one dimension."""
    places = np.stack(np.meshgrid(*[np.arange(2**bits)] * n, indexing="ij"), -1).reshape(-1, n)
    keys = cc.hilbert_keys(places, bits)
    assert len(set(keys)) == len(places)
    order = places[sorted(range(len(keys)), key=keys.__getitem__)]
    assert (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()


def test_boxes_leave_few_candidates():
    """Blocks of neighbours on the curve need far fewer comparisons than all centroids."""
    rng = np.random.default_rng(3)
    middle = rng.integers(-2000, 2000, (40, 8))
    x = (middle[rng.integers(0, 40, 4000)] + rng.integers(-20, 20, (4000, 8))).astype(np.int64)
    low, span = x.min(0), x.max(0) - x.min(0) + 1
    order = sorted(range(len(x)), key=cc.hilbert_keys(((x - low) << 4) // span, 4).__getitem__)
    blocks = [x[order[i : i + 50]] for i in range(0, len(x), 50)]
    share = sum(len(cc.candidates(b.min(0), b.max(0), middle)) for b in blocks) / (40 * len(blocks))
    assert share < 0.4
