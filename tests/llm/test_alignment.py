"""Cross-tokenizer alignment (operator 11) against whole-text encodings by the two libraries."""

from __future__ import annotations

import collections
import random
import sys
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

sys.path.insert(0, str(Path(__file__).parent))
import brute

from tidegrid.llm import token_alignment as ta
from tidegrid.llm.common import packed_numbers, unpacked_numbers
from tidegrid.llm.registry import tokenizer_path

A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path()
MODEL = ta.Aligner(A, B)


def groups_of(text):
    """Groups [(A ids, B ids)] of one text, from its whole encodings; none where the tokens do not spell it."""
    if not text:
        return []
    a = MODEL.a.encode(" " + text, add_special_tokens=False).ids
    b = MODEL.b.encode(text)
    wanted = (" " + text).encode()
    if b"".join(MODEL.bytes_a[i] for i in a) != wanted or b"".join(MODEL.bytes_b[i] for i in b) != wanted:
        return []
    out, i, j, at_a, at_b = [], 0, 0, 0, 0
    first = (0, 0)
    while i < len(a):
        if at_a <= at_b:
            at_a += len(MODEL.bytes_a[a[i]])
            i += 1
        else:
            at_b += len(MODEL.bytes_b[b[j]])
            j += 1
        while at_b < at_a:
            at_b += len(MODEL.bytes_b[b[j]])
            j += 1
        if at_a == at_b:
            out.append((a[first[0] : i], b[first[1] : j]))
            first = (i, j)
    return out


def brute_rows(rows):
    groups = [groups_of(t) for _, t in rows]
    links = [collections.Counter((x, y) for a, b in g for x in a for y in b) for g in groups]
    count = collections.Counter(p for own in links for p in own)
    most = collections.defaultdict(int)
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    out = []
    for (i, _), g, own in zip(rows, groups, links, strict=True):
        written = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        best = sum(n for p, n in own.items() if count[p] == most[p[0]])
        out.append((i, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(own.values()), best, sum(count[p] * n for p, n in own.items()), brute.sha(written) if g else ""))
    return out


NAMES = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def as_rows(df):
    return sorted(str(tuple(r[n] for n in NAMES)) for r in df.collect())


BITS = ["a", "b", "the", " ", "  ", "\n", "\n\n", "\t", "'s", "don't", "1", "23", ".", "&&", "<|endoftext|>", "<s>", "é", "漢", " ", "　", "\x1c", "🙂", "=" * 70, "Ġ", "\0", "▁", "<0x0A>"]


@given(st.lists(st.sampled_from(BITS), min_size=1, max_size=14).map("".join))
@settings(max_examples=300, deadline=None)
def test_cuts_are_tokens_ends_of_both(text):
    sums, digests, (pair, times, _) = ta.measured(MODEL, [text])
    groups = groups_of(text)
    links = collections.Counter((x << ta.SHIFT) | y for a, b in groups for x in a for y in b)
    assert sums[0].tolist() == [sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), sum(links.values())]
    assert dict(zip(pair.tolist(), times.tolist(), strict=True)) == dict(links)
    assert bool(digests[0]) == bool(groups)


def test_whole_table(spark, odd, odd_rows, nothing):
    found = ta.align_tokens(odd, A, B)
    assert tuple(found.columns) == NAMES
    want = sorted(map(str, brute_rows(odd_rows)))
    assert as_rows(found) == want
    # blocks of every size give the same rows
    assert as_rows(ta.align_tokens(odd, A, B, block_entries=10)) == want
    assert ta.align_tokens(nothing, A, B).count() == 0


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert as_rows(ta.align_tokens(docs, A, B)) == sorted(map(str, brute_rows(rows)))


def test_long_texts_and_long_groups(monkeypatch):
    rng = random.Random(4)
    text = " ".join("".join(rng.choice("abcdé\n.") for _ in range(rng.randint(1, 9))) for _ in range(4000)) + " " + "=" * 3000 + " end  "
    whole = ta.measured(MODEL, [text, "x"])
    monkeypatch.setattr(ta, "BATCH_CHARACTERS", 100)
    parts = ta.measured(MODEL, [text, "x"])
    assert (whole[0] == parts[0]).all() and whole[1] == parts[1]
    assert all((x == y).all() for x, y in zip(whole[2], parts[2], strict=True))


def test_groups_without_common_ends_are_counted_by_distinct_ids():
    a, b = np.array([1, 1, 1, 2] * 10), np.array([7, 8] * 15)
    pair, times, of = ta.Aligner._pairs(a, b, np.array([40]), np.array([30]), np.array([0]), np.array([0]), np.array([0]))
    want = collections.Counter(((x << ta.SHIFT) | y) for x in a.tolist() for y in b.tolist())
    assert dict(zip(pair.tolist(), times.tolist(), strict=True)) == want and set(of.tolist()) == {0}


@given(st.lists(st.integers(-(2**30), 2**30)))
def test_packed_numbers_round_trip(numbers):
    assert unpacked_numbers(packed_numbers(np.array(numbers, np.int64))).tolist() == numbers


@pytest.mark.parametrize("size", [1, 5])
def test_forgetting_changes_nothing(monkeypatch, size):
    texts = [f"word{i} and {i * 7} again" for i in range(30)]
    whole = ta.measured(MODEL, texts)
    monkeypatch.setattr(ta, "CACHE", size)
    again = ta.measured(ta.Aligner(A, B), texts)
    assert (whole[0] == again[0]).all() and whole[1] == again[1]
