from __future__ import annotations

import base64
import random
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute

from tidegrid.llm import sentencepiece_lattice as sl
from tidegrid.llm.common import prepared
from tidegrid.llm.registry import tokenizer_path

PIECES = sl.Pieces(tokenizer_path())
TABLE = {p: (i, s) for p, i, s in PIECES.rows}


def runs():
    rng = random.Random(4)
    texts = ["=" * 1000, "a" * 600, "z" * 700, "http://x.org/" + "ab/c=" * 120, "漢字🙂" * 200, "é\0" * 300]
    texts += [base64.b64encode(rng.randbytes(750)).decode() for _ in range(10)]
    texts += ["two words " + "-" * n for n in (254, 255, 256, 257, 258, 300)]
    return [*texts, texts[0], "short", "", None]


def want(text):
    return brute.viterbi("▁" + text.replace(" ", "▁"), PIECES) if text else []


@pytest.mark.parametrize("block, row", [(3, 700), (1_000_000, 1_000_000)])
def test_ids_are_the_path_of_the_whole_text(spark, block, row, monkeypatch):
    monkeypatch.setattr(sl, "ROW_CHARACTERS", row)
    prepared(spark)
    rows = list(enumerate(runs()))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: (r.n_pieces, r.ids, r.decoded_sha256) for r in sl.encode(docs, tokenizer_path(), block_units=block).collect()}
    wrong = [i for i, t in rows if found.pop(i) != (len(want(t)), want(t), brute.sha(t or ""))]
    assert not wrong and not found


def test_a_model_whose_pieces_cross_spaces_is_not_cut(spark, monkeypatch):
    prepared(spark)
    monkeypatch.setattr(sl, "Pieces", lambda path: PIECES)
    monkeypatch.setattr(PIECES, "splits", False)
    text = "some words with spaces " * 40
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    same = sl.encode(docs, "").first().ids == want(text)
    assert same


def test_long_run_takes_time_by_its_length():
    ids = sl.best_path("▁" + "ab" * 100_000, TABLE, PIECES.longest, PIECES.lowest, PIECES.byte_ids)
    same = sl.decoded(ids, PIECES.surface) == b"ab" * 100_000
    assert same


def test_units_end_where_no_piece_joins_characters():
    cutter = sl.Cutter(PIECES.pattern, PIECES.alone, PIECES.borders)
    assert sl.units("ends. (a,b) 42", cutter) == ["▁ends", ".", "▁(", "a", ",", "b", ")", "▁", "4", "2"]
    rng, letters = random.Random(8), "ab zé.,()'\"/-_42ж漢🙂\0▁\n"
    for _ in range(300):
        text = "".join(rng.choices(letters, k=rng.randint(1, 40)))
        parts = sl.units(text, cutter)
        ids = [i for u in parts for i in sl.best_path(u, TABLE, PIECES.longest, PIECES.lowest, PIECES.byte_ids)]
        assert ids == want(text)


def test_paths_of_many_units_at_once_and_of_one_are_the_same(spark):
    prepared(spark)
    rng, letters = random.Random(9), "▁abcdehinorstuz.,=é漢🙂\0"
    words = sorted({"".join(rng.choices(letters, k=rng.randint(1, 30))) for _ in range(400)} | {"=" * 256, "a" * 256, "▁", "\0"})
    rows = sl.lattices(spark.createDataFrame([(w,) for w in words], "unit string"), PIECES).collect()
    scores = np.zeros(1 + max(i for _, i, _ in PIECES.rows))
    for _, i, s in PIECES.rows:
        scores[i] = s
    edges, counts = np.concatenate([r.edges for r in rows]), np.array([len(r.edges) for r in rows])
    size, ids = sl.best_paths(edges, counts, scores, PIECES.lowest, PIECES.byte_ids)
    found = [x.tolist() for x in np.split(ids, np.cumsum(size)[:-1])]
    assert {r.unit: x for r, x in zip(rows, found, strict=True)} == {w: brute.viterbi(w, PIECES) for w in words}


def test_of_equal_sums_the_longer_last_piece_stays():
    # "abc" as a, b, c (ids 0, 1, 2), ab (3), bc (4): both ways with two pieces sum up to -2
    edge = lambda e, l, i: e << sl.END | l << sl.LENGTH | i + sl.CODES
    edges = np.array([edge(1, 1, 0), edge(2, 1, 1), edge(2, 2, 3), edge(3, 1, 2), edge(3, 2, 4)])
    size, ids = sl.best_paths(np.tile(edges, 2), np.array([5, 5]), np.full(5, -1.0), -10.0, [])
    assert size.tolist() == [2, 2] and ids.tolist() == [0, 4, 0, 4]


def test_packed_numbers_come_back_and_small_ones_take_little():
    edges = [0, 239, 240, 255, 256, 65535, 65536, 15 * 65536 - 1, 15 * 65536, 2**31, 2**32 - 1]
    for numbers in (edges, [], [7], [2**32 - 1]):
        assert sl._unpacked(sl._packed(np.array(numbers, np.int64))).tolist() == numbers
    # numbers of words by rank, against four planes of bytes
    ranks = np.random.default_rng(3).zipf(1.2, 100_000)
    ranks = ranks[ranks < 2**20].astype(np.uint32)
    planes = zlib.compress(ranks.view(np.uint8).reshape(-1, 4).T.tobytes(), 4)
    assert len(sl._packed(ranks)) < 0.95 * len(planes)


def test_units_are_given_back_before_the_documents_move(spark):
    prepared(spark)
    docs = spark.createDataFrame([(i, f"some words and number {i}") for i in range(50)], "doc_id long, text string")
    found = sl.encode(docs, tokenizer_path())
    folder = next(Path(f.removeprefix("file://")).parent for f in found.inputFiles() if f"/kind={sl.DOCUMENTS}/" in f)
    assert folder.exists() and not (folder.parent / f"kind={sl.UNITS}").exists()
    assert found.where("size(ids) = n_pieces AND n_pieces > 0").count() == 50
