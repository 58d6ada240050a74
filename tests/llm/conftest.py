from __future__ import annotations

import random

import pytest

#: Columns beside doc_id and text whose names the operators use for their own.
CLASHING = "id long, fp long, _d string, _h int, key string, n int, block string, unit string, spans int, _sha string, turn int"


def words(rng, n, alphabet="abcdef"):
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(1, 3))) for _ in range(n))


def texts() -> list[tuple]:
    """(doc_id, text): copies, near copies, shared passages, nulls, empty, blank and long texts, repeated rows, a null id."""
    rng = random.Random(11)
    base = [words(rng, 60) for _ in range(4)]
    passage = words(rng, 25)
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(10, base[0]), (11, base[0].replace(" ", "\n\t ")), (12, base[1] + " tail"), (13, "x " + base[2])]
    rows += [(20 + i, words(rng, 20) + " " + passage + " " + words(rng, 20)) for i in range(4)]
    rows += [(30, None), (31, ""), (32, " \t\n "), (33, None), (34, "a"), (35, "Été ñandú ß 漢字 🙂 été")]
    rows += [(40, words(rng, 3000)), (41, "z" * 700), (42, "ab " * 150)]
    rows += [(50, base[3]), (50, base[3]), (50, "another text with this id"), (None, base[1]), (None, None)]
    return rows


@pytest.fixture(scope="session")
def odd_rows():
    return texts()


@pytest.fixture(scope="session")
def odd(spark):
    from tidegrid.llm.common import prepared

    prepared(spark)
    extra = (7, 8, "d", 9, "k", 1, "b", "u", 3, "s", 0)
    return spark.createDataFrame([(i, t, "en", *extra) for i, t in texts()], f"doc_id long, text string, lang string, {CLASHING}").cache()


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.where("doc_id < -5")
