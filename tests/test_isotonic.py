import math
import random

import pytest
from oracle_check import compare, duck

import __spark_entry__ as entry
from tidegrid.plans import learning as ln

SF = "/root/testdata/sf0.001"


def pooled(points):
    """Isotonic means of (value, label), as value -> mean."""
    blocks = []
    for x, y in sorted(points):
        if blocks and blocks[-1][2][-1] == x:
            last = blocks.pop()
            blocks.append([last[0] + y, last[1] + 1, last[2]])
        else:
            blocks.append([y, 1, [x]])
    out = []
    for b in blocks:
        out.append(b)
        while len(out) > 1 and out[-2][0] / out[-2][1] >= out[-1][0] / out[-1][1]:
            last = out.pop()
            out[-1] = [out[-1][0] + last[0], out[-1][1] + last[1], out[-1][2] + last[2]]
    return {x: t / n for t, n, xs in out for x in xs}


@pytest.mark.parametrize("sign", [1, -1])
def test_fit_on_a_skewed_feature_with_an_outlier(spark, sign):
    rng = random.Random(6)
    data = [(math.exp(rng.gauss(0, 2)), rng.uniform(0, 3)) for _ in range(1500)]
    data = [(x, sign * math.log(x) + rng.gauss(0, 1), p) for x, p in data] + [(1e9, sign * 30.0, 1.0)]
    rows = spark.createDataFrame([*data, (1e9, None, 5.0), (None, 1.0, 7.0), (-1e6, None, 2.0)], "x double, load double, prediction double")
    want = {x: sign * m for x, m in pooled([(x, sign * y) for x, y, _ in data]).items()}
    out = ln.isotonic_recalibration(rows, "x", sign).collect()
    found = {r.x: r.recalibrated for r in out if r.load is not None and r.x is not None}
    assert len(out) == 1504 and found == pytest.approx(want, abs=1e-6)
    # without a label: the fit at its value, or the nearest one
    rest = {(r.x, r.prediction): r.recalibrated for r in out if r.load is None or r.x is None}
    assert rest == pytest.approx({(1e9, 5.0): want[1e9] + 4, (None, 7.0): 7.0, (-1e6, 2.0): want[min(want)]})


def test_registered_on_a_skewed_feature(spark):
    name = "isotonic_recalibration_skewed"
    problem, n = compare(entry.queries()[name](spark, SF), duck(SF), entry.oracle_sql()[name])
    assert not problem and n > 0
