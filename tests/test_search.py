import math

import __spark_entry__ as entry
from tidegrid.plans import boosting
from tidegrid.plans import learning as ln


def test_drawn_settings():
    drawn = ln.trial_settings(400)
    assert ln.trial_settings(400) == drawn and ln.trial_settings(400, 7) != drawn
    assert ln.trial_settings(50) == drawn[:50] and len({tuple(x.values()) for x in drawn}) == 400
    assert {x["depth"] for x in drawn} == set(range(3, 13))
    bounds = {"leaves": (16, 128), "trees": (100, 1000), "step": (0.01, 0.3), "min_rows": (10, 100), "row_share": (0.5, 1.0), "feature_share": (0.5, 1.0), "l1": (1e-8, 10.0), "l2": (1e-8, 10.0)}
    for name, (low, high) in bounds.items():
        values = [x[name] for x in drawn]
        assert low <= min(values) and high - 0.1 * (high - low) < max(values) <= high
    # drawn on a log scale: half of the values are below the geometric mean of the ends
    for name, (low, high) in {n: bounds[n] for n in ("step", "l1", "l2")}.items():
        assert 160 < sum(x[name] < math.sqrt(low * high) for x in drawn) < 240


def test_registered_search_fits_fifty_drawn_trials_over_three_folds(spark, monkeypatch):
    asked = []

    def fit(binned, fits):
        asked.extend(fits)
        return [type("Model", (), {"history": [float(n + 1)]}) for n in range(len(fits))]

    monkeypatch.setattr(boosting, "fit_all", fit)
    trials = entry.queries()["random_search"](spark, "/root/testdata/sf0.001").collect()
    assert len(asked) == 150 and {f.role for f in asked} == {0, 1, 2} and len(trials) == 50
    for n, drawn in enumerate(ln.trial_settings(50)):
        for fit_of in asked[3 * n : 3 * n + 3]:
            assert all(getattr(fit_of.settings, k) == x for k, x in drawn.items())
