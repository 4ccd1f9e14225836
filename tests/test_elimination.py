"""Stable selection against plain fits and hand votes; planted useless columns go."""

import datetime as dt

import numpy as np
import pytest

from tarnpike.operators import elimination

START = "2020-01-01"
FEATURES = ["good", "twin", "weak", "junk", "junk2"]


def rows(n=1_400, seed=3):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 5))
    x[:, 1] = x[:, 0] + 0.05 * r.normal(size=n)
    y = x[:, 0] + 0.5 * x[:, 2] + r.normal(size=n)
    at = [dt.datetime(2020, 1, 1) + dt.timedelta(hours=18 * i) for i in range(n)]
    return at, x, y


@pytest.fixture(scope="module")
def sums(spark):
    at, x, y = rows()
    data = [(t, *map(float, v), float(w)) for t, v, w in zip(at, x, y, strict=True)]
    df = spark.createDataFrame([*data, (dt.datetime(2020, 5, 5), None, 1.0, 1.0, 1.0, 1.0, 1.0), (dt.datetime(2019, 12, 31), *[9.0] * 6)], "ts timestamp, good double, twin double, weak double, junk double, junk2 double, y double")
    return df, elimination.block_sums(df, FEATURES, "y", "ts", START, 5)


def months(t):
    return (t.year - 2020) * 12 + t.month - 1


def test_windows_are_those_of_rows(sums):
    at, x, y = rows()
    z = np.column_stack([np.ones(len(y)), x, y])
    windows = elimination.rolling_windows(sums[1], 12, 4, 4)
    assert [w.label for w in windows][:2] == ["0..12..16", "4..16..20"]
    block = np.array([months(t) for t in at])
    late = np.array([t.day > 5 for t in at])
    for k, w in enumerate(windows):
        first = 4 * k
        on = (block >= first) & (block < first + 12)
        assert np.allclose(w.train, z[on].T @ z[on])
        for i, t in enumerate(w.tests):
            own = (block == first + 12 + i) & (late | (i > 0))
            assert np.allclose(t, z[own].T @ z[own])
    with pytest.raises(ValueError):
        elimination.rolling_windows({(b, False): np.zeros((3, 3)) for b in range(20)}, 12, 4, 4)


def test_skill_is_that_of_fitted_rows(sums):
    at, x, y = rows()
    w = elimination.rolling_windows(sums[1], 12, 4, 4)[0]
    block = np.array([months(t) for t in at])
    on = block < 12
    z = np.column_stack([np.ones(len(y)), x[:, [0, 2]]])
    beta = np.linalg.lstsq(z[on], y[on], rcond=None)[0]
    own = block == 14
    want = 1 - ((y[own] - z[own] @ beta) ** 2).sum() / ((y[own] - y[on].mean()) ** 2).sum()
    assert elimination._skills(w, [1, 3])[2] == pytest.approx(want, abs=1e-4)


def test_non_inferior_by_hand():
    # mean 0, deviation 0.01, three values: the interval ends at -0.0113
    d = np.array([-0.01, 0.0, 0.01])
    assert elimination.non_inferior(d, 0.012) and not elimination.non_inferior(d, 0.011) and not elimination.non_inferior(d[:1], 1.0)


def test_votes_count_windows(sums):
    windows = elimination.rolling_windows(sums[1], 12, 4, 4)[:3]
    base, less = [1, 2, 3, 4, 5], [1, 2, 3, 4]
    n = sum(elimination.non_inferior(elimination._skills(w, less) - elimination._skills(w, base), 0.02) for w in windows)
    for k in (1, 2, 3):
        mean, found, passes = elimination.vote(windows, base, {"x": less}, 0.02, k)["x"]
        assert found == n and passes == (n >= k)


def test_useless_and_doubled_columns_go(spark, sums):
    kept, votes = elimination.stable_selection(sums[0], FEATURES, "y", "ts", START, 12, 4, 4, margin=0.03)
    v = votes.collect()
    assert kept == ["good", "weak"]
    assert v[0].phase == "collapse" and v[0].candidate == "twin" and v[0].dropped
    assert [x.candidate for x in v if x.phase == "eliminate" and x.dropped] in (["junk", "junk2"], ["junk2", "junk"])
    assert v[-1].phase == "confirm" and v[-1].passes
    # an earlier run's state goes on to the same end
    again = elimination.eliminate(elimination.rolling_windows(sums[1], 12, 4, 4), FEATURES, 0.03, kept=["good", "weak", "junk2"])
    assert again.kept == ["good", "weak"] and again.reason == "no feature can go"
    strict = elimination.eliminate(elimination.rolling_windows(sums[1], 12, 4, 4), FEATURES, -1.0)
    assert strict.kept == FEATURES and strict.reason == "no feature can go"
    with pytest.raises(ValueError):
        elimination.eliminate(elimination.rolling_windows(sums[1], 12, 4, 4)[:2], FEATURES, 0.02)
