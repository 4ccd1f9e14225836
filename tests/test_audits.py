"""Unit roots against plain regressions, published table values, overlaps against all pairs, weighted deviations against pandas."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tarnpike.functions import safe
from tarnpike.operators import align, evaluation, labels, unitroot

T0 = dt.datetime(2024, 1, 1)


def series(n=300, seed=1):
    r = np.random.default_rng(seed)
    noise = r.normal(size=n)
    ar = np.zeros(n)
    for i in range(2, n):
        ar[i] = 0.5 * ar[i - 1] + 0.3 * ar[i - 2] + noise[i]
    return {"walk": np.cumsum(noise) + 50, "ar": ar, "noise": r.normal(size=n), "flat": np.ones(n), "few": r.normal(size=10), "short": r.normal(size=25)}


@pytest.fixture(scope="module")
def table(spark):
    rows = [(k, T0 + dt.timedelta(days=i), float(v)) for k, x in series().items() for i, v in enumerate(x)] + [("ar", T0 - dt.timedelta(days=1), None)]
    return spark.createDataFrame(rows, "symbol string, ts timestamp, x double").cache()


def plain_adf(y):
    """The test by least squares on matrices, lags by Akaike on a common sample."""
    n, d = len(y), np.diff(y)
    most = min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2)

    def fit(lags, first):
        rows = range(first, len(d))
        x = np.array([[1.0, y[t], *(d[t - i] for i in range(1, lags + 1))] for t in rows])
        target = d[first:]
        beta = np.linalg.lstsq(x, target, rcond=None)[0]
        e = target - x @ beta
        cov = np.linalg.inv(x.T @ x) * (e @ e) / (len(e) - x.shape[1])
        return len(e) * (math.log(2 * math.pi * (e @ e) / len(e)) + 1) + 2 * x.shape[1], beta[1] / math.sqrt(cov[1, 1]), len(e)

    best = min((fit(k, most)[0], k) for k in range(most + 1))[1]
    _, stat, used = fit(best, best)
    return best, used, stat


def test_dickey_fuller_is_that_of_plain_regressions(spark, table):
    got = {r.symbol: r for r in unitroot.dickey_fuller(table, "x", ["symbol"], "ts").collect()}
    assert set(got) == {"walk", "ar", "noise", "short"}  # too few, or without variation
    for k in got:
        lags, used, stat = plain_adf(series()[k])
        assert (got[k].n, got[k].lags, got[k].used) == (len(series()[k]), lags, used) and got[k].stat == pytest.approx(stat, rel=1e-6)
    assert got["walk"].p > 0.05 and got["noise"].p < 0.001
    assert unitroot.dickey_fuller(table.limit(0), "x", ["symbol"], "ts").count() == 0
    one = unitroot.dickey_fuller(table, "x", ["symbol"], "ts", 0).where("symbol = 'ar'").first()
    assert one.lags == 0 and one.used == 299


def test_table_values():
    """Critical values of the Dickey-Fuller test with a constant: -3.43, -2.86 and -2.57."""
    for tau, p in ((-3.43, 0.01), (-2.86, 0.05), (-2.57, 0.10)):
        assert unitroot.mackinnon_p(tau) == pytest.approx(p, abs=0.002)
    assert unitroot.mackinnon_p(3.0) == 1.0 and unitroot.mackinnon_p(-30.0) == 0.0
    assert unitroot.mackinnon_p(-1.6101) == pytest.approx(unitroot.mackinnon_p(-1.6099), abs=2e-3)


def plain_kpss(x):
    n, e = len(x), x - x.mean()
    s0, s1 = e @ e / n, 0.0
    for i in range(1, int(n ** (2 / 9)) + 1):
        c = e[i:] @ e[:-i] / (n / 2)
        s0, s1 = s0 + c, s1 + i * c
    lags = int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3))
    variance = (e @ e + 2 * sum((1 - i / (lags + 1)) * (e[i:] @ e[:-i]) for i in range(1, lags + 1))) / n
    return lags, (np.cumsum(e) ** 2).sum() / n**2 / variance


def test_kpss_and_ljung_box(spark, table):
    got = {r.symbol: r for r in unitroot.kpss(table, "x", ["symbol"], "ts").collect()}
    box = {r.symbol: r for r in unitroot.ljung_box(table, "x", ["symbol"], "ts", 4).collect()}
    assert set(got) == set(box) == {"walk", "ar", "noise", "short"}
    for k in got:
        x = series()[k]
        lags, stat = plain_kpss(x)
        assert got[k].lags == lags and got[k].stat == pytest.approx(stat)
        e, n = x - x.mean(), len(x)
        q = n * (n + 2) * sum((e[i:] @ e[:-i] / (e @ e)) ** 2 / (n - i) for i in range(1, 5))
        assert box[k].stat == pytest.approx(q) and box[k].p == pytest.approx(math.exp(-q / 2) * (1 + q / 2))
    assert got["walk"].p == 0.01 and got["noise"].p > 0.05
    assert unitroot.kpss(table.limit(0), "x", ["symbol"], "ts").count() == 0
    with pytest.raises(ValueError):
        unitroot.ljung_box(table, "x", ["symbol"], "ts", 3)


def runs(on, at):
    out = []
    for i, v in enumerate(on):
        if v == 1 and out and out[-1][-1] == i - 1 and at[i] - at[i - 1] <= 1:
            out[-1].append(i)
        elif v == 1:
            out.append([i])
    return out


def test_event_overlap_is_that_of_all_runs(spark):
    r = np.random.default_rng(5)
    rows = [(k, int(a), int(y), int(p)) for k in "abc" for a, y, p in zip(np.cumsum(r.choice([1, 1, 1, 1, 3], 200)), r.random(200) < 0.5, r.random(200) < 0.4, strict=True)]
    rows += [("none", i, 0, None) for i in range(3)] + [("unknown", 0, None, 1)]
    got = {x.k: x for x in evaluation.event_overlap(spark.createDataFrame(rows, "k string, at int, y int, p int"), "y", "p", ["k"], "at").collect()}
    for k in "abc":
        own = [x for x in rows if x[0] == k]
        at, y, p = ([x[i] for x in own] for i in (1, 2, 3))
        actual, predicted = runs(y, at), runs(p, at)
        hits = [[i for i in e if p[i] == 1] for e in actual]
        true = sum(any(set(e) & set(q) for e in actual) for q in predicted)
        g = got[k]
        assert (g.events, g.detected, g.predicted, g.true_predicted) == (len(actual), sum(map(bool, hits)), len(predicted), true)
        assert g.recall == pytest.approx(sum(map(bool, hits)) / len(actual)) and g.precision == pytest.approx(true / len(predicted))
        assert g.mean_lag == pytest.approx(np.mean([h[0] - e[0] for h, e in zip(hits, actual, strict=True) if h])) and g.mean_predictions == pytest.approx(np.mean(list(map(len, hits))))
    assert got["none"].events == 0 and got["none"].recall is None and got["unknown"].predicted == 1 and got["unknown"].precision == 0


def test_overlap_join_is_that_of_all_pairs(spark):
    r = np.random.default_rng(6)
    made = lambda n: [(int(k), int(s), int(s + w)) for k, s, w in zip(r.integers(0, 3, n), r.integers(-50, 200, n), r.choice([0, 1, 3, 10, 60], n), strict=True)]
    a, b = made(120) + [(0, None, 5), (0, 9, 3)], made(100) + [(1, 4, None)]
    schema = "k int, start int, end int"
    want = sorted((k, s, e, t, f) for k, s, e in a for j, t, f in b if k == j and None not in (s, t, f) and s <= e and s <= f and t <= e)
    for width in (1, 7, 1000):
        got = align.overlap_join(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), ["k"], width)
        assert sorted(map(tuple, got.select("k", "start", "end", "start_b", "end_b").collect())) == want


def test_weighted_deviation_is_that_of_pandas(spark):
    r = np.random.default_rng(7)
    rows = [(s, T0 + dt.timedelta(days=i), float(v)) for s in "ab" for i, v in enumerate(r.normal(0.1, 1, 150))] + [("one", T0, 1.0)]
    got = safe.weighted_deviation(spark.createDataFrame(rows, "symbol string, ts timestamp, x double"), "x", 20, "d").orderBy("symbol", "ts").toPandas()
    for s in "ab":
        want = pd.Series([v for k, _, v in rows if k == s]).ewm(span=20).std()
        assert np.allclose(got[got.symbol == s].d.to_numpy(float), want.to_numpy(), equal_nan=True)
    assert got[got.symbol == "one"].d.isna().all()


def test_volatility_targets_use_days_before(spark):
    days = [("a", T0 + dt.timedelta(days=i), c) for i, c in enumerate([100.0, 101.0, 99.0, 102.0, 100.0])]
    hours = [("a", T0 + dt.timedelta(days=4, hours=h), 100.0 + h) for h in (0, 5)] + [("a", T0 + dt.timedelta(hours=3), 100.0)]
    x = labels.volatility_targets(spark.createDataFrame(hours, "symbol string, ts timestamp, close double"), spark.createDataFrame(days, "symbol string, ts timestamp, close double"), 10, 2.0, 1.0, pip=0.01, low=1.0, high=300.0)
    v = pd.Series(np.diff(np.log([100.0, 101.0, 99.0, 102.0]))).ewm(span=10).std().iloc[-1]
    got = {r.ts: r for r in x.collect()}
    first, later, early = (got[t] for _, t, _ in hours)
    assert first.volatility == later.volatility == pytest.approx(v) and early.volatility is None and early.target is None
    assert later.stop_pips == pytest.approx(min(105 * v / 0.01, 300)) and later.target == pytest.approx(min(2 * 105 * v / 0.01, 300) * 0.01)
