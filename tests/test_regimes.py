"""Regimes: chunked fits against plain ones, choice of states, meaning, causal inference."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tarnpike.operators import regimes

T0 = dt.datetime(2024, 1, 1)


def made(seed=1, n=240, series=("a", "b")):
    """Two series that stay for a while in one of two states."""
    r = np.random.default_rng(seed)
    rows = []
    for s in series:
        state = 0
        for i in range(n):
            state = state if r.random() < 0.93 else 1 - state
            x = r.normal([(-1.0, 0.3), (1.5, 1.0)][state], [(0.5, 0.2), (0.8, 0.3)][state])
            rows.append((s, T0 + dt.timedelta(hours=i), float(x[0]), float(x[1]), float(abs(x[0]) + 0.1), state))
    return rows


@pytest.fixture(scope="module")
def table(spark):
    df = spark.createDataFrame(made(), "symbol string, ts timestamp, x double, y double, z double, state int")
    # rows with an unknown feature are not observed
    return df.unionByName(spark.createDataFrame([("a", T0 + dt.timedelta(hours=500), None, 1.0, 1.0, 0), ("few", T0, 1.0, 1.0, 1.0, 0)], df.schema)).cache()


def plain_em(x, m, rounds, tol=1e-3):
    """Baum-Welch by its textbook recursions over the whole series."""
    start, move, means, covs, value = m.start.copy(), m.move.copy(), m.means.copy(), m.covs.copy(), -np.inf
    for i in range(rounds + 1):
        b = np.exp(regimes.log_density(x, means, covs))
        n, k = b.shape
        a, c = np.empty((n, k)), np.empty(n)
        for t in range(n):
            a[t] = (start if t == 0 else a[t - 1] @ move) * b[t]
            c[t] = a[t].sum()
            a[t] /= c[t]
        loglik = np.log(c).sum()
        if loglik - value <= tol or i == rounds:
            value = loglik
            break
        value = loglik
        w = np.ones((n, k))
        for t in range(n - 2, -1, -1):
            w[t] = move @ (b[t + 1] * w[t + 1]) / c[t + 1]
        post = a * w
        pairs = sum(np.outer(a[t - 1], b[t] * w[t]) * move / c[t] for t in range(1, n))
        start, move = post[0] / post[0].sum(), pairs / pairs.sum(1, keepdims=True)
        means = post.T @ x / post.sum(0)[:, None]
        covs = np.array([(post[:, j, None] * (x - means[j])).T @ (x - means[j]) / post[:, j].sum() + regimes.RIDGE * np.eye(x.shape[1]) for j in range(k)])
    return start, move, means, covs, value


def test_products_of_all_lengths():
    r = np.random.default_rng(0)
    for n in range(1, 20):
        ops, want = r.random((n, 3, 3)), np.eye(3)
        products, logs = regimes.running_products(ops, np.zeros(n))
        for i in range(n):
            want = want @ ops[i]
            assert np.allclose(products[i] * np.exp(logs[i]), want)
        whole, log = regimes.whole_product(ops, np.zeros(n))
        assert np.allclose(whole * np.exp(log), want)
        back = regimes.backward(ops, np.zeros(n), np.array([1.0, 2.0, 3.0]))
        w = np.array([1.0, 2.0, 3.0])
        for i in range(n - 1, -1, -1):
            assert np.allclose(back[i] / back[i].sum(), w / w.sum())
            w = ops[i] @ w


@pytest.mark.parametrize(("seconds", "most"), [(10**7, 512), (36 * 3600, 512), (5 * 3600, 4)])
def test_hidden_markov_fit_is_that_of_the_whole_series(spark, table, monkeypatch, seconds, most):
    monkeypatch.setattr(regimes, "COMPOSED", most)
    features = ["x", "y"]
    chunks = regimes.scaled_chunks(table, features, ["symbol"], "ts", seconds)
    rounds = 4 if most < 512 else 12
    got = regimes.fit_models(chunks, ["symbol"], 2, "hmm", [2], rounds=rounds, restarts=2)
    assert set(got) == {(("a",), 2), (("b",), 2)}  # too few rows of the third
    means = regimes.fit_models(chunks, ["symbol"], 2, "kmeans", [2], restarts=2)
    for s in ("a", "b"):
        x = np.array([[r[2], r[3]] for r in made() if r[0] == s])
        x = (x - x.mean(0)) / x.std(0)
        begin = regimes.Model(np.full(2, 0.5), np.full((2, 2), 0.5), means[(s,), 2].means, np.tile(np.eye(2) * 1.001, (2, 1, 1)))
        start, move, mu, covs, value = plain_em(x, begin, rounds)
        m = got[(s,), 2]
        for a, b in ((m.start, start), (m.move, move), (m.means, mu), (m.covs, covs)):
            assert np.allclose(a, b, atol=1e-6)
        assert m.value == pytest.approx(value, abs=1e-5)


def test_states_are_found_and_read_causally(spark, table):
    scored = regimes.regime_scores(table, ["x", "y", "z"], ["symbol"], "ts", 72 * 3600, "hmm", 2, rounds=20, restarts=2).toPandas()
    assert len(scored) == table.count() and scored[scored.symbol == "few"].rgm_label.isna().all() and scored[scored.x.isna()].rgm_conf.isna().all()
    known = scored[scored.rgm_label.notna()]
    assert (known.rgm_prob_s0 + known.rgm_prob_s1).to_numpy() == pytest.approx(1.0)
    assert (known.rgm_label == known.state).mean() > 0.93  # the second state drifts more, so it is the later one
    assert known.rgm_trend_score.between(-1, 1).all() and known.rgm_vol_score.between(0, 1).all()
    # rows to come do not matter once models are fitted: the same start of the series, scored alone with the same models
    cut = T0 + dt.timedelta(hours=150)
    whole = regimes.regime_scores(table, ["x", "y", "z"], ["symbol"], "ts", 72 * 3600, "hmm", 2, fit_until=cut, rounds=8, restarts=2).where(F.col("ts") < cut)
    part = regimes.regime_scores(table.where(F.col("ts") < cut), ["x", "y", "z"], ["symbol"], "ts", 72 * 3600, "hmm", 2, rounds=8, restarts=2)
    a, b = (d.orderBy("symbol", "ts").toPandas() for d in (whole, part))
    pd.testing.assert_frame_equal(a, b)


def test_states_keep_their_names_under_another_seed(spark, table):
    one, two = (regimes.regime_scores(table, ["x", "y", "z"], ["symbol"], "ts", 10**7, "mixture", 2, seed=s, restarts=2).where("rgm_label is not null").orderBy("symbol", "ts").toPandas() for s in (1, 99))
    assert (one.rgm_label == two.rgm_label).mean() > 0.99


def test_meaning_by_hand():
    order, trend, vol = regimes.meaning(np.array([[0.3, 2.0, 9.0, 0.5], [-0.1, 4.0, 9.0, 1.0], [0.1, 3.0, 9.0, 0.25]]))
    # drifts less their mean 0.1: 0.2, -0.2, 0; over 0.2: 1, -1, 0; times efficiency 0.5, 1, 0.25
    assert order.tolist() == [1, 2, 0] and trend.tolist() == pytest.approx([-1, 0, 0.5]) and vol.tolist() == [1.0, 0.5, 0.0]
    order, trend, vol = regimes.meaning(np.ones((3, 4)))
    assert order.tolist() == [0, 1, 2] and trend.tolist() == [0, 0, 0] and vol.tolist() == [0, 0, 0]


def test_silhouette_by_hand():
    x, labels = np.array([[0.0], [1.0], [10.0], [12.0], [30.0]]), np.array([0, 0, 1, 1, 2])
    want = [(11 - 1) / 11, (10 - 1) / 10, (9.5 - 2) / 9.5, (11.5 - 2) / 11.5, 0]
    assert regimes.silhouette(x, labels) == pytest.approx(sum(want) / 5)
    assert regimes.silhouette(x, np.zeros(5)) is None


@pytest.mark.parametrize("kind", ["hmm", "mixture", "kmeans"])
def test_choice_of_states(spark, table, kind):
    out = regimes.select_states(table, ["x", "y"], ["symbol"], "ts", 10**7, kind, [2, 3], rounds=15, restarts=2).toPandas()
    assert sorted(zip(out.symbol, out.k, strict=True)) == [("a", 2), ("a", 3), ("b", 2), ("b", 3)]
    for r in out.itertuples():
        free = r.k - 1 + 2 * r.k + 3 * r.k + (r.k * (r.k - 1) if kind == "hmm" else 0)
        if kind == "kmeans":
            assert r.inertia > 0 and np.isnan(r.bic)
        else:
            assert r.bic == pytest.approx(-2 * r.loglik + free * np.log(240)) and r.aic == pytest.approx(-2 * r.loglik + 2 * free)
        assert -1 <= r.silhouette <= 1
    assert out.groupby("symbol").best.sum().tolist() == [1, 1]
    if kind == "hmm":
        assert out[out.best].k.tolist() == [2, 2]


def test_mixture_log_likelihood_by_hand(spark, table):
    chunks = regimes.scaled_chunks(table, ["x", "y"], ["symbol"], "ts", 30 * 3600)
    m = regimes.fit_models(chunks, ["symbol"], 2, "mixture", [2], restarts=2)[("a",), 2]
    x = np.array([[r[2], r[3]] for r in made() if r[0] == "a"])
    x = (x - x.mean(0)) / x.std(0)
    density = sum(w * np.exp(-0.5 * np.einsum("ti,ij,tj->t", x - mu, np.linalg.inv(c), x - mu)) / (2 * np.pi * np.sqrt(np.linalg.det(c))) for w, mu, c in zip(m.start, m.means, m.covs, strict=True))
    assert m.value == pytest.approx(np.log(density).sum()) and m.start.sum() == pytest.approx(1)


@pytest.mark.parametrize("most", [512, 3])
def test_filter_with_given_parameters_in_chunks(spark, table, monkeypatch, most):
    monkeypatch.setattr(regimes, "COMPOSED", most)
    got = regimes.markov_filter(table, "x", ["symbol"], "ts", [-1.0, 1.0, 0.0], [0.5, 1.0, 2.0], 0.8, 10 * 3600).toPandas()
    assert len(got) == table.count()
    rows = {s: sorted((r.ts, r.x) for r in table.where(F.col("symbol") == s).collect()) for s in ("a", "few")}
    move = np.full((3, 3), 0.1) + 0.7 * np.eye(3)
    for s, values in rows.items():
        p, want = np.full(3, 1 / 3), []
        for _, v in values:
            p = p @ move
            if v is not None:
                p = p * np.exp(-0.5 * ((v - np.array([-1.0, 1.0, 0.0])) / np.array([0.5, 1.0, 2.0])) ** 2) / np.array([0.5, 1.0, 2.0])
            p = p / p.sum()
            want.append(p)
        found = np.array(got[got.symbol == s].sort_values("ts").prob.tolist())
        assert np.allclose(found, np.array(want))


def test_empty_tables_and_wrong_states(spark, table):
    none = table.limit(0)
    assert regimes.regime_scores(none, ["x", "y", "z"], ["symbol"], "ts", 3600, "hmm", 2).count() == 0
    assert regimes.select_states(none, ["x", "y"], ["symbol"], "ts", 3600, "mixture", [2]).count() == 0
    assert regimes.markov_filter(none, "x", ["symbol"], "ts", [0.0, 1.0], [1.0, 1.0], 0.9, 3600).count() == 0
    scored = none.withColumn("rgm_prob_s0", F.lit(1.0))
    assert regimes.checked_states(scored, "hmm", "hmm", [0]) is scored
    for kind, wanted in (("mixture", [0]), ("hmm", [0, 1])):
        with pytest.raises(ValueError):
            regimes.checked_states(scored, kind, "hmm", wanted)


def test_economics_of_states_by_hand(spark):
    rows = [("a", T0 + dt.timedelta(days=i), c, s) for i, (c, s) in enumerate([(100.0, 0), (101.0, 0), (100.0, 1), (102.0, None), (103.0, 1), (101.0, 0)])]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, close double, state int")
    got = {r.state: r for r in regimes.state_economics(df, "state", "close", ["symbol"], "ts").collect()}
    zero = 1e4 * np.log([101 / 100, 100 / 101])
    assert got[0].n == 2 and got[0].fwd_ret_bp == pytest.approx(zero.mean()) and got[0].fwd_vol_bp == pytest.approx(zero.std(ddof=1))
    assert got[1].n == 2 and got[0].dwell == got[1].dwell == pytest.approx(5 / 3)


def test_share_threshold(spark):
    df = spark.createDataFrame([(x,) for x in [-1.0, 0.2, 0.4, -0.6, 0.8, None]], "s double")
    assert regimes.share_threshold(df, "s", 0.4).first()[0] == pytest.approx(np.quantile([1.0, 0.2, 0.4, 0.6, 0.8], 0.6))
