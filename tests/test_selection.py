"""Choice of features: bins and information by hand, chance against shuffles, shifted labels on noise and on signal."""

import datetime as dt
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnpike.operators import selection

T0 = dt.datetime(2024, 1, 1)


def test_rank_bins(spark):
    r = np.random.default_rng(1)
    rows = [(g, float(v)) for g, n in (("a", 500), ("b", 7), (None, 40)) for v in r.integers(0, 60, n)] + [("a", None)]
    got = selection.rank_bins(spark.createDataFrame(rows, "g string, x double"), ["g"], "x", 10).collect()
    assert len(got) == len(rows)
    for q in got:
        own = [v for g, v in rows if g == q.g and v is not None]
        assert q.bin == (None if q.x is None else math.floor(10 * sum(v < q.x for v in own) / len(own)))


def test_information_by_hand(spark):
    rows = [("a", 0, 0)] * 3 + [("a", 0, 1)] + [("a", 1, 1)] * 4 + [("b", 0, 1)] * 2
    got = {r.g: r for r in selection.information(spark.createDataFrame(rows, "g string, bin int, y int"), ["g"], "bin", "y").collect()}
    want = 3 / 8 * math.log(3 / 8 / (4 / 8 * 3 / 8)) + 1 / 8 * math.log(1 / 8 / (4 / 8 * 5 / 8)) + 4 / 8 * math.log(4 / 8 / (4 / 8 * 5 / 8))
    assert got["a"].n == 8 and got["a"].mi == pytest.approx(want) and got["b"].mi == pytest.approx(0)


def test_chance_is_that_of_shuffled_labels():
    r = np.random.default_rng(3)
    bins, labels = np.repeat(np.arange(5), [40, 60, 50, 30, 20]), np.repeat([0, 1], [140, 60])
    table = lambda y: np.array([[((bins == b) & (y == v)).sum() for v in (0, 1)] for b in range(5)], float)
    shuffled = selection._table_information(np.array([table(r.permutation(labels)) for _ in range(3000)]))
    drawn = selection.chance_information(np.bincount(bins), np.bincount(labels), 3000, 5)
    for q in (5, 50, 95):
        assert np.percentile(drawn, q) == pytest.approx(np.percentile(shuffled, q), rel=0.12)


def made(n=1_500):
    r = np.random.default_rng(2)
    rows = []
    for i in range(n):
        x, noise = float(r.normal()), float(r.normal())
        day = float(i // 96)  # one value for many rows
        rows.append(("s", T0 + dt.timedelta(minutes=15 * i), x, noise, day, 1.0, int(x + r.normal() > 0), float(i % 2) if i % 50 else None))
    return rows


SCHEMA = "symbol string, ts timestamp, x double, noise double, day double, same double, y int, regime double"


def test_information_filter(spark):
    df = spark.createDataFrame(made(), SCHEMA).unionByName(spark.createDataFrame([("s", T0, None, 1.0, 1.0, 1.0, 1, 1.0)], SCHEMA))
    got = {(r.feature, r.bucket): r for r in selection.information_filter(df, ["x", "noise", "day", "same"], "y", ["symbol"], "ts", F.col("regime")).collect()}
    assert {b for _, b in got} == {"signal", "other"} and got["x", "other"].n == sum(r[7] != 1 for r in made())
    assert got["x", "signal"].informative and got["x", "signal"].kept and got["x", "signal"].mi > got["x", "signal"].floor
    assert not got["same", "other"].evaluable and got["same", "other"].mi is None and got["same", "other"].kept  # no verdict, so it stays
    assert got["day", "signal"].n_eff == 16 and not got["day", "signal"].evaluable  # a run counts once
    assert [got[f, "other"].place for f in ("x", "noise", "day", "same")] == [0, 1, 2, 3]
    one = {r.feature: r for r in selection.information_filter(df, ["x", "noise"], "y", ["symbol"], "ts", F.lit(1.0)).collect()}
    assert one["x"].bucket == "all" and one["x"].kept and not one["noise"].informative and not one["noise"].kept


def test_a_bucket_of_one_label_has_no_vote(spark):
    df = spark.createDataFrame(made(600), SCHEMA).withColumn("y", F.when(F.col("regime") == 1, F.col("y")).otherwise(0))
    got = {(r.feature, r.bucket): r for r in selection.information_filter(df, ["noise"], "y", ["symbol"], "ts", F.col("regime")).collect()}
    assert not got["noise", "other"].votes and got["noise", "signal"].votes and not got["noise", "other"].kept
    flat = df.withColumn("y", F.lit(0))
    assert all(r.kept and not r.votes for r in selection.information_filter(flat, ["noise"], "y", ["symbol"], "ts", F.col("regime")).collect())


def test_permuted_labels_are_the_same_labels(spark):
    df = spark.createDataFrame(made(300), SCHEMA)
    got = selection.permuted_labels(df, "y", ["symbol"], "ts", 3).collect()
    want = Counter(r[6] for r in made(300))
    for p in (1, 2, 3):
        assert Counter(r.y for r in got if r.permutation == p) == want and len({r.ts for r in got if r.permutation == p}) == 300


def plain_shifted(x, y, folds, embargo, moves, ridge=1e-3):
    """Fits and areas one after another."""
    n, size, out = len(y), len(y) // (folds + 1), []
    x = np.column_stack([np.ones(n), x])
    for m in moves:
        moved = np.roll(y, m)
        areas = []
        for f in range(1, folds + 1):
            first = n - (folds - f + 1) * size
            a, b = x[: first - embargo].T @ x[: first - embargo], x[: first - embargo].T @ moved[: first - embargo]
            beta = np.linalg.solve(a + ridge * np.diag([0.0, *np.diag(a)[1:]]), b)
            s, t = x[first : first + size] @ beta, moved[first : first + size]
            areas.append(np.mean([(p > q) + 0.5 * (p == q) for p in s[t == 1] for q in s[t == 0]]))
        out.append(np.mean(areas))
    return out


def test_shifted_labels_against_plain_fits(spark):
    r = np.random.default_rng(4)
    n = 400
    x = r.normal(size=(n, 2))
    noise, signal = (r.random(n) < 0.5).astype(int), (x[:, 0] + 0.5 * r.normal(size=n) > 0).astype(int)
    df = spark.createDataFrame([(i, *map(float, x[i]), int(noise[i]), int(signal[i])) for i in range(n)] + [(n, None, 1.0, 1, 1)], "i long, a double, b double, noise int, signal int")
    moves = [0, *np.random.default_rng(7).integers(2, n - 2, 19).tolist()]
    for label, y in (("noise", noise), ("signal", signal)):
        got = selection.shifted_null(df, ["a", "b"], label, "i", 3, 2, 19, seed=7).first()
        want = plain_shifted(x, y, 3, 2, moves)
        assert got.n == n and got.n_folds == 3 and got.auc == pytest.approx(want[0], abs=2e-3)
        assert got.null_mean == pytest.approx(np.mean(want[1:]), abs=2e-3) and got.null_sd == pytest.approx(np.std(want[1:]), abs=3e-3)
        if label == "signal":
            assert got.p == 0.05 and got.auc > 0.9
        else:
            assert got.p > 0.05 and got.verdict == "none"


def test_too_few_rows_for_a_shift(spark):
    got = selection.shifted_null(spark.createDataFrame([(1, 1.0, 1)], "i long, a double, y int"), ["a"], "y", "i").first()
    assert got.n == 1 and got.auc is None and got.verdict is None
