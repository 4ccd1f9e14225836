"""Frozen operating points and votes on rounds by hand."""

import datetime as dt

import pytest

from tarnpike.operators import protocol

D = lambda m, d=1: dt.datetime(2024, m, d)


def windows(spark):
    return spark.createDataFrame([(1, D(1), D(3), D(3, 5), D(5)), (2, D(3), D(5), D(5, 5), D(7)), (3, D(9), D(10), D(10), D(11))], "fold int, train_start timestamp, train_end timestamp, test_start timestamp, test_end timestamp")


TRADES = [("a", D(1, 5), 3.0), ("a", D(2, 5), 1.0), ("b", D(1, 6), 9.0), ("c", D(1, 7), 2.0), ("c", D(2, 7), 2.0), ("b", D(3, 2), 50.0), ("a", D(3, 6), -1.0), ("b", D(4, 1), 7.0), ("c", D(4, 2), 7.0), ("z", D(1, 1), 99.0)]


def frozen(spark, trades, **options):
    df = spark.createDataFrame(trades, "arm string, ts timestamp, pips double")
    return {r.fold: r for r in protocol.frozen_arms(df, windows(spark), ["a", "b", "c"], 2, **options).collect()}


def test_frozen_arms(spark):
    got = frozen(spark, TRADES)
    # a and c have two trades and four pips each: the first in the grid; the trade of the embargo counts nowhere
    assert (got[1].arm, got[1].reason, got[1].select_trades, got[1].select_pips, got[1].test_trades, got[1].test_pips) == ("a", "best_pips", 2, 4.0, 1, -1.0)
    assert (got[1].oracle_arm, got[1].oracle_pips, got[1].regret) == ("b", 7.0, 8.0)
    assert (got[2].arm, got[2].reason, got[2].oracle_arm, got[2].regret) == ("b", "best_pips", None, None)  # 50 and 7 pips
    assert (got[3].arm, got[3].reason, got[3].select_trades) == (None, "no_trades", None)
    assert frozen(spark, TRADES, months=1)[1].reason == "most_trades"  # one trade each in the last month


def test_test_rows_leave_the_choice_alone(spark):
    changed = [(a, t, p + 1000 * (t >= D(3, 5)) * (a == "c")) for a, t, p in TRADES]
    one, two = frozen(spark, TRADES)[1], frozen(spark, changed)[1]
    assert (one.arm, one.reason, one.select_pips, one.test_pips) == (two.arm, two.reason, two.select_pips, two.test_pips) and two.oracle_arm == "c" and two.regret > one.regret


def test_votes_on_rounds(spark):
    peak = lambda at, n=200: [0.5 + 0.3 * (1 - abs(i - at) / n) for i in range(1, n + 1)]
    rows = [("m", 1, peak(59)), ("m", 2, peak(3)), ("m", 3, [0.7] * 200), ("m", 4, peak(100)), ("m", 5, None), ("m", 6, []), ("k", 1, peak(50)), ("k", 2, peak(61)), ("few", 1, [0.5]), ("none", 1, None)]
    votes = protocol.round_votes(spark.createDataFrame(rows, "model string, fold int, curve array<double>"), 200)
    assert {(r.model, r.fold): r.vote for r in votes.collect()} == {("m", 1): 59, ("m", 2): 20, ("m", 3): 200, ("m", 4): 100, ("m", 5): None, ("m", 6): None, ("k", 1): 50, ("k", 2): 61, ("few", 1): 200, ("none", 1): None}
    got = {r.model: r for r in protocol.voted_rounds(votes, ["model"], 200).collect()}
    assert got["m"].rounds == 200 and got["m"].votes == [20, 59, 100, 200]  # fewest and most: no consensus
    assert got["k"].rounds == 56 and "none" not in got  # 55.5
    assert {r.model: r.rounds for r in protocol.voted_rounds(votes.where("vote <> 200"), ["model"], 200).collect()}["m"] == 59


def test_mean_curves_end_with_the_shortest(spark):
    rows = [("m", 1, [1.0, 2.0, 3.0]), ("m", 2, [3.0, 4.0]), ("m", 3, None), ("k", 1, [])]
    got = sorted(map(tuple, protocol.mean_curves(spark.createDataFrame(rows, "model string, fold int, curve array<double>"), ["model"]).collect()))
    assert got == [("m", 1, pytest.approx(2.0), 2), ("m", 2, pytest.approx(3.0), 2)]
