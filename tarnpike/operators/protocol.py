"""Choices that must not see the rows they are judged on: frozen operating points by fold, and rounds of boosting by vote of folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def frozen_arms(trades: DataFrame, windows: DataFrame, arms: list[str], least_trades: int, months: int | None = None, ts: str = "ts", pips: str = "pips") -> DataFrame:
    """(fold, arm, reason, select_trades, select_pips, test_trades, test_pips, oracle_arm, oracle_pips, regret): each fold's arm, chosen on its training time and measured
    on its test.

    ``trades`` has arm, ``ts`` and ``pips``; ``windows`` one row a fold: fold, train_start, train_end, test_start, test_end, all ends outside. Of arms with ``least_trades`` or more trades in
    the training time (its last ``months``, if given) the one with most pips is frozen, else that with most trades, the first in ``arms`` of equals; without any trade there is none. The oracle is
    the arm with most pips in the test, by which nothing is chosen; regret is what it had more.
    """
    begin = F.col("train_start") if months is None else F.greatest(F.col("train_start"), F.add_months(F.to_date("train_end"), -months).cast(windows.schema["train_start"].dataType))
    spans = F.broadcast(windows.select(F.array(F.struct("fold", begin.alias("a"), F.col("train_end").alias("b"), F.col("test_start").alias("c"), F.col("test_end").alias("d"))).alias("_w")).agg(F.flatten(F.collect_list("_w")).alias("_w")))  # one row
    at = F.col(ts)
    parts = F.filter(F.transform("_w", lambda w: F.struct(w["fold"].alias("fold"), F.when((at >= w["a"]) & (at < w["b"]), "select").when((at >= w["c"]) & (at < w["d"]), "test").alias("part"))), lambda p: p["part"].isNotNull())
    rows = trades.where(F.col("arm").isin(arms)).crossJoin(spans).select("arm", F.col(pips).alias("_p"), F.explode(parts).alias("_f")).select("arm", "_p", "_f.*")
    count = lambda part: F.count_if(F.col("part") == part)
    total = lambda part: F.coalesce(F.sum(F.when(F.col("part") == part, F.col("_p"))), F.lit(0.0))
    found = rows.groupBy("fold", "arm").agg(count("select").alias("select_trades"), total("select").alias("select_pips"), count("test").alias("test_trades"), total("test").alias("test_pips"))
    grid = windows.select("fold", F.posexplode(F.array(*map(F.lit, arms))).alias("_place", "arm"))  # folds by arms
    x = grid.join(found, ["fold", "arm"], "left").fillna(0, ["select_trades", "select_pips", "test_trades", "test_pips"])
    enough = (F.col("select_trades") >= least_trades).cast("int")
    choice = Window.partitionBy("fold").orderBy(F.desc(enough), F.desc(F.when(enough == 1, F.col("select_pips")).otherwise(F.col("select_trades").cast("double"))), "_place")
    best = Window.partitionBy("fold").orderBy(F.desc(F.col("test_trades") > 0), F.desc("test_pips"), "_place")
    x = x.withColumns({"_n": F.row_number().over(choice), "_traded": F.first("test_trades").over(best) > 0, "oracle_arm": F.first("arm").over(best), "oracle_pips": F.first("test_pips").over(best)})
    x = x.where("_n = 1").withColumn("reason", F.when(enough == 1, "best_pips").when(F.col("select_trades") > 0, "most_trades").otherwise("no_trades"))
    chosen, oracle = F.col("reason") != "no_trades", F.col("_traded")
    return x.select(
        "fold", F.when(chosen, F.col("arm")).alias("arm"), "reason", *(F.when(chosen, F.col(c)).alias(c) for c in ("select_trades", "select_pips", "test_trades", "test_pips")),
        F.when(oracle, F.col("oracle_arm")).alias("oracle_arm"), F.when(oracle, F.col("oracle_pips")).alias("oracle_pips"), F.when(chosen & oracle, F.col("oracle_pips") - F.col("test_pips")).alias("regret"),
    )


def round_votes(curves: DataFrame, most: int, flat: float = 0.005, least: int | None = None, curve: str = "curve") -> DataFrame:
    """``curves`` with ``vote``: the round where a fold's validation curve peaks, ``least`` at least (a tenth of ``most``, 20 at least), ``most`` where it hardly falls
    afterwards: by ``flat`` or less to the mean of its last tenth. Null for null and empty curves."""
    floor = min(max(20, most // 10) if least is None else least, most)
    c, n = F.col(curve), F.size(curve)
    tail = F.greatest(F.lit(1), F.floor(n / 10).cast("int"))
    late = F.aggregate(F.slice(c, n - tail + 1, tail), F.lit(0.0), lambda a, x: a + x) / tail
    peak = F.array_max(c)
    vote = F.when(peak - late <= flat, most).otherwise(F.greatest(F.array_position(c, peak).cast("int"), F.lit(floor)))
    return curves.withColumn("vote", F.when(n > 0, vote))


def voted_rounds(votes: DataFrame, keys: list[str], most: int, least: int | None = None) -> DataFrame:
    """(keys, rounds, votes): the median vote of the folds, half rounds to the even one. Votes for both the fewest and the most rounds are no consensus: the most counts then. Models
    without a vote are left out."""
    floor = min(max(20, most // 10) if least is None else least, most)
    g = votes.where("vote is not null").groupBy(*keys).agg(F.sort_array(F.collect_list("vote")).alias("votes"), F.median("vote").alias("_m"))
    split = F.array_contains("votes", floor) & F.array_contains("votes", most) & F.lit(floor < most)
    return g.select(*keys, F.when(split, most).otherwise(F.bround("_m", 0).cast("int")).alias("rounds"), "votes")


def mean_curves(curves: DataFrame, keys: list[str], curve: str = "curve") -> DataFrame:
    """(keys, round, value, folds): the mean of the folds' curves up to the end of the shortest; a view, by which nothing is chosen."""
    known = curves.where(F.size(curve) > 0).withColumn("_n", F.size(curve))
    shortest = known.groupBy(*keys).agg(F.min("_n").alias("_least"))
    x = known.join(shortest, keys).select(*keys, F.posexplode(F.slice(F.col(curve), F.lit(1), F.col("_least"))).alias("round", "_v"))
    return x.groupBy(*keys, (F.col("round") + 1).alias("round")).agg(F.avg("_v").alias("value"), F.count("*").alias("folds"))
