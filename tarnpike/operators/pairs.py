"""Features across the series of a panel (symbol, ts, close): pressure of a group, leads, breaks of correlation, volatility, risk.

Series meet at equal times alone and are never filled: a series without a bar at a time is unknown there. Windows run by symbol, what
is across symbols is an aggregation by time or a join by time, so no window goes over one order of everything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnpike.functions.safe import correlation, framed, last_n, ordered, rank_avg, sdiv, sln, std_n, sum_n, zscore_before
from tarnpike.operators.sequences import masked_returns
from tarnpike.operators.volume import least


def on_grid(panel: DataFrame, grid: str, symbols: list[str], ts: str = "ts") -> DataFrame:
    """Closes of the symbols at the times of the symbol ``grid``, one row a symbol and time, null where it has no bar."""
    times = panel.where(F.col("symbol") == grid).select(ts)
    named = panel.sparkSession.createDataFrame([(s,) for s in symbols], "symbol string")
    return times.crossJoin(F.broadcast(named)).join(panel.select("symbol", ts, F.when(F.col("close") > 0, F.col("close")).alias("close")), ["symbol", ts], "left")  # as many rows a time as symbols


def group_scores(panel: DataFrame, grid: str, signs: dict[str, float], w: int, z: int, ts: str = "ts") -> DataFrame:
    """(ts, breadth, strength, dispersion) of a group at the times of ``grid``: mean sign of its signed w-bar log moves, and mean and population deviation of
    each move's z against the z bars before; null unless all are known."""
    by = ordered("symbol", by=ts)
    sign = F.create_map(*(F.lit(v) for kv in signs.items() for v in kv))
    x = on_grid(panel, grid, list(signs), ts).withColumn("_m", F.element_at(sign, F.col("symbol")) * (F.ln("close") - F.lag(F.ln("close"), w).over(by)))
    x = x.withColumn("_z", zscore_before("_m", by, z))
    whole = lambda c, agg: F.when(F.count(c) == len(signs), agg)
    return x.groupBy(ts).agg(whole("_m", F.avg(F.signum("_m"))).alias("breadth"), whole("_z", F.avg("_z")).alias("strength"), whole("_z", F.stddev_pop("_z")).alias("dispersion"))


def consensus(a: DataFrame, b: DataFrame, ts: str = "ts") -> DataFrame:
    """(ts, consensus): half of one group's strength less another's."""
    return a.select(ts, F.col("strength").alias("_a")).join(b.select(ts, F.col("strength").alias("_b")), ts, "full").select(ts, (0.5 * (F.col("_a") - F.col("_b"))).alias("consensus"))


def pair_scores(panel: DataFrame, grid: str, others: list[str], w: int, z: int, ts: str = "ts") -> DataFrame:
    """(symbol, ts, llpred, corrbk, rvz, risk_z) of each other series at the times of ``grid``.

    llpred: the slope of grid's return on the other's return a bar before, over w bars and read one bar back, times the other's return, in deviations of grid's
    returns one bar back. corrbk: percent rank, ties at their average, of their correlation over w bars among the last z. rvz: z of the log of the root
    of the sum of squared returns over w. risk_z: z of the w-bar log move. Returns are null across gaps; z runs against the z bars before.
    """
    base = masked_returns(panel.where(F.col("symbol") == grid)).select(ts, F.col("r").alias("_y"))
    x = masked_returns(on_grid(panel, grid, others, ts)).join(base, ts)
    by = ordered("symbol", by=ts)
    f = last_n(by, w)
    x = x.withColumn("_l", F.lag("r").over(by))
    pair = F.col("_l").isNotNull() & F.col("_y").isNotNull()
    x = x.withColumns({"_ly": F.when(pair, F.col("_y")), "_lx": F.when(pair, F.col("_l"))})
    beta = sdiv(framed(F.covar_samp("_ly", "_lx"), F.col("_lx"), f, least(w)), framed(F.var_samp("_l"), F.col("_l"), f, least(w)))
    x = x.withColumns({"_beta": beta, "_sd": std_n("_y", by, w, least(w))})
    both = F.when(F.col("_y").isNotNull() & F.col("r").isNotNull(), 1)
    x = x.withColumns({"_c": F.when(F.count(both).over(f) >= least(w), correlation("_y", "r", f)), "_rv": sln(F.sqrt(sum_n(F.col("r") * F.col("r"), by, w, least(w)))), "_m": F.ln("close") - F.lag(F.ln("close"), w).over(by)})
    return x.select(
        "symbol", ts, sdiv(F.lag("_beta").over(by) * F.col("r"), F.lag("_sd").over(by)).alias("llpred"), rank_avg("_c", by, z, max(2, z // 2)).alias("corrbk"),
        zscore_before("_rv", by, z).alias("rvz"), zscore_before("_m", by, z).alias("risk_z"),
    )
