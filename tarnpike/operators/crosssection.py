"""Panels kept long (date, symbol, value): cross-sectional ranks, dispersion, strengths and rolling relations."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnpike.functions.safe import before_n, correlation, framed, last_n, mean_n, ordered, rank_prev_le, sdiv, sln


def log_returns(panel: DataFrame, value: str, most_days: int = 14, date: str = "date") -> DataFrame:
    """With ``ret``: log returns by symbol; rows after a gap of more than ``most_days`` go."""
    w = ordered("symbol", by=date)
    x = panel.withColumn("_gap", F.datediff(date, F.lag(date).over(w))).withColumn("ret", sln(sdiv(F.col(value), F.lag(value).over(w))))
    return x.where(F.col("_gap").isNull() | (F.col("_gap") <= most_days)).drop("_gap")


def cross_rank(panel: DataFrame, value: str, date: str = "date") -> DataFrame:
    """Rank share with average ties, z with the population deviation (null at 0), breadth (share of others below; null if any is unknown)."""
    day = Window.partitionBy(date)
    n, ties = F.count(value).over(day), F.count("*").over(Window.partitionBy(date, value))
    x = F.col(value)
    rank = F.rank().over(Window.partitionBy(date, x.isNull()).orderBy(value))
    full = F.count("*").over(day) == n
    return panel.withColumns(
        {
            "xs_rank": F.when(x.isNotNull(), (rank + (ties - 1) / 2.0) / n),
            "xs_z": sdiv(x - F.avg(value).over(day), F.stddev_pop(value).over(day)),
            "breadth": F.when(full & (n > 1), (rank - 1) / (n - 1.0)),
        }
    )


def dispersion(panel: DataFrame, value: str, smooth: int = 20, least: int = 10, n: int = 500, n_least: int = 125, date: str = "date") -> DataFrame:
    """(date, dispersion, smoothed, share of days before not above). smoothed has 6 digits, so that equal days tie."""
    x = panel.groupBy(date).agg(F.stddev_pop(value).alias("dispersion"))
    w = Window.orderBy(date)
    return x.withColumn("smoothed", F.round(mean_n("dispersion", w, smooth, least), 6)).withColumn("dispersion_pct", rank_prev_le("smoothed", w, n, n_least))


def strength_weights(pairs: list[tuple[str, str, str]]) -> list[tuple[str, str, float]]:
    """(symbol, unit, weight): the least-norm solution of pair returns = base strength - quote strength.

    Raises unless every unit hangs together with the others by pairs. A few numbers, on the driver.
    """
    units = sorted({u for _, b, q in pairs for u in (b, q)})
    a = np.zeros((len(pairs), len(units)))
    for i, (_, b, q) in enumerate(pairs):
        a[i, units.index(b)], a[i, units.index(q)] = 1, -1
    if np.linalg.matrix_rank(a) != len(units) - 1:
        raise ValueError("pairs do not connect all units")
    p = np.linalg.pinv(a)
    return [(s, u, float(p[j, i])) for i, (s, _, _) in enumerate(pairs) for j, u in enumerate(units)]


def strengths(panel: DataFrame, pairs: list[tuple[str, str, str]], value: str = "ret", date: str = "date") -> DataFrame:
    """(date, unit, strength) on dates on which every pair is known. The weights, pairs x units of them, are broadcast."""
    spark = panel.sparkSession
    weights = spark.createDataFrame(strength_weights(pairs), "symbol string, unit string, weight double")
    full = panel.where(F.col(value).isNotNull()).join(F.broadcast(weights), "symbol")
    each = full.groupBy(date, "unit").agg(F.sum(F.col(value) * F.col("weight")).alias("strength"), F.count("*").alias("_n"))
    return each.where(F.col("_n") == len(pairs)).drop("_n")


def residual_rms(panel: DataFrame, found: DataFrame, pairs: list[tuple[str, str, str]], value: str = "ret", date: str = "date") -> DataFrame:
    """(symbol, rms): what strengths leave unexplained."""
    named = panel.sparkSession.createDataFrame(pairs, "symbol string, base string, quote string")
    b, q = found.select(date, F.col("unit").alias("base"), F.col("strength").alias("sb")), found.select(date, F.col("unit").alias("quote"), F.col("strength").alias("sq"))
    x = panel.join(F.broadcast(named), "symbol").join(b, [date, "base"]).join(q, [date, "quote"])
    return x.groupBy("symbol").agg(F.sqrt(F.avg(F.pow(F.col(value) - F.col("sb") + F.col("sq"), F.lit(2)))).alias("rms"))


def rolling_relation(df: DataFrame, y: str, x: str, n: int, keys: list[str], ts: str = "ts") -> DataFrame:
    """Correlation, slope of y on x over n rows with both known, and the lead-lag prediction: slope on the lagged x up to the row before, times x."""
    w = ordered(*keys, by=ts)
    both = F.col(y).isNotNull() & F.col(x).isNotNull()
    r = df.withColumn("_y", F.when(both, F.col(y))).withColumn("_x", F.when(both, F.col(x))).withColumn("_l", F.lag(x).over(w))
    f = last_n(w, n)
    pair = F.when(F.col("_l").isNotNull() & F.col(y).isNotNull(), 1)
    r = r.withColumn("_lx", F.when(pair == 1, F.col("_l"))).withColumn("_ly", F.when(pair == 1, F.col(y)))
    beta = F.when(F.count("_lx").over(f) >= n, sdiv(F.covar_samp("_lx", "_ly").over(f), F.var_samp("_lx").over(f)))
    r = r.withColumn("_beta", beta)
    return r.withColumns(
        {
            f"corr_{n}": F.when(F.count("_x").over(f) >= n, correlation("_x", "_y", f)),
            f"beta_{n}": F.when(F.count("_x").over(f) >= n, sdiv(F.covar_samp("_x", "_y").over(f), F.var_samp("_x").over(f))),
            f"lead_{n}": F.lag("_beta").over(w) * F.col(x),
        }
    ).drop("_y", "_x", "_l", "_lx", "_ly", "_beta")


def causal_z(df: DataFrame, x: str, n: int, keys: list[str], out: str, ts: str = "ts") -> DataFrame:
    w = ordered(*keys, by=ts)
    f = before_n(w, n)
    return df.withColumn(out, sdiv(F.col(x) - framed(F.avg(x), F.col(x), f, n // 2), framed(F.stddev_samp(x), F.col(x), f, n // 2)))
