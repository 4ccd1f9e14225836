"""Unit-root tests of many series at once: augmented Dickey-Fuller with chosen lags, KPSS with a chosen bandwidth, Ljung-Box.

Regressions are sums of products, one row a task and series, added up by Spark and solved where there is one row a series.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnpike.functions.safe import ordered, schema_with

#: fixed values: MacKinnon's (1994) response surface for a regression with a constant: where the two polynomials meet, their ends, and their coefficients
TAU_STAR, TAU_LEAST, TAU_MOST = -1.61, -18.83, 2.74
SMALL_P, LARGE_P = (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368)
#: fixed values: critical values of KPSS around a level (1992) and their p-values
KPSS_AT, KPSS_P = (0.347, 0.463, 0.574, 0.739), (0.10, 0.05, 0.025, 0.01)
#: fewest values of a series that is tested
LEAST = 20


def normal_equations(df: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """(keys, i, j, v): sums of products of columns i and j, counted from 0, over rows that know all."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = []
            for key, g in p.groupby(keys, dropna=False, sort=False):
                x = g[columns].to_numpy(float)
                out += [(*key, i, j, v) for i, row in enumerate((x.T @ x).tolist()) for j, v in enumerate(row)]
            yield pd.DataFrame(out, columns=[*keys, "i", "j", "v"])

    known = df.where(F.forall(F.array(*(F.col(c).isNotNull() for c in columns)), lambda c: c)).select(*keys, *(F.col(c).cast("double") for c in columns))
    return known.mapInPandas(run, schema_with(known.select(*keys), i="int", j="int", v="double")).groupBy(*keys, "i", "j").agg(F.sum("v").alias("v"))


def mackinnon_p(tau: float) -> float:
    """The p-value of a Dickey-Fuller statistic of a regression with a constant."""
    if tau > TAU_MOST or tau < TAU_LEAST:
        return 1.0 if tau > TAU_MOST else 0.0
    z = sum(c * tau**i for i, c in enumerate(SMALL_P if tau <= TAU_STAR else LARGE_P))
    return 0.5 * math.erfc(-z / math.sqrt(2))


def _fit(a: np.ndarray, columns: list[int], y: int) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Coefficients, their deviations, sum of squared residuals and rows of a regression from sums of products; column 0 is the constant."""
    x, n = a[np.ix_(columns, columns)], a[0, 0]
    inverse = np.linalg.pinv(x)
    beta = inverse @ a[columns, y]
    rest = max(float(a[y, y] - beta @ a[columns, y]), 1e-300)
    return beta, np.sqrt(np.maximum(np.diag(inverse), 0) * rest / max(n - len(columns), 1)), rest, float(n)


def _aic(rest: float, n: float, k: int) -> float:
    return n * (math.log(2 * math.pi * rest / n) + 1) + 2 * k


def _lagged(df: DataFrame, x: str, keys: list[str], ts: str) -> DataFrame:
    """Known values in deviations from their series' mean, by its deviation: (keys, ts, _n, _y)."""
    of = Window.partitionBy(*keys)
    z = df.where(F.col(x).isNotNull()).select(*keys, ts, F.col(x).cast("double").alias("_v"))
    z = z.withColumns({"_n": F.count("*").over(of), "_m": F.avg("_v").over(of), "_s": F.stddev_pop("_v").over(of)})
    return z.where((F.col("_n") >= LEAST) & (F.col("_s") > 0)).select(*keys, ts, "_n", ((F.col("_v") - F.col("_m")) / F.col("_s")).alias("_y"))


def _square(rows: list, keys: list[str]) -> dict[tuple, np.ndarray]:
    d = 1 + max((r.i for r in rows), default=0)
    out: dict[tuple, np.ndarray] = {}
    for r in rows:
        out.setdefault(tuple(r[k] for k in keys), np.zeros((d, d)))[r.i, r.j] = r.v
    return out


def dickey_fuller(df: DataFrame, x: str, keys: list[str], ts: str, most: int | None = None) -> DataFrame:
    """(keys, n, lags, used, stat, p): the augmented Dickey-Fuller test with a constant of each series. Small p-values speak against a unit root.

    The lags of the change are chosen by Akaike's criterion among 0 to ``most`` (by default 12 (n / 100)^(1/4), rounded up, of the longest series, and not half a series or
    more), all on the rows that know the most lags; the statistic is of the chosen ones on all rows that know them. Series with fewer than LEAST values or without variation are left out.
    """
    z = _lagged(df, x, keys, ts)
    sizes = {tuple(r[k] for k in keys): r.n for r in z.groupBy(*keys).agg(F.first("_n").alias("n")).collect()}  # one row a series
    schema = schema_with(df.select(*keys), n="long", lags="int", used="long", stat="double", p="double")
    if not sizes:
        return df.sparkSession.createDataFrame([], schema)
    top = {s: min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2) if most is None else min(most, n // 2 - 2) for s, n in sizes.items()}
    deepest = max(top.values())
    w = ordered(*keys, by=ts)
    z = z.withColumns({"_c": F.lit(1.0), "_l": F.lag("_y").over(w)}).withColumn("_d", F.col("_y") - F.col("_l"))
    z = z.withColumns({f"_d{i}": F.lag("_d", i).over(w) for i in range(1, deepest + 1)}).withColumn("_rn", F.row_number().over(w))
    names = ["_c", "_l", "_d", *(f"_d{i}" for i in range(1, deepest + 1))]
    filled = z.fillna(0.0, [f"_d{i}" for i in range(1, deepest + 1)]).where("_d is not null")

    def sums(lags: dict[tuple, int]) -> dict[tuple, np.ndarray]:
        """Of rows that know so many lags."""
        held = df.sparkSession.createDataFrame([(*s, k) for s, k in lags.items()], schema_with(df.select(*keys), _k="int"))
        renamed = held.withColumnsRenamed({k: f"_r_{k}" for k in keys})
        rows = filled.join(renamed, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]).where(F.col("_rn") >= F.col("_k") + 2)
        return _square(normal_equations(rows, names, keys).collect(), keys)  # (lags + 3)^2 numbers a series

    common = sums(top)
    best = {}
    for s, a in common.items():
        fits = [(_aic(rest, n, k + 2), k) for k in range(top[s] + 1) for _, _, rest, n in [_fit(a, [0, 1, *range(3, 3 + k)], 2)]]
        best[s] = min(fits)[1]
    out = []
    for s, a in sums(best).items():
        beta, sd, _, n = _fit(a, [0, 1, *range(3, 3 + best[s])], 2)
        stat = float(beta[1] / sd[1]) if sd[1] > 0 else None
        out.append((*s, sizes[s], best[s], int(n), stat, mackinnon_p(stat) if stat is not None else None))
    return df.sparkSession.createDataFrame(out, schema)


def kpss(df: DataFrame, x: str, keys: list[str], ts: str) -> DataFrame:
    """(keys, n, lags, stat, p): the test of Kwiatkowski and others around a level. Small p-values speak against stationarity; they are read from a table and lie
    between 0.01 and 0.1.

    The bandwidth is chosen by the rule of Hobijn and others from n^(2/9) autocovariances. Series with fewer than LEAST values or without variation are left out.
    """
    z = _lagged(df, x, keys, ts).persist()
    w = ordered(*keys, by=ts)
    schema = schema_with(df.select(*keys), n="long", lags="int", stat="double", p="double")
    sizes = {tuple(r[k] for k in keys): r.n for r in z.groupBy(*keys).agg(F.first("_n").alias("n")).collect()}  # one row a series
    if not sizes:
        z.unpersist()
        return df.sparkSession.createDataFrame([], schema)

    def products(most: int) -> dict[tuple, tuple[list[float], float]]:
        """Sums of products with each lag up to ``most``, and of squared running sums."""
        run = F.sum("_y").over(w.rowsBetween(Window.unboundedPreceding, 0))
        y = z.withColumns({"_run": run, **{f"_y{i}": F.lag("_y", i).over(w) for i in range(most + 1)}})
        rows = y.groupBy(*keys).agg(F.array(*(F.coalesce(F.sum(F.col("_y") * F.col(f"_y{i}")), F.lit(0.0)) for i in range(most + 1))).alias("c"), F.sum(F.col("_run") * F.col("_run")).alias("s")).collect()
        return {tuple(r[k] for k in keys): (r.c, r.s) for r in rows}

    first = products(max(int(n ** (2 / 9)) for n in sizes.values()))
    width = {}
    for s, n in sizes.items():
        c = first[s][0]
        s0, s1 = c[0] / n, 0.0
        for i in range(1, int(n ** (2 / 9)) + 1):
            s0 += 2 * c[i] / n
            s1 += i * 2 * c[i] / n
        width[s] = min(int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)), n - 1)
    out = []
    whole = products(max(width.values()))
    z.unpersist()
    for s, n in sizes.items():
        c, run = whole[s]
        variance = (c[0] + 2 * sum((1 - i / (width[s] + 1)) * c[i] for i in range(1, width[s] + 1))) / n
        stat = run / (n * n * variance)
        out.append((*s, n, width[s], float(stat), float(np.interp(stat, KPSS_AT, KPSS_P))))
    return df.sparkSession.createDataFrame(out, schema)


def ljung_box(df: DataFrame, x: str, keys: list[str], ts: str, lags: int = 10) -> DataFrame:
    """(keys, n, stat, p): whether a series is correlated with its own ``lags`` (an even number) values before."""
    if lags % 2:
        raise ValueError("an even number of lags")
    z, w = _lagged(df, x, keys, ts), ordered(*keys, by=ts)
    y = z.withColumns({f"_y{i}": F.lag("_y", i).over(w) for i in range(1, lags + 1)})
    n, total = F.first("_n"), F.sum(F.col("_y") * F.col("_y"))
    r2 = [F.pow(F.coalesce(F.sum(F.col("_y") * F.col(f"_y{i}")), F.lit(0.0)) / total, F.lit(2)) / (n - i) for i in range(1, lags + 1)]
    g = y.groupBy(*keys).agg(n.alias("n"), (n * (n + 2) * sum(r2[1:], r2[0])).alias("stat"))
    # the tail of a chi-square distribution with an even number of degrees of freedom
    half = F.col("stat") / 2
    terms = [F.pow(half, F.lit(k)) / math.factorial(k) for k in range(lags // 2)]
    return g.withColumn("p", F.exp(-half) * sum(terms[1:], terms[0]))
