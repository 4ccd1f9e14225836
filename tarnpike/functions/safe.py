"""Null-safe expressions and row windows with minimum counts.

Missing is always null: no division, logarithm or gate here makes NaN or infinity (but ``fdiv`` and ``fpow``), and null never turns into 0 or false.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StructType


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def sdiv(a: Column, b: Column) -> Column:
    """a / b; null where b is 0."""
    return a / F.nullif(b, F.lit(0.0))


def fdiv(a: Column, b: Column) -> Column:
    """a / b of doubles as IEEE 754 and DuckDB have it: infinite where b is 0, by the signs of both, NaN where a is 0 too."""
    return F.when(b == 0, a * F.pow(b, F.lit(-1.0))).otherwise(sdiv(a, b))


def fpow(a: Column, b: Column) -> Column:
    """a to the power of b as C and DuckDB have it: 1 where a is 1, or -1 with an infinite b, which are NaN in Java."""
    return F.when((a == 1) | (a == -1) & (F.abs(b) == math.inf), 1.0).otherwise(F.pow(a, b))


def sln(x: Column) -> Column:
    """ln(x); null unless x > 0."""
    return F.when(x > 0, F.ln(x))


def ssqrt(x: Column) -> Column:
    return F.when(x >= 0, F.sqrt(x))


def clip(x: Column, low: float | Column, high: float | Column) -> Column:
    low, high = (v if isinstance(v, Column) else F.lit(v) for v in (low, high))
    return F.when(x.isNotNull(), F.least(F.greatest(x, low), high))


def event(score: Column, when: Column) -> Column:
    """The score where the condition holds, 0 where not, null if either is unknown."""
    return F.when(score.isNull() | when.isNull(), None).when(when, score).otherwise(0.0)


def no_nan(df: DataFrame) -> DataFrame:
    """NaN and infinities of all floating columns become null."""
    bad = [float("nan"), float("inf"), float("-inf")]
    out = {f.name: F.when(~F.col(f.name).isin(bad), F.col(f.name)) for f in df.schema if isinstance(f.dataType, DoubleType | FloatType)}
    return df.withColumns(out) if out else df


def ordered(*keys: str, by: str | list[str] = "ts") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*([by] if isinstance(by, str) else by))


def last_n(w: WindowSpec, n: int) -> WindowSpec:
    """The current row and the n - 1 before it."""
    return w.rowsBetween(-(n - 1), 0)


def before_n(w: WindowSpec, n: int) -> WindowSpec:
    """The n rows before the current one."""
    return w.rowsBetween(-n, -1)


def after_n(w: WindowSpec, n: int) -> WindowSpec:
    """The n rows after the current one."""
    return w.rowsBetween(1, n)


def framed(agg: Column, of: Column, frame: WindowSpec, least: int) -> Column:
    """An aggregate over a frame; null unless ``least`` values of ``of`` in it are known."""
    return F.when(F.count(of).over(frame) >= least, agg.over(frame))


def mean_n(x: str | Column, w: WindowSpec, n: int, least: int | None = None) -> Column:
    return framed(F.avg(col(x)), col(x), last_n(w, n), n if least is None else least)


def std_n(x: str | Column, w: WindowSpec, n: int, least: int | None = None, population: bool = False) -> Column:
    f = F.stddev_pop if population else F.stddev_samp
    return framed(f(col(x)), col(x), last_n(w, n), n if least is None else least)


def sum_n(x: str | Column, w: WindowSpec, n: int, least: int | None = None) -> Column:
    return framed(F.sum(col(x)), col(x), last_n(w, n), n if least is None else least)


def max_n(x: str | Column, w: WindowSpec, n: int, least: int | None = None) -> Column:
    return framed(F.max(col(x)), col(x), last_n(w, n), n if least is None else least)


def min_n(x: str | Column, w: WindowSpec, n: int, least: int | None = None) -> Column:
    return framed(F.min(col(x)), col(x), last_n(w, n), n if least is None else least)


def zscore_n(x: str | Column, w: WindowSpec, n: int, least: int | None = None) -> Column:
    """Distance from the mean of the last n rows, this one included, in sample deviations."""
    return sdiv(col(x) - mean_n(x, w, n, least), std_n(x, w, n, least))


def zscore_before(x: str | Column, w: WindowSpec, n: int, least: int | None = None) -> Column:
    """Distance from the mean of the n rows before, in their sample deviations."""
    least = n // 2 if least is None else least
    frame = before_n(w, n)
    return sdiv(col(x) - framed(F.avg(col(x)), col(x), frame, least), framed(F.stddev_samp(col(x)), col(x), frame, least))


def ffill(x: str | Column, w: WindowSpec, most: int | None = None) -> Column:
    """The last known value, at most ``most`` rows back."""
    return F.last(col(x), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding if most is None else -most, 0))


def slope_n(x: str | Column, place: str | Column, w: WindowSpec, n: int) -> Column:
    """Least-squares slope of the last n values against ``place``, a running row number; null if one is missing."""
    return framed(F.regr_slope(col(x), col(place).cast("double")), col(x), last_n(w, n), n)


def rank_le(x: str | Column, w: WindowSpec, n: int, least: int) -> Column:
    """Percent of the last n rows, this one included, that are not above; unknown ones count as above."""
    values = F.collect_list(col(x)).over(last_n(w, n))
    share = 100.0 * F.size(F.filter(values, lambda v: v <= col(x))) / F.count(F.lit(1)).over(last_n(w, n))
    return F.when(col(x).isNotNull() & (F.count(col(x)).over(last_n(w, n)) >= least), share)


def rank_avg(x: str | Column, w: WindowSpec, n: int, least: int | None = None) -> Column:
    """Percent rank among the last n known values, ties at their average."""
    values = F.collect_list(col(x)).over(last_n(w, n))
    less, same = F.size(F.filter(values, lambda v: v < col(x))), F.size(F.filter(values, lambda v: v == col(x)))
    return F.when(col(x).isNotNull() & (F.size(values) >= (n if least is None else least)), 100.0 * (less + (same + 1) / 2.0) / F.size(values))


def rank_strict(x: str | Column, w: WindowSpec, n: int, least: int) -> Column:
    """Percent of the known values among the n - 1 rows before that are below."""
    values = F.collect_list(col(x)).over(before_n(w, n - 1))
    return F.when(col(x).isNotNull() & (F.size(values) >= least - 1) & (F.size(values) > 0), 100.0 * F.size(F.filter(values, lambda v: v < col(x))) / F.size(values))


def rank_prev_le(x: str | Column, w: WindowSpec, n: int, least: int) -> Column:
    """Share of the known values among the n rows before that are not above, from 0 to 1."""
    values = F.collect_list(col(x)).over(before_n(w, n))
    return F.when(col(x).isNotNull() & (F.size(values) >= least), F.size(F.filter(values, lambda v: v <= col(x))) / F.size(values).cast("double"))


def correlation(x: str | Column, y: str | Column, frame: WindowSpec | None = None) -> Column:
    """Pearson's correlation over rows with both known; null where either does not vary (where the built-in one fails)."""
    both = col(x).isNotNull() & col(y).isNotNull()
    a, b = F.when(both, col(x)), F.when(both, col(y))
    over = (lambda f: f.over(frame)) if frame is not None else (lambda f: f)
    return sdiv(over(F.covar_pop(a, b)), over(F.stddev_pop(a)) * over(F.stddev_pop(b)))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Floating columns rounded, without a negative zero."""
    out = {f.name: F.round(F.col(f.name), digits) + F.lit(0.0) for f in df.schema if isinstance(f.dataType, DoubleType)}
    return df.withColumns(out) if out else df


def schema_with(df: DataFrame, **more: str) -> StructType:
    """The schema of a table with more columns, all of which may be null: what a grouped function returns."""
    out = StructType()
    for f in df.schema:
        out.add(f.name, f.dataType, True)
    for f in StructType.fromDDL(", ".join(f"`{name}` {kind}" for name, kind in more.items())):
        out.add(f)
    return out


def recursive_means(df: DataFrame, of: dict[str, tuple[str, float, int]], keys: tuple[str, ...] = ("symbol",), ts: str = "ts") -> DataFrame:
    """More columns: {name: (column, alpha, start)}, y[t] = alpha x[t] + (1 - alpha) y[t - 1] by keys in order of time, begun by the
    mean of the first ``start`` known values and null before; where x is null, y stays.

    Known values are cut into blocks within which (1 - alpha) falls to 1e-12. In a block y is a running sum of x in growing units, and
    what came before weighs by its last value alone: windows of Spark's own, no loop and no group in a worker.
    """
    w = ordered(*keys, by=ts)
    here, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    for i, (name, (x, alpha, start)) in enumerate(of.items()):
        left = 1.0 - alpha
        block = max(1, int(math.log(1e-12) / math.log(left))) if left > 0 else 1
        k, p, j, b, own, end = (f"_{n}{i}_{name}" for n in ("k", "p", "j", "b", "own", "end"))
        df = df.withColumn(k, F.when(F.col(x).isNotNull(), F.count(x).over(here)))
        seed = F.avg(F.when(F.col(k) <= start, F.col(x))).over(here)
        term = F.when(F.col(k) == start, seed).when(F.col(k) > start, alpha * F.col(x))
        df = df.withColumn(p, F.col(k) - start).withColumn(own, term)
        df = df.withColumns({j: F.pmod(F.col(p), F.lit(block)), b: F.when(F.col(own).isNotNull(), F.floor(F.col(p) / block))})
        inside = ordered(*keys, b, by=ts).rowsBetween(Window.unboundedPreceding, 0)
        grown = F.sum(F.col(own) * F.pow(F.lit(left), -F.col(j))).over(inside)
        df = df.withColumn(own, F.when(F.col(own).isNotNull(), grown * F.pow(F.lit(left), F.col(j))))
        last = F.last(F.when(F.col(j) == block - 1, F.col(own)), ignorenulls=True).over(before)
        df = df.withColumn(end, F.when(F.col(j) == block - 1, F.col(own) + left**block * F.coalesce(last, F.lit(0.0))))
        carried = F.coalesce(F.last(end, ignorenulls=True).over(before), F.lit(0.0))
        df = df.withColumn(own, F.col(own) + F.pow(F.lit(left), F.col(j) + 1) * carried)
        df = df.withColumn(name, F.last(own, ignorenulls=True).over(here)).drop(k, p, j, b, own, end)
    return df


def weighted_deviation(df: DataFrame, x: str, span: float, out: str, keys: tuple[str, ...] = ("symbol",), ts: str = "ts", least: int = 2) -> DataFrame:
    """With ``out``: the deviation of the values so far, weighted by (1 - 2 / (span + 1)) ** age, with weights that sum to one from the first value on and the
    correction for weighted samples. Null below ``least`` known values; ages count known values.

    First and second moments are recursive means begun by one value; the weight of that value is taken off, so that all weigh by age alone.
    """
    alpha = 2 / (span + 1)
    left = 1 - alpha
    w = ordered(*keys, by=ts)
    here = w.rowsBetween(Window.unboundedPreceding, 0)
    y = df.withColumns({"_x1": col(x).cast("double"), "_x2": col(x).cast("double") * col(x)})
    y = recursive_means(y, {"_m1": ("_x1", alpha, 1), "_m2": ("_x2", alpha, 1)}, keys, ts)
    n = F.count("_x1").over(here)
    first = {i: F.first(f"_x{i}", ignorenulls=True).over(here) for i in (1, 2)}
    y = y.withColumns({"_k": n, "_f1": first[1], "_f2": first[2]})
    off = F.pow(F.lit(left), F.col("_k"))
    weight, squares = (1 - off) / alpha, (1 - off * off) / (1 - left * left)
    mean, second = ((F.col(f"_m{i}") - off * F.col(f"_f{i}")) / alpha / weight for i in (1, 2))
    variance = F.greatest(second - mean * mean, F.lit(0.0)) * sdiv(weight * weight, weight * weight - squares)
    return y.withColumn(out, F.when(F.col("_k") >= max(least, 2), F.sqrt(variance))).drop("_x1", "_x2", "_m1", "_m2", "_k", "_f1", "_f2")
