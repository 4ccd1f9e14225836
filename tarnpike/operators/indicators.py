"""Classic indicators as columns over row windows.

All functions take bars (symbol, ts, open, high, low, close, volume, mid) and use rows up to the current one only.
Averages of the true range are kept apart: ``wilder`` (recursive, null in warm-up; the unit of all features "in true ranges", over the
feature's own window), ``atr_wilder`` (the same, 0 in warm-up) and ``atr_mean`` (plain mean: labels and execution).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tarnpike.functions.safe import before_n, clip, framed, last_n, max_n, mean_n, min_n, ordered, rank_avg, rank_le, recursive_means, sdiv, slope_n, sln, std_n, sum_n


def W() -> WindowSpec:  # noqa: N802
    """A symbol's bars in order."""
    return ordered("symbol")


def c() -> Column:
    return F.col("close")


def o() -> Column:
    return F.col("open")


def h() -> Column:
    return F.col("high")


def l() -> Column:  # noqa: E743
    return F.col("low")


def v() -> Column:
    return F.col("volume")


def numbered(bars: DataFrame) -> DataFrame:
    """With ``rn``, the running number of a symbol's bars."""
    return bars.withColumn("rn", F.row_number().over(W()).cast("double"))


def true_range() -> Column:
    prev = F.lag("close").over(W())
    return F.greatest(h() - l(), F.abs(h() - prev), F.abs(l() - prev))


def atr_mean(bars: DataFrame, n: int) -> DataFrame:
    return bars.withColumn("_tr", true_range()).withColumn(f"atr_mean_{n}", mean_n("_tr", W(), n)).drop("_tr")


def wilder(bars: DataFrame, *ns: int) -> DataFrame:
    """With atr_n: Wilder's mean true range, null in the first n - 1 bars."""
    of = {f"atr_{n}": ("_tr", 1 / n, n) for n in ns if f"atr_{n}" not in bars.columns}
    return recursive_means(bars.withColumn("_tr", F.coalesce(true_range(), h() - l())), of).drop("_tr")


def bollinger(bars: DataFrame, n: int = 20, k: float = 2.0) -> DataFrame:
    """Middle, upper and lower band (population deviation), width in percent, place of the close between the bands (percent: null, position: 0 at
    zero width), squeeze, distance from the middle in true ranges, and position times width."""
    x = wilder(bars, n).withColumn("bb_middle", mean_n("close", W(), n)).withColumn("_sd", std_n("close", W(), n, population=True))
    x = x.withColumn("bb_upper", F.col("bb_middle") + k * F.col("_sd")).withColumn("bb_lower", F.col("bb_middle") - k * F.col("_sd"))
    span = F.col("bb_upper") - F.col("bb_lower")
    x = x.withColumns(
        {
            "bb_width": 100 * sdiv(span, F.col("bb_middle")),
            "bb_percent": sdiv(c() - F.col("bb_lower"), span),
            "bb_position": F.when(span == 0, 0.0).otherwise(sdiv(c() - F.col("bb_lower"), span)),
            "bb_deviation": sdiv(c() - F.col("bb_middle"), F.col(f"atr_{n}")),
        }
    )
    return x.withColumns({"bb_squeeze": sdiv(F.col("bb_width"), c()), "abs_bb_deviation": F.abs("bb_deviation"), "bb_edge_impact": F.col("bb_position") * F.col("bb_width")}).drop("_sd")


def donchian(bars: DataFrame, n: int) -> DataFrame:
    """Place of the close in the n-bar range, and breaks of the range of the n bars before."""
    top, low = max_n("high", W(), n), min_n("low", W(), n)
    before_top, before_low = (framed(f(x), F.col(x), before_n(W(), n), n) for f, x in ((F.max, "high"), (F.min, "low")))
    return bars.withColumns({f"channel_pos_{n}": sdiv(c() - low, top - low), f"break_up_{n}": (c() > before_top).cast("int"), f"break_down_{n}": (c() < before_low).cast("int")})


def ichimoku(bars: DataFrame, fast: int = 9, slow: int = 26, wide: int = 52) -> DataFrame:
    mid = lambda n: (max_n("high", W(), n) + min_n("low", W(), n)) / 2
    x = wilder(bars, slow, wide).withColumns({"ichi_conv": mid(fast), "ichi_base": mid(slow), "ichi_b": mid(wide)}).withColumn("ichi_a", (F.col("ichi_conv") + F.col("ichi_base")) / 2)
    top, low = F.greatest("ichi_a", "ichi_b"), F.least("ichi_a", "ichi_b")
    known = F.col("ichi_a").isNotNull() & F.col("ichi_b").isNotNull()
    return x.withColumns(
        {
            "cloud_color": F.when(known, F.when(F.col("ichi_a") > F.col("ichi_b"), 1).otherwise(-1)),
            "price_above_cloud": F.when(known, (c() > top).cast("int")),
            "distance_to_cloud": F.when(known, F.when(c() > top, sdiv(c() - top, F.col(f"atr_{wide}"))).when(c() < low, sdiv(low - c(), F.col(f"atr_{wide}"))).otherwise(0.0)),
            "cloud_thickness": F.when(known, sdiv(top - low, F.col(f"atr_{wide}"))),
            "tenkan_kijun_diff": sdiv(F.col("ichi_conv") - F.col("ichi_base"), F.col(f"atr_{slow}")),
        }
    )


def stochastic(bars: DataFrame, n: int = 14, smooth: int = 3) -> DataFrame:
    low, top = min_n("low", W(), n), max_n("high", W(), n)
    return bars.withColumn("stoch_k", 100 * sdiv(c() - low, top - low)).withColumn("stoch_d", mean_n("stoch_k", W(), smooth))


def efficiency(bars: DataFrame, n: int = 20, zero_warmup: bool = False) -> DataFrame:
    """|change over n| over the sum of changes, 0 where nothing moved. In the first n bars null, or 0 with ``zero_warmup``."""
    x = bars.withColumn("_d", F.abs(c() - F.lag("close").over(W())))
    path, move = sum_n("_d", W(), n), F.abs(c() - F.lag("close", n).over(W()))
    eff = F.when(path == 0, 0.0).otherwise(move / F.nullif(path, F.lit(0.0)))
    return x.withColumn(f"efficiency_{n}", F.coalesce(eff, F.lit(0.0)) if zero_warmup else eff).drop("_d")


def trend_slope(bars: DataFrame, n: int) -> DataFrame:
    """Regression slope of the last n closes in true ranges."""
    x = wilder(numbered(bars), n)
    return x.withColumn(f"trend_slope_{n}", sdiv(slope_n("close", "rn", W(), n), F.col(f"atr_{n}"))).drop("rn")


def run_length(bars: DataFrame, of: Column, out: str) -> DataFrame:
    """k or -k at the k-th value in a row of one sign. 0 breaks the run and is 0, null breaks it and is null."""
    x = bars.withColumn("_s", F.signum(of).cast("double")).withColumn("_new", F.when(F.col("_s").eqNullSafe(F.lag("_s").over(W())) & (F.row_number().over(W()) > 1), 0).otherwise(1))
    x = x.withColumn("_run", F.sum("_new").over(W().rowsBetween(Window.unboundedPreceding, 0)))
    place = F.row_number().over(Window.partitionBy("symbol", "_run").orderBy("ts"))
    return x.withColumn(out, (place * F.col("_s")).cast("long")).drop("_s", "_new", "_run")


def momentum(bars: DataFrame, p: int) -> DataFrame:
    """close over the close p + 1 bars before, less 1; the span is one bar longer than the name, as published."""
    return bars.withColumn(f"momentum_{p}", sdiv(c(), F.lag("close", p + 1).over(W())) - 1)


def momentum_acceleration(bars: DataFrame, n: int) -> DataFrame:
    a, b = F.lag("close", n).over(W()), F.lag("close", 2 * n).over(W())
    return wilder(bars, n).withColumn(f"momentum_accel_{n}", sdiv((c() - a) - (a - b), F.col(f"atr_{n}")))


def bar_shape(bars: DataFrame) -> DataFrame:
    """Fractions of a bar: close in range (0.5 without range), body, upper and lower wick (0 without range)."""
    span = h() - l()
    part = lambda x: F.when(span == 0, 0.0).otherwise(x / F.nullif(span, F.lit(0.0)))
    return bars.withColumns(
        {
            "close_vs_range": F.when(span == 0, 0.5).otherwise((c() - l()) / F.nullif(span, F.lit(0.0))),
            "body_ratio": part(F.abs(c() - o())),
            "upper_wick": part(h() - F.greatest(o(), c())),
            "lower_wick": part(F.least(o(), c()) - l()),
        }
    )


def cci(bars: DataFrame, n: int = 20) -> DataFrame:
    """Commodity channel index with the mean absolute deviation and 0.015."""
    x = bars.withColumn("_tp", (h() + l() + c()) / 3).withColumn("_m", mean_n("_tp", W(), n)).withColumn("_a", F.collect_list("_tp").over(last_n(W(), n)))
    mad = F.aggregate("_a", F.lit(0.0), lambda s, t: s + F.abs(t - F.col("_m"))) / n
    return x.withColumn(f"cci_{n}", F.when(F.col("_m").isNotNull(), sdiv(F.col("_tp") - F.col("_m"), 0.015 * mad))).drop("_tp", "_m", "_a")


def volume_features(bars: DataFrame, n: int) -> DataFrame:
    """Volume rank, effort against result, distance from the volume-weighted price, money flow, divergence; a quarter of the window must be known."""
    least = max(2, n // 4)
    x = wilder(bars, n).withColumn("_mfm", F.when(h() == l(), 0.0).otherwise(((c() - l()) - (h() - c())) / F.nullif(h() - l(), F.lit(0.0))))
    total = sum_n("volume", W(), n, least)
    vwap = sdiv(sum_n((h() + l() + c()) / 3 * v(), W(), n, least), total)
    x = x.withColumn(f"volume_rank_{n}", rank_avg("volume", W(), n, least))
    return x.withColumns(
        {
            f"effort_result_{n}": sln(sdiv(v(), mean_n("volume", W(), n, least))) - sln(sdiv(h() - l(), F.col(f"atr_{n}"))),
            f"vwap_deviation_{n}": sdiv(c() - vwap, mean_n(f"atr_{n}", W(), n, least)),
            f"cmf_{n}": sdiv(sum_n(F.col("_mfm") * v(), W(), n, least), total),
            f"vol_price_divergence_{n}": F.signum(c() - F.lag("close", n).over(W())) * (2 * F.col(f"volume_rank_{n}") / 100 - 1),
        }
    ).drop("_mfm")


def calendar_columns(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Clock encodings and four session flags by UTC hour (8-16, 13-21, 0-8, 13-16)."""
    t = F.col(ts)
    angle = lambda x, n: x * (2 * math.pi / n)
    hour = F.hour(t) + F.minute(t) / 60.0
    flag = lambda a, b: ((F.hour(t) >= a) & (F.hour(t) < b)).cast("int")
    return df.withColumns(
        {
            "day_of_week": F.weekday(t) / 4.0, "month_sin": F.sin(angle(F.month(t), 12)), "month_cos": F.cos(angle(F.month(t), 12)),
            "week_sin": F.sin(angle(F.weekofyear(t), 53)), "week_cos": F.cos(angle(F.weekofyear(t), 53)), "quarter": (F.quarter(t) - 1) / 3.0,
            "hour_sin": F.sin(angle(hour, 24)), "hour_cos": F.cos(angle(hour, 24)), "london": flag(8, 16), "new_york": flag(13, 21), "asia": flag(0, 8), "overlap": flag(13, 16),
        }
    )


def pullback(bars: DataFrame, n: int) -> DataFrame:
    """Depth of the retreat from the n-bar extreme on the side of the 4n-bar mean, in true ranges; below without a mean.
    pullback_score_n keeps retreats of an up-trend by the 200-bar mean, 0 otherwise."""
    x = wilder(bars, n).withColumn("_m", mean_n("close", W(), 4 * n))
    depth = F.when(F.coalesce(c() > F.col("_m"), F.lit(False)), max_n("high", W(), n) - c()).otherwise(c() - min_n("low", W(), n))
    x = x.withColumn(f"pullback_{n}", sdiv(depth, F.col(f"atr_{n}")))
    up = F.when(F.coalesce(c() > mean_n("close", W(), 200), F.lit(False)), 1).otherwise(-1)
    return x.withColumn(f"pullback_score_{n}", clip(up * F.col(f"pullback_{n}"), 0.0, float("inf"))).drop("_m")


def trend_regime(bars: DataFrame, adx: str, efficiency_col: str, adx_level: float = 25.0, ma: int = 50) -> DataFrame:
    """Trend, range, up and down flags from a trend strength and an efficiency."""
    x = bars.withColumn("_m", mean_n("close", W(), ma, ma // 2))
    trend = (F.col(adx) > adx_level) | (F.col(efficiency_col) > 0.5)
    return x.withColumns({"regime_trend": trend.cast("int"), "regime_range": (~trend).cast("int"), "uptrend": (trend & (c() > F.col("_m"))).cast("int"), "downtrend": (trend & (c() < F.col("_m"))).cast("int")}).drop("_m")


# recursive averages -------------------------------------------------------------------------------------------------


def ewm_by_symbol(bars: DataFrame, of: dict[str, tuple[str, float, int]], ts: str = "ts") -> DataFrame:
    """More columns: {name: (column, alpha, start)}, exponential means by symbol in order of time (see ``recursive_means``)."""
    return recursive_means(bars, of, ("symbol",), ts)


def ema(bars: DataFrame, column: str, spans: list[int]) -> DataFrame:
    return ewm_by_symbol(bars, {f"ema_{n}": (column, 2 / (n + 1), 1) for n in spans})


def ewm_in_sql(bars: DataFrame, column: str, alpha: float, out: str, reach: int = 200) -> DataFrame:
    """The same mean from the last ``reach`` values alone, in expressions; (1 - alpha) ** reach is the share left out."""
    values = F.collect_list(column).over(last_n(W(), reach))
    return bars.withColumn(out, F.aggregate(F.slice(values, 2, reach), F.get(values, F.lit(0)), lambda y, x: (1 - alpha) * y + alpha * x))


def macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """Difference of two exponential means, its own mean and what is left, each also in true ranges; null until a mean has as many values as its span."""
    x = ema(bars, "close", [fast, slow]).withColumn("_n", F.count("close").over(W().rowsBetween(Window.unboundedPreceding, 0)))
    x = x.withColumn("macd", F.when(F.col("_n") >= slow, F.col(f"ema_{fast}") - F.col(f"ema_{slow}")))
    x = ewm_by_symbol(x, {"macd_signal": ("macd", 2 / (signal + 1), 1)}).withColumn("macd_signal", F.when(F.col("_n") >= slow + signal - 1, F.col("macd_signal")))
    x = wilder(x, slow).withColumn("macd_diff", F.col("macd") - F.col("macd_signal"))
    unit = {f"{k}_atr": sdiv(F.col(k), F.col(f"atr_{slow}")) for k in ("macd", "macd_signal", "macd_diff")}
    return x.withColumns(unit).withColumn("abs_macd_atr", F.abs("macd_atr")).drop("_n")


def rsi(bars: DataFrame, n: int = 14) -> DataFrame:
    """Wilder's relative strength index; 100 without losses."""
    d = c() - F.lag("close").over(W())
    x = bars.withColumn("_up", F.greatest(d, F.lit(0.0))).withColumn("_down", F.greatest(-d, F.lit(0.0)))
    x = x.withColumns({k: F.when(d.isNotNull(), F.col(k)) for k in ("_up", "_down")})
    x = ewm_by_symbol(x, {"_u": ("_up", 1 / n, n), "_d": ("_down", 1 / n, n)})
    return x.withColumn("rsi", F.when(F.col("_d") == 0, 100.0).otherwise(100 - 100 / (1 + sdiv(F.col("_u"), F.col("_d"))))).drop("_up", "_down", "_u", "_d")


def atr_wilder(bars: DataFrame, n: int = 14) -> DataFrame:
    """Wilder's mean true range, begun by a plain mean; 0 in the first n - 1 bars, as libraries have it."""
    x = ewm_by_symbol(bars.withColumn("_tr", F.coalesce(true_range(), h() - l())), {f"atr_{n}": ("_tr", 1 / n, n)})
    return x.withColumn(f"atr_{n}", F.coalesce(f"atr_{n}", F.lit(0.0))).drop("_tr")


def adx(bars: DataFrame, n: int = 14, slope: int = 5) -> DataFrame:
    """Wilder's directional indexes +DI and -DI, their average index and its change over ``slope`` bars."""
    up, down = h() - F.lag("high").over(W()), F.lag("low").over(W()) - l()
    x = bars.withColumns({"_p": F.when(up.isNotNull(), F.when((up > down) & (up > 0), up).otherwise(0.0)), "_m": F.when(up.isNotNull(), F.when((down > up) & (down > 0), down).otherwise(0.0)), "_t": true_range()})
    x = x.withColumn("_t", F.when(F.lag("close").over(W()).isNotNull(), F.col("_t")))
    x = ewm_by_symbol(x, {"_sp": ("_p", 1 / n, n), "_sm": ("_m", 1 / n, n), "_st": ("_t", 1 / n, n)})
    x = x.withColumns({"adx_pos": 100 * sdiv(F.col("_sp"), F.col("_st")), "adx_neg": 100 * sdiv(F.col("_sm"), F.col("_st"))})
    x = x.withColumn("_dx", 100 * sdiv(F.abs(F.col("adx_pos") - F.col("adx_neg")), F.col("adx_pos") + F.col("adx_neg")))
    x = ewm_by_symbol(x, {"adx": ("_dx", 1 / n, n)})
    return x.withColumn("adx_slope", F.col("adx") - F.lag("adx", slope).over(W())).drop("_p", "_m", "_t", "_sp", "_sm", "_st", "_dx")


def true_range_units(bars: DataFrame, n: int = 14, pip: float = 0.0001, reach: int = 500) -> DataFrame:
    """Wilder's mean true range in pips and in percent of the close, and its rank among the last ``reach`` bars (percent not above)."""
    x = wilder(bars, n)
    least = max(n, min(reach // 2, 50))
    return x.withColumns({"atr_pips": F.col(f"atr_{n}") / pip, "atr_volatility_ratio": 100 * sdiv(F.col(f"atr_{n}"), c()), "volatility_percentile": rank_le(f"atr_{n}", W(), reach, least)})
