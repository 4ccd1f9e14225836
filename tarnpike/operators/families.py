"""More feature families on bars: averages and their crossings, bursts, clocks of sessions and months, volume by session, pairs and execution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnpike.functions.safe import correlation, event, framed, last_n, mean_n, ordered, rank_avg, sdiv, sln, std_n, zscore_before
from tarnpike.operators.indicators import W, c, h, l, o, wilder

# averages -----------------------------------------------------------------------------------------------------------


def average_features(bars: DataFrame, fast: int, slow: int, k: int = 5, usual: int = 14) -> DataFrame:
    """Price against averages (in true ranges, and percent), their crossing and slope over k bars, k-bar log return, ranges in the usual true
    range, three-bar return, and share of rising bars among five."""
    x = wilder(bars, 3, usual, slow, max(k, usual)).withColumns({"_f": mean_n("close", W(), fast), "_s": mean_n("close", W(), slow)})
    a, u = F.col(f"atr_{slow}"), F.col(f"atr_{usual}")
    x = x.withColumns(
        {
            f"price_vs_sma_{slow}": 100 * (sdiv(c(), F.col("_s")) - 1),
            f"signed_price_vs_sma_{slow}": sdiv(c() - F.col("_s"), a),
            f"sma_{fast}_over_sma_{slow}": sdiv(F.col("_f") - F.col("_s"), a),
            f"sma_slope_{slow}": sdiv(F.col("_s") - F.lag("_s", k).over(W()), a),
            f"log_return_atr_{k}": sdiv(sln(sdiv(c(), F.lag("close", k).over(W()))) * c(), F.col(f"atr_{max(k, usual)}")),
            "hl_range_atr": sdiv(h() - l(), u),
            "oc_range_atr": sdiv(c() - o(), u),
            "return_3_atr": sdiv(c() - F.lag("close", 3).over(W()), F.col("atr_3")),
            "momentum_consistency_5": mean_n((c() > o()).cast("double"), W(), 5),
        }
    )
    return x.withColumn(f"abs_price_vs_sma_{slow}", F.abs(f"price_vs_sma_{slow}")).drop("_f", "_s")


def bars_since_flip(bars: DataFrame, n: int) -> DataFrame:
    """Bars since the close changed its side of the n-bar mean, 0 in the first one; without a mean it counts as below. And the squared correlation of the last
    12 closes with time, signed by the slope."""
    above = F.coalesce(c() > mean_n("close", W(), n), F.lit(False))
    x = bars.withColumn("_side", above).withColumn("_new", F.when(F.col("_side") == F.lag("_side").over(W()), 0).otherwise(1)).withColumn("_id", F.sum("_new").over(W().rowsBetween(Window.unboundedPreceding, 0)))
    x = x.withColumn("bars_since_flip", F.row_number().over(Window.partitionBy("symbol", "_id").orderBy("ts")) - 1).withColumn("_rn", F.row_number().over(W()).cast("double"))
    r = correlation("close", "_rn", last_n(W(), 12))
    return x.withColumn("slope_efficiency", F.when(F.count("close").over(last_n(W(), 12)) >= 12, r * r * F.signum(r))).drop("_side", "_new", "_id", "_rn")


# moments -----------------------------------------------------------------------------------------------------------


def moment_changes(bars: DataFrame, x: str, k: int, z: int) -> DataFrame:
    """Change over k bars, z against the z bars before, and percent rank of a column among the last z, ties at their average."""
    return bars.withColumns({f"{x}_chg_{k}": F.col(x) - F.lag(x, k).over(W()), f"{x}_z_{z}": zscore_before(x, W(), z), f"{x}_pct_{z}": rank_avg(x, W(), z, max(2, z // 2))})


def term_structure(bars: DataFrame, x: str, short: int, long: int) -> DataFrame:
    """A moment over the short window less that over the long one, which bars have as ``x``_n."""
    return bars.withColumn(f"{x}_ts_{short}_{long}", F.col(f"{x}_{short}") - F.col(f"{x}_{long}"))


def jump_asymmetry(bars: DataFrame, n: int, size: float = 2.0) -> DataFrame:
    """Share of returns ``r`` (see ``masked_returns``) above ``size`` deviations, read one bar back, less that below minus it; and the mean of lower less
    upper wick by range, whose wicks are 0 in a bar without range. Three quarters of the n bars, four at least, must be known."""
    least = max(4, round(0.75 * n))
    x = bars.withColumn("_s", std_n("r", W(), n, least)).withColumn("_s", F.lag("_s").over(W()))
    jump = F.when(F.col("r").isNotNull() & (F.col("_s") > 0), F.when(F.col("r") > size * F.col("_s"), 1.0).when(F.col("r") < -size * F.col("_s"), -1.0).otherwise(0.0))
    wick = F.when(h() == l(), 0.0).otherwise(((F.least(o(), c()) - l()) - (h() - F.greatest(o(), c()))) / (h() - l()))
    x = x.withColumns({"_j": jump, "_w": wick})
    return x.withColumns({f"jump_asym_{n}": mean_n("_j", W(), n, least), f"wick_asym_{n}": mean_n("_w", W(), n, least)}).drop("_s", "_j", "_w")


# clocks -------------------------------------------------------------------------------------------------------------


def local_clock(zone: str, ts: str = "ts") -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), F.col(ts))


def month_turn(day: Column, n: int = 2) -> Column:
    """-n to -1 on the last n weekdays of a month, 1 to n on the first n, 0 on all other days. Weekdays are counted by the calendar, holidays too."""
    weekdays = lambda a, b: F.size(F.filter(F.sequence(a, b), lambda d: F.weekday(d) < 5))
    start = F.to_date(F.date_trunc("month", day))
    left, gone = weekdays(day, F.last_day(day)), weekdays(start, day)  # both with the day itself
    return F.when(F.weekday(day) > 4, 0).when(left <= n, -left).when(gone <= n, gone).otherwise(0)


def turn_of_month(days: DataFrame, n: int, day: str = "day") -> DataFrame:
    """With tom_pos, the place in the turn of the month (see ``month_turn``)."""
    return days.withColumn("tom_pos", month_turn(F.to_date(day), n))


def clock_features(bars: DataFrame, k: int, turn: int = 2) -> DataFrame:
    """Clocks of a bar, and the k-bar move in true ranges of the bar before it at certain hours, 0 outside (so all is known when the bar begins).

    fix_proximity: 1 / (1 + hours to 16:00 London); week_pos: place in the week, null on weekends; tom_pos: see ``month_turn``. Moves: fix_momo 15 to 16
    London; fix_tom_momo 14 to 16 London on the last weekdays of a month; ny_open_momo 8 to 9 New York; friday_unwind from 16 London on Fridays;
    first_friday_momo on a month's first Friday.
    """
    hours = lambda t: F.hour(t) + F.minute(t) / 60.0
    x = wilder(bars, k).withColumns({"_ldn": local_clock("Europe/London"), "_ny": local_clock("America/New_York"), "_m": sdiv(c() - F.lag("close", k).over(W()), F.col(f"atr_{k}"))})
    x = x.withColumns({"_m": F.lag("_m").over(W()), "_lf": hours(F.col("_ldn")), "_nf": hours(F.col("_ny")), "tom_pos": month_turn(F.to_date("ts"), turn)})
    m, lf, nf, day = F.col("_m"), F.col("_lf"), F.col("_nf"), F.weekday("ts")
    return x.withColumns(
        {
            "fix_proximity": 1 / (1 + F.pmod(16.0 - lf, F.lit(24.0))),
            "week_pos": F.when(day < 5, (day + hours(F.col("ts")) / 24.0) / 5.0),
            f"fix_momo_{k}": event(m, (lf >= 15) & (lf < 16)),
            f"fix_tom_momo_{k}": event(m, (lf >= 14) & (lf < 16) & (F.col("tom_pos") < 0)),
            f"ny_open_momo_{k}": event(m, (nf >= 8) & (nf < 9)),
            f"friday_unwind_{k}": event(m, (F.weekday("_ldn") == 4) & (lf >= 16)),
            f"first_friday_momo_{k}": event(m, (day == 4) & (F.dayofmonth("ts") <= 7)),
        }
    ).drop("_ldn", "_ny", "_m", "_lf", "_nf")


# execution ----------------------------------------------------------------------------------------------------------


def execution_snapshot(bars: DataFrame, columns: list[str]) -> DataFrame:
    """(symbol, snapshot): each symbol's last row as JSON."""
    return bars.groupBy("symbol").agg(F.max_by(F.to_json(F.struct("ts", *columns)), "ts").alias("snapshot"))


# pairs --------------------------------------------------------------------------------------------------------------


def triangle(panel: DataFrame, legs: dict[str, str], z: int, k: int, ts: str = "ts") -> DataFrame:
    """(ts, residual, residual_z, residual_chg_z) of three series that should add up in logs: {"ab": .., "bc": .., "ac": ..} names them; rows with all three."""
    parts = [panel.where(F.col("symbol") == s).select(ts, sln(F.col("close")).alias(n)) for n, s in legs.items()]
    x = parts[0].join(parts[1], ts).join(parts[2], ts).withColumn("residual", F.col("ab") + F.col("bc") - F.col("ac")).withColumn("_one", F.lit(1))
    w = ordered("_one", by=ts)
    x = x.withColumn("_c", F.col("residual") - F.lag("residual", k).over(w))
    return x.select(ts, "residual", zscore_before("residual", w, z).alias("residual_z"), zscore_before("_c", w, z).alias("residual_chg_z"))


# labels and filters -------------------------------------------------------------------------------------------------

MASKS = {
    "uptrend": lambda: F.col("regime_trend") == 1, "downtrend": lambda: F.col("regime_trend") == -1, "range": lambda: F.col("regime_trend") == 0, "trend": lambda: F.col("regime_trend") != 0,
    "high_volatility": lambda: F.col("regime_volatility") == 1, "low_volatility": lambda: F.col("regime_volatility") == -1,
}


def regime_filter(df: DataFrame, names: list[str]) -> DataFrame:
    """Rows in one of the named regimes. Unknown names raise."""
    unknown = set(names) - set(MASKS)
    if unknown or not names:
        raise ValueError(f"no such regimes: {sorted(unknown)}; there are {sorted(MASKS)}")
    keep = F.lit(False)
    for n in names:
        keep = keep | F.coalesce(MASKS[n](), F.lit(False))
    return df.where(keep)


def signal_mask(df: DataFrame, side: int, directional: bool) -> Column:
    """Whether a bar is in a tradable trend: of the side's direction, or of any."""
    return F.coalesce(F.col("regime_trend") == side if directional else F.col("regime_trend") != 0, F.lit(False))


LABELS = ("long_slow", "short_slow", "long_fast", "short_fast")


def file_labels(df: DataFrame, time: str = "ts", mirror: bool = False) -> DataFrame:
    """(ts, long_slow, short_slow, long_fast, short_fast) from a table with any of these names, also as target_, y_ or y_target_, or with one signed column ``label``.

    Values other than 0, 1 and null (-1, 0, 1 in the signed column) and repeated times raise. With ``mirror`` missing fast labels take the slow ones.
    """
    names = {n: next((p + n for p in ("", "target_", "y_", "y_target_") if p + n in df.columns), None) for n in LABELS}
    if any(names.values()):
        cols = {n: F.col(x).cast("int") if x else F.lit(None).cast("int") for n, x in names.items()}
        bad = sum((F.count_if(~F.col(x).isin(0, 1)) for x in names.values() if x), F.lit(0))
    elif "label" in df.columns:
        s = F.col("label")
        cols = {n: F.when(s.isNotNull(), (s == (1 if n.startswith("long") else -1)).cast("int")) for n in LABELS}
        bad = F.count_if(~s.isin(-1, 0, 1))
    else:
        raise ValueError("no label column")
    found = df.agg(bad.alias("bad"), F.count(time).alias("n"), F.count_distinct(time).alias("d")).first()
    if found.bad:
        raise ValueError(f"{found.bad} values are no labels")
    if found.n != found.d:
        raise ValueError("repeated times")
    if mirror:
        for side in ("long", "short"):
            if names.get(f"{side}_fast") is None:
                cols[f"{side}_fast"] = cols[f"{side}_slow"]
    return df.select(F.col(time).alias("ts"), *(cols[n].alias(n) for n in LABELS))


def percentile_targets(bars: DataFrame, horizon: int, n: int, q: float) -> DataFrame:
    """target: the q-quantile over n bars of the absolute moves over ``horizon`` bars that have completed."""
    return bars.withColumn("_m", F.abs(c() - F.lag("close", horizon).over(W()))).withColumn("target", framed(F.percentile("_m", q), F.col("_m"), last_n(W(), n), n)).drop("_m")


def half_spread(bars: DataFrame, floor: float) -> DataFrame:
    """Half the spread between price and mid, at least the floor; where there is no mid, the symbol's median."""
    x = bars.withColumn("_h", F.when(F.col("mid").isNotNull(), F.greatest(F.abs(c() - F.col("mid")), F.lit(floor))))
    med = x.groupBy("symbol").agg(F.percentile("_h", 0.5).alias("_m"))
    return x.join(med, "symbol", "left").withColumn("half_spread", F.coalesce("_h", "_m", F.lit(floor))).drop("_h", "_m")


def months_needed(mean: Column, sd: Column, per_month: Column, t: float = 2.0) -> Column:
    """Months of trades until a mean is ``t`` standard errors from 0; null for no mean."""
    return F.ceil(F.pow(t * sd / F.nullif(mean, F.lit(0.0)), F.lit(2)) / F.nullif(per_month, F.lit(0.0)))


