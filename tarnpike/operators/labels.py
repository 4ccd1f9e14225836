"""Forward-looking labels: barrier races, excursions, horizons, percentiles, routing, denoising and regimes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnpike.functions.safe import after_n, before_n, clip, framed, last_n, mean_n, ordered, schema_with, sdiv, sln, weighted_deviation
from tarnpike.operators.align import asof
from tarnpike.operators.indicators import W, c, true_range


def regime_targets(bars: DataFrame, atr: str, target: float, stop: float, factors: dict[str, float] | None = None, regime: str | None = None, low: float = 0.0, high: float = 1e18) -> DataFrame:
    """Target and stop distances: multiples of an average true range, times a factor of the regime (default 1), clipped."""
    factor = F.lit(1.0)
    if factors and regime:
        factor = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in factors.items() for x in kv)), F.col(regime)), F.lit(1.0))
    return bars.withColumns({"target": clip(target * F.col(atr) * factor, low, high), "stop": clip(stop * F.col(atr) * factor, low, high)})


def volatility_targets(bars: DataFrame, daily: DataFrame, span: float, target: float, stop: float, arm: float = 0.0, pip: float = 0.0001, low: float = 0.0, high: float = 1e18) -> DataFrame:
    """volatility, target, stop, target_pips, stop_pips, arm: distances as multiples of close times the deviation of daily log returns, weighted by ``span``, of
    the days before the bar's own (a day's value holds from the next day's row on). Pips lie between ``low`` and ``high``, and distances follow them; the arming distance is not bounded."""
    w = ordered("symbol")
    d = daily.select("symbol", "ts", sln(sdiv(F.col("close"), F.lag("close").over(w))).alias("_r"))
    d = weighted_deviation(d, "_r", span, "_v").select("symbol", "ts", F.lag("_v").over(w).alias("volatility"))
    x = asof(bars, d, ["volatility"], ["symbol"])
    move = F.col("close") * F.col("volatility")
    x = x.withColumns({"target_pips": clip(target * move / pip, low, high), "stop_pips": clip(stop * move / pip, low, high), "arm": arm * move})
    return x.withColumns({"target": F.col("target_pips") * pip, "stop": F.col("stop_pips") * pip})


def _first(window: Column, hit) -> Column:
    """1-based place of the first bar of a window that satisfies ``hit``; 0 if none does."""
    return F.coalesce(F.array_position(F.transform(window, lambda b: F.coalesce(hit(b), F.lit(False))), True), F.lit(0))


def barrier_race(bars: DataFrame, horizon: int, target: str = "target", stop: str = "stop", arm: str | None = None) -> DataFrame:
    """Which barrier the next ``horizon`` bars reach first; the stop is tested before the target in a bar. With a column ``arm`` above 0 the race begins
    after the first bar that moves that far either way; before it, and in that bar, neither barrier counts.

    long and short are 1 if the target comes first, else 0; t1_long and t1_short are the time of the deciding bar, or of the last bar seen;
    null for a symbol's last bar. The window is one array by row: for horizons of a few hundred bars see ``barrier_race_fast``.
    """
    ahead = F.collect_list(F.struct("high", "low", "ts")).over(after_n(W(), horizon))
    x = bars.withColumn("_w", ahead)
    t, s = F.col(target), F.col(stop)
    run = F.col("_w")
    if arm is None:
        x = x.withColumn("_off", F.lit(0).cast("long"))
    else:
        a = F.coalesce(F.col(arm), F.lit(0.0))
        moved = _first(run, lambda b: (b["high"] >= c() + a) | (b["low"] <= c() - a)).cast("long")
        x = x.withColumn("_off", F.when(a <= 0, F.lit(0)).when(moved == 0, F.size(run)).otherwise(moved))  # bars that do not count
    racing = F.filter(run, lambda b, i: i >= F.col("_off")) if arm else run
    place = lambda hit: F.when(_first(racing, hit) > 0, _first(racing, hit) + F.col("_off")).otherwise(0)
    x = x.withColumns(
        {
            "_lt": place(lambda b: b["high"] >= c() + t), "_ls": place(lambda b: b["low"] <= c() - s),
            "_st": place(lambda b: b["low"] <= c() - t), "_ss": place(lambda b: b["high"] >= c() + s),
        }
    )

    def outcome(win: Column, lose: Column) -> tuple[Column, Column]:
        won = (win > 0) & ((lose == 0) | (win < lose))
        end = F.when(won, win).when(lose > 0, lose).otherwise(F.size("_w"))
        known = t.isNotNull() & s.isNotNull()
        return F.when(known, won.cast("int")), F.when(known & (end > 0), F.get(F.col("_w"), (end - 1).cast("int"))["ts"])

    long, t1_long = outcome(F.col("_lt"), F.col("_ls"))
    short, t1_short = outcome(F.col("_st"), F.col("_ss"))
    return x.withColumns({"long": long, "t1_long": t1_long, "short": short, "t1_short": t1_short}).drop("_w", "_off", "_lt", "_ls", "_st", "_ss")


def barrier_race_fast(bars: DataFrame, horizon: int, target: str = "target", stop: str = "stop", arm: str | None = None, block: int = 20_000) -> DataFrame:
    """The same labels long and short by numpy over sliding windows, a symbol at a time in blocks of rows: for long horizons."""
    schema = schema_with(bars, long="int", short="int")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", kind="stable")
        n = len(pdf)
        pad = np.full(horizon, np.nan)
        hi, lo = (np.concatenate([pdf[x].to_numpy(float), pad]) for x in ("high", "low"))
        close, t, s = (pdf[x].to_numpy(float) for x in ("close", target, stop))
        out = {"long": np.zeros(n), "short": np.zeros(n)}
        for a in range(0, n, block):
            b = min(n, a + block)
            h = np.lib.stride_tricks.sliding_window_view(hi[a + 1 : b + horizon], horizon)
            low = np.lib.stride_tricks.sliding_window_view(lo[a + 1 : b + horizon], horizon)
            base, tt, ss = close[a:b, None], t[a:b, None], s[a:b, None]
            open_ = True
            if arm is not None:
                d = np.nan_to_num(pdf[arm].to_numpy(float)[a:b, None])
                moved = (h >= base + d) | (low <= base - d)
                from_ = np.where(d[:, 0] <= 0, -1, np.where(moved.any(1), moved.argmax(1), horizon))
                open_ = np.arange(horizon) > from_[:, None]
            first = lambda m: np.where((m & open_).any(1), (m & open_).argmax(1), horizon)  # noqa: B023, E731
            out["long"][a:b] = first(h >= base + tt) < first(low <= base - ss)
            out["short"][a:b] = first(low <= base - tt) < first(h >= base + ss)
        for k, x in out.items():
            pdf[k] = pd.array(np.where(np.isnan(t) | np.isnan(s), np.nan, x), dtype="Int32")
        return pdf

    return bars.groupBy("symbol").applyInPandas(run, schema)


def symmetric_barrier(bars: DataFrame, distance: str, horizon: int) -> DataFrame:
    """1, -1 or 0: which side at one distance is reached first; 0 if a bar reaches both or none is reached; null in the last ``horizon`` bars."""
    x = bars.withColumn("_w", F.collect_list(F.struct("high", "low")).over(after_n(W(), horizon)))
    d = F.col(distance)
    x = x.withColumns({"_u": _first(F.col("_w"), lambda b: b["high"] >= c() + d), "_d": _first(F.col("_w"), lambda b: b["low"] <= c() - d)})
    up, dn = F.col("_u"), F.col("_d")
    y = F.when((up > 0) & ((dn == 0) | (up < dn)), 1).when((dn > 0) & ((up == 0) | (dn < up)), -1).otherwise(0)
    return x.withColumn("barrier", F.when((F.size("_w") == horizon) & (d > 0), y)).drop("_w", "_u", "_d")


def direction_horizon(bars: DataFrame, horizon: int, dead: float) -> DataFrame:
    """1 or -1 if the close ``horizon`` bars ahead is beyond a dead zone, else 0; the forward return; null at the end."""
    f = sdiv(F.lead("close", horizon).over(W()), c()) - 1
    return bars.withColumn("fwd_return", f).withColumn("direction", F.when(F.col("fwd_return") > dead, 1).when(F.col("fwd_return") < -dead, -1).when(F.col("fwd_return").isNotNull(), 0))


def excursions(bars: DataFrame, horizon: int) -> DataFrame:
    """Largest moves for and against a long position in the next bars."""
    f = after_n(W(), horizon)
    return bars.withColumns({"mfe": F.max("high").over(f) - c(), "mae": c() - F.min("low").over(f)})


def lookahead_percentile(bars: DataFrame, horizon: int, n: int, q: float, least_move: float, adverse: float) -> DataFrame:
    """1 where the forward return is above its q-quantile over the n forward returns up to the bar before, that quantile is at least
    ``least_move`` and no bar ahead falls by ``adverse`` of the close. Those n returns reach into the future of the bar, as published."""
    x = direction_horizon(bars, horizon, 0.0).drop("direction")
    x = x.withColumn("_q", framed(F.percentile("fwd_return", q), F.col("fwd_return"), before_n(W(), n), n))
    low = F.min("low").over(after_n(W(), horizon))
    hit = (F.col("fwd_return") > F.col("_q")) & (F.col("_q") >= least_move) & (low > c() * (1 - adverse))
    return x.withColumn("lookahead", F.when(F.col("fwd_return").isNotNull() & F.col("_q").isNotNull(), hit.cast("int"))).drop("_q")


def mean_reversion(bars: DataFrame, horizon: int, stop: float, fast: float, fast_horizon: int, n: int = 20, k: float = 2.0) -> DataFrame:
    """Labels of a return to the mean, at closes outside the band of the n bars before (mean and k sample deviations); null at all other bars and at a
    symbol's last.

    long_slow: 1 if, within ``horizon`` bars, a high reaches the mean before a low falls by more than ``stop``. long_fast: 1 if it also is and, within
    ``fast_horizon`` bars, a rise of ``fast`` comes before a fall as large. short_slow and short_fast mirror them. reg: the return over ``horizon`` bars.
    """
    f = before_n(W(), n)
    mean, sd = framed(F.avg("close"), c(), f, n), framed(F.stddev_samp("close"), c(), f, n)
    x = bars.withColumns({"_m": mean, "_sd": sd, "_w": F.collect_list(F.struct("high", "low")).over(after_n(W(), max(horizon, fast_horizon)))})
    m, slow_, fast_ = F.col("_m"), F.slice("_w", 1, horizon), F.slice("_w", 1, fast_horizon)
    down, up = c() < m - k * F.col("_sd"), c() > m + k * F.col("_sd")
    first = {
        "_lw": _first(slow_, lambda b: b["high"] >= m), "_ll": _first(slow_, lambda b: b["low"] < c() - stop), "_fu": _first(fast_, lambda b: b["high"] - c() >= fast),
        "_sw": _first(slow_, lambda b: b["low"] <= m), "_sl": _first(slow_, lambda b: b["high"] > c() + stop), "_fd": _first(fast_, lambda b: c() - b["low"] >= fast),
    }
    x = x.withColumns(first)
    won = lambda a, b: ((F.col(a) > 0) & ((F.col(b) == 0) | (F.col(a) < F.col(b)))).cast("int")
    seen = F.size("_w") > 0
    x = x.withColumns({"long_slow": F.when(down & seen, won("_lw", "_ll")), "short_slow": F.when(up & seen, won("_sw", "_sl")), "long_fast": F.when(down & seen, won("_fu", "_fd")), "short_fast": F.when(up & seen, won("_fd", "_fu"))})
    for side in ("long", "short"):
        x = mask_fast(x, f"{side}_fast", f"{side}_slow")
    reg = F.when(down | up, sdiv(F.lead("close", horizon).over(W()), c()) - 1)
    return x.withColumn("reg", reg).drop("_m", "_sd", "_w", *first)


def mask_fast(df: DataFrame, fast: str, slow: str) -> DataFrame:
    """The fast label counts only where the slow one is 1."""
    return df.withColumn(fast, F.when(F.col(slow) == 1, F.coalesce(fast, F.lit(0))).otherwise(0))


def denoise(df: DataFrame, fast: int, slow: int, level: float = 0.65, trend: str | None = None, move: str | None = None, aggression: float = 0.7, keys: tuple[str, ...] = ("symbol",), ts: str = "ts") -> DataFrame:
    """Labels of 1 become 0 where the opposite label holds on ``level`` or more of the known bars around (``fast`` or ``slow`` bars to either side,
    that many known at least). Where ``trend`` is 1 and the mean of ``move`` around has the opposite sign, ``level`` times ``aggression`` is
    enough. Long labels are cleaned first, and short ones see them cleaned. Needs long_fast, short_fast, long_slow, short_slow."""
    order = ordered(*keys, by=ts)
    around = lambda n: order.rowsBetween(-n, n)
    half = max(fast, slow) // 2
    against = {"long": F.lit(False), "short": F.lit(False)}
    x = df
    if trend and move:
        full = max(fast, slow)  # a centred window of that many rows: one more before than after if it is even
        x = x.withColumn("_side", F.signum(F.avg(move).over(order.rowsBetween(-half, full - half - 1))))
        on = F.coalesce(F.col(trend) == 1, F.lit(False))
        against = {"long": on & F.coalesce(F.col("_side") < 0, F.lit(False)), "short": on & F.coalesce(F.col("_side") > 0, F.lit(False))}
    for label, other, n in (("long_fast", "short_fast", fast), ("short_fast", "long_fast", fast), ("long_slow", "short_slow", slow), ("short_slow", "long_slow", slow)):
        x = x.withColumn("_o", framed(F.avg(other), F.col(other), around(n), n))
        gone = (F.col("_o") >= level) | (against[label.split("_")[0]] & (F.col("_o") >= level * aggression))
        x = x.withColumn(label, F.when((F.col(label) == 1) & F.coalesce(gone, F.lit(False)), 0).otherwise(F.col(label)))
    return x.drop("_o", "_side")


def rule_regimes(bars: DataFrame, adx: str, eff: str, volatility: str, trend_level: float = 25.0, ma: int = 50, lo: float = 33.0, hi: float = 67.0) -> DataFrame:
    """Trend (1 up, -1 down, 0 none) and volatility (-1, 0, 1) regimes with their names; null where inputs are."""
    x = bars.withColumn("_m", mean_n("close", W(), ma, ma // 2))
    trending = (F.col(adx) > trend_level) | (F.col(eff) > 0.5)
    trend = F.when(trending.isNull() | F.col("_m").isNull(), None).when(trending & (c() > F.col("_m")), 1).when(trending & (c() < F.col("_m")), -1).otherwise(0)
    vol = F.when(F.col(volatility) < lo, -1).when(F.col(volatility) > hi, 1).when(F.col(volatility).isNotNull(), 0)
    x = x.withColumns({"regime_trend": trend, "regime_volatility": vol}).drop("_m")
    t = F.when(F.col("regime_trend") == 1, "UPTREND").when(F.col("regime_trend") == -1, "DOWNTREND").when(F.col("regime_trend") == 0, "RANGE")
    v = F.when(F.col("regime_volatility") == 1, "HIGH").when(F.col("regime_volatility") == -1, "LOW").when(F.col("regime_volatility") == 0, "NORMAL")
    return x.withColumns({"regime_trend_label": t, "regime_volatility_label": v, "regime_combined": F.concat_ws("_", t, v)})


def route(df: DataFrame, regime: str, trend_label: str, range_label: str, out: str) -> DataFrame:
    """The label of the regime a bar is in; null where the regime is unknown."""
    return df.withColumn(out, F.when(F.col(regime) != 0, F.col(trend_label)).when(F.col(regime) == 0, F.col(range_label)))


def opportunity_windows(bars: DataFrame, trigger: str, still: str, most: int = 4) -> DataFrame:
    """With ``window_id`` and ``window_pos``: a window opens at a trigger, lasts ``most`` bars at most and ends early where ``still`` fails;
    the bar that breaks it is in no window and opens none. A state machine, run by symbol."""
    schema = schema_with(bars, window_id="long", window_pos="long")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", kind="stable")
        ids, places = [None] * len(pdf), [None] * len(pdf)
        open_, at, number = False, 0, 0
        for i, (go, on) in enumerate(zip(pdf[trigger].eq(True), pdf[still].eq(True), strict=True)):
            if open_ and at < most:
                if on:
                    at += 1
                    ids[i], places[i] = number, at
                else:
                    open_ = False
                continue
            open_ = False
            if go:
                open_, at, number = True, 1, number + 1
                ids[i], places[i] = number, 1
        pdf["window_id"], pdf["window_pos"] = pd.array(ids, dtype="Int64"), pd.array(places, dtype="Int64")
        return pdf

    return bars.groupBy("symbol").applyInPandas(run, schema)


def _timed(bars: DataFrame, setup: str, window: str) -> tuple[DataFrame, Column]:
    """Rows with ``_rn``, and whether all of a window up to a row are set up."""
    so_far = Window.partitionBy("symbol", window).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return bars.withColumn("_rn", F.row_number().over(W())), F.min(F.coalesce(F.col(setup), F.lit(0))).over(so_far) == 1


def _move_ahead(horizon: int, side: int) -> Column:
    f = after_n(W(), horizon)
    return F.max("high").over(f) - c() if side > 0 else c() - F.min("low").over(f)


def first_higher_low(bars: DataFrame, setup: str, window: str, trend: str, least: float, horizon: int, most_body: float, side: int = 1) -> DataFrame:
    """timing: 1 at a window's first bar, after a close below the one before, that closes above the one before and above its open, with a body of
    ``most_body`` at most, whose largest move in ``horizon`` bars is ``least`` or more. A window's search ends at that bar, where ``setup`` is
    not 1, and at such a bar on the wrong side of ``trend``. Bars without a window have 0."""
    x, on = _timed(bars, setup, window)
    prev = F.lag("close").over(W())
    ahead = Window.partitionBy("symbol", window).orderBy("ts")
    x = x.withColumns({"_on": on, "_fall": (c() < prev).cast("int"), "_up": c() > prev, "_far": F.coalesce(_move_ahead(horizon, side) >= least, F.lit(False))})
    fell = F.max(F.when(F.col("_on"), F.col("_fall"))).over(ahead.rowsBetween(Window.unboundedPreceding, -1)) == 1
    lost = F.coalesce(c() < F.col(trend) if side > 0 else c() > F.col(trend), F.lit(False))
    candidate = F.col("_on") & fell & F.col("_up") & (c() > F.col("open")) & (side * (c() - F.col("open")) <= most_body)
    x = x.withColumn("_lost", lost).withColumn("_ends", F.coalesce(candidate, F.lit(False)) & (F.col("_lost") | F.col("_far")) & F.col(window).isNotNull())
    first = F.min(F.when(F.col("_ends"), F.col("_rn"))).over(Window.partitionBy("symbol", window))
    return x.withColumn("timing", F.coalesce(F.col("_ends") & ~F.col("_lost") & (F.col("_rn") == first), F.lit(False)).cast("int")).drop("_rn", "_on", "_fall", "_up", "_far", "_lost", "_ends")


def rebounds(bars: DataFrame, setup: str, window: str, trend: str, atr: str, strength: str, least: float, horizon: int, most_body: float, near: float = 2.0, body: float = 0.3, level: float = 40.0, gap: int = 4, side: int = 1) -> DataFrame:
    """timing: 1 at a window's first bar, and at the next one ``gap`` bars later or more, that is at most ``near`` true ranges beyond ``trend``, has a body
    of ``body`` true ranges or more (and ``most_body`` at most), ``strength`` above ``level``, and a move ahead of ``least``; setups as in ``first_higher_low``."""
    x, on = _timed(bars, setup, window)
    away, long = side * (c() - F.col(trend)), side * (c() - F.col("open"))
    a = F.col(atr) + 1e-10
    good = on & (away > 0) & (away / a <= near) & (F.col(strength) > level) & (long > 0) & (long / a >= body) & (long <= most_body) & (_move_ahead(horizon, side) >= least)
    x = x.withColumn("_good", F.coalesce(good, F.lit(False)) & F.col(window).isNotNull())
    whole = Window.partitionBy("symbol", window)
    x = x.withColumn("_first", F.min(F.when(F.col("_good"), F.col("_rn"))).over(whole))
    x = x.withColumn("_next", F.min(F.when(F.col("_good") & (F.col("_rn") >= F.col("_first") + gap), F.col("_rn"))).over(whole))
    hit = F.col("_good") & ((F.col("_rn") == F.col("_first")) | (F.col("_rn") == F.col("_next")))
    return x.withColumn("timing", F.coalesce(hit, F.lit(False)).cast("int")).drop("_rn", "_good", "_first", "_next")


def label_atr(bars: DataFrame, n: int) -> DataFrame:
    """Plain mean of the true ranges of the n bars before."""
    return bars.withColumn("_tr", true_range()).withColumn("label_atr", framed(F.avg("_tr"), F.col("_tr"), before_n(W(), n), n)).drop("_tr")


def weekly_label_stats(df: DataFrame, label: str, ts: str = "ts") -> DataFrame:
    """By calendar year and ISO week: bars, positives, share. The year is the calendar's, as published, so a week can appear in two years."""
    return df.groupBy(F.year(ts).alias("year"), F.weekofyear(ts).alias("week")).agg(F.count(label).alias("bars"), F.sum(label).alias("positives"), F.avg(label).alias("share"))


def running(df: DataFrame, x: Column, keys: tuple[str, ...] = ("symbol",), ts: str = "ts") -> Column:
    return F.sum(x).over(Window.partitionBy(*keys).orderBy(ts).rowsBetween(Window.unboundedPreceding, 0))


def rolling_quantile(bars: DataFrame, x: str, q: float, n: int, out: str) -> DataFrame:
    return bars.withColumn(out, framed(F.percentile(x, q), F.col(x), last_n(W(), n), n))
