"""Event sequences, realized moments, volume slots and session anchors over row windows of bars.

An event score is 0 where the event is absent, null where it cannot be known, and else signed by direction, in true ranges (Wilder's, over
the largest window that the name has) unless it says otherwise.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnpike.functions.safe import before_n, clip, correlation, event, framed, last_n, max_n, mean_n, min_n, ordered, rank_avg, sdiv, sln, slope_n, ssqrt, std_n, sum_n, zscore_before
from tarnpike.operators.indicators import W, atr_mean, c, h, l, numbered, o, run_length, v, wilder


# fixed values: multiples of ranges for stops, targets and trails, their limits in pips, and costs (pips; per million and side)
SL, TP, TRAIL = 0.5, 0.5, 0.5
SL_PIPS, TP_PIPS, TRAIL_PIPS = (15.0, 60.0), (15.0, 150.0), (8.0, 40.0)
SLIPPAGE, COMMISSION, FALLBACK_SPREAD = 0.2, 18.0, 0.4


def _range_before(w: int) -> tuple[Column, Column]:
    """Highest high and lowest low of the w bars before."""
    return tuple(framed(f(k), F.col(k), before_n(W(), w), w) for f, k in ((F.max, "high"), (F.min, "low")))


def _one_sided(n: int) -> tuple[Column, Column]:
    """Whether n - 1 or more of the last n bodies are up, and down."""
    body = c() - o()
    count = lambda on: F.when(F.count(body).over(last_n(W(), n)) >= n, F.sum(on.cast("int")).over(last_n(W(), n)))
    return count(body > 0) >= n - 1, count(body < 0) >= n - 1


def _signed(up: Column, a: Column, down: Column, b: Column) -> Column:
    """b where ``down`` holds, else a where ``up`` does, else 0."""
    yes = lambda x: F.coalesce(x, F.lit(False))
    return F.when(yes(down), b).when(yes(up), a).otherwise(0.0)


def impulse_burst(bars: DataFrame, n: int, w: int, gate: float = 0.6) -> DataFrame:
    """Sum of n bodies times its efficiency, |sum of bodies| over the sum of ranges, where that is at least ``gate``; and that of the bars before in bars
    of the hours 8 to 16, 0 in others."""
    x = wilder(bars, w)
    net = sum_n(c() - o(), W(), n)
    x = x.withColumn("_e", sdiv(F.abs(net), sum_n(h() - l(), W(), n))).withColumn("_s", sdiv(net, F.col(f"atr_{w}")) * F.col("_e"))
    x = x.withColumn(f"impulse_burst_{n}_{w}", event(F.col("_s"), F.col("_e") >= gate))
    london = (F.hour("ts") >= 8) & (F.hour("ts") < 16)
    return x.withColumn(f"impulse_london_{n}_{w}", F.when(london, F.lag(f"impulse_burst_{n}_{w}").over(W())).otherwise(0.0)).drop("_e", "_s")


def breakout_close(bars: DataFrame, m: int, w: int) -> DataFrame:
    """The close's distance beyond the range of the w bars before, if no such break came in the m bars before."""
    top, low = _range_before(w)
    x = wilder(bars, w).withColumn("_over", c() - top).withColumn("_under", c() - low).withColumn("_up", (F.col("_over") > 0).cast("int")).withColumn("_dn", (F.col("_under") < 0).cast("int"))
    fresh_up, fresh_dn = (F.coalesce(F.max(k).over(before_n(W(), m)), F.lit(0)) == 0 for k in ("_up", "_dn"))
    score = F.when((F.col("_up") == 1) & fresh_up, F.col("_over")).when((F.col("_dn") == 1) & fresh_dn, F.col("_under")).when(F.col("_up").isNotNull(), 0.0)
    return x.withColumn(f"breakout_close_{m}_{w}", sdiv(score, F.col(f"atr_{w}"))).drop("_over", "_under", "_up", "_dn")


def volspike_body(bars: DataFrame, w: int, size: float = 2.0, body: float = 0.6) -> DataFrame:
    """The range of a long bar that its body fills, signed by the body."""
    x = wilder(bars, w)
    spike = sdiv(h() - l(), F.col(f"atr_{w}"))
    big = (spike >= size) & F.coalesce(sdiv(F.abs(c() - o()), h() - l()) >= body, F.lit(False))
    return x.withColumn(f"volspike_body_{w}", event(F.signum(c() - o()) * spike, big))


def run_momentum(bars: DataFrame, r: int, w: int) -> DataFrame:
    """The move over r bars after r closes or more in one direction."""
    x = run_length(wilder(bars, w), c() - F.lag("close").over(W()), "_len")
    return x.withColumn(f"run_momentum_{r}_{w}", event(sdiv(c() - F.lag("close", r).over(W()), F.col(f"atr_{w}")), F.abs(F.col("_len")) >= r)).drop("_len")


def break_retest(bars: DataFrame, m: int, w: int, near: float = 0.25) -> DataFrame:
    """A level of the w bars before that a close broke is carried for m bars and seen from the next bar on. break_retest: a bar comes back within
    ``near`` true ranges of it and closes beyond it again; failed_break: a bar closes back inside. Both are the close's distance from the level."""
    top, low = _range_before(w)
    x = wilder(bars, w).withColumns({"_hi": top, "_lo": low})
    x = x.withColumn("_top", F.when(c() > F.col("_hi"), F.col("_hi"))).withColumn("_low", F.when(c() < F.col("_lo"), F.col("_lo")))
    up, dn = (F.last(k, ignorenulls=True).over(W().rowsBetween(-m - 1, -1)) for k in ("_top", "_low"))
    x = x.withColumn("_lu", up).withColumn("_ld", dn)
    a, u, d = (F.col(k) for k in (f"atr_{w}", "_lu", "_ld"))
    up_by, down_by = sdiv(c() - u, a), sdiv(c() - d, a)
    known = F.col("_hi").isNotNull() & F.nullif(a, F.lit(0.0)).isNotNull()
    retest = _signed((l() <= u + near * a) & (c() > u), up_by, (h() >= d - near * a) & (c() < d), down_by)
    failed = _signed(c() < u, up_by, c() > d, down_by)
    return x.withColumns({f"break_retest_{m}_{w}": F.when(known, retest), f"failed_break_{m}_{w}": F.when(known, failed)}).drop("_hi", "_lo", "_top", "_low", "_lu", "_ld")


def imbalance(bars: DataFrame, w: int, gate: float = 0.5) -> DataFrame:
    """Signed shares of ranges and of volume (a quarter of the window known), where at least ``gate``; no units."""
    s, least = F.signum(c() - o()), max(2, w // 4)
    rng, vol = sdiv(sum_n(s * (h() - l()), W(), w), sum_n(h() - l(), W(), w)), sdiv(sum_n(s * v(), W(), w, least), sum_n("volume", W(), w, least))
    return bars.withColumns({f"range_imbalance_{w}": event(rng, F.abs(rng) >= gate), f"tick_imbalance_{w}": event(vol, F.abs(vol) >= gate)})


def wick_reversal(bars: DataFrame, w: int, size: float = 2.0, wick: float = 0.6) -> DataFrame:
    """The range of a long bar with a long wick, against the wick's side. A bar without range has no wicks."""
    x = wilder(bars, w)
    part = lambda of: F.when(h() == l(), 0.0).otherwise(sdiv(of, h() - l()))
    upper, lower, spike = part(h() - F.greatest(o(), c())), part(F.least(o(), c()) - l()), sdiv(h() - l(), F.col(f"atr_{w}"))
    score = _signed((spike >= size) & (upper >= wick), -spike, (spike >= size) & (lower >= wick), spike)
    return x.withColumn(f"spike_wick_{w}", F.when(spike.isNotNull() & upper.isNotNull() & lower.isNotNull(), score))


def jumps(bars: DataFrame, w: int, n: int, size: float = 3.0) -> DataFrame:
    """One-bar moves of ``size`` true ranges, faded; and the n-bar move after such a jump n bars ago that n - 1 of n bodies followed."""
    x = wilder(bars, w).withColumn("_j", sdiv(c() - F.lag("close").over(W()), F.col(f"atr_{w}")))
    x = x.withColumn("_ago", F.lag(F.when(F.abs("_j") >= size, F.col("_j")), n).over(W()))
    up, down = _one_sided(n)
    move = sdiv(c() - F.lag("close", n).over(W()), F.col(f"atr_{w}"))
    follow = _signed((F.col("_ago") > 0) & up, move, (F.col("_ago") < 0) & down, move)
    return x.withColumns({f"jump_reversion_{w}": event(-F.col("_j"), F.abs("_j") >= size), f"jump_follow_{n}_{w}": F.when(move.isNotNull() & F.col("_j").isNotNull(), follow)}).drop("_j", "_ago")


def squeeze_breakout(bars: DataFrame, k: int, w: int, low_rank: float = 20.0) -> DataFrame:
    """range_pctile: percent rank of the k-bar range among the last w. squeeze_breakout: the close's distance beyond the range of the k bars
    before, where that was narrow."""
    x = wilder(bars, w).withColumn("_rng", max_n("high", W(), k) - min_n("low", W(), k)).withColumn("_rank", rank_avg("_rng", W(), w, max(2, w // 2)))
    top, bottom = _range_before(k)
    x = x.withColumns({"_was": F.lag("_rank").over(W()), "_top": top, "_bottom": bottom})
    narrow, a = F.col("_was") <= low_rank, F.col(f"atr_{w}")
    score = _signed(narrow & (c() > F.col("_top")), sdiv(c() - F.col("_top"), a), narrow & (c() < F.col("_bottom")), sdiv(c() - F.col("_bottom"), a))
    known = F.col("_was").isNotNull() & F.nullif(a, F.lit(0.0)).isNotNull()
    return x.withColumn(f"squeeze_breakout_{k}_{w}", F.when(known, score)).withColumnRenamed("_rank", f"range_pctile_{k}_{w}").drop("_rng", "_was", "_top", "_bottom")


def thrusts(bars: DataFrame, w: int, high_rank: float = 80.0) -> DataFrame:
    """hh_thrust: the step of highs (lows) from the bar before that ranks high among the last w, with a body of its direction."""
    x = wilder(bars, w).withColumns({"_up": h() - F.lag("high").over(W()), "_dn": F.lag("low").over(W()) - l()})
    x = x.withColumns({f"{k}_rank": rank_avg(k, W(), w, max(2, w // 2)) for k in ("_up", "_dn")})
    a = F.col(f"atr_{w}")
    score = _signed((F.col("_up_rank") >= high_rank) & (c() > o()), sdiv(F.col("_up"), a), (F.col("_dn_rank") >= high_rank) & (c() < o()), -sdiv(F.col("_dn"), a))
    known = F.col("_up_rank").isNotNull() & F.col("_dn_rank").isNotNull() & F.nullif(a, F.lit(0.0)).isNotNull()
    return x.withColumn(f"hh_thrust_{w}", F.when(known, score)).drop("_up", "_dn", "_up_rank", "_dn_rank")


def bursts(bars: DataFrame, n: int, w: int, size: float = 1.0) -> DataFrame:
    """micro_burst: the sum of n bodies, n - 1 of them one-sided, of ``size`` true ranges or more."""
    x = wilder(bars, w)
    burst = sdiv(sum_n(c() - o(), W(), n), F.col(f"atr_{w}"))
    up, down = _one_sided(n)
    return x.withColumn(f"micro_burst_{n}_{w}", event(burst, (up | down) & (F.abs(burst) >= size)))


def volatility_shift(bars: DataFrame, fast: int, w: int, least: float = 0.25) -> DataFrame:
    """atr_ratio: fast over slow true range less 1; volshift_bias: it where at least ``least``, signed by the regression slope of w closes."""
    x = wilder(numbered(bars), fast, w)
    ratio = sdiv(F.col(f"atr_{fast}"), F.col(f"atr_{w}")) - 1
    slope = slope_n("close", "rn", W(), w)
    x = x.withColumn(f"atr_ratio_{fast}_{w}", ratio).withColumn("_slope", slope)
    return x.withColumn(f"volshift_bias_{fast}_{w}", event(F.col(f"atr_ratio_{fast}_{w}") * F.signum("_slope"), F.col(f"atr_ratio_{fast}_{w}") >= least)).drop("_slope", "rn")


def compression_spread(bars: DataFrame, k: int, w: int, low_rank: float = 20.0, wide: float = 1.0) -> DataFrame:
    """z of the spread (twice close less mid) over w bars, where it is ``wide`` or more and the k-bar range is narrow, signed by the body."""
    x = bars.withColumns({"_s": 2 * (c() - F.col("mid")), "_rng": max_n("high", W(), k) - min_n("low", W(), k)})
    x = x.withColumn("_z", sdiv(F.col("_s") - mean_n("_s", W(), w), std_n("_s", W(), w))).withColumn("_rank", rank_avg("_rng", W(), w, max(2, w // 2)))
    return x.withColumn(f"compression_spread_{k}_{w}", event(F.signum(c() - o()) * F.col("_z"), (F.col("_rank") <= low_rank) & (F.col("_z") >= wide))).drop("_s", "_rng", "_z", "_rank")


def news_impulse(bars: DataFrame, counts: DataFrame, w: int, least: int = 2) -> DataFrame:
    """The bar's range, signed by its body, on days with ``least`` events or more. ``counts`` has (day, events) for every day of the calendar, one
    row a day; null outside."""
    x = wilder(bars, w).withColumn("_day", F.to_date("ts")).join(counts.select(F.to_date("day").alias("_day"), F.col("events").alias("_events")), "_day", "left")
    impulse = F.signum(c() - o()) * sdiv(h() - l(), F.col(f"atr_{w}"))
    return x.withColumn(f"news_impulse_{w}", event(impulse, F.col("_events") >= least)).drop("_day", "_events")


def masked_returns(bars: DataFrame, factor: float = 1.5) -> DataFrame:
    """With ``r``: log returns, null across gaps of more than ``factor`` times the symbol's median spacing."""
    step = F.unix_seconds(F.col("ts").cast("timestamp")) - F.unix_seconds(F.lag("ts").over(W()).cast("timestamp"))
    x = bars.withColumn("_dt", step)
    typical = x.groupBy("symbol").agg(F.percentile("_dt", 0.5).alias("_med"))
    x = x.join(typical, "symbol", "left")
    return x.withColumn("r", F.when(F.col("_dt") <= factor * F.col("_med"), sln(sdiv(c(), F.lag("close").over(W()))))).drop("_dt", "_med")


def realized_moments(bars: DataFrame, n: int) -> DataFrame:
    """Moments of ``r`` (see ``masked_returns``) over n bars, at least three quarters of them known."""
    least = max(4, round(0.75 * n))
    r = F.col("r")
    f = last_n(W(), n)
    known = F.count("r").over(f)
    gated = lambda x: F.when(known >= least, x)
    p2, p3, p4 = (F.sum(F.pow(r, F.lit(k))).over(f) for k in (2, 3, 4))
    up, down = F.sum(F.when(r > 0, r * r).when(r.isNotNull(), 0.0)).over(f), F.sum(F.when(r < 0, r * r).when(r.isNotNull(), 0.0)).over(f)
    x = bars.withColumn("_rr", F.abs(r) * F.abs(F.lag("r").over(W())))
    bv = framed(F.avg("_rr"), F.col("_rr"), f, max(3, least - 1)) * (math.pi / 2)
    rv = p2 / F.nullif(known, F.lit(0))
    lead = F.when(r.isNotNull(), F.lag("r").over(W()))
    x = x.withColumn("_lead", lead).withColumn("_abs", F.when(F.col("_lead").isNotNull(), F.abs(r)))
    return x.withColumns(
        {
            f"rsv_diff_{n}": gated(sdiv(up - down, p2)),
            f"rskew_{n}": gated(sdiv(F.sqrt(known) * p3, F.pow(p2, F.lit(1.5)))),
            f"rkurt_{n}": gated(sdiv(known * p4, p2 * p2)),
            f"jump_share_{n}": gated(F.when(bv.isNotNull(), F.greatest(F.lit(0.0), sdiv(rv - bv, rv)))),
            f"dvol_{n}": gated(F.sqrt(down / F.nullif(known, F.lit(0)))),
            f"levcorr_{n}": F.when(F.count("_abs").over(f) >= least, correlation("_lead", "_abs", f)),
        }
    ).drop("_rr", "_lead", "_abs")


def slot_z(df: DataFrame, x: str, n: int, out: str, slot: Column, least: int | None = None) -> DataFrame:
    """Distance from the mean of the n rows before in the same time slot, in their deviations."""
    least = min(n, max(10, round(0.4 * n))) if least is None else least
    rows = df.withColumn("_slot", slot)
    return rows.withColumn(out, zscore_before(x, ordered("symbol", "_slot"), n, least)).drop("_slot")


def local_slot(zone: str, ts: str = "ts") -> Column:
    """Minute of the day on a local clock."""
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), F.col(ts))
    return F.hour(local) * 60 + F.minute(local)


def slot_seasonal(bars: DataFrame, k: int, n: int, slot: Column, out: str, least: int, read_back: int = 1) -> DataFrame:
    """Mean over deviation of the next-k moves of the n same-slot rows from ``read_back`` occurrences back; only completed moves are read."""
    x = bars.withColumn("_slot", slot).withColumn("_pos", F.row_number().over(W())).withColumn("_mv", F.lead("close", k).over(W()) - c())
    s = ordered("symbol", "_slot")
    f = s.rowsBetween(-(n + read_back - 1), -read_back)
    done = F.lag("_pos", read_back).over(s) + k <= F.col("_pos")
    score = sdiv(framed(F.avg("_mv"), F.col("_mv"), f, least), framed(F.stddev_samp("_mv"), F.col("_mv"), f, least))
    return x.withColumn(out, F.when(done, score)).drop("_slot", "_pos", "_mv")


def session_anchors(bars: DataFrame, w: int, z: int = 60) -> DataFrame:
    """Scores of a bar's day. Clocks are the bar's own; prices are those of the bars before it, so every value is known when the bar begins.

    asia_pos, asia_break, asia_ret: the last close in the range of 00 to 07 UTC (-1 to 1), its distance beyond it, and the move of these hours,
    from 07 on. london_first_hour: the move of 08 to 09 London time, from 09 on. overnight_gap: first close of the day less the last of the day
    before, from the second bar on. day_ret_z: move since the last close of the day before, in deviations of the same time of day over z days.
    day_range_pos: place in the day's range so far (-1 to 1).
    """
    day = Window.partitionBy("symbol", "_d")
    early, london = F.hour("ts") < 7, F.convert_timezone(F.lit("UTC"), F.lit("Europe/London"), F.col("ts"))
    clock = F.hour(london) + F.minute(london) / 60.0
    x = wilder(bars, w).withColumns({"_d": F.to_date("ts"), "_a": F.nullif(F.lag(f"atr_{w}").over(W()), F.lit(0.0)), "_c": F.lag("close").over(W()), "_lf": clock})
    first_hour = (F.col("_lf") >= 8) & (F.col("_lf") < 9)
    of_day = {
        "_hi": F.max(F.when(early, h())), "_lo": F.min(F.when(early, l())), "_o": F.min_by("open", F.when(early, F.col("ts"))), "_e": F.max_by("close", F.when(early, F.col("ts"))),
        "_fo": F.min_by("open", F.when(first_hour, F.col("ts"))), "_fc": F.max_by("close", F.when(first_hour, F.col("ts"))), "_first": F.min_by("close", "ts"), "_last": F.max_by("close", "ts"),
    }
    days = x.groupBy("symbol", "_d").agg(*(v_.alias(k) for k, v_ in of_day.items()))
    days = days.withColumn("_prev", F.lag("_last").over(ordered("symbol", by="_d")))
    x = x.join(days, ["symbol", "_d"])
    so_far = Window.partitionBy("symbol", "_d").orderBy("ts")
    before = so_far.rowsBetween(Window.unboundedPreceding, -1)
    close, a, late = F.col("_c"), F.col("_a"), F.hour("ts") >= 7
    hi, lo = (F.when(late, F.col(k)) for k in ("_hi", "_lo"))
    top, low = F.max("high").over(before), F.min("low").over(before)
    x = x.withColumns({"_n": F.row_number().over(so_far), "_dr": close - F.col("_prev"), "day_range_pos": 2 * sdiv(close - low, top - low) - 1, "_slot": F.hour("ts") * 60 + F.minute("ts")})
    known = close.isNotNull() & hi.isNotNull() & a.isNotNull()
    x = x.withColumns(
        {
            "asia_pos": sdiv(close - (hi + lo) / 2, (hi - lo) / 2),
            f"asia_break_{w}": F.when(known, _signed(close > hi, (close - hi) / a, close < lo, (close - lo) / a)),
            f"asia_ret_{w}": F.when(late, (F.col("_e") - F.col("_o")) / a),
            f"london_first_hour_{w}": F.when(F.col("_lf") >= 9, (F.col("_fc") - F.col("_fo")) / a),
            f"overnight_gap_{w}": F.when(F.col("_n") > 1, (F.col("_first") - F.col("_prev")) / a),
            f"day_ret_z_{z}": zscore_before("_dr", ordered("symbol", "_slot"), z, min(z, max(20, z // 3))),
        }
    )
    return x.drop("_d", "_a", "_c", "_lf", *of_day, "_prev", "_n", "_dr", "_slot")


def timing(bars: DataFrame, fast: int, slow: int, span: int, wide: int, k: int, slots: int, pip: float, share: float = 0.75, slot_share: float = 0.4) -> DataFrame:
    """Timing and execution from completed bars; averages of the true range are plain means here, and windows need ``share`` of their rows.

    vol_ratio: fast over slow true range; vol_shift: its log against the median of the ``span`` bars before, in their quartile ranges;
    range_ratio: fast over slow high-low range; micro_break: the close's distance beyond the range of the k bars before, in true ranges.
    spread_norm: log of the spread (pips) over its median in the ``slots`` same London slots before; liq_impulse_score: slot z of log volume
    less that of log spread. Ranks from 0 to 1 among the last ``wide``: spread_regime, liq_impulse. queue_good: mean of calm volatility and calm spread;
    maker_ok: it times the calm of the impulse. sl, tp and trail_pips: multiples of ranges, clipped; cost_floor_pips: spread, slippage, commission.
    """
    least = lambda n: max(2, round(n * share))
    slot_least = min(slots, max(10, round(slots * slot_share)))
    prev = F.lag("close").over(W())
    x = bars.withColumns({"_tr": F.greatest(h(), prev) - F.least(l(), prev), "_slot": local_slot("Europe/London"), "_v": F.when(v() > 0, v())})
    x = x.withColumn("_s", 2 * (c() - F.col("mid")) / pip).withColumn("_s", F.when(F.col("_s") > 0, F.col("_s")))
    mean_tr = lambda n: mean_n("_tr", W(), n, least(n))
    span_of = lambda n: max_n("high", W(), n, least(n)) - min_n("low", W(), n, least(n))
    rank01 = lambda name: rank_avg(F.round(name, 9), W(), wide, least(wide) // 2 + 1) / 100  # noqa: E731  equal to nine digits is a tie
    slot, past = ordered("symbol", "_slot"), before_n(W(), span)
    top, low = (framed(f(q), F.col(q), before_n(W(), k), least(k)) for f, q in ((F.max, "high"), (F.min, "low")))
    x = x.withColumns({"vol_ratio": sdiv(mean_tr(fast), mean_tr(slow)), "_rf": span_of(fast), "_rs": F.nullif(span_of(slow), F.lit(0.0)), "_top": top, "_low": low, "_ak": F.nullif(mean_tr(k), F.lit(0.0))})
    x = x.withColumn("_x", sln(F.col("vol_ratio")))
    q = lambda p: framed(F.percentile("_x", p), F.col("_x"), past, least(span))
    med = framed(F.percentile("_s", 0.5), F.col("_s"), before_n(slot, slots), slot_least)
    x = x.withColumns({"_m": q(0.5), "_iqr": q(0.75) - q(0.25), "spread_norm": sln(sdiv(F.col("_s"), med)), "_lv": sln(F.col("_v")), "_ls": sln(F.col("_s"))})
    x = x.withColumns({f"{k_}_z": zscore_before(k_, slot, slots, slot_least) for k_ in ("_lv", "_ls")}).withColumn("liq_impulse_score", F.col("_lv_z") - F.col("_ls_z"))
    x = x.withColumns({"spread_regime": rank01("spread_norm"), "liq_impulse": rank01("liq_impulse_score"), "_vp": rank01("vol_ratio")})
    x = x.withColumn("queue_good", 0.5 * ((1 - F.col("_vp")) + (1 - F.col("spread_regime"))))
    spread = F.coalesce(framed(F.percentile("_s", 0.5), F.col("_s"), last_n(W(), wide), least(wide) // 2 + 1), F.lit(FALLBACK_SPREAD))
    outside = F.greatest(sdiv(c() - F.col("_top"), F.col("_ak")), F.lit(0.0)) + F.least(sdiv(c() - F.col("_low"), F.col("_ak")), F.lit(0.0))
    return x.withColumns(
        {
            "vol_shift": sdiv(F.col("_x") - F.col("_m"), F.col("_iqr") / 1.349), "range_ratio": sdiv(F.col("_rf"), F.col("_rs")),
            "micro_break": F.when(F.col("_top").isNotNull() & F.col("_low").isNotNull() & F.col("_ak").isNotNull(), outside),
            "maker_ok": F.col("queue_good") * (1 - F.col("liq_impulse")),
            "sl_pips": clip(SL * F.col("_rs") / pip, *SL_PIPS), "tp_pips": clip(TP * F.col("_rs") / pip, *TP_PIPS), "trail_pips": clip(TRAIL * F.nullif("_rf", F.lit(0.0)) / pip, *TRAIL_PIPS),
            "cost_floor_pips": spread + 2 * SLIPPAGE + 2 * COMMISSION / 1e6 * c() / pip,
        }
    ).drop("_tr", "_slot", "_v", "_s", "_rf", "_rs", "_top", "_low", "_ak", "_x", "_m", "_iqr", "_lv", "_ls", "_lv_z", "_ls_z", "_vp")
