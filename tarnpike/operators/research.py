"""Calendar scores, derivations of external series, more labels, and the tables behind research reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnpike.functions.safe import after_n, before_n, clip, correlation, event, framed, last_n, max_n, mean_n, min_n, ordered, rank_avg, rank_strict, sdiv, sln, zscore_n
from tarnpike.operators.align import asof
from tarnpike.operators.indicators import W, c, wilder

# calendar -----------------------------------------------------------------------------------------------------------


def clocks_of_days(days: DataFrame, events: DataFrame, names: list[str]) -> DataFrame:
    """(day, clock, until, since): for each day and each clock named, of ``events`` (clock, day), calendar days until its next and since its last event
    day; both 0 on it, null outside the calendar. Tables of days: one row for each day and clock is all that is ordered."""
    e = events.select("clock", F.to_date("day").alias("day")).where("day is not null").distinct()
    grid = days.select(F.to_date("day").alias("day")).distinct().withColumn("clock", F.explode(F.array(*map(F.lit, names))))
    x = asof(grid, e.withColumn("_n", F.col("day")), ["_n"], ["clock"], ts="day", forward=True)
    x = asof(x, e.withColumn("_l", F.col("day")), ["_l"], ["clock"], ts="day")
    return x.select("day", "clock", F.datediff("_n", "day").cast("double").alias("until"), F.datediff("day", "_l").cast("double").alias("since"))


def cycle_place(until: Column, since: Column) -> Column:
    """Place in the time between two events, 0 just after one and 1 on its day."""
    return F.when(until.isNotNull() & since.isNotNull(), F.when(since + until == 0, 1.0).otherwise(since / F.nullif(since + until, F.lit(0.0))))


def event_clock(bars: DataFrame, events: DataFrame, prefix: str, window: int = 2) -> DataFrame:
    """Calendar days until the next and since the last event (both 0 on its day; null outside the calendar), proximity 1 / (1 + until),
    recency 1 / (1 + since), place in the cycle (see ``cycle_place``) and flags for ``window`` days before and after.

    ``events`` has one column, ``day``, for one kind of event. Only days are put in order, never bars.
    """
    x = bars.withColumn("_day", F.to_date("ts"))
    clock = clocks_of_days(x.select(F.col("_day").alias("day")), events.select(F.lit(prefix).alias("clock"), "day"), [prefix])
    x = x.join(clock.select(F.col("day").alias("_day"), F.col("until").alias(f"{prefix}_until"), F.col("since").alias(f"{prefix}_since")), "_day", "left")
    u, s = F.col(f"{prefix}_until"), F.col(f"{prefix}_since")
    return x.withColumns(
        {
            f"{prefix}_proximity": 1 / (1 + u), f"{prefix}_recency": 1 / (1 + s), f"{prefix}_cycle": cycle_place(u, s),
            f"{prefix}_pre": ((u >= 1) & (u <= window)).cast("int"), f"{prefix}_post": ((s >= 1) & (s <= window)).cast("int"),
        }
    ).drop("_day")


def calendar_direction(bars: DataFrame, events: DataFrame, names: list[str], k: int, squeeze: tuple[int, int], n: int, window: int = 3, low_rank: float = 20.0) -> DataFrame:
    """Scores around scheduled events of the clocks named (``events`` has clock and ts, the published time): by clock x

    x_prox_intraday: 1 / (1 + days to the next event's time); x_pre_ramp, x_post_ramp: proximity 1 to ``window`` days before, recency as many after, else 0;
    x_pre_momo, x_day_momo, x_post_cont: the k-bar move in true ranges before, on and after event days; x_pre_squeeze: it where the range of the bars in
    ``squeeze`` (bars, ranks) is narrow; x_post_event_cont: after it the event day's own log return over its deviation in n days. Of the first two clocks a, b:
    a_b_convergence and a_b_cycle_diff, proximity and place in the cycle of one less the other. Prices are those of the bars before.
    """
    w, reach = squeeze
    x = wilder(bars, k).withColumn("_day", F.to_date("ts"))
    x = x.withColumn("_m", sdiv(c() - F.lag("close", k).over(W()), F.col(f"atr_{k}"))).withColumn("_g", max_n("high", W(), w) - min_n("low", W(), w)).withColumn("_rank", rank_avg("_g", W(), reach, max(2, reach // 2)))
    x = x.withColumns({"_m": F.lag("_m").over(W()), "_rank": F.lag("_rank").over(W())})
    day = bars.groupBy("symbol", F.to_date("ts").alias("_day")).agg(F.min_by("open", "ts").alias("_o"), F.max_by("close", "ts").alias("_c"))
    day = day.withColumn("_r", sln(sdiv(F.col("_c"), F.col("_o"))))
    past = before_n(ordered("symbol", by="_day"), n)
    day = day.withColumn("_z", sdiv(F.col("_r"), framed(F.stddev_samp("_r"), F.col("_r"), past, max(5, n // 2)))).select("symbol", "_day", "_z")
    clocks = clocks_of_days(x.select(F.col("_day").alias("day")), events.select("clock", F.col("ts").alias("day")), names)
    wide = clocks.groupBy("day").agg(*(F.max(F.when(F.col("clock") == e, F.col(v))).alias(f"_{e}_{v}") for e in names for v in ("until", "since")))
    x = x.join(wide.withColumnRenamed("day", "_day"), "_day", "left")
    at = asof(x.select("ts").distinct().withColumn("clock", F.explode(F.array(*map(F.lit, names)))), events.select("clock", "ts", F.col("ts").alias("_at")), ["_at"], ["clock"], forward=True)
    hours = at.groupBy("ts").agg(*(F.max(F.when(F.col("clock") == e, (F.unix_micros(F.col("_at").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 3.6e9)).alias(f"_{e}_hours") for e in names))
    x = x.join(hours, "ts", "left")
    for e in names:
        u, s, m = F.col(f"_{e}_until"), F.col(f"_{e}_since"), F.col("_m")
        pre, post = (u >= 1) & (u <= window), (s >= 1) & (s <= window)
        gone = day.select("symbol", F.col("_day").alias("_then"), "_z")
        x = x.withColumn("_then", F.date_sub("_day", s.cast("int"))).join(gone, ["symbol", "_then"], "left")
        x = x.withColumns(
            {
                f"{e}_prox_intraday": 1 / (1 + F.col(f"_{e}_hours") / 24.0), f"{e}_pre_ramp": event(1 / (1 + u), pre), f"{e}_post_ramp": event(1 / (1 + s), post),
                f"{e}_pre_momo": event(m, pre), f"{e}_day_momo": event(m, u == 0), f"{e}_post_cont": event(m, post),
                f"{e}_pre_squeeze": F.when(pre.isNotNull() & F.col("_rank").isNotNull(), event(m, pre & (F.col("_rank") <= low_rank))), f"{e}_post_event_cont": event(F.col("_z"), post),
            }
        ).drop("_then", "_z")
    if len(names) > 1:
        a, b = names[:2]
        p, q = (cycle_place(F.col(f"_{e}_until"), F.col(f"_{e}_since")) for e in (a, b))
        x = x.withColumns({f"{a}_{b}_convergence": 1 / (1 + F.col(f"_{a}_until")) - 1 / (1 + F.col(f"_{b}_until")), f"{a}_{b}_cycle_diff": p - q})
    return x.drop("_day", "_m", "_g", "_rank", *(f"_{e}_{v}" for e in names for v in ("until", "since", "hours")))


def day_counts(events: DataFrame, days: DataFrame, n: int) -> DataFrame:
    """(day, events, density): events of the day and of it and the n - 1 days after; null density where the calendar ends sooner. ``days`` has every day."""
    per = events.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("events"))
    x = days.join(per, "day", "left").withColumn("events", F.coalesce("events", F.lit(0)))
    f = Window.orderBy("day").rowsBetween(0, n - 1)
    return x.withColumn("density", F.when(F.count("*").over(f) == n, F.sum("events").over(f)))


# external series ----------------------------------------------------------------------------------------------------


def positioning(weekly: DataFrame, longs: str, shorts: str, interest: str, n: int = 52, least: int = 26, lag_days: int = 3, date: str = "date") -> DataFrame:
    """Net share of open interest, its change, and its strict rank over n weeks, dated ``lag_days`` later, when it is published."""
    w = Window.orderBy(date)
    x = weekly.withColumn("net_position", sdiv(F.col(longs) - F.col(shorts), F.col(interest))).withColumn("net_change", F.col("net_position") - F.lag("net_position").over(w))
    return x.withColumn("position_index", rank_strict("net_position", w, n, least)).select(F.date_add(date, lag_days).alias(date), "net_position", "net_change", "position_index")


def level_features(series: DataFrame, value: str, n: int, z: int, date: str = "date") -> DataFrame:
    """Level, one-row change, strict rank over n rows, z over the last z rows."""
    w = Window.orderBy(date)
    return series.withColumns({"change": F.col(value) - F.lag(value).over(w), "percentile": rank_strict(value, w, n, n // 2), "zscore": zscore_n(value, w, z, z // 2)})


def spread_features(both: DataFrame, a: str, b: str, n: int, date: str = "date") -> DataFrame:
    """a less b, its changes over 5 and 20 rows, and the z of each over n rows."""
    w = Window.orderBy(date)
    x = both.withColumn("diff", F.col(a) - F.col(b))
    x = x.withColumns({"diff_chg5": F.col("diff") - F.lag("diff", 5).over(w), "diff_chg20": F.col("diff") - F.lag("diff", 20).over(w)})
    return x.withColumns({f"{k}_z": zscore_n(k, w, n, n // 2) for k in ("diff", "diff_chg5", "diff_chg20")})


def agreement(df: DataFrame, slopes: dict[str, float], out: str = "mtf_agreement") -> DataFrame:
    """Mean of tanh(slope / scale) over timeframes; null if one is unknown."""
    terms = [F.tanh(F.col(k) / s) for k, s in slopes.items()]
    return df.withColumn(out, sum(terms[1:], terms[0]) / len(terms))


# labels -------------------------------------------------------------------------------------------------------------


def excursion_race(bars: DataFrame, distance: str, horizon: int) -> DataFrame:
    """fast_long is 1 if the price rises by the distance before it falls by it within the horizon (a bar with both counts for neither), fast_short the mirror; null without a bar ahead."""
    x = bars.withColumn("_w", F.collect_list(F.struct("high", "low")).over(after_n(W(), horizon)))
    d = F.col(distance)
    place = lambda hit: F.coalesce(F.array_position(F.transform("_w", hit), True), F.lit(0))
    x = x.withColumns({"_u": place(lambda b: F.coalesce(b["high"] >= c() + d, F.lit(False))), "_d": place(lambda b: F.coalesce(b["low"] <= c() - d, F.lit(False)))})
    up, dn = F.col("_u"), F.col("_d")
    known = (F.size("_w") > 0) & d.isNotNull()
    return x.withColumns({"fast_long": F.when(known, ((up > 0) & ((dn == 0) | (up < dn))).cast("int")), "fast_short": F.when(known, ((dn > 0) & ((up == 0) | (dn < up))).cast("int"))}).drop("_w", "_u", "_d")


def valid_setups(bars: DataFrame, trigger: Column, horizon: int, pips: float, pip: float, atr: str, k: float) -> DataFrame:
    """With ``setup``: 1 at a trigger whose largest move ahead reaches ``pips`` or k mean true ranges, 0 if not, null elsewhere and at the end."""
    mfe = F.max("high").over(after_n(W(), horizon)) - c()
    ok = (mfe >= pips * pip) | (mfe >= k * F.col(atr))
    return bars.withColumn("setup", F.when(trigger & mfe.isNotNull(), F.coalesce(ok, F.lit(False)).cast("int")))


def tune_multiplier(rate, low: float, high: float, lowest: float, highest: float, steps: int = 12) -> tuple[float, float]:
    """A multiplier whose positive rate lies in [lowest, highest], by bisection on a falling function of it, and that rate. One job each step."""
    mid, got = low, rate(low)
    for _ in range(steps):
        mid = (low + high) / 2
        got = rate(mid)
        if lowest <= got <= highest:
            break
        low, high = (mid, high) if got > highest else (low, mid)
    return mid, got


# tables of results --------------------------------------------------------------------------------------------------


def grouped_metrics(df: DataFrame, y: str, pred: str, regimes: list[str]) -> DataFrame:
    """Confusion counts, precision and recall by each regime column and over all rows, by grouping sets: one pass."""
    ids = df.groupingSets([[], *([r] for r in regimes)], *regimes).agg(
        F.count("*").alias("n"), F.sum(F.when((F.col(y) == 1) & (F.col(pred) == 1), 1).otherwise(0)).alias("tp"), F.sum(F.when((F.col(y) == 0) & (F.col(pred) == 1), 1).otherwise(0)).alias("fp"), F.sum(F.when((F.col(y) == 1) & (F.col(pred) == 0), 1).otherwise(0)).alias("fn"),
        *(F.grouping(r).alias(f"_{r}") for r in regimes),
    )
    scope = F.lit("overall")
    value = F.lit("all")
    for r in regimes:
        scope = F.when(F.col(f"_{r}") == 0, F.lit(r)).otherwise(scope)
        value = F.when(F.col(f"_{r}") == 0, F.coalesce(F.col(r).cast("string"), F.lit("unknown"))).otherwise(value)
    tp = F.col("tp").cast("double")
    return ids.select(scope.alias("scope"), value.alias("value"), "n", "tp", "fp", "fn", sdiv(tp, tp + F.col("fp")).alias("precision"), sdiv(tp, tp + F.col("fn")).alias("recall"))


def probability_table(oof: DataFrame, ts: str, model: str, score: str, seq: str, names: list[str]) -> DataFrame:
    """One row for each time, a column for each model: its last score."""
    return oof.groupBy(ts).pivot(model, names).agg(F.max_by(score, seq))


def sign_stability(df: DataFrame, x: str, y: str, period: Column, keys: list[str], least: int = 10) -> DataFrame:
    """(keys, periods, same_sign): correlations by period, and the share with the sign of their mean."""
    each = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, period.alias("_p")).agg(correlation(x, y).alias("_r"), F.count("*").alias("_n")).where(F.col("_n") >= least)
    m = F.signum(F.avg("_r").over(Window.partitionBy(*keys)))
    return each.withColumn("_s", (F.signum("_r") == m).cast("double")).groupBy(*keys).agg(F.count("*").alias("periods"), F.avg("_s").alias("same_sign"))


def terciles(df: DataFrame, z: str, cut: float = 0.4307) -> Column:
    """low, mid or high by a z score, at the thirds of a normal distribution."""
    return F.when(F.col(z) < -cut, "low").when(F.col(z) > cut, "high").when(F.col(z).isNotNull(), "mid")


def probability_histogram(df: DataFrame, p: str, keys: list[str], bins: int = 10) -> DataFrame:
    """(keys, bin, n, share) over equal bins of [0, 1], the last one closed."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    g = df.where(F.col(p).between(0, 1)).groupBy(*keys, b.alias("bin")).agg(F.count("*").alias("n"))
    return g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))


def monthly_matrix(trades: DataFrame, config: str, when: str, value: str, names: list[str]) -> DataFrame:
    """Sums by month and configuration, 0 where there is none."""
    return trades.groupBy(F.date_trunc("month", when).cast("timestamp_ntz").alias("month")).pivot(config, names).agg(F.sum(value)).na.fill(0.0)


def run_name_parts(df: DataFrame, name: str) -> DataFrame:
    """base, fold, seed and test of run names: the parts __bt..., _wfNN and _sN in any order."""
    n = F.col(name)
    number = lambda p: F.regexp_extract(n, p, 1).try_cast("int")
    return df.withColumns({"base": F.regexp_replace(n, r"(__bt[A-Za-z0-9]*|_wf\d+|_s\d+)(?=_|$)", ""), "fold": number(r"_wf(\d+)(?=_|$)"), "seed": number(r"_s(\d+)(?=_|$)"), "test": F.nullif(F.regexp_extract(n, r"__bt([A-Za-z0-9]*)", 1), F.lit(""))})


def flat_metrics(df: DataFrame, keys: list[str], json: str) -> DataFrame:
    """(keys, metric, value) of the numeric leaves of a JSON object of objects, named a/b."""
    outer = df.select(*keys, F.explode(F.from_json(json, "map<string,string>")).alias("_a", "_v"))
    inner = outer.select(*keys, "_a", "_v", F.explode_outer(F.from_json("_v", "map<string,string>")).alias("_b", "_w"))
    value = F.coalesce(F.col("_w"), F.col("_v")).try_cast("double")
    return inner.select(*keys, F.concat_ws("/", "_a", "_b").alias("metric"), value.alias("value")).where("value is not null and not isnan(value)")


def parity(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str], tolerance: float) -> DataFrame:
    """Rows of two runs that differ: (keys, column, left, right, missing in one, apart)."""
    long = lambda df, n: df.unpivot(keys, columns, "column", n)
    x = long(a, "left").join(long(b, "right"), [*keys, "column"], "full_outer")
    apart = F.col("left").eqNullSafe(F.col("right")) | (F.abs(F.col("left") - F.col("right")) <= tolerance)
    return x.where(~F.coalesce(apart, F.lit(False)))


def cohen_kappa(df: DataFrame, a: str, b: str, keys: list[str]) -> DataFrame:
    """(keys, n, agreement, kappa) of two labels with values 0 and 1."""
    x = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.avg((F.col(a) == F.col(b)).cast("double")).alias("agreement"), F.avg(a).alias("_a"), F.avg(b).alias("_b"))
    chance = F.col("_a") * F.col("_b") + (1 - F.col("_a")) * (1 - F.col("_b"))
    return x.withColumn("kappa", sdiv(F.col("agreement") - chance, 1 - chance)).drop("_a", "_b")


def stationarity(df: DataFrame, x: str, keys: list[str], ts: str, q: int = 5) -> DataFrame:
    """(keys, n, df_stat, variance_ratio, kpss, mean_drift): Dickey-Fuller t of the level in a regression of its change, variance ratio of q-step changes,
    KPSS statistic of the level about its mean (no lags), and the range of a 50-row mean over the deviation."""
    w, all_ = ordered(*keys, by=ts), Window.partitionBy(*keys)
    y = df.where(F.col(x).isNotNull()).withColumn("_l", F.lag(x).over(w)).withColumn("_d", F.col(x) - F.col("_l")).withColumn("_q", F.col(x) - F.lag(x, q).over(w))
    y = y.withColumn("_e", F.col(x) - F.avg(x).over(all_)).withColumn("_s", F.sum("_e").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_m", framed(F.avg(x), F.col(x), last_n(w, 50), 50))
    g = y.groupBy(*keys).agg(
        F.count("*").alias("n"), F.regr_slope("_d", "_l").alias("_b"), F.regr_sxx("_d", "_l").alias("_sxx"), F.regr_syy("_d", "_l").alias("_syy"), F.regr_count("_d", "_l").alias("_k"),
        F.var_pop("_d").alias("_vd"), F.var_pop("_q").alias("_vq"), F.sum(F.col("_s") * F.col("_s")).alias("_ss"), F.sum(F.col("_e") * F.col("_e")).alias("_ee"), (F.max("_m") - F.min("_m")).alias("_r"), F.stddev_samp(x).alias("_sd"),
    )
    se = F.sqrt(clip(F.col("_syy") - F.col("_b") * F.col("_b") * F.col("_sxx"), 0.0, 1e300) / F.nullif(F.col("_k") - 2, F.lit(0)) / F.nullif("_sxx", F.lit(0.0)))
    n = F.col("n").cast("double")
    return g.select(*keys, "n", sdiv(F.col("_b"), se).alias("df_stat"), sdiv(F.col("_vq"), q * F.col("_vd")).alias("variance_ratio"), sdiv(F.col("_ss"), n * F.col("_ee")).alias("kpss"), sdiv(F.col("_r"), F.col("_sd")).alias("mean_drift"))


def stationarity_verdict(stats: DataFrame, df_level: float = -2.86, kpss_level: float = 0.463) -> DataFrame:
    rejects, level = F.col("df_stat") < df_level, F.col("kpss") < kpss_level
    return stats.withColumn("verdict", F.when(rejects & level, "stationary").when(~rejects & ~level, "non-stationary").otherwise("inconclusive"))


def health_checks(summary: DataFrame) -> DataFrame:
    """(check, status) of one row with cv_accuracy (share), trades, win_rate (percent), total_pnl, stop_share (percent), buy_pnl, sell_pnl,
    features and features_selected; checks of unknown values are left out."""
    a, t, w, p, s, b, q = (F.col(k) for k in ("cv_accuracy", "trades", "win_rate", "total_pnl", "stop_share", "buy_pnl", "sell_pnl"))
    cut = (1 - F.col("features_selected") / F.nullif(F.col("features"), F.lit(0))) * 100
    status = {
        "cv_accuracy": F.when(a > 0.55, "PASS").when(a > 0.52, "WARN").when(a.isNotNull(), "FAIL"),
        "win_rate": F.when(w.between(50, 75), "PASS").when(w > 80, "WARN").when(w.isNotNull(), "FAIL"),
        "total_pnl": F.when(p > 0, "PASS").when(p.isNotNull(), "FAIL"),
        "trades": F.when(t >= 30, "PASS").when(t >= 15, "WARN").when(t.isNotNull(), "FAIL"),
        "stops": F.when(s < 30, "PASS").when(s < 50, "WARN").when(s.isNotNull(), "FAIL"),
        "balance": F.when((b > 0) & (q > 0), "PASS").when((b > 0) | (q > 0), "WARN").when(b.isNotNull() | q.isNotNull(), "FAIL"),
        "selection": F.when(cut < 50, "PASS").when(cut.isNotNull(), "WARN"),
    }
    rows = F.array(*(F.struct(F.lit(k).alias("check"), x.alias("status")) for k, x in status.items()))
    return summary.select(F.explode(rows).alias("r")).select("r.check", "r.status").where("status is not null")


def paired_delta(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(n, mean, std, t) of a less b over equal keys (seeds, folds)."""
    x = a.select(*keys, F.col(value).alias("_a")).join(b.select(*keys, F.col(value).alias("_b")), keys).withColumn("_d", F.col("_a") - F.col("_b"))
    g = x.agg(F.count("*").alias("n"), F.avg("_d").alias("mean"), F.stddev_samp("_d").alias("std"))
    return g.withColumn("t", sdiv(F.col("mean"), F.col("std") / F.sqrt("n")))


def smoothed(df: DataFrame, x: str, n: int, keys: list[str], ts: str) -> DataFrame:
    return df.withColumn(f"{x}_{n}", mean_n(x, ordered(*keys, by=ts), n, 1))
