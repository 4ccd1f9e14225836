"""Queries on bars: building, aligning, indicators, sequences and panels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnpike.functions import safe
from tarnpike.functions.safe import ordered, rounded
from tarnpike.operators import align, crosssection, indicators, sequences, volume
from tarnpike.plans.sql import BARS, BY, DAILY, TRUE, div, gated, lag, lead, mean, over, prev, r, ranked, with_wilder
from tarnpike.sources import bars as src

W = indicators.W
QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.event_bars(spark, sf_dir)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shown(df: DataFrame, *cols: str) -> DataFrame:
    return rounded(df.select("symbol", "ts", *cols))


# building and aligning ----------------------------------------------------------------------------------------------


@query(f"""WITH {BARS}, daily AS (SELECT symbol, date_trunc('day', ts)::TIMESTAMP + INTERVAL 1 DAY AS seen, arg_max(close, ts) AS prior_close FROM bars GROUP BY symbol, date_trunc('day', ts)),
    f AS (SELECT *, {mean('close', 4)} AS m4, {gated('avg(close)', 'close', prev(24), 12)} AS m24, {gated('stddev_samp(close)', 'close', prev(24), 12)} AS s24 FROM bars)
    SELECT f.symbol, f.ts, {r('open', 'open')}, {r('high', 'high')}, {r('low', 'low')}, {r('close', 'close')}, volume, {r('mid', 'mid')}, {r('m4', 'sma_4')}, {r(div('close - m24', 's24'), 'z_24')}, {r('prior_close', 'prior_close')}
    FROM f ASOF LEFT JOIN daily d ON f.symbol = d.symbol AND f.ts >= d.seen""")
def bars_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars with a moving average, a causal z and the last close of an earlier day."""
    b = bars(spark, sf_dir)
    daily = b.groupBy("symbol", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ts")).agg(F.max_by("close", "ts").alias("prior_close"))
    x = b.withColumns({"sma_4": safe.mean_n("close", W(), 4), "z_24": safe.zscore_before("close", W(), 24)})
    return rounded(align.asof(x, daily, ["prior_close"], ["symbol"], available=F.col("ts") + F.expr("interval 1 day")))


@query(f"WITH {DAILY} SELECT symbol, ts, {r('open', 'open')}, {r('high', 'high')}, {r('low', 'low')}, {r('close', 'close')}, volume, {r('mid', 'mid')} FROM days")
def bars_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(src.order_bars(spark, sf_dir))


@query("SELECT event_type, date_trunc('hour', ts) AS hour, event_id, round(value, 6) + 0.0 AS value FROM events QUALIFY row_number() OVER (PARTITION BY event_type, date_trunc('hour', ts) ORDER BY event_id DESC) = 1")
def keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("event_type", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "event_id", "value")
    return rounded(src.keep_last(e, ["event_type", "hour"], "event_id"))


@query("""SELECT event_type, user_id, count(*) AS rows FROM events GROUP BY ALL HAVING count(DISTINCT value) + (count(value) < count(*) AND count(value) > 0)::INT > 1""")
def conflicting_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.conflicts(read(spark, sf_dir, "events"), ["event_type", "user_id"], ["value"])


@query("SELECT event_id, ts FROM events WHERE isodow(ts) <= 4 OR (isodow(ts) = 5 AND hour(ts) < 22)")
def weekend_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").where(src.weekday_hours(F.col("ts"))).select("event_id", "ts")


@query(f"""WITH {BARS} SELECT symbol, ts, {r(mean('close', 12, 6), 'mean_12')}, {r(gated('stddev_samp(close)', 'close', over(12), 6), 'std_12')}, {r(gated('stddev_pop(close)', 'close', over(12), 12), 'std_pop_12')},
    {r(gated('sum(volume)', 'volume', over(6), 6), 'sum_6')}, {r(gated('max(high)', 'high', over(8), 8), 'max_8')}, {r(gated('min(low)', 'low', over(8), 8), 'min_8')}, {r(f"close - {lag('close', 3)}", 'diff_3')}, {r(gated('quantile_cont(close, 0.8)', 'close', over(10), 10), 'q80_10')},
    {r(div(f"close - {mean('close', 20, 10)}", gated('stddev_samp(close)', 'close', over(20), 10)), 'z_20')} FROM bars""")
def rolling_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars(spark, sf_dir).withColumns(
        {
            "mean_12": safe.mean_n("close", W(), 12, 6), "std_12": safe.std_n("close", W(), 12, 6), "std_pop_12": safe.std_n("close", W(), 12, population=True), "sum_6": safe.sum_n("volume", W(), 6),
            "max_8": safe.max_n("high", W(), 8), "min_8": safe.min_n("low", W(), 8), "diff_3": F.col("close") - F.lag("close", 3).over(W()), "q80_10": safe.framed(F.percentile("close", 0.8), F.col("close"), safe.last_n(W(), 10), 10), "z_20": safe.zscore_n("close", W(), 20, 10),
        }
    )
    return shown(b, "mean_12", "std_12", "std_pop_12", "sum_6", "max_8", "min_8", "diff_3", "q80_10", "z_20")


@query(f"""WITH {BARS}, s AS (SELECT *, CASE WHEN volume >= 3 THEN close END AS x FROM bars)
    SELECT symbol, ts, {r(f'last_value(x IGNORE NULLS) OVER ({BY} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)', 'filled')}, {r(f'last_value(x IGNORE NULLS) OVER ({BY} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)', 'filled_2')} FROM s""")
def forward_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars(spark, sf_dir).withColumn("x", F.when(F.col("volume") >= 3, F.col("close")))
    return shown(b.withColumns({"filled": safe.ffill("x", W()), "filled_2": safe.ffill("x", W(), 2)}), "filled", "filled_2")


@query(f"""WITH {BARS}, s AS (SELECT *, CASE WHEN volume >= 3 THEN open END AS o FROM bars)
    SELECT symbol, time_bucket(INTERVAL 4 HOURS, ts) AS ts, {r('arg_min(o, CASE WHEN o IS NOT NULL THEN ts END)', 'o')}, {r('arg_max(close, ts)', 'close')}, {r('max(high)', 'high')}, {r('min(low)', 'low')}, sum(volume) AS volume FROM s GROUP BY ALL""")
def resample_4h(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars(spark, sf_dir).withColumn("o", F.when(F.col("volume") >= 3, F.col("open")))
    return rounded(align.resample(b, ["symbol"], "4 hours", first=["o"], last=["close"], highest=["high"], lowest=["low"], total=["volume"]))


@query(f"""WITH {BARS}, s AS (SELECT symbol, ts, {mean('close', 24)} AS slow, CASE WHEN volume >= 2 THEN close END AS x FROM bars),
    f AS (SELECT *, min(CASE WHEN slow IS NOT NULL AND x IS NOT NULL THEN ts END) OVER (PARTITION BY symbol) AS start FROM s) SELECT symbol, ts, {r('slow', 'slow')}, {r('x', 'x')} FROM f WHERE ts >= start""")
def leading_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars(spark, sf_dir).withColumns({"slow": safe.mean_n("close", W(), 24), "x": F.when(F.col("volume") >= 2, F.col("close"))})
    return shown(align.leading_trim(b, ["symbol"], ["slow", "x"]), "slow", "x")


@query(f"""WITH {BARS}, s AS (SELECT symbol, ts, {mean('close', 24)} AS slow, CASE WHEN volume >= 2 THEN close END AS x FROM bars), n AS (SELECT count(*) AS n, count_if(slow IS NULL) AS a, count_if(x IS NULL) AS b FROM s)
    SELECT 'slow' AS "column", a::BIGINT AS nulls, round(a / n, 6) + 0.0 AS share FROM n UNION ALL SELECT 'x', b::BIGINT, round(b / n, 6) + 0.0 FROM n""")
def null_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars(spark, sf_dir).withColumns({"slow": safe.mean_n("close", W(), 24), "x": F.when(F.col("volume") >= 2, F.col("close"))})
    return rounded(align.null_counts(b, ["slow", "x"]))


@query(f"""WITH {BARS}, h AS (SELECT symbol, ts + INTERVAL 4 HOURS AS seen, close AS slow_close, volume AS slow_volume FROM (SELECT symbol, time_bucket(INTERVAL 4 HOURS, ts) AS ts, arg_max(close, ts) AS close, sum(volume) AS volume FROM bars GROUP BY ALL))
    SELECT b.symbol, b.ts, {r('slow_close', 'slow_close')}, slow_volume FROM bars b ASOF LEFT JOIN h ON b.symbol = h.symbol AND b.ts >= h.seen""")
def asof_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars with the last finished 4-hour bar."""
    b = bars(spark, sf_dir)
    slow = align.resample(b, ["symbol"], "4 hours", last=["close"], total=["volume"]).select("symbol", "ts", F.col("close").alias("slow_close"), F.col("volume").alias("slow_volume"))
    x = align.asof(b, slow, ["slow_close", "slow_volume"], ["symbol"], available=F.col("ts") + F.expr("interval 4 hours"))
    return shown(x, "slow_close", "slow_volume")


@query(f"""WITH {BARS}, e AS (SELECT DISTINCT event_type AS symbol, date_trunc('day', ts)::TIMESTAMP AS d FROM events WHERE value > 300)
    SELECT b.symbol, b.ts, date_diff('day', b.ts, n.d)::BIGINT AS days_until, date_diff('day', p.d, b.ts)::BIGINT AS days_since FROM bars b ASOF LEFT JOIN e p ON b.symbol = p.symbol AND date_trunc('day', b.ts) >= p.d ASOF LEFT JOIN e n ON b.symbol = n.symbol AND date_trunc('day', b.ts) <= n.d""")
def event_clocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days until the next and since the last day with a large event."""
    b = bars(spark, sf_dir).withColumn("day", F.date_trunc("day", "ts").cast("timestamp_ntz"))
    e = read(spark, sf_dir, "events").where("value > 300").select(F.col("event_type").alias("symbol"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).distinct()
    x = align.asof(b, e.withColumn("next_day", F.col("day")), ["next_day"], ["symbol"], ts="day", forward=True)
    x = align.asof(x, e.withColumn("last_day", F.col("day")), ["last_day"], ["symbol"], ts="day")
    return x.select("symbol", "ts", F.datediff("next_day", "day").cast("long").alias("days_until"), F.datediff("day", "last_day").cast("long").alias("days_since"))


@query("""WITH a AS (SELECT o_orderdate::DATE AS date, sum(o_totalprice) AS a FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT l_shipdate::DATE AS date, sum(l_quantity) AS b FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
    j AS (SELECT coalesce(a.date, b.date) AS date, a, b FROM a FULL JOIN b ON a.date = b.date), f AS (SELECT date, last_value(a IGNORE NULLS) OVER w AS a, last_value(b IGNORE NULLS) OVER w AS b FROM j WINDOW w AS (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    SELECT date::TIMESTAMP AS date, round(lag(a) OVER (ORDER BY date), 2) + 0.0 AS a, round(lag(b) OVER (ORDER BY date), 2) + 0.0 AS b FROM f""")
def sparse_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = read(spark, sf_dir, "orders").where("o_orderstatus = 'F'").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.sum("o_totalprice").alias("a"))
    b = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy(F.to_date("l_shipdate").alias("date")).agg(F.sum("l_quantity").alias("b"))
    return rounded(align.sparse_merge([a, b], "date"), 2).withColumn("date", F.col("date").cast("timestamp_ntz"))


@query(f"""WITH {BARS}, d AS (SELECT symbol, date_trunc('day', ts)::DATE AS date, arg_max(close, ts) AS close, sum(volume) AS volume FROM bars GROUP BY 1, 2),
    s AS (SELECT *, max(CASE WHEN volume >= 25 THEN date END) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seen FROM d) SELECT symbol, date::TIMESTAMP AS date, CASE WHEN date - seen <= 3 THEN round(close, 6) + 0.0 END AS close FROM s""")
def stale_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = bars(spark, sf_dir).groupBy("symbol", F.to_date("ts").alias("date")).agg(F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"))
    return rounded(align.stale_to_null(d, F.col("volume") >= 25, ["close"], 3, ["symbol"]).select("symbol", F.col("date").cast("timestamp_ntz").alias("date"), "close"))


@query(f"""WITH {BARS}, g AS (SELECT *, CASE WHEN epoch(ts) - epoch({lag('ts')}) > 10800 THEN 1 ELSE 0 END AS n FROM bars), s AS (SELECT *, sum(n) OVER ({BY} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS segment FROM g)
    SELECT symbol, ts, segment, round(CASE WHEN {lag('segment', 2)} = segment THEN close - {lag('close', 2)} END, 6) + 0.0 AS d2 FROM s""")
def segmented_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = align.segments(bars(spark, sf_dir), ["symbol"], 3 * 3600)
    return shown(align.segmented_diff(x, "close", 2, ["symbol"], "d2"), "segment", "d2")


@query(f"""WITH {BARS}, y AS (SELECT symbol, ts, CASE WHEN close > 350 THEN 1 ELSE 0 END AS y FROM bars), n AS (SELECT *, row_number() OVER (PARTITION BY symbol, y ORDER BY ts) - 1 AS i FROM y)
    SELECT symbol, ts, y FROM n WHERE y = 1 OR i % 7 = 0 OR EXISTS (SELECT 1 FROM y p WHERE p.symbol = n.symbol AND p.y = 1 AND n.ts BETWEEN p.ts - INTERVAL 2 HOURS AND p.ts + INTERVAL 4 HOURS)""")
def sampling_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = bars(spark, sf_dir).select("symbol", "ts", F.when(F.col("close") > 350, 1).otherwise(0).alias("y"))
    return align.sampling_context(y, "y", 7, 2, 4, ["symbol"])


@query("""WITH o AS (SELECT c_custkey AS k, round(c_acctbal, 2) AS v FROM customer), n AS (SELECT o_custkey AS k, round(max(o_totalprice), 2) AS v FROM orders GROUP BY 1)
    SELECT coalesce(o.k, n.k) AS k, round(coalesce(n.v, o.v), 2) + 0.0 AS v FROM o FULL JOIN n ON o.k = n.k""")
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.round("c_acctbal", 2).alias("v"))
    new = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.round(F.max("o_totalprice"), 2).alias("v"))
    return rounded(src.upsert(old, new, ["k"]), 2)


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def missing_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.missing_keys(read(spark, sf_dir, "customer").select("c_custkey"), read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query(f"""WITH {BARS}, d AS (SELECT DISTINCT symbol, ts::DATE AS day FROM bars), e AS (SELECT event_type AS symbol, ts::DATE AS day, count(*) AS n FROM events WHERE value > 100 GROUP BY 1, 2)
    SELECT d.symbol, d.day::TIMESTAMP AS day, sum(coalesce(n, 0)) OVER (PARTITION BY d.symbol ORDER BY d.day ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)::BIGINT AS density FROM d LEFT JOIN e ON d.day = e.day AND d.symbol = e.symbol""")
def event_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """High events of each kind on each of its days and the two after."""
    day = F.to_date("ts").alias("day")
    n = read(spark, sf_dir, "events").where("value > 100").groupBy(F.col("event_type").alias("symbol"), day).agg(F.count("*").alias("n"))
    d = bars(spark, sf_dir).select("symbol", day).distinct().join(n, ["symbol", "day"], "left")
    return d.select("symbol", F.col("day").cast("timestamp_ntz").alias("day"), F.sum(F.coalesce("n", F.lit(0))).over(ordered("symbol", by="day").rowsBetween(0, 2)).alias("density"))


# indicators ---------------------------------------------------------------------------------------------------------


@query(f"""WITH RECURSIVE {with_wilder(20)}, m AS (SELECT *, {mean('close', 20)} AS m, {gated('stddev_pop(close)', 'close', over(20), 20)} AS s FROM a), b AS (SELECT *, m + 2 * s AS u, m - 2 * s AS d, 400 * s / nullif(m, 0) AS wd FROM m)
    SELECT symbol, ts, {r('m', 'bb_middle')}, {r('u', 'bb_upper')}, {r('d', 'bb_lower')}, {r('100 * ' + div('u - d', 'm'), 'bb_width')}, {r(div('close - d', 'u - d'), 'bb_percent')}, {r(f"CASE WHEN u - d = 0 THEN 0 ELSE {div('close - d', 'u - d')} END", 'bb_position')}, {r(div('wd', 'close'), 'bb_squeeze')},
    {r(div('close - m', 'atr'), 'bb_deviation')}, {r(f"abs({div('close - m', 'atr')})", 'abs_bb_deviation')}, {r(f"CASE WHEN u - d = 0 THEN 0 ELSE {div('close - d', 'u - d')} END * wd", 'bb_edge_impact')} FROM b""")
def bollinger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(indicators.bollinger(bars(spark, sf_dir)), "bb_middle", "bb_upper", "bb_lower", "bb_width", "bb_percent", "bb_position", "bb_squeeze", "bb_deviation", "abs_bb_deviation", "bb_edge_impact")


@query(f"""WITH {BARS}, x AS (SELECT *, {gated('max(high)', 'high', over(20), 20)} AS t, {gated('min(low)', 'low', over(20), 20)} AS l, {gated('max(high)', 'high', prev(20), 20)} AS pt, {gated('min(low)', 'low', prev(20), 20)} AS pl FROM bars)
    SELECT symbol, ts, {r(div('close - l', 't - l'), 'channel_pos_20')}, (close > pt)::INT AS break_up_20, (close < pl)::INT AS break_down_20 FROM x""")
def donchian(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(indicators.donchian(bars(spark, sf_dir), 20), "channel_pos_20", "break_up_20", "break_down_20")


def _mid(n: int) -> str:
    return f"({gated('max(high)', 'high', over(n), n)} + {gated('min(low)', 'low', over(n), n)}) / 2"


@query(f"""WITH RECURSIVE {with_wilder(26, 52)}, x AS (SELECT *, {_mid(9)} AS cv, {_mid(26)} AS bs, {_mid(52)} AS b FROM a), y AS (SELECT *, (cv + bs) / 2 AS a FROM x), z AS (SELECT *, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN greatest(a, b) END AS t, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN least(a, b) END AS d FROM y)
    SELECT symbol, ts, {r('cv', 'ichi_conv')}, {r('bs', 'ichi_base')}, {r('a', 'ichi_a')}, {r('b', 'ichi_b')}, CASE WHEN t IS NULL THEN NULL WHEN a > b THEN 1 ELSE -1 END AS cloud_color, (close > t)::INT AS price_above_cloud,
    round(CASE WHEN t IS NULL THEN NULL WHEN close > t THEN (close - t) / nullif(atr_52, 0) WHEN close < d THEN (d - close) / nullif(atr_52, 0) ELSE 0 END, 6) + 0.0 AS distance_to_cloud, {r('(t - d) / nullif(atr_52, 0)', 'cloud_thickness')}, {r('(cv - bs) / nullif(atr_26, 0)', 'tenkan_kijun_diff')} FROM z""")
def ichimoku(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(indicators.ichimoku(bars(spark, sf_dir)), "ichi_conv", "ichi_base", "ichi_a", "ichi_b", "cloud_color", "price_above_cloud", "distance_to_cloud", "cloud_thickness", "tenkan_kijun_diff")


@query(f"""WITH {BARS}, x AS (SELECT *, 100 * {div('close - ' + gated('min(low)', 'low', over(14), 14), gated('max(high)', 'high', over(14), 14) + ' - ' + gated('min(low)', 'low', over(14), 14))} AS k FROM bars) SELECT symbol, ts, {r('k', 'stoch_k')}, {r(mean('k', 3), 'stoch_d')} FROM x""")
def stochastic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(indicators.stochastic(bars(spark, sf_dir)), "stoch_k", "stoch_d")


@query(f"""WITH {BARS}, x AS (SELECT *, abs(close - {lag('close')}) AS d FROM bars), y AS (SELECT *, {gated('sum(d)', 'd', over(20), 20)} AS p, abs(close - {lag('close', 20)}) AS m FROM x) SELECT symbol, ts, round(CASE WHEN p = 0 THEN 0 ELSE m / nullif(p, 0) END, 6) + 0.0 AS efficiency_20 FROM y""")
def price_efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(indicators.efficiency(bars(spark, sf_dir)), "efficiency_20")


@query(f"""WITH RECURSIVE {with_wilder(12)} SELECT symbol, ts, {r(div(gated('regr_slope(close, rn)', 'close', over(12), 12), 'atr'), 'trend_slope_12')}, {r('atr', 'atr_12')} FROM a""")
def trend_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(indicators.trend_slope(bars(spark, sf_dir), 12), "trend_slope_12", "atr_12")


@query(f"""WITH {BARS}, x AS (SELECT *, sign(close - {lag('close')}) AS s FROM bars), y AS (SELECT *, CASE WHEN s IS NOT DISTINCT FROM {lag('s')} THEN 0 ELSE 1 END AS n FROM x), z AS (SELECT *, sum(n) OVER ({BY} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM y)
    SELECT symbol, ts, (row_number() OVER (PARTITION BY symbol, g ORDER BY ts) * s)::BIGINT AS run FROM z""")
def run_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(indicators.run_length(bars(spark, sf_dir), F.col("close") - F.lag("close").over(W()), "run"), "run")


@query(f"""WITH RECURSIVE {with_wilder(10)} SELECT symbol, ts, {r(div('close', lag('close', 6)) + ' - 1', 'momentum_5')}, {r(div(f"(close - {lag('close', 10)}) - ({lag('close', 10)} - {lag('close', 20)})", 'atr'), 'momentum_accel_10')} FROM a""")
def momentum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(indicators.momentum_acceleration(indicators.momentum(bars(spark, sf_dir), 5), 10), "momentum_5", "momentum_accel_10")


@query(f"""WITH {BARS} SELECT symbol, ts, round(CASE WHEN high = low THEN 0.5 ELSE (close - low) / nullif(high - low, 0) END, 6) + 0.0 AS close_vs_range, round(CASE WHEN high = low THEN 0 ELSE abs(close - open) / nullif(high - low, 0) END, 6) + 0.0 AS body_ratio,
    round(CASE WHEN high = low THEN 0 ELSE (high - greatest(open, close)) / nullif(high - low, 0) END, 6) + 0.0 AS upper_wick, round(CASE WHEN high = low THEN 0 ELSE (least(open, close) - low) / nullif(high - low, 0) END, 6) + 0.0 AS lower_wick FROM bars""")
def bar_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(indicators.bar_shape(bars(spark, sf_dir)), "close_vs_range", "body_ratio", "upper_wick", "lower_wick")


@query(f"""WITH {BARS}, x AS (SELECT *, (high + low + close) / 3 AS tp FROM bars), y AS (SELECT *, {mean('tp', 20)} AS m, list(tp) OVER {over(20)} AS l FROM x)
    SELECT symbol, ts, round(CASE WHEN m IS NOT NULL THEN (tp - m) / nullif(0.015 * list_sum(list_transform(l, lambda v: abs(v - m))) / 20, 0) END, 6) + 0.0 AS cci_20 FROM y""")
def cci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(indicators.cci(bars(spark, sf_dir)), "cci_20")


@query(f"""WITH RECURSIVE {with_wilder(16)}, x AS (SELECT *, {mean('volume', 16, 4)} AS mv, CASE WHEN high = low THEN 0 ELSE ((close - low) - (high - close)) / nullif(high - low, 0) END AS f, list(volume) OVER {over(16)} AS l, {mean('atr', 16, 4)} AS am, {gated('sum((high + low + close) / 3 * volume)', 'volume', over(16), 4)} / nullif({gated('sum(volume)', 'volume', over(16), 4)}, 0) AS vw FROM a),
    y AS (SELECT *, CASE WHEN len(l) >= 4 THEN 100.0 * (len(list_filter(l, lambda q: q < volume)) + (len(list_filter(l, lambda q: q = volume)) + 1) / 2.0) / len(l) END AS vr FROM x)
    SELECT symbol, ts, {r('vr', 'volume_rank_16')}, round(ln(volume / mv) - CASE WHEN (high - low) / nullif(atr, 0) > 0 THEN ln((high - low) / atr) END, 6) + 0.0 AS effort_result_16, {r(div('close - vw', 'am'), 'vwap_deviation_16')},
    {r(div(gated('sum(f * volume)', 'f', over(16), 4), gated('sum(volume)', 'volume', over(16), 4)), 'cmf_16')}, {r(f"sign(close - {lag('close', 16)}) * (2 * vr / 100 - 1)", 'vol_price_divergence_16')} FROM y""")
def volume_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(indicators.volume_features(bars(spark, sf_dir), 16), "volume_rank_16", "effort_result_16", "vwap_deviation_16", "cmf_16", "vol_price_divergence_16")


@query(f"""WITH {BARS} SELECT symbol, ts, {r('(isodow(ts) - 1) / 4.0', 'day_of_week')}, {r('sin(month(ts) * 2 * pi() / 12)', 'month_sin')}, {r('cos(week(ts) * 2 * pi() / 53)', 'week_cos')}, {r('(quarter(ts) - 1) / 3.0', 'quarter')}, {r('sin((hour(ts) + minute(ts) / 60.0) * 2 * pi() / 24)', 'hour_sin')},
    (hour(ts) BETWEEN 8 AND 15)::INT AS london, (hour(ts) BETWEEN 13 AND 20)::INT AS new_york, (hour(ts) < 8)::INT AS asia, (hour(ts) BETWEEN 13 AND 15)::INT AS overlap FROM bars""")
def calendar_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(indicators.calendar_columns(bars(spark, sf_dir)), "day_of_week", "month_sin", "week_cos", "quarter", "hour_sin", "london", "new_york", "asia", "overlap")


@query(f"""WITH RECURSIVE {with_wilder(6)}, x AS (SELECT *, {mean('close', 24)} AS m, {mean('close', 200)} AS m200, {gated('max(high)', 'high', over(6), 6)} AS t, {gated('min(low)', 'low', over(6), 6)} AS l FROM a), y AS (SELECT *, {div('CASE WHEN coalesce(close > m, false) THEN t - close ELSE close - l END', 'atr')} AS p FROM x)
    SELECT symbol, ts, round(p, 5) + 0.0 AS pullback_6, round(CASE WHEN p IS NOT NULL THEN greatest(CASE WHEN coalesce(close > m200, false) THEN p ELSE -p END, 0) END, 5) + 0.0 AS pullback_score_6 FROM y""")
def pullback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(indicators.pullback(bars(spark, sf_dir), 6).select("symbol", "ts", "pullback_6", "pullback_score_6"), 5)


@query(f"""WITH RECURSIVE {with_wilder(14)}, x AS (SELECT *, list(atr) OVER {over(60)} AS v, count(*) OVER {over(60)} AS n FROM a)
    SELECT symbol, ts, {r('atr / 0.01', 'atr_pips')}, {r('100 * atr / nullif(close, 0)', 'atr_volatility_ratio')}, round(CASE WHEN atr IS NOT NULL AND len(list_filter(v, lambda q: q IS NOT NULL)) >= 30 THEN 100.0 * len(list_filter(v, lambda q: q <= atr)) / n END, 6) + 0.0 AS volatility_percentile FROM x""")
def true_range_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(indicators.true_range_units(bars(spark, sf_dir), 14, 0.01, 60), "atr_pips", "atr_volatility_ratio", "volatility_percentile")


@query(f"""WITH {BARS}, x AS (SELECT *, list(volume) OVER {over(30)} AS l, coalesce(list(volume) OVER {prev(29)}, []) AS p, coalesce(list(volume) OVER {prev(30)}, []) AS q FROM bars)
    SELECT symbol, ts, round(CASE WHEN len(l) >= 10 THEN 100.0 * len(list_filter(l, lambda v: v <= volume)) / len(l) END, 6) + 0.0 AS le, round(CASE WHEN len(l) >= 10 THEN 100.0 * (len(list_filter(l, lambda v: v < volume)) + (len(list_filter(l, lambda v: v = volume)) + 1) / 2.0) / len(l) END, 6) + 0.0 AS average,
    round(CASE WHEN len(p) >= 9 THEN 100.0 * len(list_filter(p, lambda v: v < volume)) / len(p) END, 6) + 0.0 AS strict, round(CASE WHEN len(q) >= 10 THEN len(list_filter(q, lambda v: v <= volume)) / len(q) END, 6) + 0.0 AS before FROM x""")
def rolling_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four conventions of a rolling percent rank."""
    b = bars(spark, sf_dir).withColumns({"le": safe.rank_le("volume", W(), 30, 10), "average": safe.rank_avg("volume", W(), 30, 10), "strict": safe.rank_strict("volume", W(), 30, 10), "before": safe.rank_prev_le("volume", W(), 30, 10)})
    return shown(b, "le", "average", "strict", "before")


def _recursive(x: str, alpha: float, name: str, start: int = 1) -> str:
    """CTEs: ``name`` with symbol, rn and y, the recursive mean of x in ``n`` (symbol, rn from 1)."""
    return f"""{name} AS (SELECT symbol, {start}::BIGINT AS rn, avg({x}) AS y FROM n WHERE rn <= {start} GROUP BY symbol HAVING count(*) = {start}
        UNION ALL SELECT n.symbol, n.rn, {alpha!r} * n.{x} + (1 - {alpha!r}) * e.y FROM {name} e JOIN n ON n.symbol = e.symbol AND n.rn = e.rn + 1)"""


@query(f"""WITH RECURSIVE {BARS}, n AS (SELECT *, row_number() OVER ({BY}) AS rn FROM bars), {_recursive('close', 2 / 13, 'f')}, {_recursive('close', 2 / 27, 's')}
    SELECT n.symbol, n.ts, {r('f.y', 'ema_12')}, {r('s.y', 'ema_26')} FROM n JOIN f USING (symbol, rn) JOIN s USING (symbol, rn)""")
def ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(indicators.ema(bars(spark, sf_dir), "close", [12, 26]), "ema_12", "ema_26")


@query(f"""WITH RECURSIVE {TRUE}, n AS (SELECT *, row_number() OVER ({BY}) AS rn FROM t), {_recursive('tr', 1 / 14, 'e', 14)} SELECT n.symbol, n.ts, round(coalesce(e.y, 0), 6) + 0.0 AS atr_14 FROM n LEFT JOIN e USING (symbol, rn)""")
def atr_wilder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(indicators.atr_wilder(bars(spark, sf_dir)), "atr_14")


@query(f"""WITH RECURSIVE {BARS}, d AS (SELECT *, close - {lag('close')} AS d FROM bars), n AS (SELECT *, greatest(d, 0) AS u, greatest(-d, 0) AS w, row_number() OVER ({BY}) AS rn FROM d WHERE d IS NOT NULL), {_recursive('u', 1 / 14, 'a', 14)}, {_recursive('w', 1 / 14, 'b', 14)}
    SELECT x.symbol, x.ts, round(CASE WHEN b.y = 0 THEN 100 ELSE 100 - 100 / (1 + a.y / nullif(b.y, 0)) END, 6) + 0.0 AS rsi FROM bars x LEFT JOIN n USING (symbol, ts) LEFT JOIN a ON a.symbol = n.symbol AND a.rn = n.rn LEFT JOIN b ON b.symbol = n.symbol AND b.rn = n.rn""")
def rsi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(indicators.rsi(bars(spark, sf_dir)), "rsi")


_MACD = ("macd", "macd_signal", "macd_diff", "macd_atr", "abs_macd_atr", "macd_signal_atr", "macd_diff_atr")


@query(f"""WITH RECURSIVE {with_wilder(26)}, n AS (SELECT * FROM a), {_recursive('close', 2 / 13, 'f')}, {_recursive('close', 2 / 27, 's')}, m AS (SELECT n.*, f.y - s.y AS m FROM n JOIN f USING (symbol, rn) JOIN s USING (symbol, rn) WHERE rn >= 26),
    g AS (SELECT symbol, 26::BIGINT AS rn, m AS y FROM m WHERE rn = 26 UNION ALL SELECT m.symbol, m.rn, 0.2 * m.m + 0.8 * g.y FROM g JOIN m ON m.symbol = g.symbol AND m.rn = g.rn + 1), j AS (SELECT n.symbol, n.ts, n.atr, m.m, CASE WHEN n.rn >= 34 THEN g.y END AS g FROM n LEFT JOIN m USING (symbol, rn) LEFT JOIN g USING (symbol, rn))
    SELECT symbol, ts, {r('m', 'macd')}, {r('g', 'macd_signal')}, {r('m - g', 'macd_diff')}, {r(div('m', 'atr'), 'macd_atr')}, {r(f"abs({div('m', 'atr')})", 'abs_macd_atr')}, {r(div('g', 'atr'), 'macd_signal_atr')}, {r(div('m - g', 'atr'), 'macd_diff_atr')} FROM j""")
def macd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(indicators.macd(bars(spark, sf_dir)), *_MACD)


@query(f"""WITH RECURSIVE {TRUE}, o AS (SELECT *, high - {lag('high')} AS up, {lag('low')} - low AS dn, row_number() OVER ({BY}) - 1 AS rn FROM t), n AS (SELECT symbol, ts, rn, CASE WHEN up > dn AND up > 0 THEN up ELSE 0 END AS p, CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0 END AS m, tr FROM o WHERE rn > 0),
    {_recursive('p', 1 / 14, 'sp', 14)}, {_recursive('m', 1 / 14, 'sm', 14)}, {_recursive('tr', 1 / 14, 'st', 14)}, d AS (SELECT symbol, rn, 100 * sp.y / nullif(st.y, 0) AS pos, 100 * sm.y / nullif(st.y, 0) AS neg FROM sp JOIN sm USING (symbol, rn) JOIN st USING (symbol, rn)),
    x AS (SELECT *, 100 * abs(pos - neg) / nullif(pos + neg, 0) AS dx, rn - 13 AS k FROM d), g AS (SELECT symbol, 14::BIGINT AS k, avg(dx) AS y FROM x WHERE k <= 14 GROUP BY symbol HAVING count(*) = 14 UNION ALL SELECT x.symbol, x.k, x.dx / 14 + {13 / 14!r} * g.y FROM g JOIN x ON x.symbol = g.symbol AND x.k = g.k + 1)
    SELECT o.symbol, o.ts, {r('pos', 'adx_pos')}, {r('neg', 'adx_neg')}, {r('g.y', 'adx')}, {r('g.y - lag(g.y, 5) OVER (PARTITION BY o.symbol ORDER BY o.ts)', 'adx_slope')} FROM o LEFT JOIN x ON x.symbol = o.symbol AND x.rn = o.rn LEFT JOIN g ON g.symbol = x.symbol AND g.k = x.k""")
def adx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(indicators.adx(bars(spark, sf_dir)), "adx_pos", "adx_neg", "adx", "adx_slope")


# sequences ----------------------------------------------------------------------------------------------------------


def _event(score: str, cond: str) -> str:
    return f"CASE WHEN ({score}) IS NULL OR ({cond}) IS NULL THEN NULL WHEN {cond} THEN {score} ELSE 0 END"


def _two_sided(up: str, a: str, down: str, b: str, known: str) -> str:
    return f"CASE WHEN NOT ({known}) THEN NULL WHEN {down} THEN {b} WHEN {up} THEN {a} ELSE 0 END"


_IMPULSE = _event("net / nullif(atr, 0) * eff", "eff >= 0.6")


@query(f"""WITH RECURSIVE {with_wilder(14)}, x AS (SELECT *, {gated('sum(close - open)', 'close', over(4), 4)} AS net, {gated('sum(high - low)', 'close', over(4), 4)} AS path, {gated('max(high)', 'high', prev(14), 14)} AS t, {gated('min(low)', 'low', prev(14), 14)} AS l FROM a),
    y AS (SELECT *, abs(net) / nullif(path, 0) AS eff, (close > t)::INT AS up, (close < l)::INT AS dn FROM x),
    z AS (SELECT *, coalesce(max(up) OVER {prev(5)}, 0) AS pu, coalesce(max(dn) OVER {prev(5)}, 0) AS pd FROM y)
    SELECT symbol, ts, {r(_IMPULSE, 'impulse_burst_4_14')}, round(CASE WHEN hour(ts) BETWEEN 8 AND 15 THEN lag({_IMPULSE}) OVER ({BY}) ELSE 0 END, 6) + 0.0 AS impulse_london_4_14, {r(div('CASE WHEN up = 1 AND pu = 0 THEN close - t WHEN dn = 1 AND pd = 0 THEN close - l WHEN up IS NOT NULL THEN 0 END', 'atr'), 'breakout_close_5_14')},
    {r(_event('sign(close - open) * (high - low) / nullif(atr, 0)', 'high - low >= 2.0 * atr AND abs(close - open) >= 0.6 * (high - low)'), 'volspike_body_14')} FROM z""")
def event_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = sequences.volspike_body(sequences.breakout_close(sequences.impulse_burst(bars(spark, sf_dir), 4, 14), 5, 14), 14)
    return shown(x, "impulse_burst_4_14", "impulse_london_4_14", "breakout_close_5_14", "volspike_body_14")


@query(f"""WITH {BARS}, x AS (SELECT *, {gated('sum(sign(close - open) * (high - low))', 'close', over(8), 8)} / nullif({gated('sum(high - low)', 'close', over(8), 8)}, 0) AS a, {gated('sum(sign(close - open) * volume)', 'close', over(8), 2)} / nullif({gated('sum(volume)', 'close', over(8), 2)}, 0) AS b FROM bars)
    SELECT symbol, ts, {r(_event('a', 'abs(a) >= 0.5'), 'range_imbalance_8')}, {r(_event('b', 'abs(b) >= 0.5'), 'tick_imbalance_8')} FROM x""")
def imbalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(sequences.imbalance(bars(spark, sf_dir), 8), "range_imbalance_8", "tick_imbalance_8")


_BODIES = f"CASE WHEN count(close) OVER {over(5)} >= 5 THEN sum((close > open)::INT) OVER {over(5)} END AS ups, CASE WHEN count(close) OVER {over(5)} >= 5 THEN sum((close < open)::INT) OVER {over(5)} END AS downs"
_WICK = "CASE WHEN high = low THEN 0 ELSE ({}) / nullif(high - low, 0) END"


@query(f"""WITH RECURSIVE {with_wilder(14)}, x AS (SELECT *, nullif(atr, 0) AS u, (close - {lag('close')}) / nullif(atr, 0) AS j, {gated('max(high)', 'high', prev(14), 14)} AS t, {gated('min(low)', 'low', prev(14), 14)} AS l, (close - {lag('close', 5)}) / nullif(atr, 0) AS mv, {_BODIES}, (high - low) / nullif(atr, 0) AS sp, {_WICK.format('high - greatest(open, close)')} AS uw, {_WICK.format('least(open, close) - low')} AS lw FROM a),
    y AS (SELECT *, CASE WHEN close > t THEN t END AS bt, CASE WHEN close < l THEN l END AS bl, {lag('CASE WHEN abs(j) >= 1.5 THEN j END', 5)} AS ago FROM x),
    z AS (SELECT *, last_value(bt IGNORE NULLS) OVER ({BY} ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS lu, last_value(bl IGNORE NULLS) OVER ({BY} ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS ld FROM y)
    SELECT symbol, ts, {r(_event('-j', 'abs(j) >= 1.5'), 'jump_reversion_14')}, {r(_two_sided('ago > 0 AND ups >= 4', 'mv', 'ago < 0 AND downs >= 4', 'mv', 'mv IS NOT NULL AND j IS NOT NULL'), 'jump_follow_5_14')},
    {r(_two_sided('low <= lu + 0.25 * atr AND close > lu', '(close - lu) / u', 'high >= ld - 0.25 * atr AND close < ld', '(close - ld) / u', 't IS NOT NULL AND u IS NOT NULL'), 'break_retest_6_14')}, {r(_two_sided('close < lu', '(close - lu) / u', 'close > ld', '(close - ld) / u', 't IS NOT NULL AND u IS NOT NULL'), 'failed_break_6_14')},
    {r(_two_sided('sp >= 1.5 AND uw >= 0.6', '-sp', 'sp >= 1.5 AND lw >= 0.6', 'sp', 'sp IS NOT NULL AND uw IS NOT NULL'), 'spike_wick_14')} FROM z""")
def jumps_and_retests(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = sequences.break_retest(sequences.jumps(bars(spark, sf_dir), 14, 5, 1.5), 6, 14)
    return shown(sequences.wick_reversal(x, 14, 1.5), "jump_reversion_14", "jump_follow_5_14", "break_retest_6_14", "failed_break_6_14", "spike_wick_14")


@query(f"""WITH RECURSIVE {with_wilder(40)}, x AS (SELECT *, {gated('max(high)', 'high', over(6), 6)} - {gated('min(low)', 'low', over(6), 6)} AS g, {gated('max(high)', 'high', prev(6), 6)} AS t, {gated('min(low)', 'low', prev(6), 6)} AS l FROM a),
    y AS (SELECT *, list(g) OVER {over(40)} AS g_list FROM x), z AS (SELECT *, {ranked('g', 20)} AS k FROM y), w AS (SELECT *, {lag('k')} AS was FROM z)
    SELECT symbol, ts, {r('k', 'range_pctile_6_40')}, {r(_two_sided('was <= 20 AND close > t', '(close - t) / atr', 'was <= 20 AND close < l', '(close - l) / atr', 'was IS NOT NULL AND nullif(atr, 0) IS NOT NULL'), 'squeeze_breakout_6_40')} FROM w""")
def squeeze_breakout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(sequences.squeeze_breakout(bars(spark, sf_dir), 6, 40), "range_pctile_6_40", "squeeze_breakout_6_40")


@query(f"""WITH {BARS}, g AS (SELECT *, epoch(ts) - epoch({lag('ts')}) AS dt FROM bars), m AS (SELECT symbol, quantile_cont(dt, 0.5) AS med FROM g GROUP BY 1), q AS (SELECT g.*, CASE WHEN dt <= 1.5 * med THEN ln(close / {lag('close')}) END AS r FROM g JOIN m USING (symbol)),
    l AS (SELECT *, {lag('r')} AS rl FROM q), x AS (SELECT *, abs(r) * abs(rl) AS rr, CASE WHEN r IS NOT NULL THEN rl END AS le, CASE WHEN r IS NOT NULL AND rl IS NOT NULL THEN abs(r) END AS ab FROM l),
    y AS (SELECT *, count(r) OVER w AS n, sum(r ** 2) OVER w AS p2, sum(r ** 3) OVER w AS p3, sum(r ** 4) OVER w AS p4, sum(CASE WHEN r > 0 THEN r * r WHEN r IS NOT NULL THEN 0 END) OVER w AS u, sum(CASE WHEN r < 0 THEN r * r WHEN r IS NOT NULL THEN 0 END) OVER w AS d,
        CASE WHEN count(rr) OVER w >= 14 THEN avg(rr) OVER w * pi() / 2 END AS bv, CASE WHEN count(ab) OVER w >= 15 THEN corr(le, ab) OVER w END AS lc FROM x WINDOW w AS {over(20)})
    SELECT symbol, ts, round(CASE WHEN n >= 15 THEN (u - d) / nullif(p2, 0) END, 6) + 0.0 AS rsv_diff_20, round(CASE WHEN n >= 15 THEN sqrt(n) * p3 / nullif(p2 ** 1.5, 0) END, 6) + 0.0 AS rskew_20, round(CASE WHEN n >= 15 THEN n * p4 / nullif(p2 * p2, 0) END, 6) + 0.0 AS rkurt_20,
    round(CASE WHEN n >= 15 AND bv IS NOT NULL THEN greatest(0, (p2 / n - bv) / nullif(p2 / n, 0)) END, 6) + 0.0 AS jump_share_20, round(CASE WHEN n >= 15 THEN sqrt(d / n) END, 6) + 0.0 AS dvol_20, {r('lc', 'levcorr_20')} FROM y""")
def realized_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = sequences.realized_moments(sequences.masked_returns(bars(spark, sf_dir)), 20)
    return shown(x, "rsv_diff_20", "rskew_20", "rkurt_20", "jump_share_20", "dvol_20", "levcorr_20")


_SLOT = "PARTITION BY symbol, hour(ts) ORDER BY ts"


def r4(x: str, name: str) -> str:
    return f"round(({x})::DOUBLE, 4) + 0.0 AS {name}"


_MASKED = f"""{BARS}, g AS (SELECT *, epoch(ts) - epoch({lag('ts')}) AS dt FROM bars), med AS (SELECT symbol, quantile_cont(dt, 0.5) AS med FROM g GROUP BY 1),
    q AS (SELECT g.*, CASE WHEN dt <= 1.5 * med THEN ln(close / {lag('close')}) END AS r FROM g JOIN med USING (symbol))"""


def _slotted(x: str) -> str:
    return div(f"{x} - {gated(f'avg({x})', x, prev(12, _SLOT), 10)}", gated(f"stddev_samp({x})", x, prev(12, _SLOT), 10))


def _before(x: str, n: int) -> str:
    return div(f"{x} - {gated(f'avg({x})', x, prev(n), n // 2)}", gated(f"stddev_samp({x})", x, prev(n), n // 2))


def _sum(x: str, n: int) -> str:
    return gated(f"sum({x})", x, over(n), volume.least(n))


def _avg(x: str, n: int) -> str:
    return gated(f"avg({x})", x, over(n), volume.least(n))


def _some(cond: str, x: str) -> str:
    return f"CASE WHEN {cond} THEN {x} END"


_MEMBERS = ["vz_12", "vz_ma_6_12", "vimb_10", "vimb_chg_10_3", "vimb_z_10_20", "vconf_6_12", "vpdiv_10", "vwret_10_20", "vrange_imb_10", "amihud_z_10_20", "amihud_chg_10_3", "sz_12", "sz_ma_6_12", "sexp_3_20", "spread_ratio_6_40", "sconf_6_12", "roll_z_10_20", "break_vol_6_12", "jump_vol_10_12"]


@query(f"""WITH {_MASKED}, x AS (SELECT *, {_some('volume > 0', 'volume')} AS v, {_some('close > low', '2 * (close - low) / 0.01')} AS s, CASE WHEN r IS NOT NULL THEN close - {lag('close')} END AS d FROM q),
    y AS (SELECT *, ln(v) AS lv, ln(s) AS ls, r IS NOT NULL AND v IS NOT NULL AS ok, CASE WHEN d IS NOT NULL THEN {lag('d')} END AS d1, {gated('stddev_samp(r)', 'r', over(20), 15)} AS sd, {gated('stddev_samp(r)', 'r', over(10), 8)} AS sd10,
        {gated('min(low)', 'low', over(10), 8)} AS lo, {gated('max(high)', 'high', over(10), 8)} AS hi, {gated('max(high)', 'high', prev(6), 6)} AS bh, {gated('min(low)', 'low', prev(6), 6)} AS bl FROM x),
    z AS (SELECT *, {_slotted('lv')} AS vz, {_slotted('ls')} AS sz, CASE WHEN ok THEN v END AS vv, CASE WHEN ok THEN sign(r) * v END AS sv, CASE WHEN ok THEN v * r END AS vr, CASE WHEN ok THEN r END AS rv, CASE WHEN ok THEN abs(r) / v END AS il,
        CASE WHEN d1 IS NOT NULL THEN d END AS d0, {lag('sd')} AS sd1, {lag('sd10')} AS sj, (close - lo) / nullif(hi - lo, 0) AS place FROM y),
    k AS (SELECT *, {_avg('vz', 6)} AS vzm, {_avg('sz', 6)} AS szm, {gated('avg(vz)', 'vz', over(4), 3)} AS bz, {div(_sum('sv', 10), _sum('vv', 10))} AS vimb, {_avg('il', 10)} AS am, {div(_sum('r', 6), 'sd1 * sqrt(6)')} AS mv,
        CASE WHEN count(d0) OVER {over(10)} >= 8 THEN avg(d0 * d1) OVER {over(10)} - avg(d0) OVER {over(10)} * avg(d1) OVER {over(10)} END AS cov,
        CASE WHEN place IS NOT NULL AND v IS NOT NULL THEN v END AS pv, CASE WHEN place IS NOT NULL AND v IS NOT NULL THEN v * CASE WHEN place >= 0.75 THEN 1.0 WHEN place <= 0.25 THEN -1.0 ELSE 0.0 END END AS ps FROM z),
    f AS (SELECT *, CASE WHEN am > 0 THEN ln(am) END AS la, 2 * sqrt(greatest(-cov, 0)) / 0.01 AS roll FROM k)
    SELECT symbol, ts, {r4('vz', 'vz_12')}, {r4('vzm', 'vz_ma_6_12')}, {r4('vimb', 'vimb_10')}, {r4(f"vimb - {lag('vimb', 3)}", 'vimb_chg_10_3')}, {r4(_before('vimb', 20), 'vimb_z_10_20')}, {r4('mv * vzm', 'vconf_6_12')}, {r4(f"vimb - {div(_sum('r', 10), _sum('abs(r)', 10))}", 'vpdiv_10')},
    {r4(div(f"{div(_sum('vr', 10), _sum('vv', 10))} - {_avg('rv', 10)}", 'sd1'), 'vwret_10_20')}, {r4(div(_sum('ps', 10), _sum('pv', 10)), 'vrange_imb_10')}, {r4(_before('la', 20), 'amihud_z_10_20')}, {r4(f"la - {lag('la', 3)}", 'amihud_chg_10_3')}, {r4('sz', 'sz_12')}, {r4('szm', 'sz_ma_6_12')},
    {r4(f"{div(_avg('s', 3), _avg('s', 20))} - 1", 'sexp_3_20')}, {r4(f"{div(_avg('s', 6), _avg('s', 40))} - 1", 'spread_ratio_6_40')}, {r4('mv * szm', 'sconf_6_12')}, {r4(_before('roll', 20), 'roll_z_10_20')},
    {r4('CASE WHEN bh IS NOT NULL AND bl IS NOT NULL AND bz IS NOT NULL THEN CASE WHEN close > bh THEN bz WHEN close < bl THEN -bz ELSE 0 END END', 'break_vol_6_12')}, {r4('CASE WHEN r IS NOT NULL AND sj > 0 AND vz IS NOT NULL THEN CASE WHEN abs(r) > 2 * sj THEN sign(r) * vz ELSE 0 END END', 'jump_vol_10_12')} FROM f""")
def volume_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All volume and spread members of hourly bars; the low stands for the mid, so that most spreads are known."""
    return rounded(volume.volume_members(bars(spark, sf_dir).withColumn("mid", F.col("low")), _MEMBERS, 0.01, 20).select("symbol", "ts", *_MEMBERS), 4)


@query(f"""WITH {BARS}, x AS (SELECT *, row_number() OVER ({BY}) AS pos, {lead('close', 2)} - close AS mv FROM bars)
    SELECT symbol, ts, round(CASE WHEN lag(pos) OVER ({_SLOT}) + 2 <= pos THEN {div(gated('avg(mv)', 'mv', prev(15, _SLOT), 5), gated('stddev_samp(mv)', 'mv', prev(15, _SLOT), 5))} END, 6) + 0.0 AS hour_seasonal FROM x""")
def slot_seasonal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(sequences.slot_seasonal(bars(spark, sf_dir), 2, 15, F.hour("ts"), "hour_seasonal", 5), "hour_seasonal")


@query(f"""WITH RECURSIVE {with_wilder(14)}, d AS (SELECT symbol, ts::DATE AS d, max(high) FILTER (hour(ts) < 7) AS hi, min(low) FILTER (hour(ts) < 7) AS lo, arg_min(open, ts) FILTER (hour(ts) < 7) AS ao, arg_max(close, ts) FILTER (hour(ts) < 7) AS ac, arg_min(open, ts) FILTER (hour(ts) = 8) AS fo, arg_max(close, ts) FILTER (hour(ts) = 8) AS fc, arg_min(close, ts) AS dc, arg_max(close, ts) AS lc FROM bars GROUP BY 1, 2),
    p AS (SELECT *, lag(lc) OVER (PARTITION BY symbol ORDER BY d) AS prev FROM d), q AS (SELECT *, ts::DATE AS d, {lag('close')} AS c, nullif({lag('atr')}, 0) AS u FROM a),
    x AS (SELECT q.symbol, ts, hour(ts) AS h, c, u, CASE WHEN hour(ts) >= 7 THEN hi END AS hi, CASE WHEN hour(ts) >= 7 THEN lo END AS lo, ao, ac, fo, fc, dc, prev, c - prev AS dr, row_number() OVER (PARTITION BY q.symbol, q.d ORDER BY ts) AS n,
        max(high) OVER (PARTITION BY q.symbol, q.d ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS t, min(low) OVER (PARTITION BY q.symbol, q.d ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l FROM q JOIN p ON p.symbol = q.symbol AND p.d = q.d)
    SELECT symbol, ts, {r(div('c - (hi + lo) / 2', '(hi - lo) / 2'), 'asia_pos')}, {r(_two_sided('c > hi', '(c - hi) / u', 'c < lo', '(c - lo) / u', 'c IS NOT NULL AND hi IS NOT NULL AND u IS NOT NULL'), 'asia_break_14')}, {r('CASE WHEN h >= 7 THEN (ac - ao) / u END', 'asia_ret_14')}, {r('CASE WHEN h >= 9 THEN (fc - fo) / u END', 'london_first_hour_14')},
    {r('CASE WHEN n > 1 THEN (dc - prev) / u END', 'overnight_gap_14')}, {r(div('dr - ' + gated('avg(dr)', 'dr', prev(22, 'PARTITION BY symbol, h ORDER BY ts'), 20), gated('stddev_samp(dr)', 'dr', prev(22, 'PARTITION BY symbol, h ORDER BY ts'), 20)), 'day_ret_z_22')}, {r('2 * ' + div('c - l', 't - l') + ' - 1', 'day_range_pos')} FROM x""")
def session_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In January, when London is at UTC."""
    return shown(sequences.session_anchors(bars(spark, sf_dir), 14, 22), "asia_pos", "asia_break_14", "asia_ret_14", "london_first_hour_14", "overnight_gap_14", "day_ret_z_22", "day_range_pos")


# panels -------------------------------------------------------------------------------------------------------------

_PANEL = """panel AS (SELECT r_name AS symbol, l_shipdate::DATE AS date, sum(l_extendedprice * (1 - l_discount)) AS value FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2)"""
_RET = f"{_PANEL}, ret AS (SELECT symbol, date, ln(value / nullif(lag(value) OVER w, 0)) AS ret, date - lag(date) OVER w AS gap FROM panel WINDOW w AS (PARTITION BY symbol ORDER BY date))"


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, date, value): discounted sales by region of the supplier and day of shipment."""
    li, s, n, rg = (read(spark, sf_dir, t) for t in ("lineitem", "supplier", "nation", "region"))
    named = s.join(n, s["s_nationkey"] == n["n_nationkey"]).join(rg, n["n_regionkey"] == rg["r_regionkey"]).select("s_suppkey", "r_name")
    x = li.select("l_suppkey", "l_shipdate", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v")).join(named, F.col("l_suppkey") == F.col("s_suppkey"))
    return x.groupBy(F.col("r_name").alias("symbol"), F.to_date("l_shipdate").alias("date")).agg(F.sum("v").alias("value"))


@query(f"""WITH {_RET}, x AS (SELECT *, count(*) OVER (PARTITION BY date) AS n, rank() OVER (PARTITION BY date ORDER BY value) AS k, count(*) OVER (PARTITION BY date, value) AS t FROM panel)
    SELECT symbol, date::TIMESTAMP AS date, {r('(k + (t - 1) / 2.0) / n', 'xs_rank')}, {r('(value - avg(value) OVER (PARTITION BY date)) / nullif(stddev_pop(value) OVER (PARTITION BY date), 0)', 'xs_z')}, round(CASE WHEN n > 1 THEN (k - 1) / (n - 1.0) END, 6) + 0.0 AS breadth FROM x""")
def cross_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(crosssection.cross_rank(panel(spark, sf_dir), "value").select("symbol", F.col("date").cast("timestamp_ntz").alias("date"), "xs_rank", "xs_z", "breadth"))


@query(f"""WITH {_RET} SELECT symbol, date::TIMESTAMP AS date, round(ret, 6) + 0.0 AS ret FROM ret WHERE gap IS NULL OR gap <= 14""")
def panel_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(crosssection.log_returns(panel(spark, sf_dir), "value").select("symbol", F.col("date").cast("timestamp_ntz").alias("date"), "ret"))


@query(f"""WITH {_PANEL}, d AS (SELECT date, stddev_pop(value) AS dispersion FROM panel GROUP BY 1), s AS (SELECT *, round(CASE WHEN count(dispersion) OVER w >= 10 THEN avg(dispersion) OVER w END, 6) AS smoothed FROM d WINDOW w AS (ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
    p AS (SELECT *, list_filter(coalesce(list(smoothed) OVER (ORDER BY date ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING), []), lambda v: v IS NOT NULL) AS l FROM s) SELECT date::TIMESTAMP AS date, round(dispersion, 6) + 0.0 AS dispersion, round(smoothed, 1) + 0.0 AS smoothed, round(CASE WHEN smoothed IS NOT NULL AND len(l) >= 50 THEN len(list_filter(l, lambda v: v <= smoothed)) / len(l) END, 3) + 0.0 AS dispersion_pct FROM p""")
def dispersion(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = crosssection.dispersion(panel(spark, sf_dir), "value", n=100, n_least=50)
    return x.select(F.col("date").cast("timestamp_ntz").alias("date"), *(F.round(k, d).alias(k) for k, d in (("dispersion", 6), ("smoothed", 1), ("dispersion_pct", 3))))


#: regions as instruments between four made-up units
LINKS = [("AFRICA", "A", "B"), ("AMERICA", "B", "C"), ("ASIA", "C", "D"), ("EUROPE", "A", "C"), ("MIDDLE EAST", "B", "D")]


@query(f"""WITH {_RET}, w(symbol, unit, weight) AS (VALUES {', '.join(f"('{s}', '{u}', {x!r}::DOUBLE)" for s, u, x in crosssection.strength_weights(LINKS))}), x AS (SELECT date, unit, sum(ret * weight) AS strength, count(*) AS n FROM ret JOIN w USING (symbol) WHERE ret IS NOT NULL AND (gap IS NULL OR gap <= 14) GROUP BY 1, 2)
    SELECT date::TIMESTAMP AS date, unit, round(strength, 6) + 0.0 AS strength FROM x WHERE n = 5""")
def strengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(crosssection.strengths(crosssection.log_returns(panel(spark, sf_dir), "value"), LINKS)).withColumn("date", F.col("date").cast("timestamp_ntz"))


@query(f"""WITH {DAILY}, x AS (SELECT a.ts, a.close AS y, b.close AS x FROM days a JOIN days b ON a.ts = b.ts WHERE a.symbol = '1-URGENT' AND b.symbol = '5-LOW'), l AS (SELECT *, lag(x) OVER (ORDER BY ts) AS lx FROM x),
    c AS (SELECT *, count(x) OVER w AS n, count(lx) OVER w AS m, corr(x, y) OVER w AS c, covar_samp(x, y) OVER w / nullif(var_samp(x) OVER w, 0) AS b, covar_samp(lx, CASE WHEN lx IS NOT NULL THEN y END) OVER w / nullif(var_samp(lx) OVER w, 0) AS lb FROM l WINDOW w AS (ORDER BY ts ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))
    SELECT ts, round(CASE WHEN n >= 60 THEN c END, 5) + 0.0 AS corr_60, round(CASE WHEN n >= 60 THEN b END, 5) + 0.0 AS beta_60, round(lag(CASE WHEN m >= 60 THEN lb END) OVER (ORDER BY ts) * x, 2) + 0.0 AS lead_60 FROM c""")
def rolling_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = src.order_bars(spark, sf_dir)
    a, b = (d.where(F.col("symbol") == s).select("ts", F.col("close").alias(n)) for s, n in (("1-URGENT", "y"), ("5-LOW", "x")))
    x = crosssection.rolling_relation(a.join(b, "ts").withColumn("k", F.lit(1)), "y", "x", 60, ["k"])
    return x.select("ts", *(F.round(c, d) + F.lit(0.0) for c, d in (("corr_60", 5), ("beta_60", 5), ("lead_60", 2)))).toDF("ts", "corr_60", "beta_60", "lead_60")

