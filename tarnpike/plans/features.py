"""Queries on the further feature families."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnpike.functions.safe import rounded
from tarnpike.operators import families, indicators, pairs, sequences, volume
from tarnpike.plans.market import _MASKED, _PANEL, bars, panel, read
from tarnpike.plans.sql import BARS, BY, DAILY, div, gated, lag, mean, over, prev, ranked, with_atr, with_wilder
from tarnpike.sources import bars as src

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def shown(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return rounded(df.select("symbol", "ts", *cols), digits)


def ev(score: str, cond: str) -> str:
    return f"CASE WHEN ({score}) IS NULL OR ({cond}) IS NULL THEN NULL WHEN {cond} THEN {score} ELSE 0 END"


def r5(x: str, name: str) -> str:
    return f"round(({x})::DOUBLE, 5) + 0.0 AS {name}"


def r7(x: str, name: str) -> str:
    return f"round(({x})::DOUBLE, 7) + 0.0 AS {name}"


@query(f"""WITH RECURSIVE {with_wilder(3, 14, 20)}, x AS (SELECT *, {mean('close', 8)} AS f, {mean('close', 20)} AS s FROM a)
    SELECT symbol, ts, {r5('100 * (' + div('close', 's') + ' - 1)', 'price_vs_sma_20')}, {r5('abs(100 * (' + div('close', 's') + ' - 1))', 'abs_price_vs_sma_20')}, {r5(div('close - s', 'atr_20'), 'signed_price_vs_sma_20')}, {r5(div('f - s', 'atr_20'), 'sma_8_over_sma_20')}, {r5(div(f"s - {lag('s', 5)}", 'atr_20'), 'sma_slope_20')}, {r5(div(f"ln(close / {lag('close', 5)}) * close", 'atr_14'), 'log_return_atr_5')},
    {r5(div('high - low', 'atr_14'), 'hl_range_atr')}, {r5(div('close - open', 'atr_14'), 'oc_range_atr')}, {r5(div(f"close - {lag('close', 3)}", 'atr_3'), 'return_3_atr')}, {r5(gated('avg((close > open)::INT)', 'close', over(5), 5), 'momentum_consistency_5')} FROM x""")
def average_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = families.average_features(bars(spark, sf_dir), 8, 20)
    return shown(x, "price_vs_sma_20", "abs_price_vs_sma_20", "signed_price_vs_sma_20", "sma_8_over_sma_20", "sma_slope_20", "log_return_atr_5", "hl_range_atr", "oc_range_atr", "return_3_atr", "momentum_consistency_5", digits=5)


@query(f"""WITH {BARS}, x AS (SELECT *, coalesce(close > {mean('close', 24)}, false)::INT AS side, row_number() OVER ({BY}) AS rn FROM bars), y AS (SELECT *, CASE WHEN side IS NOT DISTINCT FROM {lag('side')} THEN 0 ELSE 1 END AS n FROM x), z AS (SELECT *, sum(n) OVER ({BY} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g, CASE WHEN count(close) OVER {over(12)} >= 12 AND var_pop(close) OVER {over(12)} > 0 THEN corr(close, rn) OVER {over(12)} END AS c FROM y)
    SELECT symbol, ts, (row_number() OVER (PARTITION BY symbol, g ORDER BY ts) - 1)::INT AS bars_since_flip, {r5('c * c * sign(c)', 'slope_efficiency')} FROM z""")
def bars_since_flip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(families.bars_since_flip(bars(spark, sf_dir), 24), "bars_since_flip", "slope_efficiency", digits=5)


_BODIES = f"CASE WHEN count(close - open) OVER {over(4)} >= 4 THEN sum((close > open)::INT) OVER {over(4)} END AS ups, CASE WHEN count(close - open) OVER {over(4)} >= 4 THEN sum((close < open)::INT) OVER {over(4)} END AS downs"


@query(f"""WITH RECURSIVE {with_wilder(6, 24)}, x AS (SELECT *, high - {lag('high')} AS dh, {lag('low')} - low AS dl, {_BODIES}, {gated('sum(close - open)', 'close', over(4), 4)} / nullif(atr_24, 0) AS burst, atr_6 / nullif(atr_24, 0) - 1 AS ra, {gated('regr_slope(close, rn)', 'close', over(24), 24)} AS slope FROM a),
    y AS (SELECT *, list(dh) OVER {over(24)} AS dh_list, list(dl) OVER {over(24)} AS dl_list FROM x), z AS (SELECT *, {ranked('dh', 12)} AS hr, {ranked('dl', 12)} AS lr FROM y)
    SELECT symbol, ts, round(CASE WHEN hr IS NULL OR lr IS NULL OR nullif(atr_24, 0) IS NULL THEN NULL WHEN lr >= 80 AND close < open THEN -dl / atr_24 WHEN hr >= 80 AND close > open THEN dh / atr_24 ELSE 0 END, 5) + 0.0 AS hh_thrust_24,
    {r5(ev('burst', '(ups >= 3 OR downs >= 3) AND abs(burst) >= 1'), 'micro_burst_4_24')}, {r5('ra', 'atr_ratio_6_24')}, {r5(ev('ra * sign(slope)', 'ra >= 0.25'), 'volshift_bias_6_24')} FROM z""")
def burst_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = sequences.volatility_shift(sequences.bursts(sequences.thrusts(bars(spark, sf_dir), 24), 4, 24), 6, 24)
    return shown(x, "hh_thrust_24", "micro_burst_4_24", "atr_ratio_6_24", "volshift_bias_6_24", digits=5)


@query(f"""WITH RECURSIVE {with_wilder(14)}, d AS (SELECT ts::DATE AS day, count_if(value > 300) AS n FROM events GROUP BY 1), s AS (SELECT *, 2 * (close - mid) AS sp, {gated('max(high)', 'high', over(6), 6)} - {gated('min(low)', 'low', over(6), 6)} AS g FROM a),
    x AS (SELECT *, {div('sp - ' + mean('sp', 40), gated('stddev_samp(sp)', 'sp', over(40), 40))} AS z, list(g) OVER {over(40)} AS g_list FROM s), y AS (SELECT *, {ranked('g', 20)} AS k FROM x)
    SELECT y.symbol, y.ts, {r5(ev('sign(close - open) * z', 'k <= 20 AND z >= 1'), 'compression_spread_6_40')}, {r5(ev('sign(close - open) * (high - low) / nullif(atr, 0)', 'n >= 8'), 'news_impulse_14')} FROM y JOIN d ON d.day = y.ts::DATE""")
def spread_and_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = read(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count_if(F.col("value") > 300).alias("events"))
    x = sequences.news_impulse(sequences.compression_spread(bars(spark, sf_dir), 6, 40), counts, 14, 8)
    return shown(x, "compression_spread_6_40", "news_impulse_14", digits=5)


@query(f"""WITH {_MASKED}, x AS (SELECT *, CASE WHEN high = low THEN 0 ELSE ((least(open, close) - low) - (high - greatest(open, close))) / (high - low) END AS w, {gated('stddev_samp(r)', 'r', over(20), 15)} AS s FROM q), z AS (SELECT *, {lag('s')} AS p FROM x), j AS (SELECT *, CASE WHEN r IS NOT NULL AND p > 0 THEN CASE WHEN r > 1.5 * p THEN 1.0 WHEN r < -1.5 * p THEN -1.0 ELSE 0 END END AS j FROM z)
    SELECT symbol, ts, {r5(gated('avg(j)', 'j', over(20), 15), 'jump_asym_20')}, {r5(gated('avg(w)', 'w', over(20), 15), 'wick_asym_20')} FROM j""")
def jump_asymmetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(families.jump_asymmetry(sequences.masked_returns(bars(spark, sf_dir)), 20, 1.5), "jump_asym_20", "wick_asym_20", digits=5)


@query(f"""WITH {_MASKED}, k AS (SELECT *, count(r) OVER {over(10)} AS n1, sum(r ** 2) OVER {over(10)} AS a1, sum(r ** 3) OVER {over(10)} AS b1, count(r) OVER {over(30)} AS n2, sum(r ** 2) OVER {over(30)} AS a2, sum(r ** 3) OVER {over(30)} AS b2 FROM q)
    SELECT symbol, ts, {r5('CASE WHEN n1 >= 8 THEN sqrt(n1) * b1 / nullif(a1 ** 1.5, 0) END - CASE WHEN n2 >= 22 THEN sqrt(n2) * b2 / nullif(a2 ** 1.5, 0) END', 'rskew_ts_10_30')} FROM k""")
def skew_term_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = sequences.realized_moments(sequences.realized_moments(sequences.masked_returns(bars(spark, sf_dir)), 10), 30)
    return shown(families.term_structure(x, "rskew", 10, 30), "rskew_ts_10_30", digits=5)


@query(f"""WITH {with_atr(14)}, e AS (SELECT * REPLACE (round(atr, 9) AS atr) FROM a), k AS (SELECT *, list(atr) OVER {over(30)} AS atr_list FROM e) SELECT symbol, ts, {r5(f"atr - {lag('atr', 3)}", 'atr_mean_14_chg_3')}, {r5(div('atr - ' + gated('avg(atr)', 'atr', prev(30), 15), gated('stddev_samp(atr)', 'atr', prev(30), 15)), 'atr_mean_14_z_30')},
    {r5(ranked('atr', 15), 'atr_mean_14_pct_30')} FROM k""")
def moment_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = indicators.atr_mean(bars(spark, sf_dir), 14).withColumn("atr_mean_14", F.round("atr_mean_14", 9))
    return shown(families.moment_changes(x, "atr_mean_14", 3, 30), "atr_mean_14_chg_3", "atr_mean_14_z_30", "atr_mean_14_pct_30", digits=5)


_TURN = """(SELECT day, CASE WHEN isodow(day) > 5 THEN 0 WHEN down <= {n} THEN -down WHEN up <= {n} THEN up ELSE 0 END::INT AS tom_pos FROM (SELECT day, sum((isodow(day) <= 5)::INT) OVER (PARTITION BY date_trunc('month', day) ORDER BY day) AS up,
    sum((isodow(day) <= 5)::INT) OVER (PARTITION BY date_trunc('month', day) ORDER BY day DESC) AS down FROM (SELECT unnest(range({a}, {b}, INTERVAL 1 DAY)) AS day)))"""


@query(f"""WITH RECURSIVE {with_wilder(3)}, span AS (SELECT date_trunc('month', min(ts)) AS first, date_trunc('month', max(ts)) + INTERVAL 1 MONTH AS last FROM bars), turn AS {_TURN.format(n=2, a='(SELECT first FROM span)', b='(SELECT last FROM span)')},
    m AS (SELECT *, (close - {lag('close', 3)}) / nullif(atr, 0) AS mv FROM a), x AS (SELECT m.*, lag(mv) OVER ({BY}) AS m1, hour(ts) AS ln, hour(ts - INTERVAL 5 HOURS) AS ny, tom_pos FROM m JOIN turn ON turn.day = date_trunc('day', ts))
    SELECT symbol, ts, tom_pos, {r5('1 / (1 + (16.0 - ln + 24) % 24)', 'fix_proximity')}, {r5('CASE WHEN isodow(ts) < 6 THEN (isodow(ts) - 1 + hour(ts) / 24.0) / 5 END', 'week_pos')}, {r5(ev('m1', 'ln = 15'), 'fix_momo_3')}, {r5(ev('m1', 'ln IN (14, 15) AND tom_pos < 0'), 'fix_tom_momo_3')},
    {r5(ev('m1', 'ny = 8'), 'ny_open_momo_3')}, {r5(ev('m1', 'isodow(ts) = 5 AND ln >= 16'), 'friday_unwind_3')}, {r5(ev('m1', 'isodow(ts) = 5 AND day(ts) <= 7'), 'first_friday_momo_3')} FROM x""")
def clock_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In January, when London is at UTC and New York five hours behind."""
    return shown(families.clock_features(bars(spark, sf_dir), 3), "tom_pos", "fix_proximity", "week_pos", "fix_momo_3", "fix_tom_momo_3", "ny_open_momo_3", "friday_unwind_3", "first_friday_momo_3", digits=5)


@query(f"""WITH s AS (SELECT date_trunc('month', min(o_orderdate)) AS first, date_trunc('month', max(o_orderdate)) + INTERVAL 1 MONTH AS last FROM orders), turn AS {_TURN.format(n=3, a='(SELECT first FROM s)', b='(SELECT last FROM s)')}
    SELECT day::TIMESTAMP AS day, tom_pos, n FROM turn JOIN (SELECT date_trunc('day', o_orderdate) AS day, count(*) AS n FROM orders GROUP BY 1) USING (day)""")
def turn_of_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of each day and its place in the turn of the month."""
    days = read(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"))
    return families.turn_of_month(days, 3).withColumn("day", F.col("day").cast("timestamp_ntz"))


@query(f"""WITH {BARS}, d AS (SELECT symbol, ts::DATE AS d, sum(CASE WHEN hour(ts) BETWEEN 8 AND 16 THEN volume END) / nullif(sum(volume), 0) AS s, sum(CASE WHEN hour(ts) < 7 THEN volume END) / nullif(sum(volume), 0) AS t FROM bars GROUP BY 1, 2),
    w AS (SELECT symbol, d, lag(s) OVER (PARTITION BY symbol ORDER BY d) - CASE WHEN count(s) OVER q >= 5 THEN avg(s) OVER q END AS x, lag(t) OVER (PARTITION BY symbol ORDER BY d) - CASE WHEN count(t) OVER q >= 5 THEN avg(t) OVER q END AS y FROM d WINDOW q AS (PARTITION BY symbol ORDER BY d ROWS BETWEEN 9 PRECEDING AND 2 PRECEDING))
    SELECT b.symbol, b.ts, round(x, 8) + 0.0 AS vshare_ldn_8, round(y, 8) + 0.0 AS vshare_asia_8 FROM bars b JOIN w ON w.symbol = b.symbol AND w.d = b.ts::DATE""")
def day_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In January, when London is at UTC."""
    return shown(volume.day_shares(bars(spark, sf_dir), 8), "vshare_ldn_8", "vshare_asia_8", digits=8)


@query(f"""WITH {DAILY}, t AS (SELECT DISTINCT ts FROM days WHERE symbol = '5-LOW'), s(symbol, g) AS (VALUES ('1-URGENT', 1.0), ('2-HIGH', -1.0), ('3-MEDIUM', 1.0)), x AS (SELECT s.symbol, t.ts, g, close FROM t CROSS JOIN s LEFT JOIN days d ON d.symbol = s.symbol AND d.ts = t.ts),
    m AS (SELECT *, g * (ln(close) - {lag('ln(close)', 4)}) AS m FROM x), z AS (SELECT *, {div('m - ' + gated('avg(m)', 'm', prev(40), 20), gated('stddev_samp(m)', 'm', prev(40), 20))} AS z FROM m)
    SELECT ts, round(CASE WHEN count(m) = 3 THEN avg(sign(m)) END, 5) + 0.0 AS breadth, round(CASE WHEN count(z) = 3 THEN avg(z) END, 5) + 0.0 AS strength, round(CASE WHEN count(z) = 3 THEN stddev_pop(z) END, 5) + 0.0 AS dispersion FROM z GROUP BY 1""")
def group_pressure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pairs.group_scores(src.order_bars(spark, sf_dir), "5-LOW", {"1-URGENT": 1.0, "2-HIGH": -1.0, "3-MEDIUM": 1.0}, 4, 40), 5)


@query(f"""WITH {_PANEL}, days AS (SELECT symbol, date::TIMESTAMP AS ts, value AS close FROM panel), t AS (SELECT ts FROM days WHERE symbol = 'EUROPE'), s(symbol) AS (VALUES ('ASIA'), ('AFRICA')), x0 AS (SELECT s.symbol, t.ts, close FROM t CROSS JOIN s LEFT JOIN days d ON d.symbol = s.symbol AND d.ts = t.ts UNION ALL SELECT symbol, ts, close FROM days WHERE symbol = 'EUROPE'),
    g AS (SELECT *, epoch(ts) - epoch({lag('ts')}) AS dt FROM x0), med AS (SELECT symbol, quantile_cont(dt, 0.5) AS med FROM g GROUP BY 1), q AS (SELECT g.symbol, g.ts, close, CASE WHEN dt <= 1.5 * med THEN ln(close / {lag('close')}) END AS r FROM g JOIN med USING (symbol)),
    p AS (SELECT q.*, b.r AS y, {lag('q.r', 1, 'PARTITION BY q.symbol ORDER BY q.ts')} AS l, {lag('ln(q.close)', 20, 'PARTITION BY q.symbol ORDER BY q.ts')} AS c0 FROM q JOIN q b ON b.ts = q.ts AND b.symbol = 'EUROPE' WHERE q.symbol <> 'EUROPE'),
    e AS (SELECT *, CASE WHEN l IS NOT NULL AND y IS NOT NULL THEN y END AS ly, CASE WHEN l IS NOT NULL AND y IS NOT NULL THEN l END AS lx, CASE WHEN r IS NOT NULL AND y IS NOT NULL THEN r END AS br, CASE WHEN r IS NOT NULL AND y IS NOT NULL THEN y END AS b_y, ln(close) - c0 AS m FROM p),
    f AS (SELECT *, {div(gated('covar_samp(ly, lx)', 'lx', over(20), 15), gated('var_samp(l)', 'l', over(20), 15))} AS beta, {gated('stddev_samp(y)', 'y', over(20), 15)} AS sd, {gated('corr(b_y, br)', 'br', over(20), 15)} AS c, CASE WHEN {gated('sum(r * r)', 'r', over(20), 15)} > 0 THEN ln(sqrt({gated('sum(r * r)', 'r', over(20), 15)})) END AS rv FROM e),
    h AS (SELECT *, list(round(c, 9)) OVER {over(40)} AS c_list, round(c, 9) AS c9 FROM f)
    SELECT symbol, ts, {r5(div(f"{lag('beta')} * r", lag('sd')), 'llpred')}, {r5(ranked('c', 20).replace('q < c)', 'q < c9)').replace('q = c)', 'q = c9)'), 'corrbk')}, {r5(div('rv - ' + gated('avg(rv)', 'rv', prev(40), 20), gated('stddev_samp(rv)', 'rv', prev(40), 20)), 'rvz')}, {r5(div('m - ' + gated('avg(m)', 'm', prev(40), 20), gated('stddev_samp(m)', 'm', prev(40), 20)), 'risk_z')} FROM h""")
def pair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily sales of two regions against a third's."""
    x = panel(spark, sf_dir).select("symbol", F.col("date").cast("timestamp_ntz").alias("ts"), F.col("value").alias("close"))
    return shown(pairs.pair_scores(x, "EUROPE", ["ASIA", "AFRICA"], 20, 40), "llpred", "corrbk", "rvz", "risk_z", digits=5)


_SLOT = "PARTITION BY symbol, hour(ts) ORDER BY ts"


def _tr_mean(n: int) -> str:
    return gated("avg(tr)", "tr", over(n), max(2, round(n * 0.75)))


def _span(n: int) -> str:
    return f"{gated('max(high)', 'high', over(n), max(2, round(n * 0.75)))} - {gated('min(low)', 'low', over(n), max(2, round(n * 0.75)))}"


def _slot_z(x: str) -> str:
    return div(f"{x} - {gated(f'avg({x})', x, prev(20, _SLOT), 10)}", gated(f"stddev_samp({x})", x, prev(20, _SLOT), 10))


_TIMING = f"""{BARS}, t AS (SELECT *, greatest(high, {lag('close')}) - least(low, {lag('close')}) AS tr, CASE WHEN 2 * (close - low) / 0.01 > 0 THEN 2 * (close - low) / 0.01 END AS s FROM bars),
    x AS (SELECT *, {div(_tr_mean(4), _tr_mean(16))} AS vr, {_span(4)} AS rf, nullif({_span(16)}, 0) AS rs, nullif({_tr_mean(12)}, 0) AS ak, {gated('max(high)', 'high', prev(12), 9)} AS t12, {gated('min(low)', 'low', prev(12), 9)} AS l12, ln(s) AS ls, ln(volume) AS lv, {gated('quantile_cont(s, 0.5)', 's', prev(20, _SLOT), 10)} AS med, coalesce({gated('quantile_cont(s, 0.5)', 's', over(80), 31)}, 0.4) AS spr FROM t),
    y AS (SELECT *, ln(vr) AS lx, ln(s / med) AS sn, {_slot_z('lv')} - {_slot_z('ls')} AS li FROM x),
    z AS (SELECT *, {gated('quantile_cont(lx, 0.5)', 'lx', prev(48), 36)} AS m, {gated('quantile_cont(lx, 0.75)', 'lx', prev(48), 36)} - {gated('quantile_cont(lx, 0.25)', 'lx', prev(48), 36)} AS q, round(vr, 9) AS vq, round(sn, 9) AS sq, round(li, 9) AS lq, list(round(vr, 9)) OVER {over(80)} AS vq_list, list(round(sn, 9)) OVER {over(80)} AS sq_list, list(round(li, 9)) OVER {over(80)} AS lq_list FROM y),
    k AS (SELECT *, {ranked('vq', 31)} / 100 AS vp, {ranked('sq', 31)} / 100 AS sr, {ranked('lq', 31)} / 100 AS lp FROM z)"""
_DISTANCES = {"sl_pips": ("rs", 15, 60), "tp_pips": ("rs", 15, 150), "trail_pips": ("nullif(rf, 0)", 8, 40)}


@query(f"""WITH {_TIMING} SELECT symbol, ts, {r7('vr', 'vol_ratio')}, {r7(div('lx - m', 'q / 1.349'), 'vol_shift')}, {r7('rf / rs', 'range_ratio')}, {r7('greatest((close - t12) / ak, 0) + least((close - l12) / ak, 0)', 'micro_break_all')},
    {r7('sn', 'spread_norm')}, {r7('sr', 'spread_regime')}, {r7('li', 'liq_impulse_score')}, {r7('lp', 'liq_impulse')}, {r7('0.5 * ((1 - vp) + (1 - sr))', 'queue_good')}, {r7('0.5 * ((1 - vp) + (1 - sr)) * (1 - lp)', 'maker_ok')},
    {', '.join(r7(f'CASE WHEN {x} IS NOT NULL THEN least(greatest(0.5 * {x} / 0.01, {a}), {b}) END', n) for n, (x, a, b) in _DISTANCES.items())}, {r7('spr + 0.4 + 36 / 1e6 * close / 0.01', 'cost_floor_pips')} FROM k""".replace("greatest((close - t12) / ak, 0) + least((close - l12) / ak, 0)", "CASE WHEN t12 IS NOT NULL AND l12 IS NOT NULL AND ak IS NOT NULL THEN greatest((close - t12) / ak, 0) + least((close - l12) / ak, 0) END").replace("micro_break_all", "micro_break"))
def execution_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(_execution(spark, sf_dir), *_EXECUTION, digits=7)


_EXECUTION = ("vol_ratio", "vol_shift", "range_ratio", "micro_break", "spread_norm", "spread_regime", "liq_impulse_score", "liq_impulse", "queue_good", "maker_ok", "sl_pips", "tp_pips", "trail_pips", "cost_floor_pips")


def _execution(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars(spark, sf_dir).withColumn("mid", F.col("low"))  # a spread that is seldom 0
    return sequences.timing(b, 4, 16, 48, 80, 12, 20, 0.01)


@query(f"""WITH {_TIMING} SELECT symbol, ts, {r5('vr', 'vol_ratio')}, {r5(div('lx - m', 'q / 1.349'), 'vol_shift')}, {r5('rf / rs', 'range_ratio')} FROM k""")
def timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(_execution(spark, sf_dir), "vol_ratio", "vol_shift", "range_ratio", digits=5)


@query(f"""WITH {_TIMING}, f AS (SELECT symbol, ts, CASE WHEN rs IS NOT NULL THEN least(greatest(0.5 * rs / 0.01, 15), 60) END AS sl, CASE WHEN rs IS NOT NULL THEN least(greatest(0.5 * rs / 0.01, 15), 150) END AS tp FROM k), l AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS n FROM f)
    SELECT symbol, '{{"ts":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.000') || '","sl_pips":' || sl::VARCHAR || ',"tp_pips":' || tp::VARCHAR || '}}' AS snapshot FROM l WHERE n = 1""")
def execution_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return families.execution_snapshot(_execution(spark, sf_dir), ["sl_pips", "tp_pips"])


@query(f"""WITH {DAILY}, x AS (SELECT a.ts, ln(a.close) + ln(b.close) - ln(c.close) AS r FROM days a JOIN days b ON a.ts = b.ts JOIN days c ON a.ts = c.ts WHERE a.symbol = '1-URGENT' AND b.symbol = '2-HIGH' AND c.symbol = '3-MEDIUM'), y AS (SELECT *, r - lag(r, 5) OVER (ORDER BY ts) AS c FROM x)
    SELECT ts, {r5('r', 'residual')}, {r5(div('r - ' + gated('avg(r)', 'r', prev(40, 'ORDER BY ts'), 20), gated('stddev_samp(r)', 'r', prev(40, 'ORDER BY ts'), 20)), 'residual_z')}, {r5(div('c - ' + gated('avg(c)', 'c', prev(40, 'ORDER BY ts'), 20), gated('stddev_samp(c)', 'c', prev(40, 'ORDER BY ts'), 20)), 'residual_chg_z')} FROM y""")
def triangle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(families.triangle(src.order_bars(spark, sf_dir), {"ab": "1-URGENT", "bc": "2-HIGH", "ac": "3-MEDIUM"}, 40, 5), 5)


@query(f"""WITH {BARS}, x AS (SELECT *, abs(close - {lag('close', 6)}) AS m FROM bars) SELECT symbol, ts, {r5(gated('quantile_cont(m, 0.7)', 'm', over(30), 30), 'target')} FROM x""")
def percentile_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(families.percentile_targets(bars(spark, sf_dir), 6, 30, 0.7), "target", digits=5)


@query(f"""WITH {BARS}, x AS (SELECT symbol, ts, CASE WHEN volume > 2 THEN greatest(abs(close - mid), 5) END AS h FROM bars), m AS (SELECT symbol, quantile_cont(h, 0.5) AS m FROM x GROUP BY 1) SELECT x.symbol, x.ts, {r5('coalesce(h, m, 5)', 'half_spread')} FROM x JOIN m USING (symbol)""")
def half_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars(spark, sf_dir).withColumn("mid", F.when(F.col("volume") > 2, F.col("mid")))
    return shown(families.half_spread(b, 5.0), "half_spread", digits=5)


@query(f"""WITH RECURSIVE {with_wilder(14)}, x AS (SELECT *, sign(coalesce(close - {lag('close')}, 0)) AS s FROM a), y AS (SELECT *, CASE WHEN s = {lag('s')} THEN 0 ELSE 1 END AS n FROM x), z AS (SELECT *, sum(n) OVER ({BY} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM y), k AS (SELECT *, row_number() OVER (PARTITION BY symbol, g ORDER BY ts) * s AS run FROM z)
    SELECT symbol, ts, {r5(ev(f"(close - {lag('close', 3)}) / nullif(atr, 0)", 'abs(run) >= 3'), 'run_momentum_3_14')} FROM k""")
def run_momentum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(sequences.run_momentum(bars(spark, sf_dir), 3, 14), "run_momentum_3_14", digits=5)


@query("SELECT doc_id AS ts, quality AS long_slow, toxic AS short_slow, quality AS long_fast, toxic AS short_fast FROM labels")
def file_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("ts"), F.col("quality").alias("target_long_slow"), F.col("toxic").alias("y_short_slow"))
    return families.file_labels(x, mirror=True)
