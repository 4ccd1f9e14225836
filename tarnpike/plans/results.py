"""Queries on labels, evaluation, simulation and models."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnpike.functions.safe import mean_n, ordered, rounded, sdiv
from tarnpike.operators import align, evaluation, indicators, labels, models, simulation
from tarnpike.plans.market import bars, read
from tarnpike.plans.sql import BARS, BY, DAILY, TRUE, ahead, div, gated, lag, lead, mean, over, prev, r, with_atr
from tarnpike.sources import bars as src
from tarnpike.streaming import bars as streams

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def shown(df: DataFrame, *cols: str) -> DataFrame:
    return rounded(df.select("symbol", "ts", *cols))


def targeted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.regime_targets(indicators.atr_mean(bars(spark, sf_dir), 14), "atr_mean_14", 1.0, 0.5)


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with a made-up score from the length of the text, and its language."""
    d, y = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    return y.join(d.select("doc_id", "lang", "n_chars"), "doc_id").select("doc_id", "lang", F.col("quality").alias("y"), (F.col("n_chars") / (F.col("n_chars") + 1500.0)).alias("p"))


_SCORED = "s AS (SELECT doc_id, lang, quality AS y, n_chars / (n_chars + 1500.0) AS p FROM labels JOIN documents USING (doc_id))"


# labels -------------------------------------------------------------------------------------------------------------


def _race(h: int) -> str:
    first = lambda cond: f"coalesce(list_position(list_transform(w, lambda b: coalesce({cond}, false)), true), 0)"
    return f"""{with_atr(14)}, g AS (SELECT *, 1.0 * atr AS t, 0.5 * atr AS s, coalesce(list({{'h': high, 'l': low, 'ts': ts}}) OVER {ahead(h)}, []) AS w FROM a),
    f AS (SELECT *, {first('b.h >= close + t')} AS lt, {first('b.l <= close - s')} AS ls, {first('b.l <= close - t')} AS st, {first('b.h >= close + s')} AS ss FROM g),
    o AS (SELECT *, (lt > 0 AND (ls = 0 OR lt < ls)) AS wl, (st > 0 AND (ss = 0 OR st < ss)) AS ws FROM f)"""


_RACE_SQL = f"WITH {_race(12)} SELECT symbol, ts, CASE WHEN t IS NOT NULL THEN wl::INT END AS long, CASE WHEN t IS NOT NULL THEN ws::INT END AS short"


@query(f"""{_RACE_SQL}, CASE WHEN t IS NOT NULL THEN w[CASE WHEN wl THEN lt WHEN ls > 0 THEN ls ELSE len(w) END].ts END AS t1_long, CASE WHEN t IS NOT NULL THEN w[CASE WHEN ws THEN st WHEN ss > 0 THEN ss ELSE len(w) END].ts END AS t1_short FROM o""")
def triple_barrier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.barrier_race(targeted(spark, sf_dir), 12).select("symbol", "ts", "long", "short", "t1_long", "t1_short")


@query(f"""WITH {with_atr(14)}, g AS (SELECT *, coalesce(list({{'h': high, 'l': low}}) OVER {ahead(12)}, []) AS w0 FROM a), m AS (SELECT *, coalesce(list_position(list_transform(w0, lambda b: coalesce(b.h >= close + 0.4 * atr OR b.l <= close - 0.4 * atr, false)), true), 0) AS mv FROM g), k AS (SELECT *, CASE WHEN mv = 0 THEN [] ELSE w0[mv + 1:] END AS w FROM m),
    f AS (SELECT *, coalesce(list_position(list_transform(w, lambda b: coalesce(b.h >= close + atr, false)), true), 0) AS lt, coalesce(list_position(list_transform(w, lambda b: coalesce(b.l <= close - 0.5 * atr, false)), true), 0) AS ls, coalesce(list_position(list_transform(w, lambda b: coalesce(b.l <= close - atr, false)), true), 0) AS st, coalesce(list_position(list_transform(w, lambda b: coalesce(b.h >= close + 0.5 * atr, false)), true), 0) AS ss FROM k)
    SELECT symbol, ts, CASE WHEN atr IS NOT NULL THEN (lt > 0 AND (ls = 0 OR lt < ls))::INT END AS long, CASE WHEN atr IS NOT NULL THEN (st > 0 AND (ss = 0 OR st < ss))::INT END AS short FROM f""")
def triple_barrier_armed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The race that begins after a first move of 0.4 true ranges."""
    x = targeted(spark, sf_dir).withColumn("arm", 0.4 * F.col("atr_mean_14"))
    return labels.barrier_race(x, 12, arm="arm").select("symbol", "ts", "long", "short")


@query(f"{_RACE_SQL} FROM o")
def triple_barrier_fast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The race over numpy windows, for long horizons."""
    return labels.barrier_race_fast(targeted(spark, sf_dir), 12).select("symbol", "ts", "long", "short")


@query(f"""WITH {with_atr(14)}, g AS (SELECT *, coalesce(list({{'h': high, 'l': low}}) OVER {ahead(8)}, []) AS w FROM a), f AS (SELECT *, coalesce(list_position(list_transform(w, lambda b: coalesce(b.h >= close + atr, false)), true), 0) AS u, coalesce(list_position(list_transform(w, lambda b: coalesce(b.l <= close - atr, false)), true), 0) AS d FROM g)
    SELECT symbol, ts, CASE WHEN len(w) = 8 AND atr > 0 THEN CASE WHEN u > 0 AND (d = 0 OR u < d) THEN 1 WHEN d > 0 AND (u = 0 OR d < u) THEN -1 ELSE 0 END END AS barrier FROM f""")
def symmetric_barrier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.symmetric_barrier(indicators.atr_mean(bars(spark, sf_dir), 14), "atr_mean_14", 8).select("symbol", "ts", "barrier")


@query(f"""WITH {BARS}, f AS (SELECT *, {div(lead('close', 6), 'close')} - 1 AS f, max(high) OVER {ahead(6)} - close AS mfe, close - min(low) OVER {ahead(6)} AS mae FROM bars)
    SELECT symbol, ts, {r('f', 'fwd_return')}, CASE WHEN f > 0.1 THEN 1 WHEN f < -0.1 THEN -1 WHEN f IS NOT NULL THEN 0 END AS direction, {r('mfe', 'mfe')}, {r('mae', 'mae')} FROM f""")
def direction_horizon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(labels.excursions(labels.direction_horizon(bars(spark, sf_dir), 6, 0.1), 6), "fwd_return", "direction", "mfe", "mae")


@query(f"""WITH {BARS}, f AS (SELECT *, {div(lead('close', 4), 'close')} - 1 AS f, min(low) OVER {ahead(4)} AS low4 FROM bars), q AS (SELECT *, {gated('quantile_cont(f, 0.8)', 'f', prev(48), 48)} AS q FROM f)
    SELECT symbol, ts, CASE WHEN f IS NOT NULL AND q IS NOT NULL THEN (f > q AND q >= 0.01 AND low4 > close * (1 - 0.5))::INT END AS lookahead FROM q""")
def lookahead_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.lookahead_percentile(bars(spark, sf_dir), 4, 48, 0.8, 0.01, 0.5).select("symbol", "ts", "lookahead")


def _first(cond: str) -> str:
    return f"coalesce(list_position(list_transform(w, lambda b: coalesce({cond}, false)), true), 0)"


_SIGNAL = f"""{BARS}, m AS (SELECT *, {gated('avg(close)', 'close', prev(20), 20)} AS m, {gated('stddev_samp(close)', 'close', prev(20), 20)} AS s, {lead('close', 10)} / nullif(close, 0) - 1 AS f, coalesce(list({{'h': high, 'l': low, 'i': hour(ts)}}) OVER {ahead(10)}, []) AS w0 FROM bars), b AS (SELECT *, close < m - s AS dn, close > m + s AS up, w0 AS w FROM m)"""
_WON = lambda a, b: f"({a} > 0 AND ({b} = 0 OR {a} < {b}))::INT"


@query(f"""WITH {_SIGNAL}, f AS (SELECT *, {_first('b.h >= m')} AS lw, {_first('b.l < close - 60')} AS ll, {_first('b.l <= m')} AS sw, {_first('b.h > close + 60')} AS sl FROM b), g AS (SELECT * REPLACE (w[1:4] AS w) FROM f), k AS (SELECT *, {_first('b.h - close >= 40')} AS fu, {_first('close - b.l >= 40')} AS fd FROM g),
    z AS (SELECT symbol, ts, up, dn, f, CASE WHEN dn AND len(w) > 0 THEN {_WON('lw', 'll')} END AS ls, CASE WHEN up AND len(w) > 0 THEN {_WON('sw', 'sl')} END AS ss, CASE WHEN dn AND len(w) > 0 THEN {_WON('fu', 'fd')} END AS lf, CASE WHEN up AND len(w) > 0 THEN {_WON('fd', 'fu')} END AS sf FROM k)
    SELECT symbol, ts, ls AS long_slow, ss AS short_slow, CASE WHEN ls = 1 THEN coalesce(lf, 0) ELSE 0 END AS long_fast, CASE WHEN ss = 1 THEN coalesce(sf, 0) ELSE 0 END AS short_fast, {r('CASE WHEN up OR dn THEN f END', 'reg')} FROM z""")
def mean_reversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(labels.mean_reversion(bars(spark, sf_dir), 10, 60.0, 40.0, 4, 20, 1.0), "long_slow", "short_slow", "long_fast", "short_fast", "reg")


def _around(n: int) -> str:
    return f"({BY} ROWS BETWEEN {n} PRECEDING AND {n} FOLLOWING)"


def _cleaned(label: str, other: str, n: int, against: str, name: str, source: str) -> str:
    o = gated(f"avg({other})", other, _around(n), n)
    return f"{name} AS (SELECT * REPLACE (CASE WHEN {label} = 1 AND coalesce({o} >= 0.65 OR ({against} AND {o} >= 0.65 * 0.7), false) THEN 0 ELSE {label} END AS {label}) FROM {source})"


@query(f"""WITH {_race(12)}, y AS (SELECT symbol, ts, CASE WHEN t IS NOT NULL THEN wl::INT END AS long_slow, CASE WHEN t IS NOT NULL THEN ws::INT END AS short_slow, ({lead('close')} > close)::INT AS long_fast, ({lead('close')} < close)::INT AS short_fast, (volume >= 5)::INT AS tr, {lead('close', 3)} - close AS mv FROM o),
    d AS (SELECT *, sign(avg(mv) OVER ({BY} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) AS side FROM y), a0 AS (SELECT *, tr = 1 AND coalesce(side < 0, false) AS cl, tr = 1 AND coalesce(side > 0, false) AS cs FROM d),
    {_cleaned('long_fast', 'short_fast', 3, 'cl', 'a1', 'a0')}, {_cleaned('short_fast', 'long_fast', 3, 'cs', 'a2', 'a1')}, {_cleaned('long_slow', 'short_slow', 5, 'cl', 'a3', 'a2')}, {_cleaned('short_slow', 'long_slow', 5, 'cs', 'a4', 'a3')}
    SELECT symbol, ts, long_fast, short_fast, long_slow, short_slow FROM a4""")
def denoised_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four labels cleaned by their surroundings, counter-trend ones sooner."""
    w = ordered("symbol")
    x = labels.barrier_race(targeted(spark, sf_dir), 12).withColumnsRenamed({"long": "long_slow", "short": "short_slow"})
    ahead_ = lambda n: F.lead("close", n).over(w) - F.col("close")
    x = x.withColumns({"long_fast": (ahead_(1) > 0).cast("int"), "short_fast": (ahead_(1) < 0).cast("int"), "tr": (F.col("volume") >= 5).cast("int"), "mv": ahead_(3)})
    return labels.denoise(x, 3, 5, 0.65, "tr", "mv", 0.7).select("symbol", "ts", "long_fast", "short_fast", "long_slow", "short_slow")


_WINDOWS = f"""n AS (SELECT *, floor(epoch(ts) / 28800)::BIGINT AS window_id, CASE WHEN volume >= 2 THEN 1 ELSE 0 END AS setup, {mean('close', 20)} AS trend, row_number() OVER ({BY}) AS i FROM a),
    p AS (SELECT *, min(setup) OVER q = 1 AS ok, close - {lag('close')} AS d, coalesce(max(high) OVER {ahead(12)} - close >= 60, false) AS far FROM n WINDOW q AS (PARTITION BY symbol, window_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


@query(f"""WITH {with_atr(14)}, {_WINDOWS}, f AS (SELECT *, coalesce(max((d < 0 AND ok)::INT) OVER (PARTITION BY symbol, window_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 1, false) AS fell, coalesce(close < trend, false) AS lost FROM p),
    e AS (SELECT *, coalesce(ok AND fell AND d > 0 AND close > open AND close - open <= 150, false) AND (lost OR far) AS ends FROM f), m AS (SELECT *, min(CASE WHEN ends THEN i END) OVER (PARTITION BY symbol, window_id) AS first FROM e) SELECT symbol, ts, (ends AND NOT lost AND i = first)::INT AS timing FROM m""")
def first_higher_low(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.first_higher_low(_windowed(spark, sf_dir), "setup", "window_id", "trend", 60.0, 12, 150.0).select("symbol", "ts", "timing")


def _windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = indicators.atr_mean(bars(spark, sf_dir), 14)
    return b.withColumns({"window_id": F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 28800), "setup": (F.col("volume") >= 2).cast("int"), "trend": mean_n("close", ordered("symbol"), 20), "strength": F.col("close") / 4})


@query(f"""WITH {with_atr(14)}, {_WINDOWS}, g AS (SELECT *, coalesce(ok AND close > trend AND (close - trend) / (atr + 1e-10) <= 2 AND close / 4 > 40 AND close > open AND (close - open) / (atr + 1e-10) >= 0.3 AND close - open <= 150 AND far, false) AS good FROM p),
    f AS (SELECT *, min(CASE WHEN good THEN i END) OVER (PARTITION BY symbol, window_id) AS first FROM g), k AS (SELECT *, min(CASE WHEN good AND i >= first + 3 THEN i END) OVER (PARTITION BY symbol, window_id) AS second FROM f) SELECT symbol, ts, coalesce(good AND (i = first OR i = second), false)::INT AS timing FROM k""")
def rebounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.rebounds(_windowed(spark, sf_dir), "setup", "window_id", "trend", "atr_mean_14", "strength", 60.0, 12, 150.0, gap=3).select("symbol", "ts", "timing")


@query(f"""WITH {TRUE}, x AS (SELECT *, {gated('avg(tr)', 'tr', prev(14), 14)} AS a, CASE WHEN volume >= 6 THEN 1 WHEN volume >= 3 THEN 0 WHEN volume = 2 THEN -1 END AS regime FROM t)
    SELECT symbol, ts, {r('a', 'label_atr')}, CASE WHEN regime <> 0 THEN (close > open)::INT WHEN regime = 0 THEN (close < open)::INT END AS routed FROM x WHERE a IS NOT NULL AND close IS NOT NULL""")
def routed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean true range of the bars before, and a label routed by regime, on complete rows."""
    v = F.col("volume")
    x = labels.label_atr(bars(spark, sf_dir), 14).withColumns({"regime": F.when(v >= 6, 1).when(v >= 3, 0).when(v == 2, -1), "up": (F.col("close") > F.col("open")).cast("int"), "down": (F.col("close") < F.col("open")).cast("int")})
    return shown(align.complete_cases(labels.route(x, "regime", "up", "down", "routed"), ["label_atr", "close"]), "label_atr", "routed")


@query("""WITH n AS (SELECT doc_id, quality AS y, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM labels), f AS (SELECT unnest(range(1, 6)) AS fold), s AS (SELECT *, n - (6 - fold) * (n // 6) AS first FROM n, f)
    SELECT fold, count(*) FILTER (i <= first - 4) AS train_rows, coalesce(sum(y) FILTER (i <= first - 4), 0)::BIGINT AS train_positives, count(*) FILTER (i BETWEEN first AND first + n // 6 - 1) AS test_rows, coalesce(sum(y) FILTER (i BETWEEN first AND first + n // 6 - 1), 0)::BIGINT AS test_positives, coalesce(sum(y) FILTER (i <= first - 4), 0) = 0 AS degenerate FROM s GROUP BY 1""")
def label_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.label_coverage(read(spark, sf_dir, "labels"), "quality", "doc_id", 5, 3)


@query("""SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS month, count(*) AS rows, count_if(o_totalprice > 400000)::BIGINT AS positives, round(avg((o_totalprice > 400000)::INT), 6) + 0.0 AS rate, count_if(o_totalprice > 400000) = 0 AS empty FROM orders GROUP BY 1""")
def empty_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluation.empty_months(read(spark, sf_dir, "orders").withColumn("y", (F.col("o_totalprice") > 400000).cast("int")), "y", "o_orderdate"))


@query(f"""WITH {_SCORED}, g AS (SELECT lang, count(*) AS n, avg((p - y) ** 2) AS b, avg(y) AS m FROM s GROUP BY 1) SELECT lang, n, {r('b', 'brier')}, {r('m * (1 - m)', 'reference')}, {r('1 - b / nullif(m * (1 - m), 0)', 'skill')} FROM g""")
def brier_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluation.brier(_scored(spark, sf_dir), "y", "p", ["lang"]))


@query(f"""WITH {BARS}, e AS (SELECT *, abs(close - {lag('close')}) AS d FROM bars), f AS (SELECT *, {gated('sum(d)', 'd', over(20), 20)} AS p, abs(close - {lag('close', 20)}) AS mv, 100.0 * {gated('stddev_samp(close)', 'close', over(20), 20)} / nullif({mean('close', 20)}, 0) AS v, {mean('close', 50, 25)} AS m FROM e),
    g AS (SELECT *, CASE WHEN p = 0 THEN 0 ELSE mv / nullif(p, 0) END AS eff FROM f), h AS (SELECT *, (100 * eff > 25 OR eff > 0.5) AS tr FROM g), i AS (SELECT *, CASE WHEN tr IS NULL OR m IS NULL THEN NULL WHEN tr AND close > m THEN 1 WHEN tr AND close < m THEN -1 ELSE 0 END AS t, CASE WHEN v < 70 THEN -1 WHEN v > 100 THEN 1 WHEN v IS NOT NULL THEN 0 END AS q FROM h)
    SELECT symbol, ts, t AS regime_trend, q AS regime_volatility, concat_ws('_', CASE t WHEN 1 THEN 'UPTREND' WHEN -1 THEN 'DOWNTREND' WHEN 0 THEN 'RANGE' END, CASE q WHEN 1 THEN 'HIGH' WHEN -1 THEN 'LOW' WHEN 0 THEN 'NORMAL' END) AS regime_combined FROM i""")
def rule_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = ordered("symbol")
    x = indicators.efficiency(bars(spark, sf_dir), 20).withColumn("strength", 100 * F.col("efficiency_20"))
    sd = F.when(F.count("close").over(w.rowsBetween(-19, 0)) >= 20, F.stddev_samp("close").over(w.rowsBetween(-19, 0)))
    x = x.withColumn("v", 100.0 * sdiv(sd, mean_n("close", w, 20)))
    return labels.rule_regimes(x, "strength", "efficiency_20", "v", lo=70, hi=100).select("symbol", "ts", "regime_trend", "regime_volatility", "regime_combined")


@query(f"""WITH {_race(12)}, y AS (SELECT ts, CASE WHEN t IS NOT NULL THEN wl::INT END AS l FROM o) SELECT year(ts)::INT AS year, week(ts)::INT AS week, count(l) AS bars, sum(l)::BIGINT AS positives, {r('avg(l)', 'share')} FROM y GROUP BY 1, 2""")
def weekly_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(labels.weekly_label_stats(labels.barrier_race(targeted(spark, sf_dir), 12), "long"))


@query(f"""WITH RECURSIVE {BARS}, x AS (SELECT *, abs(close - {lag('close')}) AS d FROM bars), y AS (SELECT *, {gated('sum(d)', 'd', over(10), 10)} AS p, abs(close - {lag('close', 10)}) AS m, row_number() OVER ({BY}) AS rn FROM x), e AS (SELECT symbol, ts, rn, CASE WHEN p = 0 THEN 0 ELSE m / p END AS e FROM y),
    n AS (SELECT symbol, ts, rn, coalesce(e > 0.4, false) AS go, coalesce(e > 0.2, false) AS still FROM e),
    w AS (SELECT DISTINCT symbol, 0::BIGINT AS rn, false AS live, 0::BIGINT AS pos, 0::BIGINT AS number, false AS inside FROM n
        UNION ALL SELECT n.symbol, n.rn, CASE WHEN live AND pos < 4 THEN still ELSE go END, CASE WHEN live AND pos < 4 THEN pos + still::BIGINT WHEN go THEN 1 ELSE 0 END, number + (NOT (live AND pos < 4) AND go)::BIGINT, CASE WHEN live AND pos < 4 THEN still ELSE go END FROM w JOIN n ON n.symbol = w.symbol AND n.rn = w.rn + 1)
    SELECT n.symbol, n.ts, CASE WHEN inside THEN number END AS window_id, CASE WHEN inside THEN pos END AS window_pos FROM n JOIN w USING (symbol, rn)""")
def opportunity_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A state machine by symbol."""
    x = indicators.efficiency(bars(spark, sf_dir), 10).withColumn("go", F.col("efficiency_10") > 0.4).withColumn("on", F.col("efficiency_10") > 0.2)
    return labels.opportunity_windows(x.select("symbol", "ts", "go", "on"), "go", "on").select("symbol", "ts", "window_id", "window_pos")


# evaluation ---------------------------------------------------------------------------------------------------------


@query(f"""WITH {_race(12)}, y AS (SELECT symbol, ts, w[CASE WHEN wl THEN lt WHEN ls > 0 THEN ls ELSE len(w) END].ts AS t1 FROM o WHERE t IS NOT NULL AND len(w) > 0), c AS (SELECT a.symbol, a.ts, a.t1, count(*) AS n FROM y a JOIN y b ON a.symbol = b.symbol AND b.ts <= a.ts AND b.t1 >= a.ts GROUP BY ALL),
    u AS (SELECT a.symbol, a.ts, any_value(a.n) AS n, CASE WHEN any_value(e.n) IS NOT NULL THEN avg(1 / b.n) END AS u FROM c a JOIN c b ON a.symbol = b.symbol AND b.ts BETWEEN a.ts AND a.t1 LEFT JOIN c e ON e.symbol = a.symbol AND e.ts = a.t1 GROUP BY 1, 2)
    SELECT symbol, ts, n::BIGINT AS concurrent, {r('u', 'uniqueness')}, {r('u * count(u) OVER (PARTITION BY symbol) / sum(u) OVER (PARTITION BY symbol)', 'weight')} FROM u""")
def label_uniqueness(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = labels.barrier_race(targeted(spark, sf_dir), 12).where("t1_long is not null").select("symbol", "ts", F.col("t1_long").alias("t1"))
    return shown(evaluation.average_uniqueness(x, "ts", "t1"), "concurrent", "uniqueness", "weight")


@query("""WITH n AS (SELECT count(*) AS n FROM orders), f AS (SELECT unnest(range(1, 6)) AS fold, n, n // 6 AS s FROM n) SELECT fold, n - (6 - fold) * s AS first_test, n - (6 - fold) * s + s - 1 AS last_test, n - (6 - fold) * s - 1 - 10 AS train_until FROM f""")
def time_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.time_folds(read(spark, sf_dir, "orders"), 5, 10, "o_orderdate")


@query(f"""WITH {_SCORED}, k AS (SELECT *, rank() OVER (PARTITION BY lang ORDER BY p) + (count(*) OVER (PARTITION BY lang, p) - 1) / 2.0 AS k FROM s), a AS (SELECT lang, count(*) AS n, sum(y)::BIGINT AS positives, sum(CASE WHEN y = 1 THEN k END) AS t FROM k GROUP BY 1)
    SELECT lang, n, positives, {r(div('t - positives * (positives + 1) / 2.0', 'positives::DOUBLE * (n - positives)'), 'auc')} FROM a""")
def auc_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluation.auc(_scored(spark, sf_dir), "y", "p", ["lang"]))


@query(f"""WITH {_SCORED}, t AS (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7]) AS threshold), g AS (SELECT threshold::DOUBLE AS threshold, count(*)::DOUBLE AS n, sum(y)::DOUBLE AS pos, count_if(p >= threshold)::DOUBLE AS k, count_if(p >= threshold AND y = 1)::DOUBLE AS h FROM s, t GROUP BY 1)
    SELECT threshold, k::BIGINT AS predicted, h::BIGINT AS hits, {r('h / nullif(k, 0)', '"precision"')}, {r('h / nullif(pos, 0)', 'recall')}, {r('2 * h / nullif(k + pos, 0)', 'f1')}, {r('(h * (n - pos - k + h) - (k - h) * (pos - h)) / nullif(sqrt(k * pos * (n - pos) * (n - k)), 0)', 'mcc')}, {r('(h / nullif(k, 0)) / nullif(pos / n, 0)', 'lift')} FROM g""")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluation.threshold_sweep(_scored(spark, sf_dir), "y", "p", [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7]))


@query(f"""WITH {_SCORED}, g AS (SELECT p, count(*) AS n, sum(y) AS k FROM s GROUP BY 1), c AS (SELECT p, sum(n) OVER (ORDER BY p DESC) AS cn, sum(k) OVER (ORDER BY p DESC) AS ck, sum(k) OVER () AS t FROM g)
    SELECT {r('p', 'threshold')}, {r('ck / cn', '"precision"')}, {r('ck / t', 'recall')} FROM c WHERE ck / t >= 0.8 ORDER BY ck / cn DESC, p DESC LIMIT 1""")
def threshold_at_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluation.threshold_at_recall(_scored(spark, sf_dir), "y", "p", 0.8))


@query(f"""WITH {_SCORED}, g AS (SELECT least(floor(p * 10), 9)::INT AS bin, count(*) AS n, avg(p) AS ms, avg(y) AS sh FROM s GROUP BY 1) SELECT bin, n, {r('ms', 'mean_score')}, {r('sh', 'share')}, {r('sum(n * abs(ms - sh)) OVER () / sum(n) OVER ()', 'ece')} FROM g""")
def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluation.calibration(_scored(spark, sf_dir), "y", "p"))


@query(f"""WITH {BARS}, x AS (SELECT *, (close > {mean('close', 24, 2)})::INT AS y, (volume >= 5)::INT AS q FROM bars), n AS (SELECT *, CASE WHEN y = 1 AND coalesce({lag('y')}, 0) <> 1 THEN 1 ELSE 0 END AS s FROM x), i AS (SELECT *, sum(s) OVER ({BY} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS id FROM n),
    p AS (SELECT *, row_number() OVER (PARTITION BY symbol, id ORDER BY ts) - 1 AS pos FROM i WHERE y = 1), e AS (SELECT symbol, id, min(CASE WHEN q = 1 THEN pos END) AS lag, count(*) AS len FROM p GROUP BY 1, 2) SELECT symbol, count(*) AS events, count(lag) AS detected, {r('avg(lag)', 'mean_lag')}, {r('avg(len)', 'mean_length')} FROM e GROUP BY 1""")
def event_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = ordered("symbol")
    x = bars(spark, sf_dir).withColumn("y", (F.col("close") > mean_n("close", w, 24, 2)).cast("int")).withColumn("q", (F.col("volume") >= 5).cast("int"))
    return rounded(evaluation.event_metrics(x, "y", "q", ["symbol"], "ts"))


@query("""WITH e AS (SELECT o_orderpriority AS k, date_trunc('month', o_orderdate) AS c, sum(o_totalprice) AS s, count(*) AS n FROM orders GROUP BY 1, 2), m AS (SELECT *, sum(s) OVER (PARTITION BY k) / sum(n) OVER (PARTITION BY k) AS m FROM e), g AS (SELECT k, sum(n)::BIGINT AS n, count(*) AS clusters, max(m) AS mean, sum((s - n * m) ** 2) AS q FROM m GROUP BY 1)
    SELECT k AS priority, n, clusters, round(mean, 3) + 0.0 AS mean, round(sqrt(q * clusters / (clusters - 1.0)) / n, 3) + 0.0 AS se, round(mean / (sqrt(q * clusters / (clusters - 1.0)) / n), 3) + 0.0 AS t FROM g""")
def clustered_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean order value with errors clustered by month."""
    o = read(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "priority")
    return rounded(evaluation.clustered_mean(o, "o_totalprice", F.date_trunc("month", "o_orderdate"), ["priority"]), 3)


@query("""WITH p AS (SELECT c_custkey, abs(c_acctbal) / 10000 AS p FROM customer), x AS (SELECT *, row_number() OVER (ORDER BY p, c_custkey) AS k, count(*) OVER () AS n FROM p) SELECT c_custkey, round(p, 6) + 0.0 AS p, round(least(min(p * n / k) OVER (ORDER BY k DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1), 6) + 0.0 AS p_adjusted FROM x""")
def benjamini_hochberg(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = read(spark, sf_dir, "customer").select("c_custkey", (F.abs("c_acctbal") / 10000).alias("p"))
    return rounded(evaluation.benjamini_hochberg(x, "p"))


def _ranked(x: str) -> str:
    return f"(rank() OVER (PARTITION BY symbol ORDER BY {x}) + (count(*) OVER (PARTITION BY symbol, {x}) - 1) / 2.0)"


_FWD = f"{BARS}, f AS (SELECT *, {div(lead('close', 3), 'close')} - 1 AS f FROM bars), k AS (SELECT symbol, ts, {_ranked('volume')} AS x, {_ranked('f')} AS y, row_number() OVER ({BY}) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM f WHERE f IS NOT NULL)"


@query(f"WITH {_FWD} SELECT symbol, count(*) AS n, {r('corr(x, y)', 'ic')} FROM k GROUP BY 1")
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = labels.direction_horizon(bars(spark, sf_dir), 3, 0.0)
    return rounded(evaluation.spearman(x, "volume", "fwd_return", ["symbol"]))


@query(f"WITH {_FWD}, o AS (SELECT unnest([0, 50, 100, 150, 200]) AS off) SELECT a.symbol, off::INT AS \"offset\", {r('corr(a.x, b.y)', 'ic')} FROM k a, o JOIN k b ON b.symbol = a.symbol AND b.i = (a.i + off) % a.n GROUP BY 1, 2")
def circular_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = labels.direction_horizon(bars(spark, sf_dir), 3, 0.0)
    return rounded(evaluation.circular_null(x, "volume", "fwd_return", ["symbol"], "ts", [0, 50, 100, 150, 200]))


@query("""WITH p AS (SELECT o_totalprice AS x, (o_orderdate >= TIMESTAMP '1999-01-01')::INT AS b FROM orders), e AS (SELECT quantile_cont(x, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM p WHERE b = 0), g AS (SELECT len(list_filter(list_distinct(e), lambda q: q < x))::INT AS bin, count_if(b = 0) AS o, count_if(b = 1) AS n FROM p, e GROUP BY 1),
    h AS (SELECT *, greatest(o / sum(o) OVER (), 0.0001) AS a, greatest(n / sum(n) OVER (), 0.0001) AS q FROM g) SELECT bin, o::BIGINT AS old, n::BIGINT AS "new", round((q - a) * ln(q / a), 6) + 0.0 AS psi FROM h""")
def stability_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluation.stability_index(read(spark, sf_dir, "orders"), "o_totalprice", F.col("o_orderdate") >= F.lit("1999-01-01").cast("timestamp_ntz")))


@query("""WITH p AS (SELECT o_totalprice AS x, o_orderdate >= TIMESTAMP '1999-01-01' AS b FROM orders), g AS (SELECT x, count_if(b) AS n, count_if(NOT b) AS o FROM p GROUP BY 1), c AS (SELECT sum(o) OVER w AS co, sum(n) OVER w AS cn, sum(o) OVER () AS t, sum(n) OVER () AS u FROM g WINDOW w AS (ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    SELECT round(max(abs(co / t - cn / u)), 6) + 0.0 AS ks, max(t)::BIGINT AS n_old, max(u)::BIGINT AS n_new FROM c""")
def kolmogorov_smirnov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluation.kolmogorov_smirnov(read(spark, sf_dir, "orders"), "o_totalprice", F.col("o_orderdate") >= F.lit("1999-01-01").cast("timestamp_ntz")))


def _profiled(c: str) -> str:
    return f"""SELECT '{c}' AS "column", count(*) AS rows, count_if({c} IS NULL)::BIGINT AS nulls, count(DISTINCT {c}) AS distinct_values, {r(f'avg(({c} = 0)::INT)', 'zero_share')}, round(avg({c}), 5) + 0.0 AS mean, {r(f'stddev_samp({c})', 'std')}, {r(f'quantile_cont({c}, 0.01)', 'q01')}, {r(f'quantile_cont({c}, 0.5)', 'q50')}, {r(f'quantile_cont({c}, 0.99)', 'q99')}, {r(f'skewness({c})', 'skew')} FROM lineitem"""


@query(" UNION ALL ".join(_profiled(c) for c in ("l_quantity", "l_discount", "l_tax")))
def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = evaluation.profile(read(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_tax"])
    return rounded(x.withColumn("mean", F.round("mean", 5)))


@query("SELECT 'a' AS a, 'c' AS b")
def duplicate_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("a"), F.col("o_orderkey").alias("b"), F.col("o_custkey").alias("c"))
    return evaluation.duplicate_columns(x, ["a", "b", "c"])


@query(f"""WITH {BARS}, d AS (SELECT symbol, {lag('ts')} AS p, ts, epoch(ts) - epoch({lag('ts')}) AS d FROM bars), f AS (SELECT symbol, d, count(*) AS n FROM d WHERE d IS NOT NULL GROUP BY 1, 2), u AS (SELECT symbol, arg_max(d, (n, -d)) AS step FROM f GROUP BY 1)
    SELECT symbol, p AS gap_start, ts AS gap_end, d::BIGINT AS seconds FROM d JOIN u USING (symbol) WHERE d > 1.5 * step AND NOT list_bool_or(list_transform(range(p::DATE::TIMESTAMP, ts::DATE::TIMESTAMP + INTERVAL 1 DAY, INTERVAL 1 DAY), lambda x: isodow(x) = 6))""")
def time_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.time_gaps(bars(spark, sf_dir), ["symbol"], "ts")


@query(f"""WITH {BARS}, m AS (SELECT symbol, ts, close - avg(close) OVER (PARTITION BY symbol) AS d FROM bars), l AS (SELECT symbol, d, {', '.join(f"{lag('d', k)} AS l{k}" for k in range(1, 6))} FROM m), s AS (SELECT symbol, count(*)::DOUBLE AS n, sum(d * d) AS v, [{', '.join(f'sum(d * l{k})' for k in range(1, 6))}] AS c FROM l GROUP BY 1),
    u AS (SELECT symbol, n, unnest(range(1, 6))::INT AS lag, unnest(c) / v AS acf FROM s) SELECT symbol, lag, {r('acf', 'acf')}, {r('n * (n + 2) * sum(acf * acf / (n - lag)) OVER (PARTITION BY symbol ORDER BY lag)', 'ljung_box')} FROM u""")
def autocorrelation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluation.autocorrelation(bars(spark, sf_dir), "close", 5, ["symbol"], "ts"))


@query("""WITH c AS (SELECT o_orderpriority AS config, (epoch(o_orderdate) // 86400 % 6)::INT AS block, sum(o_totalprice) AS s, count(*) AS n, sum(o_totalprice * o_totalprice) AS q FROM orders GROUP BY 1, 2), m AS (SELECT unnest(range(64)) AS m), h AS (SELECT m FROM m WHERE bit_count(m) = 3),
    y AS (SELECT m, config, sum(CASE WHEN m & (1 << block) > 0 THEN s END) AS si, sum(CASE WHEN m & (1 << block) > 0 THEN n END) AS ni, sum(CASE WHEN m & (1 << block) > 0 THEN q END) AS qi, sum(CASE WHEN m & (1 << block) = 0 THEN s END) AS so, sum(CASE WHEN m & (1 << block) = 0 THEN n END) AS no, sum(CASE WHEN m & (1 << block) = 0 THEN q END) AS qo FROM c, h GROUP BY 1, 2),
    z AS (SELECT m, config, (si / ni) / sqrt(qi / ni - (si / ni) ** 2) AS i, (so / no) / sqrt(qo / no - (so / no) ** 2) AS o FROM y), k AS (SELECT *, rank() OVER (PARTITION BY m ORDER BY o) AS k, count(*) OVER (PARTITION BY m) AS n, row_number() OVER (PARTITION BY m ORDER BY i DESC, config) AS b FROM z)
    SELECT count(*) AS splits, round(avg((k / (n + 1.0) <= 0.5)::INT), 6) + 0.0 AS pbo FROM k WHERE b = 1""")
def overfitting_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").withColumn("block", F.pmod(F.unix_date(F.to_date("o_orderdate")), F.lit(6)))
    return rounded(evaluation.overfitting_probability(o, "o_orderpriority", "block", "o_totalprice", 6))


@query()
def deflated_sharpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sharpe ratios of five made-up strategies and the chance that each is more than the best of five by luck."""
    o = read(spark, sf_dir, "orders").select("o_orderpriority", (F.col("o_totalprice") - 150000.0).alias("v"))
    rows = simulation.sharpe_by(o, "v", ["o_orderpriority"]).collect()  # a row for each strategy
    spread = pd.Series([x.sharpe for x in rows]).var()
    return rounded(spark.createDataFrame([(x.o_orderpriority, x.n, x.sharpe, evaluation.deflated_sharpe(x.sharpe, x.n, x.skew, x.kurt, len(rows), float(spread))) for x in rows], "strategy string, n long, sharpe double, deflated double"))


# simulation ---------------------------------------------------------------------------------------------------------


@query("""WITH t AS (SELECT event_id, ts AS o, ts + (event_id % 200) * INTERVAL 1 HOUR AS c FROM events), d AS (SELECT event_id, o, c, unnest(range(o::DATE::TIMESTAMP, c::DATE::TIMESTAMP + INTERVAL 1 DAY, INTERVAL 1 DAY)) + INTERVAL 21 HOUR AS r FROM t)
    SELECT event_id, coalesce(sum(CASE WHEN r > o AND r <= c AND isodow(r) <= 5 THEN CASE WHEN isodow(r) = 3 THEN 3 ELSE 1 END ELSE 0 END), 0)::INT AS nights FROM d GROUP BY 1""")
def rollover_nights(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read(spark, sf_dir, "events").select("event_id", "ts", (F.col("ts") + F.make_dt_interval(F.lit(0), F.pmod(F.col("event_id"), F.lit(200)).cast("int"))).alias("closed"))
    return t.select("event_id", simulation.rollover_nights(F.col("ts"), F.col("closed")).alias("nights"))


_TRADES = """t AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS action, 1 + o_orderkey % 97 / 1000.0 AS op, 1 + o_totalprice % 100 / 1000.0 AS cp, o_totalprice AS notional, o_orderdate AS ot, o_orderdate + (o_orderkey % 90) * INTERVAL 1 HOUR AS ct, o_orderpriority AS why FROM orders)"""


def _trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(
        k.alias("id"), F.when(k % 2 == 0, "BUY").otherwise("SELL").alias("action"), (1 + k % 97 / 1000.0).alias("open_price"), (1 + F.col("o_totalprice") % 100 / 1000.0).alias("close_price"), F.col("o_totalprice").alias("notional"),
        F.col("o_orderdate").alias("open_time"), (F.col("o_orderdate") + F.make_dt_interval(F.lit(0), (k % 90).cast("int"))).alias("close_time"), F.col("o_orderpriority").alias("exit_reason"),
    )


@query(f"""WITH {_TRADES}, f AS (SELECT *, CASE WHEN action = 'BUY' THEN op + 0.00002 ELSE op - 0.00008 END AS fo, CASE WHEN action = 'BUY' THEN cp - 0.00008 ELSE cp + 0.00002 END AS fc, CASE WHEN action = 'BUY' THEN 1 ELSE -1 END AS s FROM t)
    SELECT id, round(s * (cp - op) / 0.0001, 4) + 0.0 AS pips_gross, round(s * (fc - fo) / 0.0001, 4) + 0.0 AS pips, round(s * (cp - op) / 0.0001 - s * (fc - fo) / 0.0001, 4) + 0.0 AS cost_pips, round(2 * 0.00003 * notional, 4) + 0.0 AS commission FROM f""")
def trade_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(simulation.trade_costs(_trades(spark, sf_dir), F.lit(0.6), 0.2, 0.00003, 0.00001).select("id", "pips_gross", "pips", "cost_pips", "commission"), 4)


@query(f"""WITH {_TRADES}, p AS (SELECT *, CASE WHEN action = 'BUY' THEN 1 ELSE -1 END * (cp - op) / 0.0001 AS pips FROM t) SELECT why AS exit_reason, count(*) AS trades, round(sum(pips), 3) + 0.0 AS total_pips, round(avg(pips), 3) + 0.0 AS mean_pips, round(avg((pips > 0)::INT), 3) + 0.0 AS win_rate, round(sum(CASE WHEN pips > 0 THEN pips END) / sum(CASE WHEN pips < 0 THEN -pips END), 3) + 0.0 AS profit_factor FROM p GROUP BY 1""")
def exit_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = simulation.trade_costs(_trades(spark, sf_dir), F.lit(0.0), 0.0, 0.0, 0.0)
    return rounded(simulation.trade_summary(t, ["exit_reason"], "pips_gross"), 3)


@query("""WITH e AS (SELECT list_distinct(quantile_cont(l_quantity, [0.2, 0.4, 0.6, 0.8])) AS e FROM lineitem) SELECT len(list_filter(e, lambda q: q < l_quantity))::INT AS bucket, count(*) AS n, round(avg(l_extendedprice), 3) + 0.0 AS mean_value, round(min(l_quantity), 3) + 0.0 AS low, round(max(l_quantity), 3) + 0.0 AS high FROM lineitem, e GROUP BY 1""")
def quantile_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem").withColumn("l_quantity", F.col("l_quantity").cast("double"))
    return rounded(simulation.quantile_buckets(li, "l_quantity", "l_extendedprice", 5), 3)


_EQUITY = """b AS (SELECT o_orderdate::DATE AS day, sum(o_totalprice - 150000) AS pnl FROM orders GROUP BY 1), s AS (SELECT unnest(range(min(day)::TIMESTAMP, max(day)::TIMESTAMP + INTERVAL 1 DAY, INTERVAL 1 DAY))::DATE AS day FROM b), x AS (SELECT s.day, coalesce(pnl, 0) AS pnl FROM s LEFT JOIN b ON b.day = s.day),
    e AS (SELECT *, 1e9 + sum(pnl) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS equity FROM x), p AS (SELECT *, greatest(max(equity) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1e9) AS peak, equity / coalesce(lag(equity) OVER (ORDER BY day), 1e9) - 1 AS ret FROM e)"""


def _equity(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day"), (F.col("o_totalprice") - 150000).alias("pnl"))
    return simulation.daily_equity(o, "day", "pnl", 1e9)


@query(f"WITH {_EQUITY} SELECT day::TIMESTAMP AS day, round(pnl, 2) + 0.0 AS pnl, round(equity, 2) + 0.0 AS equity, round(peak, 2) + 0.0 AS peak FROM p")
def daily_equity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_equity(spark, sf_dir).select(F.col("day").cast("timestamp_ntz").alias("day"), "pnl", "equity", "peak"), 2)


_GROWTH = "(arg_max(equity, day) / arg_min(equity - pnl, day)) ** (365.0 / (max(day) - min(day))) - 1"


@query(f"WITH {_EQUITY} SELECT count(*) AS days, {r('avg(ret) / stddev_samp(ret) * sqrt(252)', 'sharpe')}, {r('avg(ret) / sqrt(avg(least(ret, 0) ** 2)) * sqrt(252)', 'sortino')}, {r('min(equity / peak - 1)', 'max_drawdown')}, {r('arg_max(equity, day) / arg_min(equity - pnl, day) - 1', 'total_return')}, {r(_GROWTH, 'growth')}, {r(f'({_GROWTH}) / -min(equity / peak - 1)', 'calmar')} FROM p")
def equity_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(simulation.equity_metrics(_equity(spark, sf_dir)))


@query("""WITH a AS (SELECT l_linestatus AS fold, l_linenumber AS arm, count(*) AS trades, sum(l_quantity * (l_discount - 0.05)) AS pips FROM lineitem GROUP BY 1, 2), k AS (SELECT *, (trades >= 1000)::INT AS e, max(pips) OVER (PARTITION BY fold) - pips AS regret FROM a), n AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY e DESC, CASE WHEN e = 1 THEN pips ELSE trades END DESC, arm) AS n FROM k)
    SELECT fold, arm, trades, round(pips, 3) + 0.0 AS total_pips, round(regret, 3) + 0.0 AS regret FROM n WHERE n = 1""")
def operating_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = read(spark, sf_dir, "lineitem").groupBy(F.col("l_linestatus").alias("fold"), F.col("l_linenumber").alias("arm")).agg(F.count("*").alias("trades"), F.sum(F.col("l_quantity") * (F.col("l_discount") - 0.05)).alias("total_pips"))
    return rounded(simulation.operating_point(a.withColumn("place", F.col("arm")), ["fold"], 1000).select("fold", "arm", "trades", "total_pips", "regret"), 3)


# models and streams -------------------------------------------------------------------------------------------------


@query()
def out_of_fold_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direction of daily bars from two ranges, each fold scored by a model of earlier rows."""
    d = labels.direction_horizon(indicators.bar_shape(src.order_bars(spark, sf_dir)), 1, 0.0).withColumn("y", (F.col("direction") > 0).cast("int"))
    x = d.where("y is not null").select("symbol", "ts", "close_vs_range", "body_ratio", "volume", "y")
    return models.out_of_fold(x, ["close_vs_range", "body_ratio", "volume"], "y", "ts", 3, 5).select("symbol", "ts", "fold", "y", F.round("score", 4).alias("score"))


@query("""WITH e AS (SELECT list_distinct(quantile_cont(l_quantity, [0.2, 0.4, 0.6, 0.8])) AS e FROM lineitem) SELECT len(list_filter(e, lambda q: q < l_quantity))::INT AS bucket, count(*) AS n, round(avg(l_extendedprice), 3) + 0.0 AS mean_value, round(min(l_quantity), 3) + 0.0 AS low, round(max(l_quantity), 3) + 0.0 AS high FROM lineitem, e GROUP BY 1""")
def quantile_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem").withColumn("l_quantity", F.col("l_quantity").cast("double"))
    return rounded(simulation.quantile_buckets(li, "l_quantity", "l_extendedprice", 5), 3)


_EQUITY = """b AS (SELECT o_orderdate::DATE AS day, sum(o_totalprice - 150000) AS pnl FROM orders GROUP BY 1), s AS (SELECT unnest(range(min(day)::TIMESTAMP, max(day)::TIMESTAMP + INTERVAL 1 DAY, INTERVAL 1 DAY))::DATE AS day FROM b), x AS (SELECT s.day, coalesce(pnl, 0) AS pnl FROM s LEFT JOIN b ON b.day = s.day),
    e AS (SELECT *, 1e9 + sum(pnl) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS equity FROM x), p AS (SELECT *, greatest(max(equity) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1e9) AS peak, equity / coalesce(lag(equity) OVER (ORDER BY day), 1e9) - 1 AS ret FROM e)"""


def _equity(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day"), (F.col("o_totalprice") - 150000).alias("pnl"))
    return simulation.daily_equity(o, "day", "pnl", 1e9)


@query(f"WITH {_EQUITY} SELECT day::TIMESTAMP AS day, round(pnl, 2) + 0.0 AS pnl, round(equity, 2) + 0.0 AS equity, round(peak, 2) + 0.0 AS peak FROM p")
def daily_equity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_equity(spark, sf_dir).select(F.col("day").cast("timestamp_ntz").alias("day"), "pnl", "equity", "peak"), 2)


_GROWTH = "(arg_max(equity, day) / arg_min(equity - pnl, day)) ** (365.0 / (max(day) - min(day))) - 1"


@query(f"WITH {_EQUITY} SELECT count(*) AS days, {r('avg(ret) / stddev_samp(ret) * sqrt(252)', 'sharpe')}, {r('avg(ret) / sqrt(avg(least(ret, 0) ** 2)) * sqrt(252)', 'sortino')}, {r('min(equity / peak - 1)', 'max_drawdown')}, {r('arg_max(equity, day) / arg_min(equity - pnl, day) - 1', 'total_return')}, {r(_GROWTH, 'growth')}, {r(f'({_GROWTH}) / -min(equity / peak - 1)', 'calmar')} FROM p")
def equity_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(simulation.equity_metrics(_equity(spark, sf_dir)))


@query("""WITH a AS (SELECT l_linestatus AS fold, l_linenumber AS arm, count(*) AS trades, sum(l_quantity * (l_discount - 0.05)) AS pips FROM lineitem GROUP BY 1, 2), k AS (SELECT *, (trades >= 1000)::INT AS e, max(pips) OVER (PARTITION BY fold) - pips AS regret FROM a), n AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY e DESC, CASE WHEN e = 1 THEN pips ELSE trades END DESC, arm) AS n FROM k)
    SELECT fold, arm, trades, round(pips, 3) + 0.0 AS total_pips, round(regret, 3) + 0.0 AS regret FROM n WHERE n = 1""")
def operating_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = read(spark, sf_dir, "lineitem").groupBy(F.col("l_linestatus").alias("fold"), F.col("l_linenumber").alias("arm")).agg(F.count("*").alias("trades"), F.sum(F.col("l_quantity") * (F.col("l_discount") - 0.05)).alias("total_pips"))
    return rounded(simulation.operating_point(a.withColumn("place", F.col("arm")), ["fold"], 1000).select("fold", "arm", "trades", "total_pips", "regret"), 3)


# models and streams -------------------------------------------------------------------------------------------------


@query()
def out_of_fold_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direction of daily bars from two ranges, each fold scored by a model of earlier rows."""
    d = labels.direction_horizon(indicators.bar_shape(src.order_bars(spark, sf_dir)), 1, 0.0).withColumn("y", (F.col("direction") > 0).cast("int"))
    x = d.where("y is not null").select("symbol", "ts", "close_vs_range", "body_ratio", "volume", "y")
    return models.out_of_fold(x, ["close_vs_range", "body_ratio", "volume"], "y", "ts", 3, 5).select("symbol", "ts", "fold", "y", F.round("score", 4).alias("score"))


@query()
def regime_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mixture for each symbol; its states count within the symbol."""
    d = indicators.efficiency(src.order_bars(spark, sf_dir), 20).withColumn("rng", F.ln(F.col("high") / F.col("low")))
    x = d.where("efficiency_20 is not null")
    features, states = ["efficiency_20", "rng"], []
    for r in x.na.drop(subset=features).select("symbol").distinct().orderBy("symbol").collect():  # a row for each symbol
        own = x.where(F.col("symbol").eqNullSafe(F.lit(r.symbol)))
        states.append(models.regime_states(models.fit_regimes(own, features, 3), own, features))
    return models.dwell_times(reduce(DataFrame.unionByName, states), "state", ["symbol"], "ts")


@query()
def hidden_markov_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = bars(spark, sf_dir).select("symbol", "ts", F.ln("close").alias("x"))
    out = models.hidden_markov_filter(x, "x", ["symbol"], "ts", [3.0, 5.0], [1.0, 0.5], 0.9)
    return rounded(out.select("symbol", "ts", F.get("prob", F.lit(0)).alias("calm"), F.get("prob", F.lit(1)).alias("wild")))


@query("""WITH e AS (SELECT list_distinct(quantile_cont(l_quantity, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS e FROM lineitem), x AS (SELECT len(list_filter(e, lambda q: q < l_quantity)) AS b, l_returnflag AS y FROM lineitem, e), g AS (SELECT b, y, count(*) AS n FROM x GROUP BY 1, 2), t AS (SELECT n, n / sum(n) OVER () * ln(n * sum(n) OVER () / (sum(n) OVER (PARTITION BY b) * sum(n) OVER (PARTITION BY y))) AS t FROM g)
    SELECT 'l_quantity' AS feature, sum(n)::BIGINT AS n, round(sum(t), 6) + 0.0 AS mi FROM t""")
def mutual_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(models.mutual_information(read(spark, sf_dir, "lineitem").withColumn("l_quantity", F.col("l_quantity").cast("double")), "l_quantity", "l_returnflag"))


@query("""SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, round(corr(l_quantity, l_extendedprice), 6) + 0.0 AS r FROM lineitem UNION ALL SELECT 'l_quantity', 'l_discount', round(corr(l_quantity, l_discount), 6) + 0.0 FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_discount', round(corr(l_extendedprice, l_discount), 6) + 0.0 FROM lineitem""")
def correlation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(models.correlation_pairs(read(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]))


@query(f"""WITH {DAILY}, n AS (SELECT *, row_number() OVER ({BY}) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n, close - {lag('close')} AS d FROM days), w AS (SELECT symbol, n, unnest(range(0, (n - 30) // 10 + 1)) AS window_id FROM (SELECT DISTINCT symbol, n FROM n))
    SELECT w.symbol, window_id, count(*) AS n, round(avg(close), 3) + 0.0 AS mean, round(stddev_samp(close), 3) + 0.0 AS std, round(min(close), 3) + 0.0 AS low, round(max(close), 3) + 0.0 AS high, round(avg((d > 0)::INT), 3) + 0.0 AS up_share FROM w JOIN n ON n.symbol = w.symbol AND n.i BETWEEN 10 * window_id AND 10 * window_id + 29 GROUP BY 1, 2""")
def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(models.fingerprints(src.order_bars(spark, sf_dir), "close", ["symbol"], "ts", 30, 10), 3)


@query(f"WITH {BARS} SELECT symbol, ts, {r('open', 'open')}, {r('high', 'high')}, {r('low', 'low')}, {r('close', 'close')}, volume, {r('mid', 'mid')} FROM bars")
def stream_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming bars on a table: the batch result; a test runs them as a stream."""
    e = read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return rounded(streams.stream_bars(e, "event_type", "ts", "value", "event_id").withColumn("ts", F.col("ts").cast("timestamp_ntz")))


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 6 HOURS OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS id FROM e)
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOURS AS "end", count(*) AS ticks FROM s GROUP BY user_id, id""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return streams.stream_sessions(e, "user_id", "ts", "6 hours").withColumns({k: F.col(k).cast("timestamp_ntz") for k in ("start", "end")})


