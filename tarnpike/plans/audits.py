"""Queries on unit roots, overlapping events and weighted deviations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnpike.functions.safe import mean_n, ordered, rounded
from tarnpike.operators import align, evaluation, labels, unitroot
from tarnpike.plans.market import bars
from tarnpike.plans.sql import BARS, BY, DAILY, lag, mean, r
from tarnpike.sources import bars as src

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query()
def dickey_fuller(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily closes of each symbol, lags by Akaike's criterion."""
    return rounded(unitroot.dickey_fuller(src.order_bars(spark, sf_dir), "close", ["symbol"], "ts"), 4)


@query(f"""WITH {DAILY}, c AS (SELECT symbol, ts, close, 1.0::DOUBLE AS k, {lag('close')} AS l, close - {lag('close')} AS d, row_number() OVER ({BY}) AS rn FROM days), x AS (SELECT *, {lag('d', 1)} AS d1, {lag('d', 2)} AS d2 FROM c), v AS (SELECT symbol, [k, l / 1e5, d / 1e5, d1 / 1e5, d2 / 1e5] AS a FROM x WHERE d2 IS NOT NULL)
    SELECT symbol, (i - 1)::INT AS i, (j - 1)::INT AS j, round(sum(a[i] * a[j]), 4) + 0.0 AS v FROM v, (SELECT unnest(range(1, 6)) AS i), (SELECT unnest(range(1, 6)) AS j) GROUP BY ALL""")
def normal_equations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of products of a regression of daily changes on the level before and two changes before, in 100,000s."""
    w = ordered("symbol")
    x = src.order_bars(spark, sf_dir).select("symbol", "ts", F.lit(1.0).alias("k"), (F.lag("close").over(w) / 1e5).alias("l"), ((F.col("close") - F.lag("close").over(w)) / 1e5).alias("d"))
    x = x.withColumns({f"d{i}": F.lag("d", i).over(w) for i in (1, 2)})
    return rounded(unitroot.normal_equations(x, ["k", "l", "d", "d1", "d2"], ["symbol"]), 4)


@query(f"""WITH {DAILY}, e AS (SELECT symbol, close - avg(close) OVER (PARTITION BY symbol) AS e, row_number() OVER ({BY}) AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM days), s AS (SELECT *, sum(e) OVER (PARTITION BY symbol ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM e),
    c AS (SELECT a.symbol, any_value(a.n) AS n, a.rn - b.rn AS i, sum(a.e * b.e) AS c FROM e a JOIN e b ON a.symbol = b.symbol AND b.rn BETWEEN a.rn - 80 AND a.rn GROUP BY a.symbol, a.rn - b.rn),
    h AS (SELECT symbol, any_value(n) AS n, sum(CASE WHEN i = 0 THEN c / n ELSE 2 * c / n END) AS s0, sum(CASE WHEN i > 0 THEN i * 2 * c / n ELSE 0 END) AS s1 FROM c WHERE i <= floor(n ** (2.0 / 9)) GROUP BY symbol),
    l AS (SELECT symbol, n, floor(1.1447 * ((s1 / s0) ** 2) ** (1.0 / 3) * n ** (1.0 / 3))::INT AS lags FROM h), v AS (SELECT symbol, any_value(l.n) AS n, any_value(lags) AS lags, sum(CASE WHEN i = 0 THEN c ELSE 2 * (1 - i / (lags + 1.0)) * c END) / any_value(l.n) AS v FROM c JOIN l USING (symbol) WHERE i <= lags GROUP BY symbol),
    t AS (SELECT symbol, any_value(v.n) AS n, any_value(lags) AS lags, sum(run * run) / (any_value(v.n) ** 2 * any_value(v)) AS stat FROM s JOIN v USING (symbol) GROUP BY symbol)
    SELECT symbol, n, lags, round(stat, 4) + 0.0 AS stat, round(CASE WHEN stat <= 0.347 THEN 0.1 WHEN stat <= 0.463 THEN 0.1 - (stat - 0.347) / 0.116 * 0.05 WHEN stat <= 0.574 THEN 0.05 - (stat - 0.463) / 0.111 * 0.025 WHEN stat <= 0.739 THEN 0.025 - (stat - 0.574) / 0.165 * 0.015 ELSE 0.01 END, 4) + 0.0 AS p FROM t""")
def kpss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(unitroot.kpss(src.order_bars(spark, sf_dir), "close", ["symbol"], "ts"), 4)


@query(f"""WITH {DAILY}, e AS (SELECT symbol, close - avg(close) OVER (PARTITION BY symbol) AS e, row_number() OVER ({BY}) AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM days),
    c AS (SELECT a.symbol, any_value(a.n) AS n, a.rn - b.rn AS i, sum(a.e * b.e) AS c FROM e a JOIN e b ON a.symbol = b.symbol AND b.rn BETWEEN a.rn - 10 AND a.rn GROUP BY a.symbol, a.rn - b.rn), z AS (SELECT symbol, c AS c0 FROM c WHERE i = 0),
    q AS (SELECT symbol, any_value(n) AS n, any_value(n) * (any_value(n) + 2) * sum((c / c0) ** 2 / (n - i)) AS stat FROM c JOIN z USING (symbol) WHERE i > 0 GROUP BY symbol)
    SELECT symbol, n, round(stat, 4) + 0.0 AS stat, round(exp(-stat / 2) * (1 + stat / 2 + (stat / 2) ** 2 / 2 + (stat / 2) ** 3 / 6 + (stat / 2) ** 4 / 24), 4) + 0.0 AS p FROM q""")
def ljung_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(unitroot.ljung_box(src.order_bars(spark, sf_dir), "close", ["symbol"], "ts"), 4)


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours above their mean as events, busy ones as predictions; days number as folds do."""
    w = ordered("symbol")
    x = bars(spark, sf_dir).withColumns({"y": (F.col("close") > mean_n("close", w, 24, 2)).cast("int"), "q": (F.col("volume") >= 2).cast("int")})
    return x.withColumn("at", F.unix_seconds(F.col("ts").cast("timestamp")) / 3600)


_MARKED = f"""{BARS}, m AS (SELECT *, coalesce(close > {mean('close', 24, 2)}, false) AS y, volume >= 2 AS q, epoch(ts) / 3600 AS hr FROM bars), g AS (SELECT *, coalesce(hr - {lag('hr')} > 1, true) AS gap, {lag('y')} AS py, {lag('q')} AS pq FROM m),
    o AS (SELECT *, (y AND (gap OR NOT py))::INT AS oy, (q AND (gap OR NOT pq))::INT AS oq FROM g), i AS (SELECT *, sum(oy) OVER w AS iy, sum(oq) OVER w AS iq FROM o WINDOW w AS ({BY} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


@query(f"""WITH {_MARKED}, p AS (SELECT *, row_number() OVER (PARTITION BY symbol, iy ORDER BY ts) - 1 AS pos FROM i WHERE y), e AS (SELECT symbol, iy, count_if(q) AS k, min(CASE WHEN q THEN pos END) AS lg FROM p GROUP BY 1, 2), t AS (SELECT symbol, iq, max(y::INT) AS t FROM i WHERE q GROUP BY 1, 2),
    a AS (SELECT symbol, count(*) AS events, count(lg) AS detected, avg(lg) AS ml, avg(k) AS mp FROM e GROUP BY 1), b AS (SELECT symbol, count(*) AS predicted, sum(t)::BIGINT AS true_predicted FROM t GROUP BY 1), s AS (SELECT DISTINCT symbol FROM bars)
    SELECT symbol, coalesce(events, 0) AS events, coalesce(detected, 0) AS detected, coalesce(predicted, 0) AS predicted, coalesce(true_predicted, 0) AS true_predicted, {r('detected / nullif(events, 0)', 'recall')}, {r('true_predicted / nullif(predicted, 0)', 'precision')}, {r('ml', 'mean_lag')}, {r('mp', 'mean_predictions')} FROM s LEFT JOIN a USING (symbol) LEFT JOIN b USING (symbol)""")
def event_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of events against runs of predictions; missing hours end runs."""
    return rounded(evaluation.event_overlap(_marked(spark, sf_dir), "y", "q", ["symbol"], "at"))


@query(f"""WITH {_MARKED}, a AS (SELECT symbol, iy AS run, min(ts) AS s, max(ts) AS e FROM i WHERE y GROUP BY 1, 2), b AS (SELECT symbol, iq AS run, min(ts) AS s, max(ts) AS e FROM i WHERE q GROUP BY 1, 2)
    SELECT a.symbol, a.s AS start, a.e AS "end", b.s AS start_b, b.e AS end_b FROM a JOIN b ON a.symbol = b.symbol AND a.s <= b.e AND b.s <= a.e""")
def interval_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of events and of predictions that overlap."""
    w = ordered("symbol")
    here = w.rowsBetween(Window.unboundedPreceding, 0)

    def spans(c: str) -> DataFrame:
        x = _marked(spark, sf_dir).withColumn("_on", F.coalesce(F.col(c) == 1, F.lit(False))).withColumn("_new", F.when(F.col("_on") & (F.coalesce(F.col("at") - F.lag("at").over(w) > 1, F.lit(True)) | ~F.lag("_on").over(w)), 1).otherwise(0))
        return x.withColumn("run", F.sum("_new").over(here)).where("_on").groupBy("symbol", "run").agg(F.min("ts").alias("start"), F.max("ts").alias("end")).drop("run")

    return align.overlap_join(spans("y"), spans("q"), ["symbol"], 6 * 3600)


@query(f"""WITH {BARS}, d AS (SELECT symbol, date_trunc('day', ts) AS day, arg_max(close, ts) AS close FROM bars GROUP BY 1, 2), q AS (SELECT symbol, day, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY day)) AS r FROM d), k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY day) AS k FROM q WHERE r IS NOT NULL),
    m AS (SELECT a.symbol, a.day, a.k, sum((2.0 / 3) ** (a.k - b.k)) AS w, sum((4.0 / 9) ** (a.k - b.k)) AS w2, sum((2.0 / 3) ** (a.k - b.k) * b.r) AS s1, sum((2.0 / 3) ** (a.k - b.k) * b.r * b.r) AS s2 FROM k a JOIN k b ON a.symbol = b.symbol AND b.k <= a.k GROUP BY 1, 2, 3),
    v AS (SELECT q.symbol, q.day, CASE WHEN k >= 2 THEN sqrt(greatest(s2 / w - (s1 / w) ** 2, 0) * w * w / (w * w - w2)) END AS v FROM q LEFT JOIN m ON m.symbol = q.symbol AND m.day = q.day), l AS (SELECT symbol, day, lag(v) OVER (PARTITION BY symbol ORDER BY day) AS v FROM v),
    x AS (SELECT b.symbol, b.ts, v, greatest(least(2.0 * close * v / 0.01, 9000), 100) AS t, greatest(least(1.0 * close * v / 0.01, 9000), 100) AS s, 0.5 * close * v AS arm FROM bars b JOIN l ON l.symbol = b.symbol AND l.day = date_trunc('day', b.ts))
    SELECT symbol, ts, {r('v', 'volatility')}, {r('CASE WHEN v IS NOT NULL THEN t END', 'target_pips')}, {r('CASE WHEN v IS NOT NULL THEN s END', 'stop_pips')}, {r('CASE WHEN v IS NOT NULL THEN t * 0.01 END', 'target')}, {r('CASE WHEN v IS NOT NULL THEN s * 0.01 END', 'stop')}, {r('arm', 'arm')} FROM x""")
def volatility_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets of hours by the weighted deviation of the days before."""
    b = bars(spark, sf_dir)
    days = b.groupBy("symbol", F.date_trunc("day", "ts").alias("ts")).agg(F.max_by("close", "ts").alias("close"))
    days = days.withColumn("ts", F.col("ts").cast(b.schema["ts"].dataType))
    x = labels.volatility_targets(b, days, 5, 2.0, 1.0, 0.5, 0.01, 100.0, 9000.0)
    return rounded(x.select("symbol", "ts", "volatility", "target_pips", "stop_pips", "target", "stop", "arm"))
