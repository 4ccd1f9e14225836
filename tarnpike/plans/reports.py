"""Queries on calendars, external series and the tables behind reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnpike.functions.safe import mean_n, ordered, rounded
from tarnpike.operators import indicators, research
from tarnpike.plans.market import bars, read
from tarnpike.plans.results import _SCORED, _scored
from tarnpike.plans.sql import BARS, BY, ahead, div, gated, lag, mean, over, r, ranked, with_atr, with_wilder

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(f"""WITH {BARS}, e AS (SELECT DISTINCT date_trunc('day', ts)::TIMESTAMP AS d FROM events WHERE value > 400), x AS (SELECT b.symbol, b.ts, date_diff('day', date_trunc('day', b.ts), n.d)::DOUBLE AS u, date_diff('day', p.d, date_trunc('day', b.ts))::DOUBLE AS s FROM bars b ASOF LEFT JOIN e p ON date_trunc('day', b.ts) >= p.d ASOF LEFT JOIN e n ON date_trunc('day', b.ts) <= n.d)
    SELECT symbol, ts, u AS cb_until, s AS cb_since, {r('1 / (1 + u)', 'cb_proximity')}, {r('1 / (1 + s)', 'cb_recency')}, round(CASE WHEN u IS NOT NULL AND s IS NOT NULL THEN CASE WHEN s = 0 THEN 1 ELSE s / nullif(s + u, 0) END END, 6) + 0.0 AS cb_cycle, (u BETWEEN 1 AND 2)::INT AS cb_pre, (s BETWEEN 1 AND 2)::INT AS cb_post FROM x""")
def event_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").where("value > 400").select(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"))
    x = research.event_clock(bars(spark, sf_dir), e, "cb")
    return rounded(x.select("symbol", "ts", *(f"cb_{k}" for k in ("until", "since", "proximity", "recency", "cycle", "pre", "post"))))


_CLOCK = "CASE WHEN event_type < 'p' THEN 'ecb' ELSE 'fed' END"
_PRE, _POST = "{0}_u BETWEEN 1 AND 3", "{0}_s BETWEEN 1 AND 3"
_CYCLE = "CASE WHEN {0}_u IS NOT NULL AND {0}_s IS NOT NULL THEN CASE WHEN {0}_u + {0}_s = 0 THEN 1 ELSE {0}_s / ({0}_u + {0}_s) END END"


def _ev(score: str, cond: str) -> str:
    return f"CASE WHEN ({score}) IS NULL OR ({cond}) IS NULL THEN NULL WHEN {cond} THEN {score} ELSE 0 END"


def _of_clock(e: str) -> str:
    pre, post, u, s = _PRE.format(e), _POST.format(e), f"{e}_u", f"{e}_s"
    return ", ".join(r(x, f"{e}_{n}") for n, x in {"prox_intraday": f"1 / (1 + {e}_h / 24.0)", "pre_ramp": _ev(f"1 / (1 + {u})", pre), "post_ramp": _ev(f"1 / (1 + {s})", post), "pre_momo": _ev("mv", pre), "day_momo": _ev("mv", f"{u} = 0"), "post_cont": _ev("mv", post), "pre_squeeze": f"CASE WHEN k IS NOT NULL AND {u} IS NOT NULL THEN {_ev('mv', f'{pre} AND k <= 20')} END", "post_event_cont": _ev(f"{e}_z", post)}.items())


@query(f"""WITH RECURSIVE {with_wilder(3)}, e AS (SELECT {_CLOCK} AS clock, ts FROM events WHERE value > 300), m AS (SELECT *, ts::DATE AS d, (close - {lag('close', 3)}) / nullif(atr, 0) AS mv0, {gated('max(high)', 'high', over(6), 6)} - {gated('min(low)', 'low', over(6), 6)} AS g FROM a),
    q AS (SELECT *, list(g) OVER {over(40)} AS g_list FROM m), x AS (SELECT *, lag(mv0) OVER ({BY}) AS mv, lag(k0) OVER ({BY}) AS k FROM (SELECT *, {ranked('g', 20)} AS k0 FROM q)),
    dy AS (SELECT symbol, d, ln(arg_max(close, ts) / nullif(arg_min(open, ts), 0)) AS rt FROM m GROUP BY 1, 2), dz AS (SELECT symbol, d, rt / nullif(CASE WHEN count(rt) OVER v >= 5 THEN stddev_samp(rt) OVER v END, 0) AS z FROM dy WINDOW v AS (PARTITION BY symbol ORDER BY d ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)),
    c AS (SELECT x.symbol, x.ts, x.d, x.mv, x.k, {', '.join(f"(SELECT min(ts::DATE) FROM e WHERE clock = '{e}' AND ts::DATE >= x.d) - x.d AS {e}_u, x.d - (SELECT max(ts::DATE) FROM e WHERE clock = '{e}' AND ts::DATE <= x.d) AS {e}_s, (epoch((SELECT min(ts) FROM e WHERE clock = '{e}' AND ts >= x.ts)) - epoch(x.ts)) / 3600.0 AS {e}_h" for e in ('ecb', 'fed'))} FROM x),
    f AS (SELECT c.*, p.z AS ecb_z, o.z AS fed_z FROM c LEFT JOIN dz p ON p.symbol = c.symbol AND p.d = c.d - ecb_s::INT LEFT JOIN dz o ON o.symbol = c.symbol AND o.d = c.d - fed_s::INT)
    SELECT symbol, ts, {_of_clock('ecb')}, {_of_clock('fed')}, {r('1 / (1 + ecb_u) - 1 / (1 + fed_u)', 'ecb_fed_convergence')}, {r(f"({_CYCLE.format('ecb')}) - ({_CYCLE.format('fed')})", 'ecb_fed_cycle_diff')} FROM f""")
def calendar_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large events as decisions of two clocks."""
    e = read(spark, sf_dir, "events").where("value > 300").select(F.when(F.col("event_type") < "p", "ecb").otherwise("fed").alias("clock"), "ts")
    x = research.calendar_direction(bars(spark, sf_dir), e, ["ecb", "fed"], 3, (6, 40), 10)
    kinds = ("prox_intraday", "pre_ramp", "post_ramp", "pre_momo", "day_momo", "post_cont", "pre_squeeze", "post_event_cont")
    return rounded(x.select("symbol", "ts", *(f"{c}_{k}" for c in ("ecb", "fed") for k in kinds), "ecb_fed_convergence", "ecb_fed_cycle_diff"))


@query("""WITH d AS (SELECT DISTINCT ts::DATE AS day FROM events), e AS (SELECT ts::DATE AS day, count(*) AS n FROM events WHERE value > 200 GROUP BY 1), x AS (SELECT d.day, coalesce(n, 0) AS n FROM d LEFT JOIN e ON d.day = e.day)
    SELECT day::TIMESTAMP AS day, n AS events, CASE WHEN count(*) OVER w = 3 THEN sum(n) OVER w END::BIGINT AS density FROM x WINDOW w AS (ORDER BY day ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)""")
def event_day_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    x = research.day_counts(e.where("value > 200"), e.select(F.to_date("ts").alias("day")).distinct(), 3)
    return x.withColumn("day", F.col("day").cast("timestamp_ntz"))


_WEEKLY = "w AS (SELECT date_trunc('week', l_shipdate)::DATE AS date, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END)::DOUBLE AS a, sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END)::DOUBLE AS b, sum(l_quantity)::DOUBLE AS c FROM lineitem GROUP BY 1)"


def _weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = lambda f: F.sum(F.when(F.col("l_returnflag") == f, F.col("l_quantity")).otherwise(0)).cast("double")
    return read(spark, sf_dir, "lineitem").groupBy(F.to_date(F.date_trunc("week", "l_shipdate")).alias("date")).agg(q("R").alias("a"), q("A").alias("b"), F.sum("l_quantity").cast("double").alias("c"))


@query(f"""WITH {_WEEKLY}, n AS (SELECT date, (a - b) / nullif(c, 0) AS p FROM w), x AS (SELECT *, p - lag(p) OVER (ORDER BY date) AS ch, coalesce(list(p) OVER (ORDER BY date ROWS BETWEEN 51 PRECEDING AND 1 PRECEDING), []) AS l FROM n)
    SELECT (date + 3)::TIMESTAMP AS date, {r('p', 'net_position')}, {r('ch', 'net_change')}, round(CASE WHEN p IS NOT NULL AND len(list_filter(l, lambda v: v IS NOT NULL)) >= 25 THEN 100.0 * len(list_filter(l, lambda v: v < p)) / len(list_filter(l, lambda v: v IS NOT NULL)) END, 6) + 0.0 AS position_index FROM x""")
def positioning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(research.positioning(_weekly(spark, sf_dir), "a", "b", "c")).withColumn("date", F.col("date").cast("timestamp_ntz"))


@query(f"""WITH {_WEEKLY}, x AS (SELECT *, coalesce(list(c) OVER (ORDER BY date ROWS BETWEEN 39 PRECEDING AND 1 PRECEDING), []) AS l FROM w) SELECT date::TIMESTAMP AS date, c, {r('c - lag(c) OVER (ORDER BY date)', 'change')}, round(CASE WHEN len(l) >= 19 THEN 100.0 * len(list_filter(l, lambda v: v < c)) / len(l) END, 6) + 0.0 AS percentile,
    {r(div('c - ' + gated('avg(c)', 'c', '(ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)', 10), gated('stddev_samp(c)', 'c', '(ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)', 10)), 'zscore')} FROM x""")
def level_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = research.level_features(_weekly(spark, sf_dir).select("date", "c"), "c", 40, 20)
    return rounded(x).withColumn("date", F.col("date").cast("timestamp_ntz"))


def _z(x: str) -> str:
    f = "(ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)"
    return div(f"{x} - {gated(f'avg({x})', x, f, 15)}", gated(f"stddev_samp({x})", x, f, 15))


@query(f"""WITH {_WEEKLY}, d AS (SELECT date, a - b AS diff FROM w), e AS (SELECT *, diff - lag(diff, 5) OVER (ORDER BY date) AS c5, diff - lag(diff, 20) OVER (ORDER BY date) AS c20 FROM d)
    SELECT date::TIMESTAMP AS date, {r('diff', 'diff')}, {r('c5', 'diff_chg5')}, {r('c20', 'diff_chg20')}, {r(_z('diff'), 'diff_z')}, {r(_z('c5'), 'diff_chg5_z')}, {r(_z('c20'), 'diff_chg20_z')} FROM e""")
def spread_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = research.spread_features(_weekly(spark, sf_dir), "a", "b", 30).drop("a", "b", "c")
    return rounded(x).withColumn("date", F.col("date").cast("timestamp_ntz"))


@query(f"""WITH {with_atr(14)}, g AS (SELECT *, coalesce(list({{'h': high, 'l': low}}) OVER {ahead(5)}, []) AS w, max(high) OVER {ahead(5)} - close AS mfe FROM a), f AS (SELECT *, coalesce(list_position(list_transform(w, lambda b: coalesce(b.h >= close + atr, false)), true), 0) AS u, coalesce(list_position(list_transform(w, lambda b: coalesce(b.l <= close - atr, false)), true), 0) AS d FROM g)
    SELECT symbol, ts, CASE WHEN len(w) > 0 AND atr IS NOT NULL THEN (u > 0 AND (d = 0 OR u < d))::INT END AS fast_long, CASE WHEN len(w) > 0 AND atr IS NOT NULL THEN (d > 0 AND (u = 0 OR d < u))::INT END AS fast_short, CASE WHEN volume >= 5 AND mfe IS NOT NULL THEN coalesce(mfe >= 100 OR mfe >= 0.8 * atr, false)::INT END AS setup FROM f""")
def excursion_race(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = research.excursion_race(indicators.atr_mean(bars(spark, sf_dir), 14), "atr_mean_14", 5)
    return research.valid_setups(x, F.col("volume") >= 5, 5, 100, 1.0, "atr_mean_14", 0.8).select("symbol", "ts", "fast_long", "fast_short", "setup")


@query(f"""WITH {_SCORED}, x AS (SELECT lang, CASE WHEN doc_id % 2 = 0 THEN 'even' ELSE 'odd' END AS half, y, (p >= 0.5)::INT AS q FROM s), g AS (SELECT lang, half, grouping(lang) AS gl, grouping(half) AS gh, count(*) AS n, count_if(y = 1 AND q = 1)::BIGINT AS tp, count_if(y = 0 AND q = 1)::BIGINT AS fp, count_if(y = 1 AND q = 0)::BIGINT AS fn FROM x GROUP BY GROUPING SETS ((), (lang), (half)))
    SELECT CASE WHEN gh = 0 THEN 'half' WHEN gl = 0 THEN 'lang' ELSE 'overall' END AS scope, CASE WHEN gh = 0 THEN half WHEN gl = 0 THEN lang ELSE 'all' END AS value, n, tp, fp, fn, {r('tp / nullif(tp + fp, 0)', '"precision"')}, {r('tp / nullif(tp + fn, 0)', 'recall')} FROM g""")
def grouped_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _scored(spark, sf_dir).withColumn("half", F.when(F.col("doc_id") % 2 == 0, "even").otherwise("odd")).withColumn("q", (F.col("p") >= 0.5).cast("int"))
    return rounded(research.grouped_metrics(x, "y", "q", ["lang", "half"]))


@query("""SELECT o_orderdate AS ts, arg_max(o_totalprice, o_orderkey) FILTER (o_orderstatus = 'F') AS "F", arg_max(o_totalprice, o_orderkey) FILTER (o_orderstatus = 'O') AS "O" FROM orders GROUP BY 1""")
def probability_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return research.probability_table(read(spark, sf_dir, "orders").withColumnRenamed("o_orderdate", "ts"), "ts", "o_orderstatus", "o_totalprice", "o_orderkey", ["F", "O"])


@query(f"""WITH {_SCORED}, e AS (SELECT lang, doc_id % 4 AS p, CASE WHEN var_pop(p) > 0 AND var_pop(y) > 0 THEN corr(p, y) END AS r, count(*) AS n FROM s GROUP BY 1, 2 HAVING count(*) >= 10), m AS (SELECT *, sign(avg(r) OVER (PARTITION BY lang)) AS m FROM e) SELECT lang, count(*) AS periods, {r('avg(CASE WHEN r IS NOT NULL THEN (sign(r) = m)::INT END)', 'same_sign')} FROM m GROUP BY 1""")
def sign_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(research.sign_stability(_scored(spark, sf_dir), "p", "y", F.col("doc_id") % 4, ["lang"]))


@query(f"""WITH {_SCORED}, g AS (SELECT lang, least(floor(p * 10), 9)::INT AS bin, count(*) AS n FROM s WHERE p BETWEEN 0 AND 1 GROUP BY 1, 2) SELECT lang, bin, n, {r('n / sum(n) OVER (PARTITION BY lang)', 'share')} FROM g""")
def probability_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(research.probability_histogram(_scored(spark, sf_dir), "p", ["lang"]))


@query("""SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS month, round(coalesce(sum(o_totalprice) FILTER (o_orderstatus = 'F'), 0), 2) + 0.0 AS "F", round(coalesce(sum(o_totalprice) FILTER (o_orderstatus = 'O'), 0), 2) + 0.0 AS "O" FROM orders GROUP BY 1""")
def monthly_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(research.monthly_matrix(read(spark, sf_dir, "orders"), "o_orderstatus", "o_orderdate", "o_totalprice", ["F", "O"]), 2)


@query("SELECT event_id, (props->>'k')::DOUBLE AS value, 'k' AS metric FROM events WHERE TRY_CAST(props->>'k' AS DOUBLE) IS NOT NULL")
def flat_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return research.flat_metrics(read(spark, sf_dir, "events"), ["event_id"], "props")


@query("""WITH a AS (SELECT c_custkey, c_acctbal AS v FROM customer WHERE c_custkey % 5 <> 0), b AS (SELECT c_custkey, c_acctbal + CASE WHEN c_custkey % 7 = 0 THEN 1 ELSE 0 END AS v FROM customer WHERE c_custkey % 3 <> 0)
    SELECT coalesce(a.c_custkey, b.c_custkey) AS c_custkey, 'v' AS "column", round(a.v, 2) + 0.0 AS "left", round(b.v, 2) + 0.0 AS "right" FROM a FULL JOIN b ON a.c_custkey = b.c_custkey WHERE a.v IS NULL OR b.v IS NULL OR abs(a.v - b.v) > 0.5""")
def parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("v"))
    b = c.where("c_custkey % 3 <> 0").withColumn("v", F.col("v") + F.when(F.col("c_custkey") % 7 == 0, 1).otherwise(0))
    return rounded(research.parity(c.where("c_custkey % 5 <> 0"), b, ["c_custkey"], ["v"], 0.5), 2)


@query(f"""WITH {_SCORED}, x AS (SELECT lang, y, (p >= 0.5)::INT AS q FROM s), g AS (SELECT lang, count(*) AS n, avg((y = q)::INT) AS a, avg(y) AS ya, avg(q) AS qa FROM x GROUP BY 1) SELECT lang, n, {r('a', 'agreement')}, {r('(a - (ya * qa + (1 - ya) * (1 - qa))) / nullif(1 - (ya * qa + (1 - ya) * (1 - qa)), 0)', 'kappa')} FROM g""")
def cohen_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(research.cohen_kappa(_scored(spark, sf_dir).withColumn("q", (F.col("p") >= 0.5).cast("int")), "y", "q", ["lang"]))


@query(f"""WITH {BARS}, x AS (SELECT *, lag(close) OVER ({BY}) AS l, close - lag(close) OVER ({BY}) AS d, close - lag(close, 5) OVER ({BY}) AS q, close - avg(close) OVER (PARTITION BY symbol) AS e, {mean('close', 50)} AS m FROM bars), y AS (SELECT *, sum(e) OVER ({BY} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM x),
    g AS (SELECT symbol, count(*) AS n, regr_slope(d, l) AS b, regr_sxx(d, l) AS sxx, regr_syy(d, l) AS syy, regr_count(d, l) AS k, var_pop(d) AS vd, var_pop(q) AS vq, sum(s * s) AS ss, sum(e * e) AS ee, max(m) - min(m) AS rg, stddev_samp(close) AS sd FROM y GROUP BY 1), z AS (SELECT *, b / nullif(sqrt((syy - b * b * sxx) / (k - 2) / sxx), 0) AS t, ss / (n::DOUBLE * ee) AS kp FROM g)
    SELECT symbol, n, {r('t', 'df_stat')}, {r('vq / (5 * vd)', 'variance_ratio')}, {r('kp', 'kpss')}, {r('rg / sd', 'mean_drift')}, CASE WHEN t < -2.86 AND kp < 0.463 THEN 'stationary' WHEN NOT t < -2.86 AND NOT kp < 0.463 THEN 'non-stationary' ELSE 'inconclusive' END AS verdict FROM z""")
def stationarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(research.stationarity_verdict(research.stationarity(bars(spark, sf_dir), "close", ["symbol"], "ts")))


@query(f"""WITH {BARS}, s AS (SELECT symbol, ts, {mean('close', 6)} AS f, {mean('close', 24)} AS m FROM bars) SELECT symbol, ts, {r('(tanh((f - m) / 50) + tanh((m - 150) / 80)) / 2', 'mtf_agreement')}, CASE WHEN (f - m) / 20 < -0.4307 THEN 'low' WHEN (f - m) / 20 > 0.4307 THEN 'high' WHEN f - m IS NOT NULL THEN 'mid' END AS bucket FROM s""")
def timeframe_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = ordered("symbol")
    x = bars(spark, sf_dir).withColumn("m", mean_n("close", w, 24)).withColumn("f", mean_n("close", w, 6) - F.col("m")).withColumn("g", F.col("m") - 150).withColumn("z", F.col("f") / 20)
    x = research.agreement(x, {"f": 50.0, "g": 80.0})
    return rounded(x.select("symbol", "ts", "mtf_agreement", research.terciles(x, "z").alias("bucket")))


@query("""WITH a AS (SELECT o_custkey, avg(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_custkey, avg(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'O' GROUP BY 1), d AS (SELECT a.v - b.v AS d FROM a JOIN b USING (o_custkey))
    SELECT count(*) AS n, round(avg(d), 3) + 0.0 AS mean, round(stddev_samp(d), 3) + 0.0 AS std, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 3) + 0.0 AS t FROM d""")
def paired_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = lambda s: read(spark, sf_dir, "orders").where(F.col("o_orderstatus") == s).groupBy("o_custkey").agg(F.avg("o_totalprice").alias("v"))
    return rounded(research.paired_delta(g("F"), g("O"), ["o_custkey"], "v"), 3)
