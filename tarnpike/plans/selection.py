"""Queries on the choice of features and on chance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnpike.functions.safe import ordered, rounded
from tarnpike.operators import elimination, protocol, selection
from tarnpike.plans.market import read
from tarnpike.plans.sql import DAILY, lead, r
from tarnpike.sources import bars as src

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days with three features, whether the next close is higher, and whether the day is in the first half of the week."""
    d = src.order_bars(spark, sf_dir).withColumn("_next", F.lead("close").over(ordered("symbol"))).where("_next is not null")
    return d.select("symbol", "ts", F.col("volume"), (F.col("high") - F.col("low")).alias("range"), (F.col("close") - F.col("open")).alias("body"), (F.col("_next") > F.col("close")).cast("int").alias("y"), (F.weekday("ts") < 3).cast("int").alias("early"))


_FEATURES = ["volume", "range", "body"]
_HASH = "('0x' || substr(md5({p} || '|' || symbol || '|' || epoch_us(ts)), 1, 15))::BIGINT"


@query(f"""WITH {DAILY}, l AS (SELECT *, {lead('close')} AS nx FROM days), r AS (SELECT symbol, ts, volume, high - low AS "range", close - open AS body, (nx > close)::INT AS y, CASE WHEN isodow(ts) <= 3 THEN 'signal' ELSE 'other' END AS bucket FROM l WHERE nx IS NOT NULL),
    b AS (SELECT symbol, ts, row_number() OVER (ORDER BY {_HASH.format(p=0)}) AS k FROM r), p AS (SELECT p, y, row_number() OVER (PARTITION BY p ORDER BY {_HASH.format(p='p')}) AS k FROM r, (SELECT unnest(range(1, 6)) AS p)),
    perm AS (SELECT p, symbol, ts, y AS yp FROM b JOIN p USING (k)),
    f AS (SELECT 0 AS place, 'volume' AS feature, symbol, ts, bucket, y, volume AS x FROM r UNION ALL SELECT 1, 'range', symbol, ts, bucket, y, "range" FROM r UNION ALL SELECT 2, 'body', symbol, ts, bucket, y, body FROM r),
    d AS (SELECT * FROM (SELECT *, lag(x) OVER (PARTITION BY feature, bucket, symbol ORDER BY ts) AS px FROM f) WHERE px IS NULL OR px <> x),
    g AS (SELECT *, floor(10 * (rank() OVER (PARTITION BY feature, bucket ORDER BY x) - 1) / count(*) OVER (PARTITION BY feature, bucket))::INT AS bin FROM d),
    n AS (SELECT place, feature, bucket, 0 AS p, bin, y FROM g UNION ALL SELECT place, feature, bucket, p, bin, yp FROM g JOIN perm USING (symbol, ts)),
    c AS (SELECT place, feature, bucket, p, bin, y, count(*) AS n FROM n GROUP BY ALL),
    t AS (SELECT *, n / sum(n) OVER a * ln(n * sum(n) OVER a / (sum(n) OVER (PARTITION BY feature, bucket, p, bin) * sum(n) OVER (PARTITION BY feature, bucket, p, y))) AS t FROM c WINDOW a AS (PARTITION BY feature, bucket, p)),
    m AS (SELECT place, feature, bucket, p, sum(t) AS mi, sum(n)::BIGINT AS n FROM t GROUP BY ALL), o AS (SELECT place, feature, bucket, max(CASE WHEN p = 0 THEN n END) AS n_eff, max(CASE WHEN p = 0 THEN mi END) AS mi, quantile_cont(mi, 0.95) FILTER (p > 0) AS floor FROM m GROUP BY ALL),
    v AS (SELECT feature, bucket, count(*) >= 50 AND min(x) < max(x) AND min(y) < max(y) AS ok FROM g GROUP BY ALL), i AS (SELECT o.*, ok, ok AND coalesce(mi > floor AND mi >= 0.001, false) AS informative FROM o JOIN v USING (feature, bucket))
    SELECT place, feature, bucket, (SELECT count(*) FROM r WHERE r.bucket = i.bucket) AS n, n_eff, round(CASE WHEN ok THEN mi END, 6) + 0.0 AS mi, round(CASE WHEN ok THEN floor END, 6) + 0.0 AS floor, ok AS evaluable, informative, true AS votes, bool_or(informative OR NOT ok) OVER (PARTITION BY feature) AS kept FROM i""")
def information_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three features of days against the direction of the next one, by first and other days of the week, with given permutations of labels."""
    rows = _rows(spark, sf_dir)
    permuted = selection.permuted_labels(rows, "y", ["symbol"], "ts", 5)
    return rounded(selection.information_filter(rows, _FEATURES, "y", ["symbol"], "ts", F.col("early"), permuted=permuted))


@query()
def information_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the floor drawn from the tables' margins."""
    return rounded(selection.information_filter(_rows(spark, sf_dir), _FEATURES, "y", ["symbol"], "ts", F.col("early")))


@query()
def shifted_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether day features of all series tell the next day's direction better than labels moved along in time."""
    rows = _rows(spark, sf_dir)
    order = F.unix_micros(F.col("ts").cast("timestamp")) * 8 + F.pmod(F.substring("symbol", 1, 1).cast("long"), F.lit(8))  # days, and the series within them
    return rounded(selection.shifted_null(rows.withColumn("at", order), _FEATURES, "y", "at", embargo=5))


@query()
def stable_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes on features of days of all series over rolling years: what goes without making the next day's direction harder to tell."""
    rows = _rows(spark, sf_dir).withColumns({"double_range": 2 * F.col("range"), "weekday": F.weekday("ts")})
    _, votes = elimination.stable_selection(rows, [*_FEATURES, "double_range", "weekday"], "y", "ts", "1995-01-01", 18, 6, 6)
    return rounded(votes)


_WINDOWS = [(i + 1, f"{1995 + i}-01-01", f"{1997 + i}-01-01", f"{1997 + i}-01-06", f"{1998 + i}-01-01") for i in range(4)]


@query(f"""WITH t AS (SELECT l_linenumber::VARCHAR AS arm, l_shipdate AS ts, l_quantity * (l_discount - 0.05) AS p FROM lineitem), w(fold, a, b, c, d) AS (VALUES {', '.join(f"({f}, TIMESTAMP '{a}', TIMESTAMP '{b}', TIMESTAMP '{c}', TIMESTAMP '{d}')" for f, a, b, c, d in _WINDOWS)}),
    x AS (SELECT fold, arm, count_if(ts >= a AND ts < b) AS st, coalesce(sum(p) FILTER (ts >= a AND ts < b), 0) AS sp, count_if(ts >= c AND ts < d) AS tt, coalesce(sum(p) FILTER (ts >= c AND ts < d), 0) AS tp FROM w, t GROUP BY 1, 2),
    n AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY (st >= 200) DESC, CASE WHEN st >= 200 THEN sp ELSE st END DESC, arm) AS k, row_number() OVER (PARTITION BY fold ORDER BY (tt > 0) DESC, tp DESC, arm) AS o FROM x)
    SELECT s.fold, s.arm, CASE WHEN s.st >= 200 THEN 'best_pips' ELSE 'most_trades' END AS reason, s.st AS select_trades, {r('s.sp', 'select_pips')}, s.tt AS test_trades, {r('s.tp', 'test_pips')}, b.arm AS oracle_arm, {r('b.tp', 'oracle_pips')}, {r('b.tp - s.tp', 'regret')} FROM n s JOIN n b ON b.fold = s.fold AND b.o = 1 WHERE s.k = 1""")
def frozen_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line numbers as arms, chosen on two years of lines and measured on the third."""
    t = read(spark, sf_dir, "lineitem").select(F.col("l_linenumber").cast("string").alias("arm"), F.col("l_shipdate").cast("timestamp_ntz").alias("ts"), (F.col("l_quantity") * (F.col("l_discount") - 0.05)).alias("pips"))
    w = spark.createDataFrame(_WINDOWS, "fold int, train_start string, train_end string, test_start string, test_end string")
    w = w.select("fold", *(F.col(c).cast("timestamp_ntz").alias(c) for c in w.columns[1:]))
    return rounded(protocol.frozen_arms(t, w, [str(i) for i in range(1, 8)], 200))


@query("""WITH c AS (SELECT event_type AS model, user_id % 5 AS fold, list(value / 500 ORDER BY ts, event_id) AS c FROM events GROUP BY 1, 2), v AS (SELECT model, fold, CASE WHEN list_max(c) - list_sum(c[len(c) - greatest(1, len(c) // 10) + 1 :]) / greatest(1, len(c) // 10) <= 0.01 THEN 100 ELSE greatest(list_position(c, list_max(c)), 20) END AS vote FROM c)
    SELECT model, CASE WHEN bool_or(vote = 20) AND bool_or(vote = 100) THEN 100 ELSE round_even(quantile_cont(vote, 0.5), 0) END::INT AS rounds, array_to_string(list(vote ORDER BY vote), ',') AS votes FROM v GROUP BY 1""")
def voted_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of events as models, groups of users as folds, their values in time as curves."""
    e = read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("model"), (F.col("user_id") % 5).alias("fold")).agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", (F.col("value") / 500).alias("v"))))["v"].alias("curve"))
    votes = protocol.round_votes(e, 100, 0.01)
    return protocol.voted_rounds(votes, ["model"], 100).withColumn("votes", F.array_join(F.transform("votes", lambda v: v.cast("string")), ","))


@query("""WITH c AS (SELECT event_type AS model, user_id % 5 AS fold, list(value / 500 ORDER BY ts, event_id) AS c FROM events GROUP BY 1, 2), n AS (SELECT model, min(len(c)) AS n FROM c GROUP BY 1), x AS (SELECT model, unnest(range(1, n + 1)) AS i, c FROM c JOIN n USING (model))
    SELECT model, i::INT AS round, round(avg(c[i]), 6) + 0.0 AS value, count(*) AS folds FROM x GROUP BY 1, 2""")
def mean_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("model"), (F.col("user_id") % 5).alias("fold")).agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", (F.col("value") / 500).alias("v"))))["v"].alias("curve"))
    return rounded(protocol.mean_curves(e, ["model"]))
