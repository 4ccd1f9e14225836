"""Queries on market regimes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnpike.functions.safe import rounded
from tarnpike.operators import models, regimes
from tarnpike.plans.market import bars
from tarnpike.plans.sql import BARS, BY, DAILY, lead
from tarnpike.sources import bars as src

QUERIES, ORACLE_SQL = {}, {}
YEAR = 366 * 86400


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regimes.observations(src.order_bars(spark, sf_dir))


@query()
def hidden_markov_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hidden Markov model of two states for each symbol: means in plain units, moves and the log likelihood, states in order of their meaning."""
    chunks = regimes.scaled_chunks(_observed(spark, sf_dir), regimes.OBSERVED, ["symbol"], "ts", YEAR)
    units = {r.symbol: r for r in chunks.select("symbol", "n", "mean", "scale").distinct().collect()}  # a row a symbol
    rows = []
    for ((symbol,), k), m in regimes.fit_models(chunks, ["symbol"], len(regimes.OBSERVED), "hmm", [2], rounds=15, restarts=2).items():
        means = m.means * units[symbol].scale + units[symbol].mean
        order, trend, vol = regimes.meaning(means)
        rows += [(symbol, place, units[symbol].n, float(m.start[s]), float(m.move[s, s]), *map(float, means[s]), float(trend[place]), float(vol[place]), float(m.value)) for place, s in enumerate(order)]
    observed = ", ".join(f"{c} double" for c in regimes.OBSERVED)
    return rounded(spark.createDataFrame(rows, f"symbol string, state int, n long, start double, stay double, {observed}, trend_score double, vol_score double, loglik double"), 4)


@query()
def regime_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of the states of a mixture for each symbol; all mixtures are fitted together."""
    scored = regimes.regime_scores(_observed(spark, sf_dir), regimes.OBSERVED, ["symbol"], "ts", YEAR, "mixture", 3, rounds=40)
    return models.dwell_times(scored.where("rgm_label is not null").withColumnRenamed("rgm_label", "state"), "state", ["symbol"], "ts")


@query()
def regime_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixtures of two to six states for each symbol by information criteria and silhouette."""
    return rounded(regimes.select_states(_observed(spark, sf_dir), regimes.OBSERVED, ["symbol"], "ts", YEAR, "mixture", [2, 3, 4, 5, 6], rounds=40, restarts=2), 4)


@query()
def regime_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities, label and scores of k-means states of each day, with soft assignment."""
    scored = regimes.regime_scores(_observed(spark, sf_dir), regimes.OBSERVED, ["symbol"], "ts", YEAR, "kmeans", 3)
    return rounded(scored.select("symbol", "ts", *(c for c in scored.columns if c.startswith("rgm_"))), 4)


@query(f"""WITH RECURSIVE {BARS}, x AS MATERIALIZED (SELECT symbol, ts, ln(close) AS x, row_number() OVER ({BY}) AS i FROM bars),
    g AS (SELECT symbol, i, 0.9 * a + 0.1 * b AS a, 0.1 * a + 0.9 * b AS b, ts FROM (SELECT symbol, 0::BIGINT AS i, 0.5::DOUBLE AS a, 0.5::DOUBLE AS b, NULL::TIMESTAMP AS ts FROM (SELECT DISTINCT symbol FROM x))
        UNION ALL SELECT symbol, i, 0.9 * a + 0.1 * b, 0.1 * a + 0.9 * b, ts FROM (
            SELECT symbol, i, ts, p / (p + q) AS a, q / (p + q) AS b FROM (SELECT x.symbol, x.i, x.ts, g.a * exp(-0.5 * (x.x - 3) ** 2) AS p, g.b * exp(-0.5 * ((x.x - 5) / 0.5) ** 2) / 0.5 AS q FROM g JOIN x ON x.symbol = g.symbol AND x.i = g.i + 1)))
    SELECT symbol, ts, round((a - 0.1) / 0.8, 6) + 0.0 AS calm, round((b - 0.1) / 0.8, 6) + 0.0 AS wild FROM g WHERE ts IS NOT NULL""")
def hidden_markov_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = bars(spark, sf_dir).select("symbol", "ts", F.ln("close").alias("x"))
    out = regimes.markov_filter(x, "x", ["symbol"], "ts", [3.0, 5.0], [1.0, 0.5], 0.9, 7 * 86400)
    return rounded(out.select("symbol", "ts", F.get("prob", F.lit(0)).alias("calm"), F.get("prob", F.lit(1)).alias("wild")))


_RULED = f"""{DAILY}, d AS (SELECT symbol, ts, close, CASE WHEN close > avg(close) OVER (PARTITION BY symbol) THEN 1 ELSE 0 END AS state, ln({lead('close')} / close) AS nx FROM days),
    n AS (SELECT *, CASE WHEN lag(state) OVER ({BY}) IS NOT DISTINCT FROM state THEN 0 ELSE 1 END AS new FROM d)"""


@query(f"""WITH {_RULED}, w AS (SELECT symbol, count(*) / sum(new) AS dwell FROM n GROUP BY 1)
    SELECT symbol, state, count(nx) AS n, round(1e4 * avg(nx), 4) + 0.0 AS fwd_ret_bp, round(1e4 * stddev_samp(nx), 4) + 0.0 AS fwd_vol_bp, round(any_value(dwell), 4) + 0.0 AS dwell FROM n JOIN w USING (symbol) WHERE nx IS NOT NULL GROUP BY 1, 2""")
def state_economics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Next day's return by state: days above or below the symbol's mean close."""
    d = src.order_bars(spark, sf_dir)
    mean = d.groupBy("symbol").agg(F.avg("close").alias("_m"))
    x = d.join(mean, "symbol").withColumn("state", F.when(F.col("close") > F.col("_m"), 1).otherwise(0))
    return rounded(regimes.state_economics(x, "state", "close", ["symbol"], "ts"), 4)


@query(f"""WITH {DAILY}, x AS (SELECT abs(ln(close / open)) AS s FROM days) SELECT round(quantile_cont(s, 0.4), 6) + 0.0 AS threshold FROM x""")
def share_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The size of a day's move that six of ten days reach."""
    return rounded(regimes.share_threshold(src.order_bars(spark, sf_dir).withColumn("s", F.ln(F.col("close") / F.col("open"))), "s", 0.6))
