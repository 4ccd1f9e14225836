"""Models on Spark ML: classifiers over time folds, calibration, importances; runs of states and fingerprints of windows."""

from __future__ import annotations

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnpike.functions.safe import correlation
from tarnpike.operators.align import quantiles, running_totals
from tarnpike.operators.evaluation import time_folds

LEARNERS = {
    "logistic": lambda **k: LogisticRegression(labelCol="y", weightCol="w", maxIter=50, **k),
    "forest": lambda **k: RandomForestClassifier(labelCol="y", weightCol="w", numTrees=20, maxDepth=4, seed=1, **k),
    "boosted": lambda **k: GBTClassifier(labelCol="y", weightCol="w", maxIter=10, maxDepth=3, seed=1, **k),
}


def weighted(df: DataFrame, y: str) -> DataFrame:
    """With y as double and w: positives weigh as much as negatives in sum."""
    n = df.agg(F.count_if(F.col(y) == 0).alias("_q"), F.count_if(F.col(y) == 1).alias("_p"))
    return df.crossJoin(F.broadcast(n)).withColumn("y", F.col(y).cast("double")).withColumn("w", F.when(F.col("y") == 1, F.col("_q") / F.greatest(F.col("_p"), F.lit(1))).otherwise(1.0)).drop("_p", "_q")


def fit_classifier(train: DataFrame, features: list[str], y: str, learner: str = "logistic") -> PipelineModel:
    """Assembles, scales and fits; rows with nulls in features or label do not count."""
    rows = weighted(train.na.drop(subset=[*features, y]), y)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True), LEARNERS[learner]()]).fit(rows)


def scores(model: PipelineModel, df: DataFrame, features: list[str], out: str = "score") -> DataFrame:
    kept = model.transform(df.na.drop(subset=features)).withColumn(out, vector_to_array("probability")[1])
    return kept.drop("raw", "features", "rawPrediction", "probability", "prediction")


def out_of_fold(df: DataFrame, features: list[str], y: str, order: str, folds: int, embargo: int, learner: str = "logistic") -> DataFrame:
    """(all columns, fold, score): each fold is scored by a model of the rows before it, less the embargo. Folds with one class are skipped.

    Folds and the embargo count distinct values of ``order``, so rows of one time, as those of several symbols, are in one fold.
    """
    times = df.select(F.col(order).alias("_time")).distinct().withColumn("_rn", F.lit(1))
    places = running_totals(times, "_time", ["_rn"]).select("_time", (F.col("_rn_run") - 1).alias("_rn"))
    n = df.join(places, F.col(order).eqNullSafe(F.col("_time"))).drop("_time")
    parts = []
    for f in time_folds(times, folds, embargo, "_time").collect():  # as many rows as folds
        train = n.where(F.col("_rn") <= f.train_until)
        if train.select(y).where(F.col(y).isNotNull()).distinct().count() < 2:
            continue
        model = fit_classifier(train, features, y, learner)
        test = n.where(F.col("_rn").between(f.first_test, f.last_test)).withColumn("fold", F.lit(f.fold))
        parts.append(scores(model, test, features))
    if not parts:  # no fold with two classes before it, or no rows
        return df.where(F.lit(False)).withColumns({"fold": F.lit(None).cast("long"), "score": F.lit(None).cast("double")})
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.drop("_rn")


def platt(df: DataFrame, score: str, y: str) -> PipelineModel | None:
    """A logistic map of the score; none if there is one class."""
    rows = df.where(F.col(y).isNotNull() & F.col(score).isNotNull()).select(F.col(score), F.col(y).cast("double").alias("y"))
    if rows.select("y").distinct().count() < 2:
        return None
    return Pipeline(stages=[VectorAssembler(inputCols=[score], outputCol="features"), LogisticRegression(labelCol="y")]).fit(rows)


def isotonic(df: DataFrame, score: str, y: str):
    rows = df.where(F.col(y).isNotNull() & F.col(score).isNotNull()).select(F.col(score), F.col(y).cast("double").alias("y"))
    return IsotonicRegression(featuresCol=score, labelCol="y").fit(rows)


def _places(rows: DataFrame, key: Column) -> DataFrame:
    """With ``_i``, places from 1 in the order of a key without repeats, numbered by ranges."""
    return running_totals(rows.withColumns({"_k": key, "_one": F.lit(1)}), "_k", ["_one"]).withColumnRenamed("_one_run", "_i").drop("_k", "_one")


def permutation_importance(df: DataFrame, features: list[str], y: str, model: PipelineModel, metric, seed: int = 3) -> list[tuple[str, float]]:
    """By feature: the loss of the metric when its values are dealt anew among the rows, largest first."""
    base = metric(scores(model, df, features))
    rows = df.withColumn("_row", F.monotonically_increasing_id()).persist()
    numbered = _places(rows, F.xxhash64("_row", F.lit(seed)))
    out = []
    for k, f in enumerate(features):
        dealt = _places(rows.select(f, "_row"), F.xxhash64("_row", F.lit(seed + 1 + k))).select(f, "_i")
        out.append((f, base - metric(scores(model, numbered.drop(f).join(dealt, "_i").drop("_i", "_row"), features))))
    rows.unpersist()
    return sorted(out, key=lambda x: (-x[1], x[0]))


def mutual_information(df: DataFrame, feature: str, y: str, bins: int = 10, keys: list[str] | None = None, order: str | None = None) -> DataFrame:
    """(feature, n, mi) in nats between quantile bins of a feature and a label: an estimate by counts.

    With an order, over rows that differ from the one before of their ``keys`` in either; without one, over every row.
    """
    known = F.col(feature).isNotNull() & F.col(y).isNotNull()
    if order:
        w = Window.partitionBy(*(keys or [])).orderBy(order)
        same = F.col(feature).eqNullSafe(F.lag(feature).over(w)) & F.col(y).eqNullSafe(F.lag(y).over(w))
        df = df.where(known).withColumn("_same", same).where(~F.col("_same")).drop("_same")
    edges = quantiles(df, feature, [i / bins for i in range(1, bins)]).select(F.array_distinct("quantiles").alias("_e"))
    x = df.where(known).crossJoin(F.broadcast(edges)).withColumn("_b", F.size(F.filter(F.col("_e"), lambda e: e < F.col(feature))))
    g = x.groupBy("_b", y).agg(F.count("*").alias("_n"))
    all_, row, colm = Window.partitionBy(), Window.partitionBy("_b"), Window.partitionBy(y)
    n = F.sum("_n").over(all_)
    g = g.withColumn("_t", F.col("_n") / n * F.ln(F.col("_n") * n / (F.sum("_n").over(row) * F.sum("_n").over(colm))))
    return g.agg(F.lit(feature).alias("feature"), F.sum("_n").alias("n"), F.sum("_t").alias("mi"))


def correlation_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r) of all pairs of columns, in one aggregation."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    row = df.agg(*(correlation(a, b).alias(f"{a}|{b}") for a, b in pairs))
    long = row.unpivot([], [f"{a}|{b}" for a, b in pairs], "pair", "r")
    return long.select(F.split_part("pair", F.lit("|"), F.lit(1)).alias("a"), F.split_part("pair", F.lit("|"), F.lit(2)).alias("b"), "r")


def correlation_clusters(pairs: DataFrame, columns: list[str], distance: float) -> dict[str, int]:
    """Average linkage on 1 - |r| up to a distance. A column is a number here, not a row: the matrix is of columns by columns, on the driver."""
    d = {c: {c: 0.0} for c in columns}
    for r in pairs.collect():
        d[r.a][r.b] = d[r.b][r.a] = 1 - abs(r.r or 0.0)
    return {c: i for i, g in enumerate(linked(d, columns, distance)) for c in g}


def linked(d: dict[str, dict[str, float]], columns: list[str], distance: float) -> list[list[str]]:
    """Groups of columns by average linkage of their distances."""
    groups = [[c] for c in columns]
    while len(groups) > 1:
        best = min(((np.mean([d[a][b] for a in x for b in y]), i, j) for i, x in enumerate(groups) for j, y in enumerate(groups) if i < j), default=None)
        if best is None or best[0] > distance:
            break
        groups[best[1]] += groups.pop(best[2])
    return groups


# regimes ------------------------------------------------------------------------------------------------------------


def dwell_times(df: DataFrame, state: str, keys: list[str], ts: str) -> DataFrame:
    """(keys, state, spells, mean_length, share): runs of one state."""
    w = Window.partitionBy(*keys).orderBy(ts)
    x = df.withColumn("_new", F.when(F.col(state).eqNullSafe(F.lag(state).over(w)), 0).otherwise(1)).withColumn("_id", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = x.groupBy(*keys, state, "_id").agg(F.count("*").alias("_n"))
    return runs.groupBy(*keys, state).agg(F.count("*").alias("spells"), F.avg("_n").alias("mean_length"), F.sum("_n").alias("_t")).withColumn("share", F.col("_t") / F.sum("_t").over(Window.partitionBy(*keys))).drop("_t")


def fingerprints(df: DataFrame, value: str, keys: list[str], order: str, size: int, step: int) -> DataFrame:
    """(keys, window_id, n, mean, std, low, high, up_share) of overlapping windows of ``size`` rows, each ``step`` rows one. A row names its windows; one aggregation."""
    x = df.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1).withColumn("_d", F.col(value) - F.lag(value).over(Window.partitionBy(*keys).orderBy(order)))
    n = F.count("*").over(Window.partitionBy(*keys))
    first = F.greatest(F.ceil((F.col("_i") - size + 1) / step), F.lit(0))
    last = F.least(F.floor(F.col("_i") / step), F.floor((n - size) / step))
    x = x.withColumn("_a", first).withColumn("_b", last).where("_a <= _b").withColumn("window_id", F.explode(F.sequence("_a", "_b")))
    return x.groupBy(*keys, "window_id").agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("low"), F.max(value).alias("high"), F.avg((F.col("_d") > 0).cast("double")).alias("up_share"))


def nearest_fingerprints(prints: DataFrame, features: list[str], target, n: int) -> DataFrame:
    """The n windows closest to the target ones in z-scores of the features (population deviation; 0 counts as 1)."""
    moments = prints.agg(*(m(f).alias(f"_{n}_{f}") for f in features for n, m in (("m", F.avg), ("s", F.stddev_pop))))  # one row
    z = prints.crossJoin(F.broadcast(moments)).withColumns({f"_{f}": (F.col(f) - F.col(f"_m_{f}")) / F.coalesce(F.nullif(f"_s_{f}", F.lit(0.0)), F.lit(1.0)) for f in features})
    t = z.where(target).agg(*(F.avg(f"_{f}").alias(f"_t{f}") for f in features))
    d = F.sqrt(sum((F.pow(F.col(f"_{f}") - F.col(f"_t{f}"), F.lit(2)) for f in features), F.lit(0.0)))
    return z.where(~target).crossJoin(F.broadcast(t)).withColumn("distance", d).select(*prints.columns, "distance").orderBy("distance").limit(n)
