"""Which features tell something: mutual information against a floor of chance, and out-of-sample scores against shifted labels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnpike.operators.align import running_totals
from tarnpike.operators.evaluation import time_folds

#: ranges that a group's values are cut into, so that no task orders a whole group
RANGES = 64
#: tables of more rows than this draw their chance from the limit distribution
DRAWN = 10**9
#: steps that scores are told apart by in an area under the curve
STEPS = 10_000


def rank_bins(df: DataFrame, groups: list[str], x: str, bins: int, out: str = "bin") -> DataFrame:
    """With ``out``: floor(bins * rows of the group below / rows of the group), so that equal values share a bin. Null values have none.

    Values are counted, cut into ranges by approximate quantiles, and ranked within ranges; the ranges before add their counts.
    """
    known = df.where(F.col(x).isNotNull())
    counts = known.groupBy(*groups, x).agg(F.count("*").alias("_n"))
    edges = counts.groupBy(*groups).agg(F.percentile_approx(x, [i / RANGES for i in range(1, RANGES)]).alias("_edges"), F.sum("_n").alias("_all"))
    same = lambda a, b: a.join(b.withColumnsRenamed({g: f"_r_{g}" for g in groups}), [F.col(g).eqNullSafe(F.col(f"_r_{g}")) for g in groups]).drop(*(f"_r_{g}" for g in groups))
    cut = same(counts, edges).withColumn("_range", F.size(F.filter("_edges", lambda e: e < F.col(x)))).drop("_edges")
    before = Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # at most RANGES rows
    ranges = cut.groupBy(*groups, "_range").agg(F.sum("_n").alias("_m")).withColumn("_lower", F.coalesce(F.sum("_m").over(before), F.lit(0))).drop("_m")
    within = Window.partitionBy(*groups, "_range").orderBy(x).rowsBetween(Window.unboundedPreceding, -1)
    placed = cut.withColumn("_below", F.coalesce(F.sum("_n").over(within), F.lit(0)))
    placed = placed.join(ranges.withColumnsRenamed({g: f"_r_{g}" for g in (*groups, "_range")}), [F.col(g).eqNullSafe(F.col(f"_r_{g}")) for g in (*groups, "_range")])
    found = placed.select(*groups, F.col(x).alias("_x"), F.floor(bins * (F.col("_below") + F.col("_lower")) / F.col("_all")).cast("int").alias(out))
    renamed = found.withColumnsRenamed({g: f"_r_{g}" for g in groups})
    return df.join(renamed, [*(F.col(g).eqNullSafe(F.col(f"_r_{g}")) for g in groups), F.col(x) == F.col("_x")], "left").drop("_x", *(f"_r_{g}" for g in groups))


def information(df: DataFrame, groups: list[str], bin_: str, y: str) -> DataFrame:
    """(groups, n, mi): mutual information in nats of two columns by their counts."""
    g = df.groupBy(*groups, bin_, y).agg(F.count("*").alias("_n"))
    of = lambda *more: F.sum("_n").over(Window.partitionBy(*groups, *more))
    g = g.withColumn("_t", F.col("_n") / of() * F.ln(F.col("_n") * of() / (of(bin_) * of(y))))
    return g.groupBy(*groups).agg(F.sum("_n").alias("n"), F.sum("_t").alias("mi"))


def _table_information(tables: np.ndarray) -> np.ndarray:
    """Mutual information of each of several tables of counts."""
    n = tables.sum((1, 2), keepdims=True)
    expected = tables.sum(1, keepdims=True) * tables.sum(2, keepdims=True) / n
    with np.errstate(divide="ignore", invalid="ignore"):
        terms = np.where(tables > 0, tables / n * np.log(tables / expected), 0.0)
    return terms.sum((1, 2))


def chance_information(rows: np.ndarray, columns: np.ndarray, draws: int, seed: int) -> np.ndarray:
    """Mutual information of ``draws`` tables with these margins: what shuffled labels give. A shuffle of labels among rows that are in bins
    is a draw without replacement, bin by bin, so that no row need be moved."""
    r = np.random.default_rng(seed)
    n = int(rows.sum())
    if n > DRAWN:
        return r.chisquare((len(rows) - 1) * (len(columns) - 1), draws) / (2 * n)
    tables = np.zeros((draws, len(rows), len(columns)))
    for d in range(draws):
        left = columns.astype(np.int64).copy()
        for i, m in enumerate(rows[:-1]):
            tables[d, i] = r.multivariate_hypergeometric(left, int(m), method="marginals")
            left -= tables[d, i].astype(np.int64)
        tables[d, -1] = left
    return _table_information(tables)


def _chance(draws: int, seed: int, groups: list[str]):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = [(*(r[g] for g in groups), float(np.percentile(chance_information(np.array(r["bins"]), np.array(r["labels"]), draws, seed), 95))) for r in p.to_dict("records")]
            yield pd.DataFrame(rows, columns=[*groups, "floor"])

    return run


def information_filter(
    df: DataFrame, features: list[str], y: str, keys: list[str], order: str, regime: Column | None = None, bins: int = 10, draws: int = 20, least: int = 50, least_mi: float = 0.001, seed: int = 42, permuted: DataFrame | None = None,
) -> DataFrame:
    """(place, feature, bucket, n, n_eff, mi, floor, evaluable, informative, votes, kept): each feature in each bucket of rows.

    Rows count that know all features and the label. Where ``regime`` is above one half a row is in the bucket signal, else (and where it is unknown) in other; without a
    regime, or with fewer than 50 rows in either, all are in one. Runs of equal values of a feature in a series count once. The feature's information with the label
    is compared with the 95th percentile of ``draws`` shuffles of the labels, drawn from the table's margins, or with the labels of ``permuted`` (permutation, keys, order, label).
    A feature with fewer than ``least`` values left, one value or one label is not evaluable. A bucket with one label has no vote. A feature is kept if any voting
    bucket finds it informative (above the floor and ``least_mi``) or cannot evaluate it, or if no bucket votes. ``place`` is the feature's place in the list given.
    """
    known = df.where(F.forall(F.array(*(F.col(c).isNotNull() for c in (*features, y))), lambda c: c))
    known = known.withColumn("bucket", F.lit("all") if regime is None else F.when(F.coalesce(regime > 0.5, F.lit(False)), "signal").otherwise("other"))
    if regime is not None:
        sizes = known.groupBy("bucket").count().collect()  # two rows
        if len(sizes) < 2 or min(r["count"] for r in sizes) < 50:
            known = known.withColumn("bucket", F.lit("all"))
    pair = F.explode(F.array(*(F.struct(F.lit(i).alias("place"), F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for i, f in enumerate(features)))).alias("_f")
    long = known.select(*keys, order, F.col(y).alias("y"), "bucket", pair).select(*keys, order, "y", "bucket", "_f.*")
    w = Window.partitionBy(*keys, "bucket", "feature").orderBy(order)
    fresh = long.withColumn("_before", F.lag("x").over(w)).where(F.col("_before").isNull() | (F.col("_before") != F.col("x"))).drop("_before")
    groups = ["place", "feature", "bucket"]
    binned = rank_bins(fresh, groups, "x", bins)
    scored = information(binned, groups, "bin", "y")
    checks = binned.groupBy(*groups).agg((F.min("x") < F.max("x")).alias("_varies"), (F.min("y") < F.max("y")).alias("_labels"))
    if permuted is None:
        margin = lambda c: binned.groupBy(*groups, c).agg(F.count("*").alias("_n")).groupBy(*groups).agg(F.sort_array(F.collect_list(F.struct(c, "_n")))["_n"].alias("_m"))
        margins = margin("bin").withColumnRenamed("_m", "bins").join(margin("y").withColumnRenamed("_m", "labels"), groups)
        floor = margins.mapInPandas(_chance(draws, seed, groups), "place int, feature string, bucket string, floor double")
    else:
        labels = permuted.select("permutation", *keys, order, F.col(y).alias("_y"))
        chance = information(binned.join(labels, [*keys, order]), [*groups, "permutation"], "bin", "_y")
        floor = chance.groupBy(*groups).agg(F.percentile("mi", 0.95).alias("floor"))
    buckets = known.groupBy("bucket").agg(F.count("*").alias("_rows"), (F.min(y) < F.max(y)).alias("votes"))
    out = scored.join(checks, groups).join(floor, groups, "left").join(F.broadcast(buckets), "bucket")
    evaluable = (F.col("n") >= least) & F.col("_varies") & F.col("_labels")
    known_only = lambda c: F.when(F.col("evaluable"), F.col(c))
    out = out.withColumn("evaluable", evaluable).withColumns({"mi": known_only("mi"), "floor": known_only("floor")})
    out = out.withColumn("informative", F.coalesce((F.col("mi") > F.col("floor")) & (F.col("mi") >= least_mi), F.lit(False)))
    of = Window.partitionBy("feature")
    kept = F.max((F.col("votes") & (F.col("informative") | ~F.col("evaluable"))).cast("int")).over(of) == 1
    none = F.max(F.col("votes").cast("int")).over(of) == 0
    return out.withColumn("kept", kept | none).select("place", "feature", "bucket", F.col("_rows").alias("n"), F.col("n").alias("n_eff"), "mi", "floor", "evaluable", "informative", "votes", "kept")


def permuted_labels(df: DataFrame, y: str, keys: list[str], order: str, draws: int) -> DataFrame:
    """(permutation, keys, order, y): labels dealt anew among all rows, by the order of a hash of the permutation's number and the row; numbered by ranges."""
    row = F.concat_ws("|", *(F.col(k).cast("string") for k in keys), F.unix_micros(F.col(order).cast("timestamp")).cast("string"))

    def placed(p: int) -> DataFrame:
        h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{p}|"), row)), 1, 15), 16, 10).cast("long")
        return running_totals(df.select(*keys, order, y, h.alias("_h"), F.lit(1).alias("_one")), "_h", ["_one"])

    base = placed(0).select(*keys, order, "_one_run")
    out = None
    for p in range(1, draws + 1):
        one = base.join(placed(p).select(y, "_one_run"), "_one_run").select(F.lit(p).alias("permutation"), *keys, order, y)
        out = one if out is None else out.unionByName(one)
    return out


# out-of-sample scores against shifted labels --------------------------------------------------------------------------


def _normal_equations(features: list[str], folds: list):
    """Sums of x x' and x y' over the rows that each fold is fitted on, one row a task and fold."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, list[np.ndarray]] = {}
        for p in parts:
            x = np.column_stack([np.ones(len(p)), p[features].to_numpy(float)])
            labels = np.array(p["labels"].tolist(), float)
            at = p["_rn"].to_numpy()
            for f in folds:
                on = at <= f.train_until
                if on.any():
                    a, b = x[on].T @ x[on], x[on].T @ labels[on]
                    old = sums.get(f.fold)
                    sums[f.fold] = [a, b] if old is None else [old[0] + a, old[1] + b]
        rows = [(f, i, v) for f, (a, b) in sums.items() for i, v in enumerate(np.concatenate([a.ravel(), b.ravel()]).tolist())]
        yield pd.DataFrame(rows, columns=["fold", "cell", "v"])

    return run


def _score_counts(features: list[str], folds: list, weights: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]):
    """(fold, shift, step, pos, n) of the rows that each fold is tested on, by steps of their scores."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            x = np.column_stack([np.ones(len(p)), p[features].to_numpy(float)])
            labels, at = np.array(p["labels"].tolist(), int), p["_rn"].to_numpy()
            out = []
            for f in folds:
                on = (at >= f.first_test) & (at <= f.last_test)
                if f.fold in weights and on.any():
                    beta, low, span = weights[f.fold]
                    step = np.clip(((x[on] @ beta - low) / span * STEPS).astype(int), 0, STEPS)
                    for s in range(step.shape[1]):
                        key, inverse = np.unique(step[:, s], return_inverse=True)
                        out.append(pd.DataFrame({"fold": f.fold, "shift": s, "step": key, "pos": np.bincount(inverse, labels[on, s]).astype(int), "n": np.bincount(inverse)}))
            if out:
                yield pd.concat(out)

    return run


def shifted_null(df: DataFrame, features: list[str], y: str, order: str, folds: int = 4, embargo: int = 1, draws: int = 20, seed: int = 42, ridge: float = 1e-3) -> DataFrame:
    """(n, n_folds, auc, null_mean, null_sd, delta, p, verdict): whether linear scores of the features tell a label out of sample better than they tell
    labels that have been moved along by a random number of rows, all labels together and around the end, so that both keep their dependence in time.

    Rows with a null feature or label are left out; ``order`` has no repeats. Each fold is scored by least squares on the rows before it, less the embargo;
    the area is the mean over folds with both labels. All shifts are fitted together: a row carries its label under each shift, normal equations are sums, scores are counted by
    steps. p counts shifts that do as well, with the label itself: (1 + those) / (1 + shifts). The verdict is leakage if the shifted mean is above 0.55, signal if p < 0.05 and the
    difference is above 0.02, else none; null without areas.
    """
    known = df.where(F.forall(F.array(*(F.col(c).isNotNull() for c in (*features, y))), lambda c: c)).select(order, F.col(y).cast("int").alias("_y"), *(F.col(f).cast("double") for f in features))
    n = known.count()
    schema = "n long, n_folds int, auc double, null_mean double, null_sd double, delta double, p double, verdict string"
    low = max(embargo, 1)
    if n <= 2 * low:
        return df.sparkSession.createDataFrame([(n, 0, None, None, None, None, None, None)], schema)
    r = np.random.default_rng(seed)
    moves = [0, *r.integers(low, n - low, draws).tolist()]
    numbered = running_totals(known.withColumn("_one", F.lit(1)), order, ["_one"]).withColumn("_rn", F.col("_one_run") - 1).drop("_one", "_one_run").persist()
    moved = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.pmod(F.col("_rn") + m, F.lit(n)).alias("_rn")) for i, m in enumerate(moves)))).alias("_m")
    labels = numbered.select("_y", moved).groupBy(F.col("_m._rn").alias("_rn")).agg(F.sort_array(F.collect_list(F.struct(F.col("_m.i").alias("i"), F.col("_y").alias("v"))))["v"].alias("labels"))
    rows = numbered.drop("_y").join(labels, "_rn").select("_rn", "labels", *features).persist()
    cut = time_folds(numbered.select("_rn"), folds, embargo, "_rn").collect()  # as many rows as folds
    d, k = len(features) + 1, len(moves)
    sums = rows.mapInPandas(_normal_equations(features, cut), "fold int, cell int, v double").groupBy("fold", "cell").agg(F.sum("v").alias("v")).collect()
    held: dict[int, np.ndarray] = {}
    for s in sums:  # (features + 1) * (features + 1 + shifts) numbers a fold
        held.setdefault(s.fold, np.zeros(d * d + d * k))[s.cell] = s.v
    ends = rows.agg(*(f(c).alias(f"{name}_{i}") for i, c in enumerate(features) for name, f in (("a", F.min), ("b", F.max)))).first()
    weights = {}
    for fold, v in held.items():
        a, b = v[: d * d].reshape(d, d), v[d * d :].reshape(d, k)
        beta = np.linalg.solve(a + ridge * a[0, 0] * np.diag([0.0, *np.maximum(np.diag(a)[1:] / a[0, 0], 1e-12)]), b)
        edge = np.array([[ends[f"a_{i}"], ends[f"b_{i}"]] for i in range(d - 1)], float)
        parts = beta[1:, None, :] * edge[:, :, None]
        lowest, highest = beta[0] + parts.min(1).sum(0), beta[0] + parts.max(1).sum(0)
        weights[fold] = (beta, lowest, np.maximum(highest - lowest, 1e-300))
    counted = rows.mapInPandas(_score_counts(features, cut, weights), "fold int, shift int, step int, pos long, n long").groupBy("fold", "shift", "step").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))
    of = Window.partitionBy("fold", "shift").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)  # at most STEPS + 1 rows
    neg = F.col("n") - F.col("pos")
    terms = counted.withColumn("_below", F.coalesce(F.sum(neg).over(of), F.lit(0))).groupBy("fold", "shift").agg(F.sum(F.col("pos") * (F.col("_below") + neg / 2)).alias("u"), F.sum("pos").alias("p"), F.sum(neg).alias("q"))
    areas = terms.where("p > 0 and q > 0").groupBy("shift").agg(F.avg(F.col("u") / (F.col("p") * F.col("q"))).alias("auc"), F.count("*").alias("folds")).collect()  # one row a shift
    rows.unpersist()
    numbered.unpersist()
    by = {a["shift"]: a for a in areas}
    null = np.array([a["auc"] for s, a in by.items() if s])
    if 0 not in by or not len(null):
        return df.sparkSession.createDataFrame([(n, by[0]["folds"] if 0 in by else 0, by[0]["auc"] if 0 in by else None, None, None, None, None, None)], schema)
    real, mean = by[0]["auc"], float(null.mean())
    p = float((1 + (null >= real).sum()) / (1 + len(null)))
    verdict = "leakage" if mean > 0.55 else "signal" if p < 0.05 and real - mean > 0.02 else "none"
    return df.sparkSession.createDataFrame([(n, by[0]["folds"], real, mean, float(null.std()), real - mean, p, verdict)], schema)
