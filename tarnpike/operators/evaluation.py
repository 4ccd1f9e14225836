"""Sample overlap, folds, classification metrics and statistics of results."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnpike.functions.safe import correlation, sdiv, ssqrt
from tarnpike.operators.align import quantiles, running_least, running_totals

# sample overlap -----------------------------------------------------------------------------------------------------


def concurrency(df: DataFrame, t0: str, t1: str, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """With ``concurrent``: how many labels [t0, t1] are open at each row's t0. Openings and closings as signed events, summed in order of time."""
    k = list(keys)
    opens = df.select(*k, F.col(t0).alias("_t"), F.lit(0).alias("_o"), F.lit(1).alias("_d"))
    closes = df.where(F.col(t1).isNotNull()).select(*k, F.col(t1).alias("_t"), F.lit(1).alias("_o"), F.lit(-1).alias("_d"))
    steps = opens.unionByName(closes).groupBy(*k, "_t", "_o").agg(F.sum("_d").alias("_d"))
    level = steps.withColumn("concurrent", F.sum("_d").over(Window.partitionBy(*k).orderBy("_t", "_o").rowsBetween(Window.unboundedPreceding, 0)))
    at = level.where("_o = 0").select(*k, F.col("_t").alias(t0), "concurrent")
    return df.join(at, [*k, t0], "left")


def average_uniqueness(df: DataFrame, t0: str, t1: str, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """With ``uniqueness``: the mean of 1 / concurrency over the rows from t0 to t1, by prefix sums; and ``weight``, which sums to the number of rows."""
    k = list(keys)
    x = concurrency(df, t0, t1, keys)
    w = Window.partitionBy(*k).orderBy(t0).rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("_i", F.sum(1 / F.col("concurrent")).over(w)).withColumn("_n", F.count("*").over(w))
    end = x.select(*k, F.col(t0).alias(t1), F.col("_i").alias("_ie"), F.col("_n").alias("_ne"))
    x = x.join(end, [*k, t1], "left").withColumn("uniqueness", (F.col("_ie") - F.col("_i") + 1 / F.col("concurrent")) / (F.col("_ne") - F.col("_n") + 1))
    all_ = Window.partitionBy(*k)
    return x.withColumn("weight", sdiv(F.col("uniqueness") * F.count("uniqueness").over(all_), F.sum("uniqueness").over(all_))).drop("_i", "_n", "_ie", "_ne")


# folds --------------------------------------------------------------------------------------------------------------


def time_folds(df: DataFrame, folds: int, embargo: int, order: str) -> DataFrame:
    """(fold, first_test, last_test, train_until): equal tests at the end of time, training rows up to ``embargo`` rows before each."""
    n = df.agg(F.count("*").alias("n"))
    x = n.select("n", F.floor(F.col("n") / (folds + 1)).alias("size"), F.explode(F.sequence(F.lit(1), F.lit(folds))).alias("fold"))
    first = F.col("n") - (folds - F.col("fold") + 1) * F.col("size")
    return x.select(F.col("fold").cast("long"), first.cast("long").alias("first_test"), (first + F.col("size") - 1).cast("long").alias("last_test"), (first - 1 - embargo).cast("long").alias("train_until"))


def label_coverage(df: DataFrame, y: str, ts: str, folds: int, gap: int = 0) -> DataFrame:
    """(fold, train_rows, train_positives, test_rows, test_positives, degenerate) of ``time_folds`` in the order of ``ts``, which has no repeats: a fold
    whose training rows have no positive label learns nothing. Known before any training; rows are numbered by ranges, in many tasks."""
    x = running_totals(df.select(F.col(ts).alias("_t"), F.col(y).alias("_y")).withColumn("_one", F.lit(1)), "_t", ["_one"])
    f = time_folds(df, folds, gap, ts)
    at = F.col("_one_run") - 1
    spans = F.broadcast(f.agg(F.array_sort(F.collect_list(F.struct("fold", "first_test", "last_test", "train_until"))).alias("_f")))  # one row
    part = x.crossJoin(spans).select("_y", F.explode(F.transform("_f", lambda s: F.struct(s["fold"].alias("fold"), F.when(at <= s["train_until"], 0).when(at.between(s["first_test"], s["last_test"]), 1).alias("part")))).alias("p"))
    count = lambda k, what: F.coalesce(F.sum(F.when(F.col("p.part") == k, what)), F.lit(0)).cast("long")
    g = part.groupBy(F.col("p.fold").alias("fold")).agg(count(0, 1).alias("train_rows"), count(0, F.col("_y")).alias("train_positives"), count(1, 1).alias("test_rows"), count(1, F.col("_y")).alias("test_positives"))
    return g.withColumn("degenerate", F.col("train_positives") == 0)


def empty_months(df: DataFrame, y: str, ts: str) -> DataFrame:
    """(month, rows, positives, rate, empty): months without a positive label."""
    g = df.groupBy(F.date_trunc("month", ts).cast("timestamp_ntz").alias("month")).agg(F.count("*").alias("rows"), F.coalesce(F.sum(y), F.lit(0)).cast("long").alias("positives"), F.avg(y).alias("rate"))
    return g.withColumn("empty", F.col("positives") == 0)


def brier(df: DataFrame, y: str, score: str, keys: list[str]) -> DataFrame:
    """(keys, n, brier, reference, skill): mean squared error of probabilities, that of the base rate, and the share of it that is saved."""
    known = df.where(F.col(y).isNotNull() & F.col(score).isNotNull())
    g = known.groupBy(*keys).agg(F.count("*").alias("n"), F.avg((F.col(score) - F.col(y)) * (F.col(score) - F.col(y))).alias("brier"), F.avg(y).alias("_p"))
    return g.withColumn("reference", F.col("_p") * (1 - F.col("_p"))).withColumn("skill", 1 - sdiv(F.col("brier"), F.col("reference"))).drop("_p")


def fold_windows(start: str, end: str, train_months: int, test_months: int, step_months: int) -> Column:
    """Array of (train_start, train_end, test_end), the newest test first; training rolls."""
    s, e = F.lit(start).cast("date"), F.lit(end).cast("date")
    steps = F.sequence(F.lit(0), F.floor(F.months_between(e, s) / step_months).cast("int"))
    made = F.transform(steps, lambda i: F.struct(F.add_months(e, -(i * step_months + test_months + train_months)).alias("train_start"), F.add_months(e, -(i * step_months + test_months)).alias("train_end"), F.add_months(e, -(i * step_months)).alias("test_end")))
    return F.filter(made, lambda f: f["train_start"] >= s)


# classification -----------------------------------------------------------------------------------------------------


def auc(df: DataFrame, y: str, score: str, keys: list[str] | None = None) -> DataFrame:
    """(keys, n, positives, auc) by rank sums with average ranks. Scores are counted first, so ties cost one row each."""
    k = keys or []
    g = df.where(F.col(y).isNotNull() & F.col(score).isNotNull()).groupBy(*k, score).agg(F.count("*").alias("_n"), F.sum(y).alias("_p"))
    if k:
        g = g.withColumn("_n_run", F.sum("_n").over(Window.partitionBy(*k).orderBy(score).rowsBetween(Window.unboundedPreceding, 0)))
    else:
        g = running_totals(g, score, ["_n"])
    g = g.withColumn("_r", F.col("_p") * (F.col("_n_run") - F.col("_n") + (F.col("_n") + 1) / 2.0))
    x = g.groupBy(*k).agg(F.sum("_n").alias("n"), F.sum("_p").alias("positives"), F.sum("_r").alias("_r"))
    p, q = F.col("positives").cast("double"), F.col("n") - F.col("positives").cast("double")
    return x.select(*k, "n", "positives", sdiv(F.col("_r") - p * (p + 1) / 2, p * q).alias("auc"))


def threshold_sweep(df: DataFrame, y: str, score: str, thresholds: list[float]) -> DataFrame:
    """By threshold: predicted positives, hits, precision, recall, F1, Matthews correlation and lift. One pass: the thresholds are a short array in each row."""
    t = F.explode(F.array(*map(F.lit, thresholds)))
    base = df.where(F.col(y).isNotNull() & F.col(score).isNotNull()).groupBy(score).agg(F.count("*").alias("_n"), F.sum(y).alias("_p"))
    x = base.select("*", t.alias("threshold"))
    on = F.col(score) >= F.col("threshold")
    x = x.groupBy("threshold").agg(F.sum("_n").alias("n"), F.sum("_p").alias("pos"), F.sum(F.when(on, F.col("_n")).otherwise(0)).alias("predicted"), F.sum(F.when(on, F.col("_p")).otherwise(0)).alias("hits"))
    n, pos, pred, hit = (F.col(q).cast("double") for q in ("n", "pos", "predicted", "hits"))
    prec, rec = sdiv(hit, pred), sdiv(hit, pos)
    tn = n - pos - pred + hit
    mcc = sdiv(hit * tn - (pred - hit) * (pos - hit), F.sqrt(pred * pos * (n - pos) * (n - pred)))
    return x.select("threshold", "predicted", "hits", prec.alias("precision"), rec.alias("recall"), sdiv(2 * hit, pred + pos).alias("f1"), mcc.alias("mcc"), sdiv(prec, sdiv(pos, n)).alias("lift"))


def threshold_at_recall(df: DataFrame, y: str, score: str, recall: float) -> DataFrame:
    """(threshold, precision, recall): of the thresholds that keep the recall, the most precise; of those the highest."""
    g = df.where(F.col(y).isNotNull() & F.col(score).isNotNull()).groupBy(score).agg(F.count("*").alias("_n"), F.sum(y).alias("_p"))
    c = running_totals(g, score, ["_n", "_p"], descending=True).crossJoin(F.broadcast(g.agg(F.sum("_p").alias("_all"))))
    x = c.select(F.col(score).alias("threshold"), (F.col("_p_run") / F.col("_n_run")).alias("precision"), sdiv(F.col("_p_run").cast("double"), F.col("_all").cast("double")).alias("recall")).where(F.col("recall") >= recall)
    return x.orderBy(F.desc("precision"), F.desc("threshold")).limit(1)


def calibration(df: DataFrame, y: str, p: str, bins: int = 10) -> DataFrame:
    """By bin of equal width (the last one closed): rows, mean score, share of positives, and the expected calibration error over all."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    x = df.where(F.col(y).isNotNull() & F.col(p).isNotNull()).groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_score"), F.avg(y).alias("share"))
    all_ = Window.partitionBy()
    return x.withColumn("ece", F.sum(F.col("n") * F.abs(F.col("mean_score") - F.col("share"))).over(all_) / F.sum("n").over(all_))


def event_metrics(df: DataFrame, y: str, pred: str, keys: list[str], ts: str) -> DataFrame:
    """Runs of positives as events: how many, how many predicted at some time, and the mean rows until the first prediction."""
    w = Window.partitionBy(*keys).orderBy(ts)
    x = df.withColumn("_new", F.when((F.col(y) == 1) & (F.coalesce(F.lag(y).over(w), F.lit(0)) != 1), 1).otherwise(0))
    x = x.withColumn("_id", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).where(F.col(y) == 1)
    x = x.withColumn("_pos", F.row_number().over(Window.partitionBy(*keys, "_id").orderBy(ts)) - 1)
    e = x.groupBy(*keys, "_id").agg(F.min(F.when(F.col(pred) == 1, F.col("_pos"))).alias("lag"), F.count("*").alias("length"))
    return e.groupBy(*keys).agg(F.count("*").alias("events"), F.count("lag").alias("detected"), F.avg("lag").alias("mean_lag"), F.avg("length").alias("mean_length"))


def event_overlap(df: DataFrame, y: str, pred: str, keys: list[str], position: str) -> DataFrame:
    """(keys, events, detected, predicted, true_predicted, recall, precision, mean_lag, mean_predictions): runs of positive labels and of positive predictions.

    An event is detected if a row of it is predicted; a predicted run is true if a row of it is positive. The lag is the rows until an event's first
    prediction. Where ``position`` jumps by more than one, as between folds, runs end. Unknown labels and predictions count as none.
    """
    w = Window.partitionBy(*keys).orderBy(position)
    on = lambda c: F.coalesce(F.col(c) == 1, F.lit(False))
    x = df.withColumns({"_y": on(y), "_p": on(pred), "_gap": F.coalesce(F.col(position) - F.lag(position).over(w) > 1, F.lit(True))})
    opens = lambda c: F.when(F.col(c) & (F.col("_gap") | ~F.lag(c).over(w)), 1).otherwise(0)
    x = x.withColumns({"_oy": opens("_y"), "_op": opens("_p")})
    run = lambda c: F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, 0))
    x = x.withColumns({"_iy": run("_oy"), "_ip": run("_op")})
    of_event = Window.partitionBy(*keys, "_iy", "_y").orderBy(position)
    actual = x.withColumn("_at", F.row_number().over(of_event) - 1).where("_y").groupBy(*keys, "_iy").agg(F.count_if("_p").alias("_k"), F.min(F.when(F.col("_p"), F.col("_at"))).alias("_lag"))
    a = actual.groupBy(*keys).agg(F.count("*").alias("events"), F.count("_lag").alias("detected"), F.avg("_lag").alias("mean_lag"), F.avg("_k").alias("mean_predictions"))
    b = x.where("_p").groupBy(*keys, "_ip").agg(F.max(F.col("_y").cast("int")).alias("_t")).groupBy(*keys).agg(F.count("*").alias("predicted"), F.sum("_t").alias("true_predicted"))
    every = df.select(*keys).distinct()
    on_keys = lambda r: [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    for part in (a, b):
        every = every.join(part.withColumnsRenamed({k: f"_r_{k}" for k in keys}), on_keys(part), "left").drop(*(f"_r_{k}" for k in keys))
    every = every.fillna(0, ["events", "detected", "predicted", "true_predicted"])
    return every.select(*keys, "events", "detected", "predicted", "true_predicted", sdiv(F.col("detected").cast("double"), F.col("events")).alias("recall"), sdiv(F.col("true_predicted").cast("double"), F.col("predicted")).alias("precision"), "mean_lag", "mean_predictions")


# statistics of results ----------------------------------------------------------------------------------------------


def clustered_mean(df: DataFrame, value: str, cluster: Column, keys: list[str] | None = None) -> DataFrame:
    """(keys, n, clusters, mean, se, t): the standard error lets rows of a cluster depend on each other."""
    k = keys or []
    m = df.where(F.col(value).isNotNull()).withColumn("_c", cluster)
    each = m.groupBy(*k, "_c").agg(F.sum(value).alias("_s"), F.count("*").alias("_n"))
    all_ = Window.partitionBy(*k)
    each = each.withColumn("_m", F.sum("_s").over(all_) / F.sum("_n").over(all_)).withColumn("_d", F.col("_s") - F.col("_n") * F.col("_m"))
    x = each.groupBy(*k).agg(F.sum("_n").alias("n"), F.count("*").alias("clusters"), F.max("_m").alias("mean"), F.sum(F.col("_d") * F.col("_d")).alias("_q"))
    g = F.col("clusters").cast("double")
    x = x.withColumn("se", F.when(g > 1, F.sqrt(F.col("_q") * g / F.nullif(g - 1, F.lit(0.0))) / F.col("n")))
    return x.withColumn("t", sdiv(F.col("mean"), F.col("se"))).drop("_q")


def benjamini_hochberg(df: DataFrame, p: str, out: str = "p_adjusted", keys: list[str] | None = None) -> DataFrame:
    """Step-up adjusted p-values among known ones, by keys or over the whole table. Without keys equal values are counted first and placed by
    ranges; with keys a key's values are one window."""
    if keys:
        n, w = F.count(p).over(Window.partitionBy(*keys)), Window.partitionBy(*keys)
        x = df.withColumn("_r", F.row_number().over(w.orderBy(F.asc_nulls_last(p)))).withColumn("_a", F.col(p) * n / F.col("_r"))
        run = F.min("_a").over(w.orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, 0))
        return x.withColumn(out, F.when(F.col(p).isNotNull(), F.least(run, F.lit(1.0)))).drop("_r", "_a")
    counts = df.where(F.col(p).isNotNull()).groupBy(F.col(p).alias("_p")).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("_total"))
    ranked = running_totals(counts, "_p", ["_n"]).crossJoin(F.broadcast(total)).withColumn("_a", F.col("_p") * F.col("_total") / F.col("_n_run"))
    adjusted = running_least(ranked, "_p", "_a", out).select("_p", F.least(out, F.lit(1.0)).alias(out))
    return df.join(adjusted, F.col(p) == F.col("_p"), "left").drop("_p")


def average_rank(x: str, keys: list[str]) -> Column:
    """Rank with average ties among known values."""
    ties = F.count("*").over(Window.partitionBy(*keys, x))
    return F.when(F.col(x).isNotNull(), F.rank().over(Window.partitionBy(*keys).orderBy(F.asc_nulls_last(x))) + (ties - 1) / 2.0)


def spearman(df: DataFrame, x: str, y: str, keys: list[str]) -> DataFrame:
    """(keys, n, ic): rank correlation over rows with both known."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    r = both.withColumn("_x", average_rank(x, keys)).withColumn("_y", average_rank(y, keys))
    return r.groupBy(*keys).agg(F.count("*").alias("n"), correlation("_x", "_y").alias("ic"))


def circular_null(df: DataFrame, x: str, y: str, keys: list[str], ts: str, offsets: list[int]) -> DataFrame:
    """(keys, offset, ic): rank correlations of x with y turned round by each offset; at 0 the real one."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    r = both.withColumn("_x", average_rank(x, keys)).withColumn("_y", average_rank(y, keys)).withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(ts)) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    left = r.select(*keys, "_n", "_x", F.explode(F.array(*map(F.lit, offsets))).alias("offset"), "_i").withColumn("_j", F.pmod(F.col("_i") + F.col("offset"), F.col("_n")))
    return left.join(r.select(*keys, F.col("_i").alias("_j"), "_y"), [*keys, "_j"]).groupBy(*keys, "offset").agg(correlation("_x", "_y").alias("ic"))


def stability_index(df: DataFrame, x: str, new: Column, bins: int = 10, floor: float = 1e-4) -> DataFrame:
    """Population stability index between two parts of a table, by quantile bins of the old part; shares are floored."""
    part = df.where(F.col(x).isNotNull()).withColumn("_new", new.cast("int"))
    edges = quantiles(part.where("_new = 0"), x, [i / bins for i in range(1, bins)]).withColumnRenamed("quantiles", "_e")
    b = F.size(F.filter(F.array_distinct(F.col("_e")), lambda e: e < F.col(x)))
    g = part.crossJoin(F.broadcast(edges)).groupBy(b.alias("bin")).agg(F.count_if(F.col("_new") == 0).alias("_a"), F.count_if(F.col("_new") == 1).alias("_b"))
    all_ = Window.partitionBy()
    a, q = (F.greatest(F.col(k) / F.sum(k).over(all_), F.lit(floor)) for k in ("_a", "_b"))
    return g.select("bin", F.col("_a").alias("old"), F.col("_b").alias("new"), ((q - a) * F.ln(q / a)).alias("psi"))


def kolmogorov_smirnov(df: DataFrame, x: str, new: Column) -> DataFrame:
    """The largest distance between the distribution functions of two parts of a table."""
    g = df.where(F.col(x).isNotNull()).groupBy(x).agg(F.count_if(new).alias("_b"), F.count_if(~new).alias("_a"))
    c = running_totals(g, x, ["_a", "_b"]).crossJoin(F.broadcast(g.agg(F.sum("_a").alias("_na"), F.sum("_b").alias("_nb"))))
    return c.agg(F.max(F.abs(F.col("_a_run") / F.col("_na") - F.col("_b_run") / F.col("_nb"))).alias("ks"), F.max("_na").alias("n_old"), F.max("_nb").alias("n_new"))


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """By column: rows, nulls, distinct values, share of zeros, mean, deviation, quantiles and bias-corrected skewness."""
    long = df.select(*(F.col(x).cast("double").alias(x) for x in columns)).unpivot([], columns, "column", "value")
    v = F.col("value")
    x = long.groupBy("column").agg(
        F.count("*").alias("rows"), F.count_if(v.isNull()).alias("nulls"), F.count_distinct("value").alias("distinct_values"), F.avg(F.when(v.isNotNull(), (v == 0).cast("double"))).alias("zero_share"),
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.percentile("value", 0.01).alias("q01"), F.percentile("value", 0.5).alias("q50"), F.percentile("value", 0.99).alias("q99"), F.skewness("value").alias("_g"), F.count("value").alias("_n"),
    )
    n = F.col("_n").cast("double")
    return x.withColumn("skew", F.when(n > 2, F.col("_g") * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))).drop("_g", "_n")


def duplicate_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b) of columns that agree in every row. Signatures find the pairs, a comparison of all rows confirms them."""
    sums = df.agg(*(F.sum(F.xxhash64(F.col(x).cast("string")).cast("decimal(38,0)")).alias(x) for x in columns)).first()
    pairs = [(a, b) for a, b in itertools.combinations(columns, 2) if sums[a] == sums[b]]
    spark = df.sparkSession
    if not pairs:
        return spark.createDataFrame([], "a string, b string")
    same = df.agg(*(F.bool_and(F.col(a).eqNullSafe(F.col(b))).alias(f"{i}") for i, (a, b) in enumerate(pairs))).first()
    return spark.createDataFrame([p for i, p in enumerate(pairs) if same[f"{i}"]], "a string, b string")


def time_gaps(df: DataFrame, keys: list[str], ts: str, factor: float = 1.5) -> DataFrame:
    """(keys, gap_start, gap_end, seconds): spacings above ``factor`` times the key's most frequent one that contain no Saturday."""
    w = Window.partitionBy(*keys).orderBy(ts)
    x = df.withColumn("_p", F.lag(ts).over(w)).withColumn("_d", F.unix_seconds(F.col(ts).cast("timestamp")) - F.unix_seconds(F.col("_p").cast("timestamp")))
    usual = x.where("_d is not null").groupBy(*keys, "_d").count().groupBy(*keys).agg(F.max_by("_d", F.struct("count", -F.col("_d"))).alias("_step"))
    saturday = F.exists(F.sequence(F.to_date("_p"), F.to_date(ts)), lambda d: F.weekday(d) == 5)
    return x.join(usual, keys).where((F.col("_d") > factor * F.col("_step")) & ~saturday).select(*keys, F.col("_p").alias("gap_start"), F.col(ts).alias("gap_end"), F.col("_d").alias("seconds"))


def autocorrelation(df: DataFrame, x: str, lags: int, keys: list[str], ts: str) -> DataFrame:
    """(keys, lag, acf, ljung_box): autocorrelations about the overall mean and the running Ljung-Box statistic."""
    w, all_ = Window.partitionBy(*keys).orderBy(ts), Window.partitionBy(*keys)
    d = df.where(F.col(x).isNotNull()).withColumn("_d", F.col(x) - F.avg(x).over(all_))
    cols = [F.sum(F.col("_d") * F.col(f"_l{k}")).alias(f"{k}") for k in range(1, lags + 1)]
    for k in range(1, lags + 1):
        d = d.withColumn(f"_l{k}", F.lag("_d", k).over(w))
    s = d.groupBy(*keys).agg(F.sum(F.col("_d") * F.col("_d")).alias("_v"), F.count("*").alias("_n"), *cols)
    long = s.unpivot([*keys, "_v", "_n"], [f"{k}" for k in range(1, lags + 1)], "lag", "_c").withColumn("lag", F.col("lag").cast("int")).withColumn("acf", sdiv(F.col("_c"), F.col("_v")))
    n = F.col("_n").cast("double")
    q = F.sum(F.col("acf") * F.col("acf") / (n - F.col("lag"))).over(Window.partitionBy(*keys).orderBy("lag").rowsBetween(Window.unboundedPreceding, 0))
    return long.select(*keys, "lag", "acf", (n * (n + 2) * q).alias("ljung_box"))


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def normal_quantile(p: float) -> float:
    """By bisection on the distribution function; p strictly between 0 and 1."""
    lo, hi = -40.0, 40.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if normal_cdf(mid) < p else (lo, mid)
    return (lo + hi) / 2


def deflated_sharpe(sharpe: float, n: int, skew: float, kurt: float, trials: int, variance: float) -> float:
    """Probability that a Sharpe ratio (per observation) is above what the best of ``trials`` without skill reaches."""
    g = 0.5772156649015329
    best = math.sqrt(variance) * ((1 - g) * normal_quantile(1 - 1 / trials) + g * normal_quantile(1 - 1 / (trials * math.e))) if trials > 1 else 0.0
    return normal_cdf((sharpe - best) * math.sqrt(n - 1) / math.sqrt(1 - skew * sharpe + (kurt - 1) / 4 * sharpe**2))


def overfitting_probability(results: DataFrame, config: str, block: str, value: str, blocks: int) -> DataFrame:
    """(splits, pbo): over all halvings of the blocks, how often the configuration that is best in one half is at or below the median of the other.

    ``results`` has sums of the value by configuration and block (0 to blocks - 1). Splits are an array of bit masks, joined with configurations, never with rows.
    """
    masks = [sum(1 << i for i in pick) for pick in itertools.combinations(range(blocks), blocks // 2)]
    spark = results.sparkSession
    each = results.groupBy(config, block).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"), F.sum(F.col(value) * F.col(value)).alias("_q"))
    split = spark.range(1).select(F.explode(F.array(*map(F.lit, masks))).alias("split"))
    x = each.crossJoin(F.broadcast(split)).withColumn("_in", F.shiftright("split", 0).bitwiseAND(F.pow(F.lit(2), F.col(block)).cast("int")) > 0)

    def sharpe(on: Column) -> Column:
        n, s, q = (F.sum(F.when(on, F.col(k))) for k in ("_n", "_s", "_q"))
        mean = s / F.nullif(n, F.lit(0))
        return sdiv(mean, ssqrt(q / F.nullif(n, F.lit(0)) - mean * mean))

    y = x.groupBy("split", config).agg(sharpe(F.col("_in")).alias("inside"), sharpe(~F.col("_in")).alias("outside"))
    w = Window.partitionBy("split")
    y = y.withColumn("_rank", F.rank().over(Window.partitionBy("split").orderBy("outside"))).withColumn("_n", F.count("*").over(w))
    best = y.withColumn("_b", F.row_number().over(Window.partitionBy("split").orderBy(F.desc_nulls_last("inside"), config))).where("_b = 1")
    return best.agg(F.count("*").alias("splits"), F.avg((F.col("_rank") / (F.col("_n") + 1.0) <= 0.5).cast("double")).alias("pbo"))
