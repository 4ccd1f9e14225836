"""Hand-made cases of operators, their edges, and that features do not look ahead."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tarnpike.functions import safe
from tarnpike.functions.recursions import ewm
from tarnpike.operators import align, crosssection, evaluation, indicators, labels, models, sequences, simulation
from tarnpike.sources import bars as src
from tarnpike.streaming import bars as streams

T0 = dt.datetime(2024, 1, 1)


def make(spark, close, high=None, low=None, volume=None, open_=None, symbol="A"):
    n = len(close)
    rows = [(symbol, T0 + dt.timedelta(hours=i), float((open_ or close)[i]), float((high or close)[i]), float((low or close)[i]), float(close[i]), float((volume or [1.0] * n)[i]), float(close[i])) for i in range(n)]
    return spark.createDataFrame(rows, src.BAR)


def values(df, *cols):
    rows = df.orderBy("symbol", "ts").select(*cols).collect()
    return [tuple(r) if len(cols) > 1 else r[0] for r in rows]


def random_bars(spark, n=120, seed=1):
    rng = np.random.default_rng(seed)
    c = 100 + np.cumsum(rng.normal(0, 1, n))
    h, lo, o = c + rng.uniform(0, 2, n), c - rng.uniform(0, 2, n), c + rng.uniform(-1, 1, n)
    return make(spark, list(c), list(np.maximum(h, o)), list(np.minimum(lo, o)), list(rng.integers(1, 50, n)), list(o))


def test_barrier_race_by_hand(spark):
    b = make(spark, [100, 101, 102, 100, 100], [100, 101, 102, 102, 101], [100, 100, 101, 99, 99]).withColumns({"target": F.lit(2.0), "stop": F.lit(1.0)})
    got = values(labels.barrier_race(b, 3), "long", "t1_long", "short", "t1_short")
    hour = lambda i: None if i is None else T0 + dt.timedelta(hours=i)
    assert [g[0] for g in got] == [1, 0, 0, 0, 0]
    assert [g[2] for g in got] == [0, 0, 1, 0, 0]
    assert [g[1] for g in got] == [hour(i) for i in (2, 3, 3, 4, None)]
    assert [g[3] for g in got] == [hour(i) for i in (1, 2, 3, 4, None)]
    assert values(labels.barrier_race_fast(b, 3), "long", "short") == [(g[0], g[2]) for g in got]


def test_symmetric_barrier_by_hand(spark):
    b = make(spark, [100, 101, 102, 100, 100], [100, 101, 102, 102, 101], [100, 100, 101, 99, 99]).withColumn("d", F.lit(2.0))
    assert values(labels.symmetric_barrier(b, "d", 2), "barrier") == [1, -1, -1, None, None]


def test_rank_conventions(spark):
    b = make(spark, [3, 1, 2, 2])
    w = indicators.W()
    x = b.select("symbol", "ts", safe.rank_le("close", w, 4, 1).alias("a"), safe.rank_avg("close", w, 4).alias("b"), safe.rank_strict("close", w, 4, 1).alias("c"), safe.rank_prev_le("close", w, 3, 1).alias("d"))
    assert values(x, "a", "b", "c", "d")[-1] == pytest.approx((75, 62.5, 100 / 3, 2 / 3))


def test_run_length(spark):
    b = make(spark, [1, 2, -1, -2, -3, 0, 4])
    assert values(indicators.run_length(b, F.col("close"), "r"), "r") == [1, 2, -1, -2, -3, 0, 1]


def test_uniqueness(spark):
    hour = lambda i: T0 + dt.timedelta(hours=i)
    x = spark.createDataFrame([("A", hour(i), hour(j)) for i, j in enumerate((2, 1, 3, 3))], "symbol string, ts timestamp_ntz, t1 timestamp_ntz")
    got = values(evaluation.average_uniqueness(x, "ts", "t1"), "concurrent", "uniqueness")
    assert [g[0] for g in got] == [1, 2, 2, 2]
    assert [g[1] for g in got] == pytest.approx([2 / 3, 0.5, 0.5, 0.5])


def test_benjamini_hochberg(spark):
    x = spark.createDataFrame([(p,) for p in (0.01, 0.04, 0.03, 0.20)], "p double")
    got = {r.p: r.p_adjusted for r in evaluation.benjamini_hochberg(x, "p").collect()}
    assert got == pytest.approx({0.01: 0.04, 0.04: 0.16 / 3, 0.03: 0.16 / 3, 0.20: 0.20})


def test_clustered_mean(spark):
    x = spark.createDataFrame([("a", 1.0), ("a", -1.0), ("b", 2.0), ("b", 0.0)], "k string, v double")
    row = evaluation.clustered_mean(x, "v", F.col("k")).first()
    assert (row.mean, row.clusters, row.n) == (0.5, 2, 4)
    assert row.se == pytest.approx(np.sqrt(2 * ((0 - 1) ** 2 + (2 - 1) ** 2)) / 4)


def test_rollover_nights(spark):
    rows = [(dt.datetime(2024, 1, 3, 20), dt.datetime(2024, 1, 5, 21)), (dt.datetime(2024, 1, 3, 21), dt.datetime(2024, 1, 5, 21)), (dt.datetime(2024, 1, 6, 1), dt.datetime(2024, 1, 7, 23))]
    x = spark.createDataFrame(rows, "a timestamp_ntz, b timestamp_ntz")
    assert [r[0] for r in x.select(simulation.rollover_nights(F.col("a"), F.col("b"))).collect()] == [5, 2, 0]


def test_sizing(spark):
    x = spark.range(1).select(simulation.risk_notional(F.lit(50_000.0), 0.01, F.lit(35.0), F.lit(1.10)).alias("a"), simulation.risk_notional(F.lit(0.0), 0.01, F.lit(35.0), F.lit(1.10)).alias("b")).first()
    assert x.a == pytest.approx(157_142.857142857) and x.b == 0


def test_cross_rank(spark):
    d = dt.date(2024, 1, 1)
    x = spark.createDataFrame([(d, s, v) for s, v in zip("abcd", (1.0, 2.0, 2.0, 4.0), strict=True)], "date date, symbol string, v double")
    got = {r.symbol: (r.xs_rank, r.breadth) for r in crosssection.cross_rank(x, "v").collect()}
    assert [got[s][0] for s in "abcd"] == [0.25, 0.625, 0.625, 1.0]
    assert [got[s][1] for s in "abcd"] == pytest.approx([0, 1 / 3, 1 / 3, 1])
    y = x.unionByName(spark.createDataFrame([(d, "e", None)], "date date, symbol string, v double"))
    assert all(r.breadth is None for r in crosssection.cross_rank(y, "v").collect())


def test_strengths_need_connected_pairs():
    with pytest.raises(ValueError):
        crosssection.strength_weights([("x", "A", "B"), ("y", "C", "D")])


def test_weekend_filter_and_local_times(spark):
    stamps = ["2024-01-05 21:45:00", "2024-01-05 22:00:00", "2024-01-06 10:00:00", "2024-01-07 10:00:00", "2024-01-08 00:00:00"]
    x = spark.createDataFrame([(s,) for s in stamps], "s string").withColumn("ts", F.col("s").cast("timestamp_ntz"))
    assert [r.s for r in x.where(src.weekday_hours(F.col("ts"))).collect()] == [stamps[0], stamps[4]]
    y = spark.createDataFrame([("05.01.2024 10:30",), ("2024-01-05T10:30:00Z",), ("2024-01-05 12:30:00+02:00",), ("2024-01-05 10:30:00",), ("nonsense",), (None,)], "s string")
    at = dt.datetime(2024, 1, 5, 10, 30)
    assert [r[0] for r in y.select(src.parsed_time(F.col("s"))).collect()] == [at, at, at, at, None, None]
    z = spark.createDataFrame([("2024-03-31 02:30:00",), ("2024-10-27 02:30:00",), ("2024-07-01 12:00:00",)], "s string")
    assert [r[0] for r in z.select(src.local_time_to_utc(F.col("s"), "Europe/Berlin")).collect()] == [None, None, dt.datetime(2024, 7, 1, 10)]


def test_csv_bars(spark, tmp_path):
    (tmp_path / "a.csv").write_text("time,open,high,low,close,volume,mid\n05.01.2024 10:00,1,2,0,1,3,1\n05.01.2024 10:00,1,2,0,9,3,1\n06.01.2024 10:00,1,2,0,1,3,1\n")
    got = src.read_bar_csv(spark, str(tmp_path / "a.csv"), "X").collect()
    assert [(r.symbol, r.close) for r in got] == [("X", 9.0)]


def test_vintages(spark, tmp_path):
    for day, v in (("2024-01-10", 1.0), ("2024-02-10", 2.0)):
        (tmp_path / f"CPI_{day}.csv").write_text(f"observation_date,CPI_x\n2023-12-01,{v}\n2024-01-01,.\n")
    x = src.read_vintages(spark, str(tmp_path))
    assert {(r.series, str(r.vintage_date), r.value) for r in x.collect()} == {("CPI", "2024-01-10", 1.0), ("CPI", "2024-01-10", None), ("CPI", "2024-02-10", 2.0), ("CPI", "2024-02-10", None)}
    assert [r.value for r in src.as_known(x, "2024-01-31").orderBy("observation_date").collect()] == [1.0, None]


def test_asof_edges(spark):
    hour = lambda i: T0 + dt.timedelta(hours=i)
    a = spark.createDataFrame([("A", hour(i)) for i in (0, 4, 5, 9)], "symbol string, ts timestamp_ntz")
    b = spark.createDataFrame([("A", hour(4), 1.0), ("A", hour(8), None), ("B", hour(0), 7.0)], "symbol string, ts timestamp_ntz, v double")
    assert values(align.asof(a, b, ["v"], ["symbol"]), "v") == [None, 1.0, 1.0, None]
    assert values(align.asof(a, b, ["v"], ["symbol"], exact=False), "v") == [None, None, 1.0, None]
    assert values(align.asof(a, b, ["v"], ["symbol"], forward=True), "v") == [1.0, 1.0, None, None]


def test_halo_gives_the_same_windows(spark):
    b = random_bars(spark)
    want = values(b.withColumn("m", safe.mean_n("close", indicators.W(), 10)), "m")
    split = align.with_halo(b, ["symbol"], F.to_date("ts"), 9)
    w = safe.ordered("symbol", "_chunk")
    got = values(split.withColumn("m", safe.mean_n("close", w, 10)).where("_halo = 0"), "m")
    assert [x is None for x in got] == [x is None for x in want]
    assert [x for x in got if x is not None] == pytest.approx([x for x in want if x is not None])


def test_event_gate_keeps_unknown(spark):
    x = spark.createDataFrame([(1.0, True), (1.0, False), (None, True), (1.0, None)], "s double, c boolean")
    assert [r[0] for r in x.select(safe.event(F.col("s"), F.col("c"))).collect()] == [1.0, 0.0, None, None]


@pytest.mark.parametrize("n", [0, 1, 5])
def test_short_and_empty_frames(spark, n):
    b = make(spark, [1.0] * n) if n else spark.createDataFrame([], src.BAR)
    x = indicators.trend_slope(indicators.cci(indicators.bollinger(b)), 12)
    x = sequences.realized_moments(sequences.masked_returns(x), 20)
    assert x.count() == n
    assert labels.symmetric_barrier(b.withColumn("d", F.lit(1.0)), "d", 3).count() == n
    assert labels.barrier_race_fast(b.withColumns({"target": F.lit(1.0), "stop": F.lit(1.0)}), 3).count() == n


def test_features_do_not_look_ahead(spark):
    b = random_bars(spark).cache()
    cut = T0 + dt.timedelta(hours=80)
    changed = b.withColumns({k: F.when(F.col("ts") > F.lit(cut), F.col(k) * 3 + 7).otherwise(F.col(k)) for k in ("open", "high", "low", "close", "volume")})

    def features(x):
        x = indicators.volume_features(indicators.pullback(indicators.donchian(indicators.bollinger(x), 20), 6), 16)
        x = sequences.squeeze_breakout(sequences.jumps(sequences.breakout_close(x, 5, 14), 14, 5), 6, 40)
        return indicators.rsi(indicators.macd(sequences.timing(x, 4, 16, 48, 80, 12, 20, 0.01)))

    cols = [c for c in features(b).columns if c not in ("symbol", "ts", "open", "high", "low", "close", "volume", "mid")]
    at = F.col("ts") <= F.lit(cut)
    assert values(features(b).where(at), *cols) == values(features(changed).where(at), *cols)


def test_recursions_against_a_loop(spark):
    b = random_bars(spark)
    pdf = b.orderBy("ts").toPandas()
    want = pdf.close.ewm(span=12, adjust=False).mean() - pdf.close.ewm(span=26, adjust=False).mean()
    assert values(indicators.macd(b), "macd")[:25] == [None] * 25 and values(indicators.macd(b), "macd")[25:] == pytest.approx(list(want)[25:])
    gaps = b.withColumn("x", F.when(F.hour("ts") % 5 != 2, F.col("close") - 100))
    x = gaps.orderBy("ts").toPandas().x.to_numpy(float)
    for alpha, start in ((0.05, 1), (0.9, 3), (1 / 14, 14), (1.0, 1)):
        got = np.array(values(safe.recursive_means(gaps, {"y": ("x", alpha, start)}), "y"), float)
        assert got == pytest.approx(ewm(x, alpha, start), rel=1e-9, nan_ok=True)
    assert ewm(np.array([1.0, np.nan, 3.0]), 0.5) == pytest.approx([1, 1, 2])
    sql = values(indicators.ewm_in_sql(b, "close", 2 / 13, "y"), "y")
    assert sql == pytest.approx(list(pdf.close.ewm(span=12, adjust=False).mean()), rel=1e-9)
    adx = values(indicators.adx(b), "adx")
    assert all(x is None or 0 <= x <= 100 for x in adx) and adx[-1] is not None


def test_opportunity_windows(spark):
    go = [False, True, True, True, True, True, True, False, True]
    on = [True, True, True, True, True, True, False, True, True]
    x = spark.createDataFrame([("A", T0 + dt.timedelta(hours=i), g, o) for i, (g, o) in enumerate(zip(go, on, strict=True))], "symbol string, ts timestamp_ntz, go boolean, on boolean")
    assert values(labels.opportunity_windows(x, "go", "on"), "window_id") == [None, 1, 1, 1, 1, 2, None, None, 3]


def test_mask_fast(spark):
    x = spark.createDataFrame([(1, 1), (None, 1), (1, 0), (1, None)], "f int, s int")
    assert [r.f for r in labels.mask_fast(x, "f", "s").collect()] == [1, 0, 0, 0]


def test_costs_are_symmetric(spark):
    rows = [("BUY", 1.0, 1.01, 100.0, T0, T0), ("SELL", 1.01, 1.0, 100.0, T0, T0)]
    x = spark.createDataFrame(rows, "action string, open_price double, close_price double, notional double, open_time timestamp_ntz, close_time timestamp_ntz")
    got = simulation.trade_costs(x, F.lit(0.6), 0.2, 3e-5, 1e-5).collect()
    assert got[0].cost_pips == pytest.approx(got[1].cost_pips) == pytest.approx(1.0)


def test_normal_quantile_and_deflated_sharpe():
    assert evaluation.normal_quantile(0.975) == pytest.approx(1.959964, abs=1e-5)
    assert evaluation.deflated_sharpe(0.1, 1000, 0.0, 3.0, 1, 0.0) > evaluation.deflated_sharpe(0.1, 1000, 0.0, 3.0, 50, 0.01)


def test_folds_cover_the_end(spark):
    rows = [tuple(r) for r in evaluation.time_folds(spark.range(100), 4, 2, "id").orderBy("fold").collect()]
    assert rows == [(1, 20, 39, 17), (2, 40, 59, 37), (3, 60, 79, 57), (4, 80, 99, 77)]


def test_fold_windows(spark):
    got = spark.range(1).select(F.explode(evaluation.fold_windows("2020-01-01", "2021-01-01", 6, 3, 3)).alias("f")).select("f.*").collect()
    assert [(str(r.train_start), str(r.test_end)) for r in got] == [("2020-04-01", "2021-01-01"), ("2020-01-01", "2020-10-01")]


def test_permutation_importance_finds_the_feature(spark):
    rng = np.random.default_rng(0)
    x = pd.DataFrame({"a": rng.normal(size=400), "b": rng.normal(size=400)})
    x["y"] = (x.a + 0.1 * rng.normal(size=400) > 0).astype(int)
    df = spark.createDataFrame(x)
    m = models.fit_classifier(df, ["a", "b"], "y")
    metric = lambda s: evaluation.auc(s, "y", "score").first().auc
    assert models.permutation_importance(df, ["a", "b"], "y", m, metric)[0][0] == "a"
    s = models.scores(m, df, ["a", "b"])
    assert models.platt(s, "score", "y") is not None and models.platt(s.where("y = 1"), "score", "y") is None
    assert models.isotonic(s, "score", "y").transform(s).where("prediction < 0 or prediction > 1").count() == 0
    c = models.correlation_pairs(df.withColumn("c", F.col("a") * 2), ["a", "b", "c"])
    groups = models.correlation_clusters(c, ["a", "b", "c"], 0.3)
    assert groups["a"] == groups["c"] != groups["b"]


def test_mutual_information_counts_runs_once(spark):
    rows = [(k, i, float(v), y) for k, runs in (("a", ((1, 0, 5), (2, 1, 1), (1, 0, 3), (1, 1, 2))), ("b", ((1, 1, 4), (2, 1, 2)))) for i, (v, y) in enumerate((v, y) for v, y, n in runs for _ in range(n))]
    df = spark.createDataFrame(rows, "k string, i int, x double, y int")
    once = spark.createDataFrame([(1.0, 0), (2.0, 1), (1.0, 0), (1.0, 1), (1.0, 1), (2.0, 1)], "x double, y int")
    got, want = models.mutual_information(df, "x", "y", 2, ["k"], "i").first(), models.mutual_information(once, "x", "y", 2).first()
    assert got.n == want.n == 6 and got.mi == pytest.approx(want.mi)
    assert models.mutual_information(df, "x", "y", 2).first().n == 17


def test_nearest_fingerprints(spark):
    p = models.fingerprints(random_bars(spark), "close", ["symbol"], "ts", 20, 10)
    near = models.nearest_fingerprints(p, ["mean", "std"], F.col("window_id") == 0, 3).collect()
    assert len(near) == 3 and near[0].distance <= near[1].distance <= near[2].distance


def test_stream_equals_batch(spark, tmp_path):
    ticks = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).orderBy("ts")
    for i in range(3):
        ticks.where(F.pmod(F.dayofmonth("ts"), F.lit(3)) >= 0).where((F.dayofmonth("ts") - 1) / 11 >= i).where((F.dayofmonth("ts") - 1) / 11 < i + 1).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    source = spark.readStream.schema(ticks.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in/*"))
    q = streams.stream_bars(source, "event_type", "ts", "value", "event_id", late="60 days").writeStream.outputMode("complete").format("memory").queryName("bars").trigger(availableNow=True).start()
    q.awaitTermination()
    cols = ["symbol", "ts", "open", "high", "low", "close", "volume"]
    want = streams.stream_bars(ticks, "event_type", "ts", "value", "event_id")
    assert sorted(map(tuple, spark.table("bars").select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect()))


def test_stateful_runs(spark, tmp_path):
    rows = [("a", T0 + dt.timedelta(hours=i), v) for i, v in enumerate((1.0, 5.0, 6.0, 1.0, 7.0))]
    df = spark.createDataFrame(rows, "k string, ts timestamp, v double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = streams.stream_runs(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "k", "ts", "v", 4.0).writeStream.outputMode("update").format("memory").queryName("runs").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [tuple(r) for r in spark.table("runs").collect()] == [("a", 1, 2)]


def test_file_labels(spark):
    from tarnpike.operators import families

    x = spark.createDataFrame([(1, 1), (2, -1), (3, 0), (4, None)], "ts int, label int")
    got = {r.ts: tuple(r)[1:] for r in families.file_labels(x).collect()}
    assert got == {1: (1, 0, 1, 0), 2: (0, 1, 0, 1), 3: (0, 0, 0, 0), 4: (None,) * 4}
    for bad in (x.withColumn("label", F.lit(3)), x.unionByName(x), x.drop("label")):
        with pytest.raises(ValueError):
            families.file_labels(bad)


def test_regime_filter(spark):
    from tarnpike.operators import families

    x = spark.createDataFrame([(1, 0), (0, 1), (-1, -1), (None, None)], "regime_trend int, regime_volatility int")
    assert families.regime_filter(x, ["uptrend", "high_volatility"]).count() == 2
    assert [r[0] for r in x.select(families.signal_mask(x, -1, True)).collect()] == [False, False, True, False]
    with pytest.raises(ValueError):
        families.regime_filter(x, ["sideways"])


def test_run_names_and_checks(spark):
    from tarnpike.operators import research

    x = spark.createDataFrame([("alpha_wf03_s7__bt2024",), ("beta",), ("g_s1_wf12",)], "name string")
    got = [(r.base, r.fold, r.seed, r.test) for r in research.run_name_parts(x, "name").collect()]
    assert got == [("alpha", 3, 7, "2024"), ("beta", None, None, None), ("g", 12, 1, None)]
    names = "cv_accuracy double, trades int, win_rate double, total_pnl double, stop_share double, buy_pnl double, sell_pnl double, features int, features_selected int"
    checks = lambda *row: {r.check: r.status for r in research.health_checks(spark.createDataFrame([row], names)).collect()}
    assert checks(0.55, 20, 85.0, -1.0, 30.0, 5.0, -6.0, 100, 50) == {"cv_accuracy": "WARN", "trades": "WARN", "win_rate": "WARN", "total_pnl": "FAIL", "stops": "WARN", "balance": "WARN", "selection": "WARN"}
    assert checks(0.56, 30, 75.0, 1.0, 29.9, 5.0, 6.0, 100, 51) == dict.fromkeys(("cv_accuracy", "trades", "win_rate", "total_pnl", "stops", "balance", "selection"), "PASS")
    assert checks(0.52, 14, 78.0, None, 50.0, -5.0, 0.0, None, 3) == dict.fromkeys(("cv_accuracy", "trades", "win_rate", "stops", "balance"), "FAIL")
    z = spark.createDataFrame([(1, '{"a": {"b": 1, "c": "x"}, "d": 2.5, "e": "NaN"}'), (2, None), (3, "no json")], "id int, j string")
    assert {(r.id, r.metric, r.value) for r in research.flat_metrics(z, ["id"], "j").collect()} == {(1, "a/b", 1.0), (1, "d", 2.5)}


def test_tune_multiplier():
    from tarnpike.operators import research

    m, got = research.tune_multiplier(lambda k: max(0.0, 1 - k / 4), 0.1, 4.0, 0.03, 0.15)
    assert 0.03 <= got <= 0.15 and got == pytest.approx(1 - m / 4)


def test_correlation_of_constants_is_null(spark):
    x = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (None, 4.0)], "a double, b double")
    assert x.agg(safe.correlation("a", "b")).first()[0] is None


def test_half_spread_without_mid(spark):
    from tarnpike.operators import families

    b = make(spark, [1.0, 2.0]).withColumn("mid", F.lit(None).cast("double"))
    assert values(families.half_spread(b, 0.5), "half_spread") == [0.5, 0.5]


@pytest.mark.parametrize("down", [False, True])
def test_running_totals(spark, down):
    rng = np.random.default_rng(3)
    x = pd.DataFrame({"k": rng.permutation(500).astype(float), "v": rng.integers(0, 9, 500)})
    got = align.running_totals(spark.createDataFrame(x), "k", ["v"], descending=down, parts=7).toPandas().sort_values("k", ascending=not down)
    assert (got.v_run.to_numpy() == x.sort_values("k", ascending=not down).v.cumsum().to_numpy()).all()
    assert align.running_totals(spark.createDataFrame(x).limit(0), "k", ["v"]).count() == 0


def test_auc_without_keys(spark):
    x = spark.createDataFrame([(0, 0.1), (0, 0.4), (1, 0.35), (1, 0.8), (1, 0.4)], "y int, s double")
    assert evaluation.auc(x, "y", "s").first().auc == pytest.approx((1 + 2 + 1.5) / 6)


def test_calendar_and_bar_files(spark, tmp_path):
    (tmp_path / "c.csv").write_text("Name,Start,Impact,Currency\nRates,01/10/2024 13:45:00,HIGH,EUR\nRates,01/10/2024 13:45:00,HIGH,EUR\nBad,soon,LOW,USD\n")
    got = src.read_calendar(spark, str(tmp_path / "c.csv")).collect()
    assert [(r.name, r.ts) for r in got] == [("Rates", dt.datetime(2024, 1, 10, 13, 45))]
    b = make(spark, [1.0, 2.0, 3.0])
    src.write_bars(b, str(tmp_path / "bars"))
    back = spark.read.parquet(str(tmp_path / "bars"))
    assert back.where("symbol = 'A' and month = '2024-01'").count() == 3
    assert src.before_holdout(b, "ts", "2024-01-01 01:00:00").count() == 1 and src.before_holdout(b, "ts", "2024-01-01 01:00:00", unsealed=True).count() == 3


def test_event_clock_edges(spark):
    from tarnpike.operators import research

    day = lambda d: dt.datetime(2024, 1, d)
    b = spark.createDataFrame([("A", day(d) + dt.timedelta(hours=3)) for d in (8, 10, 11)], "symbol string, ts timestamp_ntz")
    e = spark.createDataFrame([(day(1),), (day(10),), (None,)], "day timestamp_ntz")
    got = [tuple(r) for r in research.event_clock(b, e, "x").orderBy("ts").select("x_until", "x_since", "x_cycle").collect()]
    assert got[0] == pytest.approx((2, 7, 7 / 9)) and got[1] == (0, 0, 1.0) and got[2] == (None, 1, None)


def test_conflicts_and_upsert(spark):
    x = spark.createDataFrame([(1, 1.0), (1, 1.0), (2, 1.0), (2, 2.0), (3, None), (3, 1.0), (4, None), (4, None)], "k int, v double")
    assert {r.k for r in src.conflicts(x, ["k"], ["v"]).collect()} == {2, 3}
    old, new = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, v double"), spark.createDataFrame([(2, None), (3, 3.0)], "k int, v double")
    assert {(r.k, r.v) for r in src.upsert(old, new, ["k"]).collect()} == {(1, 1.0), (2, 2.0), (3, 3.0)}


def test_no_nan(spark):
    x = spark.createDataFrame([(float("nan"), 1), (float("inf"), 2), (1.5, 3)], "a double, b int")
    assert [r.a for r in safe.no_nan(x).orderBy("b").collect()] == [None, None, 1.5]


def test_armed_race_in_both_forms(spark):
    b = random_bars(spark).withColumns({"target": F.lit(2.0), "stop": F.lit(1.5), "arm": F.when(F.hour("ts") % 3 == 0, 0.0).when(F.hour("ts") % 3 == 1, 1.2)})
    for h in (1, 6):
        slow, fast = (values(f(b, h, arm="arm"), "long", "short") for f in (labels.barrier_race, labels.barrier_race_fast))
        assert slow == fast
    assert values(labels.barrier_race(b, 6, arm="arm"), "long") != values(labels.barrier_race(b, 6), "long")


def test_long_recursions_cross_blocks(spark):
    """Thousands of values: many blocks of the fastest mean, some of the slowest."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=3000)
    b = spark.createDataFrame([("A", T0 + dt.timedelta(hours=i), float(v)) for i, v in enumerate(x)], "symbol string, ts timestamp_ntz, x double")
    got = safe.recursive_means(b, {"a": ("x", 0.5, 1), "b": ("x", 1 / 14, 14), "c": ("x", 0.01, 1)}).orderBy("ts").toPandas()
    for name, alpha, start in (("a", 0.5, 1), ("b", 1 / 14, 14), ("c", 0.01, 1)):
        assert got[name].to_numpy(float) == pytest.approx(ewm(x, alpha, start), rel=1e-7, abs=1e-10, nan_ok=True)


def test_event_scores_by_hand(spark):
    """True range 2 in every bar, so that scores can be read off."""
    rows = [(10, 12, 10, 11), (11, 13, 11, 12), (12, 14, 12, 13.5), (13.5, 15.5, 13.5, 15), (15, 15.5, 13.5, 14)]
    b = spark.createDataFrame([("A", T0 + dt.timedelta(hours=i), *map(float, x), 1.0, 0.0) for i, x in enumerate(rows)], "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double, mid double")
    x = sequences.bursts(sequences.impulse_burst(b, 2, 2), 2, 2)
    assert values(x, "atr_2") == [None, 2, 2, 2, 2]
    # bodies 1, 1, 1.5, 1.5, -1 over ranges of 2: sum / 2 true ranges times |sum| / sum of ranges
    assert values(x, "impulse_burst_2_2") == [None, 0.0, 2.5 / 2 * (2.5 / 4), 3 / 2 * (3 / 4), 0.0]
    assert values(x, "impulse_london_2_2") == [0.0] * 5  # at night
    assert values(x, "micro_burst_2_2") == [None, 1.0, 1.25, 1.5, 0.0]
    assert values(sequences.jumps(b, 2, 1, 0.7), "jump_reversion_2") == [None, 0.0, -0.75, -0.75, 0.0]
    assert values(sequences.break_retest(b, 2, 2), "failed_break_2_2")[-1] == (14 - 14) / 2 == 0.0


def test_first_higher_low_by_hand(spark):
    """A fall, then the first rising bar with a rising body, whose move ahead is large enough; one a window, none after the trend broke."""
    close = [10, 9, 9.5, 9.6, 12]
    b = make(spark, close, high=[10, 9.5, 9.6, 9.7, 12], low=[9, 8.5, 9, 9, 9])
    b = b.withColumns({"open": F.col("close") - 0.1, "window_id": F.lit(1), "setup": F.lit(1), "trend": F.lit(5.0)})
    assert values(labels.first_higher_low(b, "setup", "window_id", "trend", 2.0, 5, 35.0), "timing") == [0, 0, 1, 0, 0]
    assert values(labels.first_higher_low(b.withColumn("trend", F.lit(9.55)), "setup", "window_id", "trend", 2.0, 5, 35.0), "timing") == [0] * 5
    assert values(labels.first_higher_low(b.withColumn("setup", (F.col("close") < 10).cast("int")), "setup", "window_id", "trend", 2.0, 5, 35.0), "timing") == [0] * 5
