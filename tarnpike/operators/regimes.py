"""Market regimes: Gaussian hidden Markov models, mixtures and k-means, fitted for all series and numbers of states together.

A series is cut into chunks of time, one row each. A round of fitting gives sums of a chunk under each model, added up by Spark; the driver
holds one set of parameters for each series and number of states. What ties chunks of a hidden Markov model together is a product of k x k
matrices: a chunk's product stands for all its rows, products compose, and so each chunk learns the probabilities that reach it from both
sides without its rows meeting those of others. Within a chunk the products are pairwise scans, log2(rows) numpy steps.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tarnpike.functions.safe import mean_n, ordered, sdiv, sln, std_n
from tarnpike.operators import indicators
from tarnpike.operators.align import quantiles

#: chunks of a series whose products one task composes
COMPOSED = 512
#: rows of a series for a silhouette, about; beyond, a sample is drawn by hash
SILHOUETTE_ROWS = 5_000
#: added to variances, so that a state of equal rows has a density
RIDGE = 1e-6

MODEL = "k:int, restart:int, start:array<double>, move:array<double>, means:array<double>, covs:array<double>, active:boolean"


@dataclass
class Model:
    """Parameters of k states in scaled units. ``move`` matters to hidden Markov models alone; ``start`` are weights for mixtures."""

    start: np.ndarray
    move: np.ndarray
    means: np.ndarray
    covs: np.ndarray
    value: float = -np.inf  #: log likelihood; less the inertia for k-means
    rounds: int = 0
    active: bool = True

    @property
    def k(self) -> int:
        return len(self.start)


#: what regimes are told by
OBSERVED = ["drift", "realized_vol", "adx", "price_efficiency"]


def observations(bars: DataFrame, drift: int = 20, volatility: int = 20, adx: int = 14, efficiency: int = 20) -> DataFrame:
    """Bars with OBSERVED: mean and sample deviation of log returns, Wilder's directional index and the price efficiency, null in warm-up."""
    w = ordered("symbol")
    x = bars.withColumn("_r", sln(sdiv(F.col("close"), F.lag("close").over(w))))
    x = x.withColumns({"drift": mean_n("_r", w, drift), "realized_vol": std_n("_r", w, volatility)}).drop("_r")
    x = indicators.efficiency(indicators.adx(x, adx), efficiency)
    return x.select(*bars.columns, "drift", "realized_vol", "adx", F.col(f"efficiency_{efficiency}").alias("price_efficiency"))


# chunks of series ---------------------------------------------------------------------------------------------------


def series_chunks(df: DataFrame, features: list[str], keys: list[str], ts: str, seconds: int) -> DataFrame:
    """(keys, _chunk, _first, at, xs): rows with all features known, in chunks of ``seconds``. A chunk's rows are its times alone, however long its series is.

    Null keys are a series of their own. ``xs`` has the features of one row after the other.
    """
    known = df.where(F.forall(F.array(*(F.col(f).isNotNull() for f in features)), lambda x: x))
    chunk = F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / (seconds * 1_000_000))
    row = F.struct(F.col(ts).alias("at"), F.array(*(F.col(f).cast("double") for f in features)).alias("x"))
    chunks = known.groupBy(*keys, chunk.alias("_chunk")).agg(F.sort_array(F.collect_list(row)).alias("_rows"))
    chunks = chunks.select(*keys, "_chunk", F.col("_rows.at").alias("at"), F.flatten("_rows.x").alias("xs"))
    first = F.col("_chunk") == F.min("_chunk").over(Window.partitionBy(*keys))
    return chunks.withColumn("_first", first)


def scaling(df: DataFrame, features: list[str], keys: list[str]) -> DataFrame:
    """(keys, n, mean, scale): means and population deviations of rows with all features known; deviations of 0 count as 1."""
    known = df.where(F.forall(F.array(*(F.col(f).isNotNull() for f in features)), lambda x: x))
    sd = lambda f: F.coalesce(F.nullif(F.stddev_pop(f), F.lit(0.0)), F.lit(1.0))
    return known.groupBy(*keys).agg(F.count("*").alias("n"), F.array(*(F.avg(f) for f in features)).alias("mean"), F.array(*(sd(f) for f in features)).alias("scale"))


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join by keys, null keys alike."""
    renamed = b.withColumnsRenamed({c: f"_r_{c}" for c in keys})
    on = F.lit(True)
    for c in keys:
        on = on & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    return a.join(renamed, on).drop(*(f"_r_{c}" for c in keys))


def scaled_chunks(df: DataFrame, features: list[str], keys: list[str], ts: str, seconds: int) -> DataFrame:
    """``series_chunks`` in units of ``scaling``, whose columns are kept."""
    d = len(features)
    chunks = _same(series_chunks(df, features, keys, ts, seconds), scaling(df, features, keys), keys)
    unit = lambda x, i: (x - F.get("mean", (i % d).cast("int"))) / F.get("scale", (i % d).cast("int"))
    return chunks.withColumn("xs", F.transform("xs", unit))


# numpy: emissions, scans, sums --------------------------------------------------------------------------------------


def log_density(x: np.ndarray, means: np.ndarray, covs: np.ndarray) -> np.ndarray:
    """Log densities of rows under each state's normal distribution."""
    out = np.empty((len(x), len(means)))
    for j, (m, c) in enumerate(zip(means, covs, strict=True)):
        low = np.linalg.cholesky(c)
        z = np.linalg.solve(low, (x - m).T)
        out[:, j] = -0.5 * (z * z).sum(0) - np.log(np.diag(low)).sum() - 0.5 * len(m) * np.log(2 * np.pi)
    return out


def _scaled(ops: np.ndarray, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    top = np.maximum(ops.max((1, 2)), 1e-300)
    return ops / top[:, None, None], logs + np.log(top)


def running_products(ops: np.ndarray, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The products of the first 1, 2, ... of a row of matrices, each divided by its largest entry, whose log is told."""
    if len(ops) < 2:
        return ops, logs
    half, half_logs = _scaled(ops[0:-1:2] @ ops[1::2], logs[0:-1:2] + logs[1::2])
    even, even_logs = running_products(half, half_logs)
    out, out_logs = np.empty_like(ops), np.empty_like(logs)
    out[0], out_logs[0] = ops[0], logs[0]
    out[1::2], out_logs[1::2] = even, even_logs
    n = len(ops[2::2])
    out[2::2], out_logs[2::2] = _scaled(even[:n] @ ops[2::2], even_logs[:n] + logs[2::2])
    return out, out_logs


def whole_product(ops: np.ndarray, logs: np.ndarray) -> tuple[np.ndarray, float]:
    while len(ops) > 1:
        if len(ops) % 2:
            ops, logs = np.concatenate([ops, np.eye(ops.shape[1])[None]]), np.append(logs, 0.0)
        ops, logs = _scaled(ops[0::2] @ ops[1::2], logs[0::2] + logs[1::2])
    return ops[0], float(logs[0])


def step_matrices(density: np.ndarray, move: np.ndarray, first: bool) -> tuple[np.ndarray, np.ndarray]:
    """What one row does to the probabilities of states: they move, then meet the row's densities. The first row of a series moves nothing."""
    top = density.max(1)
    weight = np.exp(density - top[:, None])
    ops = (move + 1e-300)[None] * weight[:, None, :]
    if first:
        ops[0] = np.diag(weight[0])
    return ops, top


def forward(ops: np.ndarray, logs: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Probabilities of states after each row, given the rows up to it."""
    p = before @ running_products(ops, logs)[0]
    return p / p.sum(1, keepdims=True)


def backward(ops: np.ndarray, logs: np.ndarray, after: np.ndarray) -> np.ndarray:
    """What the rows after each row weigh its states by, up to a factor."""
    if len(ops) == 1:
        return after[None]
    flipped = np.transpose(ops[:0:-1], (0, 2, 1))
    w = (after @ running_products(flipped, logs[:0:-1])[0])[::-1]
    w = np.concatenate([w, after[None]])
    return w / w.sum(1, keepdims=True)


def chain_sums(x: np.ndarray, m: Model, before: np.ndarray, after: np.ndarray, first: bool) -> dict[str, np.ndarray]:
    """Expected counts of a chunk: states of the series' first row, moves, and rows, sums and products of each state."""
    ops, logs = step_matrices(log_density(x, m.means, m.covs), m.move, first)
    p, w = forward(ops, logs, before), backward(ops, logs, after)
    post = p * w
    post /= post.sum(1, keepdims=True)
    last = np.concatenate([before[None], p[:-1]])
    pair = last[:, :, None] * ops * w[:, None, :]
    pair /= np.maximum(pair.sum((1, 2), keepdims=True), 1e-300)
    if first:
        pair = pair[1:]
    return {"start": post[0] if first else np.zeros(m.k), "move": pair.sum(0).ravel(), **_moments(x, post)}


def _moments(x: np.ndarray, post: np.ndarray) -> dict[str, np.ndarray]:
    return {"n": post.sum(0), "sums": (post.T @ x).ravel(), "products": np.einsum("tk,ti,tj->kij", post, x, x, optimize=True).ravel()}


def point_sums(x: np.ndarray, m: Model, kind: str) -> tuple[dict[str, np.ndarray], float]:
    """The same for kinds without moves, with the value that fitting raises."""
    if kind == "kmeans":
        d = ((x[:, None] - m.means[None]) ** 2).sum(2)
        post, value = np.eye(m.k)[d.argmin(1)], -float(d.min(1).sum())
    else:
        logs = log_density(x, m.means, m.covs) + np.log(np.maximum(m.start, 1e-300))
        top = logs.max(1, keepdims=True)
        post = np.exp(logs - top)
        value = float((top[:, 0] + np.log(post.sum(1))).sum())
        post /= post.sum(1, keepdims=True)
    zero = np.zeros(m.k)
    return {"start": zero, "move": np.zeros(m.k * m.k), **_moments(x, post)}, value


def raised(m: Model, s: dict[str, np.ndarray], kind: str) -> Model:
    """The model that the sums make likeliest. States without rows keep their parameters."""
    k, d = m.means.shape
    n, sums, products = s["n"], s["sums"].reshape(k, d), s["products"].reshape(k, d, d)
    has = n > 1e-9
    safe = np.where(has, n, 1.0)
    means = np.where(has[:, None], sums / safe[:, None], m.means)
    covs = products / safe[:, None, None] - means[:, :, None] * means[:, None, :] + RIDGE * np.eye(d)
    covs = np.where(has[:, None, None], covs, m.covs)
    if kind == "kmeans":
        return Model(n / n.sum(), m.move, means, covs)
    if kind == "mixture":
        return Model(n / n.sum(), m.move, means, covs)
    move = s["move"].reshape(k, k)
    total = move.sum(1, keepdims=True)
    return Model(s["start"] / s["start"].sum(), np.where(total > 0, move / np.maximum(total, 1e-300), m.move), means, covs)


# models to and from rows --------------------------------------------------------------------------------------------


def _row(k: int, restart: int, m: Model) -> tuple:
    return k, restart, m.start.tolist(), m.move.ravel().tolist(), m.means.ravel().tolist(), m.covs.ravel().tolist(), m.active


def _model(r, d: int) -> Model:
    k = int(r["k"])
    arr = lambda name, *shape: np.array(r[name], float).reshape(shape)
    return Model(arr("start", k), arr("move", k, k), arr("means", k, d), arr("covs", k, d, d), active=bool(r["active"]))


def _models_table(chunks: DataFrame, keys: list[str], models: dict[tuple, Model]) -> DataFrame:
    """(keys, models): those of a series in one row."""
    by: dict[tuple, list[tuple]] = {}
    for (series, k, restart), m in models.items():
        by.setdefault(series, []).append(_row(k, restart, m))
    held = StructType.fromDDL(f"models array<struct<{MODEL}>>").fields
    schema = StructType([*(f for f in chunks.schema.fields if f.name in keys), *held])
    order = [f.name for f in schema.fields[:-1]]
    return chunks.sparkSession.createDataFrame([(*(s[keys.index(c)] for c in order), rows) for s, rows in by.items()], schema)


def _fields(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keys)


def _by_chunk(kernel: Callable, keys: list[str], d: int):
    """Runs ``kernel(chunk row, x, [(k, restart, model)])``, which gives rows that follow the keys, for each chunk."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for row in part.to_dict("records"):
                x = np.array(row["xs"], float).reshape(-1, d)
                models = [(int(r["k"]), int(r["restart"]), _model(r, d)) for r in row["models"] if r["active"]]
                out += [(*(row[c] for c in keys), *r) for r in kernel(row, x, models)]
            if out:
                yield pd.DataFrame(out)

    def named(columns: list[str]):
        def run_named(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in run(parts):
                p.columns = [*keys, *columns]
                yield p

        return run_named

    return named


# composing chunks ---------------------------------------------------------------------------------------------------


def _group(df: DataFrame, keys: list[str], *more: str) -> list[str]:
    return [*keys, "k", "restart", *more]


def longest(chunks: DataFrame, keys: list[str]) -> int:
    """Chunks of the series that has most."""
    return chunks.groupBy(*keys).agg(F.count("*").alias("_n")).agg(F.max("_n")).first()[0] or 0


def composed(products: DataFrame, keys: list[str], most: int) -> DataFrame:
    """(keys, k, restart, _chunk, before, after, value): what reaches each chunk from both sides, and the log likelihood of its series.

    ``products`` has a row for each chunk: its matrix and log, and the model's start; ``most`` is the number of chunks of the longest series. More than COMPOSED of them are composed by
    runs first, and the runs' rows in the same way, so that no task holds a row for each chunk of a long series.
    """
    outer = products.withColumns({"before": F.col("start"), "after": F.array_repeat(F.lit(1.0), F.size("start")), "_run": F.lit(0).cast("long")})
    if most > COMPOSED:
        place = F.row_number().over(Window.partitionBy(*_group(products, keys)).orderBy("_chunk")) - 1
        runs = products.withColumn("_run", F.floor(place / COMPOSED))
        whole = runs.groupBy(*_group(runs, keys, "_run")).applyInPandas(_run_product(keys), f"{_fields(products, keys)}, k int, restart int, _chunk long, matrix array<double>, log double, start array<double>")
        above = composed(whole, keys, -(-most // COMPOSED)).withColumnRenamed("_chunk", "_run")
        value = above.groupBy(*_group(above, keys)).agg(F.first("value").alias("value"))
        outer = _same(runs.drop("start"), above.drop("value"), [*keys, "k", "restart", "_run"])
        inner = outer.groupBy(*_group(outer, keys, "_run")).applyInPandas(_spread(keys), f"{_fields(products, keys)}, k int, restart int, _chunk long, before array<double>, after array<double>, value double").drop("value")
        return _same(inner, value, [*keys, "k", "restart"])
    return outer.groupBy(*_group(outer, keys, "_run")).applyInPandas(_spread(keys), f"{_fields(products, keys)}, k int, restart int, _chunk long, before array<double>, after array<double>, value double")


def _matrices(g: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray, int]:
    g = g.sort_values("_chunk", kind="stable")
    k = int(g.k.iloc[0])
    return g, np.array(g.matrix.tolist(), float).reshape(-1, k, k), g.log.to_numpy(float), k


def _run_product(keys: list[str]):
    def run(g: pd.DataFrame) -> pd.DataFrame:
        g, ops, logs, _ = _matrices(g)
        matrix, log = whole_product(ops, logs)
        r = g.iloc[0]
        return pd.DataFrame([(*(r[c] for c in keys), r.k, r.restart, r._run, matrix.ravel(), log, r.start)], columns=[*keys, "k", "restart", "_chunk", "matrix", "log", "start"])

    return run


def _spread(keys: list[str]):
    def run(g: pd.DataFrame) -> pd.DataFrame:
        g, ops, logs, _ = _matrices(g)
        before, after = np.array(g.before.iloc[0], float), np.array(g.after.iloc[0], float)
        products, all_logs = running_products(ops, logs)
        p = before @ products
        value = float(np.log(p[-1] @ after) + all_logs[-1]) if p[-1] @ after > 0 else -np.inf
        p /= p.sum(1, keepdims=True)
        out = g[[*keys, "k", "restart", "_chunk"]].copy()
        out["before"] = list(np.concatenate([before[None], p[:-1]]))
        out["after"] = list(backward(ops, logs, after))
        out["value"] = value
        return out

    return run


def _chunk_product(row: dict, x: np.ndarray, models: list) -> list[tuple]:
    out = []
    for k, restart, m in models:
        matrix, log = whole_product(*step_matrices(log_density(x, m.means, m.covs), m.move, bool(row["_first"])))
        out.append((k, restart, row["_chunk"], matrix.ravel(), log, m.start))
    return out


def reached(chunks: DataFrame, keys: list[str], d: int, most: int) -> DataFrame:
    """``composed`` of chunks that have ``models``."""
    schema = f"{_fields(chunks, keys)}, k int, restart int, _chunk long, matrix array<double>, log double, start array<double>"
    run = _by_chunk(_chunk_product, keys, d)(["k", "restart", "_chunk", "matrix", "log", "start"])
    return composed(chunks.mapInPandas(run, schema), keys, most)


# fitting ------------------------------------------------------------------------------------------------------------


_SUMS = ("start", "move", "n", "sums", "products")


def _chain_kernel(row: dict, x: np.ndarray, models: list) -> list[tuple]:
    sides = {(int(s["k"]), int(s["restart"])): s for s in row["sides"]}
    out = []
    for k, restart, m in models:
        s = sides[k, restart]
        sums = chain_sums(x, m, np.array(s["before"], float), np.array(s["after"], float), bool(row["_first"]))
        # each chunk names the series' log likelihood; the first one's counts
        out.append((k, restart, *(sums[name] for name in _SUMS), float(s["value"]) if row["_first"] else 0.0))
    return out


def _point_kernel(kind: str):
    def kernel(row: dict, x: np.ndarray, models: list) -> list[tuple]:
        out = []
        for k, restart, m in models:
            sums, value = point_sums(x, m, kind)
            out.append((k, restart, *(sums[name] for name in _SUMS), value))
        return out

    return kernel


def _round(chunks: DataFrame, keys: list[str], d: int, models: dict[tuple, Model], kind: str, most: int) -> dict[tuple, tuple[dict, float]]:
    """Sums and value of each model that is still being fitted."""
    own = _same(chunks, _models_table(chunks, keys, {key: m for key, m in models.items() if m.active}), keys)
    kernel = _point_kernel(kind)
    if kind == "hmm":
        sides = reached(own, keys, d, most).groupBy(*keys, "_chunk").agg(F.collect_list(F.struct("k", "restart", "before", "after", "value")).alias("sides"))
        own, kernel = _same(own, sides, [*keys, "_chunk"]), _chain_kernel
    columns = ["k", "restart", *_SUMS, "value"]
    schema = f"{_fields(chunks, keys)}, k int, restart int, {', '.join(f'{x} array<double>' for x in _SUMS)}, value double"
    found = own.mapInPandas(_by_chunk(kernel, keys, d)(columns), schema)
    # one row a place of an array, so that sums are partial before the shuffle
    flat = found.select(*keys, "k", "restart", "value", F.posexplode(F.concat(*_SUMS)).alias("_place", "_x"))
    cells = flat.groupBy(*keys, "k", "restart", "_place").agg(F.sum("_x").alias("_x"), F.sum("value").alias("value"))
    rows = cells.groupBy(*keys, "k", "restart").agg(F.sort_array(F.collect_list(F.struct("_place", "_x"))).alias("cells"), F.first("value").alias("value"))
    out = {}
    for r in rows.select(*keys, "k", "restart", F.col("cells._x").alias("x"), "value").collect():  # one row a model
        k, x = r.k, np.array(r.x, float)
        ends = np.cumsum([k, k * k, k, k * d, k * d * d])
        out[(tuple(r[c] for c in keys), k, r.restart)] = dict(zip(_SUMS, np.split(x, ends[:-1]), strict=True)), r.value
    return out


def _fitted(chunks: DataFrame, keys: list[str], d: int, models: dict[tuple, Model], kind: str, rounds: int, least: Callable[[tuple], float]) -> dict[tuple, Model]:
    """Rounds until no model's value rises by more than ``least`` of its key."""
    models, most = dict(models), longest(chunks, keys) if kind == "hmm" else 0
    for i in range(rounds + 1):
        if not any(m.active for m in models.values()):
            break
        for key, (sums, value) in _round(chunks, keys, d, models, kind, most).items():
            old = models[key]
            if i == rounds or value - old.value <= least(key):
                models[key] = Model(old.start, old.move, old.means, old.covs, value, i, False)
            else:
                new = raised(old, sums, kind)
                new.value, new.rounds = value, i + 1
                models[key] = new
    return models


def _starts(chunks: DataFrame, keys: list[str], d: int, ks: list[int], restarts: int, seed: int) -> dict[tuple, Model]:
    """Models whose means are rows of the series, picked by hash."""
    most = max(ks)
    row = F.explode(F.arrays_zip("at", F.sequence(F.lit(0), F.size("at") - 1).alias("i"))).alias("_r")
    x = chunks.select(*keys, row, "xs").select(*keys, F.col("_r.at").alias("at"), F.slice("xs", F.col("_r.i") * d + 1, d).alias("x"))
    x = x.withColumn("restart", F.explode(F.array(*(F.lit(i) for i in range(restarts))))).withColumn("_h", F.xxhash64(F.lit(seed), "restart", "at"))
    place = F.row_number().over(Window.partitionBy(*keys, "restart").orderBy("_h", "at", "x"))
    found: dict[tuple, list] = {}
    for r in x.withColumn("_place", place).where(F.col("_place") <= most).orderBy("_place").collect():  # as many rows as states of a series and restart
        found.setdefault((tuple(r[c] for c in keys), r.restart), []).append(r.x)
    out = {}
    for (series, restart), rows in found.items():
        for k in ks:
            if len(rows) >= k:
                out[series, k, restart] = Model(np.full(k, 1 / k), np.full((k, k), 1 / k), np.array(rows[:k], float), np.tile(np.eye(d), (k, 1, 1)))
    return out


def fit_models(chunks: DataFrame, keys: list[str], d: int, kind: str, ks: list[int], seed: int = 42, rounds: int = 100, restarts: int = 4) -> dict[tuple, Model]:
    """{(series, k): model} for each series of ``scaled_chunks`` and number of states: ``kind`` is hmm, mixture or kmeans.

    k-means begins at rows picked by hash, ``restarts`` times, and the best one counts; mixtures begin with its clusters, hidden Markov models with its
    means, the deviation of the whole series (1 in each feature) and even moves. Fitting ends when the log likelihood rises by 0.001 or less, of
    mixtures by row, and after ``rounds``. Series with fewer than ten rows a state have no model.
    """
    chunks = chunks.persist()
    try:
        enough = {tuple(r[c] for c in keys): r.n for r in chunks.select(*keys, "n").distinct().collect()}
        ks_of = lambda s: [k for k in ks if enough[s] >= 10 * k]
        begun = {key: m for key, m in _starts(chunks, keys, d, ks, restarts, seed).items() if key[1] in ks_of(key[0])}
        grouped = _fitted(chunks, keys, d, begun, "kmeans", 50, lambda key: 0.0)
        best: dict[tuple, Model] = {}
        for (series, k, _), m in grouped.items():
            if (series, k) not in best or m.value > best[series, k].value:
                best[series, k] = m
        if kind == "kmeans":
            return best
        begin = {}
        for (series, k), m in best.items():
            covs = m.covs if kind == "mixture" else np.tile(np.eye(d) * (1 + 1e-3), (k, 1, 1))
            begin[series, k, 0] = Model(m.start if kind == "mixture" else np.full(k, 1 / k), np.full((k, k), 1 / k), m.means, covs)
        done = _fitted(chunks, keys, d, begin, kind, rounds, lambda key: 1e-3 * (enough[key[0]] if kind == "mixture" else 1))
        return {(series, k): m for (series, k, _), m in done.items()}
    finally:
        chunks.unpersist()


# meaning, inference, choice -----------------------------------------------------------------------------------------


def meaning(means: np.ndarray, drift: int = 0, volatility: int = 1, efficiency: int = -1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, trend scores, volatility scores) of states by their means in plain units, both scores in that order.

    Volatility goes from 0 to 1 between the least and the largest. Trend is the drift against the mean of the states, by its largest size, times the
    efficiency by its largest. States are ordered by trend, then volatility, so that they keep their names when fitted anew.
    """
    over = lambda a, by: a / by if by > 0 else None
    v = means[:, volatility]
    vol = over(v - v.min(), v.max() - v.min())
    vol = np.zeros(len(v)) if vol is None else vol
    away = means[:, drift] - means[:, drift].mean()
    direction = over(away, np.abs(away).max())
    quality = over(means[:, efficiency], np.abs(means[:, efficiency]).max())
    trend = np.clip((np.zeros(len(v)) if direction is None else direction) * (1.0 if quality is None else quality), -1, 1)
    order = np.lexsort((vol, trend))
    return order, trend[order], vol[order]


def _infer_kernel(kind: str, temperature: float):
    def kernel(row: dict, x: np.ndarray, models: list) -> list[tuple]:
        sides = {int(s["k"]): s for s in row["sides"]} if kind == "hmm" else {}
        out = []
        for k, _, m in models:
            if kind == "hmm":
                ops, logs = step_matrices(log_density(x, m.means, m.covs), m.move, bool(row["_first"]))
                p = forward(ops, logs, np.array(sides[k]["before"], float))
            else:
                logits = -((x[:, None] - m.means[None]) ** 2).sum(2) / max(temperature, 1e-8) if kind == "kmeans" else log_density(x, m.means, m.covs) + np.log(np.maximum(m.start, 1e-300))
                p = np.exp(logits - logits.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
            mean, scale = np.array(row["mean"], float), np.array(row["scale"], float)
            order, trend, vol = meaning(m.means * scale + mean)
            p = p[:, order]
            p /= p.sum(1, keepdims=True)
            out += [(at, k, q, int(q.argmax()), float(q @ trend), float(q @ vol), float(q.max()), v) for at, q, v in zip(row["at"], p, x, strict=True)]
        return out

    return kernel


def infer(chunks: DataFrame, keys: list[str], d: int, models: dict[tuple, Model], kind: str, ts: str = "ts", temperature: float = 1.0) -> DataFrame:
    """(keys, ts, k, prob, label, trend_score, vol_score, conf, x) of each row, causal: from the rows up to it and the models.

    Probabilities are in the order of ``meaning``. Features are drift, volatility, others, and efficiency at the end. ``x`` is the row in scaled units.
    """
    own = _same(chunks, _models_table(chunks, keys, {(s, k, 0): Model(m.start, m.move, m.means, m.covs) for (s, k), m in models.items()}), keys)
    if kind == "hmm":
        sides = reached(own, keys, d, longest(chunks, keys)).groupBy(*keys, "_chunk").agg(F.collect_list(F.struct("k", "before")).alias("sides"))
        own = _same(own, sides, [*keys, "_chunk"])
    at = chunks.schema["at"].dataType.elementType.simpleString()
    schema = f"{_fields(chunks, keys)}, `{ts}` {at}, k int, prob array<double>, label int, trend_score double, vol_score double, conf double, x array<double>"
    return own.mapInPandas(_by_chunk(_infer_kernel(kind, temperature), keys, d)([ts, "k", "prob", "label", "trend_score", "vol_score", "conf", "x"]), schema)


def silhouette(x: np.ndarray, labels: np.ndarray) -> float | None:
    """Mean over rows of (b - a) / max(a, b): a is the mean distance to the own cluster's others, b the least mean distance to another cluster. 0 for lone rows."""
    kinds, own = np.unique(labels, return_inverse=True)
    if len(kinds) < 2:
        return None
    member = np.eye(len(kinds))[own]
    size = member.sum(0)
    total = 0.0
    for i in range(0, len(x), 512):
        far = np.sqrt(np.maximum(((x[i : i + 512, None] - x[None]) ** 2).sum(2), 0)) @ member
        mine = own[i : i + 512]
        rows = np.arange(len(mine))
        a = far[rows, mine] / np.maximum(size[mine] - 1, 1)
        mean = far / size
        mean[rows, mine] = np.inf
        b = mean.min(1)
        total += float(np.where(size[mine] > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0.0).sum())
    return total / len(x)


def select_states(df: DataFrame, features: list[str], keys: list[str], ts: str, seconds: int, kind: str, ks: list[int], seed: int = 42, **options) -> DataFrame:
    """(keys, k, n, loglik, bic, aic, inertia, silhouette, best): each number of states of each series, and whether it is the series' choice: the least BIC,
    or for k-means the largest silhouette; the fewest states of equal ones.

    Free parameters are those of starts (or weights), moves, means and covariances. Silhouettes beyond SILHOUETTE_ROWS rows are of about so many, picked by hash.
    """
    chunks = scaled_chunks(df, features, keys, ts, seconds).persist()
    d = len(features)
    models = fit_models(chunks, keys, d, kind, ks, seed, **options)
    n = {tuple(r[c] for c in keys): r.n for r in chunks.select(*keys, "n").distinct().collect()}
    rows = []
    for (series, k), m in models.items():
        free = k - 1 + k * d + k * d * (d + 1) // 2 + (k * (k - 1) if kind == "hmm" else 0)
        chain = kind != "kmeans"
        loglik = float(m.value) if chain else None
        rows.append((*series, k, n[series], loglik, -2 * loglik + free * float(np.log(n[series])) if chain else None, -2 * loglik + 2 * free if chain else None, None if chain else -float(m.value)))
    scored = df.sparkSession.createDataFrame(rows, f"{_fields(chunks, keys)}, k int, n long, loglik double, bic double, aic double, inertia double")
    found = _same(infer(chunks, keys, d, models, kind, "_at"), scored.select(*keys, "k", "n"), [*keys, "k"])
    share = F.least(F.lit(1.0), F.lit(float(SILHOUETTE_ROWS)) / F.col("n"))
    sampled = found.where(F.pmod(F.xxhash64("_at"), F.lit(1 << 30)) < share * (1 << 30)).select(*keys, "k", "label", "x")

    def measure(g: pd.DataFrame) -> pd.DataFrame:
        r = g.iloc[0]
        return pd.DataFrame([(*(r[c] for c in keys), r.k, silhouette(np.array(g.x.tolist(), float), g.label.to_numpy()))], columns=[*keys, "k", "silhouette"])

    measured = sampled.groupBy(*keys, "k").applyInPandas(measure, f"{_fields(chunks, keys)}, k int, silhouette double")
    out = scored.join(measured.withColumnsRenamed({c: f"_r_{c}" for c in (*keys, "k")}), _on([*keys, "k"]), "left").drop(*(f"_r_{c}" for c in (*keys, "k")))
    w = Window.partitionBy(*keys).orderBy(F.col("silhouette").desc_nulls_last() if kind == "kmeans" else F.col("bic").asc_nulls_last(), "k")
    return out.withColumn("best", F.row_number().over(w) == 1)


def _on(keys: list[str]):
    on = F.lit(True)
    for c in keys:
        on = on & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    return on


def regime_scores(df: DataFrame, features: list[str], keys: list[str], ts: str, seconds: int, kind: str, k: int, seed: int = 42, fit_until=None, temperature: float = 1.0, **options) -> DataFrame:
    """``df`` with rgm_prob_s0.., rgm_label, rgm_trend_score, rgm_vol_score and rgm_conf, null where a feature is; rows of one series and time must be one.

    Models are fitted on rows before ``fit_until`` (all, if none) and read every row causally. Series with too few rows have nulls.
    """
    fitted_on = df if fit_until is None else df.where(F.col(ts) < fit_until)
    d = len(features)
    models = fit_models(scaled_chunks(fitted_on, features, keys, ts, seconds), keys, d, kind, [k], seed, **options)
    units = scaling(fitted_on, features, keys)
    unit = lambda x, i: (x - F.get("mean", (i % d).cast("int"))) / F.get("scale", (i % d).cast("int"))
    chunks = _same(series_chunks(df, features, keys, ts, seconds), units, keys).withColumn("xs", F.transform("xs", unit))
    found = infer(chunks, keys, d, models, kind, ts, temperature)
    columns = [F.get("prob", F.lit(i)).alias(f"rgm_prob_s{i}") for i in range(k)] + [F.col(c).alias(f"rgm_{c}") for c in ("label", "trend_score", "vol_score", "conf")]
    right = found.select(*(F.col(c).alias(f"_r_{c}") for c in (*keys, ts)), *columns)
    return df.join(right, _on([*keys, ts]), "left").drop(*(f"_r_{c}" for c in (*keys, ts)))


def markov_filter(df: DataFrame, x: str, keys: list[str], ts: str, means: list[float], sds: list[float], stay: float, seconds: int) -> DataFrame:
    """(keys, ts, prob): probabilities of normal states with given parameters, given the values so far, which begin even and move at each row;
    where x is null, they only move. Chunks of ``seconds`` compose as those of fitted models."""
    k = len(means)
    m, sd = np.array(means), np.array(sds)
    move = np.full((k, k), (1 - stay) / max(k - 1, 1))
    np.fill_diagonal(move, stay if k > 1 else 1.0)
    row = F.struct(F.col(ts).alias("at"), F.coalesce(F.col(x).cast("double"), F.lit(float("nan"))).alias("x"))
    chunk = F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / (seconds * 1_000_000))
    chunks = df.groupBy(*keys, chunk.alias("_chunk")).agg(F.sort_array(F.collect_list(row)).alias("_rows")).select(*keys, "_chunk", F.col("_rows.at").alias("at"), F.col("_rows.x").alias("xs"))

    def steps(values) -> tuple[np.ndarray, np.ndarray]:
        v = np.array(values, float)[:, None]
        return step_matrices(np.where(np.isnan(v), 0.0, -0.5 * ((v - m) / sd) ** 2 - np.log(sd)), move, False)

    def product(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = p[[*keys, "_chunk"]].copy()
            found = [whole_product(*steps(v)) for v in p["xs"]]
            out["k"], out["restart"], out["matrix"], out["log"] = k, 0, [a.ravel() for a, _ in found], [b for _, b in found]
            out["start"] = [np.full(k, 1 / k)] * len(p)
            yield out

    def filtered(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = [(*(r[c] for c in keys), at, q) for r in p.to_dict("records") for at, q in zip(r["at"], forward(*steps(r["xs"]), np.array(r["before"], float)), strict=True)]
            if out:
                yield pd.DataFrame(out, columns=[*keys, ts, "prob"])

    products = chunks.mapInPandas(product, f"{_fields(df, keys)}, _chunk long, k int, restart int, matrix array<double>, log double, start array<double>")
    own = _same(chunks, composed(products, keys, longest(chunks, keys)).select(*keys, "_chunk", "before"), [*keys, "_chunk"])
    return own.mapInPandas(filtered, f"{_fields(df, keys)}, `{ts}` {df.schema[ts].dataType.simpleString()}, prob array<double>")


def checked_states(scores: DataFrame, kind: str, made_by: str, wanted: list[int]) -> DataFrame:
    """``scores``, if they were made by the kind of model and have the states that are asked for; else an error that says which is not so."""
    if made_by != kind:
        raise ValueError(f"scores of {made_by}, asked for {kind}")
    missing = [s for s in wanted if f"rgm_prob_s{s}" not in scores.columns]
    if missing:
        raise ValueError(f"no states {missing} in scores of {sum(c.startswith('rgm_prob_s') for c in scores.columns)} states")
    return scores


def state_economics(df: DataFrame, state: str, close: str, keys: list[str], ts: str, scores: tuple[str, ...] = ()) -> DataFrame:
    """(keys, state, n, means of the scores, fwd_ret_bp, fwd_vol_bp, dwell): the next bar's log return by state, its mean and sample deviation in
    hundredths of a percent over bars that have all, and the mean length of runs of one state over all states of the series."""
    w = Window.partitionBy(*keys).orderBy(ts)
    known = F.col(state).isNotNull()
    next_ = F.ln(F.lead(close).over(w) / F.col(close))
    runs = df.where(known).withColumn("_new", F.when(F.lag(state).over(w).eqNullSafe(F.col(state)), 0).otherwise(1))
    dwell = runs.groupBy(*keys).agg((F.count("*") / F.sum("_new")).alias("dwell"))
    rows = df.withColumn("_next", next_).where(known & F.col("_next").isNotNull())
    for s in scores:
        rows = rows.where(F.col(s).isNotNull())
    table = rows.groupBy(*keys, state).agg(F.count("*").alias("n"), *(F.avg(s).alias(s) for s in scores), (1e4 * F.avg("_next")).alias("fwd_ret_bp"), (1e4 * F.stddev_samp("_next")).alias("fwd_vol_bp"))
    return _same(table, dwell, keys)


def share_threshold(df: DataFrame, score: str, share: float) -> DataFrame:
    """(threshold): the size of a score that ``share`` of the known rows reach."""
    sizes = df.where(F.col(score).isNotNull()).select(F.abs(score).alias("_s"))
    return quantiles(sizes, "_s", [1 - share]).select(F.get("quantiles", F.lit(0)).alias("threshold"))
