"""Stable selection of features: backward elimination over rolling windows, from one pass over the rows.

A linear model's fit on any stretch of time, and its errors on any other, follow from sums of products. These are taken once by calendar block; windows are sums of
blocks, so that candidates, windows and steps cost small matrices and no further job.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnpike.operators.models import linked
from tarnpike.operators.unitroot import normal_equations

#: fewest rows of a window's training and of a block that is tested
LEAST_TRAIN, LEAST_TEST = 50, 5
VOTES = "phase string, step int, candidate string, mean_delta double, n_pass int, n_windows int, passes boolean, dropped boolean"


@dataclass
class Window:
    """Sums of products of the training rows, and of each block that is tested."""

    label: str
    train: np.ndarray
    tests: list[np.ndarray]


@dataclass
class Selection:
    """What is kept, and the votes that led there: (phase, step, candidate, mean_delta, n_pass, n_windows, passes, dropped)."""

    kept: list[str]
    votes: list[tuple] = field(default_factory=list)
    reason: str = ""


def block_sums(df: DataFrame, features: list[str], y: str, ts: str, start: str, embargo_days: int) -> dict[tuple[int, bool], np.ndarray]:
    """{(months since ``start``, within the embargo after the block begins): sums of products of 1, the features and the label}, over rows that know all."""
    at = F.col(ts).cast("timestamp")
    begin = F.lit(start).cast("timestamp")
    block = F.floor(F.months_between(at, begin)).cast("int")
    x = df.where(at >= begin).select(F.lit(1.0).alias("_one"), *(F.col(c).cast("double").alias(c) for c in (*features, y)), block.alias("_block"), at.alias("_at"))
    x = x.withColumn("_early", F.col("_at") < F.add_months(F.lit(start).cast("date"), F.col("_block")).cast("timestamp") + F.make_dt_interval(F.lit(embargo_days)))
    d = len(features) + 2
    out: dict[tuple[int, bool], np.ndarray] = {}
    for r in normal_equations(x, ["_one", *features, y], ["_block", "_early"]).collect():  # two squares of the number of columns a block
        out.setdefault((r["_block"], r["_early"]), np.zeros((d, d)))[r.i, r.j] = r.v
    return out


def rolling_windows(sums: dict[tuple[int, bool], np.ndarray], train: int, test: int, step: int) -> list[Window]:
    """Windows of ``train`` blocks and the ``test`` blocks after them, the first of these without its embargo, ``step`` blocks apart. Windows with too few rows raise:
    they would pass every candidate."""
    last = max((b for b, _ in sums), default=-1)
    none = np.zeros_like(next(iter(sums.values()))) if sums else np.zeros((2, 2))
    both = lambda b: sums.get((b, True), none) + sums.get((b, False), none)
    out = []
    for first in range(0, last + 2 - train - test, step):
        fitted = sum((both(b) for b in range(first, first + train)), none)
        tests = [sums.get((first + train, False), none), *(both(b) for b in range(first + train + 1, first + train + test))]
        tests = [t for t in tests if t[0, 0] >= LEAST_TEST]
        varies = fitted[-1, -1] * fitted[0, 0] > fitted[0, -1] ** 2 * (1 + 1e-12)
        if fitted[0, 0] < LEAST_TRAIN or not varies or len(tests) < 2:
            raise ValueError(f"the window from block {first} has too few rows or one label")
        out.append(Window(f"{first}..{first + train}..{first + train + test}", fitted, tests))
    return out


def _skills(w: Window, columns: list[int], ridge: float = 1e-6) -> np.ndarray:
    """1 - squared error over that of the training mean, in each tested block, of least squares on the columns."""
    a, y = w.train, w.train.shape[0] - 1
    use = [0, *columns]
    x = a[np.ix_(use, use)] + ridge * a[0, 0] * np.diag([0.0, *np.maximum(np.diag(a)[columns] / a[0, 0], 1e-12)])
    beta = np.linalg.solve(x, a[use, y])
    mean = a[0, y] / a[0, 0]
    out = []
    for t in w.tests:
        error = t[y, y] - 2 * beta @ t[use, y] + beta @ t[np.ix_(use, use)] @ beta
        base = t[y, y] - 2 * mean * t[0, y] + mean * mean * t[0, 0]
        out.append(1 - error / max(base, 1e-300))
    return np.array(out)


def non_inferior(deltas: np.ndarray, margin: float) -> bool:
    """Whether the lower end of the mean's 95 % interval stays above -margin. One delta has no interval and does not pass."""
    if len(deltas) < 2:
        return False
    return bool(deltas.mean() - 1.96 * deltas.std(ddof=1) / np.sqrt(len(deltas)) > -margin)


def vote(windows: list[Window], base: list[int], candidates: dict[str, list[int]], margin: float, agree: int) -> dict[str, tuple[float, int, bool]]:
    """{candidate: (mean delta, windows where it is not inferior to the base, whether these are ``agree`` or more)}."""
    usual = [_skills(w, base) for w in windows]
    out = {}
    for name, columns in candidates.items():
        deltas = [_skills(w, columns) - u for w, u in zip(windows, usual, strict=True)]
        n = sum(non_inferior(d, margin) for d in deltas)
        out[name] = float(np.mean([d.mean() for d in deltas])), n, n >= agree
    return out


def eliminate(windows: list[Window], features: list[str], margin: float, agree: int = 0, confirm: int = 1, distance: float = 0.2, most_steps: int = 40, kept: list[str] | None = None) -> Selection:
    """Collapse of correlated features, then backward elimination on all but the last ``confirm`` windows, then the result against all features on those.

    Groups of features linked below ``distance`` (1 - |r| over the training rows) collapse to their first one if that is not inferior. In each step every feature that is left is tried without; of
    those that pass in ``agree`` windows (all, if 0) the one whose loss raises the skill most goes, the first by name of equal ones. ``kept`` resumes from what an earlier run had left, without the
    collapse. A selection that is inferior on the confirming windows is not taken: all features stay.
    """
    if len(windows) < confirm + 2:
        raise ValueError(f"{len(windows)} windows, {confirm + 2} are needed")
    search, last = windows[: len(windows) - confirm], windows[len(windows) - confirm :]
    agree = len(search) if not agree else min(agree, len(search))
    place = {f: i + 1 for i, f in enumerate(features)}
    at = lambda fs: [place[f] for f in fs]
    current = list(kept or features)
    out = Selection(current)
    if kept is None:
        a = sum(w.train for w in search)
        spread = np.sqrt(np.maximum(np.diag(a) * a[0, 0] - a[0] ** 2, 1e-300))
        r = (a * a[0, 0] - np.outer(a[0], a[0])) / np.outer(spread, spread)
        groups = linked({f: {g: 0.0 if f == g else 1 - abs(float(r[place[f], place[g]])) for g in features} for f in features}, features, distance)
        firsts = [f for f in features if any(g[0] == f for g in (sorted(g, key=features.index) for g in groups))]
        if len(firsts) < len(features):
            mean, n, passes = vote(search, at(features), {"collapse": at(firsts)}, margin, agree)["collapse"]
            out.votes.append(("collapse", 0, ",".join(f for f in features if f not in firsts), mean, n, len(search), passes, passes))
            current = firsts if passes else current
    out.reason = "one feature is left"
    for step in range(1, len(features) + 1):
        if len(current) < 2:
            break
        if step > most_steps:
            out.reason = "most steps are taken"
            break
        found = vote(search, at(current), {f: at(x for x in current if x != f) for f in current}, margin, agree)
        passing = sorted((f for f in current if found[f][2]), key=lambda f: (-found[f][0], f))
        out.votes += [("eliminate", step, f, found[f][0], found[f][1], len(search), found[f][2], bool(passing) and f == passing[0]) for f in current]
        if not passing:
            out.reason = "no feature can go"
            break
        current = [f for f in current if f != passing[0]]
    if last and current != list(features):
        mean, n, passes = vote(last, at(features), {"kept": at(current)}, margin, len(last))["kept"]
        out.votes.append(("confirm", 0, ",".join(current), mean, n, len(last), passes, False))
        if not passes:
            current, out.reason = list(features), "not confirmed"
    out.kept = current
    return out


def stable_selection(df: DataFrame, features: list[str], y: str, ts: str, start: str, train: int = 18, test: int = 6, step: int = 6, embargo_days: int = 5, margin: float = 0.017, **options) -> tuple[list[str], DataFrame]:
    """(features kept, votes): see ``eliminate`` for its options. Blocks are months from ``start``; a window trains on ``train`` of them and tests on the next ``test``."""
    found = eliminate(rolling_windows(block_sums(df, features, y, ts, start, embargo_days), train, test, step), features, margin, **options)
    return found.kept, df.sparkSession.createDataFrame(found.votes, VOTES)
