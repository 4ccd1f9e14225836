"""Every registered query: against its SQL where it has one, else that it gives rows."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import numpy as np
import pytest
from oracle import assert_same, connection
from pyspark.sql import functions as F

from tarnpike.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    if name in registry.ORACLE_SQL:
        assert_same(got, registry.ORACLE_SQL[name], duck)
    else:
        assert len(got)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert registry.FLAGSHIP in entry.queries()


def test_models_score_every_symbol(spark, duck):
    symbols = {x for (x,) in duck.sql("SELECT DISTINCT o_orderpriority FROM orders").fetchall()}
    scored = registry.QUERIES["out_of_fold_scores"](spark, SF).toPandas()
    assert set(scored.symbol) == symbols and not scored.duplicated(["symbol", "ts"]).any()
    assert (scored.groupby("ts").fold.nunique() == 1).all()
    states = registry.QUERIES["regime_mixture"](spark, SF).toPandas()
    assert set(states.symbol) == symbols
    assert states.groupby("symbol").share.sum().to_numpy() == pytest.approx(1.0)


def test_the_rest_works_without_the_text_operators(tmp_path):
    """A copy without the text operators, their tests and with or without the pipeline's file still has all other queries."""
    root = Path(__file__).resolve().parents[1]
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and not any(n.startswith('op') and n[2].isdigit() or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    for pipeline in (True, False):
        copy = tmp_path / f"copy_{pipeline}"
        shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", ".pytest_cache", *([] if pipeline else ["corpus_pipeline.py"])))
        done = subprocess.run([sys.executable, "-c", code], cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)}, capture_output=True, text=True)
        assert done.returncode == 0, done.stderr


def test_deflated_sharpe_by_hand(spark, duck):
    """Bailey and Lopez de Prado's formula on the strategies' returns."""
    from statistics import NormalDist

    norm = NormalDist()
    returns = {}
    for k, v in duck.sql("SELECT o_orderpriority, o_totalprice - 150000 FROM orders").fetchall():
        returns.setdefault(k, []).append(v)
    ratio, shape = {}, {}
    for k, v in returns.items():
        x = np.array(v)
        z = (x - x.mean()) / x.std()
        ratio[k], shape[k] = x.mean() / x.std(ddof=1), ((z**3).mean(), (z**4).mean())
    n, euler = len(ratio), 0.5772156649015329
    best = np.std(list(ratio.values()), ddof=1) * ((1 - euler) * norm.inv_cdf(1 - 1 / n) + euler * norm.inv_cdf(1 - 1 / (n * np.e)))
    for r in registry.QUERIES["deflated_sharpe"](spark, SF).collect():
        s, (skew, kurt) = ratio[r.strategy], shape[r.strategy]
        assert r.n == len(returns[r.strategy]) and r.sharpe == pytest.approx(s, abs=1e-6)
        assert r.deflated == pytest.approx(norm.cdf((s - best) * np.sqrt(r.n - 1) / np.sqrt(1 - skew * s + (kurt - 1) / 4 * s * s)), abs=1e-5)


@pytest.mark.parametrize(
    "orders",
    [
        [("1995-01-01", 250000.0), ("1995-01-03", 160000.0), ("1996-01-01", 150001.0)],  # no loss: infinite ratios
        [("1995-01-01", 250000.0), ("1995-01-03", 1000.0), (None, 7.0), ("1995-01-09", None)],
        [("1995-01-01", 150000.0), ("1995-01-02", 150000.0)],  # nothing won or lost: 0 / 0
        [("1995-01-01", 150000.0)],  # one day
        [("1995-01-01", 250000.0)],
        [("1995-01-01", 1000.0)],
        [("1995-01-01", 250000.0), ("1995-01-05", -2e9)],  # ends below nothing
        [("1995-01-01", 250000.0), ("1995-01-05", 150000.0 - 1e9 - 1e5)],  # ends at nothing
        [("1995-01-01", 1e30), ("1995-01-05", 1e30)],  # the capital is lost in rounding
        [(None, 5.0)],
        [],
    ],
)
def test_equity_metrics_have_the_limits_of_their_sql(spark, tmp_path, orders):
    df = spark.createDataFrame(orders, "day string, o_totalprice double")
    df.select(F.to_timestamp_ntz("day").alias("o_orderdate"), "o_totalprice").write.parquet(f"{tmp_path}/orders.parquet")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    for name in ("equity_metrics", "daily_equity"):
        want = duck.sql(registry.ORACLE_SQL[name])
        got = registry.QUERIES[name](spark, str(tmp_path)).select(*want.columns).collect()
        assert sorted(repr(tuple(r)) for r in got) == sorted(map(repr, want.fetchall()))  # tells null from NaN
