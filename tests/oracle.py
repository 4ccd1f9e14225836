"""Compares a query with its SQL on DuckDB."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(frame: pd.DataFrame) -> pd.DataFrame:
    """Columns by name, values as text, rows sorted."""
    out = frame[sorted(frame.columns)].copy()
    for c in out:
        if out[c].dtype.kind == "f" or out[c].map(lambda v: isinstance(v, float)).any():
            out[c] = pd.to_numeric(out[c]).map(lambda v: "" if pd.isna(v) else f"{v:.6g}")
        else:
            out[c] = out[c].map(lambda v: "" if v is None or v is pd.NaT or v is pd.NA else str(v.item() if hasattr(v, "item") else v))
    return out.sort_values(list(out.columns)).reset_index(drop=True)


def assert_same(spark_frame: pd.DataFrame, sql: str, c: duckdb.DuckDBPyConnection) -> None:
    want = c.sql(sql).df()
    assert sorted(spark_frame.columns) == sorted(want.columns)
    assert len(spark_frame) == len(want)
    pd.testing.assert_frame_equal(plain(spark_frame), plain(want))
