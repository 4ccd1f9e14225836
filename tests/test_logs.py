"""Prediction logs in each encoding and number format, and their parity."""

import datetime as dt

import pytest

from tarnpike.sources import logs

LINE = "2024-01-02 03:04:05: Model predictions p_long_fast: 0.5 | p_short_fast: 0.25 | p_long_slow: 0.75 | p_short_slow: 0.1 | R: 1.5"
COMMAS = "[2024-01-02 03:04:06] 2024-01-02 03:04:05: Model predictions p_long_fast: 0,5 | p_short_fast: 0,25 | p_long_slow: 0,75 | p_short_slow: 0,1 | R: 1,5"
ONE = f"""Gestartet f\u00fcr h\u00f6here Kurse
{LINE}
   OHLC: O: 1.1 | H: 1.3 | L: 1.0 | C: 1.2
Fast features: [0.1, -0.2, 3]
Slow features: [4.5,6]
something else
Slow features: [9.0]
{LINE.replace("03:04", "03:05")}
Features: [1.0, x]
"""
TWO = f"""{COMMAS}
[2024-01-02 03:04:06] OHLC: O: 1,1 | H: 1,3 | L: 1,0 | C: 1,2
[2024-01-02 03:04:06] Fast features: [0,1, -0,2, 3,0]
[2024-01-02 03:04:06] Slow features: [4,5, 6,0]
{COMMAS}
[2024-01-02 03:04:06] Features: [7,25, 8,0]
"""


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "utf-16", "utf-16-le", "utf-16-be", "latin-1", "cp1252"])
def test_encodings(encoding):
    assert logs.decoded(ONE.encode(encoding)) == ONE


def test_entries_of_lines_that_depend_on_lines_before(spark, tmp_path):
    (tmp_path / "one.log").write_bytes(ONE.encode("utf-16"))
    (tmp_path / "two.log").write_bytes(TWO.encode("latin-1"))
    (tmp_path / "none.log").write_bytes(b"")
    got = {(r.file.rsplit("/", 1)[1], r.entry): r for r in logs.read_prediction_logs(spark, str(tmp_path)).collect()}
    assert set(got) == {("one.log", 0), ("one.log", 1), ("two.log", 0), ("two.log", 1)}
    for name in ("one.log", "two.log"):
        r = got[name, 0]
        assert r.ts == dt.datetime(2024, 1, 2, 3, 4, 5) and (r.p_long_fast, r.p_short_fast, r.p_long_slow, r.p_short_slow, r.r) == (0.5, 0.25, 0.75, 0.1, 1.5)
        assert (r.open, r.high, r.low, r.close) == (1.1, 1.3, 1.0, 1.2) and r.fast_features == [0.1, -0.2, 3.0] and r.slow_features == [4.5, 6.0] and r.features is None
    second = got["one.log", 1]
    assert second.ts == dt.datetime(2024, 1, 2, 3, 5, 5) and second.open is None and second.fast_features is None and second.features is None  # x is no number
    assert got["two.log", 1].features == [7.25, 8.0] and got["two.log", 1].slow_features is None
