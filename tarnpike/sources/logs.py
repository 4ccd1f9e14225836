"""Prediction logs as tables: free text in several encodings, whose entries go over several lines."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from tarnpike.functions.safe import no_nan

PROBABILITIES = ["p_long_fast", "p_short_fast", "p_long_slow", "p_short_slow", "r"]
PRICES = ["open", "high", "low", "close"]
LISTS = ["fast_features", "slow_features", "features"]
COLUMNS = f"file string, entry int, ts timestamp_ntz, {', '.join(f'{c} double' for c in (*PROBABILITIES, *PRICES))}, {', '.join(f'{c} array<double>' for c in LISTS)}"

_NUMBER = r"(-?\d+(?:[.,]\d+)?)"
_STAMP = r"^\s*(?:\[[\d\-: ]+\]\s*)?"
_ENTRY = re.compile(_STAMP + r"(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}): Model predictions " + r" \| ".join(f"{'[Rr]' if c == 'r' else c}: {_NUMBER}" for c in PROBABILITIES))
_PRICES = re.compile(_STAMP + r"OHLC: " + r" \| ".join(f"{c}: {_NUMBER}" for c in "OHLC"))
_LIST = re.compile(_STAMP + r"(Fast features|Slow features|Features): \[(.*)\]")


def decoded(raw: bytes) -> str:
    """The text of a log: by its mark if it has one, else UTF-8, else UTF-16 where every other byte is mostly zero, else one byte a character."""
    for mark, name in ((b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16"), (b"\xef\xbb\xbf", "utf-8-sig")):
        if raw.startswith(mark):
            return raw.decode(name, "replace")
    if raw.count(0) * 3 > len(raw):
        return raw.decode("utf-16-le" if raw[1::2].count(0) >= raw[::2].count(0) else "utf-16-be", "replace")
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("cp1252", "replace")


def _number(text: str) -> float:
    return float(text.replace(",", "."))


def _numbers(text: str) -> list[float]:
    """A list of numbers; ", " stands between them where commas are decimal signs, a comma else."""
    parts = re.split(r",\s+|;\s*", text.strip()) if re.search(r",\s", text) or ";" in text else text.split(",")
    return [_number(x) for x in parts if x.strip()]


def entries(text: str) -> Iterator[dict]:
    """Each prediction of a log with what its following lines say: prices on the next, then lists of features, fast and slow, or one of the older form. Lines that fit
    nothing end an entry; numbers that are none leave a list out."""
    entry: dict | None = None
    awaited: set[str] = set()
    for line in text.splitlines():
        if m := _ENTRY.match(line):
            if entry:
                yield entry
            entry = {"ts": m[1], **{c: _number(m[i + 2]) for i, c in enumerate(PROBABILITIES)}}
            awaited = {"prices", "Fast features", "Features"}
        elif entry and "prices" in awaited and (m := _PRICES.match(line)):
            entry |= {c: _number(m[i + 1]) for i, c in enumerate(PRICES)}
            awaited.discard("prices")
        elif entry and (m := _LIST.match(line)) and m[1] in awaited:
            try:
                entry[m[1].lower().replace(" ", "_")] = _numbers(m[2])
            except ValueError:
                pass
            awaited = {"Slow features"} if m[1] == "Fast features" else set()
        elif entry and line.strip():
            yield entry
            entry, awaited = None, set()
    if entry:
        yield entry


def read_prediction_logs(spark: SparkSession, path: str) -> DataFrame:
    """(file, entry, ts, probabilities, prices, lists of features) of every prediction in the logs under a path, by any file system that Spark reads; what an entry does not say is null.
    A task reads whole files; entries are numbered in each."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["file", "entry", "ts", *PROBABILITIES, *PRICES, *LISTS]
        for p in parts:
            rows = [{"file": name, "entry": i, **e} for name, raw in zip(p.path, p.content, strict=True) for i, e in enumerate(entries(decoded(bytes(raw))))]
            out = pd.DataFrame(rows, columns=names)
            out["ts"] = pd.to_datetime(out["ts"], format="%Y-%m-%d %H:%M:%S", errors="coerce")
            for c in (*PROBABILITIES, *PRICES):
                out[c] = out[c].astype(float)
            for c in LISTS:
                out[c] = out[c].astype(object).where(out[c].notna(), None)
            yield out

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return no_nan(files.mapInPandas(run, COLUMNS))
