"""Pieces of DuckDB SQL that the oracles share."""

from __future__ import annotations

BARS = """bars AS (
    SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low,
        arg_max(value, (ts, event_id)) AS close, count(*)::DOUBLE AS volume, (max(value) + min(value)) / 2 AS mid
    FROM events GROUP BY 1, 2)"""

DAILY = """days AS (
    SELECT o_orderpriority AS symbol, date_trunc('day', o_orderdate)::TIMESTAMP AS ts, arg_min(o_totalprice, (o_orderdate, o_orderkey)) AS open, max(o_totalprice) AS high,
        min(o_totalprice) AS low, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS close, count(*)::DOUBLE AS volume, (max(o_totalprice) + min(o_totalprice)) / 2 AS mid
    FROM orders GROUP BY 1, 2)"""

BY = "PARTITION BY symbol ORDER BY ts"


def over(n: int, by: str = BY) -> str:
    return f"({by} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def prev(n: int, by: str = BY) -> str:
    return f"({by} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


def ahead(n: int, by: str = BY) -> str:
    return f"({by} ROWS BETWEEN 1 FOLLOWING AND {n} FOLLOWING)"


def gated(agg: str, of: str, frame: str, least: int) -> str:
    return f"(CASE WHEN count({of}) OVER {frame} >= {least} THEN {agg} OVER {frame} END)"


def mean(x: str, n: int, least: int | None = None) -> str:
    return gated(f"avg({x})", x, over(n), n if least is None else least)


def lag(x: str, n: int = 1, by: str = BY) -> str:
    return f"(lag({x}, {n}) OVER ({by}))"


def lead(x: str, n: int = 1, by: str = BY) -> str:
    return f"(lead({x}, {n}) OVER ({by}))"


def div(a: str, b: str) -> str:
    return f"(({a}) / nullif({b}, 0))"


def r(x: str, name: str) -> str:
    return f"round(({x})::DOUBLE, 6) + 0.0 AS {name}"


#: true range, and bars with it
TR = f"(CASE WHEN {lag('close')} IS NULL THEN high - low ELSE greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')})) END)"
TRUE = f"{BARS}, t AS (SELECT *, {TR} AS tr FROM bars)"


def with_atr(n: int) -> str:
    """CTEs up to ``a``: bars with atr, the mean true range of n bars."""
    return f"{TRUE}, a AS (SELECT *, {mean('tr', n)} AS atr FROM t)"


def with_wilder(*ns: int, more: str = "") -> str:
    """CTEs up to ``a``: bars with rn and Wilder's mean true range, null in warm-up: atr, or atr_n of several. They need WITH RECURSIVE."""
    walk = lambda n: f"""w{n} AS (SELECT symbol, {n}::BIGINT AS rn, avg(tr) AS y FROM numbered WHERE rn <= {n} GROUP BY symbol HAVING count(*) = {n}
        UNION ALL SELECT m.symbol, m.rn, {1 / n!r} * m.tr + {1 - 1 / n!r} * w.y FROM w{n} w JOIN numbered m ON m.symbol = w.symbol AND m.rn = w.rn + 1)"""  # noqa: E731
    names = {n: "atr" if len(ns) == 1 else f"atr_{n}" for n in ns}
    joins = " ".join(f"LEFT JOIN w{n} ON w{n}.symbol = m.symbol AND w{n}.rn = m.rn" for n in ns)
    return f"""{TRUE}, numbered AS (SELECT *, row_number() OVER ({BY}) AS rn FROM t), {', '.join(map(walk, ns))},
    a AS (SELECT m.*, {', '.join(f'w{n}.y AS {x}' for n, x in names.items())}{more} FROM numbered m {joins})"""


def ranked(x: str, least: int) -> str:
    """Percent rank of x among the known values of the list x_list, ties at their average."""
    known = f"list_filter({x}_list, lambda q: q IS NOT NULL)"
    return f"CASE WHEN {x} IS NOT NULL AND len({known}) >= {least} THEN 100.0 * (len(list_filter({known}, lambda q: q < {x})) + (len(list_filter({known}, lambda q: q = {x})) + 1) / 2.0) / len({known}) END"
