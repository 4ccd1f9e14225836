"""Aligning tables in time: as-of joins, resampling, filling, segments and contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnpike.functions.safe import ordered


def asof(left: DataFrame, right: DataFrame, values: list[str], keys: list[str], ts: str = "ts", available: Column | None = None, forward: bool = False, exact: bool = True, tie: str | None = None) -> DataFrame:
    """``left`` with the latest row of ``right`` that is not after it, by keys; or the earliest not before, with ``forward``.

    Of right rows at one time the one with the largest ``tie`` counts (the smallest, forward); without it, by all ``values`` in order.
    ``available`` is the time from which a right row can be seen (default: its ts). Without ``exact`` equal times do not match.
    Both sides are put into one table, sorted once by (keys, time) and filled: n log n, no pairs. Values come as one row, so nulls in
    the matching row stay null. Column names of ``values`` must not be in ``left``.
    """
    first = 0 if exact != forward else 1  # where right rows stand among equal times
    a = left.select("*", F.lit(None).alias("_v"), F.lit(1 - first).alias("_side"), F.col(ts).alias("_at"))
    at = F.col(ts) if available is None else available
    row = F.struct(*values)
    b = right.select(*keys, at.alias("_at"), row.alias("_v"), (F.col(tie) if tie else row).alias("_tie")).where("_at is not null").withColumn("_side", F.lit(first))
    both = a.drop("_v").unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("_at", "_side", "_tie")
    if forward:
        found = F.first("_v", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    else:
        found = F.last("_v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("_m", found).where(F.col("_side") == 1 - first).select(*left.columns, *(F.col("_m")[v].alias(v) for v in values))


def resample(df: DataFrame, keys: list[str], every: str, first: list[str] = (), last: list[str] = (), highest: list[str] = (), lowest: list[str] = (), total: list[str] = (), ts: str = "ts") -> DataFrame:
    """Tumbling windows: first and last known values, maxima, minima and sums, at the window's start."""
    at = F.window(ts, every)["start"].cast("timestamp_ntz")
    known = lambda c: F.when(F.col(c).isNotNull(), F.col(ts))
    aggs = [F.min_by(c, known(c)).alias(c) for c in first] + [F.max_by(c, known(c)).alias(c) for c in last]
    aggs += [F.max(c).alias(c) for c in highest] + [F.min(c).alias(c) for c in lowest] + [F.sum(c).alias(c) for c in total]
    return df.groupBy(*keys, at.alias("_at")).agg(*aggs).withColumnRenamed("_at", ts)


def leading_trim(df: DataFrame, keys: list[str], needed: list[str], ts: str = "ts") -> DataFrame:
    """From the first row on in which all ``needed`` columns are known, by keys."""
    full = F.lit(True)
    for c in needed:
        full = full & F.col(c).isNotNull()
    start = F.min(F.when(full, F.col(ts))).over(Window.partitionBy(*keys))
    return df.withColumn("_start", start).where(F.col(ts) >= F.col("_start")).drop("_start")


def complete_cases(df: DataFrame, needed: list[str] | None = None) -> DataFrame:
    return df.na.drop("any", subset=needed)


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, nulls, share), the emptiest first."""
    row = df.agg(F.count("*").alias("_rows"), *(F.count_if(F.col(c).isNull()).alias(c) for c in columns))
    long = row.unpivot("_rows", columns, "column", "nulls")
    return long.select("column", "nulls", (F.col("nulls") / F.nullif("_rows", F.lit(0))).alias("share")).orderBy(F.desc("nulls"), "column")


def sparse_merge(frames: list[DataFrame], on: str, shift: int = 1) -> DataFrame:
    """Sparse series by date: full outer joins, filled forward, then moved down by ``shift`` rows of the union."""
    out = frames[0]
    for f in frames[1:]:
        out = out.join(f, on, "full_outer")
    w = Window.orderBy(on)
    values = [c for c in out.columns if c != on]
    filled = out.select(on, *(F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias(c) for c in values))
    return filled.select(on, *(F.lag(c, shift).over(w).alias(c) for c in values)) if shift else filled


def stale_to_null(df: DataFrame, observed: Column, values: list[str], days: int, keys: list[str], date: str = "date") -> DataFrame:
    """Values become null more than ``days`` calendar days after the last row in which ``observed`` holds."""
    last = F.max(F.when(observed, F.col(date))).over(ordered(*keys, by=date).rowsBetween(Window.unboundedPreceding, 0))
    fresh = F.datediff(F.col(date), last) <= days
    return df.withColumns({v: F.when(fresh, F.col(v)) for v in values})


def segments(df: DataFrame, keys: list[str], gap_seconds: int, ts: str = "ts") -> DataFrame:
    """With ``segment``: a number that grows by one where a row follows the one before by more than the gap."""
    w = ordered(*keys, by=ts)
    gap = F.col(ts).cast("timestamp").cast("double") - F.lag(F.col(ts)).over(w).cast("timestamp").cast("double")
    return df.withColumn("_gap", F.when(gap > gap_seconds, 1).otherwise(0)).withColumn("segment", F.sum("_gap").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_gap")


def segmented_diff(df: DataFrame, value: str, k: int, keys: list[str], out: str, ts: str = "ts", segment: str = "segment") -> DataFrame:
    """The change over k rows, null where it would cross a segment."""
    w = ordered(*keys, by=ts)
    same = F.lag(segment, k).over(w) == F.col(segment)
    return df.withColumn(out, F.when(same, F.col(value) - F.lag(value, k).over(w)))


def overlap_join(a: DataFrame, b: DataFrame, keys: list[str], width: int, start: str = "start", end: str = "end") -> DataFrame:
    """Pairs of intervals (both ends inside) of two tables that overlap, with equal keys: columns of a, and of b with ``_b`` behind all but the keys.

    Intervals are dealt over bins of ``width`` units of their ends (seconds for times) and meet in bins, not by key alone; a pair counts in the bin where the later one
    begins. ``width`` about as long as usual intervals keeps both bins and pairs few. Intervals with a null end, or that end before they start, overlap nothing.
    """
    unit = lambda c: F.floor((F.unix_seconds(F.col(c).cast("timestamp")) if a.schema[start].dataType.typeName().startswith("timestamp") else F.col(c)) / width)
    binned = lambda t: t.where(F.col(start) <= F.col(end)).withColumn("_bin", F.explode(F.sequence(unit(start), unit(end))))
    right = binned(b).withColumnsRenamed({c: f"{c}_b" for c in b.columns if c not in keys})
    met = binned(a).join(right, [*keys, "_bin"]).where((F.col(start) <= F.col(f"{end}_b")) & (F.col(f"{start}_b") <= F.col(end)))
    later = F.greatest(F.col(start), F.col(f"{start}_b"))
    return met.withColumn("_later", later).where(unit("_later") == F.col("_bin")).drop("_bin", "_later")


def sampling_context(df: DataFrame, label: str, every: int, hours_before: int, hours_after: int, keys: list[str], ts: str = "ts") -> DataFrame:
    """Rows with label 1, each ``every``-th row with label 0 (from the first), and all rows within hours of a label 1.

    The context is a range frame on time: no interval join.
    """
    w = Window.partitionBy(*keys).orderBy("_s")
    near = F.max(F.when(F.col(label) == 1, 1)).over(w.rangeBetween(-hours_after * 3600, hours_before * 3600))
    nth = F.row_number().over(Window.partitionBy(*keys, label).orderBy(ts)) - 1
    rows = df.withColumn("_s", F.unix_seconds(F.col(ts).cast("timestamp")))
    rows = rows.withColumn("_near", near).withColumn("_nth", nth)
    keep = (F.col(label) == 1) | ((F.col(label) == 0) & (F.col("_nth") % every == 0)) | (F.col("_near") == 1)
    return rows.where(keep).drop("_s", "_near", "_nth")


def with_halo(df: DataFrame, keys: list[str], chunk: Column, rows: int, ts: str = "ts") -> DataFrame:
    """Splits long series into chunks that carry the last ``rows`` rows before them.

    Returns the rows with ``_chunk`` and ``_halo`` (1 for carried rows). Windows by (keys, _chunk) of at most ``rows`` + 1 rows then give
    the same values as windows by keys, in as many tasks as there are chunks; drop the halo afterwards. ``chunk`` must not fall as ts grows,
    and a chunk's halo must lie in the chunk before it.
    """
    marked = df.withColumn("_chunk", chunk)
    following = marked.select(*keys, "_chunk").distinct().withColumn("_next", F.lead("_chunk").over(Window.partitionBy(*keys).orderBy("_chunk")))
    tail = F.row_number().over(Window.partitionBy(*keys, "_chunk").orderBy(F.desc(ts)))
    carried = marked.withColumn("_tail", tail).where(F.col("_tail") <= rows).join(following.where("_next is not null"), [*keys, "_chunk"]).withColumn("_chunk", F.col("_next")).drop("_next", "_tail")
    return marked.withColumn("_halo", F.lit(0)).unionByName(carried.withColumn("_halo", F.lit(1)))


def running_totals(df: DataFrame, order: str, sums: list[str], descending: bool = False, parts: int = 64) -> DataFrame:
    """With ``<name>_run`` for each of ``sums``: its total over rows up to the current one in the order of one column, which has no repeats.

    One order over a whole table without one task for it: quantiles cut the column into ``parts`` ranges, each is summed by itself, and gets
    the total of the ranges before it (``parts`` rows, broadcast).
    """
    edges = df.agg(F.percentile_approx(order, [i / parts for i in range(1, parts)]).alias("_edges"))
    x = df.crossJoin(F.broadcast(edges)).withColumn("_range", F.size(F.filter("_edges", lambda e: e < F.col(order)))).drop("_edges")
    direction = F.desc if descending else F.asc
    before = Window.orderBy(direction("_range")).rowsBetween(Window.unboundedPreceding, -1)
    ranges = x.groupBy("_range").agg(*(F.sum(s).alias(s) for s in sums)).select("_range", *(F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"_before_{s}") for s in sums))
    within = Window.partitionBy("_range").orderBy(direction(order)).rowsBetween(Window.unboundedPreceding, 0)
    out = x.withColumns({f"{s}_run": F.sum(s).over(within) for s in sums}).join(F.broadcast(ranges), "_range")
    return out.withColumns({f"{s}_run": F.col(f"{s}_run") + F.col(f"_before_{s}") for s in sums}).drop("_range", *(f"_before_{s}" for s in sums))


def running_least(df: DataFrame, order: str, x: str, out: str, parts: int = 64) -> DataFrame:
    """With ``out``: the least ``x`` of the rows at or after the current one in the order of one column, which has no repeats; by ranges as in
    ``running_totals``."""
    edges = df.agg(F.percentile_approx(order, [i / parts for i in range(1, parts)]).alias("_edges"))
    y = df.crossJoin(F.broadcast(edges)).withColumn("_range", F.size(F.filter("_edges", lambda e: e < F.col(order)))).drop("_edges")
    later = Window.orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    ranges = y.groupBy("_range").agg(F.min(x).alias("_low")).select("_range", F.min("_low").over(later).alias("_later"))
    within = Window.partitionBy("_range").orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    return y.withColumn(out, F.min(x).over(within)).join(F.broadcast(ranges), "_range").withColumn(out, F.least(out, "_later")).drop("_range", "_later")


def quantiles(df: DataFrame, x: str, shares: list[float]) -> DataFrame:
    """One row with the array ``quantiles`` of the known values of a column, exactly and interpolated, null without any. Values are counted first and
    placed by ranges, so that no task holds all of them."""
    counts = df.where(F.col(x).isNotNull()).groupBy(F.col(x).cast("double").alias("_x")).agg(F.count("*").alias("_n"))
    run = running_totals(counts, "_x", ["_n"])
    total = counts.agg(F.sum("_n").alias("_total"))
    y = run.crossJoin(F.broadcast(total))
    place = [F.lit(p) * (F.col("_total") - 1) for p in shares]
    at = [F.min(F.when(F.col("_n_run") > f(p), F.col("_x"))) for p in place for f in (F.floor, F.ceil)]
    g = y.agg(F.max("_total").alias("_total"), *(a.alias(f"_{i}") for i, a in enumerate(at)))

    def between(i: int) -> Column:
        low, high = F.col(f"_{2 * i}"), F.col(f"_{2 * i + 1}")
        return F.when(low == high, low).otherwise((F.ceil(place[i]) - place[i]) * low + (place[i] - F.floor(place[i])) * high)

    return g.select(F.when(F.col("_total").isNotNull(), F.array(*(between(i) for i in range(len(shares))))).alias("quantiles"))
