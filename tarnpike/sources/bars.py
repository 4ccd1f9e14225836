"""Bars: from ticks, from files and from databases, in one schema.

A bar is a row (symbol, ts, open, high, low, close, volume, mid); ts is the UTC time at which it opens, without a zone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BAR = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double, mid double"


def ticks_to_bars(ticks: DataFrame, symbol: str, ts: str, value: str, tie: str, every: str = "hour") -> DataFrame:
    """Bars of calendar buckets. First and last value by (ts, tie); volume counts ticks; mid is halfway between high and low.

    One hash aggregation with partial sums: a busy symbol is no hot task, and the shuffle carries bars, not ticks.
    """
    at = F.struct(F.col(ts), F.col(tie))
    bucket = F.date_trunc(every, F.col(ts)).cast("timestamp_ntz")
    return (
        ticks.where(F.col(value).isNotNull() & F.col(ts).isNotNull())
        .groupBy(F.col(symbol).alias("symbol"), bucket.alias("ts"))
        .agg(F.min_by(value, at).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, at).alias("close"), F.count("*").cast("double").alias("volume"))
        .withColumn("mid", (F.col("high") + F.col("low")) / 2)
    )


def event_bars(spark: SparkSession, sf_dir: str, every: str = "hour") -> DataFrame:
    """Hourly bars of ``events``: a symbol is a type of event."""
    return ticks_to_bars(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_type", "ts", "value", "event_id", every)


def order_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of ``orders``: a symbol is a priority."""
    return ticks_to_bars(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_orderpriority", "o_orderdate", "o_totalprice", "o_orderkey", "day")


def parsed_time(text: Column) -> Column:
    """UTC time without a zone from dd.MM.yyyy HH:mm or ISO 8601 with or without an offset; null if it is neither."""
    dotted = F.try_to_timestamp(text, F.lit("dd.MM.yyyy HH:mm")).cast("timestamp_ntz")
    aware = F.to_utc_timestamp(text.try_cast("timestamp"), F.current_timezone()).cast("timestamp_ntz")
    return F.when(text.rlike(r"^\d\d\.\d\d\.\d{4} "), dotted).when(text.rlike(r"(Z|[+-]\d\d:?\d\d)$"), aware).otherwise(text.try_cast("timestamp_ntz"))


def local_time_to_utc(text: Column, zone: str) -> Column:
    """UTC time from local clock time; null where the clock shows it twice or never."""
    local = text.try_cast("timestamp_ntz")
    utc = F.convert_timezone(F.lit(zone), F.lit("UTC"), local)
    back = F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)
    hour = F.expr("interval 1 hour")
    twice = (F.convert_timezone(F.lit("UTC"), F.lit(zone), utc + hour) == local) | (F.convert_timezone(F.lit("UTC"), F.lit(zone), utc - hour) == local)
    return F.when((back == local) & ~twice, utc)


def weekday_hours(ts: Column, friday_hour: int = 22) -> Column:
    """Monday to Thursday, and Friday before ``friday_hour``."""
    day = F.weekday(ts)
    return (day < 4) | ((day == 4) & (F.hour(ts) < friday_hour))


def weekdays(ts: Column) -> Column:
    return F.weekday(ts) < 5


def keep_last(df: DataFrame, keys: list[str], arrival: str) -> DataFrame:
    """Of rows with equal keys the one that came last."""
    w = Window.partitionBy(*keys).orderBy(F.desc(arrival))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def conflicts(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Keys whose rows disagree in a value, with the number of their rows."""
    apart = [F.when(F.min(v).eqNullSafe(F.max(v)) & (F.count(v).isin(0) | (F.count(v) == F.count("*"))), 0).otherwise(1).alias(f"_{v}") for v in values]
    flags = df.groupBy(*keys).agg(F.count("*").alias("rows"), *apart)
    return flags.where(sum((F.col(f"_{v}") for v in values), F.lit(0)) > 0).select(*keys, "rows")


def read_bar_csv(spark: SparkSession, path: str, symbol: str, start: str | None = None, end: str | None = None, drop_weekends: bool = True, arrival: str = "_arrival") -> DataFrame:
    """Bars from CSV files with columns time, open, high, low, close, volume, mid: UTC times, the last of repeated ones, dates inclusive."""
    raw = spark.read.schema("time string, open double, high double, low double, close double, volume double, mid double").option("header", True).csv(path)
    rows = raw.withColumn(arrival, F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())).withColumn("ts", parsed_time(F.col("time"))).where(F.col("ts").isNotNull())
    if drop_weekends:
        rows = rows.where(weekday_hours(F.col("ts")))
    if start:
        rows = rows.where(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    if end:
        rows = rows.where(F.col("ts") <= F.lit(end).cast("timestamp_ntz"))
    return keep_last(rows, ["ts"], arrival).select(F.lit(symbol).alias("symbol"), "ts", "open", "high", "low", "close", "volume", "mid")


def read_bar_table(spark: SparkSession, url: str, table: str, symbol: str, properties: dict[str, str], splits: list[str]) -> DataFrame:
    """Bars of one instrument from a database; filter and columns go to the server, one task for each predicate of ``splits``."""
    rows = spark.read.jdbc(url, table, predicates=[f"instrument = '{symbol.replace(chr(39), chr(39) * 2)}' AND ({p})" for p in splits], properties=properties)
    return rows.select(F.col("instrument").alias("symbol"), F.col("time").cast("timestamp_ntz").alias("ts"), "open", "high", "low", "close", "volume", "mid")


def before_holdout(df: DataFrame, ts: str, holdout: str, unsealed: bool = False) -> DataFrame:
    """Rows before the sealed period; all if it is unsealed."""
    return df if unsealed else df.where(F.col(ts) < F.lit(holdout).cast("timestamp_ntz"))


def read_vintages(spark: SparkSession, path: str) -> DataFrame:
    """(series, observation_date, vintage_date, value) from files <SERIES>_<yyyy-mm-dd>.csv of one value column each."""
    raw = spark.read.schema("observation_date date, value string").option("header", True).csv(path)
    name = F.element_at(F.split(F.col("_metadata.file_name"), "/"), -1)
    return raw.select(
        F.regexp_extract(name, r"^(.+)_\d{4}-\d\d-\d\d\.csv$", 1).alias("series"), "observation_date",
        F.to_date(F.regexp_extract(name, r"_(\d{4}-\d\d-\d\d)\.csv$", 1)).alias("vintage_date"), F.col("value").try_cast("double").alias("value"),
    )


def as_known(vintages: DataFrame, day: str) -> DataFrame:
    """The value of each observation in its latest vintage up to ``day``."""
    known = vintages.where(F.col("vintage_date") <= F.lit(day).cast("date"))
    return known.groupBy("series", "observation_date").agg(F.max_by("value", "vintage_date").alias("value"), F.max("vintage_date").alias("vintage_date"))


def read_calendar(spark: SparkSession, path: str) -> DataFrame:
    """(name, ts, impact, currency) from CSV with Name, Start, Impact, Currency; rows without a readable time go, repeated ones count once."""
    raw = spark.read.schema("Name string, Start string, Impact string, Currency string").option("header", True).csv(path)
    at = F.try_to_timestamp(F.col("Start"), F.lit("MM/dd/yyyy HH:mm:ss")).cast("timestamp_ntz")
    return raw.select(F.col("Name").alias("name"), at.alias("ts"), F.col("Impact").alias("impact"), F.col("Currency").alias("currency")).where("ts is not null").distinct()


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New values win, old ones stay elsewhere. A null in a new row keeps the old value."""
    values = [c for c in old.columns if c not in keys]
    joined = old.alias("o").join(new.alias("n"), keys, "full_outer")
    return joined.select(*keys, *(F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in values))


def missing_keys(wanted: DataFrame, have: DataFrame, keys: list[str]) -> DataFrame:
    """The work list of an incremental run: wanted rows whose keys are not there yet."""
    return wanted.join(have.select(*keys), keys, "left_anti")


def write_bars(bars: DataFrame, path: str) -> None:
    """Parquet by symbol and month, so that filters on either prune files."""
    bars.withColumn("month", F.date_format("ts", "yyyy-MM")).repartition("symbol", "month").sortWithinPartitions("ts").write.partitionBy("symbol", "month").mode("overwrite").parquet(path)
