"""Sharding by a permutation-filled lookup table, in DataFrame functions alone.

Every shard has a preference order over the slots of a table of prime size, from two hashes of its name. Shards take
turns: each claims the first free slot of its order, until the table is full. A row's key is hashed to a slot and
the slot's shard is looked up, so placement takes constant time, is even to about one part in a hundred, and
moves few keys when a shard comes or goes. The table has as many rows as slots, whatever the data, and is broadcast.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from ._shared import ready

#: slots for each shard, at least; the most slots that a table may have (a broadcast of some 2 MB)
SLOTS, MOST_SLOTS = 100, 1 << 17
_HEX = 15  # digits of an MD5 that make a 60-bit number


def _hash(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:_HEX], 16)


def _prime(n: int) -> int:
    """The smallest prime that is n or more."""
    while n < 2 or any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def table_size(shards: int) -> int:
    size = _prime(max(2, SLOTS * shards))
    if size > MOST_SLOTS:
        raise ValueError(f"{shards} shards need {size} slots; at most {MOST_SLOTS} are broadcast")
    return size


def lookup_table(names: list[str], size: int | None = None) -> list[int]:
    """For each slot the index of its shard in ``names``."""
    if not names or len(set(names)) != len(names):
        raise ValueError("shards need names, each its own")
    size = size or table_size(len(names))
    if size < len(names) or size != _prime(size):
        raise ValueError("the size must be a prime and no less than the number of shards")
    offset = [_hash(f"{x}#offset") % size for x in names]
    skip = [_hash(f"{x}#skip") % (size - 1) + 1 for x in names]
    at, slots, left = [0] * len(names), [-1] * size, size
    while True:
        for i in range(len(names)):
            while slots[slot := (offset[i] + at[i] * skip[i]) % size] >= 0:
                at[i] += 1
            slots[slot] = i
            left -= 1
            if not left:
                return slots


def slot_of(key: Column, size: int) -> Column:
    """The slot of a key: of its text's MD5; a null key counts as empty text."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, _HEX), 16, 10).cast("long"), F.lit(size).cast("long"))


def _as_table(spark: SparkSession, slots: list[int], names: list[str]) -> DataFrame:
    listed = F.split(F.lit(",".join(map(str, slots))), ",")
    return spark.range(1).select(F.posexplode(listed).alias("slot", "shard")).select(F.col("slot").cast("long").alias(names[0]), F.col("shard").cast("int").alias(names[1]))


def assign_shards(df: DataFrame, key_col: str, shards: int | list[str] = 32, shard_col: str = "shard", slot_col: str = "slot") -> DataFrame:
    """``df`` with two more columns: the row's slot (long) and the index of its shard (int).

    ``shards`` is a list of names or a number n, which stands for shard-0 to shard-(n-1). Equal keys go to one shard; null keys go where
    the empty text goes. All rows and columns stay; columns of the two new names are replaced. Empty tables work.
    """
    names = [f"shard-{i}" for i in range(shards)] if isinstance(shards, int) else list(shards)
    slots = lookup_table(names)
    at, of = (f"_{x}_{uuid.uuid4().hex}" for x in ("slot", "shard"))  # whatever the columns of df are called
    rows = df.withColumn(at, slot_of(df[key_col], len(slots))).drop(slot_col, shard_col)
    placed = rows.join(F.broadcast(_as_table(ready(df.sparkSession), slots, [at, of])), at)
    return placed.select(*(F.col(c) for c in df.columns if c not in (slot_col, shard_col)), F.col(at).alias(slot_col), F.col(of).alias(shard_col))


def write_shards(df: DataFrame, path: str, key_col: str, shards: int | list[str] = 32, files_each: int = 4) -> None:
    """Parquet partitioned by shard. A shard's rows are dealt over ``files_each`` tasks by a hash of the whole row, so neither a shard nor one key's rows
    are written by one task alone. Null keys go where the empty text goes; repeated rows stay; an empty table writes no rows."""
    placed = assign_shards(df, key_col, shards)
    n = (shards if isinstance(shards, int) else len(shards)) * files_each
    spread = F.pmod(F.xxhash64(*(c for c in placed.columns if not isinstance(placed.schema[c].dataType, MapType))), F.lit(files_each))
    placed.repartition(n, "shard", spread).write.partitionBy("shard").parquet(path)


def table_sql(shards: int) -> str:
    """DuckDB SQL for the columns slot and shard of the table of shard-0 to shard-(n-1)."""
    m = table_size(shards)
    number = lambda text: f"('0x' || substr(md5({text}), 1, {_HEX}))::BIGINT"
    return f"""
        WITH RECURSIVE named AS (
            SELECT i, {number("'shard-' || i || '#offset'")} % {m} AS off, {number("'shard-' || i || '#skip'")} % {m - 1} + 1 AS skip FROM range({shards}) AS t(i)
        ), fill AS (
            SELECT 0::BIGINT AS step, list_transform(range({m}), lambda x: -1::BIGINT) AS slots
            UNION ALL
            SELECT step + 1, slots[:s] || [i] || slots[s + 2:]
            FROM (
                SELECT step, slots, i, (off + skip * list_filter(range({m}), lambda j: slots[(off + skip * j) % {m} + 1] = -1)[1]) % {m} AS s
                FROM fill JOIN named ON named.i = step % {shards} WHERE step < {m}
            )
        )
        SELECT unnest(range({m})) AS slot, unnest(slots)::INTEGER AS shard FROM fill WHERE step = {m}
    """
