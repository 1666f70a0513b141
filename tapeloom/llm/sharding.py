"""Operator 3: placement of keys on shards by a permutation-filled lookup table, in DataFrame and SQL functions only.

The table has a prime number of slots. Each shard has its own order of preference over the slots, a permutation
(offset + j * skip) mod slots given by two hashes of its name; shards take turns, each claiming the first slot of its
order that is free, until the table is full. A key goes to the shard in slot hash(key) mod slots. Every shard holds
slots // shards or one more, and when a shard leaves, few keys of the others move.

The table's size is a parameter, not a matter of the data, so it is broadcast whatever the size of the input.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import unused

SHARDS = 16
SLOTS = 1621  # a prime, about a hundred slots a shard


def _hash(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def fill(shards: list[str], slots: int = SLOTS) -> list[int]:
    """For each slot the position in shards of the shard that claimed it."""
    if not shards or slots < len(shards) or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError("there must be shards, and at least as many slots, a prime number of them")
    order = [(_hash(f"offset:{s}") % slots, _hash(f"skip:{s}") % (slots - 1) + 1) for s in shards]
    table, tried, free = [-1] * slots, [0] * len(shards), slots
    while True:
        for k, (offset, skip) in enumerate(order):
            while table[at := (offset + tried[k] * skip) % slots] >= 0:
                tried[k] += 1
            table[at] = k
            free -= 1
            if not free:
                return table


def lookup_table(spark: SparkSession, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """(slot, shard): the filled table as rows, read out of one literal."""
    listed = F.split(F.lit(",".join(map(str, fill(shards, slots)))), ",")
    return spark.range(1).select(F.posexplode(listed).alias("slot", "shard")).select("slot", F.col("shard").cast("int").alias("shard"))


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """md5 of the key as text, its first 15 hex digits as a number, modulo the slots; a null key counts as the text ''."""
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15)
    return (F.conv(digits, 16, 10).cast("long") % slots).cast("int")


def place(df: DataFrame, key: str, shards: list[str], slots: int = SLOTS, slot: str = "slot", shard: str = "shard") -> DataFrame:
    """df with two more columns: the key's slot and the position of its shard. Equal keys go together, null and '' too.
    Columns of df with the names slot or shard are replaced; rows keep their number, repeated rows too."""
    if key in (slot, shard):
        raise ValueError("the key's column would be replaced")
    kept, own = df.drop(slot, shard), unused(df, "_slot")
    where = lookup_table(df.sparkSession, shards, slots).select(F.col("slot").alias(own), F.col("shard").alias(shard))
    return kept.withColumn(own, slot_of(F.col(key), slots)).join(F.broadcast(where), own).withColumnRenamed(own, slot)


def names(n: int = SHARDS) -> list[str]:
    return [f"shard-{k:05d}" for k in range(n)]


def oracle(shards: int = SHARDS, slots: int = SLOTS) -> str:
    """The same placement in DuckDB SQL; its recursion claims one slot a step."""
    return f"""
WITH RECURSIVE shards AS (
  SELECT k::INT AS k, ('0x' || substr(md5('offset:' || n), 1, 15))::BIGINT % {slots} AS o,
         ('0x' || substr(md5('skip:' || n), 1, 15))::BIGINT % {slots - 1} + 1 AS s
  FROM (SELECT range AS k, 'shard-' || lpad(range::VARCHAR, 5, '0') AS n FROM range({shards}))),
prefs AS (SELECT list(p ORDER BY k) AS ps FROM (
  SELECT k, list((o + j * s) % {slots} ORDER BY j) AS p FROM shards, (SELECT range AS j FROM range({slots})) GROUP BY k)),
turns AS (
  SELECT 0 AS n, [0 FOR x IN range({slots})] AS taken, NULL::BIGINT AS slot, -1 AS shard
  UNION ALL
  SELECT n + 1, list_concat(list_concat(taken[1:f], [1]), taken[f + 2:]), f, n % {shards}
  FROM (SELECT n, taken, [x FOR x IN ps[n % {shards} + 1] IF taken[x + 1] = 0][1] AS f
        FROM turns, prefs WHERE n < {slots}))
SELECT d.doc_id, (('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, '')), 1, 15))::BIGINT % {slots})::INT AS slot, t.shard::INT AS shard
FROM documents d JOIN turns t ON t.slot = ('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, '')), 1, 15))::BIGINT % {slots}"""
