"""Running values in arrival order without a window over everything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..paths import materialize

_SHIFT = "10000000000000000000"
#: Cuts of a key that one task carries on; more are cut again.
LEVEL = 4096
_AGGREGATE = {"max": F.max, "sum": F.sum}


def time_place(df: DataFrame, seq: Column | None = None) -> Column:
    """What orders the rows of df by (ts, seq); seq may stand for the column. A bigint seq goes with the time into one decimal, so that min_by and max_by
    keep fixed-size buffers and Spark aggregates by hash; a struct would make it sort."""
    if isinstance(df.schema["seq"].dataType, T.LongType):
        wide = lambda c: c.cast("decimal(38,0)")
        return wide(wide(F.unix_micros("ts")) * wide(F.lit(_SHIFT))) + wide(F.col("seq") if seq is None else seq)
    return F.struct("ts", "seq")


def running(df: DataFrame, value: Column, out: str, order: str, keys: tuple[str, ...] = (), chunk: int | None = None, before: bool = False, how: str = "max", ties: tuple[str, ...] = ()) -> DataFrame:
    """df with out: the largest value (or the sum) of the rows up to this one by order and ties, within keys; before: this one
    left out.

    With chunk the rows of a key are cut where order passes a multiple of it. Each cut's value, one row, is carried over the
    later ones, so neither one hot key nor a whole feed is sorted in one task; where the cuts of a key are more than LEVEL,
    they are cut in the same way. Maximum and sum are associative, so the result is the same for every chunk. The cuts'
    values are a small table that is made at once, from df's value, order and keys alone; df itself is not copied. What is
    carried comes as a row before those of its cut, so the cuts' exchange is the only one, however many cuts there are.
    """
    top, last = _AGGREGATE[how], -1 if before else 0
    df = df.withColumn("_v", value)
    if chunk is None:
        w = Window.partitionBy(*keys).orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, last)
        return df.withColumn(out, top("_v").over(w)).drop("_v")
    df = df.withColumn("_chunk", F.floor(F.col(order) / chunk))
    tops = materialize(df.groupBy(*keys, "_chunk").agg(top("_v").alias("_top")))
    low, high = tops.agg(F.min("_chunk"), F.max("_chunk")).first()
    cut = LEVEL if low is not None and high - low >= LEVEL else None
    carry = running(tops.withColumnRenamed("_chunk", "_at"), F.col("_top"), "_from", "_at", keys, cut, True, how)
    values = carry.select(*keys, F.col("_at").alias("_chunk"), F.col("_from").alias("_v"), F.lit(True).alias("_carried"))
    rows = df.withColumn("_carried", F.lit(False)).unionByName(values, allowMissingColumns=True)
    w = Window.partitionBy(*keys, "_chunk").orderBy(F.desc("_carried"), order, *ties).rowsBetween(Window.unboundedPreceding, last)
    return rows.withColumn(out, top("_v").over(w)).where("not _carried").drop("_v", "_chunk", "_carried")
