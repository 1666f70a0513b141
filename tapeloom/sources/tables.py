"""Market tapes out of the given tables events and lineitem, by formula."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.symbols import BASKET
from ..operators.mapping import map_symbols
from ..paths import materialize
from . import frames as fr


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    hop = F.expr("event_id * 7919 % 7")
    return e.select(
        "event_id",
        "event_type",
        "value",
        F.get_json_object("props", "$.k").cast("double").alias("k"),
        F.col("ts").cast("timestamp").alias("ts"),
        ((F.col("event_id") + hop) * 1_000_000 + F.col("event_id")).alias("seq"),
        F.concat(F.lit("F"), (F.col("event_id") % 3).cast("string")).alias("feed"),
        (F.col("ts").cast("timestamp") + F.make_dt_interval(secs=hop)).alias("recv_ts"),
        F.element_at(F.array(*map(F.lit, BASKET)), (F.col("user_id") % 30 + 1).cast("int")).alias("base"),
    )


def raw_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, base, raw_symbol): the symbol as it might come over the wire."""
    b, n = F.col("base"), F.col("event_id") % 5
    raw = F.when(n == 0, b).when(n == 1, F.lower(b)).when(n == 2, F.concat(F.lit("  "), b, F.lit(" "))).when(n == 3, F.concat(F.lit("HOSE:"), b)).otherwise(F.concat(b, F.lit(".HOSE")))
    return _events(spark, sf_dir).withColumn("raw_symbol", raw)


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded frames; some are broken, binary or pings, and every tenth quote comes twice."""
    e = raw_symbols(spark, sf_dir)
    epoch = F.when(F.col("event_id") % 2 == 0, F.unix_seconds("ts")).otherwise(F.unix_millis("ts")).alias("timestamp")
    kind = lambda k: F.lit(k).alias("type")
    symbol = F.col("raw_symbol").alias("symbol")
    text = (
        F.when(F.col("event_type").isin("purchase", "click"), F.to_json(F.struct(kind("trade"), symbol, F.col("value").alias("price"), F.col("k").alias("volume"), epoch)))
        .when(
            F.col("event_type") == "view",
            F.to_json(F.struct(kind("quote"), symbol, F.col("value").alias("bid_price"), F.lit(100.0).alias("bid_vol"), (F.col("value") + (F.col("k") - 5) / 100).alias("ask_price"), F.lit(200.0).alias("ask_vol"), epoch)),
        )
        .when(F.col("event_type") == "signup", F.to_json(F.struct(kind("heartbeat"), epoch)))
        .otherwise(F.to_json(F.struct(F.when(F.col("event_id") % 2 == 0, F.lit("error")).otherwise(F.lit("exchange_error")).alias("type"), F.lit("E1").alias("code"), F.concat(F.lit("refused "), F.col("event_id").cast("string")).alias("message"))))
    )
    way = F.when(F.col("event_id") % 89 == 0, F.lit("binary")).when(F.col("event_id") % 83 == 0, F.lit("ping")).otherwise(F.lit("text"))
    out = e.withColumn("raw", text)
    cut = F.when(F.col("event_id") % 97 == 0, F.expr("substr(raw, 1, length(raw) - 1)")).otherwise(F.col("raw")).alias("raw")
    twice = (F.col("event_type") == "view") & (F.col("event_id") % 10 == 0)
    seq = F.explode(F.when(twice, F.array(F.col("seq"), F.col("seq") + 500_000)).otherwise(F.array("seq"))).alias("seq")
    return out.select("feed", seq, "recv_ts", way.alias("frame_kind"), cut)


def converted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fr.convert(fr.parse(frames(spark, sf_dir)))


def tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid trades and quotes with canonical symbols, repeated quotes still in."""
    return map_symbols(fr.events(converted(spark, sf_dir))).where("symbol is not null")


def stored_tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tape as a table, for what reads it more than once: frames are parsed once, later reads take the columns they need."""
    return materialize(tape(spark, sf_dir))


def heavy_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trade for each row of lineitem; ord is its place in the arrival order of its symbol."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    ts = F.col("l_shipdate").cast("timestamp") + F.make_dt_interval(hours=F.col("l_linenumber"))
    return li.select(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("symbol"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("volume"),
        ts.alias("ts"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("seq"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ord"),
    )
