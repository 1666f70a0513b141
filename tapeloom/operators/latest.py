"""The latest state of each symbol."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import normal_symbol
from .scan import running, time_place

_TRADE, _QUOTE = ("price", "volume", "ts"), ("bid_price", "bid_vol", "ask_price", "ask_vol", "ts")


def mark_stale(tape: DataFrame, chunk: int | None = None) -> DataFrame:
    """tape with accepted: not older than any earlier event of its symbol and kind; equal times are accepted."""
    out = running(tape, F.col("ts"), "_before", "seq", ("symbol", "kind"), chunk, before=True)
    return out.withColumn("accepted", F.col("_before").isNull() | (F.col("ts") >= F.col("_before"))).drop("_before")


def snapshot(marked: DataFrame) -> DataFrame:
    """(symbol, last_trade, last_quote, total_volume, updated_at). Only accepted trades count for the volume; the last trade
    and quote need no filter, as a rejected one is never the newest."""
    trade, quote = F.col("kind") == "trade", F.col("kind") == "quote"
    rows = marked.withColumn("_place", time_place(marked))

    def newest(of, names):
        return [F.max_by(F.when(of, F.col(n)), F.when(of, F.col("_place"))).alias(f"{names[0]}_{n}") for n in names]

    made = rows.groupBy("symbol").agg(
        *newest(trade, _TRADE), *newest(quote, _QUOTE), F.coalesce(F.sum(F.when(trade & F.col("accepted"), F.col("volume"))), F.lit(0.0)).alias("total_volume"), F.max("ts").alias("updated_at")
    )

    def state(names):
        return F.when(F.col(f"{names[0]}_ts").isNotNull(), F.struct(*(F.col(f"{names[0]}_{n}").alias(n) for n in names)))

    return made.select("symbol", state(_TRADE).alias("last_trade"), state(_QUOTE).alias("last_quote"), "total_volume", "updated_at")


def stale_report(marked: DataFrame) -> DataFrame:
    """Rejected events, with the error's name."""
    return marked.where("not accepted").select("symbol", "kind", "seq", F.unix_millis("ts").alias("ts_ms"), F.lit("StaleData").alias("error_kind"))


def symbol_count(states: DataFrame) -> DataFrame:
    """(n_symbols, is_empty) of the states held."""
    return states.agg(F.count("*").alias("n_symbols"), (F.count("*") == 0).alias("is_empty"))


def last_price(states: DataFrame, symbol: str) -> DataFrame:
    """One row or none; the price is null without a trade."""
    return states.where(F.col("symbol") == normal_symbol(F.lit(symbol))).select("symbol", F.col("last_trade.price").alias("price"))
