"""Repeated quotes. Trades are never dropped."""

from __future__ import annotations

import json
from collections import OrderedDict

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .segments import Walk, walked

SIDES = ("bid_price", "bid_vol", "ask_price", "ask_vol")
#: Fixed value: what a capacity of 0 means.
DEFAULT_CAPACITY = 10_000


def _key(signed_zero: str) -> list:
    if signed_zero not in ("distinct", "equal"):
        raise ValueError("signed_zero is 'distinct' or 'equal'")
    # Spark groups 0.0 and -0.0 together, their texts differ
    return ["symbol", "ts", *((F.col(c).cast("string") if signed_zero == "distinct" else F.col(c)) for c in SIDES)]


def mark_duplicates(tape: DataFrame, signed_zero: str = "distinct", together: bool = False) -> DataFrame:
    """tape with is_duplicate: a quote that came before with the same symbol, sides and time. together: trades pass the same
    window, so rows that lie together by symbol stay where they are; else they pass none."""
    if together:
        place = F.row_number().over(Window.partitionBy("kind", *_key(signed_zero)).orderBy("seq"))
        return tape.withColumn("is_duplicate", (F.col("kind") == "quote") & (place > 1))
    quotes = tape.where("kind = 'quote'")
    first = F.row_number().over(Window.partitionBy(*_key(signed_zero)).orderBy("seq")) > 1
    return quotes.withColumn("is_duplicate", first).unionByName(tape.where("kind != 'quote'").withColumn("is_duplicate", F.lit(False)))


def dedup_quotes(tape: DataFrame, signed_zero: str = "distinct", together: bool = False) -> DataFrame:
    return mark_duplicates(tape, signed_zero, together).where("not is_duplicate").drop("is_duplicate")


class Remembered:
    """The last capacity accepted keys; a hit doesn't refresh its key, and a forgotten key is new again."""

    def __init__(self, capacity: int, keys: list[str] = ()):
        self.room, self.keys = capacity or DEFAULT_CAPACITY, OrderedDict.fromkeys(keys)

    def known(self, key: str) -> bool:
        """Whether the key is remembered; if not, it is from now on."""
        if key in self.keys:
            return True
        self.keys[key] = None
        if len(self.keys) > self.room:
            self.keys.popitem(last=False)
        return False


def quote_key(signed_zero: str = "distinct") -> Column:
    """A quote's time, sides and symbol as one text."""
    _key(signed_zero)
    sides = [F.col(c) if signed_zero == "distinct" else F.col(c) + F.lit(0.0) for c in SIDES]  # -0.0 + 0.0 is 0.0
    return F.concat_ws("|", *(F.coalesce(c.cast("string"), F.lit("")) for c in (F.unix_micros("ts"), *sides, F.col("symbol"))))


class _Walk(Walk):
    def __init__(self, capacity: int, state: bytes | None):
        self.held = Remembered(capacity, json.loads(state) if state else [])

    def row(self, seq: int, value: str) -> list[tuple[int, str, None]]:
        return [(seq, "duplicate" if self.held.known(value) else "new", None)]

    def state(self) -> bytes:
        return json.dumps(list(self.held.keys)).encode()


def mark_duplicates_bounded(tape: DataFrame, capacity: int, key: str = "feed", signed_zero: str = "distinct", chunk: int | None = None) -> DataFrame:
    """(key, seq, is_duplicate) of quotes, with the last capacity accepted ones remembered. What is remembered depends on all
    that came: without chunk a feed is walked through in its arrival order by one task, batch by batch; with it a feed is cut
    at multiples of it and its stretches are walked at once, see segments.walked(), which makes its tables right away."""
    if chunk:
        quotes = tape.where("kind = 'quote'").select(F.col(key).cast("string").alias(key), "seq", quote_key(signed_zero).alias("value"))
        out = walked(quotes, key, chunk, lambda state: _Walk(capacity, state))
        return out.select(key, "seq", (F.col("outcome") == "duplicate").alias("is_duplicate"))

    def walk(batches):
        feed, held = None, None
        for batch in batches:
            out = []
            for k, quote in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if held is None or k != feed:
                    feed, held = k, Remembered(capacity)
                out.append(held.known(quote))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.bool_())], [key, "seq", "is_duplicate"])

    quotes = tape.where("kind = 'quote'").select(F.col(key).cast("string").alias(key), "seq", quote_key(signed_zero).alias("_quote"))
    return quotes.repartition(key).sortWithinPartitions(key, "seq").mapInArrow(walk, f"{key} string, seq long, is_duplicate boolean")


def metrics(marked: DataFrame) -> DataFrame:
    dropped = F.col("is_duplicate") & (F.col("kind") == "quote")
    return marked.agg(F.count("*").alias("total_received"), F.count_if(dropped).alias("dropped_quotes"), F.lit(0).cast("long").alias("dropped_trades"))
