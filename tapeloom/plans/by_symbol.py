"""The tape kept by symbol: one exchange, and then dedup, sequencing, state, candles and liveness without another."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import candles as cd
from ..operators import dedup, latest, liveness, mapping, sequence
from ..paths import materialize, work_dir

#: Rows that a bucket is meant to have, and rows from which on a symbol is too much for one task.
BUCKET_ROWS, HOT_ROWS = 2_000_000, 32_000_000
#: Buckets that a table may have.
MAX_BUCKETS = 10_000


@dataclass(frozen=True)
class SymbolTape:
    """Trades and quotes with watermark_at_arrival and is_late, repeated quotes still in. cold is a table in buckets of symbols:
    windows and aggregates by symbol find their rows together. hot (or None) has the symbols with more rows than one task
    should sort; their work is cut at multiples of chunk instead."""

    cold: DataFrame
    hot: DataFrame | None
    chunk: int
    table: str

    def events(self) -> list[tuple[DataFrame, int | None]]:
        """The clean events, and the chunk for what runs on them. Windows by symbol alone pass no exchange in the first."""
        out = [(dedup.dedup_quotes(self.cold, together=True), None)]
        if self.hot is not None:
            out.append((dedup.dedup_quotes(self.hot), self.chunk))
        return [(df.where("not is_late"), chunk) for df, chunk in out]

    def late(self) -> DataFrame:
        both = dedup.dedup_quotes(self.cold, together=True)
        return (both if self.hot is None else both.unionByName(dedup.dedup_quotes(self.hot))).where("is_late")

    def state(self) -> DataFrame:
        """As workloads.market_state."""
        return _all([latest.snapshot(latest.mark_stale(df, chunk)) for df, chunk in self.events()])

    def candles(self, timeframes: tuple[str, ...] = tuple(cd.TIMEFRAMES)) -> DataFrame:
        """As workloads.candle_tables."""
        return _all([cd.kept(cd.mark_closed(cd.all_timeframes(df.where("kind = 'trade'"), timeframes, mode="event"))) for df, _ in self.events()])

    def last_seen(self) -> DataFrame:
        """(symbol, recv_ts): the newest arrival of each symbol, late ones left out."""
        return _all([df.groupBy("symbol").agg(F.max("recv_ts").alias("recv_ts")) for df, _ in self.events()])

    def status(self, watch: DataFrame, now: Column, threshold: float) -> DataFrame:
        return liveness.symbol_status(self.last_seen(), watch, now, threshold)

    def stale_intervals(self, watch: DataFrame, threshold: float, time_chunk: int) -> DataFrame:
        """When each watched symbol was stale; time_chunk cuts the hot symbols' arrivals, in microseconds."""
        return _all([liveness.stale_intervals(mapping.tracked(df, watch), threshold, chunk and time_chunk) for df, chunk in self.events()])

    def drop(self) -> None:
        """Forgets the table's name; its files go with the application."""
        self.cold.sparkSession.sql(f"DROP TABLE IF EXISTS {self.table}")


def _all(parts: list[DataFrame]) -> DataFrame:
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def store(tape: DataFrame, lateness: float, chunk: int, per_symbol: bool = False, bucket_rows: int = BUCKET_ROWS, hot_rows: int = HOT_ROWS) -> SymbolTape:
    """tape, which should be a table, by symbol. The watermark is the whole feed's, or with per_symbol each symbol's own, for
    which the buckets serve too.

    The watermark is found before repeated quotes go: a repeated quote has the time of one that came before, so it raises no
    watermark, the feed's or its symbol's, and lateness is the same as behind the dedup. An empty tape makes an empty table;
    rows without a symbol are one symbol."""
    spark = tape.sparkSession
    sizes = materialize(tape.groupBy("symbol").agg(F.count("*").alias("n")))
    cold = F.col("n") <= hot_rows
    rows, n_hot = sizes.agg(F.coalesce(F.sum(F.when(cold, F.col("n"))), F.lit(0)), F.count_if(~cold)).first()
    own = ("symbol",) if per_symbol else ()
    hot = None
    if n_hot:
        found = sizes.where(~cold).select(F.col("symbol").alias("_s"))
        found = F.broadcast(found) if n_hot <= mapping.SMALL else found
        tape = tape if per_symbol else materialize(sequence.sequence(tape, lateness, (), chunk))
        is_hot = F.col("symbol").eqNullSafe(F.col("_s"))
        hot = tape.join(found, is_hot, "left_semi")
        hot = materialize(sequence.sequence(hot, lateness, own, chunk) if per_symbol else hot)
        tape = tape.join(found, is_hot, "left_anti")
    elif not per_symbol:
        tape = sequence.sequence(tape, lateness, (), chunk)
    buckets = max(1, min(MAX_BUCKETS, -(-rows // bucket_rows)))
    name = f"tape_{uuid.uuid4().hex}"
    dealt = tape.repartition(buckets, "symbol")  # the hash of the buckets, so each is one file
    dealt.write.bucketBy(buckets, "symbol").sortBy("symbol").option("path", f"{work_dir(spark)}/{name}").format("parquet").saveAsTable(name)
    kept = spark.table(name)
    return SymbolTape(sequence.sequence(kept, lateness, own) if per_symbol else kept, hot, chunk, name)
