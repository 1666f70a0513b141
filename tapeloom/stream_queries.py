"""Streaming jobs over the tape, stored as files in arrival order and read back micro-batch by micro-batch."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .market_queries import LATENESS, ROOM, query
from .paths import forget, materialize, work_dir
from .signal_queries import _signal_bars
from .functions.symbols import BASKET
from .sources import tables
from .sources.frames import read_frames
from .streaming import jobs, market, stateful

#: Rows of a micro-batch, about, and micro-batches at least.
BATCH_ROWS, BATCHES = 1_000_000, 4
#: Slices of a tape that come one after the other, and seconds that the watermark waits, where it drops rows.
SLICES, PATIENCE = 4, 43_200


def _stored(spark: SparkSession, d: str, where: str, order: str = "seq") -> DataFrame:
    return _store(spark, materialize(tables.tape(spark, d).where(where)), order)


def _store(spark: SparkSession, rows: DataFrame, order: str = "seq", batch_rows: int = BATCH_ROWS) -> DataFrame:
    path = f"{work_dir(spark)}/tape-{uuid.uuid4().hex}"
    jobs.store_in_order(rows, path, max(BATCHES, rows.count() // batch_rows), order)
    return jobs.read_tape(spark, path, rows.schema)


@query("WITH TAPE SELECT symbol, 'H1' AS timeframe, ts_us // 3600000000 * 3600 AS start_s, arg_min(price, (ts_us, seq)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (ts_us, seq)) AS close, sum(volume) AS volume FROM trades GROUP BY symbol, ts_us // 3600000000")
def stream_candles(spark, d):
    got = jobs.newest(jobs.collect_updates(jobs.candles(_stored(spark, d, "kind = 'trade'"), "H1", "60 days")), "symbol", "timeframe", "start_time")
    return got.select("symbol", "timeframe", F.unix_seconds("start_time").alias("start_s"), "open", "high", "low", "close", "volume")


@query("WITH TAPE SELECT symbol, ts_us, bid_price, ask_price FROM tape WHERE kind = 'quote' GROUP BY ALL")
def stream_quote_dedup(spark, d):
    got = jobs.collect_updates(jobs.dedup_quotes(_stored(spark, d, "kind = 'quote'"), "60 days"), "append")
    return got.select("symbol", F.unix_micros("ts").alias("ts_us"), "bid_price", "ask_price")


@query("WITH TAPE SELECT symbol, arg_max(price, (ts_us, seq)) FILTER (kind = 'trade') AS last_price, max(ts_us) AS updated_at_us FROM tape GROUP BY symbol")
def stream_latest(spark, d):
    got = jobs.newest(jobs.collect_updates(jobs.latest(_stored(spark, d, "true"))), "symbol")
    return got.select("symbol", "last_price", F.unix_micros("updated_at").alias("updated_at_us"))


@query("WITH TAPE, ac AS (SELECT *, coalesce(ts_us >= max(ts_us) OVER (PARTITION BY symbol ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS ok FROM trades) SELECT symbol, sum(volume) FILTER (ok) AS total_volume FROM ac GROUP BY symbol")
def stream_accepted_volume(spark, d):
    got = jobs.newest(jobs.collect_updates(jobs.accepted_volume(_stored(spark, d, "kind = 'trade'"))), "symbol")
    return got.select("symbol", "total_volume")


_OWN_SEQ = f"sq AS (SELECT *, max(ts_us) OVER (PARTITION BY symbol ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - {int(LATENESS)} * 1000000 AS wm FROM tape)"


@query(f"""WITH TAPE, {_OWN_SEQ}, w AS (SELECT symbol, seq AS s, max(ts_us) OVER (PARTITION BY symbol ORDER BY seq) - {int(LATENESS)} * 1000000 AS mark FROM tape), r AS (SELECT symbol, mark, min(s) AS s FROM w GROUP BY symbol, mark),
e AS (SELECT symbol, seq, ts_us FROM sq WHERE NOT coalesce(ts_us < wm, false)), j AS (SELECT e.symbol, e.seq, (SELECT min(r.s) FROM r WHERE r.symbol = e.symbol AND r.mark >= e.ts_us) AS f FROM e)
SELECT symbol, seq, CASE WHEN f IS NULL THEN 'flush' ELSE 'ready' END AS outcome, greatest(f, CASE WHEN f IS NOT NULL THEN seq END) AS release_seq FROM j
UNION ALL SELECT symbol, seq, 'late', NULL FROM sq WHERE ts_us < wm""")
def stream_sequencer(spark, d):
    """A sequencer for each symbol, whose events come by all feeds: events let out and, from their own table, late ones; a row of
    each symbol after the tape says that its session is over, and what waits is let out."""
    stateful.use_rocksdb(spark)
    tape = materialize(tables.tape(spark, d))
    ends = stateful.session_ends(tape, tape.select("symbol").distinct(), seq=F.lit((1 << 63) - 1))
    stream = _store(spark, materialize(tape.withColumn("ends", F.lit(False)).unionByName(ends)))
    good, late = jobs.split_late(stateful.sequencer(stream, LATENESS, key="symbol"))
    return good.unionByName(late).drop("batch_id")


@query(f"WITH TAPE, {_OWN_SEQ} SELECT symbol, seq FROM sq WHERE ts_us < wm")
def stream_late(spark, d):
    return jobs.split_late(jobs.sequencer(_stored(spark, d, "true"), LATENESS, key="symbol"))[1].select("symbol", "seq")


@query(f"WITH RECURSIVE TAPE, HELD({ROOM}) SELECT feed, seq, dup AS is_duplicate FROM held WHERE n > 0")
def stream_bounded_dedup(spark, d):
    stateful.use_rocksdb(spark)
    return jobs.collect_updates(stateful.bounded_dedup(_stored(spark, d, "kind = 'quote'"), ROOM), "append").drop("batch_id")


@query("""WITH TAPE, rm AS (SELECT *, max(ts_us) OVER (PARTITION BY symbol ORDER BY seq) AS rm FROM trades), c AS (SELECT symbol, rm // 900000000 * 900 AS start_s, arg_min(price, seq) AS open, max(price) AS high, min(price) AS low, arg_max(price, seq) AS close, sum(volume) AS volume, min(seq) AS first_seq FROM rm GROUP BY symbol, rm // 900000000)
SELECT symbol, 'M15' AS timeframe, start_s, open, high, low, close, volume, first_seq, lead(first_seq) OVER (PARTITION BY symbol ORDER BY start_s) AS closed_by_seq FROM c""")
def stream_arrival_candles(spark, d):
    return jobs.newest(jobs.collect_updates(jobs.arrival_candles(_stored(spark, d, "kind = 'trade'"), "M15")), "symbol", "timeframe", "start_s")


@query("""WITH TAPE, x AS (SELECT symbol, recv_us + 36000000000 AS a, lead(recv_us) OVER (PARTITION BY symbol ORDER BY recv_us, seq) AS b FROM tape)
SELECT symbol, a AS stale_from_us, b AS stale_until_us FROM x WHERE (b IS NULL AND a < (SELECT max(recv_us) - 1000000 FROM tape)) OR a < b""")
def stream_stale_intervals(spark, d):
    got = jobs.collect_updates(jobs.stale_intervals(_stored(spark, d, "true", "recv_ts"), 36_000.0))
    return jobs.newest(got, "symbol", "stale_from_us")


def _market(spark: SparkSession, d: str) -> market.MarketTables:
    """The frames as JSON files in the order of their arrival, a frame that ends the session behind them, read as one stream."""
    stateful.use_rocksdb(spark)
    path = f"{work_dir(spark)}/market-{uuid.uuid4().hex}"
    frames = materialize(tables.frames(spark, d))
    end = spark.range(1).select(F.lit(None).cast("string").alias("feed"), F.lit((1 << 63) - 1).alias("seq"), F.lit(None).cast("timestamp").alias("recv_ts"), F.lit(market.SESSION_END).alias("frame_kind"), F.lit(None).cast("string").alias("raw"))
    jobs.store_in_order(frames.unionByName(end), f"{path}/frames", max(BATCHES, frames.count() // BATCH_ROWS), form="json")
    return market.run(read_frames(spark, f"{path}/frames", True, 1), path, LATENESS, "M15", list(BASKET))


@query(f"""WITH TAPE, {_OWN_SEQ} SELECT 'late' AS place, seq FROM sq WHERE ts_us < wm UNION ALL SELECT 'events', seq FROM sq WHERE NOT coalesce(ts_us < wm, false)
UNION ALL SELECT 'rejects', seq FROM ck WHERE error_kind IS NOT NULL UNION ALL SELECT 'control', seq FROM ck WHERE error_kind IS NULL AND (ping OR kind = 'heartbeat')""")
def stream_market(spark, d):
    """Frames to tables as one stream: which table each frame came to."""
    got, out = _market(spark, d), None
    for name in ("events", "late", "control", "rejects"):
        rows = getattr(got, name).select(F.lit(name).alias("place"), "seq")
        out = rows if out is None else out.unionByName(rows)
    return out


@query(f"""WITH TAPE, {_OWN_SEQ}, c AS (SELECT symbol, ts_us // 900000000 * 900 AS start_s, arg_min(price, (ts_us, seq)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (ts_us, seq)) AS close, sum(volume) AS volume, arg_min(seq, (ts_us, seq)) AS first_seq
  FROM sq WHERE kind = 'trade' AND NOT coalesce(ts_us < wm, false) GROUP BY symbol, ts_us // 900000000)
SELECT symbol, 'M15' AS timeframe, start_s, open, high, low, close, volume, first_seq, true AS is_closed, lead(first_seq) OVER (PARTITION BY symbol ORDER BY start_s) AS closed_by_seq FROM c""")
def stream_market_candles(spark, d):
    """Frames to candles as one stream: trades in time order behind the sequencer, candles kept by replacing those that grew."""
    got = _market(spark, d).candles
    return got.select("symbol", "timeframe", F.unix_seconds("start_time").alias("start_s"), "open", "high", "low", "close", "volume", "first_seq", "is_closed", "closed_by_seq")


def _in_slices(spark: SparkSession, d: str, where: str, job, mode: str) -> DataFrame:
    """Runs job over the tape's rows, which come in SLICES stretches of equal spans of seq: each is written when the one before is
    done, and the stream starts again where it ended. So the watermark of a slice follows from those before it."""
    path = f"{work_dir(spark)}/slices-{uuid.uuid4().hex}"
    rows = materialize(tables.tape(spark, d).where(where))
    low, high = rows.agg(F.min("seq"), F.max("seq")).first()
    stream = None
    for k in range(SLICES):
        span = ((high or 0) - (low or 0)) // SLICES + 1
        rows.where(F.expr(f"(seq - {low or 0}) div {span} = {k}")).write.mode("append").parquet(f"{path}/tape")
        stream = job(spark.readStream.schema(rows.schema).parquet(f"{path}/tape"))
        jobs.run(stream, path, lambda batch, j: jobs.replace_batch(batch, j, f"{path}/rows"), mode)
    return jobs.read_batches(spark, f"{path}/rows", stream.schema)


_MARKS = f"""sl AS (SELECT *, (seq - (SELECT min(seq) FROM t0)) // (((SELECT max(seq) FROM t0) - (SELECT min(seq) FROM t0)) // {SLICES} + 1) AS slice FROM t0),
mk AS (SELECT slice, max(max(ts_us)) OVER (ORDER BY slice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) // 1000 * 1000 - {PATIENCE}000000 AS wm FROM sl GROUP BY slice)"""


@query(f"""WITH TAPE, t0 AS (SELECT * FROM trades), {_MARKS}, ok AS (SELECT sl.* FROM sl JOIN mk USING (slice) WHERE wm IS NULL OR (ts_us // 3600000000 + 1) * 3600000000 > wm)
SELECT symbol, 'H1' AS timeframe, ts_us // 3600000000 * 3600 AS start_s, arg_min(price, (ts_us, seq)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (ts_us, seq)) AS close, sum(volume) AS volume FROM ok GROUP BY symbol, ts_us // 3600000000""")
def stream_late_candles(spark, d):
    """Event-time candles under a watermark that drops the trades of candles which it has passed."""
    got = _in_slices(spark, d, "kind = 'trade'", lambda s: jobs.candles(s, "H1", f"{PATIENCE} seconds"), "update")
    return jobs.newest(got, "symbol", "timeframe", "start_time").select("symbol", "timeframe", F.unix_seconds("start_time").alias("start_s"), "open", "high", "low", "close", "volume")


@query(f"""WITH TAPE, t0 AS (SELECT * FROM tape WHERE kind = 'quote'), {_MARKS}
SELECT symbol, ts_us, bid_price, ask_price FROM sl JOIN mk USING (slice) WHERE wm IS NULL OR ts_us > wm GROUP BY ALL""")
def stream_late_quotes(spark, d):
    """First of equal quotes under a watermark that drops what is older."""
    got = _in_slices(spark, d, "kind = 'quote'", lambda s: jobs.dedup_quotes(s, f"{PATIENCE} seconds"), "append")
    return got.select("symbol", F.unix_micros("ts").alias("ts_us"), "bid_price", "ask_price")


@query()
def stream_life_cycle(spark, d):
    """The life of signals on the stored bars, which come hour by hour; agrees with signal_life_cycle."""
    return _life(spark, d)[0].select("symbol", "start_time", "state", "event")


@query()
def stream_alerts(spark, d):
    """The alerts of that, as a second stateful operator of the same stream; agrees with alerts."""
    return _life(spark, d, True)[0].drop("batch_id")


def _life(spark: SparkSession, d: str, alerts: bool = False) -> tuple[DataFrame, DataFrame]:
    """(what the stream gives, the bars): after the last bar each symbol's session ends, twice, as the alerts hear of it a step
    later. Its key is a share of the symbols, so a batch has as many rows for each core as others have in all."""
    stateful.use_rocksdb(spark)
    made = _signal_bars(spark, d)
    bars = materialize(made.select("symbol", "start_time", "low", "high", "is_valid", "passes", "score", "stop_loss", "take_profit"))
    forget(made)
    last, marked = bars.agg(F.max("start_time")).first()[0], bars.withColumn("ends", F.lit(False))
    for days in (2, 4):
        ends = stateful.session_ends(marked, bars.select("symbol").distinct(), start_time=F.lit(last) + F.make_dt_interval(days=F.lit(days)))
        marked = marked.unionByName(ends)
    life = stateful.life_cycle(_store(spark, marked, "start_time", BATCH_ROWS * spark.sparkContext.defaultParallelism), "1 hour")
    return jobs.collect_updates(stateful.debounce(life) if alerts else life, "append"), bars
