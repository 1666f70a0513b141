"""Queries of the market-tape operators over the given tables, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalars, symbols, validate
from .operators import candles as cd
from .operators import dedup, latest, liveness, mapping, sequence
from .paths import materialize, work_dir
from .plans import by_symbol, workloads
from .sources import frames as fr
from .sources import sinks, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Arrival numbers in a chunk of a running maximum: about two thousand events.
CHUNK = 2_000_000_000
#: Microseconds in a chunk of an order of time, and places in one of lineitem's arrival order.
DAY, HEAVY_CHUNK = 86_400_000_000, 1_000_000
LATENESS = 600.0
#: Quotes that the bounded dedup remembers of a feed; events that the bounded sequencer lets wait of a symbol, and its lateness.
ROOM, CAPACITY, WAIT = 50, 4, 36_000.0
NOW_US = 1_706_745_600_000_000  # 2024-02-01 00:00:00 UTC

_BASKET = "[" + ", ".join(f"'{s}'" for s in symbols.BASKET) + "]"
_TAPE = f"""
ev AS (SELECT event_id, event_type, value, json_extract(props, '$.k')::DOUBLE AS k, epoch_us(ts) AS us, (event_id + event_id * 7919 % 7) * 1000000 + event_id AS seq,
  'F' || (event_id % 3)::VARCHAR AS feed, epoch_us(ts) + event_id * 7919 % 7 * 1000000 AS recv_us, {_BASKET}[(user_id % 30 + 1)::INT] AS base FROM events),
fr AS (SELECT * FROM ev UNION ALL SELECT * REPLACE (seq + 500000 AS seq) FROM ev WHERE event_type = 'view' AND event_id % 10 = 0),
cv AS (SELECT *, CASE WHEN event_id % 2 = 0 THEN us // 1000000 * 1000000 ELSE us // 1000 * 1000 END AS ts_us, value + (k - 5) / 100 AS ask,
  CASE WHEN event_type IN ('purchase', 'click') THEN 'trade' WHEN event_type = 'view' THEN 'quote' WHEN event_type = 'signup' THEN 'heartbeat' ELSE 'error' END AS kind,
  event_id % 89 <> 0 AND event_id % 83 = 0 AS ping FROM fr),
ck AS (SELECT *, CASE WHEN ping THEN NULL WHEN event_id % 89 = 0 OR event_id % 97 = 0 OR kind = 'error' THEN 'ParseError'
    WHEN kind = 'trade' THEN CASE WHEN NOT value > 0 THEN 'InvalidPrice' WHEN NOT k > 0 THEN 'InvalidVolume' END
    WHEN kind = 'quote' THEN CASE WHEN value < 0 OR ask < 0 OR (value = 0 AND ask = 0) THEN 'InvalidPrice' WHEN value > 0 AND ask > 0 AND value >= ask THEN 'CrossedMarket' END END AS error_kind FROM cv),
tape AS (SELECT feed, seq, recv_us, kind, base AS symbol, event_id, ts_us, CASE WHEN kind = 'trade' THEN value END AS price, CASE WHEN kind = 'trade' THEN k END AS volume,
    CASE WHEN kind = 'quote' THEN value END AS bid_price, CASE WHEN kind = 'quote' THEN 100.0::DOUBLE END AS bid_vol, CASE WHEN kind = 'quote' THEN ask END AS ask_price, CASE WHEN kind = 'quote' THEN 200.0::DOUBLE END AS ask_vol
  FROM ck WHERE error_kind IS NULL AND NOT ping AND kind IN ('trade', 'quote')),
trades AS (SELECT * FROM tape WHERE kind = 'trade')"""
_WATCH = "watch AS (SELECT unnest(['HPG', 'VIC', 'FPT', 'ACB', 'AAA', 'ZZZ']) AS symbol)"


#: A feed's quotes one after the other, with the last ROOM accepted ones.
_HELD = """q AS MATERIALIZED (SELECT feed, seq, concat_ws('|', symbol, ts_us, bid_price, bid_vol, ask_price, ask_vol) AS k, row_number() OVER (PARTITION BY feed ORDER BY seq) AS n FROM tape WHERE kind = 'quote'),
held AS (SELECT feed, 0::BIGINT AS n, NULL::BIGINT AS seq, false AS dup, []::VARCHAR[] AS ks FROM q GROUP BY feed
 UNION ALL SELECT q.feed, q.n, q.seq, list_contains(h.ks, q.k), CASE WHEN list_contains(h.ks, q.k) THEN h.ks WHEN len(h.ks) >= ROOM THEN list_append(h.ks[2:], q.k) ELSE list_append(h.ks, q.k) END FROM held h JOIN q ON q.feed = h.feed AND q.n = h.n + 1)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql.replace("WITH TAPE", f"WITH {_TAPE}").replace("WITH RECURSIVE TAPE", f"WITH RECURSIVE {_TAPE}").replace("WATCH,", f"{_WATCH},").replace(f"HELD({ROOM})", _HELD.replace("ROOM", str(ROOM)))
        return f

    return add


def _us(*names: str) -> list:
    return [F.unix_micros(n).alias(f"{n}_us") for n in names]


def _trades(spark: SparkSession, d: str) -> DataFrame:
    return materialize(tables.tape(spark, d).where("kind = 'trade'"))


def _watch(spark: SparkSession) -> DataFrame:
    return spark.sql("select explode(array('  hpg ', 'VIC', 'fpt', 'ACB', 'aaa', 'ZZZ', '   ', '', 'VIC')) as symbol")


def _now():
    return F.timestamp_micros(F.lit(NOW_US))


# --- frames ----------------------------------------------------------------------------------------------------------


@query("WITH TAPE SELECT CASE WHEN ping THEN 'pong' WHEN event_id % 89 = 0 OR event_id % 97 = 0 THEN NULL ELSE kind END AS msg_type, count(*)::BIGINT AS n FROM ck GROUP BY 1")
def parse_frames(spark, d):
    return fr.parse(tables.frames(spark, d)).groupBy("msg_type").agg(F.count("*").alias("n"))


@query("WITH TAPE SELECT seq, feed, kind, CASE event_id % 5 WHEN 3 THEN 'HOSE:' || symbol WHEN 4 THEN symbol || '.HOSE' ELSE symbol END AS symbol, ts_us, price, volume, bid_price, bid_vol, ask_price, ask_vol FROM tape")
def frame_events(spark, d):
    return fr.events(tables.converted(spark, d)).select("seq", "feed", "kind", "symbol", *_us("ts"), "price", "volume", "bid_price", "bid_vol", "ask_price", "ask_vol")


@query("WITH TAPE SELECT seq, CASE WHEN ping THEN 'pong' ELSE kind END AS msg_type, CASE WHEN NOT ping THEN ts_us END AS ts_us FROM ck WHERE error_kind IS NULL AND (ping OR kind = 'heartbeat')")
def frame_control(spark, d):
    return fr.control(tables.converted(spark, d)).select("seq", "msg_type", *_us("ts"))


@query("WITH TAPE SELECT seq, error_kind, kind = 'error' AND event_id % 89 <> 0 AND event_id % 97 <> 0 AS is_exchange_error FROM ck WHERE error_kind IS NOT NULL")
def frame_rejects(spark, d):
    return fr.rejects(tables.converted(spark, d)).select("seq", "error_kind", "is_exchange_error")


@query("WITH TAPE SELECT error_kind, count(*)::BIGINT AS n FROM ck WHERE error_kind IS NOT NULL GROUP BY 1")
def reject_summary(spark, d):
    return fr.reject_summary(fr.rejects(tables.converted(spark, d)))


@query("""WITH TAPE, recs AS (SELECT seq, CASE WHEN seq % 7 = 0 THEN -price WHEN seq % 11 = 0 THEN 0 ELSE price END AS price, seq % 13 = 0 AS old FROM trades)
SELECT seq, CASE WHEN old THEN 'InvalidTimestamp' ELSE 'InvalidPrice' END AS error_kind FROM recs WHERE old OR price <= 0""")
def record_audit(spark, d):
    """Trades stored with faults that reading does not notice, then read again and checked."""
    path = f"{work_dir(spark)}/records-{uuid.uuid4().hex}"
    s = F.col("seq")
    price = F.when(s % 7 == 0, -F.col("price")).when(s % 11 == 0, F.lit(0.0)).otherwise(F.col("price")).alias("price")
    at = F.when(s % 13 == 0, F.lit("1999-12-31T23:59:59Z")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).alias("date_time")
    tables.tape(spark, d).where("kind = 'trade'").select("seq", "kind", "symbol", price, "volume", F.struct(at).alias("timestamp")).write.json(path)
    return fr.audit_records(fr.read_records(spark, path)).where("error_kind is not null").select("seq", "error_kind")


@query("WITH TAPE SELECT feed, CASE WHEN ping THEN 'pong' WHEN event_id % 89 = 0 OR event_id % 97 = 0 THEN NULL ELSE kind END AS msg_type, count(*)::BIGINT AS n FROM ck GROUP BY 1, 2")
def recorded_frames(spark, d):
    """Frames recorded as JSON lines, read again and parsed."""
    path = f"{work_dir(spark)}/frames-{uuid.uuid4().hex}"
    tables.frames(spark, d).write.json(path)
    return fr.parse(fr.read_frames(spark, path)).groupBy("feed", "msg_type").agg(F.count("*").alias("n"))


@query("""WITH TAPE, recs AS (SELECT seq, kind, symbol, CASE WHEN seq % 7 = 0 THEN -price ELSE price END AS price, volume, ask_price, seq % 13 = 0 AS old, ts_us FROM tape)
SELECT seq, kind, symbol, price, ask_price, CASE WHEN NOT old THEN ts_us // 1000 END AS ts_ms, CASE WHEN old THEN 'InvalidTimestamp' WHEN price <= 0 THEN 'InvalidPrice' END AS error_kind FROM recs""")
def event_records(spark, d):
    """The tape stored as events that name their kind, some with faults, then read again and checked."""
    path = f"{work_dir(spark)}/events-{uuid.uuid4().hex}"
    s = F.col("seq")
    at = F.struct(F.when(s % 13 == 0, F.lit("no time")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).alias("date_time")).alias("timestamp")
    price = F.when(s % 7 == 0, -F.col("price")).otherwise(F.col("price")).alias("price")
    of = lambda kind, *cols: F.when(F.col("kind") == kind, F.struct("symbol", *cols, at))
    tables.tape(spark, d).select("seq", of("trade", price, "volume").alias("Trade"), of("quote", *fr.QUOTE_SIDES).alias("Quote")).write.json(path)
    return fr.audit_records(fr.read_event_records(spark, path)).select("seq", "kind", "symbol", "price", "ask_price", F.unix_millis("ts").alias("ts_ms"), "error_kind")


@query("""WITH TAPE, c AS (SELECT symbol, ts_us // 3600000000 * 3600 AS start_s, arg_min(price, (ts_us, seq)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (ts_us, seq)) AS close, sum(volume) AS volume, min(seq) % 5 AS fault FROM trades GROUP BY symbol, ts_us // 3600000000)
SELECT symbol, start_s, open, high, CASE WHEN fault = 1 THEN high + 1 ELSE low END AS low, close, CASE WHEN fault = 2 THEN -1.0::DOUBLE ELSE volume END AS volume, CASE WHEN fault = 3 THEN start_s ELSE start_s + 3600 END AS end_s,
 CASE fault WHEN 1 THEN 'InvalidPrice' WHEN 2 THEN 'InvalidVolume' WHEN 3 THEN 'InvalidTime' END AS error_kind FROM c""")
def candle_records(spark, d):
    """Hourly candles stored as records, some with faults, then read again and checked."""
    path = f"{work_dir(spark)}/candle-records-{uuid.uuid4().hex}"
    fault = F.col("first_seq") % 5
    at = lambda c: F.struct(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date_time"))
    made = cd.candles(tables.tape(spark, d).where("kind = 'trade'"), "H1", mode="event")
    made.select(
        "symbol", "open", "high", F.when(fault == 1, F.col("high") + 1).otherwise(F.col("low")).alias("low"), "close", F.when(fault == 2, F.lit(-1.0)).otherwise(F.col("volume")).alias("volume"), at("start_time").alias("start_time"),
        at(F.when(fault == 3, F.col("start_time")).otherwise(F.col("end_time"))).alias("end_time"), F.lit(True).alias("is_closed"),
    ).write.json(path)
    return fr.audit_candles(fr.read_candle_records(spark, path)).select("symbol", _start(), "open", "high", "low", "close", "volume", F.unix_seconds("end_time").alias("end_s"), "error_kind")


# --- scalars and checks ----------------------------------------------------------------------------------------------

_EPOCH = "CASE event_id % 6 WHEN 0 THEN epoch_us(ts) // 1000000 WHEN 1 THEN epoch_us(ts) // 1000 WHEN 2 THEN -event_id WHEN 3 THEN 946684799000 + event_id WHEN 4 THEN 4133980799 + event_id % 4 ELSE 4133980799000 + event_id END"


@query(f"""WITH e AS (SELECT event_id, ({_EPOCH})::BIGINT AS e FROM events),
t AS (SELECT event_id, CASE WHEN e < 100000000000 THEN CASE WHEN e BETWEEN 946684800 AND 4133980799 THEN e * 1000 END WHEN e BETWEEN 946684800000 AND 4133980799999 THEN e END AS ts_ms FROM e)
SELECT event_id, ts_ms, (ts_ms // 3600000 + 7) % 24 AS vietnam_hour, CASE WHEN ts_ms - 757382400000 >= 946684800000 THEN ts_ms - 757382400000 END AS earlier_ms FROM t""")
def epochs(spark, d):
    """Raw epochs of all kinds; 24 years earlier, as long as that is not before 2000."""
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    n = F.col("event_id")
    raw = F.when(n % 6 == 0, F.floor(F.col("us") / 1000000)).when(n % 6 == 1, F.floor(F.col("us") / 1000)).when(n % 6 == 2, -n).when(n % 6 == 3, 946684799000 + n).when(n % 6 == 4, 4133980799 + n % 4).otherwise(4133980799000 + n)
    got = e.select("event_id", scalars.from_raw_epoch(raw.cast("long")).alias("t"))
    return got.select("event_id", F.unix_millis("t").alias("ts_ms"), F.hour(scalars.to_vietnam_time(F.col("t"))).cast("long").alias("vietnam_hour"), F.unix_millis(scalars.minus(F.col("t"), 757382400.0)).alias("earlier_ms"))


_RAW = """CASE event_id % 12 WHEN 0 THEN lower(base) WHEN 1 THEN '  ' || base || ' ' WHEN 2 THEN 'HOSE:' || base WHEN 3 THEN base || '.HOSE' WHEN 4 THEN 'HNX/' || base WHEN 5 THEN base || ':GARBAGE'
 WHEN 6 THEN 'GARBAGE:' || base WHEN 7 THEN 'vn30f24' || lpad((event_id // 12 % 15)::VARCHAR, 2, '0') WHEN 8 THEN ' vnindex ' WHEN 9 THEN 'HOSE:VN30' WHEN 10 THEN substr(base, 1, 2) || '@' ELSE 'HOSE' END"""


@query(f"""WITH TAPE, r AS (SELECT event_id, base, {_RAW} AS raw FROM ev)
SELECT event_id, CASE WHEN event_id % 12 < 6 THEN 'stock' WHEN event_id % 12 = 7 AND event_id // 12 % 15 BETWEEN 1 AND 12 THEN 'future' WHEN event_id % 12 = 8 THEN 'index' END AS instrument_type,
 CASE WHEN event_id % 12 < 6 THEN base WHEN event_id % 12 = 7 AND event_id // 12 % 15 BETWEEN 1 AND 12 THEN upper(raw) WHEN event_id % 12 = 8 THEN 'VNINDEX' END AS canonical,
 CASE WHEN event_id % 12 = 7 AND event_id // 12 % 15 BETWEEN 1 AND 12 THEN (event_id // 12 % 15)::INT END AS month,
 CASE WHEN event_id % 12 < 5 THEN base WHEN event_id % 12 = 7 AND event_id // 12 % 15 BETWEEN 1 AND 12 THEN upper(raw) WHEN event_id % 12 = 8 THEN 'VNINDEX' WHEN event_id % 12 = 9 THEN 'VN30' END AS strict_canonical FROM r""")
def instruments(spark, d):
    raw = F.expr(_RAW.replace("//", "div").replace("::VARCHAR", "").replace("lpad((event_id div 12 % 15)", "lpad(cast(event_id div 12 % 15 as string)"))
    got, strict = symbols.canonical(raw), symbols.canonical(raw, strict=True, strip_exchange=True)
    return tables.raw_symbols(spark, d).select("event_id", got.instrument_type.alias("instrument_type"), got.canonical.alias("canonical"), got.month.alias("month"), strict.canonical.alias("strict_canonical"))


@query("""SELECT CASE WHEN event_id % 50 = 0 THEN 'InvalidSymbol' WHEN event_id % 7 = 0 OR NOT value > 100 THEN 'InvalidPrice' WHEN event_id % 11 = 0 OR NOT json_extract(props, '$.k')::DOUBLE > 0 THEN 'InvalidVolume' END AS error_kind, count(*)::BIGINT AS n FROM events GROUP BY 1""")
def trade_checks(spark, d):
    n = F.col("event_id")
    price = F.when(n % 7 == 0, F.lit(float("nan"))).otherwise(F.col("value") - 100)
    volume = F.when(n % 11 == 0, F.lit(float("inf"))).otherwise(F.col("k"))
    error = validate.trade_error(F.when(n % 50 == 0, F.lit("   ")).otherwise(F.col("base")), price, volume)
    return tables.raw_symbols(spark, d).groupBy(error.alias("error_kind")).agg(F.count("*").alias("n"))


_Q = "SELECT CASE WHEN event_id % 3 = 0 THEN 0 ELSE value END AS b, CASE WHEN event_id % 5 = 0 THEN 0 ELSE value + (json_extract(props, '$.k')::DOUBLE - 5) / 100 END AS a, CASE WHEN event_id % 4 = 0 THEN 0 ELSE 100 END AS bv, CASE WHEN event_id % 13 = 0 THEN -1 ELSE 200 END AS av FROM events"
_QC = "CASE WHEN b < 0 OR a < 0 THEN 'InvalidPrice' WHEN bv < 0 OR av < 0 THEN 'InvalidVolume' WHEN b = 0 AND a = 0 THEN 'InvalidPrice' WHEN b > 0 AND a > 0 AND b >= a THEN 'CrossedMarket' STRICT END"


@query(f"WITH q AS ({_Q}) SELECT {_QC.replace('STRICT', '')} AS error_kind, {_QC.replace('STRICT', chr(87) + 'HEN (b = 0) <> (bv = 0) OR (a = 0) <> (av = 0) THEN ' + chr(39) + 'InvalidVolume' + chr(39))} AS strict_kind, count(*)::BIGINT AS n FROM q GROUP BY 1, 2")
def quote_checks(spark, d):
    n = F.col("event_id")
    sides = (F.when(n % 3 == 0, F.lit(0.0)).otherwise(F.col("value")), F.when(n % 4 == 0, F.lit(0.0)).otherwise(F.lit(100.0)), F.when(n % 5 == 0, F.lit(0.0)).otherwise(F.col("value") + (F.col("k") - 5) / 100), F.when(n % 13 == 0, F.lit(-1.0)).otherwise(F.lit(200.0)))
    kinds = [validate.quote_error(F.col("base"), *sides, strict_sides=s).alias(name) for s, name in ((False, "error_kind"), (True, "strict_kind"))]
    return tables.raw_symbols(spark, d).groupBy(*kinds).agg(F.count("*").alias("n"))


@query("""SELECT CASE WHEN NOT (p_size - 20) > 0 THEN 'InvalidPrice' WHEN p_partkey % 17 = 0 THEN 'InvalidVolume' WHEN p_partkey % 19 = 0 THEN 'InvalidTime' WHEN p_size < 20 OR p_size - 20 > 10 THEN 'InvalidPrice' END AS error_kind, count(*)::BIGINT AS n FROM part GROUP BY 1""")
def candle_checks(spark, d):
    """Candles made of parts: open 10, close 20, high p_size, low p_size - 20."""
    n, size, start = F.col("p_partkey"), F.col("p_size").cast("double"), F.timestamp_seconds(F.lit(1_725_300_000))
    error = validate.candle_error(F.lit("HPG"), F.lit(10.0), size, size - 20, F.lit(20.0), F.when(n % 17 == 0, F.lit(-1.0)).otherwise(F.lit(5.0)), start, F.when(n % 19 == 0, start).otherwise(start + F.make_dt_interval(mins=F.lit(1))))
    return spark.read.parquet(f"{d}/part.parquet").groupBy(error.alias("error_kind")).agg(F.count("*").alias("n"))


# --- symbols, watch lists --------------------------------------------------------------------------------------------

_ALIASES = "(1, 'acb', 'VN30F2408'), (2, ' ACB ', 'VN30F2409'), (3, 'bcm', 'bid'), (4, 'BID', 'CTG'), (5, 'X1', 'NOT_A_TICKER'), (6, 'X2', 'vnindex')"


def _aliases(spark: SparkSession) -> DataFrame:
    return spark.sql(f"select * from values {_ALIASES} as t(reg_no, alias, canonical)")


@query("""WITH TAPE, m AS (SELECT seq, CASE WHEN event_id % 5 < 3 THEN CASE symbol WHEN 'ACB' THEN 'VN30F2409' WHEN 'BCM' THEN 'BID' WHEN 'BID' THEN 'CTG' ELSE symbol END ELSE symbol END AS symbol FROM tape)
SELECT symbol, CASE WHEN symbol = 'VN30F2409' THEN 'future' ELSE 'stock' END AS instrument_type, count(*)::BIGINT AS n FROM m GROUP BY 1, 2""")
def alias_resolution(spark, d):
    mapped = mapping.map_symbols(fr.events(tables.converted(spark, d)), _aliases(spark))
    return mapped.groupBy("symbol", "instrument_type").agg(F.count("*").alias("n"))


@query("""WITH TAPE, a AS (SELECT DISTINCT symbol AS key, CASE WHEN seq % 2 = 0 THEN symbol ELSE symbol || 'X' END AS target, seq FROM tape)
SELECT key, arg_max(target, seq) AS target FROM a GROUP BY key HAVING length(arg_max(target, seq)) <> 3""")
def alias_audit(spark, d):
    """An alias table with a registration for each event; the newest counts."""
    a = tables.tape(spark, d).select(F.col("seq").alias("reg_no"), F.col("symbol").alias("alias"), F.when(F.col("seq") % 2 == 0, F.col("symbol")).otherwise(F.concat("symbol", F.lit("X"))).alias("canonical"))
    return mapping.alias_audit(a)


@query("WITH TAPE, WATCH, x AS (SELECT symbol, symbol IN (SELECT symbol FROM watch) AS tracked FROM tape) SELECT symbol, tracked, count(*)::BIGINT AS n FROM x GROUP BY 1, 2")
def basket_filter(spark, d):
    tape, watch = tables.stored_tape(spark, d), _watch(spark)
    both = mapping.tracked(tape, watch).withColumn("tracked", F.lit(True)).unionByName(mapping.untracked(tape, watch).withColumn("tracked", F.lit(False)))
    return both.groupBy("symbol", "tracked").agg(F.count("*").alias("n"))


@query("""WITH TAPE, WATCH, a AS (SELECT DISTINCT symbol FROM tape WHERE kind = 'quote' AND ask_price > 150),
x AS (SELECT 'added' AS change, symbol FROM (SELECT symbol FROM watch EXCEPT SELECT symbol FROM a) UNION ALL SELECT 'removed', symbol FROM (SELECT symbol FROM watch INTERSECT SELECT symbol FROM a)
 UNION ALL SELECT 'active', symbol FROM ((SELECT symbol FROM a UNION SELECT symbol FROM watch) EXCEPT (SELECT symbol FROM a WHERE symbol < 'G')) )
SELECT change, symbol FROM x""")
def watch_list_changes(spark, d):
    active = materialize(tables.tape(spark, d).where("kind = 'quote' and ask_price > 150").select("symbol").distinct())
    request = _watch(spark).where("trim(symbol) != ''")
    added, removed = mapping.subscribe(active, request), mapping.unsubscribe(active, request)
    after = mapping.active_after(active, added, active.where("symbol < 'G'"))
    name = lambda df, k: df.select(F.lit(k).alias("change"), "symbol")
    return name(added, "added").unionByName(name(removed, "removed")).unionByName(name(after, "active"))


@query("""WITH TAPE, s AS (SELECT DISTINCT symbol FROM tape) SELECT '{"type":"subscribe","symbols":[' || string_agg('"' || symbol || '"', ',' ORDER BY symbol) || ']}' AS message FROM s""")
def watch_list_payload(spark, d):
    return mapping.payload("subscribe", tables.tape(spark, d).select("symbol").distinct())


# --- repeated quotes -------------------------------------------------------------------------------------------------

_KEY = "symbol, ts_us, bid_price, bid_vol, ask_price, ask_vol"


@query(f"WITH TAPE SELECT seq, kind, symbol FROM tape WHERE kind = 'trade' UNION ALL SELECT seq, kind, symbol FROM (SELECT * FROM tape WHERE kind = 'quote' QUALIFY row_number() OVER (PARTITION BY {_KEY} ORDER BY seq) = 1)")
def quote_dedup(spark, d):
    return dedup.dedup_quotes(tables.stored_tape(spark, d)).select("seq", "kind", "symbol")


@query("""WITH TAPE, q AS (SELECT symbol, seq, seq % 2 = 0 AS neg FROM tape WHERE kind = 'quote')
SELECT 'distinct' AS signed_zero, count(DISTINCT symbol || neg::VARCHAR)::BIGINT AS kept FROM q UNION ALL SELECT 'equal', count(DISTINCT symbol)::BIGINT FROM q""")
def signed_zero_dedup(spark, d):
    """Quotes made equal but for the sign of a zero ask."""
    q = tables.stored_tape(spark, d).where("kind = 'quote'").withColumn("ts", F.timestamp_seconds(F.lit(1_725_300_000))).withColumn("bid_price", F.lit(5.0))
    q = q.withColumn("ask_price", F.lit(0.0) * (F.col("seq") % 2 - 0.5))
    parts = [dedup.dedup_quotes(q, z).agg(F.count("*").alias("kept")).select(F.lit(z).alias("signed_zero"), "kept") for z in ("distinct", "equal")]
    return parts[0].unionByName(parts[1])


@query(f"WITH TAPE, m AS (SELECT kind, kind = 'quote' AND row_number() OVER (PARTITION BY kind, {_KEY} ORDER BY seq) > 1 AS dup FROM tape) SELECT count(*)::BIGINT AS total_received, count(*) FILTER (dup)::BIGINT AS dropped_quotes, 0::BIGINT AS dropped_trades FROM m")
def dedup_metrics(spark, d):
    return dedup.metrics(dedup.mark_duplicates(tables.stored_tape(spark, d)))


@query(f"WITH RECURSIVE TAPE, HELD({ROOM}) SELECT feed, seq, dup AS is_duplicate FROM held WHERE n > 0")
def bounded_dedup(spark, d):
    return dedup.mark_duplicates_bounded(tables.tape(spark, d), ROOM)


def split_dedup(spark, d):
    """The same by stretches of a feed, each a task's."""
    return dedup.mark_duplicates_bounded(tables.tape(spark, d), ROOM, chunk=CHUNK)


QUERIES["split_dedup"], ORACLES["split_dedup"] = split_dedup, ORACLES["bounded_dedup"]


# --- order -----------------------------------------------------------------------------------------------------------

_SEQ = f"sq AS (SELECT *, max(ts_us) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - {int(LATENESS)} * 1000000 AS wm FROM tape)"


@query(f"WITH TAPE, {_SEQ} SELECT seq, symbol, wm AS watermark_at_arrival_us, coalesce(ts_us < wm, false) AS is_late FROM sq")
def sequencer(spark, d):
    return sequence.sequence(tables.stored_tape(spark, d), LATENESS, chunk=CHUNK).select("seq", "symbol", *_us("watermark_at_arrival"), "is_late")


@query(f"""WITH TAPE, {_SEQ}, w AS (SELECT seq AS s, max(ts_us) OVER (ORDER BY seq) - {int(LATENESS)} * 1000000 AS mark FROM tape), r AS (SELECT mark, min(s) AS s FROM w GROUP BY mark),
e AS (SELECT seq, ts_us FROM sq WHERE NOT coalesce(ts_us < wm, false)), j AS (SELECT e.seq, (SELECT min(r.s) FROM r WHERE r.mark >= e.ts_us) AS f FROM e)
SELECT seq, greatest(f, CASE WHEN f IS NOT NULL THEN seq END) AS release_seq, CASE WHEN f IS NULL THEN 'flush' ELSE 'ready' END AS release FROM j""")
def sequencer_release(spark, d):
    return sequence.release(tables.stored_tape(spark, d), LATENESS, chunk=CHUNK).select("seq", "release_seq", "release")


@query(f"WITH TAPE, {_SEQ} SELECT symbol, count(*)::BIGINT AS n_late, max((wm - ts_us) / 1000000) AS max_late_by FROM sq WHERE ts_us < wm GROUP BY symbol")
def late_events(spark, d):
    return sequence.late_report(sequence.sequence(tables.stored_tape(spark, d), LATENESS, chunk=CHUNK))


@query(f"""WITH RECURSIVE TAPE, q AS MATERIALIZED (SELECT symbol, seq, ts_us, row_number() OVER (PARTITION BY symbol ORDER BY seq) AS n FROM tape),
w AS (SELECT symbol, 0::BIGINT AS n, NULL::BIGINT AS seq, NULL::BIGINT AS mark, false AS late, []::STRUCT(ts BIGINT, seq BIGINT)[] AS wait, []::STRUCT(ts BIGINT, seq BIGINT)[] AS evicted, []::STRUCT(ts BIGINT, seq BIGINT)[] AS ready FROM q GROUP BY symbol
 UNION ALL SELECT symbol, n, seq, mark, late, list_filter(wait, lambda x: mark IS NULL OR x.ts > mark), evicted, list_filter(wait, lambda x: x.ts <= mark) FROM (
  SELECT symbol, n, seq, late, CASE WHEN len(wait) > {CAPACITY} THEN greatest(mark, oldest) ELSE mark END AS mark,
   CASE WHEN len(wait) > {CAPACITY} THEN list_filter(wait, lambda x: x.ts > oldest) ELSE wait END AS wait, CASE WHEN len(wait) > {CAPACITY} THEN list_filter(wait, lambda x: x.ts = oldest) ELSE [] END AS evicted FROM (
   SELECT *, list_min(list_transform(wait, lambda x: x.ts)) AS oldest FROM (
    SELECT q.symbol, q.n, q.seq, coalesce(q.ts_us < w.mark, false) AS late, CASE WHEN coalesce(q.ts_us < w.mark, false) THEN w.mark ELSE greatest(w.mark, q.ts_us - {int(WAIT)} * 1000000::BIGINT) END AS mark,
     CASE WHEN coalesce(q.ts_us < w.mark, false) THEN w.wait ELSE list_append(w.wait, {{'ts': q.ts_us, 'seq': q.seq}}) END AS wait FROM w JOIN q ON q.symbol = w.symbol AND q.n = w.n + 1))))
SELECT symbol, seq, 'late' AS outcome, NULL::BIGINT AS release_seq FROM w WHERE late
UNION ALL SELECT symbol, x.seq, 'evicted', seq FROM (SELECT symbol, seq, unnest(evicted) AS x FROM w)
UNION ALL SELECT symbol, x.seq, 'ready', seq FROM (SELECT symbol, seq, unnest(ready) AS x FROM w)
UNION ALL SELECT symbol, x.seq, 'flush', NULL FROM (SELECT symbol, unnest(wait) AS x FROM (SELECT symbol, wait FROM w QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY n DESC) = 1))""")
def bounded_sequencer(spark, d):
    return sequence.sequence_bounded(tables.tape(spark, d), WAIT, CAPACITY, "symbol")


def split_sequencer(spark, d):
    """The same by stretches of a symbol, each a task's."""
    return sequence.sequence_bounded(tables.tape(spark, d), WAIT, CAPACITY, "symbol", chunk=CHUNK)


QUERIES["split_sequencer"], ORACLES["split_sequencer"] = split_sequencer, ORACLES["bounded_sequencer"]


@query("WITH TAPE SELECT seq, symbol, row_number() OVER (PARTITION BY symbol ORDER BY ts_us, seq)::INT AS place FROM tape")
def replay_order(spark, d):
    return sequence.replay_number(sinks.replay(tables.stored_tape(spark, d)), DAY).select("seq", "symbol", "place")


# --- state, liveness -------------------------------------------------------------------------------------------------

_ACC = "ac AS (SELECT *, coalesce(ts_us >= max(ts_us) OVER (PARTITION BY symbol, kind ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS ok FROM tape)"


@query(f"""WITH TAPE, {_ACC} SELECT symbol, arg_max(price, (ts_us, seq)) FILTER (kind = 'trade') AS last_price, arg_max(ask_price, (ts_us, seq)) FILTER (kind = 'quote') AS last_ask,
 coalesce(sum(volume) FILTER (kind = 'trade' AND ok), 0) AS total_volume, max(ts_us) AS updated_at_us FROM ac GROUP BY symbol""")
def latest_state(spark, d):
    got = latest.snapshot(latest.mark_stale(tables.stored_tape(spark, d), CHUNK))
    return got.select("symbol", F.col("last_trade.price").alias("last_price"), F.col("last_quote.ask_price").alias("last_ask"), "total_volume", *_us("updated_at"))


@query(f"WITH TAPE, {_ACC} SELECT symbol, kind, seq, ts_us // 1000 AS ts_ms, 'StaleData' AS error_kind FROM ac WHERE NOT ok")
def stale_updates(spark, d):
    return latest.stale_report(latest.mark_stale(tables.stored_tape(spark, d), CHUNK))


@query("WITH TAPE SELECT symbol, arg_max(price, (ts_us, seq)) FILTER (kind = 'trade') AS price FROM tape WHERE symbol = 'FPT' GROUP BY symbol")
def last_price(spark, d):
    return latest.last_price(latest.snapshot(latest.mark_stale(tables.stored_tape(spark, d), CHUNK)), "  fpt ")


_SEEN = "seen AS (SELECT symbol, max(recv_us) AS t FROM tape GROUP BY symbol)"


@query(f"""WITH TAPE, WATCH, {_SEEN} SELECT coalesce(w.symbol, s.symbol) AS symbol, CASE WHEN w.symbol IS NOT NULL THEN s.t END AS last_seen_us,
 CASE WHEN w.symbol IS NULL THEN 'Untracked' WHEN s.t IS NULL THEN 'NeverSeen' WHEN {NOW_US} - s.t >= 10000000000 THEN 'Stale' ELSE 'Active' END AS status FROM watch w FULL JOIN seen s ON w.symbol = s.symbol""")
def symbol_liveness(spark, d):
    return liveness.symbol_status(tables.tape(spark, d), _watch(spark), _now(), 10_000.0).select("symbol", *_us("last_seen"), "status")


@query(f"WITH TAPE, WATCH, {_SEEN} SELECT w.symbol FROM watch w LEFT JOIN seen s ON w.symbol = s.symbol WHERE s.t IS NULL OR {NOW_US} - s.t >= 10000000000")
def stale_symbols(spark, d):
    return liveness.stale_symbols(liveness.symbol_status(tables.tape(spark, d), _watch(spark), _now(), 10_000.0))


@query("WITH TAPE, x AS (SELECT symbol, recv_us + 36000000000 AS a, lead(recv_us) OVER (PARTITION BY symbol ORDER BY recv_us, seq) AS b FROM tape) SELECT symbol, a AS stale_from_us, b AS stale_until_us FROM x WHERE b IS NULL OR a < b")
def stale_intervals(spark, d):
    return liveness.stale_intervals(tables.stored_tape(spark, d), 36_000.0, DAY).select("symbol", *_us("stale_from", "stale_until"))


@query(f"""WITH TAPE, WATCH, n AS (SELECT {NOW_US} - range * 432000000000 AS now_us FROM range(8)), l AS (SELECT w.symbol, n.now_us, (SELECT max(recv_us) FROM tape t WHERE t.symbol = w.symbol AND t.recv_us <= n.now_us) AS t FROM watch w, n)
SELECT symbol, now_us, CASE WHEN t IS NULL THEN 'NeverSeen' WHEN now_us - t >= 36000000000 THEN 'Stale' ELSE 'Active' END AS status FROM l""")
def liveness_schedule(spark, d):
    times = spark.range(8).select(F.timestamp_micros(F.lit(NOW_US) - F.col("id") * 432_000_000_000).alias("now"))
    return liveness.status_at(tables.stored_tape(spark, d), _watch(spark), times, 36_000.0, DAY).select("symbol", *_us("now"), "status")


@query(f"""WITH TAPE, l AS (SELECT feed, arg_max(recv_us, seq) AS t FROM fr GROUP BY feed), f AS (SELECT unnest(['F0', 'F1', 'F2', 'F9']) AS feed)
SELECT f.feed, l.t AS last_message_us, CASE WHEN l.t IS NULL THEN 'Dead' WHEN greatest({NOW_US} - l.t, 0) >= 50000000000 THEN 'Stale' WHEN greatest({NOW_US} - l.t, 0) >= 2000000000 THEN 'HeartbeatMissed' ELSE 'Healthy' END AS health FROM f LEFT JOIN l ON f.feed = l.feed""")
def feed_health(spark, d):
    feeds = spark.sql("select explode(array('F0', 'F1', 'F2', 'F9')) as feed")
    return liveness.feed_health(tables.frames(spark, d), _now(), 2_000.0, 50_000.0, feeds).select("feed", *_us("last_message"), "health")


# --- candles ---------------------------------------------------------------------------------------------------------

_CANDLE = ("symbol", "timeframe", "open", "high", "low", "close", "volume")
_TF = "tf AS (SELECT * FROM (VALUES ('M1', 60, 512, 0), ('M15', 900, 32, 1), ('H1', 3600, 8, 2), ('D1', 86400, 16, 3)) t(timeframe, step, room, tf_order))"
_ARR = "rm AS (SELECT *, max(ts_us) OVER (PARTITION BY symbol ORDER BY seq) AS rm FROM trades)"
_ALL = f"""{_TF}, {_ARR}, c AS (SELECT symbol, timeframe, any_value(tf_order) AS tf_order, any_value(room) AS room, any_value(step) AS step, rm // 1000000 // step * step AS start_s, arg_min(price, seq) AS open, max(price) AS high, min(price) AS low, arg_max(price, seq) AS close, sum(volume) AS volume, min(seq) AS first_seq
  FROM rm, tf GROUP BY symbol, timeframe, rm // 1000000 // step * step),
mc AS (SELECT *, lead(first_seq) OVER (PARTITION BY symbol, timeframe ORDER BY start_s) AS closed_by_seq FROM c)"""


def _start():
    return F.unix_seconds("start_time").alias("start_s")


def _marked(spark, d):
    return cd.mark_closed(cd.all_timeframes(_trades(spark, d), chunk=CHUNK))


@query(f"WITH TAPE, {_ALL} SELECT symbol, timeframe, start_s, open, high, low, close, volume FROM c WHERE timeframe = 'M15'")
def candles_arrival(spark, d):
    return cd.candles(_trades(spark, d), "M15", chunk=CHUNK).select(*_CANDLE, _start())


@query("WITH TAPE SELECT symbol, 'M15' AS timeframe, ts_us // 900000000 * 900 AS start_s, arg_min(price, (ts_us, seq)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (ts_us, seq)) AS close, sum(volume) AS volume FROM trades GROUP BY symbol, ts_us // 900000000")
def candles_event_time(spark, d):
    return cd.candles(tables.tape(spark, d).where("kind = 'trade'"), "M15", mode="event").select(*_CANDLE, _start())


@query(f"WITH TAPE, {_ALL} SELECT symbol, timeframe, start_s, start_s + step AS end_s, open, high, low, close, volume, closed_by_seq IS NOT NULL AS is_closed FROM mc")
def candles_all(spark, d):
    return _marked(spark, d).select(*_CANDLE, _start(), F.unix_seconds("end_time").alias("end_s"), "is_closed")


@query(f"WITH TAPE, {_ALL} SELECT closed_by_seq, tf_order, symbol, timeframe, start_s, close FROM mc WHERE closed_by_seq IS NOT NULL")
def candle_close_events(spark, d):
    return cd.close_events(_marked(spark, d)).select("closed_by_seq", "tf_order", "symbol", "timeframe", _start(), "close")


@query(f"WITH TAPE, {_ALL} SELECT symbol, timeframe, start_s, close FROM mc WHERE closed_by_seq IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol, timeframe ORDER BY start_s DESC) <= room")
def candle_history(spark, d):
    return cd.history(_marked(spark, d)).select("symbol", "timeframe", _start(), "close")


@query(f"WITH TAPE, {_ALL} SELECT symbol, timeframe, start_s, open, high, low, close, volume FROM mc WHERE closed_by_seq IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol, timeframe ORDER BY start_s DESC) = 1")
def candle_latest_closed(spark, d):
    return cd.latest_closed(_marked(spark, d)).select(*_CANDLE, _start())


@query(f"WITH TAPE, {_ALL} SELECT symbol, timeframe, start_s, open, high, low, close, volume FROM mc WHERE closed_by_seq IS NULL")
def candle_current(spark, d):
    return cd.current(_marked(spark, d)).select(*_CANDLE, _start())


@query("WITH TAPE SELECT DISTINCT symbol FROM trades")
def candle_symbols(spark, d):
    return cd.symbols(cd.candles(tables.tape(spark, d).where("kind = 'trade'"), "D1", mode="event"))


_LI = """li AS (SELECT 'S' || l_suppkey::VARCHAR AS symbol, l_extendedprice / l_quantity AS price, l_quantity AS volume, epoch_us(l_shipdate) // 1000000 + l_linenumber * 3600 AS s,
 (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS o FROM lineitem)"""


@query(f"WITH {_LI}, rm AS (SELECT *, max(s) OVER (PARTITION BY symbol ORDER BY o) AS rm FROM li) SELECT symbol, 'D1' AS timeframe, rm // 86400 * 86400 AS start_s, arg_min(price, o) AS open, max(price) AS high, min(price) AS low, arg_max(price, o) AS close, sum(volume) AS volume FROM rm GROUP BY symbol, rm // 86400")
def heavy_candles_arrival(spark, d):
    return cd.candles(tables.heavy_trades(spark, d), "D1", chunk=HEAVY_CHUNK, order="ord").select(*_CANDLE, _start())


@query(f"WITH {_LI} SELECT symbol, 'H1' AS timeframe, s // 3600 * 3600 AS start_s, arg_min(price, (s, o)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (s, o)) AS close, sum(volume) AS volume FROM li GROUP BY symbol, s // 3600")
def heavy_candles_event_time(spark, d):
    return cd.candles(tables.heavy_trades(spark, d), "H1", mode="event").select(*_CANDLE, _start())


@query(f"WITH TAPE, {_ALL} SELECT timeframe, count(*)::BIGINT AS n, sum(volume) AS volume FROM mc GROUP BY timeframe")
def candle_sink(spark, d):
    """Candles written by timeframe and date, then read again."""
    path = f"{work_dir(spark)}/candles-{uuid.uuid4().hex}"
    sinks.write_candles(cd.all_timeframes(_trades(spark, d), chunk=CHUNK), path)
    return spark.read.parquet(path).groupBy("timeframe").agg(F.count("*").alias("n"), F.sum("volume").alias("volume"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candle_latest_closed(spark, sf_dir)


# --- whole jobs ------------------------------------------------------------------------------------------------------

_CLEAN = f"""dd AS (SELECT * FROM tape WHERE kind = 'trade' UNION ALL SELECT * FROM (SELECT * FROM tape WHERE kind = 'quote' QUALIFY row_number() OVER (PARTITION BY {_KEY} ORDER BY seq) = 1)),
wk AS (SELECT *, max(ts_us) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - {int(LATENESS)} * 1000000 AS wm FROM dd), good AS (SELECT * FROM wk WHERE NOT coalesce(ts_us < wm, false)),
ga AS (SELECT *, coalesce(ts_us >= max(ts_us) OVER (PARTITION BY symbol, kind ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS ok FROM good)"""


_STATE = f"""WITH TAPE, {_CLEAN} SELECT symbol, arg_max(price, (ts_us, seq)) FILTER (kind = 'trade') AS last_price, arg_max(bid_price, (ts_us, seq)) FILTER (kind = 'quote') AS last_bid,
 coalesce(sum(volume) FILTER (kind = 'trade' AND ok), 0) AS total_volume FROM ga GROUP BY symbol"""


@query(_STATE)
def job_market_state(spark, d):
    clean = workloads.clean_tape(tables.frames(spark, d), LATENESS, chunk=CHUNK)
    return workloads.market_state(clean.events, CHUNK).select("symbol", F.col("last_trade.price").alias("last_price"), F.col("last_quote.bid_price").alias("last_bid"), "total_volume")


_KEPT = f"""WITH TAPE, {_CLEAN}, {_TF}, c AS (SELECT symbol, timeframe, any_value(room) AS room, ts_us // 1000000 // step * step AS start_s, arg_min(price, (ts_us, seq)) AS open, arg_max(price, (ts_us, seq)) AS close, sum(volume) AS volume
 FROM good, tf WHERE kind = 'trade' GROUP BY symbol, timeframe, ts_us // 1000000 // step * step), n AS (SELECT *, row_number() OVER (PARTITION BY symbol, timeframe ORDER BY start_s DESC) - 1 AS n FROM c)
SELECT symbol, timeframe, start_s, open, close, volume, n > 0 AS is_closed FROM n WHERE n <= room"""


@query(_KEPT)
def job_candles(spark, d):
    clean = workloads.clean_tape(tables.frames(spark, d), LATENESS, chunk=CHUNK)
    return workloads.candle_tables(clean.events).select("symbol", "timeframe", _start(), "open", "close", "volume", "is_closed")


@query(f"WITH TAPE, {_CLEAN} SELECT symbol, count(*)::BIGINT AS n FROM wk WHERE ts_us < wm GROUP BY symbol")
def job_late_events(spark, d):
    return workloads.clean_tape(tables.frames(spark, d), LATENESS, chunk=CHUNK).late.groupBy("symbol").agg(F.count("*").alias("n"))


# --- the tape by symbol ----------------------------------------------------------------------------------------------


def _by_symbol(spark: SparkSession, d: str, **more) -> by_symbol.SymbolTape:
    return by_symbol.store(tables.stored_tape(spark, d), LATENESS, CHUNK, **more)


@query(_STATE)
def tape_by_symbol_state(spark, d):
    """As job_market_state, from the tape in buckets of symbols."""
    return _by_symbol(spark, d).state().select("symbol", F.col("last_trade.price").alias("last_price"), F.col("last_quote.bid_price").alias("last_bid"), "total_volume")


@query(_KEPT)
def tape_by_symbol_candles(spark, d):
    return _by_symbol(spark, d).candles().select("symbol", "timeframe", _start(), "open", "close", "volume", "is_closed")


@query(f"WITH TAPE, {_CLEAN.replace('OVER (ORDER BY seq ROWS', 'OVER (PARTITION BY symbol ORDER BY seq ROWS')} SELECT symbol, count(*)::BIGINT AS n FROM wk WHERE ts_us < wm GROUP BY symbol")
def tape_by_symbol_late(spark, d):
    """Events behind their own symbol's watermark."""
    return _by_symbol(spark, d, per_symbol=True).late().groupBy("symbol").agg(F.count("*").alias("n"))


@query(f"""WITH TAPE, WATCH, {_CLEAN}, seen AS (SELECT symbol, max(recv_us) AS t FROM good GROUP BY symbol), x AS (SELECT symbol, recv_us + 36000000000 AS a, lead(recv_us) OVER (PARTITION BY symbol ORDER BY recv_us, seq) AS b FROM good WHERE symbol IN (FROM watch)),
i AS (SELECT symbol, count(*)::BIGINT AS n_stale FROM x WHERE b IS NULL OR a < b GROUP BY symbol)
SELECT coalesce(w.symbol, s.symbol) AS symbol, CASE WHEN w.symbol IS NULL THEN 'Untracked' WHEN s.t IS NULL THEN 'NeverSeen' WHEN {NOW_US} - s.t >= 10000000000 THEN 'Stale' ELSE 'Active' END AS status, coalesce(n_stale, 0) AS n_stale
 FROM watch w FULL JOIN seen s ON w.symbol = s.symbol LEFT JOIN i ON i.symbol = coalesce(w.symbol, s.symbol)""")
def tape_by_symbol_liveness(spark, d):
    """The watched symbols' status, and how often each was stale."""
    tape, watch = _by_symbol(spark, d), _watch(spark)
    often = tape.stale_intervals(watch, 36_000.0, DAY).groupBy("symbol").agg(F.count("*").alias("n_stale"))
    return tape.status(watch, _now(), 10_000.0).join(often, "symbol", "left").select("symbol", "status", F.coalesce("n_stale", F.lit(0)).alias("n_stale"))
