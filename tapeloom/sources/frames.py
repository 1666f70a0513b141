"""Exchange frames: JSON texts to events, control messages and rejected frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import from_raw_epoch, normal_symbol
from ..functions.validate import candle_error, quote_error, trade_error

FRAME_SCHEMA = "feed string, seq bigint, recv_ts timestamp, frame_kind string, raw string"
_MESSAGE = (
    "type string, symbol string, price double, volume double, bid_price double, bid_vol double, ask_price double, ask_vol double, "
    "timestamp bigint, code string, message string"
)
# What each type of message must hold.
REQUIRED = {
    "trade": ("symbol", "price", "volume", "timestamp"),
    "quote": ("symbol", "bid_price", "bid_vol", "ask_price", "ask_vol", "timestamp"),
    "heartbeat": ("timestamp",),
    "error": ("code", "message"),
}
QUOTE_SIDES = ("bid_price", "bid_vol", "ask_price", "ask_vol")


def read_frames(spark: SparkSession, path: str, streaming: bool = False, files_per_batch: int | None = None) -> DataFrame:
    """Recorded frames as JSON lines of FRAME_SCHEMA."""
    read = (spark.readStream if streaming else spark.read).schema(FRAME_SCHEMA)
    return (read.option("maxFilesPerTrigger", files_per_batch) if streaming and files_per_batch else read).json(path)


def _settled(df: DataFrame, **columns: Column) -> DataFrame:
    """df with the columns, computed once per row: a generator of one row keeps Catalyst from writing the expressions out
    again wherever a later filter or column uses them, which would multiply with every step."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def _is_text(parsed: Column, field: str) -> Column:
    """The field is absent or a JSON string; from_json alone would turn a number into text."""
    got = F.schema_of_variant(F.try_variant_get(parsed, f"$.{field}", "variant"))
    return F.coalesce(got.isin("STRING", "VOID"), F.lit(True))


def parse(frames: DataFrame) -> DataFrame:
    """frames with msg (the message's fields), msg_type (trade, quote, heartbeat, error, pong; null if it can't be parsed) and
    parse_error. Strict JSON: no single quotes, NaN, repeated keys or trailing text; a wrong type counts as missing."""
    raw = F.col("raw")
    out = _settled(frames, _v=F.when(F.col("frame_kind") == "text", F.try_parse_json(raw)))
    got = F.from_json(raw, _MESSAGE, {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"})
    sound = F.col("_v").isNotNull() & raw.rlike(r"\}\s*$")
    for field in ("type", "symbol", "code", "message"):
        sound = sound & _is_text(F.col("_v"), field)
    out = _settled(out, msg=F.when(sound, got)).drop("_v")
    tag = F.when(F.col("msg.type") == "exchange_error", F.lit("error")).otherwise(F.col("msg.type"))
    whole = F.lit(None).cast("string")
    for kind, fields in REQUIRED.items():
        full = F.lit(True)
        for field in fields:
            full = full & F.col(f"msg.{field}").isNotNull()
        whole = F.when((tag == kind) & full, F.lit(kind)).otherwise(whole)
    out = _settled(out, msg_type=F.when(F.col("frame_kind").isin("ping", "pong"), F.lit("pong")).otherwise(whole))
    error = (
        F.when(F.col("msg_type").isNotNull(), F.lit(None).cast("string"))
        .when(F.col("frame_kind") == "binary", F.lit("binary frames are not supported"))
        .when(F.col("msg.type").isNull(), F.lit("malformed message"))
        .when(~F.col("msg.type").isin(*REQUIRED, "exchange_error"), F.lit("unknown message type"))
        .otherwise(F.lit("missing or malformed field"))
    )
    return out.withColumn("parse_error", error)


def convert(parsed: DataFrame, strict_sides: bool = False) -> DataFrame:
    """parsed with ts, symbol, error_kind, error_reason, is_exchange_error and status (event, control, rejected). Checks in
    this order: time, then the trade's or quote's own; the symbol is trimmed and in upper case, not mapped."""
    m, kind = F.col("msg"), F.col("msg_type")
    out = _settled(parsed, ts=from_raw_epoch(m.timestamp), symbol=normal_symbol(m.symbol))
    own = F.when(kind == "trade", trade_error(m.symbol, m.price, m.volume)).when(kind == "quote", quote_error(m.symbol, *(m[c] for c in QUOTE_SIDES), strict_sides=strict_sides))
    error = F.when(kind.isNull() | (kind == "error"), F.lit("ParseError")).when(kind.isin("trade", "quote") & F.col("ts").isNull(), F.lit("InvalidTimestamp")).otherwise(own)
    out = _settled(out, error_kind=error)
    rejected = F.col("error_kind").isNotNull()
    reason = F.when(rejected, F.coalesce(F.col("parse_error"), F.when(kind == "error", m.message), F.col("error_kind")))
    status = F.when(rejected, F.lit("rejected")).when(kind.isin("heartbeat", "pong"), F.lit("control")).otherwise(F.lit("event"))
    return _settled(out, status=status, error_reason=reason, is_exchange_error=F.coalesce(kind == "error", F.lit(False)))


def events(converted: DataFrame) -> DataFrame:
    """The tape: valid trades and quotes, columns of the other kind null."""
    side = lambda kind, c: F.when(F.col("msg_type") == kind, F.col(f"msg.{c}")).alias(c)
    return converted.where("status = 'event'").select(
        "feed", "seq", "recv_ts", F.col("msg_type").alias("kind"), "symbol", "ts", side("trade", "price"), side("trade", "volume"), *(side("quote", c) for c in QUOTE_SIDES)
    )


def control(converted: DataFrame) -> DataFrame:
    return converted.where("status = 'control'").select("feed", "seq", "recv_ts", "msg_type", "ts")


def rejects(converted: DataFrame) -> DataFrame:
    return converted.where("status = 'rejected'").select("feed", "seq", "recv_ts", "raw", "error_kind", "error_reason", "is_exchange_error")


def reject_summary(rejected: DataFrame) -> DataFrame:
    return rejected.groupBy("error_kind").agg(F.count("*").alias("n"))


_TRADE = "symbol: string, price: double, volume: double, timestamp: struct<date_time: string>"
_QUOTE = "symbol: string, bid_price: double, bid_vol: double, ask_price: double, ask_vol: double, timestamp: struct<date_time: string>"
_TIMES = {"timestamp": "ts", "start_time": "start_time", "end_time": "end_time"}


def _timed(df: DataFrame) -> DataFrame:
    """df with its times, stored as {"date_time": ...}, as timestamps; null where they are none."""
    return df.select(*(F.try_to_timestamp(F.col(c).date_time).alias(_TIMES[c]) if c in _TIMES else F.col(c) for c in df.columns))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Stored trades and quotes, one JSON object a line with its time as {"date_time": ...}; nothing is checked on reading."""
    fields = "seq bigint, kind string, symbol string, price double, volume double, bid_price double, bid_vol double, ask_price double, ask_vol double, timestamp struct<date_time: string>"
    return _timed(spark.read.schema(fields).json(path))


def read_event_records(spark: SparkSession, path: str) -> DataFrame:
    """Stored market events, one JSON object a line that names its kind: {"Trade": {...}} or {"Quote": {...}}. Columns as of
    read_records, without seq unless the lines have one; kind is null for other objects. Nothing is checked on reading."""
    read = spark.read.schema(f"seq bigint, Trade struct<{_TRADE}>, Quote struct<{_QUOTE}>").json(path)
    both = lambda c: F.coalesce(F.col(f"Trade.{c}"), F.col(f"Quote.{c}")).alias(c)
    kind = F.when(F.col("Trade").isNotNull(), "trade").when(F.col("Quote").isNotNull(), "quote").alias("kind")
    return _timed(read.select("seq", kind, both("symbol"), "Trade.price", "Trade.volume", *(f"Quote.{c}" for c in QUOTE_SIDES), both("timestamp")))


def read_candle_records(spark: SparkSession, path: str) -> DataFrame:
    """Stored candles, one JSON object a line with its times as {"date_time": ...}; nothing is checked on reading."""
    fields = "symbol string, open double, high double, low double, close double, volume double, start_time struct<date_time: string>, end_time struct<date_time: string>, is_closed boolean"
    return _timed(spark.read.schema(fields).json(path))


def audit_candles(records: DataFrame) -> DataFrame:
    """Stored candles with error_kind: what checks on reading would have refused."""
    times = F.lit(True)
    for c in ("start_time", "end_time"):
        times = times & F.col(c).isNotNull() & F.year(c).between(2000, 2100)
    own = candle_error(*(F.col(c) for c in ("symbol", "open", "high", "low", "close", "volume", "start_time", "end_time")))
    return records.withColumn("error_kind", F.when(~times, F.lit("InvalidTimestamp")).otherwise(own))


def audit_records(records: DataFrame) -> DataFrame:
    """records with error_kind: what checks on reading would have refused."""
    c = F.col
    own = F.when(c("kind") == "trade", trade_error(c("symbol"), c("price"), c("volume"))).otherwise(quote_error(c("symbol"), *(c(x) for x in QUOTE_SIDES)))
    return records.withColumn("error_kind", F.when(c("ts").isNull() | ~F.year("ts").between(2000, 2100), F.lit("InvalidTimestamp")).otherwise(own))
