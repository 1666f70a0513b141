"""Alias tables, watch lists and their joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import normal_symbol
from ..functions.symbols import canonical

#: Rows of an alias table or watch list that may be broadcast.
SMALL = 100_000


def small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if its size, counted, allows it."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def alias_table(aliases: DataFrame) -> DataFrame:
    """(key, target) from aliases(reg_no, alias, canonical): the last registration of an alias counts."""
    return aliases.groupBy(normal_symbol(F.col("alias")).alias("key")).agg(F.max_by("canonical", "reg_no").alias("target"))


def map_symbols(tape: DataFrame, aliases: DataFrame | None = None, strict: bool = False, strip_exchange: bool = False) -> DataFrame:
    """tape with symbol replaced by its canonical form, null if it is no instrument, and instrument_type. One alias hop."""
    if aliases is not None:
        keyed = tape.withColumn("_key", normal_symbol(F.col("symbol")))
        table = small(alias_table(aliases).withColumnRenamed("key", "_key"))
        tape = keyed.join(table, "_key", "left").withColumn("symbol", F.coalesce("target", "_key")).drop("_key", "target")
    found = F.inline(F.array(F.struct(canonical(F.col("symbol"), strict, strip_exchange).alias("_i"))))  # once per row, see sources.frames
    return tape.select("*", found).withColumns({"symbol": F.col("_i.canonical"), "instrument_type": F.col("_i.instrument_type")}).drop("_i")


def alias_audit(aliases: DataFrame) -> DataFrame:
    """Registered aliases whose target is no instrument."""
    return alias_table(aliases).where(canonical(F.col("target")).isNull())


def normal_list(symbols: DataFrame) -> DataFrame:
    """(symbol): distinct, trimmed, in upper case, without blanks."""
    return symbols.select(normal_symbol(F.col("symbol")).alias("symbol")).where("symbol != ''").distinct()


def tracked(tape: DataFrame, watch: DataFrame) -> DataFrame:
    return tape.join(small(normal_list(watch)), "symbol", "left_semi")


def untracked(tape: DataFrame, watch: DataFrame) -> DataFrame:
    return tape.join(small(normal_list(watch)), "symbol", "left_anti")


# --- changes of a watch list -----------------------------------------------------------------------------------------


def subscribe(active: DataFrame, request: DataFrame) -> DataFrame:
    """The symbols of the request that are new, sorted; a blank symbol fails the whole request."""
    return _whole(request).subtract(active.select("symbol")).orderBy("symbol")


def unsubscribe(active: DataFrame, request: DataFrame) -> DataFrame:
    """The symbols of the request that were active, sorted."""
    return _whole(request).intersect(active.select("symbol")).orderBy("symbol")


def _whole(request: DataFrame) -> DataFrame:
    name = normal_symbol(F.col("symbol"))
    return request.select(F.when(F.coalesce(name, F.lit("")) == "", F.raise_error(F.lit("InvalidSymbol: blank symbol in request"))).otherwise(name).alias("symbol")).distinct()


def active_after(active: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    return active.select("symbol").union(added.select("symbol")).distinct().subtract(removed.select("symbol")).orderBy("symbol")


def payload(kind: str, symbols: DataFrame) -> DataFrame:
    """One row: the message that a watch list's change sends; none if nothing changes. A watch list is short."""
    listed = symbols.agg(F.array_sort(F.collect_set("symbol")).alias("symbols")).where(F.size("symbols") > 0)
    return listed.select(F.to_json(F.struct(F.lit(kind).alias("type"), "symbols")).alias("message"))
