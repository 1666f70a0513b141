"""Whole jobs put together from the operators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import candles as cd
from ..operators import dedup, latest, liveness, mapping, sequence
from ..paths import materialize
from ..sources import frames as fr


@dataclass(frozen=True)
class CleanTape:
    """What becomes of recorded frames. They are parsed once; the four tables read what came of that."""

    events: DataFrame
    late: DataFrame
    control: DataFrame
    rejects: DataFrame


def clean_tape(frames: DataFrame, lateness: float, aliases: DataFrame | None = None, chunk: int | None = None, keys: tuple[str, ...] = ()) -> CleanTape:
    """Parsed, checked, mapped to canonical symbols, without repeated quotes, late events set aside. Events with symbols that
    are no instruments are left out."""
    converted = fr.convert(fr.parse(frames))
    converted = materialize(converted.withColumn("raw", F.when(F.col("status") == "rejected", F.col("raw"))))
    tape = mapping.map_symbols(fr.events(converted), aliases).where("symbol is not null")
    marked = sequence.sequence(dedup.dedup_quotes(tape), lateness, keys, chunk)
    return CleanTape(marked.where("not is_late"), marked.where("is_late"), fr.control(converted), fr.rejects(converted))


def market_state(events: DataFrame, chunk: int | None = None) -> DataFrame:
    return latest.snapshot(latest.mark_stale(events, chunk))


def candle_tables(events: DataFrame, timeframes: tuple[str, ...] = tuple(cd.TIMEFRAMES)) -> DataFrame:
    """Candles of a clean tape, which is replayed in time order, with is_closed, and no more closed ones than are kept."""
    marked = cd.mark_closed(cd.all_timeframes(events.where("kind = 'trade'"), timeframes, mode="event"))
    return cd.kept(marked)


def liveness_tables(events: DataFrame, watch: DataFrame, now: Column, threshold: float) -> tuple[DataFrame, DataFrame]:
    """The watched symbols' status, and when each was stale."""
    seen = mapping.tracked(events, watch)
    return liveness.symbol_status(seen, watch, now, threshold), liveness.stale_intervals(seen, threshold)
