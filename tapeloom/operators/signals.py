"""Risk gates, the life of a signal, and alerts that don't repeat."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .series import whole_symbols

MIN_SCORE, COOLDOWN_BARS, DEBOUNCE_MINUTES = 0.75, 3, 60
# Continuous trading in Vietnam, minutes of the day.
SESSIONS = ((540, 690), (780, 870))
PRIORITY = {"STOP_LOSS": "CRITICAL", "INVALIDATED": "CRITICAL", "TAKE_PROFIT": "HIGH", "ENTRY": "HIGH"}


def in_session(ts: Column) -> Column:
    """Within continuous trading, by the clock at UTC+7."""
    minute = (F.floor(F.unix_seconds(ts) / 60) + 7 * 60) % 1440
    out = F.lit(False)
    for a, b in SESSIONS:
        out = out | ((minute >= a) & (minute < b))
    return out


def gates(df: DataFrame, max_volatility: float = 0.05, max_spread: float = 0.02, stale: str = "is_stale", spread: str = "spread") -> DataFrame:
    """df with blocked_by: the first gate that fails, null if none; and passes."""
    checks = (
        ("stale_data", ~F.coalesce(F.col(stale), F.lit(True))),
        ("missing_indicator", F.col("is_valid")),
        ("volatility", F.col("std_20") <= max_volatility),
        ("spread", F.coalesce(F.col(spread) <= max_spread, F.lit(True))),
        ("session", in_session(F.col("start_time"))),
    )
    blocked = F.coalesce(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks))
    return df.withColumn("blocked_by", blocked).withColumn("passes", F.col("blocked_by").isNull())


class Life:
    """A symbol's signal, bar by bar: its state, the bars left of a cool-down, and the levels of an entry."""

    def __init__(self, min_score: float = MIN_SCORE, cooldown: int = COOLDOWN_BARS, state: str = "IDLE", left: int = 0, stop: float = 0.0, target: float = 0.0):
        self.min_score, self.cooldown, self.state, self.left, self.stop, self.target = min_score, cooldown, state, left, stop, target

    def bar(self, low: float, high: float, valid: bool, passes: bool, score: float, stop: float, target: float) -> str | None:
        """What a bar brings about. An entry is at the close; from the next bar on the stop is tested before the target; a bar that
        is no longer valid invalidates. After the cool-down the symbol is idle again."""
        event = None
        if self.state == "ENTRY":
            event = "STOP_LOSS" if low <= self.stop else "TAKE_PROFIT" if high >= self.target else "INVALIDATED" if not valid else None
            if event:
                self.state, self.left = "COOLDOWN", self.cooldown
        elif self.state == "COOLDOWN":
            self.left -= 1
            if self.left <= 0:
                self.state = "IDLE"
        elif passes and pd.notna(score) and score >= self.min_score and pd.notna(target):
            self.state, event, self.stop, self.target = "ENTRY", "ENTRY", float(stop), float(target)
        return event


def life_frame(pdf: pd.DataFrame, min_score: float = MIN_SCORE, cooldown: int = COOLDOWN_BARS) -> pd.DataFrame:
    """One symbol's bars in order: (bar, state after it, event). The plain form of life_cycle."""
    life, out = Life(min_score, cooldown), []
    for r in pdf.sort_values("start_time").itertuples(index=False):
        event = life.bar(r.low, r.high, r.is_valid, r.passes, r.score, r.stop_loss, r.take_profit)
        out.append((r.symbol, r.start_time, life.state, event))
    return pd.DataFrame(out, columns=["symbol", "start_time", "state", "event"])


def life_cycle(bars: DataFrame, min_score: float = MIN_SCORE, cooldown: int = COOLDOWN_BARS) -> DataFrame:
    """(symbol, start_time, state, event) of bars with high, low, is_valid, passes, score, take_profit, stop_loss. Bars are dealt
    by symbol and walked in order, many symbols to a frame: most symbols have few."""
    numbers = ["low", "high", "score", "stop_loss", "take_profit"]
    rows = bars.select("symbol", "start_time", *numbers, "is_valid", "passes").repartition("symbol").sortWithinPartitions("symbol", "start_time")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, begins in whole_symbols(batches):
            low, high, score, stop, target = (pc.fill_null(table.column(c), float("nan")).to_pylist() for c in numbers)
            valid, passes = (pc.fill_null(table.column(c), False).to_pylist() for c in ("is_valid", "passes"))
            first, states, events = set(begins.tolist()), [], []
            for k in range(len(table)):
                if k in first:
                    life = Life(min_score, cooldown)
                events.append(life.bar(low[k], high[k], valid[k], passes[k], score[k], stop[k], target[k]))
                states.append(life.state)
            out = table.select(["symbol", "start_time"]).append_column("state", pa.array(states, pa.string())).append_column("event", pa.array(events, pa.string()))
            yield from out.combine_chunks().to_batches(max_chunksize=10_000)

    return rows.mapInArrow(walk, "symbol string, start_time timestamp, state string, event string")


def debounce(events: DataFrame, minutes: int = DEBOUNCE_MINUTES) -> DataFrame:
    """events(symbol, start_time, event) with priority and sent: an alert goes out unless the same one of its symbol went out
    less than minutes before. That depends on what was sent, so an alert's times are walked through in order."""

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, last, sent = pdf.sort_values("start_time"), None, []
        for at in pdf["start_time"]:
            sent.append(last is None or at - last >= pd.Timedelta(minutes=minutes))
            last = at if sent[-1] else last
        return pdf.assign(sent=sent)

    rows = events.where("event is not null").select("symbol", "start_time", "event")
    out = rows.groupBy("symbol", "event").applyInPandas(walk, "symbol string, start_time timestamp, event string, sent boolean")
    return priority(out)


def priority(events: DataFrame) -> DataFrame:
    """events(event) with priority."""
    ranks = F.create_map(*(F.lit(x) for pair in PRIORITY.items() for x in pair))
    return events.withColumn("priority", F.coalesce(F.try_element_at(ranks, F.col("event")), F.lit("INFO")))


def with_audit(signals: DataFrame, model_version: str, config_version: str) -> DataFrame:
    return signals.withColumns({"model_version": F.lit(model_version), "config_version": F.lit(config_version), "feature_timestamp": F.col("start_time")})
