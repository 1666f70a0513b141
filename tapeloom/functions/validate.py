"""Checks of trades, quotes and candles: the first failure's kind, or null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import finite, normal_symbol


def _first(*checks: tuple[Column, str]) -> Column:
    """Each check: what must hold (null counts as not) and the kind if it doesn't."""
    return F.coalesce(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(kind)) for ok, kind in checks))


def _named(symbol: Column) -> Column:
    return normal_symbol(symbol) != ""


def trade_error(symbol: Column, price: Column, volume: Column) -> Column:
    return _first((_named(symbol), "InvalidSymbol"), (finite(price) & (price > 0), "InvalidPrice"), (finite(volume) & (volume > 0), "InvalidVolume"))


def quote_error(symbol: Column, bid_price: Column, bid_vol: Column, ask_price: Column, ask_vol: Column, strict_sides: bool = False) -> Column:
    """One side without a price is legal, both are not. strict_sides: a side has a price just if it has a volume."""
    good = lambda x: finite(x) & (x >= 0)
    checks = [
        (_named(symbol), "InvalidSymbol"),
        (good(bid_price) & good(ask_price), "InvalidPrice"),
        (good(bid_vol) & good(ask_vol), "InvalidVolume"),
        ((bid_price != 0) | (ask_price != 0), "InvalidPrice"),
        (~((bid_price > 0) & (ask_price > 0) & (bid_price >= ask_price)), "CrossedMarket"),
    ]
    if strict_sides:
        checks.append((((bid_price == 0) == (bid_vol == 0)) & ((ask_price == 0) == (ask_vol == 0)), "InvalidVolume"))
    return _first(*checks)


def candle_error(symbol: Column, open: Column, high: Column, low: Column, close: Column, volume: Column, start: Column, end: Column) -> Column:
    prices = F.lit(True)
    for p in (open, high, low, close):
        prices = prices & finite(p) & (p > 0)
    return _first(
        (_named(symbol), "InvalidSymbol"),
        (prices, "InvalidPrice"),
        (finite(volume) & (volume >= 0), "InvalidVolume"),
        (start < end, "InvalidTime"),
        ((high >= open) & (high >= close) & (low <= open) & (low <= close), "InvalidPrice"),
    )
