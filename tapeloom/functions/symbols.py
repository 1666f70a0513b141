"""Instruments out of symbol texts: stocks, index futures and indices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import normal_symbol, trim_all

# Fixed values.
EXCHANGES = ("HOSE", "HNX", "UPCOM", "HSX")
INDICES = ("VN30", "VNINDEX")
FUTURE = "VN30F"
BASKET = (
    "ACB", "BCM", "BID", "BVH", "CTG", "FPT", "GAS", "GVR", "HDB", "HPG",
    "MBB", "MSN", "MWG", "PLX", "POW", "SAB", "SHB", "SSB", "SSI", "STB",
    "TCB", "TPB", "VCB", "VHM", "VIB", "VIC", "VJC", "VNM", "VPB", "VRE",
)


def _parts(text: Column) -> Column:
    return F.transform(F.split(F.upper(text), "[:./]"), trim_all)


def _without_exchange(text: Column) -> Column:
    return F.filter(_parts(text), lambda p: ~p.isin(*EXCHANGES))


def stock(text: Column, strict: bool = False) -> Column:
    """The first part between : . / that names no exchange, if it is three letters. strict: no other part may follow."""
    rest = _without_exchange(text)
    first = F.get(rest, F.lit(0))
    return F.when(first.rlike("^[A-Z]{3}$") & ((F.size(rest) == 1) if strict else F.lit(True)), first)


def canonical(text: Column, strict: bool = False, strip_exchange: bool = False) -> Column:
    """struct<instrument_type, canonical, underlying, year, month>; null for what is no instrument. strip_exchange also takes
    an exchange's name off futures and indices; year and month of a future are two digits each."""
    whole = normal_symbol(text)
    if strip_exchange:
        rest = _without_exchange(text)
        whole = F.when(F.size(rest) == 1, F.get(rest, F.lit(0))).otherwise(whole)
    year, month = (F.try_to_number(F.nullif(F.regexp_extract(whole, r"^VN30F(\d{2})(\d{2})$", k), F.lit("")), F.lit("99")).cast("int") for k in (1, 2))
    none = F.lit(None).cast("string")
    make = lambda kind, name, under, y=F.lit(None).cast("int"), m=F.lit(None).cast("int"): F.struct(
        F.lit(kind).alias("instrument_type"), name.alias("canonical"), under.alias("underlying"), y.alias("year"), m.alias("month")
    )
    name = stock(text, strict)
    return (
        F.when(whole.isin(*INDICES), make("index", whole, none))
        .when(whole.startswith(FUTURE), F.when(month.between(1, 12), make("future", whole, F.lit("VN30"), year, month)))
        .when(name.isNotNull(), make("stock", name, none))
    )
