"""Names, labels and flags as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Labels that mean a bar length; any other label is daily (fixed values).
TIMEFRAMES = {"1M": "M1", "M1": "M1", "5M": "M5", "M5": "M5", "15M": "M15", "M15": "M15", "30M": "M30", "M30": "M30", "1H": "H1", "H1": "H1", "4H": "H4", "H4": "H4", "1D": "D1", "D1": "D1"}
#: Bits of a tick's flags (fixed values).
FLAG_BUY, FLAG_SELL = 32, 64


def timeframe(label: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in TIMEFRAMES.items() for x in pair])
    return F.coalesce(F.element_at(known, F.upper(label)), F.lit("D1"))


def slug(symbol: Column) -> Column:
    """A symbol as a folder name: runs of other characters than letters, digits, `_`, `.`, `$` and `-` become one `_`."""
    return F.regexp_replace(symbol, r"(?U)[^\w.$-]+", "_")


def asset_class(symbol: Column, path: Column) -> Column:
    future = path.contains("BMF") | symbol.contains("@") | symbol.contains("$")
    return F.when(future, "future").when(path.contains("FX") | path.contains("Forex"), "fx").otherwise("equity")


def tick_side(flags: Column) -> Column:
    """buy or sell where exactly one of the two bits is set."""
    buy, sell = flags.bitwiseAND(FLAG_BUY) != 0, flags.bitwiseAND(FLAG_SELL) != 0
    return F.when(buy & ~sell, "buy").when(sell & ~buy, "sell")


def is_trade(last: Column, flags: Column) -> Column:
    return (F.coalesce(last, F.lit(0.0)) > 0) | (F.coalesce(flags, F.lit(0)).bitwiseAND(FLAG_BUY | FLAG_SELL) != 0)


def mid(bid: Column, ask: Column) -> Column:
    return (bid + ask) / 2


def iso(time: Column) -> Column:
    """UTC in whole seconds, with Z."""
    return F.date_format(time.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def iso_millis(time_msc: Column) -> Column:
    """UTC of milliseconds since 1970, with milliseconds and Z."""
    return F.date_format(F.timestamp_millis(time_msc), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def iso_offset(time: Column) -> Column:
    """UTC in whole seconds, with the offset, as fingerprints have it."""
    return F.date_format(time.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
