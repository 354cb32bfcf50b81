"""Column factories for bar series: null-safe scalars, comparators and fixed-frame window indicators.

A missing value is NULL, never NaN. Windowed values are NULL until their frame is full. Comparators are false
where an operand is missing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

YEAR = 252


def series() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("time")


def div(a: Column, b: Column) -> Column:
    return F.try_divide(a, F.nullif(b, F.lit(0.0)))


def frame(n: int, skip: int = 0) -> WindowSpec:
    """The last n rows, or those before the last `skip`."""
    return series().rowsBetween(-(n - 1) - skip, -skip)


def full(x: Column, n: int, agg: Column, skip: int = 0) -> Column:
    return F.when(F.count(x).over(frame(n, skip)) == n, agg.over(frame(n, skip)))


def lag(x: Column, k: int = 1) -> Column:
    return F.lag(x, k).over(series())


def false_if_null(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))


# transforms
def clip(x: Column, low: float, high: float) -> Column:
    if low > high:
        raise ValueError("low is over high")
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def momentum(x: Column, k: int) -> Column:
    return div(x, lag(x, k)) - 1


def ratio(a: Column, b: Column) -> Column:
    return div(a, b) - 1


def minute_of_day(time: Column) -> Column:
    return F.hour(time) * 60 + F.minute(time)


def minutes_from_open(time: Column, open_minute: int) -> Column:
    m = minute_of_day(time) - open_minute
    return F.when(m >= 0, m)


def time_of_day(time: Column, open_minute: int, close_minute: int) -> Column:
    m = F.least(F.greatest(minute_of_day(time), F.lit(open_minute)), F.lit(close_minute))
    return (m - open_minute) / (close_minute - open_minute)


def in_session(time: Column, start: int, end: int) -> Column:
    return minute_of_day(time).between(start, end)


# comparators
def cross_above(a: Column, b: Column) -> Column:
    return false_if_null((a > b) & (lag(a) <= lag(b)))


def cross_below(a: Column, b: Column) -> Column:
    return false_if_null((a < b) & (lag(a) >= lag(b)))


def touch_below(close: Column, band: Column) -> Column:
    return false_if_null((lag(close) >= lag(band)) & (close < band))


def touch_above(close: Column, band: Column) -> Column:
    return false_if_null((lag(close) <= lag(band)) & (close > band))


def negate(x: Column) -> Column:
    return ~false_if_null(x)


# fixed frames
def sma(x: Column, n: int) -> Column:
    return full(x, n, F.avg(x))


def rolling_std(x: Column, n: int) -> Column:
    return full(x, n, F.stddev_samp(x))


def wma(x: Column, n: int) -> Column:
    terms = sum((lag(x, n - k) if k < n else x) * k for k in range(1, n + 1))
    return terms / (n * (n + 1) / 2)


def bollinger(x: Column, n: int, k: float) -> dict[str, Column]:
    mid, dev = sma(x, n), rolling_std(x, n)
    return {"middle": mid, "upper": mid + k * dev, "lower": mid - k * dev}


def donchian(high: Column, low: Column, n: int) -> dict[str, Column]:
    return {"upper": full(high, n, F.max(high), 1), "lower": full(low, n, F.min(low), 1)}


def trb_channel(close: Column, n: int, band_pct: float) -> dict[str, Column]:
    high, low = full(close, n, F.max(close), 1), full(close, n, F.min(close), 1)
    return {"channel_high": high, "channel_low": low, "upper": high * (1 + band_pct / 100), "lower": low * (1 - band_pct / 100)}


def zscore(x: Column, n: int) -> Column:
    return div(x - sma(x, n), rolling_std(x, n))


def rolling_rank(x: Column, n: int) -> Column:
    """Share of the window's values that are at most the current one."""
    values = F.collect_list(x).over(frame(n))
    return F.when(F.count(x).over(frame(n)) == n, F.size(F.filter(values, lambda v: v <= x)) / F.lit(float(n)))


def percentile_rank(x: Column, n: int) -> Column:
    """The same with ties at their average rank."""
    values = F.collect_list(x).over(frame(n))
    under, ties = F.size(F.filter(values, lambda v: v < x)), F.size(F.filter(values, lambda v: v == x))
    return F.when(F.count(x).over(frame(n)) == n, (under + (ties + 1) / 2.0) / F.lit(float(n)))


def log_return(x: Column) -> Column:
    return F.when((x > 0) & (lag(x) > 0), F.ln(x / lag(x)))


def annualised(std: Column) -> Column:
    return std * math.sqrt(YEAR)


def true_range(high: Column, low: Column, close: Column) -> Column:
    before = lag(close)
    return F.greatest(high - low, F.abs(high - before), F.abs(low - before))  # skips nulls: the first bar's own range


def rolling_corr(a: Column, b: Column, n: int) -> Column:
    both = F.when(a.isNotNull() & b.isNotNull(), 1)
    return F.when(F.count(both).over(frame(n)) == n, F.corr(a, b).over(frame(n)))


def forward_return(x: Column, h: int) -> Column:
    return div(F.lead(x, h).over(series()), x) - 1


def correlation(a: Column | str, b: Column | str) -> Column:
    """Pearson's correlation in a group; null, where an aggregate would divide by zero, if either is constant."""
    return F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))
