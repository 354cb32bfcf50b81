"""Bars and ticks: building, resampling, sessions and point-in-time joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def ticks_to_bars(ticks: DataFrame, length: str = "hour") -> DataFrame:
    """OHLCV by symbol and time bucket from (symbol, ts, seq, price, volume); labels are bar opens.

    One partial aggregation and one shuffle, on (symbol, bucket): no symbol lands in a single task.
    """
    order = F.struct("ts", "seq")
    return ticks.groupBy("symbol", F.date_trunc(length, "ts").alias("time")).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("volume").alias("volume"))


def resample(bars: DataFrame, bar_seconds: int, target_seconds: int) -> DataFrame:
    """Coarser bars, right-closed and right-labelled on the bars' close times; empty bins are absent."""
    if target_seconds <= bar_seconds or target_seconds % bar_seconds:
        raise ValueError("only finer to coarser")
    close_at = F.unix_timestamp("time") + bar_seconds
    label = F.timestamp_seconds(F.ceil(close_at / target_seconds) * target_seconds)
    return bars.groupBy("symbol", label.alias("time")).agg(F.min_by("open", "time").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "time").alias("close"), F.sum("volume").alias("volume"))


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, values: list[str]) -> DataFrame:
    """Each left row with the latest right row at or before its time: a union, sorted once per key, and a running last value.

    Equal times match. Left rows without an earlier right row get nulls. One shuffle on `by`.
    """
    l = left.select("*", F.col(left_time).alias("_t"), F.lit(1).alias("_side"), *(F.lit(None).cast(right.schema[v].dataType).alias(f"_r_{v}") for v in values), F.lit(None).cast("boolean").alias("_has"))
    r = right.select(*[F.col(c) if c in by else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns], F.col(right_time).alias("_t"), F.lit(0).alias("_side"), *(F.col(v).alias(f"_r_{v}") for v in values), F.lit(True).alias("_has"))
    w = W.partitionBy(*by).orderBy("_t", "_side").rowsBetween(W.unboundedPreceding, 0)
    packed = F.last(F.when(F.col("_has"), F.struct(*(F.col(f"_r_{v}").alias(v) for v in values))), ignorenulls=True).over(w)
    return l.unionByName(r).withColumn("_m", packed).where("_side = 1").select(*left.columns, *(F.col("_m")[v].alias(v) for v in values))


def sessions(bars: DataFrame) -> DataFrame:
    """One row per symbol and date."""
    return bars.groupBy("symbol", F.to_date("time").alias("date")).agg(F.min_by("open", "time").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "time").alias("close"))


def with_session_context(bars: DataFrame, trend_lookback: int = 5, vol_window: int = 21) -> DataFrame:
    """Bars with the previous completed session's prices, the gap, and daily trend and volatility, each a session late."""
    w = W.partitionBy("symbol").orderBy("date")
    prev = lambda c, k=1: F.lag(c, k).over(w)
    days = sessions(bars)
    days = days.withColumn("_r", F.when(prev("close") > 0, F.ln(F.try_divide(F.col("close"), F.nullif(prev("close"), F.lit(0.0))))))
    n = w.rowsBetween(-(vol_window - 1), 0)
    days = days.withColumns({"_trend": F.signum(F.try_divide(F.col("close"), F.nullif(prev("close", trend_lookback), F.lit(0.0))) - 1), "_vol": F.when(F.count("_r").over(n) == vol_window, F.stddev_samp("_r").over(n) * 252**0.5)})
    context = days.select("symbol", "date", prev("high").alias("prev_session_high"), prev("low").alias("prev_session_low"), prev("close").alias("prev_session_close"), (F.try_divide(F.col("open"), F.nullif(prev("close"), F.lit(0.0))) - 1).alias("session_gap"), prev("_trend").alias("d1_trend"), prev("_vol").alias("d1_volatility"))
    return bars.withColumn("date", F.to_date("time")).join(context, ["symbol", "date"], "left").drop("date")


def with_opening_range(bars: DataFrame, open_minute: int = 540, minutes: int = 60) -> DataFrame:
    """Bars with the session's opening range, shown only once it is complete."""
    m: Column = F.hour("time") * 60 + F.minute("time") - open_minute
    day = W.partitionBy("symbol", F.to_date("time"))
    inside = (m >= 0) & (m <= minutes)
    show = lambda agg: F.when(m >= minutes, agg)
    return bars.withColumns({"opening_range_high": show(F.max(F.when(inside, F.col("high"))).over(day)), "opening_range_low": show(F.min(F.when(inside, F.col("low"))).over(day))})
