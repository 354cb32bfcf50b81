"""Does a feature read the future? Its value at sampled bars, from all bars and from those up to the bar alone."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .research import numbered


def check(bars: DataFrame, compute: Callable[[DataFrame], DataFrame], features: Sequence[str], cuts: Sequence[int], lookback: int | None = None, rtol: float = 1e-9, atol: float = 1e-9) -> DataFrame:
    """(symbol, time, cut, feature, whole, prefix, leaks): the features of each series' bars number `cuts`, from 0, computed twice.

    `compute` adds columns to bars (symbol, time, ...), series by series, and leaves columns that it doesn't know. Each bar is handed out
    to the cuts that it lies before, by at most `lookback` bars if that is given; a cut's bars are a series of their own, so
    all prefixes are computed in one go and spread like series. A cut behind a series' end has no row. A value leaks if it
    is null in one of the two alone, or differs by more than `atol` + `rtol` of the whole one's size.
    """
    if any(c < 0 for c in cuts):
        raise ValueError("bars are numbered from 0")
    rows = numbered(bars, F.lit(True), "symbol", "_bar").withColumn("_bar", F.col("_bar") - 1)
    cut = F.array(*map(F.lit, sorted(set(cuts))))
    held = F.filter(cut, lambda c: (c >= F.col("_bar")) & (F.lit(True) if lookback is None else c - F.col("_bar") < lookback))
    prefixes = rows.withColumn("_cut", F.explode(held)).withColumn("_series", F.col("symbol")).withColumn("symbol", F.concat_ws("\1", "symbol", "_cut"))
    value = lambda f: F.col(f).cast("double").alias(f)
    part = compute(prefixes).where("_bar = _cut").select(F.col("_series").alias("symbol"), F.col("_cut").alias("cut"), F.struct(*map(value, features)).alias("_part"))
    whole = compute(rows).where(F.col("_bar").isin(*cuts)).select("symbol", "time", F.col("_bar").cast("int").alias("cut"), F.struct(*map(value, features)).alias("_whole"))
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f"_whole.{f}").alias("whole"), F.col(f"_part.{f}").alias("prefix")) for f in features)))
    out = whole.join(part, ["symbol", "cut"]).select("symbol", "time", "cut", each.alias("e")).select("symbol", "time", "cut", "e.*")
    apart = F.abs(F.col("whole") - F.col("prefix")) > atol + rtol * F.abs("whole")
    return out.withColumn("leaks", F.coalesce(apart, F.col("whole").isNull() != F.col("prefix").isNull()))


def status(checked: DataFrame) -> DataFrame:
    """(feature, cuts, leaks, status): suspect if any value leaks, else clean."""
    leaks = F.count(F.when(F.col("leaks"), 1))
    return checked.groupBy("feature").agg(F.count(F.lit(1)).alias("cuts"), leaks.alias("leaks"), F.when(leaks > 0, "suspect").otherwise("clean").alias("status"))
