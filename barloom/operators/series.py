"""Stored series: coverage, gap filling, upserts and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def upsert(stored: DataFrame, new: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Rows of both; of one key the new table's last by `order` wins, or else the stored one's. One shuffle by the key."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    last = F.struct("_new", *order)
    values = [x for x in stored.columns if x not in key]
    return both.groupBy(*key).agg(F.max_by(F.struct(*values), last).alias("_v")).select(*key, *(F.col(f"_v.{x}") for x in values)).select(stored.columns)


def coverage(bars: DataFrame, seconds: int, by: str = "symbol") -> DataFrame:
    """(by, gap_start, gap_end, missing): the runs of missing bars between a series' first and last, from neighbours alone."""
    at, step = F.col("time").cast("timestamp"), F.expr(f"interval {seconds} seconds")
    rows = bars.select(by, at.alias("time")).distinct().withColumn("next", F.lead("time").over(W.partitionBy(by).orderBy("time")))
    missing = (F.unix_timestamp("next") - F.unix_timestamp("time")) / seconds - 1
    return rows.withColumn("missing", missing.cast("long")).where("missing > 0").select(by, (F.col("time") + step).alias("gap_start"), (F.col("next") - step).alias("gap_end"), "missing")


def plan_read(stored: DataFrame, requests: DataFrame, by: str = "symbol") -> DataFrame:
    """`requests` (by, start, end, ...) with serve_from (local or provider), head and tail: what the store lacks before and behind what it has.

    The store's first and last bar are its envelope: holes within are no concern of a plan. A series that isn't stored lacks the
    whole request, as its head. A segment that isn't missing is null.
    """
    envelope = stored.groupBy(by).agg(F.min("time").alias("_a"), F.max("time").alias("_z"))
    out = requests.join(envelope, by, "left")
    start, end, a, z = (F.col(x) for x in ("start", "end", "_a", "_z"))
    part = lambda when, s, e: F.when(when, F.struct(s.alias("start"), e.alias("end")))
    head = F.when(a.isNull(), F.struct(start.alias("start"), end.alias("end"))).otherwise(part(start < a, start, a.cast(requests.schema["start"].dataType)))
    local = F.coalesce((a <= start) & (z >= end), F.lit(False))
    return out.select(*requests.columns, F.when(local, "local").otherwise("provider").alias("serve_from"), head.alias("head"), part(end > z, z.cast(requests.schema["end"].dataType), end).alias("tail"))


def gap_filled(local: DataFrame, other: DataFrame, key: list[str]) -> DataFrame:
    """The local rows, and those of the other source whose key the local ones lack."""
    return local.unionByName(other.join(local.select(key), key, "left_anti").select(local.columns))


def last_n(bars: DataFrame, n: int, by: str = "symbol") -> DataFrame:
    """The last n bars of every series; Spark cuts within tasks before it shuffles."""
    return bars.withColumn("_r", F.row_number().over(W.partitionBy(by).orderBy(F.desc("time")))).where(F.col("_r") <= n).drop("_r")


def summary(bars: DataFrame, by: str = "symbol") -> DataFrame:
    return bars.groupBy(by).agg(F.count(F.lit(1)).alias("rows"), F.min("time").alias("first"), F.max("time").alias("last"))
