"""The tick store: parquet by symbol and month of the tick's time; of one symbol and millisecond the newest write's last row stays."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .artifacts import _place
from .scratch import kept

TICKS = T.StructType([T.StructField(n, t) for n, t in (("time_msc", T.LongType()), ("bid", T.DoubleType()), ("ask", T.DoubleType()), ("last", T.DoubleType()), ("volume", T.DoubleType()), ("flags", T.IntegerType()), ("symbol", T.StringType()), ("month", T.StringType()))])
KEY = ["symbol", "month", "time_msc"]


def month_of(time_msc) -> F.Column:
    """yyyy-MM, in the session's time zone."""
    return F.date_format(F.timestamp_millis(time_msc), "yyyy-MM")


def _stored(spark: SparkSession, root: str) -> DataFrame | None:
    fs, at = _place(spark, root)
    return spark.read.schema(TICKS).parquet(root) if fs.exists(at) else None


def write_ticks(ticks: DataFrame, root: str, order: list[str] | None = None) -> None:
    """Merge (symbol, time_msc, bid, ask, last, volume, flags) into the store.

    Only the months that `ticks` touches are read and replaced. Of rows of one symbol and millisecond within `ticks` the last by
    `order` stays (by default of all columns), and it replaces the stored one. Rows without symbol or time aren't stored.
    """
    values = [f for f in TICKS.fieldNames() if f not in KEY]
    new = ticks.where("symbol is not null and time_msc is not null").withColumn("month", month_of(F.col("time_msc")))
    new = new.groupBy(*KEY).agg(F.max_by(F.struct(*(F.col(v).cast(TICKS[v].dataType).alias(v) for v in values)), F.struct(*(order or values))).alias("v")).select(*KEY, "v.*")
    new = kept(new)
    old = _stored(new.sparkSession, root)
    if old is not None:
        touched = new.select("symbol", "month").distinct()
        old = old.join(touched, ["symbol", "month"], "left_semi").join(new.select(*KEY), KEY, "left_anti")
        new = kept(new.unionByName(old.select(new.columns)))  # the files that are read are those that are replaced
    rows = new.select(TICKS.fieldNames()).repartition("symbol", "month").sortWithinPartitions("symbol", "month", "time_msc")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("symbol", "month").parquet(root)


def read_ticks(spark: SparkSession, root: str, symbols: list[str], start: datetime, end: datetime) -> DataFrame:
    """Ticks of the symbols from start to end, both included, whole milliseconds; folders of other symbols and months aren't opened."""
    msc = lambda t: F.unix_millis(F.lit(t).cast("timestamp"))
    some = F.col("symbol").isin(symbols) & F.col("month").between(f"{start:%Y-%m}", f"{end:%Y-%m}") & F.col("time_msc").between(msc(start), msc(end))
    stored = _stored(spark, root)
    return (spark.createDataFrame([], TICKS) if stored is None else stored.where(some)).select("symbol", "time_msc", "bid", "ask", "last", "volume", "flags")


def summarize(spark: SparkSession, root: str) -> DataFrame:
    """(symbol, months, rows, first, last) of what is stored."""
    stored = _stored(spark, root)
    at = lambda x: F.timestamp_millis(x)
    rows = spark.createDataFrame([], TICKS) if stored is None else stored
    return rows.groupBy("symbol").agg(F.countDistinct("month").alias("months"), F.count(F.lit(1)).alias("rows"), at(F.min("time_msc")).alias("first"), at(F.max("time_msc")).alias("last"))


def delete_ticks(spark: SparkSession, root: str, symbol: str) -> bool:
    """Whether the symbol was stored."""
    fs, at = _place(spark, f"{root.rstrip('/')}/symbol={symbol}")
    return fs.delete(at, True)
