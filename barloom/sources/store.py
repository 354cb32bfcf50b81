"""The parquet market-data store: bars by symbol, timeframe and year; a later row of one key wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

KEY = ["symbol", "timeframe", "time"]
BARS = T.StructType([T.StructField(n, t) for n, t in (("time", T.TimestampType()), ("open", T.DoubleType()), ("high", T.DoubleType()), ("low", T.DoubleType()), ("close", T.DoubleType()), ("tick_volume", T.LongType()), ("spread", T.IntegerType()), ("real_volume", T.LongType()), ("symbol", T.StringType()), ("timeframe", T.StringType()), ("year", T.IntegerType()))])


def latest(old: DataFrame, new: DataFrame) -> DataFrame:
    """Union that keeps the newer row of each key."""
    both = old.withColumn("_age", F.lit(1)).unionByName(new.withColumn("_age", F.lit(0)))
    return both.withColumn("_r", F.row_number().over(W.partitionBy(*KEY).orderBy("_age"))).where("_r = 1").drop("_r", "_age")


def write_bars(bars: DataFrame, root: str) -> None:
    """Merge into the store; only the partitions that `bars` touches are rewritten."""
    spark = bars.sparkSession
    bars = bars.withColumn("year", F.year("time")).select(BARS.fieldNames())
    parts = bars.select("symbol", "timeframe", "year").distinct()
    try:
        old = spark.read.schema(BARS).parquet(root).join(parts, ["symbol", "timeframe", "year"], "left_semi").select(BARS.fieldNames())
        merged = latest(old, bars).checkpoint()  # the files read are the files replaced
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        merged = bars
    merged.repartition("symbol", "timeframe", "year").sortWithinPartitions("time").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("symbol", "timeframe", "year").parquet(root)


def read_bars(spark: SparkSession, root: str, symbol: str, timeframe: str, start, end) -> DataFrame:
    """Inclusive range; whole years outside it aren't opened."""
    c = F.col
    return spark.read.schema(BARS).parquet(root).where((c("symbol") == symbol) & (c("timeframe") == timeframe) & c("year").between(start.year, end.year) & c("time").between(start, end)).orderBy("time")


def inventory(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(BARS).parquet(root).groupBy("symbol", "timeframe").agg(F.count(F.lit(1)).alias("rows"), F.min("time").alias("start"), F.max("time").alias("end"))
