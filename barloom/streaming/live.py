"""Completed bars from a stream of ticks: watermark, tumbling windows, append once a bar can't change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def completed_bars(ticks: DataFrame, length: str = "1 hour", late: str = "1 hour") -> DataFrame:
    order = F.struct("ts", "seq")
    bars = ticks.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy("symbol", F.window("ts", length).alias("w")).agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("volume").alias("volume"))
    return bars.select("symbol", F.col("w.start").alias("time"), "open", "high", "low", "close", "volume")


DECISIONS = "symbol string, time timestamp, close double, fast double, slow double, buy boolean, sell boolean"


def recovering(stored: DataFrame, live: DataFrame) -> DataFrame:
    """Live bars behind a stream of stored ones, which are replayed: they build up state and decide nothing.

    For a query that starts without a checkpoint. A stored bar that also comes live has been decided on already. The stored
    bars have to be there when the query starts: its first batch takes all of them, in order of time with the live ones.
    """
    columns = ["symbol", "time", "open", "high", "low", "close", "volume"]
    return stored.select(*columns, F.lit(True).alias("replay")).unionByName(live.select(*columns, F.lit(False).alias("replay")))


def crossover_decisions(bars: DataFrame, fast: int = 5, slow: int = 20) -> DataFrame:
    """One decision per completed bar of a stream: moving-average crosses from a bounded window of bars kept as state.

    A bar at or before the series' last evaluated one is late or repeated and gives no second decision. The state is the
    last slow + 1 closes, so its size doesn't depend on how long the stream runs. It comes back from the query's checkpoint, or, with
    bars that `recovering` makes, from stored bars.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    if "replay" not in bars.columns:
        bars = bars.withColumn("replay", F.lit(False))

    def run(key, parts, state):
        import pandas as pd

        last, closes = state.get if state.exists else (None, [])
        closes, out = list(closes), []
        pdf = pd.concat(list(parts)).sort_values(["time", "replay"], ascending=[True, False], kind="stable")
        mean = lambda xs, n: sum(xs[-n:]) / n if len(xs) >= n else None
        for time, close, replay in zip(pdf["time"], pdf["close"], pdf["replay"], strict=True):
            if last is not None and time.value // 1000 <= last:
                continue
            before = mean(closes, fast), mean(closes, slow)
            closes = [*closes, float(close)][-(slow + 1) :]
            now = mean(closes, fast), mean(closes, slow)
            known = None not in (*before, *now)
            if not replay:
                out.append((key[0], time, close, *now, known and now[0] > now[1] and before[0] <= before[1], known and now[0] < now[1] and before[0] >= before[1]))
            last = time.value // 1000
        if last is not None:
            state.update((last, closes))
        yield pd.DataFrame(out, columns=[x.split()[0] for x in DECISIONS.split(", ")])

    return bars.groupBy("symbol").applyInPandasWithState(run, DECISIONS, "last bigint, closes array<double>", "append", GroupStateTimeout.NoTimeout)
