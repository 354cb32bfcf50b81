"""Trade analytics, targets and feature scores as aggregations."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import columns as C
from . import scan

DRAWDOWN_FLOOR = 1e-9  # a fixed value


def trade_metrics(trades: DataFrame, by: str = "symbol", capital: float = 100_000.0) -> DataFrame:
    """Counts, pnl, win rate (a zero pnl is a loss), drawdown of the trade-ordered equity, factors, expectancy, averages, streaks.

    A factor without a divisor is 0, the profit factor the gross profit. `commission` is summed where the trades have it.
    """
    t = trades if "commission" in trades.columns else trades.withColumn("commission", F.lit(0.0))
    order = ("exit_time", "trade_id")
    t = scan.chunked(t.select(by, *order, "pnl", "commission"), by, *order)
    w = scan.within(by, *order)
    run = w.rowsBetween(W.unboundedPreceding, 0)
    t = t.withColumns({"win": F.col("pnl") > 0, "_run": F.sum("pnl").over(run)})
    t = t.withColumns({"_top": F.max("_run").over(run), "new": F.when(F.lag("win").over(w) == F.col("win"), 0).otherwise(1)}).withColumn("island", F.sum("new").over(run))
    sums = t.groupBy(by, "_chunk").agg(F.sum("pnl").alias("sum"), F.max("_run").alias("top")).withColumn("_off", F.sum("sum").over(scan.before(by)))
    sums = sums.withColumn("_high", F.max(scan.plus(F.col("_off"), F.col("top"))).over(scan.before(by)))
    streaks = _streaks(t, by)
    t = t.join(F.broadcast(sums.select(by, "_chunk", "_off", "_high")), [by, "_chunk"])  # a row for each chunk
    t = t.withColumns({"equity": F.lit(capital) + scan.plus(F.col("_off"), F.col("_run")), "peak": F.lit(capital) + F.greatest(F.lit(0.0), "_high", scan.plus(F.col("_off"), F.col("_top")))})
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    out = t.groupBy(by).agg(
        F.count(F.lit(1)).alias("total_trades"), F.sum("pnl").alias("total_pnl"), F.sum("commission").alias("total_commission"), F.avg(F.col("win").cast("double")).alias("win_rate"), F.count(F.when(F.col("win"), 1)).alias("winning_trades"), F.count(F.when(~F.col("win"), 1)).alias("losing_trades"),
        F.max(F.col("peak") - F.col("equity")).alias("max_drawdown"), F.max(F.when(F.col("peak") > 0, (F.col("peak") - F.col("equity")) / F.col("peak")).otherwise(0.0)).alias("max_drawdown_pct"), F.avg("pnl").alias("expectancy"),
        zero(F.sum(F.when(F.col("win"), F.col("pnl")))).alias("_won"), zero(F.sum(F.when(~F.col("win"), -F.col("pnl")))).alias("_lost"))
    per = lambda x, n: F.when(n > 0, x / n).otherwise(0.0)
    out = out.withColumns({"profit_factor": F.when(F.col("_lost") > 0, F.col("_won") / F.col("_lost")).otherwise(F.col("_won")), "recovery_factor": per(F.col("total_pnl"), F.col("max_drawdown")), "avg_win": per(F.col("_won"), F.col("winning_trades")), "avg_loss": -per(F.col("_lost"), F.col("losing_trades"))})
    out = out.withColumn("win_loss_ratio", per(F.col("avg_win"), -F.col("avg_loss"))).drop("_won", "_lost")
    return out.join(streaks, by).withColumns({"max_win_streak": F.coalesce("max_win_streak", F.lit(0)), "max_loss_streak": F.coalesce("max_loss_streak", F.lit(0))})


def _streaks(t: DataFrame, by: str) -> DataFrame:
    """Longest runs of wins and of losses, of trades whose islands are numbered within chunks: those at a chunk's ends go on in the next."""
    islands = t.groupBy(by, "_chunk", "island", "win").agg(F.count(F.lit(1)).alias("n"))
    longest = lambda n: (F.max(F.when(F.col("win"), n)).alias("max_win_streak"), F.max(F.when(~F.col("win"), n)).alias("max_loss_streak"))
    piece = F.struct("island", "win", "n")
    chunks = islands.groupBy(by, "_chunk").agg(*longest(F.col("n")), F.min_by(piece, "island").alias("first"), F.max_by(piece, "island").alias("last"))
    ends = chunks.select(by, "_chunk", F.inline(F.array_distinct(F.array("first", "last"))))
    w = W.partitionBy(by).orderBy("_chunk", "island")
    joined = (F.lag("win").over(w) == F.col("win")) & (F.lag("_chunk").over(w) != F.col("_chunk"))
    ends = ends.withColumn("new", F.when(joined, 0).otherwise(1)).withColumn("run", F.sum("new").over(w))
    across = ends.groupBy(by, "run", "win").agg(F.sum("n").alias("n")).groupBy(by).agg(*longest(F.col("n")))
    names = ("max_win_streak", "max_loss_streak")
    return chunks.select(by, *names).unionByName(across).groupBy(by).agg(*(F.max(x).alias(x) for x in names))


def trade_sharpe(trades: DataFrame, days: float, by: str = "symbol", capital: float = 100_000.0) -> DataFrame:
    """Mean over deviation of the trades' returns, times the root of 252 over the `days` of the test; 0 where that isn't defined."""
    ret, dev = F.col("pnl") / capital, F.stddev_samp(F.col("pnl") / capital)
    return trades.groupBy(by).agg(F.when((F.count(F.lit(1)) >= 2) & (dev > 0) & F.lit(days > 0), F.avg(ret) / dev * math.sqrt(252 / days if days > 0 else 0.0)).otherwise(0.0).alias("trade_sharpe_ratio"))


def extended_metrics(trades: DataFrame, daily_sharpe: DataFrame, days: float, by: str = "symbol", capital: float = 100_000.0) -> DataFrame:
    """Trade metrics with total return, return over drawdown, and the Sharpe ratio: of days (`daily_sharpe`) or, without one, of trades."""
    out = trade_metrics(trades, by, capital).join(trade_sharpe(trades, days, by, capital), by).join(daily_sharpe.select(by, F.col("sharpe").alias("_daily")), by, "left")
    total = F.col("total_pnl") / capital if capital > 0 else F.lit(0.0)
    return out.withColumns({"total_return_pct": total, "sharpe_ratio": F.coalesce("_daily", "trade_sharpe_ratio"), "return_drawdown_ratio": total / F.greatest("max_drawdown_pct", F.lit(DRAWDOWN_FLOOR))}).drop("_daily")


def exit_reasons(trades: DataFrame) -> DataFrame:
    reason = F.coalesce(F.nullif(F.trim("exit_reason"), F.lit("")), F.lit("unknown"))
    return trades.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("trades"), F.sum("pnl").alias("pnl"), F.avg((F.col("pnl") > 0).cast("double")).alias("win_rate"))


def information_coefficients(rows: DataFrame, feature: str, target: str, by: str = "symbol") -> DataFrame:
    """Pearson and Spearman (average-tie ranks) correlation of feature and target by key."""
    rows = rows.where(F.col(feature).isNotNull() & F.col(target).isNotNull())

    def rank(c: str):
        return F.rank().over(W.partitionBy(by).orderBy(c)) + (F.count(F.lit(1)).over(W.partitionBy(by, c)) - 1) / 2.0

    ranked = rows.withColumns({"_f": rank(feature), "_t": rank(target)})
    return ranked.groupBy(by).agg(F.count(F.lit(1)).alias("n"), C.correlation(feature, target).alias("ic"), C.correlation("_f", "_t").alias("rank_ic"))


def path_quality(trades: DataFrame, bars: DataFrame, point_value: float = 1.0) -> DataFrame:
    """Excursions of each trade in money over the bars it spans: mfe (0 at least), mae (negative where it hurts), capture, giveback.

    An equi-join on symbol and date (a trade has a row for each of its dates) and then the time range: no cross join.
    A short trade gains as prices fall. Capture is the pnl's share of a positive mfe; giveback what of the mfe the pnl lacks.
    """
    spans = trades.withColumn("date", F.explode(F.sequence(F.to_date("entry_time"), F.to_date("exit_time"))))
    day = bars.select("symbol", F.to_date("time").alias("date"), "time", "high", "low")
    joined = spans.join(day, ["symbol", "date"]).where("time between entry_time and exit_time")
    per = joined.groupBy("symbol", "trade_id", "action", "entry_price", "quantity", "pnl").agg(F.max("high").alias("high"), F.min("low").alias("low"), F.count(F.lit(1)).alias("bars"))
    long, worth = F.col("action") == "BUY", F.col("quantity") * point_value
    up = F.when(long, F.col("high") - F.col("entry_price")).otherwise(F.col("entry_price") - F.col("low"))
    down = F.when(long, F.col("low") - F.col("entry_price")).otherwise(F.col("entry_price") - F.col("high"))
    out = per.withColumns({"mfe": F.greatest(up, F.lit(0.0)) * worth, "mae": down * worth})
    return out.select("symbol", "trade_id", "bars", "pnl", "mfe", "mae", F.when(F.col("mfe") > 0, F.col("pnl") / F.col("mfe")).alias("capture"), F.when(F.col("mfe") > F.col("pnl"), F.col("mfe") - F.col("pnl")).alias("giveback"))


def exit_quality(paths: DataFrame, by: str = "symbol", min_capture: float | None = None, max_giveback_pct: float | None = None) -> DataFrame:
    """Averages of `path_quality`, and the flags of averages that miss their bounds (giveback: a share of a positive total pnl)."""
    out = paths.groupBy(by).agg(F.avg("capture").alias("avg_capture"), F.avg("giveback").alias("avg_giveback"), F.avg("mae").alias("avg_mae"), F.sum("pnl").alias("total_pnl"))
    low = F.when(F.col("avg_capture") < F.lit(min_capture), "low_mfe_capture")
    high = F.when((F.col("total_pnl") > 0) & (F.col("avg_giveback") > F.col("total_pnl") * F.lit(max_giveback_pct)), "high_profit_giveback")
    return out.withColumn("flags", F.concat_ws(",", low, high)).drop("total_pnl")
