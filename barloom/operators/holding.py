"""Entries that are held for exactly n bars, whatever is signalled meanwhile.

A bar's signal is filled at the next bar's open. From n bars after that on, a close is signalled, and filled at the bar behind it: before
an entry that was signalled with it. So of a series' signals one is taken, and then always the first that is n + 1 or more
bars later: a chain that starts with the first signal. Chains are followed by pointer doubling: each signal knows the one
1, 2, 4, 8, ... entries on, by one join each, and what the first leads to in any number of entries is marked from the longest step
down. Nothing is folded bar by bar, and a series is as many tasks as its signals have partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..sources.scratch import kept

TRADES = ("action", "entry_time", "entry_price", "exit_time", "exit_price", "pnl", "bars")


def _chain(ways: DataFrame, by: list[str]) -> DataFrame:
    """(by, row) of the rows that each series' first row leads to; `ways` has (by, row, to), `to` null at the end."""
    jumps = [ways]
    while not jumps[-1].where("to is not null").isEmpty():
        step = jumps[-1]
        onward = step.select(*by, F.col("row").alias("to"), F.col("to").alias("further"))
        jumps.append(kept(step.where("to is not null").join(onward, [*by, "to"]).select(*by, "row", F.col("further").alias("to"))))
    taken = ways.groupBy(*by).agg(F.min("row").alias("row"))
    for step in reversed(jumps):
        led = taken.join(step.where("to is not null"), [*by, "row"]).select(*by, F.col("to").alias("row"))
        taken = kept(taken.unionByName(led).distinct())
    return taken


def fixed_holding(bars: DataFrame, n: int, by: str = "symbol") -> DataFrame:
    """`bars` (with boolean `buy` and `sell`) with taken, +1 or -1 where an entry is taken, exit_long and exit_short, where its close is signalled.

    With both signals a bar buys. A null signal is none.
    """
    if n < 1:
        raise ValueError("an entry is held for a bar or more")
    order = W.partitionBy(by).orderBy("time")
    side = F.when(F.col("buy"), 1).when(F.col("sell"), -1)
    rows = bars.select(by, "time", side.alias("_side"), F.row_number().over(order).alias("row"))
    # the first signal at a bar or later
    later = F.min(F.when(F.col("_side").isNotNull(), F.col("row"))).over(W.partitionBy(by).orderBy(F.desc("row")).rowsBetween(W.unboundedPreceding, 0))
    ways = kept(rows.withColumn("_next", later).withColumn("to", F.lead("_next", n + 1).over(W.partitionBy(by).orderBy("row"))).where("_side is not null").select(by, "time", "_side", "row", "to"))
    taken = _chain(ways.select(by, "row", "to"), [by])
    entries = ways.join(taken, [by, "row"]).select(by, "time", F.col("_side").alias("taken"))
    out = bars.join(entries, [by, "time"], "left")
    closed = F.lag("taken", n + 1).over(order)
    return out.withColumns({"exit_long": F.coalesce(closed > 0, F.lit(False)), "exit_short": F.coalesce(closed < 0, F.lit(False)), "taken": F.coalesce("taken", F.lit(0))})


def holding_trades(bars: DataFrame, n: int, by: str = "symbol", point_value: float = 1.0) -> DataFrame:
    """(by, action, entry_time, entry_price, exit_time, exit_price, pnl, bars) of the entries taken; one still open at the end isn't a trade."""
    order = W.partitionBy(by).orderBy("time")
    at = lambda c, k: F.lead(c, k).over(order)
    held = fixed_holding(bars, n, by).select(by, "taken", at("time", 1).alias("entry_time"), at("open", 1).alias("entry_price"), at("time", n + 2).alias("exit_time"), at("open", n + 2).alias("exit_price"))
    held = held.where("taken <> 0 and exit_time is not null")
    return held.select(by, F.when(F.col("taken") > 0, "BUY").otherwise("SELL").alias("action"), "entry_time", "entry_price", "exit_time", "exit_price", ((F.col("exit_price") - F.col("entry_price")) * F.col("taken") * point_value).alias("pnl"), F.lit(n + 1).alias("bars"))
