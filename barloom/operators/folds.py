"""Recursive averages as affine maps, composed over chunks; and the folds over each symbol's ordered bars.

An exponential mean is a map from its last value to its next, value -> a * value + b, with a and b of one bar. Maps compose
to maps. A chunk of a series (a calendar month) composes its bars by doubling: after the k-th step a row holds the map of the last 2^k
bars, in window expressions over the chunk. The last rows' maps, one row a chunk, are composed in the same way to the value that
each chunk starts with; a bar's value is its map of the chunk's. Weights fall by 1 - alpha a bar, so steps end where what is left is
under the last bit of a double. Tasks are chunks of series; only the rows of a chunk each are ordered by series.

Backtests remain folds: groups are series (or series and day, window or candidate); add such keys to get more tasks.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W
from pyspark.sql.window import WindowSpec

#: the weight that is as good as none
LEAST = 1e-20


def _doubled(df: DataFrame, names: dict[str, float], order: WindowSpec) -> DataFrame:
    """`df` with the maps (name_a, name_b) of single rows replaced by those of all rows up to each, so far as they weigh."""
    bits = {n: 1 if alpha >= 1 else math.ceil(math.log2(max(2.0, math.log(LEAST) / math.log1p(-alpha)))) for n, alpha in names.items()}
    for k in range(max(bits.values(), default=0)):
        made = {}
        for n in (n for n, b in bits.items() if k < b):
            a, b = F.col(f"{n}_a"), F.col(f"{n}_b")
            made[f"{n}_b"] = a * F.coalesce(F.lag(b, 1 << k).over(order), F.lit(0.0)) + b
            made[f"{n}_a"] = a * F.coalesce(F.lag(a, 1 << k).over(order), F.lit(1.0))
        df = df.withColumns(made)
    return df


def smoothed(bars: DataFrame, columns: dict[str, tuple[str, float, int]], by: tuple[str, ...] = ("symbol",), chunk: str = "month") -> DataFrame:
    """Exponential means: name -> (column, alpha, min_periods), started by the first value; null before so many values.

    A null keeps the mean and weighs it less against the next value: after g nulls, (1 - alpha) ^ (g + 1) against alpha.
    NaN is null. Rows of one series and time are taken in any order.
    """
    have, alphas = bars.columns, {f"_{n}": alpha for n, (_, alpha, _) in columns.items()}
    key = [*by, "_chunk"]
    order = W.partitionBy(*key).orderBy("time")
    values = {f"_{n}_x": F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for n, (c, _, _) in columns.items()}
    rows = bars.withColumn("_chunk", F.date_trunc(chunk, "time")).withColumns({"_rn": F.row_number().over(order), **values})

    def share(alpha: float, steps: Column) -> Column:
        """What the mean of so many bars ago weighs against a value."""
        kept = F.pow(F.lit(1 - alpha), steps)
        return kept / (kept + alpha)

    # within a chunk: maps from the mean at its first value on, which is known only once the chunks before are
    maps = {}
    for n, alpha in alphas.items():
        x = F.col(f"{n}_x")
        last = F.last(F.when(x.isNotNull(), F.col("_rn")), True).over(order.rowsBetween(W.unboundedPreceding, -1))
        old = share(alpha, F.col("_rn") - last)
        later = x.isNotNull() & last.isNotNull()
        maps |= {f"{n}_a": F.when(later, old).otherwise(1.0), f"{n}_b": F.when(later, (1 - old) * x).otherwise(0.0)}
    rows = _doubled(rows.withColumns(maps), alphas, order)

    at = lambda n: F.when(F.col(f"{n}_x").isNotNull(), F.col("_rn"))
    chunks = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_rows"), *(f.alias(f"{n}_{c}") for n in alphas for c, f in (("seen", F.count(f"{n}_x")), ("first", F.min(at(n))), ("last", F.max(at(n))), ("x", F.min_by(f"{n}_x", at(n))), ("a", F.max_by(f"{n}_a", "_rn")), ("b", F.max_by(f"{n}_b", "_rn")))))
    line = W.partitionBy(*by).orderBy("_chunk")
    earlier = line.rowsBetween(W.unboundedPreceding, -1)
    chunks = chunks.withColumn("_off", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
    made, ends = {}, {}
    for n, alpha in alphas.items():
        old = F.coalesce(share(alpha, F.col("_off") + F.col(f"{n}_first") - F.max(F.col("_off") + F.col(f"{n}_last")).over(earlier)), F.lit(0.0))  # none: it starts the series
        made |= {f"{n}_before": F.coalesce(F.sum(f"{n}_seen").over(earlier), F.lit(0)), f"{n}_old": old, f"{n}_first_b": (1 - old) * F.col(f"{n}_x")}
        some = F.col(f"{n}_seen") > 0
        ends |= {f"{n}_b": F.when(some, F.col(f"{n}_a") * F.col(f"{n}_first_b") + F.col(f"{n}_b")).otherwise(0.0), f"{n}_a": F.when(some, F.col(f"{n}_a") * F.col(f"{n}_old")).otherwise(1.0)}
    chunks = _doubled(chunks.withColumns(made).withColumns(ends), alphas, line)
    starts = {f"{n}_start": F.when(F.col(f"{n}_before") > 0, F.lag(f"{n}_b").over(line)) for n in alphas}
    chunks = chunks.withColumns(starts).select(*key, *(v.alias(f"{n}_{c}") for n in alphas for c, v in (("start", F.col(f"{n}_start")), ("before", F.col(f"{n}_before")), ("first", F.col(f"{n}_first")), ("mean", F.col(f"{n}_old") * F.coalesce(f"{n}_start", F.lit(0.0)) + F.col(f"{n}_first_b")))))
    rows = rows.join(chunks, key)
    out = []
    for n, (_, _, least) in columns.items():
        seen = F.col(f"_{n}_before") + F.count(f"_{n}_x").over(order.rowsBetween(W.unboundedPreceding, 0))
        mean = F.when(F.col("_rn") >= F.col(f"_{n}_first"), F.col(f"_{n}_a") * F.col(f"_{n}_mean") + F.col(f"_{n}_b")).otherwise(F.col(f"_{n}_start"))
        out.append(F.when(seen >= max(least, 1), mean).alias(n))
    return rows.select(*have, *out)


def ema_alpha(n: int) -> float:
    return 2.0 / (n + 1)


TRADES = "symbol string, action string, quantity double, entry_time timestamp, entry_price double, exit_time timestamp, exit_price double, pnl double, exit_reason string, commission double"


def backtest(bars: DataFrame, quantity: float = 1.0, stop_pct: float | None = None, target_pct: float | None = None, trailing_pct: float | None = None, max_bars: int | None = None, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """One position at a time from bars with boolean `buy` and `sell`; `rules.replay` has all exits, sizes and costs."""
    from .rules import Exits, fixed_quantity, replay

    exits = Exits(stop_loss_pct=stop_pct or 0.0, take_profit_pct=target_pct or 0.0, trailing_stop_pct=trailing_pct or 0.0, max_bars_in_trade=max_bars or 0)
    return replay(bars, exits, fixed_quantity(quantity), max_position=quantity, by=by)


def parabolic_sar(bars: DataFrame, step: float = 0.02, most: float = 0.2) -> DataFrame:
    schema = T.StructType([*bars.schema.fields, T.StructField("sar", T.DoubleType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("time", kind="stable")
        high, low = pdf["high"].to_numpy(), pdf["low"].to_numpy()
        out = np.full(len(pdf), np.nan)
        up, af, ep, sar = True, step, high[0], low[0]
        for i in range(1, len(pdf)):
            sar += af * (ep - sar)
            past = slice(max(0, i - 2), i)
            sar = min(sar, low[past].min()) if up else max(sar, high[past].max())
            if (up and low[i] < sar) or (not up and high[i] > sar):
                up, sar, af = not up, ep, step
                ep = high[i] if up else low[i]
            elif (up and high[i] > ep) or (not up and low[i] < ep):
                ep, af = (high[i] if up else low[i]), min(af + step, most)
            out[i] = sar
        return pdf.assign(sar=out)

    return bars.groupBy("symbol").applyInPandas(run, schema)
