"""Forward execution as tables: completed decisions, risk checks, fills folded into positions and an account ledger."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..sources import scratch
from . import scan

MONEY = "decimal(20,8)"
POSITIONS = f"account string, symbol string, fill_id bigint, time timestamp, side string, quantity {MONEY}, entry {MONEY}, realised {MONEY}"


def once(rows: DataFrame, key: list[str], *order: str) -> DataFrame:
    """The first row of each key: a repeated fill or decision has no second effect."""
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("_r = 1").drop("_r")


def risk_rejection(checks: list[tuple[str, Column]]) -> Column:
    """The code of the first check that fails, in this order; null if all hold. A null check fails."""
    out: Column | None = None
    for code, holds in checks:
        fails = ~F.coalesce(holds, F.lit(False))
        out = F.when(fails, code) if out is None else out.when(fails, code)
    return out if out is not None else F.lit(None).cast("string")


def standard_checks(now: Column, limits: dict[str, float]) -> list[tuple[str, Column]]:
    """Over (kill_switch, lifecycle, lease_ok, unknown_orders, bar_close, bid, ask, quote_time, quantity, open_quantity, equity, day_pnl)."""
    c = F.col
    age = lambda t: F.unix_timestamp(now) - F.unix_timestamp(t)
    return [
        ("kill_switch", ~c("kill_switch")), ("lifecycle", c("lifecycle") == "running"), ("lease_lost", c("lease_ok")), ("unknown_prior_order", c("unknown_orders") == 0),
        ("stale_bar", age(c("bar_close")) <= limits["bar_age"]), ("symbol_unavailable", (c("bid") > 0) & (c("ask") >= c("bid"))), ("stale_quote", age(c("quote_time")) <= limits["quote_age"]),
        ("invalid_quantity", (c("quantity") >= limits["min_quantity"]) & (c("quantity") % limits["step"] == 0)), ("notional_limit", c("quantity") * c("ask") <= limits["notional"]),
        ("one_position_violation", c("open_quantity") == 0), ("insufficient_equity", c("equity") > 0), ("daily_loss", c("day_pnl") > -limits["daily_loss"]),
    ]


def positions(fills: DataFrame, point_value: int = 1) -> DataFrame:
    """Each fill (account, symbol, fill_id, time, side, quantity, price) with the position after it and the profit it realised.

    A fill on the position's side adds at the weighted price; one against it closes, and what is left over opens the
    other side. Repeated fill ids count once. Account and symbol are the group; its fills stream through one task in order.
    """

    unit, zero = Decimal("0.00000001"), Decimal(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, entry = None, zero, zero  # held is negative when short
        for batch in batches:
            sides, quantities, entries, realised = [], [], [], []
            for account, symbol, side, quantity, price in zip(*(batch[c].to_pylist() for c in ("account", "symbol", "side", "quantity", "price")), strict=True):
                if key != (account, symbol):
                    key, held, entry = (account, symbol), zero, zero
                change = quantity if side == "BUY" else -quantity
                closed = min(abs(held), abs(change)) if held * change < 0 else zero
                won = closed * (price - entry) * point_value * (1 if held > 0 else -1)
                after = held + change
                if held * after <= 0:
                    entry = price
                elif not closed:
                    entry = ((entry * abs(held) + price * abs(change)) / abs(after)).quantize(unit)
                held = after
                sides.append("LONG" if held > 0 else "SHORT" if held < 0 else "FLAT")
                quantities.append(abs(held))
                entries.append(entry if held else None)
                realised.append(won.quantize(unit))
            made = [pa.array(sides, pa.string()), *(pa.array(x, pa.decimal128(20, 8)) for x in (quantities, entries, realised))]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("account", "symbol", "fill_id", "time")), *made], names=[x.split()[0] for x in POSITIONS.split(", ")])

    dealt = _typed(fills).sortWithinPartitions("account", "symbol", F.asc_nulls_last("time"), F.asc_nulls_last("fill_id"))
    return dealt.select("account", "symbol", "fill_id", "time", "side", "quantity", "price").mapInArrow(run, POSITIONS)


def _typed(fills: DataFrame) -> DataFrame:
    """Each fill once, an account's and symbol's in one partition."""
    dealt = fills.repartition(max(1, -(-fills.count() // scan.ROWS)), "account", "symbol")
    return once(dealt, ["account", "symbol", "fill_id"], "time", "quantity", "price").withColumns({c: F.col(c).cast(MONEY) for c in ("quantity", "price")})


def net(fills: DataFrame) -> DataFrame:
    """(account, symbol, side, quantity): the positions after all fills. What is held is the sum of the changes, so nothing is folded."""
    held = _typed(fills).groupBy("account", "symbol").agg(F.sum(F.when(F.col("side") == "BUY", F.col("quantity")).otherwise(-F.col("quantity"))).alias("_held"))
    side = F.when(F.col("_held") > 0, "LONG").when(F.col("_held") < 0, "SHORT").otherwise("FLAT")
    return held.select("account", "symbol", side.alias("side"), F.abs("_held").cast(MONEY).alias("quantity"))


def ledger(after: DataFrame, start: Column, fee: Column) -> DataFrame:
    """Entries (account, fill_id, kind, amount, balance_after), none of zero; both entries of a fill carry the balance after it."""
    rows = scratch.kept(after.select("account", "fill_id", "time", "realised", start.cast(MONEY).alias("_start"), fee.cast(MONEY).alias("_fee")))
    rows = scan.chunked(rows, "account", "time", "fill_id").withColumn("_net", F.col("realised") - F.col("_fee"))
    sums = rows.groupBy("account", "_chunk").agg(F.sum("_net").alias("_sum")).withColumn("_off", F.sum("_sum").over(scan.before("account")))
    off = F.broadcast(sums.select(F.col("account").alias("_account"), F.col("_chunk").alias("_at"), "_off"))  # a row for each chunk
    run = F.sum("_net").over(scan.within("account", "time", "fill_id").rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("_run", run).join(off, F.col("account").eqNullSafe(F.col("_account")) & (F.col("_chunk") == F.col("_at")))
    rows = rows.withColumn("balance_after", (F.col("_start") + scan.plus(F.col("_off"), F.col("_run"))).cast(MONEY))
    kinds = F.array(F.struct(F.lit("realised_pnl").alias("kind"), F.col("realised").alias("amount")), F.struct(F.lit("fee").alias("kind"), (-F.col("_fee")).cast(MONEY).alias("amount")))
    return rows.select("account", "fill_id", "time", F.inline(kinds), "balance_after").where("amount <> 0")
