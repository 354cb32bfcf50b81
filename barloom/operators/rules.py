"""Exit rules, position sizes and the replays that use them: bars, ticks and pairs.

A replay folds one series in time order, so its groups are series, or series and day, window or candidate where these
are independent of each other; such keys make the tasks. Rules look at a trade as if it were long: a short trade sees
negated prices with high and low exchanged.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .folds import TRADES

NAMES = [x.split()[0] for x in TRADES.split(", ")]


def trade_fields() -> list[T.StructField]:
    kinds = {"string": T.StringType(), "double": T.DoubleType(), "timestamp": T.TimestampType()}
    return [T.StructField(n, kinds[k]) for n, k in map(str.split, TRADES.split(", "))]


@dataclass
class Trade:
    side: int
    entry: float  # in the long view
    time: object
    quantity: float
    held: int = 0
    memory: dict = field(default_factory=dict)


@dataclass
class Seen:
    """A bar in a trade's long view."""

    high: float
    low: float
    atr: float
    floor: float  # the previous bars' channel on the losing side


@dataclass(frozen=True)
class Exits:
    """Rules by name; zero switches a rule off. They are asked in this order and the first that fires wins."""

    stop_loss_pct: float = 0.0
    stop_loss_atr: float = 0.0
    take_profit_pct: float = 0.0
    take_profit_atr: float = 0.0
    trailing_stop_pct: float = 0.0
    chandelier_atr_mult: float = 0.0
    breakeven_trigger_pct: float = 0.0
    breakeven_offset_pct: float = 0.0
    psar_af_start: float = 0.0
    psar_af_step: float = 0.02
    psar_af_max: float = 0.2
    target_ratchet_atr: float = 0.0
    max_bars_in_trade: int = 0
    donchian_exit_period: int = 0
    opposite_signal: bool = True

    def rules(self) -> list[tuple[str, Callable[[Trade, Seen], bool]]]:
        all_ = [
            ("fixed_sl", self.stop_loss_pct, lambda t, b: b.low <= t.entry - self.stop_loss_pct * abs(t.entry)),
            ("atr_sl", self.stop_loss_atr, lambda t, b: b.low <= t.entry - self.stop_loss_atr * b.atr),
            ("fixed_tp", self.take_profit_pct, lambda t, b: b.high >= t.entry + self.take_profit_pct * abs(t.entry)),
            ("atr_tp", self.take_profit_atr, lambda t, b: b.high >= t.entry + self.take_profit_atr * b.atr),
            ("trailing", self.trailing_stop_pct, lambda t, b: b.low <= (p := _peak(t, b, "trailing")) - self.trailing_stop_pct * abs(p)),
            ("chandelier", self.chandelier_atr_mult, lambda t, b: b.low <= _peak(t, b, "chandelier") - self.chandelier_atr_mult * b.atr),
            ("breakeven", self.breakeven_trigger_pct, self._breakeven),
            ("psar", self.psar_af_start, self._psar),
            ("profit_target_ratchet", self.target_ratchet_atr, self._ratchet),
            ("time_stop", self.max_bars_in_trade, lambda t, b: t.held >= self.max_bars_in_trade),
            ("donchian_stop", self.donchian_exit_period, lambda t, b: b.low <= b.floor),
        ]
        return [(name, rule) for name, on, rule in all_ if on]

    def _breakeven(self, t: Trade, b: Seen) -> bool:
        armed = t.memory["armed"] = t.memory.get("armed", False) or b.high >= t.entry + self.breakeven_trigger_pct * abs(t.entry)
        return armed and b.low <= t.entry + self.breakeven_offset_pct * abs(t.entry)

    def _psar(self, t: Trade, b: Seen) -> bool:
        sar, best, pace, lows = t.memory.get("psar", (None, 0.0, 0.0, ()))
        if sar is None:
            sar, best, pace = min(t.entry, b.low), max(t.entry, b.high), self.psar_af_start
        else:
            sar = min(sar + pace * (best - sar), *lows)
            if b.high > best:
                best, pace = b.high, min(pace + self.psar_af_step, self.psar_af_max)
        t.memory["psar"] = (sar, best, pace, (*lows[-1:], b.low))
        return b.low <= sar

    def _ratchet(self, t: Trade, b: Seen) -> bool:
        step = self.target_ratchet_atr * b.atr
        if "ratchet" not in t.memory and not b.high >= t.entry + step:
            return False
        t.memory["ratchet"] = level = max(t.memory.get("ratchet", -np.inf), b.high - step)
        return b.low <= level


def _peak(t: Trade, b: Seen, rule: str) -> float:
    t.memory[rule] = top = max(t.memory.get(rule, b.high), b.high)
    return top


#: Named bundles of rules (fixed values); the atr of those that use one is over 14 bars.
PRESETS = {
    "atr_stop_chandelier": Exits(stop_loss_atr=2.0, chandelier_atr_mult=3.0),
    "breakeven_time_stop": Exits(breakeven_trigger_pct=0.02, breakeven_offset_pct=0.001, max_bars_in_trade=50),
    "fixed_pct_bracket": Exits(stop_loss_pct=0.02, take_profit_pct=0.05),
    "parabolic_sar_trail": Exits(psar_af_start=0.02, psar_af_step=0.02, psar_af_max=0.2),
    "donchian_channel_trail": Exits(donchian_exit_period=20),
    "ratchet_target_atr_stop": Exits(target_ratchet_atr=2.0, stop_loss_atr=2.0),
}


# position sizes: (capital, price, volatility, strength) -> quantity
def fixed_quantity(quantity: float, scaled: bool = False) -> Callable[..., float]:
    return lambda capital, price, vol, strength=1.0: float(np.floor(quantity * (strength if scaled else 1.0)))


def safety_margin(margin: float, least: int = 0, most: int = 0) -> Callable[..., float]:
    """Capital over margin, under `most`; `least` holds even if the capital pays for none."""

    def size(capital: float, price: float, vol: float, strength: float = 1.0) -> float:
        n = int(max(capital, 0.0) // margin)
        return float(max(min(n, most) if most > 0 else n, least))

    return size


def inverse_volatility(target_pct: float, point_value: float = 1.0, least: int = 0, most: int = 0) -> Callable[..., float]:
    """A quantity whose annual volatility is `target_pct` percent of the capital; none without a volatility or capital."""

    def size(capital: float, price: float, vol: float, strength: float = 1.0) -> float:
        if not vol or not np.isfinite(vol) or vol <= 0 or price <= 0 or capital <= 0:
            return 0.0
        n = int(np.floor(target_pct / 100 * capital / (vol * price * point_value)))
        return float(max(min(n, most) if most > 0 else n, least))

    return size


@dataclass(frozen=True)
class Costs:
    per_contract: float = 0.0
    bps: float = 0.0

    def side(self, price: float, quantity: float, point_value: float) -> float:
        return quantity * self.per_contract + self.bps / 10_000 * price * quantity * point_value


def replay(
    bars: DataFrame, exits: Exits = Exits(), size: Callable[..., float] | None = None, max_position: float = 1.0, capital: float = 100_000.0,
    costs: Costs = Costs(), point_value: float = 1.0, by: tuple[str, ...] = ("symbol",), day_minutes: tuple[int, int, int] | None = None,
    trade_start: datetime | None = None, force_close: bool = False,
) -> DataFrame:
    """Trades from bars with boolean `buy` and `sell`, and `atr` and `vol` where rules or sizes need them; other keys of `by` come along.

    A closed bar's decision is filled at the next bar's open, exits before entries. An exit closes every open trade of the
    series: by the reason of the first trade whose rule fires, or else by the opposite signal (`exit_long` and `exit_short` where
    the bars have them). Sizes see the volatility and strength of the bar that fills. Open quantity stays within
    `max_position`; the rest of an order is dropped. Realised profit, less both sides' costs, adds to the capital. Bars before
    `trade_start` only warm up. Trades still open at the end are closed at the last close with `force_close` and
    aren't returned without. With `day_minutes` (first entry, last entry, forced close) every day is a group of its own
    that starts with the capital and ends flat.
    """
    size = size or fixed_quantity(1.0)
    keys = [f for f in bars.schema.fields if f.name in by and f.name != "symbol"]
    schema = T.StructType([*keys, *trade_fields()])
    if day_minutes:
        bars, by = bars.withColumn("_date", F.to_date("time")), (*by, "_date")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("time", kind="stable").reset_index(drop=True)
        rules, n = exits.rules(), exits.donchian_exit_period
        low_edge = pdf["low"].rolling(n).min().shift(1) if n else pd.Series(np.nan, pdf.index)
        high_edge = pdf["high"].rolling(n).max().shift(1) if n else pd.Series(np.nan, pdf.index)
        none = pd.Series(np.nan, pdf.index)
        atr, vol = pdf.get("atr", none), pdf.get("vol", none)
        strength = pdf.get("strength", pd.Series(1.0, pdf.index))
        leave = {1: pdf.get("exit_long", pdf["sell"]), -1: pdf.get("exit_short", pdf["buy"])}
        key = [pdf[f.name].iloc[0] for f in keys]
        money, live, leaving, entering, out = capital, [], "", 0, []

        def close(time, price: float, why: str) -> None:
            nonlocal money, live
            for t in live:
                entry = t.entry * t.side
                paid = costs.side(entry, t.quantity, point_value) + costs.side(price, t.quantity, point_value)
                pnl = (price - entry) * t.side * t.quantity * point_value - paid
                money += pnl
                out.append((*key, pdf["symbol"].iloc[0], "BUY" if t.side > 0 else "SELL", t.quantity, t.time, entry, time, price, pnl, why, paid))
            live = []

        def reason(i: int, h: float, l: float) -> str:
            found = []
            for t in live:  # every trade's rules see the bar
                t.held += 1
                seen = Seen(h, l, atr[i], low_edge[i]) if t.side > 0 else Seen(-l, -h, atr[i], -high_edge[i])
                found.append(next((name for name, rule in rules if rule(t, seen)), ""))
            return next(filter(None, found), "") or ("SIGNAL" if exits.opposite_signal and any(leave[t.side][i] for t in live) else "")

        for i, (time, o, h, l, c) in enumerate(zip(pdf["time"], pdf["open"], pdf["high"], pdf["low"], pdf["close"], strict=True)):
            if trade_start is not None and time < pd.Timestamp(trade_start):
                continue
            at = time.hour * 60 + time.minute
            if day_minutes and at >= day_minutes[2]:
                close(time, o, "END_OF_DAY")
                leaving, entering = "", 0
                continue
            if leaving:
                close(time, o, leaving)
            if entering:
                quantity = min(size(money, o, vol[i], strength[i]), max_position - sum(t.quantity for t in live))
                if quantity > 0:
                    live.append(Trade(entering, o * entering, time, quantity))
            leaving, entering = reason(i, h, l), 0
            if not day_minutes or day_minutes[0] <= at <= day_minutes[1]:
                entering = 1 if pdf["buy"][i] else -1 if pdf["sell"][i] else 0
        if day_minutes or force_close:
            close(pdf["time"].iloc[-1], pdf["close"].iloc[-1], "END_OF_DAY" if day_minutes else "FORCE_CLOSE")
        return pd.DataFrame(out, columns=schema.names)

    return bars.groupBy(*by).applyInPandas(run, schema)


def replay_ticks(ticks: DataFrame, size: Callable[..., float] | None = None, capital: float = 100_000.0, point_value: float = 1.0) -> DataFrame:
    """Trades from quotes (symbol, ts, seq, bid, ask, direction, sl_points, tp_points), each day flat at its end.

    Buys fill at the ask and sells at the bid. Stop, then target, then the opposite direction close at the current quote.
    Days are independent, so the groups are symbol and day.
    """
    size = size or fixed_quantity(1.0)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts", "seq"], kind="stable")
        out, side, last = [], 0, len(pdf) - 1
        money = capital
        for i, (ts, bid, ask, way, sl, tp) in enumerate(zip(pdf["ts"], pdf["bid"], pdf["ask"], pdf["direction"], pdf["sl_points"], pdf["tp_points"], strict=True)):
            if not side:
                quantity = size(money, ask, np.nan) if way and i < last else 0.0
                if quantity > 0:
                    side, price, since = int(np.sign(way)), ask if way > 0 else bid, ts
                    stop, goal = sl, tp
                continue
            quote = bid if side > 0 else ask
            gain = (quote - price) * side
            why = "stop_loss" if gain <= -stop else "take_profit" if gain >= goal else "SIGNAL" if way * side < 0 else "END_OF_DAY" if i == last else ""
            if why:
                pnl = gain * quantity * point_value
                money += pnl
                out.append((pdf["symbol"].iloc[0], "BUY" if side > 0 else "SELL", quantity, since, price, ts, quote, pnl, why, 0.0))
                side = 0
        return pd.DataFrame(out, columns=NAMES)

    return ticks.withColumn("_date", F.to_date("ts")).groupBy("symbol", "_date").applyInPandas(run, TRADES)


def pairs_signals(pair: DataFrame, formation: int = 252, trading: int = 126, threshold: float = 2.0) -> DataFrame:
    """Signals on the spread of two price columns, close_a and close_b, in cycles of formation and trading bars.

    Both prices are relative to the cycle's first bar. In the trading part a spread beyond `threshold` population
    deviations of the formation's spread opens against it; a zero cross or the cycle's end closes. Cycles don't depend on
    each other, so each is a group.
    """
    from pyspark.sql.window import Window as W

    k = F.row_number().over(W.partitionBy("symbol").orderBy("time")) - 1
    rows = pair.withColumn("_k", k).withColumn("cycle", F.floor(F.col("_k") / (formation + trading)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_k")
        a, b = pdf["close_a"].to_numpy(), pdf["close_b"].to_numpy()
        spread = (a / a[0] if a[0] > 1e-12 else np.ones(len(a))) - (b / b[0] if b[0] > 1e-12 else np.ones(len(b)))
        buy, sell, leave = (np.zeros(len(a), bool) for _ in range(3))
        edge, side = threshold * spread[:formation].std(), 0
        for i in range(formation, len(a)):
            if side:
                if spread[i] * side >= 0 or i == formation + trading - 1:
                    leave[i], side = True, 0
            elif edge > threshold * 1e-12 and abs(spread[i]) > edge:
                side = -1 if spread[i] > 0 else 1
                (buy if side > 0 else sell)[i] = True
        return pd.DataFrame({"symbol": pdf["symbol"], "time": pdf["time"], "spread": spread, "buy": buy, "sell": sell, "exit": leave})

    return rows.groupBy("symbol", "cycle").applyInPandas(run, "symbol string, time timestamp, spread double, buy boolean, sell boolean, exit boolean")
