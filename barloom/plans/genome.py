"""Strategies as graphs of nodes, compiled to columns over a bar series.

A graph is a tuple of `Node`s; an input names a node, or "node:port". Every node becomes one or more columns named
`g_<id>` (or `g_<id>__<port>`); nodes that can be window expressions are, and the recursive ones (ema, rsi, atr, macd)
are folds by series. Exogenous nodes read the columns `exog_<symbol>` that an as-of join has attached; session nodes
read the context that `with_session_context` and `with_opening_range` attach once, when a node needs it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import columns as C
from ..operators import bars, folds, holding

MAX_NODES, MAX_DEPTH = 24, 12
REGIME_QUANTILE = 0.6


@dataclass(frozen=True)
class Node:
    id: str
    kind: str
    params: dict[str, Any] = field(default_factory=dict)
    inputs: tuple[str, ...] = ()


@dataclass(frozen=True)
class Kind:
    make: Callable[[Build, Node, list[Column]], dict[str, Column] | Column]
    inputs: tuple[int, int] = (0, 0)
    params: tuple[str, ...] = ()
    boolean: bool = False
    takes_bool: bool | None = None  # None: either


class Build:
    """The frame while nodes are added; a nested window needs its inner value as a column first."""

    def __init__(self, df: DataFrame):
        self.df, self.made, self.context, self.ranges = df, 0, False, set()

    def put(self, x: Column) -> Column:
        self.made += 1
        self.df = self.df.withColumn(name := f"_n{self.made}", x)
        return F.col(name)

    def smooth(self, x: Column, alpha: float, least: int = 0) -> Column:
        return self.smooth_all([(x, alpha, least)])[0]

    def smooth_all(self, means: list[tuple[Column, float, int]]) -> list[Column]:
        """Averages that don't depend on each other, (value, alpha, least rows) each, in one pass."""
        columns = {}
        for x, alpha, least in means:
            self.put(x.cast("double"))
            self.made += 1
            columns[f"_n{self.made}"] = (f"_n{self.made - 1}", alpha, least)
        self.average(columns)
        return [F.col(name) for name in columns]

    def average(self, columns: dict[str, tuple[str, float, int]]) -> None:
        self.df = folds.smoothed(self.df, columns)

    def session(self, name: str) -> Column:
        if not self.context:
            self.df, self.context = bars.with_session_context(self.df), True
        return F.col(name)

    def opening_range(self, side: str, open_minute: int, minutes: int) -> Column:
        if (open_minute, minutes) not in self.ranges:
            self.df = bars.with_opening_range(self.df, open_minute, minutes)
            for x in ("high", "low"):
                self.df = self.df.withColumnRenamed(f"opening_range_{x}", f"_or_{x}_{open_minute}_{minutes}")
            self.ranges.add((open_minute, minutes))
        return F.col(f"_or_{side}_{open_minute}_{minutes}")


class Gathered(Build):
    """Nodes that don't read each other, built together: the averages of one depth, of all nodes, are one pass."""

    def __init__(self, df: DataFrame):
        super().__init__(df)
        self.depth, self.puts, self.averages = 0, [[]], []

    def put(self, x: Column) -> Column:
        self.made += 1
        self.puts[self.depth].append((name := f"_n{self.made}", x))
        return F.col(name)

    def average(self, columns: dict[str, tuple[str, float, int]]) -> None:
        if self.depth == len(self.averages):
            self.averages.append({})
            self.puts.append([])
        self.averages[self.depth] |= columns
        self.depth += 1

    def finish(self) -> DataFrame:
        for depth, puts in enumerate(self.puts):
            for name, x in puts:
                self.df = self.df.withColumn(name, x)
            if depth < len(self.averages):
                self.df = folds.smoothed(self.df, self.averages[depth])
        return self.df


def minute(text: str) -> int:
    h, m = text.split(":")
    if not (h.isdigit() and m.isdigit() and int(h) < 24 and int(m) < 60):
        raise ValueError(f"not HH:MM: {text}")
    return int(h) * 60 + int(m)


def price(name: str) -> Column:
    return F.col(name)


def average(b: Build, x: Column, n: int, how: str) -> Column:
    if how == "ema":
        return b.smooth(x, folds.ema_alpha(n))
    if how == "smma":
        return b.smooth(x, 1 / n)
    if how == "wma":
        return C.wma(x, n)
    if how == "hma":
        half, whole = C.wma(x, max(n // 2, 1)), C.wma(x, n)
        return C.wma(b.put(2 * half - whole), max(int(n**0.5), 1))
    if how == "sma":
        return C.sma(x, n)
    raise ValueError(f"no such average: {how}")


def realised(b: Build, x: Column, n: int) -> Column:
    return C.annualised(C.rolling_std(b.put(C.log_return(x)), n))


def yang_zhang(b: Build, n: int) -> Column:
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    k = 0.34 / (1.34 + (n + 1) / (n - 1))
    night, day = b.put(F.when((o > 0) & (C.lag(c) > 0), F.ln(o / C.lag(c)))), b.put(F.when((o > 0) & (c > 0), F.ln(c / o)))
    rs = b.put(F.when((o > 0) & (h > 0) & (l > 0) & (c > 0), F.ln(h / c) * F.ln(h / o) + F.ln(l / c) * F.ln(l / o)))
    return F.sqrt((C.full(night, n, F.var_samp(night)) + k * C.full(day, n, F.var_samp(day)) + (1 - k) * C.full(rs, n, F.avg(rs))) * C.YEAR)


def volatility(b: Build, n: int, how: str = "close_to_close") -> Column:
    return yang_zhang(b, n) if how == "yang_zhang" else realised(b, price("close"), n)


def atr(b: Build, n: int) -> Column:
    return b.smooth(C.true_range(price("high"), price("low"), price("close")), 1 / n, n)


def rsi(b: Build, x: Column, n: int) -> Column:
    d = b.put(x - C.lag(x))
    up, down = b.smooth_all([(F.when(d.isNotNull(), F.greatest(x, F.lit(0.0))), 1 / n, n) for x in (d, -d)])
    return F.when((down == 0) & (up > 0), 100.0).otherwise(100 - 100 / (1 + C.div(up, down)))


def macd(b: Build, n: Node, ins: list[Column]) -> dict[str, Column]:
    fast, slow = b.smooth_all([(ins[0], folds.ema_alpha(n.params.get(p, d)), 0) for p, d in (("fast_period", 12), ("slow_period", 26))])
    line = b.put(fast - slow)
    signal = b.smooth(line, folds.ema_alpha(n.params.get("signal_period", 9)))
    return {"macd": line, "macd_signal": signal, "macd_histogram": line - signal}


def tsmom(b: Build, n: Node, ins: list[Column]) -> dict[str, Column]:
    """Flips of the momentum's sign between rebalance bars, counted from the series' first bar."""
    every = n.params.get("rebalance_bars", 21)
    mom = b.put(C.momentum(price("close"), n.params.get("lookback_bars", 252)))
    turn = b.put((F.row_number().over(C.series()) - 1) % every == 0)
    sign = b.put(F.when(turn, F.coalesce(F.signum(mom), F.lit(0.0))))
    before = b.put(F.coalesce(F.last(sign, True).over(C.series().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    return {"buy_signal": turn & (sign > 0) & (before <= 0), "sell_signal": turn & (sign < 0) & (before >= 0), "momentum": mom, "volatility": volatility(b, n.params.get("vol_window", 63), n.params.get("vol_estimator", "close_to_close"))}


def trend_blend(b: Build, n: Node, ins: list[Column]) -> dict[str, Column]:
    signs = [F.signum(C.momentum(ins[0], n.params.get(f"lookback_{i}", d))) for i, d in ((1, 21), (2, 63), (3, 252))]
    return {"out": sum(signs[1:], signs[0]) / 3, "volatility": realised(b, ins[0], n.params.get("vol_window", 63))}


def exog(n: Node) -> Column:
    return F.col(f"exog_{n.params['symbol']}")


def exog_vol(b: Build, n: Node, ins: list[Column]) -> Column:
    vol = b.put(realised(b, exog(n), w := n.params.get("vol_window", 21)))
    return C.false_if_null(C.percentile_rank(vol, w) >= REGIME_QUANTILE)


def compared(op: Callable[[Column, Column], Column]) -> Kind:
    return Kind(lambda b, n, i: C.false_if_null(op(i[0], i[1])), (2, 2), boolean=True, takes_bool=False)


def crossing(f: Callable[[Column, Column], Column]) -> Kind:
    def make(b: Build, n: Node, i: list[Column]) -> Column:
        other = i[1] if len(i) > 1 else b.put(F.lit(float(n.params.get("threshold", 0.0)) * (-1 if n.params.get("negate") else 1)))
        return f(i[0], other)

    return Kind(make, (1, 2), ("negate", "threshold"), True, False)


def band(side: str) -> Kind:
    """Against the channel of the current bar: the previous close was within it, this one is outside the band."""

    def make(b: Build, n: Node, i: list[Column]) -> Column:
        close, channel, edge = i
        return C.false_if_null((C.lag(close) <= channel) & (close > edge) if side == "above" else (C.lag(close) >= channel) & (close < edge))

    return Kind(make, (3, 3), boolean=True, takes_bool=False)


def distance(level: str) -> Kind:
    return Kind(lambda b, n, i: C.div(price("close") - b.session(level), atr(b, n.params.get("atr_period", 14))), params=("atr_period",))


def named(kind: str, **columns: Column) -> dict[str, Column]:
    return {f"{kind}_{k}": v for k, v in columns.items()}


def middle_band(b: Build, n: Node, i: list[Column]) -> dict[str, Column]:
    return {"exit_long": C.cross_above(i[0], i[1]), "exit_short": C.cross_below(i[0], i[1])}


def policy(b: Build, n: Node, i: list[Column]) -> dict[str, Column]:
    """No columns: `signals` reads the node where the graph's exits name it."""
    return {}


P = lambda name, default: lambda n: n.params.get(name, default)
period, lookback, window = P("period", 20), P("lookback_bars", 20), P("window", 20)
opens, closes = P("session_open", "09:00"), P("session_close", "18:00")

KINDS: dict[str, Kind] = {
    **{f"source.{x}": Kind(lambda b, n, i, x=x: F.col(x)) for x in ("close", "high", "low", "open", "volume")},
    "source.exog.close": Kind(lambda b, n, i: exog(n), params=("symbol",)),
    "source.exog.return": Kind(lambda b, n, i: C.momentum(exog(n), lookback(n)), params=("lookback_bars", "symbol")),
    "source.exog.return_zscore": Kind(lambda b, n, i: C.zscore(b.put(C.momentum(exog(n), lookback(n))), window(n)), params=("lookback_bars", "symbol", "window")),
    "source.exog.rolling_corr": Kind(lambda b, n, i: C.rolling_corr(b.put(C.momentum(price("close"), lookback(n))), b.put(C.momentum(exog(n), lookback(n))), window(n)), params=("lookback_bars", "symbol", "window")),
    "source.exog.relative_strength": Kind(lambda b, n, i: C.momentum(price("close"), lookback(n)) - C.momentum(exog(n), lookback(n)), params=("lookback_bars", "symbol")),
    "source.exog.vol_regime": Kind(exog_vol, params=("symbol", "vol_window"), boolean=True),
    "source.exog.direction_regime": Kind(lambda b, n, i: C.false_if_null(C.momentum(exog(n), lookback(n)) > 0), params=("lookback_bars", "symbol"), boolean=True),
    "ind.ma": Kind(lambda b, n, i: average(b, i[0], period(n), n.params.get("ma_type", "sma")), (1, 1), ("ma_type", "period")),
    "ind.ema": Kind(lambda b, n, i: average(b, i[0], period(n), "ema"), (1, 1), ("period",)),
    "ind.rsi": Kind(lambda b, n, i: rsi(b, i[0], n.params.get("period", 14)), (1, 1), ("period",)),
    "ind.atr": Kind(lambda b, n, i: atr(b, n.params.get("period", 14)), params=("period",)),
    "ind.macd": Kind(macd, (1, 1), ("fast_period", "signal_period", "slow_period")),
    "ind.bollinger": Kind(lambda b, n, i: named("bb", **C.bollinger(i[0], period(n), n.params.get("num_std", 2.0))), (1, 1), ("num_std", "period")),
    "ind.donchian": Kind(lambda b, n, i: named("donchian", **C.donchian(price("high"), price("low"), period(n))), params=("period",)),
    "ind.momentum": Kind(lambda b, n, i: C.momentum(i[0], lookback(n)), (1, 1), ("lookback_bars",)),
    "ind.realized_vol": Kind(lambda b, n, i: yang_zhang(b, window(n)) if n.params.get("estimator") == "yang_zhang" else realised(b, i[0], window(n)), (1, 1), ("estimator", "window")),
    "ind.diff": Kind(lambda b, n, i: i[0] - i[1], (2, 2)),
    "ind.ratio": Kind(lambda b, n, i: C.ratio(i[0], i[1]), (2, 2)),
    "ind.trb_channel": Kind(lambda b, n, i: {k if "channel" in k else f"trb_{k}": v for k, v in C.trb_channel(i[0], period(n), n.params.get("band_pct", 0.0)).items()}, (1, 1), ("band_pct", "period")),
    "ind.ma_band": Kind(lambda b, n, i: {"ma_band_upper": i[0] * (1 + n.params.get("band_pct", 0.0) / 100), "ma_band_lower": i[0] * (1 - n.params.get("band_pct", 0.0) / 100)}, (1, 1), ("band_pct",)),
    "ind.tsmom": Kind(tsmom, params=("lookback_bars", "rebalance_bars", "vol_estimator", "vol_window")),
    "ind.trend_blend": Kind(trend_blend, (1, 1), ("lookback_1", "lookback_2", "lookback_3", "vol_window")),
    "ind.latent": Kind(lambda b, n, i: F.col(f"latent_{n.params.get('latent_index', 0)}") if f"latent_{n.params.get('latent_index', 0)}" in b.df.columns else F.lit(None).cast("double"), params=("latent_index",)),
    "transform.shift": Kind(lambda b, n, i: C.lag(i[0], n.params.get("bars", 1)), (1, 1), ("bars",)),
    "transform.abs": Kind(lambda b, n, i: F.abs(i[0]), (1, 1)),
    "transform.scale": Kind(lambda b, n, i: i[0] * n.params.get("factor", 1.0), (1, 1), ("factor",)),
    "transform.zscore": Kind(lambda b, n, i: C.zscore(i[0], window(n)), (1, 1), ("window",)),
    "transform.rank": Kind(lambda b, n, i: C.rolling_rank(i[0], window(n)), (1, 1), ("window",)),
    "transform.pct_change": Kind(lambda b, n, i: C.momentum(i[0], n.params.get("change_bars", 1)), (1, 1), ("change_bars",)),
    "transform.clip": Kind(lambda b, n, i: C.clip(i[0], n.params.get("clip_low", -1.0), n.params.get("clip_high", 1.0)), (1, 1), ("clip_high", "clip_low")),
    "feature.minutes_from_open": Kind(lambda b, n, i: C.minutes_from_open(F.col("time"), minute(opens(n))), params=("session_open",)),
    "feature.time_of_day": Kind(lambda b, n, i: C.time_of_day(F.col("time"), minute(opens(n)), minute(closes(n))), params=("session_close", "session_open")),
    "feature.day_of_week": Kind(lambda b, n, i: F.weekday("time")),
    "feature.month_of_year": Kind(lambda b, n, i: F.month("time")),
    "feature.session_window": Kind(lambda b, n, i: C.in_session(F.col("time"), minute(n.params.get("window_from", "09:00")), minute(n.params.get("window_to", "18:00"))), params=("window_from", "window_to"), boolean=True),
    "feature.vol_regime": Kind(lambda b, n, i: C.rolling_rank(b.put(realised(b, i[0], window(n))), n.params.get("regime_lookback", 63)), (1, 1), ("regime_lookback", "window")),
    "feature.trend_regime": Kind(lambda b, n, i: C.div(i[0] - C.sma(i[0], n.params.get("ma_period", 50)), realised(b, i[0], n.params.get("ma_period", 50))), (1, 1), ("ma_period",)),
    "feature.range_compression": Kind(lambda b, n, i: C.rolling_rank(b.put(C.div(price("high") - price("low"), atr(b, 14))), n.params.get("regime_lookback", 63)), (1, 1), ("regime_lookback", "window")),
    **{f"feature.{x}": Kind(lambda b, n, i, x=x: b.session(x)) for x in ("prev_session_high", "prev_session_low", "prev_session_close", "session_gap", "d1_trend", "d1_volatility")},
    **{f"feature.d1_prev_{x}": Kind(lambda b, n, i, x=x: b.session(f"prev_session_{x}")) for x in ("high", "low", "close")},
    **{f"feature.dist_prev_session_{x}_atr": distance(f"prev_session_{x}") for x in ("high", "low", "close")},
    **{f"feature.opening_range_{x}": Kind(lambda b, n, i, x=x: b.opening_range(x, minute(opens(n)), n.params.get("range_minutes", 60)), params=("range_minutes", "session_open")) for x in ("high", "low")},
    "cmp.gt": compared(lambda a, b: a > b),
    "cmp.lt": compared(lambda a, b: a < b),
    "cmp.gte": compared(lambda a, b: a >= b),
    "cmp.lte": compared(lambda a, b: a <= b),
    "cmp.cross_above": crossing(C.cross_above),
    "cmp.cross_below": crossing(C.cross_below),
    "cmp.touch_below": Kind(lambda b, n, i: C.touch_below(i[0], i[1]), (2, 2), boolean=True, takes_bool=False),
    "cmp.touch_above": Kind(lambda b, n, i: C.touch_above(i[0], i[1]), (2, 2), boolean=True, takes_bool=False),
    "cmp.trb_breakout_above": band("above"),
    "cmp.trb_breakout_below": band("below"),
    "logic.and": Kind(lambda b, n, i: C.false_if_null(i[0]) & C.false_if_null(i[1]), (2, 2), boolean=True, takes_bool=True),
    "logic.or": Kind(lambda b, n, i: C.false_if_null(i[0]) | C.false_if_null(i[1]), (2, 2), boolean=True, takes_bool=True),
    "logic.not": Kind(lambda b, n, i: C.negate(i[0]), (1, 1), boolean=True, takes_bool=True),
    "exit.opposite_signal": Kind(policy),
    "exit.middle_band": Kind(middle_band, (2, 2), boolean=True),
    "exit.fixed_holding": Kind(policy, params=("holding_period",)),
    "exit.rebalance": Kind(policy),
}
BOOLEAN_PORTS = {"buy_signal", "sell_signal", "exit_long", "exit_short"}


def ordered(nodes: tuple[Node, ...]) -> list[Node]:
    """Inputs before their users; raises where the graph isn't a valid one."""
    by_id = {n.id: n for n in nodes}
    if len(by_id) != len(nodes) or len(nodes) > MAX_NODES:
        raise ValueError("ids repeat or there are too many nodes")
    depth: dict[str, int] = {}
    open_, out = set(), []

    def visit(name: str) -> int:
        if name in depth:
            return depth[name]
        if name not in by_id or name in open_:
            raise ValueError(f"unknown or cyclic: {name}")
        open_.add(name)
        n = by_id[name]
        kind = KINDS.get(n.kind)
        if kind is None or not kind.inputs[0] <= len(n.inputs) <= kind.inputs[1]:
            raise ValueError(f"unknown kind or wrong number of inputs: {name}")
        if unknown := set(n.params) - set(kind.params):
            raise ValueError(f"unknown parameters of {name}: {sorted(unknown)}")
        if n.kind == "transform.shift" and n.params.get("bars", 1) != 1:
            raise ValueError("a literal shift is one bar")
        depth[name] = 1 + max([visit(i.split(":")[0]) for i in n.inputs], default=0)
        if kind.takes_bool is not None:
            for i in n.inputs:
                source, _, port = i.partition(":")
                if (port in BOOLEAN_PORTS or (not port and KINDS[by_id[source].kind].boolean)) != kind.takes_bool:
                    raise ValueError(f"{name} takes {'boolean' if kind.takes_bool else 'numeric'} inputs")
        if depth[name] > MAX_DEPTH:
            raise ValueError("too deep")
        open_.discard(name)
        out.append(n)
        return depth[name]

    for n in nodes:
        visit(n.id)
    return out


def resolved(nodes: tuple[Node, ...], trial: dict[str, Any]) -> tuple[Node, ...]:
    """References {"param": name, "negate": bool} replaced by the trial's values."""

    def value(v: Any) -> Any:
        if not (isinstance(v, dict) and "param" in v):
            return v
        x = trial[v["param"]] if v["param"] in trial else v["default"]
        return -x if v.get("negate") else x

    return tuple(Node(n.id, n.kind, {k: value(v) for k, v in n.params.items()}, n.inputs) for n in nodes)


def compile_graph(df: DataFrame, nodes: tuple[Node, ...], trial: dict[str, Any] | None = None) -> DataFrame:
    """`df` (symbol, time, open, high, low, close, volume and any context) with every node's columns."""
    build, keep = Build(df), list(df.columns)
    for n in ordered(resolved(nodes, trial or {})):
        ins = [F.col(f"g_{i.replace(':', '__')}") for i in n.inputs]
        made = KINDS[n.kind].make(build, n, ins)
        made = {f"g_{n.id}__{k}": v for k, v in made.items()} if isinstance(made, dict) else {f"g_{n.id}": made}
        if f"g_{n.id}__out" in made:
            made[f"g_{n.id}"] = made.pop(f"g_{n.id}__out")
        if made:
            build.df = build.df.withColumns(made)
            keep += made
    return build.df.select(keep)


def signals(df: DataFrame, nodes: tuple[Node, ...], entry_long: str, entry_short: str, exit_long: str, exit_short: str, trial: dict[str, Any] | None = None) -> DataFrame:
    """`df` with buy, sell, exit_long and exit_short of a graph whose entries and exits are named as "node" or "node:port".

    `exit.opposite_signal` closes where the other side is entered, `exit.middle_band` by its own crosses; `exit.rebalance` never: entries
    turn the position. `exit.fixed_holding` on either side closes both, so many bars after each entry that is taken (`taken` tells
    which). Any other node closes where it is true.
    """
    by_id = {n.id: n for n in resolved(nodes, trial or {})}
    made = compile_graph(df, nodes, trial)
    ref = lambda name: F.col(f"g_{name.replace(':', '__')}")
    out = made.select(*df.columns, *(C.false_if_null(ref(r)).alias(c) for c, r in (("buy", entry_long), ("sell", entry_short))), *(c for c in made.columns if c not in df.columns))
    leave = {}
    for side, name, other in (("exit_long", exit_long, "sell"), ("exit_short", exit_short, "buy")):
        node = by_id[name.split(":")[0]]
        if node.kind == "exit.opposite_signal":
            leave[side] = F.col(other)
        elif node.kind == "exit.rebalance":
            leave[side] = F.lit(False)
        elif node.kind == "exit.middle_band":
            leave[side] = C.false_if_null(ref(f"{node.id}:{side}"))
        elif node.kind != "exit.fixed_holding":
            leave[side] = C.false_if_null(ref(name))
    held = next((by_id[x.split(":")[0]].params.get("holding_period", 10) for x in (exit_long, exit_short) if by_id[x.split(":")[0]].kind == "exit.fixed_holding"), None)
    if held is not None:
        return holding.fixed_holding(out.select(*df.columns, "buy", "sell"), held).select(*df.columns, "buy", "sell", "exit_long", "exit_short", "taken")
    out = out.withColumns(leave)
    return out.select(*df.columns, "buy", "sell", "exit_long", "exit_short")


def activity(df: DataFrame, signals: list[str]) -> DataFrame:
    """Rising edges of each signal by series; a series' first row is none."""
    edges = df.select("symbol", *(C.false_if_null(F.col(s) & ~C.lag(F.col(s))).cast("int").alias(s) for s in signals))
    return edges.groupBy("symbol").agg(*(F.sum(s).alias(s) for s in signals))
