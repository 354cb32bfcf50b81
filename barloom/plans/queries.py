"""The market operators on the driver's tables, each with the same thing in SQL.

Ticks are `events` (symbol is the event type, price is value + 1); hourly bars come from them, daily bars from
`orders` (symbol is the priority). Values are rounded to six places on both sides.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import analytics, bars, folds


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), "ts", F.col("event_id").alias("seq"), (F.col("value") + 1).alias("price"), F.lit(1).cast("long").alias("volume"))


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.ticks_to_bars(ticks(spark, sf_dir))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.struct("o_orderkey")
    return read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").alias("time")).agg(
        F.min_by("o_totalprice", order).alias("open"), F.max("o_totalprice").alias("high"), F.min("o_totalprice").alias("low"), F.max_by("o_totalprice", order).alias("close"), F.count(F.lit(1)).alias("volume"))


H1 = """ticks AS (SELECT event_type AS symbol, ts, event_id AS seq, value + 1 AS price FROM events),
bars AS (SELECT symbol, date_trunc('hour', ts) AS time, arg_min(price, (ts, seq)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (ts, seq)) AS close, count(*) AS volume FROM ticks GROUP BY ALL)"""
D1 = """bars AS (SELECT o_orderpriority AS symbol, o_orderdate AS time, arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close, count(*) AS volume FROM orders GROUP BY ALL)"""
W = "(PARTITION BY symbol ORDER BY time)"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def rounded(x: Column) -> Column:
    return F.round(x.cast("double"), 6)


def over(n: int, skip: int = 0) -> str:
    return f"(PARTITION BY symbol ORDER BY time ROWS BETWEEN {n - 1 + skip} PRECEDING AND {f'{skip} PRECEDING' if skip else 'CURRENT ROW'})"


def full(x: str, n: int, agg: str, skip: int = 0) -> str:
    return f"(CASE WHEN count({x}) OVER {over(n, skip)} = {n} THEN {agg} OVER {over(n, skip)} END)"


def lagged(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) OVER {W}"


def series(name: str, columns: Callable[[], dict[str, Column]], sql: dict[str, str], steps: list[tuple[Callable[[], dict[str, Column]], dict[str, str]]] | None = None, base: Callable = daily, flags: bool = False) -> None:
    """Registers columns over bars; `steps` are columns that the later ones read. Columns are made when a session is there."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = base(spark, sf_dir)
        for made, _ in steps or []:
            df = df.withColumns(made())
        return df.select("symbol", "time", *((x if flags else rounded(x)).alias(n) for n, x in columns().items()))

    source, parts = "bars", [D1 if base is daily else H1]
    for i, (_, made) in enumerate(steps or []):
        parts.append(f"s{i} AS (SELECT *, {', '.join(f'{x} AS {n}' for n, x in made.items())} FROM {source})")
        source = f"s{i}"
    values = ", ".join(f"{x} AS {n}" if flags else f"round(CAST({x} AS DOUBLE), 6) AS {n}" for n, x in sql.items())
    QUERIES[name], SQL[name] = query, f"WITH {', '.join(parts)} SELECT symbol, time, {values} FROM {source}"


c = F.col
RET = (lambda: {"r": C.log_return(c("close"))}, {"r": f"CASE WHEN close > 0 AND {lagged('close')} > 0 THEN ln(close / {lagged('close')}) END"})
TR = (lambda: {"tr": C.true_range(c("high"), c("low"), c("close"))}, {"tr": f"greatest(high - low, abs(high - {lagged('close')}), abs(low - {lagged('close')}))"})
MAS = (lambda: {"fast": C.sma(c("close"), 5), "slow": C.sma(c("close"), 20)}, {"fast": full("close", 5, "avg(close)"), "slow": full("close", 20, "avg(close)")})
up, down = "coalesce(fast > slow AND lag(fast) OVER {w} <= lag(slow) OVER {w}, false)".format(w=W), "coalesce(fast < slow AND lag(fast) OVER {w} >= lag(slow) OVER {w}, false)".format(w=W)

series("source_columns", lambda: {x: c(x) for x in ("open", "high", "low", "close", "volume")}, {x: x for x in ("open", "high", "low", "close", "volume")}, base=hourly)
series("ind_diff_ratio", lambda: {"diff": c("high") - c("low"), "ratio": C.ratio(c("high"), c("low"))}, {"diff": "high - low", "ratio": "high / nullif(low, 0) - 1"})
series("transform_abs_scale_clip", lambda: {"a": F.abs(c("close") - c("open")), "s": c("close") * 0.5, "k": C.clip(c("close"), 50_000.0, 200_000.0)}, {"a": "abs(close - open)", "s": "close * 0.5", "k": "least(greatest(close, 50000), 200000)"})
series("transform_shift", lambda: {"v": C.lag(c("close"), 3)}, {"v": lagged("close", 3)})
series("ind_momentum", lambda: {"v": C.momentum(c("close"), 10)}, {"v": f"close / nullif({lagged('close', 10)}, 0) - 1"})
series("ind_sma", lambda: {"v": C.sma(c("close"), 20)}, {"v": full("close", 20, "avg(close)")})
series("ind_wma", lambda: {"v": C.wma(c("close"), 5)}, {"v": f"({lagged('close', 4)} + 2 * {lagged('close', 3)} + 3 * {lagged('close', 2)} + 4 * {lagged('close', 1)} + 5 * close) / 15.0"})
series("ind_hma", lambda: {"v": C.wma(c("d"), 3)}, {"v": f"({lagged('d', 2)} + 2 * {lagged('d', 1)} + 3 * d) / 6.0"}, [(lambda: {"d": 2 * C.wma(c("close"), 4) - C.wma(c("close"), 9)}, {"d": "2 * (" + " + ".join(f"{k} * {lagged('close', 4 - k) if k < 4 else 'close'}" for k in range(1, 5)) + ") / 10.0 - (" + " + ".join(f"{k} * {lagged('close', 9 - k) if k < 9 else 'close'}" for k in range(1, 10)) + ") / 45.0"})])
b = lambda: C.bollinger(c("close"), 20, 2.0)
m, s = full("close", 20, "avg(close)"), full("close", 20, "stddev_samp(close)")
series("ind_bollinger", b, {"middle": m, "upper": f"{m} + 2 * {s}", "lower": f"{m} - 2 * {s}"})
series("ind_donchian", lambda: C.donchian(c("high"), c("low"), 20), {"upper": full("high", 20, "max(high)", 1), "lower": full("low", 20, "min(low)", 1)})
series("ind_trb", lambda: C.trb_channel(c("close"), 20, 1.0), {"channel_high": full("close", 20, "max(close)", 1), "channel_low": full("close", 20, "min(close)", 1), "upper": full("close", 20, "max(close)", 1) + " * 1.01", "lower": full("close", 20, "min(close)", 1) + " * 0.99"})
series("ind_ma_band", lambda: {"upper": C.sma(c("close"), 20) * 1.01, "lower": C.sma(c("close"), 20) * 0.99}, {"upper": f"{m} * 1.01", "lower": f"{m} * 0.99"})
series("transform_zscore", lambda: {"v": C.zscore(c("close"), 20)}, {"v": f"(close - {m}) / nullif({s}, 0)"})
series("transform_rank", lambda: {"v": C.rolling_rank(c("close"), 20)}, {"v": f"CASE WHEN count(close) OVER {over(20)} = 20 THEN len(list_filter(list(close) OVER {over(20)}, lambda x: x <= close)) / 20.0 END"})
series("exog_percentile_rank", lambda: {"v": C.percentile_rank(c("close"), 20)}, {"v": f"CASE WHEN count(close) OVER {over(20)} = 20 THEN (len(list_filter(list(close) OVER {over(20)}, lambda x: x < close)) + (len(list_filter(list(close) OVER {over(20)}, lambda x: x = close)) + 1) / 2.0) / 20.0 END"})
series("ind_realized_vol", lambda: {"v": C.annualised(C.rolling_std(c("r"), 21))}, {"v": full("r", 21, "stddev_samp(r)") + " * sqrt(252)"}, [RET])
series("ind_true_range", lambda: {"v": c("tr")}, {"v": "tr"}, [TR])
k = 0.34 / (1.34 + 22 / 20)
yz = (lambda: {"o": F.when((c("open") > 0) & (C.lag(c("close")) > 0), F.ln(c("open") / C.lag(c("close")))), "oc": F.when((c("open") > 0) & (c("close") > 0), F.ln(c("close") / c("open"))), "rs": F.ln(c("high") / c("close")) * F.ln(c("high") / c("open")) + F.ln(c("low") / c("close")) * F.ln(c("low") / c("open"))},
      {"o": f"ln(open / {lagged('close')})", "oc": "ln(close / open)", "rs": "ln(high / close) * ln(high / open) + ln(low / close) * ln(low / open)"})
series("ind_yang_zhang", lambda: {"v": F.sqrt((C.full(c("o"), 21, F.var_samp("o")) + k * C.full(c("oc"), 21, F.var_samp("oc")) + (1 - k) * C.full(c("rs"), 21, F.avg("rs"))) * 252)}, {"v": f"sqrt(({full('o', 21, 'var_samp(o)')} + {k} * {full('oc', 21, 'var_samp(oc)')} + {1 - k} * {full('rs', 21, 'avg(rs)')}) * 252)"}, [yz])
series("ind_rolling_corr", lambda: {"v": C.rolling_corr(c("close"), c("high"), 20)}, {"v": f"CASE WHEN count(close) OVER {over(20)} = 20 THEN corr(close, high) OVER {over(20)} END"})
sign = lambda n: F.signum(C.momentum(c("close"), n))
sq = lambda n: f"sign(close / nullif({lagged('close', n)}, 0) - 1)"
series("ind_trend_blend", lambda: {"v": (sign(21) + sign(63) + sign(126)) / 3}, {"v": f"({sq(21)} + {sq(63)} + {sq(126)}) / 3.0"})
series("trend_regime", lambda: {"v": C.div(c("close") - C.sma(c("close"), 20), C.annualised(C.rolling_std(c("r"), 21)))}, {"v": f"(close - {m}) / nullif({full('r', 21, 'stddev_samp(r)')} * sqrt(252), 0)"}, [RET])
series("cmp_relations", lambda: {"gt": C.false_if_null(c("close") > C.sma(c("close"), 20)), "lte": C.false_if_null(c("close") <= C.sma(c("close"), 20)), "not_gt": C.negate(c("close") > C.sma(c("close"), 20))}, {"gt": f"coalesce(close > {m}, false)", "lte": f"coalesce(close <= {m}, false)", "not_gt": f"NOT coalesce(close > {m}, false)"}, flags=True)
series("cmp_cross", lambda: {"above": C.cross_above(c("fast"), c("slow")), "below": C.cross_below(c("fast"), c("slow"))}, {"above": up, "below": down}, [MAS], flags=True)
series("ma_crossover_h1", lambda: {"buy": C.cross_above(c("fast"), c("slow")), "sell": C.cross_below(c("fast"), c("slow"))}, {"buy": up, "sell": down}, [MAS], base=hourly, flags=True)
bands = (lambda: {"upper": b()["upper"], "lower": b()["lower"]}, {"upper": f"{m} + 2 * {s}", "lower": f"{m} - 2 * {s}"})
series("cmp_touch", lambda: {"below": C.touch_below(c("close"), c("lower")), "above": C.touch_above(c("close"), c("upper"))}, {"below": f"coalesce({lagged('close')} >= {lagged('lower')} AND close < lower, false)", "above": f"coalesce({lagged('close')} <= {lagged('upper')} AND close > upper, false)"}, [bands], flags=True)
t = lambda: C.trb_channel(c("close"), 20, 0.0)
trb = (lambda: {"ch": t()["channel_high"], "cl": t()["channel_low"]}, {"ch": full("close", 20, "max(close)", 1), "cl": full("close", 20, "min(close)", 1)})
series("cmp_trb_breakout", lambda: {"above": C.false_if_null((C.lag(c("close")) <= c("ch")) & (c("close") > c("ch"))), "below": C.false_if_null((C.lag(c("close")) >= c("cl")) & (c("close") < c("cl")))}, {"above": f"coalesce({lagged('close')} <= ch AND close > ch, false)", "below": f"coalesce({lagged('close')} >= cl AND close < cl, false)"}, [trb], flags=True)
series("time_features", lambda: {"minutes": C.minutes_from_open(c("time"), 540), "tod": C.time_of_day(c("time"), 540, 1080), "dow": F.weekday("time"), "moy": F.month("time"), "inside": C.in_session(c("time"), 600, 900).cast("int")},
       {"minutes": "CASE WHEN hour(time) * 60 + minute(time) >= 540 THEN hour(time) * 60 + minute(time) - 540 END", "tod": "(least(greatest(hour(time) * 60 + minute(time), 540), 1080) - 540) / 540.0", "dow": "isodow(time) - 1", "moy": "month(time)", "inside": "CAST(hour(time) * 60 + minute(time) BETWEEN 600 AND 900 AS INTEGER)"}, base=hourly)
series("forward_targets", lambda: {"fwd": C.forward_return(c("close"), 5), "direction": F.signum(C.forward_return(c("close"), 5)), "fwd_log": F.ln(F.lead(c("close"), 5).over(C.series()) / c("close"))}, {"fwd": f"lead(close, 5) OVER {W} / nullif(close, 0) - 1", "direction": f"sign(lead(close, 5) OVER {W} / nullif(close, 0) - 1)", "fwd_log": f"ln(lead(close, 5) OVER {W} / close)"})


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def ewm_sql(out: str, x: str, alpha: float, source: str = "bars") -> str:
    return f"""x AS (SELECT symbol, list(CAST({x} AS DOUBLE) ORDER BY time) AS xs, list(time ORDER BY time) AS ts FROM {source} GROUP BY symbol),
y AS (SELECT symbol, ts[i] AS time, list_reduce(xs[1:i], lambda a, v: a + {alpha!r} * (v - a)) AS {out} FROM (SELECT *, unnest(generate_series(1, len(xs))) AS i FROM x))"""


@query(f"WITH {H1}, {ewm_sql('ema', 'close', 2 / 21)} SELECT symbol, time, round(ema, 6) AS ema FROM y")
def ind_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.smoothed(hourly(spark, sf_dir), {"ema": ("close", folds.ema_alpha(20), 0)}).select("symbol", "time", rounded(F.col("ema")).alias("ema"))


@query(f"WITH {H1}, {ewm_sql('smma', 'close', 1 / 20)} SELECT symbol, time, round(smma, 6) AS smma FROM y")
def ind_smma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.smoothed(hourly(spark, sf_dir), {"smma": ("close", 1 / 20, 0)}).select("symbol", "time", rounded(F.col("smma")).alias("smma"))


@query(f"WITH {H1}, t AS (SELECT *, {TR[1]['tr']} AS tr FROM bars), {ewm_sql('atr', 'tr', 1 / 14, 't')}, n AS (SELECT *, row_number() OVER {W} AS i FROM y) SELECT symbol, time, round(CASE WHEN i >= 14 THEN atr END, 6) AS atr FROM n")
def ind_atr(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = hourly(spark, sf_dir).withColumns(TR[0]())
    return folds.smoothed(df, {"atr": ("tr", 1 / 14, 14)}).select("symbol", "time", rounded(F.nanvl("atr", F.lit(None).cast("double"))).alias("atr"))


@query(f"""WITH {H1}, d AS (SELECT *, close - {lagged('close')} AS d FROM bars), x AS (SELECT symbol, list(greatest(d, 0) ORDER BY time) AS g, list(greatest(-d, 0) ORDER BY time) AS l, list(time ORDER BY time) AS ts FROM d WHERE d IS NOT NULL GROUP BY symbol),
y AS (SELECT symbol, ts[i] AS time, i, list_reduce(g[1:i], lambda a, v: a + {1 / 14!r} * (v - a)) AS g, list_reduce(l[1:i], lambda a, v: a + {1 / 14!r} * (v - a)) AS l FROM (SELECT *, unnest(generate_series(1, len(g))) AS i FROM x))
SELECT b.symbol, b.time, round(CASE WHEN i >= 14 THEN CASE WHEN l = 0 THEN 100 ELSE 100 - 100 / (1 + g / l) END END, 6) AS rsi FROM bars b LEFT JOIN y USING (symbol, time)""")
def ind_rsi(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("close") - C.lag(F.col("close"))
    df = hourly(spark, sf_dir).withColumns({"gain": F.greatest(d, F.lit(0.0)), "loss": F.greatest(-d, F.lit(0.0))})
    df = df.withColumns({x: F.when(d.isNotNull(), F.col(x)) for x in ("gain", "loss")})
    out = folds.smoothed(df, {"g": ("gain", 1 / 14, 14), "l": ("loss", 1 / 14, 14)})
    g, l = (F.nanvl(x, F.lit(None).cast("double")) for x in ("g", "l"))
    return out.select("symbol", "time", rounded(F.when(l == 0, 100.0).otherwise(100 - 100 / (1 + C.div(g, l)))).alias("rsi"))


@query(f"""WITH {H1}, x AS (SELECT symbol, list(close ORDER BY time) AS xs, list(time ORDER BY time) AS ts FROM bars GROUP BY symbol),
y AS (SELECT symbol, ts[i] AS time, list_reduce(xs[1:i], lambda a, v: a + {2 / 13!r} * (v - a)) - list_reduce(xs[1:i], lambda a, v: a + {2 / 27!r} * (v - a)) AS macd FROM (SELECT *, unnest(generate_series(1, len(xs))) AS i FROM x)),
z AS (SELECT symbol, list(macd ORDER BY time) AS ms, list(time ORDER BY time) AS ts FROM y GROUP BY symbol),
s AS (SELECT symbol, ts[i] AS time, ms[i] AS macd, list_reduce(ms[1:i], lambda a, v: a + {2 / 10!r} * (v - a)) AS signal FROM (SELECT *, unnest(generate_series(1, len(ms))) AS i FROM z))
SELECT symbol, time, round(macd, 6) AS macd, round(signal, 6) AS signal, round(macd - signal, 6) AS histogram FROM s""")
def ind_macd(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = folds.smoothed(hourly(spark, sf_dir), {"f": ("close", folds.ema_alpha(12), 0), "s": ("close", folds.ema_alpha(26), 0)}).withColumn("macd", F.col("f") - F.col("s"))
    df = folds.smoothed(df, {"signal": ("macd", folds.ema_alpha(9), 0)})
    return df.select("symbol", "time", rounded(F.col("macd")).alias("macd"), rounded(F.col("signal")).alias("signal"), rounded(F.col("macd") - F.col("signal")).alias("histogram"))


@query()
def parabolic_sar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.parabolic_sar(daily(spark, sf_dir)).select("symbol", "time", rounded(F.nanvl("sar", F.lit(None).cast("double"))).alias("sar"))


@query(f"WITH {H1}, l AS (SELECT *, to_timestamp(ceil((epoch(time) + 3600) / 14400) * 14400)::TIMESTAMP AS t4 FROM bars) SELECT symbol, t4 AS time, round(arg_min(open, time), 6) AS open, round(max(high), 6) AS high, round(min(low), 6) AS low, round(arg_max(close, time), 6) AS close, CAST(sum(volume) AS BIGINT) AS volume FROM l GROUP BY symbol, t4")
def ohlcv_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bars.resample(hourly(spark, sf_dir), 3600, 14_400)
    return out.select("symbol", "time", *(rounded(F.col(x)).alias(x) for x in ("open", "high", "low", "close")), F.col("volume").cast("long").alias("volume"))


@query(f"WITH {H1}, p AS (SELECT * FROM bars WHERE symbol <> 'view'), x AS (SELECT time + INTERVAL 1 HOUR AS at, close AS exog FROM bars WHERE symbol = 'view') SELECT p.symbol, p.time, round(p.close, 6) AS close, round(x.exog, 6) AS exog_close FROM p ASOF LEFT JOIN x ON p.time >= x.at")
def asof_exogenous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other series with the last completed bar of one exogenous series: that one is broadcast by none, it is dealt to each symbol."""
    df = hourly(spark, sf_dir)
    primary = df.where("symbol <> 'view'").select("symbol", "time", "close")
    symbols = primary.select("symbol").distinct()
    exog = df.where("symbol = 'view'").select((F.col("time") + F.expr("interval 1 hour")).alias("at"), F.col("close").alias("exog_close"), F.lit(1).alias("one"))
    exog = exog.join(symbols.withColumn("one", F.lit(1)), "one").drop("one")
    out = bars.asof_join(primary, exog, ["symbol"], "time", "at", ["exog_close"])
    return out.select("symbol", "time", rounded(F.col("close")).alias("close"), rounded(F.col("exog_close")).alias("exog_close"))


SESSION_SQL = f"""WITH {H1}, d AS (SELECT symbol, CAST(time AS DATE) AS date, arg_min(open, time) AS open, max(high) AS high, min(low) AS low, arg_max(close, time) AS close FROM bars GROUP BY ALL),
w AS (SELECT *, lag(high) OVER q AS ph, lag(low) OVER q AS pl, lag(close) OVER q AS pc, sign(close / nullif(lag(close, 5) OVER q, 0) - 1) AS tr FROM d WINDOW q AS (PARTITION BY symbol ORDER BY date)),
v AS (SELECT *, lag(tr) OVER (PARTITION BY symbol ORDER BY date) AS trend FROM w)
SELECT b.symbol, b.time, round(ph, 6) AS prev_session_high, round(pl, 6) AS prev_session_low, round(pc, 6) AS prev_session_close, round(v.open / nullif(pc, 0) - 1, 6) AS session_gap, round(trend, 6) AS d1_trend FROM bars b LEFT JOIN v ON b.symbol = v.symbol AND CAST(b.time AS DATE) = v.date"""


@query(SESSION_SQL)
def session_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = bars.with_session_context(hourly(spark, sf_dir))
    return df.select("symbol", "time", *(rounded(F.col(x)).alias(x) for x in ("prev_session_high", "prev_session_low", "prev_session_close", "session_gap", "d1_trend")))


@query(f"WITH {H1}, m AS (SELECT *, hour(time) * 60 + minute(time) - 540 AS m FROM bars), r AS (SELECT *, max(CASE WHEN m BETWEEN 0 AND 60 THEN high END) OVER q AS h, min(CASE WHEN m BETWEEN 0 AND 60 THEN low END) OVER q AS l FROM m WINDOW q AS (PARTITION BY symbol, CAST(time AS DATE))) SELECT symbol, time, round(CASE WHEN m >= 60 THEN h END, 6) AS opening_range_high, round(CASE WHEN m >= 60 THEN l END, 6) AS opening_range_low FROM r")
def opening_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = bars.with_opening_range(hourly(spark, sf_dir))
    return df.select("symbol", "time", rounded(F.col("opening_range_high")).alias("opening_range_high"), rounded(F.col("opening_range_low")).alias("opening_range_low"))


def made_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    pnl = F.floor(F.col("l_extendedprice") * F.col("l_discount") - 250 * F.col("l_tax") * F.col("l_quantity")).cast("double")
    return li.select(F.col("l_returnflag").alias("symbol"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("trade_id"), F.col("l_shipdate").alias("exit_time"), pnl.alias("pnl"), F.when(F.col("l_linestatus") == "O", F.lit(" ")).otherwise(F.col("l_linestatus")).alias("exit_reason"))


TRADES = "t AS (SELECT l_returnflag AS symbol, l_orderkey * 10 + l_linenumber AS trade_id, l_shipdate AS exit_time, floor(l_extendedprice * l_discount - 250 * l_tax * l_quantity) AS pnl, CASE WHEN l_linestatus = 'O' THEN ' ' ELSE l_linestatus END AS exit_reason FROM lineitem)"


@query(f"""WITH {TRADES}, e AS (SELECT *, pnl > 0 AS win, 100000 + sum(pnl) OVER w AS equity, CASE WHEN lag(pnl > 0) OVER w = (pnl > 0) THEN 0 ELSE 1 END AS fresh FROM t WINDOW w AS (PARTITION BY symbol ORDER BY exit_time, trade_id)),
p AS (SELECT *, greatest(100000, max(equity) OVER w) AS peak, sum(fresh) OVER w AS island FROM e WINDOW w AS (PARTITION BY symbol ORDER BY exit_time, trade_id)),
s AS (SELECT symbol, island, win, count(*) AS n FROM p GROUP BY ALL), k AS (SELECT symbol, max(CASE WHEN win THEN n END) AS a, max(CASE WHEN NOT win THEN n END) AS b FROM s GROUP BY symbol)
SELECT p.symbol, count(*) AS total_trades, round(sum(pnl), 2) AS total_pnl, 0.0 AS total_commission, round(avg(CAST(win AS INTEGER)), 6) AS win_rate, count(*) FILTER (win) AS winning_trades, count(*) FILTER (NOT win) AS losing_trades, round(max(peak - equity), 2) AS max_drawdown, round(max(CASE WHEN peak > 0 THEN (peak - equity) / peak ELSE 0 END), 6) AS max_drawdown_pct, round(sum(pnl) / max(peak - equity), 6) AS recovery_factor, round(avg(pnl) FILTER (win), 4) AS avg_win, round(avg(pnl) FILTER (NOT win), 4) AS avg_loss, round(avg(pnl) FILTER (win) / -avg(pnl) FILTER (NOT win), 6) AS win_loss_ratio, round(sum(CASE WHEN win THEN pnl END) / sum(CASE WHEN NOT win THEN -pnl END), 6) AS profit_factor, round(avg(pnl), 4) AS expectancy, any_value(coalesce(a, 0)) AS max_win_streak, any_value(coalesce(b, 0)) AS max_loss_streak FROM p JOIN k ON p.symbol = k.symbol GROUP BY p.symbol""")
def trade_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = analytics.trade_metrics(made_trades(spark, sf_dir))
    places = {"total_pnl": 2, "max_drawdown": 2, "expectancy": 4, "avg_win": 4, "avg_loss": 4, "total_commission": 2}
    ratios = ("win_rate", "max_drawdown_pct", "recovery_factor", "win_loss_ratio", "profit_factor")
    return out.select("symbol", "total_trades", "winning_trades", "losing_trades", *(F.round(x, n).alias(x) for x, n in (places | dict.fromkeys(ratios, 6)).items()), "max_win_streak", "max_loss_streak")


@query(f"WITH {TRADES} SELECT coalesce(nullif(trim(exit_reason), ''), 'unknown') AS reason, count(*) AS trades, round(sum(pnl), 2) AS pnl, round(avg(CAST(pnl > 0 AS INTEGER)), 6) AS win_rate FROM t GROUP BY 1")
def exit_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.exit_reasons(made_trades(spark, sf_dir)).select("reason", "trades", F.round("pnl", 2).alias("pnl"), F.round("win_rate", 6).alias("win_rate"))


@query(f"WITH {D1}, f AS (SELECT symbol, close / nullif({lagged('close', 10)}, 0) - 1 AS x, lead(close, 5) OVER {W} / nullif(close, 0) - 1 AS y FROM bars), g AS (SELECT * FROM f WHERE x IS NOT NULL AND y IS NOT NULL), r AS (SELECT *, rank() OVER (PARTITION BY symbol ORDER BY x) + (count(*) OVER (PARTITION BY symbol, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY symbol ORDER BY y) + (count(*) OVER (PARTITION BY symbol, y) - 1) / 2.0 AS ry FROM g) SELECT symbol, count(*) AS n, round(corr(x, y), 6) AS ic, round(corr(rx, ry), 6) AS rank_ic FROM r GROUP BY symbol")
def information_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = daily(spark, sf_dir).select("symbol", C.momentum(F.col("close"), 10).alias("x"), C.forward_return(F.col("close"), 5).alias("y"))
    return analytics.information_coefficients(df, "x", "y").select("symbol", "n", F.round("ic", 6).alias("ic"), F.round("rank_ic", 6).alias("rank_ic"))


@query()
def backtest_ma_crossover(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = daily(spark, sf_dir).withColumns(MAS[0]()).withColumns({"buy": C.cross_above(F.col("fast"), F.col("slow")), "sell": C.cross_below(F.col("fast"), F.col("slow"))})
    return folds.backtest(df, stop_pct=0.5, trailing_pct=0.6, max_bars=40)
