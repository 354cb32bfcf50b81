import datetime as dt

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions import columns as C
from barloom.functions import labels
from barloom.operators import analytics, rules, series
from barloom.plans import desk
from barloom.plans.genome import Build, atr

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in "orders events lineitem part customer supplier".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(desk.SQL))
def test_query_equals_sql(spark, duck, name):
    got, want = desk.QUERIES[name](spark, SF), duck.execute(desk.SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    key = lambda r: tuple("" if x is None else f"{x:.4f}" if isinstance(x, float) else str(x) for x in r)
    near = lambda a, b: a == b or (None not in (a, b) and isinstance(a, float) and abs(a - b) <= 2e-6 * max(1, abs(a)))
    a, b = sorted(map(tuple, got.select(names).collect()), key=key), sorted(want.fetchall(), key=key)
    assert len(a) == len(b) > 0 and all(all(map(near, x, y)) for x, y in zip(a, b, strict=True))


def synthetic_bars(spark):
    """400 hourly bars of a seeded random walk."""
    r = np.random.default_rng(20240609)
    close = 100 + np.cumsum(r.normal(0, 1, 400))
    first = close - r.normal(0, 0.5, 400)
    high, low = np.maximum(first, close) + np.abs(r.normal(0, 0.5, 400)), np.minimum(first, close) - np.abs(r.normal(0, 0.5, 400))
    pdf = pd.DataFrame({"symbol": "s", "time": pd.date_range("2023-01-02", periods=400, freq="h"), "open": first, "high": high, "low": low, "close": close})
    df = spark.createDataFrame(pdf).withColumns({"fast": C.sma(F.col("close"), 5), "slow": C.sma(F.col("close"), 20)})
    df = df.withColumns({"buy": C.cross_above(F.col("fast"), F.col("slow")), "sell": C.cross_below(F.col("fast"), F.col("slow"))})
    b = Build(df)
    value = atr(b, 14)
    return b.df.withColumn("atr", value)


#: Known outcomes of a 5 / 20 crossover on these bars (fixed values): closed trades, pnl, winners, drawdown and its share, profit factor, recovery, win-loss ratio, streaks.
KNOWN = {
    "baseline": (rules.Exits(), None, 1.0, (25, -26.4733585496, 7, 30.6330051642, 0.0003063232, 0.5012509464, -0.8642102989, 1.2889310049, 2, 10)),
    "fixed": (rules.Exits(stop_loss_pct=0.02, take_profit_pct=0.04), None, 1.0, (26, -14.5963165189, 8, 16.8013524264, 0.0001680098, 0.6124183249, -0.8687584278, 1.3779412311, 2, 6)),
    "atr": (rules.Exits(stop_loss_atr=2.0, take_profit_atr=3.0), None, 1.0, (26, -18.5536635738, 8, 21.8631396267, 0.0002186242, 0.5787989553, -0.8486275938, 1.3022976493, 2, 8)),
    "trailing": (rules.Exits(trailing_stop_pct=0.03), None, 1.0, (26, -13.4964887699, 11, 15.7258876542, 0.0001572586, 0.5545657547, -0.8582338286, 0.7562260292, 4, 5)),
    "donchian": (rules.Exits(donchian_exit_period=20), None, 1.0, (25, -23.6215872381, 7, 27.7812338527, 0.0002778061, 0.5297103779, -0.8502713509, 1.3621124002, 2, 10)),
    "time": (rules.Exits(max_bars_in_trade=10), None, 1.0, (26, -25.0627397885, 9, 26.6612674416, 0.0002666127, 0.4573930573, -0.9400430735, 0.8639646638, 2, 5)),
    "margin": (rules.Exits(), rules.safety_margin(5_000.0, 1), 1e9, (25, -507.0820872904, 7, 584.9069632558, 0.0058466396, 0.4992271922, -0.8669448633, 1.2837270656, 2, 10)),
}


@pytest.mark.parametrize("case", sorted(KNOWN))
def test_replays_have_known_outcomes(spark, case):
    exits, size, most, want = KNOWN[case]
    trades = rules.replay(synthetic_bars(spark), exits, size, most).withColumn("trade_id", F.unix_timestamp("entry_time"))
    r = analytics.trade_metrics(trades).first()
    got = (r.total_trades, r.total_pnl, r.winning_trades, r.max_drawdown, r.max_drawdown_pct, r.profit_factor, r.recovery_factor, r.win_loss_ratio, r.max_win_streak, r.max_loss_streak)
    assert np.allclose(got, want, rtol=1e-6, atol=1e-9), (case, got, want)


def replayed(spark, rows, **k):
    bars = [("s", dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), float(o), float(o) + 1, float(o) - 1, float(o), buy, sell, float(vol)) for i, (o, buy, sell, vol) in enumerate(rows)]
    df = spark.createDataFrame(bars, "symbol string, time timestamp, open double, high double, low double, close double, buy boolean, sell boolean, vol double")
    out = rules.replay(df, **k).orderBy("entry_time").collect()
    return [(t.action, t.quantity, t.entry_price, t.exit_price, t.exit_reason) for t in out]


def test_one_exit_closes_all_and_sizes_see_the_filling_bar(spark):
    rows = [(10, True, False, 0), (11, True, False, 0.1), (13, False, False, 0.2), (14, False, True, 0), (15, False, False, 0.5)]
    got = replayed(spark, rows, max_position=3.0)
    assert got == [("BUY", 1.0, 11.0, 15.0, "SIGNAL"), ("BUY", 1.0, 13.0, 15.0, "SIGNAL")]
    assert replayed(spark, rows, max_position=3.0, force_close=True)[2:] == [("SELL", 1.0, 15.0, 15.0, "FORCE_CLOSE")]
    sized = replayed(spark, rows, size=rules.inverse_volatility(10.0), max_position=1e9)
    assert [q for _, q, *_ in sized] == [float(int(10_000 / (0.1 * 11))), float(int(10_000 / (0.2 * 13)))]
    assert replayed(spark, rows, trade_start=dt.datetime(2024, 1, 1, 1), max_position=3.0) == [("BUY", 1.0, 13.0, 15.0, "SIGNAL")]
    assert replayed(spark, rows, exits=rules.Exits(stop_loss_pct=0.01), max_position=3.0)[0][4] == "fixed_sl"


def test_labels(spark):
    df = spark.createDataFrame([("é/x  $y", "WIN$", "BMF\\x", 32, 0.0), ("a.b-c", "EURUSD", "Forex\\y", 96, None), ("@", "@a", "", 64, -1.0), ("", "X", "z", 1, 2.0)], "s string, symbol string, path string, flags int, last double")
    got = df.select(labels.slug(F.col("s")), labels.asset_class(F.col("symbol"), F.col("path")), labels.tick_side(F.col("flags")), labels.is_trade(F.col("last"), F.col("flags"))).collect()
    assert [tuple(r) for r in got] == [("é_x_$y", "future", "buy", True), ("a.b-c", "fx", None, True), ("_", "future", "sell", True), ("", "equity", None, True)]


def test_upsert_and_coverage(spark):
    at = lambda h: dt.datetime(2024, 1, 1, h)
    make = lambda rows: spark.createDataFrame(rows, "symbol string, time timestamp, close double")
    out = series.upsert(make([("s", at(0), 1.0), ("s", at(1), 2.0)]), make([("s", at(1), 3.0), ("t", at(1), 4.0)]), ["symbol", "time"], ["close"])
    assert sorted(map(tuple, out.collect())) == [("s", at(0), 1.0), ("s", at(1), 3.0), ("t", at(1), 4.0)]
    gaps = series.coverage(make([("s", at(h), 0.0) for h in (0, 1, 1, 4, 9)] + [("t", at(2), 0.0)]), 3600)
    assert sorted(map(tuple, gaps.collect())) == [("s", at(2), at(3), 2), ("s", at(5), at(8), 4)]
