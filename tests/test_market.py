import datetime as dt
import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import bars, folds
from barloom.plans import queries as Q
from barloom.sources import store
from barloom.streaming import live

SF = "/root/testdata/sf0.001"
TABLES = "orders events lineitem"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES.split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query_equals_sql(spark, duck, name):
    got = Q.QUERIES[name](spark, SF)
    want = duck.execute(Q.SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    key = lambda r: tuple("" if x is None else f"{x:.5f}" if isinstance(x, float) else str(x) for x in r)
    near = lambda a, b: a == b or (isinstance(a, float) and isinstance(b, float) and abs(a - b) <= 2e-6 * max(1, abs(a)))
    a, b = sorted(map(tuple, got.select(names).collect()), key=key), sorted(want.fetchall(), key=key)
    assert len(a) == len(b) and all(all(map(near, x, y)) for x, y in zip(a, b, strict=True))


def day(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def test_rsi_and_macd_equal_pandas(spark):
    pdf = Q.hourly(spark, SF).toPandas().sort_values(["symbol", "time"])
    d = pdf.groupby("symbol")["close"].diff()
    mean = lambda x: x.groupby(pdf["symbol"]).transform(lambda v: v.ewm(alpha=1 / 14, adjust=False, min_periods=14).mean())
    g, l = mean(d.clip(lower=0)), mean((-d).clip(lower=0))
    want = pdf.assign(want=(100 - 100 / (1 + g / l)))[["symbol", "time", "want"]]
    got = Q.ind_rsi(spark, SF).toPandas().merge(want, on=["symbol", "time"])
    assert (got["rsi"].isna() == got["want"].isna()).all() and (got["rsi"] - got["want"]).abs().max() < 1e-5


def test_asof_equals_pandas(spark):
    left = pd.DataFrame({"k": ["a"] * 5 + ["b"], "t": [1, 3, 5, 7, 9, 1], "x": range(6)})
    right = pd.DataFrame({"k": ["a", "a", "a"], "u": [3, 6, 6], "y": [1.0, None, 3.0]}).iloc[:2]
    got = bars.asof_join(spark.createDataFrame(left), spark.createDataFrame(right), ["k"], "t", "u", ["y"]).toPandas().sort_values("x")
    want = pd.merge_asof(left.sort_values("t"), right, left_on="t", right_on="u", by="k").sort_values("x")
    assert got["y"].fillna(-1).tolist() == want["y"].fillna(-1).tolist()


def test_backtest_fills_at_the_next_open(spark):
    rows = [("s", day(i), float(100 + i), float(101 + i), float(99 + i), float(100 + i), i == 1, i == 4) for i in range(8)]
    df = spark.createDataFrame(rows, "symbol string, time timestamp, open double, high double, low double, close double, buy boolean, sell boolean")
    trades = folds.backtest(df).collect()
    assert [(t.action, t.entry_price, t.exit_price, t.pnl, t.exit_reason) for t in trades] == [("BUY", 102.0, 105.0, 3.0, "SIGNAL")]
    assert folds.backtest(df, max_bars=1).first().exit_reason == "time_stop"
    assert folds.backtest(df.limit(0)).count() == 0


def test_store_merges_by_key(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    make = lambda days, close: spark.createDataFrame([("S", "D1", day(i), 1.0, 2.0, 0.5, close, 1, None, None) for i in days], "symbol string, timeframe string, time timestamp, open double, high double, low double, close double, tick_volume long, spread int, real_volume long")
    store.write_bars(make(range(360, 370), 1.0), root)
    store.write_bars(make(range(368, 372), 2.0), root)
    got = store.read_bars(spark, root, "S", "D1", day(365), day(371)).collect()
    assert [r.close for r in got] == [1.0] * 3 + [2.0] * 4
    assert store.inventory(spark, root).first().rows == 12


def test_stream_equals_batch(spark, tmp_path):
    ticks = Q.ticks(spark, SF)
    ticks.repartition(3).write.parquet(f"{tmp_path}/ticks")
    stream = live.completed_bars(spark.readStream.schema(ticks.schema).parquet(f"{tmp_path}/ticks"))
    q = stream.writeStream.format("memory").queryName("bars_out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {tuple(r) for r in spark.table("bars_out").collect()}
    want = {tuple(r) for r in Q.hourly(spark, SF).select("symbol", F.col("time").cast("timestamp"), "open", "high", "low", "close", "volume").collect()}
    assert got and got <= want


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert os.path.exists(SF) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
