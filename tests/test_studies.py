import datetime as dt
import importlib

import duckdb
import numpy as np
import pandas as pd
import pytest

from barloom.operators import ledger, research, rules
from barloom.plans import genome
from barloom.plans import queries as Q
from barloom.plans import studies as S
from barloom.plans.genome import Node
from barloom.streaming import live

SF = "/root/testdata/sf0.001"
BARS = "symbol string, time timestamp, open double, high double, low double, close double, volume long"


def hour(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=n)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in "orders events lineitem part customer".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(S.SQL))
def test_query_equals_sql(spark, duck, name):
    got, want = S.QUERIES[name](spark, SF), duck.execute(S.SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    key = lambda r: tuple("" if x is None else f"{x:.4f}" if isinstance(x, float) else str(x) for x in r)
    near = lambda a, b: a == b or (None not in (a, b) and isinstance(a, float) and abs(a - b) <= 2e-6 * max(1, abs(a)))
    a, b = sorted(map(tuple, got.select(names).collect()), key=key), sorted(want.fetchall(), key=key)
    assert len(a) == len(b) > 0 and all(all(map(near, x, y)) for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("name", sorted(set(S.QUERIES) - set(S.SQL)))
def test_query_runs(spark, name):
    """Those that SQL doesn't express: rows come out, one for each key, and none is wholly null."""
    rows = S.QUERIES[name](spark, SF).collect()
    assert rows and all(any(x is not None for x in r) for r in rows)
    if "entry_time" in rows[0]:
        assert all(r.entry_time <= r.exit_time and r.quantity > 0 and r.exit_reason for r in rows)
        profit = lambda r: (r.exit_price - r.entry_price) * (1 if r.action == "BUY" else -1) * r.quantity - r.commission
        assert all(abs(profit(r) - r.pnl) < 1e-6 * max(1, abs(r.pnl)) for r in rows)


def test_ledger_equals_sql(spark, duck):
    want = duck.execute(S.LEDGER_SQL)
    names = [d[0] for d in want.description]
    key = lambda r: (r[0], r[1], r[3])
    a, b = sorted(map(tuple, S.QUERIES["ledger_entries"](spark, SF).select(names).collect()), key=key), sorted(want.fetchall(), key=key)
    assert len(a) == len(b) > 0 and all(x[:4] == y[:4] and abs(x[4] - y[4]) < 1e-3 and abs(x[5] - y[5]) < 1e-2 for x, y in zip(a, b, strict=True))


def test_every_node_kind_compiles(spark):
    rng = np.random.default_rng(1)
    close = 100 + rng.normal(size=120).cumsum()
    rows = [("s", hour(i), c - 0.2, c + 1, c - 1, c, 10) for i, c in enumerate(close.tolist())]
    df = spark.createDataFrame(rows, BARS).selectExpr("*", "close * 2 as exog_X")
    skipped = {"cmp.trb_breakout_above": 3, "cmp.trb_breakout_below": 3}
    assert len(genome.KINDS) == 74
    for kinds in [list(genome.KINDS)[i : i + 18] for i in range(0, 74, 18)]:
        nodes = [Node("c", "source.close"), Node("h", "source.high"), Node("l", "source.low"), Node("b", "cmp.gt", {}, ("c", "l"))]
        for i, k in enumerate(kinds):
            n = skipped.get(k, genome.KINDS[k].inputs[1])
            ins = ("b", "b", "b") if genome.KINDS[k].takes_bool else ("c", "h", "l")
            nodes.append(Node(f"n{i}", k, {"symbol": "X"} if "symbol" in genome.KINDS[k].params else {}, ins[:n]))
        assert genome.compile_graph(df, tuple(nodes)).count() == 120


def test_invalid_graphs_are_refused():
    close = Node("c", "source.close")
    for bad in ((Node("a", "ind.ema", {}, ("b",)), Node("b", "ind.ema", {}, ("a",))), (close, Node("x", "logic.not", {}, ("c",))), (close, Node("x", "ind.ema", {"no": 1}, ("c",))), (Node("x", "no.kind"),), (close, close)):
        with pytest.raises(ValueError):
            genome.ordered(bad)
    assert genome.resolved((Node("x", "transform.scale", {"factor": {"param": "f", "negate": True}}),), {"f": 2})[0].params == {"factor": -2}


def trade(**bars):
    return rules.Trade(1, 100.0, None, 1.0, **bars)


def test_exit_rules():
    seen = lambda h, l, atr=1.0, floor=float("nan"): rules.Seen(h, l, atr, floor)
    only = lambda **k: rules.Exits(**k).rules()[0][1]
    assert only(stop_loss_pct=0.01)(trade(), seen(101, 99)) and not only(stop_loss_pct=0.01)(trade(), seen(101, 99.1))
    assert only(take_profit_atr=2.0)(trade(), seen(102, 100)) and not only(take_profit_atr=2.0)(trade(), seen(101.9, 100))
    t, chandelier = trade(), only(chandelier_atr_mult=2.0)
    assert not chandelier(t, seen(110, 109)) and chandelier(t, seen(109, 108))
    t, even = trade(), only(breakeven_trigger_pct=0.05)
    assert not even(t, seen(106, 101)) and even(t, seen(101, 100))
    t, ratchet = trade(), only(target_ratchet_atr=2.0)
    assert not ratchet(t, seen(101, 90)) and not ratchet(t, seen(105, 104)) and ratchet(t, seen(104, 103))
    assert only(donchian_exit_period=3)(trade(), seen(101, 95, floor=95.0)) and not only(donchian_exit_period=3)(trade(), seen(101, 95))
    t, sar = trade(), only(psar_af_start=0.5)
    assert not sar(t, seen(110, 101)) and sar(t, seen(104, 99.5))
    short = rules.Trade(-1, -100.0, None, 1.0)
    assert only(stop_loss_pct=0.01)(short, seen(-99, -101))


def test_sizes():
    assert rules.safety_margin(30_000)(100_000, 1, 0) == 3 and rules.safety_margin(1e6, least=2)(100_000, 1, 0) == 2 and rules.safety_margin(1000, most=5)(100_000, 1, 0) == 5
    assert rules.inverse_volatility(10.0)(100_000, 50.0, 0.2) == 1000 and rules.inverse_volatility(10.0)(100_000, 50.0, float("nan")) == 0 and rules.inverse_volatility(10.0, least=1)(-1.0, 50.0, 0.2) == 0 and rules.fixed_quantity(2.7)(0, 0, 0) == 2


def test_positions_and_ledger(spark):
    at = lambda i: hour(i)
    rows = [("a", "s", 1, at(0), "BUY", 2.0, 10.0), ("a", "s", 2, at(1), "BUY", 2.0, 20.0), ("a", "s", 3, at(2), "SELL", 1.0, 25.0), ("a", "s", 4, at(3), "SELL", 5.0, 5.0), ("a", "s", 4, at(4), "SELL", 5.0, 5.0), ("a", "s", 5, at(5), "BUY", 2.0, 4.0)]
    got = ledger.positions(spark.createDataFrame(rows, "account string, symbol string, fill_id long, time timestamp, side string, quantity double, price double"))
    out = [(r.side, float(r.quantity), r.entry and float(r.entry), float(r.realised)) for r in got.orderBy("fill_id").collect()]
    assert out == [("LONG", 2.0, 10.0, 0.0), ("LONG", 4.0, 15.0, 0.0), ("LONG", 3.0, 15.0, 10.0), ("SHORT", 2.0, 5.0, -30.0), ("FLAT", 0.0, None, 2.0)]
    from pyspark.sql import functions as F

    balances = {r.fill_id: float(r.balance_after) for r in ledger.ledger(got, F.lit(100), F.lit(1)).collect()}
    assert balances == {1: 99.0, 2: 98.0, 3: 107.0, 4: 76.0, 5: 77.0}


def test_day_trades_end_flat(spark):
    rows = [("s", hour(i), 10.0 + i, 11.0 + i, 9.0 + i, 10.0 + i, 1) for i in range(48)]
    df = spark.createDataFrame(rows, BARS).selectExpr("*", "hour(time) = 9 as buy", "false as sell")
    got = rules.replay(df, day_minutes=(540, 960, 1020)).collect()
    assert sorted((t.entry_time.hour, t.exit_time.hour, t.pnl, t.exit_reason) for t in got) == [(10, 17, 7.0, "END_OF_DAY")] * 2


def test_ticks_fill_at_the_quote(spark):
    cols = "symbol string, ts timestamp, seq long, bid double, ask double, direction int, sl_points double, tp_points double"
    q = lambda bids, ways: spark.createDataFrame([("s", dt.datetime(2024, 1, 1, 0, 0, i), i, b, b + 1, w, 2.0, 5.0) for i, (b, w) in enumerate(zip(bids, ways, strict=True))], cols)
    got = [(t.action, t.entry_price, t.exit_price, t.exit_reason) for t in rules.replay_ticks(q([10.0, 9.5, 8.0, 8.0, 20.0], [1, 0, 0, -1, 0])).orderBy("entry_time").collect()]
    assert got == [("BUY", 11.0, 8.0, "stop_loss"), ("SELL", 8.0, 21.0, "stop_loss")]


def test_pairs_close_at_zero_or_the_cycle_end(spark):
    b = [100.0, 101.0, 99.0, 100.0, 100.0, 90.0, 95.0, 101.0, 100.0, 80.0]
    df = spark.createDataFrame([("p", hour(i), 100.0, x) for i, x in enumerate(b)], "symbol string, time timestamp, close_a double, close_b double")
    got = rules.pairs_signals(df, 4, 6, 2.0).orderBy("time").toPandas()
    assert got["sell"].to_numpy().nonzero()[0].tolist() == [5, 9] and got["exit"].to_numpy().nonzero()[0].tolist() == [7]


def test_expected_max_and_windows():
    assert research.expected_max_sharpe(1) == 0 and abs(research.expected_max_sharpe(10) - 1.5746) < 1e-3
    w = research.split_windows(dt.datetime(2020, 1, 1), dt.datetime(2020, 12, 31), 100, 60)
    assert len(w) == 5 and w[-1]["test_end"] == dt.datetime(2020, 12, 31) and w[1]["train_start"] == dt.datetime(2020, 3, 1)


def test_stream_decisions_equal_batch(spark, tmp_path):
    bars = Q.hourly(spark, SF).select("symbol", "time", "close")
    bars.coalesce(1).write.parquet(f"{tmp_path}/bars")
    stream = live.crossover_decisions(spark.readStream.schema(bars.schema).parquet(f"{tmp_path}/bars"))
    q = stream.writeStream.format("memory").queryName("decided").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.symbol, r.time.replace(tzinfo=None)) for r in spark.table("decided").where("buy").collect()}
    want = {(r.symbol, r.time.replace(tzinfo=None)) for r in Q.ma_crossover_h1(spark, SF).where("buy").collect()} if hasattr(Q, "ma_crossover_h1") else {(r.symbol, r.time) for r in Q.QUERIES["ma_crossover_h1"](spark, SF).where("buy").collect()}
    assert got == want


def test_redundancy_and_pca(spark):
    pdf = pd.DataFrame({"time": [hour(i) for i in range(50)], "a": range(50), "b": [2.0 * i for i in range(50)], "c": [(i * 7919) % 50 for i in range(50)]}).astype({"a": float, "c": float})
    df = spark.createDataFrame(pdf)
    corr = research.correlations(df, ["a", "b", "c"])
    assert research.redundancy(corr, ["a", "b", "c"]) == {"a": "a", "b": "a", "c": "c"}
    model, out = research.pca_encoder(df, ["a", "b", "c"], 2)
    assert out.count() == 50 and sum(model.stages[-1].explainedVariance) > 0.99


def test_correlations_and_latents_are_over_all_symbols(spark):
    bars = Q.daily(spark, SF).toPandas()
    want = {}
    for symbol, g in bars.groupby("symbol"):
        corr = g[["open", "high", "low", "close"]].corr("spearman").abs()
        want |= {(symbol, a, b): corr.loc[a, b] for i, a in enumerate(corr) for b in list(corr)[i + 1 :]}
    got = {(r.symbol, r.a, r.b): r["corr"] for r in S.QUERIES["feature_correlations"](spark, SF).collect()}
    assert set(got) == set(want) and len({k[0] for k in want}) == 5
    assert all(abs(got[k] - want[k]) <= 2e-6 for k in want)
    latents = S.QUERIES["pca_latents"](spark, SF).collect()
    assert sorted((r.symbol, r.time) for r in latents) == sorted(zip(bars["symbol"], bars["time"], strict=True))


def test_entry_has_them():
    assert set(S.QUERIES) <= set(importlib.import_module("__spark_entry__").queries())
