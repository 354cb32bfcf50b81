"""Odd ticks, and groups that are longer than a task should hold."""

import random
from datetime import datetime, timedelta

import duckdb
from barloom.operators import analytics, ledger, research, scan
from barloom.plans import studies as S
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_tick_bars_skip_missing_values_in_any_session_zone(spark, tmp_path):
    at = datetime(2024, 3, 10, 2, 10)
    rows = [(0, at, "a", None), (1, at, "a", 1.0), (2, at + timedelta(seconds=1), "a", 4.0), (3, at + timedelta(seconds=2), "a", None), (8, None, "a", 5.0), (9, None, "a", 6.0), (4, at, "b", 8.0), (None, at, "b", 7.0), (5, at, "c", None), (6, datetime(1969, 12, 31, 23, 59), "c", 2.0)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = sorted(map(str, db.sql(S.SQL["tick_resample"]).fetchall()))
    for zone in ("UTC", "America/New_York", "Asia/Kolkata"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            assert sorted(str(tuple(r)) for r in S.tick_resample(spark, str(tmp_path)).collect()) == want
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")


def chunk_sizes(df, by, *order):
    return [r["count"] for r in scan.chunked(df, by, *order).groupBy("_chunk").count().collect()]


def test_a_task_holds_one_chunk(spark):
    df = spark.range(6000).select((F.col("id") % 3).cast("string").alias("symbol"), "id")
    t = scan.chunked(df, "symbol", "id", rows=150).withColumn("task", F.spark_partition_id())
    held = [r.n for r in t.groupBy("task").agg(F.countDistinct("_chunk").alias("n")).collect()]
    assert len(held) > 30 and max(held) == 1
    runs = F.sum("id").over(scan.within("symbol", "id"))
    assert t.withColumn("run", runs)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_trade_metrics_are_the_same_over_chunks(spark, monkeypatch):
    monkeypatch.setattr(scan, "ROWS", 20)
    r = random.Random(4)
    rows = [(s, i, datetime(2024, 1, 1) + timedelta(days=i // 50), r.choice([None, 0.0, 3000.0, -5000.0, 7000.0, -2500.0]) if s != "run" else (1.0 if 30 <= i < 190 else -1.0)) for s in ("x", "y", "run") for i in range(220)] + [("nulls", i, datetime(2024, 1, 1), None) for i in range(45)] + [("nulls", 99, datetime(2024, 1, 2), 5.0)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "symbol string, trade_id long, exit_time timestamp, pnl double")
    assert max(chunk_sizes(df, "symbol", "exit_time", "trade_id")) < 100
    got = {x.symbol: x for x in analytics.trade_metrics(df, capital=10_000.0).collect()}
    assert len(got) == 4
    for s, x in got.items():
        pnl = [p for _, _, p in sorted((t, i, p) for k, i, t, p in rows if k == s)]
        equity, peak, worst, share, streak, best, last = 10_000.0, 10_000.0, 0.0, 0.0, 0, {True: 0, False: 0}, None
        for p in pnl:
            equity += p or 0.0
            peak = max(peak, equity)
            worst, share = max(worst, peak - equity), max(share, (peak - equity) / peak)
            win = None if p is None else p > 0
            streak = streak + 1 if win is not None and win == last else 1
            last = win
            if win is not None:
                best[win] = max(best[win], streak)
        assert (x.max_drawdown, x.max_win_streak, x.max_loss_streak) == (worst, best[True], best[False]), s
        assert abs(x.max_drawdown_pct - share) < 1e-12 and x.total_trades == len(pnl) and x.total_pnl == sum(p or 0.0 for p in pnl)


def made_fills(spark):
    r = random.Random(5)
    rows = [(r.choice("ab"), r.choice(["s", "t", "u"]), i, datetime(2024, 1, 1) + timedelta(hours=i // 9), r.choice(["BUY", "SELL"]), float(r.randint(1, 9)), r.randint(100, 900) / 100) for i in range(300)]
    rows += [(*x[:3], x[3] + timedelta(days=90), *x[4:]) for x in rows[:40]]  # repeated fills
    return spark.createDataFrame(rows, "account string, symbol string, fill_id long, time timestamp, side string, quantity double, price double").repartition(5)


def test_balances_are_the_same_over_chunks(spark, monkeypatch):
    monkeypatch.setattr(scan, "ROWS", 25)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)  # a group goes on in the next batch
    try:
        after = ledger.positions(made_fills(spark)).collect()
        entries = ledger.ledger(ledger.positions(made_fills(spark)), F.lit(1000), F.lit(0.5)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(after) == 300 and max(chunk_sizes(spark.createDataFrame(after), "account", "time", "fill_id")) < 100
    balance, want = {}, {}
    for x in sorted(after, key=lambda x: (x.time, x.fill_id)):
        balance[x.account] = want[x.account, x.fill_id] = balance.get(x.account, 1000) + float(x.realised) - 0.5
    assert {(e.account, e.fill_id) for e in entries} == set(want)
    assert all(abs(float(e.balance_after) - want[e.account, e.fill_id]) < 1e-6 for e in entries)


def test_net_positions_are_the_last_ones_without_a_fold(spark):
    last = F.max_by(F.struct("side", "quantity"), F.struct("time", "fill_id"))
    want = ledger.positions(made_fills(spark)).groupBy("account", "symbol").agg(last.alias("p")).select("account", "symbol", "p.*")
    assert sorted(map(tuple, ledger.net(made_fills(spark)).collect())) == sorted(map(tuple, want.collect()))
    plan = S.net_positions(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("InPandas", "InArrow"))


def test_extended_metrics_are_the_same_over_chunks(spark, monkeypatch):
    rows = [("x", i, datetime(2024, 1, 1) + timedelta(days=i // 40), float(i * 7919 % 601 - 300)) for i in range(200)]
    df = spark.createDataFrame(rows, "symbol string, trade_id long, exit_time timestamp, pnl double")
    days = spark.createDataFrame([("x", 1.5)], "symbol string, sharpe double")
    whole = analytics.extended_metrics(df, days, 100.0).first()
    monkeypatch.setattr(scan, "ROWS", 15)
    assert analytics.extended_metrics(df, days, 100.0).first() == whole and max(chunk_sizes(df, "symbol", "exit_time", "trade_id")) < 60


def test_equity_curve_is_the_same_over_chunks(spark, monkeypatch):
    r = random.Random(6)
    rows = [(s, datetime(2024, 1, 1) + timedelta(hours=i // 2), r.choice([None, 5.0, -3.0, 8.0])) for s in ("x", "y", None) for i in range(200)] + [("x", None, 4.0)]
    df = spark.createDataFrame(rows, "symbol string, exit_time timestamp, pnl double").repartition(5)
    start, end = datetime(2023, 12, 31), datetime(2024, 2, 1)
    monkeypatch.setattr(scan, "ROWS", 15)
    curve = research.equity_curve(df, start, end)
    want = {}
    for s in ("x", "y", None):
        equity = 100_000.0
        want[s, start] = equity
        for _, at, pnl in sorted((x for x in rows if x[0] == s and x[1]), key=lambda x: x[1]):
            want[s, at] = equity = equity + (pnl or 0.0)
        want[s, end] = equity
    got = {(x.symbol, x.time): x.equity for x in curve.collect()}
    assert got == want and curve.count() == len(want)
    # the long windows are of chunks, the others have a row for each chunk
    plan = curve._jdf.queryExecution().executedPlan().toString()
    assert all("_chunk" in line or "_at" in line for line in plan.splitlines() if "Window [" in line)
