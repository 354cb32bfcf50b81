"""Operators whose method is their own, against brute force: neighbours, chains of entries, chunked means, merged counts, stores."""

import math
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions import columns as C
from barloom.functions import labels
from barloom.operators import causality, folds, holding, importance, information, research, search, series
from barloom.plans import catalogue, genome
from barloom.plans.genome import Node
from barloom.sources import artifacts
from barloom.sources import ticks as tick_store
from barloom.streaming import live

T0 = datetime(2023, 1, 1)
BARS = "symbol string, time timestamp, open double, high double, low double, close double, volume long"


def made_bars(spark, n=120, seed=42, symbols=("s",), step=1):
    rows = []
    for k, s in enumerate(symbols):
        rng = np.random.default_rng(seed + k)
        close = 100 + rng.normal(size=n).cumsum()
        rows += [(s, T0 + timedelta(hours=i * step), c - 0.2, c + 1.0, c - 1.0, c, 10 + i) for i, c in enumerate(close.tolist())]
    return spark.createDataFrame(rows, BARS)


def psi(m):
    total = 0.0
    while m < 30:
        total -= 1 / m
        m += 1
    return total + math.log(m) - 1 / (2 * m) - 1 / (12 * m**2) + 1 / (120 * m**4) - 1 / (252 * m**6)


def brute_information(x, y, k=3):
    x, y = x / (x.std() or 1), y / (y.std() or 1)
    dx, dy = np.abs(x[:, None] - x), np.abs(y[:, None] - y)
    r = np.sort(np.maximum(dx, dy), axis=1)[:, k][:, None]
    a, b = (((d < r) | (d == 0)).sum(axis=1) - 1 for d in (dx, dy))
    return max(0.0, psi(len(x)) + psi(k) - np.mean([psi(i + 1) + psi(j + 1) for i, j in zip(a, b, strict=True)]))


@pytest.mark.parametrize("slab", [20_000, 11])
def test_mutual_information(spark, monkeypatch, slab):
    """One slab and many, ties, constants, groups that are too small, nulls and NaN."""
    monkeypatch.setattr(information, "SLAB", slab)
    rng = np.random.default_rng(1)
    x = rng.normal(size=250)
    groups = {"gauss": (x, 0.7 * x + rng.normal(size=250)), "same": (x, x), "ties": (np.floor(x * 2), np.floor(x * 2 + rng.normal(size=250))), "const": (np.ones(30), x[:30]), "few": (x[:3], x[:3]), "far": (np.r_[np.zeros(80), x[:50] * 1e6], x[:130])}
    rows = [(g, float(a), float(b)) for g, (xs, ys) in groups.items() for a, b in zip(xs, ys, strict=True)] + [("gauss", None, 1.0), ("gauss", float("nan"), 2.0)]
    got = {r.g: r for r in information.mutual_information(spark.createDataFrame(rows, "g string, x double, y double"), "x", "y", ["g"]).collect()}
    for g, (xs, ys) in groups.items():
        assert got[g].n == len(xs)
        assert got[g].mutual_info is None if len(xs) <= 3 else abs(got[g].mutual_info - brute_information(xs, ys)) < 1e-9


def test_digamma(spark):
    got = spark.range(1, 200).select("id", information.digamma(F.col("id")).alias("p")).collect()
    assert all(abs(r.p - psi(r.id)) < 1e-12 for r in got)


@pytest.mark.parametrize("n", [1, 3, 10])
def test_fixed_holding(spark, n):
    """Entries are taken as a bar-by-bar loop takes them, by series; each trade lasts n + 1 bars from fill to fill."""
    rng = np.random.default_rng(n)
    rows, want, trades = [], [], 0
    for s in ("a", "b", "c"):
        side = np.where(rng.random(150) < 0.3, rng.choice([-1, 1], 150), 0) if s != "c" else np.zeros(150, int)
        free = 0
        for i, v in enumerate(side.tolist()):
            rows.append((s, T0 + timedelta(hours=i), float(i), v > 0, None if v == 0 and i % 2 else v < 0))
            if v and i >= free:
                want.append((s, i, v))
                free = i + n + 1
                trades += i + n + 2 < 150
    df = spark.createDataFrame(rows, "symbol string, time timestamp, open double, buy boolean, sell boolean").repartition(4)
    out = holding.fixed_holding(df, n).collect()
    hour = lambda t: int((t - T0).total_seconds() // 3600)
    assert sorted((r.symbol, hour(r.time), r.taken) for r in out if r.taken) == sorted(want)
    assert sorted((r.symbol, hour(r.time)) for r in out if r.exit_long or r.exit_short) == sorted((s, i + n + 1) for s, i, _ in want if i + n + 1 < 150)
    got = holding.holding_trades(df, n).collect()
    assert len(got) == trades and all(hour(r.exit_time) - hour(r.entry_time) == n + 1 == r.bars for r in got)
    assert all(r.pnl == (r.exit_price - r.entry_price) * (1 if r.action == "BUY" else -1) for r in got)


def test_exit_nodes(spark):
    nodes = (Node("c", "source.close"), Node("o", "source.open"), Node("m", "ind.ma", {"period": 5}, ("c",)), Node("up", "cmp.cross_above", {}, ("c", "m")), Node("dn", "cmp.cross_below", {}, ("c", "m")),
             Node("h", "exit.fixed_holding", {"holding_period": 4}), Node("x", "exit.opposite_signal"), Node("r", "exit.rebalance"), Node("b", "exit.middle_band", {}, ("c", "m")))
    df = made_bars(spark)
    rows = lambda a, b: sorted(genome.signals(df, nodes, "up", "dn", a, b).collect(), key=lambda r: r.time)
    held = rows("h", "h")
    taken = [i for i, r in enumerate(held) if r.taken]
    assert taken and all(b - a >= 5 for a, b in zip(taken, taken[1:], strict=False)) and all(held[i + 5].exit_long or held[i + 5].exit_short for i in taken if i + 5 < 120)
    assert all(r.exit_long == r.sell and r.exit_short == r.buy for r in rows("x", "x"))
    assert all(r.exit_long == r.buy and not r.exit_short for r in rows("b", "r"))  # the close against its own mean


def test_smoothed_is_what_a_loop_makes(spark):
    rng = np.random.default_rng(2)
    frames = []
    for s, n, step in (("a", 400, "h"), ("b", 300, "D"), ("c", 5, "31D"), ("d", 1, "D"), ("e", 150, "97D")):
        v = 100 + rng.normal(size=n).cumsum()
        v[rng.random(n) < (0.2 if s in "be" else 0)] = np.nan
        v[: 7 if s in "ab" else 0] = np.nan
        frames.append(pd.DataFrame({"symbol": s, "time": pd.date_range("2023-01-01", periods=n, freq=step), "v": v, "w": rng.normal(size=n)}))
    pdf = pd.concat(frames).reset_index(drop=True)
    means = {"e": ("v", 2 / 21, 0), "r": ("v", 1 / 14, 14), "q": ("w", 1.0, 0)}
    for chunk in ("month", "day"):
        got = folds.smoothed(spark.createDataFrame(pdf), means, chunk=chunk).toPandas().sort_values(["symbol", "time"]).reset_index(drop=True)
        for name, (c, alpha, least) in means.items():
            want = pdf.groupby("symbol")[c].transform(lambda x, a=alpha, m=least: x.ewm(alpha=a, adjust=False, min_periods=m).mean())
            assert (got[name].isna() == want.isna()).all() and np.nanmax(np.abs(got[name] - want)) < 1e-10


@pytest.mark.parametrize("past", [6, 1])
def test_regimes(spark, monkeypatch, past):
    monkeypatch.setattr(research, "PAST", past)
    rng = np.random.default_rng(3)
    rows = [(s, T0 + timedelta(days=i), None if rng.random() < 0.1 else float(np.floor(rng.normal() * 4)), i) for s, n in (("a", 200), ("b", 3), ("c", 1)) for i in range(n)]
    got = {(r.symbol, r.time): r.regime for r in research.regimes(spark.createDataFrame(rows, "symbol string, time timestamp, v double, _x int"), "v", 3).collect()}
    for s in "abc":
        seen = []
        for _, t, v, _ in (r for r in rows if r[0] == s):
            if v is not None:
                seen.append(v)
            want = None if v is None or len(seen) < 3 else sum(v >= c - 1e-12 for c in np.quantile(seen, [1 / 3, 2 / 3]))
            assert got[s, t] == want


def test_causality(spark):
    """Kinds with and without memory are clean; a planted look ahead is suspect, also where prefixes are cut to a look-back."""
    df = made_bars(spark, symbols=("s", "t"))
    nodes = (Node("c", "source.close"), Node("m", "ind.ma", {"period": 10}, ("c",)), Node("e", "ind.ema", {"period": 10}, ("c",)), Node("v", "feature.prev_session_high"))

    def compute(b):
        return genome.compile_graph(b, nodes).withColumn("ahead", F.lead("close").over(C.series()))

    checked = causality.check(df, compute, ["g_m", "g_e", "g_v", "ahead"], (5, 30, 100, 500))
    assert checked.count() == 2 * 3 * 4
    assert {r.feature: r.status for r in causality.status(checked).collect()} == {"g_m": "clean", "g_e": "clean", "g_v": "clean", "ahead": "suspect"}
    short = causality.check(df, lambda b: b.withColumn("m", C.sma(F.col("close"), 10)), ["m"], (30, 100), lookback=10)
    assert short.where("leaks").count() == 0 and short.where("whole is null").count() == 0


def test_catalogue_matrix(spark):
    """All 51 features at once: as each alone, in three passes over averages, behind their first bars."""
    df = made_bars(spark, n=320, symbols=("s", "t")).withColumn("exog_WDO$", F.col("close") * 2)
    requests = [catalogue.Request(n) for n in catalogue.CATALOGUE]
    assert len(requests) == 51
    passes = []
    smoothed = folds.smoothed
    folds.smoothed = lambda bars, columns, **more: passes.append(len(columns)) or smoothed(bars, columns, **more)
    try:
        whole = catalogue.feature_matrix(df, requests)
    finally:
        folds.smoothed = smoothed
    assert len(passes) == 2 and sum(passes) < 12  # the signal line is the only mean of a mean
    assert len(whole.columns) == 53 and whole.columns[2:] == sorted(whole.columns[2:])
    got = whole.toPandas().set_index(["symbol", "time"]).sort_index()
    for name in ("macd_signal", "rsi", "bollinger_upper", "range_compression", "dist_prev_session_low_atr"):
        one = catalogue.feature_matrix(df, [catalogue.Request(name)]).toPandas().set_index(["symbol", "time"]).sort_index()
        feature, params = catalogue.Request(name).resolved()
        column = catalogue.feature_id(feature, params)
        pd.testing.assert_series_equal(one[column], got[column])
        assert got.loc["s"][column].iloc[: catalogue.warmup(feature, params)].isna().all() and got.loc["s"][column].notna().any()
    about = {r.symbol: r for r in catalogue.manifest(whole, requests).collect()}
    assert about["s"].bar_count == 320 and about["s"].valid_from == T0 + timedelta(hours=252)


def test_matrix_id_and_store(spark, tmp_path):
    day = timedelta(days=1)
    a, b = catalogue.Request("ma", (("period", 5),)), catalogue.Request("rsi")
    key = lambda *r, **k: catalogue.matrix_id(k.get("symbol", "s"), "h1", T0, T0 + day, list(r))
    assert key(a, b) == key(b, a) and len({key(a), key(b), key(a, b), key(a, symbol="t"), key(catalogue.Request("ma"))}) == 5
    with pytest.raises(KeyError):
        catalogue.Request("nothing").resolved()
    with pytest.raises(KeyError):
        catalogue.Request("rsi", version=2).resolved()
    with pytest.raises(ValueError, match="unknown parameters"):
        catalogue.Request("rsi", (("window", 3),)).resolved()
    df, root = made_bars(spark, symbols=("s", "t")), f"file://{tmp_path}/lake"
    one, matrix, about = catalogue.stored_matrix(spark, root, df, "s", "H1", T0, T0 + 2 * day, [a, b])
    assert matrix.count() == about["bar_count"] == 49 and about["valid_from"] == "2023-01-01T14:00:00Z"
    again = catalogue.stored_matrix(spark, root, df.limit(0), "s", "H1", T0, T0 + 2 * day, [b, a])  # found, not built
    assert again[0] == one and again[1].count() == 49 and again[2] == about
    assert artifacts.versions(spark, root, "features", one) == [1]


def test_artifacts(spark, tmp_path):
    root = f"file://{tmp_path}/lake"
    t = lambda n: {"trades": spark.range(n), "equity": spark.range(n + 1)}
    assert artifacts.manifest(spark, root, "backtests", "r") is None
    with pytest.raises(FileNotFoundError):
        artifacts.read(spark, root, "backtests", "r", "trades")
    first = artifacts.write(spark, root, "backtests", "r", t(3), {"metrics": {"pnl": 1.5}})
    old = artifacts.read(spark, root, "backtests", "r", "trades")
    artifacts.write(spark, root, "backtests", "r", t(5))
    assert first["version"] == 1 and artifacts.versions(spark, root, "backtests", "r") == [1, 2]
    assert old.count() == 3 and artifacts.read(spark, root, "backtests", "r", "equity").count() == 6  # a reader keeps its version
    assert artifacts.manifest(spark, root, "backtests", "r", 1)["metrics"] == {"pnl": 1.5}
    with pytest.raises(FileNotFoundError):
        artifacts.read(spark, root, "backtests", "r", "windows")
    assert artifacts.delete(spark, root, "backtests", "r") and not artifacts.delete(spark, root, "backtests", "r")
    assert artifacts.manifest(spark, root, "backtests", "r") is None


def test_a_lock_box_is_used_once(spark, tmp_path):
    """Of many at once one is first; all are told what stands."""
    from concurrent.futures import ThreadPoolExecutor

    root = f"file://{tmp_path}/lake"
    with ThreadPoolExecutor(8) as pool:
        found = list(pool.map(lambda i: artifacts.claim(spark, root, "box", {"by": i}), range(8)))
    assert sum(first for first, _ in found) == 1
    winner = next(facts for first, facts in found if first)
    assert all(facts == winner for _, facts in found) and artifacts.claim(spark, root, "box", {"by": 9}) == (False, winner)


def test_tick_store(spark, tmp_path):
    root = f"file://{tmp_path}/ticks"
    msc = lambda m, d, ms=0: int((datetime(2024, m, d) - datetime(1970, 1, 1)).total_seconds() * 1000) + ms
    ticks = lambda *rows: spark.createDataFrame([(*r, 1.0, 1.0, 1.0, 2) for r in rows], "symbol string, time_msc long, bid double, ask double, last double, volume double, flags int")
    assert tick_store.read_ticks(spark, root, ["a"], T0, T0).count() == 0 and tick_store.summarize(spark, root).count() == 0
    tick_store.write_ticks(ticks(("a", msc(1, 5), 1.0), ("a", msc(1, 5, 1), 2.0), ("a", msc(2, 5), 3.0), ("b", msc(2, 6), 4.0), ("a", None, 9.0), (None, 1, 9.0)), root)
    files = lambda month: sorted(p.name for p in tmp_path.glob(f"ticks/symbol=a/month={month}/*.parquet"))
    january = files("2024-01")
    tick_store.write_ticks(ticks(("a", msc(2, 5), 5.0), ("a", msc(2, 5), 6.0), ("a", msc(3, 1), 7.0)), root)
    assert files("2024-01") == january and len(files("2024-02")) == 1  # only touched months are replaced
    every = tick_store.read_ticks(spark, root, ["a", "b"], datetime(2024, 1, 1), datetime(2024, 12, 31))
    assert sorted((r.symbol, r.time_msc, r.bid) for r in every.collect()) == [("a", msc(1, 5), 1.0), ("a", msc(1, 5, 1), 2.0), ("a", msc(2, 5), 6.0), ("a", msc(3, 1), 7.0), ("b", msc(2, 6), 4.0)]
    some = tick_store.read_ticks(spark, root, ["a"], datetime(2024, 2, 1), datetime(2024, 2, 28))
    assert [r.bid for r in some.collect()] == [6.0]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "month" in plan.split("PartitionFilters")[1]
    assert tick_store.delete_ticks(spark, root, "a") and not tick_store.delete_ticks(spark, root, "a")
    assert [(r.symbol, r.rows, r.months) for r in tick_store.summarize(spark, root).collect()] == [("b", 1, 1)]


def test_equity_begins_and_ends(spark):
    """A first loss and an idle tail count: days from the start to the end."""
    rows = [("s", datetime(2024, 1, 3, 12), -5000.0), ("s", datetime(2024, 1, 5, 9), 1000.0), ("s", datetime(2024, 1, 5, 18), 900.0), ("s", None, 77.0), ("t", None, 5.0)]
    curve = research.equity_curve(spark.createDataFrame(rows, "symbol string, exit_time timestamp, pnl double"), datetime(2024, 1, 1), datetime(2024, 1, 9))
    assert [(r.time, r.equity) for r in curve.where("symbol = 's'").orderBy("time").collect()] == [(datetime(2024, 1, 1), 100_000), (datetime(2024, 1, 3, 12), 95_000), (datetime(2024, 1, 5, 9), 96_000), (datetime(2024, 1, 5, 18), 96_900), (datetime(2024, 1, 9), 96_900)]
    days = pd.Series([100_000, 100_000, 95_000, 95_000, 96_900, 96_900, 96_900, 96_900, 96_900]).pct_change().dropna()
    got = {r.symbol: r for r in research.sharpe(research.daily_returns(curve)).collect()}
    assert got["s"].n == 8 and abs(got["s"].sharpe - days.mean() / days.std() * math.sqrt(252)) < 1e-9 and got["t"].sharpe is None


def test_plans_of_reads(spark):
    at = lambda d: datetime(2024, 1, d)
    stored = spark.createDataFrame([("s", at(5)), ("s", at(9)), ("s", at(20))], "symbol string, time timestamp")
    asked = spark.createDataFrame([(1, "s", at(6), at(8)), (2, "s", at(1), at(8)), (3, "s", at(6), at(30)), (4, "s", at(1), at(30)), (5, "x", at(1), at(2)), (6, "s", at(5), at(20))], "i int, symbol string, start timestamp, end timestamp")
    got = {r.i: (r.serve_from, r.head and tuple(r.head), r.tail and tuple(r.tail)) for r in series.plan_read(stored, asked).collect()}
    assert got == {1: ("local", None, None), 2: ("provider", (at(1), at(5)), None), 3: ("provider", None, (at(20), at(30))), 4: ("provider", (at(1), at(5)), (at(20), at(30))), 5: ("provider", (at(1), at(2)), None), 6: ("local", None, None)}


def test_timestamps_and_signs(spark):
    r = spark.sql("select timestamp'2024-01-02 03:04:05.678' as t").select(labels.iso(F.col("t")), labels.iso_offset(F.col("t")), labels.iso_millis(F.lit(1704164645078))).first()
    assert tuple(r) == ("2024-01-02T03:04:05Z", "2024-01-02T03:04:05+00:00", "2024-01-02T03:04:05.078Z")
    ics = spark.createDataFrame([("a", 0.1), ("b", 0.1), ("b", 0.2), ("b", -0.1), ("c", 0.0), ("d", None), ("e", 0.0), ("e", 0.3)], "symbol string, rank_ic double")
    assert {r.symbol: r.sign_consistency for r in research.stability(ics).collect()} == {"a": 0.0, "b": 2 / 3, "c": 0.0, "d": 0.0, "e": 0.0}


def test_a_stream_recovers(spark, tmp_path):
    """Stopped in the middle, then resumed from its checkpoint, or started anew behind stored bars: the same decisions, none twice."""
    bars = made_bars(spark, n=90, symbols=("s", "t")).orderBy("time").toPandas()
    schema = spark.createDataFrame(bars[:1]).schema
    put = lambda name, rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/{name}")
    stream = lambda name: spark.readStream.schema(schema).parquet(f"file://{tmp_path}/{name}")

    def decided(frame, name):
        frame.writeStream.format("parquet").option("path", f"file://{tmp_path}/{name}").option("checkpointLocation", f"file://{tmp_path}/{name}-state").trigger(availableNow=True).start().awaitTermination()
        return sorted(tuple(r) for r in spark.read.parquet(f"file://{tmp_path}/{name}").collect())

    put("all", bars)
    want = decided(live.crossover_decisions(stream("all")), "whole")
    assert len(want) == 180 and any(r[5] for r in want)
    first, second = bars[:100], bars[90:]  # ten bars come twice
    put("live", first)
    early = decided(live.crossover_decisions(stream("live")), "resumed")
    put("live", second)
    resumed = decided(live.crossover_decisions(stream("live")), "resumed")
    assert len(early) == 100 and resumed == want
    put("store", first)
    put("rest", second)
    anew = decided(live.crossover_decisions(live.recovering(stream("store"), stream("rest"))), "anew")
    assert anew == [r for r in want if r not in early]


def test_importances(spark):
    """As a dense grid over the box has them; they add up to 1 at most."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    rng = np.random.default_rng(4)
    a, b, k = rng.uniform(0, 10, 300), rng.uniform(-1, 1, 300), np.ones(300)
    y = 3 * a + 10 * (b > 0.2) + a * b
    df = spark.createDataFrame([*zip(a.tolist(), b.tolist(), k.tolist(), y.tolist(), strict=True), (None, 1.0, 1.0, 99.0)], "a double, b double, k double, y double").coalesce(1)
    got = {r.parameter: r for r in importance.importances(df, ["a", "b", "k"], "y", trees=3, depth=4).collect()}
    assert set(got) == {"a", "b", "k"} and got["k"].importance == 0 and sum(r.importance for r in got.values()) <= 1 + 1e-9
    assert abs(sum(r.share for r in got.values()) - 1) < 1e-9
    at = lambda x: np.linspace(x.min(), x.max(), 401)[:-1] + (x.max() - x.min()) / 802
    grid = spark.createDataFrame([(float(p), float(q), 1.0) for p in at(a) for q in at(b)[::4]], "a double, b double, k double")
    points = VectorAssembler(inputCols=["a", "b", "k"], outputCol="_x")
    whole = points.transform(df.dropna().withColumnRenamed("y", "_y"))
    model = RandomForestRegressor(featuresCol="_x", labelCol="_y", numTrees=3, maxDepth=4, seed=1, featureSubsetStrategy="all").fit(whole)
    shares = []
    for tree in model.trees:
        z = np.array([r.prediction for r in tree.transform(points.transform(grid)).select("prediction").collect()]).reshape(400, 100)
        shares.append((z.mean(axis=1).var() / z.var(), z.mean(axis=0).var() / z.var()))
    assert np.allclose([got["a"].importance, got["b"].importance], np.mean(shares, axis=0), atol=0.01)
    assert importance.importances(df.limit(1), ["a"], "y").count() == 0


def test_searches(spark):
    trial = lambda s, p, r: (s, p, r)
    rows = [trial("MACrossover", {"short_period": "50", "long_period": "50"}, {}), trial("MACrossover", {"short_period": "5", "long_period": "50", "short_ma_type": " EMA "}, {}), trial("MACrossover", {"long_ma_type": "tma"}, {}), trial("RSI", {"short_period": "50", "long_period": "5"}, {}),
            trial("RSI", {}, {"type": "fixed_safety_margin", "min_contracts": "3", "max_contracts": "2"}), trial("RSI", {}, {"type": "fixed", "min_contracts": "3", "max_contracts": "2"}), trial(None, None, None)]
    df = spark.createDataFrame(rows, "s string, p map<string,string>, r map<string,string>").coalesce(1)
    assert [r[0] and r[0][:12] for r in df.select(search.void(F.col("s"), F.col("p"), F.col("r"))).collect()] == ["long_period ", None, "unknown long", None, "max_contract", None, None]
    warm = spark.createDataFrame([({"period": 5.0, "e1__Window": 9.7, "num_std": 99.0, "period__num_std": 50.0},), ({},), (None,)], "p map<string,double>").coalesce(1)
    assert [r[0] for r in warm.select(search.warmup_bars(F.col("p"))).collect()] == [27, 0, 0]
    figures = spark.createDataFrame([("a", 1, 5.0, 0.1, None), ("a", 2, 5.0, 0.2, None), ("a", 3, 9.0, 0.0, "no"), ("b", 1, None, 0.3, None)], "study string, trial int, total_pnl double, max_drawdown_pct double, void string").withColumn("total_return_pct", F.col("total_pnl"))
    best = lambda mode: {r.study: (r.trial, r.objective) for r in search.best_trials(figures, mode, "study", "trial").collect()}
    assert best("maximize_net_profit") == {"a": (1, [5.0]), "b": (1, [0.0])} and best("minimize_drawdown")["a"] == (1, [0.1])
    assert best("multi_objective_return_drawdown")["a"] == (1, [5.0, 0.1])
    nodes = spark.createDataFrame([("p", 1, "x"), ("p", 1, "y"), ("p", 2, "y"), ("p", 2, "x"), ("p", 3, "x"), ("p", 3, "x"), ("p", 3, "y")], "p string, g int, kind string")
    assert tuple(search.diversity(nodes, "p", "g").first()) == ("p", 3, 2, 2 / 3)
    scores = spark.createDataFrame([("s", "a", -0.4), ("s", "a", 0.1), ("s", "b", 0.1), ("s", "c", None), ("z", "a", 0.0)], "s string, kind string, ic double")
    assert {tuple(r) for r in search.kind_weights(scores, "s").collect()} == {("s", "a", 3.0), ("s", "b", 1.5)}
    bars = made_bars(spark, n=130, symbols=("s",)).unionByName(made_bars(spark, n=5, symbols=("few",))).unionByName(made_bars(spark, n=130, symbols=("gap",)).where("time < '2023-01-03' or time > '2023-01-04'"))
    found = {r.symbol: (r.verdict, r.max_gap_days) for r in search.preflight(bars, 3600, min_bars=100, max_gap_days=0.5).collect()}
    assert found == {"s": ("ready", 0.0), "few": ("inconclusive", 0.0), "gap": ("inconclusive", 26 / 24)}
