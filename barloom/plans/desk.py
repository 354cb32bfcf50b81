"""The store's reads and writes, labels, joins of run tables and figures of trades on the driver's tables, each with the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import columns as C
from ..functions import labels
from ..operators import analytics, holding, research, series
from ..sources import artifacts, scratch
from ..sources import ticks as tick_store
from .studies import END, START
from .queries import D1, H1, TRADES, W, daily, full, hourly, lagged, made_trades, read, rounded, ticks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
c = F.col


def query(sql: str):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


# stored series
RAW = "t AS (SELECT event_type AS symbol, ts, event_id AS seq, value + 1 AS price FROM events)"


@query(f"WITH {RAW}, m AS (SELECT min(ts) AS a, max(ts) AS z FROM t) SELECT symbol, ts, seq, price FROM t, m WHERE ts >= a + (z - a) / 4 AND ts < a + (z - a) / 2 AND symbol IN ('view', 'click')")
def tick_range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ticks(spark, sf_dir).drop("volume")
    a, z = t.agg(F.min("ts"), F.max("ts")).first()
    return t.where("symbol in ('view', 'click')").where((c("ts") >= F.lit(a + (z - a) / 4)) & (c("ts") < F.lit(a + (z - a) / 2))) if a else t.limit(0)


@query("SELECT event_type AS symbol, strftime(ts, '%Y-%m') AS month, count(*) AS n FROM events GROUP BY ALL")
def tick_month_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").groupBy(c("event_type").alias("symbol"), F.date_format("ts", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH b AS (SELECT event_type AS symbol, date_trunc('minute', ts) AS minute, value, event_id, 0 AS fresh FROM events WHERE event_id % 3 <> 0 UNION ALL SELECT event_type, date_trunc('minute', ts), value * 2, event_id, 1 FROM events WHERE event_id % 2 = 0)
SELECT symbol, minute, arg_max(value, (fresh, event_id)) AS value, arg_max(event_id, (fresh, event_id)) AS seq FROM b GROUP BY ALL""")
def tick_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read(spark, sf_dir, "events").select(c("event_type").alias("symbol"), F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("minute"), "value", c("event_id").alias("seq"))
    return series.upsert(t.where("seq % 3 <> 0"), t.where("seq % 2 = 0").withColumn("value", c("value") * 2), ["symbol", "minute"], ["seq"])


@query(f"WITH {H1} SELECT symbol, time, close FROM bars WHERE symbol NOT IN (SELECT symbol FROM bars GROUP BY symbol ORDER BY count(*), symbol LIMIT 1)")
def delete_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All series but the one with the fewest bars."""
    df = hourly(spark, sf_dir).select("symbol", "time", "close")
    return df.join(F.broadcast(df.groupBy("symbol").count().orderBy("count", "symbol").limit(1).select("symbol")), "symbol", "left_anti")


@query(f"""WITH {H1}, s AS (SELECT symbol, 'H1' AS timeframe, count(*) AS rows, min(time) AS first, max(time) AS last FROM bars GROUP BY symbol), o AS (SELECT symbol, timeframe, rows // 2 AS rows, first, first AS last FROM s WHERE symbol < 'm' UNION ALL SELECT 'old', 'D1', 1, min(first), min(first) FROM s)
SELECT * FROM s UNION ALL SELECT * FROM o WHERE (symbol, timeframe) NOT IN (SELECT symbol, timeframe FROM s)""")
def catalog_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = series.summary(hourly(spark, sf_dir)).select("symbol", F.lit("H1").alias("timeframe"), "rows", "first", "last")
    old = s.where("symbol < 'm'").select("symbol", "timeframe", F.floor(c("rows") / 2).cast("long").alias("rows"), "first", c("first").alias("last"))
    old = old.unionByName(s.agg(F.min("first").alias("first")).select(F.lit("old").alias("symbol"), F.lit("D1").alias("timeframe"), F.lit(1).cast("long").alias("rows"), "first", c("first").alias("last")))
    return series.upsert(old, s, ["symbol", "timeframe"], ["last"])


@query(f"WITH {H1} SELECT symbol, count(*) AS rows, min(time) AS first, max(time) AS last FROM bars GROUP BY symbol")
def series_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored symbols, each with its rows and available range."""
    return series.summary(hourly(spark, sf_dir))


@query(f"WITH {H1}, r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY time DESC) AS r FROM bars) SELECT symbol, time, open, high, low, close, volume FROM r WHERE r <= 50")
def last_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.last_n(hourly(spark, sf_dir), 50).select("symbol", "time", "open", "high", "low", "close", "volume")


@query(f"WITH {H1}, n AS (SELECT symbol, time, lead(time) OVER {W} AS nxt FROM bars) SELECT symbol, time + INTERVAL 1 HOUR AS gap_start, nxt - INTERVAL 1 HOUR AS gap_end, CAST((epoch(nxt) - epoch(time)) / 3600 - 1 AS BIGINT) AS missing FROM n WHERE nxt > time + INTERVAL 1 HOUR")
def coverage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = series.coverage(hourly(spark, sf_dir), 3600)
    return out.select("symbol", *(c(x).cast("timestamp_ntz").alias(x) for x in ("gap_start", "gap_end")), "missing")


@query(f"""WITH {H1}, v AS (SELECT symbol, min(time) AS a, max(time) AS z FROM bars GROUP BY symbol),
r AS (SELECT CASE WHEN user_id % 7 = 0 THEN event_type || '_x' ELSE event_type END AS symbol, user_id % 40 AS request, min(ts) - (user_id % 3) * INTERVAL 1 DAY AS s, max(ts) - (user_id % 4 - 1) * INTERVAL 1 DAY AS e FROM events GROUP BY event_type, user_id),
q AS (SELECT symbol, request, min(s) AS s, max(e) AS e FROM r GROUP BY ALL)
SELECT q.symbol, request, s AS start, e AS "end", CASE WHEN a <= s AND z >= e THEN 'local' ELSE 'provider' END AS serve_from,
CASE WHEN a IS NULL OR s < a THEN s END AS head_start, CASE WHEN a IS NULL THEN e WHEN s < a THEN a END AS head_end, CASE WHEN e > z THEN z END AS tail_start, CASE WHEN e > z THEN e END AS tail_end FROM q LEFT JOIN v USING (symbol)""")
def coverage_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests against what is stored: served from the store, or else what is missing before and behind it."""
    u = c("user_id")
    each = read(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.min("ts").alias("s"), F.max("ts").alias("e"))
    day = lambda t, n: (t.cast("timestamp") - F.make_dt_interval(n)).cast(each.schema["s"].dataType)
    requests = each.groupBy(F.when(u % 7 == 0, F.concat("event_type", F.lit("_x"))).otherwise(c("event_type")).alias("symbol"), (u % 40).alias("request")).agg(F.min(day(c("s"), (u % 3).cast("int"))).alias("start"), F.max(day(c("e"), (u % 4 - 1).cast("int"))).alias("end"))
    out = series.plan_read(hourly(spark, sf_dir), requests)
    return out.select("symbol", "request", "start", "end", "serve_from", c("head.start").alias("head_start"), c("head.end").alias("head_end"), c("tail.start").alias("tail_start"), c("tail.end").alias("tail_end"))


@query(f"WITH {H1}, l AS (SELECT time, close FROM bars WHERE symbol = 'purchase'), v AS (SELECT time, close FROM bars WHERE symbol = 'view') SELECT time, close FROM l UNION ALL SELECT time, close FROM v WHERE time NOT IN (SELECT time FROM l)")
def gap_fill_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = hourly(spark, sf_dir)
    one = lambda s: df.where(c("symbol") == s).select("time", "close")
    return series.gap_filled(one("purchase"), one("view"), ["time"])


# labels and projections
@query("""SELECT p_partkey, CASE upper(CASE p_size % 9 WHEN 0 THEN '1m' WHEN 1 THEN 'H1' WHEN 2 THEN '4h' WHEN 3 THEN '30M' WHEN 4 THEN 'm5' WHEN 5 THEN '15m' WHEN 6 THEN '1d' WHEN 7 THEN '1W' END) WHEN '1M' THEN 'M1' WHEN 'H1' THEN 'H1' WHEN '4H' THEN 'H4' WHEN '30M' THEN 'M30' WHEN 'M5' THEN 'M5' WHEN '15M' THEN 'M15' ELSE 'D1' END AS timeframe,
regexp_replace(p_name || ' ' || p_brand || '/' || p_type, '[^0-9A-Za-z_.$-]+', '_', 'g') AS slug, CASE WHEN p_type LIKE '%BMF%' OR p_name LIKE '%@%' OR p_name LIKE '%$%' THEN 'future' WHEN p_type LIKE '%FX%' OR p_type LIKE '%Forex%' THEN 'fx' ELSE 'equity' END AS asset_class FROM part""")
def market_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["1m", "H1", "4h", "30M", "m5", "15m", "1d", "1W"]
    label = F.element_at(F.array(*map(F.lit, names), F.lit(None)), (c("p_size") % 9 + 1).cast("int"))
    slug = labels.slug(F.concat("p_name", F.lit(" "), "p_brand", F.lit("/"), "p_type"))
    return read(spark, sf_dir, "part").select("p_partkey", labels.timeframe(label).alias("timeframe"), slug.alias("slug"), labels.asset_class(c("p_name"), c("p_type")).alias("asset_class"))


@query("""WITH t AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value - 50 END AS last, CAST(event_id % 128 AS BIGINT) AS flags, value AS bid, value + 0.5 AS ask, ts FROM events)
SELECT event_id, CASE WHEN flags & 32 <> 0 AND flags & 64 = 0 THEN 'buy' WHEN flags & 64 <> 0 AND flags & 32 = 0 THEN 'sell' END AS side, coalesce(last, 0) > 0 OR flags & 96 <> 0 AS is_trade, round((bid + ask) / 2, 6) AS mid, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS iso_ms FROM t""")
def tick_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read(spark, sf_dir, "events").select("event_id", F.when(c("event_id") % 5 != 0, c("value") - 50).alias("last"), (c("event_id") % 128).alias("flags"), c("value").alias("bid"), (c("value") + 0.5).alias("ask"), "ts")
    return t.select("event_id", labels.tick_side(c("flags")).alias("side"), labels.is_trade(c("last"), c("flags")).alias("is_trade"), rounded(labels.mid(c("bid"), c("ask"))).alias("mid"), labels.iso(c("ts")).alias("iso"), labels.iso_millis(F.unix_millis(c("ts").cast("timestamp"))).alias("iso_ms"))


@query(f"""WITH {H1}, f AS (SELECT symbol, count(*) AS n, strftime(min(time), '%Y-%m-%dT%H:%M:%S+00:00') AS a, strftime(max(time), '%Y-%m-%dT%H:%M:%S+00:00') AS z FROM bars GROUP BY symbol)
SELECT symbol, sha256('{{"bar_count":' || n || ',"end":"' || z || '","start":"' || a || '"}}') AS data_fingerprint, symbol || '.v1.' || left(sha256('[["period",' || n || ']]'), 8) AS feature_id FROM f""")
def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a series' count and ends, and of a feature's parameters as compact JSON."""
    s = series.summary(hourly(spark, sf_dir))
    data = F.format_string('{"bar_count":%d,"end":"%s","start":"%s"}', "rows", labels.iso_offset(c("last")), labels.iso_offset(c("first")))
    return s.select("symbol", F.sha2(data, 256).alias("data_fingerprint"), F.concat("symbol", F.lit(".v1."), F.left(F.sha2(F.format_string('[["period",%d]]', "rows"), 256), F.lit(8))).alias("feature_id"))


@query(f"WITH {RAW}, s AS (SELECT symbol, ts, seq, date_trunc('hour', ts) AS time, {full('price', 20, 'avg(price)').replace('ORDER BY time', 'ORDER BY ts, seq')} AS v FROM t) SELECT symbol, time, round(arg_max(coalesce(v, -1), (ts, seq)), 6) AS v FROM s GROUP BY ALL")
def indicator_at_bar_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20-tick mean at each hour's last tick; -1 where it isn't full yet."""
    w = Window.partitionBy("symbol").orderBy("ts", "seq").rowsBetween(-19, 0)
    t = ticks(spark, sf_dir).withColumn("v", F.when(F.count("price").over(w) == 20, F.avg("price").over(w)).otherwise(-1.0))
    return t.groupBy("symbol", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("time")).agg(rounded(F.max_by("v", F.struct("ts", "seq"))).alias("v"))


# strategies
m = full("close", 20, "avg(close)")


HELD = """e AS (SELECT symbol, i, CASE WHEN buy THEN 1 ELSE -1 END AS side FROM s WHERE buy OR sell),
k AS (SELECT symbol, min(i) AS i FROM e GROUP BY symbol UNION ALL SELECT k.symbol, (SELECT min(e.i) FROM e WHERE e.symbol = k.symbol AND e.i >= k.i + {n} + 1) FROM k WHERE k.i IS NOT NULL),
h AS (SELECT symbol, i, side FROM k JOIN e USING (symbol, i))"""
HELD_SIGNALS = "SELECT s.symbol, s.time, buy, sell, coalesce(a.side, 0) AS taken, coalesce(b.side > 0, false) AS exit_long, coalesce(b.side < 0, false) AS exit_short FROM s LEFT JOIN h a ON a.symbol = s.symbol AND a.i = s.i LEFT JOIN h b ON b.symbol = s.symbol AND b.i + {n} + 1 = s.i"
HELD_TRADES = "SELECT h.symbol, CASE WHEN side > 0 THEN 'BUY' ELSE 'SELL' END AS action, x.time AS entry_time, round(x.open, 6) AS entry_price, y.time AS exit_time, round(y.open, 6) AS exit_price, round((y.open - x.open) * side, 4) AS pnl, y.i - x.i AS bars FROM h JOIN s x ON x.symbol = h.symbol AND x.i = h.i + 1 JOIN s y ON y.symbol = h.symbol AND y.i = h.i + {n} + 2"
FMA = f"""{D1}, y AS (SELECT *, {m} * 1.01 AS u, {m} * 0.99 AS l, row_number() OVER {W} AS i FROM bars), s AS (SELECT *, coalesce(close > u AND {lagged('close')} <= {lagged('u')}, false) AS buy, coalesce(close < l AND {lagged('close')} >= {lagged('l')}, false) AS sell FROM y),
{HELD.format(n=10)}"""
TRB = f"""{D1}, y AS (SELECT *, {full("close", 20, "max(close)", 1)} AS u, {full("close", 20, "min(close)", 1)} AS l, row_number() OVER {W} AS i FROM bars), s AS (SELECT *, coalesce({lagged('close')} <= u AND close > u, false) AS buy, coalesce({lagged('close')} >= l AND close < l, false) AS sell FROM y),
{HELD.format(n=5)}"""


def fma(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = C.sma(c("close"), 20)
    df = daily(spark, sf_dir).withColumns({"u": mean * 1.01, "l": mean * 0.99})
    return df.withColumns({"buy": C.cross_above(c("close"), c("u")), "sell": C.cross_below(c("close"), c("l"))})


def trb(spark: SparkSession, sf_dir: str) -> DataFrame:
    channel = C.trb_channel(c("close"), 20, 0.0)
    df = daily(spark, sf_dir).withColumns({"u": channel["channel_high"], "l": channel["channel_low"]})
    return df.withColumns({"buy": C.false_if_null((C.lag(c("close")) <= c("u")) & (c("close") > c("u"))), "sell": C.false_if_null((C.lag(c("close")) >= c("l")) & (c("close") < c("l")))})


@query(f"WITH RECURSIVE {FMA} {HELD_SIGNALS.format(n=10)}")
def strategy_fma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crosses of a band round the mean; each that is taken is held for ten bars whatever else is signalled."""
    return holding.fixed_holding(fma(spark, sf_dir), 10).select("symbol", "time", "buy", "sell", "taken", "exit_long", "exit_short")


@query(f"WITH RECURSIVE {TRB} {HELD_SIGNALS.format(n=5)}")
def strategy_trb_held(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breakouts of the last 20 closes' range, each that is taken held for five bars."""
    return holding.fixed_holding(trb(spark, sf_dir), 5).select("symbol", "time", "buy", "sell", "taken", "exit_long", "exit_short")


def _rounded_trades(bars: DataFrame, n: int) -> DataFrame:
    return holding.holding_trades(bars, n).select("symbol", "action", "entry_time", F.round("entry_price", 6).alias("entry_price"), "exit_time", F.round("exit_price", 6).alias("exit_price"), F.round("pnl", 4).alias("pnl"), "bars")


@query(f"WITH RECURSIVE {FMA} {HELD_TRADES.format(n=10)}")
def fma_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded_trades(fma(spark, sf_dir), 10)


@query(f"WITH RECURSIVE {TRB} {HELD_TRADES.format(n=5)}")
def trb_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded_trades(trb(spark, sf_dir), 5)


# stores: each query writes to a new folder and reads it back
TICK = "SELECT event_type AS symbol, epoch_us(ts) // 1000 AS time_msc, event_id, value AS bid, value + 0.5 AS ask, value + 0.25 AS last, 1.0 AS volume, CAST(event_id % 128 AS INTEGER) AS flags FROM events"


def store_ticks(spark: SparkSession, sf_dir: str) -> str:
    """A store of two writes: two thirds of the ticks, then every second one with its prices doubled."""
    e = read(spark, sf_dir, "events")
    t = e.select(c("event_type").alias("symbol"), F.unix_millis(c("ts").cast("timestamp")).alias("time_msc"), "event_id", c("value").alias("bid"), (c("value") + 0.5).alias("ask"), (c("value") + 0.25).alias("last"), F.lit(1.0).alias("volume"), (c("event_id") % 128).cast("int").alias("flags"))
    root = scratch.shared_dir(spark)
    tick_store.write_ticks(t.where("event_id % 3 <> 0"), root, ["event_id"])
    tick_store.write_ticks(t.where("event_id % 2 = 0").withColumns({x: c(x) * 2 for x in ("bid", "ask", "last")}), root, ["event_id"])
    return root


STORED = f"""i AS ({TICK}), w AS (SELECT *, 0 AS w FROM i WHERE event_id % 3 <> 0 UNION ALL SELECT symbol, time_msc, event_id, bid * 2, ask * 2, last * 2, volume, flags, 1 FROM i WHERE event_id % 2 = 0),
s AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY symbol, time_msc ORDER BY w DESC, event_id DESC) = 1)"""


@query(f"WITH {STORED} SELECT symbol, time_msc, round(bid, 6) AS bid, round(ask, 6) AS ask, round(last, 6) AS last, flags FROM s WHERE symbol IN ('click', 'view') AND make_timestamp_ms(time_msc) BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-20'")
def tick_store_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten days of two symbols, of what two writes have left."""
    out = tick_store.read_ticks(spark, store_ticks(spark, sf_dir), ["click", "view"], datetime(2024, 1, 10), datetime(2024, 1, 20))
    return out.select("symbol", "time_msc", *(F.round(x, 6).alias(x) for x in ("bid", "ask", "last")), "flags")


@query(f"WITH {STORED} SELECT symbol, count(DISTINCT strftime(make_timestamp_ms(time_msc), '%Y-%m')) AS months, count(*) AS rows, make_timestamp_ms(min(time_msc)) AS first, make_timestamp_ms(max(time_msc)) AS last FROM s WHERE symbol <> 'view' GROUP BY symbol")
def tick_store_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is stored once a series has been deleted."""
    root = store_ticks(spark, sf_dir)
    tick_store.delete_ticks(spark, root, "view")
    out = tick_store.summarize(spark, root)
    return out.select("symbol", "months", "rows", *(c(x).cast("timestamp_ntz").alias(x) for x in ("first", "last")))


@query(f"WITH {TRADES} SELECT symbol, trade_id, exit_time, pnl, exit_reason, 2 AS version FROM t WHERE pnl > 0")
def run_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run's trades, written twice; the second version, of the gains alone, is what readers see."""
    root, t = scratch.shared_dir(spark), made_trades(spark, sf_dir)
    for rows in (t, t.where("pnl > 0")):
        artifacts.write(spark, root, "backtests", "run", {"trades": rows, "equity": research.equity_curve(rows, START, END)}, {"metrics": {"trades": rows.count()}})
    found = artifacts.manifest(spark, root, "backtests", "run")
    return artifacts.read(spark, root, "backtests", "run", "trades").withColumn("version", F.lit(found["version"]))


# run tables
@query("SELECT o_orderkey AS run, c_custkey AS model, c_mktsegment AS kind, o_totalprice AS score FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F'")
def scores_with_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").where("o_orderstatus = 'F'").join(read(spark, sf_dir, "customer"), c("o_custkey") == c("c_custkey")).select(c("o_orderkey").alias("run"), c("c_custkey").alias("model"), c("c_mktsegment").alias("kind"), c("o_totalprice").alias("score"))


@query("SELECT s_suppkey AS deployment, s_name AS name, l_returnflag AS account, count(*) AS fills, round(coalesce(sum(CASE WHEN l_linestatus = 'O' THEN l_quantity END), 0), 2) AS open_quantity FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL")
def positions_with_deployments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums are 0 where nothing is open. Fills are summed by position before they meet the deployments."""
    held = read(spark, sf_dir, "lineitem").groupBy("l_suppkey", c("l_returnflag").alias("account")).agg(F.count(F.lit(1)).alias("fills"), F.round(F.coalesce(F.sum(F.when(c("l_linestatus") == "O", c("l_quantity"))), F.lit(0.0)), 2).alias("open_quantity"))
    return held.join(read(spark, sf_dir, "supplier"), c("l_suppkey") == c("s_suppkey")).select(c("s_suppkey").alias("deployment"), c("s_name").alias("name"), "account", "fills", "open_quantity")


@query("SELECT c_custkey AS model, CAST(coalesce(max(o_orderkey % 100), 0) + 1 AS BIGINT) AS next_version, count(o_orderkey) FILTER (o_totalprice > 150000) AS large FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY ALL")
def next_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One more than a model's largest version (1 without any), and a count over a filtered part."""
    best = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max(c("o_orderkey") % 100).alias("v"), F.count(F.when(c("o_totalprice") > 150_000, 1)).alias("large"))
    return read(spark, sf_dir, "customer").join(best, c("c_custkey") == c("o_custkey"), "left").select(c("c_custkey").alias("model"), (F.coalesce("v", F.lit(0)) + 1).cast("long").alias("next_version"), F.coalesce("large", F.lit(0)).cast("long").alias("large"))


@query("SELECT o_orderkey AS k FROM orders WHERE o_orderpriority LIKE '1%' UNION ALL SELECT o_orderkey FROM orders WHERE o_totalprice > 200000")
def union_of_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    return o.where("o_orderpriority like '1%'").select(c("o_orderkey").alias("k")).union(o.where("o_totalprice > 200000").select("o_orderkey"))


@query(f"WITH {D1} SELECT time FROM bars WHERE symbol LIKE '1%' INTERSECT SELECT time FROM bars WHERE symbol LIKE '2%' AND close > open")
def common_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = daily(spark, sf_dir)
    return df.where("symbol like '1%'").select("time").intersect(df.where("symbol like '2%' and close > open").select("time"))


@query(f"WITH {D1}, f AS (SELECT symbol, time, {full('close', 20, 'avg(close)')} AS v FROM bars), a AS (SELECT symbol, min(time) AS valid_from FROM f WHERE v IS NOT NULL GROUP BY symbol) SELECT symbol, time, round(v, 6) AS v FROM f JOIN a USING (symbol) WHERE time >= valid_from")
def trimmed_to_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feature from its first value on: a running maximum of 'seen', no join."""
    w = Window.partitionBy("symbol").orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    df = daily(spark, sf_dir).withColumn("v", C.sma(c("close"), 20))
    return df.withColumn("seen", F.count("v").over(w)).where("seen > 0").select("symbol", "time", rounded(c("v")).alias("v"))


# figures of trades
MADE = f"""{D1}, n AS (SELECT *, row_number() OVER {W} AS i, lead(time, 5) OVER {W} AS t5, lead(open, 5) OVER {W} AS o5 FROM bars),
t AS (SELECT symbol, i AS trade_id, CASE WHEN i % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS action, open AS entry_price, 2.0 AS quantity, time AS entry_time, t5 AS exit_time, (o5 - open) * CASE WHEN i % 2 = 0 THEN 2 ELSE -2 END AS pnl FROM n WHERE i % 7 = 0 AND t5 IS NOT NULL)"""


def held_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh bar a trade over five bars, long and short by turns: trades that are closed have an exit."""
    w = Window.partitionBy("symbol").orderBy("time")
    n = daily(spark, sf_dir).withColumns({"i": F.row_number().over(w).cast("long"), "t5": F.lead("time", 5).over(w), "o5": F.lead("open", 5).over(w)})
    side = F.when(c("i") % 2 == 0, 1).otherwise(-1)
    return n.where("i % 7 = 0 and t5 is not null").select("symbol", c("i").alias("trade_id"), F.when(side > 0, "BUY").otherwise("SELL").alias("action"), c("open").alias("entry_price"), F.lit(2.0).alias("quantity"), c("time").alias("entry_time"), c("t5").alias("exit_time"), ((c("o5") - c("open")) * side * 2).alias("pnl"))


PATHS = f"""{MADE}, p AS (SELECT t.symbol, trade_id, any_value(action) AS action, any_value(entry_price) AS e, any_value(pnl) AS pnl, max(high) AS h, min(low) AS l, count(*) AS bars FROM t JOIN bars b ON t.symbol = b.symbol AND b.time BETWEEN entry_time AND exit_time GROUP BY ALL),
q AS (SELECT symbol, trade_id, bars, pnl, greatest(CASE WHEN action = 'BUY' THEN h - e ELSE e - l END, 0) * 2 AS mfe, CASE WHEN action = 'BUY' THEN l - e ELSE e - h END * 2 AS mae FROM p)"""


@query(f"WITH {PATHS} SELECT symbol, trade_id, bars, round(mfe, 4) AS mfe, round(mae, 4) AS mae, round(CASE WHEN mfe > 0 THEN pnl / mfe END, 6) AS capture, round(CASE WHEN mfe > pnl THEN mfe - pnl END, 4) AS giveback FROM q")
def path_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = analytics.path_quality(held_trades(spark, sf_dir), daily(spark, sf_dir))
    return out.select("symbol", "trade_id", "bars", F.round("mfe", 4).alias("mfe"), F.round("mae", 4).alias("mae"), F.round("capture", 6).alias("capture"), F.round("giveback", 4).alias("giveback"))


@query(f"""WITH {PATHS}, a AS (SELECT symbol, avg(CASE WHEN mfe > 0 THEN pnl / mfe END) AS cap, avg(CASE WHEN mfe > pnl THEN mfe - pnl END) AS give, avg(mae) AS mae, sum(pnl) AS total FROM q GROUP BY symbol)
SELECT symbol, round(cap, 6) AS avg_capture, round(give, 4) AS avg_giveback, round(mae, 4) AS avg_mae, concat_ws(',', CASE WHEN cap < 0.3 THEN 'low_mfe_capture' END, CASE WHEN total > 0 AND give > total * 0.05 THEN 'high_profit_giveback' END) AS flags FROM a""")
def exit_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = analytics.exit_quality(analytics.path_quality(held_trades(spark, sf_dir), daily(spark, sf_dir)), "symbol", 0.3, 0.05)
    return out.select("symbol", F.round("avg_capture", 6).alias("avg_capture"), F.round("avg_giveback", 4).alias("avg_giveback"), F.round("avg_mae", 4).alias("avg_mae"), "flags")


@query(f"WITH {MADE}, d AS (SELECT symbol, epoch(exit_time) - epoch(entry_time) AS s FROM t) SELECT symbol, CAST(median(s) AS DOUBLE) AS median_seconds, round(quantile_cont(s, 0.9), 4) AS p90_seconds FROM d GROUP BY symbol")
def holding_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = held_trades(spark, sf_dir).select("symbol", (F.unix_timestamp(c("exit_time").cast("timestamp")) - F.unix_timestamp(c("entry_time").cast("timestamp"))).cast("double").alias("s"))
    return d.groupBy("symbol").agg(F.expr("percentile(s, 0.5)").alias("median_seconds"), F.round(F.expr("percentile(s, 0.9)"), 4).alias("p90_seconds"))


@query(f"""WITH {TRADES}, e AS (SELECT symbol, pnl, trade_id, exit_time, 100000 + sum(pnl) OVER w AS equity FROM t WINDOW w AS (PARTITION BY symbol ORDER BY exit_time, trade_id)), p AS (SELECT *, greatest(100000, max(equity) OVER (PARTITION BY symbol ORDER BY exit_time, trade_id)) AS peak FROM e),
s AS (SELECT symbol, sum(pnl) / 100000 AS total, max((peak - equity) / peak) AS dd, avg(pnl / 100000) / stddev_samp(pnl / 100000) * sqrt(252 / 2500) AS ts FROM p GROUP BY symbol),
q AS (SELECT symbol, exit_time AS time, sum(pnl) AS pnl FROM t GROUP BY ALL),
pt AS (SELECT symbol, TIMESTAMP '{START}' AS time, 100000.0::DOUBLE AS equity, 0 AS o FROM t GROUP BY symbol UNION ALL SELECT symbol, time, 100000 + sum(pnl) OVER (PARTITION BY symbol ORDER BY time), 1 FROM q UNION ALL SELECT symbol, TIMESTAMP '{END}', 100000 + sum(pnl), 2 FROM t GROUP BY symbol),
eq AS (SELECT symbol, time, arg_max(equity, o) AS equity FROM pt GROUP BY ALL), d AS (SELECT symbol, CAST(time AS DATE) AS date, arg_max(equity, time) AS equity FROM eq GROUP BY ALL),
a AS (SELECT symbol, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM d GROUP BY symbol), f AS (SELECT symbol, date, last_value(equity IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date) AS equity FROM a LEFT JOIN d USING (symbol, date)),
r AS (SELECT symbol, equity / lag(equity) OVER (PARTITION BY symbol ORDER BY date) - 1 AS ret FROM f), y AS (SELECT symbol, avg(ret) / stddev_samp(ret) * sqrt(252) AS sharpe FROM r GROUP BY symbol)
SELECT s.symbol, round(total, 6) AS total_return_pct, round(ts, 6) AS trade_sharpe_ratio, round(coalesce(sharpe, ts), 6) AS sharpe_ratio, round(total / greatest(dd, 1e-9), 4) AS return_drawdown_ratio FROM s JOIN y USING (symbol)""")
def extended_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = made_trades(spark, sf_dir)
    days = research.sharpe(research.daily_returns(research.equity_curve(t, START, END)))
    out = analytics.extended_metrics(t, days, 2500.0)
    return out.select("symbol", *(F.round(x, 6).alias(x) for x in ("total_return_pct", "trade_sharpe_ratio", "sharpe_ratio")), F.round("return_drawdown_ratio", 4).alias("return_drawdown_ratio"))


WINDOWS = "g AS (SELECT p_brand AS study, p_size % 6 AS win, p_partkey % 4 AS candidate, sum(p_retailprice) - 3000 AS gain, count(*) AS trades FROM part GROUP BY ALL)"


@query(f"WITH {WINDOWS}, r AS (SELECT *, row_number() OVER (PARTITION BY study ORDER BY gain DESC, win, candidate) AS place FROM g WHERE trades >= 1) SELECT study, win, candidate, round(gain, 4) AS gain, CAST(place AS INTEGER) AS place FROM r WHERE place <= 3")
def ranked_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best windows and candidates of each study; ties go to the earlier window and candidate."""
    g = read(spark, sf_dir, "part").groupBy(c("p_brand").alias("study"), (c("p_size") % 6).cast("int").alias("win"), (c("p_partkey") % 4).alias("candidate")).agg((F.sum("p_retailprice") - 3000).alias("gain"), F.count(F.lit(1)).alias("trades")).where("trades >= 1")
    w = Window.partitionBy("study").orderBy(F.desc("gain"), "win", "candidate")
    return g.withColumn("place", F.row_number().over(w)).where("place <= 3").select("study", "win", "candidate", F.round("gain", 4).alias("gain"), "place")


