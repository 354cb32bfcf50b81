"""Trials, populations and the series that research asks for, on the driver's tables, each with the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import importance, research, search
from .evidence import LONG, MATRIX, ic_sql, long, matrix
from .queries import D1, H1, W, daily, hourly, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
c = F.col


def query(sql: str):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A study is a brand, a trial a part; its figures and parameters come from its row."""
    p = read(spark, sf_dir, "part")
    k, size, price = c("p_partkey"), c("p_size"), c("p_retailprice")
    word = F.element_at(F.split("p_type", " "), 1)
    params = F.create_map(F.lit("short_period"), size.cast("string"), F.lit("long_period"), (k % 60).cast("string"), F.lit("short_ma_type"), F.when(k % 9 == 0, F.lower(word)).otherwise("ema"))
    risk = F.create_map(F.lit("type"), F.when(k % 2 == 0, "fixed_safety_margin").otherwise("fixed"), F.lit("min_contracts"), (k % 7).cast("string"), F.lit("max_contracts"), (k % 5 + 2).cast("string"))
    figures = {"total_pnl": price - 1500, "sharpe_ratio": F.when(k % 11 != 0, (price - 1400) / (size + 1)), "max_drawdown_pct": (k % 17) / 17, "return_drawdown_ratio": (price - 1500) / (k % 17 + 1), "total_return_pct": F.round((price - 1500) / 100, 0)}
    out = p.select(c("p_brand").alias("study"), k.alias("trial"), F.when(k % 3 == 0, "MACrossover").otherwise("RSI").alias("strategy"), params.alias("params"), risk.alias("risk"), *(v.alias(n) for n, v in figures.items()))
    return out.withColumn("void", search.void(c("strategy"), c("params"), c("risk")))


TRIALS = """t0 AS (SELECT p_brand AS study, p_partkey AS trial, p_partkey % 3 = 0 AS ma, p_size AS short, p_partkey % 60 AS long, CASE WHEN p_partkey % 9 = 0 THEN lower(string_split(p_type, ' ')[1]) ELSE 'ema' END AS kind, p_partkey % 2 = 0 AS margin, p_partkey % 7 AS mn, p_partkey % 5 + 2 AS mx,
p_retailprice - 1500 AS total_pnl, CASE WHEN p_partkey % 11 <> 0 THEN (p_retailprice - 1400) / (p_size + 1) ELSE 0 END AS sharpe_ratio, (p_partkey % 17) / 17 AS max_drawdown_pct, (p_retailprice - 1500) / (p_partkey % 17 + 1) AS return_drawdown_ratio, round((p_retailprice - 1500) / 100, 0) AS total_return_pct FROM part),
t AS (SELECT *, CASE WHEN ma AND long <= short THEN 'long_period must be greater than short_period' WHEN ma AND kind NOT IN ('sma', 'ema', 'wma', 'smma', 'hma') THEN 'unknown short_ma_type' WHEN margin AND mx < mn THEN 'max_contracts must be >= min_contracts' END AS void FROM t0)"""


@query(f"WITH {TRIALS} SELECT study, trial, void AS reason FROM t WHERE void IS NOT NULL")
def void_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trials that aren't run, and why."""
    return trials(spark, sf_dir).where("void is not null").select("study", "trial", c("void").alias("reason"))


def _best_sql(mode: str) -> str:
    figures = search.MODES[mode]
    order = ", ".join(f"CASE WHEN void IS NULL THEN {n} ELSE '{'-' if more else ''}inf'::DOUBLE END {'DESC' if more else 'ASC'}" for n, more in figures)
    second = f"round(CASE WHEN void IS NULL THEN {figures[1][0]} ELSE 'inf'::DOUBLE END, 6)" if len(figures) > 1 else "NULL::DOUBLE"
    name, more = figures[0]
    return f"SELECT * FROM (SELECT '{mode}' AS mode, study, trial, round(CASE WHEN void IS NULL THEN {name} ELSE '{'-' if more else ''}inf'::DOUBLE END, 6) AS value, {second} AS second FROM t QUALIFY row_number() OVER (PARTITION BY study ORDER BY {order}, trial) = 1)"


@query(f"WITH {TRIALS} " + " UNION ALL ".join(map(_best_sql, search.MODES)))
def best_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each study's best trial by each way to judge trials; void ones count worst."""
    t, out = trials(spark, sf_dir), None
    for mode in search.MODES:
        rows = search.best_trials(t, mode, "study", "trial").select(F.lit(mode).alias("mode"), "study", "trial", F.round(c("objective")[0], 6).alias("value"), F.round(F.get("objective", F.lit(1)), 6).alias("second"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("SELECT p_partkey AS trial, 3 * greatest(p_size, p_partkey % 90, CAST(floor(p_retailprice / 20) AS INTEGER)) AS warmup FROM part")
def warmup_by_trial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars that a trial's parameters need before its first; a deviation's factor is no length."""
    size = c("p_size").cast("double")
    params = F.create_map(F.lit("short_period"), size, F.lit("e0__Lookback_bars"), (c("p_partkey") % 90).cast("double"), F.lit("num_std"), c("p_retailprice"), F.lit("window__num_std"), c("p_retailprice"), F.lit("vol_window"), F.floor(c("p_retailprice") / 20).cast("double"))
    return read(spark, sf_dir, "part").select(c("p_partkey").alias("trial"), search.warmup_bars(params).alias("warmup"))


@query("""WITH s AS (SELECT l_returnflag AS population, l_orderkey AS genome, string_agg(k, ',' ORDER BY k) AS shape FROM (SELECT l_returnflag, l_orderkey, (l_linestatus || l_linenumber % 3) AS k FROM lineitem) GROUP BY ALL)
SELECT population, count(*) AS genomes, count(DISTINCT shape) AS shapes, round(count(DISTINCT shape) / count(*), 6) AS diversity FROM s GROUP BY population""")
def genome_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of different multisets of node kinds in each population; a graph is an order, its nodes the lines."""
    nodes = read(spark, sf_dir, "lineitem").select(c("l_returnflag").alias("population"), c("l_orderkey").alias("genome"), F.concat("l_linestatus", c("l_linenumber") % 3).alias("kind"))
    return search.diversity(nodes, "population", "genome").withColumn("diversity", F.round("diversity", 6))


def parameter_importances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of a trial's parameters decide its objective, by a forest over all trials."""
    p = read(spark, sf_dir, "part").select(c("p_size").alias("short_period"), (c("p_partkey") % 60).alias("long_period"), (c("p_partkey") % 7).alias("threshold"), c("p_retailprice").alias("objective"))
    return importance.importances(p, ["short_period", "long_period", "threshold"], "objective")


QUERIES["parameter_importances"] = parameter_importances
KINDS = {"m5": "ind.momentum", "m10": "ind.momentum", "m21": "ind.momentum", "reach": "ind.ratio"}


@query(f"""WITH {MATRIX}, {LONG.format(source="(SELECT symbol, time, y, m10, m21, m5, reach FROM mx)")}, k AS (SELECT symbol, CASE WHEN feature = 'reach' THEN 'ind.ratio' ELSE 'ind.momentum' END AS kind, max(abs(rank_ic)) AS m FROM {ic_sql("l", "symbol, feature")} GROUP BY ALL)
SELECT symbol, kind, round(1 + 2 * m / max(m) OVER (PARTITION BY symbol), 6) AS weight FROM k""")
def kind_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How likely a search is to draw a node kind, by its features' rank correlations."""
    ics = research.rank_ics(long(matrix(spark, sf_dir)), ["symbol", "feature"])
    kind = F.create_map(*(F.lit(x) for pair in KINDS.items() for x in pair))[c("feature")]
    return search.kind_weights(ics.select("symbol", kind.alias("kind"), c("rank_ic").alias("ic")), "symbol").withColumn("weight", F.round("weight", 6))


@query(f"""WITH {H1}, h AS (SELECT * FROM bars WHERE symbol <> 'error' OR day(time) NOT BETWEEN 8 AND 19), g AS (SELECT symbol, epoch(time) - epoch({"lag(time) OVER " + W}) AS d FROM h), p AS (SELECT symbol, count(*) AS bars, coalesce(max(CASE WHEN d > 14400 THEN d / 86400 END), 0) AS gap FROM g GROUP BY symbol)
SELECT symbol, bars, round(gap, 6) AS max_gap_days, CASE WHEN bars < 200 OR gap > 10 THEN 'inconclusive' ELSE 'ready' END AS verdict, CASE WHEN bars < 200 THEN 'Insufficient bar count (' || bars || ' < 200) for a three-way research split.' WHEN gap > 10 THEN 'Local series continuity break of ' || printf('%.1f', gap) || ' days exceeds 10-day limit.' END AS reason FROM p""")
def data_preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which series research can start from, one of them with a hole of twelve days."""
    rows = hourly(spark, sf_dir).where("symbol <> 'error' or not (day(time) between 8 and 19)")
    out = search.preflight(rows, 3600, min_bars=200, max_gap_days=10.0)
    return out.select("symbol", "bars", F.round("max_gap_days", 6).alias("max_gap_days"), "verdict", "reason")


@query(f"""WITH {D1}, i AS (SELECT symbol, time, row_number() OVER {W} AS i FROM bars), h AS (SELECT a.symbol, z.i - a.i AS n FROM i a JOIN i z ON z.symbol = a.symbol AND z.i = a.i + a.i % 17 + 1)
SELECT symbol, quantile_cont(n, 0.5) AS median_bars, round(quantile_cont(n, 0.9), 6) AS p90_bars FROM h GROUP BY symbol""")
def holding_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many bars trades last: from each bar to one of the next seventeen."""
    df = research.numbered(daily(spark, sf_dir).select("symbol", "time"), F.lit(True), "symbol", "i")
    ends = df.select("symbol", c("i").alias("z"), c("time").alias("exit_time"))
    held = df.select("symbol", c("time").alias("entry_time"), (c("i") + c("i") % 17 + 1).alias("z")).join(ends, ["symbol", "z"]).drop("z")
    return research.holding_periods(held, df).withColumn("p90_bars", F.round("p90_bars", 6))
