"""Searches over strategies: what a trial is worth, which trials are void, how alike a population is, what a series must have first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: mode -> the figures that it goes by, each with whether more is better
MODES: dict[str, tuple[tuple[str, bool], ...]] = {
    "maximize_net_profit": (("total_pnl", True),),
    "maximize_sharpe": (("sharpe_ratio", True),),
    "minimize_drawdown": (("max_drawdown_pct", False),),
    "maximize_return_drawdown": (("return_drawdown_ratio", True),),
    "multi_objective_return_drawdown": (("total_return_pct", True), ("max_drawdown_pct", False)),
}
MOVING_AVERAGES = ("sma", "ema", "wma", "smma", "hma")
#: values of parameters with these in their names are lengths in bars; recursive averages need so many times the longest
LENGTHS, TIMES = ("period", "lookback", "window"), 3
#: fixed values: how much a kind's correlation adds to its weight; the bars and days of a series that research needs
ALPHA, MIN_BARS, MAX_GAP_DAYS = 2.0, 120, 31.0


def objective(mode: str) -> Column:
    """The mode's figures of a row, as an array; a missing one is 0."""
    if mode not in MODES:
        raise ValueError(f"no such mode: {mode}")
    return F.array(*(F.coalesce(F.col(name).cast("double"), F.lit(0.0)) for name, _ in MODES[mode]))


def worst(mode: str) -> list[float]:
    """What a void trial counts."""
    return [float("-inf") if more else float("inf") for _, more in MODES[mode]]


def best_trials(trials: DataFrame, mode: str, by: str, trial: str) -> DataFrame:
    """(by, trial, objective) of each key's best by the mode's figures, one after the other; a trial with a `void` counts its worst. Ties go to the smaller trial."""
    value = F.when(F.col("void").isNotNull(), F.array(*map(F.lit, worst(mode)))).otherwise(objective(mode)) if "void" in trials.columns else objective(mode)
    rows = trials.withColumn("_o", value)
    order = [F.desc(F.col("_o")[i]) if more else F.asc(F.col("_o")[i]) for i, (_, more) in enumerate(MODES[mode])]
    first = rows.withColumn("_r", F.row_number().over(W.partitionBy(by).orderBy(*order, trial))).where("_r = 1")
    return first.select(by, trial, F.col("_o").alias("objective"))


def void(strategy: Column, params: Column, risk: Column) -> Column:
    """Why a trial isn't run, or null: crossing averages whose long one isn't longer or whose kinds are unknown, contract limits that cross.

    `params` and `risk` are maps of strings. A number that is missing fails no check.
    """
    number = lambda m, k: F.try_element_at(m, F.lit(k)).cast("int")
    known = lambda k: F.coalesce(F.lower(F.trim(F.try_element_at(params, F.lit(k)))).isin(*MOVING_AVERAGES), F.lit(True))
    crossing = strategy == "MACrossover"
    margin = F.try_element_at(risk, F.lit("type")) == "fixed_safety_margin"
    return (F.when(crossing & (number(params, "long_period") <= number(params, "short_period")), "long_period must be greater than short_period")
            .when(crossing & ~known("short_ma_type"), "unknown short_ma_type").when(crossing & ~known("long_ma_type"), "unknown long_ma_type")
            .when(margin & (number(risk, "max_contracts") < number(risk, "min_contracts")), "max_contracts must be >= min_contracts"))


def warmup_bars(params: Column) -> Column:
    """Of a map of numbers: what the longest length among them needs. What a name has up to its first __ doesn't count."""
    name = lambda k: F.lower(F.regexp_replace(k, "^.*?__", ""))
    lengths = F.map_values(F.map_filter(params, lambda k, v: name(k).rlike("|".join(LENGTHS))))
    return F.coalesce(F.array_max(F.transform(lengths, lambda v: v.cast("int"))), F.lit(0)) * TIMES


def diversity(nodes: DataFrame, by: str, genome: str, kind: str = "kind") -> DataFrame:
    """(by, genomes, shapes, diversity): the share of different shapes, a graph's shape being its node kinds with their counts.

    Counted by graph and kind before kinds are gathered, a graph's kinds being few; shapes go on as digests.
    """
    counts = nodes.groupBy(by, genome, kind).agg(F.count(F.lit(1)).alias("_n"))
    shape = counts.groupBy(by, genome).agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct(kind, "_n")))), 256).alias("_shape"))
    return shape.groupBy(by).agg(F.count(F.lit(1)).alias("genomes"), F.countDistinct("_shape").alias("shapes")).withColumn("diversity", F.col("shapes") / F.col("genomes"))


def kind_weights(scores: DataFrame, by: str, kind: str = "kind", ic: str = "ic") -> DataFrame:
    """(by, kind, weight): 1 and more by how large a kind's largest correlation is beside the key's largest. None where all are 0 or unknown."""
    most = scores.where(F.col(ic).isNotNull() & ~F.isnan(ic)).groupBy(by, kind).agg(F.max(F.abs(ic)).alias("_m"))
    peak = most.groupBy(by).agg(F.max("_m").alias("_peak")).where("_peak > 0")
    return most.join(peak, by).select(by, kind, (1 + ALPHA * F.col("_m") / F.col("_peak")).alias("weight"))


def preflight(bars: DataFrame, seconds: int, by: str = "symbol", min_bars: int = MIN_BARS, max_gap_days: float = MAX_GAP_DAYS) -> DataFrame:
    """(by, bars, max_gap_days, verdict, reason): is there enough of a series, without a break? Distances of up to four bars are none."""
    at = F.unix_timestamp("time")
    far = at - F.lag(at).over(W.partitionBy(by).orderBy("time"))
    rows = bars.select(by, F.when(far > 4 * seconds, far / 86_400).alias("_gap"))
    out = rows.groupBy(by).agg(F.count(F.lit(1)).alias("bars"), F.coalesce(F.max("_gap"), F.lit(0.0)).alias("max_gap_days"))
    reason = F.when(F.col("bars") < min_bars, F.format_string(f"Insufficient bar count (%d < {min_bars}) for a three-way research split.", "bars")).when(F.col("max_gap_days") > max_gap_days, F.format_string(f"Local series continuity break of %.1f days exceeds {max_gap_days:g}-day limit.", "max_gap_days"))
    return out.withColumn("reason", reason).withColumn("verdict", F.when(F.col("reason").isNull(), "ready").otherwise("inconclusive"))
