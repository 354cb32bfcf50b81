"""Evaluating features, trades and searches: aggregations and windows, and folds by series where order decides."""

from __future__ import annotations

import math
from datetime import datetime, timedelta
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.columns import correlation
from ..sources.scratch import kept
from . import scan

EULER = 0.5772156649015329  # the Euler-Mascheroni constant


# equity and Sharpe
def equity_curve(trades: DataFrame, start: datetime, end: datetime, by: str = "symbol", capital: float = 100_000.0) -> DataFrame:
    """(by, time, equity): the capital at the start, what it is after each exit time, and at the end; of one time's the last counts.

    A trade without an exit time takes no part, and one without a profit adds nothing.
    """
    closed = trades.where("exit_time is not null").select(by, F.col("exit_time").alias("time"), F.coalesce("pnl", F.lit(0.0)).alias("pnl"))
    at = scan.chunked(kept(closed.groupBy(by, "time").agg(F.sum("pnl").alias("pnl"))), by, "time")
    sums = at.groupBy(F.col(by).alias("_by"), F.col("_chunk").alias("_at")).agg(F.sum("pnl").alias("_sum"))
    sums = sums.withColumn("_off", F.sum("_sum").over(W.partitionBy("_by").orderBy("_at").rowsBetween(W.unboundedPreceding, -1)))
    at = at.withColumn("_run", F.sum("pnl").over(scan.within(by, "time").rowsBetween(W.unboundedPreceding, 0)))
    at = at.join(F.broadcast(sums), (F.col("_chunk") == F.col("_at")) & F.col(by).eqNullSafe(F.col("_by")))  # a row for each chunk
    curve = at.select(by, "time", (F.lit(capital) + scan.plus(F.col("_off"), F.col("_run"))).alias("equity"), F.lit(1).alias("_o"))
    kind = trades.schema["exit_time"].dataType
    point = lambda t, equity, o: F.struct(F.lit(t).cast(kind).alias("time"), equity.alias("equity"), F.lit(o).alias("_o"))
    total = trades.groupBy(by).agg((F.lit(capital) + F.coalesce(F.sum(F.when(F.col("exit_time").isNotNull(), F.col("pnl"))), F.lit(0.0))).alias("_t"))
    ends = total.select(by, F.explode(F.array(point(start, F.lit(capital), 0), point(end, F.col("_t"), 2))).alias("p")).select(by, "p.*")
    return curve.unionByName(ends).groupBy(by, "time").agg(F.max_by("equity", "_o").alias("equity"))


def daily_returns(equity: DataFrame, by: str = "symbol") -> DataFrame:
    """Relative change of each calendar day's last equity; days without one carry the day before's."""
    day = equity.groupBy(by, F.to_date("time").alias("date")).agg(F.max_by("equity", "time").alias("equity"))
    all_days = day.groupBy(by).agg(F.explode(F.sequence(F.min("date"), F.max("date"))).alias("date"))
    w = W.partitionBy(by).orderBy("date")
    filled = all_days.join(day, [by, "date"], "left").withColumn("equity", F.last("equity", True).over(w))
    return filled.withColumn("ret", F.try_divide(F.col("equity"), F.lag("equity").over(w)) - 1)


def sharpe(returns: DataFrame, by: str = "symbol", ret: str = "ret") -> DataFrame:
    """Annualised mean over deviation, with the moments that deflating needs; null for fewer than two or equal returns."""
    dev = F.stddev_samp(ret)
    return returns.groupBy(by).agg(F.count(ret).alias("n"), F.when(dev > 0, F.avg(ret) / dev * math.sqrt(252)).alias("sharpe"), F.skewness(ret).alias("skew"), F.kurtosis(ret).alias("excess"))


def expected_max_sharpe(trials: int, sigma: float = 1.0) -> float:
    """The largest Sharpe ratio that so many independent trials without skill are expected to show."""
    if trials < 1:
        raise ValueError("no trials")
    z = NormalDist().inv_cdf
    return 0.0 if trials == 1 else sigma * ((1 - EULER) * z(1 - 1 / trials) + EULER * z(1 - 1 / (trials * math.e)))


def normal_cdf(x: Column) -> Column:
    """The standard normal distribution by its series in odd powers, in Horner's form; 8 deviations off it is 0 or 1 in doubles."""
    z = F.least(F.greatest(x, F.lit(-8.0)), F.lit(8.0))
    total = F.aggregate(F.sequence(F.lit(120), F.lit(1), F.lit(-1)), F.lit(1.0), lambda a, k: a * z * z / (2 * k + 1) + 1)
    return F.when(x.isNotNull(), 0.5 + z * total * F.exp(-z * z / 2) / math.sqrt(2 * math.pi))


def deflated_sharpe(df: DataFrame, trials: int, ratio: str = "sharpe", n: str = "n", skew: str = "skew", kurtosis: str = "excess", variance: float = 1.0) -> DataFrame:
    """`df` with dsr, the probability that the ratio beats the best of `trials` chance results, whose ratios have that variance."""
    s = F.col(ratio)
    spread = 1 - F.col(skew) * s + (F.col(kurtosis) - 1) / 4 * s * s
    z = (s - expected_max_sharpe(trials, math.sqrt(max(variance, 0.0)))) * F.sqrt(F.col(n) - 1) / F.sqrt(F.when(spread > 0, spread))
    return df.withColumn("dsr", F.when(F.col(n) < 2, 0.0).when(spread > 0, normal_cdf(z)).otherwise(F.when(s.isNotNull(), 0.0)))


# features against targets; rows are (by, time, feature, target)
def binned_mutual_information(rows: DataFrame, feature: str, target: str, by: str = "symbol", bins: int = 16) -> DataFrame:
    """Mutual information in nats of two columns cut into bins of equal width. Only bin counts are shuffled."""
    rows = rows.where(F.col(feature).isNotNull() & F.col(target).isNotNull())
    ends = rows.groupBy(by).agg(*(f(c).alias(f"{n}_{c}") for c in (feature, target) for n, f in (("lo", F.min), ("hi", F.max))))

    def cut(c: str) -> Column:
        width = F.col(f"hi_{c}") - F.col(f"lo_{c}")
        return F.when(width > 0, F.least(F.floor((F.col(c) - F.col(f"lo_{c}")) / width * bins), F.lit(bins - 1))).otherwise(bins // 2)

    cells = rows.join(ends, by).groupBy(by, cut(feature).alias("x"), cut(target).alias("y")).agg(F.count(F.lit(1)).alias("c"))
    whole, row, col = (F.sum("c").over(W.partitionBy(by, *k)) for k in ((), ("x",), ("y",)))
    cells = cells.withColumns({"n": whole, "cx": row, "cy": col})
    return cells.groupBy(by).agg(F.sum(F.col("c") / F.col("n") * F.ln(F.col("c") * F.col("n") / (F.col("cx") * F.col("cy")))).alias("mi"))


def time_blocks(rows: DataFrame, blocks: int, by: str = "symbol") -> DataFrame:
    """`rows` with block, from 0: contiguous blocks whose edges are at floor(i * n / blocks)."""
    at, n = F.row_number().over(W.partitionBy(by).orderBy("time")), F.count(F.lit(1)).over(W.partitionBy(by))
    return rows.withColumn("block", (F.ceil(at * blocks / n) - 1).cast("int"))


def stability(ics: DataFrame, by: str = "symbol", ic: str = "rank_ic") -> DataFrame:
    """How little the blocks' rank correlations scatter around their mean, from 0 to 1, and the share of the commoner sign: 0 under two signs."""
    score = 1 - F.stddev_pop(ic) / (F.abs(F.avg(ic)) + 1e-12)
    plus, minus = F.count(F.when(F.col(ic) > 0, 1)), F.count(F.when(F.col(ic) < 0, 1))
    return ics.groupBy(by).agg(F.when(F.count(ic) >= 2, F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0))).alias("stability"), F.when(plus + minus >= 2, F.greatest(plus, minus) / (plus + minus)).otherwise(0.0).alias("sign_consistency"), F.percentile(ic, 0.5).alias("median"), F.stddev_pop(ic).alias("dispersion"))


def numbered(rows: DataFrame, some: Column, by: str, name: str, chunk: str = "month") -> DataFrame:
    """`rows` with `name`: how many rows of the series up to this one have `some`. Rows are counted by chunk, chunks by series."""
    rows = rows.withColumn("_chunk", F.date_trunc(chunk, "time")).withColumn("_some", F.when(some, 1))
    before = W.partitionBy(by).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    sizes = rows.groupBy(by, "_chunk").agg(F.count("_some").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = W.partitionBy(by, "_chunk").orderBy("time").rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("_inside", F.count("_some").over(inside)).join(sizes, [by, "_chunk"]).withColumn(name, F.col("_before") + F.col("_inside")).drop("_chunk", "_some", "_inside", "_before")


#: values that are counted one by one, as a power of two; longer pasts by merging halves
PAST = 6


def regimes(rows: DataFrame, vol: str, n: int = 3, by: str = "symbol") -> DataFrame:
    """`rows` with regime, 0 (calm) to n - 1: the row's place among the quantiles of all volatility up to it.

    Of m values so far, s of them at most the row's own, the i-th quantile is at most the row's value where (s - 1) n >= (m - 1) i. s
    is counted by merging: of values in their order of time, each right half counts how many of its left neighbour's are at
    most its own, half by half; within 64 values one by one. A null has no regime, nor have rows with fewer than n values so far.
    """
    value = F.nanvl(F.col(vol).cast("double"), F.lit(None).cast("double"))
    keep = rows.columns
    rows = numbered(rows.withColumn("_v", value), F.col("_v").isNotNull(), by, "_m")
    at = F.col("_m") - 1
    levels = int((rows.agg(F.max("_m")).first()[0] or 1) - 1 >> PAST).bit_length()
    # rows without a value are in no half; they are spread
    node = lambda k: F.when(F.col("_v").isNotNull(), F.shiftright(at, k)).otherwise(-1 - F.pmod(F.xxhash64("time"), F.lit(997)))
    block = F.collect_list("_v").over(W.partitionBy(by, node(PAST)).orderBy("_m").rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("_s", F.size(F.filter(block, lambda x: x <= F.col("_v"))).cast("long"))
    for k in range(PAST, PAST + levels):
        left = F.shiftright(at, k) % 2 == 0
        counted = F.count(F.when(left & F.col("_v").isNotNull(), 1)).over(W.partitionBy(by, node(k + 1)).orderBy("_v").rangeBetween(W.unboundedPreceding, 0))
        rows = rows.withColumn("_s", F.col("_s") + F.when(left, 0).otherwise(counted))
    cuts = sum(((F.col("_s") - 1) * n >= (F.col("_m") - 1) * i).cast("int") for i in range(1, n))
    return rows.select(*keep, F.when(F.col("_v").isNotNull() & (F.col("_m") >= n), cuts).cast("int").alias("regime"))


def correlations(wide: DataFrame, features: list[str], by: str | None = None) -> DataFrame:
    """(by, a, b, corr): absolute rank correlation of each two features within each `by`, in one aggregation over rows that have all of them."""
    keys = [by] if by else []
    # numbers of rows are other ones once a stage runs again: they are kept
    wide = kept(wide.dropna(subset=features).select(*keys, *features).withColumn("_key", F.monotonically_increasing_id()))
    long = wide.select("_key", *keys, F.explode(F.array(*(F.struct(F.lit(f).alias("f"), F.col(f).cast("double").alias("v")) for f in features))).alias("x")).select("_key", *keys, "x.*")
    counts = long.groupBy(*keys, "f", "v").agg(F.count(F.lit(1)).alias("c"))
    ranks = counts.withColumn("rank", F.sum("c").over(W.partitionBy(*keys, "f").orderBy("v")) - (F.col("c") - 1) / 2)
    ranked = long.join(ranks, [*keys, "f", "v"]).groupBy(*keys, "_key").pivot("f", features).agg(F.first("rank"))
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i + 1 :]]
    one = ranked.groupBy(*keys).agg(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.abs(correlation(a, b)).alias("corr")) for a, b in pairs)).alias("all"))
    return one.select(*keys, F.inline("all"))


def redundancy(corr: DataFrame, features: list[str], threshold: float = 0.9) -> dict[str, str]:
    """Feature to the smallest name in its cluster. A catalogue has some dozens of features: their links fit the driver."""
    head = {f: f for f in features}

    def root(f: str) -> str:
        while head[f] != f:
            f = head[f]
        return f

    for r in corr.where(F.col("corr") >= threshold).select("a", "b").collect():
        x, y = sorted((root(r.a), root(r.b)))
        head[y] = x
    return {f: root(f) for f in features}


def rank_of(value: str, by: list[str]) -> Column:
    """The rank among the rows of `by`; equal values share the mean of their places."""
    return F.rank().over(W.partitionBy(*by).orderBy(value)) + (F.count(F.lit(1)).over(W.partitionBy(*by, value)) - 1) / 2


def rank_ics(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, rank_ic): the rank correlation of x and y in each group."""
    ranked = rows.withColumns({"_rx": rank_of("x", by), "_ry": rank_of("y", by)})
    return ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), correlation("_rx", "_ry").alias("rank_ic"))


def regime_consistency(ics: DataFrame, by: list[str]) -> DataFrame:
    """(by, regime_term): 1 where all regimes' rank correlations agree, 0 where they are 2 apart or fewer than two are known."""
    term = 1 - F.least((F.max("rank_ic") - F.min("rank_ic")) / 2, F.lit(1.0))
    return ics.groupBy(*by).agg(F.when(F.count("rank_ic") >= 2, term).otherwise(0.0).alias("regime_term"))


def clusters(corr: DataFrame, features: list[str], by: str, threshold: float = 0.9) -> DataFrame:
    """(by, feature, cluster): the smallest name that links of at least `threshold` lead to.

    Paths double in length each round. The tables have a row for two features of a key, however many rows were correlated.
    """
    linked = corr.where(F.col("corr") >= threshold)
    alone = corr.select(by).distinct().select(by, F.explode(F.array(*map(F.lit, features))).alias("a")).withColumn("b", F.col("a"))
    reach = alone.unionByName(linked.select(by, "a", "b")).unionByName(linked.select(by, F.col("b").alias("a"), F.col("a").alias("b")))
    for _ in range(max(len(features) - 1, 1).bit_length()):
        reach = reach.select(by, "a", F.col("b").alias("via")).join(reach.select(by, F.col("a").alias("via"), "b"), [by, "via"]).select(by, "a", "b").distinct()
    return reach.groupBy(by, F.col("a").alias("feature")).agg(F.min("b").alias("cluster"))


def permutation_null(rows: DataFrame, by: list[str], permutations: int = 20, block: int = 20) -> DataFrame:
    """(by, n, rank_ic, null_mean, null_std): the rank correlation, and median and deviation of its size once x is dealt anew by blocks.

    Blocks are ordered by a hash of key, permutation and number, so that any run deals alike; rows behind the last
    whole block stay. Ranks stay too: a permutation only adds up the products of blocks of ranks that meet.
    """
    ranked = rows.withColumns({"rx": rank_of("x", by), "ry": rank_of("y", by), "i": F.row_number().over(W.partitionBy(*by).orderBy("time")) - 1})
    ranked = ranked.withColumn("block", F.floor(F.col("i") / block))
    cells = F.array_sort(F.collect_list(F.struct("i", "rx", "ry")))
    blocks = ranked.groupBy(*by, "block").agg(cells.alias("v"), (F.count(F.lit(1)) == block).alias("full"))
    figures = ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), correlation("rx", "ry").alias("rank_ic"), F.avg("rx").alias("mx"), F.avg("ry").alias("my"), (F.stddev_pop("rx") * F.stddev_pop("ry")).alias("dev"))
    dealt = blocks.select(*by, "block", "full", F.col("v.rx").alias("xs"), F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))).alias("p"))
    order = W.partitionBy(*by, "p", "full").orderBy(F.md5(F.concat_ws(":", *by, "p", "block")))
    dealt = dealt.withColumn("place", F.when(F.col("full"), F.row_number().over(order) - 1).otherwise(F.col("block")))
    met = dealt.drop("block").join(blocks.select(*by, F.col("block").alias("place"), F.col("v.ry").alias("ys")), [*by, "place"])
    products = F.aggregate(F.zip_with("xs", "ys", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    sums = met.groupBy(*by, "p").agg(F.sum(products).alias("total")).join(figures, by)
    sums = sums.withColumn("ic", F.abs((F.col("total") / F.col("n") - F.col("mx") * F.col("my")) / F.nullif("dev", F.lit(0.0))))
    return sums.groupBy(*by).agg(F.first("n").alias("n"), F.first("rank_ic").alias("rank_ic"), F.percentile("ic", 0.5).alias("null_mean"), F.stddev_pop("ic").alias("null_std"))


def deflated_ic(df: DataFrame, trials: int) -> DataFrame:
    """`df` of permutation_null with null_floor, what the best of `trials` chance features is expected to show, and deflated, the probability of beating it."""
    best, root = expected_max_sharpe(trials), F.sqrt(F.greatest(F.col("n"), F.lit(2)))
    floor = F.when(F.col("n") >= 4, F.col("null_mean") + best * F.when(F.col("null_std") > 0, F.col("null_std")).otherwise(1 / root))
    over = F.abs("rank_ic") - F.coalesce(F.col("null_floor"), F.lit(0.0)) - best / root
    return df.withColumn("null_floor", floor).withColumn("deflated", F.when(over > 0, normal_cdf(over * F.sqrt(F.col("n") - 1))).otherwise(0.0))


def plateau(cells: DataFrame, by: str, parameters: list[str], objective: str) -> DataFrame:
    """(by, champion, neighbours, profitable_fraction, score_retention) of each best cell and those one step off in one parameter.

    Ties go to the smaller parameters. One champion for each `by` meets that key's cells.
    """
    first = F.max_by(F.struct(*parameters, objective), F.struct(F.col(objective), *(-F.col(x) for x in parameters)))
    champion = cells.groupBy(by).agg(first.alias("_c"))
    steps = sum((F.abs(F.col(x) - F.col(f"_c.{x}")) for x in parameters), F.lit(0))
    near = F.when(steps == 1, F.col(objective))
    out = cells.join(champion, by).groupBy(by).agg(F.first(f"_c.{objective}").alias("champion"), F.count(near).alias("neighbours"), F.avg((near > 0).cast("int")).alias("profitable_fraction"), F.percentile(near, 0.5).alias("_median"))
    return out.withColumn("score_retention", F.when(F.col("champion") > 0, F.col("_median") / F.col("champion"))).drop("_median")


def verdict(criteria: list[tuple[str, Column]]) -> tuple[Column, Column]:
    """(verdict, names not passed) of conditions, null where unavailable: that makes it inconclusive, otherwise a failure rejects."""
    missing = F.array_compact(F.array(*(F.when(ok.isNull(), name) for name, ok in criteria)))
    failed = F.array_compact(F.array(*(F.when(~ok, name) for name, ok in criteria)))
    return F.when(F.size(missing) > 0, "inconclusive").when(F.size(failed) > 0, "rejected").otherwise("ready_for_paper"), F.when(F.size(missing) > 0, missing).otherwise(failed)


def feature_score(rank_ic: Column, stable: Column, regime: Column, cluster_size: Column, clean: Column) -> Column:
    z = lambda x: F.coalesce(x, F.lit(0.0))
    raw = 0.4 * F.abs(z(rank_ic)) + 0.3 * z(stable) + 0.15 * z(regime) + 0.15 / F.greatest(cluster_size, F.lit(1))
    return F.least(F.greatest(raw * F.when(clean, 1.0).otherwise(0.5), F.lit(0.0)), F.lit(1.0))


def admission(n: Column, folds: Column, rank_ic: Column, sign: Column, dispersion: Column, least: dict[str, float]) -> tuple[Column, Column]:
    """(decision, reasons): too little data is inconclusive; otherwise any reason rejects."""
    reasons = F.array_compact(F.array(
        F.when(rank_ic.isNull() | (F.abs(rank_ic) < least["rank_ic"]), "weak_rank_ic"), F.when(sign < least["sign"], "unstable_sign"), F.when(dispersion > least["dispersion"], "high_dispersion")))
    thin = F.array_compact(F.array(F.when(n < least["n"], "insufficient_observations"), F.when(folds < least["folds"], "insufficient_folds")))
    decision = F.when(F.size(thin) > 0, "inconclusive").when(F.size(reasons) > 0, "rejected").otherwise("admitted")
    return decision, F.when(F.size(thin) > 0, thin).otherwise(reasons)


def split_segments(rows: DataFrame, evidence: float = 0.4, forward: float = 0.4, by: str = "symbol") -> DataFrame:
    """`rows` with segment: evidence, walkforward and lockbox by row counts, one after the other in time."""
    at, n = F.row_number().over(W.partitionBy(by).orderBy("time")), F.count(F.lit(1)).over(W.partitionBy(by))
    return rows.withColumn("segment", F.when(at <= F.floor(n * evidence), "evidence").when(at <= F.floor(n * (evidence + forward)), "walkforward").otherwise("lockbox"))


def purge(rows: DataFrame, embargo: int, by: str = "symbol") -> DataFrame:
    """Rows with `segment`, without the `embargo` rows on each side of a change of segment."""
    w = W.partitionBy(by).orderBy("time")
    near = [F.lag("segment", k).over(w) for k in range(1, embargo + 1)] + [F.lead("segment", k).over(w) for k in range(1, embargo + 1)]
    other = sum((F.coalesce((x != F.col("segment")).cast("int"), F.lit(0)) for x in near), F.lit(0))
    return rows.withColumn("_other", other).where("_other = 0").drop("_other")


# walk-forward and search
def split_windows(start: datetime, end: datetime, train_days: int, test_days: int, anchored: bool = False, least: int = 1) -> list[dict]:
    """Half-open train and test ranges; the last test is cut at the end and dropped if it is under a day."""
    out, day = [], timedelta(days=1)
    for i in range(max(0, (end - start).days // test_days + 1)):
        opens = start + timedelta(days=train_days + i * test_days)
        closes = min(opens + timedelta(days=test_days), end)
        if closes - opens < day:
            break
        out.append({"window": i, "train_start": start if anchored else opens - timedelta(days=train_days), "test_start": opens, "test_end": closes})
    if len(out) < least:
        raise ValueError(f"only {len(out)} windows")
    return out


def in_windows(bars: DataFrame, windows: list[dict]) -> DataFrame:
    """Bars, once for each window that holds them, with window and part (train or test). The windows are literals: no join."""
    t = F.col("time")
    held = [F.when((t >= F.lit(w["train_start"])) & (t < F.lit(w["test_end"])), F.struct(F.lit(w["window"]).alias("window"), F.when(t < F.lit(w["test_start"]), "train").otherwise("test").alias("part"))) for w in windows]
    return bars.withColumn("_w", F.explode(F.array_compact(F.array(*held)))).select(*bars.columns, "_w.window", "_w.part")


def walk_forward(results: DataFrame, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """The best candidate of each window by train objective, with its test figures.

    `results` has (by, window, candidate, part, trades, objective). Ties go to the smaller candidate.
    """
    part = lambda p, c: F.max(F.when(F.col("part") == p, F.col(c)))
    cell = results.groupBy(*by, "window", "candidate").agg(part("train", "objective").alias("is_objective"), part("test", "objective").alias("oos_objective"), F.coalesce(part("test", "trades"), F.lit(0)).alias("oos_trades"))
    best = F.max_by(F.struct("candidate", "is_objective", "oos_objective", "oos_trades"), F.struct("is_objective", -F.col("candidate")))
    return cell.where("is_objective is not null").groupBy(*by, "window").agg(best.alias("b")).select(*by, "window", "b.*")


def gates(best: DataFrame, by: tuple[str, ...] = ("symbol",), min_windows: int = 3, min_trades: int = 10, low: float = 0.5, high: float = 2.0) -> DataFrame:
    """Efficiency (test objective over the mean train objective) and the flags that reject a walk-forward run."""
    out = best.groupBy(*by).agg(F.count("window").alias("windows"), F.sum("oos_trades").alias("oos_trades"), F.avg("is_objective").alias("mean_is"), F.sum("oos_objective").alias("oos"))
    out = out.withColumn("efficiency", F.try_divide(F.col("oos"), F.nullif(F.col("mean_is"), F.lit(0.0))))
    win, gain = F.col("mean_is") > 0, F.col("oos") > 0
    flags = F.array_compact(F.array(
        F.when(F.col("windows") < min_windows, "few_windows"), F.when(F.col("oos_trades") < min_trades, "few_oos_trades"),
        F.when(win & (~gain | (F.col("efficiency") < low)), "low_efficiency"), F.when(win & gain & (F.col("efficiency") > high), "suspicious_efficiency")))
    return out.withColumn("flags", flags).withColumn("passed", F.size("flags") == 0)


def pareto_front(trials: DataFrame, up: str, down: str, by: str = "study") -> DataFrame:
    """Trials that none beats in `up` (more is better) and `down` (less is better). One sort by study, no pairs."""
    w = W.partitionBy(by).orderBy(F.desc(up))
    levels = trials.groupBy(by, up).agg(F.min(down).alias("_own")).withColumn("_least", F.min("_own").over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("_better", F.lag("_least").over(w))
    return trials.join(levels.select(by, up, "_own", "_better"), [by, up]).where(F.col(down) == F.col("_own")).where(F.col("_better").isNull() | (F.col("_own") < F.col("_better"))).drop("_own", "_better")


def tail_diagnostics(windows: DataFrame, by: str = "symbol") -> DataFrame:
    """Worst and 25 % window return, longest run of windows without gain, largest share of the trades."""
    w = W.partitionBy(by).orderBy("window")
    runs = windows.withColumn("_wins", F.sum((F.col("ret") > 0).cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    streak = runs.groupBy(by, "_wins").agg(F.count(F.when(F.col("ret") <= 0, 1)).alias("n")).groupBy(by).agg(F.max("n").alias("losing_streak"))
    return windows.groupBy(by).agg(F.min("ret").alias("worst"), F.percentile("ret", 0.25).alias("p25"), F.try_divide(F.max("trades"), F.sum("trades")).alias("concentration")).join(streak, by)


def holding_periods(trades: DataFrame, bars: DataFrame, by: str = "symbol") -> DataFrame:
    """Median and 90 % of the bars between entry and exit."""
    at = bars.select(by, "time", F.row_number().over(W.partitionBy(by).orderBy("time")).alias("i"))
    held = trades.join(at.select(by, F.col("time").alias("entry_time"), F.col("i").alias("a")), [by, "entry_time"]).join(at.select(by, F.col("time").alias("exit_time"), F.col("i").alias("z")), [by, "exit_time"])
    return held.groupBy(by).agg(F.percentile(F.col("z") - F.col("a"), 0.5).alias("median_bars"), F.percentile(F.col("z") - F.col("a"), 0.9).alias("p90_bars"))


def newey_west(x: Column, n: int, lags: int, frame: W) -> Column:
    """t statistic of the last n values' mean with Bartlett-weighted autocovariances; 0 where there is no variance."""
    values = F.collect_list(F.coalesce(x, F.lit(0.0))).over(frame)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    mean = total(values) / n
    off = F.transform(values, lambda v: v - mean)
    cov = lambda j: total(F.zip_with(F.slice(off, j + 1, n - j), F.slice(off, 1, n - j), lambda p, q: p * q)) / n
    s = cov(0) + sum((2 * (1 - j / (lags + 1)) * cov(j) for j in range(1, lags + 1)), F.lit(0.0))
    return F.when(F.size(values) == n, F.when(s > 1e-12, mean / F.sqrt(s / n)).otherwise(0.0))


def pca_encoder(wide: DataFrame, features: list[str], k: int, holdout: float = 0.2):
    """(model, encoded): standardised principal components fitted on the earliest 1 - `holdout` of the rows.

    Rows with a missing feature take no part in fitting and get no components.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler

    whole = wide.dropna(subset=features)
    cut = whole.select(F.percentile_approx(F.unix_timestamp("time"), 1 - holdout).alias("t")).first()["t"]
    stages = [VectorAssembler(inputCols=features, outputCol="_v"), StandardScaler(withMean=True, inputCol="_v", outputCol="_s"), PCA(k=k, inputCol="_s", outputCol="latent")]
    model = Pipeline(stages=stages).fit(whole.where(F.unix_timestamp("time") <= cut))
    return model, model.transform(whole).drop("_v", "_s")
