"""What features and candidates are held to: regimes, clusters, permuted blocks, plateaus and verdicts, each with the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import columns as C
from ..operators import bars, causality, information, research
from . import catalogue
from .desk import WINDOWS
from .queries import D1, H1, W, daily, full, hourly, lagged, over, read
from .studies import CDF

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
c = F.col
KEYS = ["symbol", "feature"]
FEATURES = ["m10", "m21", "m5", "reach"]


def query(sql: str):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


MATRIX = f"""{D1}, f AS (SELECT symbol, time, close, {", ".join(f"close / nullif({lagged('close', n)}, 0) - 1 AS m{n}" for n in (5, 10, 21))}, high / nullif(low, 0) - 1 AS reach, lead(close, 5) OVER {W} / nullif(close, 0) - 1 AS y FROM bars),
mx AS (SELECT * FROM f WHERE m5 IS NOT NULL AND m10 IS NOT NULL AND m21 IS NOT NULL AND reach IS NOT NULL AND y IS NOT NULL)"""
LONG = "l AS (UNPIVOT {source} ON m10, m21, m5, reach INTO NAME feature VALUE x)"


def corr(a: str, b: str) -> str:
    return f"covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0)"


def ic_sql(source: str, keys: str) -> str:
    rank = lambda v: f"rank() OVER (PARTITION BY {keys} ORDER BY {v}) + (count(*) OVER (PARTITION BY {keys}, {v}) - 1) / 2"
    return f"(SELECT {keys}, count(*) AS n, {corr("rx", "ry")} AS rank_ic FROM (SELECT *, {rank('x')} AS rx, {rank('y')} AS ry FROM {source}) GROUP BY {keys})"


def features(df: DataFrame) -> DataFrame:
    return df.withColumns({f"m{n}": C.momentum(c("close"), n) for n in (5, 10, 21)} | {"reach": C.ratio(c("high"), c("low"))})


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, time, close, features, y): rows that have all features and the target."""
    made = features(daily(spark, sf_dir)).withColumn("y", C.forward_return(c("close"), 5))
    return made.select("symbol", "time", "close", "m5", "m10", "m21", "reach", "y").dropna(subset=[*FEATURES, "y"])


def long(rows: DataFrame, *more: str) -> DataFrame:
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), c(f).alias("x")) for f in FEATURES)))
    return rows.select("symbol", "time", "y", *more, each.alias("e")).select("symbol", "time", "y", *more, "e.*")


REGIMES = f"""{MATRIX}, v AS (SELECT *, {full("r", 21, "stddev_samp(r)")} AS vol FROM (SELECT *, ln(close / {lagged("close")}) AS r FROM mx)),
q AS (SELECT *, count(vol) OVER w AS nv, quantile_cont(vol, 1/3) OVER w AS qa, quantile_cont(vol, 2/3) OVER w AS qb FROM v WINDOW w AS (PARTITION BY symbol ORDER BY time ROWS UNBOUNDED PRECEDING)),
g AS (SELECT *, CASE WHEN vol IS NULL OR nv < 3 THEN NULL ELSE CAST(vol >= qa AS INTEGER) + CAST(vol >= qb AS INTEGER) END AS regime, ceil(row_number() OVER {W} * 5 / count(*) OVER (PARTITION BY symbol)) - 1 AS block FROM q),
{LONG.format(source="(SELECT symbol, time, regime, block, y, m10, m21, m5, reach FROM g)")}, ri AS {ic_sql("(SELECT * FROM l WHERE regime IS NOT NULL)", "symbol, feature, regime")}"""


def with_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = matrix(spark, sf_dir).withColumn("r", C.log_return(c("close")))
    return research.regimes(rows.withColumn("vol", C.rolling_std(c("r"), 21)).drop("r"), "vol")


@query(f"WITH {REGIMES} SELECT symbol, feature, regime, n, round(rank_ic, 6) AS rank_ic FROM ri")
def regime_ics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each feature's rank correlation with the target in calm, middle and wild bars."""
    out = research.rank_ics(long(with_regimes(spark, sf_dir), "regime").where("regime is not null"), [*KEYS, "regime"])
    return out.select(*KEYS, "regime", "n", F.round("rank_ic", 6).alias("rank_ic"))


@query(f"""WITH RECURSIVE {REGIMES}, t AS (SELECT symbol, feature, CASE WHEN count(rank_ic) >= 2 THEN 1 - least((max(rank_ic) - min(rank_ic)) / 2, 1) ELSE 0 END AS term FROM ri GROUP BY ALL),
bi AS {ic_sql("l", "symbol, feature, block")}, st AS (SELECT symbol, feature, sum(n) AS n, count(rank_ic) AS folds, least(greatest(1 - stddev_pop(rank_ic) / (abs(avg(rank_ic)) + 1e-12), 0), 1) AS stability, greatest(count(*) FILTER (rank_ic > 0), count(*) FILTER (rank_ic < 0)) / (count(*) FILTER (rank_ic > 0) + count(*) FILTER (rank_ic < 0)) AS sign, stddev_pop(rank_ic) AS dispersion FROM bi GROUP BY ALL),
wi AS {ic_sql("l", "symbol, feature")}, k AS (SELECT *, rank() OVER (PARTITION BY symbol, feature ORDER BY x) + (count(*) OVER (PARTITION BY symbol, feature, x) - 1) / 2 AS k FROM l),
co AS (SELECT p.symbol, p.feature AS a, q.feature AS b FROM k p JOIN k q USING (symbol, time) GROUP BY ALL HAVING abs({corr("p.k", "q.k")}) >= 0.5),
reach AS (SELECT symbol, a, b FROM co UNION SELECT h.symbol, h.a, co.b FROM reach h JOIN co ON h.symbol = co.symbol AND h.b = co.a),
cl AS (SELECT symbol, a AS feature, min(b) AS cluster, count(*) AS size FROM reach GROUP BY ALL),
sc AS (SELECT symbol, feature, cluster, n, folds, rank_ic, sign, dispersion, least(greatest(0.4 * abs(coalesce(rank_ic, 0)) + 0.3 * coalesce(stability, 0) + 0.15 * term + 0.15 / size, 0), 1) AS score FROM st JOIN (SELECT symbol, feature, rank_ic FROM wi) USING (symbol, feature) JOIN t USING (symbol, feature) JOIN cl USING (symbol, feature)),
rp AS (SELECT *, row_number() OVER (PARTITION BY symbol, cluster ORDER BY score DESC, feature) = 1 AS representative FROM sc),
ad AS (SELECT *, CASE WHEN n < 100 OR folds < 5 THEN 'inconclusive' WHEN rank_ic IS NULL OR abs(rank_ic) < 0.02 OR sign < 0.6 OR dispersion > 0.3 THEN 'rejected' WHEN NOT representative THEN 'redundant' ELSE 'admitted' END AS d FROM rp)
SELECT symbol, feature, cluster, round(score, 6) AS score, representative, CASE WHEN d = 'redundant' THEN 'rejected' ELSE d END AS decision,
CASE d WHEN 'inconclusive' THEN concat_ws(',', CASE WHEN n < 100 THEN 'insufficient_observations' END, CASE WHEN folds < 5 THEN 'insufficient_folds' END) WHEN 'redundant' THEN 'redundant_non_representative' ELSE concat_ws(',', CASE WHEN rank_ic IS NULL OR abs(rank_ic) < 0.02 THEN 'weak_rank_ic' END, CASE WHEN sign < 0.6 THEN 'unstable_sign' END, CASE WHEN dispersion > 0.3 THEN 'high_dispersion' END) END AS reasons,
CASE WHEN representative THEN CAST(row_number() OVER (PARTITION BY symbol, representative ORDER BY score DESC, feature) AS INTEGER) END AS recommended FROM ad""")
def feature_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features scored by rank correlation, stability, regimes and cluster; the best of a cluster represents it and may be admitted.

    `recommended` is a representative's place among those of its symbol.
    """
    rows = with_regimes(spark, sf_dir)
    blocks = research.rank_ics(long(research.time_blocks(rows, 5), "block"), [*KEYS, "block"])
    key = F.concat_ws("|", *KEYS).alias("key")
    stable = research.stability(blocks.select(key, "rank_ic"), "key")
    seen = blocks.groupBy(*KEYS).agg(F.sum("n").alias("n"), F.count("rank_ic").alias("folds")).withColumn("key", key)
    terms = research.regime_consistency(research.rank_ics(long(rows, "regime").where("regime is not null"), [*KEYS, "regime"]), KEYS)
    groups = research.clusters(research.correlations(rows, FEATURES, "symbol"), FEATURES, "symbol", 0.5)
    groups = groups.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("symbol", "cluster")))
    out = seen.join(stable, "key").join(research.rank_ics(long(rows), KEYS).drop("n"), KEYS).join(terms, KEYS, "left").join(groups, KEYS)
    clean = causality.status(causality.check(daily(spark, sf_dir), features, FEATURES, (30, 300))).select("feature", (c("status") == "clean").alias("clean"))
    out = out.join(F.broadcast(clean), "feature")  # a row a feature
    out = out.withColumn("score", research.feature_score(c("rank_ic"), c("stability"), c("regime_term"), c("size"), c("clean")))
    best = Window.partitionBy("symbol", "cluster").orderBy(F.desc("score"), "feature")
    out = out.withColumn("representative", F.row_number().over(best) == 1)
    decision, reasons = research.admission(c("n"), c("folds"), c("rank_ic"), c("sign_consistency"), c("dispersion"), {"n": 100, "folds": 5, "rank_ic": 0.02, "sign": 0.6, "dispersion": 0.3})
    out = out.withColumns({"d": decision, "why": F.concat_ws(",", reasons)})
    surplus = (c("d") == "admitted") & ~c("representative")
    place = F.row_number().over(Window.partitionBy("symbol", "representative").orderBy(F.desc("score"), "feature"))
    return out.select(*KEYS, "cluster", F.round("score", 6).alias("score"), "representative", F.when(surplus, "rejected").otherwise(c("d")).alias("decision"), F.when(surplus, "redundant_non_representative").otherwise(c("why")).alias("reasons"), F.when(c("representative"), place).alias("recommended"))


best = research.expected_max_sharpe(10)


@query(f"""WITH {MATRIX}, {LONG.format(source="(SELECT symbol, time, y, m10, m21, m5, reach FROM mx)")},
r AS (SELECT symbol, feature, rank() OVER (PARTITION BY symbol, feature ORDER BY x) + (count(*) OVER (PARTITION BY symbol, feature, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY symbol, feature ORDER BY y) + (count(*) OVER (PARTITION BY symbol, feature, y) - 1) / 2 AS ry, row_number() OVER (PARTITION BY symbol, feature ORDER BY time) - 1 AS i, count(*) OVER (PARTITION BY symbol, feature) AS n FROM l),
b AS (SELECT DISTINCT symbol, feature, i // 20 AS block FROM r WHERE i // 20 < n // 20), o AS (SELECT symbol, feature, p, block, row_number() OVER (PARTITION BY symbol, feature, p ORDER BY md5(symbol || ':' || feature || ':' || p || ':' || block)) - 1 AS place FROM b, range(20) t(p)),
s AS (SELECT r.symbol, r.feature, q.p, r.rx, coalesce(o.place * 20 + i % 20, i) AS at FROM r CROSS JOIN range(20) q(p) LEFT JOIN o ON o.symbol = r.symbol AND o.feature = r.feature AND o.p = q.p AND o.block = r.i // 20),
e AS (SELECT s.symbol, s.feature, p, abs({corr("s.rx", "r.ry")}) AS ic FROM s JOIN r ON s.symbol = r.symbol AND s.feature = r.feature AND s.at = r.i GROUP BY ALL), z AS (SELECT symbol, feature, median(ic) AS m, stddev_pop(ic) AS d FROM e GROUP BY ALL),
w AS (SELECT symbol, feature, count(*) AS n, {corr("rx", "ry")} AS ic FROM r GROUP BY ALL), u AS (SELECT symbol, feature, n, ic, CASE WHEN n >= 4 THEN m + {best!r} * CASE WHEN d > 0 THEN d ELSE 1 / sqrt(greatest(n, 2)) END END AS fl FROM w JOIN z USING (symbol, feature)),
x AS (SELECT *, abs(ic) - coalesce(fl, 0) - {best!r} / sqrt(greatest(n, 2)) AS over FROM u), y AS (SELECT *, CASE WHEN over > 0 THEN least(over * sqrt(n - 1), 8) END AS c FROM x)
SELECT symbol, feature, n, round(ic, 6) AS rank_ic, round(fl, 6) AS null_floor, round(CASE WHEN c IS NULL THEN 0 ELSE {CDF} END, 6) AS deflated FROM y""")
def permutation_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What chance shows: rank correlations once blocks of 20 bars are dealt anew, and the probability of beating the best of ten such features."""
    out = research.deflated_ic(research.permutation_null(long(matrix(spark, sf_dir)), KEYS), 10)
    return out.select(*KEYS, "n", *(F.round(x, 6).alias(x) for x in ("rank_ic", "null_floor", "deflated")))


NEIGHBOURS = f"""{MATRIX}, {LONG.format(source="(SELECT symbol, time, y, m10, m21, m5, reach FROM mx)")},
z AS (SELECT symbol, feature, time, x / CASE WHEN stddev_pop(x) OVER g > 0 THEN stddev_pop(x) OVER g ELSE 1 END AS x, y / CASE WHEN stddev_pop(y) OVER g > 0 THEN stddev_pop(y) OVER g ELSE 1 END AS y FROM l WINDOW g AS (PARTITION BY symbol, feature)),
p AS (SELECT a.symbol, a.feature, a.time, abs(a.x - b.x) AS dx, abs(a.y - b.y) AS dy, greatest(abs(a.x - b.x), abs(a.y - b.y)) AS d FROM z a JOIN z b ON a.symbol = b.symbol AND a.feature = b.feature AND a.time <> b.time),
r AS (SELECT symbol, feature, time, list_sort(min(d, 3))[3] AS r FROM p GROUP BY ALL),
c AS (SELECT symbol, feature, time, count(*) FILTER (dx < r OR dx = 0) AS nx, count(*) FILTER (dy < r OR dy = 0) AS ny FROM p JOIN r USING (symbol, feature, time) GROUP BY ALL),
h AS (SELECT m, sum(1.0::DOUBLE / m) OVER (ORDER BY m) - 1.0::DOUBLE / m - {research.EULER!r} AS psi FROM range(1, 20000) t(m)), n AS (SELECT symbol, feature, count(*) AS n FROM c GROUP BY ALL)"""


@query(f"""WITH {NEIGHBOURS} SELECT symbol, feature, any_value(n.n) AS n, round(greatest(any_value(hn.psi) + 1.5 - {research.EULER!r} - avg(hx.psi + hy.psi), 0), 6) AS mutual_info
FROM c JOIN n USING (symbol, feature) JOIN h hn ON hn.m = n.n JOIN h hx ON hx.m = nx + 1 JOIN h hy ON hy.m = ny + 1 GROUP BY symbol, feature""")
def mutual_information_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each feature's mutual information with the target, from three nearest neighbours."""
    out = information.mutual_information(long(matrix(spark, sf_dir)), "x", "y", KEYS)
    return out.select(*KEYS, "n", F.round("mutual_info", 6).alias("mutual_info"))


# the catalogue's features on hourly bars, for each series with the last completed close of another
CLOSE, SESSION = "close", "PARTITION BY symbol, CAST(time AS DATE)"
MATRIX_FEATURES = {
    "ma": {}, "ema": {}, "rsi": {}, "atr": {}, "macd": {}, "macd_signal": {}, "macd_histogram": {}, "bollinger_upper": {}, "bollinger_middle": {}, "bollinger_lower": {}, "donchian_upper": {}, "donchian_lower": {},
    "momentum": {"lookback_bars": 24}, "realized_vol": {"window": 21}, "tsmom": {"lookback_bars": 48}, "zscore": {"window": 20}, "rank": {"window": 20}, "pct_change": {}, "clip": {}, "minutes_from_open": {}, "time_of_day": {}, "day_of_week": {}, "month_of_year": {},
    "prev_session_high": {}, "prev_session_low": {}, "prev_session_close": {}, "session_gap": {}, "dist_prev_session_high_atr": {}, "opening_range_high": {}, "d1_prev_low": {}, "d1_trend": {}, "exog_close": {"symbol": "view"}, "exog_return": {"symbol": "view"},
}
_ewm = lambda xs, alpha: f"list_reduce({xs}, lambda a, v: a + {alpha!r} * (v - a))"
_bb, _dev = full("close", 20, "avg(close)"), full("close", 20, "stddev_samp(close)")
_of = {
    "ma": (20, _bb), "ema": (20, "ema"), "rsi": (14, "CASE WHEN l = 0 AND g > 0 THEN 100 WHEN l > 0 THEN 100 - 100 / (1 + g / l) END"), "atr": (14, "atr"), "macd": (26, "macd"), "macd_signal": (26, "signal"), "macd_histogram": (26, "macd - signal"),
    "bollinger_upper": (20, f"{_bb} + 2 * {_dev}"), "bollinger_middle": (20, _bb), "bollinger_lower": (20, f"{_bb} - 2 * {_dev}"), "donchian_upper": (20, full("high", 20, "max(high)", 1)), "donchian_lower": (20, full("low", 20, "min(low)", 1)),
    "momentum": (24, f"close / nullif({lagged('close', 24)}, 0) - 1"), "realized_vol": (21, full("r", 21, "stddev_samp(r)") + " * sqrt(252)"), "tsmom": (48, f"close / nullif({lagged('close', 48)}, 0) - 1"), "zscore": (20, f"(close - {_bb}) / nullif({_dev}, 0)"),
    "rank": (20, f"CASE WHEN count(close) OVER {over(20)} = 20 THEN len(list_filter(list(close) OVER {over(20)}, lambda x: x <= close)) / 20.0 END"), "pct_change": (1, f"close / nullif({lagged('close')}, 0) - 1"), "clip": (0, "least(greatest(close, -3), 3)"),
    "minutes_from_open": (0, "CASE WHEN m >= 540 THEN m - 540 END"), "time_of_day": (0, "(least(greatest(m, 540), 1080) - 540) / 540.0"), "day_of_week": (0, "isodow(time) - 1"), "month_of_year": (0, "month(time)"),
    "prev_session_high": (1, "ph"), "prev_session_low": (1, "pl"), "prev_session_close": (1, "pc"), "session_gap": (1, "gap"), "dist_prev_session_high_atr": (1, "(close - ph) / nullif(atr, 0)"), "opening_range_high": (0, f"CASE WHEN m >= 600 THEN max(CASE WHEN m BETWEEN 540 AND 600 THEN high END) OVER ({SESSION}) END"),
    "d1_prev_low": (1, "pl"), "d1_trend": (1, "trend"), "exog_close": (0, "exog"), "exog_return": (8, f"exog / nullif({lagged('exog', 8)}, 0) - 1"),
}


@query(f"""WITH {H1}, t AS (SELECT *, hour(time) * 60 + minute(time) AS m, row_number() OVER {W} AS i, CASE WHEN close > 0 AND {lagged("close")} > 0 THEN ln(close / {lagged("close")}) END AS r, greatest(high - low, abs(high - {lagged("close")}), abs(low - {lagged("close")})) AS tr, close - {lagged("close")} AS d FROM bars),
x AS (SELECT symbol, list(close ORDER BY time) AS xs, list(tr ORDER BY time) AS ts, list(greatest(d, 0) ORDER BY time) FILTER (d IS NOT NULL) AS gs, list(greatest(-d, 0) ORDER BY time) FILTER (d IS NOT NULL) AS ls FROM t GROUP BY symbol),
y AS (SELECT symbol, i, {_ewm("xs[1:i]", 2 / 21)} AS ema, {_ewm("xs[1:i]", 2 / 13)} - {_ewm("xs[1:i]", 2 / 27)} AS macd, CASE WHEN i >= 14 THEN {_ewm("ts[1:i]", 1 / 14)} END AS atr, CASE WHEN i > 14 THEN {_ewm("gs[1:i - 1]", 1 / 14)} END AS g, CASE WHEN i > 14 THEN {_ewm("ls[1:i - 1]", 1 / 14)} END AS l FROM (SELECT *, unnest(generate_series(1, len(xs))) AS i FROM x)),
q AS (SELECT symbol, list(macd ORDER BY i) AS ms FROM y GROUP BY symbol), z AS (SELECT y.*, {_ewm("ms[1:i]", 2 / 10)} AS signal FROM y JOIN q USING (symbol)),
dd AS (SELECT symbol, CAST(time AS DATE) AS date, arg_min(open, time) AS open, max(high) AS high, min(low) AS low, arg_max(close, time) AS close FROM bars GROUP BY ALL), dw AS (SELECT *, lag(high) OVER o AS ph, lag(low) OVER o AS pl, lag(close) OVER o AS pc, sign(close / nullif(lag(close, 5) OVER o, 0) - 1) AS tr FROM dd WINDOW o AS (PARTITION BY symbol ORDER BY date)),
dv AS (SELECT symbol, date, ph, pl, pc, open / nullif(pc, 0) - 1 AS gap, lag(tr) OVER (PARTITION BY symbol ORDER BY date) AS trend FROM dw), ex AS (SELECT time + INTERVAL 1 HOUR AS at, close AS exog FROM bars WHERE symbol = 'view'),
j AS (SELECT t.*, ema, macd, atr, g, l, signal, ph, pl, pc, gap, trend FROM t JOIN z USING (symbol, i) JOIN dv ON dv.symbol = t.symbol AND dv.date = CAST(time AS DATE)), k AS (SELECT j.*, exog FROM j ASOF LEFT JOIN ex ON j.time >= ex.at),
v AS (SELECT symbol, time, i, {", ".join(f"{e} AS {n}" for n, (_, e) in _of.items())} FROM k)
SELECT symbol, time, {", ".join(f"round(CASE WHEN i > {skip} THEN CAST({n} AS DOUBLE) END, 6) AS {n}" for n, (skip, _) in _of.items())} FROM v""")
def feature_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """33 features of the catalogue, all series, one row a bar."""
    df = hourly(spark, sf_dir)
    exog = df.where("symbol = 'view'").select((c("time") + F.expr("interval 1 hour")).alias("at"), c("close").alias("exog_view"), F.lit(1).alias("one"))
    exog = exog.join(df.select("symbol").distinct().withColumn("one", F.lit(1)), "one").drop("one")
    df = bars.asof_join(df, exog, ["symbol"], "time", "at", ["exog_view"])
    requests = [catalogue.Request(n, tuple(p.items())) for n, p in MATRIX_FEATURES.items()]
    made = catalogue.feature_matrix(df, requests)
    ids = {r.name: catalogue.feature_id(*r.resolved()) for r in requests}
    return made.select("symbol", "time", *(F.round(c(f"`{i}`").cast("double"), 6).alias(n) for n, i in ids.items()))


LEAKY = {"m10": (C.momentum, 10), "sma20": (C.sma, 20), "z20": (C.zscore, 20)}
CUTS = (25, 60, 333, 1000)


def leaky(df: DataFrame) -> DataFrame:
    """Three features of the past and one that looks ahead."""
    return df.withColumns({n: f(c("close"), k) for n, (f, k) in LEAKY.items()} | {"ahead": F.lead("close").over(C.series())})


_leaky = {"m10": f"close / nullif({lagged('close', 10)}, 0) - 1", "sma20": _bb, "z20": f"(close - {_bb}) / nullif({_dev}, 0)", "ahead": f"lead(close) OVER {W}"}


@query(f"""WITH {D1}, b AS (SELECT *, row_number() OVER {W} - 1 AS i FROM bars), f AS (SELECT symbol, time, i, {", ".join(f"{e} AS {n}" for n, e in _leaky.items())} FROM b),
p AS (SELECT b.symbol || ':' || cut AS symbol, b.symbol AS origin, cut, time, close, i FROM b, (SELECT unnest({list(CUTS)}) AS cut) WHERE i <= cut), g AS (SELECT origin, cut, i, {", ".join(f"{e} AS {n}" for n, e in _leaky.items())} FROM p),
u AS (SELECT f.symbol, g.cut, unnest([{", ".join(f"{{'feature': '{n}', 'a': f.{n}, 'b': g.{n}}}" for n in _leaky)}], recursive := true) FROM f JOIN g ON f.symbol = g.origin AND f.i = g.cut AND g.i = g.cut)
SELECT feature, count(*) AS cuts, count(*) FILTER ((a IS NULL) <> (b IS NULL) OR abs(a - b) > 1e-9 + 1e-9 * abs(a)) AS leaks, CASE WHEN count(*) FILTER ((a IS NULL) <> (b IS NULL) OR abs(a - b) > 1e-9 + 1e-9 * abs(a)) > 0 THEN 'suspect' ELSE 'clean' END AS status FROM u GROUP BY feature""")
def causality_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Do features at sampled bars change once the later bars are gone? The one that looks ahead is found."""
    return causality.status(causality.check(daily(spark, sf_dir), leaky, [*LEAKY, "ahead"], CUTS))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gain and trades of each study's window and candidate."""
    return read(spark, sf_dir, "part").groupBy(c("p_brand").alias("study"), (c("p_size") % 6).cast("int").alias("win"), (c("p_partkey") % 4).alias("candidate")).agg((F.sum("p_retailprice") - 3000).alias("gain"), F.count(F.lit(1)).alias("trades"))


PLATEAU = f"""{WINDOWS}, ch AS (SELECT study, win AS w, candidate AS k, gain AS top FROM g QUALIFY row_number() OVER (PARTITION BY study ORDER BY gain DESC, win, candidate) = 1),
nb AS (SELECT study, top, CASE WHEN abs(win - w) + abs(candidate - k) = 1 THEN gain END AS v FROM g JOIN ch USING (study)),
pl AS (SELECT study, any_value(top) AS champion, count(v) AS neighbours, avg(CAST(v > 0 AS INTEGER)) AS profitable_fraction, CASE WHEN any_value(top) > 0 THEN median(v) / any_value(top) END AS score_retention FROM nb GROUP BY study)"""


@query(f"WITH {PLATEAU} SELECT study, round(champion, 4) AS champion, neighbours, round(profitable_fraction, 6) AS profitable_fraction, round(score_retention, 6) AS score_retention FROM pl")
def parameter_plateau(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each study's best cell compares with the cells one step off in window or candidate."""
    out = research.plateau(cells(spark, sf_dir), "study", ["win", "candidate"], "gain")
    return out.select("study", F.round("champion", 4).alias("champion"), "neighbours", F.round("profitable_fraction", 6).alias("profitable_fraction"), F.round("score_retention", 6).alias("score_retention"))


@query(f"""WITH {PLATEAU}, a AS (SELECT study, count(DISTINCT win) AS windows, sum(trades) AS trades, sum(gain) AS total, median(gain) AS middle FROM g GROUP BY study),
s AS (SELECT study, windows >= 6 AS c1, trades >= 30 AS c2, total > 0 AS c3, middle > 0 AS c4, CASE WHEN neighbours > 0 AND score_retention IS NOT NULL THEN profitable_fraction >= 0.5 AND score_retention >= 0.7 END AS c5 FROM a JOIN pl USING (study))
SELECT study, CASE WHEN c5 IS NULL THEN 'inconclusive' WHEN c1 AND c2 AND c3 AND c4 AND c5 THEN 'ready_for_paper' ELSE 'rejected' END AS verdict,
CASE WHEN c5 IS NULL THEN 'parameter_plateau' ELSE concat_ws(',', CASE WHEN NOT c1 THEN 'oos_windows' END, CASE WHEN NOT c2 THEN 'oos_trades' END, CASE WHEN NOT c3 THEN 'aggregate_oos_return' END, CASE WHEN NOT c4 THEN 'median_window_return' END, CASE WHEN NOT c5 THEN 'parameter_plateau' END) END AS open FROM s""")
def acceptance_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ready, rejected or inconclusive, with the criteria that aren't passed."""
    g = cells(spark, sf_dir)
    totals = g.groupBy("study").agg(F.countDistinct("win").alias("windows"), F.sum("trades").alias("trades"), F.sum("gain").alias("total"), F.percentile("gain", 0.5).alias("middle"))
    out = totals.join(research.plateau(g, "study", ["win", "candidate"], "gain"), "study")
    flat = F.when((c("neighbours") > 0) & c("score_retention").isNotNull(), (c("profitable_fraction") >= 0.5) & (c("score_retention") >= 0.7))
    made, names = research.verdict([("oos_windows", c("windows") >= 6), ("oos_trades", c("trades") >= 30), ("aggregate_oos_return", c("total") > 0), ("median_window_return", c("middle") > 0), ("parameter_plateau", flat)])
    return out.select("study", made.alias("verdict"), F.concat_ws(",", names).alias("open"))
