"""The feature catalogue: named causal features of bars, their matrix, its identity and its stored form.

A feature is a node kind with parameters and one of its outputs. A matrix builds all features asked for at once: features
with the same kind and parameters share a node, and the recursive averages of one depth are one pass over the bars, whatever
the number of features. A matrix's id is a digest of what it was asked for, so a stored one is found again by it.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators.research import numbered
from ..sources import artifacts
from . import genome

ENGINE_VERSION = 1

# fixed values: default parameters
DEFAULTS: dict[str, Any] = {
    "atr_period": 14, "change_bars": 1, "clip_high": 3.0, "clip_low": -3.0, "estimator": "close_to_close", "fast_period": 12, "lookback_1": 21, "lookback_2": 63,
    "lookback_3": 252, "lookback_bars": 252, "ma_period": 20, "ma_type": "sma", "num_std": 2.0, "period": 20, "range_minutes": 60, "rebalance_bars": 21,
    "regime_lookback": 63, "session_close": "18:00", "session_open": "09:00", "signal_period": 9, "slow_period": 26, "symbol": "WDO$", "vol_estimator": "yang_zhang",
    "vol_window": 63, "window": 63, "window_from": "09:00", "window_to": "12:00",
}

# fixed values: name, category, node kind, output, the parameter that says how many bars to skip, type of the values, parameters that differ from the defaults
FEATURES = """
rsi                         momentum    ind.rsi                            out              period           oscillator    period=14
atr                         volatility  ind.atr                            out              period           oscillator    period=14
ma                          trend       ind.ma                             out              period           price_series
ema                         trend       ind.ema                            out              period           price_series
macd                        momentum    ind.macd                           macd             slow_period      oscillator
macd_signal                 momentum    ind.macd                           macd_signal      slow_period      oscillator
macd_histogram              momentum    ind.macd                           macd_histogram   slow_period      oscillator
bollinger_upper             volatility  ind.bollinger                      bb_upper         period           price_series
bollinger_middle            volatility  ind.bollinger                      bb_middle        period           price_series
bollinger_lower             volatility  ind.bollinger                      bb_lower         period           price_series
donchian_upper              trend       ind.donchian                       donchian_upper   period           price_series
donchian_lower              trend       ind.donchian                       donchian_lower   period           price_series
momentum                    momentum    ind.momentum                       out              lookback_bars    oscillator
realized_vol                volatility  ind.realized_vol                   out              window           oscillator
tsmom                       momentum    ind.tsmom                          momentum         lookback_bars    oscillator
tsmom_volatility            volatility  ind.tsmom                          volatility       vol_window       oscillator
trend_blend                 trend       ind.trend_blend                    out              lookback_3       oscillator
trend_blend_volatility      volatility  ind.trend_blend                    volatility       vol_window       oscillator
zscore                      transform   transform.zscore                   out              window           oscillator
rank                        transform   transform.rank                     out              window           oscillator
pct_change                  transform   transform.pct_change               out              change_bars      oscillator
clip                        transform   transform.clip                     out              -                price_series
minutes_from_open           session     feature.minutes_from_open          out              -                oscillator
time_of_day                 session     feature.time_of_day                out              -                oscillator
day_of_week                 session     feature.day_of_week                out              -                oscillator
month_of_year               session     feature.month_of_year              out              -                oscillator
session_window              session     feature.session_window             out              -                bool_series   window_from=10:00
vol_regime                  regime      feature.vol_regime                 out              regime_lookback  oscillator
trend_regime                regime      feature.trend_regime               out              ma_period        oscillator
range_compression           regime      feature.range_compression          out              regime_lookback  oscillator
prev_session_high           session     feature.prev_session_high          out              -                price_series
prev_session_low            session     feature.prev_session_low           out              -                price_series
prev_session_close          session     feature.prev_session_close         out              -                price_series
session_gap                 session     feature.session_gap                out              -                oscillator
dist_prev_session_high_atr  session     feature.dist_prev_session_high_atr out              atr_period       oscillator
dist_prev_session_low_atr   session     feature.dist_prev_session_low_atr  out              atr_period       oscillator
dist_prev_session_close_atr session     feature.dist_prev_session_close_atr out             atr_period       oscillator
opening_range_high          session     feature.opening_range_high         out              range_minutes    price_series
opening_range_low           session     feature.opening_range_low          out              range_minutes    price_series
d1_prev_high                htf         feature.d1_prev_high               out              -                price_series
d1_prev_low                 htf         feature.d1_prev_low                out              -                price_series
d1_prev_close               htf         feature.d1_prev_close              out              -                price_series
d1_trend                    htf         feature.d1_trend                   out              -                oscillator
d1_volatility               htf         feature.d1_volatility              out              -                oscillator
exog_close                  exogenous   source.exog.close                  out              -                price_series
exog_return                 exogenous   source.exog.return                 out              lookback_bars    oscillator    lookback_bars=8
exog_return_zscore          exogenous   source.exog.return_zscore          out              window           oscillator    lookback_bars=8 window=20
exog_rolling_corr           exogenous   source.exog.rolling_corr           out              window           oscillator    window=20
exog_relative_strength      exogenous   source.exog.relative_strength      out              lookback_bars    oscillator    lookback_bars=8
exog_vol_regime             exogenous   source.exog.vol_regime             out              vol_window       bool_series   vol_window=20
exog_direction_regime       exogenous   source.exog.direction_regime       out              lookback_bars    bool_series   lookback_bars=8
"""
#: fixed values: these node kinds are known so many bars late, whatever their parameters; a session's other features at once
LATE = {f"feature.{x}": 1 for x in ("prev_session_high", "prev_session_low", "prev_session_close", "session_gap", "dist_prev_session_high_atr", "dist_prev_session_low_atr", "dist_prev_session_close_atr", "d1_prev_high", "d1_prev_low", "d1_prev_close", "d1_trend", "d1_volatility")}


@dataclass(frozen=True)
class Feature:
    name: str
    category: str
    kind: str
    port: str
    lookback: str | None
    output: str
    params: tuple[tuple[str, Any], ...]
    version: int = 1


def _keys(kind: str) -> list[str]:
    """The kind's parameters; a rolling correlation's return length is not one of the catalogue's."""
    return [p for p in genome.KINDS[kind].params if not (kind == "source.exog.rolling_corr" and p == "lookback_bars")]


def _parsed(line: str) -> Feature:
    name, category, kind, port, lookback, output, *own = line.split()
    given = dict(x.split("=") for x in own)
    params = {p: type(DEFAULTS[p])(given.get(p, DEFAULTS[p])) for p in _keys(kind)}
    return Feature(name, category, kind, port, None if lookback == "-" else lookback, output, tuple(sorted(params.items())))


CATALOGUE: dict[str, Feature] = {f.name: f for f in map(_parsed, FEATURES.strip().splitlines())}


@dataclass(frozen=True)
class Request:
    name: str
    params: tuple[tuple[str, Any], ...] = ()
    version: int | None = None

    def resolved(self) -> tuple[Feature, dict[str, Any]]:
        feature = CATALOGUE.get(self.name)
        if feature is None or self.version not in (None, feature.version):
            raise KeyError(f"no such feature: {self.name} {self.version or ''}")
        if unknown := set(dict(self.params)) - set(dict(feature.params)):
            raise ValueError(f"unknown parameters of {self.name}: {sorted(unknown)}")
        return feature, dict(sorted((dict(feature.params) | dict(self.params)).items()))


def feature_id(feature: Feature, params: dict[str, Any]) -> str:
    """name.vN.digest, of the parameters by name."""
    payload = json.dumps(sorted(params.items()), separators=(",", ":"), sort_keys=True)
    return f"{feature.name}.v{feature.version}.{hashlib.sha256(payload.encode()).hexdigest()[:8]}"


def warmup(feature: Feature, params: dict[str, Any]) -> int:
    """The bars at a series' start that have no value; session and regime features go by when they are known, not by parameters."""
    if feature.kind.startswith("feature."):
        return LATE.get(feature.kind, 0)
    return int(params[feature.lookback]) if feature.lookback else 0


def _iso(at: datetime) -> str:
    return (at.replace(tzinfo=UTC) if at.tzinfo is None else at.astimezone(UTC)).strftime("%Y-%m-%dT%H:%M:%SZ")


def matrix_id(symbol: str, timeframe: str, start: datetime, end: datetime, requests: list[Request]) -> str:
    """Of what is asked for, in any order of the features."""
    entries = []
    for feature, params in (r.resolved() for r in requests):
        entries.append({"feature_id": feature_id(feature, params), "version": feature.version, "params": params})
    payload = {"symbol": symbol, "timeframe": timeframe.upper(), "start": _iso(start), "end": _iso(end), "engine_version": ENGINE_VERSION, "features": sorted(entries, key=lambda e: e["feature_id"])}
    return hashlib.sha256(json.dumps(payload, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def feature_matrix(bars: DataFrame, requests: list[Request]) -> DataFrame:
    """(symbol, time, a column for each feature id, by name): null in the feature's first bars.

    `bars` has what the kinds read: prices and volume, and for exogenous features a column exog_<symbol> of aligned closes.
    """
    if not requests:
        raise ValueError("no features")
    asked = sorted({feature_id(f, p): (f, p) for f, p in (r.resolved() for r in requests)}.items())
    keep = list(bars.columns)
    build = genome.Gathered(bars)
    nodes: dict[tuple, dict[str, Column]] = {}
    for _, (feature, params) in asked:
        key = (feature.kind, tuple(params.items()))
        if key not in nodes:
            build.depth = 0
            kind = genome.KINDS[feature.kind]
            made = kind.make(build, genome.Node("f", feature.kind, params), [F.col("close")] * kind.inputs[1])
            nodes[key] = made if isinstance(made, dict) else {"out": made}
    built = numbered(build.finish(), F.lit(True), "symbol", "_bar")
    value = lambda f, p: nodes[f.kind, tuple(p.items())][f.port]
    # windows first, then the cut: a window of a cut value would see the cut
    built = built.withColumns({f"_f{i}": value(f, p) for i, (_, (f, p)) in enumerate(asked)})
    shown = [F.when(F.col("_bar") > warmup(f, p), F.col(f"_f{i}")).alias(name) for i, (name, (f, p)) in enumerate(asked)]
    return built.select(*(c for c in keep if c in ("symbol", "time")), *shown)


def manifest(matrix: DataFrame, requests: list[Request]) -> DataFrame:
    """(symbol, start, end, bar_count, valid_from): the first bar behind all features' first bars, null if there is none."""
    skip = max(warmup(*r.resolved()) for r in requests)
    rows = numbered(matrix.select("symbol", "time"), F.lit(True), "symbol", "_bar")
    return rows.groupBy("symbol").agg(F.min("time").alias("start"), F.max("time").alias("end"), F.count(F.lit(1)).alias("bar_count"), F.min(F.when(F.col("_bar") > skip, F.col("time"))).alias("valid_from"))


def stored_matrix(spark: SparkSession, root: str, bars: DataFrame, symbol: str, timeframe: str, start: datetime, end: datetime, requests: list[Request]) -> tuple[str, DataFrame, dict[str, Any]]:
    """(id, matrix, manifest) of one series, from the store where it has been built before; otherwise built and stored as a whole."""
    key = matrix_id(symbol, timeframe, start, end, requests)
    found = artifacts.manifest(spark, root, "features", key)
    if found is None:
        some = bars.where((F.col("symbol") == symbol) & F.col("time").between(F.lit(start), F.lit(end)))
        made = feature_matrix(some, requests)
        about = manifest(some, requests).first()
        rows = [{"feature_id": feature_id(f, p), "name": f.name, "version": f.version, "params": p, "warmup_bars": warmup(f, p), "leakage_status": "clean"} for f, p in (r.resolved() for r in requests)]
        found = artifacts.write(spark, root, "features", key, {"matrix": made}, {"matrix_id": key, "symbol": symbol, "timeframe": timeframe.upper(), "start": _iso(start), "end": _iso(end), "bar_count": about.bar_count if about else 0, "valid_from": _iso(about.valid_from) if about and about.valid_from else None, "features": sorted(rows, key=lambda r: r["feature_id"]), "engine_version": ENGINE_VERSION})
    return key, artifacts.read(spark, root, "features", key, "matrix"), found
