import datetime as dt
import math
from statistics import NormalDist

import duckdb
import pytest
from pyspark.sql import functions as F

from barloom.operators import research
from barloom.plans import evidence, searches

SF = "/root/testdata/sf0.001"


QUERIES, SQL = evidence.QUERIES | searches.QUERIES, evidence.SQL | searches.SQL
KEYS = ("symbol", "time", "feature", "regime", "study", "mode", "trial", "kind", "population")


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("orders", "part", "events", "lineitem"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = QUERIES[name](spark, SF), con.execute(SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    keys = sum(n in KEYS for n in names)
    near = lambda a, b: a == b or (isinstance(a, float) and isinstance(b, float) and abs(a - b) <= 2e-6 * max(1, abs(a)))
    a, b = (sorted(rows, key=lambda r: tuple(map(str, r[:keys]))) for rows in (list(map(tuple, got.select(names).collect())), want.fetchall()))
    assert len(a) == len(b) > 0 and all(all(map(near, x, y)) for x, y in zip(a, b, strict=True))


def test_normal_cdf(spark):
    xs = [-40.0, -8.0, -3.0, -0.5, 0.0, 1.0, 2.5, 7.9, 40.0]
    got = spark.createDataFrame([(x,) for x in [*xs, None]], "x double").select("x", research.normal_cdf(F.col("x")).alias("p")).collect()
    assert got[-1].p is None and all(math.isclose(r.p, NormalDist().cdf(r.x), abs_tol=1e-12) for r in got[:-1])


def test_clusters_follow_chains(spark):
    corr = spark.createDataFrame([("s", a, b, v) for a, b, v in [("e", "d", 0.95), ("d", "c", 0.95), ("c", "b", 0.95), ("b", "a", 0.95), ("e", "f", 0.1)]], "symbol string, a string, b string, corr double")
    got = {r.feature: r.cluster for r in research.clusters(corr, list("abcdef"), "symbol").collect()}
    assert got == dict.fromkeys("abcde", "a") | {"f": "f"}


def test_permutations_keep_short_series_and_break_long_ones(spark):
    rows = [("s", "f", dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), float(i * 7919 % 101), float(i * 7919 % 101)) for i in range(101)]
    make = lambda r: spark.createDataFrame(r, "symbol string, feature string, time timestamp, x double, y double")
    short = research.permutation_null(make(rows[:30]), ["symbol", "feature"]).first()
    assert short.n == 30 and abs(short.rank_ic - 1) < 1e-12 and abs(short.null_mean - 1) < 1e-12 and short.null_std < 1e-12
    whole = research.deflated_ic(research.permutation_null(make(rows), ["symbol", "feature"]), 10).first()
    assert whole.null_mean < 0.9 and 0 < whole.null_floor < 1


def test_verdicts(spark):
    df = spark.createDataFrame([(1, True, True), (2, True, False), (3, False, None)], "i int, a boolean, b boolean")
    made, names = research.verdict([("a", F.col("a")), ("b", F.col("b"))])
    assert [(r.v, r.n) for r in df.orderBy("i").select(made.alias("v"), names.alias("n")).collect()] == [("ready_for_paper", []), ("rejected", ["b"]), ("inconclusive", ["b"])]
