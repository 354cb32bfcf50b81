"""Mutual information of a feature and a target from nearest neighbours, without a table of pairs.

Kraskov's first estimator: with r the distance (the larger of the two coordinates' differences, each scaled by its deviation) from
a point to its k-th nearest neighbour, and a and b the numbers of other points nearer than r in x and in y alone, the
estimate is psi(n) + psi(k) - mean(psi(a + 1) + psi(b + 1)), never under 0.

Points of a group are cut into slabs by x, at approximate quantiles. A slab knows its own points' nearest neighbours; where
a point's circle so found leaves the slab, the point asks the slabs that the circle reaches, and the nearest of all
answers count. Within a slab, points sorted by x meet in blocks, and a block only what its circles reach. How many points lie
nearer in one coordinate is a difference of ranks: places in the slab that holds an end of the interval, and the counts of the
slabs before it. Equal points are one row with a count. So tasks go by group and slab, and nothing grows with the square of a group.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .research import EULER

#: points of a slab; slabs of a group at most, so that a point's slab is found by going through their ends
SLAB, SLABS, BLOCK = 20_000, 256, 256


def digamma(m: Column) -> Column:
    """Of whole numbers from 1: exact sums up to 16, and from there the asymptotic series, good to 1e-15."""
    x = F.greatest(m, F.lit(16)).cast("double")
    series = F.ln(x) - 1 / (2 * x) - 1 / (12 * x * x) + 1 / (120 * x * x * x * x) - 1 / (252 * x * x * x * x * x * x)
    exact = F.element_at(F.array(*(F.lit(sum(1 / i for i in range(1, n)) - EULER) for n in range(1, 16))), F.least(m, F.lit(15)).cast("int"))
    return F.when(m < 16, exact).otherwise(series)


def _nearest(x: np.ndarray, y: np.ndarray, qx: np.ndarray, qy: np.ndarray, reach: np.ndarray | None, k: int) -> tuple[list, list]:
    """For each question: the distances to the k + 1 nearest points (a point asked about is one itself), and their rows.

    `x` is sorted. `reach` says how far to look; without it, a question's own block does.
    """
    order = np.argsort(qx, kind="stable")
    near, rows = [None] * len(qx), [None] * len(qx)
    for part in (order[at : at + BLOCK] for at in range(0, len(order), BLOCK)):
        px, py = qx[part], qy[part]
        if reach is None:
            at = np.searchsorted(x, px[0]), np.searchsorted(x, px[-1], side="right")
            at = max(0, at[0] - k), min(len(x), at[1] + k)
            d = np.maximum(np.abs(px[:, None] - x[at[0] : at[1]]), np.abs(py[:, None] - y[at[0] : at[1]]))
            far = np.partition(d, k, axis=1)[:, k] if d.shape[1] > k else np.full(len(part), np.inf)
        else:
            far = reach[part]
        a, z = np.searchsorted(x, np.nextafter((px - far).min(), -np.inf)), np.searchsorted(x, np.nextafter((px + far).max(), np.inf), side="right")
        d = np.maximum(np.abs(px[:, None] - x[a:z]), np.abs(py[:, None] - y[a:z]))
        some = np.argpartition(d, k, axis=1)[:, : k + 1] if d.shape[1] > k + 1 else np.broadcast_to(np.arange(d.shape[1]), d.shape)
        for i, row, s in zip(part.tolist(), np.take_along_axis(d, some, axis=1).tolist(), (some + a).tolist(), strict=True):
            near[i], rows[i] = row, s
    return near, rows


def _places(values: np.ndarray, counts: np.ndarray, center: np.ndarray, r: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """How many of the slab's sorted values lie below an end of an interval: the upper end (nearer than r on that side) or the lower one."""
    whole = np.r_[0, np.cumsum(counts)]
    at = np.where(upper, np.searchsorted(values, center + r), np.searchsorted(values, center - r, side="right"))
    # an end that was rounded may be off by the value that made r: differences decide
    for _ in range(2):
        last, next_ = values[np.maximum(at - 1, 0)], values[np.minimum(at, len(values) - 1)]
        down = (at > 0) & np.where(upper, last - center >= r, center - last < r)
        up = (at < len(values)) & np.where(upper, next_ - center < r, center - next_ >= r)
        at = at - down.astype(int) + (up & ~down)
    same = r == 0
    at[same] = np.where(upper[same], np.searchsorted(values, center[same], side="right"), np.searchsorted(values, center[same]))
    return whole[at]


def _slab(value: Column, ends: Column) -> Column:
    return F.size(F.filter(ends, lambda e: e <= value))


def mutual_information(rows: DataFrame, x: str, y: str, by: list[str], k: int = 3) -> DataFrame:
    """(by, n, mutual_info) in nats; null where a group has no more than k rows. Rows with a null or NaN take no part."""
    a, b = (F.col(c).cast("double") for c in (x, y))
    rows = rows.select(*by, a.alias("x"), b.alias("y")).where("x is not null and y is not null and not isnan(x) and not isnan(y)")
    rows = rows.groupBy(*by, "x", "y").agg(F.count(F.lit(1)).alias("c"))
    sums = rows.groupBy(*by).agg(F.sum("c").alias("n"), *(F.sum(F.col("c") * F.col(v)).alias(f"s{v}") for v in "xy"))
    parts = min(SLABS, math.ceil((sums.agg(F.max("n")).first()[0] or 0) / SLAB))
    # deviations around the mean, as sums of squares alone would lose digits
    off = lambda v: F.sum(F.col("c") * (F.col(v) - F.col(f"s{v}") / F.col("n")) ** 2)
    dev = lambda v: F.when(off(v) > 0, F.sqrt(off(v) / F.first("n"))).otherwise(1.0).alias(f"d{v}")
    ends = lambda v: F.percentile_approx(v, [i / parts for i in range(1, parts)], F.lit(10_000)) if parts > 1 else F.array().cast("array<double>")
    scale = rows.join(sums, by).groupBy(*by).agg(F.first("n").alias("n"), dev("x"), dev("y"), *((ends(v).alias(f"e{v}")) if parts > 1 else F.first(ends(v)).alias(f"e{v}") for v in "xy"))
    scale = scale.select(*by, "n", "dx", "dy", *(F.expr(f"transform(e{v}, e -> e / d{v})").alias(f"e{v}") for v in "xy"))
    points = rows.join(scale.where(F.col("n") > k), by).select(*by, (F.col("x") / F.col("dx")).alias("x"), (F.col("y") / F.col("dy")).alias("y"), "c", "ex", "ey")
    points = points.select(*by, "x", "y", "c", "ex", "ey", _slab(F.col("x"), F.col("ex")).alias("slab"))
    keys = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in by)

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("x", kind="stable").reset_index(drop=True)
        px, py, c = (pdf[v].to_numpy() for v in ("x", "y", "c"))
        near, at = _nearest(px, py, px, py, None, k)
        return pdf[[*by, "x", "y", "c", "slab"]].assign(near=near, many=[c[i].tolist() for i in at])

    found = points.drop("ex", "ey").groupBy(*by, "slab").applyInPandas(inside, f"{keys}, x double, y double, c long, slab int, near array<double>, many array<long>")
    # (distance, rows up to it, the point itself counted); the k-th other row's distance
    pairs = lambda near, many: F.arrays_zip(near.alias("d"), many.alias("m"))

    def radius(p: Column) -> Column:
        state = F.aggregate(F.array_sort(p), F.struct(F.lit(-1).cast("long").alias("seen"), F.lit(None).cast("double").alias("r")), lambda s, v: F.struct((s["seen"] + v["m"]).alias("seen"), F.coalesce(s["r"], F.when(s["seen"] + v["m"] >= k, v["d"])).alias("r")))
        return state["r"]

    scales = scale.select(*by, "n", "ex", "ey")
    found = found.select(*by, "x", "y", "c", "slab", pairs(F.col("near"), F.col("many")).alias("p")).withColumn("r", radius(F.col("p"))).join(scales, by)
    wide = F.coalesce("r", F.lit(float("inf")))
    reached = found.withColumns({"lo": _slab(F.col("x") - wide, F.col("ex")), "hi": _slab(F.col("x") + wide, F.col("ex"))})
    others = reached.where("lo < hi").select(*by, "x", "y", wide.alias("r"), "slab", F.explode(F.filter(F.sequence("lo", "hi"), lambda s: s != F.col("slab"))).alias("other"))

    def asked(questions: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
        if not len(questions) or not len(pdf):
            return questions[[*by, "x", "y"]].head(0).assign(near=pd.Series(dtype=object), many=pd.Series(dtype=object))
        pdf = pdf.sort_values("x", kind="stable").reset_index(drop=True)
        px, py, c = (pdf[v].to_numpy() for v in ("x", "y", "c"))
        near, at = _nearest(px, py, questions["x"].to_numpy(), questions["y"].to_numpy(), questions["r"].to_numpy(), k)
        return questions[[*by, "x", "y"]].assign(near=near, many=[c[i].tolist() for i in at])

    answers = others.drop("slab").withColumnRenamed("other", "slab").groupBy(*by, "slab").cogroup(points.drop("ex", "ey").toDF(*by, "x", "y", "c", "slab").groupBy(*by, "slab")).applyInPandas(asked, f"{keys}, x double, y double, near array<double>, many array<long>")
    more = answers.groupBy(*by, "x", "y").agg(F.flatten(F.collect_list(pairs(F.col("near"), F.col("many")))).alias("more"))
    known = found.join(more, [*by, "x", "y"], "left").select(*by, "x", "y", "c", "ex", "ey", radius(F.concat("p", F.coalesce("more", F.slice("p", 1, 0)))).alias("r"))

    axis = lambda v: F.struct(F.lit(v).alias("axis"), F.col(v).alias("v"), F.col(f"e{v}").alias("ends"))
    both = known.select(*by, "x", "y", "c", "r", F.explode(F.array(axis("x"), axis("y"))).alias("a")).select(*by, "x", "y", "c", "r", "a.*")
    values = both.groupBy(*by, "axis", _slab(F.col("v"), F.col("ends")).alias("slab"), "v").agg(F.sum("c").alias("c"))
    before = Window.partitionBy(*by, "axis").orderBy("slab").rowsBetween(Window.unboundedPreceding, -1)
    slabs = scales.select(*by, F.explode(F.array(F.lit("x"), F.lit("y"))).alias("axis")).withColumn("slab", F.explode(F.sequence(F.lit(0), F.lit(max(parts - 1, 0)))))
    held = values.groupBy(*by, "axis", "slab").agg(F.sum("c").alias("c"))
    offsets = slabs.join(held, [*by, "axis", "slab"], "left").withColumn("before", F.coalesce(F.sum("c").over(before), F.lit(0))).drop("c")
    # the lower end is looked for a little above itself: there lies the value that made r, should it begin a slab
    low = F.col("v") - F.col("r") + F.greatest(F.abs("v"), F.col("r")) * 1e-15
    end = lambda upper, at: F.struct(F.lit(upper).alias("upper"), _slab(at, F.col("ends")).alias("slab"))
    sides = both.select(*by, "x", "y", "axis", "v", "r", F.explode(F.array(end(True, F.col("v") + F.col("r")), end(False, low))).alias("e")).select(*by, "x", "y", "axis", "v", "r", "e.*")

    def counted(questions: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, upper = pdf.sort_values("v"), questions["upper"].to_numpy(bool)
        at = _places(pdf["v"].to_numpy(), pdf["c"].to_numpy(), questions["v"].to_numpy(), questions["r"].to_numpy(), upper) if len(pdf) and len(questions) else np.zeros(len(questions), np.int64)
        return questions[[*by, "x", "y", "axis", "slab", "upper"]].assign(below=at)

    below = sides.groupBy(*by, "axis", "slab").cogroup(values.toDF(*values.columns).groupBy(*by, "axis", "slab")).applyInPandas(counted, f"{keys}, x double, y double, axis string, slab int, upper boolean, below long")
    inside_of = below.join(offsets, [*by, "axis", "slab"]).withColumn("below", (F.col("below") + F.col("before")) * F.when(F.col("upper"), 1).otherwise(-1))
    near = inside_of.groupBy(*by, "x", "y", "axis").agg((F.sum("below") - 1).alias("near"))
    psi = near.groupBy(*by, "x", "y").agg(F.sum(digamma(F.col("near") + 1)).alias("psi"))
    out = known.join(psi, [*by, "x", "y"]).groupBy(*by).agg(F.sum(F.col("psi") * F.col("c")).alias("psi"))
    n = F.col("n")
    return sums.select(*by, "n").join(out, by, "left").select(*by, "n", F.when(F.col("psi").isNotNull(), F.greatest(digamma(n) + digamma(F.lit(k)) - F.col("psi") / n, F.lit(0.0))).alias("mutual_info"))
