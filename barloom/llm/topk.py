"""Exact inner-product top-k: ball trees with branch and bound, one per shard.

Vectors are rounded to integers, and equal ones become one candidate with its k + 1 smallest ids, so a
vector that a third of all rows share is scored once. Shards are dealt by space: the leaves of a tree over a
bounded sample are cells, every vector goes to the nearest cell's centre, and a cell of too many vectors
is split by hash. So a shard is a ball, and the upper bound of a query's inner product with it (centre's product
plus radius times the query's norm) says whether the two need meet. Queries go through shards in a few waves, best
bound first; each wave takes along the kth score so far, and pairs of query and shard under it aren't formed. A
task meets one shard and one block of queries that share home shards: it orders the leaves of the shard's tree by the
same bound (no more than the parents') and stops where it is under the current kth score.

Edge cases: vectors that are null, or have null or non-finite components (once scaled) take no part. Only vectors of
one length are compared. Scores are exact; one outside a long's range is given as the nearest long. Equal scores rank by
smaller id. Repeated ids count as several rows, of which none is its own candidate. Fewer candidates than k give
fewer rows; an empty table gives none. Extra columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import tidy, written

LEAF = 128
#: at most so many centres are broadcast; larger inputs split their cells by hash
CELLS = 4096
#: a query meets its best shard first, then up to WAVE - 1 more, then all others that its kth score leaves
WAVE = 8
LEAST, MOST = -(1 << 63), (1 << 63) - 1
FOUND = "query_id long, vec_id long, score long"


def _bound(queries: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """Upper bounds of the inner product, by query and ball, with room for rounding."""
    with np.errstate(all="ignore"):
        norm = np.sqrt((queries**2).sum(axis=1))
        out = queries @ centres.T + norm[:, None] * radii
        out += 1e-9 * (np.abs(out) + norm[:, None] * (np.abs(radii) + np.sqrt((centres**2).sum(axis=1))) + 1)
    return np.where(np.isnan(out), np.inf, out)


def _cells(points: np.ndarray, n: int) -> np.ndarray:
    """Centres of about equal parts of the points, halved along their longest extent."""
    if n <= 1 or len(points) < 2:
        return points.mean(axis=0)[None, :]
    centre = points.mean(axis=0)
    one = points[((points - centre) ** 2).sum(axis=1).argmax()]
    other = points[((points - one) ** 2).sum(axis=1).argmax()]
    side = np.argsort(points @ (other - one), kind="stable")
    cut = max(1, len(points) * (n // 2) // n)
    return np.concatenate([_cells(points[side[:cut]], n // 2), _cells(points[side[cut:]], n - n // 2)])


class BallTree:
    def __init__(self, points: np.ndarray):
        self.order = np.arange(len(points))
        self.leaves: list[tuple[int, int]] = []
        centres, radii, self.paths = [], [], []

        def build(a: int, z: int, path: list[int]) -> None:
            part = points[self.order[a:z]]
            centre = part.mean(axis=0)
            path = [*path, len(centres)]
            centres.append(centre)
            radii.append(float(np.sqrt(((part - centre) ** 2).sum(axis=1).max())))
            if z - a <= LEAF:
                self.leaves.append((a, z))
                self.paths.append(path)
                return
            one = part[((part - centre) ** 2).sum(axis=1).argmax()]
            other = part[((part - one) ** 2).sum(axis=1).argmax()]
            side = np.argsort(part @ (other - one), kind="stable")
            self.order[a:z] = self.order[a:z][side]
            build(a, (a + z) // 2, path)
            build((a + z) // 2, z, path)

        if len(points):
            build(0, len(points), [])
        self.centres, self.radii = np.array(centres), np.array(radii)
        self.points = points[self.order]

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Upper bounds by query and leaf."""
        node = _bound(queries, self.centres, self.radii)
        return np.stack([node[:, p].min(axis=1) for p in self.paths], axis=1)


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, ~score))[:k]  # ~ turns the order round, also at a long's ends
    return score[order], ids[order]


def _scores(points: np.ndarray, large: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact inner products; those of `large` rows, which a double may not hold, in Python's integers."""
    out = np.zeros(len(points), np.int64)
    out[~large] = (points[~large] @ query).astype(np.int64)
    if large.any():
        q = [int(x) for x in query.tolist()]
        out[large] = [min(max(sum(int(x) * y for x, y in zip(p, q, strict=True)), LEAST), MOST) for p in points[large].tolist()]
    return out


def search(points: np.ndarray, ids: list[np.ndarray], queries: np.ndarray, own: np.ndarray, floor: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per query: (its place, ids, scores) of the k best that aren't under `floor`."""
    if not len(points):
        return
    tree = BallTree(points)
    ids = [ids[i] for i in tree.order]
    size = np.array([len(x) for x in ids])
    flat, start = np.concatenate(ids), np.r_[0, np.cumsum(size)]
    peak, dim = np.abs(tree.points).max(axis=1, initial=0), max(points.shape[1], 1)
    small = peak.max(initial=0) * np.abs(queries).max(initial=0) * dim < 2**24
    at = tree.points.astype(np.float32) if small else tree.points
    for a in range(0, len(queries), 256):
        bound = tree.bounds(queries[a : a + 256])
        for q in range(a, min(a + 256, len(queries))):
            order = np.argsort(-bound[q - a], kind="stable")
            limit = bound[q - a][order]
            query, kth = queries[q].astype(at.dtype), int(floor[q])
            large = peak * (np.abs(queries[q]).max(initial=0) * dim) >= 2.0**53
            score, found = np.empty(0, np.int64), np.empty(0, np.int64)
            i, step = 0, 4
            while i < len(order) and limit[i] >= kth:
                leaves = [tree.leaves[x] for j, x in enumerate(order[i : i + step]) if limit[i + j] >= kth]
                i, step = i + step, step * 2
                rows = np.concatenate([np.arange(*x) for x in leaves])
                s = _scores(at[rows], large[rows], query)
                if len(s) > 4 * k:  # one row each is enough for the kth; the query's own may be one of them
                    kth = max(kth, int(np.partition(s, len(s) - k - 1)[len(s) - k - 1]))
                hit = np.flatnonzero(s >= kth)
                rows, s = rows[hit], s[hit]
                n = size[rows]
                place = np.repeat(start[rows] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum()) if len(rows) else np.empty(0, np.int64)
                new, s = flat[place], np.repeat(s, n)
                other = new != own[q]
                score, found = _best(np.r_[score, s[other]], np.r_[found, new[other]], k)
                if len(score) == k:
                    kth = max(kth, int(score[-1]))
            yield q, found, score


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64).reshape(len(column), -1)


def top_k(df: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", scale: int = 64, k: int = 20, shard_rows: int = 20_000, block_rows: int = 16_000, sample_rows: int = 20_000) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest integer products of every query with all other rows.

    The cells are fitted on about `sample_rows` of the distinct vectors; all vectors are placed, bounded and searched.
    """
    spark = df.sparkSession
    scaled = F.transform(F.col(vector).cast("array<double>"), lambda v: v * scale)
    ok = F.forall(scaled, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    whole = F.transform(scaled, lambda v: F.when(F.abs(v) < 2.0**53, F.floor(v).cast("double")).otherwise(v))  # larger doubles are integers
    rows = written(df.where(F.col(vector).isNotNull() & F.col(key).isNotNull() & ok).select(F.col(key).cast("long").alias("id"), is_query.alias("q"), whole.alias("x")))
    first = W.partitionBy("x").orderBy("id")  # a rank limit: Spark cuts within tasks before it shuffles
    few = rows.select("id", "x").distinct().withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1)
    points = written(few.groupBy("x").agg(F.collect_list("id").alias("ids")).select(F.size("x").alias("dim"), "x", "ids"))

    sizes = {r["dim"]: r["n"] for r in points.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row for each length of vectors
    share = int((1 << 20) * min(1.0, sample_rows / max(1, sum(sizes.values()))))
    sample = points.where(F.pmod(F.xxhash64("x", F.lit(5)), F.lit(1 << 20)) < share).select("dim", "x").toArrow()
    centres: dict[int, np.ndarray] = {}
    for dim, n in sizes.items():
        own = _matrix(sample["x"].filter(pa.array([d == dim for d in sample["dim"].to_pylist()], pa.bool_())).combine_chunks())
        with np.errstate(all="ignore"):
            centres[dim] = _cells(own, min(-(-n // shard_rows), CELLS, len(own))) if len(own) else np.zeros((1, dim))
    sent = spark.sparkContext.broadcast(centres)  # at most CELLS centres for each length

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 4096) for b in batches for at in range(0, b.num_rows, 4096)):
            dims = batch["dim"].to_numpy()
            cell, reach = np.zeros(len(dims), np.int32), np.zeros(len(dims))
            for dim in np.unique(dims):
                here = np.flatnonzero(dims == dim)
                x, c = _matrix(batch["x"].take(pa.array(here))), sent.value[int(dim)]
                with np.errstate(all="ignore"):
                    cell[here] = ((c**2).sum(axis=1) - 2 * (x @ c.T)).argmin(axis=1)
                    reach[here] = np.sqrt(((x - c[cell[here]]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(reach)], names=["dim", "x", "ids", "cell", "reach"])

    points = written(points.mapInArrow(tidy(place), "dim int, x array<double>, ids array<long>, cell int, reach double"))
    balls = sorted((r["dim"], r["cell"], r["n"], r["reach"]) for r in points.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("reach").alias("reach")).collect())  # a row for each cell
    parts, shards = [], []
    for dim, cell, n, reach in balls:
        parts.append((dim, cell, len(shards), -(-n // shard_rows)))
        shards += [(dim, cell, reach)] * parts[-1][3]
    if not shards:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # centres, radii and shard numbers by length of vectors
    layout = {dim: (np.array([centres[dim][c] for d, c, _ in shards if d == dim]), np.array([r for d, _, r in shards if d == dim]), np.array([i for i, s in enumerate(shards) if s[0] == dim])) for dim in sizes}
    known = spark.sparkContext.broadcast(layout)
    table = spark.createDataFrame(parts, "dim int, cell int, lead int, parts int")
    points = points.join(F.broadcast(table), ["dim", "cell"]).select((F.col("lead") + F.pmod(F.xxhash64("x"), F.col("parts"))).cast("int").alias("shard"), "x", "ids")

    def meeting(lo: int, hi: int | None):
        """Query and shard for places `lo` to `hi` of the query's shards, best bound first, as far as `floor` allows."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
                dims, floor = batch["dim"].to_numpy(), batch["floor"].to_numpy()
                for dim in np.unique(dims):
                    here = np.flatnonzero(dims == dim)
                    c, r, number = known.value[int(dim)]
                    bound = _bound(_matrix(batch["x"].take(pa.array(here))), c, r)
                    best = np.argsort(-bound, axis=1, kind="stable")[:, lo:hi]
                    row, at = np.nonzero(np.take_along_axis(bound, best, axis=1) >= floor[here][:, None])
                    yield pa.RecordBatch.from_arrays([*batch.take(pa.array(here[row])).columns, pa.array(number[best[row, at]].astype(np.int32))], names=[*batch.schema.names, "shard"])

        return tidy(run)

    def meet(queries: DataFrame) -> DataFrame:
        def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            names = ["query_id", "vec_id", "score"]
            if not len(left) or not len(right):
                return pd.DataFrame({n: np.empty(0, np.int64) for n in names})
            p, q = (np.stack([np.asarray(v, np.float64) for v in side["x"]]) for side in (right, left))
            own = left["id"].to_numpy(np.int64)
            parts = [(np.full(len(f), own[i]), f, s) for i, f, s in search(p, [np.asarray(v, np.int64) for v in right["ids"]], q, own, left["floor"].to_numpy(np.int64), k)]
            return pd.DataFrame({n: np.concatenate([x[i] for x in parts]).astype(np.int64) for i, n in enumerate(names)})

        pairs = queries.select("shard", F.col("block").alias("to_block"), F.col("part").alias("to_part")).distinct()
        near = points.join(pairs, "shard").select(F.col("shard").alias("to_shard"), "to_block", "to_part", "x", "ids")
        return queries.groupBy("shard", "block", "part").cogroup(near.groupBy("to_shard", "to_block", "to_part")).applyInPandas(run, FOUND)

    asked = rows.where("q").distinct().select("id", "x", F.size("x").alias("dim"), F.lit(LEAST).cast("long").alias("floor"))
    fields = "id long, x array<double>, dim int, floor long"
    at_home = written(asked.mapInArrow(meeting(0, 1), f"{fields}, shard int"))
    # queries of neighbouring home shards share a block; those of a crowded one are split by hash
    crowd = [(r["shard"], -(-r["n"] // block_rows)) for r in at_home.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()]  # at most a row for each shard
    if not crowd:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    together = max(1, len(shards) // max(1, sum(n for _, n in crowd)))
    home = at_home.join(F.broadcast(spark.createDataFrame(crowd, "shard int, n int")), "shard")
    home = home.select("id", "x", "dim", "floor", "shard", F.floor(F.col("shard") / together).cast("int").alias("block"), F.pmod(F.xxhash64("id"), F.col("n")).cast("int").alias("part"))
    found = written(meet(home))
    for lo, hi in ((1, WAVE), (WAVE, None)):
        if lo >= max(len(x[2]) for x in layout.values()):
            break
        kth = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        floor = found.withColumn("r", F.row_number().over(kth)).where(F.col("r") == k).select(F.col("query_id").alias("id"), F.col("score").alias("kth"))
        now = home.join(floor, "id", "left").select("id", "x", "dim", F.coalesce("kth", "floor").alias("floor"), "block", "part")
        found = found.unionByName(written(meet(written(now.mapInArrow(meeting(lo, hi), f"{fields}, block int, part int, shard int")))))
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
