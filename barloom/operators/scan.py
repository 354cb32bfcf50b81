"""Ordered scans of few long groups: rows are dealt by ranges of the order, so that no task holds a whole group.

Windows run by group and chunk; what lies before a chunk is a scan over the chunks' figures, a row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W
from pyspark.sql.window import WindowSpec

from ..sources import scratch

#: rows of a chunk, about
ROWS = 200_000


def chunked(df: DataFrame, by: str, *order: str, rows: int | None = None) -> DataFrame:
    """`df` with `_chunk`, numbered in order of (by, order): about `rows` (ROWS) rows each, written once, so that they stay what they are."""
    n = max(1, -(-df.count() // (rows or ROWS)))
    ranged = df.repartitionByRange(n, by, *order).withColumn("_chunk", F.spark_partition_id())
    # dealt by ranges of the number: a hash puts several chunks into one task, and the more chunks there are, the more
    return scratch.kept(ranged).repartitionByRange(2 * n, "_chunk")


def within(by: str, *order: str) -> WindowSpec:
    """Over a chunk's rows of one group."""
    return W.partitionBy(by, "_chunk").orderBy(*order)


def before(by: str) -> WindowSpec:
    """Over a group's earlier chunks, in a table with a row for each."""
    return W.partitionBy(by).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)


def plus(a: Column, b: Column) -> Column:
    """The sum of those that aren't null, as aggregates add."""
    return F.coalesce(a + b, a, b)
