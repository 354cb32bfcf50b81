"""Connected components of an edge table, as joins; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: a component's members meet their label's own label in so many parts
SALTS = 8


def components(edges: DataFrame) -> DataFrame:
    """(id, label) for every end of an edge (a, b): label is the smallest id that can be reached.

    Each round gives a node its neighbours' smallest label and then that label's own label, until nothing
    changes: about as many rounds as the logarithm of the longest path. Only labels that moved are looked up, and
    the members of a large component are spread over salts.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        step = written(labels.join(near, "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("label")))
        if step.where("old <> label").isEmpty():
            return labels
        moved = step.where("label < id").select(F.col("id").alias("label"), F.col("label").alias("next"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        salted = step.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
        labels = written(salted.join(moved, ["label", "salt"], "left").select("id", F.coalesce("next", "label").alias("label")))
