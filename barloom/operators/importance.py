"""Which parameters decide a search's objective: functional variance analysis of a forest fitted to the trials.

Spark fits the forest to all trials. Each tree cuts the box of parameters into leaves, so what it predicts on average at a value of one
parameter, all others drawn evenly from their ranges, is a sum over the leaves that hold the value, weighted by their extent in the
other parameters. A parameter's importance is the variance of that average over its range, as a share of the tree's variance
over the box, averaged over trees. Leaves are a table of at most trees x 2 ^ depth x parameters rows, however many trials there are.
"""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

LEAVES = "tree int, leaf int, value double, parameter string, low double, high double"


def _leaves(model, parameters: list[str], box: dict[str, tuple[float, float]]) -> list[tuple]:
    """The leaves' boxes, one row for each parameter."""
    rows = []
    for number, tree in enumerate(model.trees):
        todo, leaf = [(tree._call_java("rootNode"), dict(box))], 0
        while todo:
            node, held = todo.pop()
            if node.subtreeDepth() == 0:
                rows += [(number, leaf, float(node.prediction()), p, *held[p]) for p in parameters]
                leaf += 1
                continue
            name, at = parameters[node.split().featureIndex()], float(node.split().threshold())
            low, high = held[name]
            todo += [(node.leftChild(), held | {name: (low, min(at, high))}), (node.rightChild(), held | {name: (max(at, low), high)})]
    return rows


def importances(trials: DataFrame, parameters: list[str], objective: str, trees: int = 16, depth: int = 6, seed: int = 1) -> DataFrame:
    """(parameter, importance, share): the part of the variance that a parameter decides alone, and that part among all parameters'.

    Trials with a null among parameters or objective take no part; fewer than two leave nothing. A parameter of one value decides nothing,
    and nor does any where the forest predicts one value.
    """
    rows = trials.select(*(F.col(p).cast("double").alias(p) for p in parameters), F.col(objective).cast("double").alias("_y")).dropna()
    ends = rows.agg(F.count(F.lit(1)).alias("n"), *(f(p).alias(f"{n}_{p}") for p in parameters for n, f in (("lo", F.min), ("hi", F.max)))).first()
    if ends.n < 2:
        return trials.sparkSession.createDataFrame([], "parameter string, importance double, share double")
    box = {p: (ends[f"lo_{p}"], ends[f"hi_{p}"]) for p in parameters}
    points = VectorAssembler(inputCols=parameters, outputCol="_x").transform(rows)
    model = RandomForestRegressor(featuresCol="_x", labelCol="_y", numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="all").fit(points)
    leaves = trials.sparkSession.createDataFrame(_leaves(model, parameters, box), LEAVES)

    spans = F.create_map(*(F.lit(x) for p, (low, high) in box.items() for x in (p, high - low)))[F.col("parameter")]
    part = F.when(spans > 0, (F.col("high") - F.col("low")) / spans).otherwise(1.0)  # of the range
    leaves = leaves.withColumn("part", part).withColumn("volume", F.product("part").over(W.partitionBy("tree", "leaf")))
    each = leaves.groupBy("tree", "leaf").agg(F.first("value").alias("value"), F.first("volume").alias("volume"))
    whole = each.groupBy("tree").agg(F.sum(F.col("value") * F.col("volume")).alias("mean"), F.sum(F.col("value") ** 2 * F.col("volume")).alias("square"))
    whole = whole.select("tree", "mean", (F.col("square") - F.col("mean") ** 2).alias("variance")).where("variance > 1e-12")

    cuts = leaves.select("tree", "parameter", F.explode(F.array("low", "high")).alias("cut")).distinct()
    pieces = cuts.withColumn("next", F.lead("cut").over(W.partitionBy("tree", "parameter").orderBy("cut"))).where("next is not null")
    held = pieces.join(leaves.where("part > 0"), ["tree", "parameter"]).where("low <= cut and next <= high")
    average = held.groupBy("tree", "parameter", "cut", "next").agg(F.sum(F.col("value") * F.col("volume") / F.col("part")).alias("mean_here"))
    width = (F.col("next") - F.col("cut")) / spans
    alone = average.join(whole, "tree").groupBy("tree", "parameter").agg((F.sum(width * (F.col("mean_here") - F.col("mean")) ** 2) / F.first("variance")).alias("v"))
    out = trials.sparkSession.createDataFrame([(p,) for p in parameters], "parameter string").join(alone.groupBy("parameter").agg(F.avg("v").alias("v")), "parameter", "left")
    out = out.select("parameter", F.coalesce("v", F.lit(0.0)).alias("importance"))
    return out.withColumn("share", F.coalesce(F.try_divide("importance", F.sum("importance").over(W.partitionBy())), F.lit(0.0)))
