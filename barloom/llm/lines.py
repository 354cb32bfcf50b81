"""Line dedup by site-relative frequency.

A line is boilerplate on a host if more than `ratio` of the host's pages hold it, and at least `min_pages` do:
a floor against chance only, as one copied page repeats all its lines. With 3 pages the ratio decides from 60
pages on; a smaller host loses what 3 of its pages share, and one of under 3 pages nothing. Such lines go from
every page of that host. Only hashes of lines are shuffled to be counted, summed within tasks first; the text
moves once, by its id.

Edge cases: blank lines are no boilerplate and stay. A null text stays null and counts as a page without
lines. Null hosts are one host of their own. Rows of one id are pages of their own that lose the same
lines; a page with a null id is counted but keeps its lines. All other columns stay as they are, whatever
their names; _n_lines and _n_dropped replace columns of those names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh


def _key(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(line, F.lit(1)).alias("b"))


def drop_boilerplate(df: DataFrame, host: Column | str = "source", text: str = "text", key: str = "doc_id", ratio: float = 0.05, min_pages: int = 3) -> DataFrame:
    """`df` with the cleaned text, and _n_lines and _n_dropped."""
    host = F.col(host) if isinstance(host, str) else host
    lines = F.split(F.col(text), "\n", -1)
    full = lambda line: F.length(F.trim(line)) > 0
    site = F.coalesce(F.concat(F.lit("="), host.cast("string")), F.lit(""))
    page = df.select(F.col(key).alias("id"), site.alias("site"), F.explode(F.array_distinct(F.transform(F.filter(lines, full), _key))).alias("line"))
    common = page.groupBy("site", "line").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= min_pages)
    totals = df.groupBy(site.alias("site")).agg(F.count(F.lit(1)).alias("all_pages"))
    boilerplate = common.join(totals, "site").where(F.col("pages") > ratio * F.col("all_pages")).select("site", "line")
    owner, gone, kept = fresh(df, "_owner", "_gone", "_kept")
    lost = page.where(F.col("id").isNotNull()).join(boilerplate, ["site", "line"], "left_semi").groupBy(F.col("id").alias(owner)).agg(F.collect_set("line").alias(gone))
    out = df.join(lost, F.col(key) == F.col(owner), "left")
    out = out.withColumn(kept, F.when(F.col(gone).isNull(), lines).otherwise(F.filter(lines, lambda x: ~full(x) | ~F.array_contains(F.col(gone), _key(x)))))
    n = lambda c: F.when(F.col(text).isNull(), 0).otherwise(F.size(c)).cast("long")
    out = out.withColumns({"_n_lines": n(lines), "_n_dropped": n(lines) - n(F.col(kept)), text: F.array_join(kept, "\n")})
    return out.drop(owner, gone, kept)
