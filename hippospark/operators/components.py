"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hippospark.functions.storage import forget, saved


def _least(edges: DataFrame, both: DataFrame) -> DataFrame:
    return both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Nodes with an edge: node, component (the least node reachable).

    Each round links every node's larger neighbours to its least neighbour, then its smaller ones; edges never grow in
    number and the rounds are logarithmic in the component's size. Minima are pre-aggregated, so a hub costs no task more
    than a partial aggregate; its join is a skew join that adaptive execution splits.
    """
    e = saved(edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where("u <> v").distinct(), "edges")
    sign = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == sign:
            break
        sign = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(e, both).hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        small = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = small.groupBy("u").agg(F.min("v").alias("m"))
        star = small.join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        old, e = e, saved(star.where("u <> v").distinct(), "edges")
        forget(old)
    return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
