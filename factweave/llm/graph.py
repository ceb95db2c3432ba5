"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..plans.storage import freeing
from . import common as C


def _min_of(edges: DataFrame) -> DataFrame:
    """Smallest neighbour (or itself) of each node; map-side combined, so hubs do not meet in one task."""
    return edges.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge; root is the smallest node of the component.

    Alternates two steps until the edges no longer change: larger neighbours move to the smallest
    neighbour of a node, then smaller ones do. Columns: a, b (bigint). An empty list gives no rows.
    """
    fold = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    now = C.materialise(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )

    def total():
        with freeing(edges.sparkSession):
            return now.agg(F.count(F.lit(1)), fold).first()

    seen = total()
    while seen[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = (
            both.join(_min_of(both), "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        )
        joined = large.join(_min_of(large), "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            joined.select("a", F.col("m").alias("b"))
        )
        new = C.materialise(small.filter("a <> b").distinct(), "edges")
        C.drop_table(now)
        now, before = new, seen
        seen = total()
        if seen == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
