"""Positions and running totals over a whole table without putting it into one task.

A plain window without a partition key sends every row to one task.  Here rows are first put into
ordered buckets, bucket totals (a bounded table) give each bucket its offset, and the window runs
inside buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .storage import cut

HASH_BUCKETS = 1 << 14


def hashed_positions(df: DataFrame, strata: list[str], key: list[str], seed: int, name: str = "pos") -> DataFrame:
    """1-based position of each row within its stratum, in the order of a seeded hash of its key.

    The hash spreads rows evenly over buckets whatever the data looks like, so a stratum that holds
    a third of all rows is still split over many tasks.
    """
    h = F.xxhash64(F.lit(seed), *[F.col(k) for k in key])
    rows = df.withColumns({"@h": h, "@b": F.pmod(F.shiftright(h, 40), F.lit(HASH_BUCKETS)).cast("int")})
    counts = rows.groupBy(*strata, "@b").agg(F.count(F.lit(1)).alias("@c"))
    order = W.partitionBy(*strata).orderBy("@b")
    offsets = counts.withColumn("@o", F.sum("@c").over(order) - F.col("@c")).drop("@c")
    inner = W.partitionBy(*strata, "@b").orderBy("@h", *key)
    ranked = rows.withColumn("@r", F.row_number().over(inner))
    return (
        ranked.join(offsets, strata + ["@b"])
        .withColumn(name, (F.col("@r") + F.col("@o")).cast("bigint"))
        .drop("@h", "@b", "@r", "@o")
    )


def ordered_positions(df: DataFrame, order: list[Column], name: str = "pos") -> DataFrame:
    """1-based position in a total order over the whole table.

    Rows are range-partitioned and sorted on all order columns together (so ties on the first column
    still spread), numbered inside partitions, and stored; partition totals, one row per partition,
    give the offsets.
    """
    numbered = cut(df.orderBy(*order).withColumn("@id", F.monotonically_increasing_id()))
    part = F.shiftright("@id", 33)
    totals = numbered.groupBy(part.alias("@part")).agg(F.count(F.lit(1)).alias("@n"))
    offsets = totals.withColumn("@o", F.sum("@n").over(W.orderBy("@part")) - F.col("@n")).drop("@n")
    inside = F.col("@id") - F.shiftleft(part, 33)
    return (
        numbered.withColumn("@part", part).join(F.broadcast(offsets), "@part")
        .withColumn(name, (F.col("@o") + inside + 1).cast("bigint")).drop("@id", "@part", "@o")
    )


def bucket_of(value: Column, bounds: list[float]) -> Column:
    """Number of bounds below the value, as a balanced tree of comparisons."""
    if not bounds:
        return F.lit(0)

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(value <= F.lit(bounds[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return tree(0, len(bounds))


def running_totals(df: DataFrame, by: list[str], order: str, values: list[str], descending: bool = True) -> DataFrame:
    """Cumulative sums of ``values`` over distinct ``order`` values within ``by``: adds ``cum_<value>``.

    Equal order values are summed first, so the frame is the range frame. The sums are range-partitioned on
    (by, order) and stored; totals per group and partition, a table in proportion to groups plus partitions, give
    the offsets, and the windows stay inside partitions. A group of any size is spread like any other rows.
    """
    sums = df.groupBy(*by, order).agg(*[F.sum(v).alias(v) for v in values])
    key = F.col(order).desc() if descending else F.col(order).asc()
    rows = cut(sums.orderBy(*by, key).withColumn("@part", F.spark_partition_id()))
    totals = rows.groupBy(*by, "@part").agg(*[F.sum(v).alias(v) for v in values])
    before = W.partitionBy(*by).orderBy("@part") if by else W.orderBy("@part")
    offsets = totals.select(*by, "@part", *[(F.sum(v).over(before) - F.col(v)).alias(f"@o_{v}") for v in values])
    inner = W.partitionBy(*by, "@part").orderBy(key)
    out = rows.withColumns({f"@c_{v}": F.sum(v).over(inner) for v in values}).join(offsets, by + ["@part"])
    return out.select(
        *by, order, *values, *[(F.col(f"@c_{v}") + F.col(f"@o_{v}")).alias(f"cum_{v}") for v in values]
    )
