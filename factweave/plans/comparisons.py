"""Counting partners of a value under a comparison without pairing the values.

``lessThan(x, y)`` between variables that no stored fact connects holds for about half of all pairs of a
fold. Where one of the two is only counted, its values are summed in order once: the number of partners
of x is a running total read off at x. The cost is a sort instead of a product.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .ordering import running_totals

EXACT = "decimal(38,0)"
# relation seen from its first argument: (partners are above, an equal partner counts)
ORDERED = {
    "lessThan": (True, False),
    "lessThanEq": (True, True),
    "greaterThan": (False, False),
    "greaterThanEq": (False, True),
}
SUCCESSOR = "succ"
COUNTABLE = frozenset([*ORDERED, SUCCESSOR])


def partner_counts(relation: str, first: bool, values: DataFrame, partners: DataFrame) -> DataFrame:
    """``fold, v, m``: for each integer of ``values`` (fold, v) the sum of n over its ``partners`` (fold, v, n).

    first: the values are the first argument of the relation. Values without a partner have no row or m = 0.
    """
    if relation == SUCCESSOR:
        step = F.expr("try_add(v, -1L)" if first else "try_add(v, 1L)")
        return partners.select("fold", step.alias("v"), F.col("n").alias("m")).filter("v IS NOT NULL")
    above, equal = ORDERED[relation]
    rows = partners.select("fold", "v", "n").unionByName(
        values.distinct().select("fold", "v", F.lit(0).cast(EXACT).alias("n"))
    )
    totals = running_totals(rows, ["fold"], "v", ["n"], descending=above == first)
    m = F.col("cum_n") if equal else F.col("cum_n") - F.col("n")
    return totals.select("fold", "v", m.cast(EXACT).alias("m"))


def weigh_by_partners(
    df: DataFrame, column: str, weight: str | None, partners: DataFrame, partner_column: str,
    partner_weight: str | None, relation: str, first: bool, positive: bool,
) -> DataFrame:
    """``df`` with column n: its weight times the number of partners with (or, negative, without) the relation.

    Constants that are no integers stand in no relation: without partners for a positive literal, partners of
    everything for a negative one.
    """
    n = (F.col(partner_weight) if partner_weight else F.lit(1)).cast(EXACT)
    sums = partners.groupBy("fold", F.col(partner_column).try_cast("bigint").alias("v")).agg(F.sum(n).cast(EXACT).alias("n"))
    keyed = df.withColumn("@v", F.col(column).try_cast("bigint"))
    values = keyed.filter("`@v` IS NOT NULL").select("fold", F.col("@v").alias("v"))
    counts = partner_counts(relation, first, values, sums.filter("v IS NOT NULL"))
    counts = counts.select("fold", F.col("v").alias("@v"), F.col("m").alias("@m"))
    if positive:
        out = keyed.join(counts, ["fold", "@v"])
        m = F.col("@m")
    else:
        everyone = sums.groupBy("fold").agg(F.sum("n").cast(EXACT).alias("@all"))  # one row a fold
        out = keyed.join(counts, ["fold", "@v"], "left").join(F.broadcast(everyone), "fold")
        m = F.col("@all") - F.coalesce("@m", F.lit(0).cast(EXACT))
    own = F.col(weight).cast(EXACT) if weight else F.lit(1).cast(EXACT)
    kept = [c for c in df.columns if c != weight]
    return out.withColumn("@n", (own * m).cast(EXACT)).filter("`@n` > 0").select(*kept, F.col("@n").alias("n"))
