"""Sharding by sampled splitters, with DataFrame functions only.

Records are ordered by a hash of their text, so equal texts are neighbours. A size-weighted sample of
the keys gives the splitters of many ranges; a range that turns out overfull is subdivided by more
splitters, a group of equal texts that is too large for one unit by a hash of its rows' places in the stored sizes. Exact byte
totals of the ranges and units then give every unit its place on the line of all bytes, which is cut
into equal shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..plans.ordering import bucket_of
from . import common as C

OVERHEAD = 16  # bytes counted for each record beside its text
SAMPLES_PER_RANGE = 64
MAX_RANGES = 1024  # splitters to begin with; overfull ranges get more until none is over its share


def _quantiles(sample: DataFrame, n: int) -> list[int]:
    """n - 1 boundaries of n equal parts of a sample of bounded size."""
    row = sample.agg(F.percentile_approx("h", [i / n for i in range(1, n)], 100 * n).alias("q")).first()
    return sorted(set(row["q"] or []))


def _drawn(rows: DataFrame, total: int, samples: int) -> DataFrame:
    """Every record is drawn with a chance in proportion to its size, by a hash of its place and fields."""
    u = F.shiftrightunsigned(F.xxhash64(F.lit(17), "h", "at", "crc"), 11) / F.lit(float(1 << 53))
    return rows.filter(u * F.lit(float(total)) < F.col("size") * F.lit(float(samples)))


def shards(
    docs: DataFrame, n_shards: int, *, key: str = "doc_id", text: str = "text", units_per_shard: int = 512,
    ranges_per_shard: int = 8,
) -> DataFrame:
    """Assigns every record to a shard so that the bytes of the shards are near equal.

    Returns key, size (UTF-8 bytes and 16; a null text has none), text_crc32, shard and slot (0, 1, ...
    in each shard). Records of equal text form a group; a group stays in one shard unless its bytes exceed
    1/units_per_shard of a shard, in which case it is cut into that many parts. A null text is grouped with
    the empty one. Repeated rows and rows without id each get their own slot and are cut like others; null ids come first in their unit; an empty table
    gives an empty result; other columns are ignored.
    """
    text_ = C.whole_text(text)
    rows = C.materialise(
        docs.select(
            F.col(key).cast("bigint").alias("key"), (F.octet_length(text_) + OVERHEAD).cast("bigint").alias("size"),
            F.crc32(text_.cast("binary")).alias("crc"), F.xxhash64(text_).alias("h"), F.monotonically_increasing_id().alias("at"),
        ),
        "sizes",
    )
    total, n_rows = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    unit = max(1, total // (n_shards * units_per_shard))
    n_ranges = max(1, min(MAX_RANGES, n_shards * ranges_per_shard, n_rows // 16 + 1))
    bounds = _quantiles(_drawn(rows, total, n_ranges * SAMPLES_PER_RANGE), n_ranges)

    groups = rows.groupBy("h").agg(F.sum("size").alias("bytes"))
    # at most n_shards * units_per_shard groups can be larger than a unit
    large = C.materialise(
        groups.filter(F.col("bytes") > unit).select("h", F.ceil(F.col("bytes") / F.lit(unit)).cast("int").alias("parts")),
        "large_groups",
    )
    # ranges that hold more than twice their share without their large groups get splitters of their own
    ranged = C.materialise(
        rows.join(F.broadcast(large), "h", "left")
        .withColumn("part", F.when(F.col("parts").isNull(), 0).otherwise(
            F.pmod(F.xxhash64(F.lit(29), "at", "h"), F.col("parts")).cast("int")))
        .groupBy("h", "part", F.col("parts").isNotNull().alias("cut"))
        .agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")),
        "units",
    )
    light = ranged.filter(~F.col("cut"))
    while True:
        share = max(1, 2 * total // n_ranges)
        over = [
            r["g"] for r in light.groupBy(bucket_of(F.col("h"), bounds).alias("g")).agg(F.sum("bytes").alias("b"))
            .filter(F.col("b") > share).collect()
        ]
        inside = light.filter(bucket_of(F.col("h"), bounds).isin(over)) if over else None
        extra = set(_quantiles(inside, 2 * len(over) + 1)) - set(bounds) if over else set()
        if not extra:
            break
        bounds = sorted({*bounds, *extra})

    placed = ranged.withColumn("g", bucket_of(F.col("h"), bounds))
    per_range = placed.groupBy("g").agg(F.sum("bytes").alias("b"))  # fewer than half of the ranges can be overfull at a time
    offsets = per_range.select("g", (F.sum("b").over(W.orderBy("g")) - F.col("b")).alias("before"))
    line = W.partitionBy("g").orderBy("h", "part")
    middle = F.col("before") + F.sum("bytes").over(line) - F.col("bytes") + F.col("bytes") / 2
    units = placed.join(F.broadcast(offsets), "g").withColumn(
        "shard", F.least(F.lit(n_shards - 1), F.floor(middle * n_shards / F.lit(max(total, 1)))).cast("int")
    )
    # slots: rows before the unit in its shard, by range and then inside the range
    by_range = units.groupBy("shard", "g").agg(F.sum("n").alias("n_range"))
    ahead = by_range.select(
        "shard", "g", (F.sum("n_range").over(W.partitionBy("shard").orderBy("g")) - F.col("n_range")).alias("rows_before")
    )
    inside = W.partitionBy("shard", "g").orderBy("h", "part")
    units = units.join(F.broadcast(ahead), ["shard", "g"]).select(
        "h", "part", "shard", (F.col("rows_before") + F.sum("n").over(inside) - F.col("n")).alias("first_slot")
    )
    salted = rows.join(F.broadcast(large), "h", "left").withColumn(
        "part", F.when(F.col("parts").isNull(), 0).otherwise(
            F.pmod(F.xxhash64(F.lit(29), "at", "h"), F.col("parts")).cast("int"))
    )
    numbered = salted.withColumn("@r", F.row_number().over(W.partitionBy("h", "part").orderBy("key", "size", "crc", "at")))
    return numbered.join(units, ["h", "part"]).select(
        F.col("key").alias(key), "size", F.col("crc").alias("text_crc32"), "shard",
        (F.col("first_slot") + F.col("@r") - 1).cast("bigint").alias("slot"),
    )


def grown_shard() -> Column:
    """Only the law ``key`` has one."""
    return F.lit(None).cast("int")
