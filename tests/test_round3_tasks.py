"""Adaptive execution does not put so much shuffle together that a task outgrows its memory."""

import pytest
from pyspark.sql import functions as F

from factweave.plans import storage
from factweave.sources.tables import view_fact_base

ADVISORY = "spark.sql.adaptive.advisoryPartitionSizeInBytes"


@pytest.fixture
def advisory(spark):
    before = spark.conf.get(ADVISORY)
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    yield lambda size: spark.conf.set(ADVISORY, size)
    spark.conf.set(ADVISORY, before)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)


def test_a_fact_base_limits_the_shuffle_of_a_task(spark, advisory, tmp_path):
    advisory("64m")
    spark.createDataFrame([(1, 2)], "o_custkey long, o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    view_fact_base(spark, str(tmp_path), ["Placed"])
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    # digests do not compress: about 70 MB of shuffle
    rows = spark.range(2_000_000, numPartitions=2).select(F.sha2(F.col("id").cast("string"), 256).alias("k"))
    tasks = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).select(F.spark_partition_id().alias("p"), "n")
    got = tasks.groupBy("p").agg(F.sum("n").alias("n")).collect()
    assert sum(r["n"] for r in got) == 2_000_000
    assert max(r["n"] for r in got) < 250_000  # without the limit four tasks share them


def test_a_smaller_limit_of_the_session_stays(spark, advisory):
    advisory("512k")
    storage.small_tasks(spark)
    assert spark.conf.get(ADVISORY) == "512k"
