"""Where jobs keep intermediate tables: the shared folder named by ``spark.checkpoint.dir``."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from .local import small_table

FILTER_BITS = 26  # of the largest filter, 8 MB
TASK_MB = 4  # of compressed shuffle in one task


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; only where none is set (tests) a fresh local one."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="factweave-")
    spark.sparkContext.setCheckpointDir(folder)
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def small_tasks(spark: SparkSession) -> None:
    """From here on adaptive execution puts at most TASK_MB of shuffle together in one task.

    Facts and ground clauses are short repetitive strings, which compress well: in the hash tables and sorts of a task
    a megabyte of shuffle takes up to a hundred, and Spark's default of 64 MB would be several gigabytes.
    """
    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    text = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    if text(spark.conf.get(name)) > TASK_MB << 20:
        spark.conf.set(name, f"{TASK_MB}m")


@contextmanager
def freeing(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is planned and run in here go when it ends, not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back; of the run only this table stays on disk."""
    path = fresh_path(df.sparkSession, name)
    with freeing(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Remove a table written by ``stored`` that no later step reads."""
    spark = df.sparkSession
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def thinned(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The rows of df whose key may be among ``keys``, a stored table: what an inner join of both drops anyway hardly reaches its shuffle.

    A bitmap of hashes, of 8 MB at most, goes beside every task of df; some rows without a partner pass.
    """
    spark = df.sparkSession
    bits = min(FILTER_BITS, max(15, (16 * keys.count()).bit_length()))
    slot = F.shiftrightunsigned(F.xxhash64(*on), 64 - bits)
    with freeing(spark):
        rows = (
            keys.select(F.shiftright(slot, 15).cast("int").alias("b"), slot.bitwiseAND(32767).alias("p"))
            .groupBy("b").agg(F.bitmap_construct_agg("p").alias("m")).collect()
        )
    words = np.zeros(1 << (bits - 6), np.int64)
    for r in rows:
        words[r["b"] << 9 : (r["b"] + 1) << 9] = np.frombuffer(bytes(r["m"]), "<i8")
    mask = small_table(spark, [(words.tolist(),)], "`@m` array<bigint>")
    word = F.get("@m", F.shiftright(slot, 6).cast("int"))
    return df.join(F.broadcast(mask), F.getbit(word, slot.bitwiseAND(63).cast("int")) == 1).drop("@m")


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder and drop the lineage: survives the loss of an executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
