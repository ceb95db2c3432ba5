"""Small driver-side tables (rule lists, weights, totals per fold) as local relations.

A local relation has known size, needs no job to broadcast and is folded by the optimizer.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.pandas.types import to_arrow_schema


def _plain(value, type_: T.DataType):
    """Tuples become dicts where the type is a struct, as Arrow expects."""
    if value is None:
        return None
    if isinstance(type_, T.StructType):
        return {f.name: _plain(v, f.dataType) for f, v in zip(type_.fields, value)}
    if isinstance(type_, T.ArrayType):
        return [_plain(v, type_.elementType) for v in value]
    if isinstance(type_, T.MapType):
        return list(value.items())
    return value


def small_table(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    schema = T.StructType.fromDDL(ddl)
    arrow = pa.Table.from_pylist([_plain(r, schema) for r in rows], schema=to_arrow_schema(schema))
    return spark.createDataFrame(arrow, schema)
