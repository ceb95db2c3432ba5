"""Predicate declarations: the fixed schema every fact and rule is checked against."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from .plans.local import small_table

SCHEMA_DDL = "pred string, arg_pos int, type string, as_constant boolean, exclusive boolean"


@dataclass(frozen=True)
class Predicate:
    """A named relation with one type per argument.

    ``constant_args`` are positions that rules may bind to constants (``+``);
    ``exclusive_args`` are positions whose values are mutually exclusive (``!``).
    """

    name: str
    types: tuple[str, ...]
    constant_args: tuple[int, ...] = ()
    exclusive_args: tuple[int, ...] = ()

    @property
    def arity(self) -> int:
        return len(self.types)


@dataclass(frozen=True)
class Schema:
    predicates: dict[str, Predicate] = field(default_factory=dict)

    @staticmethod
    def of(*decls: Predicate) -> "Schema":
        return Schema({d.name: d for d in decls})

    def __getitem__(self, name: str) -> Predicate:
        if name not in self.predicates:
            raise KeyError(f"undeclared predicate {name!r}")
        return self.predicates[name]

    def __contains__(self, name: str) -> bool:
        return name in self.predicates

    def __iter__(self):
        return iter(self.predicates.values())

    def types(self) -> list[str]:
        return sorted({t for p in self for t in p.types})

    def to_df(self, spark: SparkSession) -> DataFrame:
        rows = [
            (p.name, i, t, i in p.constant_args, i in p.exclusive_args)
            for p in self
            for i, t in enumerate(p.types)
        ]
        return small_table(spark, rows, SCHEMA_DDL)

    @staticmethod
    def from_df(df: DataFrame) -> "Schema":
        """Collect declaration rows (one per predicate argument, so small by nature)."""
        per_pred = df.groupBy("pred").agg(
            F.sort_array(F.collect_list(F.struct("arg_pos", "type", "as_constant", "exclusive"))).alias("a")
        )
        decls = []
        for row in per_pred.orderBy("pred").collect():
            args = row["a"]
            decls.append(
                Predicate(
                    row["pred"],
                    tuple(a["type"] for a in args),
                    tuple(a["arg_pos"] for a in args if a["as_constant"]),
                    tuple(a["arg_pos"] for a in args if a["exclusive"]),
                )
            )
        return Schema.of(*decls)
