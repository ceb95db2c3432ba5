"""The fact base: typed ground facts held as DataFrames.

Long form of a fact: ``fold INT, pred STRING, args ARRAY<STRING>, truth STRING`` where truth is
``true``, ``false`` or ``unknown``.  ``FactBase.relation`` narrows that table to one predicate with
one column per argument; when the long table is a union of per-table projections, the filter on the
literal predicate name prunes every other branch, so only the needed columns are scanned.
"""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .plans.storage import freeing
from .schema import Schema

FACTS_DDL = "fold int, pred string, args array<string>, truth string"


def union_all(dfs: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, dfs)


class FactBase:
    """Facts plus their schema, with per-type constant counts computed once and kept on the driver.

    Driver-side state is limited to one number per (fold, type) and per (fold, predicate).
    """

    def __init__(
        self,
        schema: Schema,
        facts: DataFrame,
        open_world: tuple[str, ...] = (),
        extra_constants: DataFrame | None = None,
    ):
        self.schema = schema
        self.facts = facts
        self.open_world = frozenset(open_world)
        self.extra_constants = extra_constants
        self._sets: dict[str, DataFrame] = {}
        self._relations: dict[tuple[str, str], DataFrame] = {}
        self._sizes: dict[tuple[int, str], int] | None = None
        self._totals: dict[tuple[int, str], int] | None = None

    @property
    def spark(self) -> SparkSession:
        return self.facts.sparkSession

    def with_set(self, name: str, atoms: DataFrame) -> "FactBase":
        """Same facts with one more named atom set (``fold, pred, args``), e.g. the query atoms."""
        other = FactBase(self.schema, self.facts, tuple(self.open_world), self.extra_constants)
        other._sets = {**self._sets, name: atoms}
        other._relations = dict(self._relations)
        other._sizes, other._totals = self._sizes, self._totals
        return other

    def relation(self, pred: str, which: str = "true") -> DataFrame:
        """Distinct atoms of one predicate as ``fold, a0, a1, ...``."""
        key = (pred, which)
        if key not in self._relations:
            decl = self.schema[pred]
            src = self._sets.get(which)
            if src is None:
                src = self.facts.filter(F.col("truth") == which)
            self._relations[key] = (
                src.filter(F.col("pred") == pred)
                .select("fold", *[F.col("args")[i].alias(f"a{i}") for i in range(decl.arity)])
                .distinct()
            )
        return self._relations[key]

    def persist(self, *preds: str) -> "FactBase":
        """Keep true relations that several terms of a job re-read; recomputable if an executor is lost."""
        for pred in preds or tuple(p.name for p in self.schema):
            key = (pred, "true")
            self._relations[key] = self.relation(pred).persist(StorageLevel.MEMORY_AND_DISK)
        return self

    def unpersist(self) -> None:
        for df in self._relations.values():
            df.unpersist()

    def constants(self) -> DataFrame:
        """Distinct ``fold, type, const`` over all arguments of all facts, whatever their truth."""
        parts = []
        for decl in self.schema:
            for i, t in enumerate(decl.types):
                parts.append(
                    self.facts.filter(F.col("pred") == decl.name).select(
                        "fold", F.lit(t).alias("type"), F.col("args")[i].alias("const")
                    )
                )
        if self.extra_constants is not None:
            parts.append(self.extra_constants.select("fold", "type", "const"))
        return union_all(parts).distinct()

    def constants_of(self, type_: str) -> DataFrame:
        return self.constants().filter(F.col("type") == type_).select("fold", "const")

    def domain_sizes(self) -> dict[tuple[int, str], int]:
        if self._sizes is None:
            with freeing(self.spark):
                rows = self.constants().groupBy("fold", "type").count().collect()
            self._sizes = {(r["fold"], r["type"]): r["count"] for r in rows}
            missing = [t for t in self.schema.types() if not any(k[1] == t for k in self._sizes)]
            if missing:
                raise ValueError(f"types without constants: {missing}")
        return self._sizes

    def folds(self) -> list[int]:
        return sorted({f for f, _ in self.domain_sizes()})

    def size(self, fold: int, type_: str) -> int:
        return self.domain_sizes().get((fold, type_), 0)

    def possible(self, fold: int, pred: str) -> int:
        """Number of possible ground atoms of a predicate in a fold."""
        n = 1
        for t in self.schema[pred].types:
            n *= self.size(fold, t)
        return n

    def true_totals(self) -> dict[tuple[int, str], int]:
        """Number of distinct true facts per (fold, predicate)."""
        if self._totals is None:
            parts = [
                self.relation(p.name).groupBy("fold").count().select("fold", F.lit(p.name).alias("pred"), "count")
                for p in self.schema
            ]
            with freeing(self.spark):
                self._totals = {(r["fold"], r["pred"]): r["count"] for r in union_all(parts).collect()}
        return self._totals

    def per_fold(self, values: dict[int, int | float], type_: str = "decimal(38,0)") -> Column:
        """A Column giving a small driver-side number per fold."""
        vals = set(values.values())
        if len(vals) == 1:
            return F.lit(str(next(iter(vals)))).cast(type_)
        pairs: list[Column] = []
        for k, v in sorted(values.items()):
            pairs += [F.lit(int(k)), F.lit(str(v)).cast(type_)]
        return F.create_map(*pairs)[F.col("fold")]

    def size_product(self, types: list[str]) -> Column:
        out = {}
        for f in self.folds():
            n = 1
            for t in types:
                n *= self.size(f, t)
            out[f] = n
        return self.per_fold(out)
