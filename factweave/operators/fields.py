"""Two-level nested fields: a weighted sum of exponentials of weighted sums over child literals.

A feature has typed slots and children (literals over the slots, each with a weight).  Its value at
one grounding is exp(sum of weights of true children); the field is the weighted sum of feature
values over all groundings.  Values depend only on which children are true, so the field is a sum
over truth patterns of (pattern count x pattern value) and no grounding is listed.
"""

from __future__ import annotations

import math
import random
from dataclasses import dataclass
from itertools import product

from pyspark.sql import DataFrame, functions as F

from ..plans.local import small_table
from ..facts import FactBase, union_all
from ..plans.counting import EXACT, Atom, signed_terms, subsets, term_counts
from ..plans.patterns import bit, pattern_counts
from ..rules import EQUALS, Clause, Literal, Term
from ..schema import Schema
from .learn import softplus


@dataclass(frozen=True)
class FieldFeature:
    """Children are ``(literal, weight)``; ``weight`` scales the feature in the field."""

    name: str
    children: tuple[tuple[Literal, float], ...]
    weight: float = 1.0

    def clause(self) -> Clause:
        return Clause(tuple(l for l, _ in self.children), clause_id=self.name)

    def pattern_values(self) -> dict[int, float]:
        """Value per truth pattern; exponents below -100 count as zero."""
        k = len(self.children)
        out = {}
        for m in range(1 << k):
            s = sum(w for i, (_, w) in enumerate(self.children) if m & bit(i, k))
            out[m] = 0.0 if s < -100.0 else math.exp(s)
        return out


def _value_table(features: list[FieldFeature], fb: FactBase) -> DataFrame:
    rows = [(f.name, m, f.weight * v) for f in features for m, v in f.pattern_values().items()]
    return small_table(fb.spark, rows, "clause_id string, mask int, value double")


def field_value(features: list[FieldFeature], fb: FactBase) -> DataFrame:
    """``fold, value``: the (log) value of the field, summed over features and groundings."""
    counts = pattern_counts([f.clause() for f in features], fb, distinct=False)
    return (
        counts.join(F.broadcast(_value_table(features, fb)), ["clause_id", "mask"])
        .groupBy("fold").agg(F.sum(F.col("n").cast("double") * F.col("value")).alias("value"))
    )


def field_differences(features: list[FieldFeature], fb: FactBase, pred: str, atoms: DataFrame) -> DataFrame:
    """``fold, a0.., truth, delta``: change of the field when each listed atom is flipped.

    For every set of children that coincide with the atom, groundings are counted per pattern of the
    children; exactly-equal sets come from at-least-equal sets by inclusion-exclusion.
    """
    arity = fb.schema[pred].arity
    cols = [f"a{i}" for i in range(arity)]
    listed = fb.relation(pred).withColumn("truth", F.lit(True))
    rows = atoms.select("fold", *cols).distinct().join(listed, ["fold"] + cols, "left").withColumn(
        "truth", F.coalesce("truth", F.lit(False))
    )
    base = fb.with_set("targets", rows.select("fold", F.lit(pred).alias("pred"), F.array(*cols).alias("args")))
    keep = tuple(f"@{i}" for i in range(arity))
    pivot = Atom(pred, tuple(Term("var", v) for v in keep), "targets")
    parts = []
    for f in features:
        c = f.clause()
        k = len(c.literals)
        vt = {**c.var_types(fb.schema), **{f"@{i}": t for i, t in enumerate(fb.schema[pred].types)}}
        own = [i for i, l in enumerate(c.literals) if l.pred == pred]
        values = f.pattern_values()
        for equal in subsets(own):
            if not equal:
                continue
            eqs = [
                Atom(EQUALS, (Term("var", f"@{j}"), a)) for i in equal for j, a in enumerate(c.literals[i].args)
            ]
            others = [i for i in range(k) if i not in equal]
            # Coefficient of this "at least equal" set in every exact set inside it.
            exact_sets = [s for s in subsets(equal) if s]
            for chosen in subsets(others):
                # Superset count: these other children are true.  Expand to exact patterns below it.
                for truth in (True, False):
                    weight = 0.0
                    for s in exact_sets:
                        sign = (-1) ** (len(equal) - len(s))
                        flip = sum(bit(i, k) for i in s)
                        same = sum(bit(i, k) for i in equal if i not in s)
                        for sub in subsets(chosen):
                            mob = (-1) ** (len(chosen) - len(sub))
                            m = sum(bit(i, k) for i in sub) + (same if truth else 0)
                            before = values[m + (flip if truth else 0)]
                            after = values[m + (0 if truth else flip)]
                            weight += sign * mob * (after - before)
                    if weight == 0.0:
                        continue
                    ins = [pivot] + eqs + [Atom(c.literals[i].pred, c.literals[i].args) for i in chosen]
                    for t in signed_terms(ins, [], vt, keep):
                        parts.append(
                            term_counts(base, t, vt).select(
                                "fold", *[F.col(f"k_@{i}").alias(cols[i]) for i in range(arity)],
                                F.lit(truth).alias("truth"), (F.col("n").cast("double") * (weight * f.weight)).alias("d"),
                            )
                        )
    key = ["fold"] + cols + ["truth"]
    if not parts:
        return rows.withColumn("delta", F.lit(0.0))
    sums = union_all(parts).groupBy(*key).agg(F.sum("d").alias("delta"))
    return rows.join(sums, key, "left").withColumn("delta", F.coalesce("delta", F.lit(0.0)))


def field_lpl(features: list[FieldFeature], fb: FactBase, pred: str, atoms: DataFrame) -> DataFrame:
    """``fold, lpl``: mean over the atoms of -log(1 + exp(log value flipped - log value))."""
    d = field_differences(features, fb, pred, atoms)
    return d.groupBy("fold").agg(F.avg(-softplus(F.col("delta"))).alias("lpl"))


def _slots(schema: Schema, per_type: dict[str, int]) -> dict[str, list[Term]]:
    return {t: [Term("var", f"{t.lower()}{i}") for i in range(n)] for t, n in per_type.items()}


def complete_feature(schema: Schema, per_type: dict[str, int], name: str = "complete") -> FieldFeature:
    """All predicates under all mappings of their arguments to the typed slots, weights zero."""
    slots = _slots(schema, per_type)
    children = []
    for p in schema:
        for args in product(*[slots.get(t, []) for t in p.types]):
            children.append((Literal(p.name, True, args), 0.0))
    return FieldFeature(name, tuple(children))


def random_feature(
    schema: Schema, per_type: dict[str, int], k: int, query: list[str], seed: int, name: str = "random"
) -> FieldFeature:
    """k random children over the slots, at least one of them a query predicate."""
    rng = random.Random(seed)
    slots = _slots(schema, per_type)
    usable = [p for p in schema if all(slots.get(t) for t in p.types)]
    if not any(p.name in query for p in usable):
        raise ValueError("no query predicate fits the slots")
    while True:
        children = []
        for _ in range(k):
            p = rng.choice(usable)
            children.append((Literal(p.name, True, tuple(rng.choice(slots[t]) for t in p.types)), 0.0))
        if any(l.pred in query for l, _ in children):
            return FieldFeature(name, tuple(children))
