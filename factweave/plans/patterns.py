"""Truth-pattern tables: for the n literals of a clause, groundings per 2^n truth pattern.

Counting groundings where all literals of a subset are true needs only joins over stored facts;
inverting the superset sums (Moebius inversion over subsets) gives the exact pattern counts, so
absent atoms are never listed.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame, functions as F

from .local import small_table
from ..facts import FactBase
from ..rules import Clause, Literal
from .counting import EXACT, Atom, pairwise_equalities, scalar_counts, signed_terms, subsets


def bit(i: int, n: int) -> int:
    """Pattern bit of literal i: the first literal is the most significant."""
    return 1 << (n - 1 - i)


def pattern_counts(clauses: list[Clause], fb: FactBase, distinct: bool = True, start: int = 0) -> DataFrame:
    """``fold, clause_id, mask, n``; a set bit of ``mask`` means the literal's atom is true (signs ignored).

    ``distinct`` counts bindings with pairwise distinct constants per type; ``start`` is added to
    every cell.
    """
    parts, base, below = [], [], []
    for c in clauses:
        n = len(c.literals)
        vt = c.var_types(fb.schema)
        base += [(f, c.clause_id, m) for f in fb.folds() for m in range(1 << n)]
        outs = pairwise_equalities(vt) if distinct else []
        for chosen in subsets(range(n)):
            upper = sum(bit(i, n) for i in chosen)
            ins = [Atom(c.literals[i].pred, c.literals[i].args) for i in chosen]
            # This superset count enters every pattern below it with alternating sign.
            below += [
                (c.clause_id, str(upper), m, (-1) ** bin(upper ^ m).count("1")) for m in range(1 << n) if m & upper == m
            ]
            parts += [((c.clause_id, str(upper)), t, vt) for t in signed_terms(ins, outs, vt)]
    signs = small_table(fb.spark, below, "clause_id string, upper string, mask int, sign int")
    sums = (
        scalar_counts(parts, fb, ["clause_id", "upper"]).join(F.broadcast(signs), ["clause_id", "upper"])
        .groupBy("fold", "clause_id", "mask").agg(F.sum((F.col("n") * F.col("sign")).cast(EXACT)).cast(EXACT).alias("n"))
    )
    cells = small_table(fb.spark, base, "fold int, clause_id string, mask int")
    zero = F.lit(0).cast(EXACT)
    return cells.join(sums, ["fold", "clause_id", "mask"], "left").select(
        "fold", "clause_id", "mask", (F.coalesce("n", zero) + F.lit(start)).cast(EXACT).alias("n")
    )


def splits(n: int) -> list[tuple[tuple[int, ...], tuple[int, ...]]]:
    """The 2^(n-1) - 1 ways to split n literals into two non-empty parts; literal 0 is in the first."""
    out = []
    for rest in subsets(range(1, n)):
        first = (0,) + rest
        if len(first) < n:
            out.append((first, tuple(i for i in range(n) if i not in first)))
    return out


def split_id(first: tuple[int, ...], n: int) -> int:
    return sum(bit(i, n) for i in first)


def part_clause(c: Clause, part: tuple[int, ...]) -> Clause:
    return Clause(tuple(c.literals[i] for i in part), clause_id=f"{c.clause_id}#{split_id(part, len(c.literals))}")


def split_pattern_counts(clauses: list[Clause], fb: FactBase, distinct: bool = True, start: int = 0) -> DataFrame:
    """``fold, clause_id, split, part, mask, n``: pattern counts of both parts of every split.

    A part is counted once per binding of its own variables.  ``split`` is the bit set of the first
    part, ``mask`` the pattern of the part's literals in clause order.
    """
    rows, parts = [], {}
    for c in clauses:
        for first, second in splits(len(c.literals)):
            for k, part in ((1, first), (2, second)):
                pc = part_clause(c, part)
                parts[pc.clause_id] = pc
                rows.append((pc.clause_id, c.clause_id, split_id(first, len(c.literals)), k))
    counts = pattern_counts(list(parts.values()), fb, distinct, start).withColumnRenamed("clause_id", "part_id")
    owners = small_table(fb.spark, rows, "part_id string, clause_id string, split int, part int")
    return counts.join(F.broadcast(owners), "part_id").select("fold", "clause_id", "split", "part", "mask", "n")


def canonical_form(literals: tuple[Literal, ...]) -> tuple:
    """Least renaming of a short literal list over all orders."""
    best = None
    for order in permutations(literals):
        names: dict[str, int] = {}
        form = []
        for l in order:
            args = tuple(
                (0, str(names.setdefault(a.name, len(names)))) if a.is_var else (1, a.name) for a in l.args
            )
            form.append((l.pred, l.positive, args))
        if best is None or tuple(form) < best:
            best = tuple(form)
    return best


def pattern_classes(literals: tuple[Literal, ...]) -> dict[int, tuple[int, int]]:
    """mask -> (representative mask, class size): sign patterns that are renamings of each other."""
    n = len(literals)
    groups: dict[tuple, list[int]] = {}
    for m in range(1 << n):
        signed = tuple(Literal(l.pred, bool(m & bit(i, n)), l.args) for i, l in enumerate(literals))
        groups.setdefault(canonical_form(signed), []).append(m)
    return {m: (ms[0], len(ms)) for ms in groups.values() for m in ms}
