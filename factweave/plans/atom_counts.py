"""Per-atom count differences.

For clause c and ground atom A, n_c(A) is the number of true groundings of c containing A after
flipping A, minus the number as observed.  Only groundings whose other literals are all false
change, so n_c(A) is again a signed sum of binding counts, now kept per argument of A.

Listed-true atoms give at most one row per fact.  Absent atoms are far too many to list, but each
signed term factors over the connected parts of the rule body: a part that touches one argument is
a table per constant of that argument, a part that touches several arguments is a table of explicit
atoms, and a part that touches none is one number per fold.  ``AtomCounts`` keeps that form:

    n_c(A) = sum over terms  coef * product over arguments f_t(argument)      (A not listed)
           + sum over explicit rows for A
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import DataFrame, functions as F

from .local import small_table
from ..facts import FactBase, union_all
from ..rules import EQUALS, Clause, Literal, Term, plain_only
from .counting import (
    EXACT,
    Atom,
    CountTerm,
    Guard,
    join_count,
    requirements,
    signed_terms,
    subsets,
    term_counts,
    unify,
    vcol,
)


def _args(p: int) -> list[Term]:
    return [Term("var", f"@{i}") for i in range(p)]


@dataclass(frozen=True)
class PivotTerm:
    clause: Clause
    term: CountTerm
    var_types: tuple[tuple[str, str], ...]


def pivot_terms(c: Clause, pred: str, fb: FactBase, listed: bool) -> list[PivotTerm]:
    """Signed count terms whose sum is n_c(A) for atoms A of ``pred`` that are listed (or absent).

    The variables ``@0, @1, ...`` stand for the arguments of A.
    """
    arity = fb.schema[pred].arity
    vt = dict(c.var_types(fb.schema))
    for i, t in enumerate(fb.schema[pred].types):
        vt[f"@{i}"] = t
    keep = tuple(f"@{i}" for i in range(arity))
    lits = list(c.literals)
    pos = [i for i, l in enumerate(lits) if l.pred == pred and l.positive]
    neg = [i for i, l in enumerate(lits) if l.pred == pred and not l.positive]
    if not pos and not neg:
        return []
    false_side, true_side = (neg, pos) if listed else (pos, neg)
    pivot = [Atom(pred, tuple(_args(arity)))] if listed else []
    out: list[PivotTerm] = []

    def emit(coef: int, equal: tuple[int, ...], rest: list[int]) -> None:
        ins, outs, guards = requirements([lits[i] for i in rest], fb)
        eqs = [
            Atom(EQUALS, (Term("var", f"@{k}"), a)) for i in equal for k, a in enumerate(lits[i].args)
        ]
        for t in signed_terms(pivot + eqs + ins, outs, vt, keep, guards):
            out.append(PivotTerm(c, CountTerm(coef * t.coef, t.atoms, t.guards, t.keep, t.free), tuple(vt.items())))

    everything = range(len(lits))
    # Literal false as observed: the flip makes it true.  Count each false grounding once.
    for chosen in subsets(false_side):
        if chosen:
            emit((-1) ** (len(chosen) + 1), chosen, [i for i in everything if i not in chosen])
    # Literal true as observed: the flip makes it false.  The literals equal to A are exactly
    # ``chosen``; an opposite-signed literal equal to A would keep the grounding true.
    for chosen in subsets(true_side):
        if not chosen:
            continue
        for same in subsets(false_side):
            rest = [i for i in everything if i not in chosen and i not in same]
            emit(-((-1) ** len(same)), chosen + same, rest)
    return _merge(out)


def _merge(terms: list[PivotTerm]) -> list[PivotTerm]:
    acc: dict[tuple, tuple[int, PivotTerm]] = {}
    for p in terms:
        key = (p.term.atoms, p.term.guards, p.term.keep, p.term.free)
        coef = acc[key][0] if key in acc else 0
        acc[key] = (coef + p.term.coef, p)
    return [
        PivotTerm(p.clause, CountTerm(coef, p.term.atoms, p.term.guards, p.term.keep, p.term.free), p.var_types)
        for coef, p in acc.values()
        if coef
    ]


@dataclass(frozen=True)
class FactorTerm:
    """One product term for absent atoms: which arguments it depends on and its number per fold."""

    term_id: int
    clause_id: str
    args: tuple[int, ...]
    coef: dict[int, int]


@dataclass
class AtomCounts:
    fb: FactBase
    pred: str
    clauses: tuple[str, ...]
    listed: DataFrame | None  # fold, clause_id, a0.., n       listed-true atoms
    joint: DataFrame | None  # fold, clause_id, a0.., n        explicit absent atoms (may contain listed ones)
    single: DataFrame | None  # fold, term_id, clause_id, pos, const, n
    terms: list[FactorTerm]

    @property
    def arity(self) -> int:
        return self.fb.schema[self.pred].arity

    def arg_cols(self) -> list[str]:
        return [f"a{i}" for i in range(self.arity)]


def _components(term: CountTerm) -> list[tuple[list[Atom], list[Guard], set[str]]]:
    """Connected parts of a term's body, linked by shared variables."""
    groups: list[tuple[list, set[str]]] = []
    for item in list(term.atoms) + list(term.guards):
        vs = set(item.variables())
        hit = [g for g in groups if g[1] & vs]
        merged = ([item], set(vs))
        for g in hit:
            merged[0].extend(g[0])
            merged[1].update(g[1])
            groups.remove(g)
        groups.append(merged)
    return [
        ([x for x in items if isinstance(x, Atom)], [x for x in items if isinstance(x, Guard)], vs)
        for items, vs in groups
    ]


def atom_counts(clauses: list[Clause], pred: str, fb: FactBase) -> AtomCounts:
    """Count differences of all clauses for the atoms of one predicate, listed and absent."""
    plain_only(clauses, "a count difference")
    arity = fb.schema[pred].arity
    cols = [f"a{i}" for i in range(arity)]
    folds = fb.folds()
    listed, joint, single, terms = [], [], [], []
    scalars: list[tuple[int, DataFrame]] = []
    pending: list[dict] = []
    for c in clauses:
        for p in pivot_terms(c, pred, fb, listed=True):
            df = term_counts(fb, p.term, dict(p.var_types))
            listed.append(
                df.select("fold", F.lit(c.clause_id).alias("clause_id"),
                          *[F.col(f"k_@{i}").alias(f"a{i}") for i in range(arity)], "n")
            )
        for p in pivot_terms(c, pred, fb, listed=False):
            t, vt = p.term, dict(p.var_types)
            value = {f: t.coef for f in folds}
            for f in folds:
                for ty in t.free:
                    value[f] *= fb.size(f, ty)
            kept = [tm for _, tm in t.keep]
            tid = len(pending)
            info = {"id": tid, "clause": c.clause_id, "args": [], "coef": value}
            pending.append(info)
            parts = _components(t)
            done: set[int] = set()
            for i, tm in enumerate(kept):
                if not tm.is_var:  # argument fixed to a constant by the rule
                    rows = [(f, tm.name, 1) for f in folds]
                    df = small_table(fb.spark, rows, "fold int, const string, n bigint")
                    single.append(_single(df, tid, c.clause_id, i))
                    info["args"].append(i)
                    done.add(i)
            for atoms, guards, vs in parts:
                touched = [i for i, tm in enumerate(kept) if tm.is_var and tm.name in vs]
                carriers = tuple(dict.fromkeys(kept[i].name for i in touched))
                df = join_count(fb, tuple(atoms), tuple(guards), carriers, vt)
                done.update(touched)
                if not touched:
                    scalars.append((tid, df))
                elif len(touched) == 1:
                    df = df.select("fold", F.col(vcol(carriers[0])).alias("const"), "n")
                    single.append(_single(df, tid, c.clause_id, touched[0]))
                    info["args"].append(touched[0])
                else:
                    info.setdefault("joint", []).append((touched, df))
            left = [i for i in range(arity) if i not in done]
            by_var: dict[str, list[int]] = {}
            for i in left:
                by_var.setdefault(kept[i].name, []).append(i)
            for name, positions in by_var.items():
                if len(positions) > 1:  # repeated unconstrained argument, e.g. R(x,x)
                    df = fb.constants_of(vt[name]).select(
                        "fold", F.col("const").alias(vcol(name)), F.lit(1).cast("bigint").alias("n")
                    )
                    info.setdefault("joint", []).append((positions, df))
            info["kept"] = kept
    factors = _scalar_values(fb, scalars)
    for info in pending:
        coef = {f: v * factors.get((info["id"], f), 1 if info["id"] not in {t for t, _ in scalars} else 0)
                for f, v in info["coef"].items()}
        parts = info.get("joint")
        if not parts:
            terms.append(FactorTerm(info["id"], info["clause"], tuple(sorted(info["args"])), coef))
            continue
        positions, df = parts[0]
        if len(parts) > 1 or len(positions) < arity:
            raise NotImplementedError(
                f"absent atoms of {pred} in clause {info['clause']}: arguments {positions} are bound together "
                "but not with the rest; list the atoms to be scored instead"
            )
        kept = info["kept"]
        n = (F.col("n").cast(EXACT) * fb.per_fold(coef)).cast(EXACT)
        joint.append(
            df.select("fold", F.lit(info["clause"]).alias("clause_id"),
                      *[F.col(vcol(kept[i].name)).alias(f"a{i}") for i in range(arity)], n.alias("n"))
        )
    key = ["fold", "clause_id"] + cols

    def total(parts):
        if not parts:
            return None
        return union_all(parts).groupBy(*key).agg(F.sum("n").cast(EXACT).alias("n")).filter("n != 0")

    used = {t.term_id for t in terms}
    tables = [df for tid, df in single if tid in used]
    return AtomCounts(
        fb, pred, tuple(c.clause_id for c in clauses), total(listed), total(joint),
        union_all(tables) if tables else None, [t for t in terms if any(t.coef.values())],
    )


def _single(df: DataFrame, tid: int, clause_id: str, pos: int) -> tuple[int, DataFrame]:
    return tid, df.select(
        "fold", F.lit(tid).alias("term_id"), F.lit(clause_id).alias("clause_id"), F.lit(pos).alias("pos"), "const", "n"
    )


def _scalar_values(fb: FactBase, scalars: list[tuple[int, DataFrame]]) -> dict[tuple[int, int], int]:
    """Body parts that touch no argument: one number per term and fold, all from one job."""
    if not scalars:
        return {}
    tagged = [
        df.select(F.lit(k).alias("k"), F.lit(tid).alias("term_id"), "fold", F.col("n").cast(EXACT).alias("n"))
        for k, (tid, df) in enumerate(scalars)
    ]
    out: dict[tuple[int, int], int] = {}
    missing = {(tid, f) for tid, _ in scalars for f in fb.folds()}
    seen: dict[tuple[int, int], int] = {}
    for r in union_all(tagged).collect():
        key = (r["term_id"], r["fold"])
        out[key] = out.get(key, 1) * int(r["n"])
        seen[key] = seen.get(key, 0) + 1
    need: dict[int, int] = {}
    for tid, _ in scalars:
        need[tid] = need.get(tid, 0) + 1
    for key in missing:
        if seen.get(key, 0) < need[key[0]]:
            out[key] = 0  # a part without any match makes the product zero
    return out


def counts_for_atoms(ac: AtomCounts, atoms: DataFrame) -> DataFrame:
    """n_c for given atoms (``fold, a0, ...``): ``fold, a0.., truth, clause_id, n`` with n != 0.

    The atoms are a listed table, so this is the form used for query atoms and for samples.
    """
    fb, cols = ac.fb, ac.arg_cols()
    key = ["fold"] + cols
    true = fb.relation(ac.pred).withColumn("listed", F.lit(True))
    tagged = (
        atoms.select(*key).distinct().join(true, key, "left")
        .select(*key, F.coalesce("listed", F.lit(False)).alias("truth"))
    )
    parts = []
    if ac.listed is not None:
        parts.append(tagged.filter("truth").join(ac.listed, key).select(*key, "truth", "clause_id", "n"))
    absent = tagged.filter(~F.col("truth"))
    if ac.joint is not None:
        parts.append(absent.join(ac.joint, key).select(*key, "truth", "clause_id", "n"))
    for t in ac.terms:
        df = absent.withColumn("n", fb.per_fold(t.coef))
        for pos in t.args:
            f = ac.single.filter((F.col("term_id") == t.term_id) & (F.col("pos") == pos)).select(
                "fold", F.col("const").alias(f"a{pos}"), F.col("n").alias("m")
            )
            df = df.join(f, ["fold", f"a{pos}"]).withColumn("n", (F.col("n") * F.col("m")).cast(EXACT)).drop("m")
        parts.append(df.select(*key, "truth", F.lit(t.clause_id).alias("clause_id"), F.col("n").cast(EXACT)))
    return (
        union_all(parts)
        .groupBy(*key, "truth", "clause_id")
        .agg(F.sum("n").cast(EXACT).alias("n"))
        .filter("n != 0")
    )
