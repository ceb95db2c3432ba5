"""Relational features of atoms, independence tests between them, Markov blankets, blanket rules."""

from __future__ import annotations

from itertools import combinations, product

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.local import small_table
from ..facts import FactBase, union_all
from ..plans.counting import Atom, count_bindings, pairwise_equalities, subsets
from ..rules import EQUALS, Clause, Literal, Term
from ..schema import Schema

# Fixed table: chi-square quantiles with one degree of freedom and their significance level.
CHI2_LEVELS = [
    (7.882, 0.005), (6.637, 0.01), (5.025, 0.025), (3.843, 0.05), (2.706, 0.1), (1.323, 0.25), (0.455, 0.5),
    (0.102, 0.7), (0.016, 0.9), (0.004, 0.95),
]
CHI2_LAST = 0.975


def feature_shapes(schema: Schema, target: str, max_facts: int = 2, max_free: int = 1) -> dict[str, tuple[Literal, ...]]:
    """Shapes of one or two facts around an atom of the target predicate.

    Arguments that repeat a constant of the target atom are its positions 0, 1, ..., others are free
    (``f0``, ``f1``).  The first fact shares a constant with the target, the second with the first;
    the target atom itself is not a feature, and facts with a repeated constant are skipped.
    """
    decl = schema[target]
    pos_types = {f"t{i}": t for i, t in enumerate(decl.types)}
    identity = (target, tuple(f"t{i}" for i in range(decl.arity)))

    def facts(types: dict[str, str], free_used: int):
        for p in schema:
            options = []
            for t in p.types:
                opts = [v for v, vt in types.items() if vt == t]
                opts += [f"f{j}" for j in range(free_used, max_free)]
                options.append(opts)
            for names in product(*options):
                if len(set(names)) < len(names) or (p.name, names) == identity:
                    continue
                fresh = [v for v in names if v not in types]
                if fresh != [f"f{free_used + j}" for j in range(len(fresh))]:
                    continue
                yield p, names, {**types, **{v: p.types[names.index(v)] for v in fresh}}, free_used + len(fresh)

    out: dict[str, tuple[Literal, ...]] = {}

    def name(lits):
        return " ".join(f"{l.pred}({','.join(a.name for a in l.args)})" for l in lits)

    for p, names, types, used in facts(pos_types, 0):
        if not any(v in pos_types for v in names):
            continue
        one = (Literal(p.name, True, tuple(Term("var", v) for v in names)),)
        out[name(one)] = one
        if max_facts < 2:
            continue
        for q, names2, _, _ in facts(types, used):
            if (q.name, names2) == (p.name, names) or not set(names2) & set(names):
                continue
            two = one + (Literal(q.name, True, tuple(Term("var", v) for v in names2)),)
            if all(set(v.name for v in l.args) & set(pos_types) for l in two):
                two = tuple(sorted(two, key=lambda l: name((l,))))
            out[name(two)] = two
    return out


def feature_table(fb: FactBase, target: str, shapes: dict[str, tuple[Literal, ...]], rows: DataFrame | None = None) -> DataFrame:
    """``fold, a0.., features``: which shapes hold around each target atom (listed facts by default).

    A shape holds when at least one binding of its free arguments, different from the atom's own
    constants, exists.  Each shape is an aggregate join keyed by the arguments it touches; pairs of
    facts are never listed.
    """
    decl = fb.schema[target]
    cols = [f"a{i}" for i in range(decl.arity)]
    rel = rows if rows is not None else fb.relation(target)
    for i, j in combinations(range(decl.arity), 2):
        rel = rel.filter(F.col(cols[i]) != F.col(cols[j]))
    hits = []
    for shape, lits in shapes.items():
        vt: dict[str, str] = {}
        for l in lits:
            for a, t in zip(l.args, fb.schema[l.pred].types):
                vt[a.name] = t
        touched = [v for v in vt if v.startswith("t")]
        free = [v for v in vt if v.startswith("f")]
        ins = [Atom(l.pred, l.args) for l in lits]
        # Free arguments differ from each other and from the target constants they could equal.
        others = [f"t{i}" for i, t in enumerate(decl.types) if t in {vt[f] for f in free}]
        all_types = {**vt, **{o: decl.types[int(o[1:])] for o in others}}
        apart = [a for a in pairwise_equalities(all_types) if any(x.name.startswith("f") for x in a.args)]
        keep = tuple(sorted(set(touched) | set(others)))
        missing = [o for o in others if o not in touched]
        if missing:  # the inequality involves a target constant the shape itself does not bind
            ins = ins + [Atom(target, tuple(Term("var", f"t{i}") for i in range(decl.arity)), "rows")]
            all_types.update({f"t{i}": t for i, t in enumerate(decl.types)})
            keep = tuple(f"t{i}" for i in range(decl.arity))
        base = fb.with_set("rows", rel.select("fold", F.lit(target).alias("pred"), F.array(*cols).alias("args"))) if missing else fb
        n = count_bindings(base, ins, apart, all_types, keep).filter("n > 0")
        keys = n.select("fold", *[F.col(f"k_{v}").alias(f"a{v[1:]}") for v in keep])
        hits.append(
            rel.join(keys, ["fold"] + [f"a{v[1:]}" for v in keep], "left_semi").select("fold", *cols, F.lit(shape).alias("feature"))
        )
    found = union_all(hits).groupBy("fold", *cols).agg(F.array_sort(F.collect_set("feature")).alias("features"))
    return rel.join(found, ["fold"] + cols, "left").select(
        "fold", *cols, F.coalesce("features", F.array().cast("array<string>")).alias("features")
    )


def shape_counts(t: DataFrame) -> DataFrame:
    return t.select(F.explode("features").alias("feature")).groupBy("feature").agg(F.count(F.lit(1)).alias("n"))


def contingency(t: DataFrame, tests: list[tuple[str, str, tuple[str, ...]]]) -> DataFrame:
    """2x2 counts per test and stratum, all tests in one aggregation.

    A test is (x, y, conditioning features); ``test, stratum, n11, n10, n01, n00``.
    """
    def flag(f: str) -> Column:
        return F.array_contains("features", f)

    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("test"),
                F.concat_ws("", *[flag(g).cast("int").cast("string") for g in given]).alias("stratum") if given else F.lit("").alias("stratum"),
                flag(x).alias("x"), flag(y).alias("y"),
            )
            for i, (x, y, given) in enumerate(tests)
        ]
    )
    e = t.select(F.explode(rows).alias("e")).select("e.*")

    def n(x, y):
        return F.sum((F.col("x") == x).cast("bigint") * (F.col("y") == y).cast("bigint"))

    return e.groupBy("test", "stratum").agg(
        n(True, True).alias("n11"), n(True, False).alias("n10"), n(False, True).alias("n01"), n(False, False).alias("n00")
    )


def chi2_alpha(
    t: DataFrame, tests: list[tuple[str, str, tuple[str, ...]]], min_cell: int = 0, mode: str = "smoothed"
) -> DataFrame:
    """``test, chi2, alpha``: smallest significance level over the strata of each test.

    ``smoothed`` expects (X Y + p m) / (N + m) per cell with m = 3, p = 0.5, or no smoothing when a
    minimum cell count is set (strata with a smaller cell are skipped); ``standard`` expects X Y / N.
    A test without a usable stratum has alpha 1.
    """
    c = contingency(t, tests)
    m, p = (3.0, 0.5) if mode == "smoothed" and min_cell == 0 else (0.0, 0.0)
    n11, n10, n01, n00 = (F.col(x).cast("double") for x in ("n11", "n10", "n01", "n00"))
    total = n11 + n10 + n01 + n00

    def part(obs, row, col):
        expected = F.try_divide(row * col + p * m, total + m)
        return F.coalesce(F.try_divide((expected - obs) * (expected - obs), expected), F.lit(0.0))

    chi = (
        part(n11, n11 + n10, n11 + n01) + part(n10, n11 + n10, n10 + n00)
        + part(n01, n01 + n00, n11 + n01) + part(n00, n01 + n00, n10 + n00)
    )
    alpha = None
    for bound, level in CHI2_LEVELS:
        alpha = F.when(F.col("chi2") >= bound, level) if alpha is None else alpha.when(F.col("chi2") >= bound, level)
    alpha = alpha.otherwise(CHI2_LAST)
    reliable = F.least("n11", "n10", "n01", "n00") > min_cell if min_cell > 0 else F.lit(True)
    per = c.filter(reliable).withColumn("chi2", chi).withColumn("alpha", alpha)
    best = per.groupBy("test").agg(F.max("chi2").alias("chi2"), F.min("alpha").alias("alpha"))
    ids = small_table(t.sparkSession, [(i, x, y) for i, (x, y, _) in enumerate(tests)], "test int, x string, y string")
    return ids.join(best, "test", "left").select("test", "x", "y", "chi2", F.coalesce("alpha", F.lit(1.0)).alias("alpha"))


def markov_blanket(t: DataFrame, features: list[str], threshold: float = 0.05, min_cell: int = 0) -> dict[str, set[str]]:
    """Grow-shrink blanket of every feature, made symmetric.

    Each round tests, for all features at once, every remaining candidate given the current blanket
    in one aggregation, adds the strongest dependent one, then removes members that have become
    independent of the feature given the others.
    """
    blankets: dict[str, list[str]] = {f: [] for f in features}
    growing = set(features)
    while True:
        tests = [
            (x, y, tuple(blankets[x])) for x in sorted(growing) for y in features if y != x and y not in blankets[x]
        ]
        if not tests:
            break
        best: dict[str, tuple[float, float, str]] = {}
        for r in chi2_alpha(t, tests, min_cell).collect():
            if r["alpha"] < threshold:
                cand = (r["alpha"], -(r["chi2"] or 0.0), r["y"])
                best[r["x"]] = min(best.get(r["x"], cand), cand)
        growing = set(best)
        for x, (_, _, y) in best.items():
            blankets[x].append(y)
    while True:
        tests = [(x, y, tuple(z for z in blankets[x] if z != y)) for x in features for y in blankets[x]]
        if not tests:
            break
        weakest: dict[str, tuple[float, str]] = {}
        for r in chi2_alpha(t, tests, min_cell).collect():
            if r["alpha"] >= threshold:
                cand = (r["alpha"], r["y"])
                weakest[r["x"]] = max(weakest.get(r["x"], cand), cand)
        if not weakest:
            break
        for x, (_, y) in weakest.items():
            blankets[x].remove(y)
    out = {f: set(b) for f, b in blankets.items()}
    for f, b in blankets.items():
        for y in b:
            out[y].add(f)
    return out


def blanket_clauses(
    target: Literal, shapes: dict[str, tuple[Literal, ...]], blanket: set[str], max_literals: int = 3
) -> list[Clause]:
    """Clauses over subsets of the blanket that contain the target literal, with every sign pattern."""
    seen: dict[str, Clause] = {}
    for chosen in subsets(sorted(blanket)):
        lits = list(dict.fromkeys(l for f in chosen for l in shapes[f] if l != target))
        if not chosen or len(lits) + 1 > max_literals:
            continue
        body = [target] + lits
        for signs in product((True, False), repeat=len(body)):
            c = Clause(tuple(Literal(l.pred, s, l.args) for l, s in zip(body, signs)))
            seen.setdefault(" v ".join(sorted(str(l) for l in c.literals)), c)
    return list(seen.values())
