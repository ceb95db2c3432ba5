"""Counting bindings of a rule body with joins and aggregates.

A *requirement* says that an atom is in, or is not in, a named set of atoms.  "Not in" is never
enumerated: a set of bindings with absent atoms is counted by inclusion-exclusion,

    count(in, not out) = sum over S of out of (-1)^|S| * count(in + S) * free domain sizes

and each inner count is a join in which every variable that is no longer needed is summed away
before the next join.  A relation therefore enters a join as one row per key it shares with the
rest, so a constant that appears in a third of all facts costs one row, not a quadratic blow-up.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from itertools import chain, combinations, permutations

from pyspark.sql import DataFrame, functions as F

from .comparisons import COUNTABLE, weigh_by_partners
from .local import small_table
from ..facts import FactBase, union_all
from ..functions.computed import computed_column, is_computed
from ..rules import EQUALS, EXISTS, EXISTS_ONE, Clause, Literal, Term

EXACT = "decimal(38,0)"
# Up to this many pairs a join inside a cycle is done directly; beyond it hub values are split off.
DIRECT_PAIRS = 1e8


@dataclass(frozen=True, order=True)
class Atom:
    """Membership of ``pred(args)`` in the atom set ``which`` ("true", "false" or a named set).

    With ``inner`` it is membership of the args in a derived set: the bindings of the free variables (free0, ...) for
    which some, exactly one or every (``which``) binding of the other variables satisfies the inner requirements.
    """

    pred: str
    args: tuple[Term, ...]
    which: str = "true"
    inner: tuple = ()  # (pred, positive, args, set)

    def variables(self) -> list[str]:
        return list(dict.fromkeys(a.name for a in self.args if a.is_var))


@dataclass(frozen=True, order=True)
class Guard:
    """A computed literal with the truth value it must have."""

    pred: str
    args: tuple[Term, ...]
    positive: bool

    def variables(self) -> list[str]:
        return list(dict.fromkeys(a.name for a in self.args if a.is_var))


@dataclass(frozen=True)
class CountTerm:
    """coefficient * count(atoms, guards) * product of free domain sizes, per kept variable."""

    coef: int
    atoms: tuple[Atom, ...]
    guards: tuple[Guard, ...]
    keep: tuple[tuple[str, Term], ...]  # output variable -> term that carries its value
    free: tuple[str, ...]  # types of unconstrained variables
    without: tuple[Atom, ...] = ()  # absent atoms whose variables one of the atoms binds


def subsets(items):
    items = list(items)
    return chain.from_iterable(combinations(items, k) for k in range(len(items) + 1))


def vcol(name: str) -> str:
    return f"v_{name}"


def unify(equalities: list[tuple[Term, Term]]) -> dict[str, Term] | None:
    """Substitution making all pairs equal, or None when two constants clash."""
    sub: dict[str, Term] = {}

    def find(t: Term) -> Term:
        while t.is_var and t.name in sub:
            t = sub[t.name]
        return t

    for left, right in equalities:
        a, b = find(left), find(right)
        if a == b:
            continue
        if a.is_var:
            sub[a.name] = b
        elif b.is_var:
            sub[b.name] = a
        else:
            return None
    return {v: find(Term("var", v)) for v in sub}


def signed_terms(
    ins: list[Atom],
    outs: list[Atom],
    var_types: dict[str, str],
    keep: tuple[str, ...] = (),
    guards: tuple[Guard, ...] = (),
) -> list[CountTerm]:
    """Inclusion-exclusion over ``outs``; equality atoms become substitutions; equal terms are merged."""
    acc: dict[tuple, int] = {}
    for chosen in subsets(outs):
        atoms = list(ins) + list(chosen)
        sub = unify([(a.args[0], a.args[1]) for a in atoms if a.pred == EQUALS])
        if sub is None:
            continue

        def apply(args):
            return tuple(sub.get(t.name, t) if t.is_var else t for t in args)

        body = frozenset(Atom(a.pred, apply(a.args), a.which, a.inner) for a in atoms if a.pred != EQUALS)
        grd = frozenset(Guard(g.pred, apply(g.args), g.positive) for g in guards)
        kept = tuple((v, sub.get(v, Term("var", v))) for v in keep)
        live = {sub.get(v, Term("var", v)) for v in var_types}
        bound = {t for a in body for t in a.args} | {t for g in grd for t in g.args} | {t for _, t in kept}
        free = tuple(sorted(var_types[t.name] for t in live if t.is_var and t not in bound))
        key = (body, grd, kept, free)
        acc[key] = acc.get(key, 0) + (-1) ** len(chosen)
    return [
        CountTerm(c, tuple(sorted(b)), tuple(sorted(g)), k, f) for (b, g, k, f), c in acc.items() if c != 0
    ]


@dataclass
class _Factor:
    vars: tuple[str, ...]
    df: DataFrame  # fold, v_<var>..., [n]
    weighted: bool
    size: float

    def project(self, needed: set[str]) -> "_Factor":
        kept = tuple(v for v in self.vars if v in needed)
        if kept == self.vars:
            return self
        agg = F.sum("n") if self.weighted else F.count(F.lit(1))
        df = self.df.groupBy("fold", *[vcol(v) for v in kept]).agg(agg.alias("n"))
        return _Factor(kept, df, True, self.size)

    def filter(self, guard: Guard) -> "_Factor":
        cols = [F.col(vcol(a.name)) if a.is_var else F.lit(a.name) for a in guard.args]
        cond = computed_column(guard.pred, *cols)
        return _Factor(self.vars, self.df.filter(cond if guard.positive else ~cond), self.weighted, self.size)


def _derived(fb: FactBase, atom: Atom) -> DataFrame:
    """Bindings of an existential's free variables, ``fold, a0, ...``: one inside count each, no bindings listed."""
    lits = [Literal(p, positive, args) for p, positive, args, _ in atom.inner]
    vt = Clause(tuple(lits)).var_types(fb.schema)
    keep = tuple(f"free{i}" for i in range(len(atom.args)))
    if atom.which == "every":
        ((pred, _, args, which),) = atom.inner
        counts = count_bindings(fb, [Atom(pred, args, which)], [], vt, keep)
        wanted = F.col("n") == fb.size_product([t for v, t in vt.items() if v not in keep])
    else:
        stored = {p: w for p, _, _, w in atom.inner if w != "true"}
        ins, outs, guards = requirements([replace(l, positive=not l.positive) for l in lits], fb) if not stored else (
            [Atom(p, args, w) for p, _, args, w in atom.inner], [], ()
        )
        bound = {v for a in ins if a.pred != EQUALS for v in a.variables()}
        if not bound >= set(keep):
            raise ValueError("every free variable of an existential conjunction must occur in a positive stored literal")
        counts = count_bindings(fb, ins, outs, vt, keep, guards)
        wanted = (F.col("n") == 1) if atom.which == "one" else (F.col("n") > 0)
    return counts.filter(wanted).select("fold", *[F.col(f"k_{v}").alias(f"a{i}") for i, v in enumerate(keep)])


def _factor(fb: FactBase, atom: Atom, sizes: dict[str, float]) -> _Factor:
    df = _derived(fb, atom) if atom.inner else fb.relation(atom.pred, atom.which)
    first: dict[str, int] = {}
    size = sizes.get(atom.inner[0][0] if atom.inner else atom.pred, 1.0)
    for i, a in enumerate(atom.args):
        if not a.is_var:
            df = df.filter(F.col(f"a{i}") == a.name)
            size /= 10
        elif a.name in first:
            df = df.filter(F.col(f"a{i}") == F.col(f"a{first[a.name]}"))
        else:
            first[a.name] = i
    df = df.select("fold", *[F.col(f"a{i}").alias(vcol(v)) for v, i in first.items()])
    return _Factor(tuple(first), df, False, size)


def _join(a: _Factor, b: _Factor) -> _Factor:
    shared = [v for v in a.vars if v in b.vars]
    left = a.df.withColumnRenamed("n", "n_l") if a.weighted else a.df
    right = b.df.withColumnRenamed("n", "n_r") if b.weighted else b.df
    df = left.join(right, ["fold"] + [vcol(v) for v in shared])
    out = a.vars + tuple(v for v in b.vars if v not in a.vars)
    cols = ["fold"] + [vcol(v) for v in out]
    if a.weighted and b.weighted:
        df = df.select(*cols, (F.col("n_l") * F.col("n_r")).alias("n"))
    elif a.weighted or b.weighted:
        df = df.select(*cols, F.col("n_l" if a.weighted else "n_r").alias("n"))
    else:
        df = df.select(*cols)
    return _Factor(out, df, a.weighted or b.weighted, max(a.size, b.size))


def _cycle_join(a: _Factor, b: _Factor, c: _Factor) -> _Factor:
    """Join of three factors where a and b share a key and c links their other ends.

    Joining a and b first costs d_a(k) * d_b(k) rows per key value k.  For hub values, where that
    exceeds the size of c, c is extended through the key instead: there are at most about
    2 sqrt(rows) such values, so the work stays within rows^1.5 whatever the skew.
    """
    keys = ["fold"] + [vcol(v) for v in a.vars if v in b.vars]
    deg_a = a.df.groupBy(*keys).agg(F.count(F.lit(1)).alias("da"))
    deg_b = b.df.groupBy(*keys).agg(F.count(F.lit(1)).alias("db"))
    hubs = deg_a.join(deg_b, keys).filter(F.col("da").cast("double") * F.col("db") > float(c.size)).select(*keys)

    def part(f: _Factor, how: str) -> _Factor:
        return _Factor(f.vars, f.df.join(hubs, keys, how), f.weighted, f.size)

    light = _join(_join(part(a, "left_anti"), part(b, "left_anti")), c)
    heavy = _join(_join(c, part(a, "left_semi")), part(b, "left_semi"))
    cols = ["fold"] + [vcol(v) for v in light.vars] + (["n"] if light.weighted else [])
    return _Factor(light.vars, light.df.select(*cols).unionByName(heavy.df.select(*cols)), light.weighted, light.size)


def _count_partners(factors: list[_Factor], guards: list[Guard], keep: set[str]) -> bool:
    """Replace one factor that a comparison alone still needs by the number of its partners, in place."""
    for g in guards:
        if g.pred not in COUNTABLE or len(set(g.variables())) != 2 or not all(a.is_var for a in g.args):
            continue
        for at, (value, partner) in enumerate([g.variables(), g.variables()[::-1]]):
            others = {v for o in guards if o is not g for v in o.variables()}
            holders = [i for i, f in enumerate(factors) if partner in f.vars]
            targets = [i for i, f in enumerate(factors) if value in f.vars]
            if partner in keep | others or len(holders) != 1 or not targets or factors[holders[0]].vars != (partner,):
                continue
            b = factors[holders[0]]
            i = min(targets, key=lambda t: (len(factors[t].vars), factors[t].size, t))
            a = factors[i]
            df = weigh_by_partners(
                a.df, vcol(value), "n" if a.weighted else None, b.df, vcol(partner), "n" if b.weighted else None,
                g.pred, at == 0, g.positive,
            )
            factors[i] = _Factor(a.vars, df, True, a.size)
            del factors[holders[0]]
            guards.remove(g)
            return True
    return False


def join_count(
    fb: FactBase,
    atoms: tuple[Atom, ...],
    guards: tuple[Guard, ...],
    keep: tuple[str, ...],
    var_types: dict[str, str] | None = None,
    without: tuple[Atom, ...] = (),
) -> DataFrame:
    """``fold, v_<keep>..., n``: number of bindings of the other variables for each kept binding.

    Bindings under which an atom of ``without`` holds do not count; one of the atoms has all its variables.

    Join order: always the pair whose result, after summing away finished variables, has the fewest
    columns; a pair where one side only filters the other comes first; then smaller relations.  A variable
    that only a comparison ties to the rest is counted through running totals instead of being joined.
    """
    totals = fb.true_totals() if len(atoms) > 2 else {}
    sizes = {p.name: float(sum(n for (_, q), n in totals.items() if q == p.name)) for p in fb.schema}
    factors = [_factor(fb, a, sizes) for a in atoms]
    for absent in without:
        other = _factor(fb, absent, sizes)
        i = min((i for i, f in enumerate(factors) if set(other.vars) <= set(f.vars)), key=lambda i: (factors[i].size, i))
        f = factors[i]
        df = f.df.join(other.df, ["fold"] + [vcol(v) for v in other.vars], "left_anti")
        factors[i] = _Factor(f.vars, df, f.weighted, f.size)
    bound = {v for f in factors for v in f.vars}
    for v in dict.fromkeys(x for g in guards for x in g.variables()):
        if v not in bound:
            df = fb.constants_of((var_types or {})[v]).select("fold", F.col("const").alias(vcol(v)))
            factors.append(_Factor((v,), df, False, 1.0))
    open_guards = list(guards)
    while True:
        waiting = []
        for g in open_guards:
            gv = set(g.variables())
            for i, f in enumerate(factors):
                if gv <= set(f.vars):
                    factors[i] = f.filter(g)
                    break
            else:
                waiting.append(g)
        open_guards = waiting
        guard_vars = {v for g in open_guards for v in g.variables()}
        for i, f in enumerate(factors):
            others = {v for j, o in enumerate(factors) if j != i for v in o.vars}
            factors[i] = f.project(others | set(keep) | guard_vars)
        if len(factors) == 1:
            break
        if _count_partners(factors, open_guards, set(keep)):
            continue
        best = None
        for i, j in combinations(range(len(factors)), 2):
            a, b = factors[i], factors[j]
            union = set(a.vars) | set(b.vars)
            shared = set(a.vars) & set(b.vars)
            others = {v for k, o in enumerate(factors) if k not in (i, j) for v in o.vars}
            width = len(union & (others | set(keep) | guard_vars))
            filters = set(a.vars) <= set(b.vars) or set(b.vars) <= set(a.vars)
            rank = (not shared and bool(a.vars) and bool(b.vars), not filters, width, a.size + b.size, i, j)
            if best is None or rank < best[0]:
                best = (rank, i, j)
        _, i, j = best
        a, b = factors[i], factors[j]
        used = {i, j}
        merged = None
        if not (set(a.vars) <= set(b.vars) or set(b.vars) <= set(a.vars)) and a.size * b.size > DIRECT_PAIRS:
            key = set(a.vars) & set(b.vars)
            links = [
                k for k, f in enumerate(factors)
                if k not in used and (set(a.vars) - key) & set(f.vars) and (set(b.vars) - key) & set(f.vars)
            ]
            if key and links:
                used.add(links[0])
                merged = _cycle_join(a, b, factors[links[0]])
        if merged is None:
            merged = _join(a, b)
        factors = [f for k, f in enumerate(factors) if k not in used] + [merged]
    f = factors[0].project(set(keep))
    df = f.df if f.weighted else f.df.withColumn("n", F.lit(1).cast("bigint"))
    return df.select("fold", *[vcol(v) for v in keep], "n")


def term_counts(fb: FactBase, term_: CountTerm, var_types: dict[str, str]) -> DataFrame:
    """One signed term as ``fold, v_<keep>..., n`` with exact counts."""
    carriers = tuple(dict.fromkeys(t.name for _, t in term_.keep if t.is_var))
    if term_.atoms or term_.guards:
        df = join_count(fb, term_.atoms, term_.guards, carriers, var_types, term_.without)
    else:
        if carriers:
            raise ValueError("kept variables must be bound by a stored fact")
        df = small_table(fb.spark, [(f, 1) for f in fb.folds()], "fold int, n bigint")
    n = F.col("n").cast(EXACT) * F.lit(str(term_.coef)).cast(EXACT)
    if term_.free:
        n = (n * fb.size_product(list(term_.free))).cast(EXACT)
    cols = [
        (F.col(vcol(t.name)) if t.is_var else F.lit(t.name)).alias(f"k_{v}") for v, t in term_.keep
    ]
    return df.select("fold", *cols, n.cast(EXACT).alias("n"))


def _held(ins: list[Atom], outs: list[Atom]) -> tuple[Atom, ...]:
    """Absent atoms that filter one of the stored atoms: an anti-join instead of twice as many terms."""
    if any(a.pred == EQUALS for a in [*ins, *outs]):  # equalities rename variables
        return ()
    bound = [set(a.variables()) for a in ins]
    return tuple(dict.fromkeys(
        a for a in outs if not a.inner and a.variables() and any(set(a.variables()) <= b for b in bound)))


def count_bindings(
    fb: FactBase,
    ins: list[Atom],
    outs: list[Atom],
    var_types: dict[str, str],
    keep: tuple[str, ...] = (),
    guards: tuple[Guard, ...] = (),
) -> DataFrame:
    """``fold, k_<keep>..., n``: exact number of bindings with all of ``ins`` and none of ``outs``."""
    held = _held(ins, outs)
    terms = [replace(t, without=held) for t in signed_terms(ins, [a for a in outs if a not in held], var_types, keep, guards)]
    if not terms:
        cols = ", ".join(["fold int"] + [f"k_{v} string" for v in keep] + [f"n {EXACT}"])
        return small_table(fb.spark, [], cols)
    parts = [term_counts(fb, t, var_types) for t in terms]
    if len(parts) == 1 and terms[0].coef == 1:
        return parts[0]
    keys = ["fold"] + [f"k_{v}" for v in keep]
    return union_all(parts).groupBy(*keys).agg(F.sum("n").cast(EXACT).alias("n")).filter("n != 0")


def _is_open(literals: tuple[Literal, ...], fb: FactBase) -> bool:
    return any(l.pred in fb.open_world or _is_open(l.inner, fb) for l in literals)


def _existential_sets(lit: Literal, fb: FactBase) -> tuple[Atom | None, Atom | None]:
    """Atom sets in which an existential is certainly true, and certainly false; None for a set that is not stored.

    A conjunction of closed-world literals gives the first set, one negative literal of a closed world the
    second (all its atoms are facts), one literal of an open world both.
    """
    names = {a.name: Term("var", f"free{i}") for i, a in enumerate(lit.args)}
    names |= {b: Term("var", f"bound{i}") for i, b in enumerate(lit.bound)}

    def inner(*sets: str) -> tuple:
        return tuple((l.pred, l.positive, l.rename(names).args, s) for l, s in zip(lit.inner, sets))

    kind = "one" if lit.pred == EXISTS_ONE else "some"
    first = lit.inner[0]
    single = len(lit.inner) == 1 and first.pred in fb.schema
    if _is_open(lit.inner, fb):
        if not single or kind == "one":
            raise ValueError(f"an existential over an open world takes one literal: {lit}")
        holds, fails = ("true", "false") if first.positive else ("false", "true")
        return Atom(EXISTS, lit.args, "some", inner(holds)), Atom(EXISTS, lit.args, "every", inner(fails))
    if single and not first.positive:
        if kind == "one":
            raise ValueError(f"exactly one absent atom cannot be counted: {lit}")
        return None, Atom(EXISTS, lit.args, "every", inner("true"))
    return Atom(EXISTS, lit.args, kind, inner(*["true"] * len(lit.inner))), None


def requirements(
    literals: list[Literal], fb: FactBase, unsatisfied: str = "false"
) -> tuple[list[Atom], list[Atom], tuple[Guard, ...]]:
    """Requirements under which every literal is false, or (``"not_true"``) under which none is certainly true.

    A closed-world atom is true if listed and false otherwise.  An open-world atom is false only if
    listed as false and unknown if not listed.
    """
    ins: list[Atom] = []
    outs: list[Atom] = []
    guards: list[Guard] = []
    for lit in literals:
        if lit.pred == EQUALS:
            (outs if lit.positive else ins).append(Atom(EQUALS, lit.args))
        elif lit.inner:
            some, none = _existential_sets(lit, fb)
            if not _is_open(lit.inner, fb):
                # "none" is the exact complement of "some": use the one that can be stored
                (ins if lit.positive == (some is None) else outs).append(none if some is None else some)
            elif unsatisfied == "false":
                ins.append(none if lit.positive else some)
            else:
                outs.append(some if lit.positive else none)
        elif is_computed(lit.pred) and lit.pred not in fb.schema:
            guards.append(Guard(lit.pred, lit.args, not lit.positive))
        elif lit.pred not in fb.open_world:
            (outs if lit.positive else ins).append(Atom(lit.pred, lit.args))
        elif unsatisfied == "false":
            ins.append(Atom(lit.pred, lit.args, "false" if lit.positive else "true"))
        else:
            outs.append(Atom(lit.pred, lit.args, "true" if lit.positive else "false"))
    return ins, outs, tuple(guards)


def num_groundings(c: Clause, fb: FactBase, distinct: bool = False) -> dict[int, int]:
    """Groundings per fold; ``distinct`` gives the k-th variable of a type one constant less."""
    types = list(c.var_types(fb.schema).values())
    out = {}
    for f in fb.folds():
        n = 1
        used: dict[str, int] = {}
        for t in types:
            n *= max(fb.size(f, t) - (used.get(t, 0) if distinct else 0), 0)
            used[t] = used.get(t, 0) + 1
        out[f] = n
    return out


def _components(t: CountTerm) -> list[tuple[tuple[Atom, ...], tuple[Guard, ...]]]:
    """Parts of a term that share no variable; the count of the term is the product of theirs."""
    groups: list[tuple[set[str], list]] = []
    for item in [*t.atoms, *t.guards]:
        names, members = set(item.variables()), [item]
        rest = []
        for g in groups:
            if g[0] & names:
                names, members = g[0] | names, g[1] + members
            else:
                rest.append(g)
        groups = rest + [(names, members)]
    fixed = [g for g in groups if not any(isinstance(x, Atom) for x in g[1]) and not g[0]]
    groups = [g for g in groups if g not in fixed]
    if fixed and groups:  # comparisons of constants filter the first part
        groups[0][1].extend(x for g in fixed for x in g[1])
    elif fixed:
        groups = [(set(), [x for g in fixed for x in g[1]])]
    return [
        (tuple(x for x in m if isinstance(x, Atom)), tuple(x for x in m if isinstance(x, Guard))) for _, m in groups
    ]


def _named_alike(atoms: tuple[Atom, ...], guards: tuple[Guard, ...], var_types: dict[str, str]) -> tuple:
    """The least renaming of a part over the orders of its atoms (up to four), so that equal parts are one key."""
    orders = permutations(atoms) if len(atoms) <= 4 else [atoms]
    best = None
    for order in orders:
        names: dict[str, Term] = {}
        for item in [*order, *guards]:
            for v in item.variables():
                names.setdefault(v, Term("var", f"x{len(names)}"))

        def renamed(args):
            return tuple(names[a.name] if a.is_var else a for a in args)

        key = (
            tuple(sorted(Atom(a.pred, renamed(a.args), a.which, a.inner) for a in order)),
            tuple(sorted(Guard(g.pred, renamed(g.args), g.positive) for g in guards)),
            tuple(sorted((t.name, var_types[v]) for v, t in names.items() if v in var_types)),
        )
        best = key if best is None or key < best else best
    return best


def scalar_counts(
    terms: list[tuple[tuple[str, ...], CountTerm, dict[str, str]]], fb: FactBase, tags: list[str]
) -> DataFrame:
    """``fold, <tags>..., n``: terms without kept variables, summed per tag, each distinct part counted once.

    Terms are split into parts that share no variable. Parts equal up to names, within a rule or across
    rules, are one count; a term is a product of counts, and only those counts, one row per
    (fold, part), are put beside the table of terms.
    """
    parts: dict[tuple, int] = {}
    rows = []
    for tag, t, vt in terms:
        if t.keep:
            raise ValueError("a scalar term keeps no variable")
        ids = [parts.setdefault(_named_alike(a, g, vt), len(parts)) for a, g in _components(t)]
        for f in fb.folds():
            n = t.coef
            for type_ in t.free:
                n *= fb.size(f, type_)
            rows.append((f, *tag, str(n), ids))
    table = small_table(
        fb.spark, rows, ", ".join(["fold int", *[f"{c} string" for c in tags], "coef string", "parts array<int>"])
    )
    product = F.col("coef").cast(EXACT)
    if parts:
        counted = [
            join_count(fb, atoms, guards, (), dict(types)).select("fold", F.lit(i).alias("part"), F.col("n").cast(EXACT).alias("n"))
            for (atoms, guards, types), i in parts.items()
        ]
        counts = union_all(counted).groupBy("fold", "part").agg(F.sum("n").cast(EXACT).alias("n"))
        by_fold = counts.groupBy("fold").agg(F.map_from_entries(F.collect_list(F.struct("part", "n"))).alias("counts"))
        table = table.join(F.broadcast(by_fold), "fold", "left")  # one row a fold, one entry a part of a rule
        product = F.aggregate(
            "parts", product,
            lambda acc, i: (acc * F.coalesce(F.col("counts")[i], F.lit(0).cast(EXACT))).cast(EXACT),
        )
    return table.withColumn("n", product).groupBy("fold", *tags).agg(F.sum("n").cast(EXACT).alias("n"))


def clause_counts(clauses: list[Clause], fb: FactBase) -> DataFrame:
    """True, false, unknown and total groundings of every clause, all clauses in one job with shared counts.

    Columns ``fold, clause_id, n_true, n_false, n_unknown, n_total`` (exact decimals).
    """
    parts, totals = [], []
    for c in clauses:
        vt = c.var_types(fb.schema)
        for f, n in num_groundings(c, fb).items():
            totals.append((f, c.clause_id, str(n)))
        modes = [("f", "false")]
        if _is_open(c.literals, fb):
            modes.append(("u", "not_true"))
        for tag, mode in modes:
            ins, outs, guards = requirements(list(c.literals), fb, mode)
            for t in signed_terms(ins, outs, vt, (), guards):
                parts.append(((c.clause_id, tag), t, vt))
    total_df = small_table(fb.spark, totals, "fold int, clause_id string, t string")
    zero = F.lit(0).cast(EXACT)
    if parts:
        sums = (
            scalar_counts(parts, fb, ["clause_id", "tag"])
            .groupBy("fold", "clause_id")
            .agg(
                F.sum(F.when(F.col("tag") == "f", F.col("n"))).cast(EXACT).alias("f"),
                F.sum(F.when(F.col("tag") == "u", F.col("n"))).cast(EXACT).alias("u"),
                F.max(F.col("tag") == "u").alias("has_u"),
            )
        )
        joined = total_df.join(sums, ["fold", "clause_id"], "left")
    else:
        joined = total_df.withColumns({"f": zero, "u": zero, "has_u": F.lit(False)})
    open_ids = [c.clause_id for c in clauses if _is_open(c.literals, fb)]
    total = F.col("t").cast(EXACT)
    false = F.coalesce("f", zero)
    not_true = F.when(F.col("clause_id").isin(open_ids), F.coalesce("u", zero)).otherwise(false)
    return joined.select(
        "fold",
        "clause_id",
        (total - not_true).cast(EXACT).alias("n_true"),
        false.cast(EXACT).alias("n_false"),
        (not_true - false).cast(EXACT).alias("n_unknown"),
        total.alias("n_total"),
    )


def conjunction_counts(clauses: list[Clause], fb: FactBase, distinct: bool = False) -> DataFrame:
    """Groundings in which *every* literal agrees with its sign: ``fold, clause_id, n``."""
    parts, base = [], []
    for c in clauses:
        vt = c.var_types(fb.schema)
        flipped = [replace(l, positive=not l.positive) for l in c.literals]
        ins, outs, guards = requirements(flipped, fb)
        if distinct:
            outs = outs + pairwise_equalities(vt)
        base += [(f, c.clause_id) for f in fb.folds()]
        for t in signed_terms(ins, outs, vt, (), guards):
            parts.append(((c.clause_id,), t, vt))
    sums = scalar_counts(parts, fb, ["clause_id"])
    rows = small_table(fb.spark, base, "fold int, clause_id string")
    return rows.join(sums, ["fold", "clause_id"], "left").select(
        "fold", "clause_id", F.coalesce("n", F.lit(0).cast(EXACT)).alias("n")
    )


def pairwise_equalities(var_types: dict[str, str]) -> list[Atom]:
    """Equality atoms between variables of one type; as ``outs`` they demand distinct constants."""
    return [
        Atom(EQUALS, (Term("var", a), Term("var", b)))
        for a, b in combinations(sorted(var_types), 2)
        if var_types[a] == var_types[b]
    ]
