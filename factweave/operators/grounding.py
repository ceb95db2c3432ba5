"""Matching rules against facts and building the table of ground clauses."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from ..facts import FactBase, union_all
from ..functions.computed import computed_column, is_computed
from ..plans.counting import (
    EXACT,
    Atom,
    _factor,
    _join,
    count_bindings,
    requirements,
    subsets,
    vcol,
)
from ..plans.storage import freeing, stored
from ..rules import EQUALS, LITERALS_TYPE, Clause, Literal, plain_only

GROUND_LITERALS = "array<struct<atom:string,positive:boolean>>"


def match(c: Clause, fb: FactBase) -> DataFrame:
    """All bindings under which every literal agrees with the facts: ``fold, <variable>...``.

    Positive literals are joined on shared variables, smaller relations first; negated literals are
    anti-joined once bound; comparisons and equalities filter.
    """
    plain_only([c], "a match")
    totals = fb.true_totals()
    sizes = {p.name: float(sum(n for (_, q), n in totals.items() if q == p.name)) for p in fb.schema}
    stored = [l for l in c.literals if l.pred in fb.schema]
    factors = [_factor(fb, Atom(l.pred, l.args), sizes) for l in stored if l.positive]
    if not factors:
        raise ValueError("a match needs at least one positive stored literal")
    factors.sort(key=lambda f: f.size)
    acc = factors.pop(0)
    while factors:
        linked = [f for f in factors if set(f.vars) & set(acc.vars)] or factors
        acc, factors = _join(acc, linked[0]), [f for f in factors if f is not linked[0]]
    df, bound = acc.df, set(acc.vars)
    for l in c.literals:
        free = [a.name for a in l.args if a.is_var and a.name not in bound]
        if free and not l.positive:
            raise ValueError(f"variables {free} of negated {l} occur in no positive literal")
        cols = [F.col(vcol(a.name)) if a.is_var else F.lit(a.name) for a in l.args]
        if l.pred == EQUALS:
            df = df.filter((cols[0] == cols[1]) == F.lit(l.positive))
        elif l.pred not in fb.schema and is_computed(l.pred):
            cond = computed_column(l.pred, *cols)
            df = df.filter(cond if l.positive else ~cond)
        elif not l.positive:
            other = _factor(fb, Atom(l.pred, l.args), sizes)
            df = df.join(other.df, ["fold"] + [vcol(v) for v in other.vars], "left_anti")
    return df.select("fold", *[F.col(vcol(v)).alias(v) for v in c.variables()])


def computed_predicate(fb: FactBase, name: str, types: tuple[str, ...], partitions: int = 64) -> DataFrame:
    """All constant tuples of the given types for which a computed predicate holds.

    The result is a product filtered by an arbitrary expression, so it is for types of limited size;
    inside rules the predicate is evaluated on bound variables instead.
    """
    df = None
    for i, t in enumerate(types):
        nxt = fb.constants_of(t).withColumnRenamed("const", f"a{i}")
        if df is None:
            df = nxt.repartition(partitions, "a0")
        else:
            salted = nxt.withColumn("@s", F.explode(F.sequence(F.lit(0), F.lit(partitions - 1))))
            df = df.withColumn("@s", F.pmod(F.xxhash64("a0"), F.lit(partitions)).cast("int")).join(
                salted, ["fold", "@s"]
            ).drop("@s")
    return df.filter(computed_column(name, *[F.col(f"a{i}") for i in range(len(types))]))


def exists(fb: FactBase, pred: str, keep: tuple[int, ...], exactly_one: bool = False) -> DataFrame:
    """Existential literal over the kept arguments: ``EXIST y R(x,y)``, or exactly one such y."""
    cols = [F.col(f"a{i}").alias(f"a{j}") for j, i in enumerate(keep)]
    counts = fb.relation(pred).select("fold", *cols).groupBy("fold", *[f"a{j}" for j in range(len(keep))]).agg(
        F.count(F.lit(1)).alias("n")
    )
    return (counts.filter("n = 1") if exactly_one else counts).drop("n")


def partial_ground(rules: DataFrame, atoms: DataFrame) -> DataFrame:
    """Rules with one literal bound to each given atom: ``clause_id, fold, atom_pred, atom_args, position, literals``.

    Constants of the literal must agree with the atom and repeated variables must get one value.
    """
    lit = rules.select("clause_id", "literals", F.posexplode("literals").alias("position", "l"))
    a = atoms.select("fold", F.col("pred").alias("atom_pred"), F.col("args").alias("atom_args"))
    pairs = F.transform(
        "l.args", lambda t, i: F.struct(t["kind"].alias("kind"), t["name"].alias("name"), F.get("atom_args", i).alias("value"))
    )
    rows = a.join(lit, F.col("atom_pred") == F.col("l.pred")).withColumn("p", pairs)
    var_pairs = F.array_distinct(F.filter("p", lambda s: s["kind"] != "const"))
    rows = rows.filter(F.forall("p", lambda s: (s["kind"] != "const") | (s["name"] == s["value"]))).withColumn("vp", var_pairs)
    rows = rows.filter(F.size("vp") == F.size(F.array_distinct(F.transform("vp", lambda s: s["name"]))))

    def bind(t: Column) -> Column:
        hit = F.filter("vp", lambda s: (s["name"] == t["name"]) & (t["kind"] != "const"))
        return F.struct(
            F.when(F.size(hit) > 0, "const").otherwise(t["kind"]).alias("kind"),
            F.when(F.size(hit) > 0, F.get(hit, F.lit(0))["value"]).otherwise(t["name"]).alias("name"),
        )

    grounded = F.transform(
        "literals",
        lambda l: F.struct(l["pred"].alias("pred"), l["positive"].alias("positive"), F.transform(l["args"], bind).alias("args")),
    ).cast(LITERALS_TYPE)
    return rows.select("clause_id", "fold", "atom_pred", "atom_args", "position", grounded.alias("literals"))


def query_canopy(fb: FactBase, query: DataFrame) -> FactBase:
    """Fact base in which the query atoms (``fold, pred, args``) are unknown.

    Atoms of query predicates outside the query set keep their evidence value: true if listed,
    otherwise false.
    """
    return fb.with_set("query", query)


def ground_network(clauses: list[Clause], fb: FactBase, query: DataFrame) -> DataFrame:
    """Ground clauses that evidence does not satisfy, over the query atoms.

    ``fold, clause_id, lits, weight, hard, frequency``: lits are the unknown literals; frequency is
    the number of groundings that leave exactly these literals, so evidence-only variables are
    counted rather than listed. The groundings of a clause are stored for each choice of unknown literals, so that
    the shuffles of one are gone before the next.
    """
    plain_only(clauses, "a ground network")
    fb = query_canopy(fb, query)
    with freeing(fb.spark):
        preds = {r["pred"] for r in query.select("pred").distinct().collect()}
    parts = []
    for c in clauses:
        vt = c.var_types(fb.schema)
        open_lits = [i for i, l in enumerate(c.literals) if l.pred in preds]
        for unknown in subsets(open_lits):
            if not unknown:
                continue
            rest = [l for i, l in enumerate(c.literals) if i not in unknown]
            ins, outs, guards = requirements(rest, fb)
            ins += [Atom(c.literals[i].pred, c.literals[i].args, "query") for i in unknown]
            outs += [Atom(l.pred, l.args, "query") for l in rest if l.pred in preds]
            keep = tuple(dict.fromkeys(a.name for i in unknown for a in c.literals[i].args if a.is_var))
            df = count_bindings(fb, ins, outs, vt, keep, guards)
            lits = F.array(
                *[
                    F.struct(
                        _atom_text(c.literals[i]).alias("atom"), F.lit(c.literals[i].positive).alias("positive")
                    )
                    for i in unknown
                ]
            )
            parts.append(
                stored(
                    df.filter("n > 0").select(
                        "fold", F.lit(c.clause_id).alias("clause_id"),
                        F.array_sort(F.array_distinct(lits)).cast(GROUND_LITERALS).alias("lits"),
                        F.lit(float(c.weight)).alias("weight"), F.lit(c.hard).alias("hard"),
                        F.col("n").cast("double").alias("frequency"),
                    ),
                    "groundings",
                )
            )
    if not parts:
        raise ValueError("no clause mentions a query predicate")
    g = union_all(parts)
    atoms = F.array_distinct(F.transform("lits", lambda l: l["atom"]))
    return g.filter(F.size(atoms) == F.size("lits"))  # both signs of one atom: always true


def _atom_text(l: Literal) -> Column:
    cols = [F.col(f"k_{a.name}") if a.is_var else F.lit(a.name) for a in l.args]
    return F.concat(F.lit(l.pred + "("), F.concat_ws(",", *cols), F.lit(")"))


def merge_ground(g: DataFrame) -> DataFrame:
    """Identical ground clauses become one with summed weight: ``fold, gid, lits, weight, hard, frequency``.

    A single negative soft literal becomes positive with negated weight before merging. Hard clauses are
    merged among themselves only and have weight 0, or -1 if their weight was negative, which demands that all
    literals are false.
    """
    lone = (F.size("lits") == 1) & ~F.get("lits", F.lit(0))["positive"] & ~F.col("hard")
    lits = F.when(
        lone, F.transform("lits", lambda l: F.struct(l["atom"].alias("atom"), F.lit(True).alias("positive")))
    ).otherwise(F.col("lits"))
    w = F.col("weight") * F.col("frequency")
    soft = F.when(F.col("hard"), 0.0).when(lone, -w).otherwise(w)
    demand = F.when(F.col("hard"), F.when(F.col("weight") < 0, -1.0).otherwise(0.0))  # null for soft clauses
    kind = F.when(F.col("hard"), F.concat(F.lit("hard"), F.col("demand").cast("string"))).otherwise("soft")
    return (
        g.select("fold", lits.cast(GROUND_LITERALS).alias("lits"), soft.alias("soft"), demand.alias("demand"), "hard", "frequency")
        .groupBy("fold", "lits", "hard", "demand")
        .agg(F.sum("soft").alias("soft"), F.sum("frequency").alias("frequency"))
        .withColumn("weight", F.coalesce("demand", "soft"))
        .withColumn("gid", F.sha2(F.concat_ws("|", F.col("fold").cast("string"), kind, F.transform("lits", lambda l: F.concat(F.when(l["positive"], "").otherwise("!"), l["atom"]))), 256))
        .select("fold", "gid", "lits", "weight", "hard", "frequency")
    )


def tie_weights(counts: DataFrame, clause_formula: DataFrame) -> DataFrame:
    """Per-clause numbers to per-formula numbers: ``formula_id, value`` = sum of value / divisor.

    ``clause_formula`` holds ``fold, clause_id, formula_id, divisor``.
    """
    return (
        counts.join(clause_formula, ["fold", "clause_id"])
        .groupBy("formula_id").agg(F.sum(F.col("value") / F.col("divisor")).alias("value"))
    )


def neighbours(fb: FactBase, atoms: DataFrame) -> DataFrame:
    """Facts sharing a constant with the given atoms (``fold, pred, args``).

    ``fold, pred, args, const, other_pred, other_args``; atoms and facts with a repeated constant are
    skipped.  One row per shared constant of a pair, so this is for a list of atoms; sizes over all
    facts come from ``neighbour_counts`` and shapes from ``feature_table``, which list no pairs.
    """
    sides = _exploded(fb, None)
    left = atoms.join(sides, ["fold", "pred", "args"]).select("fold", "type", "const", "pred", "args")
    right = sides.select("fold", "type", "const", F.col("pred").alias("other_pred"), F.col("args").alias("other_args"))
    same = (F.col("pred") == F.col("other_pred")) & (F.col("args") == F.col("other_args"))
    return left.join(right, ["fold", "type", "const"]).filter(~same).select(
        "fold", "pred", "args", "const", "other_pred", "other_args"
    ).dropDuplicates()


def neighbour_counts(fb: FactBase) -> DataFrame:
    """``fold, pred, args, n``: how many other facts share a constant with each fact of one or two arguments.

    Degrees per constant are joined to each argument and added up, and facts that share both constants are taken off
    once, so a constant occurring in a third of all facts costs one row. Pairs are counted only where two predicates,
    or one with two arguments of one type, can hold the same two constants.
    """
    sides = {t: [] for p in fb.schema for t in p.types}
    relations = {p.name: _apart(fb, p.name) for p in fb.schema}
    for p in fb.schema:
        for i, t in enumerate(p.types):
            sides[t].append(relations[p.name].select("fold", F.col(f"a{i}").alias("const")))
    degrees = {t: union_all(parts).groupBy("fold", "const").agg(F.count(F.lit(1)).alias("d")) for t, parts in sides.items()}
    pairs: dict[tuple, list] = {}
    for p in fb.schema:
        if p.arity == 2:
            pairs.setdefault(tuple(sorted(p.types)), []).append((p, relations[p.name].select("fold", *_pair(p.types))))
    out = []
    for p in fb.schema:
        df, n = relations[p.name], F.lit(-1).cast("bigint")
        for i, t in enumerate(p.types):
            df = df.join(degrees[t].select("fold", F.col("const").alias(f"a{i}"), F.col("d").alias(f"d{i}")), ["fold", f"a{i}"])
            n = n + F.col(f"d{i}")
        if p.arity == 2:
            alike = pairs[tuple(sorted(p.types))]
            if len(alike) == 1 and p.types[0] != p.types[1]:
                n = n - 1  # only the fact itself was counted once per constant
            else:
                twins = union_all([rows for _, rows in alike]).groupBy("fold", "lo", "hi").agg(F.count(F.lit(1)).alias("twins"))
                df = df.withColumns(dict(zip(["lo", "hi"], _pair(p.types)))).join(twins, ["fold", "lo", "hi"])
                n = n - F.col("twins")
        args = F.array(*[f"a{i}" for i in range(p.arity)])
        out.append(df.select("fold", F.lit(p.name).alias("pred"), args.alias("args"), n.alias("n")))
    return union_all(out)


def _pair(types: tuple[str, ...]) -> list[Column]:
    """The two constants of a fact in an order that depends on their types, or on the constants if those are equal."""
    first, second = F.col("a0"), F.col("a1")
    if types[0] == types[1]:
        first, second = F.least("a0", "a1"), F.greatest("a0", "a1")
    elif types[0] > types[1]:
        first, second = second, first
    return [first.alias("lo"), second.alias("hi")]


def _apart(fb: FactBase, pred: str) -> DataFrame:
    """The facts of a predicate without a repeated constant."""
    rel = fb.relation(pred)
    for i, j in combinations(range(fb.schema[pred].arity), 2):
        rel = rel.filter(F.col(f"a{i}") != F.col(f"a{j}"))
    return rel


def _exploded(fb: FactBase, preds: list[str] | None) -> DataFrame:
    """One row per fact and argument: ``fold, pred, args, pos, type, const``."""
    parts = []
    for p in fb.schema:
        if preds and p.name not in preds:
            continue
        rel = _apart(fb, p.name)
        cols = [f"a{i}" for i in range(p.arity)]
        args = F.array(*cols)
        for i, t in enumerate(p.types):
            parts.append(
                rel.select("fold", F.lit(p.name).alias("pred"), args.alias("args"), F.lit(i).alias("pos"),
                           F.lit(t).alias("type"), F.col(cols[i]).alias("const"))
            )
    return union_all(parts)


def paths2(fb: FactBase, start: str, max_free: int = 1) -> DataFrame:
    """Two facts linked to a start fact: the first shares a constant with it, the second with the first.

    ``fold, args, p1, args1, p2, args2``; kept when at most ``max_free`` constants of the two facts
    do not occur in the start fact.
    """
    sides = _exploded(fb, None)
    first = sides.filter(F.col("pred") == start).select("fold", "type", "const", "args")
    one = sides.select("fold", "type", "const", F.col("pred").alias("p1"), F.col("args").alias("args1"))
    step1 = first.join(one, ["fold", "type", "const"]).filter(
        ~((F.col("p1") == start) & (F.col("args") == F.col("args1")))
    ).select("fold", "args", "p1", "args1").distinct()
    tail = sides.select("fold", F.col("pred").alias("p1"), F.col("args").alias("args1"), "type", "const")
    linked = step1.join(tail, ["fold", "p1", "args1"])
    two = sides.select("fold", "type", "const", F.col("pred").alias("p2"), F.col("args").alias("args2"))
    out = linked.join(two, ["fold", "type", "const"]).filter(
        ~((F.col("p2") == start) & (F.col("args") == F.col("args2")))
        & ~((F.col("p1") == F.col("p2")) & (F.col("args1") == F.col("args2")))
    )
    free = F.size(F.array_except(F.array_union("args1", "args2"), F.col("args")))
    return out.filter(free <= max_free).select("fold", "args", "p1", "args1", "p2", "args2").distinct()
