"""Plain enumeration over tiny domains: the yardstick for the Spark jobs."""

import itertools
import random

from factweave.facts import FACTS_DDL, FactBase
from factweave.rules import EQUALS
from factweave.schema import Predicate, Schema

TINY = Schema.of(Predicate("P", ("a", "b")), Predicate("Q", ("a", "a")), Predicate("R", ("b", "b")), Predicate("S", ("a",)))
DOMAINS = {"a": ["A1", "A2", "A3"], "b": ["B1", "B2"]}


def tiny_facts(seed, folds=1, density=0.5, schema=TINY, domains=DOMAINS):
    rng = random.Random(seed)
    out = set()
    for f in range(folds):
        for p in schema:
            for args in itertools.product(*[domains[t] for t in p.types]):
                if rng.random() < density:
                    out.add((f, p.name, args))
    return out


def mixed_facts(seed, folds=1):
    """Like tiny_facts, but no predicate is empty or full in any fold."""
    while True:
        facts = tiny_facts(seed, folds)
        counts = {(f, p.name): sum(1 for x in facts if x[:2] == (f, p.name)) for f in range(folds) for p in TINY}
        if all(0 < n < len(atoms(p)) for (_, p), n in counts.items()):
            return facts
        seed += 1000


def fact_base(spark, facts, schema=TINY, domains=DOMAINS, folds=1, open_world=(), false=()):
    rows = [(f, p, list(a), "true") for f, p, a in sorted(facts)]
    rows += [(f, p, list(a), "false") for f, p, a in sorted(false)]
    consts = [(f, t, c) for f in range(folds) for t, cs in domains.items() for c in cs]
    return FactBase(
        schema,
        spark.createDataFrame(rows, FACTS_DDL),
        open_world,
        spark.createDataFrame(consts, "fold int, type string, const string"),
    )


def bindings(clause, schema, domains=DOMAINS):
    vt = clause.var_types(schema)
    names = list(vt)
    for vals in itertools.product(*[domains[vt[v]] for v in names]):
        yield dict(zip(names, vals))


def ground(lit, b):
    return tuple(b[a.name] if a.is_var else a.name for a in lit.args)


def lit_true(lit, b, fold, facts):
    g = ground(lit, b)
    value = g[0] == g[1] if lit.pred == EQUALS else (fold, lit.pred, g) in facts
    return value == lit.positive


def clause_true(clause, b, fold, facts):
    return any(lit_true(l, b, fold, facts) for l in clause.literals)


def n_false(clause, facts, fold, schema=TINY, domains=DOMAINS):
    return sum(not clause_true(clause, b, fold, facts) for b in bindings(clause, schema, domains))


def count_diff(clause, atom, facts, fold, schema=TINY, domains=DOMAINS):
    """True groundings containing the atom with it flipped, minus as observed."""
    pred, args = atom
    key = (fold, pred, args)
    flipped = facts - {key} if key in facts else facts | {key}
    n = 0
    for b in bindings(clause, schema, domains):
        if any(l.pred == pred and ground(l, b) == args for l in clause.literals):
            n += clause_true(clause, b, fold, flipped) - clause_true(clause, b, fold, facts)
    return n


def atoms(pred, schema=TINY, domains=DOMAINS):
    return list(itertools.product(*[domains[t] for t in schema[pred].types]))
