"""Existential literals: counts against enumeration of all bindings, inside and outside."""

import itertools

import pytest

from factweave.plans.atom_counts import atom_counts
from factweave.plans.counting import clause_counts, conjunction_counts
from factweave.plans.signatures import signatures
from factweave.rules import EXISTS_ONE, Term, clause, rules_to_df

from brute import DOMAINS, TINY, bindings, fact_base, ground, mixed_facts

RULES = [
    "!S(x) v EXIST y P(x,y)",
    "S(x) v !EXIST y P(x,y)",
    "!Q(x,z) v EXIST y (P(x,y) ^ R(y,y))",
    "!EXIST y,z (P(x,y) ^ R(y,z)) v S(x)",
    "EXIST y !P(x,y) v S(x)",
    "!EXIST y !P(x,y) v Q(x,z)",
    "EXIST! y P(x,y) v !Q(x,z)",
    "!EXIST! y Q(y,x) v S(x)",
    "EXIST x S(x) v !Q(y,z)",
    "EXIST y (P(x,y) ^ !R(y,y)) v EXIST y Q(x,y)",
    "!EXIST y P(A1,y) v S(x)",
    "EXIST y (Q(x,y) ^ x != y) v !Q(z,x)",
    "EXIST y (S(x) ^ !P(x,y)) v !S(x)",
    "EXIST y Q(y,y) v !S(x)",
    "!S(x) v EXIST y Q(x,y) v EXIST y P(x,y)",
]


def value(lit, b, fold, facts, false=frozenset(), open_world=()):
    """True, False or None of a literal."""
    if lit.inner:
        types = type_of(lit)
        inside = []
        for vals in itertools.product(*[DOMAINS[types[v]] for v in lit.bound]):
            each = [value(l, {**b, **dict(zip(lit.bound, vals))}, fold, facts, false, open_world) for l in lit.inner]
            inside.append(False if False in each else None if None in each else True)
        if lit.pred == EXISTS_ONE:
            out = inside.count(True) == 1
        else:
            out = True if True in inside else None if None in inside else False
    elif lit.pred == "=":
        g = ground(lit, b)
        out = g[0] == g[1]
    else:
        key = (fold, lit.pred, ground(lit, b))
        out = True if key in facts else None if lit.pred in open_world and key not in false else False
    return out if out is None or lit.positive else not out


def type_of(lit):
    out = {}
    for l in lit.inner:
        if l.pred in TINY:
            out.update({a.name: t for a, t in zip(l.args, TINY[l.pred].types) if a.is_var})
    return out


def enumerated(c, fold, facts, false=frozenset(), open_world=()):
    counts = {True: 0, False: 0, None: 0}
    for b in bindings(c, TINY):
        each = [value(l, b, fold, facts, false, open_world) for l in c.literals]
        counts[True if True in each else None if None in each else False] += 1
    return counts


@pytest.mark.parametrize("seed", [3, 8])
def test_counts_equal_enumeration(spark, seed):
    facts = mixed_facts(seed, folds=2)
    facts = {f for f in facts if f != (1, "P", ("A2", "B1")) and f != (1, "P", ("A2", "B2"))}  # A2 has no partner
    fb = fact_base(spark, facts, folds=2)
    rules = [clause(t) for t in RULES]
    got = {(r["fold"], r["clause_id"]): (int(r["n_true"]), int(r["n_false"])) for r in clause_counts(rules, fb).collect()}
    all_true = {(r["fold"], r["clause_id"]): int(r["n"]) for r in conjunction_counts(rules, fb).collect()}
    for c in rules:
        for f in (0, 1):
            want = enumerated(c, f, facts)
            assert got[f, c.clause_id] == (want[True], want[False]), (f, c.text)
            together = sum(all(value(l, b, f, facts) for l in c.literals) for b in bindings(c, TINY))
            assert all_true[f, c.clause_id] == together, (f, c.text)


def test_open_world(spark):
    facts = mixed_facts(5)
    q = [(0, "Q", g) for g in itertools.product(DOMAINS["a"], repeat=2)]
    false = {x for i, x in enumerate(q) if x not in facts and (i % 3 or x[2][0] == "A2")}
    facts -= {(0, "Q", ("A2", a)) for a in DOMAINS["a"]}
    false |= {(0, "Q", ("A2", a)) for a in DOMAINS["a"]}  # A2: every atom is known to be false
    fb = fact_base(spark, facts, open_world=("Q",), false=false)
    texts = ["!S(x) v EXIST y Q(x,y)", "!EXIST y Q(x,y) v S(x)", "EXIST y !Q(x,y)", "!EXIST y !Q(x,y) v S(x)"]
    rules = [clause(t) for t in texts]
    for r in clause_counts(rules, fb).collect():
        c = next(c for c in rules if c.clause_id == r["clause_id"])
        want = enumerated(c, 0, facts, false, ("Q",))
        assert (int(r["n_true"]), int(r["n_false"]), int(r["n_unknown"])) == (want[True], want[False], want[None]), c.text
    with pytest.raises(ValueError):
        clause_counts([clause("EXIST y (Q(x,y) ^ S(y))")], fb)


def test_written_form():
    for t in (t for t in RULES if "=" not in t):
        assert clause(clause(t).text) == clause(t) and clause(t).text == t
    lit = clause("EXIST y Q(x,y)").literals[0].rename({"x": Term("var", "y")})
    assert str(lit) == "EXIST y_ Q(y,y_)"  # the outer y is not caught
    assert lit.rename({"y": Term("const", "A1")}).args == ()
    for bad in ["EXIST y", "EXIST y P(x,z)", "EXIST y (P(x,y)", "EXIST y (EXIST z Q(y,z) ^ S(y))", "EXIST y P(x,y)vS(x)"]:
        with pytest.raises(ValueError):
            clause(bad)
    assert not clause("EXIST y Q(x,y)").is_unit()


def test_where_it_has_no_meaning(spark):
    fb = fact_base(spark, mixed_facts(2))
    c = clause("!S(x) v EXIST y P(x,y)")
    for call in (lambda: atom_counts([c], "S", fb), lambda: signatures({"t": [c]}, fb), lambda: rules_to_df(spark, [c]),
                 lambda: clause_counts([clause("EXIST y (S(y) ^ !Q(x,y))")], fb)):
        with pytest.raises(ValueError):
            call()
