import pytest

from brute import TINY, atoms, count_diff, fact_base, tiny_facts
from factweave.plans.atom_counts import atom_counts, counts_for_atoms
from factweave.rules import clause

CLAUSES = [
    "P(x,y)",
    "!P(x,y) v R(y,z)",
    "Q(x,y) v !Q(y,z) v Q(x,z)",
    "!Q(x,y) v !Q(y,z) v !Q(x,z)",
    "P(x,y) v Q(x,z) v R(y,y)",
    "!P(x,z) v Q(x,y) v !P(y,w)",
    "P(A1,y) v !R(y,z)",
    "!Q(x,x) v S(x)",
    "Q(x,y) v !Q(x,y) v S(x)",
    "!S(x) v !R(y,z)",
    "Q(x,y) v Q(y,x)",
    "!P(x,y) v !P(z,y) v x = z",
    "S(x) v !Q(x,x) v Q(x,y)",
]


@pytest.mark.parametrize("pred", ["P", "Q", "S"])
def test_count_differences_match_enumeration(spark, pred):
    facts = tiny_facts(11, folds=2)
    fb = fact_base(spark, facts, folds=2)
    rules = [clause(c) for c in CLAUSES]
    ac = atom_counts(rules, pred, fb)
    everything = [(f, *a) for f in (0, 1) for a in atoms(pred)]
    cols = ", ".join(["fold int"] + [f"a{i} string" for i in range(len(everything[0]) - 1)])
    got = {}
    for r in counts_for_atoms(ac, spark.createDataFrame(everything, cols)).collect():
        args = tuple(r[f"a{i}"] for i in range(TINY[pred].arity))
        got[(r["fold"], args, r["clause_id"])] = int(r["n"])
        assert r["truth"] == ((r["fold"], pred, args) in facts)
    for c in rules:
        for f in (0, 1):
            for a in atoms(pred):
                want = count_diff(c, (pred, a), facts, f)
                assert got.get((f, a, c.clause_id), 0) == want, (c.text, f, a)
