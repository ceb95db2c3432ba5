import itertools
import math

import pytest

from brute import DOMAINS, TINY, atoms, bindings, fact_base, ground, mixed_facts
from factweave.operators import conditional as CO, fields as FI, search as SE
from factweave.operators.learn import unit_theory
from factweave.rules import clause, rules_to_df


def lit(text):
    return clause(text).literals[0]


FEATURES = [
    FI.FieldFeature("f", ((lit("P(x,y)"), 0.7), (lit("R(y,z)"), -0.4)), 0.5),
    FI.FieldFeature("g", ((lit("Q(x,y)"), 0.3), (lit("Q(y,x)"), 0.9), (lit("S(x)"), -0.2)), -0.25),
]


def value(facts):
    total = 0.0
    for f in FEATURES:
        for b in bindings(f.clause(), TINY):
            total += f.weight * math.exp(sum(w for l, w in f.children if (0, l.pred, ground(l, b)) in facts))
    return total


def test_field_value_and_likelihood(spark):
    facts = mixed_facts(91)
    fb = fact_base(spark, facts)
    assert FI.field_value(FEATURES, fb).first()["value"] == pytest.approx(value(facts), abs=1e-9)
    rows = spark.createDataFrame([(0, *a) for a in atoms("Q")], "fold int, a0 string, a1 string")
    lpl = []
    got = {(r["a0"], r["a1"]): r["delta"] for r in FI.field_differences(FEATURES, fb, "Q", rows).collect()}
    for a in atoms("Q"):
        d = value(facts ^ {(0, "Q", a)}) - value(facts)
        assert got[a] == pytest.approx(d, abs=1e-9)
        lpl.append(-math.log1p(math.exp(d)))
    assert FI.field_lpl(FEATURES, fb, "Q", rows).first()["lpl"] == pytest.approx(sum(lpl) / len(lpl), abs=1e-9)
    c = FI.complete_feature(TINY, {"a": 2, "b": 1})
    assert len(c.children) == 2 * 1 + 4 + 1 + 2
    r = FI.random_feature(TINY, {"a": 2, "b": 1}, 3, ["S"], 4)
    assert any(l.pred == "S" for l, _ in r.children) and len(r.children) == 3


def test_greedy_and_prune(spark):
    facts = mixed_facts(92)
    fb = fact_base(spark, facts)
    cands = [clause("!P(x,y) v S(x)"), clause("!Q(x,y) v Q(y,x)")]
    t = SE.greedy_by_gain(cands, fb, penalty=0.0, min_weight=0.0, prior_std=2.0)
    assert len(t.trace) == 2 and len(t.clauses) == 4 + sum(k for _, _, k in t.trace)
    g = SE.greedy_formulas(cands[:1], fb, prior_std=2.0)
    assert g.trace[0][2] and g.score > -10
    p = SE.prune(unit_theory(fb) + [cands[0]], fb, penalty=100.0, prior_std=2.0)
    assert {c.clause_id for c in p.clauses} == {u.clause_id for u in unit_theory(fb)}


def test_clique_combinations(spark):
    rows = [("t1", "a", 3.0), ("t1", "b", 2.0), ("t1", "c", 1.0), ("t2", "d", 1.0), ("t3", "e", 1.0)]
    df = spark.createDataFrame(rows, "template_id string, clause_id string, score double")
    got = {tuple(r["templates"]): r["clauses"] for r in SE.clique_combinations(df, 2, 2).collect()}
    assert got == {("t1", "t2"): ["a", "b", "d"], ("t1", "t3"): ["a", "b", "e"], ("t2", "t3"): ["d", "e"]}


def test_conditional_weights_and_imputation(spark):
    facts = mixed_facts(93)
    fb = fact_base(spark, facts)
    q = spark.createDataFrame([(0, "S", [a]) for a in DOMAINS["a"]], "fold int, pred string, args array<string>")
    rules = [clause("S(x)", 0.0)]
    w = CO.fit_conditional(rules, fb, q, iterations=3, eta=0.5, chains=20, burn=1, steps=2, prior_std=None)
    n_true = sum(1 for f in facts if f[1] == "S")
    assert (w["S(x)"] > 0) == (n_true > 1.5)
    for method in ("newton", "cg"):
        w = CO.fit_conditional(rules, fb, q, iterations=1, method=method, chains=20, burn=1, steps=2)
        assert math.isfinite(w["S(x)"])
    filled = CO.impute_unknown([clause("S(x)", 2.0)], fb, q)
    assert {r["truth"] for r in filled.collect()} == {"true"}
