import math

import numpy as np
import pytest

from brute import TINY, atoms, count_diff, fact_base, mixed_facts, tiny_facts
from factweave.operators.learn import (
    atom_scores, fit_weights, log_odds_weights, pll, pll_gradient, score_candidates, theory_report, unit_theory, unit_weights,
)
from factweave.plans.signatures import signatures
from factweave.rules import clause

THEORY = [
    clause("P(x,y)", 0.3), clause("S(x)", -0.2), clause("!P(x,y) v R(y,z)", 0.7),
    clause("Q(x,y) v !Q(y,z) v Q(x,z)", -0.4), clause("!P(x,z) v Q(x,y) v !P(y,w)", 0.15),
    clause("P(A1,y) v !R(y,z)", 0.5), clause("S(x) v !Q(x,x) v Q(x,y)", 0.25),
]


def brute_pll(theory, facts, folds, equal=False):
    total = 0.0
    for f in range(folds):
        for p in TINY:
            every = atoms(p.name)
            part = 0.0
            for a in every:
                z = sum(c.weight * count_diff(c, (p.name, a), facts, f) for c in theory)
                part -= math.log1p(math.exp(z)) if z < 30 else z
            total += part / len(every) if equal else part
    return total


@pytest.mark.parametrize("seed", [21])
def test_pll_and_gradient(spark, seed):
    facts = tiny_facts(seed, folds=2)
    fb = fact_base(spark, facts, folds=2)
    s = signatures({"t": THEORY}, fb).persist()
    sizes = {r["pred"]: r["m"] for r in s.groupBy("pred").agg({"mult": "sum"}).toDF("pred", "m").collect()}
    assert sizes == {p.name: 2.0 * len(atoms(p.name)) for p in TINY}
    w = {"t": {c.clause_id: c.weight for c in THEORY}}
    assert pll(s, w).first()["pll"] == pytest.approx(brute_pll(THEORY, facts, 2), abs=1e-9)
    grad = {r["clause_id"]: r["gradient"] for r in pll_gradient(s, w).collect()}
    c = THEORY[3]
    eps = 1e-5
    hi = [x if x != c else clause(x.text, x.weight + eps) for x in THEORY]
    lo = [x if x != c else clause(x.text, x.weight - eps) for x in THEORY]
    numeric = (brute_pll(hi, facts, 2) - brute_pll(lo, facts, 2)) / (2 * eps)
    assert grad[c.clause_id] == pytest.approx(numeric, abs=1e-4)


def test_fit_reaches_zero_gradient_and_closed_form(spark):
    facts = mixed_facts(31)
    fb = fact_base(spark, facts)
    units = unit_theory(fb)
    fit = fit_weights(units, fb, prior_std=None)
    closed = {r["pred"]: r["weight"] for r in unit_weights(fb).collect()}
    for u in units:
        assert fit.weights[u.clause_id] == pytest.approx(closed[u.literals[0].pred], abs=1e-5)
    fit = fit_weights(THEORY, fb, prior_std=1.0)
    assert fit.converged
    s = signatures({"t": THEORY}, fb)
    g = pll_gradient(s, {"t": fit.weights}, (0.0, 1.0)).collect()
    assert max(abs(r["gradient"]) for r in g) < 1e-4


def test_candidate_gains_match_separate_fits(spark):
    facts = tiny_facts(41)
    fb = fact_base(spark, facts)
    base = unit_theory(fb)
    cands = [clause("!P(x,y) v R(y,z)"), clause("Q(x,y) v !Q(y,z) v Q(x,z)")]
    got = {r["clause_id"]: r for r in score_candidates(cands, base, fb, prior_std=2.0).collect()}
    ref = fit_weights(base, fb, prior_std=2.0, equal_predicates=True)
    for c in cands:
        one = fit_weights(base + [c], fb, prior_std=2.0, equal_predicates=True)
        assert got[c.clause_id]["gain"] == pytest.approx(one.value - ref.value - 0.01 * len(c.literals), abs=1e-6)
        assert got[c.clause_id]["weight"] == pytest.approx(one.weights[c.clause_id], abs=1e-3)


def test_atom_scores_and_reports(spark):
    facts = tiny_facts(51)
    fb = fact_base(spark, facts)
    rows = [(0, *a) for a in atoms("Q")]
    got = {(r["a0"], r["a1"]): r for r in atom_scores(THEORY, fb, "Q", spark.createDataFrame(rows, "fold int, a0 string, a1 string")).collect()}
    for a in atoms("Q"):
        z = sum(c.weight * count_diff(c, ("Q", a), facts, 0) for c in THEORY)
        assert got[a]["log_prob"] == pytest.approx(-math.log1p(math.exp(z)), abs=1e-9)
    rep = {r["clause_id"]: r for r in theory_report(THEORY, fb).collect()}
    lo = {r["clause_id"]: r["weight"] for r in log_odds_weights(THEORY, fb).collect()}
    for c in THEORY:
        r = rep[c.clause_id]
        t, n = float(r["n_true"]), float(r["n_total"])
        sig = 1 / (1 + math.exp(-c.weight))
        assert r["log_lik"] == pytest.approx(t * math.log(sig) + (n - t) * math.log(1 - sig), abs=1e-9)
        if 0 < t < n:
            assert lo[c.clause_id] == pytest.approx(math.log(t / (n - t)) - math.log(2 ** len(c.literals) - 1), abs=1e-9)


def test_full_sample_equals_exact_signatures(spark):
    from factweave.plans.signatures import sampled_signatures

    facts = mixed_facts(55)
    fb = fact_base(spark, facts)
    some = [THEORY[0], THEORY[2], THEORY[3]]
    w = {"t": {c.clause_id: c.weight for c in some}}
    s = sampled_signatures({"t": some}, fb, 1.0, -1, -1, 3)
    assert pll(s, w).first()["pll"] == pytest.approx(brute_pll(some, facts, 1), abs=1e-9)
    few = sampled_signatures({"t": THEORY[:1]}, fb, 0.0, 1, 2, 3).groupBy("pred").agg({"mult": "sum"}).toDF("pred", "m")
    assert {r["pred"]: r["m"] for r in few.collect()} == {p.name: float(len(atoms(p.name))) for p in TINY}
