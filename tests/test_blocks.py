"""Exclusive blocks: likelihood, gradient and fit against enumeration of the alternatives."""

import itertools
import math
import random

import pytest
from brute import bindings, clause_true, fact_base
from factweave.operators import grounding as GR, infer as I
from factweave.operators.facts_ops import block_totals, check_blocks
from factweave.operators.learn import block_gradient, block_moments, block_pll, fit_weights
from factweave.plans.blocks import block_signatures
from factweave.rules import clause
from factweave.schema import Predicate, Schema
from pyspark.sql import functions as F

SCHEMA = Schema.of(Predicate("Is", ("a", "b"), (), (1,)), Predicate("At", ("a", "a", "b"), (), (2,)), Predicate("Q", ("a", "a")), Predicate("R", ("b", "b")), Predicate("L", ("a", "b")))
DOMAINS = {"a": ["A1", "A2", "A3"], "b": ["B1", "B2", "B3", "B4"]}
THEORY = [
    clause("Is(x,y)", 0.4), clause("Is(x,B1)", 0.6), clause("!Q(x,z) v Is(x,B2)", 0.3), clause("!Is(x,y) v R(y,z)", -0.5),
    clause("!Q(x,z) v !Is(x,y) v !R(y,w)", 0.25), clause("!Q(x,v) v !At(x,z,y) v R(y,y)", 0.7), clause("!L(x,y) v Is(x,y)", 0.8), clause("L(x,y) v !Is(x,y) v R(y,y)", 0.35), clause("At(x,z,B3)", -0.2),
    clause("!At(x,z,y) v !R(y,w)", 0.15),
]


def exclusive_facts(seed, folds=1):
    rng, out = random.Random(seed), set()
    for f in range(folds):
        for x in DOMAINS["a"]:
            out.add((f, "Is", (x, rng.choice(DOMAINS["b"]))))
            for z in DOMAINS["a"]:
                out.add((f, "At", (x, z, rng.choice(DOMAINS["b"]))))
        for p in ("Q", "R", "L"):
            for args in itertools.product(*[DOMAINS[t] for t in SCHEMA[p].types]):
                if rng.random() < 0.4:
                    out.add((f, p, args))
        out |= {(f, "Q", ("A1", "A2")), (f, "R", ("B1", "B3")), (f, "L", ("A2", "B4"))}
    return out


def theory_of(pred):
    return [c for c in THEORY if any(l.pred == pred for l in c.literals)]


def brute_pll(theory, facts, pred, folds, weights):
    total = 0.0
    free = SCHEMA[pred].arity - 1
    for f in range(folds):
        for head in itertools.product(*[DOMAINS[t] for t in SCHEMA[pred].types[:free]]):
            held = next(x for x in facts if x[:2] == (f, pred) and x[2][:free] == head)
            scores = {}
            for value in DOMAINS["b"]:
                world = facts - {held} | {(f, pred, (*head, value))}
                scores[value] = sum(
                    weights[c.clause_id] * sum(clause_true(c, b, f, world) for b in bindings(c, SCHEMA, DOMAINS)) for c in theory
                )
            top = max(scores.values())
            total += scores[held[2][-1]] - top - math.log(sum(math.exp(s - top) for s in scores.values()))
    return total


@pytest.mark.parametrize("pred", ["Is", "At"])
def test_block_likelihood_and_gradient(spark, pred):
    facts, theory = exclusive_facts(3, folds=2), theory_of(pred)
    fb = fact_base(spark, facts, SCHEMA, DOMAINS, folds=2)
    b = block_signatures({"t": theory, "none": []}, fb, pred).persist()
    free = len(DOMAINS["a"]) ** (SCHEMA[pred].arity - 1)
    kinds = b.filter("problem = 't'").groupBy("block").agg(F.sum("size").alias("size"), F.max("mult").alias("mult")).collect()
    assert all(r["size"] == 4 for r in kinds) and sum(r["mult"] for r in kinds) == 2 * free
    w = {c.clause_id: c.weight for c in theory}
    got = {r["problem"]: r["pll"] for r in block_pll(b, {"t": w, "none": {}}).collect()}
    assert got["t"] == pytest.approx(brute_pll(theory, facts, pred, 2, w), abs=1e-9)
    assert got["none"] == pytest.approx(-2 * free * math.log(4), abs=1e-9)
    grad = {r["clause_id"]: r["gradient"] for r in block_gradient(b, {"t": w, "none": {}}).collect()}
    moments = {(r["ci"], r["cj"]): r["v"] for r in block_moments(b, {"t": w, "none": {}}).filter("problem = 't'").collect()}
    eps = 1e-4

    def at(**more):
        return brute_pll(theory, facts, pred, 2, {k: v + more.get(k, 0.0) for k, v in w.items()})

    for c in w:
        numeric = (at(**{c: eps}) - at(**{c: -eps})) / (2 * eps)
        assert grad.get(c, 0.0) == pytest.approx(numeric, abs=1e-5) and moments.get((c, None), 0.0) == pytest.approx(numeric, abs=1e-5)
    for c, d in itertools.combinations(sorted(w), 2):
        mixed = (at(**{c: eps, d: eps}) - at(**{c: eps, d: -eps}) - at(**{c: -eps, d: eps}) + at(**{c: -eps, d: -eps})) / (4 * eps * eps)
        assert moments.get((c, d), 0.0) == pytest.approx(mixed, abs=1e-4)


def test_fit_of_blocks(spark):
    facts = exclusive_facts(5)
    fb = fact_base(spark, facts, SCHEMA, DOMAINS)
    theory = [c for c in theory_of("Is") if not c.is_unit()] + [clause("Is(x,B1)", 0.0)]
    fit = fit_weights(theory, fb, prior_std=1.0, preds=["Is"], exclusive=True)
    assert fit.converged

    def value(w):
        return brute_pll(theory, facts, "Is", 1, w) - sum(x * x for x in w.values()) / 2

    best = value(fit.weights)
    assert fit.value == pytest.approx(best, abs=1e-8)
    for c in fit.weights:
        for step in (-0.01, 0.01):
            assert value({**fit.weights, c: fit.weights[c] + step}) < best
    with pytest.warns(UserWarning, match="independent"):
        fit_weights(theory, fb, prior_std=1.0, preds=["Is"])


def test_blocks_must_hold_one_true_atom(spark):
    facts = exclusive_facts(7)
    twice = facts | {(0, "Is", ("A1", b)) for b in DOMAINS["b"]}
    gone = {x for x in facts if x[1] != "At" or x[2][:2] != ("A2", "A3")}
    for bad, pred in ((twice, "Is"), (gone, "At")):
        with pytest.raises(ValueError, match="exactly one"):
            block_signatures({"t": theory_of(pred)}, fact_base(spark, bad, SCHEMA, DOMAINS), pred)
    with pytest.raises(ValueError, match="one block"):
        block_signatures({"t": [clause("!Is(x,y) v Is(z,y)")]}, fact_base(spark, facts, SCHEMA, DOMAINS), "Is")


def test_blocks_with_several_free_arguments(spark):
    facts = {x for x in exclusive_facts(8) if x[1] != "At" or x[2][:2] != ("A2", "A3")} | {(0, "At", ("A1", "A1", b)) for b in DOMAINS["b"]}
    fb = fact_base(spark, facts, SCHEMA, DOMAINS)
    assert [tuple(r) for r in block_totals(fb, "At").collect()] == [(0, 9, 7, 1, 1)]
    assert [tuple(r) for r in check_blocks(fb, "At").collect()] == [(0, "A1", "A1", 4)]
    assert [tuple(r) for r in block_totals(fb, "Is").collect()] == [(0, 3, 3, 0, 0)]


def test_joint_moves_of_blocks(spark):
    """Marginals of blocks that depend on one another and on single atoms, against all states."""
    rules = [clause("!Q(x,z) v !Is(x,y) v Is(z,y)", 0.9), clause("Is(x,B1)", 0.5), clause("!R(x,y) v !Is(A1,x) v !Is(A1,y)", 0.4), clause("!Is(A2,y) v S(y)", 0.8), clause("!S(y)", 0.3)]
    schema = Schema.of(*SCHEMA, Predicate("S", ("b",)))
    facts = {x for x in exclusive_facts(9) if x[1] in ("Q", "R")}
    asked = [("Is", (a, b)) for a in DOMAINS["a"] for b in DOMAINS["b"][:3]] + [("S", (b,)) for b in DOMAINS["b"][:2]]
    fb = fact_base(spark, facts, schema, DOMAINS)
    query = spark.createDataFrame([(0, p, list(a)) for p, a in asked], "fold int, pred string, args array<string>")
    g = GR.merge_ground(GR.ground_network(rules, fb, query)).persist()
    name = {x: f"{x[0]}({','.join(x[1])})" for x in asked}
    block = spark.createDataFrame([(0, name[x], x[1][0]) for x in asked if x[0] == "Is"], "fold int, atom string, block string")
    total, on = 0.0, dict.fromkeys(asked, 0.0)
    free = [x for x in asked if x[0] == "S"]
    for values in itertools.product(DOMAINS["b"][:3], repeat=3):
        for bits in itertools.product([False, True], repeat=len(free)):
            true = {("Is", (a, b)) for a, b in zip(DOMAINS["a"], values)} | {x for x, b in zip(free, bits) if b}
            world = facts | {(0, p, a) for p, a in true}
            e = math.exp(sum(c.weight * sum(clause_true(c, b, 0, world) for b in bindings(c, schema, DOMAINS)) for c in rules))
            total += e
            for x in true:
                on[x] += e
    chains = 150
    got = {r["atom"]: r["p"] for r in I.gibbs_blocks(g, block, chains=chains, burn=2, steps=1, seed=2).collect()}
    for x in asked:
        want = on[x] / total
        assert abs(got[name[x]] - want) < 4 * math.sqrt(want * (1 - want) / chains), (x, got[name[x]], want)
    for a in DOMAINS["a"]:
        assert sum(got[name["Is", (a, b)]] for b in DOMAINS["b"][:3]) == pytest.approx(1.0)


def test_large_components_are_left_out(spark):
    rows = [(0, "g1", [("P(a)", True), ("P(b)", True)], 0.5, False, 1.0), (0, "g2", [("Q(a)", True)], 0.7, False, 1.0)]
    ddl = "fold int, gid string, lits array<struct<atom:string,positive:boolean>>, weight double, hard boolean, frequency double"
    g = spark.createDataFrame(rows, ddl)
    p, z = I.exact_small(g, max_atoms=1)
    got = {r["atom"]: r["p"] for r in p.collect()}
    assert got["P(a)"] is None and got["P(b)"] is None and got["Q(a)"] == pytest.approx(1 / (1 + math.exp(-0.7)))
    assert sorted((r["n_atoms"], r["log_z"] is None) for r in z.collect()) == [(1, False), (2, True)]
    state = spark.createDataFrame([(0, "P(a)", True), (0, "P(b)", False), (0, "Q(a)", True)], "fold int, atom string, value boolean")
    assert I.exact_log_likelihood(g, state, max_atoms=1).first()["log_likelihood"] is None
    assert I.exact_log_likelihood(g, state).first()["log_likelihood"] is not None
