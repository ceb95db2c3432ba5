import itertools
import math

import pytest
from pyspark.sql import functions as F

from brute import TINY, atoms, bindings, fact_base, ground, lit_true, tiny_facts
from factweave.operators import grounding as GR, infer as I
from factweave.rules import clause, rules_to_df

THEORY = [
    clause("!P(x,y) v S(x)", 0.8), clause("S(x) v !Q(x,y) v !S(y)", 0.6),
    clause("!S(x)", 0.4), clause("S(x) v !Q(x,y) v R(z,z)", 0.3),
]


def satisfied_weight(theory, facts):
    return sum(c.weight * sum(any(lit_true(l, b, 0, facts) for l in c.literals) for b in bindings(c, TINY)) for c in theory)


def exact(theory, facts, query):
    base = {f for f in facts if (f[1], f[2]) not in query}
    tot, on = 0.0, dict.fromkeys(query, 0.0)
    for vals in itertools.product([False, True], repeat=len(query)):
        world = base | {(0, p, a) for (p, a), v in zip(query, vals) if v}
        e = math.exp(satisfied_weight(theory, world))
        tot += e
        for q, v in zip(query, vals):
            on[q] += e * v
    return {q: on[q] / tot for q in query}


@pytest.fixture(scope="module")
def network(spark):
    facts = tiny_facts(61)
    fb = fact_base(spark, facts)
    query = [("S", a) for a in atoms("S")]
    qdf = spark.createDataFrame([(0, p, list(a)) for p, a in query], "fold int, pred string, args array<string>")
    net = GR.ground_network(THEORY, fb, qdf).persist()
    merged = GR.merge_ground(net).persist()
    return facts, query, net, merged


def name(q):
    return f"{q[0]}({','.join(q[1])})"


def test_exact_and_gibbs(spark, network):
    facts, query, net, g = network
    want = exact(THEORY, facts, query)
    p, z = I.exact_small(g)
    got = {r["atom"]: r["p"] for r in p.collect()}
    for q in query:
        if name(q) in got:
            assert got[name(q)] == pytest.approx(want[q], abs=1e-9)
    m, samples = I.gibbs(g, chains=60, burn=3, steps=10, seed=3, keep_samples=True)
    for r in m.collect():
        q = next(q for q in query if name(q) == r["atom"])
        se = math.sqrt(want[q] * (1 - want[q]) / 60)  # chains are independent
        assert abs(r["p"] - want[q]) < 4 * se
    ratios = I.gelman(samples).collect()
    assert len(ratios) == len(got)
    assert 0 <= I.converged_fraction(samples, 0.5, 0.9, 1000).first()["fraction"] <= 1
    per = I.expected_counts(net, samples).persist()
    mom = {r["clause_id"]: r for r in I.count_moments(per).collect()}
    v = spark.createDataFrame([(c, 1.0 if i == 0 else 0.0) for i, c in enumerate(sorted(mom))], "clause_id string, v double")
    first = sorted(mom)[0]
    cov = {r["clause_id"]: r["value"] for r in I.count_cov_vector(per, v).collect()}
    assert cov[first] == pytest.approx(mom[first]["var_true"], abs=1e-9)


def test_map_cost_and_likelihood(spark, network):
    facts, query, net, g = network
    state = I.map_state(g, seed=1).persist()
    base = {f for f in facts if f[1] != "S"}
    world = base | {(0, "S", (r["atom"][2:-1],)) for r in state.collect() if r["value"]}
    best = satisfied_weight(THEORY, world)
    for q in query:
        key = (0, q[0], q[1])
        assert satisfied_weight(THEORY, world ^ {key}) <= best + 1e-9
    ll = I.exact_log_likelihood(g, state).first()["log_likelihood"]
    all_w = [satisfied_weight(THEORY, base | {(0, q[0], q[1]) for q, v in zip(query, vals) if v})
             for vals in itertools.product([False, True], repeat=len(query))]
    assert ll == pytest.approx(best - math.log(sum(math.exp(w) for w in all_w)), abs=1e-9)
    cost = I.state_cost(g, state).first()["cost"]
    values = {r["atom"]: r["value"] for r in state.collect()}
    want = 0.0
    for r in g.collect():
        sat = any(values[l["atom"]] == l["positive"] for l in r["lits"])
        want += abs(r["weight"]) if sat != (r["weight"] >= 0) else 0.0
    assert cost == pytest.approx(want, abs=1e-9)
    counts = I.state_counts(g, state).first()
    assert counts["n_true"] <= counts["n_total"]
    rep = {r["clause_id"]: r["n_total"] for r in I.clause_report(net, state).collect()}
    assert set(rep) <= {c.clause_id for c in THEORY}


def test_unit_propagation_components_colours(spark):
    rows = [
        (0, "g1", [("a", True)], 0.0, True, 1.0), (0, "g2", [("a", False), ("b", True)], 0.0, True, 1.0),
        (0, "g3", [("b", False), ("c", True), ("d", True)], 1.0, False, 1.0), (0, "g4", [("e", True), ("f", False)], 1.0, False, 1.0),
        (0, "g5", [("f", True), ("h", False)], 1.0, False, 1.0),
    ]
    g = spark.createDataFrame(rows, "fold int, gid string, lits array<struct<atom:string,positive:boolean>>, weight double, hard boolean, frequency double")
    left, fixed = I.propagate_units(g)
    assert {(r["atom"], r["value"]) for r in fixed.collect()} == {("a", True), ("b", True)}
    got = {r["gid"]: [(l["atom"], l["positive"]) for l in r["lits"]] for r in left.collect()}
    assert got["g3"] == [("c", True), ("d", True)] and set(got) == {"g3", "g4", "g5"}
    comp = {r["atom"]: r["component"] for r in I.components(g).collect()}
    assert comp == {"a": "a", "b": "a", "c": "a", "d": "a", "e": "e", "f": "e", "h": "e"}
    col = {r["atom"]: r["colour"] for r in I.colour(g).collect()}
    for r in rows:
        assert len({col[a] for a, _ in r[2]}) == len(r[2])


def test_match_partial_ground_exists_neighbours(spark):
    facts = tiny_facts(71)
    fb = fact_base(spark, facts)
    c = clause("P(x,y) v Q(x,z) v !S(z) v x != z")
    got = {(r["x"], r["y"], r["z"]) for r in GR.match(c, fb).collect()}
    want = {(b["x"], b["y"], b["z"]) for b in bindings(c, TINY) if all(lit_true(l, b, 0, facts) for l in c.literals)}
    assert got == want
    atoms_df = spark.createDataFrame([(0, "Q", ["A1", "A2"]), (0, "Q", ["A1", "A1"])], "fold int, pred string, args array<string>")
    pg = GR.partial_ground(rules_to_df(spark, [clause("!Q(x,x) v S(x)"), clause("Q(x,y) v P(y,B1)")]), atoms_df).collect()
    texts = sorted(" v ".join(f"{'' if l['positive'] else '!'}{l['pred']}({','.join(a['name'] for a in l['args'])})" for l in r["literals"]) for r in pg)
    assert texts == ["!Q(A1,A1) v S(A1)", "Q(A1,A1) v P(A1,B1)", "Q(A1,A2) v P(A2,B1)"]
    ex = {r["a0"] for r in GR.exists(fb, "P", (0,)).collect()}
    assert ex == {a[0] for f, p, a in facts if p == "P"}
    one = {r["a0"] for r in GR.exists(fb, "P", (0,), True).collect()}
    assert one == {x for x in ex if sum(1 for f, p, a in facts if p == "P" and a[0] == x) == 1}
    every = fb.facts.select("fold", "pred", "args")
    nb = GR.neighbours(fb, every).collect()
    fl = [(p, a) for f, p, a in facts if len(set(a)) == len(a)]
    want = {(p, a, c, q, b) for p, a in fl for q, b in fl if (p, a) != (q, b) for c in set(a) & set(b)}
    assert {(r["pred"], tuple(r["args"]), r["const"], r["other_pred"], tuple(r["other_args"])) for r in nb} == want
    counts = {(r["pred"], tuple(r["args"])): r["n"] for r in GR.neighbour_counts(fb).collect()}
    for p, a in fl:
        assert counts[(p, a)] == sum(1 for q, b in fl if (q, b) != (p, a) and set(a) & set(b))
    paths = GR.paths2(fb, "S", 1).collect()
    want = set()
    for p0, a0 in fl:
        if p0 != "S":
            continue
        for p1, a1 in fl:
            if (p1, a1) == (p0, a0) or not set(a0) & set(a1):
                continue
            for p2, a2 in fl:
                if (p2, a2) in ((p0, a0), (p1, a1)) or not set(a1) & set(a2):
                    continue
                if len((set(a1) | set(a2)) - set(a0)) <= 1:
                    want.add((a0, p1, a1, p2, a2))
    assert {(tuple(r["args"]), r["p1"], tuple(r["args1"]), r["p2"], tuple(r["args2"])) for r in paths} == want
