import itertools
import math

import pytest
from pyspark.sql import functions as F

from brute import DOMAINS, TINY, atoms, bindings, fact_base, ground, mixed_facts, n_false, tiny_facts
from factweave.operators import cliques as CL, features as FE
from factweave.plans.patterns import pattern_counts, split_pattern_counts
from factweave.rules import Literal, Term, clause

RULES = [clause("Q(x,y) v Q(y,z) v Q(x,z)"), clause("P(x,y) v R(y,z)"), clause("Q(x,y) v Q(y,x)")]


def is_distinct(b, vt):
    return all(b[u] != b[v] for u, v in itertools.combinations(b, 2) if vt[u] == vt[v])


def brute_patterns(c, facts, distinct):
    n = len(c.literals)
    out = [0] * (1 << n)
    for b in bindings(c, TINY):
        if distinct and not is_distinct(b, c.var_types(TINY)):
            continue
        out[sum(((0, l.pred, ground(l, b)) in facts) << (n - 1 - i) for i, l in enumerate(c.literals))] += 1
    return out


@pytest.mark.parametrize("distinct", [True, False])
def test_pattern_counts(spark, distinct):
    facts = tiny_facts(81)
    fb = fact_base(spark, facts)
    got = {(r["clause_id"], r["mask"]): int(r["n"]) for r in pattern_counts(RULES, fb, distinct, start=1).collect()}
    for c in RULES:
        for m, want in enumerate(brute_patterns(c, facts, distinct)):
            assert got[(c.clause_id, m)] == want + 1
    if distinct:
        sp = split_pattern_counts(RULES[:1], fb, True).collect()
        assert {r["split"] for r in sp} == {4, 5, 6}
        pair = {r["mask"]: int(r["n"]) for r in sp if r["split"] == 6 and r["part"] == 1}
        assert [pair[m] for m in range(4)] == brute_patterns(clause("Q(x,y) v Q(y,z)"), facts, True)


def test_decomposition_and_independence(spark):
    facts = mixed_facts(82)
    fb = fact_base(spark, facts)
    c = RULES[1]
    n = [x + 1 for x in brute_patterns(c, facts, True)]
    a = [x + 1 for x in brute_patterns(clause("P(x,y)"), facts, True)]
    b = [x + 1 for x in brute_patterns(clause("R(y,z)"), facts, True)]
    want = sum(
        n[m] / sum(n) * math.log(n[m] / sum(n) / (a[m >> 1] / sum(a) * b[m & 1] / sum(b))) for m in range(4)
    )
    _, best = CL.kl_decomposition([c], fb)
    assert best.first()["score"] == pytest.approx(want, abs=1e-9)
    cells = [x + 0.25 for x in brute_patterns(c, facts, True)]
    pa = sum(1 for f in facts if f[1] == "P") / len(atoms("P"))
    pb = sum(1 for f in facts if f[1] == "R") / len(atoms("R"))
    ind = [(pa if m >> 1 else 1 - pa) * (pb if m & 1 else 1 - pb) for m in range(4)]
    llr = sum(x * math.log(x / sum(cells)) - x * math.log(i / sum(ind)) for x, i in zip(cells, ind))
    row = CL.independence_llr([c], fb).first()
    assert row["llr"] == pytest.approx(llr, abs=1e-9)
    assert row["llr_per_grounding"] == pytest.approx(llr / sum(cells), abs=1e-9)
    sym = CL.decomposition_parts([RULES[2]], fb).groupBy("split").agg(F.sum("p").alias("p"), F.sum("mult").alias("m")).first()
    assert sym["p"] == pytest.approx(1.0) and sym["m"] == 4
    rates = {r["mask"]: r["rate"] for r in CL.pattern_rates([c], fb).collect()}
    plain = brute_patterns(c, facts, False)
    assert rates[3] == pytest.approx(plain[3] / sum(plain))


def test_significance(spark):
    facts = mixed_facts(83)
    fb = fact_base(spark, facts)
    c = clause("!P(x,y) v R(y,z) v S(x)")
    rows = {r["split"]: r for r in CL.split_significance([c], fb).collect()}
    total = 3 * 2 * 2
    rate = 1 - n_false(c, facts, 0) / total
    for i in range(3):
        one = clause(str(c.literals[i]))
        rest = clause(" v ".join(str(l) for j, l in enumerate(c.literals) if j != i))
        p = [1 - n_false(x, facts, 0) / sum(1 for _ in bindings(x, TINY)) for x in (one, rest)]
        p0 = 1 - (1 - p[0]) * (1 - p[1])
        z = math.sqrt(total) * abs(rate - p0) / math.sqrt(p0 * (1 - p0))
        assert rows[i]["z"] == pytest.approx(z, abs=1e-9)
        assert rows[i]["p_value"] == pytest.approx(math.erfc(z / math.sqrt(2)), abs=1e-6)
    assert CL.split_averages(CL.split_significance([c], fb)).first()["z"] == pytest.approx(sum(r["z"] for r in rows.values()) / 3)


def test_count_by_and_union_estimate(spark):
    facts = tiny_facts(84)
    fb = fact_base(spark, facts)
    c = clause("P(x,y) v R(y,z)")
    got = {(tuple(r["vars"]), tuple(r["binding"])): int(r["n"]) for r in CL.count_by(c, fb).collect()}
    want = {}
    for b in bindings(c, TINY):
        if is_distinct(b, c.var_types(TINY)) and all((0, l.pred, ground(l, b)) in facts for l in c.literals):
            for k in range(4):
                for keep in itertools.combinations(["x", "y", "z"], k):
                    key = (keep, tuple(b[v] for v in keep))
                    want[key] = want.get(key, 0) + 1
    assert got == want
    true = sum(any((0, l.pred, ground(l, b)) in facts for l in c.literals) for b in bindings(c, TINY))
    est = CL.estimate_true(c, fb, eps=0.05).first()
    assert est["estimate"] == pytest.approx(true, rel=0.05)


def test_features_and_blankets(spark):
    facts = tiny_facts(85)
    fb = fact_base(spark, facts)
    shapes = FE.feature_shapes(TINY, "P", 2, 1)
    t = FE.feature_table(fb, "P", shapes).persist()
    got = {(r["a0"], r["a1"]): set(r["features"]) for r in t.collect()}
    listed = [a for f, p, a in facts if p == "P"]
    assert set(got) == set(listed)
    for x, y in listed:
        env = {"t0": x, "t1": y}
        want = set()
        for name, lits in shapes.items():
            types = {a.name: ty for l in lits for a, ty in zip(l.args, TINY[l.pred].types)}
            free = [v for v in types if v.startswith("f")]
            ok = False
            for vals in itertools.product(*[DOMAINS[types[f]] for f in free]):
                e = {**env, **dict(zip(free, vals))}
                if any(v in (x, y) for v in vals):
                    continue
                ok |= all((0, l.pred, tuple(e[a.name] for a in l.args)) in facts for l in lits)
            if ok:
                want.add(name)
        assert got[(x, y)] == want
    rows = [(0, i, [f for f, on in (("a", i % 2), ("b", i % 2 if i % 7 else 1), ("c", i % 3 == 0)) if on]) for i in range(400)]
    df = spark.createDataFrame(rows, "fold int, id int, features array<string>").persist()
    r = {(x["x"], x["y"]): x for x in FE.chi2_alpha(df, [("a", "b", ()), ("a", "c", ()), ("a", "b", ("c",))]).collect()}
    assert r[("a", "b")]["alpha"] == 0.005 and r[("a", "c")]["alpha"] > 0.05
    mb = FE.markov_blanket(df, ["a", "b", "c"])
    assert mb["a"] == {"b"} and mb["b"] == {"a"} and mb["c"] == set()
    tgt = Literal("P", True, (Term("var", "t0"), Term("var", "t1")))
    cl = FE.blanket_clauses(tgt, shapes, {"Q(t0,f0)"}, 2)
    assert len(cl) == 4
