"""Cases in which an earlier version lost or changed something without saying so."""

import itertools

import pytest
from pyspark.sql import functions as F

from brute import fact_base, tiny_facts
from factweave.functions import literals as L
from factweave.operators import facts_ops as FO, grounding as GR, infer as I
from factweave.operators.generate import distinct_rules
from factweave.rules import clause, rules_to_df

GROUND = "fold int, clause_id string, lits array<struct<atom:string,positive:boolean>>, weight double, hard boolean, frequency double"


def ground(spark, *rows):
    data = [(0, str(i), sorted((a.lstrip("!"), not a.startswith("!")) for a in lits.split(" v ")), w, hard, 1.0)
            for i, (lits, w, hard) in enumerate(rows)]
    return GR.merge_ground(spark.createDataFrame(data, GROUND))


def test_hard_and_soft_clauses_stay_apart(spark):
    g = ground(spark, ("A", 0.0, True), ("!A", 0.3, False), ("A", 0.5, False), ("A v B", 2.0, True), ("A v B", 1.0, False))
    rows = {(tuple(l.atom for l in r.lits), r.hard): r.weight for r in g.collect()}
    assert rows == {(("A",), True): 0.0, (("A",), False): pytest.approx(0.2), (("A", "B"), True): 0.0, (("A", "B"), False): 1.0}
    assert g.select("gid").distinct().count() == 4
    _, fixed = I.propagate_units(g)
    assert [(r.atom, r.value) for r in fixed.collect()] == [("A", True)]
    assert {r.atom: r.value for r in I.map_state(g).collect()}["A"]
    p, _ = I.exact_small(g)
    assert {r.atom: r.p for r in p.collect()}["A"] > 0.999
    # a hard clause of negative weight demands that its literals are false, beside a soft one too
    _, fixed = I.propagate_units(ground(spark, ("A v !B", -1.0, True), ("A v !B", 4.0, False)))
    assert {r.atom: r.value for r in fixed.collect()} == {"A": False, "B": True}


@pytest.mark.parametrize("rows", [
    [("A", 0.0, True), ("!A", 0.0, True)],
    [("!A", 0.0, True), ("!B", 0.0, True), ("A v B", 0.0, True)],
    [("A", 0.0, True), ("!A v B", 0.0, True), ("B v C", -1.0, True)],
])
def test_contradictions_are_errors(spark, rows):
    with pytest.raises(ValueError):
        I.propagate_units(ground(spark, *rows))


def test_propagation_follows_a_long_chain(spark):
    chain = [("A0", 0.0, True), *((f"!A{i} v A{i + 1}", 0.0, True) for i in range(24))]
    left, fixed = I.propagate_units(ground(spark, *chain))
    assert left.count() == 0 and fixed.filter("value").count() == 25


def test_long_rules_keep_apart(spark):
    a = "A(x,y) v A(y,z) v A(z,w) v A(w,u) v A(u,s) v B(s,t)"
    b = "A(x,y) v A(y,z) v A(z,w) v A(w,u) v A(u,s) v B(t,s)"
    seven = a + " v !B(x,t)"
    shuffled = " v ".join(reversed(seven.replace("x", "q").split(" v ")))
    df = rules_to_df(spark, [clause(a), clause(b), clause(seven), clause(shuffled)])
    got = distinct_rules(df.select("literals"))
    assert got.count() == 3 and got.filter("text is null").count() == 0


def test_searched_order_is_the_least_of_all(spark):
    for text in ("A(x,y) v !B(y,x) v A(y,y)", 'A(x,"x1") v A(x,z) v B(z,x) v !A(z,x)', "A(x,y) v A(y,z) v A(z,x) v !A(x,z)"):
        lits = [{"pred": l.pred, "positive": l.positive, "args": [{"kind": a.kind, "name": a.name} for a in l.args]} for l in clause(text).literals]
        df = rules_to_df(spark, [clause(text)])
        want = df.select(L.canonical(F.col("literals"))["text"].alias("t")).first().t
        order = L._least_order(lits, "x", None)
        got = df.select(L.text(L.renumber(F.array(*[F.col("literals")[i - 1] for i in order]))).alias("t")).first().t
        assert got == want
        assert {L._least_order([lits[i] for i in p], "x", None) is not None for p in itertools.permutations(range(len(lits)))} == {True}


def test_constants_are_not_variables(spark):
    df = rules_to_df(spark, [clause('P(x,"x2")'), clause("P(x,y)"), clause('P(x,"en")'), clause("P(x,En)")])
    assert {r.text for r in distinct_rules(df.select("literals")).collect()} == {'P(x1,"x2")', "P(x1,x2)", 'P(x1,"en")', "P(x1,En)"}
    assert len({clause(t).clause_id for t in ('P(x,"y")', "P(x,y)", 'P(x,"a,b")')}) == 3
    assert [a.name for a in clause('P(x,"a,b")').literals[0].args] == ["x", "a,b"]


@pytest.mark.parametrize("text", ["A(x) v B(y", "A(x) B(y)", "A(x) v", "", "A()", "x = ", "A(x) v v B(x)"])
def test_text_that_is_no_rule(text):
    with pytest.raises(ValueError):
        clause(text)


def test_samples_stand_for_their_stratum(spark):
    fb = fact_base(spark, tiny_facts(3))
    for fraction in (0.4, 1.0):
        rows = FO.sample_atoms(fb, "P", fraction, -1, -1, seed=2).groupBy("fold", "truth").agg(F.sum("scale").alias("s")).collect()
        for r in rows:
            true = fb.true_totals().get((r.fold, "P"), 0)
            assert r.s == pytest.approx(true if r.truth else fb.possible(r.fold, "P") - true)
