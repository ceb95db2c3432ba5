import json
import math

import pytest
from pyspark.sql import functions as F

from brute import fact_base, tiny_facts
from factweave.facts import FACTS_DDL, FactBase
from factweave.operators import evaluate as EV, facts_ops as FO, ranking as RK
from factweave.plans.counting import clause_counts
from factweave.plans.ordering import hashed_positions, ordered_positions, running_totals
from factweave.rules import clause, collect_rules
from factweave.schema import Predicate, Schema
from factweave.sources import nested as NS, text as TX

# Five workshops: who supplies and who audits whom.
SHOPS = {
    "supplies": [["mill", "forge"], ["forge", "mill"], ["mill", "press"], ["kiln", "loom"]],
    "audits": [["mill", "forge"], ["press", "kiln"], ["loom", "loom"]],
}


def test_nested_json_and_hand_counts(spark, tmp_path):
    path = tmp_path / "shops.json"
    path.write_text(json.dumps([[SHOPS, {k: [[x + "b" for x in p] for p in v] for k, v in SHOPS.items()}], [{}, {}]]))
    facts = FO.normalise_constants(NS.read_fact_json(spark, str(path)))
    assert facts.count() == 14
    schema = Schema.of(*[Predicate(p, ("shop", "shop")) for p in ("Supplies", "Audits")])
    fb = FactBase(schema, facts)
    # 25 pairs: two audits are not supplies, three supplies are not audits, two supplies are not mutual
    rules = [clause("!Audits(x,y) v Supplies(x,y)"), clause("!Supplies(x,y) v Audits(x,y)"), clause("!Supplies(x,y) v Supplies(y,x)")]
    got = {(r["fold"], r["clause_id"]): (int(r["n_true"]), int(r["n_false"])) for r in clause_counts(rules, fb).collect()}
    for f in (0, 1):
        assert [got[(f, c.clause_id)] for c in rules] == [(23, 2), (22, 3), (23, 2)]


def test_text_facts_rules_and_schema(spark, tmp_path):
    (tmp_path / "x-fold2.db").write_text('A(B1,"two words")  // note\n!A(B2,C)\n? A(B3,C)\n// nothing\nbroken line\nZ(Q)\n')
    schema_path = tmp_path / "s.mln"
    schema_path.write_text("A(left,+right)\nE(left,value!)\n")
    schema = TX.read_schema(spark, str(schema_path))
    rows = {(r["pred"], r["arg_pos"]): (r["type"], r["as_constant"], r["exclusive"]) for r in schema.collect()}
    assert rows == {("A", 0): ("left", False, False), ("A", 1): ("right", True, False), ("E", 0): ("left", False, False), ("E", 1): ("value", False, True)}
    assert Schema.from_df(schema)["A"].constant_args == (1,)
    good, bad = TX.read_facts(spark, str(tmp_path / "x-fold2.db"), schema)
    assert {(r["fold"], tuple(r["args"]), r["truth"]) for r in good.collect()} == {
        (2, ("B1", "two words"), "true"), (2, ("B2", "C"), "false"), (2, ("B3", "C"), "unknown")}
    assert {r["reason"] for r in bad.collect()} == {"not a fact", "undeclared predicate"}
    rules = tmp_path / "r.mln"
    rules.write_text('A(left,right)\n-0.5  !A(x,Big) v A(y,"two words") v x != y\n2 A(x,y)\nA(x,y) v !A(y,x).\n')
    got = {c.text: c for c in collect_rules(TX.read_rules(spark, str(rules))[0])}
    c = got['!A(x,Big) v A(y,"two words") v !=(x,y)']
    assert c.weight == -0.5 and not c.hard and [a.is_var for a in c.literals[0].args] == [True, False]
    assert got["A(x,y) v !A(y,x)"].hard
    TX.write_rules(TX.read_rules(spark, str(rules))[0], str(tmp_path / "out"))
    again, rejected = TX.read_rules(spark, str(tmp_path / "out"))
    assert {c.text for c in collect_rules(again)} == set(got) and rejected.count() == 0
    rules.write_text('1.0 A(x) v B(y\nA(x,y)  C\n1 A(x,"a v b, c") v B(x,"en")\n2.5 A(x,y) B(x)\n1 \n')
    good, rejected = TX.read_rules(spark, str(rules))
    only = collect_rules(good)
    assert [c.text for c in only] == ['A(x,"a v b, c") v B(x,"en")'] and [a.kind for a in only[0].literals[1].args] == ["var", "const"]
    assert rejected.count() == 4
    lines = TX.strip_markers(spark.createDataFrame([("A(x,+y)",), ("1.0 A(x,+y)",)], "value string"))
    assert {r["value"] for r in lines.collect()} == {"A(x,y)", "1.0 A(x,+y)"}
    assert {r["text"] for r in TX.declaration_text(schema).collect()} == {"A(left,+right)", "E(left,value!)"}


def test_positions_and_running_totals(spark):
    df = spark.range(1000).select((F.col("id") % 7).cast("double").alias("p"), "id")
    pos = [r["pos"] for r in hashed_positions(df, [], ["id"], 3).collect()]
    assert sorted(pos) == list(range(1, 1001))
    ranked = {r["id"]: r["pos"] for r in ordered_positions(df, [F.col("p").desc(), F.col("id")]).collect()}
    want = sorted(range(1000), key=lambda i: (-(i % 7), i))
    assert [ranked[i] for i in want] == list(range(1, 1001))
    rt = {r["p"]: r["cum_one"] for r in running_totals(df.withColumn("one", F.lit(1)), [], "p", ["one"]).collect()}
    assert rt[6.0] == 142 and rt[0.0] == 1000


def test_evaluation_against_definitions(spark):
    rows = [("a", 0.9, 1), ("b", 0.8, 0), ("c", 0.7, 1), ("d", 0.7, 0), ("e", 0.2, 0), ("f", 1.0, 0), ("g", 0.0, 1)]
    p = spark.createDataFrame(rows, "atom string, p double, y int")
    pos = [r[1] for r in rows if r[2]]
    neg = [r[1] for r in rows if not r[2]]
    auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert EV.auc_roc(p).first()["auc_roc"] == pytest.approx(auc)
    cll = sum(math.log(max(x, 1e-6)) for x in pos) + sum(math.log(1 - min(x, 1 - 1e-6)) for x in neg)
    assert EV.cll(p).first()["cll"] == pytest.approx(cll / len(rows))
    perfect = spark.createDataFrame([("a", 0.9, 1), ("b", 0.8, 1), ("c", 0.1, 0)], "atom string, p double, y int")
    assert EV.auc_pr(perfect).first()["auc_pr"] == pytest.approx(1.0)
    last = spark.createDataFrame([("a", 0.9, 0), ("b", 0.1, 1)], "atom string, p double, y int")
    # One positive after one negative: precision rises from 0 to 1/2 along the interpolated segment.
    assert EV.auc_pr(last).first()["auc_pr"] == pytest.approx(1 - math.log(2))


def test_negatives_folds_blocks_samples(spark):
    facts = tiny_facts(12, folds=2)
    fb = fact_base(spark, facts, folds=2)
    neg = FO.generate_negatives(fb.relation("P"), amount=2, seed=1).collect()
    assert all((r["fold"], "P", (r["a0"], r["a1"])) not in facts for r in neg)
    s = FO.sample_atoms(fb, "Q", 0.5, -1, -1, 2).collect()
    for f in (0, 1):
        t = sum(1 for x in facts if x[:2] == (f, "Q"))
        for truth, n in ((True, t), (False, 9 - t)):
            got = [r for r in s if r["fold"] == f and r["truth"] == truth]
            assert len(got) == int(0.5 * n + 0.5)
            assert all(((f, "Q", (r["a0"], r["a1"])) in facts) == truth for r in got)
            assert sum(r["scale"] for r in got) == pytest.approx(n if got else 0)
    schema = Schema.of(Predicate("E", ("k", "v"), exclusive_args=(1,)))
    rows = [(0, "E", ["K1", "V1"], "true"), (0, "E", ["K1", "V2"], "true"), (0, "E", ["K2", "V1"], "true"), (0, "E", ["K3", "V1"], "false")]
    broken = FO.check_blocks(FactBase(schema, spark.createDataFrame(rows, FACTS_DDL)), "E").collect()
    assert {(r["a0"], r["n_true"]) for r in broken} == {("K1", 2), ("K3", 0)}
    train, test = FO.kfold(fb.facts, 0, "single")
    assert train.count() + test.count() == len(facts)
    assert FO.group_folds(fb.facts, [1]).count() == test.count()


def test_rank_and_merge(spark):
    rows = [("t1", False, "f1", "i1", 2.0), ("t1", False, "f1", "i2", 4.0), ("t1", False, "f2", "i3", 1.0), ("t2", True, "f3", "i4", 0.5)]
    r = spark.createDataFrame(rows, "template_id string, with_constants boolean, formula_id string, instance string, score double")
    t = {x["template_id"]: x["score"] for x in RK.score_templates(r).collect()}
    assert t == {"t1": 2.0, "t2": 0.5}
    assert [x["formula_id"] for x in RK.ranked_formulas(r).orderBy("rank").collect()] == ["f1", "f2", "f3"]
    m = {x["instance"]: x["score"] for x in RK.merge_rankings(r, r.filter("template_id = 't1'"), "multiply").collect()}
    assert m == {"i1": 4.0, "i2": 8.0, "i3": 2.0, "i4": 0.5}
    assert {x["instance"] for x in RK.filter_kind(r, "constants").collect()} == {"i4"}
    assert RK.normalise_scores(r.limit(1)).first()["score"] is None
