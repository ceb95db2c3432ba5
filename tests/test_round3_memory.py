"""Rows that jobs sort or keep in a task stay narrow, and work that does not change is not repeated."""

import math
import random

from factweave.facts import FactBase
from factweave.operators import grounding as GR
from factweave.operators import infer as I
from factweave.schema import Predicate, Schema

GROUND = "fold int, gid string, lits array<struct<atom:string,positive:boolean>>, weight double, hard boolean, frequency double"
FACTS = "fold int, pred string, args array<string>, truth string"


def test_component_rounds_store_numbers_only(spark, monkeypatch):
    rng = random.Random(5)
    rows, root = [], {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    by_gid = {}
    for i in range(60):  # a gid may repeat, and its rows are one clause
        fold, names = i % 2, [f"a{rng.randrange(70)}" for _ in range(rng.choice([1, 2, 2, 3]))]
        gid = f"g{i // 2 % 28}"
        rows.append((fold, gid, [(a, rng.random() < 0.5) for a in names], 0.0, True, 1.0))
        for a in names:
            find((fold, a))
        if len(names) > 1:
            by_gid.setdefault((fold, gid), []).extend(names)
    rows += [(0, f"c{i}", [(f"z{i}", False), (f"z{i + 1}", True)], 1.0, False, 1.0) for i in range(20)]
    by_gid |= {(0, f"c{i}"): [f"z{i}", f"z{i + 1}"] for i in range(20)}
    for (fold, _), names in by_gid.items():
        for a in names[1:]:
            root[find((fold, a))] = find((fold, names[0]))
    least = {}
    for x in sorted(root, reverse=True):
        least[find(x)] = x[1]
    stored, cut = [], I.cut

    def kept(df):
        stored.append(cut(df))
        return stored[-1]

    monkeypatch.setattr(I, "cut", kept)
    got = {(r.fold, r.atom): r.component for r in I.components(spark.createDataFrame(rows, GROUND)).collect()}
    assert got == {x: least[find(x)] for x in list(root)}
    rounds = [df for df in stored if "label" in df.columns and "atom" not in df.columns]
    assert len(rounds) > 1 and all(t in ("bigint", "boolean") for df in rounds for _, t in df.dtypes)


def test_neighbour_counts_join_degrees_without_lists(spark):
    rng = random.Random(6)
    schema = Schema.of(Predicate("P", ("c", "o")), Predicate("Q", ("o", "c")), Predicate("L", ("c", "c")), Predicate("U", ("o",)), Predicate("R", ("o", "r")))
    facts = set()
    for _ in range(60):
        c, d, o, r = (f"{x}{rng.randrange(6)}" for x in ("c", "c", "o", "r"))
        facts |= {("P", (c, o)), ("Q", (o, d)), ("L", (c, d)), ("U", (o,)), ("R", (o, r))}
    rows = [(0, p, list(a), "true") for p, a in sorted(facts) for _ in range(2)] + [(0, "P", ["c1", None], "true"), (0, "U", [None], "true")]
    df = GR.neighbour_counts(FactBase(schema, spark.createDataFrame(rows, FACTS)))
    whole = [(p, a) for p, a in facts if len(set(a)) == len(a)]
    want = {(p, a): sum(1 for q, b in whole if (q, b) != (p, a) and set(a) & set(b)) for p, a in whole}
    assert {(r.pred, tuple(r.args)): r.n for r in df.collect()} == want
    assert "collect_set" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_blocks_score_unlinked_clauses_once(spark, monkeypatch):
    block = spark.createDataFrame([(0, f"a{d}{v}", f"b{d}") for d in range(6) for v in range(3)], "fold int, atom string, block string")
    rows = [(0, f"g{d}", [(f"a{d}0", True)], 1.5, False, 1.0) for d in range(6)]
    rows += [(0, f"h{d}", [(f"a{d}1", False), (f"a{d}2", False)], 0.7, False, 1.0) for d in range(6)]  # one alternative of two: always true
    seen, scores = [], I._block_scores

    def counted(lits, *rest):
        seen.append({r.gid for r in lits.select("gid").distinct().collect()})
        return scores(lits, *rest)

    monkeypatch.setattr(I, "_block_scores", counted)
    g = spark.createDataFrame(rows, GROUND)
    p = {r.atom: r.p for r in I.gibbs_blocks(g, block, chains=300, burn=0, steps=1, seed=3).collect()}
    z = math.exp(1.5) + 2
    assert not seen and len(p) == 18
    assert abs(sum(p[f"a{d}0"] for d in range(6)) / 6 - math.exp(1.5) / z) < 0.05
    assert all(abs(sum(p[f"a{d}{v}"] for v in range(3)) - 1) < 1e-9 for d in range(6))
    linked = g.unionByName(spark.createDataFrame([(0, "t", [("a00", False), ("a10", True)], 2.0, False, 1.0)], GROUND))
    I.gibbs_blocks(linked, block, chains=2, burn=0, steps=1, seed=3).collect()
    assert seen and all(s == {"t"} for s in seen)
