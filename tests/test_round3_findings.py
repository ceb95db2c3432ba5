"""Work and storage that grew with rows a job does not need."""

from factweave.facts import FactBase
from factweave.operators import infer as I
from factweave.plans.counting import Atom, count_bindings
from factweave.rules import Term
from factweave.schema import Predicate, Schema

GROUND = "fold int, gid string, lits array<struct<atom:string,positive:boolean>>, weight double, hard boolean, frequency double"
FACTS = "fold int, pred string, args array<string>, truth string"


def test_propagation_stores_only_what_changes(spark, monkeypatch):
    chain = [("a0",)] + [(f"!a{i}", f"a{i + 1}") for i in range(4)] + [("!a4", "!a0", "b", "c")]
    rest = [(f"!u{i}", f"v{i}") for i in range(200)]
    rows = [(0, f"g{i}", [(a.lstrip("!"), a[0] != "!") for a in lits], 0.0, True, 1.0) for i, lits in enumerate(chain + rest)]
    rows.append((0, "soft", [("a1", False), ("z", True)], 0.5, False, 2.0))
    stored, cut = [], I.cut

    def counted(df):
        out = cut(df)
        stored.append(out.count())
        return out

    monkeypatch.setattr(I, "cut", counted)
    left, fixed = I.propagate_units(spark.createDataFrame(rows, GROUND))
    assert {(r.atom, r.value) for r in fixed.collect()} == {(f"a{i}", True) for i in range(5)}
    got = {r.gid: [(l.atom, l.positive) for l in r.lits] for r in left.collect()}
    assert got.pop("g5") == [("b", True), ("c", True)] and got.pop("soft") == [("z", True)] and len(got) == 200
    assert sum(stored) < 60


def test_absent_atoms_on_stored_ones_filter_them(spark):
    facts = [(0, "P", [f"c{i % 4}", f"o{i}"], "true") for i in range(12)] + [(0, "L", [f"c{i}"], "true") for i in (1, 2, 7)]
    facts += [(0, "B", [f"o{i}"], "true") for i in (0, 4, 5)] + [(0, "P", ["c9", None], "true"), (0, "L", ["o8"], "true")]
    schema = Schema.of(Predicate("P", ("c", "o")), Predicate("L", ("c",)), Predicate("B", ("o",)))
    fb = FactBase(schema, spark.createDataFrame(facts, FACTS))
    c, o = Term("var", "c"), Term("var", "o")
    df = count_bindings(fb, [Atom("P", (c, o))], [Atom("L", (c,)), Atom("B", (o,))], {"c": "c", "o": "o"}, ("c",))
    assert {(r.k_c, int(r.n)) for r in df.collect()} == {("c0", 1), ("c3", 3), ("c9", 1)}
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftAnti") == 2 and "Union" not in plan
