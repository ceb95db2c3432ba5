import pytest

from brute import TINY, bindings, clause_true, fact_base, n_false, tiny_facts, lit_true
from factweave.plans.counting import clause_counts, conjunction_counts
from factweave.rules import clause

CLAUSES = [
    "P(x,y)",
    "!P(x,y) v R(y,z)",
    "Q(x,y) v !Q(y,z) v Q(x,z)",
    "!Q(x,y) v !Q(y,z) v !Q(x,z)",
    "P(x,y) v Q(x,z) v R(y,y)",
    "!P(x,y) v !P(z,y) v x = z",
    "!P(x,y) v !P(z,y) v x != z",
    "P(A1,y) v !R(y,z)",
    "!Q(x,x) v S(x)",
    "S(x) v !S(x) v P(x,y)",
    "!S(x) v !R(y,z)",
]


@pytest.mark.parametrize("seed", [1, 2])
def test_clause_counts_match_enumeration(spark, seed):
    facts = tiny_facts(seed, folds=2)
    fb = fact_base(spark, facts, folds=2)
    rules = [clause(c) for c in CLAUSES]
    got = {(r["fold"], r["clause_id"]): r for r in clause_counts(rules, fb).collect()}
    assert len(got) == 2 * len(rules)
    for c in rules:
        total = sum(1 for _ in bindings(c, TINY))
        for f in (0, 1):
            r = got[(f, c.clause_id)]
            nf = n_false(c, facts, f)
            assert (int(r["n_total"]), int(r["n_false"]), int(r["n_true"])) == (total, nf, total - nf), c.text
            assert r["n_true"] + r["n_false"] + r["n_unknown"] == r["n_total"]


def test_conjunction_counts_and_distinct_bindings(spark):
    facts = tiny_facts(5)
    fb = fact_base(spark, facts)
    rules = [clause(c) for c in ["Q(x,y) v Q(y,z)", "Q(x,y) v !Q(y,z) v Q(x,z)", "P(x,y) v !S(x)"]]
    for distinct in (False, True):
        got = {r["clause_id"]: int(r["n"]) for r in conjunction_counts(rules, fb, distinct).collect()}
        for c in rules:
            vt = c.var_types(TINY)
            want = 0
            for b in bindings(c, TINY):
                if distinct and any(b[u] == b[v] for u in b for v in b if u < v and vt[u] == vt[v]):
                    continue
                want += all(lit_true(l, b, 0, facts) for l in c.literals)
            assert got[c.clause_id] == want, (c.text, distinct)


def test_open_world_counts(spark):
    facts = tiny_facts(7, density=0.3)
    false = {t for t in tiny_facts(8, density=0.4) if t not in facts and t[1] == "Q"}
    fb = fact_base(spark, facts, open_world=("Q",), false=false)
    rules = [clause(c) for c in ["Q(x,y) v !Q(y,z) v Q(x,z)", "!P(x,y) v Q(x,x)", "!Q(x,y) v S(x)"]]
    got = {r["clause_id"]: r for r in clause_counts(rules, fb).collect()}

    def value(lit, b):
        key = (0, lit.pred, tuple(b[a.name] if a.is_var else a.name for a in lit.args))
        if key in facts:
            return lit.positive
        if lit.pred != "Q" or key in false:
            return not lit.positive
        return None

    for c in rules:
        t = f = u = 0
        for b in bindings(c, TINY):
            vals = [value(l, b) for l in c.literals]
            if any(v is True for v in vals):
                t += 1
            elif all(v is False for v in vals):
                f += 1
            else:
                u += 1
        r = got[c.clause_id]
        assert (int(r["n_true"]), int(r["n_false"]), int(r["n_unknown"])) == (t, f, u), c.text


def test_computed_predicates(spark):
    from factweave.facts import FACTS_DDL, FactBase
    from factweave.schema import Predicate, Schema

    schema = Schema.of(Predicate("Age", ("person", "num")))
    rows = [(0, "Age", [f"P{i}", str(i * 7 % 5)], "true") for i in range(6)]
    fb = FactBase(schema, spark.createDataFrame(rows, FACTS_DDL))
    c = clause("!Age(x,m) v !Age(y,n) v greaterThan(m,n)")
    ages = [i * 7 % 5 for i in range(6)]
    want = sum(not (m > n) for m in ages for n in ages)
    assert int(clause_counts([c], fb).first()["n_false"]) == want
    c = clause("!Age(x,m) v !succ(m,n)")
    nums = set(ages)
    want = sum((m + 1) in nums for m in ages)
    assert int(clause_counts([c], fb).first()["n_false"]) == want


def test_cycles_with_hub_values_split_off(spark, monkeypatch):
    from factweave.plans import counting

    monkeypatch.setattr(counting, "DIRECT_PAIRS", 0.0)
    facts = tiny_facts(9, folds=2, density=0.6)
    fb = fact_base(spark, facts, folds=2)
    rules = [clause(c) for c in ["!Q(x,y) v !Q(y,z) v !Q(x,z)", "!Q(x,y) v !Q(y,z) v Q(x,z)", "!P(x,y) v !R(y,z) v !P(x,z)"]]
    got = {(r["fold"], r["clause_id"]): int(r["n_false"]) for r in clause_counts(rules, fb).collect()}
    for c in rules:
        for f in (0, 1):
            assert got[(f, c.clause_id)] == n_false(c, facts, f)


def test_registered_predicate(spark):
    from pyspark.sql import functions as F

    from factweave.functions.computed import register_predicate

    register_predicate("sameEnding", lambda a, b: F.substring(a, -1, 1) == F.substring(b, -1, 1))
    facts = tiny_facts(10)
    fb = fact_base(spark, facts)
    c = clause("!P(x,y) v sameEnding(x,y)")
    want = sum(p == "P" and a[0][-1] != a[1][-1] for _, p, a in facts)
    assert int(clause_counts([c], fb).first()["n_false"]) == want


def test_comparisons_between_unconnected_variables(spark):
    from factweave.facts import FACTS_DDL, FactBase
    from factweave.schema import Predicate, Schema

    schema = Schema.of(Predicate("Age", ("person", "num")), Predicate("Limit", ("place", "num")))
    ages = {(f, f"P{i}", str(i * 7 % 11 - 3)) for f in (0, 1) for i in range(12 - f)} | {(0, "P1", "old"), (0, "P2", "old")}
    limits = {(f, f"L{i}", str(i * 3 % 8)) for f in (0, 1) for i in range(7)} | {(1, "L9", "none"), (0, "L2", "9223372036854775807")}
    rows = [(f, "Age", [a, n], "true") for f, a, n in ages] + [(f, "Limit", [a, n], "true") for f, a, n in limits]
    fb = FactBase(schema, spark.createDataFrame(rows, FACTS_DDL))

    def whole(x):
        return int(x) if x.lstrip("-").isdigit() else None

    tests = {
        "lessThan": lambda a, b: a < b, "lessThanEq": lambda a, b: a <= b, "greaterThan": lambda a, b: a > b,
        "greaterThanEq": lambda a, b: a >= b, "succ": lambda a, b: b == a + 1,
    }
    rules, want = [], {}
    for name, test in tests.items():
        for sign in ("", "!"):
            for args in ("m,n", "n,m"):
                c = clause(f"!Age(x,m) v !Limit(y,n) v {sign}{name}({args})")
                rules.append(c)
                for f in (0, 1):
                    total = 0
                    for g, _, m in ages:
                        for h, _, k in limits:
                            if g == h == f:
                                a, b = (whole(m), whole(k)) if args == "m,n" else (whole(k), whole(m))
                                holds = a is not None and b is not None and test(a, b)
                                total += holds == (sign == "!")
                    want[f, c.clause_id] = total
    counts = clause_counts(rules, fb)
    assert {(r["fold"], r["clause_id"]): int(r["n_false"]) for r in counts.collect()} == want


def test_comparison_partners_are_not_paired(spark):
    """Ten thousand values against ten thousand: the plan joins on the value, never on the fold alone."""
    from factweave.facts import FactBase
    from factweave.schema import Predicate, Schema
    from pyspark.sql import functions as F

    n = 10_000
    schema = Schema.of(Predicate("Age", ("person", "num")), Predicate("Limit", ("place", "num")))
    ids = spark.range(n)
    facts = ids.select(
        F.lit(0).alias("fold"), F.lit("Age").alias("pred"),
        F.array(F.concat(F.lit("P"), "id"), F.col("id").cast("string")).alias("args"), F.lit("true").alias("truth"),
    ).unionByName(ids.select(
        F.lit(0).alias("fold"), F.lit("Limit").alias("pred"),
        F.array(F.concat(F.lit("L"), "id"), F.col("id").cast("string")).alias("args"), F.lit("true").alias("truth"),
    ))
    counts = clause_counts([clause("!Age(x,m) v !Limit(y,k) v !lessThan(m,k)")], FactBase(schema, facts))
    assert int(counts.first()["n_false"]) == n * (n - 1) // 2
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line and "Inner" in line]
    assert joins and all("@v" in line or "clause_id" in line or "@part" in line for line in joins), joins


def test_equal_parts_are_counted_once(spark, monkeypatch):
    from factweave.plans import counting

    calls = []
    plain = counting.join_count
    monkeypatch.setattr(counting, "join_count", lambda fb, atoms, *rest: calls.append(atoms) or plain(fb, atoms, *rest))
    facts = tiny_facts(21)
    fb = fact_base(spark, facts)
    texts = ["!P(x,y) v !R(y,z)", "!R(b,k) v !P(a,b)", "!P(x,y) v !R(y,z) v !S(w)", "!Q(x,z) v !Q(z,x)", "!Q(u,w) v !Q(w,u) v !S(k)"]
    rules = [clause(t) for t in texts]
    got = {r["clause_id"]: int(r["n_false"]) for r in clause_counts(rules, fb).collect()}
    assert got == {c.clause_id: n_false(c, facts, 0) for c in rules}
    assert len(calls) == 3  # P with R, Q with Q, S
