import itertools

from pyspark.sql import functions as F

from factweave.facts import FACTS_DDL, FactBase
from factweave.operators import generate as G
from factweave.rules import clause, rules_to_df
from factweave.schema import Predicate, Schema

SOCIAL = Schema.of(
    Predicate("AccountType", ("account", "kind"), (1,)),
    Predicate("Tweets", ("account", "word"), (1,)),
    Predicate("Follows", ("account", "account")),
)


def enumerate_templates(n, n_rel=3, n_var=3):
    """Independent enumeration used as the yardstick."""
    atoms = [(r, i, j) for r in range(n_rel) for i in range(n_var) for j in range(n_var) if i != j]
    seen = set()
    for combo in itertools.combinations(atoms, n):
        groups = [{a[1], a[2]} for a in combo]
        reached = set(groups[0])
        for _ in combo:
            for g in groups:
                if g & reached:
                    reached |= g
        if not all(g <= reached for g in groups):
            continue
        for signs in itertools.product([True, False], repeat=n):
            best = None
            for perm in itertools.permutations(list(zip(combo, signs))):
                rel, var, form = {}, {}, []
                for (r, i, j), s in perm:
                    form.append((rel.setdefault(r, len(rel)), s, var.setdefault(i, len(var)), var.setdefault(j, len(var))))
                best = min(best, tuple(form)) if best else tuple(form)
            seen.add(best)
    return seen


def test_template_counts(spark):
    got = {r["n_literals"]: r["n"] for r in G.templates(spark).groupBy("n_literals").agg(F.count("*").alias("n")).collect()}
    assert got == {2: len(enumerate_templates(2)), 3: len(enumerate_templates(3))} == {2: 29, 3: 210}


def test_instantiate_and_constants(spark):
    t = G.templates(spark, 2, 2)
    f = G.instantiate(t, SOCIAL).persist()
    texts = {r["text"] for r in f.collect()}
    assert "!AccountType(x1,x2) v Follows(x1,x3)" in texts
    assert all(not ("AccountType" in x and "Tweets" in x and x.split(" v ")[0].split(",")[1] == x.split(" v ")[1].split(",")[1]) for x in texts)
    c = G.with_constants(f.filter("text = '!AccountType(x1,x2) v Follows(x1,x3)'"), SOCIAL)
    rows = {r["with_constants"]: r["text"] for r in c.collect()}
    assert rows == {False: "!AccountType(x1,x2) v Follows(x1,x3)", True: "!AccountType(x1,+x2) v Follows(x1,x3)"}
    facts = [(0, "AccountType", ["A1", "Fan"], "true"), (0, "AccountType", ["A2", "News"], "true"),
             (0, "Tweets", ["A1", "W1"], "true"), (0, "Follows", ["A1", "A2"], "true")]
    fb = FactBase(SOCIAL, spark.createDataFrame(facts, FACTS_DDL))
    inst = {r["instance"] for r in G.expand_constants(c.filter("with_constants"), fb).collect()}
    assert inst == {"!AccountType(x1,Fan) v Follows(x1,x3)", "!AccountType(x1,News) v Follows(x1,x3)"}
    f.unpersist()


def test_canonical_signs_expand_lift(spark):
    a = rules_to_df(spark, [clause("!Follows(x,y) v Follows(y,x)"), clause("Follows(u,w) v !Follows(w,u)")])
    assert G.distinct_rules(a).count() == 1
    assert G.new_only(a, a).count() == 0
    signs = {r["text"] for r in G.expand_signs(a).collect()}
    assert len(signs) == 3  # both signs of a symmetric pair: the two mixed patterns are one rule
    unit = rules_to_df(spark, [clause("Follows(x,y)")])
    grown = {r["text"] for r in G.expand(unit, SOCIAL, 3, 2).collect()}
    assert "!Follows(x1,x2)" in grown and "Follows(x1,x2) v Tweets(x1,x3)" in grown
    assert "Follows(x1,x2) v !Follows(x2,x1)" in grown or "!Follows(x1,x2) v Follows(x2,x1)" in grown
    assert "Follows(x1,x2)" not in grown
    lifted = G.lift(rules_to_df(spark, [clause("!Tweets(x,y) v Follows(x,z)"), clause("!AccountType(x,y) v Follows(x,z)"), clause("Follows(a,b)")]))
    assert sorted(r["n_rules"] for r in lifted.collect()) == [1, 2]
    assert len(G.unit_clauses(SOCIAL, repeated=True)) == 4
    ren = {r["text"] for r in G.renamings(rules_to_df(spark, [clause("!Tweets(x,y) v Follows(x,z)")]), SOCIAL).collect()}
    assert ren == {"!Tweets(x1,x2) v Follows(x1,x3)", "!AccountType(x1,x2) v Follows(x1,x3)"}
    pats = {r["text"] for r in G.patterns(SOCIAL, spark, 2, 3).collect()}
    assert "Follows(x1,x1)" in pats and "AccountType(x1,x2) v Follows(x1,x3)" in pats
    star = G.star_signs(rules_to_df(spark, [clause("!Tweets(x,y) v Follows(x,z)")]), F.array(F.lit(1)))
    assert {r["text"] for r in star.collect()} == {"!Tweets(x,y) v Follows(x,z)", "!Tweets(x,y) v !Follows(x,z)"}
