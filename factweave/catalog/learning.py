"""Queries over likelihoods, weights, ground networks and inference."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.local import small_table
from ..plans.storage import stored
from . import dbl, n, query, r6, views
from .base import GOOD_SQL, MAIN, MAIN_RULES, good_docs
from ..facts import FactBase, union_all
from ..operators import grounding as GR, infer as I, learn as L
from ..plans.blocks import block_signatures
from ..plans.signatures import signatures
from ..rules import Clause, clause
from ..schema import Predicate, Schema
from ..sources import tables as T
from ..sources.tables import view_fact_base

NATIONS = ("CustNation", "SuppNation")
SAME = "!CustNation(c,n) v !SuppNation(s,n)"
WEIGHTS = {"same_nation": 0.01, "CustNation(x0,x1)": -3.0, "SuppNation(x0,x1)": -2.5}


def nation_theory() -> list[Clause]:
    return [clause(SAME, WEIGHTS["same_nation"], clause_id="same_nation")] + [
        clause(f"{p}(x0,x1)", WEIGHTS[f"{p}(x0,x1)"]) for p in NATIONS
    ]


# Per nation: facts m and absent atoms of each relation, and the count vector value k they share.
NATION_ATOMS = (
    views(*NATIONS)
    + f"""
, cn AS (SELECT b, count(*) AS m FROM CustNation GROUP BY b), sn AS (SELECT b, count(*) AS m FROM SuppNation GROUP BY b),
per AS (SELECT d.c AS b, CAST(coalesce(cn.m, 0) AS DOUBLE) AS mc, CAST(coalesce(sn.m, 0) AS DOUBLE) AS ms FROM d_nation d LEFT JOIN cn ON cn.b = d.c LEFT JOIN sn ON sn.b = d.c),
atoms AS (
SELECT 'CustNation' AS pred, true AS truth, ms AS k, mc AS mult FROM per UNION ALL SELECT 'CustNation', false, -ms, {n('customer')} - mc FROM per
UNION ALL SELECT 'SuppNation', true, mc, ms FROM per UNION ALL SELECT 'SuppNation', false, -mc, {n('supplier')} - ms FROM per),
z AS (SELECT pred, truth, k, mult, 0.01 * k + (CASE WHEN truth THEN -1 ELSE 1 END) * (CASE WHEN pred = 'CustNation' THEN -3.0 ELSE -2.5 END) AS z FROM atoms WHERE mult > 0),
lp AS (SELECT *, -(greatest(z, 0) + ln(1 + exp(-abs(z)))) AS logp FROM z)
"""
)


@query("signature_table", NATION_ATOMS + "SELECT pred, truth, k AS n, sum(mult) AS mult FROM atoms WHERE mult > 0 GROUP BY pred, truth, k")
def q_signatures(spark, sf):
    fb = view_fact_base(spark, sf, list(NATIONS))
    s = signatures({"t": [clause(SAME, clause_id="same_nation")]}, fb)
    value = F.coalesce(F.get("sig", F.lit(0))["n"], F.lit(0.0))
    return s.groupBy("pred", "truth", value.alias("n")).agg(F.sum("mult").alias("mult"))


@query("pseudo_log_likelihood", NATION_ATOMS + "SELECT round(sum(mult * logp), 4) AS pll FROM lp")
def q_pll(spark, sf):
    fb = view_fact_base(spark, sf, list(NATIONS))
    return L.pll(signatures({"t": nation_theory()}, fb), {"t": WEIGHTS}).select(r6("pll", 4))


@query(
    "pll_gradient",
    NATION_ATOMS
    + """SELECT 'same_nation' AS clause_id, round(sum(mult * (exp(logp) - 1) * k) - 0.01 / 4.0, 3) AS gradient FROM lp
UNION ALL SELECT 'CustNation(x0,x1)', round(sum(mult * (exp(logp) - 1) * CASE WHEN truth THEN -1 ELSE 1 END) + 3.0 / 4.0, 3) FROM lp WHERE pred = 'CustNation'
UNION ALL SELECT 'SuppNation(x0,x1)', round(sum(mult * (exp(logp) - 1) * CASE WHEN truth THEN -1 ELSE 1 END) + 2.5 / 4.0, 3) FROM lp WHERE pred = 'SuppNation'""",
)
def q_gradient(spark, sf):
    fb = view_fact_base(spark, sf, list(NATIONS))
    g = L.pll_gradient(signatures({"t": nation_theory()}, fb), {"t": WEIGHTS}, prior=(0.0, 2.0))
    return g.select("clause_id", r6("gradient", 3))


@query(
    "equal_weighted_pll",
    NATION_ATOMS
    + f"""SELECT round(sum(mult * logp / CASE WHEN pred = 'CustNation' THEN {n('customer')} * {n('nation')} ELSE {n('supplier')} * {n('nation')} END), 6) AS pll FROM lp""",
)
def q_equal_pll(spark, sf):
    fb = view_fact_base(spark, sf, list(NATIONS))
    s = L.scale_by_predicate(signatures({"t": nation_theory()}, fb), fb)
    return L.pll(s, {"t": WEIGHTS}).select(r6("pll"))


# Nations of customers as blocks: one nation holds per customer, and a nation with k suppliers scores -0.01 k.
# Segments as blocks: a customer with k orders scores 0.05 k for one of the segments.
BLOCK_SQL = (
    views("CustNation", "SuppNation", "Placed", "Segment")
    + """
, k AS (SELECT d.c AS b, CAST(coalesce(s.m, 0) AS DOUBLE) AS k FROM d_nation d LEFT JOIN (SELECT b, count(*) AS m FROM SuppNation GROUP BY b) s ON s.b = d.c),
z AS (SELECT ln(sum(exp(-0.01 * k))) AS z, sum(k * exp(-0.01 * k)) / sum(exp(-0.01 * k)) AS e FROM k),
nat AS (SELECT -0.01 * k.k - z.z AS logp, z.e - k.k AS g FROM CustNation c JOIN k USING (b), z),
o AS (SELECT c.a, c.b = 'BUILDING' AS hit, CAST(coalesce(p.m, 0) AS DOUBLE) AS k, n FROM Segment c LEFT JOIN (SELECT a, count(*) AS m FROM Placed GROUP BY a) p ON p.a = c.a,
  (SELECT count(*) AS n FROM d_segment)),
seg AS (SELECT CASE WHEN hit THEN 0.05 * k ELSE 0 END - ln(exp(0.05 * k) + n - 1) AS logp,
  k * (CASE WHEN hit THEN 1 ELSE 0 END - exp(0.05 * k) / (exp(0.05 * k) + n - 1)) AS g FROM o)
"""
)
BLOCK_WEIGHTS = {"same_nation": 0.01, "ordering": 0.05}


def _blocks(spark, sf):
    fb = view_fact_base(spark, sf, ["CustNation", "SuppNation", "Placed", "Segment"])
    theory = {"t": [clause(SAME, clause_id="same_nation"), clause('!Placed(c,o) v Segment(c,"BUILDING")', clause_id="ordering")]}
    return union_all([block_signatures(theory, fb, p) for p in ("CustNation", "Segment")])


@query(
    "block_pseudo_log_likelihood",
    BLOCK_SQL + """SELECT 'CustNation' AS pred, round(sum(logp), 4) AS pll FROM nat UNION ALL SELECT 'Segment', round(sum(logp), 4) FROM seg""",
)
def q_block_pll(spark, sf):
    b = _blocks(spark, sf)
    by_pred = b.withColumn("problem", F.col("pred"))  # the theory at equal weights, one value per predicate
    return L.block_pll(by_pred, {p: BLOCK_WEIGHTS for p in ("CustNation", "Segment")}).select(F.col("problem").alias("pred"), r6("pll", 4))


@query(
    "block_pll_gradient",
    BLOCK_SQL + """SELECT 'same_nation' AS clause_id, round(sum(g), 3) AS gradient FROM nat UNION ALL SELECT 'ordering', round(sum(g), 3) FROM seg""",
)
def q_block_gradient(spark, sf):
    return L.block_gradient(_blocks(spark, sf), {"t": BLOCK_WEIGHTS}).select("clause_id", r6("gradient", 3))


@query(
    "block_kinds",
    BLOCK_SQL + """SELECT 'CustNation' AS pred, CAST(count(*) AS DOUBLE) AS blocks, CAST(count(*) * (SELECT count(*) FROM d_nation) AS DOUBLE) AS alternatives FROM nat
UNION ALL SELECT 'Segment', count(*), count(*) * (SELECT count(*) FROM d_segment) FROM seg""",
)
def q_block_kinds(spark, sf):
    """Blocks and alternatives that the kinds of blocks stand for."""
    b = _blocks(spark, sf)
    return b.groupBy("pred").agg(
        F.sum(F.when(F.col("chosen"), F.col("mult")).otherwise(0.0)).alias("blocks"), F.sum(F.col("mult") * F.col("size")).alias("alternatives")
    )


@query(
    "atom_probabilities",
    views(*NATIONS)
    + """, k AS (SELECT b, count(*) AS m FROM SuppNation GROUP BY b)
SELECT c.a AS a0, c.b AS a1, round(1 / (1 + exp(0.01 * coalesce(k.m, 0) + 3.0)), 6) AS p_true FROM CustNation c LEFT JOIN k ON k.b = c.b""",
)
def q_atom_probabilities(spark, sf):
    fb = view_fact_base(spark, sf, list(NATIONS))
    scores = L.atom_scores(nation_theory(), fb, "CustNation", fb.relation("CustNation"))
    return scores.select("a0", "a1", r6("p_true"))


@query(
    "unit_weights",
    views(*MAIN)
    + f"""SELECT 'CustNation' AS pred, round(ln(count(*) / ({n('customer')} * {n('nation')} - count(*))), 6) AS weight FROM CustNation
UNION ALL SELECT 'SuppNation', round(ln(count(*) / ({n('supplier')} * {n('nation')} - count(*))), 6) FROM SuppNation
UNION ALL SELECT 'Supplies', round(ln(count(*) / ({n('supplier')} * {n('part_')} - count(*))), 6) FROM Supplies""",
)
def q_unit_weights(spark, sf):
    return L.unit_weights(view_fact_base(spark, sf, list(MAIN))).select("pred", r6("weight"))


@query(
    "fitted_unit_weights",
    views(*MAIN)
    + f"""SELECT 'CustNation(x0,x1)' AS clause_id, round(ln(count(*) / ({n('customer')} * {n('nation')} - count(*))), 4) AS weight FROM CustNation
UNION ALL SELECT 'SuppNation(x0,x1)', round(ln(count(*) / ({n('supplier')} * {n('nation')} - count(*))), 4) FROM SuppNation
UNION ALL SELECT 'Supplies(x0,x1)', round(ln(count(*) / ({n('supplier')} * {n('part_')} - count(*))), 4) FROM Supplies""",
)
def q_fit_units(spark, sf):
    fb = view_fact_base(spark, sf, list(MAIN))
    fit = L.fit_weights(L.unit_theory(fb), fb, prior_std=None, tol=1e-12)
    return small_table(spark, list(fit.weights.items()), "clause_id string, weight double").select("clause_id", r6("weight", 4))


@query("candidate_gains")
def q_gains(spark, sf):
    fb = view_fact_base(spark, sf, list(MAIN))
    cands = [clause(t, clause_id=k) for k, t in MAIN_RULES.items()]
    return L.score_candidates(cands, L.unit_theory(fb), fb, prior_std=2.0).select("clause_id", "weight", "gain")


@query(
    "log_odds_weights",
    views(*NATIONS)
    + f""", cn AS (SELECT b, count(*) AS k FROM CustNation GROUP BY b), sn AS (SELECT b, count(*) AS k FROM SuppNation GROUP BY b),
f AS (SELECT CAST(sum(cn.k * sn.k) AS DOUBLE) AS f, {n('customer')} * {n('supplier')} * {n('nation')} AS t FROM cn JOIN sn USING (b))
SELECT 'same_nation' AS clause_id, round(ln((t - f) / f) - ln(3), 6) AS weight FROM f""",
)
def q_log_odds(spark, sf):
    fb = view_fact_base(spark, sf, list(NATIONS))
    return L.log_odds_weights([clause(SAME, clause_id="same_nation")], fb).select("clause_id", r6("weight"))


@query(
    "theory_report",
    views(*NATIONS)
    + f""", cn AS (SELECT b, count(*) AS k FROM CustNation GROUP BY b), sn AS (SELECT b, count(*) AS k FROM SuppNation GROUP BY b),
r AS (SELECT 'same_nation' AS clause_id, 0.01 AS w, CAST(sum(cn.k * sn.k) AS DOUBLE) AS f, {n('customer')} * {n('supplier')} * {n('nation')} AS t FROM cn JOIN sn USING (b)
UNION ALL SELECT 'CustNation(x0,x1)', -3.0, {n('customer')} * {n('nation')} - count(*), {n('customer')} * {n('nation')} FROM CustNation
UNION ALL SELECT 'SuppNation(x0,x1)', -2.5, {n('supplier')} * {n('nation')} - count(*), {n('supplier')} * {n('nation')} FROM SuppNation)
SELECT clause_id, t - f AS n_true, t AS n_total, round(w * (t - f), 4) AS weighted_true, round(-(t - f) * ln(1 + exp(-w)) - f * ln(1 + exp(w)), 4) AS log_lik FROM r""",
)
def q_theory_report(spark, sf):
    fb = view_fact_base(spark, sf, list(NATIONS))
    return L.theory_report(nation_theory(), fb).select("clause_id", *dbl("n_true", "n_total"), r6("weighted_true", 4), r6("log_lik", 4))


# Quality of unlabelled documents, given language and source.
DOC_RULES = [
    clause("!DocLang(d,l) v Good(d)", 0.5, clause_id="lang_good"),
    clause("!DocSource(d,s) v !Good(d)", 0.2, clause_id="source_bad"),
    clause("!Good(d)", 0.1, clause_id="bias"),
]
DOC_QUERY_SQL = GOOD_SQL + """, q AS (SELECT a FROM docs WHERE a NOT IN (SELECT a FROM g) AND a NOT IN (SELECT a FROM f)),
s AS (SELECT DISTINCT 'D' || doc_id AS a, source AS b FROM documents),
w AS (SELECT q.a AS a, 0.5 * (SELECT count(*) FROM DocLang x WHERE x.a = q.a) - 0.2 * (SELECT count(*) FROM s x WHERE x.a = q.a) - 0.1 AS w FROM q) """


def doc_network(spark, sf):
    fb = good_docs(spark, sf)
    docs = fb.constants_of("doc").withColumnRenamed("const", "a0")
    labelled = fb.relation("Good").unionByName(fb.relation("Good", "false"))
    unlabelled = docs.join(labelled, ["fold", "a0"], "left_anti")
    q = unlabelled.select("fold", F.lit("Good").alias("pred"), F.array("a0").alias("args"))
    closed = FactBase(fb.schema, fb.facts)
    return GR.ground_network(DOC_RULES, closed, q)


@query("ground_network", DOC_QUERY_SQL + """SELECT 'lang_good' AS clause_id, CAST(count(*) AS BIGINT) AS n, CAST(count(*) AS DOUBLE) AS frequency FROM q JOIN DocLang USING (a)
UNION ALL SELECT 'source_bad', count(*), CAST(count(*) AS DOUBLE) FROM q JOIN s USING (a) UNION ALL SELECT 'bias', count(*), CAST(count(*) AS DOUBLE) FROM q""")
def q_network(spark, sf):
    g = doc_network(spark, sf)
    return g.groupBy("clause_id").agg(F.count(F.lit(1)).alias("n"), F.sum("frequency").alias("frequency"))


@query("merged_ground_clauses", DOC_QUERY_SQL + "SELECT 'Good(' || a || ')' AS atom, round(CAST(w AS DOUBLE), 6) AS weight FROM w")
def q_merged(spark, sf):
    g = GR.merge_ground(doc_network(spark, sf))
    return g.select(F.get("lits", F.lit(0))["atom"].alias("atom"), r6("weight"))


@query("exact_marginals", DOC_QUERY_SQL + "SELECT 'Good(' || a || ')' AS atom, round(1 / (1 + exp(-w)), 6) AS p FROM w")
def q_exact(spark, sf):
    p, _ = I.exact_small(GR.merge_ground(doc_network(spark, sf)), max_atoms=4)
    return p.select("atom", r6("p"))


# The language of documents drawn as blocks: a document of two rules' worth of weight for one language, none for the others.
LANG_SQL = """WITH d AS (SELECT DISTINCT doc_id, lang, source FROM documents WHERE lang IS NOT NULL), l AS (SELECT DISTINCT lang FROM d),
w AS (SELECT 'DocTongue(D' || d.doc_id || ',' || l.lang || ')' AS atom, d.doc_id, sum(CASE WHEN d.lang = l.lang THEN 1.0 ELSE 0 END) AS w FROM d, l GROUP BY 1, 2)"""


def tongue_sample(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("lang is not null").select("doc_id", "lang").distinct()
    known = T.facts_from_table(docs, "DocLang", ["doc_id", "lang"], ("D", ""))
    fb = FactBase(Schema.of(Predicate("DocLang", ("doc", "lang")), Predicate("DocTongue", ("doc", "lang"), (), (1,))), known)
    pairs = fb.constants_of("doc").withColumnRenamed("const", "a0").join(
        F.broadcast(fb.constants_of("lang").withColumnRenamed("const", "a1")), "fold")  # four languages
    query_atoms = pairs.select("fold", F.lit("DocTongue").alias("pred"), F.array("a0", "a1").alias("args"))
    g = GR.merge_ground(GR.ground_network([clause("!DocLang(d,l) v DocTongue(d,l)", 1.0, clause_id="same")], fb, query_atoms))
    block = pairs.select(
        "fold", F.concat(F.lit("DocTongue("), "a0", F.lit(","), "a1", F.lit(")")).alias("atom"), F.col("a0").alias("block"))
    return g, block


@query(
    "block_marginals",
    LANG_SQL + """, z AS (SELECT doc_id, sum(exp(w)) AS z FROM w GROUP BY doc_id)
SELECT CASE WHEN w.w > 0 THEN 'own' ELSE 'other' END AS side, count(*) AS atoms, CAST(round(avg(exp(w.w) / z.z), 1) AS DOUBLE) AS p, 0 AS odd_blocks
FROM w JOIN z USING (doc_id) GROUP BY 1""",
)
def q_block_marginals(spark, sf):
    """Joint draws: every block sums to one, and the mean marginals are those of the softmax."""
    g, block = tongue_sample(spark, sf)
    p = I.gibbs_blocks(g, block, chains=4, burn=1, steps=4, seed=1)
    own = g.select("fold", F.get("lits", F.lit(0))["atom"].alias("atom"), F.lit("own").alias("side"))
    rows = p.join(own, ["fold", "atom"], "left").fillna("other", ["side"]).join(block, ["fold", "atom"])
    odd = rows.groupBy("fold", "block").agg(F.sum("p").alias("s")).filter("abs(s - 1) > 1e-9").agg(F.count(F.lit(1)).cast("int").alias("odd_blocks"))
    means = rows.groupBy("side").agg(F.count(F.lit(1)).alias("atoms"), F.round(F.avg("p"), 1).alias("p"))
    return means.join(F.broadcast(odd), F.lit(True))


@query("gibbs_marginals")
def q_gibbs(spark, sf):
    g = GR.merge_ground(doc_network(spark, sf))
    return I.gibbs(g, chains=4, burn=1, steps=4, seed=1).select("atom", "p")


@query("most_probable_state", DOC_QUERY_SQL + "SELECT 'Good(' || a || ')' AS atom, w > 0 AS value FROM w WHERE w <> 0")
def q_map(spark, sf):
    return I.map_state(GR.merge_ground(doc_network(spark, sf)), seed=1).select("atom", "value")


# Customers and orders: unknown Loyal(customer), Big(order); urgent orders are big for certain.
def order_network(spark, sf):
    base = view_fact_base(spark, sf, ["Placed", "Priority"])
    schema = Schema.of(*base.schema, Predicate("Loyal", ("customer",)), Predicate("Big", ("order",)))
    fb = FactBase(schema, base.facts)
    q = union_all([
        fb.relation("Placed").select("fold", F.lit("Loyal").alias("pred"), F.array("a0").alias("args")).distinct(),
        fb.relation("Placed").select("fold", F.lit("Big").alias("pred"), F.array("a1").alias("args")).distinct(),
    ])
    rules = [
        clause("!Big(o) v !Placed(c,o) v Loyal(c)", 0.0, hard=True, clause_id="big_means_loyal"),
        clause('!Priority(o,"1-URGENT") v Big(o)', 0.0, hard=True, clause_id="urgent_is_big"),
        clause("!Loyal(c)", 0.3, clause_id="few_loyal"),
    ]
    return GR.ground_network(rules, fb, q)


ORDER_SQL = views("Placed", "Priority") + ", urgent AS (SELECT a FROM Priority WHERE b = '1-URGENT') "


@query(
    "unit_propagation",
    ORDER_SQL + """SELECT 'Big(' || a || ')' AS atom, true AS value FROM urgent WHERE a IN (SELECT b FROM Placed)
UNION ALL SELECT 'Loyal(' || c || ')', true FROM (SELECT DISTINCT p.a AS c FROM Placed p JOIN urgent u ON p.b = u.a)""",
)
def q_units(spark, sf):
    _, fixed = I.propagate_units(GR.merge_ground(order_network(spark, sf)))
    return fixed.select("atom", "value")


@query(
    "hard_beside_soft",
    ORDER_SQL + """SELECT 'Big(' || b || ')' AS atom, false AS hard, CAST(-0.3 AS DOUBLE) AS weight FROM (SELECT DISTINCT b FROM Placed)
UNION ALL SELECT 'Big(' || a || ')', true, CAST(0 AS DOUBLE) FROM urgent WHERE a IN (SELECT b FROM Placed)""",
)
def q_hard_beside_soft(spark, sf):
    """A hard rule and a soft rule on the same atom stay two ground clauses."""
    base = view_fact_base(spark, sf, ["Placed", "Priority"])
    fb = FactBase(Schema.of(*base.schema, Predicate("Big", ("order",))), base.facts)
    q = fb.relation("Placed").select("fold", F.lit("Big").alias("pred"), F.array("a1").alias("args")).distinct()
    rules = [
        clause('!Priority(o,"1-URGENT") v Big(o)', 0.0, hard=True, clause_id="urgent_is_big"),
        clause("!Big(o)", 0.3, clause_id="few_big"),
    ]
    merged = GR.merge_ground(GR.ground_network(rules, fb, q))
    return merged.select(F.col("lits")[0]["atom"].alias("atom"), "hard", F.round("weight", 6).alias("weight"))


@query(
    "propagation_chain",
    views("CustNation", "Placed", "Contains") + """, vip AS (SELECT a FROM CustNation WHERE b = 'N3'),
rush AS (SELECT DISTINCT p.b AS a FROM Placed p JOIN vip v ON p.a = v.a), scarce AS (SELECT DISTINCT c.b AS a FROM Contains c JOIN rush r ON c.a = r.a)
SELECT 'Vip(' || a || ')' AS atom, true AS value FROM vip UNION ALL SELECT 'Rush(' || a || ')', true FROM rush
UNION ALL SELECT 'Scarce(' || a || ')', true FROM scarce""",
)
def q_propagation_chain(spark, sf):
    """Hard rules carry a fixed atom from customers to their orders and on to the parts in them."""
    base = view_fact_base(spark, sf, ["CustNation", "Placed", "Contains"])
    schema = Schema.of(*base.schema, Predicate("Vip", ("customer",)), Predicate("Rush", ("order",)), Predicate("Scarce", ("part",)))
    fb = FactBase(schema, base.facts)
    q = union_all([
        fb.relation(rel).select("fold", F.lit(pred).alias("pred"), F.array(col).alias("args")).distinct()
        for rel, pred, col in (("CustNation", "Vip", "a0"), ("Placed", "Rush", "a1"), ("Contains", "Scarce", "a1"))
    ])
    rules = [
        clause('!CustNation(c,"N3") v Vip(c)', hard=True, clause_id="nation"),
        clause("!Placed(c,o) v !Vip(c) v Rush(o)", hard=True, clause_id="orders"),
        clause("!Contains(o,p) v !Rush(o) v Scarce(p)", hard=True, clause_id="parts"),
    ]
    _, fixed = I.propagate_units(GR.merge_ground(GR.ground_network(rules, fb, q)))
    return fixed.select("atom", "value")


@query(
    "network_components",
    ORDER_SQL + """SELECT 'Loyal(' || a || ')' AS atom, min('Big(' || b || ')') AS component FROM Placed GROUP BY a
UNION ALL SELECT 'Big(' || b || ')', min('Big(' || b || ')') OVER (PARTITION BY a) FROM Placed""",
)
def q_components(spark, sf):
    return I.components(GR.merge_ground(order_network(spark, sf))).select("atom", "component")


@query(
    "network_colouring",
    "SELECT (SELECT count(DISTINCT o_custkey) FROM orders) + (SELECT count(*) FROM orders) AS n_atoms, CAST(0 AS BIGINT) AS n_conflicts",
)
def q_colouring(spark, sf):
    g = I.numbered(GR.merge_ground(order_network(spark, sf)))
    c = stored(I.colour(g), "colouring")
    clash = (
        I.ground_literals(g).join(c, ["fold", "atom"]).groupBy("fold", "gid", "colour").agg(F.count(F.lit(1)).alias("k"))
        .agg(F.coalesce(F.sum((F.col("k") > 1).cast("bigint")), F.lit(0).cast("bigint")).alias("n_conflicts"))
    )
    return c.agg(F.count(F.lit(1)).alias("n_atoms")).join(F.broadcast(clash))


def order_state(network):
    """A fixed state to evaluate: everything true except Loyal of customers whose number is a multiple of 3."""
    atoms = I.atoms_of(GR.merge_ground(network))
    number = F.regexp_extract("atom", r"(\d+)", 1).cast("bigint")
    return atoms.withColumn("value", ~(F.col("atom").startswith("Loyal(") & (number % 3 == 0)))


@query(
    "state_counts_and_cost",
    ORDER_SQL + """, k AS (SELECT a, (CAST(substr(a, 2) AS BIGINT) % 3 = 0) AS off FROM (SELECT DISTINCT a FROM Placed))
SELECT CAST((SELECT count(*) FROM Placed p JOIN k ON k.a = p.a WHERE NOT off) + (SELECT count(*) FROM urgent WHERE a IN (SELECT b FROM Placed))
 + (SELECT count(*) FROM k WHERE NOT off) AS DOUBLE) AS n_true,
CAST((SELECT count(*) FROM Placed) + (SELECT count(*) FROM urgent WHERE a IN (SELECT b FROM Placed)) + (SELECT count(*) FROM k) AS DOUBLE) AS n_total,
round(CAST(0.3 AS DOUBLE) * (SELECT count(*) FROM k WHERE NOT off), 4) AS cost""",
)
def q_state_counts(spark, sf):
    net = order_network(spark, sf)
    g, state = GR.merge_ground(net), order_state(net)
    return I.state_counts(g, state).join(I.state_cost(g, state), "fold").select("n_true", "n_total", r6("cost", 4))


@query(
    "clause_report",
    ORDER_SQL + """, k AS (SELECT a, (CAST(substr(a, 2) AS BIGINT) % 3 = 0) AS off FROM (SELECT DISTINCT a FROM Placed))
SELECT 'big_means_loyal' AS clause_id, CAST((SELECT count(*) FROM Placed p JOIN k ON k.a = p.a WHERE NOT off) AS DOUBLE) AS n_true, CAST((SELECT count(*) FROM Placed) AS DOUBLE) AS n_total
UNION ALL SELECT 'urgent_is_big', CAST(count(*) AS DOUBLE), CAST(count(*) AS DOUBLE) FROM urgent WHERE a IN (SELECT b FROM Placed)
UNION ALL SELECT 'few_loyal', CAST(sum(CASE WHEN off THEN 1 ELSE 0 END) AS DOUBLE), CAST(count(*) AS DOUBLE) FROM k""",
)
def q_clause_report(spark, sf):
    net = order_network(spark, sf)
    return I.clause_report(net, order_state(net))


# Sampler diagnostics over boolean series kept in the line items: chain = line number, atom = supplier.
def flag_samples(spark, sf):
    return spark.read.parquet(f"{sf}/lineitem.parquet").select(
        F.lit(0).alias("fold"), F.col("l_linenumber").alias("chain"), F.col("l_orderkey").alias("step"),
        F.concat(F.lit("Returned(S"), F.col("l_suppkey").cast("string"), F.lit(")")).alias("atom"),
        (F.col("l_returnflag") == "R").alias("value"),
    )


CHAINS_SQL = """WITH c AS (SELECT l_suppkey AS s, l_linenumber AS chain, avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END) AS m,
var_samp(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END) AS v, count(*) AS n FROM lineitem GROUP BY 1, 2) """


@query("chain_variance_ratio", CHAINS_SQL + "SELECT 'Returned(S' || s || ')' AS atom, round(var_samp(m) * max(n) / avg(v), 6) AS ratio FROM c GROUP BY s")
def q_gelman(spark, sf):
    return I.gelman(flag_samples(spark, sf)).select("atom", r6("ratio"))


@query(
    "converged_fraction",
    CHAINS_SQL + """SELECT round(avg(CASE WHEN need <= 100 THEN 1.0 ELSE 0.0 END), 6) AS fraction FROM (
SELECT 1.6448536269514722 ** 2 * max(n) * var_samp(m) / ((0.5 * avg(m)) ** 2) / count(*) AS need FROM c GROUP BY s HAVING avg(m) > 0 AND count(*) > 1)""",
)
def q_converged(spark, sf):
    return I.converged_fraction(flag_samples(spark, sf), 0.5, 0.9, 100.0).select(r6("fraction"))


def quantity_samples(spark, sf):
    return spark.read.parquet(f"{sf}/lineitem.parquet").groupBy(
        F.col("l_linenumber").alias("chain"), (F.col("l_orderkey") % 100).alias("step"), F.col("l_returnflag").alias("clause_id")
    ).agg(F.sum("l_quantity").alias("n_true"))


MOMENT_SQL = "WITH p AS (SELECT l_linenumber AS chain, l_orderkey % 100 AS step, l_returnflag AS clause_id, sum(l_quantity) AS n_true FROM lineitem GROUP BY 1, 2, 3) "


@query("count_moments", MOMENT_SQL + "SELECT clause_id, round(avg(n_true), 4) AS mean_true, round(var_pop(n_true), 3) AS var_true FROM p GROUP BY clause_id")
def q_moments(spark, sf):
    return I.count_moments(quantity_samples(spark, sf)).select("clause_id", r6("mean_true", 4), r6("var_true", 3))


@query(
    "count_covariance_vector",
    MOMENT_SQL + """, d AS (SELECT chain, step, sum(n_true * CASE WHEN clause_id = 'R' THEN 0.5 ELSE 1.5 END) AS dot FROM p GROUP BY 1, 2)
SELECT clause_id, round(avg(n_true * dot) - avg(n_true) * avg(dot), 2) AS value FROM p JOIN d USING (chain, step) GROUP BY clause_id""",
)
def q_cov(spark, sf):
    v = small_table(spark, [("R", 0.5), ("A", 1.5), ("N", 1.5)], "clause_id string, v double")
    return I.count_cov_vector(quantity_samples(spark, sf), v).select("clause_id", r6("value", 2))


@query("tied_weights", "SELECT o_orderpriority AS formula_id, round(sum(c / 2.0), 4) AS value FROM (SELECT o_orderpriority, o_orderstatus, count(*) AS c FROM orders GROUP BY 1, 2) GROUP BY 1")
def q_tied(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    counts = orders.groupBy("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).cast("double").alias("value"))
    counts = counts.select(F.lit(0).alias("fold"), F.concat_ws("/", "o_orderpriority", "o_orderstatus").alias("clause_id"), "value")
    ties = counts.select(
        "fold", "clause_id", F.split("clause_id", "/")[0].alias("formula_id"), F.lit(2.0).alias("divisor")
    )
    return GR.tie_weights(counts, ties).select("formula_id", r6("value", 4))
