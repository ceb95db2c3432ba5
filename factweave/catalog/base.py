"""Queries over facts and groundings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.local import small_table
from . import dbl, n, query, views
from ..facts import FactBase, union_all
from ..operators import facts_ops as FO, grounding as GR
from ..plans.atom_counts import atom_counts
from ..plans.counting import clause_counts, conjunction_counts
from ..plans.storage import fresh_path
from ..rules import clause
from ..schema import Predicate, Schema
from ..sources import tables as T, text as TX
from ..sources.tables import view_fact_base

MAIN = ("CustNation", "SuppNation", "Supplies")

MAIN_RULES = {
    "same_nation": "!CustNation(c,n) v !SuppNation(s,n)",
    "supplier_follows_customer": "!SuppNation(s,n) v CustNation(c,n)",
    "supplies_everything": "Supplies(s,p) v !SuppNation(s,n)",
    "chain": "!Supplies(s,p) v !SuppNation(s,n) v CustNation(c,n)",
}


@query(
    "clause_counts",
    views(*MAIN)
    + f"""
, cn AS (SELECT b, count(*) AS k FROM CustNation GROUP BY b), sn AS (SELECT b, count(*) AS k FROM SuppNation GROUP BY b),
f1 AS (SELECT CAST(sum(cn.k * sn.k) AS DOUBLE) AS f FROM cn JOIN sn USING (b)),
tot AS (SELECT {n('customer')} * {n('supplier')} * {n('nation')} AS t),
f2 AS (SELECT CAST(count(*) AS DOUBLE) * {n('customer')} - (SELECT f FROM f1) AS f FROM SuppNation),
f3 AS (SELECT CAST(count(*) AS DOUBLE) * {n('part_')} - (SELECT count(*) FROM Supplies JOIN SuppNation ON Supplies.a = SuppNation.a) AS f FROM SuppNation),
j4 AS (SELECT SuppNation.b AS b, count(*) AS k FROM Supplies JOIN SuppNation ON Supplies.a = SuppNation.a GROUP BY SuppNation.b),
f4 AS (SELECT CAST(sum(j4.k) AS DOUBLE) * {n('customer')} - (SELECT sum(j4.k * cn.k) FROM j4 JOIN cn USING (b)) AS f FROM j4)
SELECT 'same_nation' AS clause_id, t - f AS n_true, f AS n_false, t AS n_total FROM tot, f1
UNION ALL SELECT 'supplier_follows_customer', t - f, f, t FROM tot, f2
UNION ALL SELECT 'supplies_everything', {n('supplier')} * {n('part_')} * {n('nation')} - f, f, {n('supplier')} * {n('part_')} * {n('nation')} FROM f3
UNION ALL SELECT 'chain', {n('supplier')} * {n('part_')} * {n('nation')} * {n('customer')} - f, f, {n('supplier')} * {n('part_')} * {n('nation')} * {n('customer')} FROM f4
""",
)
def q_clause_counts(spark, sf):
    fb = view_fact_base(spark, sf, list(MAIN))
    rules = [clause(t, clause_id=k) for k, t in MAIN_RULES.items()]
    return clause_counts(rules, fb).select("clause_id", *dbl("n_true", "n_false", "n_total"))


@query(
    "conjunction_counts",
    views("Placed", "Segment", "Priority")
    + """
, urgent AS (SELECT a FROM Priority WHERE b = '1-URGENT')
SELECT 'building_urgent' AS clause_id, CAST((SELECT count(*) FROM Placed JOIN Segment ON Placed.a = Segment.a AND Segment.b = 'BUILDING'
  JOIN urgent ON Placed.b = urgent.a) AS DOUBLE) AS n
UNION ALL SELECT 'building_not_urgent', CAST((SELECT count(*) FROM Placed JOIN Segment ON Placed.a = Segment.a AND Segment.b = 'BUILDING'
  WHERE Placed.b NOT IN (SELECT a FROM urgent)) AS DOUBLE)
""",
)
def q_conjunction_counts(spark, sf):
    fb = view_fact_base(spark, sf, ["Placed", "Segment", "Priority"])
    rules = [
        clause('Placed(c,o) v Segment(c,BUILDING) v Priority(o,"1-URGENT")', clause_id="building_urgent"),
        clause('Placed(c,o) v Segment(c,BUILDING) v !Priority(o,"1-URGENT")', clause_id="building_not_urgent"),
    ]
    return conjunction_counts(rules, fb).select("clause_id", *dbl("n"))


@query(
    "conjunctive_match",
    views("Placed", "Contains", "Brand")
    + """SELECT p.a AS c, p.b AS o, k.b AS p FROM Placed p JOIN Contains k ON p.b = k.a JOIN Brand b ON k.b = b.a
WHERE b.b = 'Brand#11' AND p.a NOT IN (SELECT a FROM Placed WHERE b = 'O1')""",
)
def q_match(spark, sf):
    fb = view_fact_base(spark, sf, ["Placed", "Contains", "Brand"])
    return GR.match(clause('Placed(c,o) v Contains(o,p) v Brand(p,"Brand#11") v !Placed(c,O1)'), fb).select("c", "o", "p")


@query(
    "equality_counts",
    views("Placed", "Priority")
    + f"""
, k AS (SELECT b, count(*) AS m FROM Priority GROUP BY b)
SELECT 'one_order_per_customer' AS clause_id, CAST((SELECT sum(m * m) - sum(m) FROM (SELECT count(*) AS m FROM Placed GROUP BY a)) AS DOUBLE) AS n_false,
 {n('customer')} * {n('orders_')} * {n('orders_')} AS n_total
UNION ALL SELECT 'no_shared_priority', CAST((SELECT sum(m * m) - sum(m) FROM k) AS DOUBLE), {n('orders_')} * {n('orders_')} * {n('priority')}
""",
)
def q_equality(spark, sf):
    fb = view_fact_base(spark, sf, ["Placed", "Priority"])
    rules = [
        clause("!Placed(c,x) v !Placed(c,y) v x = y", clause_id="one_order_per_customer"),
        clause("!Priority(x,p) v !Priority(y,p) v x = y", clause_id="no_shared_priority"),
    ]
    return clause_counts(rules, fb).select("clause_id", *dbl("n_false", "n_total"))


@query(
    "computed_predicate_counts",
    views("Contains", "Size")
    + f"""
, s AS (SELECT a, CAST(b AS BIGINT) AS v FROM Size)
SELECT 'large_parts' AS clause_id, CAST((SELECT count(*) FROM Contains k JOIN s ON k.b = s.a WHERE NOT (s.v > 25)) AS DOUBLE) AS n_false
UNION ALL SELECT 'next_size', CAST((SELECT count(*) FROM s JOIN d_number d ON CAST(d.c AS BIGINT) = s.v + 1) AS DOUBLE)
UNION ALL SELECT 'smaller_size', CAST((SELECT count(*) FROM s JOIN d_number d ON CAST(d.c AS BIGINT) < s.v) AS DOUBLE)
""",
)
def q_computed(spark, sf):
    fb = view_fact_base(spark, sf, ["Contains", "Size"])
    rules = [
        clause("!Contains(o,p) v !Size(p,m) v greaterThan(m,25)", clause_id="large_parts"),
        clause("!Size(p,m) v !succ(m,k)", clause_id="next_size"),
        clause("!Size(p,m) v !lessThan(k,m)", clause_id="smaller_size"),
    ]
    return clause_counts(rules, fb).select("clause_id", *dbl("n_false"))


def good_docs(spark, sf) -> FactBase:
    """Labels as an open-world predicate: Good(doc) true, false or unknown."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    parts = [
        T.facts_from_table(docs, "DocLang", ["doc_id", "lang"], ("D", "")),
        T.facts_from_table(docs, "DocSource", ["doc_id", "source"], ("D", "")),
        T.facts_from_table(labels.filter("quality = 1"), "Good", ["doc_id"], ("D",)),
        T.facts_from_table(labels.filter("quality = 0"), "Good", ["doc_id"], ("D",), truth="false"),
    ]
    schema = Schema.of(
        Predicate("DocLang", ("doc", "lang"), (1,)), Predicate("DocSource", ("doc", "source"), (1,)), Predicate("Good", ("doc",))
    )
    return FactBase(schema, union_all(parts), open_world=("Good",))


GOOD_SQL = """
WITH DocLang AS (SELECT DISTINCT 'D' || doc_id AS a, lang AS b FROM documents),
g AS (SELECT DISTINCT 'D' || doc_id AS a FROM labels WHERE quality = 1), f AS (SELECT DISTINCT 'D' || doc_id AS a FROM labels WHERE quality = 0),
docs AS (SELECT a FROM DocLang UNION SELECT a FROM g UNION SELECT a FROM f), nd AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM docs),
nl AS (SELECT CAST(count(DISTINCT b) AS DOUBLE) AS n FROM DocLang)
"""


@query(
    "open_world_counts",
    GOOD_SQL
    + """, tl AS (SELECT DocLang.a, DocLang.b, CASE WHEN g.a IS NOT NULL THEN 't' WHEN f.a IS NOT NULL THEN 'f' ELSE 'u' END AS v
  FROM DocLang LEFT JOIN g ON DocLang.a = g.a LEFT JOIN f ON DocLang.a = f.a)
SELECT 'all_good' AS clause_id, nd.n * nl.n - (SELECT count(*) FROM tl WHERE v <> 't') AS n_true,
 CAST((SELECT count(*) FROM tl WHERE v = 'f') AS DOUBLE) AS n_false, CAST((SELECT count(*) FROM tl WHERE v = 'u') AS DOUBLE) AS n_unknown, nd.n * nl.n AS n_total FROM nd, nl
UNION ALL SELECT 'none_good', nd.n * nl.n - (SELECT count(*) FROM tl WHERE v <> 'f'),
 CAST((SELECT count(*) FROM tl WHERE v = 't') AS DOUBLE), CAST((SELECT count(*) FROM tl WHERE v = 'u') AS DOUBLE), nd.n * nl.n FROM nd, nl
""",
)
def q_open_world(spark, sf):
    fb = good_docs(spark, sf)
    rules = [
        clause("!DocLang(d,l) v Good(d)", clause_id="all_good"),
        clause("!DocLang(d,l) v !Good(d)", clause_id="none_good"),
    ]
    return clause_counts(rules, fb).select("clause_id", *dbl("n_true", "n_false", "n_unknown", "n_total"))


@query(
    "truth_lookup",
    GOOD_SQL
    + """SELECT v AS truth, count(*) AS n FROM (SELECT d.a, CASE WHEN g.a IS NOT NULL THEN 'true' WHEN f.a IS NOT NULL THEN 'false' ELSE 'unknown' END AS v
FROM docs d LEFT JOIN g ON d.a = g.a LEFT JOIN f ON d.a = f.a) GROUP BY v""",
)
def q_truth(spark, sf):
    fb = good_docs(spark, sf)
    atoms = fb.constants_of("doc").withColumnRenamed("const", "a0")
    return FO.truth(atoms, fb, "Good").groupBy("truth").agg(F.count(F.lit(1)).alias("n"))


@query(
    "atom_totals",
    GOOD_SQL.replace("docs AS", "DocSource AS (SELECT DISTINCT 'D' || doc_id AS a, source AS b FROM documents), docs AS")
    + """, ns AS (SELECT CAST(count(DISTINCT b) AS DOUBLE) AS n FROM DocSource)
SELECT 'DocLang' AS pred, CAST((SELECT count(*) FROM DocLang) AS DOUBLE) AS n_true, nd.n * nl.n - (SELECT count(*) FROM DocLang) AS n_false, CAST(0 AS DOUBLE) AS n_unknown FROM nd, nl
UNION ALL SELECT 'DocSource', CAST((SELECT count(*) FROM DocSource) AS DOUBLE), nd.n * ns.n - (SELECT count(*) FROM DocSource), CAST(0 AS DOUBLE) FROM nd, ns
UNION ALL SELECT 'Good', CAST((SELECT count(*) FROM g) AS DOUBLE), CAST((SELECT count(*) FROM f WHERE a NOT IN (SELECT a FROM g)) AS DOUBLE),
 nd.n - (SELECT count(*) FROM g) - (SELECT count(*) FROM f WHERE a NOT IN (SELECT a FROM g)) FROM nd""",
)
def q_atom_totals(spark, sf):
    return FO.atom_totals(good_docs(spark, sf)).select("pred", *dbl("n_true", "n_false", "n_unknown"))


@query(
    "domain_sizes",
    views(*MAIN)
    + """SELECT 'customer' AS type, (SELECT count(*) FROM d_customer) AS n UNION ALL SELECT 'nation', (SELECT count(*) FROM d_nation)
UNION ALL SELECT 'part', (SELECT count(*) FROM d_part_) UNION ALL SELECT 'supplier', (SELECT count(*) FROM d_supplier)""",
)
def q_domains(spark, sf):
    return FO.domains(view_fact_base(spark, sf, list(MAIN))).select("type", "n")


@query(
    "possible_groundings",
    views(*MAIN)
    + f"""SELECT 'CustNation' AS pred, {n('customer')} * {n('nation')} AS n_possible UNION ALL SELECT 'SuppNation', {n('supplier')} * {n('nation')}
UNION ALL SELECT 'Supplies', {n('supplier')} * {n('part_')}""",
)
def q_possible(spark, sf):
    return FO.predicate_groundings(view_fact_base(spark, sf, list(MAIN))).select("pred", *dbl("n_possible"))


PROFILED = ("CustNation", "Placed", "Contains", "Supplies", "Segment", "Did", "HasWord")


@query(
    "fact_profile",
    views(*PROFILED)
    + " UNION ALL ".join(
        f"SELECT '{p}' AS pred, count(*) AS n_facts, count(DISTINCT a) AS n_distinct_0, count(DISTINCT b) AS n_distinct_1 FROM {p}"
        for p in PROFILED
    ),
)
def q_profile(spark, sf):
    return FO.profile(view_fact_base(spark, sf, list(PROFILED))).drop("fold")


@query(
    "duplicate_facts",
    """SELECT 'Supplies' AS pred, 'S' || l_suppkey AS a0, 'P' || l_partkey AS a1, count(*) AS n FROM lineitem GROUP BY l_suppkey, l_partkey HAVING count(*) > 1
UNION ALL SELECT 'Did', 'U' || user_id, event_type, count(*) FROM events GROUP BY user_id, event_type HAVING count(*) > 1""",
)
def q_duplicates(spark, sf):
    facts = view_fact_base(spark, sf, ["Supplies", "Did"]).facts
    _, report = FO.dedupe_facts(facts)
    return report.select("pred", F.col("args")[0].alias("a0"), F.col("args")[1].alias("a1"), "n")


@query(
    "clean_facts",
    """SELECT 'Isa' AS pred, 'C' || c_custkey AS a0, 'Segment' AS a1 FROM customer
UNION ALL SELECT 'Did', 'WordU' || user_id, upper(substr(event_type, 1, 1)) || lower(substr(event_type, 2)) FROM (SELECT DISTINCT user_id, event_type FROM events)
UNION ALL SELECT 'Docsource', 'D' || doc_id, lower(source) FROM documents""",
)
def q_clean(spark, sf):
    customers = spark.read.parquet(f"{sf}/customer.parquet")
    facts = (
        T.facts_from_table(customers, "segment", ["c_custkey"], ("C",))
        .unionByName(view_fact_base(spark, sf, ["Did", "DocSource", "Priority"]).facts)
    )
    rules = small_table(spark,
        [("segment", "rename_value", "Isa", None, None), ("Priority", "drop", None, None, None),
         ("Did", "prefix", None, "Word", None), ("DocSource", "quote", None, None, None)],
        "pred string, action string, new_pred string, prefix0 string, prefix1 string",
    )
    return FO.clean_facts(facts.distinct(), rules).select("pred", F.col("args")[0].alias("a0"), F.col("args")[1].alias("a1"))


@query(
    "split_target",
    """SELECT 'background' AS part, count(*) AS n FROM (SELECT DISTINCT 'DocLang', doc_id, lang FROM documents)
UNION ALL SELECT 'positive', count(DISTINCT doc_id) FROM labels WHERE quality = 1 UNION ALL SELECT 'negative', count(DISTINCT doc_id) FROM labels WHERE quality = 0""",
)
def q_split_target(spark, sf):
    facts = FO.keep_predicates(good_docs(spark, sf).facts, ["Doc_Lang", "Good"]).distinct()
    bg, pos, neg = FO.split_target(facts, "good")
    parts = [(bg, "background"), (pos, "positive"), (neg, "negative")]
    return union_all([d.select(F.lit(k).alias("part")) for d, k in parts]).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query(
    "constants_normalised",
    """SELECT upper(substr(b, 1, 1)) || lower(substr(b, 2)) AS object, count(*) AS n FROM (SELECT DISTINCT c_custkey AS a, c_mktsegment AS b FROM customer) GROUP BY 1""",
)
def q_normalised(spark, sf):
    facts = FO.normalise_constants(view_fact_base(spark, sf, ["Segment"]).facts).distinct()
    return facts.groupBy(F.col("args")[1].alias("object")).agg(F.count(F.lit(1)).alias("n"))


@query("relation_objects", "SELECT DISTINCT c_mktsegment AS object FROM customer")
def q_objects(spark, sf):
    return FO.objects(view_fact_base(spark, sf, ["Segment", "Placed"]).facts, "Segment")


@query(
    "fact_text_round_trip",
    """SELECT pred, truth, count(*) AS n, min(a0) AS first_a0, max(a1) AS last_a1 FROM (
SELECT 'DocSource' AS pred, 'true' AS truth, 'D' || doc_id AS a0, source AS a1 FROM documents
UNION ALL SELECT 'Segment', 'true', 'C' || c_custkey, c_mktsegment FROM customer
UNION ALL SELECT 'Good', 'true', 'D' || doc_id, NULL FROM labels WHERE quality = 1
UNION ALL SELECT 'Good', 'false', 'D' || doc_id, NULL FROM labels WHERE quality = 0) GROUP BY pred, truth""",
)
def q_text_round_trip(spark, sf):
    facts = FO.keep_predicates(good_docs(spark, sf).facts, ["Good", "DocSource"]).unionByName(
        view_fact_base(spark, sf, ["Segment"]).facts
    )
    path = fresh_path(spark, "facts")
    TX.write_facts(facts, path)
    back, _ = TX.read_facts(spark, path)
    return back.groupBy("pred", "truth").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.col("args")[0]).alias("first_a0"), F.max(F.get("args", F.lit(1))).alias("last_a1")
    )


@query(
    "rejected_lines",
    """SELECT 'wrong number of arguments' AS reason, count(*) AS n FROM customer UNION ALL SELECT 'undeclared predicate', count(*) FROM supplier UNION ALL SELECT 'not a fact', count(*) FROM part""",
)
def q_rejected(spark, sf):
    path = fresh_path(spark, "lines")
    lines = (
        spark.read.parquet(f"{sf}/customer.parquet").select(F.format_string("Segment(C%d)", "c_custkey").alias("value"))
        .unionByName(spark.read.parquet(f"{sf}/supplier.parquet").select(F.format_string("Unheard(S%d,x)", "s_suppkey").alias("value")))
        .unionByName(spark.read.parquet(f"{sf}/part.parquet").select(F.format_string("P%d is a part", "p_partkey").alias("value")))
    )
    lines.write.text(path)
    schema = Schema.of(Predicate("Segment", ("customer", "segment"))).to_df(spark)
    _, rejects = TX.read_facts(spark, path, schema)
    return rejects.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(
    "kfold_sizes",
    """WITH f AS (SELECT DISTINCT c_custkey AS a, c_nationkey AS b, c_custkey % 5 AS fold FROM customer)
SELECT k.fold AS fold, (SELECT count(*) FROM f WHERE f.fold <> k.fold) AS n_train, (SELECT count(*) FROM f WHERE f.fold = k.fold) AS n_test
FROM (SELECT DISTINCT fold FROM f) k""",
)
def q_kfold(spark, sf):
    facts = view_fact_base(spark, sf, ["CustNation"], folds=5).facts.distinct()
    rows = []
    for k in range(5):
        train, test = FO.kfold(facts, k)
        rows.append(train.select(F.lit(k).alias("fold"), F.lit(1).alias("t"), F.lit(0).alias("e")))
        rows.append(test.select(F.lit(k).alias("fold"), F.lit(0).alias("t"), F.lit(1).alias("e")))
    return union_all(rows).groupBy("fold").agg(F.sum("t").alias("n_train"), F.sum("e").alias("n_test"))


@query(
    "shuffled_folds",
    """WITH t AS (SELECT count(*) AS n FROM orders), s AS (SELECT n, CAST(ceil(n / 4.0) AS BIGINT) AS k FROM t)
SELECT CAST(i AS INTEGER) AS fold, CAST(least(k, n - i * k) AS BIGINT) AS n FROM s, range(4) r(i)""",
)
def q_shuffled(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey")
    return FO.split_folds(orders, ["o_orderkey"], 4, 7).groupBy("fold").agg(F.count(F.lit(1)).alias("n"))


@query(
    "mega_example_folds",
    """WITH b AS (SELECT count(*) AS n FROM (SELECT DISTINCT doc_id, lang FROM documents)), p AS (SELECT count(DISTINCT doc_id) AS n FROM labels WHERE quality = 1)
SELECT CAST(i AS INTEGER) AS fold, b.n AS n_background, CAST(least(ceil(p.n / 3.0), p.n - i * ceil(p.n / 3.0)) AS BIGINT) AS n_positive FROM b, p, range(3) r(i)""",
)
def q_mega(spark, sf):
    bg, pos, _ = FO.split_target(FO.keep_predicates(good_docs(spark, sf).facts, ["DocLang", "Good"]).distinct(), "Good")
    out = FO.mega_example_folds(bg, pos, 3, 5)
    return out.groupBy("fold").agg(
        F.sum((F.col("pred") == "DocLang").cast("int")).alias("n_background"),
        F.sum((F.col("pred") == "Good").cast("int")).alias("n_positive"),
    )


@query(
    "balanced_negatives",
    """SELECT least((SELECT count(DISTINCT doc_id) FROM labels WHERE quality = 1), (SELECT count(DISTINCT doc_id) FROM labels WHERE quality = 0)) AS n,
CAST(0 AS BIGINT) AS n_not_negative""",
)
def q_balanced(spark, sf):
    _, pos, neg = FO.split_target(good_docs(spark, sf).facts.distinct(), "Good")
    size = pos.count()
    kept = FO.balance_negatives(neg, ["args"], size, 11)
    return kept.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum((F.col("truth") != "false").cast("bigint")), F.lit(0).cast("bigint")).alias("n_not_negative")
    )


@query(
    "generated_negatives",
    "SELECT CAST(0 AS BIGINT) AS n_linked, CAST(0 AS BIGINT) AS n_unknown_object, CAST(0 AS BIGINT) AS n_too_many",
)
def q_generated(spark, sf):
    fb = view_fact_base(spark, sf, ["Did"])
    rel = fb.relation("Did")
    neg = FO.generate_negatives(rel, amount=2, seed=3)
    known = rel.select("fold", "a1").distinct().withColumn("known", F.lit(1))
    flagged = neg.join(rel.withColumn("linked", F.lit(1)), ["fold", "a0", "a1"], "left").join(known, ["fold", "a1"], "left")
    copies = rel.groupBy("a0").agg((2 * F.count(F.lit(1))).alias("allowed"))
    over = neg.groupBy("a0").agg(F.count(F.lit(1)).alias("n")).join(copies, "a0", "left").filter("allowed is null or n > allowed")
    zero = F.lit(0).cast("bigint")
    bad = flagged.agg(
        F.count("linked").alias("n_linked"),
        F.coalesce(F.sum(F.col("known").isNull().cast("bigint")), zero).alias("n_unknown_object"),
    )
    return bad.join(F.broadcast(over.agg(F.count(F.lit(1)).alias("n_too_many"))))


@query(
    "sampled_atoms",
    views("Supplies", "SuppNation")
    + f"""SELECT true AS truth, CAST(least(2000, count(*)) AS BIGINT) AS n, round(CAST(count(*) AS DOUBLE), 2) AS represented FROM Supplies
UNION ALL SELECT false, CAST(least(2000, {n('supplier')} * {n('part_')} - count(*)) AS BIGINT), round({n('supplier')} * {n('part_')} - count(*), 2) FROM Supplies""",
)
def q_sampled_atoms(spark, sf):
    fb = view_fact_base(spark, sf, ["Supplies", "SuppNation"])
    s = FO.sample_atoms(fb, "Supplies", 0.0, 2000, 2000, 13)
    return s.groupBy("truth").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("scale"), 2).alias("represented"))


@query(
    "wide_blocks",
    """WITH f AS (SELECT DISTINCT l_orderkey AS a, l_partkey AS b, l_suppkey AS m FROM lineitem),
k AS (SELECT a, b, count(*) AS n FROM f GROUP BY a, b)
SELECT CAST((SELECT count(DISTINCT a) FROM f) * (SELECT count(DISTINCT b) FROM f) AS DOUBLE) AS possible,
  CAST(count(*) FILTER (WHERE n = 1) AS BIGINT) AS one, CAST(count(*) FILTER (WHERE n > 1) AS BIGINT) AS more,
  CAST((SELECT count(DISTINCT a) FROM f) * (SELECT count(DISTINCT b) FROM f) - count(*) AS DOUBLE) AS none FROM k""",
)
def q_wide_blocks(spark, sf):
    """Blocks with two free arguments: the supplier of every order and part."""
    schema = Schema.of(Predicate("ShippedBy", ("order", "part", "supplier"), (), (2,)))
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    facts = T.facts_from_table(lines, "ShippedBy", ["l_orderkey", "l_partkey", "l_suppkey"], ("O", "P", "S"))
    return FO.block_totals(FactBase(schema, facts), "ShippedBy").select(*dbl("possible"), "one", "more", *dbl("none"))


@query(
    "broken_wide_blocks",
    """SELECT 'O' || l_orderkey AS a0, 'P' || l_partkey AS a1, count(DISTINCT l_suppkey) AS n_true FROM lineitem GROUP BY l_orderkey, l_partkey HAVING count(DISTINCT l_suppkey) > 1""",
)
def q_broken_wide_blocks(spark, sf):
    schema = Schema.of(Predicate("ShippedBy", ("order", "part", "supplier"), (), (2,)))
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    facts = T.facts_from_table(lines, "ShippedBy", ["l_orderkey", "l_partkey", "l_suppkey"], ("O", "P", "S"))
    return FO.check_blocks(FactBase(schema, facts), "ShippedBy").select("a0", "a1", "n_true")


@query(
    "exclusive_blocks",
    """SELECT (SELECT count(*) FROM (SELECT doc_id FROM documents UNION SELECT doc_id FROM labels)) AS n_blocks,
(SELECT count(*) FROM (SELECT doc_id FROM documents UNION SELECT doc_id FROM labels) d WHERE (SELECT count(DISTINCT quality) FROM labels l WHERE l.doc_id = d.doc_id) <> 1) AS n_broken""",
)
def q_blocks(spark, sf):
    fb = view_fact_base(spark, sf, ["DocLang", "Quality"])
    b = FO.blocks(fb, "Quality")
    return b.agg(F.count(F.lit(1)).alias("n_blocks"), F.sum((F.col("n_true") != 1).cast("bigint")).alias("n_broken"))


@query(
    "exists_literal",
    views("Placed", "Contains")
    + """SELECT 'some' AS kind, count(DISTINCT a) AS n FROM Placed
UNION ALL SELECT 'exactly_one', count(*) FROM (SELECT a FROM Placed GROUP BY a HAVING count(*) = 1)""",
)
def q_exists(spark, sf):
    fb = view_fact_base(spark, sf, ["Placed", "Contains"])
    some = GR.exists(fb, "Placed", (0,)).select(F.lit("some").alias("kind"))
    one = GR.exists(fb, "Placed", (0,), exactly_one=True).select(F.lit("exactly_one").alias("kind"))
    return some.unionByName(one).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(
    "existential_counts",
    views("Placed", "Segment", "Contains", "Brand", "Did")
    + f"""
, few AS (SELECT a FROM Did GROUP BY a HAVING count(*) < (SELECT count(*) FROM d_event_type)), c11 AS (SELECT DISTINCT k.a FROM Contains k JOIN Brand b ON b.a = k.b WHERE b.b = 'Brand#11'),
one AS (SELECT a FROM Placed GROUP BY a HAVING count(*) = 1), u AS (
SELECT 'builders_order' AS clause_id, CAST((SELECT count(*) FROM Segment WHERE b = 'BUILDING' AND a NOT IN (SELECT a FROM Placed)) AS DOUBLE) AS n_false, {n('customer')} AS n_total
UNION ALL SELECT 'orders_hold_brand_11', CAST((SELECT count(*) FROM Placed WHERE b NOT IN (SELECT a FROM c11)) AS DOUBLE), {n('customer')} * {n('orders_')}
UNION ALL SELECT 'customers_are_builders', CAST((SELECT count(DISTINCT a) FROM Placed WHERE a NOT IN (SELECT a FROM Segment WHERE b = 'BUILDING')) AS DOUBLE), {n('customer')}
UNION ALL SELECT 'one_order_only', CAST((SELECT count(*) FROM Segment WHERE b = 'BUILDING' AND a NOT IN (SELECT a FROM one)) AS DOUBLE), {n('customer')}
UNION ALL SELECT 'not_every_event', {n('user')} - CAST((SELECT count(*) FROM few) AS DOUBLE), {n('user')})
SELECT clause_id, n_total - n_false AS n_true, n_false, n_total FROM u
""",
)
def q_existential(spark, sf):
    fb = view_fact_base(spark, sf, ["Placed", "Segment", "Contains", "Brand", "Did"])
    rules = [
        clause("!Segment(c,BUILDING) v EXIST o Placed(c,o)", clause_id="builders_order"),
        clause('!Placed(c,o) v EXIST p (Contains(o,p) ^ Brand(p,"Brand#11"))', clause_id="orders_hold_brand_11"),
        clause("!EXIST o Placed(c,o) v Segment(c,BUILDING)", clause_id="customers_are_builders"),
        clause("!Segment(c,BUILDING) v EXIST! o Placed(c,o)", clause_id="one_order_only"),
        clause("EXIST e !Did(u,e)", clause_id="not_every_event"),
    ]
    return clause_counts(rules, fb).select("clause_id", *dbl("n_true", "n_false", "n_total"))


@query(
    "atom_count_differences",
    views("Supplies", "SuppNation", "CustNation")
    + """, k AS (SELECT b, count(*) AS m FROM CustNation GROUP BY b)
SELECT a.a AS a0, a.b AS a1, 'chain' AS clause_id, CAST(sum((SELECT count(*) FROM d_customer) - coalesce(k.m, 0)) AS DOUBLE) AS n
FROM Supplies a JOIN SuppNation s ON s.a = a.a LEFT JOIN k ON k.b = s.b GROUP BY a.a, a.b
HAVING sum((SELECT count(*) FROM d_customer) - coalesce(k.m, 0)) <> 0""",
)
def q_atom_counts(spark, sf):
    fb = view_fact_base(spark, sf, ["Supplies", "SuppNation", "CustNation"])
    ac = atom_counts([clause(MAIN_RULES["chain"], clause_id="chain")], "Supplies", fb)
    return ac.listed.select("a0", "a1", "clause_id", *dbl("n"))


@query(
    "absent_atom_count_differences",
    views("Placed", "Contains", "Brand", "Segment")
    + """SELECT o.a AS a0, count(*) AS n_atoms, CAST(sum(m) AS DOUBLE) AS n FROM (
 SELECT k.a AS a, b.b AS b, count(*) AS m FROM Contains k JOIN Brand b ON b.a = k.b GROUP BY k.a, b.b) o GROUP BY o.a""",
)
def q_absent_atom_counts(spark, sf):
    placed = view_fact_base(spark, sf, ["Placed", "Contains", "Brand", "Segment"])
    schema = Schema.of(*placed.schema, Predicate("Favours", ("order", "brand")))
    none = spark.read.parquet(f"{sf}/orders.parquet").filter("o_orderkey < 0")
    facts = placed.facts.unionByName(T.facts_from_table(none, "Favours", ["o_orderkey", "o_orderstatus"]))
    fb = FactBase(schema, facts)
    ac = atom_counts([clause("!Contains(o,p) v !Brand(p,b) v Favours(o,b)", clause_id="c")], "Favours", fb)
    return ac.joint.groupBy("a0").agg(F.count(F.lit(1)).alias("n_atoms"), F.sum("n").cast("double").alias("n"))
