"""Queries over generated rules, rule files, search and nested fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.local import small_table
from . import dbl, n, query, r6, views
from .learning import DOC_QUERY_SQL, DOC_RULES, NATIONS, SAME, doc_network
from .base import good_docs
from .scoring import PAIR_SQL, ranking
from ..facts import FactBase
from ..functions import literals as LT
from ..functions.computed import computed_column, register_predicate
from ..operators import conditional as CO, fields as FI, generate as G, grounding as GR, infer as I, search as SE
from ..plans.counting import clause_counts
from ..plans.storage import fresh_path
from ..rules import Clause, clause, collect_rules
from ..sources import text as TX
from ..sources.tables import view_fact_base


def _pair_false(first: str, pos1: bool, second: str, pos2: bool, shared: str) -> str:
    """SQL for the false groundings of two literals sharing one argument: sum over its values of f1 * f2."""
    other = {"a": "b", "b": "a"}[shared]
    dom = {"a": {"CustNation": "customer", "SuppNation": "supplier"}, "b": {"CustNation": "nation", "SuppNation": "nation"}}

    def factor(p, positive, alias):
        deg = f"coalesce({alias}.k, 0)"
        return f"({n(dom[other][p])} - {deg})" if positive else deg

    def degrees(p, alias):
        return f"(SELECT {shared} AS v, count(*) AS k FROM {p} GROUP BY {shared}) {alias}"

    return (
        f"(SELECT CAST(sum({factor(first, pos1, 'x')} * {factor(second, pos2, 'y')}) AS DOUBLE) FROM d_{dom[shared][first]} d "
        f"LEFT JOIN {degrees(first, 'x')} ON x.v = d.c LEFT JOIN {degrees(second, 'y')} ON y.v = d.c)"
    )


def _formula_rows() -> str:
    out = []
    for p in NATIONS:
        for shared, form in (("a", "{s1}{p}(x1,x2) v {s2}{p}(x1,x3)"), ("b", "{s1}{p}(x1,x2) v {s2}{p}(x3,x2)")):
            for pos1, pos2 in ((False, False), (False, True), (True, True)):
                if (p, shared, pos1, pos2) == ("SuppNation", "a", False, True):
                    continue
                text = form.format(p=p, s1="" if pos1 else "!", s2="" if pos2 else "!")
                out.append(f"SELECT '{text}' AS text, {_pair_false(p, pos1, p, pos2, shared)} AS n_false")
    # The renaming of the mixed-sign pair that is written first in canonical order.
    out.append(f"SELECT '!SuppNation(x1,x2) v SuppNation(x1,x3)' AS text, {_pair_false('SuppNation', False, 'SuppNation', True, 'a')} AS n_false")
    for first, pos1, second, pos2 in (
        ("CustNation", False, "SuppNation", False), ("CustNation", False, "SuppNation", True),
        ("SuppNation", False, "CustNation", True), ("CustNation", True, "SuppNation", True),
    ):
        text = f"{'' if pos1 else '!'}{first}(x1,x2) v {'' if pos2 else '!'}{second}(x3,x2)"
        out.append(f"SELECT '{text}' AS text, {_pair_false(first, pos1, second, pos2, 'b')} AS n_false")
    return " UNION ALL ".join(out)


@query("formula_support", views(*NATIONS) + _formula_rows())
def q_formulas(spark, sf):
    """Every two-literal formula of the schema, generated and counted."""
    fb = view_fact_base(spark, sf, list(NATIONS))
    formulas = G.instantiate(G.templates(spark, 2, 2), fb.schema)
    rules = collect_rules(formulas.select(F.col("text").alias("clause_id"), "literals"))
    return clause_counts(rules, fb).select(F.col("clause_id").alias("text"), *dbl("n_false"))


@query(
    "constant_rule_counts",
    views("Placed", "Segment")
    + f"""SELECT '!Placed(x1,x2) v Segment(x1,' || s.c || ')' AS instance,
CAST((SELECT count(*) FROM Placed p WHERE p.a NOT IN (SELECT a FROM Segment g WHERE g.b = s.c)) AS DOUBLE) AS n_false FROM d_segment s""",
)
def q_constant_rules(spark, sf):
    fb = view_fact_base(spark, sf, ["Placed", "Segment"])
    base = G.instantiate(G.templates(spark, 2, 2).filter("text = '!R1(T1,T2) v R2(T1,T3)'"), fb.schema)
    marked = G.with_constants(base.filter("text = '!Placed(x1,x2) v Segment(x1,x3)'"), fb.schema).filter("with_constants")
    rules = collect_rules(G.expand_constants(marked, fb).select(F.col("instance").alias("clause_id"), "literals"))
    return clause_counts(rules, fb).select(F.col("clause_id").alias("instance"), *dbl("n_false"))


@query(
    "rule_proportions",
    views(*NATIONS)
    + f"""SELECT 'SuppNation(s,n) v !CustNation(c,n)' AS clause_id, round(1 - {_pair_false('SuppNation', True, 'CustNation', False, 'b')} / ({n('customer')} * {n('supplier')} * {n('nation')}), 6) AS rate
UNION ALL SELECT 'SuppNation(s,n) v CustNation(c,n)', round(1 - {_pair_false('SuppNation', True, 'CustNation', True, 'b')} / ({n('customer')} * {n('supplier')} * {n('nation')}), 6)""",
)
def q_min_rate(spark, sf):
    fb = view_fact_base(spark, sf, list(NATIONS))
    rules = [clause("SuppNation(s,n) v !CustNation(c,n)"), clause("SuppNation(s,n) v CustNation(c,n)")]
    return G.min_true_rate(rules, fb, 0.0).select("clause_id", r6("rate"))


# ---- rule lists kept in tables: one rule per (brand, size) pair of the parts ----

PAIRS_SQL = "WITH r AS (SELECT DISTINCT p_brand, p_size FROM part) "


def brand_rules(spark, sf):
    pairs = spark.read.parquet(f"{sf}/part.parquet").select("p_brand", "p_size").distinct()
    text = F.format_string("!Is%s(x,y) v Size(x,\"%d\") v !Kind(z,y)", F.regexp_replace("p_brand", r"\W", ""), "p_size")
    return pairs.select(
        text.alias("clause_id"), text.alias("formula_id"), (F.col("p_size") / 10.0).alias("weight"),
        (F.col("p_size") == 50).alias("hard"), TX.rule_literals(text).alias("literals"),
    )


@query(
    "rule_file_round_trip",
    PAIRS_SQL + """SELECT count(*) AS n, CAST(count(*) FILTER (WHERE p_size = 50) AS BIGINT) AS n_hard, round(sum(CASE WHEN p_size = 50 THEN 0 ELSE p_size / 10.0 END), 3) AS weight,
count(*) AS n_definite FROM r""",
)
def q_rule_files(spark, sf):
    path = fresh_path(spark, "rules")
    TX.write_rules(brand_rules(spark, sf), path)
    back, _ = TX.read_rules(spark, path)
    return back.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("hard").cast("bigint")).alias("n_hard"), F.round(F.sum("weight"), 3).alias("weight"),
        F.sum(LT.is_definite(F.col("literals")).cast("bigint")).alias("n_definite"),
    )


@query(
    "rule_terms_round_trip",
    """WITH d AS (SELECT DISTINCT lang, source FROM documents)
SELECT 'DocLang' AS pred, false AS positive, 'const' AS kind, lang AS name, source AS of, (length(lang) + length(source)) / 7.0 AS weight FROM d
UNION ALL SELECT 'DocSource', true, 'const', source, lang, (length(lang) + length(source)) / 7.0 FROM d
UNION ALL SELECT 'DocLang', false, 'var', 'd', lang || source, (length(lang) + length(source)) / 7.0 FROM d
UNION ALL SELECT 'DocSource', true, 'var', 'd', lang || source, (length(lang) + length(source)) / 7.0 FROM d""",
)
def q_rule_terms(spark, sf):
    """Lower-case constants stay constants, and weights keep all digits, through a rule file."""
    pairs = spark.read.parquet(f"{sf}/documents.parquet").select("lang", "source").distinct()
    text = F.format_string('!DocLang(d,"%s") v DocSource(d,"%s")', "lang", "source")
    rules = pairs.select(
        text.alias("clause_id"), text.alias("formula_id"), ((F.length("lang") + F.length("source")) / F.lit(7.0)).alias("weight"),
        F.lit(False).alias("hard"), TX.rule_literals(text).alias("literals"),
    )
    path = fresh_path(spark, "rules")
    TX.write_rules(rules, path)
    back, _ = TX.read_rules(spark, path)
    lits = back.select("literals", "weight", F.col("literals")[0]["args"][1]["name"].alias("lang"), F.col("literals")[1]["args"][1]["name"].alias("source"))
    terms = lits.select("weight", "lang", "source", F.explode("literals").alias("l")).select("weight", "lang", "source", "l.pred", "l.positive", F.explode("l.args").alias("a"))
    other = F.when(F.col("a.kind") == "var", F.concat("lang", "source")).when(F.col("pred") == "DocLang", F.col("source")).otherwise(F.col("lang"))
    return terms.select("pred", "positive", "a.kind", "a.name", other.alias("of"), "weight")


@query(
    "rejected_rule_lines",
    """SELECT reason, count(*) AS n FROM (SELECT CASE CAST(o_orderkey % 4 AS INTEGER) WHEN 1 THEN 'neither a weight nor a full stop' ELSE 'not a rule' END AS reason
FROM orders WHERE o_orderkey % 4 IN (1, 2, 3)) GROUP BY 1""",
)
def q_rejected_rules(spark, sf):
    """A line for every order: well formed, without a weight, with an open bracket, or with an empty literal."""
    path = fresh_path(spark, "rules")
    k, kind = F.col("o_orderkey"), F.pmod("o_orderkey", F.lit(4))
    line = (
        F.when(kind == 0, F.format_string("1.5  Placed(C%d,O%d) v !Late(O%d)", k, k, k))
        .when(kind == 1, F.format_string("Placed(C%d,O%d) v Late(x)", k, k))
        .when(kind == 2, F.format_string("1.5  Placed(C%d,O%d v Late(x)", k, k))
        .otherwise(F.format_string("0.5  Placed(C%d,O%d) v ", k, k))
    )
    spark.read.parquet(f"{sf}/orders.parquet").select(line.alias("value")).write.text(path)
    return TX.read_rules(spark, path)[1].groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("listing_round_trip", "SELECT 'P' || p_partkey AS id, p_name AS text FROM part")
def q_listing(spark, sf):
    path = fresh_path(spark, "listing")
    part = spark.read.parquet(f"{sf}/part.parquet")
    TX.write_listing(part.select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("text")), path)
    return TX.read_listing(spark, path)


@query(
    "declaration_round_trip",
    """SELECT 'In' || replace(n_name, ' ', '_') AS pred, CASE WHEN i = 0 THEN 'customer' ELSE 'region' || n_regionkey END AS type, CAST(i AS INTEGER) AS arg_pos, i = 1 AS as_constant FROM nation, range(2) r(i)""",
)
def q_declarations(spark, sf):
    nation = spark.read.parquet(f"{sf}/nation.parquet")
    lines = nation.select(
        F.format_string("In%s(customer,+region%d)", F.translate("n_name", " ", "_"), "n_regionkey").alias("value")
    )
    path = fresh_path(spark, "declarations")
    lines.write.text(path)
    return TX.read_schema(spark, path).select("pred", "type", "arg_pos", "as_constant")


@query("declaration_markers", "SELECT 'In' || replace(n_name, ' ', '_') || '(customer,region' || n_regionkey || ')' AS value FROM nation")
def q_markers(spark, sf):
    nation = spark.read.parquet(f"{sf}/nation.parquet")
    lines = nation.select(
        F.format_string("In%s(customer,+region%d)", F.translate("n_name", " ", "_"), "n_regionkey").alias("value")
    )
    return TX.strip_markers(lines)


@query("rule_templates", PAIRS_SQL + "SELECT count(DISTINCT p_size) AS n_templates, count(*) AS n_rules FROM r")
def q_lift(spark, sf):
    lifted = G.lift(brand_rules(spark, sf))
    return lifted.agg(F.count(F.lit(1)).alias("n_templates"), F.sum("n_rules").alias("n_rules"))


@query("new_rules", PAIRS_SQL + "SELECT count(*) AS n FROM r WHERE p_size <= 25")
def q_new_only(spark, sf):
    rules = brand_rules(spark, sf)
    known = rules.filter("weight > 2.5")
    return G.new_only(rules, known).agg(F.count(F.lit(1)).alias("n"))


@query("relevant_rules", PAIRS_SQL + "SELECT count(*) AS n FROM r WHERE p_brand = 'Brand#11'")
def q_relevant(spark, sf):
    return G.relevant(brand_rules(spark, sf), ["IsBrand11"]).agg(F.count(F.lit(1)).alias("n"))


@query("sign_patterns", PAIRS_SQL + "SELECT 8 * count(*) AS n, 3 * count(*) AS n_definite FROM r")
def q_signs(spark, sf):
    signs = G.expand_signs(brand_rules(spark, sf))
    return signs.agg(
        F.count(F.lit(1)).alias("n"), F.sum(LT.is_definite(F.col("literals")).cast("bigint")).alias("n_definite")
    )


@query("split_formula_weights", PAIRS_SQL + "SELECT p_size, round(count(*) * (p_size / 10.0 / count(*)), 6) AS weight FROM r GROUP BY p_size")
def q_split_weights(spark, sf):
    rules = brand_rules(spark, sf).withColumn("formula_id", F.regexp_extract("clause_id", r'"(\d+)"', 1))
    split = TX.split_formula_weights(rules)
    return split.groupBy(F.col("formula_id").cast("int").alias("p_size")).agg(F.round(F.sum("weight"), 6).alias("weight"))


@query(
    "partial_grounding",
    views("Segment", "Placed") + "SELECT 'G(' || a || ')' AS bound, b AS segment FROM Segment WHERE b IN ('BUILDING', 'MACHINERY')",
)
def q_partial(spark, sf):
    from ..rules import rules_to_df

    fb = view_fact_base(spark, sf, ["Segment", "Placed"])
    rules = rules_to_df(spark, [clause("!Segment(c,BUILDING) v G(c)", clause_id="b"), clause("!Segment(c,MACHINERY) v G(c)", clause_id="m")])
    atoms = fb.relation("Segment").select("fold", F.lit("Segment").alias("pred"), F.array("a0", "a1").alias("args"))
    g = GR.partial_ground(rules, atoms)
    second = F.get("literals", F.lit(1))
    return g.select(LT.literal_text(second).alias("bound"), F.col("atom_args")[1].alias("segment"))


@query(
    "computed_predicate_table",
    views("Size", "Brand") + "SELECT x.c AS a0, y.c AS a1 FROM d_number x JOIN d_number y ON CAST(x.c AS BIGINT) > CAST(y.c AS BIGINT)",
)
def q_computed_table(spark, sf):
    fb = view_fact_base(spark, sf, ["Size", "Brand"])
    return GR.computed_predicate(fb, "greaterThan", ("number", "number"), partitions=8).select("a0", "a1")


@query(
    "clique_combinations",
    """WITH r AS (SELECT string_split(p_type, ' ')[1] AS t, count(*) AS k FROM part GROUP BY 1)
SELECT x.t || '+' || y.t AS templates, least(x.k, 3) + least(y.k, 3) AS n FROM r x JOIN r y ON x.t < y.t""",
)
def q_cliques(spark, sf):
    r = ranking(spark, sf).select("template_id", F.col("instance").alias("clause_id"), "score")
    return SE.clique_combinations(r, 2, 3).select(
        F.concat_ws("+", "templates").alias("templates"), F.size("clauses").cast("bigint").alias("n")
    )


@query(
    "computed_relations",
    """WITH t AS (SELECT CAST(p_partkey AS BIGINT) AS a, CAST(p_size AS BIGINT) AS b, p_brand AS s, split_part(p_type, ' ', 1) AS k, p_type AS ty FROM part)
SELECT 'P' || a AS part, a = b + 1 AS succ, a + b = a + 7 AS plus, a - b = a - 7 AS minus, a * b = a * 7 AS times, a // b = 3 AS divided_by, a % b = 2 AS mod,
contains(ty, k) AS substr, contains(s, k) AS substr_other, true AS concat, s || k = k || s AS concat_other, lower(k[1]) = 's' AS registered FROM t""",
)
def q_computed(spark, sf):
    """Every integer and text relation, and one that is registered here, on the columns of all parts."""
    register_predicate("beginsWith", lambda a, b: F.lower(F.substring(a, 1, 1)) == b)
    t = spark.read.parquet(f"{sf}/part.parquet").select(
        F.col("p_partkey").cast("string").alias("a"), F.col("p_size").cast("string").alias("b"), F.col("p_brand").alias("s"),
        F.split("p_type", " ")[0].alias("k"), F.col("p_type").alias("ty"),
    )
    a, b, s, k, ty = (F.col(c) for c in ("a", "b", "s", "k", "ty"))
    plus7, minus7 = (a.cast("bigint") + 7).cast("string"), (a.cast("bigint") - 7).cast("string")
    cc = computed_column
    return t.select(
        F.concat(F.lit("P"), a).alias("part"), cc("succ", b, a).alias("succ"), cc("plus", a, b, plus7).alias("plus"),
        cc("minus", a, b, minus7).alias("minus"), cc("times", a, b, (a.cast("bigint") * 7).cast("string")).alias("times"),
        cc("dividedBy", a, b, F.lit("3")).alias("divided_by"), cc("mod", a, b, F.lit("2")).alias("mod"),
        cc("substr", k, ty).alias("substr"), cc("substr", k, s).alias("substr_other"), cc("concat", s, k, F.concat(s, k)).alias("concat"),
        cc("concat", s, k, F.concat(k, s)).alias("concat_other"), cc("beginsWith", k, F.lit("s")).alias("registered"),
    )


@query(
    "long_rules_of_parts",
    "SELECT count(*) AS n FROM (SELECT DISTINCT p_brand, p_type, p_size FROM part)",
)
def q_long_rules(spark, sf):
    """A seven-literal rule for every brand, type and size, each written twice in different orders under different names."""
    types = spark.read.parquet(f"{sf}/part.parquet").select("p_brand", "p_type", F.col("p_size").cast("string").alias("size")).distinct()
    form = '!Is%s(x,y) v !Is%s(y,z) v !Is%s(z,w) v R(x,y) v R(y,z) v R(z,w) v !R(w,x)'
    other = '!R(d,a) v R(c,d) v R(b,c) v R(a,b) v !Is%3$s(c,d) v !Is%2$s(b,c) v !Is%1$s(a,b)'
    words = [F.regexp_replace("p_brand", r"\W", ""), F.regexp_replace("p_type", r"\W", ""), F.col("size")]
    texts = types.select(F.format_string(form, *words).alias("t")).unionByName(types.select(F.format_string(other, *words).alias("t")))
    return G.distinct_rules(texts.select(TX.rule_literals(F.col("t")).alias("literals"))).agg(F.count(F.col("text")).alias("n"))


# ---- search, conditional weights, completion ----


@query("greedy_theory")
def q_greedy(spark, sf):
    fb = view_fact_base(spark, sf, list(NATIONS))
    t = SE.greedy_by_gain([clause(SAME)], fb, penalty=0.0, min_weight=0.0, prior_std=2.0)
    return small_table(spark, [(c.clause_id, c.weight) for c in t.clauses], "clause_id string, weight double")


@query("pruned_theory")
def q_prune(spark, sf):
    fb = view_fact_base(spark, sf, list(NATIONS))
    from ..operators.learn import unit_theory

    t = SE.prune(unit_theory(fb) + [clause(SAME)], fb, penalty=10.0, prior_std=2.0)
    return small_table(spark, [(c.clause_id,) for c in t.clauses], "clause_id string")


@query("conditional_weights")
def q_conditional(spark, sf):
    fb = good_docs(spark, sf)
    docs = fb.constants_of("doc").select("fold", F.lit("Good").alias("pred"), F.array("const").alias("args"))
    w = CO.fit_conditional(DOC_RULES[2:], FactBase(fb.schema, fb.facts), docs, iterations=2, eta=1.0,
                           scale_by_counts=True, chains=4, burn=1, steps=2, prior_std=None)
    return small_table(spark, list(w.items()), "clause_id string, weight double")


@query(
    "imputed_atoms",
    DOC_QUERY_SQL + "SELECT a, CASE WHEN w > 0 THEN 'true' ELSE 'false' END AS truth FROM w WHERE w <> 0",
)
def q_impute(spark, sf):
    fb = good_docs(spark, sf)
    docs = fb.constants_of("doc").withColumnRenamed("const", "a0")
    labelled = fb.relation("Good").unionByName(fb.relation("Good", "false"))
    unknown = docs.join(labelled, ["fold", "a0"], "left_anti").select("fold", F.lit("Good").alias("pred"), F.array("a0").alias("args"))
    filled = CO.impute_unknown(DOC_RULES, FactBase(fb.schema, fb.facts), unknown)
    return filled.select(F.col("args")[0].alias("a"), "truth")


@query("exact_log_likelihood", DOC_QUERY_SQL + "SELECT round(sum(w) - sum(ln(1 + exp(w))), 4) AS log_likelihood FROM (SELECT CAST(w AS DOUBLE) AS w FROM w)")
def q_exact_ll(spark, sf):
    g = GR.merge_ground(doc_network(spark, sf))
    state = I.atoms_of(g).withColumn("value", F.lit(True))
    return I.exact_log_likelihood(g, state, max_atoms=4).select(r6("log_likelihood", 4))


# ---- nested fields ----

FIELD = FI.FieldFeature(
    "near", ((clause("CustNation(c,n)").literals[0], 0.5), (clause("SuppNation(s,n)").literals[0], -0.3)), 0.001
)


@query(
    "field_value",
    PAIR_SQL + "SELECT round(0.001 * sum(n * exp(CASE WHEN mask >= 2 THEN 0.5 ELSE 0 END + CASE WHEN mask % 2 = 1 THEN -0.3 ELSE 0 END)), 4) AS value FROM cells",
)
def q_field(spark, sf):
    fb = view_fact_base(spark, sf, list(NATIONS))
    return FI.field_value([FIELD], fb).select(r6("value", 4))


@query(
    "field_pseudo_likelihood",
    views(*NATIONS)
    + f""", k AS (SELECT b, count(*) AS m FROM SuppNation GROUP BY b),
d AS (SELECT 0.001 * (coalesce(k.m, 0) * (exp(-0.3) - exp(0.2)) + ({n('supplier')} - coalesce(k.m, 0)) * (1 - exp(0.5))) AS d FROM CustNation c LEFT JOIN k ON k.b = c.b)
SELECT round(avg(-ln(1 + exp(d))), 6) AS lpl FROM d""",
)
def q_field_lpl(spark, sf):
    fb = view_fact_base(spark, sf, list(NATIONS))
    return FI.field_lpl([FIELD], fb, "CustNation", fb.relation("CustNation")).select(r6("lpl"))
