"""Queries over rankings, pattern tables, significance, features and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.local import small_table
from . import dbl, n, query, r6, views
from ..facts import union_all
from ..operators import cliques as CL, evaluate as EV, features as FE, grounding as GR, ranking as RK
from ..operators import facts_ops as FO
from ..plans.patterns import pattern_counts, split_pattern_counts
from ..plans.storage import fresh_path
from ..rules import clause
from ..sources import nested as NS
from ..sources.tables import view_fact_base

# ---- rankings: parts as scored instances (type = template, brand = formula, large = constants) ----

RANKING_SQL = """WITH r AS (SELECT string_split(p_type, ' ')[1] AS template_id, p_size > 25 AS with_constants, p_brand AS formula_id,
'P' || p_partkey AS instance, p_retailprice / 1000.0 AS score FROM part),
f AS (SELECT template_id, with_constants, formula_id, avg(score) AS score FROM r GROUP BY 1, 2, 3),
t AS (SELECT template_id, with_constants, avg(score) AS score FROM f GROUP BY 1, 2) """


def ranking(spark, sf, value="p_retailprice / 1000.0"):
    return spark.read.parquet(f"{sf}/part.parquet").select(
        F.split("p_type", " ")[0].alias("template_id"), (F.col("p_size") > 25).alias("with_constants"),
        F.col("p_brand").alias("formula_id"), F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("instance"),
        F.expr(value).cast("double").alias("score"),
    )


@query("template_scores", RANKING_SQL + "SELECT template_id, with_constants, round(score, 6) AS score FROM t")
def q_template_scores(spark, sf):
    return RK.score_templates(ranking(spark, sf)).select("template_id", "with_constants", r6("score"))


@query("formula_scores", RANKING_SQL + "SELECT template_id, with_constants, formula_id, round(score, 6) AS score FROM f")
def q_formula_scores(spark, sf):
    return RK.score_formulas(ranking(spark, sf)).select("template_id", "with_constants", "formula_id", r6("score"))


@query(
    "normalised_scores",
    RANKING_SQL + "SELECT instance, round((score - (SELECT min(score) FROM r)) / ((SELECT max(score) FROM r) - (SELECT min(score) FROM r)), 6) AS score FROM r",
)
def q_normalised(spark, sf):
    return RK.normalise_scores(ranking(spark, sf)).select("instance", r6("score"))


@query(
    "merged_ranking",
    RANKING_SQL + """, sf AS (SELECT string_split(p_type, ' ')[1] AS template_id, p_size > 25 AS with_constants, p_brand AS formula_id, avg(p_size / 50.0) AS score FROM part
WHERE NOT starts_with(p_type, 'SMALL') GROUP BY 1, 2, 3), st AS (SELECT template_id, with_constants, avg(score) AS s FROM sf GROUP BY 1, 2)
SELECT r.instance AS instance, round(CASE WHEN s IS NULL THEN score ELSE score * s END, 6) AS multiplied, round(CASE WHEN s IS NULL THEN score ELSE greatest(score, s) END, 6) AS maximum,
round(CASE WHEN s IS NULL THEN score ELSE (score + s) / 2 END, 6) AS averaged FROM r LEFT JOIN st USING (template_id, with_constants)""",
)
def q_merged(spark, sf):
    target = ranking(spark, sf)
    source = ranking(spark, sf, "p_size / 50.0").join(
        spark.read.parquet(f"{sf}/part.parquet").filter(~F.startswith("p_type", F.lit("SMALL"))).select(
            F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("instance")), "instance", "left_semi")
    out = None
    for op, name in (("multiply", "multiplied"), ("maximum", "maximum"), ("average", "averaged")):
        one = RK.merge_rankings(target, source, op).select("instance", F.round("score", 6).alias(name))
        out = one if out is None else out.join(one, "instance")
    return out


@query(
    "ranked_formulas",
    RANKING_SQL + """SELECT template_id, with_constants, formula_id, row_number() OVER (ORDER BY score DESC, template_id, with_constants, formula_id) AS rank
FROM f WHERE with_constants""",
)
def q_ranked(spark, sf):
    out = RK.ranked_formulas(ranking(spark, sf), "constants")
    return out.select("template_id", "with_constants", "formula_id", "rank")


@query(
    "ranking_report",
    RANKING_SQL + """SELECT 'template' AS level, count(*) AS n FROM t UNION ALL SELECT 'formula', count(*) FROM f UNION ALL SELECT 'instance', count(*) FROM r""",
)
def q_report(spark, sf):
    path = fresh_path(spark, "report")
    RK.write_ranking_report(ranking(spark, sf), path)
    return spark.read.text(path).groupBy(F.split("value", "\t")[0].alias("level")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "candidate_beam",
    """SELECT 'P' || p_partkey AS clause_id FROM part WHERE p_retailprice / 1000.0 > 0.1 AND abs(p_size - 25) >= 5 ORDER BY p_retailprice DESC, clause_id LIMIT 10""",
)
def q_beam(spark, sf):
    cands = spark.read.parquet(f"{sf}/part.parquet").select(
        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("clause_id"),
        (F.col("p_retailprice") / 1000.0).alias("gain"), (F.col("p_size") - 25.0).alias("weight"),
    )
    return RK.beam(cands, 10, 0.1, 5.0).select("clause_id")


@query("last_models", "SELECT p_brand AS run, max(p_partkey) AS number, 'P' || max(p_partkey) AS model FROM part GROUP BY p_brand")
def q_last_model(spark, sf):
    models = spark.read.parquet(f"{sf}/part.parquet").select(
        F.col("p_brand").alias("run"), F.col("p_partkey").alias("number"), F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("model")
    )
    return RK.last_model(models)


@query(
    "score_log_round_trip",
    """SELECT CAST(p_size AS VARCHAR) AS template_id, CAST(hash_.k AS VARCHAR) AS formula_id, hash_.k = 1 AS with_constants, count(*) AS n, round(sum(p_retailprice), 2) AS score
FROM (SELECT p_size, p_partkey % 2 AS k, p_retailprice FROM part) hash_ GROUP BY 1, 2, 3""",
)
def q_logs(spark, sf):
    parts = spark.read.parquet(f"{sf}/part.parquet")
    k = F.col("p_partkey") % 2
    name = F.concat(F.lit("temp-"), F.col("p_size").cast("string"), F.lit("-form-"), k.cast("string"),
                    F.when(k == 1, "-constant").otherwise(""), F.lit("-output.log"))
    gain = F.format_string("%.4f \t P(a1,%s)", "p_retailprice", F.concat(F.lit("P"), F.col("p_partkey").cast("string")))
    log = F.concat(F.lit("reading\nevaluating gain of candidates...\n"), gain, F.lit("\nevaluating gain of candidates took 1 secs\n"))
    path = fresh_path(spark, "logs")
    # One small log per candidate: a file may hold several runs one after another.
    parts.select(name.alias("log"), log.alias("value")).write.partitionBy("log").option("lineSep", "\n").text(path)
    lines = NS.score_lines(spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file")))
    return lines.groupBy("template_id", "formula_id", "with_constants").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("score"), 2).alias("score")
    )


# ---- pattern tables and dependence scores ----

PAIR = "CustNation(c,n) v SuppNation(s,n)"
PAIR_SQL = (
    views("CustNation", "SuppNation")
    + f"""
, cn AS (SELECT b, CAST(count(*) AS DOUBLE) AS k FROM CustNation GROUP BY b), sn AS (SELECT b, CAST(count(*) AS DOUBLE) AS k FROM SuppNation GROUP BY b),
v AS (SELECT (SELECT sum(cn.k * sn.k) FROM cn JOIN sn USING (b)) AS both_, (SELECT sum(k) FROM cn) AS a, (SELECT sum(k) FROM sn) AS b,
 {n('customer')} AS dc, {n('supplier')} AS ds, {n('nation')} AS dn),
cells AS (SELECT 3 AS mask, both_ AS n FROM v UNION ALL SELECT 2, a * ds - both_ FROM v UNION ALL SELECT 1, b * dc - both_ FROM v
 UNION ALL SELECT 0, dc * ds * dn - a * ds - b * dc + both_ FROM v) """
)


@query("pattern_counts", PAIR_SQL + "SELECT mask, n + 1 AS n FROM cells")
def q_patterns(spark, sf):
    fb = view_fact_base(spark, sf, ["CustNation", "SuppNation"])
    return pattern_counts([clause(PAIR)], fb, distinct=True, start=1).select("mask", *dbl("n"))


@query(
    "distinct_pattern_counts",
    views("Placed", "Segment")
    + f"""
, pc AS (SELECT a, CAST(count(*) AS DOUBLE) AS k FROM Placed GROUP BY a), v AS (SELECT (SELECT sum(k * (k - 1)) FROM pc) AS both_, (SELECT sum(k) FROM pc) AS one, {n('customer')} AS dc, {n('orders_')} AS d)
SELECT 3 AS mask, both_ AS n FROM v UNION ALL SELECT 2, one * (d - 1) - both_ FROM v UNION ALL SELECT 1, one * (d - 1) - both_ FROM v
UNION ALL SELECT 0, dc * d * (d - 1) - 2 * one * (d - 1) + both_ FROM v""",
)
def q_distinct_patterns(spark, sf):
    fb = view_fact_base(spark, sf, ["Placed", "Segment"])
    return pattern_counts([clause("Placed(c,o) v Placed(c,p)")], fb, distinct=True).select("mask", *dbl("n"))


@query(
    "split_pattern_counts",
    PAIR_SQL + """SELECT 1 AS part, 1 AS mask, a AS n FROM v UNION ALL SELECT 1, 0, dc * dn - a FROM v UNION ALL SELECT 2, 1, b FROM v UNION ALL SELECT 2, 0, ds * dn - b FROM v""",
)
def q_split_patterns(spark, sf):
    fb = view_fact_base(spark, sf, ["CustNation", "SuppNation"])
    return split_pattern_counts([clause(PAIR)], fb).select("part", "mask", *dbl("n"))


@query(
    "decomposition_score",
    PAIR_SQL + """, p AS (SELECT mask, (n + 1) / (SELECT sum(n + 1) FROM cells) AS p FROM cells), q AS (SELECT (a + 1) / (dc * dn + 2) AS q1, (b + 1) / (ds * dn + 2) AS q2 FROM v)
SELECT round(sum(p * ln(p / ((CASE WHEN mask >= 2 THEN q1 ELSE 1 - q1 END) * (CASE WHEN mask % 2 = 1 THEN q2 ELSE 1 - q2 END)))), 8) AS score FROM p, q""",
)
def q_decomposition(spark, sf):
    fb = view_fact_base(spark, sf, ["CustNation", "SuppNation"])
    return CL.kl_decomposition([clause(PAIR)], fb)[1].select(r6("score", 8))


@query(
    "plain_decomposition_score",
    PAIR_SQL + """, p AS (SELECT mask, (n + 1) / (SELECT sum(n + 1) FROM cells) AS p FROM cells), q AS (SELECT (a + 1) / (dc * dn + 2) AS q1, (b + 1) / (ds * dn + 2) AS q2 FROM v)
SELECT round(sum(p * ln(p / ((CASE WHEN mask >= 2 THEN q1 ELSE 1 - q1 END) * (CASE WHEN mask % 2 = 1 THEN q2 ELSE 1 - q2 END)))), 8) AS score FROM p, q""",
)
def q_plain_decomposition(spark, sf):
    fb = view_fact_base(spark, sf, ["CustNation", "SuppNation"])
    return CL.decomposition_score([clause(PAIR)], fb, "plain")[1].select(r6("score", 8))


INDEPENDENCE_SQL = PAIR_SQL + """, m AS (SELECT mask, n + 0.25 AS n FROM cells), r AS (SELECT a / (dc * dn) AS ra, b / (ds * dn) AS rb FROM v),
i AS (SELECT mask, m.n AS n, n / (SELECT sum(n) FROM m) AS p, (CASE WHEN mask >= 2 THEN ra ELSE 1 - ra END) * (CASE WHEN mask % 2 = 1 THEN rb ELSE 1 - rb END) AS q FROM m, r) """


@query("independence_features", INDEPENDENCE_SQL + "SELECT mask, round((n * ln(p) - n * ln(q)) / (SELECT sum(n) FROM m), 8) AS contribution FROM i")
def q_independence_features(spark, sf):
    fb = view_fact_base(spark, sf, ["CustNation", "SuppNation"])
    return CL.independence_features([clause(PAIR)], fb).select("mask", r6("contribution", 8))


@query("independence_ratio", INDEPENDENCE_SQL + "SELECT round((sum(n * ln(p)) - sum(n * ln(q))) / sum(n), 8) AS llr_per_grounding FROM i")
def q_independence(spark, sf):
    fb = view_fact_base(spark, sf, ["CustNation", "SuppNation"])
    return CL.independence_llr([clause(PAIR)], fb).select(r6("llr_per_grounding", 8))


@query("pattern_rates", PAIR_SQL + "SELECT mask, round(n / (SELECT sum(n) FROM cells), 10) AS rate FROM cells")
def q_pattern_rates(spark, sf):
    fb = view_fact_base(spark, sf, ["CustNation", "SuppNation"])
    return CL.pattern_rates([clause(PAIR)], fb).select("mask", r6("rate", 10))


@query(
    "split_significance",
    PAIR_SQL + """, s AS (SELECT dc * ds * dn AS n, 1 - (SELECT n FROM cells WHERE mask = 0) / (dc * ds * dn) AS rate, 1 - (1 - a / (dc * dn)) * (1 - b / (ds * dn)) AS p0 FROM v)
SELECT round(rate, 8) AS rate, round(p0, 8) AS expected, round(sqrt(n) * abs(rate - p0) / sqrt(p0 * (1 - p0)), 4) AS z,
round(rate * ln(rate / p0) + (1 - rate) * ln((1 - rate) / (1 - p0)), 10) AS kl FROM s""",
)
def q_significance(spark, sf):
    fb = view_fact_base(spark, sf, ["CustNation", "SuppNation"])
    return CL.split_significance([clause(PAIR)], fb).select(r6("rate", 8), r6("expected", 8), r6("z", 4), r6("kl", 10))


@query(
    "counts_by_binding",
    views("Placed", "Priority", "Segment")
    + """, j AS (SELECT p.a AS c, p.b AS o, q.b AS r FROM Placed p JOIN Priority q ON q.a = p.b)
SELECT '' AS vars, '' AS binding, CAST(count(*) AS DOUBLE) AS n FROM j UNION ALL SELECT 'c', c, CAST(count(*) AS DOUBLE) FROM j GROUP BY c
UNION ALL SELECT 'o', o, CAST(count(*) AS DOUBLE) FROM j GROUP BY o UNION ALL SELECT 'r', r, CAST(count(*) AS DOUBLE) FROM j GROUP BY r
UNION ALL SELECT 'c,o', c || ',' || o, CAST(count(*) AS DOUBLE) FROM j GROUP BY c, o UNION ALL SELECT 'c,r', c || ',' || r, CAST(count(*) AS DOUBLE) FROM j GROUP BY c, r
UNION ALL SELECT 'o,r', o || ',' || r, CAST(count(*) AS DOUBLE) FROM j GROUP BY o, r UNION ALL SELECT 'c,o,r', c || ',' || o || ',' || r, CAST(count(*) AS DOUBLE) FROM j GROUP BY c, o, r""",
)
def q_count_by(spark, sf):
    fb = view_fact_base(spark, sf, ["Placed", "Priority", "Segment"])
    out = CL.count_by(clause("Placed(c,o) v Priority(o,r)"), fb)
    return out.select(F.concat_ws(",", "vars").alias("vars"), F.concat_ws(",", "binding").alias("binding"), *dbl("n"))


@query("union_estimate", "SELECT true AS within_tolerance")
def q_estimate(spark, sf):
    from ..plans.counting import clause_counts

    fb = view_fact_base(spark, sf, ["Placed", "Priority", "Segment"])
    c = clause("Placed(c,o) v Priority(o,r)")
    exact = clause_counts([c], fb).select("fold", F.col("n_true").cast("double").alias("t"))
    est = CL.estimate_true(c, fb, eps=0.1, delta=0.05, seed=2)
    return est.join(exact, "fold").select((F.abs(F.col("estimate") / F.col("t") - 1) <= 0.1).alias("within_tolerance"))


# ---- features ----


@query(
    "neighbour_counts",
    views("Placed", "Priority")
    + """, dc AS (SELECT a, count(*) AS k FROM Placed GROUP BY a), dp AS (SELECT b, count(*) AS k FROM Priority GROUP BY b)
SELECT 'Placed' AS pred, p.a AS a0, p.b AS a1, dc.k + (SELECT count(*) FROM Priority q WHERE q.a = p.b) - 1 AS n FROM Placed p JOIN dc ON dc.a = p.a
UNION ALL SELECT 'Priority', q.a, q.b, dp.k + (SELECT count(*) FROM Placed p WHERE p.b = q.a) - 1 FROM Priority q JOIN dp ON dp.b = q.b""",
)
def q_neighbours(spark, sf):
    fb = view_fact_base(spark, sf, ["Placed", "Priority"])
    return GR.neighbour_counts(fb).select("pred", F.col("args")[0].alias("a0"), F.col("args")[1].alias("a1"), "n")


FEATURE_PREDS = ("Placed", "Priority", "Segment")


@query(
    "feature_shapes",
    views(*FEATURE_PREDS)
    + """, dc AS (SELECT a, count(*) AS k FROM Placed GROUP BY a)
SELECT 'Placed(t0,f0)' AS feature, count(*) AS n FROM Placed p JOIN dc ON dc.a = p.a WHERE dc.k > 1
UNION ALL SELECT 'Priority(t1,f0)', count(*) FROM Placed p WHERE p.b IN (SELECT a FROM Priority) UNION ALL SELECT 'Segment(t0,f0)', count(*) FROM Placed p WHERE p.a IN (SELECT a FROM Segment)""",
)
def q_shapes(spark, sf):
    fb = view_fact_base(spark, sf, list(FEATURE_PREDS))
    shapes = FE.feature_shapes(fb.schema, "Placed", max_facts=1, max_free=1)
    return FE.shape_counts(FE.feature_table(fb, "Placed", shapes))


@query(
    "two_fact_shapes",
    views(*FEATURE_PREDS)
    + """, o AS (SELECT p.a AS c, p.b AS o, (SELECT max(b) FROM Priority q WHERE q.a = p.b) AS r FROM Placed p), k AS (SELECT c, r, count(*) AS k FROM o GROUP BY c, r)
SELECT 'Placed(t0,f0) Priority(f0,f1)' AS feature, count(*) AS n FROM Placed p WHERE (SELECT count(*) FROM Placed x JOIN Priority q ON q.a = x.b WHERE x.a = p.a AND x.b <> p.b) > 0
UNION ALL SELECT 'Priority(t1,f0) Priority(f1,f0)', count(*) FROM Placed p JOIN Priority q ON q.a = p.b JOIN (SELECT b, count(*) AS k FROM Priority GROUP BY b) z ON z.b = q.b WHERE z.k > 1""",
)
def q_two_shapes(spark, sf):
    fb = view_fact_base(spark, sf, list(FEATURE_PREDS))
    shapes = FE.feature_shapes(fb.schema, "Placed", max_facts=2, max_free=2)
    wanted = ("Placed(t0,f0) Priority(f0,f1)", "Priority(t1,f0) Priority(f1,f0)")
    return FE.shape_counts(FE.feature_table(fb, "Placed", {k: shapes[k] for k in wanted}))


def doc_features(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").join(
        spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    return docs.select(
        F.lit(0).alias("fold"), "doc_id",
        F.array_compact(F.array(
            F.when(F.col("lang") == "en", F.lit("english")), F.when(F.col("n_chars") > 1000, F.lit("long")),
            F.when(F.col("quality") == 1, F.lit("good")), F.when(F.col("toxic") == 1, F.lit("toxic")))).alias("features"),
    )


DOC_FEATURES_SQL = """WITH d AS (SELECT coalesce(lang = 'en', false) AS english, n_chars > 1000 AS long_, quality = 1 AS good, toxic = 1 AS toxic FROM documents JOIN labels USING (doc_id)) """


@query(
    "contingency_tables",
    DOC_FEATURES_SQL + """SELECT 0 AS test, '' AS stratum, sum(CAST(english AND good AS INT)) AS n11, sum(CAST(english AND NOT good AS INT)) AS n10, sum(CAST(NOT english AND good AS INT)) AS n01, sum(CAST(NOT english AND NOT good AS INT)) AS n00 FROM d
UNION ALL SELECT 1, CASE WHEN long_ THEN '1' ELSE '0' END, sum(CAST(toxic AND good AS INT)), sum(CAST(toxic AND NOT good AS INT)), sum(CAST(NOT toxic AND good AS INT)), sum(CAST(NOT toxic AND NOT good AS INT)) FROM d GROUP BY long_""",
)
def q_contingency(spark, sf):
    return FE.contingency(doc_features(spark, sf), [("english", "good", ()), ("toxic", "good", ("long",))])


@query(
    "chi_square_levels",
    DOC_FEATURES_SQL + """, c AS (SELECT CAST(sum(CAST(english AND good AS INT)) AS DOUBLE) AS a, CAST(sum(CAST(english AND NOT good AS INT)) AS DOUBLE) AS b, CAST(sum(CAST(NOT english AND good AS INT)) AS DOUBLE) AS c, CAST(sum(CAST(NOT english AND NOT good AS INT)) AS DOUBLE) AS d FROM d),
e AS (SELECT *, ((a+b)*(a+c)+1.5)/(a+b+c+d+3) AS ea, ((a+b)*(b+d)+1.5)/(a+b+c+d+3) AS eb, ((c+d)*(a+c)+1.5)/(a+b+c+d+3) AS ec, ((c+d)*(b+d)+1.5)/(a+b+c+d+3) AS ed FROM c),
x AS (SELECT (ea-a)*(ea-a)/ea + (eb-b)*(eb-b)/eb + (ec-c)*(ec-c)/ec + (ed-d)*(ed-d)/ed AS chi2 FROM e)
SELECT round(chi2, 6) AS chi2, CAST(CASE WHEN chi2 >= 7.882 THEN 0.005 WHEN chi2 >= 6.637 THEN 0.01 WHEN chi2 >= 5.025 THEN 0.025 WHEN chi2 >= 3.843 THEN 0.05 WHEN chi2 >= 2.706 THEN 0.1 WHEN chi2 >= 1.323 THEN 0.25
WHEN chi2 >= 0.455 THEN 0.5 WHEN chi2 >= 0.102 THEN 0.7 WHEN chi2 >= 0.016 THEN 0.9 WHEN chi2 >= 0.004 THEN 0.95 ELSE 0.975 END AS DOUBLE) AS alpha FROM x""",
)
def q_chi2(spark, sf):
    return FE.chi2_alpha(doc_features(spark, sf), [("english", "good", ())]).select(r6("chi2"), "alpha")


@query("markov_blankets")
def q_blankets(spark, sf):
    t = doc_features(spark, sf).persist()
    mb = FE.markov_blanket(t, ["english", "long", "good", "toxic"])
    return small_table(spark, [(f, sorted(b)) for f, b in mb.items()], "feature string, blanket array<string>")


# ---- evaluation: document length as a score for label quality ----

PREDICTIONS_SQL = """WITH d AS (SELECT DISTINCT doc_id, (n_chars % 1001) / 1000.0 AS p FROM documents), l AS (SELECT DISTINCT doc_id, quality FROM labels),
p AS (SELECT d.doc_id AS doc_id, CAST(p AS DOUBLE) AS p, CASE WHEN quality = 1 THEN 1 ELSE 0 END AS y FROM d JOIN l USING (doc_id)) """


def predictions(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    atom = F.concat(F.lit("Good(D"), F.col("doc_id").cast("string"), F.lit(")")).alias("atom")
    m = docs.select(atom, ((F.col("n_chars") % 1001) / 1000.0).cast("double").alias("p")).distinct()
    return EV.label_predictions(m, labels.filter("quality = 1").select(atom), labels.filter("quality = 0").select(atom))


@query("labelled_predictions", PREDICTIONS_SQL + "SELECT y, count(*) AS n, round(sum(p), 4) AS total FROM p GROUP BY y")
def q_labelled(spark, sf):
    return predictions(spark, sf).groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("p"), 4).alias("total"))


@query(
    "unlisted_negatives",
    "SELECT CAST(count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)) AS BIGINT) AS n_pos, CAST(count(*) FILTER (WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)) AS BIGINT) AS n_neg FROM documents",
)
def q_unlisted(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").cast("string").alias("atom"), F.lit(0.5).alias("p"))
    pos = spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 1").select(F.col("doc_id").cast("string").alias("atom"))
    return EV.label_predictions(docs, pos).agg(F.sum("y").cast("bigint").alias("n_pos"), F.sum(1 - F.col("y")).cast("bigint").alias("n_neg"))


@query(
    "cll",
    PREDICTIONS_SQL + "SELECT round(avg(CASE WHEN y = 1 THEN ln(CASE WHEN p = 0 THEN 1e-6 ELSE p END) ELSE ln(1 - CASE WHEN p = 1 THEN 1 - 1e-6 ELSE p END) END), 6) AS cll FROM p",
)
def q_cll(spark, sf):
    return EV.cll(predictions(spark, sf)).select(r6("cll"))


CURVE_SQL = PREDICTIONS_SQL + """, g AS (SELECT p, CAST(sum(y) AS DOUBLE) AS tp, CAST(sum(1 - y) AS DOUBLE) AS fp FROM p GROUP BY p),
c AS (SELECT p, tp, fp, sum(tp) OVER (ORDER BY p DESC) AS ct, sum(fp) OVER (ORDER BY p DESC) AS cf FROM g) """


@query("auc_roc", CURVE_SQL + "SELECT round(sum(fp * (ct - tp / 2)) / (sum(tp) * sum(fp)), 6) AS auc_roc FROM c")
def q_roc(spark, sf):
    return EV.auc_roc(predictions(spark, sf)).select(r6("auc_roc"))


@query(
    "auc_pr",
    CURVE_SQL + """, s AS (SELECT tp, CASE WHEN tp > 0 THEN 1 + fp / tp END AS k, ct - tp AS t0, ct - tp + cf - fp AS n0 FROM c)
SELECT round(sum(CASE WHEN tp = 0 THEN 0 WHEN n0 = 0 THEN tp / k ELSE tp / k + (t0 - n0 / k) / k * ln((n0 + k * tp) / n0) END) / sum(tp), 6) AS auc_pr FROM s""",
)
def q_pr(spark, sf):
    return EV.auc_pr(predictions(spark, sf)).select(r6("auc_pr"))


@query(
    "cross_validation_report",
    PREDICTIONS_SQL + """, q AS (SELECT *, CAST(doc_id % 4 AS INTEGER) AS fold FROM p), g AS (SELECT fold, p, CAST(sum(y) AS DOUBLE) AS tp, CAST(sum(1 - y) AS DOUBLE) AS fp FROM q GROUP BY fold, p),
c AS (SELECT *, sum(tp) OVER (PARTITION BY fold ORDER BY p DESC) AS ct, sum(fp) OVER (PARTITION BY fold ORDER BY p DESC) AS cf FROM g), r AS (SELECT fold, sum(fp * (ct - tp / 2)) / (sum(tp) * sum(fp)) AS roc FROM c GROUP BY fold),
cl AS (SELECT fold, avg(CASE WHEN y = 1 THEN ln(CASE WHEN p = 0 THEN 1e-6 ELSE p END) ELSE ln(1 - CASE WHEN p = 1 THEN 1 - 1e-6 ELSE p END) END) AS cll FROM q GROUP BY fold),
s AS (SELECT fold, tp, CASE WHEN tp > 0 THEN 1 + fp / tp END AS k, ct - tp AS t0, ct - tp + cf - fp AS n0 FROM c),
pr AS (SELECT fold, sum(CASE WHEN tp = 0 THEN 0 WHEN n0 = 0 THEN tp / k ELSE tp / k + (t0 - n0 / k) / k * ln((n0 + k * tp) / n0) END) / sum(tp) AS pr FROM s GROUP BY fold)
SELECT fold, round(cll, 6) AS cll, round(roc, 6) AS auc_roc, round(pr, 6) AS auc_pr FROM r JOIN cl USING (fold) JOIN pr USING (fold)""",
)
def q_cv(spark, sf):
    p = predictions(spark, sf).withColumn("fold", (F.regexp_extract("atom", r"(\d+)", 1).cast("bigint") % 4).cast("int"))
    return EV.cv_report(p).select("fold", r6("cll"), r6("auc_roc"), r6("auc_pr"))


@query(
    "united_predictions",
    PREDICTIONS_SQL + "SELECT count(*) AS n FROM (SELECT DISTINCT doc_id, p, y FROM p)",
)
def q_united(spark, sf):
    p = predictions(spark, sf)
    number = F.regexp_extract("atom", r"(\d+)", 1).cast("bigint")
    return FO.union_predictions([p.filter(number % 2 == 0), p.filter(number % 3 == 0), p]).agg(F.count(F.lit(1)).alias("n"))


@query(
    "marginals_round_trip",
    PREDICTIONS_SQL + "SELECT count(*) AS n, round(sum(p), 4) AS total, CAST(count(*) FILTER (WHERE p >= 0.5) AS BIGINT) AS n_true FROM p",
)
def q_marginals(spark, sf):
    path = fresh_path(spark, "marginals")
    p = predictions(spark, sf).select("atom", "p")
    comma = F.regexp_replace(F.col("p").cast("string"), r"\.", ",")
    number = F.regexp_extract("atom", r"(\d+)", 1).cast("bigint")
    # Half of the lines use a decimal comma, as some runs print them.
    p.select(F.concat_ws(" ", "atom", F.when(number % 2 == 0, comma).otherwise(F.col("p").cast("string"))).alias("value")).write.text(path)
    back = NS.read_marginals(spark, path)
    true = NS.true_atoms(back).agg(F.count(F.lit(1)).alias("n_true"))
    return back.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("p"), 4).alias("total")).join(F.broadcast(true))


@query(
    "result_records",
    PREDICTIONS_SQL + "SELECT 2 * count(*) AS n, round(2 * sum(p), 4) AS total FROM p",
)
def q_records(spark, sf):
    path = fresh_path(spark, "results")
    p = predictions(spark, sf)
    NS.append_result(p, path)
    NS.append_result(p, path)
    back = spark.read.schema("atom string, p double, y int").json(path)
    return back.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("p"), 4).alias("total"))
