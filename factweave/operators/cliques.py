"""Dependence between the literals of a clause: decomposition scores, likelihood ratios, significance."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.local import small_table
from ..facts import FactBase, union_all
from ..plans.counting import EXACT, Atom, clause_counts, count_bindings, pairwise_equalities, subsets
from ..plans.patterns import bit, part_clause, pattern_classes, pattern_counts, split_id, split_pattern_counts, splits
from ..rules import Clause


def _pool(df: DataFrame, keys: list[str], start: float) -> DataFrame:
    """Counts summed over folds plus one start value per cell, as doubles."""
    return df.groupBy(*keys).agg((F.sum("n").cast("double") + F.lit(float(start))).alias("n"))


def _class_table(clauses: list[Clause], fb: FactBase) -> DataFrame:
    rows = []
    for c in clauses:
        for m, (rep, size) in pattern_classes(c.literals).items():
            if m == rep:
                rows.append((c.clause_id, m, size))
    return small_table(fb.spark, rows, "clause_id string, mask int, mult int")


def _normalise(df: DataFrame, keys: list[str]) -> DataFrame:
    total = df.groupBy(*keys).agg(F.sum("n").alias("total"))
    return df.join(total, keys).withColumn("p", F.col("n") / F.col("total")).drop("total")


def decomposition_parts(clauses: list[Clause], fb: FactBase, start: float = 1.0, distinct: bool = True) -> DataFrame:
    """Per split and distinct sign pattern: ``clause_id, split, mask, mult, p, q1, q2, m1, m2``.

    p is the pattern's share among distinct patterns, q1 and q2 the shares of its two restrictions
    and m1, m2 the sizes of their pattern classes.
    """
    whole = _normalise(
        _pool(pattern_counts(clauses, fb, distinct), ["clause_id", "mask"], start)
        .join(F.broadcast(_class_table(clauses, fb)), ["clause_id", "mask"]),
        ["clause_id"],
    ).select("clause_id", "mask", "mult", "p")
    link, part_rows = [], []
    for c in clauses:
        n = len(c.literals)
        reps = sorted({rep for rep, _ in pattern_classes(c.literals).values()})
        for first, second in splits(n):
            sid = split_id(first, n)
            classes = {k: pattern_classes(part_clause(c, part).literals) for k, part in ((1, first), (2, second))}
            for k in (1, 2):
                part_rows += [(c.clause_id, sid, k, m, size) for m, (rep, size) in classes[k].items() if m == rep]
            for m in reps:
                sub = {
                    k: sum(bit(j, len(part)) for j, i in enumerate(part) if m & bit(i, n))
                    for k, part in ((1, first), (2, second))
                }
                link.append((c.clause_id, sid, m, classes[1][sub[1]][0], classes[2][sub[2]][0]))
    spark = fb.spark
    reps = small_table(spark, part_rows, "clause_id string, split int, part int, mask int, m int")
    part = _normalise(
        _pool(split_pattern_counts(clauses, fb, distinct), ["clause_id", "split", "part", "mask"], start)
        .join(F.broadcast(reps), ["clause_id", "split", "part", "mask"]),
        ["clause_id", "split", "part"],
    )
    links = small_table(spark, link, "clause_id string, split int, mask int, s1 int, s2 int")

    def side(k: int) -> DataFrame:
        return part.filter(F.col("part") == k).select(
            "clause_id", "split", F.col("mask").alias(f"s{k}"), F.col("p").alias(f"q{k}"), F.col("m").alias(f"m{k}")
        )

    return (
        whole.join(F.broadcast(links), ["clause_id", "mask"])
        .join(side(1), ["clause_id", "split", "s1"]).join(side(2), ["clause_id", "split", "s2"])
        .select("clause_id", "split", "mask", "mult", "p", "q1", "q2", "m1", "m2")
    )


def decomposition_score(
    clauses: list[Clause], fb: FactBase, metric: str = "kl", start: float = 1.0
) -> tuple[DataFrame, DataFrame]:
    """(``clause_id, split, score``; ``clause_id, score`` = minimum over splits).

    ``kl`` is sum p log(p / (mult q1 q2 / (m1 m2))); ``plain`` is sum p log(p / (q1 q2)).
    """
    d = decomposition_parts(clauses, fb, start)
    if metric == "kl":
        ref = F.col("mult") * F.col("q1") * F.col("q2") / (F.col("m1") * F.col("m2"))
    elif metric == "plain":
        ref = F.col("q1") * F.col("q2")
    else:
        raise ValueError(f"unknown metric {metric!r}")
    per_split = d.groupBy("clause_id", "split").agg(F.sum(F.col("p") * F.log(F.col("p") / ref)).alias("score"))
    return per_split, per_split.groupBy("clause_id").agg(F.min("score").alias("score"))


def kl_decomposition(clauses: list[Clause], fb: FactBase, start: float = 1.0) -> tuple[DataFrame, DataFrame]:
    return decomposition_score(clauses, fb, "kl", start)


def literal_rates(clauses: list[Clause], fb: FactBase) -> DataFrame:
    """``clause_id, idx, rate``: share of true atoms among possible atoms of each literal's predicate."""
    preds = sorted({l.pred for c in clauses for l in c.literals})
    true = union_all(
        [fb.relation(p).agg(F.count(F.lit(1)).alias("t")).withColumn("pred", F.lit(p)) for p in preds]
    )
    rows = [
        (c.clause_id, i, l.pred, float(sum(fb.possible(f, l.pred) for f in fb.folds())))
        for c in clauses
        for i, l in enumerate(c.literals)
    ]
    lits = small_table(fb.spark, rows, "clause_id string, idx int, pred string, possible double")
    return lits.join(true, "pred").select("clause_id", "idx", (F.col("t") / F.col("possible")).alias("rate"))


def independence_features(clauses: list[Clause], fb: FactBase) -> DataFrame:
    """Per distinct sign pattern: ``clause_id, mask, n, p, q, contribution``.

    n has the pseudo-count mult / 2^k added; p is its share, q the normalised product of literal
    rates; the contribution is (n log p - n log q) / sum n.
    """
    k = small_table(fb.spark, [(c.clause_id, len(c.literals)) for c in clauses], "clause_id string, k int")
    cells = (
        _pool(pattern_counts(clauses, fb, distinct=True), ["clause_id", "mask"], 0.0)
        .join(F.broadcast(_class_table(clauses, fb)), ["clause_id", "mask"]).join(F.broadcast(k), "clause_id")
        .withColumn("n", F.col("n") + F.col("mult") / F.pow(F.lit(2.0), F.col("k")))
    )
    rates = literal_rates(clauses, fb).groupBy("clause_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("idx", "rate"))), lambda s: s["rate"]).alias("rates")
    )
    indep = F.aggregate(
        F.transform(
            "rates",
            lambda r, i: F.when(F.pmod(F.floor(F.col("mask") / F.pow(F.lit(2.0), F.col("k") - 1 - i)), F.lit(2)) == 1, r).otherwise(1 - r),
        ),
        F.lit(1.0), lambda acc, x: acc * x,
    )
    cells = cells.join(rates, "clause_id").withColumn("ind", indep)
    total = cells.groupBy("clause_id").agg(F.sum("n").alias("total"), F.sum("ind").alias("ind_total"))
    cells = cells.join(total, "clause_id")
    p, q = F.col("n") / F.col("total"), F.col("ind") / F.col("ind_total")
    return cells.select(
        "clause_id", "mask", "n", p.alias("p"), q.alias("q"),
        ((_xlog(F.col("n"), p) - _xlog(F.col("n"), q)) / F.col("total")).alias("contribution"),
    )


def independence_llr(clauses: list[Clause], fb: FactBase) -> DataFrame:
    """``clause_id, log_clique, log_independent, llr, llr_per_grounding``."""
    f = independence_features(clauses, fb)
    a, b = F.sum(_xlog(F.col("n"), F.col("p"))), F.sum(_xlog(F.col("n"), F.col("q")))
    return f.groupBy("clause_id").agg(
        a.alias("log_clique"), b.alias("log_independent"), (a - b).alias("llr"), ((a - b) / F.sum("n")).alias("llr_per_grounding")
    )


def pattern_rates(clauses: list[Clause], fb: FactBase, distinct: bool = False) -> DataFrame:
    """``clause_id, mask, rate``: share of groundings with each truth pattern."""
    return _normalise(_pool(pattern_counts(clauses, fb, distinct), ["clause_id", "mask"], 0.0), ["clause_id"]).select(
        "clause_id", "mask", F.col("p").alias("rate")
    )


def normal_tail(z: Column) -> Column:
    """P(N(0,1) > z) for z >= 0, by the rational erfc approximation of Numerical Recipes (error < 1.2e-7)."""
    # Fixed polynomial coefficients of the approximation, lowest power first.
    coefs = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587,
             -0.82215223, 0.17087277]
    x = z / math.sqrt(2)
    t = 1 / (1 + x / 2)
    poly = F.lit(coefs[-1])
    for c in reversed(coefs[:-1]):
        poly = poly * t + c
    return t * F.exp(-x * x + poly) / 2


def _stirling(n: Column) -> Column:
    """log n! by Stirling's formula; 0 for n = 0."""
    return F.when(n == 0, 0.0).otherwise(n * F.log(n) - n + F.log(F.sqrt(2 * math.pi * n)))


def _xlog(x: Column, y: Column) -> Column:
    """x log y with 0 log 0 = 0 and x log 0 = -infinity."""
    return F.when(x == 0, 0.0).when(y == 0, float("-inf")).otherwise(x * F.log(y))


def split_significance(clauses: list[Clause], fb: FactBase) -> DataFrame:
    """Is a clause's true rate explained by its parts being independent?  One row per split.

    A two-literal clause is compared with 1 - (1-p1)(1-p2); a longer clause with the same expression
    for each split of one literal against the rest.  ``clause_id, split, rate, expected, z, p_value,
    difference, kl, log_lik``; averages over splits come from ``split_averages``.
    """
    rows, rules = [], {}
    for c in clauses:
        n = len(c.literals)
        rules[c.clause_id] = c
        for i in range(n if n > 2 else 1):
            rest = tuple(j for j in range(n) if j != i)
            one, other = part_clause(c, (i,)), part_clause(c, rest)
            rules[one.clause_id], rules[other.clause_id] = one, other
            rows.append((c.clause_id, i, one.clause_id, other.clause_id))
    counts = clause_counts(list(rules.values()), fb).groupBy("clause_id").agg(
        F.sum("n_true").cast("double").alias("t"), F.sum("n_total").cast("double").alias("n")
    )
    rate = counts.select("clause_id", (F.col("t") / F.col("n")).alias("rate"))
    s = small_table(fb.spark, rows, "clause_id string, split int, one string, other string")
    s = s.join(counts, "clause_id")
    for side in ("one", "other"):
        s = s.join(rate.select(F.col("clause_id").alias(side), F.col("rate").alias(f"r_{side}")), side)
    r, p0 = F.col("rate"), F.col("expected")
    s = s.select(
        "clause_id", "split", "t", "n", (F.col("t") / F.col("n")).alias("rate"),
        (1 - (1 - F.col("r_one")) * (1 - F.col("r_other"))).alias("expected"),
    )
    z = F.try_divide(F.sqrt("n") * F.abs(r - p0), F.sqrt(p0 * (1 - p0)))
    f = F.col("n") - F.col("t")
    return s.select(
        "clause_id", "split", "rate", "expected", z.alias("z"), (2 * normal_tail(z)).alias("p_value"),
        F.abs(r - p0).alias("difference"),
        (_xlog(r, r) - _xlog(r, p0) + _xlog(1 - r, 1 - r) - _xlog(1 - r, 1 - p0)).alias("kl"),
        (_stirling(F.col("n")) - _stirling(F.col("t")) - _stirling(f) + _xlog(F.col("t"), p0) + _xlog(f, 1 - p0)).alias("log_lik"),
    )


def split_averages(s: DataFrame) -> DataFrame:
    return s.groupBy("clause_id").agg(*[F.avg(c).alias(c) for c in ("z", "p_value", "difference", "kl", "log_lik")])


def count_by(c: Clause, fb: FactBase, distinct: bool = True) -> DataFrame:
    """Conjunction counts for every binding of every subset of the clause's variables.

    ``fold, vars, binding, n`` with parallel arrays.  Each subset is its own aggregate join; the full
    binding table is only built for the full subset.
    """
    vt = c.var_types(fb.schema)
    ins = [Atom(l.pred, l.args) for l in c.literals]
    outs = pairwise_equalities(vt) if distinct else []
    parts = []
    for keep in subsets(list(vt)):
        df = count_bindings(fb, ins, outs, vt, tuple(keep))
        none = F.array().cast("array<string>")
        parts.append(
            df.filter("n <> 0").select(
                "fold",
                (F.array(*[F.lit(v) for v in keep]) if keep else none).alias("vars"),
                (F.array(*[F.col(f"k_{v}") for v in keep]) if keep else none).alias("binding"),
                F.col("n").cast(EXACT).alias("n"),
            )
        )
    return union_all(parts)


def estimate_true(c: Clause, fb: FactBase, eps: float = 0.1, delta: float = 0.05, seed: int = 0) -> DataFrame:
    """Sampled estimate of the true groundings of a clause whose literals are all positive.

    Union estimate: literal i is chosen in proportion to its true groundings N_i, one of its facts
    and the remaining variables are drawn uniformly, and the draw counts sum(N) / (number of
    literals true under the binding).  4.5 (k-1) / eps^2 ln(2/delta) draws, all in one DataFrame.
    ``fold, estimate, draws``.
    """
    from ..plans.ordering import hashed_positions

    vt = c.var_types(fb.schema)
    k = len(c.literals)
    if any(not l.positive for l in c.literals):
        raise ValueError("the estimate is for clauses of positive literals; count exactly otherwise")
    draws = math.ceil(4.5 * max(k - 1, 1) / eps**2 * math.log(2 / delta))
    out = []
    facts = {
        p: hashed_positions(fb.relation(p), ["fold"], [f"a{i}" for i in range(fb.schema[p].arity)], seed, "pos")
        for p in {l.pred for l in c.literals}
    }
    consts = {t: hashed_positions(fb.constants_of(t), ["fold"], ["const"], seed, "pos") for t in set(vt.values())}
    for f in fb.folds():
        weight = []
        for l in c.literals:
            free = [v for v in vt if v not in [a.name for a in l.args]]
            w = fb.true_totals().get((f, l.pred), 0)
            for v in free:
                w *= fb.size(f, vt[v])
            weight.append(w)
        total = sum(weight)
        if total == 0:
            continue
        u = (F.pmod(F.xxhash64(F.lit(seed), F.lit(f), "id"), F.lit(1 << 50)).cast("double")) / float(1 << 50)
        cum, pick = 0, F.lit(k - 1)
        for i in reversed(range(k - 1)):
            pick = F.when(u < sum(weight[: i + 1]) / total, i).otherwise(pick)
        base = fb.spark.range(draws).select(F.lit(f).alias("fold"), "id", pick.alias("pick"))
        bound = []
        for i, l in enumerate(c.literals):
            n = fb.true_totals().get((f, l.pred), 0)
            if n == 0:
                continue
            df = base.filter(F.col("pick") == i).withColumn("pos", F.pmod(F.xxhash64(F.lit(seed + 1), "id"), F.lit(n)) + 1)
            names = [a.name for a in l.args]
            if any(not a.is_var for a in l.args) or len(set(names)) < len(names):
                raise ValueError("literals need distinct variables")
            rel = facts[l.pred].select("fold", "pos", *[F.col(f"a{j}").alias(f"v_{v}") for j, v in enumerate(names)])
            df = df.join(rel, ["fold", "pos"]).drop("pos")
            for j, v in enumerate(x for x in vt if x not in names):
                size = fb.size(f, vt[v])
                df = df.withColumn("pos", F.pmod(F.xxhash64(F.lit(seed + 2 + j), "id"), F.lit(size)) + 1).join(
                    consts[vt[v]].select("fold", "pos", F.col("const").alias(f"v_{v}")), ["fold", "pos"]
                ).drop("pos")
            bound.append(df.select("fold", "id", *[f"v_{v}" for v in vt]))
        df = union_all(bound)
        hits = F.lit(0)
        for i, l in enumerate(c.literals):
            rel = fb.relation(l.pred).select(
                "fold", *[F.col(f"a{j}").alias(f"v_{a.name}") for j, a in enumerate(l.args)]
            ).withColumn(f"hit{i}", F.lit(1))
            df = df.join(rel, ["fold"] + [f"v_{a.name}" for a in l.args], "left")
            hits = hits + F.coalesce(f"hit{i}", F.lit(0))
        out.append(df.groupBy("fold").agg(F.avg(F.lit(float(total)) / hits).alias("estimate"), F.count(F.lit(1)).alias("draws")))
    return union_all(out)
