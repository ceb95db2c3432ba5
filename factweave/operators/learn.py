"""Pseudo-log-likelihood: value, gradient, weight fitting, candidate scoring, closed forms."""

from __future__ import annotations

import math
import warnings
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..plans.local import small_table
from ..facts import FactBase, union_all
from ..plans.atom_counts import atom_counts, counts_for_atoms
from ..plans.blocks import block_signatures
from ..plans.counting import EXACT, clause_counts
from ..plans.signatures import SIGNATURES_DDL, signatures
from ..plans.storage import cut
from ..rules import Clause, unit

Weights = dict[str, dict[str, float]]  # problem -> clause_id -> weight


def weights_df(spark, weights: Weights) -> DataFrame:
    rows = [(p, {c: float(w) for c, w in ws.items()}) for p, ws in weights.items()]
    return small_table(spark, rows, "problem string, w map<string,double>")


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def with_log_prob(s: DataFrame, weights: Weights) -> DataFrame:
    """Adds ``logp`` = log P(atom as observed | rest) = -log(1 + exp(sum_c w_c n_c))."""
    score = F.aggregate(
        F.col("sig"), F.lit(0.0), lambda acc, e: acc + e["n"] * F.coalesce(F.col("w")[e["clause_id"]], F.lit(0.0))
    )
    joined = s.join(F.broadcast(weights_df(s.sparkSession, weights)), "problem")
    return joined.withColumn("logp", -softplus(score)).drop("w")


def scale_by_predicate(s: DataFrame, fb: FactBase) -> DataFrame:
    """Equal predicate weighting: multiplicities divided by the predicate's possible atoms."""
    rows = [(f, p.name, float(fb.possible(f, p.name))) for f in fb.folds() for p in fb.schema]
    n = small_table(fb.spark, rows, "fold int, pred string, possible double")
    return (
        s.join(F.broadcast(n), ["fold", "pred"])
        .withColumn("mult", F.col("mult") / F.col("possible"))
        .drop("possible")
    )


def pll(s: DataFrame, weights: Weights) -> DataFrame:
    """``problem, pll`` at given weights."""
    return with_log_prob(s, weights).groupBy("problem").agg(F.sum(F.col("mult") * F.col("logp")).alias("pll"))


def pll_gradient(
    s: DataFrame, weights: Weights, prior: tuple[float, float] | None = None
) -> DataFrame:
    """``problem, clause_id, gradient`` of the PLL, minus the Gaussian prior term (mean, std) if given."""
    g = with_log_prob(s, weights).withColumn("e", F.explode("sig")).groupBy("problem", F.col("e.clause_id").alias("clause_id")).agg(
        F.sum(F.col("mult") * (F.exp("logp") - 1) * F.col("e.n")).alias("gradient")
    )
    if prior is None:
        return g
    mean, std = prior
    w = weights_df(s.sparkSession, weights).select("problem", F.explode("w").alias("clause_id", "weight"))
    return w.join(g, ["problem", "clause_id"], "left").select(
        "problem", "clause_id",
        (F.coalesce("gradient", F.lit(0.0)) - (F.col("weight") - mean) / std**2).alias("gradient"),
    )


def pll_moments(s: DataFrame, weights: Weights) -> DataFrame:
    """Value, gradient and second derivatives in one aggregation: ``problem, ci, cj, v``.

    ``ci = cj = null`` is the value, ``cj = null`` a gradient entry, otherwise a Hessian entry.
    """
    entries = (
        "concat(array(named_struct('ci', cast(null as string), 'cj', cast(null as string), 'v', mult * logp)),"
        " transform(sig, a -> named_struct('ci', a.clause_id, 'cj', cast(null as string), 'v', mult * (exp(logp) - 1) * a.n)),"
        " flatten(transform(sig, a -> transform(filter(sig, b -> b.clause_id >= a.clause_id), b -> named_struct("
        "'ci', a.clause_id, 'cj', b.clause_id, 'v', -mult * exp(logp) * (1 - exp(logp)) * a.n * b.n)))))"
    )
    return (
        with_log_prob(s, weights).select("problem", F.explode(F.expr(entries)).alias("e"))
        .groupBy("problem", "e.ci", "e.cj").agg(F.sum("e.v").alias("v"))
    )


# ---------------------------------------------------------------- exclusive blocks


def with_block_prob(b: DataFrame, weights: Weights) -> DataFrame:
    """Adds ``score``, and ``logz`` of the block: log of the sum over its alternatives of size * exp(score)."""
    score = F.aggregate(
        F.col("sig"), F.lit(0.0), lambda acc, e: acc + e["n"] * F.coalesce(F.col("w")[e["clause_id"]], F.lit(0.0))
    )
    scored = b.join(F.broadcast(weights_df(b.sparkSession, weights)), "problem").withColumn("score", score).drop("w")
    block = W.partitionBy("problem", "block")  # its distinct alternatives
    top = F.max("score").over(block)
    return scored.withColumn("logz", top + F.log(F.sum(F.col("size") * F.exp(F.col("score") - top)).over(block)))


def block_pll(b: DataFrame, weights: Weights) -> DataFrame:
    """``problem, pll`` of blocks: log of the softmax over alternatives at the one that holds."""
    return with_block_prob(b, weights).filter("chosen").groupBy("problem").agg(
        F.sum(F.col("mult") * (F.col("score") - F.col("logz"))).alias("pll")
    )


def block_moments(b: DataFrame, weights: Weights) -> DataFrame:
    """Value, gradient and second derivatives of ``block_pll``: ``problem, ci, cj, v`` as in ``pll_moments``."""
    rows = with_block_prob(b, weights).withColumn("p", F.col("size") * F.exp(F.col("score") - F.col("logz")))
    own = (
        "concat(if(chosen, array(named_struct('ci', cast(null as string), 'cj', cast(null as string), 'v', mult * (score - logz))), array()),"
        " transform(sig, a -> named_struct('ci', a.clause_id, 'cj', cast(null as string), 'v', mult * (if(chosen, 1D, 0D) - p) * a.n)),"
        " flatten(transform(sig, a -> transform(filter(sig, b -> b.clause_id >= a.clause_id), b -> named_struct("
        "'ci', a.clause_id, 'cj', b.clause_id, 'v', -mult * p * a.n * b.n)))))"
    )
    # the product of expectations, block by block
    means = (
        rows.select("problem", "block", "mult", "p", F.explode("sig").alias("e"))
        .groupBy("problem", "block", F.col("e.clause_id").alias("clause_id")).agg(F.sum(F.col("p") * F.col("e.n")).alias("n"), F.first("mult").alias("mult"))
        .groupBy("problem", "block").agg(F.first("mult").alias("mult"), F.collect_list(F.struct("clause_id", "n")).alias("sig"))
    )
    pairs = (
        "flatten(transform(sig, a -> transform(filter(sig, b -> b.clause_id >= a.clause_id), b -> named_struct("
        "'ci', a.clause_id, 'cj', b.clause_id, 'v', mult * a.n * b.n))))"
    )
    return (
        rows.select("problem", F.explode(F.expr(own)).alias("e"))
        .unionByName(means.select("problem", F.explode(F.expr(pairs)).alias("e")))
        .groupBy("problem", "e.ci", "e.cj").agg(F.sum("e.v").alias("v"))
    )


def block_gradient(b: DataFrame, weights: Weights) -> DataFrame:
    """``problem, clause_id, gradient`` of ``block_pll``: observed minus expected gain of each clause."""
    rows = with_block_prob(b, weights).withColumn("p", F.col("size") * F.exp(F.col("score") - F.col("logz")))
    return rows.withColumn("e", F.explode("sig")).groupBy("problem", F.col("e.clause_id").alias("clause_id")).agg(
        F.sum(F.col("mult") * (F.col("chosen").cast("double") - F.col("p")) * F.col("e.n")).alias("gradient")
    )


def exclusive_preds(fb: FactBase, preds: list[str] | None = None) -> list[str]:
    return [p.name for p in fb.schema if p.exclusive_args and (preds is None or p.name in preds)]


@dataclass
class Fit:
    weights: dict[str, float]
    value: float  # penalised objective (higher is better)
    pll: float
    iterations: int
    converged: bool


DAMPINGS = (1.0, 1e-2, 0.0)  # multiples of the current damping tried in one job


def _assemble(rows, ids: dict[str, list[str]], inv_var: float, mean: float, points: dict[str, np.ndarray]):
    """Penalised value, gradient and Hessian per trial problem from ``pll_moments`` rows."""
    index = {p: {c: i for i, c in enumerate(cs)} for p, cs in ids.items()}
    out = {p: [0.0, np.zeros(len(cs)), np.zeros((len(cs), len(cs)))] for p, cs in ids.items()}
    for r in rows:
        p, ci, cj, v = r["problem"], r["ci"], r["cj"], r["v"]
        if ci is None:
            out[p][0] += v
        elif cj is None:
            out[p][1][index[p][ci]] += v
        else:
            i, j = index[p][ci], index[p][cj]
            out[p][2][i, j] += v
            if i != j:
                out[p][2][j, i] += v
    result = {}
    for p, (raw, g, h) in out.items():
        d = points[p] - mean
        result[p] = (raw - 0.5 * inv_var * float(d @ d), raw, g - inv_var * d, h - inv_var * np.eye(len(d)))
    return result


def fit_signatures(
    s: DataFrame,
    start: Weights,
    prior_std: float | None = 100.0,
    prior_mean: float = 0.0,
    max_iter: int = 40,
    tol: float = 1e-9,
    blocks: DataFrame | None = None,
) -> dict[str, Fit]:
    """Maximise PLL minus prior for every problem at once; ``blocks`` adds the terms of exclusive predicates.

    Each iteration is one Spark aggregation over the stored signature table.  It evaluates a few
    damped Newton steps per problem (the objective is concave); the driver keeps the best one and
    solves the next small linear systems.  Driver state is one weight vector per problem.
    """
    inv_var = 0.0 if prior_std is None else 1.0 / prior_std**2
    ids = {p: sorted(ws) for p, ws in start.items()}
    best: dict[str, tuple] = {}
    at = {p: np.array([start[p][c] for c in ids[p]], float) for p in start}
    damp = dict.fromkeys(start, 1e-3)
    done: dict[str, bool] = {}
    rounds = dict.fromkeys(start, 0)
    for _ in range(max_iter):
        points: dict[str, np.ndarray] = {}
        owner: dict[str, str] = {}
        for p in start:
            if p in done:
                continue
            if p not in best:
                points[p] = at[p]
                owner[p] = p
                continue
            _, _, g, h = best[p]
            scale = np.maximum(-np.diag(h), 1e-12 * max(1.0, float(np.abs(h).max(initial=0.0))))
            for k, m in enumerate(DAMPINGS):
                step = np.linalg.lstsq(-h + m * damp[p] * np.diag(scale) + 1e-14 * np.diag(scale), g, rcond=None)[0]
                step = np.clip(step, -50.0, 50.0)
                key = f"{p}\x00{k}"
                points[key] = at[p] + step
                owner[key] = p
        if not points:
            break
        copies = small_table(s.sparkSession, [(owner[k], k) for k in points], "owner string, trial string")
        at_points = {k: dict(zip(ids[owner[k]], x)) for k, x in points.items()}

        def tried(t: DataFrame) -> DataFrame:
            tagged = t.join(F.broadcast(copies), F.col("problem") == F.col("owner"))
            return tagged.drop("problem", "owner").withColumnRenamed("trial", "problem")

        moments = pll_moments(tried(s).select("problem", "sig", "mult"), at_points)
        if blocks is not None:
            moments = moments.unionByName(block_moments(tried(blocks), at_points))
        rows = moments.collect()
        found = _assemble(rows, {k: ids[owner[k]] for k in points}, inv_var, prior_mean, points)
        for p in dict.fromkeys(owner.values()):
            rounds[p] += 1
            keys = [k for k in points if owner[k] == p]
            top = max(keys, key=lambda k: found[k][0] if np.isfinite(found[k][0]) else -math.inf)
            value = found[top][0]
            if p not in best:
                best[p], gain = found[top], math.inf
            elif value > best[p][0]:
                gain = value - best[p][0]
                best[p], at[p] = found[top], points[top]
                damp[p] = damp[p] * 0.1 if top[-1] != "0" else damp[p] * 0.5
            else:
                gain = 0.0
                damp[p] = max(damp[p], 1e-6) * 100.0
            size = max(1.0, abs(best[p][0]))
            flat = float(np.abs(best[p][2]).max(initial=0.0)) <= tol * size
            if flat or (0.0 < gain <= tol * 1e-2 * size) or damp[p] > 1e12:
                done[p] = True
    return {
        p: Fit(dict(zip(ids[p], map(float, at[p]))), best[p][0], best[p][1], rounds[p], p in done) for p in start
    }


@contextmanager
def stored(s: DataFrame):
    """The signature table, materialised once for the iterations: balanced partitions, short lineage."""
    table = cut(s.hint("rebalance")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield table
    finally:
        table.unpersist()


def fit_weights(
    clauses: list[Clause],
    fb: FactBase,
    max_iter: int = 40,
    tol: float = 1e-9,
    prior_std: float | None = 100.0,
    equal_predicates: bool = False,
    preds: list[str] | None = None,
    exclusive: bool = False,
) -> Fit:
    """Weights of one theory maximising the pseudo-likelihood.

    With ``exclusive``, predicates with an exclusive argument count by blocks: a softmax over the alternatives of each
    block instead of one term per atom. Without it their atoms are ordinary ones, and a warning says so.
    """
    names = preds or [p.name for p in fb.schema]
    closed = exclusive_preds(fb, names)
    if closed and not exclusive:
        warnings.warn(f"atoms of {', '.join(closed)} are taken as independent; exclusive=True fits blocks", stacklevel=2)
    if exclusive and equal_predicates and closed:
        raise ValueError("equal weighting of predicates is defined for atoms, not for blocks")
    start = {"theory": start_weights(clauses, fb)}
    theory, plain = {"theory": clauses}, [p for p in names if not (exclusive and p in closed)]
    s = signatures(theory, fb, plain) if plain else small_table(fb.spark, [], SIGNATURES_DDL)
    if equal_predicates:
        s = scale_by_predicate(s, fb)
    with stored(s) as table:
        if not (exclusive and closed):
            return fit_signatures(table, start, prior_std, 0.0, max_iter, tol)["theory"]
        with stored(union_all([block_signatures(theory, fb, p) for p in closed])) as blocks:
            return fit_signatures(table, start, prior_std, 0.0, max_iter, tol, blocks)["theory"]


def score_candidates(
    candidates: list[Clause],
    base: list[Clause],
    fb: FactBase,
    penalty: float = 0.01,
    prior_std: float | None = 100.0,
    equal_predicates: bool = True,
    max_iter: int = 30,
    tol: float = 1e-8,
) -> DataFrame:
    """Gain of adding each candidate to the base theory, all candidates fitted by the same jobs.

    ``clause_id, weight, base_score, new_score, gain, converged`` with gain = new - base - literals * penalty. A
    candidate whose fit, or the base's, has not settled within ``max_iter`` has no gain, so no search accepts it.
    """
    if len({c.clause_id for c in candidates} | {c.clause_id for c in base}) != len(candidates) + len(base):
        raise ValueError("candidates and base theory share a clause id")
    problems = {"@base": list(base)}
    for c in candidates:
        problems[c.clause_id] = list(base) + [c]
    s = signatures(problems, fb)
    if equal_predicates:
        s = scale_by_predicate(s, fb)
    with stored(s) as table:
        begin = start_weights(base, fb)
        start = {"@base": begin, **{c.clause_id: {**begin, c.clause_id: c.weight} for c in candidates}}
        fits = fit_signatures(table, start, prior_std, 0.0, max_iter, tol)
    base_fit = fits["@base"]
    rows = [
        (
            c.clause_id,
            fits[c.clause_id].weights[c.clause_id],
            base_fit.value,
            fits[c.clause_id].value,
            fits[c.clause_id].value - base_fit.value - penalty * len(c.literals)
            if base_fit.converged and fits[c.clause_id].converged else None,
            base_fit.converged and fits[c.clause_id].converged,
        )
        for c in candidates
    ]
    return small_table(fb.spark,
        rows, "clause_id string, weight double, base_score double, new_score double, gain double, converged boolean"
    )


def start_weights(clauses: list[Clause], fb: FactBase) -> dict[str, float]:
    """Given weights; unit clauses without one start at their closed form, from per-predicate totals."""
    out = {}
    for c in clauses:
        w = c.weight
        if w == 0.0 and c.is_unit():
            pred = c.literals[0].pred
            t = sum(fb.true_totals().get((f, pred), 0) for f in fb.folds())
            rest = sum(fb.possible(f, pred) for f in fb.folds()) - t
            w = math.log((t + 0.5) / (rest + 0.5)) * (1 if c.literals[0].positive else -1)
        out[c.clause_id] = w
    return out


def unit_theory(fb: FactBase) -> list[Clause]:
    return [unit(p.name, fb.schema) for p in fb.schema]


def unit_weights(fb: FactBase) -> DataFrame:
    """Closed-form unit-clause weights log(t / (N - t)) per predicate, pooled over folds."""
    true = union_all(
        [fb.relation(p.name).groupBy().agg(F.count(F.lit(1)).alias("n_true")).select(F.lit(p.name).alias("pred"), "n_true")
         for p in fb.schema]
    )
    rows = [(p.name, float(sum(fb.possible(f, p.name) for f in fb.folds()))) for p in fb.schema]
    n = small_table(fb.spark, rows, "pred string, possible double")
    t, rest = F.col("n_true"), F.col("possible") - F.col("n_true")
    weight = (
        F.when(t == 0, F.lit(float("-inf"))).when(rest == 0, F.lit(float("inf"))).otherwise(F.log(F.try_divide(t, rest)))
    )
    return true.join(F.broadcast(n), "pred").select("pred", "n_true", "possible", weight.alias("weight"))


def log_odds_weights(clauses: list[Clause], fb: FactBase) -> DataFrame:
    """Start weights log(true/false) - log(2^k - 1), zero counts replaced by 1e-5, pooled over folds."""
    k = small_table(fb.spark, [(c.clause_id, len(c.literals)) for c in clauses], "clause_id string, k int")
    sums = clause_counts(clauses, fb).groupBy("clause_id").agg(
        F.sum("n_true").cast("double").alias("t"), F.sum("n_false").cast("double").alias("f")
    )
    t = F.when(F.col("t") == 0, 1e-5).otherwise(F.col("t"))
    f = F.when(F.col("f") == 0, 1e-5).otherwise(F.col("f"))
    return sums.join(F.broadcast(k), "clause_id").select(
        "clause_id", (F.log(t / f) - F.log(F.pow(F.lit(2.0), F.col("k")) - 1)).alias("weight")
    )


def atom_scores(clauses: list[Clause], fb: FactBase, pred: str, atoms: DataFrame) -> DataFrame:
    """Conditional probability of each listed atom given all other facts: no sampling, no grounding.

    ``atoms`` holds ``fold, a0, ...``; the result adds ``truth, p_true, log_prob`` where log_prob is
    the log-probability of the observed value.
    """
    fixed = [c for c in clauses if c.is_unit() and c.literals[0].pred == pred]
    rest = [c for c in clauses if not c.is_unit()]
    weights = {c.clause_id: c.weight for c in clauses}
    cols = [f"a{i}" for i in range(fb.schema[pred].arity)]
    key = ["fold"] + cols
    listed = fb.relation(pred).withColumn("truth", F.lit(True))
    rows = atoms.select(*key).distinct().join(listed, key, "left").withColumn("truth", F.coalesce("truth", F.lit(False)))
    touching = [c for c in rest if any(l.pred == pred for l in c.literals)]
    if touching:
        counts = counts_for_atoms(atom_counts(touching, pred, fb), atoms)
        w = F.broadcast(small_table(fb.spark,
        [(c, float(weights[c])) for c in {c.clause_id for c in touching}], "clause_id string, w double"))
        z = counts.join(w, "clause_id").groupBy(*key).agg(F.sum(F.col("n").cast("double") * F.col("w")).alias("z"))
        rows = rows.join(z, key, "left")
    else:
        rows = rows.withColumn("z", F.lit(0.0))
    bias = sum(c.weight if c.literals[0].positive else -c.weight for c in fixed)
    z = F.coalesce("z", F.lit(0.0)) + F.when(F.col("truth"), -bias).otherwise(bias)
    logp = -softplus(z)
    return rows.select(
        *key, "truth", F.when(F.col("truth"), F.exp(logp)).otherwise(1 - F.exp(logp)).alias("p_true"), logp.alias("log_prob")
    )


def theory_report(clauses: list[Clause], fb: FactBase) -> DataFrame:
    """Per clause: counts, weight * true count, and t*log s(w) + f*log(1 - s(w)), pooled over folds."""
    w = small_table(fb.spark, [(c.clause_id, float(c.weight)) for c in clauses], "clause_id string, weight double")
    sums = clause_counts(clauses, fb).groupBy("clause_id").agg(
        F.sum("n_true").cast(EXACT).alias("n_true"), F.sum("n_total").cast(EXACT).alias("n_total")
    )
    t, n = F.col("n_true").cast("double"), F.col("n_total").cast("double")
    return sums.join(F.broadcast(w), "clause_id").select(
        "clause_id", "weight", "n_true", "n_total", (F.col("weight") * t).alias("weighted_true"),
        (-t * softplus(-F.col("weight")) - (n - t) * softplus(F.col("weight"))).alias("log_lik"),
    )
