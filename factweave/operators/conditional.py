"""Weights of rules for query predicates given evidence: sampling-based gradient steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..plans.local import small_table
from ..facts import FactBase
from ..plans.storage import cut
from ..rules import Clause
from . import infer as I
from .grounding import ground_network, merge_ground


def _reweighted(network: DataFrame, weights: dict[str, float]) -> DataFrame:
    w = small_table(network.sparkSession, list(weights.items()), "clause_id string, w double")
    return network.join(F.broadcast(w), "clause_id").withColumn("weight", F.col("w")).drop("w")


def fit_conditional(
    clauses: list[Clause], fb: FactBase, query: DataFrame, iterations: int = 10, eta: float = 0.1,
    method: str = "perceptron", prior_std: float | None = 1.0, scale_by_counts: bool = False,
    chains: int = 10, burn: int = 2, steps: int = 5, seed: int = 0,
) -> dict[str, float]:
    """Maximise the likelihood of the query atoms given the rest of the facts.

    Each iteration compares the clause true counts in the data with their expectation over Gibbs
    samples.  ``perceptron`` steps by eta times the difference and returns the average of the
    iterates; ``newton`` divides by the sampled variance of each count; ``cg`` follows conjugate
    directions with step -d.g / (d.H.d + lambda d.d) from covariance-vector products.
    """
    network = cut(ground_network(clauses, fb, query))
    ids = sorted({c.clause_id for c in clauses})
    weights = np.array([next(c.weight for c in clauses if c.clause_id == i) for i in ids], float)
    atoms = I.atoms_of(merge_ground(network))
    listed = fb.facts.filter("truth = 'true'").select(
        "fold", F.concat("pred", F.lit("("), F.array_join("args", ","), F.lit(")")).alias("atom")
    ).distinct().withColumn("value", F.lit(True))
    observed = cut(atoms.join(listed, ["fold", "atom"], "left").withColumn("value", F.coalesce("value", F.lit(False))))
    rows = I.clause_report(network, observed).collect()
    train = {r["clause_id"]: r["n_true"] for r in rows}
    total = {r["clause_id"]: max(r["n_total"], 1.0) for r in rows}
    data = np.array([train.get(i, 0.0) for i in ids])
    size = np.array([total.get(i, 1.0) for i in ids])
    iterates, direction, previous, lam = [], None, None, 1.0
    for it in range(iterations):
        merged = merge_ground(_reweighted(network, dict(zip(ids, map(float, weights)))))
        _, samples = I.gibbs(merged, chains, burn, steps, seed + it, keep_samples=True)
        per = cut(I.expected_counts(network, samples))
        mom = {r["clause_id"]: r for r in I.count_moments(per).collect()}
        mean = np.array([mom[i]["mean_true"] if i in mom else 0.0 for i in ids])
        var = np.array([mom[i]["var_true"] if i in mom else 0.0 for i in ids])
        g = data - mean
        if prior_std is not None:
            g = g - weights / prior_std**2
            var = var + 1.0 / prior_std**2
        if method == "perceptron":
            step = eta * (g / size if scale_by_counts else g)
        elif method == "newton":
            step = g / np.maximum(var, 1e-9)
            step = step * min(1.0, 1.0 / max(np.abs(step).max(initial=0.0), 1e-12))
        elif method == "cg":
            pre = g / np.maximum(var, 1e-9)
            if direction is None:
                direction = pre
            else:
                beta = max(0.0, float(pre @ (g - previous)) / max(float(previous @ (previous / np.maximum(var, 1e-9))), 1e-12))
                direction = pre + beta * direction
            v = small_table(fb.spark, [(i, float(d)) for i, d in zip(ids, direction)], "clause_id string, v double")
            hd = {r["clause_id"]: r["value"] for r in I.count_cov_vector(per, v).collect()}
            curve = float(direction @ np.array([hd.get(i, 0.0) for i in ids]))
            if prior_std is not None:
                curve += float(direction @ direction) / prior_std**2
            step = direction * (float(direction @ g) / max(curve + lam * float(direction @ direction), 1e-12))
            previous, lam = g, lam / 2
        else:
            raise ValueError(f"unknown method {method!r}")
        weights = weights + step
        iterates.append(weights)
    final = np.mean(iterates, axis=0) if method == "perceptron" else weights
    return dict(zip(ids, map(float, final)))


def impute_unknown(clauses: list[Clause], fb: FactBase, unknown: DataFrame, seed: int = 0) -> DataFrame:
    """Unknown atoms (``fold, pred, args``) set to their value in a most probable state: adds ``truth``."""
    g = merge_ground(ground_network(clauses, fb, unknown))
    state = I.map_state(g, seed)
    text = F.concat("pred", F.lit("("), F.array_join("args", ","), F.lit(")"))
    return unknown.withColumn("atom", text).join(state, ["fold", "atom"], "left").select(
        "fold", "pred", "args", F.when(F.coalesce("value", F.lit(False)), "true").otherwise("false").alias("truth")
    )
