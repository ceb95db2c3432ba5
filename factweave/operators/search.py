"""Theory search: greedy acceptance, beam search, pruning.

The walk over candidates is sequential by definition and runs on the driver; every step is a batch
of Spark jobs over the facts, and only weights and scores come back.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window as W, functions as F

from ..facts import FactBase
from ..plans.patterns import canonical_form
from ..plans.signatures import signatures
from ..rules import Clause, collect_rules, rules_to_df
from .generate import expand, unit_clauses
from .learn import Fit, fit_signatures, fit_weights, scale_by_predicate, score_candidates, stored, unit_theory


@dataclass
class Theory:
    clauses: list[Clause]
    score: float
    trace: list[tuple[str, float, bool]]  # candidate, score or gain, kept


def with_weights(clauses: list[Clause], fit: Fit) -> list[Clause]:
    return [replace(c, weight=fit.weights[c.clause_id]) for c in clauses]


def settled(fit: Fit) -> bool:
    """Whether a fit may be judged: one that hasn't settled has a score on the way, and no theory is accepted or dropped by it."""
    return fit.converged


def greedy_groups(
    groups: list[tuple[str, list[Clause]]], fb: FactBase, prior_std: float = 100.0, units: bool = True
) -> Theory:
    """Walk ranked groups of clauses; keep a group iff its fit settles and the score strictly improves."""
    base = unit_theory(fb) if units else []
    kept: list[Clause] = []
    best, fit = float("-inf"), None
    trace = []
    for name, clauses in groups:
        theory = base + kept + [c for c in clauses if c not in kept]
        candidate = fit_weights(theory, fb, prior_std=prior_std, equal_predicates=True)
        better = settled(candidate) and candidate.value > best
        trace.append((name, candidate.value, better))
        if better:
            best, fit = candidate.value, candidate
            kept = theory[len(base):]
    final = with_weights(base + kept, fit) if fit else base
    return Theory(final, best, trace)


def greedy_formulas(ranked: list[Clause], fb: FactBase, prior_std: float = 100.0, units: bool = True) -> Theory:
    """One formula at a time, best ranked first."""
    return greedy_groups([(c.clause_id, [c]) for c in ranked], fb, prior_std, units)


def greedy_templates(ranked: list[tuple[str, list[Clause]]], fb: FactBase, prior_std: float = 100.0, units: bool = True) -> Theory:
    """All formulas of a template are added or rejected together."""
    return greedy_groups(ranked, fb, prior_std, units)


def greedy_by_gain(
    candidates: list[Clause], fb: FactBase, penalty: float = 0.01, min_gain: float = 0.0, min_weight: float = 0.01,
    prior_std: float = 100.0,
) -> Theory:
    """Accept each candidate whose gain over the *initial* score and whose weight pass the thresholds."""
    theory = unit_theory(fb)
    fit = fit_weights(theory, fb, prior_std=prior_std, equal_predicates=True)
    initial = fit.value
    trace = []
    for c in candidates:
        if any(canonical_form(c.literals) == canonical_form(t.literals) for t in theory):
            continue
        trial = fit_weights(with_weights(theory, fit) + [c], fb, prior_std=prior_std, equal_predicates=True)
        gain = trial.value - initial - penalty * len(c.literals)
        ok = settled(fit) and settled(trial) and gain > min_gain and abs(trial.weights[c.clause_id]) >= min_weight
        trace.append((c.clause_id, gain, ok))
        if ok:
            theory, fit = theory + [c], trial
    return Theory(with_weights(theory, fit), fit.value, trace)


def prune(theory: list[Clause], fb: FactBase, penalty: float = 0.01, prior_std: float = 100.0) -> Theory:
    """Drop multi-literal clauses while dropping one improves score minus penalty; all drops of a round share jobs."""
    current = list(theory)
    trace = []
    while True:
        droppable = [c for c in current if len(c.literals) > 1]
        problems = {"@all": current}
        for c in droppable:
            problems[c.clause_id] = [x for x in current if x is not c]
        table = scale_by_predicate(signatures(problems, fb), fb)
        with stored(table) as s:
            fits = fit_signatures(s, {p: {c.clause_id: c.weight for c in cs} for p, cs in problems.items()}, prior_std)
        now = fits["@all"].value
        gains = {
            c.clause_id: fits[c.clause_id].value - now + penalty * len(c.literals) for c in droppable
            if settled(fits["@all"]) and settled(fits[c.clause_id])
        }
        best = max(gains, key=gains.get, default=None)
        if best is None or gains[best] <= 0:
            return Theory(with_weights(current, fits["@all"]), now, trace)
        trace.append((best, gains[best], True))
        current = [c for c in current if c.clause_id != best]


def learn_structure(
    fb: FactBase, max_vars: int = 3, max_literals: int = 2, beam_size: int = 5, penalty: float = 0.01,
    min_gain: float = 0.0, min_weight: float = 0.01, prior_std: float = 100.0, max_rounds: int | None = None,
    prune_after: bool = False,
) -> Theory:
    """Beam search from unit clauses.

    Start with fitted unit clauses, add unit clauses with repeated variables, then repeat: expand the
    beam by one edit, score all new candidates together, keep the best by gain, add the best one to
    the theory; stop when no candidate gains, or after ``max_rounds`` if it is given.
    """
    theory = unit_theory(fb)
    repeated = [c for c in unit_clauses(fb.schema, repeated=True) if not c.is_unit()]
    theory = theory + repeated
    fit = fit_weights(theory, fb, prior_std=prior_std, equal_predicates=True)
    beam: list[Clause] = list(theory)
    trace, rounds = [], 0
    seen = {canonical_form(c.literals) for c in theory}
    while max_rounds is None or rounds < max_rounds:
        rounds += 1
        grown = expand(rules_to_df(fb.spark, beam), fb.schema, max_vars, max_literals)
        fresh = [
            Clause(c.literals, clause_id=c.text)
            for c in collect_rules(grown.withColumnRenamed("text", "clause_id"))
            if canonical_form(c.literals) not in seen
        ]
        if not fresh:
            break
        seen |= {canonical_form(c.literals) for c in fresh}
        scored = score_candidates(fresh, with_weights(theory, fit), fb, penalty, prior_std)
        ok = scored.filter((scored.gain > min_gain) & (F.abs(scored.weight) >= min_weight))
        top = ok.orderBy(scored.gain.desc(), "clause_id").limit(beam_size).collect()
        by_id = {c.clause_id: c for c in fresh}
        if not top:
            break
        beam = [by_id[r["clause_id"]] for r in top]
        theory = theory + [beam[0]]
        fit = fit_weights(theory, fb, prior_std=prior_std, equal_predicates=True)
        trace.append((beam[0].clause_id, top[0]["gain"], True))
    result = Theory(with_weights(theory, fit), fit.value, trace)
    if prune_after:
        pruned = prune(result.clauses, fb, penalty, prior_std)
        return Theory(pruned.clauses, pruned.score, result.trace + pruned.trace)
    return result


def clique_combinations(rules: DataFrame, size: int, per_clique: int) -> DataFrame:
    """Combinations of ``size`` second-order groups, each contributing up to ``per_clique`` instances.

    ``rules`` is ``template_id, clause_id, score``; the best instances of each template are numbered,
    then index-ordered template tuples are formed.  Rule lists are small; the join is on the number
    of instances taken, not on facts.
    """
    w = W.partitionBy("template_id").orderBy(F.col("score").desc(), "clause_id")
    top = rules.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= per_clique)
    groups = top.groupBy("template_id").agg(F.array_sort(F.collect_list("clause_id")).alias("members"))
    names = F.array_sort(F.collect_list(F.struct("template_id", "members")))
    row = groups.agg(names.alias("g"))
    for i in range(size):
        start = F.lit(0) if i == 0 else F.col(f"i{i - 1}") + 1
        seq = F.when(start < F.size("g"), F.sequence(start, F.size("g") - 1)).otherwise(F.array().cast("array<int>"))
        row = row.withColumn(f"i{i}", F.explode(seq))
    picked = [F.get("g", F.col(f"i{i}")) for i in range(size)]
    return row.select(
        F.array(*[p["template_id"] for p in picked]).alias("templates"),
        F.flatten(F.array(*[p["members"] for p in picked])).alias("clauses"),
    )
