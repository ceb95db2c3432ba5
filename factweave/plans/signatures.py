"""Compressed signature tables for pseudo-likelihood.

Atoms with the same truth value and the same count vector contribute the same term, so the table
holds one row per (problem, fold, predicate, truth, vector) with a multiplicity.  Several theories
("problems") share one job; a candidate clause is one problem.

Absent atoms are never listed.  Constants of each argument are grouped into classes by their factor
values; a class combination stands for the product of the class sizes, minus the atoms that are
listed facts or have an explicit count row, which are handled one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .local import small_table
from ..facts import FactBase, union_all
from ..rules import Clause, plain_only
from .atom_counts import AtomCounts, atom_counts, counts_for_atoms
from .counting import EXACT

SIG = "array<struct<clause_id:string,n:double>>"
SIGNATURES_DDL = f"problem string, fold int, pred string, truth boolean, sig {SIG}, mult double"
FACTOR = "array<struct<term_id:int,n:double>>"
SALTS = 16


def merge_entries(entries: str) -> Column:
    """Sum ``struct(clause_id, n)`` entries (an SQL array expression) per clause: zeros dropped, in clause order."""
    return F.expr(
        f"filter(transform(array_sort(array_distinct(transform({entries}, e -> e.clause_id))), c -> named_struct("
        f"'clause_id', c, 'n', aggregate(filter({entries}, e -> e.clause_id = c), 0D, (acc, e) -> acc + e.n))), e -> e.n <> 0)"
    )


def _local(fb: FactBase, rows: list, ddl: str) -> DataFrame:
    return small_table(fb.spark, rows, ddl)


def signatures(problems: dict[str, list[Clause]], fb: FactBase, preds: list[str] | None = None) -> DataFrame:
    """``problem, fold, pred, truth, sig, mult`` covering every possible atom of every predicate."""
    plain_only([c for cs in problems.values() for c in cs], "a signature table")
    preds = preds or [p.name for p in fb.schema]
    parts = []
    for pred in preds:
        owners: dict[str, list[str]] = {}
        rules: dict[str, Clause] = {}
        for name, clauses in problems.items():
            for c in clauses:
                if not c.is_unit() and any(l.pred == pred for l in c.literals):
                    owners.setdefault(c.clause_id, []).append(name)
                    rules.setdefault(c.clause_id, c)
        ac = atom_counts(list(rules.values()), pred, fb) if rules else None
        df = _pred_signatures(problems, pred, fb, ac, owners)
        units = {
            name: [c.clause_id for c in clauses if c.is_unit() and c.literals[0].pred == pred]
            for name, clauses in problems.items()
        }
        signs = {c.clause_id: c.literals[0].positive for cs in problems.values() for c in cs if c.is_unit()}
        rows = [(n, [(u, 1.0 if signs[u] else -1.0) for u in us]) for n, us in units.items() if us]
        if rows:
            u = _local(fb, rows, f"problem string, units {SIG}")
            flip = F.when(F.col("truth"), -1.0).otherwise(1.0)
            extra = F.transform(
                F.coalesce("units", F.array().cast(SIG)),
                lambda e: F.struct(e["clause_id"].alias("clause_id"), (e["n"] * flip).alias("n")),
            )
            df = df.join(F.broadcast(u), "problem", "left").withColumn("sig", F.concat("sig", extra)).drop("units")
        parts.append(df.select("problem", "fold", F.lit(pred).alias("pred"), "truth", "sig", "mult"))
    return union_all(parts)


def _pred_signatures(
    problems: dict[str, list[Clause]], pred: str, fb: FactBase, ac: AtomCounts | None, owners: dict[str, list[str]]
) -> DataFrame:
    folds = fb.folds()
    true_total = {f: fb.true_totals().get((f, pred), 0) for f in folds}
    possible = {f: fb.possible(f, pred) for f in folds}
    empty = F.array().cast(SIG)
    out: list[DataFrame] = []
    busy = {n for ns in owners.values() for n in ns}
    idle_rows = []
    for name in problems:
        for f in folds:
            if name not in busy:
                idle_rows.append((name, f, True, [], float(true_total[f])))
                idle_rows.append((name, f, False, [], float(possible[f] - true_total[f])))
    ddl = f"problem string, fold int, truth boolean, sig {SIG}, mult double"
    if idle_rows:
        out.append(_local(fb, idle_rows, ddl).filter("mult > 0"))
    if ac is None or not busy:
        return union_all(out)
    owner_df = F.broadcast(
        _local(fb, [(c, n) for c, ns in owners.items() for n in ns], "clause_id string, problem string")
    )
    cols = ac.arg_cols()
    atom_key = ["problem", "fold"] + cols
    busy_folds = _local(
        fb, [(n, f, str(true_total[f])) for n in sorted(busy) for f in folds], "problem string, fold int, total string"
    )

    # Listed-true atoms: rows with a non-zero vector, then the remainder by subtraction.
    entry = F.struct(F.col("clause_id"), F.col("n").cast("double").alias("n"))
    if ac.listed is not None:
        per_atom = (
            ac.listed.join(owner_df, "clause_id").groupBy(*atom_key)
            .agg(F.array_sort(F.collect_list(entry)).cast(SIG).alias("sig"))
        )
        true_sig = per_atom.groupBy("problem", "fold", "sig").agg(F.count(F.lit(1)).cast(EXACT).alias("c"))
        used = true_sig.groupBy("problem", "fold").agg(F.sum("c").cast(EXACT).alias("used"))
        out.append(true_sig.select("problem", "fold", F.lit(True).alias("truth"), "sig", F.col("c").cast("double").alias("mult")))
        rest = busy_folds.join(used, ["problem", "fold"], "left")
    else:
        rest = busy_folds.withColumn("used", F.lit(None).cast(EXACT))
    left = F.col("total").cast(EXACT) - F.coalesce("used", F.lit(0).cast(EXACT))
    out.append(
        rest.select("problem", "fold", F.lit(True).alias("truth"), empty.alias("sig"), left.cast("double").alias("mult"))
        .filter("mult > 0")
    )
    out.append(_absent(pred, fb, ac, owners, owner_df, busy, true_total))
    return union_all(out)


def _absent(pred, fb, ac, owners, owner_df, busy, true_total) -> DataFrame:
    arity, cols, folds = ac.arity, ac.arg_cols(), fb.folds()
    fx = [f"f{i}" for i in range(arity)]
    no_factor = F.array().cast(FACTOR)

    # Product terms of each problem as one small array per (problem, fold).
    term_rows: dict[tuple[str, int], list] = {}
    factored: set[str] = set()
    for t in ac.terms:
        for name in owners[t.clause_id]:
            if t.args:
                factored.add(name)
            for f in folds:
                term_rows.setdefault((name, f), []).append(
                    (t.term_id, t.clause_id, [i in t.args for i in range(arity)], float(t.coef[f]))
                )
    terms = F.broadcast(
        _local(
            fb,
            [(n, f, term_rows.get((n, f), [])) for n in sorted(busy) for f in folds],
            "problem string, fold int, "
            "terms array<struct<term_id:int,clause_id:string,uses:array<boolean>,coef:double>>",
        )
    )

    # Count vector of an atom whose argument classes are in f0, f1, ...
    factors = " * ".join(
        f"if(t.uses[{i}], coalesce(get(filter({fx[i]}, e -> e.term_id = t.term_id), 0).n, 0D), 1D)" for i in range(arity)
    )
    vector = f"transform(terms, t -> named_struct('clause_id', t.clause_id, 'n', t.coef * {factors}))"

    # Factor values per constant, one column per argument position.
    by_pos: list[DataFrame | None] = [None] * arity
    if ac.single is not None:
        positions = {i for t in ac.terms for i in t.args}
        for i in positions:
            by_pos[i] = (
                ac.single.filter(F.col("pos") == i).join(owner_df, "clause_id")
                .groupBy("problem", "fold", "const")
                .agg(
                    F.array_sort(F.collect_list(F.struct("term_id", F.col("n").cast("double").alias("n"))))
                    .cast(FACTOR).alias(fx[i])
                )
            )

    # Atoms to take out of the class products: listed facts and explicit count rows.
    key = ["problem", "fold"] + cols
    rel = fb.relation(pred)
    explicit = None
    if ac.joint is not None:
        entry = F.struct(F.col("clause_id"), F.col("n").cast("double").alias("n"))
        explicit = (
            ac.joint.join(owner_df, "clause_id")
            .join(rel, ["fold"] + cols, "left_anti")
            .groupBy(*key).agg(F.collect_list(entry).cast(SIG).alias("jsig"))
            .withColumn("absent", F.lit(True))
        )
    factored_rows = (
        rel.withColumn("problem", F.explode(F.array(*[F.lit(n) for n in sorted(factored)])))
        .select(*key, F.array().cast(SIG).alias("jsig"), F.lit(False).alias("absent"))
        if factored else None
    )
    rows = [d for d in (explicit, factored_rows) if d is not None]
    out: list[DataFrame] = []
    taken: list[DataFrame] = []
    plain = sorted(busy - factored)
    if plain:  # no per-argument factors: listed facts only matter as a total
        taken.append(
            _local(fb, [(n, f, float(true_total[f])) for n in plain for f in folds], "problem string, fold int, c double")
            .select("problem", "fold", *[no_factor.alias(c) for c in fx], F.col("c").cast(EXACT).alias("c"))
        )
    if rows:
        classed = union_all(rows)
        for i in range(arity):
            if by_pos[i] is None:
                classed = classed.withColumn(fx[i], no_factor)
            else:
                classed = classed.join(
                    by_pos[i].withColumnRenamed("const", cols[i]), ["problem", "fold", cols[i]], "left"
                ).withColumn(fx[i], F.coalesce(fx[i], no_factor))
        # One row per distinct combination before any vector is computed.
        classed = classed.groupBy("problem", "fold", "absent", "jsig", *fx).agg(F.count(F.lit(1)).cast(EXACT).alias("c"))
        taken.append(classed.select("problem", "fold", *fx, "c"))
        if explicit is not None:
            out.append(
                classed.filter("absent").join(terms, ["problem", "fold"])
                .withColumn("entries", F.expr(f"concat({vector}, jsig)"))
                .select("problem", "fold", merge_entries("entries").alias("sig"), "c")
            )

    # Class sizes per argument, with the class of constants that have no factor rows.
    product = None
    for i, type_ in enumerate(fb.schema[pred].types):
        base = _local(
            fb, [(n, f, str(fb.size(f, type_))) for n in sorted(busy) for f in folds], "problem string, fold int, d string"
        ).withColumn("d", F.col("d").cast(EXACT))
        if by_pos[i] is None:
            sizes = base.select("problem", "fold", no_factor.alias(fx[i]), F.col("d").alias("m"))
        else:
            groups = by_pos[i].groupBy("problem", "fold", fx[i]).agg(F.count(F.lit(1)).cast(EXACT).alias("m"))
            covered = groups.groupBy("problem", "fold").agg(F.sum("m").cast(EXACT).alias("s"))
            default = base.join(covered, ["problem", "fold"], "left").select(
                "problem", "fold", no_factor.alias(fx[i]),
                (F.col("d") - F.coalesce("s", F.lit(0).cast(EXACT))).cast(EXACT).alias("m"),
            )
            sizes = groups.unionByName(default).filter("m > 0")
        if product is None:
            product = sizes.withColumnRenamed("m", "mult")
        else:
            # Every class meets every class of its problem and fold; salted so that one large
            # problem is spread over tasks.
            left = product.withColumn("salt", F.pmod(F.xxhash64(*[F.col(c) for c in fx[:i]]), F.lit(SALTS)).cast("int"))
            right = sizes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            product = left.join(right, ["problem", "fold", "salt"]).select(
                "problem", "fold", *fx[: i + 1], (F.col("mult") * F.col("m")).cast(EXACT).alias("mult")
            )
    gone = union_all(taken).groupBy("problem", "fold", *fx).agg(F.sum("c").cast(EXACT).alias("gone"))
    remaining = (
        product.join(gone, ["problem", "fold"] + fx, "left")
        .withColumn("c", (F.col("mult") - F.coalesce("gone", F.lit(0).cast(EXACT))).cast(EXACT))
        .filter("c > 0")
        .join(terms, ["problem", "fold"])
        .withColumn("entries", F.expr(vector))
        .select("problem", "fold", merge_entries("entries").alias("sig"), "c")
    )
    out.append(remaining)
    return (
        union_all(out).groupBy("problem", "fold", "sig").agg(F.sum("c").cast("double").alias("mult"))
        .select("problem", "fold", F.lit(False).alias("truth"), F.col("sig").cast(SIG).alias("sig"), "mult")
    )


def sampled_signatures(
    problems: dict[str, list[Clause]], fb: FactBase, fraction: float, low: int, high: int, seed: int,
    preds: list[str] | None = None,
) -> DataFrame:
    """Signature table from stratified atom samples: each stratum is scaled by total / sampled.

    For theories whose exact table would be too large; sample size is clamp(fraction * N, low, high)
    for the listed and the absent atoms of every predicate.
    """
    from ..operators.facts_ops import sample_atoms

    plain_only([c for cs in problems.values() for c in cs], "a signature table")
    parts = []
    for pred in preds or [p.name for p in fb.schema]:
        cols = [f"a{i}" for i in range(fb.schema[pred].arity)]
        key = ["fold"] + cols
        sample = sample_atoms(fb, pred, fraction, low, high, seed)
        rules = {c.clause_id: c for cs in problems.values() for c in cs if any(l.pred == pred for l in c.literals)}
        everyone = sample.withColumn("problem", F.explode(F.array(*[F.lit(p) for p in sorted(problems)])))
        owners = [(c.clause_id, name) for name, cs in problems.items() for c in cs if c.clause_id in rules]
        if not rules:
            sig = everyone.withColumn("sig", F.array().cast(SIG))
        else:
            counts = counts_for_atoms(atom_counts(list(rules.values()), pred, fb), sample)
            owner_df = F.broadcast(_local(fb, owners, "clause_id string, problem string"))
            entry = F.struct(F.col("clause_id"), F.col("n").cast("double").alias("n"))
            per_atom = counts.join(owner_df, "clause_id").groupBy("problem", *key).agg(
                F.array_sort(F.collect_list(entry)).cast(SIG).alias("sig")
            )
            sig = everyone.join(per_atom, ["problem"] + key, "left").withColumn(
                "sig", F.coalesce("sig", F.array().cast(SIG))
            )
        parts.append(
            sig.groupBy("problem", "fold", F.lit(pred).alias("pred"), "truth", "sig").agg(F.sum("scale").alias("mult"))
        )
    return union_all(parts)
