"""Signature tables of blocks: atoms that differ in an exclusive argument only, of which exactly one is true.

A block's conditional likelihood is a softmax over its alternatives. With at most one literal of the predicate in a rule, the
gain of an alternative (true minus false, in true groundings) does not depend on which one holds, so a block is its
free arguments' factor values, the alternative observed, and the alternatives with counts of their own. Blocks that agree in these
are one row with a multiplicity; alternatives of one factor class are one row with a size. Blocks are listed facts, so no
product of free arguments is formed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..facts import FactBase, union_all
from ..rules import Clause
from .atom_counts import atom_counts
from .counting import EXACT
from .local import small_table
from .signatures import FACTOR, SALTS, SIG, merge_entries
from .storage import cut

BLOCKS_DDL = f"problem string, fold int, pred string, block string, chosen boolean, sig {SIG}, size double, mult double"


def free_args(fb: FactBase, pred: str) -> list[int]:
    decl = fb.schema[pred]
    if not decl.exclusive_args:
        raise ValueError(f"{pred} has no exclusive argument")
    return [i for i in range(decl.arity) if i not in decl.exclusive_args]


def broken_blocks(fb: FactBase, pred: str) -> dict[int, tuple[int, int]]:
    """Per fold: blocks with more than one true atom, and blocks with none (by the number of possible blocks)."""
    free = free_args(fb, pred)
    cols = [f"a{i}" for i in free]
    found = {
        r["fold"]: (r["more"], r["seen"])
        for r in fb.relation(pred).groupBy("fold", *cols).agg(F.count(F.lit(1)).alias("n")).groupBy("fold")
        .agg(F.sum((F.col("n") > 1).cast("bigint")).alias("more"), F.count(F.lit(1)).alias("seen")).collect()
    }
    out = {}
    for f in fb.folds():
        possible = 1
        for i in free:
            possible *= fb.size(f, fb.schema[pred].types[i])
        more, seen = found.get(f, (0, 0))
        if more or seen < possible:
            out[f] = (more, possible - seen)
    return out


def block_signatures(problems: dict[str, list[Clause]], fb: FactBase, pred: str) -> DataFrame:
    """``problem, fold, pred, block, chosen, sig, size, mult``: the alternatives of every kind of block.

    ``sig`` has what an alternative adds to the true groundings of each clause, ``size`` how many alternatives of the block
    share it, ``mult`` how many blocks there are of the kind; ``chosen`` marks the true one. Every block must have exactly one true
    atom, and a rule at most one literal of the predicate.
    """
    decl, arity = fb.schema[pred], fb.schema[pred].arity
    free, bound = free_args(fb, pred), list(decl.exclusive_args)
    if broken := broken_blocks(fb, pred):
        raise ValueError(f"blocks of {pred} without exactly one true atom, by fold (more than one, none): {broken}")
    rules: dict[str, Clause] = {}
    owners: dict[str, list[str]] = {}
    for name, clauses in problems.items():
        for c in clauses:
            uses = sum(l.pred == pred for l in c.literals)
            if uses > 1:
                raise ValueError(f"{c.clause_id}: two literals of {pred} may be of one block")
            if uses:
                rules.setdefault(c.clause_id, c)
                owners.setdefault(c.clause_id, []).append(name)
    names, folds = sorted(problems), fb.folds()
    cols, fx = [f"a{i}" for i in range(arity)], [f"f{i}" for i in range(arity)]
    free_cols, free_fx, bound_fx = [cols[i] for i in free], [fx[i] for i in free], [fx[i] for i in bound]
    none, no_factor = F.array().cast(SIG), F.array().cast(FACTOR)
    ac = atom_counts(list(rules.values()), pred, fb) if rules else None
    owner_rows = [(c, n) for c, ns in owners.items() for n in ns]
    owner = F.broadcast(small_table(fb.spark, owner_rows, "clause_id string, problem string"))  # rules of the call
    key = ["problem", "fold"]

    def entries(df: DataFrame, sign: int) -> DataFrame:
        entry = F.struct("clause_id", (sign * F.col("n").cast("double")).alias("n"))
        return df.join(owner, "clause_id").groupBy(*key, *cols).agg(F.array_sort(F.collect_list(entry)).cast(SIG).alias("own"))

    # factor values by position; the terms of each problem as one small array
    by_pos: dict[int, DataFrame] = {}
    for i in {i for t in (ac.terms if ac else []) for i in t.args}:
        by_pos[i] = (
            ac.single.filter(F.col("pos") == i).join(owner, "clause_id").groupBy(*key, "const")
            .agg(F.array_sort(F.collect_list(F.struct("term_id", F.col("n").cast("double").alias("n")))).cast(FACTOR).alias(fx[i]))
        )
    term_rows = {(n, f): [] for n in names for f in folds}
    for t in ac.terms if ac else []:
        for n in owners[t.clause_id]:
            for f in folds:
                term_rows[n, f].append((t.term_id, t.clause_id, [i in t.args for i in range(arity)], float(t.coef[f])))
    terms = F.broadcast(small_table(
        fb.spark, [(*k, v) for k, v in term_rows.items()],
        "problem string, fold int, terms array<struct<term_id:int,clause_id:string,uses:array<boolean>,coef:double>>",
    ))
    factors = " * ".join(
        f"if(t.uses[{i}], coalesce(get(filter({fx[i]}, e -> e.term_id = t.term_id), 0).n, 0D), 1D)" for i in range(arity)
    )
    vector = f"transform(terms, t -> named_struct('clause_id', t.clause_id, 'n', t.coef * {factors}))"

    def with_factors(df: DataFrame, positions: list[int]) -> DataFrame:
        for i in positions:
            if i in by_pos:
                df = df.join(by_pos[i].withColumnRenamed("const", cols[i]), key + [cols[i]], "left").withColumn(
                    fx[i], F.coalesce(fx[i], no_factor))
            else:
                df = df.withColumn(fx[i], no_factor)
        return df

    # one row per kind of block
    rel = fb.relation(pred)
    seen = rel.withColumn("problem", F.explode(F.array(*[F.lit(n) for n in names])))
    if ac is not None and ac.listed is not None:
        seen = seen.join(entries(ac.listed, -1), key + cols, "left").withColumn("own", F.coalesce("own", none))
    else:
        seen = seen.withColumn("own", none)
    odd_type = f"array<struct<{', '.join(f'{c}: {FACTOR}' for c in bound_fx)}, own: {SIG}, c: bigint>>"
    seen = with_factors(seen, list(range(arity)))
    if ac is not None and ac.joint is not None:
        odd = with_factors(entries(ac.joint.join(rel, ["fold"] + cols, "left_anti"), 1), bound)
        odd = odd.groupBy(*key, *free_cols, *bound_fx, "own").agg(F.count(F.lit(1)).alias("c"))
        odd = odd.groupBy(*key, *free_cols).agg(F.array_sort(F.collect_list(F.struct(*bound_fx, "own", "c"))).cast(odd_type).alias("odd"))
        seen = seen.join(odd, key + free_cols, "left").withColumn("odd", F.coalesce("odd", F.array().cast(odd_type)))
    else:
        seen = seen.withColumn("odd", F.array().cast(odd_type))
    shape = [*key, *fx, "own", "odd"]
    kinds = cut(
        seen.groupBy(*shape).agg(F.count(F.lit(1)).cast("double").alias("mult"))
        .withColumn("block", F.sha2(F.to_json(F.struct(*shape)), 256))
    )

    # classes of the exclusive arguments' constants with their sizes
    classes = None
    for i in bound:
        type_ = decl.types[i]
        total = small_table(fb.spark, [(n, f, str(fb.size(f, type_))) for n in names for f in folds], "problem string, fold int, d string")
        total = total.withColumn("d", F.col("d").cast(EXACT))
        if i in by_pos:
            groups = by_pos[i].groupBy(*key, fx[i]).agg(F.count(F.lit(1)).cast(EXACT).alias("m"))
            known = groups.groupBy(*key).agg(F.sum("m").cast(EXACT).alias("s"))
            rest = total.join(known, key, "left").select(
                *key, no_factor.alias(fx[i]), (F.col("d") - F.coalesce("s", F.lit(0).cast(EXACT))).cast(EXACT).alias("m"))
            sizes = groups.unionByName(rest).filter("m > 0")
        else:
            sizes = total.select(*key, no_factor.alias(fx[i]), F.col("d").alias("m"))
        if classes is None:
            classes = sizes
        else:
            classes = classes.join(sizes.withColumnRenamed("m", "m2"), key).withColumn("m", (F.col("m") * F.col("m2")).cast(EXACT)).drop("m2")

    # alternatives: every class, less the one observed and those with counts of their own
    salted = kinds.select("block", "mult", *key, *free_fx).withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(SALTS)).cast("int"))
    every = salted.join(classes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), key + ["salt"]).drop("salt")
    apart = kinds.select("block", F.explode("odd").alias("o")).select("block", *[F.col(f"o.{c}") for c in bound_fx], F.col("o.c").alias("c"))
    gone = apart.unionByName(kinds.select("block", *bound_fx, F.lit(1).cast("bigint").alias("c"))).groupBy("block", *bound_fx).agg(
        F.sum("c").cast(EXACT).alias("gone"))
    usual = (
        every.join(gone, ["block"] + bound_fx, "left")
        .withColumn("size", (F.col("m") - F.coalesce("gone", F.lit(0).cast(EXACT))).cast("double")).filter("size > 0")
        .join(terms, key).withColumn("entries", F.expr(vector))
        .select(*key, "block", F.lit(False).alias("chosen"), merge_entries("entries").cast(SIG).alias("sig"), "size", "mult")
    )
    own = kinds.select(*key, "block", "mult", *free_fx, F.explode("odd").alias("o")).select(
        *key, "block", "mult", *free_fx, *[F.col(f"o.{c}").alias(c) for c in bound_fx], F.col("o.own").alias("own"), F.col("o.c").cast("double").alias("size")
    ).join(terms, key).withColumn("entries", F.expr(f"concat({vector}, own)")).select(
        *key, "block", F.lit(False).alias("chosen"), merge_entries("entries").cast(SIG).alias("sig"), "size", "mult"
    )
    held = kinds.select(*key, "block", F.lit(True).alias("chosen"), F.col("own").cast(SIG).alias("sig"), F.lit(1.0).alias("size"), "mult")
    out = union_all([usual, own, held]).groupBy(*key, "block", "chosen", "sig").agg(F.sum("size").alias("size"), F.first("mult").alias("mult"))
    return out.select(*key[:2], F.lit(pred).alias("pred"), "block", "chosen", "sig", "size", "mult")
