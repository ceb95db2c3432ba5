"""Cleaning, splitting, profiling and sampling of fact tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..plans.local import small_table
from ..facts import FactBase, union_all
from ..plans.blocks import free_args
from ..plans.counting import EXACT
from ..plans.ordering import hashed_positions
from ..plans.storage import cut

FACT_KEY = ["fold", "pred", "args"]


def dedupe_facts(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Facts without duplicates, and a report ``fold, pred, args, n`` of those listed more than once."""
    counts = facts.groupBy(*FACT_KEY, "truth").agg(F.count(F.lit(1)).alias("n"))
    return counts.drop("n"), counts.filter("n > 1").select(*FACT_KEY, "n")


def capitalise(c: Column) -> Column:
    """First letter up, rest down."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substr(c, F.lit(2))))


def normalise_constants(facts: DataFrame) -> DataFrame:
    return facts.withColumns(
        {"pred": capitalise(F.col("pred")), "args": F.transform("args", capitalise)}
    )


def clean_facts(facts: DataFrame, rules: DataFrame, max_arity: int = 2) -> DataFrame:
    """Apply a per-relation cleaning table, then capitalise.

    ``rules`` has one row per relation: ``pred, action, new_pred, prefix0, prefix1`` with action
    ``drop`` (remove), ``rename_value`` (relation becomes the last argument of ``new_pred``),
    ``last_two`` (keep the last two of three arguments), ``prefix`` (prepend to arguments 0 and 1) or
    ``quote`` (second argument lower-cased, whatever else is done).  Longer facts are removed.
    """
    r = rules.select(F.lower("pred").alias("@p"), "action", "new_pred", "prefix0", "prefix1")
    rows = facts.join(r, F.lower("pred") == F.col("@p"), "left").filter(
        F.col("action").isNull() | (F.col("action") != "drop")
    )
    cap = F.transform("args", capitalise)
    action = F.coalesce("action", F.lit(""))
    args = (
        F.when(action == "rename_value", F.concat(cap, F.array(capitalise(F.col("pred")))))
        .when((action == "last_two") & (F.size("args") == 3), F.slice(cap, 2, 2))
        .when(
            action == "prefix",
            F.transform(
                cap,
                lambda a, i: F.concat(
                    F.when(i == 0, F.coalesce("prefix0", F.lit("")))
                    .when(i == 1, F.coalesce("prefix1", F.lit(""))).otherwise(""), a
                ),
            ),
        )
        .when(action == "quote", F.transform(cap, lambda a, i: F.when(i == 1, F.lower(a)).otherwise(a)))
        .otherwise(cap)
    )
    pred = F.when(action == "rename_value", F.col("new_pred")).otherwise(capitalise(F.col("pred")))
    return rows.select("fold", pred.alias("pred"), args.alias("args"), "truth").filter(F.size("args") <= max_arity)


def keep_predicates(facts: DataFrame, names: list[str]) -> DataFrame:
    """Only relations in the accept list; blanks and underscores in the list are ignored."""
    accepted = [n.replace(" ", "").replace("_", "") for n in names]
    return facts.filter(F.regexp_replace("pred", "[ _]", "").isin(accepted))


def split_target(facts: DataFrame, target: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(background, positives, negatives) for one target relation."""
    is_target = F.lower("pred") == target.lower()
    return (
        facts.filter(~is_target & (F.col("truth") == "true")),
        facts.filter(is_target & (F.col("truth") == "true")),
        facts.filter(is_target & (F.col("truth") == "false")),
    )


def truth(atoms: DataFrame, fb: FactBase, pred: str) -> DataFrame:
    """Three-valued lookup of atoms ``fold, a0, ...`` of one predicate.

    Listed atoms are true; an unlisted atom is false, unless the predicate is open-world and the
    atom is not listed as false, which makes it unknown.
    """
    key = ["fold"] + [f"a{i}" for i in range(fb.schema[pred].arity)]
    out = atoms.join(fb.relation(pred).withColumn("@t", F.lit(True)), key, "left")
    if pred not in fb.open_world:
        return out.withColumn("truth", F.when(F.col("@t"), "true").otherwise("false")).drop("@t")
    out = out.join(fb.relation(pred, "false").withColumn("@f", F.lit(True)), key, "left")
    value = F.when(F.col("@t"), "true").when(F.col("@f"), "false").otherwise("unknown")
    return out.withColumn("truth", value).drop("@t", "@f")


def world(fb: FactBase, open_preds=(), closed=(), query=()) -> DataFrame:
    """``pred, open``: query predicates are open, the rest closed unless said otherwise."""
    rows = [
        (p.name, (p.name in set(open_preds) | set(query)) and p.name not in set(closed)) for p in fb.schema
    ]
    return small_table(fb.spark, rows, "pred string, open boolean")


def domains(fb: FactBase) -> DataFrame:
    """``fold, type, n``: number of constants per type."""
    return fb.constants().groupBy("fold", "type").agg(F.count(F.lit(1)).alias("n"))


def predicate_groundings(fb: FactBase) -> DataFrame:
    """``fold, pred, n_possible``: product of the argument domains, computed from the constant table."""
    sizes = domains(fb)
    args = small_table(fb.spark,
        [(p.name, i, t) for p in fb.schema for i, t in enumerate(p.types)], "pred string, arg_pos int, type string"
    )
    per_arg = sizes.join(F.broadcast(args), "type").groupBy("fold", "pred").agg(
        F.array_sort(F.collect_list(F.struct("arg_pos", "n"))).alias("ns")
    )
    one = F.lit(1).cast(EXACT)
    return per_arg.select(
        "fold", "pred", F.aggregate("ns", one, lambda acc, x: (acc * x["n"]).cast(EXACT)).alias("n_possible")
    )


def atom_totals(fb: FactBase) -> DataFrame:
    """``fold, pred, n_true, n_false, n_unknown`` over all possible atoms."""
    parts = []
    for p in fb.schema:
        cols = [f"a{i}" for i in range(p.arity)]
        parts.append(fb.relation(p.name).select("fold", F.lit(p.name).alias("pred"), F.lit(1).alias("t"), F.lit(0).alias("f")))
        if p.name in fb.open_world:
            listed_false = fb.relation(p.name, "false").join(fb.relation(p.name), ["fold"] + cols, "left_anti")
            parts.append(listed_false.select("fold", F.lit(p.name).alias("pred"), F.lit(0).alias("t"), F.lit(1).alias("f")))
    sums = union_all(parts).groupBy("fold", "pred").agg(F.sum("t").alias("t"), F.sum("f").alias("f"))
    t = F.coalesce("t", F.lit(0)).cast(EXACT)
    f = F.coalesce("f", F.lit(0)).cast(EXACT)
    rest = F.col("n_possible") - t
    is_open = F.col("pred").isin(sorted(fb.open_world))
    return predicate_groundings(fb).join(sums, ["fold", "pred"], "left").select(
        "fold", "pred", t.alias("n_true"),
        F.when(is_open, f).otherwise(rest).cast(EXACT).alias("n_false"),
        F.when(is_open, rest - f).otherwise(F.lit(0)).cast(EXACT).alias("n_unknown"),
    )


def profile(fb: FactBase) -> DataFrame:
    """``fold, pred, n_facts, n_distinct_0, n_distinct_1``: relation sizes and distinct constants."""
    parts = []
    for p in fb.schema:
        rel = fb.relation(p.name)
        aggs = [F.count(F.lit(1)).alias("n_facts")]
        aggs += [F.count_distinct(f"a{i}").alias(f"n_distinct_{i}") for i in range(min(2, p.arity))]
        df = rel.groupBy("fold").agg(*aggs).withColumn("pred", F.lit(p.name))
        for i in range(p.arity, 2):
            df = df.withColumn(f"n_distinct_{i}", F.lit(None).cast("bigint"))
        parts.append(df)
    return union_all(parts).select("fold", "pred", "n_facts", "n_distinct_0", "n_distinct_1")


def objects(facts: DataFrame, pred: str) -> DataFrame:
    """Distinct second-argument constants of a relation."""
    return facts.filter((F.col("pred") == pred) & (F.size("args") > 1)).select(F.col("args")[1].alias("object")).distinct()


def split_folds(df: DataFrame, key: list[str], k: int, seed: int) -> DataFrame:
    """Blocks of ceil(n / k) rows after a seeded shuffle; adds ``fold``."""
    n = df.agg(F.count(F.lit(1)).alias("@n"))
    size = F.ceil(F.col("@n") / k)
    return (
        hashed_positions(df, [], key, seed, "@pos").join(F.broadcast(n))
        .withColumn("fold", F.floor((F.col("@pos") - 1) / size).cast("int")).drop("@pos", "@n")
    )


def balance_negatives(negatives: DataFrame, key: list[str], size: int, seed: int) -> DataFrame:
    """A seeded shuffle of the listed negatives, of which ``size`` are kept."""
    return hashed_positions(negatives, [], key, seed, "@pos").filter(F.col("@pos") <= size).drop("@pos")


def generate_negatives(positives: DataFrame, amount: int = 1, seed: int = 0, tries: int = 10) -> DataFrame:
    """``fold, a0, a1, copy``: for each positive (s, o), ``amount`` objects not linked to s.

    Objects are drawn uniformly from the distinct objects of the relation; a draw linked to s is
    repeated, up to ``tries`` times, after which that copy is given up.
    """
    objects_ = positives.select("fold", F.col("a1").alias("o")).distinct()
    numbered = hashed_positions(objects_, ["fold"], ["o"], seed, "pos")
    sizes = objects_.groupBy("fold").agg(F.count(F.lit(1)).alias("n_objects"))  # one row per fold
    draws = (
        positives.select("fold", "a0", "a1").join(F.broadcast(sizes), "fold")
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(amount))))
        .withColumn("attempt", F.explode(F.sequence(F.lit(1), F.lit(tries))))
        .withColumn("pos", F.pmod(F.xxhash64(F.lit(seed), "fold", "a0", "a1", "copy", "attempt"), F.col("n_objects")) + 1)
    )
    linked = positives.select("fold", "a0", F.col("a1").alias("o"))
    return (
        draws.join(numbered, ["fold", "pos"])
        .join(linked, ["fold", "a0", "o"], "left_anti")
        .groupBy("fold", "a0", "a1", "copy").agg(F.min_by("o", "attempt").alias("o"))
        .select("fold", "a0", F.col("o").alias("a1"), "copy")
    )


def kfold(facts: DataFrame, fold: int, mode: str = "rest") -> tuple[DataFrame, DataFrame]:
    """(train, test): ``rest`` trains on all other folds, ``single`` trains on this fold only."""
    here = F.col("fold") == fold
    return (facts.filter(~here), facts.filter(here)) if mode == "rest" else (facts.filter(here), facts.filter(~here))


def group_folds(facts: DataFrame, folds: list[int]) -> DataFrame:
    return facts.filter(F.col("fold").isin(folds))


def union_predictions(dfs: list[DataFrame]) -> DataFrame:
    return union_all(dfs).distinct()


def mega_example_folds(background: DataFrame, positives: DataFrame, k: int, seed: int) -> DataFrame:
    """One-example datasets: the whole background in every fold, positives dealt to folds."""
    everywhere = background.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    dealt = split_folds(positives.drop("fold"), ["pred", "args"], k, seed)
    return everywhere.select(*FACT_KEY, "truth").unionByName(dealt.select(*FACT_KEY, "truth"))


def blocks(fb: FactBase, pred: str) -> DataFrame:
    """``fold, <free args>, n_true``: true atoms per block of an exclusive argument.

    With one free argument blocks without any true atom are listed too, from its constant table. With several only blocks that
    hold a fact are listed; the others are counted by ``block_totals``, never listed.
    """
    free = free_args(fb, pred)
    cols = [f"a{i}" for i in free]
    counts = fb.relation(pred).groupBy("fold", *cols).agg(F.count(F.lit(1)).cast("bigint").alias("n_true"))
    if len(free) != 1:
        return counts
    owners = fb.constants_of(fb.schema[pred].types[free[0]]).select("fold", F.col("const").alias(cols[0]))
    return owners.join(counts, ["fold", *cols], "left").select("fold", *cols, F.coalesce("n_true", F.lit(0)).cast("bigint").alias("n_true"))


def block_totals(fb: FactBase, pred: str) -> DataFrame:
    """``fold, possible, one, more, none``: blocks by their number of true atoms.

    Possible blocks are the product of the free arguments' domain sizes; those without a true atom are what is left
    after the observed ones, so a product of constants is never formed.
    """
    free = free_args(fb, pred)
    seen = fb.relation(pred).groupBy("fold", *[f"a{i}" for i in free]).agg(F.count(F.lit(1)).alias("n")).groupBy("fold").agg(
        F.sum((F.col("n") == 1).cast("bigint")).alias("one"), F.sum((F.col("n") > 1).cast("bigint")).alias("more"))
    folds = small_table(fb.spark, [(f,) for f in fb.folds()], "fold int")
    possible = fb.size_product([fb.schema[pred].types[i] for i in free])
    held = folds.join(seen, "fold", "left").fillna(0, ["one", "more"]).withColumn("possible", possible.cast(EXACT))
    return held.select("fold", "possible", "one", "more", (F.col("possible") - F.col("one") - F.col("more")).cast(EXACT).alias("none"))


def check_blocks(fb: FactBase, pred: str) -> DataFrame:
    """Blocks that break "exactly one true": more than one, or none; with several free arguments see ``block_totals`` for none."""
    return blocks(fb, pred).filter("n_true <> 1")


def sample_size(total: int, fraction: float, low: int, high: int) -> int:
    """round(fraction * total), raised to ``low`` or else lowered to ``high``; negative bounds are ignored."""
    want = int(fraction * total + 0.5)
    if low >= 0 and want < low:
        want = low
    elif high >= 0 and want > high:
        want = high
    return min(want, total)


def sample_atoms(fb: FactBase, pred: str, fraction: float, low: int, high: int, seed: int) -> DataFrame:
    """Stratified atom sample: ``fold, a0.., truth, scale`` with scale = stratum total / sampled.

    Listed atoms are taken in hash order.  Absent atoms are drawn by index arithmetic over numbered
    argument domains: when the sample is a sizeable share of the absent atoms or of the domain product every
    index is visited, otherwise about three times the wanted number of indices is drawn and listed or
    repeated ones are dropped, so the work follows the sample size and not the domain product. The scale
    is the stratum total by the number that was really drawn.
    """
    decl = fb.schema[pred]
    cols = [f"a{i}" for i in range(decl.arity)]
    key = ["fold"] + cols
    rel = fb.relation(pred)
    spark = fb.spark
    out = []
    n_true = {f: fb.true_totals().get((f, pred), 0) for f in fb.folds()}
    want_true = {f: sample_size(n, fraction, low, high) for f, n in n_true.items()}
    out.append(
        hashed_positions(rel, ["fold"], cols, seed, "pos")
        .filter(F.col("pos") <= fb.per_fold(want_true, "bigint"))
        .select(*key, F.lit(True).alias("truth"),
                fb.per_fold({f: n_true[f] / max(want_true[f], 1) for f in n_true}, "double").alias("scale"))
    )
    numbered = [
        hashed_positions(fb.constants_of(t), ["fold"], ["const"], seed + j, "pos").select(
            "fold", F.col("pos").alias(f"p{j}"), F.col("const").alias(cols[j])
        )
        for j, t in enumerate(decl.types)
    ]
    for f in fb.folds():
        possible = fb.possible(f, pred)
        absent = possible - n_true[f]
        want = sample_size(absent, fraction, low, high)
        if want <= 0:
            continue
        every = possible <= 8 * want + 1000 or 4 * want >= absent
        n = possible if every else -(-(3 * want + 64) * possible // absent)
        cand = spark.range(n).select(F.lit(f).alias("fold"), F.col("id").alias("i"))
        stride = 1
        for j, t in enumerate(decl.types):
            size = fb.size(f, t)
            pos = F.expr(f"(i div {stride}) % {size}") if every else F.pmod(F.xxhash64(F.lit(seed * 31 + j), "i"), F.lit(size))
            cand = cand.withColumn(f"p{j}", pos + 1)
            stride *= size
        for j in range(decl.arity):
            cand = cand.join(numbered[j], ["fold", f"p{j}"])
        drawn = cand.select(*key).distinct().join(rel, key, "left_anti")
        taken = cut(hashed_positions(drawn, ["fold"], cols, seed + 7, "pos").filter(F.col("pos") <= want).select(*key))
        out.append(taken.select(*key, F.lit(False).alias("truth"), F.lit(absent / max(taken.count(), 1)).alias("scale")))
    return union_all(out)
