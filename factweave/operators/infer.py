"""Inference over the table of ground clauses (``fold, gid, lits, weight, hard, frequency``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..facts import union_all
from ..plans.local import small_table
from ..plans.storage import cut, drop, freeing, stored, thinned

ATOM = ["fold", "atom"]


def ground_literals(g: DataFrame) -> DataFrame:
    """``fold, gid, atom, positive, k``: one row per ground literal of a clause with k literals."""
    return g.select("fold", "gid", F.size("lits").alias("k"), F.explode("lits").alias("l")).select(
        "fold", "gid", "l.atom", "l.positive", "k"
    )


def numbered(g: DataFrame) -> DataFrame:
    """The ground clauses, stored once, each of its own number as gid: eight bytes beside every literal instead of a name of 64."""
    return stored(g.withColumn("gid", F.monotonically_increasing_id()), "ground")


def atoms_of(g: DataFrame) -> DataFrame:
    return ground_literals(g).select(*ATOM).distinct()


def propagate_units(g: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fix atoms forced by hard clauses, simplify, repeat: (remaining clauses, ``fold, atom, value``).

    A hard clause with one literal fixes its atom; a hard clause whose weight is negative demands
    that all its literals are false.  Satisfied clauses go, false literals are removed from the rest.
    Repeats until nothing more is forced. An atom forced both ways is an error, and so is a hard clause
    that its fixed atoms contradict. Hard clauses are stored once, without names; a round stores forced atoms and the clauses they
    occur in, and shuffles only what a filter of these lets through. Remaining clauses are simplified in one pass over ``g`` when they are read.
    """
    spark, cols = g.sparkSession, ["fold", "gid", "lits", "weight", "hard", "frequency"]
    negative = F.coalesce(F.col("weight") < 0, F.lit(False))
    hard = stored(g.filter("hard").select("fold", "lits", negative.alias("neg")).withColumn("row", F.monotonically_increasing_id()), "hard_clauses")
    lits = hard.select("fold", "row", "neg", F.size("lits").alias("k"), F.explode("lits").alias("l")).select(
        "fold", "row", "neg", "k", "l.atom", "l.positive"
    )
    new = lits.filter("k = 1 or neg").select(*ATOM, (F.col("positive") != F.col("neg")).alias("value"))
    fixed, hits = [], []
    while True:
        units = stored(new.distinct(), "units")
        with freeing(spark):
            clash = units.groupBy(*ATOM).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).collect()
        if clash:
            raise ValueError(f"hard clauses contradict each other on {clash[0]['atom']}")
        if units.isEmpty():
            break
        fixed.append(units)
        # Only clauses with a newly fixed atom change; they are kept as the atoms that became false.
        agrees = F.col("value") == F.col("positive")
        hit = stored(thinned(lits, units, ATOM).join(units, ATOM).groupBy("fold", "row", "neg", "k").agg(
            F.max(agrees).alias("sat"), F.collect_list(F.when(~agrees, F.col("atom"))).alias("gone")), "hits")
        hits.append(hit)
        state = union_all(hits).join(hit.select("fold", "row"), ["fold", "row"], "left_semi").groupBy("fold", "row", "neg", "k").agg(
            F.max("sat").alias("sat"), F.flatten(F.collect_list("gone")).alias("gone"))
        left = F.col("k") - F.size("gone")
        near = stored(state.filter(F.when(F.col("neg"), F.col("sat")).otherwise(~F.col("sat") & (left <= 1))).withColumn("left", left), "near")
        of_row = thinned(hard.select("fold", "row", "lits"), near, ["fold", "row"])
        broken = near.filter("neg or left = 0").limit(1)
        if not broken.isEmpty():
            broken = broken.join(of_row, ["fold", "row"]).first()
            raise ValueError(f"hard clauses contradict each other on {[l['atom'] for l in broken['lits']]}")
        last = F.get(F.filter("lits", lambda l: ~F.array_contains("gone", l["atom"])), F.lit(0))
        new = near.join(of_row, ["fold", "row"]).select("fold", last.alias("l")).select(
            "fold", "l.atom", F.col("l.positive").alias("value"))
        if len(hits) == 16:  # keeps the plan short on long chains
            fixed, hits = ([_joined(parts, name)] for parts, name in ((fixed, "units"), (hits, "hits")))
    if not fixed:
        return g.select(*cols), small_table(spark, [], "fold int, atom string, value boolean")
    fixed = union_all(fixed)
    every = g.select("fold", "lits").distinct().select("fold", "lits", F.explode("lits").alias("l")).select("fold", "lits", "l.atom", "l.positive")
    state = every.join(fixed, ATOM, "left").groupBy("fold", "lits").agg(
        F.max(F.coalesce(F.col("value") == F.col("positive"), F.lit(False))).alias("sat"),
        F.array_sort(F.collect_list(F.when(F.col("value").isNull(), F.struct("atom", "positive")))).alias("left"),
    ).filter(~F.col("sat") & (F.size("left") > 0))
    left = F.col("left").cast("array<struct<atom:string,positive:boolean>>").alias("lits")
    return g.join(state, ["fold", "lits"]).select("fold", "gid", left, "weight", "hard", "frequency"), fixed


def _joined(parts: list[DataFrame], name: str) -> DataFrame:
    """Several stored tables as one."""
    out = stored(union_all(parts), name)
    for p in parts:
        drop(p)
    return out


def components(g: DataFrame) -> DataFrame:
    """``fold, atom, component``: least atom name reachable through shared clauses.

    Atoms are numbered once and a clause is known by its least number, so the rounds join and aggregate numbers only.
    Labels move atom -> clause -> atom, so a clause or atom of any size costs one row per literal;
    each round also jumps to the label's own label, which shortens long chains.
    """
    every = cut(g.select("fold", "gid", F.size("lits").alias("k"), F.explode(F.array_distinct(F.transform("lits", lambda l: l["atom"]))).alias("atom")))
    atoms = cut(every.select(*ATOM).distinct().withColumn("node", F.monotonically_increasing_id()))
    # Only clauses with several atoms connect anything.
    numbered = cut(every.filter("k > 1").join(atoms, ATOM).select("fold", "gid", "node"))
    hubs = numbered.groupBy("fold", "gid").agg(F.min("node").alias("hub"))
    lits = cut(numbered.join(hubs, ["fold", "gid"]).select("hub", "node").distinct())
    if lits.isEmpty():
        return atoms.select(*ATOM, F.col("atom").alias("component"))
    labels = cut(lits.groupBy("node").agg(F.min("hub").alias("label")))
    while True:
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("j"))
        labels = labels.join(jump, "label").select("node", F.col("j").alias("label"))
        hub_min = lits.join(labels, "node").groupBy("hub").agg(F.min("label").alias("m"), F.max("label").alias("top"))
        near = lits.join(hub_min, "hub").groupBy("node").agg(
            F.min("m").alias("label"), F.max(F.col("m") != F.col("top")).alias("mixed")
        )
        labels = cut(near)
        settled = labels.filter("mixed").isEmpty()
        labels = labels.select("node", "label")
        if settled:
            break
    named = cut(atoms.join(labels, "node", "left").select(*ATOM, F.coalesce("label", "node").alias("label")))
    names = named.groupBy("label").agg(F.min("atom").alias("component"))
    return named.join(names, "label").select(*ATOM, "component")


def colour(g: DataFrame, seed: int = 0, block: DataFrame | None = None) -> DataFrame:
    """``fold, atom, colour``: atoms of one colour share no clause.

    Each round colours the atoms whose hashed priority is highest among the uncoloured atoms of
    every clause they are in. With ``block`` (``fold, atom, block``) the atoms of a block are one node and have one colour.
    """
    lits = ground_literals(g).select("fold", "gid", "atom").distinct()
    if block is None:
        return _coloured(lits, seed)
    unit = F.coalesce("block", "atom").alias("unit")
    units = lits.join(block, ATOM, "left").select("fold", "gid", unit).withColumnRenamed("unit", "atom").distinct()
    of_unit = _coloured(units, seed).withColumnRenamed("atom", "unit")
    members = block.select(*ATOM, F.col("block").alias("unit")).unionByName(
        lits.select(*ATOM).distinct().join(block, ATOM, "left_anti").select(*ATOM, F.col("atom").alias("unit"))
    )
    return members.join(of_unit, ["fold", "unit"], "left").select(*ATOM, F.coalesce("colour", F.lit(0)).alias("colour"))


def _coloured(lits: DataFrame, seed: int) -> DataFrame:
    """``fold, atom, colour`` from ``fold, gid, atom``.

    An atom goes by the hash that is its priority, and a clause is one row with its atoms from the highest priority down: of the
    open atoms those are chosen that stand below no other. Rounds store the clauses that still have several open atoms.
    Where two atoms of a fold have one hash, all go by hash and name. Clauses whose hashes are equal count as one, which only
    keeps more atoms apart.
    """
    hashed = F.xxhash64(F.lit(seed), "atom")
    atoms = stored(lits.select(*ATOM).distinct().withColumn("node", hashed), "atoms")
    with freeing(lits.sparkSession):
        alike = atoms.groupBy("fold", "node").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()
    node = hashed if alike else F.struct(hashed.alias("h"), F.col("atom").alias("a"))
    open_ = stored(atoms.select("fold", node.alias("node")), "open_atoms")
    clauses = stored(
        lits.select("fold", F.xxhash64("fold", "gid").alias("clause"), node.alias("node"))
        .groupBy("fold", "clause").agg(F.sort_array(F.collect_set("node"), asc=False).alias("nodes"))
        .filter(F.size("nodes") > 1).select("fold", "nodes"), "clause_atoms")
    done, c = [], 0
    while c == 0 or not open_.isEmpty():
        below = clauses.select("fold", F.explode(F.slice("nodes", 2, F.greatest(F.size("nodes") - 1, F.lit(0)))).alias("node")).distinct()
        chosen = stored(open_.join(below, ["fold", "node"], "left_anti").withColumn("colour", F.lit(c)), "colours")
        done.append(chosen)
        taken = chosen.select("fold", F.col("node").alias("top"), F.lit(True).alias("gone"))
        # a chosen atom is the first of all its clauses
        rest = clauses.withColumn("top", F.col("nodes")[0]).join(taken, ["fold", "top"], "left").select(
            "fold", F.when(F.col("gone"), F.slice("nodes", 2, F.size("nodes") - 1)).otherwise(F.col("nodes")).alias("nodes"))
        left = stored(rest.filter(F.size("nodes") > 1), "clause_atoms")
        still = stored(open_.join(chosen, ["fold", "node"], "left_anti"), "open_atoms")
        drop(clauses)
        drop(open_)
        clauses, open_, c = left, still, c + 1
    return atoms.select(*ATOM, node.alias("node")).join(union_all(done), ["fold", "node"]).select(*ATOM, "colour")


def _soft_weights(g: DataFrame) -> DataFrame:
    """Hard clauses get a weight larger than all soft weights together."""
    total = g.agg(F.sum(F.abs("weight")).alias("w")).first()["w"] or 0.0
    w = F.when(F.col("hard"), F.lit(float(total) + 10.0) * F.when(F.col("weight") < 0, -1.0).otherwise(1.0)).otherwise(
        F.col("weight")
    )
    return g.withColumn("weight", w)


def _field(lits: DataFrame, state: DataFrame, keys: list[str], targets: DataFrame) -> DataFrame:
    """W_true - W_false for the target atoms: sum of +-w over clauses no other literal satisfies.

    ``lits`` is ``fold, gid, atom, positive, weight``; ``state`` has ``keys + atom, value``.
    """
    valued = lits.join(state, ATOM)
    true = F.col("value") == F.col("positive")
    valued = valued.withColumn("t", true.cast("int"))
    sat = valued.groupBy(*keys, "gid").agg(F.sum("t").alias("n_true"))
    mine = valued.join(targets, ATOM, "left_semi")
    contribution = F.when(F.col("positive"), F.col("weight")).otherwise(-F.col("weight"))
    return (
        mine.join(sat, keys + ["gid"])
        .withColumn("c", F.when(F.col("n_true") - F.col("t") == 0, contribution).otherwise(0.0))
        .groupBy(*keys, "atom").agg(F.sum("c").alias("field"))
    )


def _block_scores(lits: DataFrame, state: DataFrame, keys: list[str], targets: DataFrame) -> DataFrame:
    """``keys, unit, atom, score`` of the target atoms: weight gained if the atom is the true one of its unit.

    ``lits`` and ``targets`` have the unit of each atom: its block, or itself. Only clauses that no atom outside the unit satisfies
    count: a positive literal adds its weight, and a negative one takes it away unless another atom of the unit is denied too.
    """
    valued = lits.join(state, ATOM)
    valued = valued.withColumn("t", (F.col("value") == F.col("positive")).cast("int"))
    by_unit = valued.groupBy(*keys, "gid", "unit").agg(
        F.sum("t").alias("own"), F.sum((~F.col("positive")).cast("int")).alias("denied"))
    sat = by_unit.groupBy(*keys, "gid").agg(F.sum("own").alias("n_true"))
    gain = F.when(F.col("positive") & (F.col("denied") == 0), F.col("weight")).when(
        ~F.col("positive") & (F.col("denied") == 1), -F.col("weight")).otherwise(0.0)
    mine = valued.join(targets.select(*ATOM), ATOM, "left_semi").join(by_unit, keys + ["gid", "unit"]).join(sat, keys + ["gid"])
    return mine.filter(F.col("n_true") == F.col("own")).groupBy(*keys, "unit", "atom").agg(F.sum(gain).alias("score"))


def _fixed_scores(lits: DataFrame) -> DataFrame:
    """``fold, unit, atom, fixed``: the part of ``_block_scores`` from clauses inside one unit, which no state changes."""
    by_unit = lits.groupBy("fold", "gid", "unit").agg(F.sum((~F.col("positive")).cast("int")).alias("denied"))
    gain = F.when(F.col("positive") & (F.col("denied") == 0), F.col("weight")).when(
        ~F.col("positive") & (F.col("denied") == 1), -F.col("weight")).otherwise(0.0)
    return lits.join(by_unit, ["fold", "gid", "unit"]).groupBy("fold", "unit", "atom").agg(F.sum(gain).alias("fixed"))


def gibbs_blocks(
    g: DataFrame, block: DataFrame, chains: int = 8, burn: int = 20, steps: int = 100, seed: int = 0
) -> DataFrame:
    """``fold, atom, p``: marginals where exactly one atom of every block is true.

    ``block`` is ``fold, atom, block`` and lists all alternatives of each block, also those in no clause; other atoms are
    sampled one by one. A block is drawn at once, from the softmax of its alternatives' gains (the largest of gain plus Gumbel
    noise), so no state ever has two or none. Blocks of one colour share no clause. Random numbers are hashes of
    (seed, chain, sweep, atom). The marginals of a block sum to one; they are not smoothed. A clause has no atom with both signs.
    """
    keys = ["fold", "chain"]
    block = cut(block.select(*ATOM, "block").distinct())
    colours = cut(colour(g, seed, block).join(block, ATOM, "left").withColumn("unit", F.coalesce("block", "atom")))
    lits = cut(_weighted_literals(g).join(colours.select(*ATOM, "unit"), ATOM))
    # Clauses inside one unit score the same in every state; only the others are read again in each sweep.
    linking = lits.groupBy("fold", "gid").agg(F.min("unit").alias("lo"), F.max("unit").alias("hi")).filter("lo <> hi").select("fold", "gid")
    tied = cut(lits.join(linking, ["fold", "gid"], "left_semi"))
    fixed = _fixed_scores(lits.join(linking, ["fold", "gid"], "left_anti"))
    colours = cut(colours.join(fixed, ["fold", "unit", "atom"], "left").fillna(0.0, ["fixed"]))
    n, free = colours.agg(F.max("colour")).first()[0], tied.isEmpty()
    if n is None:
        return colours.select(*ATOM, F.lit(0.0).alias("p"))

    def drawn(rows: DataFrame, sweep: int) -> DataFrame:
        """rows with ``score``: one true atom per block, single atoms by their odds."""
        u = _uniform(F.lit(seed), F.lit(sweep), F.col("fold"), F.col("chain"), F.col("atom"))
        noisy = rows.withColumn("u", u).withColumn("key", F.struct((F.col("score") - F.log(-F.log("u"))).alias("s"), "atom"))
        best = noisy.filter("block is not null").groupBy(*keys, "unit").agg(F.max("key").getField("atom").alias("best"))
        return noisy.join(best, keys + ["unit"], "left").withColumn(
            "value", F.when(F.col("block").isNull(), F.col("u") < 1 / (1 + F.exp(-F.col("score")))).otherwise(F.col("atom") == F.col("best"))
        )

    everyone = colours.withColumn("chain", F.explode(F.sequence(F.lit(0), F.lit(chains - 1))))
    state = cut(drawn(everyone.withColumn("score", F.lit(0.0)), -1).select(*keys, "atom", "value", F.lit(0).alias("hits")))
    for sweep in range(burn + steps):
        for c in range(n + 1):
            targets = colours.filter(F.col("colour") == c)
            rows = everyone.filter(F.col("colour") == c).withColumn("score", F.col("fixed"))
            if not free:
                scores = _block_scores(tied, state, keys, targets).withColumnRenamed("score", "moved")
                rows = rows.join(scores, keys + ["unit", "atom"], "left").withColumn("score", F.col("fixed") + F.coalesce("moved", F.lit(0.0)))
            new = drawn(rows, sweep).select(*keys, "atom", F.col("value").alias("new"))
            state = state.join(new, keys + ["atom"], "left").withColumn("value", F.coalesce("new", "value")).drop("new")
            if sweep >= burn and c == n:
                state = state.withColumn("hits", F.col("hits") + F.col("value").cast("int"))
            state = cut(state)  # each colour reads the state several times
    return state.groupBy(*ATOM).agg((F.sum("hits") / F.lit(float(chains * steps))).alias("p"))


def _weighted_literals(g: DataFrame) -> DataFrame:
    soft = _soft_weights(g)
    return soft.select("fold", "gid", "weight", F.explode("lits").alias("l")).select(
        "fold", "gid", "l.atom", "l.positive", "weight"
    )


def _uniform(*cols: Column) -> Column:
    """Deterministic number in (0, 1) from a hash of its arguments."""
    return (F.pmod(F.xxhash64(*cols), F.lit((1 << 52) - 1)).cast("double") + 0.5) / float(1 << 52)


def map_state(g: DataFrame, seed: int = 0) -> DataFrame:
    """``fold, atom, value``: a state no single flip improves, by coordinate ascent colour by colour.

    Every flip raises the total weight, so the sweeps end by themselves.
    """
    lits = cut(_weighted_literals(g))
    colours = cut(colour(g, seed))
    n = colours.agg(F.max("colour")).first()[0]
    state = cut(colours.select(*ATOM, (_uniform(F.lit(seed), F.col("fold"), F.col("atom")) < 0.5).alias("value")))
    if n is None:
        return state
    while True:
        before = state
        for c in range(n + 1):
            f = _field(lits, state, ["fold"], colours.filter(F.col("colour") == c))
            state = cut(
                state.join(f, ATOM, "left").select(
                    *ATOM,
                    F.when(F.col("field") > 0, True).when(F.col("field") < 0, False).otherwise(F.col("value")).alias("value"),
                )
            )
        flips = state.join(before.withColumnRenamed("value", "old"), ATOM).filter("value <> old").limit(1).count()
        if not flips:
            break
    return state


def gibbs(
    g: DataFrame, chains: int = 8, burn: int = 20, steps: int = 100, seed: int = 0, keep_samples: bool = False
) -> DataFrame | tuple[DataFrame, DataFrame]:
    """``fold, atom, p``: marginals by colour-wise Gibbs sampling, all chains in one job.

    P(A) = 1 / (1 + exp(W_false - W_true)); the reported value is smoothed, (10000 p + 0.5) / 10001.
    Random numbers are hashes of (seed, chain, sweep, atom), so a recomputed task draws the same.
    With ``keep_samples`` also ``fold, chain, step, atom, value`` of the kept sweeps.
    """
    keys = ["fold", "chain"]
    lits = cut(_weighted_literals(g))
    colours = cut(colour(g, seed))
    n = (colours.agg(F.max("colour")).first()[0] or 0) + 1
    state = cut(
        colours.select(*ATOM, F.explode(F.sequence(F.lit(0), F.lit(chains - 1))).alias("chain"))
        .withColumn("value", _uniform(F.lit(seed), F.lit(-1), F.col("fold"), F.col("chain"), F.col("atom")) < 0.5)
        .withColumn("hits", F.lit(0))
    )
    samples = []
    for sweep in range(burn + steps):
        for c in range(n):
            f = _field(lits, state, keys, colours.filter(F.col("colour") == c))
            u = _uniform(F.lit(seed), F.lit(sweep), F.col("fold"), F.col("chain"), F.col("atom"))
            state = state.join(f, keys + ["atom"], "left").withColumn(
                "value", F.when(F.col("field").isNull(), F.col("value")).otherwise(u < 1 / (1 + F.exp(-F.col("field"))))
            ).drop("field")
        if sweep >= burn:
            state = state.withColumn("hits", F.col("hits") + F.col("value").cast("int"))
        state = cut(state)
        if keep_samples and sweep >= burn:
            samples.append(state.select("fold", "chain", F.lit(sweep - burn).alias("step"), "atom", "value"))
    p = F.sum("hits") / F.lit(float(chains * steps))
    out = state.groupBy(*ATOM).agg(((p * 10000 + 0.5) / 10001).alias("p"))
    if keep_samples:
        return out, union_all(samples)
    return out


def clause_states(g: DataFrame, state: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Each ground clause with ``satisfied`` under a state (``fold, atom, value`` + extra keys)."""
    keys = keys or ["fold"]
    sat = (
        ground_literals(g).join(state, ATOM)
        .groupBy(*keys, "gid").agg(F.max(F.col("value") == F.col("positive")).alias("satisfied"))
    )
    return sat.join(g.select("fold", "gid", "weight", "hard", "frequency"), ["fold", "gid"])


def state_counts(g: DataFrame, state: DataFrame) -> DataFrame:
    """True and total ground clauses under a state, by frequency, plus their summed weight."""
    s = clause_states(g, state)
    return s.groupBy("fold").agg(
        F.sum(F.col("satisfied").cast("double") * F.col("frequency")).alias("n_true"),
        F.sum("frequency").alias("n_total"),
        F.sum(F.when(F.col("satisfied"), F.col("weight")).otherwise(0.0)).alias("weight_true"),
    )


def clause_report(network: DataFrame, state: DataFrame) -> DataFrame:
    """Per first-order clause: true and total groundings under a state (unmerged network rows)."""
    rows = network.withColumn("gid", F.concat_ws("#", "clause_id", F.to_json("lits")))
    sat = (
        rows.select("fold", "gid", F.explode("lits").alias("l")).select("fold", "gid", "l.atom", "l.positive")
        .join(state, ATOM).groupBy("fold", "gid").agg(F.max(F.col("value") == F.col("positive")).alias("satisfied"))
    )
    return rows.join(sat, ["fold", "gid"]).groupBy("clause_id").agg(
        F.sum(F.col("satisfied").cast("double") * F.col("frequency")).alias("n_true"), F.sum("frequency").alias("n_total")
    )


def expected_counts(network: DataFrame, samples: DataFrame) -> DataFrame:
    """``clause_id, mean_true, var_true`` over samples (``fold, chain, step, atom, value``)."""
    rows = network.withColumn("gid", F.concat_ws("#", "clause_id", F.to_json("lits")))
    sat = (
        rows.select("fold", "gid", F.explode("lits").alias("l")).select("fold", "gid", "l.atom", "l.positive")
        .join(samples, ATOM).groupBy("fold", "chain", "step", "gid")
        .agg(F.max(F.col("value") == F.col("positive")).alias("satisfied"))
    )
    per_sample = sat.join(rows.select("fold", "gid", "clause_id", "frequency"), ["fold", "gid"]).groupBy(
        "chain", "step", "clause_id"
    ).agg(F.sum(F.col("satisfied").cast("double") * F.col("frequency")).alias("n_true"))
    return per_sample


def count_moments(per_sample: DataFrame) -> DataFrame:
    """Mean and (population) variance of clause true counts over samples."""
    return per_sample.groupBy("clause_id").agg(
        F.avg("n_true").alias("mean_true"), F.var_pop("n_true").alias("var_true")
    )


def count_cov_vector(per_sample: DataFrame, v: DataFrame) -> DataFrame:
    """Covariance matrix of clause counts times a vector: ``clause_id, value``.

    E[n_i (v.n)] - E[n_i] E[v.n], so the matrix itself is never formed.
    """
    dots = per_sample.join(v, "clause_id").groupBy("chain", "step").agg(
        F.sum(F.col("n_true") * F.col("v")).alias("dot")
    )
    return per_sample.join(dots, ["chain", "step"]).groupBy("clause_id").agg(
        (F.avg(F.col("n_true") * F.col("dot")) - F.avg("n_true") * F.avg("dot")).alias("value")
    )


def state_cost(g: DataFrame, state: DataFrame) -> DataFrame:
    """``fold, cost``: |weight| of violated clauses (unsatisfied positive, satisfied negative weight)."""
    s = clause_states(g, state)
    bad = F.when(F.col("weight") >= 0, ~F.col("satisfied")).otherwise(F.col("satisfied"))
    return s.groupBy("fold").agg(F.sum(F.when(bad, F.abs("weight")).otherwise(0.0)).alias("cost"))


def exact_small(g: DataFrame, max_atoms: int = 16, comp: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Exact marginals and log normaliser by listing all states of each small component.

    Returns (``fold, atom, component, p``; ``fold, component, n_atoms, log_z``).  A component with
    more than ``max_atoms`` atoms is returned with null ``p`` and ``log_z``: use ``gibbs`` for it.
    """
    every = cut(components(g) if comp is None else comp)
    sizes = every.groupBy("fold", "component").agg(F.count(F.lit(1)).cast("int").alias("n_atoms"))
    large = sizes.filter(F.col("n_atoms") > max_atoms)
    comp = every.join(sizes.filter(F.col("n_atoms") <= max_atoms), ["fold", "component"]).drop("n_atoms")
    atom_lists = comp.groupBy("fold", "component").agg(F.array_sort(F.collect_list("atom")).alias("atoms"))
    lits = _weighted_literals(g).join(comp, ATOM).join(atom_lists, ["fold", "component"]).withColumn(
        "bit", F.pow(F.lit(2.0), F.array_position("atoms", F.col("atom")) - 1).cast("bigint")
    )
    clauses = lits.groupBy("fold", "component", "gid").agg(
        F.sum(F.when(F.col("positive"), F.col("bit")).otherwise(0)).alias("pos"),
        F.sum(F.when(~F.col("positive"), F.col("bit")).otherwise(0)).alias("neg"),
        F.max("weight").alias("w"),
    )
    # At most 3^max_atoms distinct merged clauses per component, in practice a handful per atom.
    body = clauses.groupBy("fold", "component").agg(F.collect_list(F.struct("pos", "neg", "w")).alias("cs"))
    top = F.pow(F.lit(2.0), F.size("atoms")).cast("bigint") - 1
    states = atom_lists.join(body, ["fold", "component"]).withColumn("s", F.explode(F.sequence(F.lit(0).cast("bigint"), top)))

    def satisfied(c: Column) -> Column:
        s = F.col("s")
        return (s.bitwiseAND(c["pos"]) != 0) | (F.bitwise_not(s).bitwiseAND(c["neg"]) != 0)

    score = F.aggregate(
        "cs", F.lit(0.0), lambda acc, c: acc + F.when(satisfied(c), c["w"]).otherwise(0.0)
    )
    scored = states.select("fold", "component", "atoms", "s", score.alias("score"))
    peak = scored.groupBy("fold", "component").agg(F.max("score").alias("peak"))
    scored = scored.join(peak, ["fold", "component"]).withColumn("e", F.exp(F.col("score") - F.col("peak")))
    z = scored.groupBy("fold", "component").agg(
        F.sum("e").alias("z"), F.max("peak").alias("peak"), F.max(F.size("atoms")).alias("n_atoms")
    )
    ones = (
        scored.select("fold", "component", "e", "s", F.posexplode("atoms").alias("i", "atom"))
        .withColumn("on", F.expr("shiftright(s, i) & 1"))
        .groupBy("fold", "component", "atom").agg(F.sum(F.when(F.col("on") == 1, F.col("e")).otherwise(0.0)).alias("on"))
    )
    p = ones.join(z, ["fold", "component"]).select(*ATOM, "component", (F.col("on") / F.col("z")).alias("p"))
    apart = every.join(large, ["fold", "component"])
    unknown = F.lit(None).cast("double")
    return (
        p.unionByName(apart.select(*ATOM, "component", unknown.alias("p"))),
        z.select("fold", "component", "n_atoms", (F.log("z") + F.col("peak")).alias("log_z"))
        .unionByName(large.select("fold", "component", "n_atoms", unknown.alias("log_z"))),
    )


def exact_log_likelihood(g: DataFrame, state: DataFrame, max_atoms: int = 16) -> DataFrame:
    """``fold, log_likelihood`` of a full state: total weight satisfied minus the log normaliser."""
    soft = _soft_weights(g)
    s = clause_states(soft, state).groupBy("fold").agg(
        F.sum(F.when(F.col("satisfied"), F.col("weight")).otherwise(0.0)).alias("score")
    )
    known = F.count("log_z") == F.count(F.lit(1))  # null if a component was too large
    z = exact_small(g, max_atoms)[1].groupBy("fold").agg(F.when(known, F.sum("log_z")).alias("log_z"))
    return s.join(z, "fold").select("fold", (F.col("score") - F.col("log_z")).alias("log_likelihood"))


def gelman(samples: DataFrame) -> DataFrame:
    """Between-chain over within-chain variance B / W per atom: ``fold, atom, ratio``."""
    x = F.col("value").cast("double")
    chain = samples.groupBy(*ATOM, "chain").agg(
        F.avg(x).alias("m"), F.var_samp(x).alias("v"), F.count(F.lit(1)).alias("n")
    )
    return chain.groupBy(*ATOM).agg(
        F.try_divide(F.var_samp("m") * F.max("n"), F.avg("v")).alias("ratio")
    )


def converged_fraction(samples: DataFrame, eps: float, gamma: float, threshold: float) -> DataFrame:
    """Share of atoms whose estimated required samples per chain is at most ``threshold``.

    Per atom: S = standard deviation of chain means, sigma = sqrt(m0) S, required total
    (z sigma / eps')^2 with z the normal quantile at (gamma+1)/2 and eps' the tolerance as a
    fraction of the overall mean; divided by the number of chains.  Non-finite scores do not count.
    """
    from statistics import NormalDist

    z = NormalDist().inv_cdf((gamma + 1) / 2)
    chain = samples.groupBy(*ATOM, "chain").agg(
        F.avg(F.col("value").cast("double")).alias("m"), F.count(F.lit(1)).alias("n")
    )
    per_atom = chain.groupBy(*ATOM).agg(
        F.var_samp("m").alias("var"), F.max("n").alias("m0"), F.count(F.lit(1)).alias("chains"), F.avg("m").alias("mean")
    )
    need = F.try_divide(
        F.pow(F.lit(z), 2) * F.col("m0") * F.col("var"), F.pow(eps * F.col("mean"), 2)
    ) / F.col("chains")
    finite = need.isNotNull() & ~F.isnan(need)
    return per_atom.withColumn("need", need).filter(finite).groupBy("fold").agg(
        F.avg(F.when(F.col("need") <= threshold, 1.0).otherwise(0.0)).alias("fraction")
    )
