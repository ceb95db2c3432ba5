"""Rule generation: abstract templates, instantiation over a schema, constants, signs, neighbours.

Rules are rows; every step is a projection, an explode over a short schema-sized array, or a
``dropDuplicates`` on the canonical text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..facts import FactBase
from ..functions import literals as L
from ..functions.computed import is_computed
from ..plans.counting import clause_counts
from ..plans.storage import cut
from ..rules import LITERALS_TYPE, Clause, collect_rules, unit
from ..schema import Schema


def rule_id(text_col: Column) -> Column:
    """Stable id: hash of the canonical text."""
    return F.substring(F.sha2(text_col, 256), 1, 16)


def _arg(name: Column, kind: str = "var") -> Column:
    return F.struct(F.lit(kind).alias("kind"), name.alias("name"))


def _literal(pred: Column, positive: Column, args: Column) -> Column:
    return F.struct(pred.alias("pred"), positive.alias("positive"), args.alias("args"))


def templates(spark: SparkSession, min_literals: int = 2, max_literals: int = 3, n_vars: int = 3) -> DataFrame:
    """Abstract clauses over R1.., T1..: ``template_id, text, n_literals, literals``.

    Literals R(Ti,Tj) have two different arguments; a template is a connected set of distinct atoms
    with any signs; templates that differ by renaming or order are one.  Combinations are decoded
    from a range of integers, so no pairing of literal tables is needed.
    """
    per_rel = n_vars * (n_vars - 1)
    out = None
    for n in range(min_literals, max_literals + 1):
        base = per_rel * max_literals
        ids = spark.range(base**n)
        digits = F.transform(
            F.sequence(F.lit(0), F.lit(n - 1)),
            lambda i: F.pmod(F.floor(F.col("id") / F.pow(F.lit(float(base)), i)), F.lit(base)).cast("int"),
        )

        def atom(d: Column) -> Column:
            rel = F.floor(d / per_rel).cast("int")
            rest = F.pmod(d, F.lit(per_rel))
            first = F.floor(rest / (n_vars - 1)).cast("int")
            second = F.pmod(rest, F.lit(n_vars - 1)).cast("int")
            second = second + F.when(second >= first, 1).otherwise(0)
            args = F.array(
                _arg(F.concat(F.lit("T"), first.cast("string"))), _arg(F.concat(F.lit("T"), second.cast("string")))
            )
            return _literal(F.concat(F.lit("R"), rel.cast("string")), F.lit(True), args)

        combos = (
            ids.select(digits.alias("d"))
            .filter(F.forall(F.sequence(F.lit(1), F.lit(n - 1)), lambda i: F.get("d", i - 1) < F.get("d", i)) if n > 1 else F.lit(True))
            .select(F.transform("d", atom).cast(LITERALS_TYPE).alias("literals"))
            .filter(L.is_connected(F.col("literals")))
        )
        shapes = _distinct(combos, var="T", pred="R", max_literals=n)
        signed = shapes.withColumn("mask", F.explode(F.sequence(F.lit(0), F.lit(2**n - 1)))).select(
            L.with_signs(F.col("literals"), F.col("mask")).alias("literals")
        )
        part = _distinct(signed, var="T", pred="R", max_literals=n)
        out = part if out is None else out.unionByName(part)
    return out.select(
        rule_id(F.col("text")).alias("template_id"), "text", F.size("literals").alias("n_literals"), "literals"
    )


def _distinct(df: DataFrame, var: str = "x", pred: str | None = None, max_literals: int = L.MAX_LITERALS) -> DataFrame:
    """Rules up to renaming and literal order: ``text, literals`` (other columns are dropped)."""
    return (
        df.select(L.canonical(F.col("literals"), var, pred, max_literals).alias("c"))
        .select("c.text", "c.literals")
        .dropDuplicates(["text"])
    )


def distinct_rules(df: DataFrame, max_literals: int = L.MAX_LITERALS) -> DataFrame:
    return _distinct(df, max_literals=max_literals)


def _predicate_array(schema: Schema) -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(p.name).alias("name"),
                F.array(*[F.lit(t) for t in p.types]).alias("types"),
                F.array(*[F.lit(i in p.constant_args) for i in range(p.arity)]).alias("plus"),
            )
            for p in schema
        ]
    )


def _typed_pairs(literals: Column, schema_map: Column) -> Column:
    """(variable, type) pairs of all literal arguments."""
    return F.flatten(
        F.transform(
            literals,
            lambda l: F.transform(
                l["args"], lambda a, i: F.struct(a["name"].alias("v"), F.get(schema_map[l["pred"]], i).alias("t"))
            ),
        )
    )


def _schema_map(schema: Schema) -> Column:
    pairs = []
    for p in schema:
        pairs += [F.lit(p.name), F.array(*[F.lit(t) for t in p.types])]
    return F.create_map(*pairs)


def type_consistent(literals: Column, schema: Schema) -> Column:
    """Every variable is used with one type only."""
    pairs = _typed_pairs(literals, _schema_map(schema))
    return F.size(F.array_distinct(pairs)) == F.size(F.array_distinct(F.transform(pairs, lambda p: p["v"])))


def instantiate(t: DataFrame, schema: Schema) -> DataFrame:
    """Templates with predicate names filled in: ``template_id, formula_id, text, literals``.

    R1..Rk take every ordered choice of distinct two-argument predicates; formulas whose variables
    would have two types are dropped, and so are renamings within a template.
    """
    two = Schema.of(*[p for p in schema if p.arity == 2])
    df = t.withColumn("rels", F.array_sort(F.array_distinct(F.transform("literals", lambda l: l["pred"]))))
    df = df.withColumn("names", F.array().cast("array<string>"))
    all_names = F.array(*[F.lit(p.name) for p in two])
    widest = int(t.agg(F.max(F.size("literals"))).first()[0] or 0)
    for k in range(widest):
        options = F.when(F.size("rels") > k, F.array_except(all_names, F.col("names"))).otherwise(
            F.array(F.lit(None).cast("string"))
        )
        df = df.withColumn("pick", F.explode(options)).withColumn(
            "names", F.when(F.col("pick").isNull(), F.col("names")).otherwise(F.concat("names", F.array("pick")))
        )
    named = F.transform(
        "literals",
        lambda l: F.struct(
            F.get(F.col("names"), (F.array_position(F.col("rels"), l["pred"]) - 1).cast("int")).alias("pred"),
            l["positive"].alias("positive"), l["args"].alias("args"),
        ),
    ).cast(LITERALS_TYPE)
    return (
        df.withColumn("literals", named)
        .filter(type_consistent(F.col("literals"), two))
        .select("template_id", L.canonical(F.col("literals"), "x", None, 3 if widest <= 3 else L.MAX_LITERALS).alias("c"))
        .select("template_id", "c.text", "c.literals")
        .dropDuplicates(["template_id", "text"])
        .select("template_id", rule_id(F.col("text")).alias("formula_id"), "text", "literals")
    )


def with_constants(formulas: DataFrame, schema: Schema) -> DataFrame:
    """Adds ``with_constants`` and, where a ``+`` argument exists, a second row with it marked."""
    plus_map = F.create_map(
        *[x for p in schema for x in (F.lit(p.name), F.array(*[F.lit(i in p.constant_args) for i in range(p.arity)]))]
    )
    marked_names = F.array_distinct(
        F.flatten(
            F.transform(
                "literals",
                lambda l: F.transform(
                    F.filter(l["args"], lambda a, i: F.get(plus_map[l["pred"]], i)), lambda a: a["name"]
                ),
            )
        )
    )
    df = formulas.withColumn("@plus", marked_names)
    marked = F.transform(
        "literals",
        lambda l: F.struct(
            l["pred"].alias("pred"), l["positive"].alias("positive"),
            F.transform(
                l["args"],
                lambda a: F.struct(
                    F.when(F.array_contains(F.col("@plus"), a["name"]), "plus").otherwise(a["kind"]).alias("kind"),
                    a["name"].alias("name"),
                ),
            ).alias("args"),
        ),
    ).cast(LITERALS_TYPE)
    plain = df.withColumn("with_constants", F.lit(False)).drop("@plus")
    second = (
        df.filter(F.size("@plus") > 0).withColumn("literals", marked).drop("@plus")
        .withColumns({"with_constants": F.lit(True), "text": L.text(F.col("literals"))})
    )
    return plain.unionByName(second)


def expand_constants(formulas: DataFrame, fb: FactBase) -> DataFrame:
    """One clause per choice of constants for the ``+`` arguments: adds ``instance`` text.

    The constant table may be large, the rule list is not; each ``+`` variable is one join on its type.
    """
    smap = _schema_map(fb.schema)
    consts = fb.constants().select("type", F.col("const").alias("@const")).distinct()
    pairs = F.array_distinct(
        F.flatten(
            F.transform(
                "literals",
                lambda l: F.filter(
                    F.transform(
                        l["args"],
                        lambda a, i: F.struct(
                            F.when(a["kind"] == "plus", a["name"]).alias("v"), F.get(smap[l["pred"]], i).alias("t")
                        ),
                    ),
                    lambda s: s["v"].isNotNull(),
                ),
            )
        )
    )
    df = formulas.withColumn("@todo", pairs)
    widest = df.agg(F.max(F.size("@todo"))).first()[0] or 0
    for _ in range(widest):
        pending = df.filter(F.size("@todo") > 0)
        done = df.filter(F.size("@todo") == 0)
        head = F.get("@todo", F.lit(0))
        grown = (
            pending.withColumn("type", head["t"]).join(consts, "type")
            .withColumn("literals", L.substitute(F.col("literals"), head["v"], F.col("@const")))
            .withColumn("@todo", F.slice("@todo", F.lit(2), F.size("@todo") - 1)).drop("type", "@const")
        )
        df = done.unionByName(grown)
    return df.drop("@todo").withColumn("instance", L.text(F.col("literals")))


def expand_signs(rules: DataFrame) -> DataFrame:
    """Every sign pattern of every rule (2^k rows), up to renaming."""
    n = F.size("literals")
    flipped = rules.withColumn("mask", F.explode(F.sequence(F.lit(0), (F.pow(F.lit(2.0), n) - 1).cast("int")))).select(
        L.with_signs(F.col("literals"), F.col("mask")).alias("literals")
    )
    return _distinct(flipped)


flip_signs = expand_signs
sign_cliques = expand_signs


def star_signs(rules: DataFrame, starred: Column) -> DataFrame:
    """Only literals whose 0-based index is in ``starred`` take both signs; one row per combination."""
    masked = rules.withColumn(
        "mask", F.explode(F.sequence(F.lit(0), (F.pow(F.lit(2.0), F.size(starred)) - 1).cast("int")))
    )
    lits = F.transform(
        "literals",
        lambda l, i: F.struct(
            l["pred"].alias("pred"),
            F.when(
                F.array_contains(starred, i),
                F.getbit(F.col("mask"), (F.array_position(starred, i) - 1).cast("int")) == 1,
            ).otherwise(l["positive"]).alias("positive"),
            l["args"].alias("args"),
        ),
    ).cast(LITERALS_TYPE)
    return masked.withColumn("literals", lits).drop("mask").withColumn("text", L.text(F.col("literals")))


def unit_clauses(schema: Schema, repeated: bool = False) -> list[Clause]:
    """P(x0,x1,..) per predicate; with ``repeated`` also every way of merging same-typed arguments."""
    from ..rules import Literal, Term

    out = []
    for p in schema:
        if not repeated:
            out.append(unit(p.name, schema))
            continue
        partitions = [()]
        for i, t in enumerate(p.types):
            grown = []
            for part in partitions:
                blocks = sorted(set(part))
                for b in blocks:
                    if p.types[part.index(b)] == t:
                        grown.append(part + (b,))
                grown.append(part + ((max(blocks) + 1) if blocks else 0,))
            partitions = grown
        for part in partitions:
            args = tuple(Term("var", f"x{b}") for b in part)
            out.append(Clause((Literal(p.name, True, args),)))
    return out


def expand(rules: DataFrame, schema: Schema, max_vars: int = 4, max_literals: int = 4) -> DataFrame:
    """Neighbours of each rule: add a literal, remove one, flip one sign; up to renaming.

    An added literal shares at least one variable with the rule; its other arguments are existing
    variables of the right type or new ones.
    """
    smap = _schema_map(schema)
    lits = F.col("literals")
    base = rules.select("literals")
    added = None
    for p in schema:
        df = base.withColumn("typed", F.array_distinct(_typed_pairs(lits, smap))).withColumn(
            "new_args", F.array().cast("array<string>")
        )
        for i, t in enumerate(p.types):
            known = F.transform(F.filter("typed", lambda s: s["t"] == t), lambda s: s["v"])
            fresh = [F.lit(f"n{j}") for j in range(i + 1) if p.types[j] == t]
            options = F.concat(known, F.array(*fresh))
            df = df.withColumn("pick", F.explode(options)).withColumn("new_args", F.concat("new_args", F.array("pick")))
        df = df.filter(F.arrays_overlap("new_args", F.transform("typed", lambda s: s["v"])))
        args = F.transform("new_args", lambda v: F.struct(F.lit("var").alias("kind"), v.alias("name")))
        df = df.withColumn("sign", F.explode(F.array(F.lit(True), F.lit(False)))).select(
            F.concat(lits, F.array(_literal(F.lit(p.name), F.col("sign"), args)).cast(LITERALS_TYPE)).alias("literals")
        )
        added = df if added is None else added.unionByName(df)
    n = F.size("literals")
    removed = base.filter(n > 1).withColumn("i", F.explode(F.sequence(F.lit(0), n - 1))).select(
        F.filter("literals", lambda l, j: j != F.col("i")).alias("literals")
    )
    flipped = base.withColumn("i", F.explode(F.sequence(F.lit(0), n - 1))).select(
        F.transform(
            "literals",
            lambda l, j: F.struct(
                l["pred"].alias("pred"), (l["positive"] != (j == F.col("i"))).alias("positive"), l["args"].alias("args")
            ),
        ).cast(LITERALS_TYPE).alias("literals")
    )
    every = added.unionByName(removed).unionByName(flipped).filter(F.size("literals") <= max_literals)
    every = every.filter((F.size(L.variables(F.col("literals"))) <= max_vars) & L.is_valid(F.col("literals")))
    grown = _distinct(every, max_literals=max_literals)
    return grown.join(_distinct(base, max_literals=max_literals).select("text"), "text", "left_anti")


def patterns(schema: Schema, spark: SparkSession, max_literals: int = 2, max_vars: int = 3) -> DataFrame:
    """All rule shapes reachable from unit clauses by adding literals, signs ignored."""
    from ..rules import rules_to_df

    seen = _distinct(rules_to_df(spark, unit_clauses(schema, repeated=True)))
    frontier = seen
    for _ in range(max_literals - 1):
        grown = expand(frontier, schema, max_vars, max_literals)
        positive = grown.filter(L.n_positive(F.col("literals")) == F.size("literals"))
        frontier = positive.join(seen.select("text"), "text", "left_anti")
        seen = seen.unionByName(frontier)
    return seen


def new_only(rules: DataFrame, theory: DataFrame) -> DataFrame:
    """Rules that are not in the theory, up to renaming."""
    # stored, or the join's test for nulls would write the canonical form of every row that the theory is read from
    known = cut(_distinct(theory).select("text"))
    return _distinct(rules).join(known, "text", "left_anti")


def lift(rules: DataFrame) -> DataFrame:
    """Rules grouped by their template: ``template_id, template, n_rules, rules``."""
    c = L.canonical(F.col("literals"), "T", "R")
    return (
        rules.select(c["text"].alias("template"), L.text(F.col("literals")).alias("rule"))
        .groupBy("template")
        .agg(F.count(F.lit(1)).alias("n_rules"), F.array_sort(F.collect_list("rule")).alias("rules"))
        .withColumn("template_id", rule_id(F.col("template")))
    )


def relevant(rules: DataFrame, query: list[str]) -> DataFrame:
    """Rules with at least one query predicate."""
    return rules.filter(F.exists("literals", lambda l: l["pred"].isin(query)))


def renamings(rules: DataFrame, schema: Schema) -> DataFrame:
    """Every reassignment of a rule's predicates to predicates of the same shape.

    The shape of a predicate is which of its arguments have equal types; variables are renamed by
    first use, so reassignments of variables collapse into the canonical form.
    """
    shape = {
        p.name: ",".join(str(p.types.index(t)) for t in p.types) for p in schema
    }
    shape_map = F.create_map(*[x for n, s in shape.items() for x in (F.lit(n), F.lit(s))])
    names = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(s).alias("s")) for n, s in shape.items()])
    df = rules.select(
        "literals", F.array_distinct(F.transform("literals", lambda l: l["pred"])).alias("rels"),
        F.array().cast("array<string>").alias("names"),
    )
    widest = df.agg(F.max(F.size("rels"))).first()[0] or 0
    for k in range(widest):
        target = shape_map[F.get("rels", F.lit(k))]
        fitting = F.array_except(
            F.transform(F.filter(names, lambda x: x["s"] == target), lambda x: x["n"]), F.col("names")
        )
        options = F.when(F.size("rels") > k, fitting).otherwise(F.array(F.lit(None).cast("string")))
        df = df.withColumn("pick", F.explode(options)).withColumn(
            "names", F.when(F.col("pick").isNull(), F.col("names")).otherwise(F.concat("names", F.array("pick")))
        )
    named = F.transform(
        "literals",
        lambda l: F.struct(
            F.get(F.col("names"), (F.array_position(F.col("rels"), l["pred"]) - 1).cast("int")).alias("pred"),
            l["positive"].alias("positive"), l["args"].alias("args"),
        ),
    ).cast(LITERALS_TYPE)
    return _distinct(df.select(named.alias("literals")).filter(type_consistent(F.col("literals"), schema)))


def min_true_rate(rules: list[Clause], fb: FactBase, rate: float) -> DataFrame:
    """Rules whose share of true groundings reaches ``rate``, pooled over folds."""
    sums = clause_counts(rules, fb).groupBy("clause_id").agg(
        F.sum("n_true").cast("double").alias("t"), F.sum("n_total").cast("double").alias("n")
    )
    return sums.withColumn("rate", F.try_divide("t", "n")).filter(F.col("rate") >= rate).select("clause_id", "rate")
