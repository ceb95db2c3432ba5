"""Column expressions over literal arrays: variables, canonical form, validity, signs."""

from __future__ import annotations

import re
from itertools import permutations

import pandas as pd
from pyspark.sql import Column, functions as F

from ..rules import LITERALS_TYPE, PLAIN_CONSTANT

MAX_LITERALS = 5  # up to so many literals all orders are written as an expression; longer rules are searched


_PLAIN = re.compile(PLAIN_CONSTANT)


def variables(literals: Column) -> Column:
    """Distinct variable names in order of first use."""
    args = F.flatten(F.transform(literals, lambda l: l["args"]))
    return F.array_distinct(
        F.transform(F.filter(args, lambda a: a["kind"] != "const"), lambda a: a["name"])
    )


def n_positive(literals: Column) -> Column:
    return F.size(F.filter(literals, lambda l: l["positive"]))


def is_definite(literals: Column) -> Column:
    """Exactly one positive literal."""
    return n_positive(literals) == 1


def is_connected(literals: Column) -> Column:
    """All literals reachable from the first through shared variables."""

    def names(l: Column) -> Column:
        return F.transform(F.filter(l["args"], lambda a: a["kind"] != "const"), lambda a: a["name"])

    def grow(seen: Column) -> Column:
        touching = F.filter(literals, lambda l: F.arrays_overlap(names(l), seen))
        return F.array_distinct(F.concat(seen, F.flatten(F.transform(touching, names))))

    # as many steps as there are literals reach all that can be reached
    reached = F.aggregate(literals, names(F.element_at(literals, 1)), lambda seen, _: grow(seen))
    return F.forall(literals, lambda l: F.arrays_overlap(names(l), reached))


def term_text(a: Column) -> Column:
    """A constant that could be read as a variable, or has unusual characters, is written in quotes."""
    quoted = (a["kind"] == "const") & ~a["name"].rlike(PLAIN_CONSTANT)
    return F.when(quoted, F.concat(F.lit('"'), a["name"], F.lit('"'))).otherwise(
        F.concat(F.when(a["kind"] == "plus", "+").otherwise(""), a["name"]))


def literal_text(l: Column) -> Column:
    args = F.array_join(F.transform(l["args"], term_text), ",")
    return F.concat(F.when(l["positive"], "").otherwise("!"), l["pred"], F.lit("("), args, F.lit(")"))


def text(literals: Column) -> Column:
    return F.array_join(F.transform(literals, literal_text), " v ")


def renumber(literals: Column, var: str = "x", pred: str | None = None) -> Column:
    """Variables renamed by first use to x1, x2, ...; predicates to R1, R2, ... when ``pred`` is given."""
    vs = variables(literals)
    preds = F.array_distinct(F.transform(literals, lambda l: l["pred"]))

    def arg(a: Column) -> Column:
        pos = F.array_position(vs, a["name"]).cast("string")
        return F.struct(
            a["kind"].alias("kind"),
            F.when(a["kind"] == "const", a["name"]).otherwise(F.concat(F.lit(var), pos)).alias("name"),
        )

    def lit(l: Column) -> Column:
        name = l["pred"] if pred is None else F.concat(F.lit(pred), F.array_position(preds, l["pred"]).cast("string"))
        return F.struct(name.alias("pred"), l["positive"].alias("positive"), F.transform(l["args"], arg).alias("args"))

    return F.transform(literals, lit).cast(LITERALS_TYPE)


def _rest(literals, used: tuple, names: dict, preds: dict, pred: str | None) -> tuple:
    """What literals not yet placed look like, up to the names of variables that have no number yet.

    They fall into parts linked by such variables; a part of up to MAX_LITERALS literals is described by its least form over
    all orders, a larger one by its own variables. States of equal description go on alike.
    """
    parts: list[tuple[set, list]] = []
    for i, l in enumerate(literals):
        if i not in used:
            own = {a["name"] for a in l["args"] if a["kind"] != "const" and a["name"] not in names}
            linked = [p for p in parts if p[0] & own]
            parts = [p for p in parts if not p[0] & own]
            parts.append((own.union(*(p[0] for p in linked)), [x for p in linked for x in p[1]] + [l]))

    def form(lits) -> tuple:
        seen: dict = {}
        return tuple(
            (l["positive"], preds.get(l["pred"], 0) if pred else 0, l["pred"] if l["pred"] not in preds else "",
             tuple((a["kind"], a["name"] if a["kind"] == "const" else "", 0 if a["kind"] == "const" else names.get(a["name"])
                    or -1 - seen.setdefault(a["name"], len(seen))) for a in l["args"]))
            for l in lits
        )

    def described(lits) -> tuple:
        if len(lits) <= MAX_LITERALS:
            return 0, min(form(p) for p in permutations(lits))
        return 1, tuple(sorted(str((l["positive"], l["pred"], [(a["kind"], names.get(a["name"], a["name"])) for a in l["args"]])) for l in lits))

    return tuple(sorted(described(lits) for _, lits in parts))


def _least_order(literals, var: str, pred: str | None) -> list[int]:
    """Positions of the literals of a long rule in its least written form.

    Literals are placed one by one; of all ways to go on, those with the least next literal are kept. No literal
    text is the beginning of another, so the least beginning belongs to the least whole. Ways that leave the same rest
    are one, so literals that can change places, like the rays of a star, are not tried in every order.
    """

    def written(l, names: dict, preds: dict) -> tuple[str, dict, dict]:
        names, preds = dict(names), dict(preds)
        head = l["pred"] if pred is None else f"{pred}{preds.setdefault(l['pred'], len(preds) + 1)}"
        args = []
        for a in l["args"]:
            if a["kind"] == "const":
                args.append(a["name"] if _PLAIN.search(a["name"]) else f'"{a["name"]}"')
            else:
                args.append(("+" if a["kind"] == "plus" else "") + f"{var}{names.setdefault(a['name'], len(names) + 1)}")
        return f"{'' if l['positive'] else '!'}{head}({','.join(args)})", names, preds

    states = [((), {}, {})]
    for _ in range(len(literals)):
        ways: list = []
        least = None
        for order, names, preds in states:
            for i, l in enumerate(literals):
                if i not in order:
                    text, n, p = written(l, names, preds)
                    if least is None or text < least:
                        least, ways = text, []
                    if text == least:
                        ways.append((order + (i,), n, p))
        grown: dict = {}
        for order, n, p in ways:
            grown.setdefault((len(n), len(p), _rest(literals, order, n, p, pred)), (order, n, p))
        states = list(grown.values())
    return [i + 1 for i in states[0][0]] if literals else []


def canonical(literals: Column, var: str = "x", pred: str | None = None, max_literals: int = MAX_LITERALS) -> Column:
    """``struct<text, literals>``: the least written form over all literal orders, after renaming.

    Rules of up to ``max_literals`` literals are compared in all orders; for longer ones the order is searched literal by
    literal in Arrow batches, where ways that leave the same rest are followed once.
    """
    orders = None

    @F.pandas_udf("array<int>")
    def searched(rules: pd.Series) -> pd.Series:
        return rules.map(lambda r: None if r is None else _least_order([dict(l) for l in r], var, pred))
    for n in range(1, max_literals + 1):
        perms = F.array(*[F.array(*[F.lit(i + 1) for i in p]) for p in permutations(range(n))])
        case = F.size(literals) == n
        orders = F.when(case, perms) if orders is None else orders.when(case, perms)
    if max_literals >= MAX_LITERALS:
        orders = orders.otherwise(F.array(searched(F.when(F.size(literals) > max_literals, literals))))

    def form(order: Column) -> Column:
        lits = renumber(F.transform(order, lambda i: F.element_at(literals, i)), var, pred)
        return F.struct(text(lits).alias("text"), lits.alias("literals"))

    return F.array_min(F.transform(orders, form))


def is_valid(literals: Column) -> Column:
    """No literal twice and no atom with both signs."""
    atoms = F.transform(
        literals, lambda l: F.concat_ws("|", l["pred"], F.array_join(F.transform(l["args"], term_text), ","))
    )
    return F.size(F.array_distinct(atoms)) == F.size(literals)


def with_signs(literals: Column, mask: Column) -> Column:
    """Literal i is positive iff bit i of the mask is set."""
    return F.transform(
        literals,
        lambda l, i: F.struct(
            l["pred"].alias("pred"), (F.getbit(mask, i) == 1).alias("positive"), l["args"].alias("args")
        ),
    ).cast(LITERALS_TYPE)


def substitute(literals: Column, name: Column, value: Column, kind: str = "const") -> Column:
    """Replace a variable everywhere."""
    return F.transform(
        literals,
        lambda l: F.struct(
            l["pred"].alias("pred"),
            l["positive"].alias("positive"),
            F.transform(
                l["args"],
                lambda a: F.struct(
                    F.when((a["kind"] != "const") & (a["name"] == name), kind).otherwise(a["kind"]).alias("kind"),
                    F.when((a["kind"] != "const") & (a["name"] == name), value).otherwise(a["name"]).alias("name"),
                ),
            ).alias("args"),
        ),
    ).cast(LITERALS_TYPE)
