"""Rules: disjunctions of signed literals.

A rule list is small by nature, so it lives on the driver as frozen dataclasses when a job has to be
built from it, and as a DataFrame with literal structs when rules are generated, read or written.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession

from .plans.local import small_table
from .schema import Schema

LITERALS_TYPE = (
    "array<struct<pred:string,positive:boolean,args:array<struct<kind:string,name:string>>>>"
)
CLAUSES_DDL = f"clause_id string, formula_id string, weight double, hard boolean, literals {LITERALS_TYPE}"
EQUALS = "="
EXISTS = "EXIST"  # at least one binding of the bound variables makes the inner literals true
EXISTS_ONE = "EXIST!"  # exactly one does
PLAIN_CONSTANT = r"^[A-Z0-9_]\w*$"  # written without quotes; anything else could be read as something else


@dataclass(frozen=True, order=True)
class Term:
    kind: str  # "var" or "const"
    name: str

    @property
    def is_var(self) -> bool:
        return self.kind == "var"

    def __str__(self) -> str:
        return self.name if self.is_var or re.search(PLAIN_CONSTANT, self.name) else f'"{self.name}"'


def term(text: str) -> Term:
    """Lower-case initial means variable; upper-case, digit or quote means constant."""
    text = text.strip()
    if len(text) > 1 and text[0] == text[-1] == '"':
        return Term("const", text[1:-1])
    return Term("var" if text[:1].islower() else "const", text)


@dataclass(frozen=True)
class Literal:
    """A signed atom, or an existential: pred EXIST, args the free variables of the conjunction ``inner``."""

    pred: str
    positive: bool
    args: tuple[Term, ...]
    bound: tuple[str, ...] = ()
    inner: tuple["Literal", ...] = ()

    def rename(self, sub: dict[str, Term]) -> "Literal":
        if not self.inner:
            return replace(self, args=tuple(sub.get(a.name, a) if a.is_var else a for a in self.args))
        sub = {v: t for v, t in sub.items() if v not in self.bound}
        taken = {t.name for t in sub.values() if t.is_var} | {a.name for a in self.args}
        names: dict[str, Term] = {}
        for b in self.bound:  # a bound variable gives way to an outer one of its name
            new = b
            while new in taken:
                new += "_"
            taken.add(new)
            names[b] = Term("var", new)
        inner = tuple(l.rename({**sub, **names}) for l in self.inner)
        return existential(tuple(t.name for t in names.values()), inner, self.positive, self.pred == EXISTS_ONE)

    def __str__(self) -> str:
        sign = "" if self.positive else "!"
        if self.inner:
            body = " ^ ".join(map(str, self.inner))
            return f"{sign}{self.pred} {','.join(self.bound)} {body if len(self.inner) == 1 else f'({body})'}"
        return f"{sign}{self.pred}({','.join(map(str, self.args))})"


def existential(bound: tuple[str, ...], inner: tuple[Literal, ...], positive: bool = True, exactly_one: bool = False) -> Literal:
    """Existential literal over a conjunction; its arguments are the variables that are not bound, in order."""
    used = dict.fromkeys(a.name for l in inner for a in l.args if a.is_var)
    missing = [b for b in bound if b not in used]
    if missing or any(l.inner for l in inner):
        raise ValueError(f"bound variables {missing} are not used" if missing else "existentials cannot be nested")
    free = tuple(Term("var", v) for v in used if v not in bound)
    return Literal(EXISTS_ONE if exactly_one else EXISTS, positive, free, tuple(bound), tuple(inner))


def plain_only(clauses: list["Clause"], what: str) -> None:
    """Raise for rules with existential literals where they have no meaning yet."""
    for c in clauses:
        if any(l.inner for l in c.literals):
            raise ValueError(f"{what} takes no existential literals: {c.text}")


@dataclass(frozen=True)
class Clause:
    literals: tuple[Literal, ...]
    weight: float = 0.0
    hard: bool = False
    clause_id: str = ""
    formula_id: str = ""

    def __post_init__(self):
        text = " v ".join(map(str, self.literals))
        if not self.clause_id:
            object.__setattr__(self, "clause_id", text)
        if not self.formula_id:
            object.__setattr__(self, "formula_id", self.clause_id)

    @property
    def text(self) -> str:
        return " v ".join(map(str, self.literals))

    def variables(self) -> list[str]:
        seen: dict[str, None] = {}
        for lit in self.literals:
            for a in lit.args:
                if a.is_var:
                    seen.setdefault(a.name)
        return list(seen)

    def var_types(self, schema: Schema) -> dict[str, str]:
        """Type of each variable; a variable used with two types is an error."""
        out: dict[str, str] = {}
        for lit in self.literals:
            if lit.inner:
                within = Clause(lit.inner).var_types(schema)
                types = tuple(within[a.name] for a in lit.args)
            elif lit.pred not in schema:
                continue
            else:
                types = schema[lit.pred].types
            if len(types) != len(lit.args):
                raise ValueError(f"{lit} has {len(lit.args)} arguments, declared {len(types)}")
            for a, t in zip(lit.args, types):
                if a.is_var and out.setdefault(a.name, t) != t:
                    raise ValueError(f"variable {a.name} of {self.text} has types {out[a.name]} and {t}")
        for lit in self.literals:  # in a computed literal, untyped variables follow a typed neighbour
            known = [out[a.name] for a in lit.args if a.is_var and a.name in out]
            for a in lit.args:
                if known and a.is_var:
                    out.setdefault(a.name, known[0])
        untyped = [v for v in self.variables() if v not in out]
        if untyped:
            raise ValueError(f"variables {untyped} of {self.text} occur in no declared predicate")
        return out

    def is_unit(self) -> bool:
        """One literal over pairwise distinct variables."""
        if len(self.literals) != 1:
            return False
        args = self.literals[0].args
        return not self.literals[0].inner and all(a.is_var for a in args) and len(set(args)) == len(args)


_TERM = r'(?:"[^"]*"|[^\s"(),=!]+)'
_LIT = re.compile(rf'(!?)\s*(\w+)\(\s*({_TERM}(?:\s*,\s*{_TERM})*)\s*\)|(!?)\s*({_TERM})\s*(!=|=)\s*({_TERM})')


_EXIST = re.compile(r"(!?)\s*EXIST(!?)\s+(\w+(?:\s*,\s*\w+)*)\s+(\(?)\s*")


def _literal(text: str, at: int) -> tuple[Literal, int] | None:
    """The literal that starts at a place of the text, and the place behind it."""
    m = _EXIST.match(text, at)
    if m is not None:
        neg, one, names, group = m.groups()
        inner, at = [], m.end()
        while True:
            got = _literal(text, at)
            if got is None:
                return None
            inner.append(got[0])
            more = re.compile(r"\s*(\^|\))\s*").match(text, got[1]) if group else None
            if not group:
                at = got[1]
                break
            if more is None:
                return None
            at = more.end()
            if more.group(1) == ")":
                break
        return existential(tuple(re.findall(r"\w+", names)), tuple(inner), not neg, bool(one)), at
    m = _LIT.match(text, at)
    if m is None:
        return None
    neg, pred, args, neg2, left, op, right = m.groups()
    if pred:
        return Literal(pred, not neg, tuple(term(a) for a in re.findall(_TERM, args))), m.end()
    return Literal(EQUALS, (op == "=") != bool(neg2), (term(left), term(right))), m.end()


def clause(text: str, weight: float = 0.0, hard: bool = False, clause_id: str = "") -> Clause:
    """Build a rule from its written form, e.g. ``clause("!A(x,y) v B(y,x)")``. Text that is not a rule is an error.

    ``EXIST y B(x,y)`` and ``EXIST y,z (B(x,y) ^ !A(y,z))`` are literals too; ``EXIST!`` means exactly one binding.
    """
    lits, at = [], 0
    while True:
        got = _literal(text, at + len(text[at:]) - len(text[at:].lstrip()))
        if got is None:
            raise ValueError(f"not a rule from {text[at:]!r} on: {text!r}")
        lits.append(got[0])
        rest = text[got[1] :]
        if not rest.strip():
            break
        sep = re.match(r"\s+v\s+", rest) or (re.match(r"\s*v\s+", rest) if text[got[1] - 1].isspace() else None)
        if sep is None:
            raise ValueError(f"not a rule from {rest!r} on: {text!r}")
        at = got[1] + sep.end()
    return Clause(tuple(lits), weight, hard, clause_id)


def unit(decl_name: str, schema: Schema, weight: float = 0.0) -> Clause:
    args = tuple(Term("var", f"x{i}") for i in range(schema[decl_name].arity))
    return Clause((Literal(decl_name, True, args),), weight)


def rules_to_df(spark: SparkSession, rules: list[Clause]) -> DataFrame:
    plain_only(rules, "a rule table")
    rows = [
        (
            c.clause_id,
            c.formula_id,
            float(c.weight),
            c.hard,
            [(l.pred, l.positive, [(a.kind, a.name) for a in l.args]) for l in c.literals],
        )
        for c in rules
    ]
    return small_table(spark, rows, CLAUSES_DDL)


def collect_rules(df: DataFrame) -> list[Clause]:
    """Bring a rule list to the driver, where the grounding jobs are built from it."""
    cols = set(df.columns)
    out = []
    for r in df.orderBy("clause_id").collect():
        lits = tuple(
            Literal(l["pred"], l["positive"], tuple(Term(a["kind"], a["name"]) for a in l["args"]))
            for l in r["literals"]
        )
        out.append(
            Clause(
                lits,
                (r["weight"] or 0.0) if "weight" in cols else 0.0,
                bool(r["hard"]) if "hard" in cols else False,
                r["clause_id"],
                r["formula_id"] if "formula_id" in cols else "",
            )
        )
    return out
