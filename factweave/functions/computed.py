"""Computed predicates: literals decided by a Column expression instead of stored facts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def _int(c: Column) -> Column:
    return c.try_cast("bigint")


def _int_relation(fn: Callable[..., Column]) -> Callable[..., Column]:
    return lambda *cols: F.coalesce(fn(*[_int(c) for c in cols]), F.lit(False))


# Constants are strings in the fact table; the integer relations cast their arguments and are false
# for arguments that are not integers.  Functions f(a, b) = r are written as relations f(a, b, r).
_BUILT_IN: dict[str, Callable[..., Column]] = {
    "greaterThan": _int_relation(lambda a, b: a > b),
    "lessThan": _int_relation(lambda a, b: a < b),
    "greaterThanEq": _int_relation(lambda a, b: a >= b),
    "lessThanEq": _int_relation(lambda a, b: a <= b),
    "succ": _int_relation(lambda a, r: r == a + 1),
    "plus": _int_relation(lambda a, b, r: r == a + b),
    "minus": _int_relation(lambda a, b, r: r == a - b),
    "times": _int_relation(lambda a, b, r: r == a * b),
    "dividedBy": _int_relation(lambda a, b, r: (b != 0) & (r == F.call_function("try_divide", a - F.try_mod(a, b), b))),
    "mod": _int_relation(lambda a, b, r: (b != 0) & (r == F.try_mod(a, b))),
    "substr": lambda a, b: F.contains(b, a),
    "concat": lambda a, b, r: r == F.concat(a, b),
}

_registered: dict[str, Callable[..., Column]] = dict(_BUILT_IN)


def register_predicate(name: str, column_fn: Callable[..., Column]) -> None:
    """Make ``column_fn(*argument_columns) -> boolean Column`` usable as a literal in rules.

    Plain Column expressions stay in generated code; a vectorised pandas UDF works through the same hook.
    """
    _registered[name] = column_fn


def is_computed(name: str) -> bool:
    return name in _registered


def computed_column(name: str, *args: Column) -> Column:
    return _registered[name](*args)
