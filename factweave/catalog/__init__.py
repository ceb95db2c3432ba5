"""Registered queries: each runs an operator over the given tables, with equivalent SQL where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = " ".join(sql.split())
        return fn

    return add


# The same fact views in SQL: distinct (a, b) pairs with type-prefixed constants.
VIEW_SQL = {
    "CustNation": "SELECT DISTINCT 'C' || c_custkey AS a, 'N' || c_nationkey AS b FROM customer",
    "SuppNation": "SELECT DISTINCT 'S' || s_suppkey AS a, 'N' || s_nationkey AS b FROM supplier",
    "NationRegion": "SELECT DISTINCT 'N' || n_nationkey AS a, 'R' || n_regionkey AS b FROM nation",
    "Placed": "SELECT DISTINCT 'C' || o_custkey AS a, 'O' || o_orderkey AS b FROM orders",
    "Contains": "SELECT DISTINCT 'O' || l_orderkey AS a, 'P' || l_partkey AS b FROM lineitem",
    "Supplies": "SELECT DISTINCT 'S' || l_suppkey AS a, 'P' || l_partkey AS b FROM lineitem",
    "Segment": "SELECT DISTINCT 'C' || c_custkey AS a, c_mktsegment AS b FROM customer",
    "Priority": "SELECT DISTINCT 'O' || o_orderkey AS a, o_orderpriority AS b FROM orders",
    "Brand": "SELECT DISTINCT 'P' || p_partkey AS a, p_brand AS b FROM part",
    "Size": "SELECT DISTINCT 'P' || p_partkey AS a, CAST(p_size AS VARCHAR) AS b FROM part",
    "Did": "SELECT DISTINCT 'U' || user_id AS a, event_type AS b FROM events",
    "DocLang": "SELECT DISTINCT 'D' || doc_id AS a, lang AS b FROM documents",
    "DocSource": "SELECT DISTINCT 'D' || doc_id AS a, source AS b FROM documents",
    "Quality": "SELECT DISTINCT 'D' || doc_id AS a, 'Q' || quality AS b FROM labels",
    "Toxic": "SELECT DISTINCT 'D' || doc_id AS a, 'T' || toxic AS b FROM labels",
    "HasWord": "SELECT DISTINCT 'D' || doc_id AS a, w AS b FROM (SELECT doc_id, "
    "unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+')) AS w FROM documents) WHERE w <> ''",
}
TYPES = {
    "CustNation": ("customer", "nation"), "SuppNation": ("supplier", "nation"), "NationRegion": ("nation", "region"),
    "Placed": ("customer", "orders_"), "Contains": ("orders_", "part_"), "Supplies": ("supplier", "part_"),
    "Segment": ("customer", "segment"), "Priority": ("orders_", "priority"), "Brand": ("part_", "brand"),
    "Size": ("part_", "number"), "Did": ("user", "event_type"), "DocLang": ("doc", "lang"), "DocSource": ("doc", "source"),
    "Quality": ("doc", "quality"), "Toxic": ("doc", "toxic"), "HasWord": ("doc", "word"),
}


def views(*preds: str) -> str:
    """WITH clause holding the fact views and one ``n_<type>`` scalar view per type of the schema."""
    parts = [f"{p} AS ({VIEW_SQL[p]})" for p in preds]
    by_type: dict[str, list[str]] = {}
    for p in preds:
        for col, t in zip("ab", TYPES[p]):
            by_type.setdefault(t, []).append(f"SELECT {col} AS c FROM {p}")
    for t, selects in by_type.items():
        parts.append(f"d_{t} AS (SELECT DISTINCT c FROM ({' UNION ALL '.join(selects)}))")
        parts.append(f"n_{t} AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM d_{t})")
    return "WITH " + ", ".join(parts) + " "


def n(type_: str) -> str:
    return f"(SELECT n FROM n_{type_})"


def dbl(*cols: str):
    """Exact decimal counts as doubles for comparison."""
    return [F.col(c).cast("double").alias(c) for c in cols]


def r6(col: str, digits: int = 6):
    """Rounded for comparison; adding zero turns -0.0 into 0.0."""
    return (F.round(F.col(col), digits) + F.lit(0.0)).alias(col)


def load() -> None:
    """Import the modules that register queries."""
    from . import base, learning, rules_q, scoring  # noqa: F401
