"""Facts from ordinary tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..facts import FactBase, union_all
from ..plans.storage import small_tasks
from ..schema import Predicate, Schema


def facts_from_table(
    df: DataFrame,
    pred: str,
    cols: list[str | Column],
    prefixes: tuple[str, ...] = (),
    fold: Column | int = 0,
    truth: str = "true",
) -> DataFrame:
    """One fact per row; duplicates are dropped when a relation is read, not here.

    Constants are strings; ``prefixes`` keep the constants of different types apart.
    """
    prefixes = prefixes or ("",) * len(cols)
    exprs = [F.col(c) if isinstance(c, str) else c for c in cols]
    args = [
        F.concat(F.lit(p), c.cast("string")) if p else c.cast("string") for p, c in zip(prefixes, exprs)
    ]
    fold_col = F.lit(fold) if isinstance(fold, int) else fold
    rows = df
    for c in exprs:
        rows = rows.filter(c.isNotNull())
    return rows.select(
        fold_col.cast("int").alias("fold"), F.lit(pred).alias("pred"), F.array(*args).alias("args"), F.lit(truth).alias("truth")
    )


# Fact views over the order-processing, event and document tables:
# predicate: (types, table, columns, constant prefixes)
VIEWS: dict[str, tuple[tuple[str, ...], str, tuple[str, ...], tuple[str, ...]]] = {
    "CustNation": (("customer", "nation"), "customer", ("c_custkey", "c_nationkey"), ("C", "N")),
    "SuppNation": (("supplier", "nation"), "supplier", ("s_suppkey", "s_nationkey"), ("S", "N")),
    "NationRegion": (("nation", "region"), "nation", ("n_nationkey", "n_regionkey"), ("N", "R")),
    "Placed": (("customer", "order"), "orders", ("o_custkey", "o_orderkey"), ("C", "O")),
    "Contains": (("order", "part"), "lineitem", ("l_orderkey", "l_partkey"), ("O", "P")),
    "Supplies": (("supplier", "part"), "lineitem", ("l_suppkey", "l_partkey"), ("S", "P")),
    "Segment": (("customer", "segment"), "customer", ("c_custkey", "c_mktsegment"), ("C", "")),
    "Priority": (("order", "priority"), "orders", ("o_orderkey", "o_orderpriority"), ("O", "")),
    "Brand": (("part", "brand"), "part", ("p_partkey", "p_brand"), ("P", "")),
    "Size": (("part", "number"), "part", ("p_partkey", "p_size"), ("P", "")),
    "Did": (("user", "event_type"), "events", ("user_id", "event_type"), ("U", "")),
    "DocLang": (("doc", "lang"), "documents", ("doc_id", "lang"), ("D", "")),
    "DocSource": (("doc", "source"), "documents", ("doc_id", "source"), ("D", "")),
    "Quality": (("doc", "quality"), "labels", ("doc_id", "quality"), ("D", "Q")),
    "Toxic": (("doc", "toxic"), "labels", ("doc_id", "toxic"), ("D", "T")),
}
CONSTANT_ARGS = {"Segment": (1,), "Priority": (1,), "Brand": (1,), "Did": (1,), "DocLang": (1,), "DocSource": (1,),
                 "Quality": (1,), "Toxic": (1,)}
EXCLUSIVE_ARGS = {"CustNation": (1,), "Segment": (1,), "Priority": (1,), "Quality": (1,)}
WORD = r"[^\p{L}\p{N}]+"


def view_fact_base(spark, folder: str, preds: list[str], folds: int = 1) -> FactBase:
    """Fact base over parquet tables in a folder; ``HasWord(doc, word)`` is tokenised from whole texts.

    With ``folds`` > 1, customers, orders, ... are dealt to folds by the first argument. Limits the shuffle that the
    session's adaptive execution puts in one task (``small_tasks``).
    """
    small_tasks(spark)
    decls, parts = [], []
    for pred in preds:
        if pred == "HasWord":
            decls.append(Predicate("HasWord", ("doc", "word"), (1,)))
            words = F.filter(F.split(F.lower("text"), WORD), lambda w: w != "")
            df = spark.read.parquet(f"{folder}/documents.parquet").select(
                "doc_id", F.explode(F.array_distinct(words)).alias("word")
            )
            parts.append(facts_from_table(df, "HasWord", ["doc_id", "word"], ("D", "")))
            continue
        types, table, cols, prefixes = VIEWS[pred]
        decls.append(Predicate(pred, types, CONSTANT_ARGS.get(pred, ()), EXCLUSIVE_ARGS.get(pred, ())))
        df = spark.read.parquet(f"{folder}/{table}.parquet")
        fold: Column | int = 0
        if folds > 1:
            fold = F.pmod(F.col(cols[0]).cast("bigint"), F.lit(folds))
        parts.append(facts_from_table(df, pred, list(cols), prefixes, fold))
    return FactBase(Schema.of(*decls), union_all(parts))
