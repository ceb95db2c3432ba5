"""What unit propagation, colouring and grounding leave on disk, and that their cheaper forms give the same."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from factweave.operators import infer as I
from factweave.plans import storage

GROUND = "fold int, gid string, lits array<struct<atom:string,positive:boolean>>, weight double, hard boolean, frequency double"


def shuffle_files(spark):
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f for top in dirs for _, _, names in os.walk(str(top)) for f in names if f.startswith("shuffle_")}


def settled(spark, before):
    for _ in range(50):  # they go in the background
        left = shuffle_files(spark) - before
        if not left:
            break
        time.sleep(0.1)
    return left


def chain(n):
    rows = [(0, "g0", [("a0", True)], 0.0, True, 1.0), (0, "soft", [("a1", False), ("z", True)], 0.5, False, 1.0)]
    return rows + [(0, f"g{i + 1}", [(f"a{i}", False), (f"a{i + 1}", True)], 0.0, True, 1.0) for i in range(n)]


def test_propagation_leaves_no_shuffle_files(spark):
    g = spark.createDataFrame(chain(18), GROUND).repartition(3, "gid")
    before = shuffle_files(spark)
    left, fixed = I.propagate_units(g)
    assert len(settled(spark, before)) < 60  # nineteen rounds; a stage that is cancelled may write after its query has ended
    assert {(r.atom, r.value) for r in fixed.collect()} == {(f"a{i}", True) for i in range(19)}
    assert [(r.gid, [(l.atom, l.positive) for l in r.lits]) for r in left.collect()] == [("soft", [("z", True)])]


def test_propagation_keeps_clauses_that_repeat(spark):
    rows = [*chain(2), (0, "soft", [("a1", False), ("z", True)], 0.5, False, 1.0), (1, "soft", [("a1", False), ("z", True)], 0.5, False, 1.0)]
    left = I.propagate_units(spark.createDataFrame(rows, GROUND))[0]
    got = sorted((r.fold, r.gid, [(l.atom, l.positive) for l in r.lits]) for r in left.collect())
    assert got == [(0, "soft", [("z", True)])] * 2 + [(1, "soft", [("a1", False), ("z", True)])]


def plain_colours(rows, prio):
    """Round by round: atoms of the highest priority in all their clauses; rows of one gid are one clause."""
    clauses = {}
    for fold, gid, lits, *_ in rows:
        clauses.setdefault((fold, gid), set()).update((fold, a) for a, _ in lits)
    open_, out, c = set().union(*clauses.values()), {}, 0
    while open_:
        top = {a for a in open_ if all(max(x & open_, key=prio) == a for x in clauses.values() if a in x)}
        out |= dict.fromkeys(top, c)
        open_ -= top
        c += 1
    return out


def test_colours_are_those_of_the_plain_rounds_and_leave_no_shuffle_files(spark):
    rng = random.Random(5)
    rows = []
    for i in range(80):  # a gid may repeat, and its rows are one clause
        names = rng.sample([f"a{j}" for j in range(25)], rng.randint(1, 4))
        rows.append((i % 2, f"g{i // 3}", [(a, rng.random() < 0.5) for a in names], 1.0, False, 1.0))
    g = spark.createDataFrame(rows, GROUND)
    hashes = {r.atom: r.h for r in spark.range(25).select(F.concat(F.lit("a"), F.col("id").cast("string")).alias("atom")).select(
        "atom", F.xxhash64(F.lit(7), "atom").alias("h")).collect()}
    before = shuffle_files(spark)
    found = I.colour(g, 7)
    assert not settled(spark, before)
    got = [((r.fold, r.atom), r.colour) for r in found.collect()]
    want = plain_colours(rows, lambda a: (hashes[a[1]], a[1]))
    assert dict(got) == want and len(got) == len(want)


def test_rows_with_a_partner_pass_the_filter(spark, monkeypatch):
    df = spark.range(4000).select((F.col("id") % 2).cast("int").alias("fold"), F.concat(F.lit("x"), F.col("id").cast("string")).alias("atom"))
    keys = storage.stored(df.filter("atom LIKE 'x1%'"), "keys")
    for bits in (26, 15):
        monkeypatch.setattr(storage, "FILTER_BITS", bits)
        thin = storage.thinned(df, keys, ["fold", "atom"])
        assert thin.columns == df.columns
        assert keys.exceptAll(thin).isEmpty()
        assert thin.count() < 1.2 * keys.count()
    assert storage.thinned(df, storage.stored(df.filter("false"), "none"), ["fold", "atom"]).isEmpty()


def test_contradictions_are_found(spark):
    rows = [*chain(3), (0, "no", [("a3", False), ("a2", False)], 0.0, True, 1.0)]
    with pytest.raises(ValueError, match="contradict"):
        I.propagate_units(spark.createDataFrame(rows, GROUND))
