"""SimHash near-duplicates by a self-join of the binary trie of fingerprints.

Distinct fingerprints are split by their leading bits into subtrees. Every pair of subtrees whose leading
bits differ in at most the allowed number is one group; in it, pairs of trie nodes are followed down
together, adding up differing bits and dropping a pair once the budget is exceeded. A group returns a
spanning forest of its links, never all pairs; components of the forests are joined over Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from . import common as C, graph

WIDTH = 3
SEED = 42
SUBTREE = 1 << 13  # leading bits are added until subtrees hold about so many fingerprints
FRONTIER = 1 << 17  # node pairs followed at a time
_LOWER = bytes(C.LOWER)


def fingerprint_batch(texts: list[bytes]) -> np.ndarray:
    """64-bit SimHash of each text: majority of the bits of its shingles' XXH64; zero without words."""
    out = np.zeros(len(texts), np.uint64)
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    for i, text in enumerate(texts):
        words = text.translate(_LOWER).split()
        if not words:
            continue
        joined = b" ".join(words)
        if len(words) <= WIDTH:
            hashes = np.array([digest(joined, SEED)], np.uint64)
        else:
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
            starts = np.concatenate(([0], ends[: -WIDTH])).tolist()
            stops = (ends[WIDTH - 1 :] - 1).tolist()
            hashes = np.fromiter((digest(joined[a:z], SEED) for a, z in zip(starts, stops)), np.uint64, len(stops))
        votes = np.zeros(64, np.int64)
        for lo in range(0, len(hashes), 1 << 14):
            bits = np.unpackbits(hashes[lo : lo + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            votes += bits.sum(axis=0, dtype=np.int64)
        out[i] = weights[votes * 2 > len(hashes)].sum(dtype=np.uint64)
    return out


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column("text")
        parts = [np.zeros(0, np.uint64)]
        for lo in range(0, len(texts), 256):
            parts.append(fingerprint_batch(texts.slice(lo, 256).cast(pa.large_binary()).to_pylist()))
        yield pa.RecordBatch.from_arrays(
            [b.column("key"), b.column("name"), pa.array(np.concatenate(parts).view(np.int64))], names=["key", "name", "fp"]
        )


def fingerprints(docs: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """(key, name, fp) of every document; the name is of its key and text."""
    return C.named_texts(docs, key=key).mapInArrow(_fingerprints, "key long, name long, fp long")


# ---------------------------------------------------------------- the trie self-join


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest reachable number of each of n nodes over the links (i, j)."""
    label = np.arange(n)
    while len(i):
        a, b = label[i], label[j]
        low = np.minimum(a, b)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
        open_ = label[i] != label[j]
        i, j = i[open_], j[open_]
    return label


def trie_links(a: np.ndarray, b: np.ndarray, same: bool, level: int, diff: int, budget: int) -> Iterator[tuple]:
    """Index pairs of sorted fingerprints a and b (sharing ``level`` leading bits each) within the budget.

    Follows node pairs depth first in slices of FRONTIER; nodes are ranges of the sorted arrays.
    """
    one = np.uint64(1)
    stack = [(level, *(np.array([x], np.int64) for x in (0, len(a), 0, len(b), diff)))]
    while stack:
        level, alo, ahi, blo, bhi, d = stack.pop()
        if len(alo) > FRONTIER:
            stack.append((level, *(x[FRONTIER:] for x in (alo, ahi, blo, bhi, d))))
            alo, ahi, blo, bhi, d = (x[:FRONTIER] for x in (alo, ahi, blo, bhi, d))
        leaf = ((ahi - alo) * (bhi - blo) <= 64) | (level == 64)
        if leaf.any():
            yield from _leaves(a, b, same, alo[leaf], ahi[leaf], blo[leaf], bhi[leaf], budget)
            alo, ahi, blo, bhi, d = (x[~leaf] for x in (alo, ahi, blo, bhi, d))
        if not len(alo):
            continue
        mask = one << np.uint64(63 - level)
        keep = ~(mask | (mask - one))
        amid = np.clip(np.searchsorted(a, (a[alo] & keep) | mask), alo, ahi)
        bmid = np.clip(np.searchsorted(b, (b[blo] & keep) | mask), blo, bhi)
        itself = same & (alo == blo)
        kids = [
            (alo, amid, blo, bmid, d), (amid, ahi, bmid, bhi, d), (alo, amid, bmid, bhi, d + 1), (amid, ahi, blo, bmid, d + 1),
        ]
        parts = []
        for n, kid in enumerate(kids):
            ok = (kid[0] < kid[1]) & (kid[2] < kid[3]) & (kid[4] <= budget)
            if n == 3:
                ok &= ~itself
            parts.append([x[ok] for x in kid])
        stack.append((level + 1, *(np.concatenate(x) for x in zip(*parts))))


def _leaves(a, b, same, alo, ahi, blo, bhi, budget) -> Iterator[tuple]:
    wide = bhi - blo
    size = (ahi - alo) * wide
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(np.cumsum(size) >> 20)) + 1, [len(size)]))
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        if lo == hi:
            continue
        s = size[lo:hi]
        at = np.arange(int(s.sum())) - np.repeat(np.cumsum(s) - s, s)
        w = np.repeat(wide[lo:hi], s)
        i, j = np.repeat(alo[lo:hi], s) + at // w, np.repeat(blo[lo:hi], s) + at % w
        near = np.bitwise_count(a[i] ^ b[j]) <= budget
        if same:
            near &= i < j
        if near.any():
            yield i[near], j[near]


def _group_links(fps: np.ndarray, bits: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between the one or two subtrees of a group."""
    fps = np.sort(fps.view(np.uint64))
    if bits == 0:
        halves = [fps]
    else:
        head = fps >> np.uint64(64 - bits)
        cut = int(np.searchsorted(head, head[0], side="right"))
        halves = [fps[:cut], fps[cut:]] if cut < len(fps) else [fps]
    same = len(halves) == 1
    a, b = halves[0], halves[-1]
    shift = 0 if same else len(a)
    diff = 0 if same else int(np.bitwise_count((a[0] ^ b[0]) >> np.uint64(64 - bits)))
    label, li, lj, held = np.arange(len(fps)), [], [], 0
    for i, j in trie_links(a, b, same, bits, diff, budget):
        li.append(i)
        lj.append(j + shift)
        held += len(i)
        if held > 1 << 21:
            label = _forest(len(fps), *(np.concatenate(x) for x in (li, lj)))
            linked = np.flatnonzero(label != np.arange(len(fps)))
            li, lj, held = [linked], [label[linked]], len(linked)
    if not li:
        return fps[:0].view(np.int64), fps[:0].view(np.int64)
    label = _forest(len(fps), *(np.concatenate(x) for x in (li, lj)))
    linked = np.flatnonzero(label != np.arange(len(fps)))
    return fps[linked].view(np.int64), fps[label[linked]].view(np.int64)


def links(distinct: DataFrame, budget: int = 2) -> DataFrame:
    """Forest of links (a, b) between distinct fingerprints (column fp) that differ in at most budget bits."""
    n = distinct.count()
    bits = max(0, (max(n, 1) // SUBTREE).bit_length())
    own = F.shiftrightunsigned(F.col("fp"), 64 - bits) if bits else F.lit(0).cast("bigint")
    flips = [0, *(1 << i for i in range(bits))]
    flips = sorted({x ^ y for x in flips for y in flips}) if budget >= 2 else flips[: 1 + bits * (budget > 0)]
    for _ in range(budget - 2):
        flips = sorted({x ^ (1 << i) for x in flips for i in range(bits)} | set(flips))
    flipped = F.explode(F.array(*[F.lit(x).cast("bigint") for x in flips]))
    placed = distinct.select("fp", own.alias("own"), flipped.alias("flip")).select(
        "fp", "own", F.col("own").bitwiseXOR(F.col("flip")).alias("other")
    ).select(
        "fp", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y")
    )

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        fps = rows["fp"].to_numpy()
        if rows["x"].iloc[0] != rows["y"].iloc[0]:
            head = fps.view(np.uint64) >> np.uint64(64 - bits)
            if (head == head[0]).all():  # the other subtree is empty
                return pd.DataFrame({"a": fps[:0], "b": fps[:0]})
        a, b = _group_links(fps, bits, budget)
        return pd.DataFrame({"a": a, "b": b})

    return placed.groupBy("x", "y").applyInPandas(run, "a long, b long")


def near_duplicates(docs: DataFrame, *, budget: int = 2, key: str = "doc_id") -> DataFrame:
    """(key, fp, component) of every document; component is the smallest key that links reach.

    Null and empty texts have the fingerprint zero and link like any other; fewer than three words are
    one shingle; equal texts share a fingerprint; repeated rows each get a row; null keys are never the
    smallest, so a component of null keys only has a null component; an empty table gives an empty
    result; other columns are ignored.
    """
    return _rooted(docs, budget, key).select(F.col("key").alias(key), "fp", "component")


def _rooted(docs: DataFrame, budget: int, key: str) -> DataFrame:
    """(key, name, fp, root, component) of every document; roots tell components of equal smallest key apart."""
    base = C.materialise(fingerprints(docs, key=key), "fingerprints")
    distinct = C.materialise(base.groupBy("fp").agg(F.min("key").alias("low")), "distinct_fingerprints")
    found = C.materialise(links(distinct, budget), "links")
    roots = graph.components(found)
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "low"
    )
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component"))
    of_fp = rooted.join(lowest, "root").select("fp", "root", "component")
    return base.join(of_fp, "fp")


def one_of_each(docs: DataFrame, *, budget: int = 2) -> DataFrame:
    """The documents without near-duplicates: of each component one with the smallest doc_id stays.

    A document is its id and its text: of a component without ids one document stays, texts that share an id are judged
    by themselves, and rows that repeat both are one document.
    """
    named = docs.withColumn("@name", C.name_of("doc_id", "text"))
    found = C.materialise(_rooted(docs, budget, "doc_id"), "components")
    lowest = found.filter(F.col("key").eqNullSafe(F.col("component")))
    stays = C.materialise(lowest.groupBy("root").agg(F.min("name").alias("@name")).select("@name"), "stays")
    kept = named.join(stays, "@name", "left_semi")
    repeated = lowest.join(stays, lowest["name"] == stays["@name"], "left_semi").groupBy("name").count().filter("count > 1")
    if repeated.limit(1).count():
        kept = kept.dropDuplicates(["@name"])
    return kept.select(docs.columns)
