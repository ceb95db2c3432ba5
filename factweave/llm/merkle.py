"""A content-addressed manifest of a dataset, and proofs that rows belong to it.

Every row is a leaf digest. Leaves of one tree (a source) stand in order of their key; three consecutive digests at a
time are digested into their parent until one is left, the tree's root, and the roots of all trees form one more tree
in the same way. Records of digest and children are stored in packs of six levels under one digest. A request
for the proof of a leaf descends from the root: each record is found by its digest, the digits of the leaf's rank choose
the child, and the children not chosen are collected. A pack is descended at once, so a request for many leaves passes
each pack once; its segment of the path is put in front of what was collected above, which turns the path round.

Digests are 64 lowercase hex digits, and a parent is the digest of its children's text end to end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..plans.ordering import ordered_positions
from . import common as C

FAN = 3
LEVELS = 6  # levels of a pack
PACK = FAN**LEVELS
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_RECORD = pa.struct([("digest", pa.string()), ("children", pa.list_(pa.string()))])
_RECORDS = "records array<struct<digest: string, children: array<string>>>"
_TOP = ""  # the tree of the roots; all other names begin with a hyphen or an s


class Manifest(NamedTuple):
    """leaves: tree, rank, key, leaf, claim. packs: digest, height, records. roots: tree, digest, height, size. root: one row or none."""

    leaves: DataFrame
    packs: DataFrame
    roots: DataFrame
    root: DataFrame


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(columns: dict[str, Column]) -> Column:
    """Digest of a row: each value as its number of bytes, a colon and itself; a hyphen if null."""
    parts = [
        F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")))
        for c in columns.values()
    ]
    return F.sha2(F.concat(*parts), 256)


def _height(size: int) -> int:
    h = 0
    while size > 1:
        size, h = -(-size // FAN), h + 1
    return h


def pack(children: list[str], height: int) -> tuple[str, list[tuple[str, list[str]]]]:
    """The digest above consecutive digests after ``height`` levels, and the records on the way, top down."""
    records: list[tuple[str, list[str]]] = []
    for _ in range(height):
        groups = [children[i : i + FAN] for i in range(0, len(children), FAN)]
        children = [digest("".join(g)) for g in groups]
        records[:0] = zip(children, groups)
    return children[0], records


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: list[list] = [[], [], []]
        for size, nodes in zip(b.column("size").to_pylist(), b.column("nodes").to_pylist()):
            height = LEVELS if size > PACK else _height(size)
            top, records = pack([x["digest"] for x in sorted(nodes, key=lambda x: x["rank"])], height)
            for o, v in zip(out, (top, height, [{"digest": d, "children": c} for d, c in dict(records).items()])):
                o.append(v)
        yield pa.RecordBatch.from_arrays(
            [b.column("tree"), b.column("rank"), b.column("size"), pa.array(out[0], pa.string()), pa.array(out[1], pa.int32()),
             pa.array(out[2], pa.list_(_RECORD))],
            names=["tree", "rank", "size", "digest", "grown", "records"],
        )


def _grow(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Tables of packs, and the root of every tree; nodes: tree, rank (from 0), size of the tree, digest.

    A step joins up to PACK neighbours into one, so trees of any size take log(size) steps, each a shuffle of what the
    last one left.
    """
    packs, roots = [], []
    nodes = nodes.withColumn("height", F.lit(0))
    while True:
        grouped = nodes.groupBy("tree", F.floor(F.col("rank") / PACK).alias("rank"), "size", "height").agg(
            F.collect_list(F.struct("rank", "digest")).alias("nodes")  # PACK of them at most
        )
        # the height below the pack is carried beside what the workers see
        done = C.materialise(
            grouped.select("tree", "rank", F.struct("size", "height").alias("was"), "nodes").select(
                F.struct("tree", "was").alias("tree"), "rank", F.col("was.size").alias("size"), "nodes"
            ).mapInArrow(
                _packed,
                "tree struct<tree: string, was: struct<size: long, height: int>>, rank long, size long, digest string,"
                f" grown int, {_RECORDS}",
            ).select(
                "tree.tree", "rank", F.ceil(F.col("size") / PACK).cast("bigint").alias("size"), "digest",
                (F.col("tree.was.height") + F.col("grown")).cast("int").alias("height"), "records",
            ),
            "packs",
        )
        packs.append(done.select("digest", "height", "records"))
        roots.append(done.filter("size = 1").select("tree", "digest", "height"))
        nodes = done.filter("size > 1").select("tree", "rank", "size", "digest", "height")
        if not nodes.limit(1).count():
            break
    out = roots[0]
    for r in roots[1:]:
        out = out.unionByName(r)
    return packs, out


def manifest(
    docs: DataFrame, *, key: str = "doc_id", tree: str = "source", columns: tuple[str, ...] = COLUMNS,
    claim: dict[str, Column] | None = None,
) -> Manifest:
    """The manifest of a table. ``claim`` replaces columns in the digest that a proof is later checked with.

    Trees are ordered by name, null first, and leaves by key, null first, then by digest. Nulls and empty texts differ; equal
    rows are equal leaves, each with a place of its own; a table without rows has no root; other columns are ignored.
    Texts are digested where they are read and never shuffled. Ranks come from a range partition, so a tree of any size is spread.
    """
    own = {c: F.col(c) for c in columns}
    name = F.when(F.col(tree).isNull(), F.lit("-")).otherwise(F.concat(F.lit("s"), F.col(tree).cast("string")))
    rows = C.materialise(
        docs.select(
            name.alias("tree"), F.col(key).alias("key"), leaf(own).alias("leaf"), leaf(own | (claim or {})).alias("claim")
        ), "leaf_digests",
    )
    parts = C.materialise(
        rows.orderBy("tree", F.col("key").asc_nulls_first(), "leaf").withColumn("at", F.monotonically_increasing_id()), "leaf_order"
    ).withColumn("part", F.shiftright("at", 33))
    held = parts.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    spread = C.materialise(
        held.select(
            F.col("tree"), "part", "first", (F.sum("n").over(W.partitionBy("tree").orderBy("part")) - F.col("n")).alias("before"),
            F.sum("n").over(W.partitionBy("tree")).alias("size"),
        ), "leaf_offsets",
    )
    leaves = C.materialise(
        parts.join(spread, ["tree", "part"]).select(
            "tree", (F.col("before") + F.col("at") - F.col("first")).alias("rank"), "size", "key", "leaf", "claim"
        ), "leaves",
    )
    packs, roots = _grow(leaves.select("tree", "rank", "size", F.col("leaf").alias("digest")))
    sizes = spread.select("tree", "size").distinct()
    roots = C.materialise(ordered_positions(roots.join(sizes, "tree"), [F.col("tree")], "place"), "roots")
    total = roots.count()
    above, root = _grow(roots.select(
        F.lit(_TOP).alias("tree"), (F.col("place") - 1).alias("rank"), F.lit(total).cast("bigint").alias("size"), "digest"
    ))
    stored = above[0]
    for p in above[1:] + packs:
        stored = stored.unionByName(p)
    # a record is addressed by its digest: equal subtrees are stored once
    stored = C.materialise(
        stored.filter("height > 0").groupBy("digest", "height").agg(F.first("records").alias("records")), "records"
    )
    return Manifest(leaves.drop("size"), stored, roots, C.materialise(root.select("digest", "height"), "root"))


# ---------------------------------------------------------------- requests


def descend(records: dict[str, list[str]], top: str, levels: int, rank: int) -> tuple[str, list[list[str]]]:
    """The digest below ``top`` that the digits of rank lead to, and the children not chosen: [left, right] per level, lowest first."""
    segment = []
    for level in range(levels - 1, -1, -1):
        children = records[top]
        digit = rank // FAN**level % FAN
        segment.append(["".join(children[:digit]), "".join(children[digit + 1 :])])
        top = children[digit]
    segment.reverse()
    return top, segment


def fold(own: str, path: list[list[str]]) -> str:
    """The root that a digest and the siblings of its path, lowest first, lead to."""
    for left, right in path:
        own = digest(left + own + right)
    return own


def _levels(height: int) -> int:
    """Levels of the pack whose digest stands at a height: packs are filled from the leaves up."""
    return (height - 1) % LEVELS + 1 if height else 0


_PATH = pa.list_(pa.list_(pa.string()))


def _step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From the digest of a pack to all digests below it."""
    for b in batches:
        out: list[list] = [[], [], [], [], []]
        for tree, rank, size, height, top, path, records in zip(*(b.column(c).to_pylist() for c in (
                "tree", "rank", "size", "height", "digest", "path", "records"))):
            records, levels = {r["digest"]: r["children"] for r in records}, _levels(height)
            base = rank * FAN**levels
            below = -(-size // FAN ** (height - levels))  # digests of the tree at the next height
            for i in range(min(FAN**levels, below - base)):
                found, segment = descend(records, top, levels, i)
                for o, v in zip(out, (tree, base + i, height - levels, found, segment + path)):
                    o.append(v)
        yield pa.RecordBatch.from_arrays(
            [pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.string()),
             pa.array(out[4], _PATH)],
            names=["tree", "rank", "height", "digest", "path"],
        )


def _descended(requests: DataFrame, packs: DataFrame, sizes: DataFrame, to: int) -> DataFrame:
    """Requests (tree, rank, height, digest, path) followed down to height ``to``: 0, or the lowest packs."""
    done = requests.filter(F.col("height") <= to)
    requests = requests.filter(F.col("height") > to)
    while requests.limit(1).count():
        found = requests.join(packs, ["digest", "height"]).join(sizes, "tree")
        requests = C.materialise(
            found.mapInArrow(_step, "tree string, rank long, height int, digest string, path array<array<string>>"), "requests"
        )
        done = done.unionByName(requests.filter(F.col("height") <= to))
        requests = requests.filter(F.col("height") > to)
    return done


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every leaf of a lowest pack descends by itself."""
    for b in batches:
        for height, top, path, records, asked in zip(*(b.column(c).to_pylist() for c in ("height", "digest", "path", "records", "asked"))):
            records = {r["digest"]: r["children"] for r in records or []}
            above, out = fold_above(path), [[], [], [], [], []]
            for x in asked:
                found, segment = descend(records, top, height, x["rank"] % PACK)
                root = above(fold(x["claim"], segment))
                for o, v in zip(out, (x["key"], x["leaf"], found == x["leaf"], segment + path, root)):
                    o.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], b.schema.field("asked").type.value_type.field("key").type), pa.array(out[1], pa.string()),
                 pa.array(out[2]), pa.array(out[3], _PATH), pa.array(out[4], pa.string())],
                names=["key", "leaf", "found", "path", "folded"],
            )


def fold_above(path: list[list[str]]):
    """Folding along a path that many leaves share: each distinct digest is folded once."""
    known: dict[str, str] = {}

    def above(own: str) -> str:
        if own not in known:
            known[own] = fold(own, path)
        return known[own]

    return above


def prove(m: Manifest, leaves: DataFrame | None = None) -> DataFrame:
    """(key, tree, leaf, path, proof, folded, subroot, root) of leaves of a manifest, all of them unless some are given.

    ``path`` has [left, right] siblings per level from the leaf up; ``proof`` is the digest of all of them end to end, and
    ``folded`` the root that the leaf's claim and the path lead to. Leaves are rows of ``m.leaves``; a leaf asked for
    twice is answered twice.
    """
    asked = m.leaves if leaves is None else leaves
    total = m.roots.agg(F.count(F.lit(1)).alias("size"))
    start = m.root.select(
        F.lit(_TOP).alias("tree"), F.lit(0).cast("bigint").alias("rank"), "height", "digest",
        F.array().cast("array<array<string>>").alias("path"),
    )
    sizes = m.roots.select("tree", "size").unionByName(total.select(F.lit(_TOP).alias("tree"), "size"))
    of_roots = _descended(start, m.packs, sizes, 0)
    into = of_roots.select((F.col("rank") + 1).alias("place"), F.col("digest").alias("found"), "path").join(m.roots, "place").select(
        "tree", F.lit(0).cast("bigint").alias("rank"), "height", F.col("found").alias("digest"), "path"
    )
    lowest = _descended(C.materialise(into, "requests"), m.packs, sizes, LEVELS)
    groups = asked.groupBy("tree", F.floor(F.col("rank") / PACK).alias("rank")).agg(
        F.collect_list(F.struct("rank", "key", "leaf", "claim")).alias("asked")
    )
    kind = asked.schema["key"].dataType.simpleString()
    answered = (
        lowest.join(m.packs, ["digest", "height"], "left").join(groups, ["tree", "rank"])
        .select("height", "digest", "path", "records", "asked", "tree")
    )
    out = answered.select("height", "digest", "path", "records", F.transform(
        "asked", lambda x: F.struct(x["rank"].alias("rank"), F.struct(x["key"].alias("key"), F.col("tree").alias("tree")).alias("key"),
                                    x["leaf"].alias("leaf"), x["claim"].alias("claim"))).alias("asked"),
    ).mapInArrow(
        _answer,
        f"key struct<key: {kind}, tree: string>, leaf string, found boolean, path array<array<string>>, folded string",
    )
    top = F.broadcast(m.root.select(F.col("digest").alias("root")))  # one row
    return out.select("key.key", "key.tree", "leaf", "found", "path", "folded").join(
        m.roots.select("tree", F.col("digest").alias("subroot")), "tree"
    ).join(top, F.lit(True)).select(
        "key", "tree", "leaf", "found", "path",
        F.sha2(F.concat_ws("", F.flatten("path")), 256).alias("proof"), "folded", "subroot", "root",
    )


def tampered(key: str = "doc_id", text: str = "text") -> dict[str, Column]:
    """Line feeds go from the text of every second document, by the checksum of its key; one without a key stays."""
    changes = F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 2 == 0, F.lit(False))
    return {text: F.when(changes, F.translate(F.col(text), "\n", "")).otherwise(F.col(text))}
