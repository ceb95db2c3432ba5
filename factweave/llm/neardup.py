"""Near-duplicate documents by banded one-permutation MinHash and stars of candidates.

A document's set is its distinct five-word shingles. Documents of one set are one node. Every node's set is hashed once into bins
(``minhash.sketch``: one permutation, optimal densification); six bins make a band, and nodes that agree in a band share
a bucket. A bucket elects as hub the member that shares most buckets with others, and candidate edges lead from the hub to
the other members: a star, never all pairs. Each edge is compared on full sets.

A star alone would lose links between two members of which one isn't linked to the hub. Such a pair is found by what
its sets differ in from the hub's: with D for the elements in only one of a member's and the hub's sets, the sets x and y differ in
|Dx| + |Dy| - 2 |Dx and Dy| elements. A link allows k (|x| + |y|) of them, k = (1 - s) / (1 + s), and a member that isn't linked
to the hub has more than k (|x| + |hub|), so both must hold elements of D in common, and enough of them that these show in
prefixes of Dx and Dy (additions first, as few members share them). Members are joined on prefix elements, and
what meets is compared on full differences. Nothing is capped.

Chance of missing a pair at the similarity of 0.85: no common band, (1 - 0.85^6)^42 = 2e-9.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common as C, graph, minhash

SHINGLE = 5
BAND = 6  # bins of a band
BANDS = 42
SEEN_BITS = 24  # two megabytes
PARTNERS = 1 << 10  # edges of a hub that one task joins


def shingle_sets(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a chunk of texts: text number, hash, bounds of each text."""
    n = len(offs) - 1
    low = C.LOWER[buf]
    s, e, doc = C.word_spans(low, offs, C.SOLID)
    words = C.span_hash(C.prefix_hash(low), s, e)
    h, ok = C.shingles(words, doc, SHINGLE)
    count, bounds = np.bincount(doc, minlength=n), C.per_text(doc, n)
    few = np.flatnonzero((count < SHINGLE) & (count > 0))  # the whole sequence is one shingle
    own = count[few].astype(C.U64)
    for j in range(SHINGLE - 1):
        has = count[few] > j
        own[has] = C.mix(own[has] * C.U64(3) + words[bounds[few[has]] + j])
    d, h = np.concatenate([doc[ok], few]), np.concatenate([h[ok], C.mix(own)])
    order = np.lexsort((h, d))
    d, h = d[order], h[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
    d, h = d[new], h[new]
    return d, h, C.per_text(d, n)


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate(([C.U64(0)], np.cumsum(values, dtype=C.U64)))
    return total[bounds[1:]] - total[bounds[:-1]]


def node_of(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A hash of each text's set."""
    size = np.diff(bounds).astype(C.U64)
    return C.mix(_sums(C.mix(h ^ C.U64(0x5DEECE66D)), bounds) + size * C.U64(0x9E3779B97F4A7C15)).view(np.int64)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each text its set's size and hash, and its band hashes."""
    salt, number = C.seeded(BAND, 23) | C.U64(1), C.seeded(BANDS, 29)
    for b in batches:
        for lo, hi, buf, offs in C.text_chunks(b.column("text")):
            _, h, bounds = shingle_sets(buf, offs)
            full = minhash.sketch(buf, offs)[:, : BAND * BANDS]
            banded = C.mix((full.reshape(-1, BANDS, BAND) * salt).sum(axis=2, dtype=C.U64) + number)
            at = np.arange(0, banded.size + 1, BANDS)
            yield pa.RecordBatch.from_arrays(
                [b.column("key").slice(lo, hi - lo), pa.array(np.diff(bounds), pa.int64()), pa.array(node_of(h, bounds)),
                 pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(banded.reshape(-1).view(np.int64)))],
                names=["key", "n_shingles", "node", "bands"],
            )


def _sets(met):
    """Shingle hashes of texts whose set passes a filter of sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, buf, offs in C.text_chunks(b.column("text")):
                _, h, bounds = shingle_sets(buf, offs)
                node = node_of(h, bounds)
                at = np.flatnonzero(C.in_filter(met.value, node) & (np.diff(bounds) > 0))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node[at]), pa.array([h[bounds[i] : bounds[i + 1]].tobytes() for i in at], pa.binary())],
                    names=["node", "hashes"],
                )

    return run


def _differences(percent: int):
    """Of each star edge its sizes, whether it is a link, and the difference: additions to the hub's set, then what is missing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], []]
            for x, y in zip(b.column("a_hashes"), b.column("b_hashes")):
                hub, own = np.frombuffer(x.as_py(), C.U64), np.frombuffer(y.as_py(), C.U64)
                added, missing = (np.setdiff1d(*v, assume_unique=True) for v in ((own, hub), (hub, own)))
                common = len(own) - len(added)
                linked = 100 * common >= percent * (len(hub) + len(own) - common)
                for o, v in zip(out, (len(hub), len(own), linked, np.concatenate([added, missing]).view(np.int64))):
                    o.append(v)
            yield pa.RecordBatch.from_arrays(
                [b.column("a"), b.column("b"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.bool_()),
                 pa.array(out[3], pa.list_(pa.int64()))],
                names=["a", "b", "a_size", "b_size", "linked", "elements"],
            )

    return run


def _confirm(percent: int):
    """Pairs whose sets are similar enough, by their differences from one hub."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y, m, n in zip(b.column("x_elements"), b.column("y_elements"), b.column("x_size").to_pylist(), b.column("y_size").to_pylist()):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                apart = len(x) + len(y) - 2 * len(np.intersect1d(x, y, assume_unique=True))
                ok.append((100 + percent) * apart <= (100 - percent) * (m + n))
            yield pa.RecordBatch.from_arrays([b.column("x"), b.column("y")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _pairs(apart: DataFrame, percent: int) -> DataFrame:
    """Pairs (a: hub, x, y) of different components whose difference prefixes meet; at least one is not linked to the hub.

    Elements two members must share: more than half of |Dy| + k (|hub| - |y|) for y beside an unlinked x, and
    |Dx| - |x| (1 - s) / s for an unlinked x beside a linked y, since y has no more than it shares.
    """
    p, q = 100 - percent, 100 + percent
    entries = apart.withColumns({
        "short": F.expr(f"size(elements) - ({q} * size(elements) + {p} * (a_size - b_size)) div {2 * q}"),
        "long": F.expr(f"size(elements) + 1 - greatest(1, size(elements) - b_size * {p} div {percent})"),
    }).select(
        "a", "b", "root", "linked", F.col("b_size").alias("size"), "short", F.size("elements").alias("m"),
        F.posexplode(F.expr("slice(elements, 1, int(if(linked, short, greatest(short, long))))")).alias("pos", "element"),
    )
    x = entries.filter(~F.col("linked")).select(
        "a", "element", F.col("b").alias("x"), F.col("root").alias("x_root"), F.col("size").alias("x_size"), (F.col("pos") < F.col("short")).alias("x_short"),
        F.col("m").alias("x_m"), (F.col("m") - F.col("pos")).alias("x_rest"),
    )
    y = entries.filter("pos < short").select(
        "a", "element", F.col("b").alias("y"), F.col("root").alias("y_root"), F.col("size").alias("y_size"), "linked",
        F.col("m").alias("y_m"), (F.col("m") - F.col("pos")).alias("y_rest"),
    )
    # where the first element in common stands, what follows it on either side must hold all that is to be shared
    enough = F.expr(f"{2 * q} * least(x_rest, y_rest) >= {q} * (x_m + y_m) - {p} * (x_size + y_size)")
    return x.join(y, ["a", "element"]).filter(
        (F.col("linked") | (F.col("x_short") & (F.col("x") < F.col("y")))) & (F.col("x_root") != F.col("y_root"))
        & enough & (100 * F.least("x_size", "y_size") >= percent * F.greatest("x_size", "y_size"))
    ).groupBy("x", "y").agg(F.min("a").alias("a"))


def _with(edges: DataFrame, of_node: DataFrame, value: str) -> DataFrame:
    """Edges (a: hub, b) with the value of both ends. A hub's edges are dealt over tasks, PARTNERS at a time."""
    hubs = edges.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PARTNERS).cast("int").alias("parts"))
    side = of_node.select(F.col("node").alias("a"), F.col(value).alias(f"a_{value}"))
    dealt = hubs.join(side, "a").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    placed = edges.join(hubs, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int")).drop("parts")
    other = of_node.select(F.col("node").alias("b"), F.col(value).alias(f"b_{value}"))
    return placed.join(other, "b").join(dealt.drop("parts"), ["a", "part"]).drop("part")


def near_duplicates(docs: DataFrame, *, percent: int = 85, key: str = "doc_id") -> DataFrame:
    """(key, n_shingles, component, kept) of every document; links have 100 * intersection >= percent * union.

    ``component`` is the smallest key that links reach, and ``kept`` whether it is the document's own. Words stand between ASCII
    white space, A-Z in lower case; fewer than five words are one shingle of all. Null, empty and blank texts have an
    empty set and are linked with nothing. Equal sets are one node whatever their number. Null keys are never the
    smallest: a component of null keys only has a null component, and of such a component every row counts as kept; repeated rows each
    get a row; an empty table gives an empty result; other columns are ignored.
    """
    session = docs.sparkSession.sparkContext
    base = C.materialise(
        C.rows_of(docs, key=key).mapInArrow(_sketches, "key long, n_shingles long, node long, bands array<long>"), "sketches"
    )
    worded = base.filter("n_shingles > 0")
    # one row per set
    lowest = C.materialise(worded.groupBy("node").agg(F.min("key").alias("low")), "distinct_sets")
    held = C.materialise(worded.groupBy("node").agg(F.first("bands").alias("bands")), "held")
    banded = held.select("node", F.explode("bands").alias("bucket"))
    counts = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    seen = session.broadcast(C.bit_filter(counts, "bucket", SEEN_BITS))
    rows = C.materialise(C.inside(banded, seen, True, "bucket"), "banded")
    seen.destroy()
    C.drop_table(held)
    placed = C.materialise(rows.join(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "bucket"), "buckets")
    C.drop_table(rows)
    rank = C.materialise(placed.groupBy("node").agg(F.sum("n").alias("rank")), "ranks")
    hubs = placed.join(rank, "node").groupBy("bucket").agg(F.max(F.struct("rank", "node")).alias("h")).select("bucket", F.col("h.node").alias("a"))
    edges = C.materialise(
        placed.select("bucket", F.col("node").alias("b")).join(hubs, "bucket").filter("a <> b").select("a", "b").distinct(), "edges"
    )
    sets = _sets_of(docs, key, rank)
    apart = C.materialise(_with(edges, sets, "hashes").mapInArrow(
        _differences(percent), "a long, b long, a_size long, b_size long, linked boolean, elements array<long>"), "differences")
    C.drop_table(sets)
    label = C.materialise(graph.components(apart.filter("linked").select("a", "b")), "labels")
    loose = apart.filter("not linked").select("a").distinct()
    open_ = apart.join(loose, "a", "left_semi").join(label.withColumnRenamed("node", "b"), "b", "left").withColumn("root", F.coalesce("root", "b"))
    pairs = C.materialise(_pairs(open_, percent), "pairs")
    ends = [apart.select("a", F.col("b").alias(v), F.col("b_size").alias(f"{v}_size"), F.col("elements").alias(f"{v}_elements")) for v in "xy"]
    found = pairs.join(ends[0], ["a", "x"]).join(ends[1], ["a", "y"]).mapInArrow(_confirm(percent), "a long, b long")
    joined = label.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(C.materialise(found, "links"))
    label = C.materialise(graph.components(joined), "labels")
    rooted = lowest.join(label, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "low")
    first = rooted.groupBy("root").agg(F.min("low").alias("component"))
    of_node = rooted.join(first, "root").select("node", "component")
    out = worded.select("key", "n_shingles", "node").join(of_node, "node").select("key", "n_shingles", "component").unionByName(
        base.filter("n_shingles = 0").select("key", "n_shingles", F.col("key").alias("component"))
    )
    return out.select(F.col("key").alias(key), "n_shingles", "component", F.col("key").eqNullSafe(F.col("component")).alias("kept"))


def _sets_of(docs: DataFrame, key: str, nodes: DataFrame) -> DataFrame:
    """(node, hashes) of the nodes of a table, from one text each."""
    met = docs.sparkSession.sparkContext.broadcast(C.bit_filter(nodes, "node", SEEN_BITS))
    found = C.rows_of(docs, key=key).mapInArrow(_sets(met), "node long, hashes binary")
    found = found.join(nodes.select("node"), "node", "left_semi").groupBy("node").agg(F.first("hashes").alias("hashes"))
    stored = C.materialise(found, "sets")
    met.destroy()
    return stored
