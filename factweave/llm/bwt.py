"""Exact removal of repeated byte strings with merged Burrows-Wheeler transforms.

Texts are parsed into phrases at content-defined places, so equal strings have equal phrases away from their
ends. Phrases are the symbols. Each shard sorts its own suffixes once and keeps its transform: the symbol before
every suffix and the row of the suffix that it begins. The shards are merged by refining their interleave:
all suffixes start in the interval of their first symbol; in every round a suffix hands its interval, extended
by the symbol before it, to the suffix one symbol longer. An interval that holds one suffix over all shards is
settled. No shard is sorted again. The last round in which the interval of a suffix holds others is their
longest common prefix, in phrases.

A string of ``length`` bytes whose covering phrases are an interval of two or more is repeated. One whose inner
phrases are single is not. Where the interval of the inner phrases is larger than that of the covering ones, the
string may also stand between other phrases; only there, near the ends of repeats, one suffix of each
interval sends a hash of the string, and equal hashes are counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import common as C

GRAM = 16  # bytes hashed at each place
REACH = 40  # a phrase begins where the hash is the strict minimum of so many places on either side
SHARD = 1 << 17  # phrases per shard, about
PHRASE_BITS = 27  # 16 MB prefilter of repeated phrases
NAME_BITS = 24  # 2 MB prefilter of documents
MAX = np.uint32(0xFFFFFFFF)
CHUNK = 1 << 17  # bytes of a chunk: its arrays stay in the processor's cache
_BYTES = (C.seeded(256, 3) >> C.U64(32)).astype(np.uint32)


def _gram_hash(buf: np.ndarray) -> np.ndarray:
    """32-bit hash of the GRAM bytes from every place, put together from halves."""
    h, span = _BYTES[buf], 1
    while span < GRAM:
        h = h[:-span] * np.uint32(0x9E3779B1 + 2 * span) + h[span:]
        span *= 2
    h ^= h >> np.uint32(15)
    return h * np.uint32(0x85EBCA6B)


def parse(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, text number and hash of every phrase of a chunk, and the prefix hash of its bytes.

    The parse of a text does not depend on its neighbours; equal values choose the first place, so that runs of
    one hash give one phrase.
    """
    n, k = len(buf), len(offs) - 1
    prefix = C.prefix_hash(buf)
    size = np.diff(offs)
    doc = np.repeat(np.arange(k), size)
    spaced = np.full(n + (k + 1) * REACH, MAX, np.uint32)  # a gap before, between and after the texts
    if n >= GRAM:
        g = _gram_hash(buf)
        for d in np.flatnonzero(size >= GRAM):
            a, z = offs[d], offs[d + 1] - GRAM + 1
            spaced[a + (d + 1) * REACH : z + (d + 1) * REACH] = g[a:z]
        low = C.window_min(spaced, REACH)
        here = spaced[REACH : len(low) - 1]
        place = np.flatnonzero((here < low[: len(here)]) & (here <= low[REACH + 1 :]))
        at = place - np.searchsorted(offs[1:] + np.arange(1, k + 1) * REACH, place, side="right") * REACH
    else:
        at = np.zeros(0, np.int64)
    start = np.union1d(at, offs[:-1][size > 0])
    end = np.append(start[1:], n)
    return start, end, doc[start] if n else start, C.span_hash(prefix, start, end), prefix


# ---------------------------------------------------------------- first pass: which phrases repeat


def _symbols(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, buf, offs in C.text_chunks(b.column("text"), CHUNK):
                sym, n = np.unique(parse(buf, offs)[3], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(sym.view(np.int64)), pa.array(n)], names=["sym", "n"])

    return docs.select("text").mapInArrow(run, "sym long, n long")


# ---------------------------------------------------------------- second pass: documents that may hold a repeat


def _needed(start: np.ndarray, end_of_text: np.ndarray, length: int) -> np.ndarray:
    """Most phrases that a string of the length beginning in a phrase can touch."""
    nxt = np.append(start[1:], end_of_text[-1] if len(start) else 0)
    last = np.minimum(nxt - 1 + length, end_of_text) - 1
    return np.searchsorted(start, last, side="right") - np.arange(len(start))


def _candidates(docs: DataFrame, repeated, length: int) -> DataFrame:
    """Phrases that pass the filter, of documents in which some string of the length may repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, buf, offs in C.text_chunks(b.column("text"), CHUNK):
                start, end, doc, sym, _ = parse(buf, offs)
                k = hi - lo
                live = C.in_filter(repeated.value, sym)
                # a string lies in a run of live phrases and at most two before and three behind them, or else has
                # no whole phrase with fixed ends, and then two neighbours are long
                bounds = C.per_text(doc, k)
                first, last = bounds[:-1][doc], bounds[1:][doc]
                index = np.arange(len(start))
                dead_before = np.maximum.accumulate(np.where(live, -1, index)) if len(index) else index
                dead_after = (
                    np.minimum.accumulate(np.where(live, len(index), index)[::-1])[::-1] if len(index) else index
                )
                left = np.maximum(dead_before - 1, first)
                right = np.minimum(dead_after + 2, last - 1)
                kept = live & (end[right] - start[left] >= length)
                pair = np.zeros(len(start), bool)
                plain = length - 2 * REACH - GRAM
                pair[:-1] = (doc[:-1] == doc[1:]) & (end[1:] - start[:-1] >= plain)
                pair |= end - start >= plain
                touched = np.bincount(doc[kept | pair], minlength=k) > 0
                need = _needed(start, offs[1:][doc], length)
                d = doc[kept]
                yield pa.RecordBatch.from_arrays(
                    [b.column("name").slice(lo, k),
                     C.lists((index - first)[kept], d, k, pa.int32()), C.lists(sym.view(np.int64)[kept], d, k, pa.int64()),
                     C.lists(need[kept], d, k, pa.int32())],
                    names=["name", "idx", "sym", "need"],
                ).filter(pa.array(touched))

    return docs.select("name", "text").mapInArrow(run, "name long, idx array<int>, sym array<long>, need array<int>")


# ---------------------------------------------------------------- the transforms and their merge


def suffix_order(sym: np.ndarray, last: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of a shard by their first symbols (at least depth), by doubling ranks.

    ``last`` marks the end of each run of symbols; no suffix goes beyond it.
    """
    n = len(sym)
    _, rank = np.unique(sym, return_inverse=True)
    rank = rank.astype(np.int64) + 1
    left = np.zeros(n, np.int64)  # symbols up to the end of the run
    ends = np.flatnonzero(last)
    left = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n) + 1
    span = 1
    while span < depth:
        nxt = np.zeros(n, np.int64)
        more = np.flatnonzero(left > span)
        nxt[more] = rank[more + span]
        _, rank = np.unique(rank * (n + 2) + nxt, return_inverse=True)
        rank = rank.astype(np.int64) + 1
        span *= 2
    return np.argsort(rank, kind="stable")


def _transform(rows: pd.DataFrame) -> pd.DataFrame:
    """The Burrows-Wheeler transform of one shard: symbol before each suffix, and the row which that begins."""
    rows = rows.sort_values(["copy", "idx"], kind="stable")
    copy, idx, sym = rows["copy"].to_numpy(), rows["idx"].to_numpy(), rows["sym"].to_numpy()
    n = len(rows)
    joined = np.zeros(n, bool)  # the symbol before is the phrase before in the same document
    joined[1:] = (copy[1:] == copy[:-1]) & (idx[1:] == idx[:-1] + 1)
    last = np.append(~joined[1:], True)
    order = suffix_order(sym.view(np.uint64), last, int(rows["need"].max()))
    row = np.empty(n, np.int64)
    row[order] = np.arange(n)
    back = np.maximum(order - 1, 0)
    has = joined[order]
    return pd.DataFrame({
        "shard": rows["shard"].to_numpy()[order], "r": np.arange(n, dtype=np.int32), "part": sym[order],
        "before": np.where(has, sym[back], 0), "lf": np.where(has, row[back], -1).astype(np.int32),
        "need": rows["need"].to_numpy()[order].astype(np.int16), "name": rows["name"].to_numpy()[order], "idx": idx[order],
    })


def _row() -> Column:
    """One number for each suffix of any shard."""
    return F.shiftleft(F.col("shard").cast("bigint"), 32) + F.col("r")


def _longer(rows: pd.DataFrame, depth: int) -> pd.DataFrame:
    """One step in a shard: every suffix hands its interval, with the symbol before it, to the row of the longer one."""
    r, lf = rows["r"].to_numpy(), rows["lf"].to_numpy()
    place = np.full(int(max(r.max(), lf.max())) + 1, -1, np.int64)
    place[r] = np.arange(len(r))
    x = np.flatnonzero(lf >= 0)
    y = place[lf[x]]
    ok = y >= 0
    ok &= rows["need"].to_numpy()[y] > depth
    x, y = x[ok], y[ok]
    part = rows["part"].to_numpy()[x].view(np.uint64) * C.U64(0xD6E8FEB86659FD93)
    part = C.mix(part + C.mix(rows["before"].to_numpy()[x].view(np.uint64)))
    out = rows.iloc[y][["shard", "r", "before", "lf", "need"]]
    return out.assign(part=part.view(np.int64), n_was=rows["n"].to_numpy()[y], own_was=rows["own"].to_numpy()[y])


def _step(depth: int):
    return lambda rows: _longer(rows, depth)


def _counted(state: DataFrame) -> DataFrame:
    """Adds n, the suffixes in the interval over all shards, and own: whether this one speaks for it."""
    counts = state.groupBy("part").agg(F.count(F.lit(1)).cast("int").alias("n"), F.min(_row()).alias("speaker"))
    return state.join(counts, "part").withColumn("own", _row() == F.col("speaker")).drop("speaker")


def intervals(phrases: DataFrame) -> DataFrame:
    """(name, idx, depth, n, own): size of the interval of the first ``depth`` phrases of each suffix.

    Only the first depth and those at which n or own changes are listed; ``_sizes`` fills in the others.
    phrases: copy (one value per row of the input table), name, idx, sym, need.
    """
    n = phrases.count()
    shards = max(1, n // SHARD)
    bwt = C.materialise(
        phrases.withColumn("shard", F.pmod(F.xxhash64("copy"), F.lit(shards)).cast("int"))
        .groupBy("shard").applyInPandas(
            _transform, "shard int, r int, part long, before long, lf int, need short, name long, idx int"),
        "transforms",
    )
    now = C.materialise(_counted(bwt.drop("name", "idx")), "interleave")
    listed = [now.select(_row().alias("row"), F.lit(1).alias("depth"), "n", "own")]
    depth = 1
    while True:
        longer = now.filter("n > 1").groupBy("shard").applyInPandas(
            _step(depth),
            "shard int, r int, before long, lf int, need short, part long, n_was int, own_was boolean",
        )
        changed = (F.col("n") != F.col("n_was")) | (F.col("own") != F.col("own_was"))
        new = C.materialise(_counted(longer).withColumn("changed", changed).drop("n_was", "own_was"), "interleave")
        depth += 1
        if depth > 2:
            C.drop_table(now)
        now = new
        if not now.limit(1).count():
            break
        listed.append(C.materialise(
            now.filter("changed").select(_row().alias("row"), F.lit(depth).alias("depth"), "n", "own"), "interval_sizes"))
    every = listed[0]
    for more in listed[1:]:
        every = every.unionByName(more)
    return every.join(bwt.select(_row().alias("row"), "name", "idx"), "row").drop("row")


def _sizes(first: np.ndarray, idx: np.ndarray, depth: np.ndarray, value: np.ndarray, n: int, deepest: int) -> np.ndarray:
    """Interval size and speaker (2 n + own) of each phrase of a chunk for every depth, from the listed changes."""
    listed = np.zeros((n + 1, deepest + 1), np.int64)
    np.maximum.at(listed, (first + idx, depth), value)
    out = np.zeros_like(listed)
    for d in range(1, deepest + 1):
        if d > 1:
            # a suffix keeps its interval while the suffix after it has company one phrase shorter
            out[:-1, d] = np.where(out[1:, d - 1] >= 4, out[:-1, d - 1], 0)
        out[:, d] = np.where(listed[:, d] > 0, listed[:, d], out[:, d])
    return out


# ---------------------------------------------------------------- strings of the length


def _runs(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate(([False], hit, [False])).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _judge(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Places where a repeated string begins, as runs, and hashes of the strings not decided by phrases."""
    for b in batches:
        known = b.column("known")
        for lo, hi, buf, offs in C.text_chunks(b.column("text"), CHUNK):
            k = hi - lo
            start, end, doc, _, prefix = parse(buf, offs)
            bounds = C.per_text(doc, k)
            part = pa.concat_arrays([known.slice(lo, k).fill_null([])])
            row = np.repeat(np.arange(k), np.diff(part.offsets.to_numpy()))
            idx, depth, n, own = (part.values.field(x).to_numpy(zero_copy_only=False) for x in ("idx", "depth", "n", "own"))
            s = np.arange(len(buf))
            text = np.repeat(np.arange(k), np.diff(offs))
            s = s[s + length <= offs[1:][text]]
            text = text[s]
            i = np.searchsorted(start, s, side="right") - 1
            covering = np.searchsorted(start, s + length - 1, side="right") - i
            a = np.searchsorted(start, s + REACH, side="left")
            inner = np.searchsorted(start, s + length - REACH - GRAM, side="right") - 1 - a
            sizes = _sizes(
                bounds[row], idx, depth, 2 * n.astype(np.int64) + own, len(start),
                int(max(covering.max(initial=1), depth.max(initial=1))),
            )
            cover = sizes[i, covering]
            sure = cover >= 4
            within = sizes[a, np.maximum(inner, 0)] >> 1
            open_ = (inner <= 0) | (within > np.maximum(cover >> 1, 1))
            u = np.flatnonzero(open_ & (~sure | (cover & 1 == 1)))
            h = C.span_hash(prefix, s[u], s[u] + length)
            _, once, inverse, n = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
            # a string that is repeated in this chunk is sent once, for its copies elsewhere
            sure[u[n[inverse] > 1]] = True
            once.sort()
            u, h = u[once], h[once]
            hit = np.zeros(len(buf) + 1, bool)
            hit[s[sure]] = True
            f, t = _runs(hit[:-1])  # no run crosses texts: the last places of a text begin no string
            d = np.searchsorted(offs[1:], f, side="right")
            ud = text[u]
            yield pa.RecordBatch.from_arrays(
                [b.column("name").slice(lo, k), C.lists(f - offs[d], d, k, pa.int32()), C.lists(t - offs[d], d, k, pa.int32()),
                 C.lists(s[u] - offs[ud], ud, k, pa.int32()), C.lists(h.view(np.int64), ud, k, pa.int64())],
                names=["name", "first", "until", "place", "hash"],
            )


def _likely(batches: Iterator[pa.RecordBatch], bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row per string that passes the filter of repeated ones."""
    for b in batches:
        place = pa.concat_arrays([b.column("place")])
        h = pa.concat_arrays([b.column("hash")]).values
        got = pa.array(C.in_filter(bits, h.to_numpy()))
        row = pa.array(np.repeat(np.arange(len(b)), np.diff(place.offsets.to_numpy()))).filter(got)
        yield pa.RecordBatch.from_arrays(
            [b.column("name").take(row), place.values.filter(got), h.filter(got)], names=["name", "place", "hash"]
        )


def _cut(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n, kept, spans = [], [], []
        for text, first, until in zip(
            b.column("text").cast(pa.large_binary()), b.column("first").to_pylist(), b.column("until").to_pylist()
        ):
            raw = text.as_py()
            gone = np.zeros(len(raw) + 1, np.int32)
            f, t = np.array(first or [], np.int64), np.array(until or [], np.int64) + length - 1
            np.add.at(gone, f, 1)
            np.add.at(gone, np.minimum(t, len(raw)), -1)
            hit = np.cumsum(gone[:-1]) > 0
            a, z = _runs(hit)
            n.append(len(raw))
            kept.append(np.frombuffer(raw, np.uint8)[~hit].tobytes())
            spans.append([{"start": x, "end": y} for x, y in zip(a.tolist(), z.tolist())])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays(
            [b.column("key"), pa.array(n, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())],
            names=["key", "n_bytes", "spans", "kept"],
        )


_RESULT = "key long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary"


def repeated_strings(docs: DataFrame, *, length: int = 400, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, spans, kept) of every document: removed byte ranges, and the bytes that stay.

    A byte goes if it is covered by a string of ``length`` bytes that also begins anywhere else, in the same
    document too; overlaps count and all strings are judged on the input. Matches never cross documents. Null texts
    are empty; texts shorter than the length keep all bytes; repeated rows each get a row and are each
    other's repeats; null keys are documents like any other; an empty table gives an empty result; other columns
    are ignored. length must be at least 2 * (REACH + GRAM).
    """
    if length < 2 * (REACH + GRAM):
        raise ValueError("length is too small for the phrases")
    spark = docs.sparkSession
    named = C.named_texts(docs, key=key, text=text)
    repeated = _symbols(named).groupBy("sym").agg(F.sum("n").alias("n")).filter("n > 1")
    phrase_bits = spark.sparkContext.broadcast(C.bit_filter(repeated, "sym", PHRASE_BITS))
    touched = C.materialise(
        _candidates(named, phrase_bits, length).withColumn("copy", F.monotonically_increasing_id()), "phrases"
    )
    name_bits = spark.sparkContext.broadcast(C.bit_filter(touched, "name", NAME_BITS))
    phrases = touched.select("copy", "name", F.explode(F.arrays_zip("idx", "sym", "need")).alias("p")).select("copy", "name", "p.*")
    known = intervals(phrases).groupBy("name").agg(F.collect_list(F.struct("idx", "depth", "n", "own")).alias("known"))
    judged = C.materialise(
        C.inside(named, name_bits, True).join(known, "name", "left").select("name", "text", "known")
        .mapInArrow(lambda it: _judge(it, length),
                    "name long, first array<int>, until array<int>, place array<int>, hash array<long>")
        .withColumn("copy", F.monotonically_increasing_id()),
        "judged",
    )
    open_ = judged.select("name", "copy", F.explode(F.arrays_zip("place", "hash")).alias("o")).select("name", "o.place", "o.hash")
    twice = C.materialise(open_.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("hash"), "open_repeats")
    twice_bits = spark.sparkContext.broadcast(C.bit_filter(twice, "hash", PHRASE_BITS))
    likely = judged.select("name", "place", "hash").mapInArrow(
        lambda it: _likely(it, twice_bits.value), "name long, place int, hash long"
    )
    more = likely.join(twice, "hash").select("name", "place")
    places = (
        judged.select("name", F.explode(F.arrays_zip("first", "until")).alias("r")).select("name", "r.first", "r.until")
        .unionByName(more.select("name", F.col("place").alias("first"), (F.col("place") + 1).alias("until")))
        .groupBy("name").agg(F.collect_set(F.struct("first", "until")).alias("r"))
        .select("name", F.col("r.first").alias("first"), F.col("r.until").alias("until"))
    )
    places = C.materialise(places, "repeats")
    cut_bits = spark.sparkContext.broadcast(C.bit_filter(places, "name", NAME_BITS))
    cut = C.inside(named, cut_bits, True).join(places, "name", "left").select("key", "text", "first", "until").mapInArrow(
        lambda it: _cut(it, length), _RESULT
    )
    whole = C.inside(named, cut_bits, False).select(
        "key", F.octet_length("text").cast("bigint").alias("n_bytes"),
        F.expr("CAST(array() AS array<struct<start: bigint, end: bigint>>)").alias("spans"), F.col("text").cast("binary").alias("kept"),
    )
    return cut.unionByName(whole).withColumnRenamed("key", key)
