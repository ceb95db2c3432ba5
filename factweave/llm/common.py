"""Shared helpers: tables in the shared folder, fixed-size filters, hashing of many texts at once.

Texts are hashed a chunk at a time with numpy: a chunk is a run of whole texts of about a quarter megabyte
(a longer text is a chunk by itself), so the memory of a task does not depend on its partition.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..plans.storage import drop, freeing, stored

CHUNK_BYTES = 1 << 18
BATCH_ROWS = 1_000
U64 = np.uint64
_GOLD = U64(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D
_BASE_INV = pow(_BASE, -1, 1 << 64)


def importable(spark: SparkSession) -> None:
    """Python workers of this session find the library where the driver found it."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])


def small_batches(spark: SparkSession) -> None:
    """From here on whole texts go to Python by at most a thousand rows, which each side of a task holds more than once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = int(spark.conf.get(name))
    if rows <= 0 or rows > BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back: a lost executor costs no recomputation."""
    return stored(df, name)


drop_table = drop


def whole_text(col: str = "text") -> Column:
    """The text as a string; null is the empty text."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def rows_of(df: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Only the two columns an operator works on, under names that no other column can clash with."""
    importable(df.sparkSession)
    return df.select(F.col(key).cast("bigint").alias("key"), whole_text(text).alias("text"))


# ---------------------------------------------------------------- filters of a fixed size


def bit_filter(df: DataFrame, hashed: str, bits: int) -> np.ndarray:
    """A bitmap of 2**bits slots, set at the top bits of each hash. Its size does not depend on the data."""
    slot = F.shiftrightunsigned(F.col(hashed), 64 - bits)
    with freeing(df.sparkSession):
        rows = (
            df.select(F.shiftright(slot, 15).cast("int").alias("b"), slot.bitwiseAND(32767).alias("p"))
            .groupBy("b").agg(F.bitmap_construct_agg("p").alias("m")).collect()
        )
    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in rows:
        out[r["b"] << 12 : (r["b"] + 1) << 12] = np.frombuffer(bytes(r["m"]), np.uint8)
    return out


def in_filter(filter_: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bits = filter_.size.bit_length() - 1 + 3
    slot = hashes.view(U64) >> U64(64 - bits)
    return (filter_[slot >> U64(3)] >> (slot & U64(7)).astype(np.uint8)) & 1 == 1


# ---------------------------------------------------------------- hashing texts


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def seeded(n: int, seed: int) -> np.ndarray:
    """n fixed 64-bit words that depend on the seed."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=U64) + U64(seed) * U64(1 << 32)) * _GOLD)


_BYTES = seeded(256, 1)
_POWERS: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    if len(_POWERS[0]) < n:
        n = max(n, CHUNK_BYTES + (CHUNK_BYTES >> 2))
        for i, b in enumerate((_BASE, _BASE_INV)):
            p = np.empty(n, U64)
            p[0], done = 1, 1
            while done < n:
                step = min(done, n - done)
                p[done : done + step] = p[:step] * U64(pow(b, done, 1 << 64))
                done += step
            _POWERS[i] = p
    return _POWERS[0], _POWERS[1]


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``span_hash`` gives the hash of any span."""
    out = np.zeros(len(buf) + 1, U64)
    np.cumsum(_BYTES[buf] * _powers(len(buf) + 1)[0][: len(buf)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes [start, end) by content alone, wherever they stand."""
    inv = _powers(len(prefix))[1]
    return mix((prefix[end] - prefix[start]) * inv[start] + (end - start).astype(U64) * _GOLD)


def text_chunks(col: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts: first row, end row, their UTF-8 bytes, and the offsets of the texts."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_binary())
    n = len(col)
    if not n:
        return
    offs = np.frombuffer(col.buffers()[1], np.int64, n + 1 + col.offset)[col.offset :]
    data = col.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi, raw[offs[lo] : offs[hi]], (offs[lo : hi + 1] - offs[lo])
        lo = hi


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words of digits, letters and anything beyond ASCII, after lower-casing A-Z.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Words between ASCII white space.
SOLID = np.ones(256, bool)
SOLID[[0x20, *range(9, 14)]] = False


def word_spans(buf: np.ndarray, offs: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every word of a chunk (bytes already lower-cased)."""
    n = len(buf)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    w = kind[buf]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    start = w.copy()
    start[1:] &= ~w[:-1] | edge[1:n]
    end = w.copy()
    end[:-1] &= ~w[1:] | edge[1:n]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(offs[1:], s, side="right")


def shingles(words: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the k words from each position, and whether all k are of one text."""
    n = len(words)
    c = seeded(k, 7) | U64(1)
    h = np.zeros(n, U64)
    for j in range(min(k, n)):
        h[: n - j] += words[j:] * c[j]
    ok = np.zeros(n, bool)
    if n >= k:
        ok[: n - k + 1] = doc[: n - k + 1] == doc[k - 1 :]
    return mix(h), ok


def window_min(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum over every w consecutive values."""
    return _slide(h, w, np.minimum)


def window_max(h: np.ndarray, w: int) -> np.ndarray:
    return _slide(h, w, np.maximum)


def _slide(h: np.ndarray, w: int, op) -> np.ndarray:
    if len(h) < w:
        return h[:0]
    m, span = h, 1
    while span * 2 <= w:
        m = op(m[:-span], m[span:])
        span *= 2
    return op(m[: len(m) - (w - span)], m[w - span :]) if span < w else m


def winnow(h: np.ndarray, w: int) -> np.ndarray:
    """Positions that are the minimum of some window of w values, all of them on ties.

    Equal runs of w values hold an equal selected value, so any shared run is seen from both sides.
    """
    if len(h) < w:
        return np.zeros(0, np.int64)
    low = window_min(h, w)
    pad = np.zeros(len(h) + w - 1, U64)
    pad[w - 1 : w - 1 + len(low)] = low
    return np.flatnonzero(window_max(pad, w) == h)


def per_text(doc: np.ndarray, n: int) -> np.ndarray:
    """Bounds of each text's entries in an array ordered by text."""
    return np.searchsorted(doc, np.arange(n + 1))


# ---------------------------------------------------------------- texts and what is known about them


def named_texts(df: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, text and a name of the row by content: rows of equal key and text share it, and all results."""
    return rows_of(df, text=text, key=key).withColumn("name", name_of())


def name_of(key: str = "key", text: str = "text") -> Column:
    k = F.col(key).cast("bigint")
    return F.xxhash64(k, whole_text(text), k.isNull())


def inside(df: DataFrame, filter_, member: bool, name: str = "name") -> DataFrame:
    """Rows whose name is in a broadcast bit filter (or not): a filter before a shuffle of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = in_filter(filter_.value, b.column(name).to_numpy())
            yield b.filter(pa.array(got if member else ~got))

    return df.mapInArrow(run, df.schema)


def lists(values: np.ndarray, row: np.ndarray, n: int, kind: pa.DataType) -> pa.Array:
    """One list per row from values in order of their row number."""
    return pa.ListArray.from_arrays(pa.array(per_text(row, n), pa.int32()), pa.array(values, kind))


def ragged_ranges(flat: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ranges of an array end to end, and their lengths."""
    size = end - start
    at = np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)
    return flat[at], size
