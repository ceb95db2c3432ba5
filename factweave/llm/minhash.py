"""One-permutation MinHash fingerprints of documents.

Each five-word shingle is hashed once; the top bits choose its bin and every bin keeps its smallest hash.
An empty bin takes the value of a bin drawn by a second hash of (bin, attempt), attempt by attempt until the
drawn bin is not empty (optimal densification). Stored are the low bits of each bin; chance agreement
of low bits is corrected when two fingerprints are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common as C

SHINGLE = 5
BINS = 256  # a power of two
BITS = 8  # low bits kept of each bin: 1, 2, 4 or 8
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def _draws(bins: int, attempts: int = 64) -> np.ndarray:
    """Fixed random bin for each (attempt, bin); after the last attempt the bins are tried in order."""
    fixed = (C.seeded(bins * attempts, 11) % C.U64(bins)).astype(np.int64).reshape(attempts, bins)
    walk = (np.arange(bins)[None, :] + np.arange(1, bins)[:, None]) % bins
    return np.concatenate([fixed, walk])


def sketch(buf: np.ndarray, offs: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Densified bin minima, one row per text of a chunk."""
    n = len(offs) - 1
    low = C.LOWER[buf]
    s, e, doc = C.word_spans(low, offs, C.SOLID)
    words = C.span_hash(C.prefix_hash(low), s, e)
    h, ok = C.shingles(words, doc, SHINGLE)
    # fewer than five words are one shingle of all words; none: one fixed shingle
    count = np.bincount(doc, minlength=n)
    bounds = C.per_text(doc, n)
    few = np.flatnonzero(count < SHINGLE)
    own = np.full(len(few), 0x1234567, C.U64)
    for j in range(SHINGLE - 1):
        has = count[few] > j
        own[has] = C.mix(own[has] * C.U64(3) + words[bounds[few[has]] + j])
    d = np.concatenate([doc[ok], few])
    h = np.concatenate([h[ok], C.mix(own)])
    shift = C.U64(64 - (bins.bit_length() - 1))
    out = np.full(n * bins, EMPTY, C.U64)
    np.minimum.at(out, d * bins + (h >> shift).astype(np.int64), h)
    return densify(out.reshape(n, bins))


def densify(table: np.ndarray) -> np.ndarray:
    """Fill empty bins; every text has at least one bin that is not."""
    full = table.copy()
    missing = table == EMPTY
    for draw in _draws(table.shape[1]):
        rows, cols = np.nonzero(missing)
        if not len(rows):
            break
        got = table[rows, draw[cols]]
        found = got != EMPTY
        full[rows[found], cols[found]] = got[found]
        missing[rows[found], cols[found]] = False
    return full


def pack(table: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Low bits of each bin, packed into bytes.

    Values are mixed with their bin first: bins that hold the same drawn value then agree by chance
    independently of one another, as the correction assumes.
    """
    low = (C.mix(table + C.seeded(table.shape[1], 13)) & C.U64((1 << bits) - 1)).astype(np.uint8)
    if bits == 8:
        return low
    spread = np.unpackbits(low[:, :, None], axis=2, bitorder="little")[:, :, :bits]
    return np.packbits(spread.reshape(len(table), -1), axis=1, bitorder="little")


def unpack(packed: np.ndarray, bits: int = BITS) -> np.ndarray:
    if bits == 8:
        return packed
    flat = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(packed), -1, bits)
    return np.packbits(flat, axis=2, bitorder="little")[:, :, 0]


def likeness(a: np.ndarray, b: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Estimated Jaccard similarity of packed fingerprints, corrected for chance agreement, within 0 and 1."""
    agree = (unpack(a, bits) == unpack(b, bits)).mean(axis=1)
    chance = 0.5**bits
    return np.clip((agree - chance) / (1 - chance), 0.0, 1.0)


def _packed(texts: list[bytes]) -> np.ndarray:
    if not texts:
        return np.zeros((0, BINS * BITS // 8), np.uint8)
    offs = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    return pack(sketch(np.frombuffer(b"".join(texts), np.uint8), offs))


def _raw(rows: np.ndarray) -> list[bytes]:
    return [r.tobytes() for r in rows]


def _hex(col: str):
    return F.lower(F.hex(col)).alias(col)


def fingerprints(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint) of every text: hex of the packed bins. Null and empty texts share one fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts: list[bytes] = []
            for _, _, buf, offs in C.text_chunks(b.column("text")):
                parts += _raw(pack(sketch(buf, offs)))
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(parts, pa.binary())], names=["key", "fingerprint"])

    return C.rows_of(docs, key=key, text=text).mapInArrow(run, "key long, fingerprint binary").select(
        F.col("key").alias(key), _hex("fingerprint")
    )


# ---------------------------------------------------------------- comparison with edited and following texts

_PAIR = (
    "part int, first boolean, last boolean, key long, n_chars long, edited_sha256 binary, fingerprint binary,"
    " edited_fingerprint binary, near_edited double, near_next double, text string"
)


def _edited(text: str, following: str) -> str:
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def _pairs(texts: list[str], nexts: list[str]) -> tuple:
    """Columns for texts that each have their following text."""
    own = [t.encode() for t in texts]
    edited = [_edited(t, f).encode() for t, f in zip(texts, nexts)]
    a, b = _packed(own), _packed(edited)
    # texts follow one another, so only following texts that are not in the list are fingerprinted again
    c = np.concatenate([a[1:], _packed([nexts[-1].encode()])])
    return [hashlib.sha256(x).digest() for x in edited], _raw(a), _raw(b), likeness(a, b), likeness(a, c)


def _run_ordered(batches: Iterator[pa.RecordBatch], limit: int = C.CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Compares each row with the next of its partition; the last row is left open for the next partition."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    keys: list[int | None] = []
    texts: list[str] = []
    size, first = 0, True

    def batch(k: list, t: list[str], closed: bool) -> pa.RecordBatch:
        nonlocal first
        n = len(k)
        heads = [first] + [False] * (n - 1)
        first = False
        if closed:
            sha, fp, efp, ne, nn = _pairs(t[:n], t[1 : n + 1])
            lasts = [False] * n
        else:
            sha, fp, efp, ne, nn, lasts = [None], [None], [None], [None], [None], [True]
        texts_out = [x if (f or z) else None for x, f, z in zip(t, heads, lasts)]
        return pa.RecordBatch.from_arrays(
            [pa.array([part] * n, pa.int32()), pa.array(heads), pa.array(lasts), pa.array(k, pa.int64()),
             pa.array([len(x) for x in t[:n]], pa.int64()), pa.array(sha, pa.binary()), pa.array(fp, pa.binary()),
             pa.array(efp, pa.binary()), pa.array(ne, pa.float64()), pa.array(nn, pa.float64()), pa.array(texts_out, pa.string())],
            names=["part", "first", "last", "key", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                   "near_edited", "near_next", "text"],
        )

    for b in batches:
        for k, t in zip(b.column("key").to_pylist(), b.column("text").to_pylist()):
            keys.append(k)
            texts.append(t)
            size += len(t)
            if size > limit and len(keys) > 1:
                yield batch(keys[:-1], texts, True)
                keys, texts, size = keys[-1:], texts[-1:], len(texts[-1])
    if len(keys) > 1:
        yield batch(keys[:-1], texts, True)
    if keys:
        yield batch(keys[-1:], texts[-1:], False)


def with_next(docs: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """Fingerprint of each text and of its edited text, and the likeness to that and to the next text.

    The next document is the one that follows by key (nulls first; equal keys by their text); the last is
    followed by the first, a single one by itself. Null texts count as empty. Texts of fewer than five
    words are one shingle, so any edit makes them unlike. Repeated rows each get a row, an empty table gives
    an empty result, other columns are ignored.

    Documents are range-partitioned by key and each partition is read once in order; only the first and
    last text of every partition are joined afterwards.
    """
    ordered = C.rows_of(docs, key=key)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = ordered.repartitionByRange(n, "key", F.xxhash64("text")).sortWithinPartitions("key", F.xxhash64("text"), "text")
    rows = C.materialise(ordered.mapInArrow(_run_ordered, _PAIR), "ordered_fingerprints")
    # one row per partition: its follower is the next partition that has rows, around the end
    parts = [r["part"] for r in rows.filter("first").select("part").orderBy("part").collect()]
    done = rows.filter(~F.col("last")).drop("part", "first", "last", "text")
    if parts:
        follower = docs.sparkSession.createDataFrame(
            list(zip(parts, parts[1:] + parts[:1])), "part int, following int"
        )
        heads = rows.filter("first").select(F.col("part").alias("following"), F.col("text").alias("next_text"))
        ends = rows.filter("last").select("part", "key", "n_chars", "text").join(follower, "part").join(heads, "following")

        def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out: list[list] = [[], [], [], [], []]
                for t, f in zip(b.column("text").to_pylist(), b.column("next_text").to_pylist()):
                    for c, v in zip(out, _pairs([t], [f])):
                        c.append(v[0])
                yield pa.RecordBatch.from_arrays(
                    [b.column("key"), b.column("n_chars"), *(pa.array(c, pa.binary()) for c in out[:3]),
                     *(pa.array(c, pa.float64()) for c in out[3:])],
                    names=["key", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                )

        done = done.unionByName(ends.select("key", "n_chars", "text", "next_text").mapInArrow(
            close, "key long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary,"
            " near_edited double, near_next double"))
    return done.select(
        F.col("key").alias(key), "n_chars", _hex("edited_sha256"), _hex("fingerprint"), _hex("edited_fingerprint"),
        "near_edited", "near_next",
    )
