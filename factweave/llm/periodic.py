"""Periodic runs of words: stretches that repeat themselves with some period.

A word of a run stands in it at least twice, since a run is two periods long. So a word that occurs once in a
segment of a text is in no run of it and splits the segment; the parts are judged again by their own counts until no
part splits (parts of fewer words than the shortest run are left out). What survives is scanned lag by lag. At
lag q a run has q matching words in a row or more, and these hold a whole aligned block of half as many: only aligned
blocks are compared, by hash, so all lags together cost about n log n. Stretches found are compared word by word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common as C

LEAST = 12  # words of the shortest run
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def segments(ids: np.ndarray, least: int = LEAST) -> Iterator[tuple[int, int]]:
    """Ranges in which every word occurs twice or more, and outside which no run stands."""
    todo = [(0, len(ids))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < least:
            continue
        _, back, count = np.unique(ids[lo:hi], return_inverse=True, return_counts=True)
        rare = np.flatnonzero(count[back] < 2)
        if not len(rare):
            yield lo, hi
            continue
        edges = np.concatenate(([-1], rare, [hi - lo]))
        for k in np.flatnonzero(np.diff(edges) > least):
            todo.append((lo + int(edges[k]) + 1, lo + int(edges[k + 1])))


class _Hashed:
    """Hashes of all spans of a segment."""

    def __init__(self, ids: np.ndarray):
        n = len(ids)
        self.power = C._powers(n + 1)[0]
        values = C.mix(ids.astype(C.U64) * C.U64(0x9E3779B97F4A7C15) + C.U64(1))
        self.prefix = np.zeros(n + 1, C.U64)
        np.cumsum(values * self.power[:n], out=self.prefix[1:])

    def blocks(self, lag: int, size: int) -> np.ndarray:
        """Starts of aligned blocks that equal the words a lag further on."""
        p = self.prefix
        at = np.arange(0, len(p) - lag - size, size)
        return at[(p[at + size] - p[at]) * self.power[lag] == p[at + lag + size] - p[at + lag]]

    def same(self, i: int, size: int, lag: int) -> bool:
        p = self.prefix
        return (int(p[i + size]) - int(p[i])) * int(self.power[lag]) % (1 << 64) == (int(p[i + lag + size]) - int(p[i + lag])) % (1 << 64)


def _reach(limit: int, same: Callable[[int], bool]) -> int:
    """Largest size up to limit for which same(size) holds; it holds for all smaller ones."""
    step, lo = 1, 0
    while lo + step <= limit and same(lo + step):
        lo += step
        step *= 2
    while step:
        if lo + step <= limit and same(lo + step):
            lo += step
        step //= 2
    return lo


def _exact_stretch(ids: np.ndarray, at: int, lag: int) -> tuple[int, int]:
    """The matching stretch around a position by comparing words."""
    off = np.flatnonzero(ids[:-lag] != ids[lag:])
    k = int(np.searchsorted(off, at))
    if k < len(off) and off[k] == at:
        return at, at
    return (int(off[k - 1]) + 1 if k else 0), (int(off[k]) if k < len(off) else len(ids) - lag)


def lag_scan(ids: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a segment, with its smallest period."""
    n, hashed, found = len(ids), _Hashed(ids), {}
    for lag in range(1, n // 2 + 1):
        need = max(least - lag, lag)  # matching words in a row
        if need + lag > n:
            break
        hits = hashed.blocks(lag, (need + 1) // 2)
        k = 0
        while k < len(hits):
            at = int(hits[k])
            lo = at - _reach(at, lambda s: hashed.same(at - s, s, lag))
            hi = at + _reach(n - lag - at, lambda s: hashed.same(at, s, lag))
            known = found.get((lo, hi + lag))
            if hi - lo >= need and not (known and lag % known == 0):
                if not np.array_equal(ids[lo:hi], ids[lo + lag : hi + lag]):  # two spans of one hash
                    lo, hi = _exact_stretch(ids, at, lag)
                    known = found.get((lo, hi + lag))
                if hi - lo >= need and not known:
                    found[lo, hi + lag] = lag
            k = max(k + 1, int(np.searchsorted(hits, hi)))
    return [(lo, hi - lo, lag) for (lo, hi), lag in found.items()]


def runs_of(words: list[bytes], least: int = LEAST) -> list[tuple[int, int, int]]:
    """All runs of a list of words, by start and period."""
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    out = [(lo + s, n, q) for lo, hi in segments(ids, least) for s, n, q in lag_scan(ids[lo:hi], least)]
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without the repetitions of any run, joined by spaces."""
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return b" ".join(words[i] for i in np.flatnonzero(keep))


def looped(key: int | None, words: list[bytes]) -> list[bytes]:
    """A tenth of all documents, chosen by the checksum of the key, get a tail that repeats itself."""
    h = 1 if key is None else zlib.crc32(str(key).encode())
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def periodic_runs(
    docs: DataFrame, *, key: str = "doc_id", least: int = LEAST,
    prepare: Callable[[int | None, list[bytes]], list[bytes]] | None = None,
) -> DataFrame:
    """(key, n_words, runs, collapsed) of every document.

    ``runs`` holds (start, length, period) by start and period: a maximal stretch of words with smallest period q and
    max(least, 2q) words or more. ``collapsed`` is the text without repetitions, its words joined by one space.
    ``prepare`` may change the words of a document first. Words stand between ASCII white space and are compared by
    their bytes. Null, empty and blank texts have no words, no runs and an empty text; repeated rows each get a row; a null key
    is kept; an empty table gives an empty result; other columns are ignored. A row is judged by itself, so nothing is
    shuffled, and a very long text costs about n log n.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, buf, offs in C.text_chunks(b.column("text")):
                keys, raw = b.column("key").slice(lo, hi - lo), buf.tobytes()
                counts, all_runs, texts = [], [], []
                for k, s, e in zip(keys.to_pylist(), offs[:-1].tolist(), offs[1:].tolist()):
                    words = raw[s:e].split()
                    if prepare:
                        words = prepare(k, words)
                    found = runs_of(words, least)
                    counts.append(len(words))
                    all_runs.append([{"start": r[0], "length": r[1], "period": r[2]} for r in found])
                    texts.append(collapsed(words, found).decode())
                yield pa.RecordBatch.from_arrays(
                    [keys, pa.array(counts, pa.int64()), pa.array(all_runs, pa.list_(_RUN)), pa.array(texts, pa.string())],
                    names=["key", "n_words", "runs", "collapsed"],
                )

    out = C.rows_of(docs, key=key).mapInArrow(
        run, "key long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    )
    return out.select(F.col("key").alias(key), "n_words", "runs", "collapsed")
