"""Benchmark decontamination by winnowing.

Each text is reduced to the minimum k-gram hash of every sliding window; equal runs of ``window``
words always hold an equal selected k-gram, so joining the fingerprints of documents and items finds
every shared run. A fingerprint carries the words around it, and each join hit is extended over them
and compared word by word, so hash collisions never count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import common as C

GRAM = 5
FILTER_BITS = 24  # 2 MB, whatever the benchmark's size; only a prefilter of the join

_FOUND = "uid long, key long, name long, n_words long, found array<struct<fp: long, span: int, pos: int, lead: int, words: string>>"
_ITEM = "item_id string, fp long, span int, item_pos int, item_words string"


def _tokens(buf: np.ndarray, offs: np.ndarray):
    low = C.LOWER[buf]
    s, e, doc = C.word_spans(low, offs, C.ALNUM)
    return low, s, e, doc, C.span_hash(C.prefix_hash(low), s, e)


def _selected(words: np.ndarray, doc: np.ndarray, span: int, full: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the k-grams kept for runs of ``span`` words."""
    k, w = (GRAM, span - GRAM + 1) if span == full else (span, 1)
    h, ok = C.shingles(words, doc, k)
    h = C.mix(h ^ C.U64(span))
    pos = C.winnow(np.where(ok, h, C.U64(0xFFFFFFFFFFFFFFFF)), w) if w > 1 else np.flatnonzero(ok)
    pos = pos[ok[pos]]
    return pos, h[pos]


def item_fingerprints(items: DataFrame, window: int) -> DataFrame:
    """Kept k-grams of the benchmark. An item of n < window words is one run of n words; none: no row.

    A row carries the k-gram and up to ``window - GRAM`` words on either side, which is as far as a document's
    row reaches, so the rows of a long item grow with its length and not with its square.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("item").to_pylist()
            out: list[list] = [[], [], [], [], []]
            for lo, _, buf, offs in C.text_chunks(b.column("text")):
                low, s, e, doc, wh = _tokens(buf, offs)
                raw = low.tobytes()
                bounds = C.per_text(doc, len(offs) - 1)
                for i in range(len(offs) - 1):
                    a, z = bounds[i], bounds[i + 1]
                    if a == z:
                        continue
                    span = min(window, int(z - a))
                    pos, fp = _selected(wh[a:z], doc[a:z], span, window)
                    side, k = (window - GRAM, GRAM) if span == window else (0, span)
                    for p, f in zip(pos.tolist(), fp.view(np.int64).tolist()):
                        x, y = int(a) + max(0, p - side), min(int(z), int(a) + p + k + side)
                        words = b" ".join(raw[i0:i1] for i0, i1 in zip(s[x:y], e[x:y])).decode("utf-8", "replace")
                        for c, v in zip(out, (ids[lo + i], f, span, int(a) + p - x, words)):
                            c.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()),
                 pa.array(out[3], pa.int32()), pa.array(out[4], pa.string())],
                names=["item_id", "fp", "span", "item_pos", "item_words"],
            )

    rows = items.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), C.whole_text().alias("text")
    )
    return rows.mapInArrow(run, _ITEM)


def _document_fingerprints(docs: DataFrame, spans: list[int], window: int, filter_) -> DataFrame:
    reach = window - GRAM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = filter_.value
        for b in batches:
            n_words = np.zeros(len(b), np.int64)
            found: list[list] = [[] for _ in range(len(b))]
            for lo, hi, buf, offs in C.text_chunks(b.column("text")):
                low, s, e, doc, wh = _tokens(buf, offs)
                n_words[lo:hi] = np.bincount(doc, minlength=hi - lo)
                bounds, raw = C.per_text(doc, hi - lo), None
                for span in spans:
                    pos, fp = _selected(wh, doc, span, window)
                    keep = C.in_filter(bits, fp)
                    if not keep.any():
                        continue
                    raw = low.tobytes() if raw is None else raw
                    side, k = (reach, GRAM) if span == window else (0, span)
                    for p, f in zip(pos[keep].tolist(), fp[keep].view(np.int64).tolist()):
                        d = int(doc[p])
                        a, z = max(int(bounds[d]), p - side), min(int(bounds[d + 1]), p + k + side)
                        words = b" ".join(raw[x:y] for x, y in zip(s[a:z], e[a:z])).decode("utf-8", "replace")
                        found[lo + d].append(
                            {"fp": f, "span": span, "pos": p - int(bounds[d]), "lead": p - a, "words": words}
                        )
            kind = pa.list_(pa.struct([("fp", pa.int64()), ("span", pa.int32()), ("pos", pa.int32()),
                                       ("lead", pa.int32()), ("words", pa.string())]))
            yield pa.RecordBatch.from_arrays(
                [b.column("uid"), b.column("key"), b.column("name"), pa.array(n_words), pa.array(found, kind)],
                names=["uid", "key", "name", "n_words", "found"],
            )

    return docs.select(F.monotonically_increasing_id().alias("uid"), "key", "name", "text").mapInArrow(run, _FOUND)


def _extend(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Longest equal run around each join hit; kept where it holds a whole window (or short item)."""
    for b in batches:
        out: list[tuple] = []
        for r in b.to_pylist():
            mine, theirs = r["words"].split(" "), r["item_words"].split(" ")
            k = GRAM if r["span"] == window else r["span"]
            i, j = r["lead"], r["item_pos"]
            if mine[i : i + k] != theirs[j : j + k]:
                continue
            left = right = 0
            while left < min(i, j) and mine[i - 1 - left] == theirs[j - 1 - left]:
                left += 1
            while i + k + right < len(mine) and j + k + right < len(theirs) and mine[i + k + right] == theirs[j + k + right]:
                right += 1
            if left + k + right >= r["span"]:
                out.append((r["uid"], r["item_id"], r["pos"] - left, r["pos"] + k + right))
        cols = list(zip(*out)) if out else [[], [], [], []]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.int64()))],
            names=["uid", "item_id", "start", "end"],
        )


def contamination(docs: DataFrame, benchmark: DataFrame, *, window: int = 13, key: str = "doc_id") -> DataFrame:
    """One row per document: key, n_words, n_hit, items (sorted ids), spans of hit words.

    A word is hit if it stands in an occurrence of ``window`` consecutive words of an item, or of a whole
    shorter item. Null and empty texts have no words; an item without words has no window; an item
    without id counts under the id ''; item rows that share an id count as one item; repeated documents
    each get their row; empty tables give an empty result or zero hits; other columns are ignored.
    """
    return _judged(docs, benchmark, window, key).select(F.col("key").alias(key), "n_words", "n_hit", "items", "spans")


def _judged(docs: DataFrame, benchmark: DataFrame, window: int, key: str) -> DataFrame:
    """The rows of ``contamination``, with the name of each document's key and text."""
    spark = docs.sparkSession
    items = C.materialise(item_fingerprints(benchmark, window), "items")
    spans = sorted({r["span"] for r in items.select("span").distinct().collect()})  # at most ``window`` values
    filter_ = spark.sparkContext.broadcast(C.bit_filter(items, "fp", FILTER_BITS))
    base = C.materialise(_document_fingerprints(C.named_texts(docs, key=key), spans, window, filter_), "kept_grams")
    found = base.select("uid", F.explode("found").alias("f")).select("uid", "f.*")
    hits = found.join(items, ["fp", "span"]).select(
        "uid", "pos", "lead", "words", "span", "item_id", "item_pos", "item_words"
    ).mapInArrow(lambda it: _extend(it, window), "uid long, item_id string, start long, end long")
    joined = hits.groupBy("uid").agg(
        F.array_sort(F.collect_set("item_id")).alias("items"),
        F.array_sort(F.collect_set(F.struct("start", "end"))).alias("runs"),
    )
    # merge overlapping runs, which are in order of their starts
    merged = F.aggregate(
        "runs", F.expr("CAST(array() AS array<struct<start: bigint, end: bigint>>)"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= x["start"]),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(
                F.element_at(acc, -1)["start"].alias("start"),
                F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end")))),
        ).otherwise(F.concat(acc, F.array(x))),
    )
    per_doc = joined.select("uid", "items", F.when(F.size("runs") > 0, merged).alias("spans"))
    return base.select("uid", "key", "name", "n_words").join(per_doc, "uid", "left").select(
        "key", "name", "n_words",
        F.coalesce(F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, x: a + x["end"] - x["start"]), F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce("items", F.expr("CAST(array() AS array<string>)")).alias("items"),
        F.coalesce("spans", F.expr("CAST(array() AS array<struct<start: bigint, end: bigint>>)")).alias("spans"),
    )


def contaminated() -> Column:
    """A document is contaminated if at least a twentieth of its words is hit."""
    return (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, *, window: int = 13) -> DataFrame:
    """The documents that are not contaminated, with all their columns.

    Each is judged by its own text, whether its doc_id is null, repeated or neither.
    """
    bad = _judged(docs, benchmark, window, "doc_id").filter(contaminated()).select(F.col("name").alias("@name")).distinct()
    return docs.withColumn("@name", C.name_of("doc_id", "text")).join(bad, "@name", "left_anti").select(docs.columns)
