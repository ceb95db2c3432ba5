"""Byte-level BPE encoding and decoding with a transducer lexicon.

The words of all documents are counted; the most frequent ones, with their ids, are compiled into a minimal
acyclic automaton whose arcs carry word numbers (states with equal continuations are shared). Workers
memory-map its arc table and run all words of a chunk through it at once; a word that it does not hold is
merged exactly by rank. The lexicon changes the speed only, never the ids.
"""

from __future__ import annotations

import heapq
import json
import tempfile
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from . import common as C

LEXICON_WORDS = 1 << 18  # most frequent words kept in the automaton
LONGEST = 48  # bytes of a lexicon word
HIGHEST = 1 << 14  # counts above are not told apart
CACHE = 1 << 17  # other words remembered by a worker


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_chars() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in kept}
    for n, b in enumerate(x for x in range(256) if x not in set(kept)):
        table[chr(256 + n)] = b
    return table


class Vocabulary:
    """A byte-level BPE vocabulary file: merges by rank, bytes of every id, special strings."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or split["type"] != "ByteLevel" or split["add_prefix_space"] or spec["normalizer"]:
            raise ValueError("only byte-level BPE without prefix space or normalizer is handled")
        chars, vocab = _byte_chars(), model["vocab"]
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that take in their surroundings are not handled")
        size = max([*vocab.values(), *added.values()]) + 1
        parts = [b""] * size
        for word, i in vocab.items():
            parts[i] = bytes(chars[c] for c in word)
        for word, i in added.items():
            parts[i] = word.encode()
        self.special = added
        self.flat = np.frombuffer(b"".join(parts), np.uint8)
        self.offs = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)
        self.byte_ids = np.zeros(256, np.int32)
        for c, b in chars.items():
            self.byte_ids[b] = vocab[c]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merges = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], np.int32).reshape(-1, 3)


class Merger:
    """Exact merging of one word: always the pair of lowest rank, the leftmost of equal ones."""

    def __init__(self, vocab: Vocabulary):
        self.pairs = {(a, b): (rank, new) for rank, (a, b, new) in enumerate(vocab.merges.tolist())}
        self.byte_ids = vocab.byte_ids.tolist()

    def __call__(self, word: bytes) -> list[int]:
        ids = [self.byte_ids[b] for b in word]
        if len(ids) > 64:
            return self._long(ids)
        pairs = self.pairs
        while len(ids) > 1:
            best, at = None, -1
            for i in range(len(ids) - 1):
                p = pairs.get((ids[i], ids[i + 1]))
                if p is not None and (best is None or p < best):
                    best, at = p, i
            if best is None:
                break
            ids[at : at + 2] = [best[1]]
        return ids

    def _long(self, ids: list[int]) -> list[int]:
        """The same with a queue of pairs, for words of any length."""
        n, pairs = len(ids), self.pairs
        nxt, prv = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(p[0], i, ids[i], ids[i + 1], p[1]) for i in range(n - 1) if (p := pairs.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = nxt[i]
            if not alive[i] or j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], nxt[i] = new, False, nxt[j]
            if nxt[j] >= 0:
                prv[nxt[j]] = i
            for left, right in ((prv[i], i), (i, nxt[i])):
                if left >= 0 and right >= 0 and (p := pairs.get((ids[left], ids[right]))):
                    heapq.heappush(heap, (p[0], left, ids[left], ids[right], p[1]))
        return [x for x, ok in zip(ids, alive) if ok]


class Splitter:
    """Words of a text as the byte-level pre-tokenizer takes them; special strings are words of their own."""

    def __init__(self, special: list[str]):
        self.words = regex.compile(
            r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        ).findall
        ordered = sorted(special, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, ordered)) + ")") if special else None

    def __call__(self, text: str) -> list[str]:
        if self.special is None or not self.special.search(text):
            return self.words(text)
        out: list[str] = []
        for i, part in enumerate(self.special.split(text)):
            out += [part] if i % 2 else self.words(part)
        return out


# ---------------------------------------------------------------- the automaton


def compile_words(words: list[bytes]) -> dict[str, np.ndarray]:
    """Minimal acyclic automaton of sorted distinct words; the numbers on a word's arcs add up to its place.

    States are built along the common prefix with the next word and replaced by an equal state as soon as
    they are complete, so memory stays near that of the minimal automaton.
    """
    register: dict[tuple, int] = {}
    arcs: list[dict[int, int]] = []  # of complete states
    final: list[bool] = []
    count: list[int] = []  # words accepted from the state
    path: list[list] = [[{}, False]]  # states of the last word that are still open

    def settle(node: list) -> int:
        key = (node[1], tuple(node[0].items()))
        state = register.get(key)
        if state is None:
            state = register[key] = len(arcs)
            arcs.append(node[0])
            final.append(node[1])
            count.append(node[1] + sum(count[t] for t in node[0].values()))
        return state

    last = b""
    for word in [*words, None]:
        common = 0
        if word is not None:
            top = min(len(last), len(word))
            while common < top and last[common] == word[common]:
                common += 1
        for depth in range(len(last), common, -1):
            state = settle(path.pop())
            path[-1][0][last[depth - 1]] = state
        if word is None:
            break
        path += [[{}, False] for _ in range(len(word) - common)]
        path[-1][1] = True
        last = word
    root = settle(path[0])
    keys, target, add = [], [], []
    for state, out in enumerate(arcs):
        before = int(final[state])
        for byte, to in out.items():  # in byte order, since words come sorted
            keys.append(state << 8 | byte)
            target.append(to)
            add.append(before)
            before += count[to]
    keys_, size = np.array(keys, np.int64), 1
    while size < 2 * len(keys) + 2:
        size *= 2
    slots = np.full(size, -1, np.int64)
    values = np.zeros((size, 2), np.int32)
    todo, at = np.arange(len(keys)), _slot(keys_, size)
    while len(todo):
        free = slots[at] < 0
        _, first = np.unique(np.where(free, at, -1 - np.arange(len(at))), return_index=True)
        put = np.zeros(len(at), bool)
        put[first] = True
        put &= free
        slots[at[put]] = keys_[todo[put]]
        values[at[put]] = np.stack([np.array(target, np.int32)[todo[put]], np.array(add, np.int32)[todo[put]]], axis=1)
        todo, at = todo[~put], (at[~put] + 1) & (size - 1)
    return {"slots": slots, "values": values, "final": np.array(final, bool), "root": np.array([root])}


def _slot(keys: np.ndarray, size: int) -> np.ndarray:
    return (C.mix(keys.view(np.uint64)) & np.uint64(size - 1)).astype(np.int64)


class Lexicon:
    """The arc table, memory-mapped from a file that no longer has a name, and the ids of each word."""

    def __init__(self, parts: dict[str, np.ndarray]):
        with tempfile.TemporaryFile() as f:
            for name in ("slots", "values"):
                f.write(parts[name].tobytes())
            f.flush()
            n = len(parts["slots"])
            self.slots = np.memmap(f, np.int64, "r", 0, (n,))
            self.values = np.memmap(f, np.int32, "r", 8 * n, (n, 2))
        self.final, self.root = parts["final"], int(parts["root"][0])
        self.flat, self.offs = parts["flat"], parts["offs"]

    def look_up(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Number of each word in the lexicon, or -1; all words advance one byte at a time."""
        found = np.full(len(start), -1, np.int64)
        size = len(self.slots)
        live = np.flatnonzero(end - start <= LONGEST)
        state = np.full(len(live), self.root, np.int64)
        number = np.zeros(len(live), np.int64)
        at, stop = start[live], end[live]
        while len(live):
            done = at == stop
            if done.any():
                good = done & self.final[state]
                found[live[good]] = number[good]
                more = ~done
                live, state, number, at, stop = live[more], state[more], number[more], at[more], stop[more]
            key = state << 8 | buf[at]
            slot = _slot(key, size)
            held = self.slots[slot]
            open_ = np.flatnonzero((held != key) & (held >= 0))
            while len(open_):
                slot[open_] = (slot[open_] + 1) & (size - 1)
                held[open_] = self.slots[slot[open_]]
                open_ = open_[(held[open_] != key[open_]) & (held[open_] >= 0)]
            hit = held == key
            live, at, stop, slot = live[hit], at[hit] + 1, stop[hit], slot[hit]
            step = self.values[slot]
            state, number = step[:, 0].astype(np.int64), number[hit] + step[:, 1]
        return found


def ragged(flat: np.ndarray, offs: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The picked rows of a ragged table end to end, and their lengths."""
    size = offs[pick + 1] - offs[pick]
    total = int(size.sum())
    at = np.arange(total) + np.repeat(offs[pick] - (np.cumsum(size) - size), size)
    return flat[at], size


class Encoder:
    def __init__(self, vocab: Vocabulary, lexicon: dict[str, np.ndarray]):
        self.vocab, self.merge = vocab, Merger(vocab)
        self.split = Splitter(list(vocab.special))
        self.lexicon = Lexicon(lexicon)
        self.special = {k.encode(): [v] for k, v in vocab.special.items()}
        self.others: dict[bytes, list[int]] = {}

    def encode(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts of a chunk end to end, and the offsets of each text's ids."""
        raw = buf.tobytes()
        lengths: list[np.ndarray] = []
        per_text = np.zeros(len(offs) - 1, np.int64)
        for i in range(len(offs) - 1):
            words = self.split(raw[offs[i] : offs[i + 1]].decode("utf-8"))
            per_text[i] = len(words)
            lengths.append(np.fromiter(map(len, words), np.int64, len(words)))
        chars = np.cumsum(np.concatenate([np.zeros(1, np.int64), *lengths]))
        begin = np.append(np.flatnonzero((buf & 0xC0) != 0x80), len(buf))  # first byte of each character
        bounds = begin[chars]
        start, end = bounds[:-1], bounds[1:]
        number = self.lexicon.look_up(buf, start, end)
        flat, table = self.lexicon.flat, self.lexicon.offs
        missing = np.flatnonzero(number < 0)
        if len(missing):
            place: dict[bytes, int] = {}
            more: list[list[int]] = []
            for m, s, e in zip(missing.tolist(), start[missing].tolist(), end[missing].tolist()):
                word = raw[s:e]
                at = place.get(word)
                if at is None:
                    at = place[word] = len(more)
                    more.append(self._merged(word))
                number[m] = len(table) - 1 + at
            flat = np.concatenate([flat, np.fromiter((x for ids in more for x in ids), np.int32)])
            table = np.concatenate([table, table[-1] + np.cumsum([len(x) for x in more])])
        ids, size = ragged(flat, table, number)
        ends = np.concatenate(([0], np.cumsum(size)))
        return ids, ends[np.concatenate(([0], np.cumsum(per_text)))]

    def _merged(self, word: bytes) -> list[int]:
        ids = self.special.get(word) or self.others.get(word)
        if ids is None:
            ids = self.merge(word)
            if len(self.others) >= CACHE:
                self.others.clear()
            if len(word) <= LONGEST:
                self.others[word] = ids
        return ids


def decode(vocab: Vocabulary, ids: np.ndarray, offs: np.ndarray) -> list[str]:
    """Texts of runs of ids; bytes that are not UTF-8 become replacement characters."""
    data, size = ragged(vocab.flat, vocab.offs, ids.astype(np.int64))
    ends = np.concatenate(([0], np.cumsum(size)))[offs]
    raw = data.tobytes()
    return [raw[a:z].decode("utf-8", "replace") for a, z in zip(ends[:-1].tolist(), ends[1:].tolist())]


# ---------------------------------------------------------------- on Spark


def word_counts(docs: DataFrame, special: list[str], *, text: str = "text") -> DataFrame:
    """(word, n) over the whole of all texts; summed in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = Splitter(special)
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["word", "n"]
            )
            seen.clear()
            return out

        for b in batches:
            for t in b.column("text"):
                seen.update(split(t.as_py()))
                if len(seen) > 400_000:
                    yield flush()
        yield flush()

    C.importable(docs.sparkSession)
    return docs.select(C.whole_text(text).alias("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(
        F.sum("n").alias("n")
    )


def build_lexicon(docs: DataFrame, vocab: Vocabulary, *, size: int = LEXICON_WORDS, text: str = "text") -> dict[str, np.ndarray]:
    """The automaton of the words that occur most often, at most ``size``, and their ids.

    Words of equal counts are taken together or not at all, so no task has to sort them; counts from HIGHEST on are
    taken as equal first and told apart by a hash if they alone are too many.
    """
    counted = C.materialise(
        word_counts(docs, list(vocab.special), text=text)
        .filter((F.octet_length("word") <= LONGEST) & (F.length("word") > 0) & ~F.col("word").isin(list(vocab.special)) & (F.col("n") > 1))
        .select("word", F.least("n", F.lit(HIGHEST)).alias("n")),
        "words",
    )
    by_count = sorted(((r["n"], r["count"]) for r in counted.groupBy("n").count().collect()), reverse=True)
    least, held = HIGHEST + 1, 0
    for n, words in by_count:
        if held + words > size:
            break
        least, held = n, held + words
    frequent = counted.filter(F.col("n") >= least)
    if not held and by_count:
        share = size / by_count[0][1]
        frequent = counted.filter(
            (F.col("n") == HIGHEST) & (F.shiftrightunsigned(F.xxhash64("word"), 11) / F.lit(float(1 << 53)) < F.lit(0.9 * share)))
    frequent = frequent.select("word")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merge = Merger(vocab)
        for b in batches:
            words = b.column("word").cast(pa.binary())
            ids = pa.array([merge(w) for w in words.to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([words, ids], names=["word", "ids"])

    rows = frequent.repartition(8).mapInArrow(run, "word binary, ids array<int>").toArrow().combine_chunks()
    words, ids = rows.column("word").to_pylist(), rows.column("ids").to_pylist()
    order = sorted(range(len(words)), key=words.__getitem__)
    parts = compile_words([words[i] for i in order])
    parts["flat"] = np.fromiter((x for i in order for x in ids[i]), np.int32)
    parts["offs"] = np.concatenate(([0], np.cumsum([len(ids[i]) for i in order]))).astype(np.int64)
    return parts


_OPEN: dict[str, Encoder] = {}


def _encoder(name: str, shared) -> Encoder:
    """One encoder per worker process."""
    if name not in _OPEN:
        _OPEN.clear()
        _OPEN[name] = Encoder(*shared.value)
    return _OPEN[name]


def _encode_with(docs: DataFrame, path: str | None, text: str, schema: str, make) -> DataFrame:
    spark = docs.sparkSession
    C.importable(spark)
    vocab = Vocabulary(path or default_path())
    shared = spark.sparkContext.broadcast((vocab, build_lexicon(docs, vocab, text=text)))
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(name, shared)
        for b in batches:
            for lo, hi, buf, offs in C.text_chunks(b.column("text")):
                ids, ends = encoder.encode(buf, offs)
                yield make(b.slice(lo, hi - lo), encoder, ids, ends)

    return docs.mapInArrow(run, schema)


def encode(docs: DataFrame, *, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>) of every text, as the vocabulary file's own tokenizer gives them.

    Null and empty texts have no ids; words of any length are merged whole; special strings in a text become
    their ids; repeated rows each get a row; an empty table gives an empty result; other columns are ignored.
    """

    def make(b, encoder, ids, ends):
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
        return pa.RecordBatch.from_arrays([b.column("key"), lists], names=["key", "ids"])

    rows = C.rows_of(docs, key=key, text=text)
    return _encode_with(rows, path, "text", "key long, ids array<int>", make).withColumnRenamed("key", key)


def decode_ids(encoded: DataFrame, *, path: str | None = None, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text) of every row of ids; null and empty lists give the empty text."""
    spark = encoded.sparkSession
    C.importable(spark)
    shared = spark.sparkContext.broadcast(Vocabulary(path or default_path()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, len(b), 256):
                part = b.slice(lo, 256)
                lists = part.column("ids")
                lists = pa.concat_arrays([lists])
                offs = lists.offsets.to_numpy().astype(np.int64)
                texts = decode(shared.value, lists.values.to_numpy(), offs)
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(texts, pa.string())], names=["key", "text"])

    rows = encoded.select(
        F.col(key).cast("bigint").alias("key"), F.coalesce(F.col(ids), F.expr("CAST(array() AS array<int>)")).alias("ids")
    )
    return rows.mapInArrow(run, "key long, text string").withColumnRenamed("key", key)


def round_trip(docs: DataFrame, *, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, packed, decoded): ids as little-endian 32-bit integers, and the text decoded from them, in one pass."""

    def make(b, encoder, ids, ends):
        raw = ids.astype("<u4").tobytes()
        packed = [raw[4 * a : 4 * z] for a, z in zip(ends[:-1].tolist(), ends[1:].tolist())]
        texts = decode(encoder.vocab, ids, ends)
        return pa.RecordBatch.from_arrays(
            [b.column("key"), pa.array(packed, pa.binary()), pa.array(texts, pa.string())], names=["key", "packed", "decoded"]
        )

    rows = C.rows_of(docs, key=key, text=text)
    return _encode_with(rows, path, "text", "key long, packed binary, decoded string", make).withColumnRenamed("key", key)
