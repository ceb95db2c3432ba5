"""Operators with an exact contract against plain versions, with the odd cases of their docstrings."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from factweave.llm import bpe, bwt, common, decontaminate, graph, sharding, simhash

import plain


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{int(rng.random() ** 2 * vocabulary)}" for _ in range(n))


ODD = [(900, None), (901, ""), (902, "   \n "), (None, "no id here at all"), (None, None), (903, "!!! ??"), (904, "x")]


def items_and_docs():
    rng = random.Random(5)
    items = [(i, prose(rng, rng.choice([3, 12, 13, 14, 40]))) for i in range(12)]
    items += [(20, "Short One"), (20, prose(rng, 20)), (21, ""), (22, None), (None, prose(rng, 15)), (23, "solo")]
    docs = []
    for k in range(60):
        text = prose(rng, rng.randrange(5, 120))
        if k % 3 == 0:
            part = (items[k % len(items)][1] or "").split()
            cut = rng.randrange(0, 4)
            text += " " + " ".join(part[cut:]).upper() + ", " + prose(rng, 20)
        docs.append((k, text))
    docs += [(60, items[3][1]), (61, items[3][1]), (61, items[3][1]), (62, "A short, ONE. solo"), *ODD]
    docs.append((63, " ".join(prose(rng, 3000).split() + items[4][1].split())))
    return items, docs


def test_contamination(spark, frame):
    items, docs = items_and_docs()
    table = spark.createDataFrame([(i, t) for i, t in items], "item_id long, text string")
    got = decontaminate.contamination(frame(docs), table).collect()
    want = plain.contamination(docs, items)
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got) == Counter((a, b, c, tuple(d)) for a, b, c, d in want)
    assert all(r.n_hit == sum(s.end - s.start for s in r.spans) for r in got)
    kept = Counter(r.doc_id for r in decontaminate.clean_documents(frame(docs), table).collect())
    bad = {k for k, n, hit, _ in want if hit and 20 * hit >= n}
    assert kept == Counter(k for k, _ in docs if k not in bad)


def test_contamination_empty(spark, frame):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(frame([]), none).count() == 0
    got = decontaminate.contamination(frame([(1, "a b c")]), none).collect()
    assert [(r.n_words, r.n_hit, r["items"]) for r in got] == [(3, 0, [])]


def test_winnowed_runs_are_seen_from_both_sides():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 9, 500).astype(np.uint64)
    for w in (1, 4, 9):
        kept = common.winnow(a, w)
        assert all(np.isin(np.arange(i, i + w), kept).any() for i in range(len(a) - w + 1))


def near_copies():
    rng = random.Random(8)
    docs = []
    for family in range(8):
        base = prose(rng, 150).split()
        for copy in range(6):
            w = base.copy()
            for _ in range(copy // 2):
                w[rng.randrange(len(w))] = "edited"
            docs.append((family * 10 + copy, " ".join(w)))
    return docs + [(500, "one"), (501, "one two"), (502, "ONE"), (503, "one"), *ODD]


def test_simhash_components(spark, frame):
    docs = near_copies()
    got = simhash.near_duplicates(frame(docs)).collect()
    prints = [(k, plain.simhash(t)) for k, t in docs]
    want = Counter((k, f, c) for (k, f), c in zip(prints, plain.components(prints)))
    assert Counter((r.doc_id, r.fp % (1 << 64), r.component) for r in got) == want
    assert simhash.near_duplicates(frame([])).count() == 0


def test_one_of_each(frame):
    docs = near_copies() + [(500, "one")]
    kept = [r.doc_id for r in simhash.one_of_each(frame(docs)).collect()]
    prints = [(k, plain.simhash(t)) for k, t in docs]
    want = {c for c in plain.components(prints)}
    assert set(kept) == want and len(kept) == len(set(kept))


def test_rows_stay_or_go_by_id_and_text(frame):
    rng = random.Random(31)
    texts = [prose(rng, 120, 4000) for _ in range(7)]
    docs = [(None, texts[0]), (None, texts[1]), (None, texts[1] + " "), (1, texts[2]), (None, texts[2]), (2, texts[3]), (2, texts[4]), (2, texts[4])]
    kept = Counter((r.doc_id, r.text.strip()) for r in simhash.one_of_each(frame(docs)).collect())
    assert kept == Counter([(None, texts[0]), (None, texts[1]), (1, texts[2]), (2, texts[3]), (2, texts[4])])
    item = prose(rng, 30, 4000)
    docs = [(None, texts[0]), (None, item), (3, texts[1]), (3, item), (4, texts[2]), (None, None)]
    items = frame([(1, item)]).withColumnRenamed("doc_id", "item_id")
    clean = decontaminate.clean_documents(frame(docs), items)
    assert clean.columns == frame(docs).columns
    assert Counter((r.doc_id, r.text) for r in clean.collect()) == Counter([(None, texts[0]), (3, texts[1]), (4, texts[2]), (None, None)])


@pytest.mark.parametrize("budget", [0, 1, 2, 3])
def test_trie_links_over_many_subtrees(spark, monkeypatch, budget):
    monkeypatch.setattr(simhash, "SUBTREE", 16)
    rng = random.Random(budget)
    prints = {rng.getrandbits(64) for _ in range(150)}
    for f in list(prints)[:100]:
        for _ in range(2):
            g = f
            for _ in range(rng.randrange(1, 5)):
                g ^= 1 << rng.randrange(64)
            prints.add(g)
    prints = sorted(prints)
    signed = [f - (1 << 64) if f >> 63 else f for f in prints]
    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), budget)
    root = {r.node: r.root for r in graph.components(edges).collect()}
    got = defaultdict(set)
    for f in signed:
        got[root.get(f, f)].add(f)
    label = plain.components(list(enumerate(prints)), budget)
    want = defaultdict(set)
    for f, c in zip(signed, label):
        want[c].add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}}


def test_repeated_strings(frame):
    rng = random.Random(2)
    shared = [prose(rng, n, 4000) for n in (40, 120, 400)]
    docs = []
    for k in range(30):
        parts = [prose(rng, rng.randrange(5, 150), 4000)]
        if k % 2:
            s = shared[k % 3]
            cut = rng.randrange(0, 30)
            parts += [s[cut:], prose(rng, 30, 4000)]
        docs.append((k, " ".join(parts)))
    docs += [(40, docs[0][1]), (40, docs[0][1]), (41, "ab" * 500), (42, "z" * 900), (43, docs[5][1] + "ü" + docs[5][1]), (44, "é" * 300), *ODD]
    got = bwt.repeated_strings(frame(docs), length=150).collect()
    want = Counter(plain.repeated(docs, 150))
    assert Counter((r.doc_id, r.n_bytes, tuple((s.start, s.end) for s in r.spans), bytes(r.kept)) for r in got) == want


def test_repeated_strings_empty(frame):
    assert bwt.repeated_strings(frame([])).count() == 0
    with pytest.raises(ValueError):
        bwt.repeated_strings(frame([]), length=20)


def test_suffix_order():
    rng = np.random.default_rng(1)
    sym = rng.integers(0, 3, 200).astype(np.uint64)
    last = rng.random(200) < 0.1
    last[-1] = True
    ends = np.flatnonzero(last)
    runs = [tuple(sym[i : ends[np.searchsorted(ends, i)] + 1].tolist())[:16] for i in range(200)]
    order = bwt.suffix_order(sym, last, 16)
    assert [runs[i] for i in order] == sorted(runs)


BPE_TEXTS = [
    "a<|endoftext|>b <|endoftext|> ", "", " ", "\n\n  x", "it's 's ''s a  b\n\n c '  's", "　a\xa0b", "x​1²½ ٣", "a" * 300,
    "!?" * 200, " " * 100, "x'll'd I'VE", "\U0001F600é́", "\x00\x1f\x85 a", None, "the cat sat on the mat " * 50,
]


def test_bpe_like_the_library(spark, frame):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_path())
    docs = list(enumerate(BPE_TEXTS)) + [(0, BPE_TEXTS[0]), (None, "no id")]
    encoded = bpe.encode(frame(docs))
    got = Counter((r.doc_id, tuple(r.ids)) for r in encoded.collect())
    assert got == Counter((k, tuple(library.encode(t or "", add_special_tokens=False).ids)) for k, t in docs)
    assert Counter((r.doc_id, r.text) for r in bpe.decode_ids(encoded).collect()) == Counter((k, t or "") for k, t in docs)
    both = bpe.round_trip(frame(docs)).collect()
    assert Counter((r.doc_id, tuple(np.frombuffer(r.packed, "<u4").tolist()), r.decoded) for r in both) == Counter(
        (k, tuple(library.encode(t or "", add_special_tokens=False).ids), t or "") for k, t in docs
    )
    assert bpe.encode(frame([])).count() == 0


def test_automaton_holds_its_words_only():
    words = sorted({f"{a}{b}{c}".encode() for a in "abc" for b in ("", "x", "yz") for c in ("ing", "ed", "")} | {b"\xff\x00"})
    parts = bpe.compile_words(words)
    parts |= {"flat": np.zeros(0, np.int32), "offs": np.zeros(1, np.int64)}
    lexicon = bpe.Lexicon(parts)
    asked = words + [b"a", b"abed", b"", b"cyzin", b"zzz"]
    buf = np.frombuffer(b"".join(asked) + b"\0", np.uint8)
    ends = np.cumsum([len(w) for w in asked])
    starts = ends - [len(w) for w in asked]
    number = {w: i for i, w in enumerate(words)}
    assert lexicon.look_up(buf, starts, ends).tolist() == [number.get(w, -1) for w in asked]
    arcs = (lexicon.slots >= 0).sum()
    assert arcs < sum(map(len, words)) / 2  # endings are shared
    assert bpe.Lexicon(bpe.compile_words([]) | {"flat": parts["flat"], "offs": parts["offs"]}).look_up(buf, starts, ends).max() == -1


def test_shards_of_rows_without_ids(frame):
    rng = random.Random(14)
    docs = [(None, "no id " * 12)] * 4000 + [(7, "one id " * 12)] * 2000 + [(k, prose(rng, 60, 5000)) for k in range(500)]
    size = Counter()
    for r in sharding.shards(frame(docs), 40).collect():
        size[r.shard] += r.size
    assert sorted(size) == list(range(40))
    assert max(size.values()) <= 1.05 * sum(size.values()) / 40


def test_shards(frame):
    rng = random.Random(4)
    docs = [(k, prose(rng, rng.randrange(1, 200), 5000)) for k in range(600)]
    docs += [(1000 + k, "hot " * 60) for k in range(400)] + [(k, t) for k, t in docs[:20]] + ODD
    got = sharding.shards(frame(docs), 8).collect()
    want = Counter((k, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for k, t in docs)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    size, slots = Counter(), defaultdict(list)
    for r in got:
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert sorted(size) == list(range(8))
    biggest = max(len((t or "").encode()) + 16 for _, t in docs)
    assert max(size.values()) - min(size.values()) <= 4 * biggest
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    where = defaultdict(set)
    for r in got:
        where[r.text_crc32].add(r.shard)
    assert all(len(s) == 1 for crc, s in where.items() if crc != zlib.crc32(b"hot " * 60))
    assert sharding.shards(frame([]), 8).count() == 0


def test_long_item_grows_with_its_length(frame):
    from factweave.llm import decontaminate

    words = [f"w{i}" for i in range(4000)]
    spark = frame([]).sparkSession
    items = spark.createDataFrame([("long", " ".join(words))], "item_id string, text string")
    held = decontaminate.item_fingerprints(items, 13).selectExpr("sum(length(item_words)) AS n").first()["n"]
    assert held < 10 * len(" ".join(words)) * 2
    docs = frame([(1, " ".join(words[100:112])), (2, " ".join(words[100:113])), (3, "a b " + " ".join(words[3980:]) + " c"), (4, " ".join(words))])
    got = {r["doc_id"]: (r["n_hit"], list(r["items"])) for r in decontaminate.contamination(docs, items).collect()}
    assert got == {1: (0, []), 2: (13, ["long"]), 3: (20, ["long"]), 4: (4000, ["long"])}
