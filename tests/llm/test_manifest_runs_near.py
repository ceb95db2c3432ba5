"""Manifests, periodic runs and MinHash components against plain versions."""

import random
import re
import zlib
from collections import Counter

import pytest
from factweave.llm import catalog, merkle, neardup, periodic

import plain
from test_exact import ODD, near_copies, prose

# ---------------------------------------------------------------- manifest


def leaf(row):
    parts = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row]
    return plain.sha("".join(parts).encode())


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([plain.sha("".join(out[-1][i : i + 3]).encode()) for i in range(0, len(out[-1]), 3)])
    return out


def path(tree, at):
    out = []
    for level in tree[:-1]:
        lo = at - at % 3
        out.append(("".join(level[lo:at]), "".join(level[at + 1 : lo + 3])))
        at //= 3
    return out


def plain_manifest(rows):
    """(doc_id, leaf, subroot, root, proof, folded) of rows (doc_id, source, lang, n_chars, text)."""
    trees, order = {}, sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        own = sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = own, levels([leaf(r) for r in own])
    top = levels([trees[s][1][-1][0] for s in order])
    out = []
    for n, s in enumerate(order):
        own, tree = trees[s]
        for at, r in enumerate(own):
            siblings = path(tree, at) + path(top, n)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None:
                r = (*r[:4], r[4].replace("\n", ""))
            folded = leaf(r)
            for a, b in siblings:
                folded = plain.sha((a + folded + b).encode())
            proof = plain.sha("".join(a + b for a, b in siblings).encode())
            out.append((r[0], tree[0][at], tree[-1][0], top[-1][0], proof, folded))
    return out


DOCS = "doc_id long, source string, lang string, n_chars long, text string, rank int, tree string, digest string"


def documents(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y") for r in rows], DOCS)


def answered(m):
    return Counter((r.key, r.leaf, r.subroot, r.root, r.proof, r.folded) for r in merkle.prove(m).collect())


def rows_of_sources(rng, sizes):
    out = []
    for s, n in sizes.items():
        for _ in range(n):
            k = len(out)
            text = rng.choice([None, "", "a\nb", f"text {k}\n", "ä\n\n€"])
            out.append((k, s, rng.choice([None, "de", ""]), rng.choice([None, k]), text))
    return out


@pytest.mark.parametrize("sizes", [{"one": 1}, {"b": 3, "a": 4, None: 2, "": 1, "ä": 10}, {"hot": 2300, "z": 731, "é": 1, "Z": 729}])
def test_manifest(spark, sizes):
    rows = rows_of_sources(random.Random(3), sizes)
    rows += rows[:2] + [(None, None, None, None, None), (None, "b", None, None, "x\ny"), (None, "b", None, None, "x\ny")]
    m = merkle.manifest(documents(spark, rows), claim=merkle.tampered())
    assert answered(m) == Counter(plain_manifest(rows))
    assert all(r.found for r in merkle.prove(m).collect())


def test_manifest_of_many_trees(spark):
    rows = rows_of_sources(random.Random(4), {f"s{i}": 1 + i % 3 for i in range(800)})
    assert answered(merkle.manifest(documents(spark, rows), claim=merkle.tampered())) == Counter(plain_manifest(rows))


def test_some_requests_and_an_empty_table(spark):
    rows = rows_of_sources(random.Random(5), {"a": 40, "b": 7})
    m = merkle.manifest(documents(spark, rows))
    asked = m.leaves.filter("key % 9 = 0")
    got = merkle.prove(m, asked.unionByName(asked.filter("key = 9"))).collect()
    assert Counter(r.key for r in got) == Counter([k for k in range(0, 47, 9)] + [9])
    assert all(r.folded == r.root for r in got)
    path_ = next(r.path for r in got if r.key == 9)
    assert plain.sha("".join(x for p in path_ for x in p).encode()) == next(r.proof for r in got if r.key == 9)
    empty = merkle.manifest(documents(spark, []))
    assert empty.root.count() == 0 and merkle.prove(empty).count() == 0


# ---------------------------------------------------------------- runs


def plain_runs(w, least=12):
    n, out = len(w), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q):
                out.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((s, e - s, q) for (s, e), q in out.items()), key=lambda r: (r[0], r[2]))


def test_runs_of_random_words():
    rng = random.Random(6)
    for _ in range(1500):
        n, v = rng.randrange(0, 80), rng.choice([1, 2, 3, 5, 20])
        w = [b"%d" % rng.randrange(v) for _ in range(n)]
        if rng.random() < 0.5:
            a, p = rng.randrange(n + 1), rng.randrange(1, 20)
            w = w[:a] + [w[a + i % p] if a + i % p < n else b"z" for i in range(n - a)] + w[: rng.randrange(5)]
        assert periodic.runs_of(w) == plain_runs(w)


def test_runs_of_words_whose_hashes_coincide():
    w = [b"%d" % (i.bit_count() & 1) for i in range(1 << 12)]  # sums of odd powers vanish on these
    assert periodic.runs_of(w) == plain_runs(w)


def test_periodic_runs(spark, frame, tmp_path):
    rng = random.Random(7)
    docs = [(k, prose(rng, rng.randrange(0, 300), rng.choice([3, 40, 4000]))) for k in range(150)]
    docs += [(200, "buy now " * 4000), (200, "buy now " * 4000), (201, "a b " * 12), *ODD]
    docs.append((202, prose(rng, 20000, 400)))
    frame(docs).write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.op12_periodic_runs(spark, str(tmp_path)).collect()
    want = []
    for k, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n, h = len(w), 1 if k is None else zlib.crc32(str(k).encode())
        if h % 10 == 0 and n:
            a, g = h // 10 % n, h // 10
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = plain_runs(w) if n < 10000 or len(set(w)) < 10 else periodic.runs_of([x.encode() for x in w])
        gone = {i for s, m, q in runs for i in range(s + q, s + m)}
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None,) * 3)
        listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        milli = 1000 * best[1] // best[2] if runs else None
        want.append((k, len(runs), *best, milli, plain.sha(listed.encode()), plain.sha(kept.encode())))
    assert Counter(map(tuple, got)) == Counter(want)
    assert sum(r.n_runs > 0 for r in got) > 5
    assert periodic.periodic_runs(frame([])).count() == 0


# ---------------------------------------------------------------- near-duplicates


def plain_near(docs, percent=85):
    sets = []
    for _, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(plain.UPPER))
        sets.append({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(docs)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                label[find(i)] = find(j)
    low = {}
    for i, (k, _) in enumerate(docs):
        if k is not None:
            low[find(i)] = min(k, low.get(find(i), k))
    return Counter((k, len(s), low.get(find(i)), k == low.get(find(i))) for i, ((k, _), s) in enumerate(zip(docs, sets)))


def found(df):
    return Counter((r.doc_id, r.n_shingles, r.component, r.kept) for r in neardup.near_duplicates(df).collect())


def test_near_duplicates(frame):
    docs = near_copies() + [(600, "a b c d e"), (601, "A b c d e"), (602, "a b c d"), (603, "a b c d"), (600, "a b c d e")]
    assert found(frame(docs)) == plain_near(docs)
    assert neardup.near_duplicates(frame([])).count() == 0


def test_a_large_family_of_edited_copies(frame):
    """Copies of a base link to it and mostly not to one another; chains link copies of copies."""
    rng = random.Random(9)
    base = prose(rng, 220, 5000).split()
    docs = [(77, " ".join(base))]
    for k in range(130):
        w = base.copy()
        for _ in range(rng.choice([1, 2, 3, 4, 6])):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
        docs.append((k + 100, " ".join(w)))
    for k in range(40):  # a chain
        w = docs[-1][1].split() if k else prose(rng, 200, 5000).split()
        for i in range(2):
            w[rng.randrange(len(w))] = f"step{k}{i}"
        docs.append((k + 300, " ".join(w)))
    docs += [(k + 400, f"{prose(rng, 60, 5000)}") for k in range(30)] + [(500 + k, prose(random.Random(1), 30, 900)) for k in range(50)]
    rng.shuffle(docs)
    assert found(frame(docs)) == plain_near(docs)
