"""Plain versions that the operators are compared with."""

import hashlib
import re
from collections import Counter, defaultdict

import xxhash

UPPER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def contamination(docs, items, window=13):
    runs = []
    for item, text in items:
        w = words(text)
        n = min(window, len(w))
        runs += [(item, tuple(w[i : i + n])) for i in range(len(w) - n + 1) if n]
    out = []
    for key, text in docs:
        w, hit, found = words(text), set(), set()
        for item, run in runs:
            for i in range(len(w) - len(run) + 1):
                if tuple(w[i : i + len(run)]) == run:
                    hit.update(range(i, i + len(run)))
                    found.add(str(item) if item is not None else "")
        out.append((key, len(w), len(hit), sorted(found)))
    return out


def simhash(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h))


def components(prints, budget=2):
    """Smallest key reachable from each row over prints that differ in at most budget bits."""
    n = len(prints)
    label = list(range(n))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(n):
        for j in range(i):
            if bin(prints[i][1] ^ prints[j][1]).count("1") <= budget:
                label[find(i)] = find(j)
    low = defaultdict(list)
    for i, (key, _) in enumerate(prints):
        if key is not None:
            low[find(i)].append(key)
    return [min(low[find(i)], default=None) for i in range(n)]


def repeated(docs, length):
    """n_bytes, removed spans and kept bytes of every text."""
    raw = [(k, (t or "").encode()) for k, t in docs]
    seen = Counter(r[i : i + length] for _, r in raw for i in range(len(r) - length + 1))
    out = []
    for k, r in raw:
        gone = [False] * len(r)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans, at = [], 0
        while at < len(r):
            end = at
            while end < len(r) and gone[end] == gone[at]:
                end += 1
            if gone[at]:
                spans.append((at, end))
            at = end
        out.append((k, len(r), tuple(spans), bytes(b for b, g in zip(r, gone) if not g)))
    return out


def sha(data):
    return hashlib.sha256(data).hexdigest()
