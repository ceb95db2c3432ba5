"""Licence scans with a trained paragraph classifier.

Paragraphs are hashed to sparse word n-grams and scored by a multinomial logistic regression over licence
families and an unknown class. Paragraphs are the lines of a text that share word shingles with a template, and
runs of such lines that follow each other, since notices are wrapped and commented out. It is trained on variations of licence sentences and on paragraphs of the corpus; the
unknown class is calibrated by a temperature and a threshold on held-out examples. A predicted family counts only if
the paragraph also shares enough word shingles with a template of that family.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common as C

BITS = 16
UNKNOWN_ROWS = 4_096  # corpus paragraphs used as unknown examples, drawn by a hash
CONFIRM = 0.6  # share of a template's shingles that must stand in the paragraph
SHINGLE = 3
STEPS = 60

# fixed texts: usual notices of each licence family
TEMPLATES: dict[str, list[str]] = {
    "apache": [
        "licensed under the apache license version 2 0",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at",
        "spdx license identifier apache 2 0",
    ],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "licensed under the bsd 3 clause license",
        "use of this source code is governed by a bsd style license",
        "spdx license identifier bsd 3 clause",
    ],
    "cc": [
        "licensed under cc by nc 4 0",
        "licensed under cc by sa 4 0",
        "licensed under cc by 4 0",
        "this work is licensed under a creative commons attribution 4 0 international license",
        "dedicated to the public domain under cc0 1 0 universal",
    ],
    "boost": [
        "distributed under the boost software license version 1 0",
        "boost software license version 1 0 august 17th 2003",
    ],
    "epl": [
        "this program and the accompanying materials are made available under the terms of the eclipse public license",
        "licensed under the eclipse public license version 2 0",
    ],
    "gpl": [
        "this work is licensed under the gnu general public license version 3",
        "licensed under the gnu lesser general public license version 2 1",
        "licensed under the gnu affero general public license version 3",
        "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
        "spdx license identifier gpl 3 0 or later",
    ],
    "isc": [
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
        "licensed under the isc license",
    ],
    "mit": [
        "released under the mit license",
        "licensed under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        "spdx license identifier mit",
    ],
    "mpl": [
        "this source code form is subject to the terms of the mozilla public license v 2 0",
        "licensed under the mozilla public license version 2 0",
    ],
    "proprietary": [
        "all rights reserved no part of this publication may be reproduced or transmitted in any form without prior written permission",
        "confidential and proprietary unauthorized copying of this file is strictly prohibited",
    ],
    "unlicense": [
        "this is free and unencumbered software released into the public domain",
    ],
    "zlib": [
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software",
        "licensed under the zlib license",
    ],
}
# fixed values: names of licences in SPDX lines, by family
SPDX = {
    "apache": ["apache 2 0"], "boost": ["bsl 1 0"], "bsd": ["bsd 2 clause", "bsd 3 clause", "0bsd"],
    "cc": ["cc by 4 0", "cc by sa 4 0", "cc by nc 4 0", "cc0 1 0"], "epl": ["epl 1 0", "epl 2 0"],
    "gpl": [f"{name} {v} {end}" for name, vs in (("gpl", ("2 0", "3 0")), ("lgpl", ("2 1", "3 0")), ("agpl", ("3 0",)))
            for v in vs for end in ("only", "or later")],
    "isc": ["isc"], "mit": ["mit"], "mpl": ["mpl 2 0"], "unlicense": ["unlicense"], "zlib": ["zlib"],
}
for _family, _names in SPDX.items():
    TEMPLATES[_family] += [t for t in (f"spdx license identifier {x}" for x in _names) if t not in TEMPLATES[_family]]
FAMILIES = sorted(TEMPLATES)
# fixed words put around and into notices for training
_LEADS = ("", "copyright 2021 the authors", "note", "this project is", "this file is", "the code is", "unless stated otherwise this is")
_TAILS = ("", "see the license file", "for details see the file named license", "all contributions are welcome", "contact the authors")


def _flat(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode() for t in texts]
    offs = np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)
    return np.frombuffer(b"".join(raw), np.uint8), offs


def _words(buf: np.ndarray, offs: np.ndarray):
    low = C.LOWER[buf]
    s, e, doc = C.word_spans(low, offs, C.ALNUM)
    return C.span_hash(C.prefix_hash(low), s, e), doc


def ngrams(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature) of the words, pairs and triples of each text, every feature once a text."""
    words, doc = _words(buf, offs)
    parts_d, parts_f = [], []
    for k in (1, 2, 3):
        h, ok = C.shingles(words, doc, k)
        parts_d.append(doc[ok])
        parts_f.append(C.mix(h[ok] + C.U64(k)) >> C.U64(64 - BITS))
    at = np.unique((np.concatenate(parts_d).astype(C.U64) << C.U64(BITS)) | np.concatenate(parts_f))
    return (at >> C.U64(BITS)).astype(np.int64), (at & C.U64((1 << BITS) - 1)).astype(np.int64)


def paragraphs(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of the lines of each text that are not blank."""
    kind = np.ones(256, bool)
    kind[[10, 13]] = False
    s, e, doc = C.word_spans(buf, offs, kind)
    solid = np.concatenate(([0], np.cumsum(C.SOLID[buf]))) if len(buf) else np.zeros(1, np.int64)
    full = solid[e] > solid[s]
    return s[full], e[full], doc[full]


def wrapped(buf: np.ndarray, s: np.ndarray, e: np.ndarray, doc: np.ndarray, offs: np.ndarray, keys: np.ndarray):
    """Lines that share a shingle with a template, and (first, last) lines of runs of them that follow each other.

    Shingles run on over line ends; punctuation and comment marks are no words. A blank line ends a run.
    """
    words, of = _words(buf, offs)
    low, ends, _ = C.word_spans(C.LOWER[buf], offs, C.ALNUM)
    h, ok = C.shingles(words, of, SHINGLE)
    at = np.flatnonzero(ok & np.isin(h, keys))
    touched = np.zeros(len(s), bool)
    if not len(at):
        return touched, np.zeros(0, np.int64), np.zeros(0, np.int64)
    feeds = np.concatenate(([0], np.cumsum(buf == 10)))
    joined = np.zeros(len(s), bool)  # a line follows directly on the one before
    joined[1:] = (doc[1:] == doc[:-1]) & (feeds[s[1:]] - feeds[e[:-1]] <= 1)
    block = np.cumsum(~joined)
    first = np.searchsorted(s, low[at], side="right") - 1
    last = np.searchsorted(s, low[at + SHINGLE - 1], side="right") - 1
    whole = block[first] == block[last]
    lines, _ = C.ragged_ranges(np.arange(len(s)), first[whole], last[whole] + 1)
    touched[lines] = True
    opens = touched & ~(np.concatenate(([False], touched[:-1])) & joined)
    closes = touched & ~np.concatenate(((touched & joined)[1:], [False]))
    a, z = np.flatnonzero(opens), np.flatnonzero(closes)
    return touched, a[z > a], z[z > a]


# ---------------------------------------------------------------- the model


class Model:
    """Weights per family and the unknown class, with the temperature and threshold found on held-out examples."""

    def __init__(self, w: np.ndarray, temperature: float = 1.0, threshold: float = 0.5):
        self.w, self.temperature, self.threshold = w, temperature, threshold

    def chances(self, doc: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        size = np.maximum(np.bincount(doc, minlength=n), 1)
        scale = 1 / np.sqrt(size)
        z = np.stack([np.bincount(doc, w[feature], minlength=n) * scale + w[-1] for w in self.w], axis=1) / self.temperature
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        return p / p.sum(axis=1, keepdims=True)


def fit(texts: list[str], labels: np.ndarray) -> Model:
    """Multinomial regression by full-batch adaptive gradient steps; a fifth of the examples calibrates it.

    labels: index of the family, or len(FAMILIES) for unknown.
    """
    held = np.arange(len(texts)) % 5 == 4
    classes, size = len(FAMILIES) + 1, (1 << BITS) + 1
    model = Model(np.zeros((classes, size)))
    doc, feature = ngrams(*_flat(texts))
    train = ~held[doc]
    n = len(texts)
    scale = 1 / np.sqrt(np.maximum(np.bincount(doc, minlength=n), 1))
    goal = np.eye(classes)[labels] * (~held)[:, None]
    # every class weighs the same
    share = goal.sum(axis=0)
    weight = (goal / np.maximum(share, 1)).sum(axis=1) * (~held).sum() / classes
    seen = np.full_like(model.w, 1e-8)
    d, f = doc[train], feature[train]
    for _ in range(STEPS):
        error = (model.chances(doc, feature, n) - np.eye(classes)[labels]) * weight[:, None]
        for c in range(classes):
            g = np.bincount(f, error[d, c] * scale[d], minlength=size)
            g[-1] = error[:, c].sum()
            g += 1e-4 * model.w[c]
            seen[c] += g * g
            model.w[c] -= 0.5 * g / np.sqrt(seen[c])
    # temperature by held-out likelihood, threshold halfway between the held-out known and unknown examples
    best = (np.inf, 1.0)
    for t in (0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0):
        model.temperature = t
        p = model.chances(doc, feature, n)[held, labels[held]] if held.any() else np.ones(1)
        best = min(best, (float(-np.log(np.maximum(p, 1e-12)).mean()), t))
    model.temperature = best[1]
    p = model.chances(doc, feature, n)[held]
    known = labels[held] < len(FAMILIES)
    top = p[:, :-1].max(axis=1, initial=0)
    if known.any() and (~known).any():
        # the lowest chance that keeps 99.9 % of the unknown examples out, never below one half nor above 0.9
        model.threshold = float(np.clip(np.quantile(top[~known], 0.999), 0.5, 0.9))
    return model


def known_examples() -> tuple[list[str], list[int]]:
    """Variations of the templates: words before and after, and words left out or doubled.

    SPDX lines keep their last words, without which they name no licence.
    """
    texts, labels = [], []
    for c, family in enumerate(FAMILIES):
        for t in TEMPLATES[family]:
            words = t.split()
            forms = [words, words[1:], words[:-1], words[: len(words) // 2] + words[len(words) // 2 + 1 :], words[:2] + words]
            if words[0] == "spdx":
                forms = [words, words[1:], words[:2] + words]
            for form in forms:
                for lead in _LEADS:
                    for tail in _TAILS:
                        texts.append(" ".join(filter(None, (lead, " ".join(form), tail))))
                        labels.append(c)
    return texts, labels


def _unknown_examples(rows: DataFrame, n: int) -> list[str]:
    """A bounded draw of corpus paragraphs that share no shingle with a template; at most n, by a hash."""
    total = rows.count()
    if not total:
        return []
    share = min(1.0, n / total)  # one paragraph of each drawn document
    u = F.shiftrightunsigned(F.xxhash64(F.lit(53), "key", "text"), 11) / F.lit(float(1 << 53))
    lines = F.filter(F.split("text", r"[\r\n]+"), lambda x: F.trim(x) != "")
    drawn = rows.withColumn("u", u).filter(F.col("u") < F.lit(share)).select("u", lines.alias("p")).filter(F.size("p") > 0).select(
        "u", F.element_at("p", (F.pmod(F.xxhash64(F.col("p")[0]), F.size("p")) + 1).cast("int")).alias("p")
    )
    texts = [r["p"] for r in drawn.orderBy("u", "p").limit(2 * n).collect()]
    if not texts:
        return []
    words, doc = _words(*_flat(texts))
    h, ok = C.shingles(words, doc, SHINGLE)
    hit = np.bincount(doc[ok][np.isin(h[ok], _template_shingles()[0])], minlength=len(texts)) > 0
    return sorted(t for t, x in zip(texts, hit) if not x)


def _template_shingles() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted (shingle, template) pairs, the family of each template, and its number of shingles."""
    texts = [t for f in FAMILIES for t in TEMPLATES[f]]
    family = np.array([i for i, f in enumerate(FAMILIES) for _ in TEMPLATES[f]])
    words, doc = _words(*_flat(texts))
    h, ok = C.shingles(words, doc, SHINGLE)
    order = np.lexsort((doc[ok], h[ok]))
    return h[ok][order], doc[ok][order], family, np.bincount(doc[ok], minlength=len(texts))


def _confirmed(words: np.ndarray, doc: np.ndarray, n: int, family: np.ndarray, templates) -> np.ndarray:
    """Largest share of a template of the predicted family that stands in each paragraph."""
    keys, owner, of, size = templates
    h, ok = C.shingles(words, doc, SHINGLE)
    h, doc = h[ok], doc[ok]
    lo, hi = np.searchsorted(keys, h), np.searchsorted(keys, h, side="right")
    at, count = C.ragged_ranges(np.arange(len(keys)), lo, hi)
    pair = np.unique(np.stack([np.repeat(doc, count), owner[at], at]), axis=1) if len(at) else np.zeros((3, 0), np.int64)
    got = np.zeros((n, len(of)))
    np.add.at(got, (pair[0], pair[1]), 1)
    share = got / np.maximum(size, 1)
    return np.where(of[None, :] == family[:, None], share, 0).max(axis=1, initial=0)


def scan(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_paragraphs, notices) of every document; notices are array<struct<paragraph, family, chance, share>>.

    A paragraph is a line that is not blank, counted from 0; a line of any length is looked at whole. It is a notice
    if a family's chance reaches the calibrated threshold and the family is confirmed by a template. A run of lines that
    follow each other and share shingles with templates is judged as one paragraph too, named by its first line,
    unless one of its lines is a notice by itself. Lines without a template's shingle cannot be confirmed and are only counted. Null
    and empty texts have no paragraphs; repeated rows each get a row; an empty table gives an empty result; other
    columns are ignored.
    """
    spark = docs.sparkSession
    rows = C.rows_of(docs, key=key, text=text)
    texts, labels = known_examples()
    unknown = _unknown_examples(rows, UNKNOWN_ROWS)
    model = fit(texts + unknown, np.array(labels + [len(FAMILIES)] * len(unknown)))
    shared = spark.sparkContext.broadcast((model.w.astype(np.float32), model.temperature, model.threshold, _template_shingles()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, temperature, threshold, templates = shared.value
        judge = Model(w, temperature, threshold)
        for b in batches:
            n_paragraphs = np.zeros(len(b), np.int64)
            notices: list[list] = [[] for _ in range(len(b))]
            for lo, hi, buf, offs in C.text_chunks(b.column("text")):
                s, e, doc = paragraphs(buf, offs)
                n_paragraphs[lo:hi] = np.bincount(doc, minlength=hi - lo)
                first = C.per_text(doc, hi - lo)
                touched, begin, last = wrapped(buf, s, e, doc, offs, templates[0])
                noticed = np.zeros(len(s) + 1, np.int64)
                single = np.flatnonzero(touched)
                for at, end in ((single, single), (begin, last)):
                    if at is begin:  # runs none of whose lines was found by itself
                        total = np.concatenate(([0], np.cumsum(noticed)))
                        free = total[end + 1] == total[at]
                        at, end = at[free], end[free]
                    if not len(at):
                        continue
                    # the candidates become the texts of a chunk of their own
                    flat, size = C.ragged_ranges(buf, s[at], e[end])
                    bounds = np.concatenate(([0], np.cumsum(size)))
                    p = judge.chances(*ngrams(flat, bounds), len(at))
                    family = p[:, :-1].argmax(axis=1)
                    chance = p[np.arange(len(at)), family]
                    words, of = _words(flat, bounds)
                    share = _confirmed(words, of, len(at), family, templates)
                    good = (chance >= threshold) & (p[:, -1] < chance) & (share >= CONFIRM)
                    for i in np.flatnonzero(good).tolist():
                        line = int(at[i])
                        noticed[line] = 1
                        notices[lo + int(doc[line])].append({
                            "paragraph": line - int(first[doc[line]]), "family": FAMILIES[family[i]],
                            "chance": float(chance[i]), "share": float(share[i]),
                        })
            notices = [sorted(found, key=lambda x: x["paragraph"]) for found in notices]
            kind = pa.list_(pa.struct([("paragraph", pa.int32()), ("family", pa.string()), ("chance", pa.float64()), ("share", pa.float64())]))
            yield pa.RecordBatch.from_arrays(
                [b.column("key"), pa.array(n_paragraphs), pa.array(notices, kind)], names=["key", "n_paragraphs", "notices"]
            )

    return rows.mapInArrow(
        run, "key long, n_paragraphs long, notices array<struct<paragraph: int, family: string, chance: double, share: double>>"
    ).withColumnRenamed("key", key)
