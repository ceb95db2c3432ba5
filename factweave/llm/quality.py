"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every document, for two targets: junk and
toxicity. Expectation-maximisation over the counts of all vote patterns estimates how accurate each labeller is,
without labelled rows. The posterior of a document's pattern is its soft label; a linear scorer over hashed words
and votes is trained on the soft labels and scores all documents.

Two of the toxicity labellers look for words that labelled toxic documents use far more often than the other
labelled ones; each takes its words from one half of a bounded sample of the labelled rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from . import common as C

FEATURE_BITS = 20
TRAINING_ROWS = 16_384  # documents, drawn by a hash of their text, on which the scorer is fitted
EPOCHS, LEAST_STEPS = 4, 2_000  # passes over the training rows; more of them if they are few
STEP, SHRINK = 0.05, 1e-5
VOTE_WEIGHT = 4.0  # of a vote feature; a word counts 1
LABELLED_ROWS = 20_000  # labelled documents from which bad words are learned, drawn by a hash of their id
BAD_WORDS = 400  # learned words of each half, at most

# fixed words: insults of persons, and abusive judgements, lower case
PERSON_WORDS = (
    "bastard bitch bozo clown coward cretin creep dimwit dumbass fool freak halfwit idiot imbecile jackass jerk loser lunatic "
    "maggot moron nitwit parasite pig rat scum scumbag simpleton slut sucker twit vermin whore"
).split()
JUDGEMENT_WORDS = (
    "asinine braindead contemptible crap despicable disgusting dumb filthy garbage hateful idiotic inferior moronic nasty "
    "obnoxious pathetic repulsive revolting rotten shit shitty sickening stupid subhuman trash ugly useless vile worthless"
).split()

JUNK = (
    "repeats", "few_words", "few_shingles", "symbols", "symbol_endings", "few_letters", "capitals", "capital_words", "exclaiming",
    "tables", "letterless", "same_lines", "word_length", "plain", "varied",
)
TOXIC = ("insults", "judgements", "several_abuses", "abuse_density", "learned_one", "learned_two", "no_abuse")
TARGETS = {"junk": JUNK, "toxic": TOXIC}


def _hash_words(words: list[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    ends = np.cumsum([len(w) for w in raw])
    buf = np.frombuffer(b"".join(raw), np.uint8)
    return np.sort(C.span_hash(C.prefix_hash(buf), np.concatenate(([0], ends[:-1])), ends))


_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True  # and digits


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.divide(part, whole, out=np.zeros(len(whole)), where=whole > 0)


def votes_and_features(buf: np.ndarray, offs: np.ndarray, learned: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Votes (texts x labellers; 1 good, -1 bad, 0 none), and the hashed words of each text with its number.

    An empty text gets no votes and has no words.
    """
    k = len(offs) - 1
    low = C.LOWER[buf]

    def per(doc: np.ndarray) -> np.ndarray:
        return np.bincount(doc, minlength=k).astype(float)

    def distinct(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        return per(doc[new])

    def inside(flags: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(flags)))
        return total[e] - total[s]

    s, e, doc = C.word_spans(low, offs, C.SOLID)
    prefix = C.prefix_hash(low)
    solid = C.span_hash(prefix, s, e)
    n = per(doc)
    again = np.zeros(len(s), bool)
    again[1:] = (solid[1:] == solid[:-1]) & (doc[1:] == doc[:-1])
    sh, ok = C.shingles(solid, doc, 3)
    upper, lower = (buf >= 65) & (buf <= 90), (buf >= 97) & (buf <= 122)
    letter = _LETTER[buf]
    starts, ends = offs[:-1], offs[1:]
    letters = inside(letter, s, e)
    ups = inside(upper, s, e)
    last = low[np.maximum(e - 1, 0)] if len(s) else low[:0]
    bang = (last == 33) & (low[np.maximum(e - 2, 0)] == 33) if len(s) else np.zeros(0, bool)
    ls, le, ldoc = C.word_spans(low, offs, _LINE)
    lines = per(ldoc)
    ws, we, wdoc = C.word_spans(low, offs, C.ALNUM)
    words = C.span_hash(prefix, ws, we)
    person, judged = np.isin(words, _PERSONS), np.isin(words, _JUDGEMENTS)
    abuse = per(wdoc[person | judged])
    repeats = _share(per(doc[again]), n)
    shingled = per(doc[ok])
    varied = np.where(shingled > 0, _share(distinct(sh[ok], doc[ok]), shingled), 1.0)
    symbols = _share(inside(_SYMBOL[buf], starts, ends), np.diff(offs).astype(float))
    letter_share = _share(inside(letter, starts, ends), inside(C.SOLID[buf], starts, ends).astype(float))
    capital_share = _share(inside(upper, starts, ends), inside(upper | lower, starts, ends).astype(float))
    mean = _share(np.bincount(doc, e - s, minlength=k), n)
    bad = [
        repeats > 0.2, (n >= 40) & (_share(distinct(solid, doc), n) < 0.2), (n >= 20) & (varied < 0.5),
        symbols > 0.06, _share(per(doc[_SYMBOL[last]]), n) > 0.2, letter_share < 0.75,
        capital_share > 0.5, _share(per(doc[(ups > 1) & (inside(lower, s, e) == 0)]), n) > 0.4, _share(per(doc[bang]), n) > 0.1,
        _share(per(doc[(e - s == 1) & (last == 124)]), n) > 0.1, _share(per(doc[letters == 0]), n) > 0.2,
        (lines > 3) & (distinct(C.span_hash(prefix, ls, le), ldoc) < 0.7 * lines), (mean > 20) | (mean < 2),
    ]
    good = [(letter_share > 0.78) & (capital_share < 0.15), (repeats < 0.05) & (varied > 0.9)]
    toxic = [
        per(wdoc[person]) > 0, per(wdoc[judged]) > 0, abuse > 1, _share(abuse, per(wdoc)) > 0.002,
        *(per(wdoc[np.isin(words, known)]) > 0 for known in learned),
    ]
    votes = np.stack([*(-x.astype(np.int8) for x in bad), *good, *(-x.astype(np.int8) for x in toxic), abuse == 0], axis=1).astype(np.int8)
    votes[n == 0] = 0
    shift = C.U64(64 - FEATURE_BITS)
    at = np.unique((wdoc.astype(C.U64) << C.U64(FEATURE_BITS)) | (C.mix(words) >> shift))
    return votes, (at >> C.U64(FEATURE_BITS)).astype(np.int64), (at & C.U64((1 << FEATURE_BITS) - 1)).astype(np.int32)


_LINE = np.ones(256, bool)
_LINE[[10, 13]] = False
_PERSONS, _JUDGEMENTS = _hash_words(PERSON_WORDS), _hash_words(JUDGEMENT_WORDS)
_COLUMNS = {"junk": slice(0, len(JUNK)), "toxic": slice(len(JUNK), len(JUNK) + len(TOXIC))}


def _vote_features(votes: np.ndarray) -> np.ndarray:
    """A feature for each labeller's vote, hashed like the words."""
    fixed = (C.seeded(3 * votes.shape[1], 31) >> C.U64(64 - FEATURE_BITS)).astype(np.int32).reshape(votes.shape[1], 3)
    return fixed[np.arange(votes.shape[1])[None, :], votes + 1]


# ---------------------------------------------------------------- bad words from labelled rows


def learn_words(docs: DataFrame, labels: DataFrame | None, rows: int = LABELLED_ROWS) -> tuple:
    """Hashes of words that toxic labelled documents use at least 30 times as often, for each half of a sample.

    labels: doc_id, toxic. The sample is drawn by a hash of the id; at most about ``rows`` documents. Documents with
    the same smallest shingle count once for a word, so that copies of one text do not pass for many.
    """
    if labels is None:
        return (np.zeros(0, np.uint64), np.zeros(0, np.uint64))
    total = labels.count()
    h = F.xxhash64(F.lit(43), "key")
    known = labels.select(F.col("doc_id").cast("bigint").alias("key"), F.col("toxic").cast("int").alias("toxic")).filter(
        (F.shiftrightunsigned(h, 11) / F.lit(float(1 << 53)) < F.lit(min(1.0, rows / max(total, 1)))) & F.col("toxic").isNotNull()
    ).groupBy("key").agg(F.max("toxic").alias("toxic"), F.max(F.pmod(F.shiftright(h, 5), F.lit(2))).cast("int").alias("half"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, buf, offs in C.text_chunks(b.column("text")):
                low = C.LOWER[buf]
                s, e, doc = C.word_spans(low, offs, C.ALNUM)
                h = C.span_hash(C.prefix_hash(low), s, e)
                sh, ok = C.shingles(h, doc, 5)
                least = np.full(hi - lo, 0xFFFFFFFFFFFFFFFF, np.uint64)
                np.minimum.at(least, doc[ok], sh[ok])
                order = np.lexsort((h, doc))
                h, doc = h[order], doc[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                rows = pa.array(lo + doc[new])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[new].view(np.int64)), pa.array(least[doc[new]].view(np.int64)), b.column("toxic").take(rows),
                     b.column("half").take(rows)],
                    names=["word", "copies", "toxic", "half"],
                )

    known = C.materialise(known, "labelled")  # bounded by ``rows``, and so broadcast
    seen = docs.join(F.broadcast(known), "key").select("text", "toxic", "half")
    sizes = {(r["half"], r["toxic"]): r["count"] for r in known.groupBy("half", "toxic").count().collect()}
    counts = seen.mapInArrow(run, "word long, copies long, toxic int, half int").distinct().groupBy("half", "word").agg(
        F.sum((F.col("toxic") > 0).cast("long")).alias("bad"), F.sum((F.col("toxic") <= 0).cast("long")).alias("fine")
    )
    out = []
    for half in (0, 1):
        scale = (sizes.get((half, 0), 0) + 1) / (sizes.get((half, 1), 0) + 1)
        odds = (F.col("bad") + 0.5) / (F.col("fine") + 0.5) * F.lit(scale)
        best = counts.filter((F.col("half") == half) & (F.col("bad") >= 6) & (odds >= 30)).orderBy(F.desc(odds), "word").limit(BAD_WORDS)
        out.append(np.sort(np.array([r["word"] for r in best.select("word").collect()], np.int64).view(np.uint64)))
    return tuple(out)


# ---------------------------------------------------------------- the label model


def vote_patterns(docs: DataFrame, learned: tuple) -> DataFrame:
    """(votes, n): how often each row of votes occurs, over all documents; at most 3**labellers rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, buf, offs in C.text_chunks(b.column("text")):
                rows, n = np.unique(votes_and_features(buf, offs, learned)[0], axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r.tobytes() for r in rows], pa.binary()), pa.array(n)], names=["votes", "n"]
                )

    return docs.select("text").mapInArrow(run, "votes binary, n long").groupBy("votes").agg(F.sum("n").alias("n"))


class LabelModel:
    """Accuracies of labellers and the share of bad documents, from vote patterns alone.

    rates[l, c, v] is the chance that labeller l votes v - 1 on a document of class c (0 good, 1 bad).
    """

    def __init__(self, votes: np.ndarray, n: np.ndarray, rounds: int = 200, prior_bad: float = 0.15):
        m = votes.shape[1]
        self.bad = prior_bad
        # labellers start out right more often than not; a prior of one vote of each kind keeps rates off 0 and 1
        self.rates = np.tile(np.array([[0.05, 0.25, 0.7], [0.4, 0.3, 0.3]]), (m, 1, 1))
        onehot = (votes[:, :, None] == np.array([-1, 0, 1])).astype(float)
        for _ in range(rounds if len(n) else 0):
            p = self.posterior(votes)
            weight = np.stack([(1 - p) * n, p * n])
            rates = np.einsum("cp,plv->lcv", weight, onehot) + 1.0
            rates /= rates.sum(axis=2, keepdims=True)
            bad = min(0.5, (weight[1].sum() + 1) / (n.sum() + 2))  # bad documents are the fewer, which tells the classes apart
            settled = np.abs(rates - self.rates).max() < 1e-7
            self.rates, self.bad = rates, bad
            if settled:
                break

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Chance that a document with these votes is bad."""
        log = np.log(self.rates)[np.arange(votes.shape[1])[None, :], :, votes + 1].sum(axis=1)
        odds = log[:, 1] - log[:, 0] + np.log(self.bad / (1 - self.bad))
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))

    def accuracy(self) -> np.ndarray:
        """Share of each labeller's votes that are right."""
        share = np.array([1 - self.bad, self.bad])
        right = share[0] * self.rates[:, 0, 2] + share[1] * self.rates[:, 1, 0]
        return right / (right + share[0] * self.rates[:, 0, 0] + share[1] * self.rates[:, 1, 2])


def fit_label_models(docs: DataFrame, learned: tuple) -> dict[str, LabelModel]:
    """docs: key and text, as of ``rows_of``."""
    rows = vote_patterns(docs, learned).orderBy("votes").collect()
    votes = np.array([np.frombuffer(bytes(r["votes"]), np.int8) for r in rows], np.int8).reshape(-1, len(JUNK) + len(TOXIC))
    n = np.array([r["n"] for r in rows], float)
    return {target: LabelModel(votes[:, cols].astype(np.int64), n) for target, cols in _COLUMNS.items()}


# ---------------------------------------------------------------- the scorer


def train(labels: np.ndarray, features: list[np.ndarray]) -> np.ndarray:
    """Weights of a logistic scorer for soft labels: adaptive gradient steps over small batches, in a fixed order."""
    size = 1 << FEATURE_BITS
    w, seen, bias, bias_seen = np.zeros(size), np.full(size, 1e-8), 0.0, 1e-8
    order = np.argsort(C.seeded(len(labels), 37), kind="stable")
    for _ in range(max(EPOCHS, -(-LEAST_STEPS * 32 // max(len(order), 1)))):
        for lo in range(0, len(order), 32):
            rows = order[lo : lo + 32]
            lengths = [len(features[r]) for r in rows]
            flat = np.concatenate([features[r] for r in rows])
            row = np.repeat(np.arange(len(rows)), lengths)
            value = np.where(flat < 0, VOTE_WEIGHT, 1.0)  # votes are marked by a negative number
            flat = np.where(flat < 0, ~flat, flat)
            p = 1 / (1 + np.exp(-np.clip(np.bincount(row, value * w[flat], minlength=len(rows)) + bias, -30, 30)))
            error = p - labels[rows]
            at, where = np.unique(flat, return_inverse=True)
            g = np.bincount(where, value * error[row], minlength=len(at)) + SHRINK * w[at]
            seen[at] += g * g
            w[at] -= STEP * g / np.sqrt(seen[at])
            b = float(error.sum())
            bias_seen += b * b
            bias -= STEP * b / np.sqrt(bias_seen)
    return np.append(w, bias)


def _training_set(docs: DataFrame, models, learned: tuple) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, buf, offs in C.text_chunks(b.column("text")):
                votes, doc, at = votes_and_features(buf, offs, learned)
                soft = [models[t].posterior(votes[:, _COLUMNS[t]].astype(np.int64)) for t in TARGETS]
                bounds, extra = C.per_text(doc, hi - lo), _vote_features(votes)
                feats = [np.concatenate([at[bounds[i] : bounds[i + 1]], ~extra[i]]) for i in range(hi - lo)]
                yield pa.RecordBatch.from_arrays(
                    [b.column("h").slice(lo, hi - lo), *(pa.array(x) for x in soft),
                     pa.array([f.astype("<i4").tobytes() for f in feats], pa.binary())],
                    names=["h", *TARGETS, "features"],
                )

    return docs.select("h", "text").mapInArrow(run, "h long, junk double, toxic double, features binary")


def fit_scorer(docs: DataFrame, models: dict[str, LabelModel], learned: tuple, rows: int = TRAINING_ROWS) -> dict[str, np.ndarray]:
    """One weight vector per target, fitted on at most about ``rows`` documents; all documents if there are fewer."""
    total = docs.count()
    if not total:
        return {t: np.zeros((1 << FEATURE_BITS) + 1) for t in TARGETS}
    share = min(1.0, rows / total)
    hashed = docs.select(F.xxhash64(F.lit(41), "text", "key").alias("h"), "text")
    sample = hashed.filter(F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53)) < F.lit(share)) if share < 1 else hashed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in b.to_pylist()]
        if not rows:
            return
        rows.sort(key=lambda r: (r["h"], r["features"]))
        features = [np.frombuffer(r["features"], "<i4") for r in rows]
        weights = [train(np.array([r[t] for r in rows]), features) for t in TARGETS]
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(TARGETS)), pa.array([w.astype("<f4").tobytes() for w in weights], pa.binary())], names=["target", "w"]
        )

    # the bounded sample, reduced to features, is fitted in one task
    fitted = _training_set(sample, models, learned).repartition(1).mapInArrow(run, "target string, w binary").collect()
    return {r["target"]: np.frombuffer(bytes(r["w"]), "<f4").astype(np.float64) for r in fitted}


def scored(
    docs: DataFrame, labels: DataFrame | None = None, *, key: str = "doc_id", text: str = "text", training_rows: int = TRAINING_ROWS
) -> DataFrame:
    """(key, junk, toxic, quality, rejected) of every document. labels (doc_id, toxic) may be left out.

    junk and toxic are the scorer's chances that the document is bad; quality is one minus the larger; a
    document is rejected if quality is below one half. Null and empty texts have no features or votes and get the
    scorer's base chances; repeated rows each get the same scores; an empty table gives an empty result; other
    columns are ignored.
    """
    rows = C.rows_of(docs, key=key, text=text)
    return _score(rows, labels, "key long, junk double, toxic double", ["key"], training_rows).select(
        F.col("key").alias(key), "junk", "toxic", quality().alias("quality"), (quality() < 0.5).alias("rejected")
    )


def quality() -> Column:
    return 1 - F.greatest("junk", "toxic")


def _score(
    rows: DataFrame, labels: DataFrame | None, schema: str, carried: list[str], training_rows: int,
    text_in: Callable[[pa.RecordBatch], pa.Array] | None = None,
) -> DataFrame:
    """``text_in`` finds the texts in the carried columns; without it they are sent beside them."""
    spark = rows.sparkSession
    C.small_batches(spark)
    learned = learn_words(rows, labels)
    models = fit_label_models(rows, learned)
    weights = fit_scorer(rows, models, learned, training_rows)
    shared = spark.sparkContext.broadcast({t: w.astype(np.float32) for t, w in weights.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            chance = {t: np.zeros(len(b)) for t in TARGETS}
            for lo, hi, buf, offs in C.text_chunks(text_in(b) if text_in else b.column("text")):
                votes, doc, at = votes_and_features(buf, offs, learned)
                extra = _vote_features(votes)
                for t, w in shared.value.items():
                    total = np.bincount(doc, w[at], minlength=hi - lo) + VOTE_WEIGHT * w[extra].sum(axis=1) + w[-1]
                    chance[t][lo:hi] = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in carried), *(pa.array(chance[t]) for t in TARGETS)], names=[*carried, *TARGETS]
            )

    return (rows.select(*carried) if text_in else rows).mapInArrow(run, schema)


def good_documents(
    docs: DataFrame, labels: DataFrame | None = None, *, text: str = "text", training_rows: int = TRAINING_ROWS
) -> DataFrame:
    """The documents that are not rejected, with all their columns; decided in the pass that reads the texts."""
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("key"), C.whole_text(text).alias("text"), F.struct(*docs.columns).alias("row")
    )
    C.importable(docs.sparkSession)
    kind = rows.schema["row"].dataType.simpleString()
    whole = docs.schema[text].dataType.simpleString() == "string"

    def text_in(b: pa.RecordBatch) -> pa.Array:
        return pc.fill_null(b.column("row").field(text), "")

    out = _score(rows, labels, f"row {kind}, junk double, toxic double", ["row"], training_rows, text_in if whole else None)
    return out.filter(quality() >= 0.5).select("row.*")
