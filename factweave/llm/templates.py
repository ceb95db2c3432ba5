"""Main text of web pages by equivalence-class template deduction.

Tags and words of a page are tokens, told apart by the elements around them. Tokens of a host that occur equally
often on each of its pages have the same occurrence vector and form an equivalence class, if enough pages hold them; the vector is
kept as a hash that adds up over pages in any order, so a host of any size is summed in many tasks. Tokens are shuffled as hashes,
those of one vector, such as the words that stand once on one page, in one row. On a page a class
is valid if its tokens come in one fixed order as often as they occur, and each round of them lies in one slot of
the class that holds it. Valid classes make the template; the text between them is in its slots. The main text
is what stands in the slots of the article, without elements of other roles.
"""

from __future__ import annotations

import html as html_
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from . import common as C

MIN_PAGES = 5  # hosts with fewer pages have no template of their own
LAYOUT = 10  # a layout is on one of so many pages of its host at least
BUCKETS = 16  # of the tokens of a host, by their low bits; each is summed in one task

# fixed names of elements and of words in class, id and role attributes
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr".split()
)
RAW = set("script style noscript template iframe textarea title svg math object xmp".split())
ASIDE = set("nav header footer aside form button select menu dialog head fieldset".split()) | RAW
ASIDE_WORDS = set(
    "ad ads adbox advert adverts advertisement advertisements advertising advertorial banner sponsor sponsored promo promotion "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup paywall nav navbar "
    "navigation menu submenu breadcrumb breadcrumbs sidebar widget related recommended recommendations comment comments commentlist "
    "respond discussion disqus replies reply share sharing social footer header masthead toolbar login search pagination pager "
    "contentinfo complementary".split()
)
CLOSES = {  # an opening tag ends these open elements
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"},
}

_PIECE = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_RAW_ENDS = {name: re.compile(rf"</{name}[^>]*(?:>|\Z)", re.I) for name in RAW}
_NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


class Block(NamedTuple):
    main: bool  # inside an article or main element
    hard: bool  # inside an element of another role by its tag
    soft: bool  # inside an element of another role by its class, id or role
    doubt: bool  # inside an element whose names only hint at another role, or in an article inside a soft one
    tokens: slice  # of its words among the page's tokens
    words: list[str]


def _names(attributes: str) -> int:
    """2 if a class, id or role is made of words of other roles, 1 if only a part of one is, else 0."""
    found = 0
    for m in _ATTRIBUTE.finditer(attributes):
        for token in (m[2] or m[3] or m[4] or "").split():
            known = [w.lower() in ASIDE_WORDS for w in _NAME_WORD.findall(token)]
            if token.lower() in ASIDE_WORDS or known and all(known):
                return 2
            found |= any(known)
    return int(found)


class _Hashes(dict):
    """Hashes of the tokens that a worker has met lately under one path of elements."""

    def __init__(self, names: tuple[str, ...]):
        self.names, self.path = names, "/".join(names)
        self.inner: dict[str, _Hashes] = {}  # by the name of an element inside it

    def __missing__(self, word: str) -> int:
        if _Hashes.held > 200_000:
            for known in _KNOWN.values():
                known.clear()
            _Hashes.held = 0
        _Hashes.held += 1
        got = self[word] = xxhash.xxh64_intdigest(f"{self.path} {word}") - (1 << 63)
        return got

    held = 0


_KNOWN: dict[tuple[str, ...], _Hashes] = {}


def _hashes(names: tuple[str, ...]) -> _Hashes:
    got = _KNOWN.get(names)
    if got is None:
        if len(_KNOWN) > 20_000:
            for known in _KNOWN.values():
                known.inner.clear()
            _KNOWN.clear()
            _Hashes.held = 0
        got = _KNOWN[names] = _Hashes(names)
    return got


def parse(page: str) -> tuple[list[int], list[Block]]:
    """Hashes of all tokens of a page in order, and its blocks of text. Malformed and cut off pages are read as far as they go."""
    tokens: list[int] = []
    blocks: list[Block] = []
    stack: list[tuple[str, bool, bool, bool, bool]] = []  # name, main, hard, soft, doubt
    here = [_hashes(())]  # of the path to each open element, by the last three names
    pending: list[str] = []

    def state() -> tuple[bool, bool, bool, bool]:
        return stack[-1][1:] if stack else (False, False, False, False)

    def text_ends() -> None:
        # words are split after all inline pieces are joined, as a word may go on over an inline tag
        text = "".join(pending) if len(pending) > 1 else pending[0] if pending else ""
        pending.clear()
        words = (html_.unescape(text) if "&" in text else text).split()
        if words:
            first = len(tokens)
            tokens.extend(map(here[-1].__getitem__, words))
            blocks.append(Block(*state(), slice(first, len(tokens)), words))

    def pop_to(depth: int) -> None:
        path = here[-1]
        for i in range(len(stack) - 1, depth - 1, -1):
            tokens.append(path[f"</{stack[i][0]}>"])
        del stack[depth:], here[depth + 1 :]

    at, end, search = 0, len(page), _PIECE.search
    while at < end:
        m = search(page, at)
        if m is None:
            pending.append(page[at:])
            break
        begins, ends = m.span()
        if begins > at:
            pending.append(page[at:begins])
        at = ends
        closing, name, attributes, cut, cut_name, rest = m.groups()
        if not name:
            closing, name, attributes = cut, cut_name, rest
        if not name:
            continue
        name = name.lower()
        if name in INLINE:
            if name == "br":
                pending.append(" ")
            continue
        if pending:
            text_ends()
        if closing:
            depth = len(stack) - 1 if stack and stack[-1][0] == name else next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if depth is not None:
                pop_to(depth)
            continue
        if name in RAW:
            tokens.append(here[-1][f"<{name}>"])
            stop = _RAW_ENDS[name].search(page, at)
            at = stop.end() if stop else end
            continue
        if name not in VOID:
            while stack and (stack[-1][0] == "p" or stack[-1][0] in CLOSES.get(name, ())):
                pop_to(len(stack) - 1)
        tokens.append(here[-1][f"<{name}>"])
        if name not in VOID and not attributes.endswith("/"):
            main, hard, soft, doubt = state()
            if name in ("article", "main"):
                if not main:  # what the elements around an article are called does not decide about it
                    main, soft, doubt = True, False, soft or doubt
            elif name not in ("html", "body"):
                sure = _names(attributes) if attributes else 0
                soft, doubt = soft or sure == 2, doubt or sure == 1
            stack.append((name, main, hard or name in ASIDE, soft, doubt))
            inner = here[-1].inner.get(name)
            if inner is None:
                inner = here[-1].inner[name] = _hashes((*here[-1].names[-2:], name))
            here.append(inner)
    text_ends()
    return tokens, blocks


# ---------------------------------------------------------------- equivalence classes of a host


def _vectors(pages: DataFrame) -> DataFrame:
    """(host, bucket, n_pages, vector, tokens) summed over runs of pages; a null token counts the pages that hold any.

    Tokens of a host and bucket with the same number of pages and the same vector share a row.
    """

    def starts(*columns: np.ndarray) -> np.ndarray:
        new = np.ones(len(columns[0]), bool)
        new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in columns])
        return np.flatnonzero(new)

    def flush(hosts: list[str], parts: list[tuple]) -> pa.RecordBatch:
        own, token, vector = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((token, own))
        own, token = own[order], token[order]
        at = starts(own, token)
        n, vector = np.diff(np.append(at, len(own))), np.bitwise_xor.reduceat(vector[order], at)
        own, token = own[at], token[at]
        bucket = (token & (BUCKETS - 1)).astype(np.int32)
        order = np.lexsort((token, vector, n, bucket, own))
        own, token, vector, n, bucket = (x[order] for x in (own, token, vector, n, bucket))
        at = starts(own, bucket, n, vector)
        pages = np.bincount([p[0][0] for p in parts], minlength=len(hosts))
        k = len(hosts)
        ends = np.concatenate((at, len(token) + np.arange(k + 1)))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([hosts[i] for i in own[at].tolist()] + hosts, pa.string()),
                pa.array(np.concatenate((bucket[at], np.zeros(k, np.int32)))), pa.array(np.concatenate((n[at], pages)), pa.int64()),
                pa.array(np.concatenate((vector[at], np.zeros(k, np.int64)))),
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.concat_arrays([pa.array(token, pa.int64()), pa.nulls(k, pa.int64())])),
            ],
            names=["host", "bucket", "n_pages", "vector", "tokens"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[str, int] = {}
        parts: list[tuple] = []
        held = 0
        for b in batches:
            for uid, host, page in zip(b.column("uid").to_pylist(), b.column("host").to_pylist(), b.column("html")):
                tokens = parse(page.as_py())[0]
                if not tokens:
                    continue
                t, n = np.unique(np.array(tokens, np.int64), return_counts=True)
                v = C.mix(C.mix(np.full(1, uid, C.U64)) + n.astype(C.U64)).view(np.int64)
                parts.append((np.full(len(t), number.setdefault(host, len(number)), np.int32), t, v))
                held += len(t)
                if held > 1_000_000:
                    yield flush(list(number), parts)
                    number, parts, held = {}, [], 0
        if parts:
            yield flush(list(number), parts)

    return pages.select("uid", "host", "html").mapInArrow(
        run, "host string, bucket int, n_pages long, vector long, tokens array<long>")


def host_templates(pages: DataFrame) -> DataFrame:
    """(host, classes): per host its tokens in classes of equal occurrence vectors.

    Pages without tokens are no pages of a host. A class stands on at least MIN_PAGES pages and a tenth of its host's: pages
    that are cut off or laid out in another way have classes of their own and leave those of the others alone.
    """
    # rows of many tokens are shuffled; a token is in one bucket, so its sums need no second shuffle
    packed = _vectors(pages).repartition("host", "bucket")
    tokens = C.materialise(
        packed.select("host", "bucket", "n_pages", "vector", F.explode("tokens").alias("token")).groupBy("host", "bucket", "token").agg(
            F.sum("n_pages").alias("n"), F.bit_xor("vector").alias("vector")
        ).filter(F.col("n") >= MIN_PAGES).drop("bucket"), "host_tokens",
    )
    sizes = tokens.filter(F.col("token").isNull()).select("host", F.col("n").alias("size"))
    frequent = tokens.filter(F.col("token").isNotNull()).join(sizes, "host").filter(F.col("n") * LAYOUT >= F.col("size"))
    classes = frequent.groupBy("host", "vector").agg(F.array_sort(F.collect_list("token")).alias("members"))
    return classes.filter(F.size("members") > 1).groupBy("host").agg(F.collect_list("members").alias("classes"))


def owners(classes: list[list[int]]) -> dict[int, int]:
    """The number of the class that a token is in."""
    return {t: c for c, members in enumerate(classes) for t in members}


def template_places(tokens: list[int], classes: list[list[int]], owner: dict[int, int] | None = None) -> np.ndarray:
    """Places on a page that the valid classes take, outer classes first."""
    owner = owners(classes) if owner is None else owner
    seen: dict[int, list[int]] = defaultdict(list)
    for i, t in enumerate(tokens):
        if t in owner:
            seen[owner[t]].append(i)
    taken = np.zeros(len(tokens), bool)
    outer = np.zeros(0, np.int64)
    rounds = {c: len(places) // len(classes[c]) for c, places in seen.items()}
    for c in sorted(seen, key=lambda c: (rounds[c], seen[c][0])):
        places, size = np.array(seen[c]), len(classes[c])
        order = [tokens[i] for i in seen[c][:size]]
        fits = len(set(order)) == size and [tokens[i] for i in seen[c]] == order * rounds[c]
        if fits and rounds[c] > 1:
            slot = np.searchsorted(outer, places).reshape(rounds[c], size)
            fits = bool((slot == slot[:, :1]).all())
        if fits:
            taken[places] = True
            outer = np.sort(np.concatenate([outer, places]))
    return taken


def _chosen(blocks: list[Block]) -> list[Block]:
    """Blocks of the article, or of the page if there is none. Doubtful ones count if three quarters of the text are in them."""

    def size(some: list[Block]) -> int:
        return sum(len(b.words) for b in some)

    open_ = [b for b in blocks if not b.hard and not b.soft]
    every = [b for b in open_ if b.main]
    clear = [b for b in every if not b.doubt]
    if not clear:
        outside = [b for b in open_ if not b.main and not b.doubt]
        if size(outside) >= size(every):
            every, clear = open_ if not every else outside, outside
    own = clear if 4 * size(clear) >= size(every) else every
    # a page that is all inside elements of such names still has its text
    return own or [b for b in blocks if not b.hard]


def main_text(page: str, classes: list[list[int]] | None, owner: dict[int, int] | None = None) -> list[str]:
    """Blocks of the main text of one page."""
    tokens, blocks = parse(page)
    own = _chosen(blocks)
    if classes:
        taken = template_places(tokens, classes, owner)
        slots = [b for b in own if not taken[b.tokens].all()]
        own = slots or own  # a host of copies of one page is all template; its article is still its article
    return [" ".join(b.words) for b in own]


def extract(pages: DataFrame, *, key: str = "page_id") -> DataFrame:
    """(page_id, url, text) of every page: blocks joined by one newline, the empty string if there are none.

    Null html is empty; null urls are one host of their own; pages of any length are read whole; repeated rows each
    get a row; an empty table gives an empty result; other columns are ignored.
    """
    C.importable(pages.sparkSession)
    rows = pages.select(
        F.col(key).alias("key"), F.col("url").cast("string").alias("url"), C.whole_text("html").alias("html"),
        F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)).alias("host"),
    )
    templates = C.materialise(host_templates(rows.withColumn("uid", F.monotonically_increasing_id())), "host_templates")
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple] = {}  # classes of the hosts met lately
        for b in batches:
            for lo in range(0, len(b), 512):
                part = b.slice(lo, 512)
                texts = []
                for host, page, classes in zip(part.column("host").to_pylist(), part.column("html").to_pylist(), part.column("classes")):
                    if host not in known:
                        if len(known) >= 64:
                            known.clear()
                        listed = classes.as_py()
                        known[host] = listed, owners(listed or [])
                    texts.append("\n".join(main_text(page, *known[host])))
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), part.column("url"), pa.array(texts, pa.string())], names=["key", "url", "text"]
                )

    joined = rows.join(templates, "host", "left").select("key", "url", "html", "host", "classes")
    return joined.mapInArrow(run, f"key {kind}, url string, text string").withColumnRenamed("key", key)
