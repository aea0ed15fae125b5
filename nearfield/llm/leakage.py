"""Evaluation texts that leak into training text, whole or in part.

A passage leaks an item if it holds a run of at least 14 words of the item in which at most one word in
seven was changed, dropped or added.

1. *Item-sized windows.*  Items are covered by windows of the largest size of ``SIZES`` that fits into them,
   and, as only a part may have leaked, by the smaller sizes as well.  Every window of these sizes, of items
   and documents, gets a 64-bit SimHash of its words.
2. *Multi-index Hamming blocks.*  The fingerprint is cut into ``RADIUS + 1`` blocks; two fingerprints within
   the radius agree on one block at least, so looking up each block finds *all* of them.
3. *Weighted shingles.*  A pair of windows is kept if the shingles of four words that the document's window
   shares with the item's hold at least ``LEAST_SHARE`` of the latter's weight (rarer among the items,
   heavier, between 1 and 2).  Fourteen words with two edits keep at least 3 of 11 shingles, hence 3 / 19.
4. *Exact check.*  From the words that stand unchanged in both windows the run is followed in both
   directions, with up to three edits, and accepted if it is what the definition demands.

A word changed in fourteen moves a SimHash by some eight bits, two in fourteen by eleven, so no radius that
blocks can guarantee reaches every passage.  A *second pass* therefore looks for equal windows of four words,
for documents and items that the first has not linked: with e edits a run of n >= max(14, 7 e) words keeps
(n - e) / (e + 1) >= 4 words in one piece for the shortest runs, and every longer run contains a short one
(n < 28) of no worse rate.  ``window_words`` tells for each row which size has found it.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.operators.skew import spread
from nearfield.storage import Workspace

#: Sizes of windows, largest first, and the size of the second pass.
SIZES = (112, 56, 28, 14)
WINDOW = 4
RADIUS = 3
LEAST_SHARE = 0.15
LEAST_WORDS = 14
WORDS_PER_EDIT = 7
MAX_EDITS = 3
#: Words of items that one pass holds in memory; more items take more passes.
ITEM_WORDS_PER_PASS = 1_000_000
#: Windows fingerprinted at once, and words of documents that are looked at together.
CHUNK = 8_192
GROUP_WORDS = 200_000
_CACHE_WORDS = 150_000

#: Tags that stand within a word or between words without parting them (fixed values).
_INLINE = "a abbr b big code em font i mark s small span strong sub sup tt u".split()
_TAG_INLINE = re.compile(rf"</?(?:{'|'.join(_INLINE)})(?:\s[^<>]*)?/?>", re.I)
_TAG = re.compile(r"</?[a-zA-Z!][^<>]*>")
_BROKEN = re.compile(r"(?<=[^\W\d_])[-‐‑]\s*\n[\s>|*#]*(?=[^\W\d_])")
_UNSEEN = re.compile("[­​-‏‪-‮⁠-⁤﻿]")
_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """Words without case, punctuation, markup, typesetting and line breaks; none for null or blank."""
    if not text:
        return []
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", _TAG_INLINE.sub("", text))
    if not text.isascii():
        text = _UNSEEN.sub("", text)
        text = unicodedata.normalize("NFKD", text)
        text = "".join(c for c in text if not unicodedata.combining(c))
    if "\n" in text:
        text = _BROKEN.sub("", text)
    return _WORD.findall(text.lower())


class _Vectors:
    """64 small numbers for every word, fixed by its letters; a bounded cache."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.rows = np.zeros((1024, 64), dtype="int8")

    def ids(self, tokens: list[str]) -> np.ndarray:
        if len(self.number) > _CACHE_WORDS:  # words come anew; numbers are only used until the next call
            self.__init__()
        number = self.number
        fresh = [w for w in dict.fromkeys(tokens) if w not in number]
        if fresh:
            k, n = len(number), len(number) + len(fresh)
            if n > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros((max(n, 2 * len(self.rows)) - len(self.rows), 64), dtype="int8")])
            digests = b"".join([blake2b(w.encode("utf-8", "replace"), digest_size=64).digest() for w in fresh])
            self.rows[k:n] = np.frombuffer(digests, dtype="int8").reshape(-1, 64)
            number.update(zip(fresh, range(k, n)))
        return np.fromiter(map(number.__getitem__, tokens), dtype="int64", count=len(tokens))


class Prints:
    """SimHash of every window of any size up to ``SIZES[0]`` over a run of word numbers."""

    def __init__(self, ids: np.ndarray, vectors: _Vectors):
        # sums up to each word, modulo 2^16: differences of up to 258 words fit
        self.sums = np.zeros((len(ids) + 1, 64), dtype="int16")
        np.cumsum(vectors.rows[ids], axis=0, dtype="int16", out=self.sums[1:])

    def of(self, size: int, most: int | None = None) -> np.ndarray:
        n = max(0, len(self.sums) - size)
        n = n if most is None else min(n, most)
        total = self.sums[size : size + n] - self.sums[:n]
        return np.packbits(total > 0, axis=1, bitorder="little").view("uint64")[:, 0] if n else np.zeros(0, dtype="uint64")


def fingerprints(tokens: list[str], vectors: _Vectors, size: int = WINDOW) -> np.ndarray:
    """SimHash of every window of ``size`` words of a text."""
    return Prints(vectors.ids(tokens), vectors).of(size)


def _reach(a: list[str], i: int, b: list[str], j: int, step: int) -> list[int]:
    """Words of ``a`` from i on (in direction ``step``) that can be read along ``b`` from j with 0, 1, .. edits.

    The furthest-reaching method: for each number of edits and each diagonal the furthest point is kept.
    Only points where the last word agrees count, so that a run ends on a word of its own.
    """
    la = len(a) - i if step > 0 else i + 1
    lb = len(b) - j if step > 0 else j + 1
    la, lb = max(la, 0), max(lb, 0)
    best = [0] * (MAX_EDITS + 1)
    front = {}
    for e in range(MAX_EDITS + 1):
        nxt: dict[int, int] = {}
        if e == 0:
            nxt[0] = 0
        else:
            for d, x in front.items():  # d: words of b read minus words of a read
                if x < la and x + d < lb:
                    nxt[d] = max(nxt.get(d, -1), x + 1)  # changed
                if x < la:
                    nxt[d - 1] = max(nxt.get(d - 1, -1), x + 1)  # dropped
                if x + d < lb:
                    nxt[d + 1] = max(nxt.get(d + 1, -1), x)  # added
        far = best[e - 1] if e else 0
        for d, x in nxt.items():
            start = x
            while x < la and x + d < lb and a[i + step * x] == b[j + step * (x + d)]:
                x += 1
            nxt[d] = x
            if x > start and x > far:
                far = x
        best[e] = far
        front = nxt
    return best


def run_from_seed(item: list[str], i: int, doc: list[str], j: int) -> tuple[int, int] | None:
    """(words, edits) of a run through the seed item[i:i+WINDOW] ~ doc[j:j+WINDOW] that the definition accepts, or None."""
    same = [k for k in range(WINDOW) if item[i + k] == doc[j + k]]
    if len(same) < WINDOW:
        return None
    right = _reach(item, i + WINDOW, doc, j + WINDOW, 1)
    left = _reach(item, i - 1, doc, j - 1, -1)
    for edits in range(MAX_EDITS + 1):
        n = WINDOW + max(left[x] + right[edits - x] for x in range(edits + 1))
        if n >= max(LEAST_WORDS, WORDS_PER_EDIT * edits):
            return n, edits
    return None


class HammingBlocks:
    """Multi-index blocks over fingerprints: all that lie within ``radius`` of a probe."""

    def __init__(self, prints: np.ndarray, radius: int = RADIUS):
        self.prints, self.radius = prints, radius
        self.blocks = []
        for b in range(radius + 1 if radius else 1):  # for radius 0 any one block will do
            key = self._keys(prints)[:, b]
            order = np.argsort(key, kind="stable")
            starts = np.searchsorted(key[order], np.arange((1 << 16) + 1))
            self.blocks.append((order, starts[:-1], np.diff(starts)))

    @staticmethod
    def _keys(prints: np.ndarray) -> np.ndarray:
        """The four blocks of 16 bits of each fingerprint."""
        return np.ascontiguousarray(prints).view("<u2").reshape(-1, 4)

    def within(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(probe, fingerprint) of all pairs within the radius."""
        keys, found = self._keys(prints), []
        for b, (order, starts, counts) in enumerate(self.blocks):
            n = counts[keys[:, b]]
            hit = np.flatnonzero(n)
            n = n[hit]
            query = np.repeat(hit, n)
            offset = np.arange(len(query)) - np.repeat(np.cumsum(n) - n, n)
            window = order[np.repeat(starts[keys[hit, b]], n) + offset]
            near = np.bitwise_count(prints[query] ^ self.prints[window]) <= self.radius
            found.append(query[near] * len(self.prints) + window[near])
        pairs = np.unique(np.concatenate(found)) if len(self.prints) else np.zeros(0, dtype="int64")
        return pairs // max(1, len(self.prints)), pairs % max(1, len(self.prints))


assert RADIUS == 3  # four blocks of 16 bits


class ItemIndex:
    """The windows of the items, for each size."""

    def __init__(self, items: list[tuple[int, list[str]]]):
        self.items = [(i, w) for i, w in items if len(w) >= LEAST_WORDS]
        vectors = _Vectors()
        runs = [Prints(vectors.ids(w), vectors) for _, w in self.items]
        self.sizes: dict[int, tuple[HammingBlocks, np.ndarray, np.ndarray]] = {}
        for size in (*SIZES, WINDOW):
            prints = [r.of(size) for r in runs]
            if sum(map(len, prints)):
                owner = np.repeat(np.arange(len(prints)), [len(p) for p in prints])
                at = np.concatenate([np.arange(len(p)) for p in prints])
                self.sizes[size] = HammingBlocks(np.concatenate(prints), RADIUS if size > WINDOW else 0), owner, at
        seen = Counter(s for _, w in self.items for s in _shingles(w))
        scale = math.log(max(2, len(self.items)))
        self.weight = {s: 2 - math.log(c) / scale for s, c in seen.items()}

    def share(self, item: list[str], doc: list[str]) -> float:
        """Weight of the item's shingles that the document has, of all the item's."""
        own = _shingles(item)
        there = own & _shingles(doc)
        return sum(self.weight[s] for s in there) / sum(self.weight[s] for s in own)

    def _check(self, item: list[str], i: int, doc: list[str], j: int, size: int) -> tuple[int, int] | None:
        """The accepted run through two near windows: weighted shingles first, then the words that both share."""
        if self.share(item[i : i + size], doc[j : j + size]) < LEAST_SHARE:
            return None
        for shift in sorted(range(-MAX_EDITS, MAX_EDITS + 1), key=abs):
            open_ = False
            for k in range(max(0, -j - shift), size - WINDOW + 1):
                same = item[i + k : i + k + WINDOW] == doc[j + k + shift : j + k + shift + WINDOW]
                if same and not open_ and (run := run_from_seed(item, i + k, doc, j + k + shift)):
                    return run
                open_ = same
        return None

    def leaks(self, docs: list[list[str]], vectors: _Vectors) -> list[tuple]:
        """(number of the document, item id, words, edits, share, window, distance) of every item that a document leaks."""
        starts = np.concatenate([[0], np.cumsum([len(t) for t in docs])]).astype("int64")
        joined = vectors.ids([w for t in docs for w in t])
        ends = np.repeat(starts[1:], np.diff(starts))  # where each word's document ends
        out: dict[tuple[int, int], tuple] = {}
        pairs: dict[int, list] = {size: [] for size in self.sizes}
        for at in range(0, len(joined), CHUNK):
            prints = Prints(joined[at : at + CHUNK + SIZES[0] - 1], vectors)
            for size, (blocks, _, _) in self.sizes.items():
                own = prints.of(size, CHUNK)
                whole = np.flatnonzero(np.arange(at, at + len(own)) + size <= ends[at : at + len(own)])
                own = own[whole]
                q, w = blocks.within(own)
                if len(q):
                    pairs[size].append((whole[q] + at, w, np.bitwise_count(own[q] ^ blocks.prints[w])))
        for size, found in pairs.items():  # from the largest windows to the second pass
            _, owner, place = self.sizes[size]
            walked: set[tuple[int, int, int]] = set()
            for position, w, distance in found:
                number = np.searchsorted(starts, position, "right") - 1
                for d, j, o, i, apart in zip(number.tolist(), (position - starts[number]).tolist(), owner[w].tolist(), place[w].tolist(), distance.tolist()):
                    if (d, o) in out:
                        continue
                    item_id, item = self.items[o]
                    if size > WINDOW:
                        run = self._check(item, i, docs[d], j, size)
                    else:
                        if item[i : i + WINDOW] != docs[d][j : j + WINDOW]:
                            continue
                        # an unbroken run is walked from its first window only
                        run = None if (d, o, j - i) in walked and item[i - 1 : i] == docs[d][j - 1 : j] != [] else run_from_seed(item, i, docs[d], j)
                        walked.add((d, o, j - i))
                    if run:
                        out[d, o] = (d, item_id, *run, self.share(item, docs[d]), size, apart)
        return list(out.values())


def _shingles(tokens: list[str]) -> set[tuple[str, ...]]:
    return {tuple(tokens[k : k + WINDOW]) for k in range(len(tokens) - WINDOW + 1)}


LEAK = "doc_id bigint, item_id bigint, run_words int, edits int, shingle_share double, window_words int, distance int"


def _passes(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items in lots of at most ``ITEM_WORDS_PER_PASS`` words (one item more at most)."""
    lot, size = [], 0
    for row in items.where("item_id is not null and text is not null").select("item_id", "text").toLocalIterator():
        lot.append((row["item_id"], row["text"]))
        size += len(row["text"]) // 5
        if size >= ITEM_WORDS_PER_PASS:
            yield lot
            lot, size = [], 0
    if lot:
        yield lot


def _groups(batch: pd.DataFrame) -> Iterator[tuple[list[int], list[list[str]]]]:
    """Documents that are looked at together: up to ``GROUP_WORDS`` words, or one longer document."""
    ids: list[int] = []
    docs: list[list[str]] = []
    size = 0
    for doc, text in zip(batch["doc_id"], batch["text"]):
        tokens = words(text)
        if len(tokens) < LEAST_WORDS - MAX_EDITS:
            continue
        ids.append(doc)
        docs.append(tokens)
        size += len(tokens)
        if size >= GROUP_WORDS:
            yield ids, docs
            ids, docs, size = [], [], 0
    if docs:
        yield ids, docs


def find_leaks(documents: DataFrame, items: DataFrame, workspace: Workspace | None = None) -> DataFrame:
    """``doc_id, item_id, run_words, edits, shingle_share, window_words, distance``: every document with every item that it leaks.

    ``window_words`` and ``distance`` are the size of the windows that led to the pair and the Hamming
    distance of their fingerprints; ``shingle_share`` is that of the whole item and the whole document.
    Whole texts are read.  Null and blank texts leak nothing; items shorter than 14 words can't be leaked;
    items with the same wording under several numbers are all reported; repeated document rows are
    reported once.  The corpus is read once for every ``ITEM_WORDS_PER_PASS`` words of items; the items of
    one pass are broadcast, and released before the next.
    """
    spark = documents.sparkSession
    workspace = workspace or Workspace(spark, "leaks")
    texts = spread(documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), "doc_id")
    result = spark.createDataFrame([], LEAK)
    names = [c.split()[0] for c in LEAK.split(", ")]
    kinds = {n: {"bigint": "int64", "int": "int32", "double": "float64"}[c.split()[1]] for n, c in zip(names, LEAK.split(", "))}
    for lot in _passes(items):
        shared = spark.sparkContext.broadcast(lot)  # at most ITEM_WORDS_PER_PASS words

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            index = ItemIndex([(i, words(t)) for i, t in shared.value])
            vectors = _Vectors()
            for batch in batches:
                for ids, docs in _groups(batch):
                    rows = [(ids[d], *leak) for d, *leak in index.leaks(docs, vectors)]
                    yield pd.DataFrame(rows, columns=names).astype(kinds)

        result = result.unionByName(workspace.save(texts.mapInPandas(run, LEAK), "leaks"))
        shared.unpersist()
    return result.dropDuplicates(["doc_id", "item_id"])
