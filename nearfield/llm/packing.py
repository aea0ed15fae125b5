"""Texts into containers of fixed capacity: best-fit decreasing with a segment tree.

Sizes are tokens of a public tokenizer.  A text longer than the capacity is cut into full pieces and a
rest; nothing else is divided.  Pieces are dealt to shards so that each shard sees the same mix of sizes
(a hash of the id), packed per shard, and the containers that a shard left loosely filled are taken
apart and packed again together with those of other shards, so that the waste does not grow with the
number of shards.  Within a shard the tightest open container that still takes a piece is found in a
segment tree over remaining capacities, in logarithmic time.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.operators.skew import spread
from nearfield.storage import Workspace

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pattern of the byte-level BPE tokenizer above (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces that one shard packs.
SHARD_PIECES = 100_000
#: A container filled less than this goes to the second round.
LOOSE = 0.97

_ENCODERS: dict = {}


def _encoder(path: str):
    if path not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _ENCODERS[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


#: Between these two characters a new word of the pattern begins whatever stands around them.
_BOUNDARY = re.compile(r"[A-Za-z0-9](?=[ \n])")


def count_tokens(text: str, path: str = TOKENIZER, block: int = 100_000) -> int:
    """Tokens of a whole text; unencodable characters are replaced.

    Long texts are encoded in blocks of ``block`` characters and what follows up to the end of a word before a blank, which changes no token; a run without such a place is encoded in one piece, however long.
    """
    enc = _encoder(path)
    text = text.encode("utf-8", "replace").decode("utf-8")
    total, at = 0, 0
    while at < len(text):
        cut = _BOUNDARY.search(text, at + block) if at + block < len(text) else None
        end = cut.end() if cut else len(text)
        total += len(enc.encode_ordinary(text[at:end]))
        at = end
    return total


def token_counts(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """``doc_id, n_tokens``: whole texts; null and blank texts have no size and are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_tokens": np.array([count_tokens(t, path) for t in b["text"]], dtype="int64")})

    texts = documents.where(F.col("doc_id").isNotNull() & F.col("text").rlike(r"\S")).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return spread(texts, "doc_id").mapInPandas(run, "doc_id bigint, n_tokens bigint")


class TightestFit:
    """Segment tree over remaining capacities 0..C: which remains have an open container.

    Leaf r counts the open containers with remaining capacity r; ``take(size)`` finds the smallest
    r >= size that has one.
    """

    def __init__(self, capacity: int):
        self.n = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.n)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, container: int, remaining: int) -> None:
        if remaining <= 0:
            return
        self.open[remaining].append(container)
        i = remaining + self.n
        while i:
            self.tree[i] += 1
            i >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """(container, remaining before) of the tightest container that takes ``size``, removed from the tree."""
        i = size + self.n
        if not self.tree[i]:
            while i > 1 and (i & 1 or not self.tree[i + 1]):  # up, until a right sibling holds something
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.n:
                i = 2 * i if self.tree[2 * i] else 2 * i + 1
        remaining = i - self.n
        container = self.open[remaining].pop()
        while i:
            self.tree[i] -= 1
            i >>= 1
        return container, remaining


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of each piece; every size is in 1..capacity.  Equal sizes go in their given order."""
    order = np.argsort(-sizes, kind="stable")
    where = np.empty(len(sizes), dtype="int64")
    tree, count = TightestFit(capacity), 0
    for k in order:
        size = int(sizes[k])
        fit = tree.take(size)
        if fit is None:
            container, remaining = count, capacity
            count += 1
        else:
            container, remaining = fit
        where[k] = container
        tree.add(container, remaining - size)
    return where


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["doc_id", "piece"], kind="stable", ignore_index=True)
    capacity = int(pdf["capacity"].iloc[0])
    sizes = pdf["n_tokens"].to_numpy()
    where = best_fit_decreasing(sizes, capacity)
    fill = np.bincount(where, weights=sizes).astype("int64")
    return pdf.assign(container=where, fill=fill[where])


PIECE = "window_name string, capacity bigint, doc_id bigint, piece int, start bigint, n_tokens bigint"


def pieces(counts: DataFrame, windows: DataFrame) -> DataFrame:
    """Every text once per capacity, cut only if it is longer.

    ``windows`` is a fixed table of a handful of capacities; more than 1000 raise ``ValueError``.  Null and
    non-positive capacities are left out.
    """
    caps = windows.where("capacity_tokens > 0").select("window_name", F.col("capacity_tokens").cast("bigint").alias("capacity")).distinct()
    if len(caps.take(1001)) > 1000:
        raise ValueError("more than 1000 capacities")
    cut = counts.where("n_tokens > 0").crossJoin(F.broadcast(caps))  # at most 1000 rows, checked
    full = F.explode(F.sequence(F.lit(0), F.floor((F.col("n_tokens") - 1) / F.col("capacity")).cast("int")))
    cut = cut.withColumn("piece", full).withColumn("start", F.col("piece") * F.col("capacity"))
    return cut.select("window_name", "capacity", "doc_id", "piece", "start", F.least("capacity", F.col("n_tokens") - F.col("start")).alias("n_tokens"))


def pack(counts: DataFrame, windows: DataFrame, workspace: Workspace) -> DataFrame:
    """``window_name, capacity, container_id, doc_id, piece, start, n_tokens``.

    No container holds more than its capacity; every token of every text is in exactly one piece.
    ``counts`` has unique ``doc_id`` (a repeated id is treated as further texts).  No texts: no rows.
    """
    all_pieces = workspace.save(pieces(counts, windows), "pieces")
    total = all_pieces.groupBy("window_name").count().agg(F.max("count")).first()[0] or 0
    shards = max(1, -(-total // SHARD_PIECES))

    def packed(rows: DataFrame, n: int, salt: str) -> DataFrame:
        sharded = rows.withColumn("shard", F.pmod(F.xxhash64(F.lit(salt), "doc_id", "piece"), F.lit(n)))
        tasks = max(n, rows.sparkSession.sparkContext.defaultParallelism)
        sharded = sharded.repartition(tasks, "window_name", "shard")  # a given number is not coalesced: the work is in packing, not in bytes
        return sharded.groupBy("window_name", "shard").applyInPandas(lambda pdf: _pack(pdf), PIECE + ", shard bigint, container bigint, fill bigint")

    first = workspace.save(packed(all_pieces, shards, "first"), "packed")
    tag = F.concat_ws("-", "window_name", F.lit("a"), "shard", "container")
    tight = first.where(F.col("fill") >= LOOSE * F.col("capacity")).withColumn("container_id", tag)
    loose = first.where(F.col("fill") < LOOSE * F.col("capacity")).select("window_name", "capacity", "doc_id", "piece", "start", "n_tokens")
    left = loose.groupBy("window_name").count().agg(F.max("count")).first()[0] or 0
    second = packed(loose, max(1, -(-left // SHARD_PIECES)), "second").withColumn("container_id", F.concat_ws("-", "window_name", F.lit("b"), "shard", "container"))
    columns = ["window_name", "capacity", "container_id", "doc_id", "piece", "start", "n_tokens"]
    return tight.select(columns).unionByName(second.select(columns))


def fill_report(packing: DataFrame) -> DataFrame:
    """One row per capacity: containers, tokens and the share of space used."""
    per = packing.groupBy("window_name", "capacity", "container_id").agg(F.sum("n_tokens").alias("used"))
    return per.groupBy("window_name", "capacity").agg(
        F.count("*").alias("containers"), F.sum("used").alias("tokens"), (F.sum("used") / (F.count("*") * F.col("capacity"))).alias("filled")
    )
