"""All similar pairs between set-valued records: T-occurrence list merging on partitioned inverted lists.

1. Equal sets are folded into one class, so that copies never meet each other here.
2. Elements are ordered from rare to common (exact counts).  Two sets of similarity >= t share an element
   among the first ``n - ceil(t n) + 1`` of each, its *prefix*; every class is routed to each of its prefix
   elements.  The classes of a frequent element are cut into blocks, and the cell (i, j) of the element
   indexes block i and is probed by block j >= i, so that no cell holds more than two blocks.
3. An element that only one class has in its prefix has no pairs and is left out before any set is shipped.
4. Every cell has an index of its own: inverted lists of the elements from the cell's element on, as a pair
   is emitted in the cell of its rarest common element only.  Each probe must find the classes that occur on
   at least T of its lists, where T is the overlap the threshold demands.  The longest lists are set aside;
   the short ones are merged with a heap that skips ahead, and the long ones are only searched by bisection
   for the survivors.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.operators.skew import hot_keys, salted_join
from nearfield.storage import Workspace, metric

#: Classes that one block of a prefix element may index.
BLOCK = 4_000
#: Aimed number of routed rows a bucket.
BUCKET_ROWS = 6_000
#: Records of equal sets that one block holds when pairs of records are written out.
MEMBERS = 2_000
_EPS = 1e-9


def component_sets(df: DataFrame, id_col: str, text_col: str, separator: str = r"\.") -> DataFrame:
    """``id, items``: the distinct trimmed, non-empty parts of a text, sorted; ids with none are left out.

    Rows delivered twice under one id count once: their parts are those of the smallest text.
    """
    one = df.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(text_col).alias("text"))
    parts = F.transform(F.split("text", separator), lambda x: F.regexp_replace(x, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    return one.select("id", F.array_sort(F.array_distinct(F.filter(parts, lambda x: x != ""))).alias("items")).where(F.size("items") > 0)


def _need(n: int, m: int, t: float) -> int:
    """Common elements that sets of n and m must have for a Jaccard similarity of t."""
    return max(1, math.ceil(t / (1 + t) * (n + m) - _EPS))


def merge_skip(lists: list[list[int]], need: int) -> list[tuple[int, int]]:
    """(entry, occurrences) of the entries on at least ``need`` of the sorted lists (DivideSkip).

    The longest lists are left out of the merge and searched by bisection; the others are merged by a
    heap: when the smallest entry is on too few lists, ``need - 1`` heads are popped and each skips to
    the smallest entry that can still reach the threshold.
    """
    lists = sorted((x for x in lists if len(x)), key=len)
    if len(lists) < need:
        return []
    n_long = min(need - 1, int(need / (0.1 * math.log(max(2, len(lists[-1]))) + 1)))
    short, long = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
    want = need - n_long
    out: list[tuple[int, int]] = []

    def finish(entry: int, count: int) -> None:
        for rest, xs in enumerate(long):
            if count + len(long) - rest < need:
                return
            k = bisect_left(xs, entry)
            count += k < len(xs) and xs[k] == entry
        if count >= need:
            out.append((int(entry), int(count)))

    if want == 1 and len(short) == 1:
        for entry in short[0]:
            finish(entry, 1)
        return out
    heap = [(int(xs[0]), i) for i, xs in enumerate(short)]
    heapq.heapify(heap)
    at = [0] * len(short)
    while len(heap) >= want:
        low = heap[0][0]
        popped = []
        while heap and heap[0][0] == low:
            popped.append(heapq.heappop(heap)[1])
        if len(popped) >= want:
            finish(low, len(popped))
            target = low + 1
        else:
            while heap and len(popped) < want - 1:
                popped.append(heapq.heappop(heap)[1])
            if not heap:
                break
            target = heap[0][0]
        for i in popped:
            xs = short[i]
            k = bisect_left(xs, target, at[i])
            at[i] = k
            if k < len(xs):
                heapq.heappush(heap, (int(xs[k]), i))
    return out


def _join_cell(element: int, within: bool, indexed: list[tuple[int, np.ndarray]], probing: list[tuple[int, np.ndarray]], t: float) -> Iterator[tuple[int, int, float]]:
    """``c1, c2, similarity`` of the pairs of one cell whose rarest common element is ``element``; within: both sides are the same block."""
    indexed.sort(key=lambda x: (len(x[1]), x[0]))  # numbers by size, so that a size range is a range of numbers
    sizes = [len(ids) for _, ids in indexed]
    lists: dict[int, list[int]] = {}
    heads = []
    for no, (_, ids) in enumerate(indexed):
        at = int(np.flatnonzero(ids == element)[0])
        heads.append(set(ids[:at].tolist()))
        for r in ids[at:].tolist():
            lists.setdefault(r, []).append(no)
    for p, own in probing:
        n, at = len(own), int(np.flatnonzero(own == element)[0])
        mine = [lists[r] for r in own[at:].tolist() if r in lists]
        head = own[:at].tolist()
        low = bisect_left(sizes, math.ceil(t * n - _EPS))
        high = bisect_left(sizes, math.floor(n / t + _EPS) + 1)
        while low < high:  # one merge for each size of partner, as T depends on it
            m = sizes[low]
            end = bisect_left(sizes, m + 1, low, high)
            cut = [x[bisect_left(x, low) : bisect_left(x, end)] for x in mine]
            for no, count in merge_skip(cut, _need(n, m, t)):
                c = indexed[no][0]
                if (c < p or (c > p and not within)) and heads[no].isdisjoint(head):
                    yield min(c, p), max(c, p), count / (n + m - count)
            low = end


def _join_bucket(pdf: pd.DataFrame, t: float) -> pd.DataFrame:
    """Pairs of the cells of one bucket; every row says: this class is indexed (role 0) or probes (role 1) in this cell."""
    cells: dict[tuple, tuple[list, list]] = {}
    for c, ids, element, i, j, role in zip(pdf["class"], pdf["ids"], pdf["element"], pdf["i"], pdf["j"], pdf["role"]):
        cells.setdefault((element, i, j), ([], []))[role].append((c, ids))
    rows = [pair for (e, i, j), (indexed, probing) in cells.items() for pair in _join_cell(e, i == j, indexed, probing, t)]
    return pd.DataFrame(rows, columns=["c1", "c2", "similarity"]).astype({"c1": "int64", "c2": "int64", "similarity": "float64"})


def similar_classes(sets: DataFrame, workspace: Workspace, t: float = 0.6) -> tuple[DataFrame, DataFrame]:
    """``(members, pairs)``: ``id, class`` of every record, and ``c1, c2, similarity`` (c1 < c2) of all pairs of classes.

    ``sets`` has ``id, items`` (sorted, distinct, not empty).  Equal sets share a class; a class is
    similar to itself, which is not listed.  An empty input gives two empty tables.
    """
    sets = workspace.save(sets.select("id", "items"), "sets", rows=F.count(F.lit(1)))
    # ids only have to be unique; written down, they are fixed
    groups = sets.select("items").distinct().select(F.monotonically_increasing_id().alias("class"), "items")
    groups = workspace.save(groups, "classes")
    copied = hot_keys(sets, "items", metric(sets, "rows"))  # one set may be delivered very often
    members = salted_join(sets, groups, "items", copied, "id").select("id", "class")

    single = groups.select("class", F.explode("items").alias("item"))
    df = single.groupBy("item").count().select("item", "count", F.monotonically_increasing_id().alias("eid"))
    df = workspace.save(df, "elements")
    hot = hot_keys(single, "item", single.count())
    ranked = salted_join(single, df, "item", hot, "class").groupBy("class").agg(F.sort_array(F.collect_list(F.struct("count", "eid"))).alias("r"))
    ranked = workspace.save(ranked.select("class", F.col("r.eid").alias("ids")), "ranked")

    n = F.size("ids")
    prefix = F.slice("ids", F.lit(1), n - F.ceil(n * F.lit(t) - F.lit(_EPS)).cast("int") + 1)
    slim = ranked.select("class", F.explode(prefix).alias("element"))
    total = slim.count()
    load = slim.groupBy("element").agg(F.count("*").alias("n")).where("n > 1").select("element", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    shared = salted_join(slim, load, "element", hot_keys(slim, "element", total), "class")
    shared = workspace.save(shared, "shared", rows=F.count(F.lit(1)))
    routed = shared.join(ranked, "class")  # a class has as many rows as its prefix is long
    routed = routed.withColumn("own", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    index = routed.withColumn("i", F.col("own")).withColumn("j", F.explode(F.sequence("own", F.col("blocks") - 1))).withColumn("role", F.lit(0))
    probe = routed.withColumn("j", F.col("own")).withColumn("i", F.explode(F.sequence(F.lit(0), "own"))).withColumn("role", F.lit(1))
    columns = ["class", "ids", "element", "i", "j", "role"]
    buckets = max(16, metric(shared, "rows") * 2 // BUCKET_ROWS)
    cells = index.select(columns).unionByName(probe.select(columns)).withColumn("bucket", F.pmod(F.xxhash64("element", "i", "j"), F.lit(buckets)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return _join_bucket(pdf, t)

    pairs = cells.groupBy("bucket").applyInPandas(run, "c1 bigint, c2 bigint, similarity double")
    return members, workspace.save(pairs, "pairs")


def similar_records(sets: DataFrame, workspace: Workspace, t: float = 0.6) -> DataFrame:
    """``id_1, id_2, similarity`` (id_1 < id_2) of all pairs of records, those with equal sets included.

    The records of a class are cut into blocks of about ``MEMBERS``, and blocks meet blocks, so that no task
    holds a class of many copies.  The result has every pair of copies; :func:`class_links` does without.
    """
    members, pairs = similar_classes(sets, workspace, t)
    members = workspace.save(members, "members", rows=F.count(F.lit(1)))
    sizes = members.groupBy("class").agg(F.count("*").alias("n")).select("class", "n", F.ceil(F.col("n") / MEMBERS).cast("int").alias("parts"))
    sizes = workspace.save(sizes, "sizes")
    hot = hot_keys(members, "class", metric(members, "rows"))
    placed = salted_join(members, sizes, "class", hot, "id").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    placed = workspace.save(placed.select("id", "class", "part"), "placed")
    one = placed.select(F.col("id").alias("x"), F.col("class").alias("c1"), F.col("part").alias("i"))
    two = placed.select(F.col("id").alias("y"), F.col("class").alias("c2"), F.col("part").alias("j"))
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    met = pairs.join(sizes.select(F.col("class").alias("c1"), F.col("parts").alias("p1")), "c1").join(sizes.select(F.col("class").alias("c2"), F.col("parts").alias("p2")), "c2")
    met = met.withColumn("i", upto("p1")).withColumn("j", upto("p2"))
    other = met.join(one, ["c1", "i"]).join(two, ["c2", "j"]).select(F.least("x", "y").alias("id_1"), F.greatest("x", "y").alias("id_2"), "similarity")
    own = sizes.where("n > 1").select(F.col("class").alias("c1"), F.col("class").alias("c2"), upto("parts").alias("i"), "parts")
    own = own.withColumn("j", F.explode(F.sequence("i", F.col("parts") - 1)))
    same = own.join(one, ["c1", "i"]).join(two, ["c2", "j"]).where((F.col("i") < F.col("j")) | (F.col("x") < F.col("y")))
    return other.unionByName(same.select(F.least("x", "y").alias("id_1"), F.greatest("x", "y").alias("id_2"), F.lit(1.0).alias("similarity")))


def class_links(sets: DataFrame, workspace: Workspace, t: float = 0.6) -> DataFrame:
    """``id, class_id, links``: each record's class, named by its smallest id, and the number of other classes similar to it."""
    members, pairs = similar_classes(sets, workspace, t)
    members = workspace.save(members, "members", rows=F.count(F.lit(1)))
    ends = pairs.select(F.explode(F.array("c1", "c2")).alias("class")).groupBy("class").agg(F.count("*").alias("links"))
    named = members.groupBy("class").agg(F.min("id").alias("class_id")).join(ends, "class", "left")
    hot = hot_keys(members, "class", metric(members, "rows"))
    return salted_join(members, named, "class", hot, "id").select("id", "class_id", F.coalesce("links", F.lit(0)).alias("links"))
