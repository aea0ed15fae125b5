"""Jaccard of all pairs of sets in blocks, summed up where they are compared.

Rows of equal sets are folded first: ``class_id, items, m`` with items as 64-bit hashes and m the number of
rows.  The top-k searches compare two blocks by one matrix product over the items that both hold.

The focused splits need every pair but only sums and maxima of them (:class:`Overlaps`).  The most frequent items are
bits of a mask; sets of equal mask and size share a profile, and what two sets share of these items depends on their
profiles alone, of which there are few.  Pairs that share other items as well are met in blocks through these
items, and what leaves a block grows with its rows.  No pair is left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.storage import Workspace

#: Sets of one side of a block.
SET_BLOCK = 20_000
#: Most profiles, most bits of their masks, and items met at once in a block.
PROFILES = 1_500
_BITS = (62, 48, 40, 32, 24, 20, 16, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
_HITS = 1_000_000
#: Items that one product takes at once.
_ITEMS = 4_096


def jaccard_grid(left: Sequence, right: Sequence) -> np.ndarray:
    """Jaccard of every left with every right set; the sets hold no item twice and are not empty."""
    sizes = [np.array([len(x) for x in side]) for side in (left, right)]
    flat = [np.concatenate([np.asarray(x) for x in side]) for side in (left, right)]
    return jaccard_flat(flat, [np.repeat(np.arange(len(n)), n) for n in sizes], sizes)


def jaccard_flat(flat: Sequence[np.ndarray], rows: Sequence[np.ndarray], sizes: Sequence[np.ndarray]) -> np.ndarray:
    """:func:`jaccard_grid` of two sides, each as its items, the row of every item and the size of every row."""
    keys = np.intersect1d(pd.unique(flat[0]), pd.unique(flat[1]), assume_unique=True)
    shared = np.zeros((len(sizes[0]), len(sizes[1])))
    for at in range(0, len(keys), _ITEMS):
        part = keys[at : at + _ITEMS]
        grids = []
        for items, row, n in zip(flat, rows, sizes):
            place = np.searchsorted(part, items)
            here = (place < len(part)) & (part[np.minimum(place, len(part) - 1)] == items)
            grid = np.zeros((len(n), len(part)), dtype="float32")
            grid[row[here], place[here]] = 1
            grids.append(grid)
        shared += grids[0] @ grids[1].T
    return shared / (sizes[0][:, None] + sizes[1][None, :] - shared)


def jaccard_lots(left: pd.DataFrame, right: pd.DataFrame) -> np.ndarray:
    """:func:`jaccard_grid` of the column ``items``, null or empty sets included: two empty sets are 1, a null set has no pairs."""
    sides = [df["items"].to_numpy() for df in (left, right)]
    have = [np.array([-1 if x is None else len(x) for x in side]) for side in sides]
    out = (have[0][:, None] == 0) & (have[1][None, :] == 0)
    out = np.where((have[0] < 0)[:, None] | (have[1] < 0)[None, :], np.nan, out.astype("float64"))
    a, b = (np.flatnonzero(n > 0) for n in have)
    if len(a) and len(b):
        out[np.ix_(a, b)] = jaccard_grid(sides[0][a], sides[1][b])
    return out


_MIX = np.uint64(0x9E3779B97F4A7C15)


def gram_sets(df: pd.DataFrame, lengths: Sequence[int] = (2, 3, 4)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct character n-grams of the column ``text`` (K21), as hashes, with the row of each and the number of every row."""
    texts = df["text"].tolist()
    n = np.array([len(t) for t in texts], dtype="int64")
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="uint32").astype("uint64") + np.uint64(1)
    row, start = np.repeat(np.arange(len(n)), n), np.cumsum(n) - n
    left = np.repeat(start + n, n) - np.arange(len(points))  # characters from here to the end of the text
    grams, rows = [np.zeros(int((n == 0).sum()), dtype="uint64")], [np.flatnonzero(n == 0)]  # an empty text is its own gram
    code = np.zeros(len(points), dtype="uint64")
    for k in range(1, max(lengths) + 1):
        have = max(0, len(points) - k + 1)
        code[:have] = code[:have] * _MIX + points[k - 1 :][:have]
        if k in lengths:
            grams.append(code[left >= k])
            rows.append(row[left >= k])
        if k < max(lengths):  # a shorter text gives itself
            whole = np.flatnonzero(n == k)
            grams.append(code[start[whole]])
            rows.append(whole)
    grams, rows = np.concatenate(grams), np.concatenate(rows)
    number, names = pd.factorize(grams)
    pairs = pd.unique(rows * len(names) + number)
    rows = pairs // len(names) if len(names) else pairs
    return names[pairs - rows * len(names)] if len(names) else names, rows, np.bincount(rows, minlength=len(n))


def jaccard_grams(left: tuple[np.ndarray, ...], right: tuple[np.ndarray, ...]) -> np.ndarray:
    """Jaccard of every left with every right of two results of :func:`gram_sets`."""
    return jaccard_flat(*zip(left, right))


def _paired(left: DataFrame, right: DataFrame, block: int, run: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], out: str, once: bool = False) -> DataFrame:
    """``run`` over every pair of blocks; with ``once`` each unordered pair of blocks comes once (both sides the same table)."""
    n, m = max(1, -(-right.count() // block)), max(1, -(-left.count() // block))
    copies = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)).cast("array<bigint>"))
    # other names on each side, as both may come from one table
    a = left.select([F.col(c).alias(f"a_{c}") for c in left.columns]).withColumn("j", F.pmod(F.xxhash64("a_class_id"), F.lit(m))).withColumn("i", copies(n))
    b = right.select([F.col(c).alias(f"b_{c}") for c in right.columns]).withColumn("i", F.pmod(F.xxhash64("b_class_id"), F.lit(n))).withColumn("j", copies(m))
    if once:
        a, b = a.where("i <= j"), b.where("i <= j")
    names = [x.split()[0] for x in out.split(", ")]

    def safe(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        return run(x, y) if len(x) and len(y) else pd.DataFrame({c: [] for c in names})

    return a.groupBy("i", "j").cogroup(b.groupBy("i", "j")).applyInPandas(safe, out)


def _spanning(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Which edges ``a, b, w`` between n nodes make a maximum spanning forest (Boruvka's method; of equal weights the first)."""
    place = np.argsort(-w, kind="stable")
    a, b, label, found = a[place], b[place], np.arange(n), []
    while len(place):
        la, lb = label[a], label[b]
        live = la != lb
        a, b, la, lb, place = a[live], b[live], la[live], lb[live], place[live]
        best, down = np.full(n, len(place)), np.arange(len(place))[::-1]
        for ends in (la, lb):
            first = np.full(n, len(place))
            first[ends[::-1]] = down  # the last that is written is the best edge
            best = np.minimum(best, first)
        have = np.flatnonzero(best < len(place))
        edge = best[have]
        found.append(place[np.unique(edge)])
        to = np.arange(n)
        to[have] = np.where(la[edge] == have, lb[edge], la[edge])
        root = (to[to] == np.arange(n)) & (np.arange(n) < to)  # two that chose the same edge
        to[root] = np.flatnonzero(root)
        while (to[to] != to).any():
            to = to[to]
        label = to[label]
    return np.concatenate(found) if found else np.zeros(0, dtype="int64")


def _met(x: pd.DataFrame, y: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row of x, row of y, Jaccard, Jaccard by the profiles alone) of all pairs of different sets that share an item of ``rare``; by rows of x."""
    (xi, xr), (yi, yr) = ((np.concatenate(s.to_numpy()), np.repeat(np.arange(len(s)), [len(v) for v in s])) for s in (x["a_rare"], y["b_rare"]))
    by = np.argsort(yi, kind="stable")
    yi, yr = yi[by], yr[by]
    lo, n = np.searchsorted(yi, xi, "left"), np.searchsorted(yi, xi, "right")
    n -= lo
    load, bounds = np.concatenate([[0], np.cumsum(n)]), np.searchsorted(xr, np.arange(len(x) + 1))
    ids, sizes, masks = ([s.to_numpy() for s in (x[f"a_{c}"], y[f"b_{c}"])] for c in ("class_id", "size", "mask"))
    at = 0
    while at < len(x):
        end = max(at + 1, int(np.searchsorted(load[bounds], load[bounds[at]] + _HITS, "right")) - 1)
        part = slice(bounds[at], bounds[end])
        hit = np.arange(load[part.stop] - load[part.start]) + np.repeat(lo[part] - (load[part] - load[part.start]), n[part])
        pair = np.sort(np.repeat(xr[part], n[part]) * len(y) + yr[hit])
        first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else pair
        shared, pair = np.diff(np.append(first, len(pair))), pair[first]
        r, c = pair // len(y), pair % len(y)
        other = ids[0][r] != ids[1][c]
        r, c, shared = r[other], c[other], shared[other]
        total, common = sizes[0][r] + sizes[1][c], np.bitwise_count(masks[0][r] & masks[1][c]).astype("int64")
        if len(r):
            yield r, c, (common + shared) / (total - common - shared), common / (total - common)
        at = end


class Overlaps:
    """Sets ``class_id, items, m`` (``class_id`` a number) made ready: ``rows`` are ``class_id, m, size, mask, profile, rare``.

    ``rare`` holds the items outside of the mask that other sets have as well.  On the driver there are at most
    1500 profiles with mask, size, number of sets, rows and one set of each.
    """

    def __init__(self, sets: DataFrame, workspace: Workspace):
        each = sets.select("class_id", F.explode("items").alias("item"))
        counts = workspace.save(each.groupBy("item").agg(F.count("*").alias("n")).where("n > 1"), "items")
        top = [r["item"] for r in counts.orderBy(F.desc("n"), "item").limit(max(_BITS)).collect()]  # the bits of a mask
        mask = F.lit(0).cast("bigint")
        for k, item in enumerate(top):
            mask = mask.bitwiseOR(F.when(F.array_contains("items", F.lit(item)), F.lit(1 << k)).otherwise(F.lit(0)).cast("bigint"))
        masked = workspace.save(sets.select("class_id", "m", F.size("items").alias("size"), mask.alias("mask")), "masks")
        kept = lambda k: F.col("mask").bitwiseAND(F.lit((1 << k) - 1).cast("bigint"))
        some = masked.select("size", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), kept(k).alias("mask")) for k in _BITS])).alias("p")).distinct()
        sizes = {r["k"]: r["n"] for r in some.groupBy("p.k").agg(F.count("*").alias("n")).collect()}  # one row a number of bits
        bits = next((k for k in _BITS if sizes.get(k, 0) <= PROFILES), 0)
        masked = masked.withColumn("mask", kept(bits))
        groups = masked.groupBy("mask", "size").agg(F.count("*").alias("sets"), F.sum("m").alias("m"), F.min("class_id").alias("first"))
        found = sorted(groups.collect(), key=lambda r: (r["mask"], r["size"]))  # at most PROFILES, without bits one a size
        self.mask, self.size, self.sets, self.m, self.first = (np.array([r[c] for r in found], dtype="int64") for c in ("mask", "size", "sets", "m", "first"))
        numbered = sets.sparkSession.createDataFrame([(r["mask"], r["size"], k) for k, r in enumerate(found)], "mask bigint, size int, profile int")
        others = counts.where(~F.col("item").isin(top[:bits])).select("item")
        rare = each.join(others, "item").groupBy("class_id").agg(F.collect_list("item").alias("rare"))
        self.rows = workspace.save(masked.join(F.broadcast(numbered), ["mask", "size"]).join(rare, "class_id", "left"), "overlaps")

    def base(self) -> np.ndarray:
        """Jaccard of sets of every two profiles that share no further item."""
        common = np.bitwise_count(self.mask[:, None] & self.mask[None, :]).astype("int64")
        return common / (self.size[:, None] + self.size[None, :] - common)


def forest(overlaps: Overlaps, least: float) -> DataFrame:
    """``i, j, w``: edges that join the same components as all pairs do, at every threshold from ``least`` on.

    Of the pairs that are met, a maximum spanning forest of each pair of blocks.  For the others each set is
    joined to the first set of the profile nearest to its own, and the first sets among each other: where two
    profiles are near enough, all sets of both are connected.
    """
    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        ids, place = np.unique(np.concatenate([x["a_class_id"], y["b_class_id"]]), return_inverse=True)
        r, c, w = [], [], []
        for a, b, j, _ in _met(x, y):
            near = j >= least
            r, c, w = [*r, place[a[near]]], [*c, place[len(x) + b[near]]], [*w, j[near]]
            if sum(map(len, w)) > _HITS:
                r, c, w = (np.concatenate(v) for v in (r, c, w))
                keep = _spanning(len(ids), r, c, w)
                r, c, w = [r[keep]], [c[keep]], [w[keep]]
        r, c, w = (np.concatenate(v) if v else np.zeros(0, dtype="int64") for v in (r, c, w))
        keep = _spanning(len(ids), r, c, w)
        return pd.DataFrame({"i": ids[r[keep]], "j": ids[c[keep]], "w": w[keep]})

    rows, spark = overlaps.rows.where("rare is not null"), overlaps.rows.sparkSession
    met = _paired(rows, rows, SET_BLOCK, run, "i bigint, j bigint, w double", True)
    grid, first = overlaps.base(), overlaps.first
    a, b = np.nonzero(np.triu(grid >= least, 1))
    keep = _spanning(len(first), a, b, grid[a, b])
    heads = spark.createDataFrame(pd.DataFrame({"i": first[a[keep]], "j": first[b[keep]], "w": grid[a, b][keep]}), "i bigint, j bigint, w double")
    np.fill_diagonal(grid, np.where(overlaps.sets > 1, grid.diagonal(), -1.0))
    best = grid.argmax(axis=1) if len(grid) else np.zeros(0, dtype="int64")
    near = spark.createDataFrame(pd.DataFrame({"profile": np.arange(len(first)), "j": first[best], "w": grid[np.arange(len(first)), best]}), "profile int, j bigint, w double").where(F.col("w") >= least)
    inside = overlaps.rows.join(F.broadcast(near), "profile").select(F.col("class_id").alias("i"), "j", "w")
    return met.unionByName(heads).unionByName(inside).where("i <> j").select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "w")


def component_tables(overlaps: Overlaps, tags: DataFrame, names: DataFrame) -> DataFrame:
    """``k, component, size, min_id, external_max, external_mean`` (A7) over all pairs of rows.

    ``tags`` has ``class_id`` and the component of each set under the k-th labelling as ``tags[k]``, ``names`` the
    id of each set by which ties are decided; the sides of a pair of equal sets share a component.
    """
    tagged = overlaps.rows.join(tags, "class_id")

    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        mine, theirs = (np.stack(s.to_numpy()) for s in (x["a_tags"], y["b_tags"]))
        have, weigh = x["a_m"].to_numpy(), y["b_m"].to_numpy().astype(float)
        hi, total = np.zeros(mine.T.shape), np.zeros(mine.T.shape)
        for r, c, j, known in _met(x, y):
            starts = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
            for k in range(len(hi)):
                out = mine[r, k] != theirs[c, k]
                hi[k, r[starts]] = np.maximum(hi[k, r[starts]], np.maximum.reduceat(np.where(out, j, 0.0), starts))
                total[k] += np.bincount(r, np.where(out, (j - known) * weigh[c], 0.0), minlength=len(x))
        parts = []
        for k in range(len(hi)):
            some = np.flatnonzero(hi[k] > 0)
            row = pd.DataFrame({"component": mine[some, k], "hi": hi[k, some], "total": total[k, some] * have[some]})
            parts.append(row.groupby("component", as_index=False).agg({"hi": "max", "total": "sum"}).assign(k=k))
        return pd.concat(parts)[["k", "component", "hi", "total"]]

    rare = tagged.where("rare is not null")
    apart = _paired(rare, rare, SET_BLOCK, run, "k int, component bigint, hi double, total double").groupBy("k", "component").agg(F.max("hi").alias("hi"), F.sum("total").alias("total"))
    flat = tagged.select("class_id", "m", "profile", F.posexplode("tags").alias("k", "component"))
    entries = flat.groupBy("k", "component", "profile").agg(F.sum("m").alias("m"))
    mask, size, mass = overlaps.mask, overlaps.size, overlaps.m

    def known(df: pd.DataFrame) -> pd.DataFrame:
        common = np.bitwise_count(mask[:, None] & mask[None, :]).astype("int64")
        grid = common / (size[:, None] + size[None, :] - common)
        every, top = grid @ mass, grid.max(axis=1)
        df = df.sort_values(["k", "component", "profile"]).reset_index(drop=True)
        p, m, key = df["profile"].to_numpy(), df["m"].to_numpy(), df[["k", "component"]].to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)]))
        ends = np.append(starts[1:], len(df))
        hi, total = top[p[starts]], m[starts] * (every[p[starts]] - grid[p[starts], p[starts]] * m[starts])
        whole = np.logical_or.reduceat(m == mass[p], starts)  # a profile with no row outside
        for s in np.flatnonzero((ends - starts > 1) | whole):
            q, n = p[starts[s] : ends[s]], m[starts[s] : ends[s]]
            total[s] = n @ every[q] - n @ grid[np.ix_(q, q)] @ n
            if whole[s]:
                left = np.ones(len(mass), dtype=bool)
                left[q[n == mass[q]]] = False
                hi[s] = grid[q][:, left].max() if left.any() else 0.0
            else:
                hi[s] = top[q].max()
        return pd.DataFrame({"k": key[starts, 0], "component": key[starts, 1], "hi0": hi, "total0": np.maximum(total, 0.0)})

    lots = 2 * tagged.sparkSession.sparkContext.defaultParallelism
    base = entries.groupBy(F.pmod(F.xxhash64("component"), F.lit(lots))).applyInPandas(known, "k int, component bigint, hi0 double, total0 double")
    sizes = flat.join(names, "class_id").groupBy("k", "component").agg(F.sum("m").alias("size"), F.min("name").alias("min_id"))
    rest = F.lit(int(mass.sum())) - F.col("size")
    total = F.col("total0") + F.coalesce("total", F.lit(0.0))
    # rounded, so that the order of packing does not hang on the order of a sum
    return sizes.join(base, ["k", "component"]).join(apart, ["k", "component"], "left").select(
        "k", "component", "size", "min_id", F.when(rest > 0, F.greatest("hi0", F.coalesce("hi", F.lit(0.0)))).alias("external_max"), F.when(rest > 0, F.round(total / (F.col("size") * rest), 12)).alias("external_mean")
    )


def split_summaries(overlaps: Overlaps, tags: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """One row a split k (A8, X4), over all pairs: sizes, the test rows' similarity to training, and ``violations``, the
    cross pairs at or above the k-th threshold.  ``tags`` has ``class_id`` and tells with ``tags[k]`` which sets are test."""
    tested = overlaps.rows.join(tags, "class_id")

    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        mine, theirs = (np.stack(s.to_numpy()).astype(bool) for s in (x["a_tags"], y["b_tags"]))
        ids, weigh = x["a_class_id"].to_numpy(), y["b_m"].to_numpy().astype(float)
        hi, total, crossed = (np.zeros(mine.T.shape) for _ in range(3))
        for r, c, j, known in _met(x, y):
            starts = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
            for k, t in enumerate(thresholds):
                cross = mine[r, k] & ~theirs[c, k]
                hi[k, r[starts]] = np.maximum(hi[k, r[starts]], np.maximum.reduceat(np.where(cross, j, 0.0), starts))
                total[k] += np.bincount(r, np.where(cross, (j - known) * weigh[c], 0.0), minlength=len(x))
                crossed[k] += np.bincount(r, np.where(cross, ((j >= t) * 1.0 - (known >= t)) * weigh[c], 0.0), minlength=len(x))
        k, row = np.nonzero(hi > 0)
        return pd.DataFrame({"k": k, "class_id": ids[row], "hi": hi[k, row], "total": total[k, row], "crossed": crossed[k, row]})

    rare = tested.where("rare is not null")
    near = _paired(rare.where(F.exists("tags", lambda x: x)), rare, SET_BLOCK, run, "k int, class_id bigint, hi double, total double, crossed double").groupBy("k", "class_id").agg(F.max("hi").alias("hi"), F.sum("total").alias("total"), F.sum("crossed").alias("crossed"))
    flat = tested.select("class_id", "m", "profile", F.posexplode("tags").alias("k", "test"))
    train = np.zeros((len(thresholds), len(overlaps.m)))
    for r in flat.where(~F.col("test")).groupBy("k", "profile").agg(F.sum("m").alias("m")).collect():  # at most PROFILES a threshold
        train[r["k"], r["profile"]] = r["m"]
    grid, known = overlaps.base(), []
    for k, t in enumerate(thresholds):
        there = grid[:, train[k] > 0]
        known.append(pd.DataFrame({"k": k, "profile": np.arange(len(grid)), "hi0": there.max(axis=1, initial=0.0), "total0": grid @ train[k], "crossed0": (grid >= t) @ train[k]}))
    known = tested.sparkSession.createDataFrame(pd.concat(known), "k int, profile int, hi0 double, total0 double, crossed0 double")
    sizes = flat.groupBy("k").agg(F.coalesce(F.sum(F.when(~F.col("test"), F.col("m"))), F.lit(0)).alias("train_size"))
    more = lambda c: F.coalesce(c, F.lit(0.0))
    rows = flat.where("test").join(F.broadcast(known), ["k", "profile"]).join(near, ["k", "class_id"], "left").select(
        "k", "m", F.greatest("hi0", more("hi")).alias("hi"), (F.col("total0") + more("total")).alias("total"), (F.col("crossed0") + more("crossed")).alias("crossed")
    )
    at = lambda q: F.percentile("hi", F.lit(q), F.col("m"))
    stats = rows.groupBy("k").agg(
        F.sum("m").alias("test_size"), F.round(F.sum(F.col("hi") * F.col("m")) / F.sum("m"), 12).alias("mean_max"), at(0.5).alias("median_max"), at(0.1).alias("p10_max"), at(0.9).alias("p90_max"),
        F.max("hi").alias("max_max"), (F.sum(F.col("total") * F.col("m")) / F.sum("m")).alias("total"), F.sum(F.col("crossed") * F.col("m")).alias("crossed"),
    )
    return sizes.join(stats, "k", "left").select(
        "k", "train_size", F.coalesce("test_size", F.lit(0)).alias("test_size"), "mean_max", "median_max", "p10_max", "p90_max", "max_max", (F.col("total") / F.greatest("train_size", F.lit(1))).alias("mean_mean"),
        F.coalesce(F.col("crossed").cast("bigint"), F.lit(0)).alias("violations"),
    )
