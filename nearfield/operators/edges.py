"""The similarity join family with exact results: pairs, top-k, nearest, attachment and composition of edges.

The common contract is the edge table ``sample_id, train_id, similarity`` (larger is more alike).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.operators.skew import spread
from nearfield.schema import EDGE, finite, require

#: Rows of one block on either side of a pairing.
BLOCK = 2_000
#: Most queries and training rows of a block that keeps the best of its pairs, and of one matrix within it.
GRID_BLOCK = (4_000, 16_000)
GRID_LOT = (512, 2_048)
#: ... and of a block that lists its pairs.
GRID_PAIRS = (1_000, 1_000)


def _blocks(df: DataFrame, rows: int) -> int:
    return max(1, -(-df.count() // rows))


def block_pairs(queries: DataFrame, train: DataFrame, key: str, block: int = BLOCK) -> DataFrame:
    """Every query row beside every training row, as an equi-join on blocks.

    Training rows fall into blocks of about ``block`` rows by the hash of ``key``; each query row is
    copied to every block.  The work is spread evenly whatever the keys are, nothing is broadcast.
    The columns of both sides must differ.  Meant for a stated query set: the result has
    |queries| x |train| rows.
    """
    n = _blocks(train, block)
    right = train.withColumn("__block", F.pmod(F.xxhash64(key), F.lit(n)).cast("int"))
    left = queries.withColumn("__block", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return left.repartition("__block").join(right.repartition("__block"), "__block").drop("__block") if n > 1 else left.join(right, "__block").drop("__block")


def all_pairs(queries: DataFrame, train: DataFrame, kernel: Callable[[Column, Column], Column], feature: str, query_id: str, train_id: str, self_pairs: bool = True) -> DataFrame:
    """Edges of every query with every training row (J1); ``feature`` is the column of both sides."""
    q = queries.select(F.col(query_id).alias("sample_id"), F.col(feature).alias("__a"))
    t = train.select(F.col(train_id).alias("train_id"), F.col(feature).alias("__b"))
    pairs = block_pairs(spread(q, "sample_id"), t, "train_id")
    if not self_pairs:
        pairs = pairs.where("sample_id <> train_id")
    return pairs.select("sample_id", "train_id", kernel(F.col("__a"), F.col("__b")).alias("similarity"))


def top_k(edges: DataFrame, k: int, digits: int | None = None) -> DataFrame:
    """The ``k`` most similar training rows per sample with ``rank`` from 1 (W1, W2); ``k <= 0`` keeps all.

    Order: similarity descending, then ``train_id``; with ``digits`` similarities are rounded first, so
    that ties do not hang on the last bit.  Edges without a finite similarity are left out.
    """
    rows = edges.where(finite("similarity"))
    if digits is not None:
        rows = rows.withColumn("similarity", F.round("similarity", digits))
    order = Window.partitionBy("sample_id").orderBy(F.desc("similarity"), F.asc("train_id"))
    ranked = rows.withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k) if k > 0 else ranked


def dense_top_k(queries: DataFrame, train: DataFrame, query_id: str, train_id: str, vector: str, k: int, metric: str = "cosine", scale: float = 1.0, raw: bool = False, self_pairs: bool = False, block: int = BLOCK) -> DataFrame:
    """Exact dense top-k (J2) by blocks of matrix products; only each block's k best rows leave it.

    Metrics: cosine (zero vectors keep norm 1; shifted to 0..1 unless raw), dot, euclidean (exp(-d/scale)),
    rbf (exp(-scale d^2)).
    Similarities are rounded to ten digits before ranking.  Vectors with null or non-finite parts fail.
    """
    out = "sample_id long, train_id long, similarity double"

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"sample_id": [], "train_id": [], "similarity": []}).astype({"sample_id": "int64", "train_id": "int64"})
        a, b = np.stack(left["__v"].to_numpy()).astype(float), np.stack(right["__v"].to_numpy()).astype(float)
        if not (np.isfinite(a).all() and np.isfinite(b).all()):
            raise ValueError("vectors must be finite")
        if metric == "cosine":
            for m in (a, b):
                n = np.linalg.norm(m, axis=1, keepdims=True)
                m /= np.where(n == 0, 1.0, n)
            sim = a @ b.T
            sim = sim if raw else (sim + 1) / 2
        elif metric == "dot":
            sim = a @ b.T
        else:
            d = np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T), 0.0)
            sim = np.exp(-scale * d) if metric == "rbf" else np.exp(-np.sqrt(d) / scale)
        sim = np.round(sim, 10)
        ids, theirs = left["sample_id"].to_numpy(), right["train_id"].to_numpy()
        if not self_pairs:
            sim = np.where(ids[:, None] == theirs[None, :], -np.inf, sim)
        order = np.lexsort((np.broadcast_to(theirs, sim.shape), -sim), axis=1)[:, : k if k > 0 else sim.shape[1]]
        values = np.take_along_axis(sim, order, axis=1)
        rows = pd.DataFrame({"sample_id": np.repeat(ids, order.shape[1]), "train_id": theirs[order].ravel(), "similarity": values.ravel()})
        return rows[np.isfinite(rows["similarity"])]

    n, m = _blocks(train, block), _blocks(queries, block)
    q = queries.select(F.col(query_id).cast("long").alias("sample_id"), F.col(vector).cast("array<double>").alias("__v"))
    t = train.select(F.col(train_id).cast("long").alias("train_id"), F.col(vector).cast("array<double>").alias("__v"))
    q = q.withColumn("j", F.pmod(F.xxhash64("sample_id"), F.lit(m))).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>")))
    t = t.withColumn("i", F.pmod(F.xxhash64("train_id"), F.lit(n))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(m - 1)).cast("array<bigint>")))
    local = q.groupBy("i", "j").cogroup(t.groupBy("i", "j")).applyInPandas(run, out)
    return top_k(local, k)


def _half_up(x: np.ndarray, digits: int) -> np.ndarray:
    return np.floor(x * 10.0**digits + 0.5)


def _kept(best: tuple[np.ndarray, ...], grid: np.ndarray, at: int, k: int, digits: int) -> tuple[np.ndarray, ...]:
    """The k best of each row, so far and in ``grid``, whose columns come after all earlier ones; equal ranks keep the earlier column.

    ``best`` is (row, column, similarity, least rank that each full row still holds).
    """
    row, column, value, least = best
    # a later column enters only by a better rank, and ranks are rounded half up
    r, c = np.nonzero(grid > ((least + 0.499) / 10.0**digits)[:, None])
    if not len(r):
        return best
    row, column, value = np.concatenate([row, r]), np.concatenate([column, c + at]), np.concatenate([value, grid[r, c]])
    rank = _half_up(value, digits)
    order = np.lexsort((column, -rank, row))
    row, column, value, rank = row[order], column[order], value[order], rank[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    ok = place < k
    full, least = ok & (place == k - 1), least.copy()
    least[row[full]] = rank[full]
    return row[ok], column[ok], value[ok], least


def grid_top_k(queries: DataFrame, train: DataFrame, score: Callable, k: int, digits: int, self_pairs: bool = False, prepare: Callable = lambda rows: rows) -> DataFrame:
    """The ``k`` best of every query among all training rows, as :func:`top_k` of all pairs, which are never listed.

    Both sides have ``id`` and the same features; ``score(prepare(a), prepare(b))`` is the matrix of the similarities of two
    lots of rows (pandas), -inf or NaN where a pair does not count.  Blocks of both sides meet in cogroups; a block
    goes through its training rows by id and keeps k rows a query, so what leaves it grows with the queries only.
    """
    kinds = [df.schema["id"].dataType.simpleString() for df in (queries, train)]
    names = queries.columns

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left[[f"a_{c}" for c in names]].set_axis(names, axis=1)
        right = right[[f"b_{c}" for c in names]].set_axis(names, axis=1).sort_values("id", kind="stable", na_position="first", ignore_index=True)
        ids, theirs = left["id"].to_numpy(), right["id"].to_numpy()
        lots = [slice(i, min(i + GRID_LOT[0], len(left))) for i in range(0, len(left), GRID_LOT[0])] if len(right) else []
        mine = [prepare(left.iloc[lot].reset_index(drop=True)) for lot in lots]
        none = np.zeros(0, dtype="int64")
        best = [(none, none, np.zeros(0), np.full(lot.stop - lot.start, -np.inf)) for lot in lots]
        at, wide = 0, 64  # few columns first, so that most of the later ones fall below what is held
        while at < len(right):
            other = prepare(right.iloc[at : at + wide].reset_index(drop=True))
            for i, lot in enumerate(lots):
                grid = score(mine[i], other)
                if not self_pairs:
                    lo, hi = (np.searchsorted(theirs[at : at + wide], ids[lot], side) for side in ("left", "right"))
                    for r in np.flatnonzero(lo < hi):
                        grid[r, lo[r] : hi[r]] = -np.inf
                best[i] = _kept(best[i], grid, at, k, digits)
            at, wide = at + wide, min(2 * wide, GRID_LOT[1])
        if not lots:
            return pd.DataFrame({"sample_id": ids[:0], "train_id": theirs[:0], "similarity": np.zeros(0)})
        rows = np.concatenate([b[0] + lot.start for b, lot in zip(best, lots)])
        return pd.DataFrame({"sample_id": ids[rows], "train_id": theirs[np.concatenate([b[1] for b in best])], "similarity": np.concatenate([b[2] for b in best])})

    if not self_pairs:  # a null id differs from nothing
        queries, train = queries.where("id is not null"), train.where("id is not null")
    a, b = grid_blocks(queries, train)
    return top_k(a.groupBy("i", "j").cogroup(b.groupBy("i", "j")).applyInPandas(run, f"sample_id {kinds[0]}, train_id {kinds[1]}, similarity double"), k, digits)


def grid_pairs(queries: DataFrame, train: DataFrame, score: Callable, prepare: Callable = lambda rows: rows, sizes: tuple[int, int] = GRID_PAIRS) -> DataFrame:
    """:func:`all_pairs` without those of one id, by ``score`` of blocks as in :func:`grid_top_k`: a row's features come to a block once, not with every pair."""
    kinds = [df.schema["id"].dataType.simpleString() for df in (queries, train)]
    names = queries.columns

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        ids, theirs = left["a_id"].to_numpy(), right["b_id"].to_numpy()
        if not len(left) or not len(right):
            return pd.DataFrame({"sample_id": ids[:0], "train_id": theirs[:0], "similarity": np.zeros(0)})
        one, two = (prepare(df[[f"{p}_{c}" for c in names]].set_axis(names, axis=1)) for df, p in ((left, "a"), (right, "b")))
        grid = score(one, two)
        out = pd.DataFrame({"sample_id": np.repeat(ids, len(theirs)), "train_id": np.tile(theirs, len(ids)), "similarity": grid.ravel()})
        return out[out["sample_id"] != out["train_id"]]

    a, b = grid_blocks(queries.where("id is not null"), train.where("id is not null"), sizes)
    return a.groupBy("i", "j").cogroup(b.groupBy("i", "j")).applyInPandas(run, f"sample_id {kinds[0]}, train_id {kinds[1]}, similarity double")


def grid_blocks(queries: DataFrame, train: DataFrame, sizes: tuple[int, int] = GRID_BLOCK) -> tuple[DataFrame, DataFrame]:
    """Both sides (with ``id``) as ``a_*`` and ``b_*`` with the blocks ``i, j`` in which every query meets every training row once."""
    rows, cores = train.count(), queries.sparkSession.sparkContext.defaultParallelism
    m = _blocks(queries, sizes[0])
    n = max(1, -(-rows // min(sizes[1], max(sizes[1] // 32, -(-rows * m // (4 * cores))))))
    copies = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    block = lambda c, k: F.pmod(F.xxhash64(c), F.lit(k)).cast("int")
    # other names on each side, as both may come from one table
    a = queries.select([F.col(c).alias(f"a_{c}") for c in queries.columns]).withColumn("j", block("a_id", m)).withColumn("i", copies(n))
    b = train.select([F.col(c).alias(f"b_{c}") for c in train.columns]).withColumn("i", block("b_id", n)).withColumn("j", copies(m))
    return a, b


def mixed_top_k(queries: DataFrame, train: DataFrame, columns: Sequence[str], k: int, digits: int) -> DataFrame:
    """The ``k`` best under :func:`kernels.mixed_metadata` of the named columns (K12), in blocks; both sides have ``id``."""

    def features(df: DataFrame) -> DataFrame:
        out = [F.col("id")]
        for i, c in enumerate(columns):
            x = F.col(c).try_cast("double")
            number = F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)
            out += [number.alias(f"x{i}"), F.when(number.isNull(), F.xxhash64(F.col(c).cast("string"))).otherwise(F.lit(0)).alias(f"h{i}")]
        return df.select(out)

    def prepare(rows: pd.DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
        return [(rows[f"x{i}"].to_numpy(dtype="float64", na_value=np.nan), rows[f"h{i}"].to_numpy()) for i in range(len(columns))]

    def score(left: list, right: list) -> np.ndarray:
        grid = np.empty((len(left[0][0]), len(right[0][0])))
        for at in range(0, len(grid), 32):  # a few rows at a time stay in the cache
            total = None
            for (x, h), (y, g) in zip(left, right):
                x, h = x[at : at + 32], h[at : at + 32]
                words = np.isnan(x)[:, None] | np.isnan(y)[None, :]
                if words.all():
                    part = (h[:, None] == g[None, :]).astype("float64")
                else:
                    part = np.abs(x[:, None] - y[None, :])
                    part += 1
                    np.divide(1, part, out=part)
                    if words.any():  # numbers have the hash 0
                        part[words] = (h[:, None] == g[None, :])[words]
                total = part if total is None else np.add(total, part, out=total)
            grid[at : at + 32] = total / len(left)
        return grid

    return grid_top_k(features(queries), features(train), score, k, digits, prepare=prepare)


def max_similarity(edges: DataFrame) -> DataFrame:
    """The highest finite similarity per sample (A2)."""
    return edges.where(finite("similarity")).groupBy("sample_id").agg(F.max("similarity").alias("axis"))


def attach_axis(evals: DataFrame, edges: DataFrame, strict: bool = True) -> DataFrame:
    """Every evaluation row with its highest similarity (J13); rows and their number stay as they are.

    With ``strict`` a row without any finite edge fails the query, as the audit demands; else its axis is null.
    """
    joined = evals.join(max_similarity(require(edges, EDGE, "edge table")), "sample_id", "left")
    if not strict:
        return joined
    missing = F.raise_error(F.concat(F.lit("no similarity for sample "), F.col("sample_id").cast("string"))).cast("double")
    return joined.withColumn("axis", F.when(F.col("axis").isNull(), missing).otherwise(F.col("axis")))


def composite(tables: Sequence[DataFrame], mode: str = "mean", weights: Sequence[float] | None = None) -> DataFrame:
    """Several similarities of the same pairs as one (J15): mean, weighted_mean, min, max or noisy_or.

    Every table must hold exactly the same pairs, once each (U4); anything else fails the query.
    """
    k = len(tables)
    w = list(weights) if weights is not None else [1.0] * k
    if len(w) != k or (mode == "weighted_mean" and sum(w) == 0):
        raise ValueError("weights must match the tables and not sum to 0")
    tagged = [t.select("sample_id", "train_id", "similarity", F.lit(i).alias("t"), F.lit(float(w[i])).alias("w")) for i, t in enumerate(tables)]
    rows = tagged[0]
    for t in tagged[1:]:
        rows = rows.unionByName(t)
    s = F.col("similarity")
    value = {
        "mean": F.avg(s),
        "weighted_mean": F.sum(s * F.col("w")) / F.sum("w"),
        "min": F.min(s),
        "max": F.max(s),
        "noisy_or": 1 - F.aggregate(F.collect_list(1 - s), F.lit(1.0), lambda a, x: a * x),  # one value a table
    }[mode]
    grouped = rows.groupBy("sample_id", "train_id").agg(value.alias("similarity"), F.count("*").alias("__n"), F.countDistinct("t").alias("__t"))
    bad = F.raise_error(F.lit("the tables do not hold the same pairs")).cast("double")
    return grouped.select("sample_id", "train_id", F.when((F.col("__n") == k) & (F.col("__t") == k), F.col("similarity")).otherwise(bad).alias("similarity"))


def nearest_numeric(queries: DataFrame, train: DataFrame, query_id: str, train_id: str, value: str, scale: float = 1.0, buckets: int = 200) -> DataFrame:
    """The training row with the nearest number for every query (J16), similarity exp(-|difference| / scale).

    An as-of join in both directions without a global sort in one task: the values are cut into range
    buckets, each bucket's nearest values below and above come from its own rows or, beyond its edges,
    from the summary of the other buckets (one row a bucket).  Of equally near rows the smaller id wins.
    Null and NaN values are left out.
    """
    t = train.where(finite(value)).groupBy(F.col(value).cast("double").alias("v")).agg(F.min(train_id).alias("train_id"))
    q = queries.where(finite(value)).select(F.col(query_id).alias("sample_id"), F.col(value).cast("double").alias("v"))
    steps = [i / buckets for i in range(1, buckets)]
    cuts = sorted(set(t.approxQuantile("v", steps, 0.001))) if steps else []
    edges = F.array(*[F.lit(float(c)) for c in cuts]) if cuts else F.array().cast("array<double>")
    bucket = F.size(F.filter(edges, lambda c: c <= F.col("v")))
    both = t.select("v", F.struct("v", "train_id").alias("hit"), F.lit(None).cast(q.schema["sample_id"].dataType).alias("sample_id")).unionByName(
        q.select("v", F.lit(None).cast(t.select(F.struct("v", "train_id").alias("h")).schema["h"].dataType).alias("hit"), "sample_id")
    )
    both = both.withColumn("bucket", bucket)
    ends = t.withColumn("bucket", bucket).groupBy("bucket").agg(F.min(F.struct("v", "train_id")).alias("lo"), F.max(F.struct("v", "train_id")).alias("hi"))
    over = Window.orderBy("bucket")  # at most `buckets` rows
    every = train.sparkSession.range(len(cuts) + 1).select(F.col("id").cast("int").alias("bucket")).join(ends, "bucket", "left")
    ends = every.select(
        "bucket",
        F.last("hi", True).over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("before"),
        F.first("lo", True).over(over.rowsBetween(1, Window.unboundedFollowing)).alias("after"),
    )
    # training rows come first among equal values, so that both running windows see them
    isq = F.col("sample_id").isNotNull()
    up = Window.partitionBy("bucket").orderBy("v", isq).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    down = Window.partitionBy("bucket").orderBy(F.desc("v"), isq).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = both.join(F.broadcast(ends), "bucket").select(
        "sample_id", "v", F.coalesce(F.last("hit", True).over(up), "before").alias("below"), F.coalesce(F.last("hit", True).over(down), "after").alias("above")
    )
    dist = lambda c: F.abs(F.col(c)["v"] - F.col("v"))
    options = F.array_sort(F.filter(F.array(*[F.struct(dist(c).alias("d"), F.col(c)["train_id"].alias("id")) for c in ("below", "above")]), lambda x: x["d"].isNotNull()))
    best = near.where("sample_id is not null").select("sample_id", F.get(options, F.lit(0)).alias("b")).where("b is not null")
    return best.select("sample_id", F.col("b.id").alias("train_id"), F.exp(-F.col("b.d") / scale).alias("similarity"))


def membership(evals: DataFrame, train: DataFrame, key: str) -> DataFrame:
    """The evaluation rows with ``in_train``: whether their key stands in the training table (J19); a null key does not."""
    keys = train.where(F.col(key).isNotNull()).select(key).distinct().withColumn("__in", F.lit(True))
    return evals.join(keys, key, "left").withColumn("in_train", F.coalesce("__in", F.lit(False))).drop("__in")
