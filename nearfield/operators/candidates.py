"""Filter-and-verify similarity joins: candidates by equi-joins on tokens, bands or blocks, then the exact kernel.

A similarity predicate on a cross join stays a nested loop in Spark.  Here every strategy turns it into an
equi-join on something both sides must (or probably will) share, removes repeated candidates, and
verifies with the exact kernel.  Exact strategies: prefix filter, q-gram filter, multi-index Hamming,
inverted index, blocking.  Approximate ones, whose recall is measured in the tests: MinHash, random
hyperplanes, p-stable projections, FracMinHash.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.functions import kernels as K
from nearfield.operators.edges import grid_top_k, top_k
from nearfield.operators.skew import hot_keys, meet, meet_two, salted_join, spread
from nearfield.storage import Workspace

_EPS = 1e-9
#: Rows of one key that a block of a join holds.
BLOCK_ROWS = 5_000


def set_classes(df: DataFrame, id_col: str, set_col: str) -> tuple[DataFrame, DataFrame]:
    """``(members, classes)``: rows of equal sets share a class, named by the smallest id.

    ``members``: ``id, class_id``; ``classes``: ``class_id, items`` (sorted).  Null and empty sets are left out.
    """
    rows = df.select(F.col(id_col).alias("id"), F.array_sort(F.array_distinct(F.col(set_col))).alias("items")).where(F.size("items") > 0)
    rows = rows.withColumn("h", F.xxhash64("items"))
    classes = rows.groupBy("h", "items").agg(F.min("id").alias("class_id"))
    members = rows.join(classes, ["h", "items"]).select("id", "class_id")
    return members, classes.select("class_id", "items")


def _prefixes(classes: DataFrame, t: float) -> DataFrame:
    """``class_id, n, pos, token`` for each of the first ``n - ceil(t n) + 1`` tokens, rarest first (ties by token)."""
    single = classes.select("class_id", F.explode("items").alias("token"))
    counts = single.groupBy("token").agg(F.count("*").alias("df"))
    hot = hot_keys(single, "token", single.count())
    ordered = (
        salted_join(single, counts, "token", hot, "class_id")
        .groupBy("class_id")
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("df", "token"))), lambda x: x["token"]).alias("items"))
    )
    n = F.size("items")
    return ordered.select("class_id", n.alias("n"), F.posexplode(F.slice("items", F.lit(1), n - F.ceil(n * F.lit(t) - F.lit(_EPS)).cast("int") + 1)).alias("pos", "token"))


def prefix_jaccard(classes: DataFrame, t: float) -> DataFrame:
    """All pairs of classes with Jaccard >= t (J6): ``c1 < c2, similarity``.

    Prefix filter, size and position filters, then the exact kernel.  A prefix token whose classes are very many is
    cut into blocks that meet pairwise, so that no task holds all of them.
    """
    ws = _workspace(classes)
    p = ws.save(_prefixes(classes, t), "prefixes")
    near = F.least("n_1", "n_2") >= F.lit(t) * F.greatest("n_1", "n_2") - F.lit(_EPS)
    # at the rarest token that a pair shares, what follows it on either side must still make up the overlap
    left = F.least(F.col("n_1") - F.col("pos_1"), F.col("n_2") - F.col("pos_2"))
    near = near & (left >= F.lit(t / (1 + t)) * (F.col("n_1") + F.col("n_2")) - F.lit(_EPS))
    pairs = meet(p, "token", "class_id", ["class_id", "n", "pos"], BLOCK_ROWS, ws).where(near)
    return verify_sets(_ordered(pairs).distinct(), classes, t)


def _workspace(df: DataFrame) -> Workspace:
    return Workspace(df.sparkSession, "candidates")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("class_id_1", "class_id_2").alias("c1"), F.greatest("class_id_1", "class_id_2").alias("c2"))


def verify_sets(candidates: DataFrame, classes: DataFrame, t: float, kernel: Callable[[Column, Column], Column] = K.jaccard) -> DataFrame:
    """The candidates ``c1, c2`` whose kernel reaches ``t``, with ``similarity``."""
    a = classes.select(F.col("class_id").alias("c1"), F.col("items").alias("__a"))
    b = classes.select(F.col("class_id").alias("c2"), F.col("items").alias("__b"))
    scored = candidates.join(a, "c1").join(b, "c2").select("c1", "c2", kernel(F.col("__a"), F.col("__b")).alias("similarity"))
    return scored.where(F.col("similarity") >= F.lit(t) - F.lit(_EPS))


def class_links(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row per record: ``id, class_id, links``, the number of other classes similar to its class."""
    ends = pairs.select(F.explode(F.array("c1", "c2")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("links"))
    return members.join(ends, "class_id", "left").select("id", "class_id", F.coalesce("links", F.lit(0)).alias("links"))


def minhash_signatures(classes: DataFrame, hashes: int = 128, rows: int = 4, seed: int = 7) -> DataFrame:
    """``class_id, band, bucket``: MinHash bands (J3).  ``hashes`` must be a multiple of ``rows``."""
    if hashes % rows:
        raise ValueError("hashes must be a multiple of rows")
    rng = np.random.default_rng(seed)
    mult = rng.integers(1, 2**63, hashes, dtype="uint64") | np.uint64(1)
    add = rng.integers(0, 2**63, hashes, dtype="uint64")

    def one(tokens) -> np.ndarray:
        x = np.asarray(tokens, dtype="int64").view("uint64")
        low = np.full(hashes, np.iinfo("uint64").max, dtype="uint64")
        for at in range(0, len(x), 4096):  # long sets a piece at a time
            h = x[at : at + 4096, None] * mult + add
            h ^= h >> np.uint64(32)
            h *= np.uint64(0xD6E8FEB86659FD93)
            np.minimum(low, h.min(axis=0), out=low)
        mixed = np.zeros(hashes // rows, dtype="uint64")
        for k in range(rows):
            mixed = (mixed ^ low[k::rows]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        return mixed.view("int64")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            buckets = [one(t) for t in b["items"]]
            n = hashes // rows
            yield pd.DataFrame(
                {
                    "class_id": np.repeat(b["class_id"].to_numpy(), n),
                    "band": np.tile(np.arange(n, dtype="int32"), len(b)),
                    "bucket": np.concatenate(buckets) if buckets else np.zeros(0, dtype="int64"),
                }
            )

    kind = classes.schema["class_id"].dataType.simpleString()
    hashed = classes.select("class_id", F.transform("items", lambda t: F.xxhash64(t)).alias("items"))
    return spread(hashed, "class_id").mapInPandas(run, f"class_id {kind}, band int, bucket bigint")


def minhash_jaccard(classes: DataFrame, t: float, hashes: int = 128, rows: int = 4) -> DataFrame:
    """MinHash-LSH candidates with exact Jaccard (J3): ``c1 < c2, similarity``.

    Equal sets were folded before, so a bucket holds different sets only; a crowded one is cut into
    blocks that meet pairwise, so that no task holds all of it.  At t = 0.8 the chance to miss a pair is
    (1 - 0.8^4)^32 < 1e-7 with the defaults.
    """
    sig = minhash_signatures(classes, hashes, rows).select("class_id", F.xxhash64("band", "bucket").alias("key"))
    ws = _workspace(classes)
    pairs = meet(ws.save(sig, "signatures"), "key", "class_id", ["class_id"], BLOCK_ROWS, ws)
    return verify_sets(_ordered(pairs).distinct(), classes, t)


def _signs(vector: Column, planes: np.ndarray) -> Column:
    """Bits of the signs of the vector's products with each plane, as one number."""
    bits = [F.when(K.dot(vector, F.array(*[F.lit(float(x)) for x in p])) >= 0, F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint") for i, p in enumerate(planes)]
    out = bits[0]
    for b in bits[1:]:
        out = out + b
    return out


def sign_codes(df: DataFrame, id_col: str, vector: str, bits: int) -> DataFrame:
    """``id, code``: the signs of the first ``bits`` parts of a vector; one number, or an array of 32-bit numbers beyond 32 bits."""
    words = []
    for lo in range(0, bits, 32):
        code = F.lit(0).cast("bigint")
        for i in range(lo, min(bits, lo + 32)):
            code = code + F.when(F.col(vector)[i] >= 0, F.lit(1 << (i - lo))).otherwise(F.lit(0)).cast("bigint")
        words.append(code)
    return df.select(F.col(id_col).alias("id"), (words[0] if bits <= 32 else F.array(*words)).alias("code"))


def hyperplane_candidates(queries: DataFrame, train: DataFrame, vector: str, dims: int, bits: int = 8, tables: int = 8, seed: int = 11) -> DataFrame:
    """Pairs that share a signature in at least one table (J4, T1): ``sample_id, train_id``.

    The planes are literals of the plan (bits x tables x dims numbers).  Both sides have ``id`` and the vector.
    """
    rng = np.random.default_rng(seed)
    planes = rng.normal(size=(tables, bits, dims))
    keys = lambda df: df.select("id", F.posexplode(F.array(*[_signs(F.col(vector), planes[t]) for t in range(tables)])).alias("table", "signature"))
    a = keys(queries).withColumnRenamed("id", "sample_id")
    b = keys(train).withColumnRenamed("id", "train_id")
    return a.join(b, ["table", "signature"]).where("sample_id <> train_id").select("sample_id", "train_id").distinct()


def verify(candidates: DataFrame, queries: DataFrame, train: DataFrame, feature: str, kernel: Callable[[Column, Column], Column], least: float | None = None) -> DataFrame:
    """Candidates with the exact kernel of both sides' ``feature`` (T37); those below ``least`` are dropped."""
    a = queries.select(F.col("id").alias("sample_id"), F.col(feature).alias("__a"))
    b = train.select(F.col("id").alias("train_id"), F.col(feature).alias("__b"))
    scored = candidates.join(a, "sample_id").join(b, "train_id").select("sample_id", "train_id", kernel(F.col("__a"), F.col("__b")).alias("similarity"))
    return scored if least is None else scored.where(F.col("similarity") >= least)


def fallback_exact(edges: DataFrame, queries: DataFrame, train: DataFrame, feature: str, kernel: Callable[[Column, Column], Column]) -> DataFrame:
    """The edges, and for every query without any the exact search against all training rows; ``candidate_source`` says which."""
    from nearfield.operators.edges import all_pairs

    alone = queries.join(edges.select(F.col("sample_id").alias("id")).distinct(), "id", "left_anti")
    exact = all_pairs(alone, train, kernel, feature, "id", "id", False)
    return edges.withColumn("candidate_source", F.lit("lsh_band")).unionByName(exact.withColumn("candidate_source", F.lit("fallback_exact")))


def block_join(queries: DataFrame, train: DataFrame, keys: list[str], similarity: Column | None = None) -> DataFrame:
    """Pairs that agree on all block columns, null with null (J5); ``similarity`` of the columns ``a_*`` and ``b_*``, else 1."""
    a = queries.select(F.col("id").alias("sample_id"), *[F.col(c).alias(f"a_{c}") for c in queries.columns if c != "id"])
    b = train.select(F.col("id").alias("train_id"), *[F.col(c).alias(f"b_{c}") for c in train.columns if c != "id"])
    # the block as one struct, which is never null itself, so that blocks of nulls match and are split like any other
    name = lambda side: F.struct(*[F.col(f"{side}_{k}").alias(f"k{i}") for i, k in enumerate(keys)])
    pairs = meet_two(a.withColumn("__block", name("a")), b.withColumn("__block", name("b")), "__block", "sample_id", "train_id", BLOCK_ROWS, _workspace(train))
    return pairs.where("sample_id <> train_id").select("sample_id", "train_id", (similarity if similarity is not None else F.lit(1.0)).alias("similarity"))


def qgram_edit_join(texts: DataFrame, id_col: str, text_col: str, distance: int, q: int = 2) -> DataFrame:
    """Pairs of distinct texts within an edit distance (J7): ``a < b, edits, similarity``.

    Each edit spoils at most q of the padded q-grams, so the ``q d + 1`` rarest grams of both sides must
    share one; then length filter and the bounded edit distance.  Texts with no more grams than that are
    compared by length alone, within the short lengths where this can happen.
    """
    words = texts.where(F.col(text_col).isNotNull()).select(F.col(text_col).alias("t")).distinct().withColumn("g", K.qgrams(F.col("t"), q))
    single = words.select("t", F.explode("g").alias("gram"))
    df = single.groupBy("gram").agg(F.count("*").alias("df"))
    first = (
        salted_join(single, df, "gram", hot_keys(single, "gram", single.count()), "t")
        .groupBy("t")
        .agg(F.sort_array(F.collect_list(F.struct("df", "gram"))).alias("r"))
        .select("t", F.transform(F.slice("r", 1, q * distance + 1), lambda x: x["gram"]).alias("p"), F.size("r").alias("n"))
    )
    keyed = first.select("t", F.explode("p").alias("key")).unionByName(
        first.where(F.col("n") <= q * distance).select("t", F.explode(F.transform(F.sequence(F.length("t") - distance, F.length("t") + distance), lambda i: F.concat(F.lit("#length:"), i.cast("string")))).alias("key"))
    )
    ws = _workspace(texts)
    pairs = meet(ws.save(keyed, "keyed"), "key", "t", ["t"], BLOCK_ROWS, ws).where(F.abs(F.length("t_1") - F.length("t_2")) <= distance)
    near = pairs.select(F.least("t_1", "t_2").alias("a"), F.greatest("t_1", "t_2").alias("b")).distinct()
    scored = near.withColumn("edits", F.levenshtein("a", "b", distance)).where("edits >= 0")
    return scored.withColumn("similarity", F.greatest(F.lit(0.0), 1 - F.col("edits") / F.greatest(F.length("a"), F.length("b"))))


def hamming_radius(codes: DataFrame, bits: int, radius: int) -> DataFrame:
    """All pairs of codes within a Hamming radius (J9, T2): ``c1 < c2, distance, similarity``.

    Multi-index hashing: of radius + 1 pieces of the code at least one agrees, so the pieces are the keys
    of an equi-join, in blocks where many codes share a piece.  ``codes`` has ``id, code``: one number, or
    an array of numbers of 32 bits each for longer codes.
    """
    if not codes.schema["code"].dataType.typeName() == "array":
        codes = codes.select("id", F.array(F.col("code").bitwiseAND(F.lit(2**32 - 1)), F.shiftrightunsigned("code", 32)).alias("code"))
    pieces = radius + 1
    cuts = [round(i * bits / pieces) for i in range(pieces + 1)]
    word = lambda i: F.col("code")[i]

    def piece(lo: int, hi: int) -> Column:
        """Bits lo .. hi - 1, which stand in one word or in two and more."""
        out, shift = F.lit(0).cast("bigint"), 0
        while lo < hi:
            end = min(hi, (lo // 32 + 1) * 32)
            part = F.shiftrightunsigned(word(lo // 32), lo % 32).bitwiseAND(F.lit((1 << (end - lo)) - 1))
            out = out.bitwiseOR(F.shiftleft(part.cast("bigint"), shift)) if shift + end - lo <= 62 else F.xxhash64(out, part)
            shift += end - lo
            lo = end
        return out

    parts = F.array(*[F.xxhash64(F.lit(i), piece(cuts[i], cuts[i + 1])) for i in range(pieces)])
    keyed = codes.select("id", "code", F.explode(parts).alias("key"))
    d = K.total(F.zip_with("code_1", "code_2", lambda x, y: F.bit_count(x.bitwiseXOR(y)))).cast("int")
    near = meet(keyed, "key", "id", ["id", "code"], BLOCK_ROWS, _workspace(codes)).withColumn("distance", d).where(F.col("distance") <= radius)
    return near.select(F.least("id_1", "id_2").alias("c1"), F.greatest("id_1", "id_2").alias("c2"), "distance", (1 - F.col("distance") / bits).alias("similarity")).distinct()


#: From this share of filled cells on, sparse rows are multiplied as dense blocks.
DENSE_SHARE = 0.1
#: Rows of one side of a dense block.
DENSE_BLOCK = 2_000


def sparse_products(queries: DataFrame, train: DataFrame) -> DataFrame:
    """``sample_id, train_id, dot, low``: sums of products and of minima over shared keys of sparse rows ``id, key, weight``.

    The inverted-index join (J10, J11, T30): only shared keys are touched.  Where the training rows fill a
    tenth and more of all (row, key) cells, which is counted first, the postings of every key would hold
    most rows; then blocks of both sides are laid out as matrices and compared in numpy, with the same
    result.  Weights must be positive; pairs without a shared key are not listed.
    """
    rows = _dense_rows(train)
    if rows:
        return _dense_products(queries, train, rows)
    a = queries.select(F.col("id").alias("sample_id"), "key", F.col("weight").alias("x"))
    b = train.select(F.col("id").alias("train_id"), "key", F.col("weight").alias("y"))
    joined = meet_two(a, b, "key", "sample_id", "train_id", BLOCK_ROWS, _workspace(train)).where("sample_id <> train_id")
    return joined.groupBy("sample_id", "train_id").agg(F.sum(F.col("x") * F.col("y")).alias("dot"), F.sum(F.least("x", "y")).alias("low"))


def _dense_rows(train: DataFrame) -> int:
    """The number of rows where they fill the cells so far that they are compared as matrices, else 0."""
    size = train.agg(F.count("*").alias("cells"), F.countDistinct("id").alias("rows"), F.countDistinct("key").alias("keys")).first()
    return size["rows"] if size["cells"] and size["cells"] >= DENSE_SHARE * size["rows"] * size["keys"] else 0


def _dense_products(queries: DataFrame, train: DataFrame, rows: int) -> DataFrame:
    n, m = max(1, -(-rows // DENSE_BLOCK)), max(1, -(-queries.select("id").distinct().count() // DENSE_BLOCK))
    # other names on each side, as both may come from one table
    side = lambda df, s: df.select(F.col("id").alias(f"{s}_id"), F.col("key").alias(f"{s}_key"), F.col("weight").cast("double").alias(f"{s}_weight"))
    copies = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)).cast("array<bigint>"))
    q = side(queries, "a").withColumn("j", F.pmod(F.xxhash64("a_id"), F.lit(m))).withColumn("i", copies(n))
    t = side(train, "b").withColumn("i", F.pmod(F.xxhash64("b_id"), F.lit(n))).withColumn("j", copies(m))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        keys = pd.Index(right["b_key"].unique())
        names = []
        grids = []
        for df in (left, right):
            df = df.set_axis([c.split("_")[-1] for c in df.columns], axis=1)
            df = df[df["key"].isin(keys)]
            code, ids = pd.factorize(df["id"])
            grid = np.zeros((len(ids), len(keys)))
            np.add.at(grid, (code, keys.get_indexer(df["key"])), df["weight"].to_numpy())
            names.append(np.asarray(ids))
            grids.append(grid)
        parts = []
        for k, row in enumerate(grids[0]):
            low = np.minimum(grids[1], row).sum(axis=1)
            ok = np.flatnonzero((low > 0) & (names[1] != names[0][k]))
            parts.append(pd.DataFrame({"sample_id": np.repeat(names[0][k], len(ok)), "train_id": names[1][ok], "dot": grids[1][ok] @ row, "low": low[ok]}))
        return pd.concat(parts) if parts else pd.DataFrame({"sample_id": names[0][:0], "train_id": names[1][:0], "dot": [], "low": []})

    kinds = (queries.schema["id"].dataType.simpleString(), train.schema["id"].dataType.simpleString())
    return q.groupBy("i", "j").cogroup(t.groupBy("i", "j")).applyInPandas(run, f"sample_id {kinds[0]}, train_id {kinds[1]}, dot double, low double")


def weighted_jaccard_pairs(queries: DataFrame, train: DataFrame) -> DataFrame:
    """Generalised Jaccard of rows that share a key: sum of maxima = both sums - sum of minima."""
    total = lambda df, name: df.groupBy("id").agg(F.sum("weight").alias(name))
    pairs = sparse_products(queries, train)
    a = total(queries, "wa").withColumnRenamed("id", "sample_id")
    b = total(train, "wb").withColumnRenamed("id", "train_id")
    high = F.col("wa") + F.col("wb") - F.col("low")
    return pairs.join(a, "sample_id").join(b, "train_id").select("sample_id", "train_id", (F.col("low") / high).alias("similarity"))


def weight_lists(rows: DataFrame) -> DataFrame:
    """Sparse rows ``id, key, weight`` as one row an id: ``id, cells`` (hash of the key and weight) and ``total``."""
    cell = F.when(F.col("key").isNotNull() & F.col("weight").isNotNull(), F.struct(F.xxhash64("key").alias("k"), F.col("weight").cast("double").alias("w")))
    lists = rows.groupBy("id").agg(F.collect_list(cell).alias("c"), F.sum("weight").cast("double").alias("total"))
    return lists.select("id", F.col("c.k").alias("k"), F.col("c.w").alias("w"), "total")


def weight_matrix(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The keys of a lot of :func:`weight_lists`, the weights as a matrix of keys x rows, and the totals."""
    n = rows["k"].str.len().to_numpy()
    flat = lambda c, kind: np.concatenate([np.asarray(x, dtype=kind) for x in rows[c]])
    keys, place = np.unique(flat("k", "int64"), return_inverse=True)
    grid = np.bincount(place * len(rows) + np.repeat(np.arange(len(rows)), n), flat("w", "float64"), len(keys) * len(rows)) if len(keys) else np.zeros(0)
    return keys, grid.reshape(len(keys), len(rows)), rows["total"].to_numpy()


def _whole(grid: np.ndarray) -> bool:
    """Whether single precision adds the numbers up without rounding: whole ones below 2 ** 24 in sum."""
    return bool((grid == np.rint(grid)).all() and (not len(grid) or np.abs(grid).sum(axis=0).max(initial=0) < 2**24))


def weighted_jaccard_grid(left: tuple[np.ndarray, ...], right: tuple[np.ndarray, ...]) -> np.ndarray:
    """Generalised Jaccard of every left with every right of two weight matrices; NaN where no key is shared."""
    _, one, two = np.intersect1d(left[0], right[0], return_indices=True)
    a, b = left[1][one], right[1][two]
    kind = "float32" if _whole(a) and _whole(b) else "float64"
    a, b = a.astype(kind), b.astype(kind)
    out = np.empty((len(left[2]), len(right[2])))
    for at in range(0, len(out), 32):  # a few rows at a time stay in the cache
        low = np.zeros((min(32, len(out) - at), out.shape[1]), dtype=kind)
        least = np.empty_like(low)
        for x, y in zip(a[:, at : at + 32], b):
            low += np.minimum(x[:, None], y[None, :], out=least)
        high = left[2][at : at + 32, None] + right[2][None, :] - low
        out[at : at + 32] = np.divide(low, high, out=np.full_like(high, np.nan), where=low > 0)
    return out


def weighted_jaccard_top_k(queries: DataFrame, train: DataFrame, k: int, digits: int) -> DataFrame:
    """The ``k`` best of :func:`weighted_jaccard_pairs` for every query; dense rows are compared in blocks that list no pairs."""
    if not _dense_rows(train):
        return top_k(weighted_jaccard_pairs(queries, train), k, digits)
    ws = _workspace(train)
    lists = [ws.save(weight_lists(df), name) for df, name in ((queries, "queries"), (train, "train"))]
    return grid_top_k(*lists, weighted_jaccard_grid, k, digits, prepare=weight_matrix)


def binned(peaks: DataFrame, width: float) -> DataFrame:
    """Peaks ``id, mz, intensity`` to L2-normalised sparse rows ``id, key, weight`` (half-even bins, intensity > 0)."""
    bins = peaks.where("intensity > 0").groupBy("id", F.bround(F.col("mz") / width).cast("bigint").alias("key")).agg(F.sum("intensity").alias("s"))
    norms = bins.groupBy("id").agg(F.sqrt(F.sum(F.col("s") * F.col("s"))).alias("n"))
    return bins.join(norms, "id").select("id", "key", (F.col("s") / F.col("n")).alias("weight"))


def sparse_cosine_pairs(queries: DataFrame, train: DataFrame) -> DataFrame:
    """Cosine of normalised sparse rows that share a key."""
    return sparse_products(queries, train).select("sample_id", "train_id", F.col("dot").alias("similarity"))


def frac_minhash(classes: DataFrame, scaled: int) -> DataFrame:
    """``class_id, items``: the items whose hash is below 1 / scaled of the range (T11); sets may become empty."""
    limit = 2**63 // scaled
    return classes.select("class_id", F.filter("items", lambda t: F.xxhash64(t).bitwiseAND(F.lit(2**63 - 1)) < limit).alias("items"))


def random_fourier(df: DataFrame, id_col: str, vector: str, dims: int, features: int = 4096, gamma: float = 1.0, seed: int = 3) -> DataFrame:
    """``id, z``: random Fourier features whose dot product approximates exp(-gamma |x - y|^2).

    The error of one product is about 1 / sqrt(features), so use them to preselect and rank by the exact
    kernel afterwards (:func:`kernel_search`).
    """
    rng = np.random.default_rng(seed)
    w, shift = rng.normal(scale=math.sqrt(2 * gamma), size=(dims, features)), rng.uniform(0, 2 * math.pi, features)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 256):
                part = b.iloc[at : at + 256]
                z = math.sqrt(2 / features) * np.cos(np.stack(part["v"].to_numpy()) @ w + shift)
                yield pd.DataFrame({"id": part["id"].to_numpy(), "z": list(z)})

    return df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v")).mapInPandas(run, "id bigint, z array<double>")


def fourier_margin(features: int, products: int, chance: float = 1e-6) -> float:
    """By how much a product of Fourier features may miss the kernel, but with ``chance`` for any of ``products``.

    Bernstein's inequality: a feature's part has a variance of at most 1 and lies within 3 of the kernel.
    """
    a = math.log(2 * max(products, 1) / chance)
    return a / features + math.sqrt(a * a / (features * features) + 2 * a / features)


def kernel_search(queries: DataFrame, train: DataFrame, vector: str, dims: int, k: int, gamma: float, preselect: int, features: int = 4096) -> DataFrame:
    """Top-k under the RBF kernel, whole at any size of the table (T15, T37): the ``preselect`` best by random Fourier
    features, then the exact kernel.

    A query keeps this answer only if its k-th exact kernel exceeds what any row left out can have, the last
    approximate kernel listed plus :func:`fourier_margin`, or if no row was left out; all other queries are
    searched exactly.
    """
    from nearfield.operators.edges import dense_top_k, top_k

    ws = Workspace(train.sparkSession, "kernel-search")
    rows, asked = train.count(), queries.count()
    q, t = (random_fourier(df, "id", vector, dims, features, gamma) for df in (queries, train))
    near = ws.save(dense_top_k(q, t, "id", "id", "z", preselect, "dot").select("sample_id", "train_id", F.col("similarity").alias("approximate")), "near")
    exact = lambda a, b: F.exp(-gamma * K.total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))
    best = ws.save(top_k(verify(near.select("sample_id", "train_id"), queries, train, vector, exact), k, 10), "best")
    ends = near.groupBy("sample_id").agg(F.min("approximate").alias("last"), F.count("*").alias("listed"))
    least = best.groupBy("sample_id").agg(F.min("similarity").alias("kth"), F.count("*").alias("found"))
    all_listed = F.col("listed") < preselect
    sure = ends.join(least, "sample_id").where(all_listed | ((F.col("found") == k) & (F.col("kth") > F.col("last") + fourier_margin(features, rows * asked)))).select("sample_id")
    sure = ws.save(sure, "sure")
    kept = best.join(sure, "sample_id", "left_semi").select("sample_id", "train_id", "similarity", "rank")
    rest = queries.join(sure.select(F.col("sample_id").alias("id")), "id", "left_anti")
    return kept.unionByName(dense_top_k(rest, train, "id", "id", vector, k, "rbf", gamma))


def inner_product_transform(df: DataFrame, vector: str, largest_norm: float, query: bool) -> DataFrame:
    """Vectors for which cosine ranks as the inner product does (T19): one more part, 0 for queries."""
    rest = F.lit(0.0) if query else F.sqrt(F.greatest(F.lit(0.0), F.lit(largest_norm**2) - K.dot(F.col(vector), F.col(vector))))
    return df.withColumn(vector, F.concat(F.col(vector), F.array(rest)))


def pivot_candidates(queries: DataFrame, train: DataFrame, vector: str, pivots: list[list[float]], radius: float) -> DataFrame:
    """Pairs that the triangle inequality over pivots cannot exclude from a Euclidean radius (T25): exact.

    The first pivot's distance is cut into rings of the radius, which are the key of an equi-join on
    neighbouring rings; the other pivots are bounds in the join condition.
    """
    at = [F.array(*[F.lit(float(x)) for x in p]) for p in pivots]
    dist = lambda df: df.select("id", *[K.euclidean(F.col(vector), p).alias(f"d{i}") for i, p in enumerate(at)])
    a = dist(queries).select(F.col("id").alias("sample_id"), *[F.col(f"d{i}").alias(f"a{i}") for i in range(len(at))])
    b = dist(train).select(F.col("id").alias("train_id"), *[F.col(f"d{i}").alias(f"b{i}") for i in range(len(at))])
    ring = F.floor(F.col("a0") / radius)
    a = a.withColumn("ring", F.explode(F.array(ring - 1, ring, ring + 1)))
    b = b.withColumn("ring", F.floor(F.col("b0") / radius))
    bound = F.col("sample_id") != F.col("train_id")
    for i in range(len(at)):
        bound = bound & (F.abs(F.col(f"a{i}") - F.col(f"b{i}")) <= radius)
    return a.join(b, "ring").where(bound).select("sample_id", "train_id")


def late_interaction(queries: DataFrame, train: DataFrame) -> DataFrame:
    """MaxSim of multi-vector rows ``id, part, v`` (T23): for each query part the best cosine, summed."""
    from nearfield.operators.edges import block_pairs

    a = queries.select(F.col("id").alias("sample_id"), F.col("part").alias("pa"), F.col("v").alias("va"))
    b = train.select(F.col("id").alias("train_id"), F.col("part").alias("pb"), F.col("v").alias("vb"))
    pairs = block_pairs(a, b, "train_id").where("sample_id <> train_id")
    best = pairs.groupBy("sample_id", "train_id", "pa").agg(F.max(K.cosine(F.col("va"), F.col("vb"))).alias("m"))
    return best.groupBy("sample_id", "train_id").agg(F.sum("m").alias("similarity"))


def projection_candidates(queries: DataFrame, train: DataFrame, vector: str, dims: int, width: float, projections: int = 3, tables: int = 6, seed: int = 5) -> DataFrame:
    """p-stable LSH (T17): pairs with equal floor((a x + b) / width) in all projections of a table."""
    rng = np.random.default_rng(seed)
    a, b = rng.normal(size=(tables, projections, dims)), rng.uniform(0, width, size=(tables, projections))

    def keys(df: DataFrame, name: str) -> DataFrame:
        cells = [
            F.xxhash64(*[F.floor((K.dot(F.col(vector), F.array(*[F.lit(float(x)) for x in a[t][p]])) + float(b[t][p])) / width) for p in range(projections)])
            for t in range(tables)
        ]
        return df.select(F.col("id").alias(name), F.posexplode(F.array(*cells)).alias("table", "cell"))

    return keys(queries, "sample_id").join(keys(train, "train_id"), ["table", "cell"]).where("sample_id <> train_id").select("sample_id", "train_id").distinct()


def ivf_top_k(queries: DataFrame, train: DataFrame, vector: str, cells: int, probes: int, k: int, seed: int = 1) -> DataFrame:
    """Partitioned approximate search (T6, T9): k-means cells of the training rows, each query looks into the nearest ``probes``.

    Every training row is indexed; the means are ``cells`` vectors and stay literals.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    from nearfield.operators.edges import top_k

    model = KMeans(k=cells, seed=seed, maxIter=10, featuresCol="__f").fit(train.select(array_to_vector(F.col(vector)).alias("__f")))
    centres = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in model.clusterCenters()])
    nearest = F.array_sort(F.transform(centres, lambda c, i: F.struct(K.euclidean(F.col(vector), c).alias("d"), i.alias("cell"))))
    a = queries.select("id", vector, F.explode(F.transform(F.slice(nearest, 1, probes), lambda x: x["cell"])).alias("cell")).select(F.col("id").alias("sample_id"), F.col(vector).alias("__a"), "cell")
    b = train.select(F.col("id").alias("train_id"), F.col(vector).alias("__b"), F.get(nearest, F.lit(0))["cell"].alias("cell"))
    return top_k(a.join(b, "cell").where("sample_id <> train_id").select("sample_id", "train_id", K.spectral_angle(F.col("__a"), F.col("__b")).alias("similarity")), k, 10)


def neighbour_descent(rows: DataFrame, vector: str, k: int, rounds: int, workspace, seed: int = 0) -> DataFrame:
    """An approximate neighbour graph (T24): ``sample_id, train_id, similarity, rank``.

    Starts from pairs that share a random-hyperplane bucket and improves each list by the neighbours of
    its neighbours, both directions, ``rounds`` times; every round is written down.  The lists have at
    most ``k`` rows a node, so a round joins at most (2 k)^2 pairs a node of ordinary degree; reversed
    lists of very popular nodes are cut to 2 k by hash order, which is part of the method.
    """
    from pyspark.sql import Window

    from nearfield.operators.edges import top_k

    dims = rows.select(F.size(vector)).first()
    if dims is None:
        return rows.sparkSession.createDataFrame([], "sample_id bigint, train_id bigint, similarity double, rank int")
    first = hyperplane_candidates(rows, rows, vector, dims[0], 4, 2, seed)
    graph = workspace.save(top_k(verify(first, rows, rows, vector, K.spectral_angle), k, 10), "graph")
    for _ in range(rounds):
        out = graph.select(F.col("sample_id").alias("u"), F.col("train_id").alias("v"))
        back = out.select(F.col("v").alias("u"), F.col("u").alias("v"))
        w = Window.partitionBy("u").orderBy(F.xxhash64(F.lit(seed), "v"), "v")
        back = back.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= 2 * k).drop("__r")
        near = out.unionByName(back).distinct()
        hop = near.select(F.col("u").alias("m"), F.col("v").alias("sample_id")).join(near.select(F.col("u").alias("m"), F.col("v").alias("train_id")), "m")
        fresh = hop.where("sample_id <> train_id").select("sample_id", "train_id").distinct()
        known = graph.select("sample_id", "train_id")
        scored = verify(fresh.unionByName(known).distinct(), rows, rows, vector, K.spectral_angle)
        graph = workspace.save(top_k(scored, k, 10), "graph")
    return graph


def learned_filter(candidates: DataFrame, classes: DataFrame, t: float, sample: int = 20_000, keep: float = 0.99, seed: int = 1) -> DataFrame:
    """Candidates ``c1, c2`` that a small model does not rule out (T16), to be verified exactly afterwards.

    The features are cheap (size ratio, agreement of 32 one-bit MinHashes); a logistic regression is fitted
    on at most ``sample`` candidates whose exact similarity is computed, and its cut keeps a ``keep`` share
    of the similar ones among them.  Approximate by design: a pair below the cut is lost.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector, vector_to_array

    bits = F.aggregate(
        F.sequence(F.lit(0), F.lit(31)), F.lit(0).cast("bigint"),
        lambda acc, s: acc * 2 + F.array_min(F.transform("items", lambda x: F.xxhash64(s, x))).bitwiseAND(F.lit(1)),
    )
    sketch = classes.select("class_id", F.size("items").alias("n"), bits.alias("bits"))
    a = sketch.select(F.col("class_id").alias("c1"), F.col("n").alias("n1"), F.col("bits").alias("b1"))
    b = sketch.select(F.col("class_id").alias("c2"), F.col("n").alias("n2"), F.col("bits").alias("b2"))
    pairs = candidates.join(a, "c1").join(b, "c2").select(
        "c1", "c2", array_to_vector(F.array(F.least("n1", "n2") / F.greatest("n1", "n2"), 1 - F.bit_count(F.col("b1").bitwiseXOR(F.col("b2"))) / 32)).alias("f")
    )
    fitting = pairs.orderBy(F.xxhash64(F.lit(seed), "c1", "c2")).limit(sample)  # bounded sample for fitting only
    good = verify_sets(fitting.select("c1", "c2"), classes, t).select("c1", "c2", F.lit(1).alias("label"))
    labelled = fitting.join(good, ["c1", "c2"], "left").withColumn("label", F.coalesce("label", F.lit(0)))
    if labelled.select("label").distinct().count() < 2:
        return candidates
    model = LogisticRegression(featuresCol="f", labelCol="label", maxIter=50).fit(labelled)
    score = vector_to_array("probability")[1]
    cut = model.transform(labelled.where("label = 1")).agg(F.percentile(score, F.lit(1 - keep))).first()[0]
    return model.transform(pairs).where(score >= cut).select("c1", "c2")


def trajectory_cells(points: Column, width: float) -> Column:
    """The distinct grid cells of a trajectory ``array<array<double>>`` as tokens (T36), for any set join before an exact check."""
    return F.array_distinct(F.transform(points, lambda p: F.array_join(F.transform(p, lambda x: F.floor(x / width).cast("string")), ":")))


def salted_tokens(tokens: Column, secret: str) -> Column:
    """Tokens as keyed digests (T26): equal tokens stay equal, so set joins of two parties give the same similarities."""
    return F.transform(tokens, lambda t: F.sha2(F.concat(F.lit(secret), t.cast("string")), 256))


def label_bound_join(trees: DataFrame, distance: int) -> DataFrame:
    """Pairs of labelled structures that an edit distance bound cannot exclude (T33): ``c1 < c2, bound``, to be verified by a user's UDF.

    ``trees`` has ``id, labels`` (the multiset of node labels).  Each edit changes the multiset by at most
    one label on either side, so the larger one-sided difference is a lower bound.  Sizes within the
    distance are the key of an equi-join.
    """
    n = F.size("labels")
    a = trees.select(F.col("id").alias("c1"), F.col("labels").alias("x"), F.explode(F.sequence(n - distance, n + distance)).alias("n"))
    b = trees.select(F.col("id").alias("c2"), F.col("labels").alias("y"), n.alias("n"))
    count = lambda xs, v: F.size(F.filter(xs, lambda e: e == v))
    lack = lambda u, w: F.aggregate(F.array_distinct(u), F.lit(0), lambda acc, v: acc + F.greatest(F.lit(0), count(u, v) - count(w, v)))
    bound = F.greatest(lack(F.col("x"), F.col("y")), lack(F.col("y"), F.col("x")))
    return a.join(b, "n").where("c1 < c2").select("c1", "c2", bound.alias("bound")).where(F.col("bound") <= distance)
