"""Searches that keep the best of each block instead of listing all pairs, against brute force."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.functions import kernels as K
from nearfield.operators import assays as A
from nearfield.operators import candidates as C
from nearfield.operators import edges as E
from nearfield.operators import setblocks as SB

NAMES = ["sample_id", "train_id"]


@pytest.fixture(autouse=True)
def _small(monkeypatch):
    monkeypatch.setattr(E, "GRID_LOT", (7, 16))
    monkeypatch.setattr(E.grid_blocks, "__defaults__", ((20, 64),))


def ranked(pairs, k):
    rows = {}
    for (a, b), s in pairs.items():
        rows.setdefault(a, []).append((-round(s, 9), b))
    return {(a, b, i + 1, -s) for a, found in rows.items() for i, (s, b) in enumerate(sorted(found)[:k])}


def same(df, want):
    got = {(r.sample_id, r.train_id, r["rank"]): r.similarity for r in df.collect()}
    assert got.keys() == {w[:3] for w in want}
    assert all(abs(got[w[:3]] - w[3]) < 1e-8 for w in want)


def listed(df, pairs_of):
    """The rows that the plan writes between the tasks that score and the ranking: none of them all pairs."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan, pairs_of


def test_tanimoto_topk(spark):
    rng = np.random.default_rng(3)
    sets = {i: [] if i % 40 == 0 else sorted(set(rng.integers(0, 12, rng.integers(1, 8)).tolist())) for i in range(150)}
    df = spark.createDataFrame(list(sets.items()), "id long, items array<long>")
    jac = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else 1.0
    want = ranked({(i, j): jac(sets[i], sets[j]) for i in range(0, 150, 5) for j in range(150) if i != j}, 4)
    out = E.grid_top_k(df.where("id % 5 = 0"), df, SB.jaccard_lots, 4, 9)
    same(out, want)
    listed(out, "tanimoto")


def test_metadata_mixed_topk(spark):
    rows = [(i, [None, float("nan"), float(i % 13), 1.5 * i][i % 4], [None, "a", "7", "b"][i * 7 % 4], i % 5) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, x double, t string, n int")
    left, right = (df.select([F.col(c).alias(f"{p}{c}") for c in df.columns]) for p in ("a", "b"))
    kernel = K.mixed_metadata([(F.col(f"a{c}"), F.col(f"b{c}")) for c in "xtn"])
    pairs = left.where("aid % 10 = 0").crossJoin(right).where("aid <> bid").select(F.col("aid").alias("sample_id"), F.col("bid").alias("train_id"), kernel.alias("similarity"))
    out = E.mixed_top_k(df.where("id % 10 = 0"), df, list("xtn"), 3, 9)
    same(out, {(r.sample_id, r.train_id, r["rank"], r.similarity) for r in E.top_k(pairs, 3, 9).collect()})
    listed(out, "metadata")


def test_weighted_jaccard_topk(spark):
    rng = np.random.default_rng(4)
    rows = [(i, f"k{k}", float(rng.integers(1, 9))) for i in range(130) for k in range(6) if rng.random() < 0.6] + [(3, None, 2.0)]
    df = spark.createDataFrame(rows, "id long, key string, weight double")
    queries = df.where("id % 10 = 0")
    out = C.weighted_jaccard_top_k(queries, df, 5, 9)
    same(out, {(r.sample_id, r.train_id, r["rank"], r.similarity) for r in E.top_k(C.weighted_jaccard_pairs(queries, df), 5, 9).collect()})
    listed(out, "weighted")


def test_nearest_molecule_grid(spark):
    rng = np.random.default_rng(5)
    text = lambda: "".join(rng.choice(list("CNO=é😀"), rng.integers(0, 9)))
    train, queries = [(f"t{i:03}", text()) for i in range(140)] + [("t9", None)], [(f"q{i}", text()) for i in range(30)] + [("q-", None), ("q+", "zzzz")]
    grams = lambda t: {g for n in (2, 3, 4) for g in ([t] if len(t) < n else [t[i : i + n] for i in range(len(t) - n + 1)])}
    want = {}
    for q, t in queries:
        near = [] if t is None else sorted((-len(grams(t) & grams(u)) / len(grams(t) | grams(u)), i) for i, u in train if u is not None)
        want[q] = (near[0][1], -near[0][0]) if near else (None, 0.0)
    out = A.nearest_molecule(spark.createDataFrame(queries, "id string, s string"), spark.createDataFrame(train, "id string, s string"), "s")
    got = {r.sample_id: (r.train_id, r.similarity) for r in out.collect()}
    assert got.keys() == want.keys() and all(got[q][0] == want[q][0] and abs(got[q][1] - want[q][1]) < 1e-9 for q in want)
    listed(out, "molecules")


@pytest.mark.parametrize("name", ["tanimoto_topk", "component_jaccard_topk", "weighted_jaccard_topk", "metadata_mixed", "nearest_molecule"])
def test_queries_list_no_pairs(spark, name):
    import __spark_entry__

    if not Path("/root/testdata/sf0.001").exists():
        pytest.skip("no test data")
    plan = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().analyzed().toString()
    assert "FlatMapCoGroupsInPandas" in plan and "array_intersect" not in plan


def test_weighted_minhash_counts_list_no_pairs(spark, workspace, monkeypatch):
    from nearfield.operators import indexes as I

    rng = np.random.default_rng(6)
    rows = [(i, f"k{k}", float(rng.integers(1, 9))) for i in range(90) for k in range(12) if rng.random() < 0.4]
    df = spark.createDataFrame(rows, "id long, key string, weight double")
    queries = df.where("id % 10 = 0")
    pairs = lambda d: {(r.sample_id, r.train_id) for r in d.collect()}
    exact, near = pairs(C.weighted_jaccard_pairs(queries, df).where("similarity >= 0.4")), pairs(I.weighted_minhash_candidates(queries, df, 16, 2))
    monkeypatch.setattr(I, "GRID_LOT", (7, 16))
    assert I.weighted_minhash_counts(queries, df, 16, 2, 0.4, workspace) == {"exact": len(exact), "near": len(near), "both": len(exact & near)}


def test_weighted_minhash_recall_takes_all_customers(spark, workspace, monkeypatch, tmp_path):
    """Also those whose key 50 does not divide, in several blocks of folded rows."""
    from nearfield.operators import indexes as I
    from nearfield.plans import datasets as D
    from nearfield.plans import workflow_queries as Q

    rng = np.random.default_rng(8)
    rows = [(i, f"k{k}", float(rng.integers(1, 9))) for i in range(1, 90) for k in range(40) if rng.random() < 0.1] + [(95, "k1", 0.0), (96, "k2", None), (97, None, 2.0), (None, "k3", 1.0)]
    rows += [(i + 100, k, w) for i, k, w in rows if i is not None and i % 3 == 0]  # copies
    rows = [r for r in rows if r[0] not in (50, 150)]
    df = spark.createDataFrame(rows, "id long, key string, weight double")
    pairs = lambda d: {(r.sample_id, r.train_id) for r in d.collect() if None not in r[:2]}
    exact, near = pairs(C.weighted_jaccard_pairs(df, df).where("similarity >= 0.5")), pairs(I.weighted_minhash_candidates(df, df, 96, 2))
    n = len({r[0] for r in rows} - {None})
    monkeypatch.setattr(I, "GRID_LOT", (7, 16))
    monkeypatch.setattr(I, "COUNT_BLOCK", (10, 25))
    monkeypatch.setattr(D, "customer_brands", lambda spark, d: df)
    got = Q.weighted_minhash_recall(spark, "").first()
    assert 0 < len(exact & near) < len(near) < n * (n - 1) and (got.recall, got.candidate_share) == (round(len(exact & near) / len(exact), 6), round(len(near) / (n * (n - 1)), 6))
    with pytest.raises(Exception, match="queries and training rows differ"):
        I.weighted_minhash_counts(df.where("id < 9").withColumn("weight", F.col("weight") + 1), df, 96, 2, 0.5, workspace)


def test_weighted_minhash_draws_where_a_list_stands(spark):
    """The same samples as from a row for each key and hash, which the plan has no more."""
    from nearfield.operators import indexes as I

    rng = np.random.default_rng(9)
    rows = [(i, f"k{k}", float(rng.integers(1, 9))) for i in range(60) for k in range(15) if rng.random() < 0.4]
    rows += [(1, None, 50.0), (2, "k1", 9.0), (70, "k1", 0.0), (71, "k2", None), (72, None, 3.0), (73, "k1", float("inf")), (73, "k0", float("inf")), (74, "k3", float("nan")), (74, "k9", 1.0), (75, "k3", float("nan"))]
    df = spark.createDataFrame(rows, "id long, key string, weight double")
    found = I.weighted_minhash(df, 12, 3)
    assert "sequence(" not in found._jdf.queryExecution().analyzed().toString()
    u = (F.xxhash64(F.lit(5), "key", "h").bitwiseAND(F.lit(2**52 - 1)).cast("double") + 1) / float(2**52 + 1)
    drawn = df.where("weight > 0").withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(11)))).groupBy("id", "h").agg(F.min_by("key", F.struct(-F.log(u) / F.col("weight"), "key")).alias("k"))
    want = {}
    for r in drawn.collect():
        want.setdefault((r.id, r.h // 3), {})[r.h] = r.k
    keys = {}
    for (i, b), k in want.items():
        keys.setdefault((b, tuple(sorted(k.items()))), set()).add(i)
    got = {}
    for r in found.collect():
        got.setdefault(r.key, set()).add(r.id)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, keys.values()))
