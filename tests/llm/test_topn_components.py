"""Top N per group and connected components against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from nearfield.llm import components, topn

EDGE = "sample_id string, train_id string, similarity double, rank int"


def brute(rows, n):
    best = {}
    for s, t, v, _ in rows:
        if s is None or t is None or v is None or v != v or not 0 <= v <= 1 or s == t:
            continue
        best[s, t] = max(v, best.get((s, t), -1))
    groups = {}
    for (s, t), v in best.items():
        groups.setdefault(s, []).append((-v, t))
    return {(s, t, i + 1) for s, xs in groups.items() for i, (_, t) in enumerate(sorted(xs)[:n])}


@pytest.fixture()
def rows():
    rng = random.Random(1)
    out = [("hot", f"t{rng.randint(0, 900):04d}", rng.choice([0.1, 0.5, 0.5, 0.9, rng.random()]), 0) for _ in range(1500)]
    out += [(f"s{rng.randint(0, 80)}", f"t{rng.randint(0, 40):04d}", rng.choice([0.5, rng.random()]), 1) for _ in range(1500)]
    out += [(None, "t1", 0.5, 0), ("s1", None, 0.5, 0), ("s1", "t1", None, 0), ("s1", "t2", float("nan"), 0), ("s1", "t3", 1.5, 0), ("s1", "s1", 0.9, 0)]
    return out


@pytest.mark.parametrize("hot_rows", [100, 20_000])
def test_top_n_matches_brute_force_with_and_without_hot_groups(spark, rows, hot_rows, monkeypatch):
    monkeypatch.setattr(topn, "HOT_GROUP_ROWS", hot_rows)
    got = topn.nearest_train_rows(spark.createDataFrame(rows, EDGE).repartition(5), 10).collect()
    assert {(r.sample_id, r.train_id, r.rank) for r in got} == brute(rows, 10)
    assert len(got) == len(brute(rows, 10))


def test_hot_group_takes_the_range_sorted_path(spark, rows, monkeypatch):
    monkeypatch.setattr(topn, "HOT_GROUP_ROWS", 100)
    plan = topn.nearest_train_rows(spark.createDataFrame(rows, EDGE))._jdf.queryExecution().toString()
    assert "rangepartitioning" in plan.lower() or "RepartitionByExpression" in plan


def test_top_n_of_nothing(spark):
    assert topn.nearest_train_rows(spark.createDataFrame([], EDGE)).count() == 0


def union_find(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def graphs():
    rng = random.Random(3)
    chain = [(f"{i:05d}", f"{i + 1:05d}") for i in range(300)]
    rng.shuffle(chain)
    star = [("00000", f"x{i}") for i in range(200)]
    ring = [(f"r{i}", f"r{(i + 1) % 50}") for i in range(50)]
    loose = [(f"n{rng.randint(0, 400)}", f"n{rng.randint(0, 400)}") for _ in range(250)]
    zigzag = [(f"z{i:03d}", f"z{999 - i:03d}") for i in range(400)] + [(f"z{999 - i:03d}", f"z{i + 1:03d}") for i in range(400)]
    return {"chain": chain, "star": star, "ring": ring, "loose": loose, "zigzag": zigzag, "all": chain + star + ring + loose + zigzag}


@pytest.mark.parametrize("name", list(graphs()))
def test_components_match_union_find(spark, workspace, name):
    edges = graphs()[name]
    df = spark.createDataFrame([(a, b, "extra") for a, b in edges + edges[:5]], "a string, b string, group_id string")
    got = {r.record_id: r.group_id for r in components.connected_components(df, workspace).collect()}
    assert got == union_find([e for e in edges if e[0] != e[1]])


def test_consolidate_ignores_weak_invalid_and_null_edges(spark, workspace):
    rows = [("a", "b", 0.8, 0), ("b", "c", 0.79, 0), ("c", "d", None, 0), ("d", "e", float("nan"), 0), (None, "f", 0.9, 0), ("g", "g", 1.0, 0), ("b", "h", 0.95, 0), ("x", "y", 1.2, 0)]
    got = components.consolidate(spark.createDataFrame(rows, EDGE), workspace).collect()
    assert {(r.record_id, r.group_id) for r in got} == {("a", "a"), ("b", "a"), ("h", "a")}


def test_no_edges(spark, workspace):
    out = components.consolidate(spark.createDataFrame([], EDGE), workspace)
    assert out.columns == ["record_id", "group_id"] and out.count() == 0


def test_hot_vertex_is_salted(spark, workspace, monkeypatch):
    monkeypatch.setattr(components, "hot_keys", lambda df, key, total: df.groupBy(key).count().where("count > 20").select(key))
    edges = [("hub", f"v{i}") for i in range(150)] + [(f"v{i}", f"w{i}") for i in range(150)]
    big = spark.createDataFrame(edges, "a string, b string")
    got = {r.record_id: r.group_id for r in components.connected_components(big.select(F.col("a"), "b"), workspace).collect()}
    assert got == union_find(edges)
