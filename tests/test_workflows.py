"""Grids of splits, runners, further indexes and round trips on small tables."""

import math
import random
from functools import cache

import pytest
from pyspark.sql import functions as F

from nearfield.functions import kernels as K
from nearfield.operators import candidates as C
from nearfield.operators import edges as E
from nearfield.operators import indexes as I
from nearfield.operators import splits as S
from nearfield.operators import workflows as W
from nearfield.sources import readers, sinks
from nearfield.streaming import streams


@pytest.fixture()
def graph(spark):
    rng = random.Random(1)
    pairs = {tuple(sorted(rng.sample(range(60), 2))): rng.random() for _ in range(150)}
    edges = spark.createDataFrame([(i, j, w) for (i, j), w in pairs.items()], "i bigint, j bigint, w double")
    return edges, spark.range(60), pairs


def test_grid_keeps_what_each_cell_demands(spark, workspace, graph):
    edges, nodes, pairs = graph
    splits, stats = W.split_grid(edges, nodes, (0.0, 0.5, 1.0), 2, workspace, 0.4)
    rows = {}
    for r in splits.collect():
        rows.setdefault((r.param, r.repeat), {})[r.sample_id] = r.split
    assert set(rows) == {(p, r) for p in (0.0, 0.5, 1.0) for r in (0, 1)}
    for (param, _), side in rows.items():
        assert sum(s == "test" for s in side.values()) == math.ceil(0.2 * len(side))
        adjacent = [p for p, w in pairs.items() if w > 0.4 and p[0] in side and p[1] in side]
        assert (len(side) == 60) == (param == 0) and (not adjacent if param == 1 else adjacent)
    for r in stats.collect():
        side = rows[r.param, r.repeat]
        near = {a for i, j in pairs for a, b in ((i, j), (j, i)) if pairs[i, j] > 0.4 and side.get(a) == "train" and side.get(b) == "test"}
        assert (r.train_size + r.test_size, r.num_similar) == (len(side), len(near)) and r.cross_split_overlap == pytest.approx(len(near) / r.train_size)
    done = stats.where("param < 1").select("param", "repeat")
    _, rest = W.split_grid(edges, nodes, (0.0, 0.5, 1.0), 2, workspace, 0.4, done)
    assert {(r.param, r.repeat) for r in rest.collect()} == {(1.0, 0), (1.0, 1)}
    curve = {r.spectral_parameter: r for r in W.grid_curve(stats).collect()}
    assert curve[0.0].repeats == 2 and curve[1.0].cross_split_overlap == 0


def test_grid_refuses_dense_graphs_and_leaves_small_ones_alone(spark, workspace):
    full = spark.createDataFrame([(i, j, 0.9) for i in range(8) for j in range(i + 1, 8)], "i bigint, j bigint, w double")
    with pytest.raises(ValueError, match="dense"):
        W.split_grid(full, spark.range(8), (1.0,), 1, workspace)
    splits, stats = W.split_grid(full.where("i = 0"), spark.range(10), (0.0,), 1, workspace)
    assert splits.count() == 0 and [r.status for r in stats.collect()] == ["too_small"]
    weighted = W.grid_cells(full, spark.range(9), (0.0, 1.0), 1, None).orderBy("cell").collect()
    assert [(r.limit, r.chance) for r in weighted] == [(0.9, 1.0), (0.0, 1.0)]
    with pytest.raises(ValueError):
        W.grid_cells(full, spark.range(9), (2.0,), 1, None)


def test_least_degree_comes_first(spark, workspace):
    star = spark.createDataFrame([(0, i, 1.0) for i in range(1, 7)], "i bigint, j bigint, w double")
    for seed in range(3):
        kept = {r.id for r in S.independent_set(star, spark.range(7), 1.0, 0.5, workspace, seed, least_degree=True).collect()}
        assert kept == {1, 2, 3, 4, 5, 6}


def test_packing_walks_like_one_task(spark, workspace, monkeypatch):
    monkeypatch.setattr("nearfield.functions.features.RUNNING_ROWS", 7)
    rng = random.Random(3)
    for n in (0, 5, 30, 400):
        sizes = []
        while sum(sizes) < n:
            sizes.append(min(n - sum(sizes), rng.choice([1, 1, 1, 2, max(1, n // 15), max(1, n // 6)])))
        rows = [(k, s, k, rng.choice([None, float("nan"), 0.1, 0.5]), rng.choice([None, 0.1, 0.2])) for k, s in enumerate(sizes)]
        table = spark.createDataFrame(rows, "component int, size bigint, min_id int, external_max double, external_mean double")
        target, least, most = round(0.2 * n), math.ceil(0.15 * n - 1e-9), math.floor(0.25 * n + 1e-9)
        key = lambda r: (r[3] is None or r[3] != r[3], -(r[3] or 0) if r[3] == r[3] else 0, r[4] is None, -(r[4] or 0), r[1], r[2])
        want, total = set(), 0
        for r in sorted(rows, key=key):
            if r[1] <= most and total < target and total + r[1] <= most:
                want.add(r[0])
                total += r[1]
        chosen, status = S.pack_components(table, n, workspace)
        assert {r.component for r in chosen.collect()} == want and status == ("valid" if least <= total <= most else "invalid_test_size")


def test_composition_and_recommendation(spark):
    split = spark.createDataFrame([(1, "train"), (2, "train"), (3, "test"), (4, "test"), (5, "test")], "sample_id int, split string")
    rows = spark.createDataFrame([(1, 1, "a"), (2, None, None), (3, 0, "a"), (4, 1, "b"), (5, None, None), (9, 1, "b")], "sample_id int, y int, s string")
    r = W.composition(split, rows, "y", "s").first()
    assert (r.train_labels, r.train_positives, r.test_labels, r.test_rate, r.test_groups, r.shared_groups, r.group_overlap) == (1, 1, 2, 0.5, 2, 1, 0.5)
    sweep = spark.createDataFrame([("easy", "valid", 0.9, 0.5), ("mid", "valid", 0.6, 0.5), ("odd", "valid", 0.3, 0.9), ("bad", "invalid_test_size", 0.1, 0.5)], "split_id string, status string, mean_max double, test_rate double")
    baseline = spark.createDataFrame([("easy", 0.9), ("mid", 0.7), ("odd", 0.6), ("bad", 0.5)], "split_id string, roc_auc double")
    out = {r.split_id: r for r in W.with_recommendation(sweep, baseline, 0.5).collect()}
    assert [k for k, r in out.items() if r.recommended] == ["mid"] and out["bad"].roc_auc is None
    none = {r.split_id: r.recommended for r in W.with_recommendation(sweep, baseline.where("false"), 0.5).collect()}
    assert [k for k, v in none.items() if v] == ["odd"]  # nothing is known of the baseline: the valid split of least similarity


def test_scores_against_the_first_row_and_area_by_hand(spark):
    rows = [("x", "all_eval", 0.1, 1.0, 100), ("x", "mid", 0.5, 1.2, 80), ("x", "hard", 0.9, 1.5, 60), ("x", "tiny", 0.95, 9.0, 3), ("y", "all_eval", 0.1, 1.0, 5), ("y", "mid", 0.5, 0.5, 4), ("z", "all_eval", 0.1, None, 50)]
    curves = spark.createDataFrame(rows, "axis string, subset string, mean_novelty double, rmse double, test_size bigint")
    got = {r.axis: r for r in W.score_against_first(curves).collect()}
    assert (got["x"].status, got["x"].points) == ("monotonic_supported", 3) and got["x"].last_delta == pytest.approx(0.5)
    assert (got["y"].status, got["y"].points, got["z"].status, got["z"].points) == ("not_explanatory", 2, "not_evaluable", 0)
    area = W.support_area(spark.createDataFrame([(1.0, 0.0), (0.5, 1.0), (0.5, 3.0), (None, 1.0), (0.0, 1.0)], "support double, score double")).first()
    assert area.computed and area.point_count == 4 and area.value == pytest.approx(0.25 + 0 + 1.0)
    assert not W.support_area(spark.createDataFrame([(1.0, 1.0)], "support double, score double")).first().computed


def test_contiguous_holdout(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(11)] + [(99, None)], "id int, p double")
    got = {r.sample_id: r.split for r in W.contiguous_holdout(df, "id", "p", 0.4).collect()}
    assert {k for k, v in got.items() if v == "test"} == {3, 4, 5, 6, 7} and 99 not in got


def tree(rng, n):
    return [rng.choice("abc") for _ in range(n)], [None if k == 0 else rng.randrange(k) for k in range(n)]


def plain_tree_distance(a, b):
    def nested(t):
        labels, parents = t
        build = lambda k: (labels[k], tuple(build(c) for c in range(len(parents)) if parents[c] == k))
        return tuple(build(k) for k in range(len(parents)) if parents[k] is None)

    @cache
    def size(f):
        return sum(1 + size(c) for _, c in f)

    @cache
    def d(f, g):
        if not f or not g:
            return size(f) + size(g)
        (x, fc), (y, gc) = f[-1], g[-1]
        return min(d(f[:-1] + fc, g) + 1, d(f, g[:-1] + gc) + 1, d(f[:-1], g[:-1]) + d(fc, gc) + (x != y))

    return d(nested(a), nested(b))


def test_tree_distance_and_join(spark, workspace):
    rng = random.Random(7)
    trees = [tree(rng, rng.randint(1, 7)) for _ in range(40)] + [([], [])]
    for _ in range(120):
        a, b = rng.choice(trees), rng.choice(trees)
        assert I.tree_distance(a, b) == plain_tree_distance(a, b)
    df = spark.createDataFrame([(k, *t) for k, t in enumerate(trees)], "id int, labels array<string>, parents array<int>")
    want = {(i, j) for i in range(40) for j in range(i + 1, 40) if plain_tree_distance(trees[i], trees[j]) <= 2}
    got = {(r.c1, r.c2) for r in I.tree_edit_join(df, 2, workspace).collect() if r.c2 < 40}
    assert got == want


def test_trajectories_match_brute_force(spark, workspace):
    rng = random.Random(8)
    rows = [(k, [[rng.uniform(0, 4), rng.uniform(0, 4)] for _ in range(rng.randint(1, 3))]) for k in range(60)] + [(90, []), (91, None)]
    df = spark.createDataFrame(rows, "id int, points array<array<double>>")
    far = lambda x, y: max(min(math.dist(p, q) for q in y) for p in x)
    want = {(a, b) for a, x in rows for b, y in rows if a < b and x and y and max(far(x, y), far(y, x)) <= 1.0}
    assert {(r.c1, r.c2) for r in I.trajectory_join(df, 1.0, workspace).collect()} == want


def test_quantised_search_and_weighted_minhash_recall(spark, workspace):
    rng = random.Random(9)
    centres = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(20)]
    rows = [(k, [x + rng.gauss(0, 0.4) for x in rng.choice(centres)]) for k in range(400)]
    df = spark.createDataFrame(rows, "id bigint, v array<double>")
    queries = df.where("id % 20 = 0")
    exact = E.dense_top_k(queries, df, "id", "id", "v", 5)
    report = {r.method: r.recall for r in I.recall_report({"pq": I.pq_search(queries, df, "v", 4, 5, 40, 32)}, exact).collect()}
    assert report["pq"] >= 0.9
    base = [{f"k{rng.randint(0, 300)}": rng.randint(1, 9) for _ in range(12)} for _ in range(20)]
    bags = [(k, key, float(w)) for k in range(200) for key, w in base[k % 20].items() if rng.random() > 0.1]
    sparse = spark.createDataFrame(bags, "id bigint, key string, weight double")
    q = sparse.where("id % 20 < 2")
    true = C.weighted_jaccard_pairs(q, sparse).where("similarity >= 0.6")
    near = I.weighted_minhash_candidates(q, sparse)
    assert I.recall_report({"wm": near}, true).first().recall >= 0.9 and near.count() < 0.5 * 20 * 200


def test_hamming_topk_salted_links_and_composite(spark, workspace):
    codes = spark.createDataFrame([(1, 0b1100), (2, 0b1000), (3, 0b0011)], "id int, code bigint")
    assert [(r.train_id, r.distance, r.similarity) for r in I.hamming_topk(codes.where("id = 1"), codes, 4, 1).collect()] == [(2, 1, 0.75)]
    sets = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["a", "b", "c"]), (3, ["a", "b"]), (4, ["x"]), (5, [])], "id int, items array<string>")
    got = sorted((r.c1, r.c2, round(r.similarity, 3)) for r in I.links_of_salted(sets, 0.6, "s", workspace).collect())
    assert got == [(1, 2, 1.0), (1, 3, 0.667), (2, 3, 0.667)]
    rows = spark.createDataFrame([(k, [math.cos(k), math.sin(k)], "x" if k % 2 else None) for k in range(12)], "id bigint, v array<double>, label string")
    near = I.multimodal_search(rows.where("id < 3"), rows, "label", "v", 2, (1.0, 1.0), 3)
    assert near.groupBy("sample_id").count().count() == 3 and near.where("sample_id = train_id").count() == 0


def test_files_and_triangles(spark, workspace, tmp_path, graph):
    edges, _, pairs = graph
    path = f"file://{tmp_path}/chunks"
    n = sinks.write_edge_chunks(edges, path, 4)
    assert n == len(pairs) == readers.read_edge_chunks(spark, path, n).count()
    with pytest.raises(ValueError):
        readers.read_edge_chunks(spark, path, n + 1)
    for nodes in (2, 3, 50):
        places = spark.range(nodes * (nodes - 1) // 2).select(F.col("id").alias("place"), F.lit(1.0).alias("w"))
        assert sorted((r.i, r.j) for r in readers.read_flattened(places, nodes).collect()) == [(i, j) for i in range(nodes) for j in range(i + 1, nodes)]
    a, b = spark.createDataFrame([(1, "x")], "k int, a string"), spark.createDataFrame([(2, 0.5)], "k int, b double")
    assert [tuple(r) for r in sinks.union_of_keys([a, b]).orderBy("k").collect()] == [(1, "x", None), (2, None, 0.5)]
    points = spark.range(5).select(F.col("id").cast("double").alias("mean_novelty"), F.lit("s").alias("subset"))
    assert len(sinks.curve_rows(points)) == 5


def test_too_many_curve_points_are_refused(spark, monkeypatch):
    monkeypatch.setattr(sinks, "MOST_POINTS", 3)
    with pytest.raises(ValueError):
        sinks.curve_rows(spark.range(4).select(F.col("id").cast("double").alias("mean_novelty"), F.lit("s").alias("subset")))


def test_stream_pairs_equal_the_batch(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.randint(0, 3), k, f"2024-01-01 {rng.randint(0, 23):02d}:{rng.randint(0, 59):02d}:00") for k in range(60)]
    left = spark.createDataFrame(rows[:30], "user int, a int, at string").select("user", "a", F.col("at").cast("timestamp").alias("left_ts"))
    right = spark.createDataFrame(rows[30:], "user int, b int, at string").select("user", "b", F.col("at").cast("timestamp").alias("right_ts"))
    want = {(r.a, r.b) for r in streams.stream_pairs(left, right, "user", "left_ts", "right_ts", "2 hours").collect()}
    assert want == {(x.a, y.b) for x in left.collect() for y in right.collect() if x.user == y.user and 0 <= (y.right_ts - x.left_ts).total_seconds() <= 7200}
    for name, df in (("l", left), ("r", right)):
        df.write.parquet(f"{tmp_path}/{name}")
    streamed = streams.stream_pairs(streams.read_events(spark, f"{tmp_path}/l", left.schema), streams.read_events(spark, f"{tmp_path}/r", right.schema), "user", "left_ts", "right_ts", "2 hours")
    out = streams.run_to_end(streamed.select("a", "b"), "pairs", "append", f"{tmp_path}/checkpoint")
    assert {(r.a, r.b) for r in out.collect()} == want
    assert streams.late_rows([{"stateOperators": [{"numRowsDroppedByWatermark": 2}, {}]}, {"stateOperators": None}]) == 2


def test_similarity_of_a_missing_side_is_null(spark):
    df = spark.createDataFrame([(None, [1.0]), ([1.0], [1.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(K.cosine(F.col("a"), F.col("b"))).collect()] == [None, pytest.approx(1.0)]


def test_shared_folder_of_the_session(spark, workspace):
    from types import SimpleNamespace

    from nearfield import storage

    assert storage.is_local(spark)
    context = SimpleNamespace(master="yarn", getCheckpointDir=lambda: "hdfs://n/own/")
    for known, want in (("s3a://b/shared/", "s3a://b/shared"), (None, "hdfs://n/own")):
        session = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default, known=known: known), sparkContext=context)
        assert storage.shared_dir(session) == want
    kept = workspace.save(spark.range(3), "rows", rows=F.count("*"))
    assert kept.count() == storage.metric(kept, "rows") == 3
    workspace.drop(kept)
    with pytest.raises(Exception):
        spark.read.parquet(kept._nearfield_path).count()


def test_a_cluster_without_a_shared_folder_is_refused():
    from types import SimpleNamespace

    from nearfield import storage

    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        session = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default), sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None))
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            storage.shared_dir(session)
