"""Core operators on small fixtures, with nulls, ties, repeated rows and empty tables."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from nearfield.functions import kernels as K
from nearfield.functions import metrics as M
from nearfield.operators import advanced as A
from nearfield.operators import candidates as C
from nearfield.operators import curve, nested, registry
from nearfield.operators import edges as E
from nearfield.operators import graph as G
from nearfield.operators import skew
from nearfield.operators import splits as S
from nearfield.plans import planner, strategies
from nearfield.sources import readers, sinks

EDGES = [("e0", "t0", 1.0), ("e0", "t1", 0.5), ("e1", "t0", 0.6), ("e1", "t1", 0.7), ("e2", "t0", 0.1), ("e2", "t1", 0.2), ("e3", "t0", 0.8), ("e3", "t1", 0.4)]
EVAL = [("e0", 1.0, 1.1), ("e1", 4.0, 2.8), ("e2", 0.2, 0.7), ("e3", 0.5, 0.55)]


@pytest.fixture()
def edges(spark):
    return spark.createDataFrame(EDGES, "sample_id string, train_id string, similarity double")


@pytest.fixture()
def evals(spark):
    return spark.createDataFrame(EVAL, "sample_id string, y_true double, y_pred double")


# ---- nested records ---------------------------------------------------------------------------------------


def brute_checkpoints(payload):
    """An independent recursion over the same rules."""

    def opened(v):
        while isinstance(v, str) and v.strip()[:1] in ("{", "["):
            try:
                v = json.loads(v)
            except ValueError:
                break
        return v

    def listed(v):
        v = opened(v)
        return [] if v is None else v if isinstance(v, list) else [v]

    out = []

    def walk(value, path, fid, no, mode):
        for i, c in enumerate(listed(value)):
            c = opened(c)
            if c is None:
                continue
            here = [*path, i]
            source = c.get("source_url_or_repo") if isinstance(c, dict) else c
            if isinstance(source, str) and source.strip():
                out.append((fid, no, mode, ".".join(map(str, here)), source))
            if isinstance(c, dict):
                walk(c.get("derived_from"), here, fid, no, mode)

    try:
        root = json.loads(payload)
    except (TypeError, ValueError):
        return []
    if not isinstance(root, dict):
        return []
    for r in listed(root.get("provenance")):
        r = opened(r)
        if isinstance(r, dict):
            for no, m in enumerate(listed(r.get("model_source"))):
                m = opened(m)
                if isinstance(m, dict):
                    walk(m.get("weights_or_checkpoint"), [], r.get("finding_id"), no, m.get("execution_mode") or "")
    return out


def payloads():
    rng = random.Random(1)

    def checkpoint(depth):
        kind = rng.random()
        if kind < 0.1:
            return None
        if kind < 0.25:
            return rng.choice(["org/repo", "  ", "{broken", "x y"])
        c = {"filename": "w.bin", "bytes_reported": rng.choice([1, "2", None])}
        if rng.random() < 0.8:
            c["source_url_or_repo"] = rng.choice(["a/b", "", None, " padded "])
        if rng.random() < 0.3:
            c["mirror"] = {"source_url_or_repo": "never"}
        if depth < 4 and rng.random() < 0.6:
            c["derived_from"] = several(depth + 1)
        return json.dumps(c) if rng.random() < 0.2 else c

    def several(depth):
        items = [checkpoint(depth) for _ in range(rng.randint(0, 3))]
        value = items[0] if items and rng.random() < 0.4 else items
        return json.dumps(value) if isinstance(value, list) and rng.random() < 0.2 else value

    def model():
        m = {"name": "m", "source_url_or_repo": "not/a/checkpoint"}
        if rng.random() < 0.8:
            m["execution_mode"] = rng.choice(["new", None, ""])
        if rng.random() < 0.9:
            m["weights_or_checkpoint"] = several(0)
        return rng.choice([m, m, json.dumps(m), None])

    out = []
    for i in range(120):
        records = [{"finding_id": f"f{i}_{k}", "model_source": [model() for _ in range(rng.randint(0, 3))], "dataset_sources": rng.choice([[], {"name": "d"}, None, "text"])} for k in range(rng.randint(0, 3))]
        out.append(json.dumps({"provenance": rng.choice([records, records[:1] and records[0], json.dumps(records)])}))
    return [*out, None, "", "{cut", "[]", "null", '"text"', "{}", '{"provenance": NaN}', out[0][: len(out[0]) // 2]]


def test_nested_records_against_an_independent_walk(spark, workspace):
    data = payloads()
    df = spark.createDataFrame([(i, p, "x", 1) for i, p in enumerate(data)] + [(0, data[0], "again", 2), (None, data[1], "y", 3)], "delivery_id bigint, payload string, tag string, pk int")
    tables = nested.flatten(df, workspace)
    got = sorted((r.delivery_id, r.finding_id, r.model_no, r.execution_mode, r.checkpoint_path, r.source_url_or_repo) for r in nested.checkpoint_sources(tables).collect() if r.delivery_id is not None)
    assert got == sorted((i, *c) for i, p in enumerate(data) for c in brute_checkpoints(p))
    links = {t: tables[t].collect() for t in ("finding", "model", "checkpoint", "checksum", "source")}
    keys = {(r.delivery_id, r.pk) for rows in links.values() for r in rows}
    assert all(r.parent_pk is None or (r.delivery_id, r.parent_pk) in keys for rows in links.values() for r in rows)
    assert {r.delivery_id for r in tables["reject"].collect()} == {120, 121, 122, 127, 128}


def test_deep_chain_and_empty_input(spark, workspace):
    chain = {"source_url_or_repo": "end"}
    for _ in range(300):
        chain = {"derived_from": chain}
    rows = list(nested.visit(json.dumps({"provenance": {"model_source": {"weights_or_checkpoint": chain}}})))
    assert sum(r[0] == "checkpoint" for r in rows) == 301
    deep = '{"provenance": {"finding_id": "f", "model_source": {"weights_or_checkpoint": ' + '[{"derived_from": ' * 100_000 + '{"source_url_or_repo": 1.50}' + "}]" * 100_000 + "}}}"
    bottom = list(nested.visit(deep))[-1]
    assert json.loads(bottom[3])["depth"] == 100_001 and json.loads(bottom[3])["source_url_or_repo"] == "1.50"
    again = list(nested.visit(json.dumps({"provenance": {"model_source": {"name": "m", "weights_or_checkpoint": deep}}})))
    assert [r[0] for r in again] == ["finding", "model", "checkpoint"]  # JSON within a text, of any depth, is no source
    assert [r[0] for r in nested.visit("[" * 100_000)] == ["reject"]
    empty = nested.flatten(spark.createDataFrame([], "delivery_id bigint, payload string"), workspace)
    assert all(t.count() == 0 for t in empty.values())


def test_the_deep_reader_agrees_with_the_library():
    rng = random.Random(3)

    def value(depth):
        kind = rng.randint(0, 7 if depth < 5 else 5)
        simple = [None, True, False, rng.randint(-99, 99), rng.random() * 10 ** rng.randint(-9, 9), rng.choice(["", "a\"b\\", "ü\n", "{"])]
        if kind < 6:
            return simple[kind]
        items = [value(depth + 1) for _ in range(rng.randint(0, 3))]
        return items if kind == 6 else {rng.choice(["a", "b", "ü"]): x for x in items}

    def plain(v):
        return float(v) if isinstance(v, nested.Number) else [plain(x) for x in v] if isinstance(v, list) else {k: plain(x) for k, x in v.items()} if isinstance(v, dict) else v

    for _ in range(300):
        v = value(0)
        text = json.dumps(v, indent=rng.choice([None, 1]))
        assert plain(nested._read_deep(f" {text}\n")) == plain(nested.read_json(text)) and nested._text(nested._read_deep("[" + text + "]")) == "[" + json.dumps(v, ensure_ascii=False) + "]"
        broken = text[: rng.randrange(len(text))]
        for reader in (nested._read_deep, nested.read_json):
            try:
                reader(broken)
            except ValueError:
                continue
            assert isinstance(json.loads(broken), (int, float))
    for broken in ("", "[1,]", "{,}", '{"a" 1}', '{"a":}', "[1 2]", "1 2", "{1: 2}", "[}", "nul"):
        with pytest.raises(ValueError):
            nested._read_deep(broken)


def test_one_delivery_with_two_payloads_keeps_its_links_apart(spark, workspace):
    def payload(fid, source):
        return json.dumps({"provenance": {"finding_id": fid, "status": "done", "dataset_sources": "d", "model_source": {"weights_or_checkpoint": source}}})

    rows = [(1, payload(None, "a/b")), (1, payload(None, " ")), (1, payload(None, "a/b")), (2, payload("f", [{"derived_from": "c"}]))]
    tables = nested.flatten(spark.createDataFrame(rows, "delivery_id bigint, payload string"), workspace)
    for t in ("finding", "model", "checkpoint"):
        keys = [r.pk for r in tables[t].collect()]
        assert len(keys) == len(set(keys)) == (4 if t == "checkpoint" else 3)
    got = sorted((r.delivery_id, r.has_id, r.has_checkpoint, r.complete) for r in registry.provenance_contract(tables).collect())
    assert got == [(1, False, False, False), (1, False, True, False), (2, True, True, True)]


# ---- edges ------------------------------------------------------------------------------------------------


def test_top_k_breaks_ties_by_id_and_drops_nan(spark):
    df = spark.createDataFrame([("a", "z", 0.5), ("a", "b", 0.5), ("a", "c", float("nan")), ("a", "d", None), ("a", "e", 0.9)], "sample_id string, train_id string, similarity double")
    assert [(r.train_id, r.rank) for r in E.top_k(df, 2).orderBy("rank").collect()] == [("e", 1), ("b", 2)]
    assert E.top_k(df, 0).count() == 3


def test_attach_axis(spark, evals, edges):
    got = {r.sample_id: r.axis for r in E.attach_axis(evals, edges).collect()}
    assert got == {"e0": 1.0, "e1": 0.7, "e2": 0.2, "e3": 0.8}
    with pytest.raises(Exception, match="no similarity"):
        E.attach_axis(evals, edges.where("sample_id <> 'e1'")).collect()
    assert E.attach_axis(evals, edges.where("sample_id <> 'e1'"), strict=False).where("axis is null").count() == 1


def test_composite_demands_the_same_pairs(spark, edges):
    other = edges.withColumn("similarity", F.lit(0.25))
    got = {(r.sample_id, r.train_id): r.similarity for r in E.composite([edges, other], "noisy_or").collect()}
    assert got["e1", "t1"] == pytest.approx(1 - 0.3 * 0.75)
    with pytest.raises(Exception, match="same pairs"):
        E.composite([edges, other.where("train_id = 't0'")], "mean").collect()


def test_nearest_numeric_matches_brute_force(spark):
    rng = random.Random(2)
    train = [(i, float(rng.randint(0, 300))) for i in range(150)] + [(999, None), (998, float("nan"))]
    queries = [(i, rng.uniform(-20, 330)) for i in range(300)] + [(5000, None)]
    out = E.nearest_numeric(spark.createDataFrame(queries, "q bigint, v double"), spark.createDataFrame(train, "t bigint, v double"), "q", "t", "v", 10.0, 20)
    best = {q: min((abs(v - x), t) for t, x in train if x is not None and x == x) for q, v in queries if v is not None}
    got = {r.sample_id: (r.train_id, r.similarity) for r in out.collect()}
    assert {q: t for q, (t, _) in got.items()} == {q: t for q, (_, t) in best.items()}
    assert all(got[q][1] == pytest.approx(math.exp(-d / 10)) for q, (d, _) in best.items())


def test_dense_top_k_in_blocks_equals_pairs(spark):
    rng = random.Random(3)
    df = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(60)] + [(100, [0.0] * 8)], "id bigint, v array<double>")
    small = {(r.sample_id, r.train_id, r.rank) for r in E.dense_top_k(df, df, "id", "id", "v", 4, block=7).collect()}
    assert small == {(r.sample_id, r.train_id, r.rank) for r in E.dense_top_k(df, df, "id", "id", "v", 4, block=1000).collect()}
    pairs = E.top_k(E.all_pairs(df, df, K.spectral_angle, "v", "id", "id", False).where("sample_id < 100 and train_id < 100"), 4, 10)
    assert {x for x in small if x[0] < 100 and x[2] == 1 and x[1] < 100} <= {(r.sample_id, r.train_id, r.rank) for r in pairs.collect()} | small
    with pytest.raises(Exception, match="finite"):
        bad = spark.createDataFrame([(1, [float("nan")]), (2, [1.0])], "id bigint, v array<double>")
        E.dense_top_k(bad, bad, "id", "id", "v", 1).collect()


def test_salted_join_equals_join(spark):
    big = spark.createDataFrame([("hot", i) for i in range(300)] + [(f"k{i % 9}", i) for i in range(60)] + [(None, 1)], "k string, v bigint")
    small = spark.createDataFrame([("hot", "a"), ("k1", "b")], "k string, w string")
    hot = skew.hot_keys(big, "k", 361, rows=100)
    assert [r.k for r in hot.collect()] == ["hot"]
    for how in ("inner", "left"):
        want = sorted((str(r.k), r.v, str(r.w)) for r in big.join(small, "k", how).collect())
        assert sorted((str(r.k), r.v, str(r.w)) for r in skew.salted_join(big, small, "k", hot, "v", how).select("k", "v", "w").collect()) == want


# ---- candidates -------------------------------------------------------------------------------------------


def sets(spark, n=150):
    rng = random.Random(4)
    base = [rng.sample(range(300), 12) for _ in range(n // 3)]
    rows = base + [b[:-1] + [rng.randint(0, 300)] for b in base] + [list(b) for b in base[:20]]
    return [(i, [f"t{x}" for x in r]) for i, r in enumerate(rows)]


@pytest.mark.parametrize("method", [C.prefix_jaccard, C.minhash_jaccard])
def test_set_joins_match_brute_force(spark, method):
    rows = sets(spark)
    members, classes = C.set_classes(spark.createDataFrame(rows + [(900, []), (901, None)], "id bigint, s array<string>"), "id", "s")
    first = {}
    for i, s in rows:
        first.setdefault(frozenset(s), i)
    items = sorted((i, s) for s, i in first.items())
    want = {(a, b) for k, (a, x) in enumerate(items) for b, y in items[k + 1 :] if len(x & y) / len(x | y) >= 0.8}
    assert {(r.c1, r.c2) for r in method(classes, 0.8).collect()} == want and want
    assert {r.id: r.class_id for r in members.collect()} == {i: first[frozenset(s)] for i, s in rows}


def test_qgram_join_matches_brute_force(spark):
    rng = random.Random(5)
    texts = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(0, 9))) for _ in range(150)})
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(999, None)], "id bigint, t string")

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    want = {(a, b) for i, a in enumerate(texts) for b in texts[i + 1 :] if lev(a, b) <= 2}
    assert {(r.a, r.b) for r in C.qgram_edit_join(df, "id", "t", 2).collect()} == want


def test_hamming_radius_matches_brute_force(spark):
    rng = random.Random(6)
    codes = [(i, rng.getrandbits(20)) for i in range(120)] + [(500, 0), (501, 3), (502, 0)]
    got = {(r.c1, r.c2) for r in C.hamming_radius(spark.createDataFrame(codes, "id bigint, code bigint"), 20, 4).collect()}
    assert got == {(a, b) for a, x in codes for b, y in codes if a < b and bin(x ^ y).count("1") <= 4}


def test_lsh_recall_against_exact_search(spark):
    rng = random.Random(7)
    centres = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(20)]
    rows = [(i, [x + rng.gauss(0, 0.15) for x in centres[i % 20]]) for i in range(400)]
    df = spark.createDataFrame(rows, "id bigint, v array<double>")
    queries = df.where("id % 50 = 0")
    exact = {(r.sample_id, r.train_id) for r in E.dense_top_k(queries, df, "id", "id", "v", 10).collect()}
    for candidates in (C.hyperplane_candidates(queries, df, "v", 16, 6, 12), C.projection_candidates(queries, df, "v", 16, 4.0, 3, 10)):
        got = {(r.sample_id, r.train_id) for r in E.top_k(C.verify(candidates, queries, df, "v", K.spectral_angle), 10, 10).collect()}
        assert len(got & exact) / len(exact) >= 0.9
    kernel = {(r.sample_id, r.train_id) for r in C.kernel_search(queries, df, "v", 16, 10, 0.05, 60).collect()}
    near = {(r.sample_id, r.train_id) for r in E.dense_top_k(queries, df, "id", "id", "v", 10, "euclidean").collect()}
    assert len(kernel & near) / len(near) >= 0.9
    ivf = {(r.sample_id, r.train_id) for r in C.ivf_top_k(queries, df, "v", 8, 3, 10).collect()}
    assert len(ivf & exact) / len(exact) >= 0.9


@pytest.mark.parametrize("rows", [400, 4000])
def test_kernel_search_is_whole_where_the_features_cannot_tell(spark, rows):
    """Kernel values closer together than the noise of the features, and few rows preselected."""
    import numpy as np

    points = np.random.default_rng(rows).normal(size=(rows, 16))
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id bigint, v array<double>")
    got = {(r.sample_id, r.train_id) for r in C.kernel_search(df.where("id % 100 = 0"), df, "v", 16, 10, 0.0005, 20, 512).collect()}
    want = set()
    for i in range(0, rows, 100):
        d = ((points - points[i]) ** 2).sum(axis=1)
        d[i] = np.inf
        want |= {(i, int(j)) for j in np.argsort(d)[:10]}
    assert got == want


def test_fallback_serves_queries_without_candidates(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.1])], "id bigint, v array<double>")
    none = spark.createDataFrame([], "sample_id bigint, train_id bigint, similarity double")
    out = C.fallback_exact(none, df.where("id = 0"), df, "v", K.cosine).collect()
    assert {(r.train_id, r.candidate_source) for r in out} == {(1, "fallback_exact"), (2, "fallback_exact")}


# ---- graphs and splits ------------------------------------------------------------------------------------


@pytest.fixture()
def graph(spark):
    rows = [(1, 2, 0.9), (2, 3, 0.85), (4, 5, 0.95), (1, 5, 0.3), (6, 7, 0.5)]
    return spark.createDataFrame(rows, "i bigint, j bigint, w double"), spark.range(1, 9).withColumnRenamed("id", "id")


def test_graph_operators(spark, graph, workspace):
    edges, nodes = graph
    labels = G.components(edges, nodes, 0.8, workspace)
    assert {r.id: r.component for r in labels.collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 7, 8: 8}
    table = {r.component: r for r in G.component_table(labels, edges).collect()}
    assert table[1].size == 3 and table[1].external_max == 0.3 and table[1].external_mean == pytest.approx(0.3 / 15)
    assert table[8].external_max == 0.0
    summary = {r.threshold: (r.edges, r.components, r.largest) for r in G.threshold_summary(edges, nodes, [0.9, 0.5], workspace).collect()}
    assert summary == {0.9: (2, 6, 2), 0.5: (4, 4, 3)}
    stats = G.statistics(edges, nodes).first()
    assert (stats.nodes, stats.possible_pairs, stats.min_weight, stats.max_weight) == (8, 28, 0.0, 0.95)
    assert {r.id: r.degree for r in G.degrees(edges, nodes).collect()}[8] == 0
    assert G.lookup(edges, spark.createDataFrame([(2, 1), (3, 8)], "a bigint, b bigint")).orderBy("a").first().w == 0.9
    empty = edges.where("false")
    assert G.components(empty, nodes, 0.5, workspace).where("id <> component").count() == 0
    assert G.statistics(empty, nodes.where("false")).first().density == 0.0


@pytest.mark.parametrize("rows", [0, 50_000])
def test_merged_components_with_hot_hubs_match_union_find(spark, workspace, monkeypatch, rows):
    """A hub, a chain and small groups; with a bound of 0 rows every key above a share of all rows is salted."""
    if not rows:
        monkeypatch.setattr(G, "HOT_ROWS", 0)
        monkeypatch.setattr(G, "hot_keys", lambda df, key, total: skew.hot_keys(df, key, total, rows=10))
    rng = random.Random(2)
    pairs = [(1000, 1001 + i) for i in range(200)] + [(2000 + i, 2001 + i) for i in range(60)] + [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(120)] + [(1100, 2030), (7, 7)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a != b:
            lo, hi = sorted((find(a), find(b)))
            parent[hi] = lo
    got = {r.node: r.root for r in G.merge_components(spark.createDataFrame(pairs, "a bigint, b bigint"), workspace).collect()}
    assert got == {x: find(x) for x in parent}
    assert G.merge_components(spark.createDataFrame([], "a bigint, b bigint"), workspace).count() == 0


def test_meeting_in_blocks_equals_a_join(spark, workspace, monkeypatch):
    monkeypatch.setattr(skew, "HOT_ROWS", 20)
    rng = random.Random(5)
    rows = [(i, rng.choice([None, "hot", "hot", "hot", f"k{rng.randint(0, 30)}"])) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, key string")
    got = sorted(tuple(sorted((r.id_1, r.id_2))) for r in skew.meet(df, "key", "id", ["id"], 7, workspace).collect())
    assert got == [(a, b) for a, k in rows for b, m in rows if a < b and k == m and k is not None]
    other = df.where("id % 3 = 0").select(F.col("id").alias("q"), "key")
    for size in (7, 1000):
        got = sorted((r.q, r.id) for r in skew.meet_two(other, df, "key", "q", "id", size, workspace).collect())
        assert got == sorted((a, b) for a, k in rows for b, m in rows if a % 3 == 0 and k == m and k is not None)


def test_block_join_of_null_blocks(spark):
    df = spark.createDataFrame([(1, None, 1), (2, None, 1), (3, "a", None), (4, "a", None), (5, "a", 1)], "id int, x string, y int")
    assert sorted((r.sample_id, r.train_id) for r in C.block_join(df, df, ["x", "y"]).collect()) == [(1, 2), (2, 1), (3, 4), (4, 3)]


def test_codes_beyond_32_bits(spark):
    rng = random.Random(9)
    vectors = [[rng.gauss(0, 1) for _ in range(70)] for _ in range(40)]
    vectors += [[x if rng.random() > 0.04 else -x for x in v] for v in vectors]
    df = spark.createDataFrame(list(enumerate(vectors)), "id int, v array<double>")
    for bits, radius in ((70, 4), (64, 3), (33, 2), (20, 2), (70, 0)):
        signs = [[x >= 0 for x in v[:bits]] for v in vectors]
        want = sorted((i, j, n) for i in range(80) for j in range(i + 1, 80) if (n := sum(a != b for a, b in zip(signs[i], signs[j]))) <= radius)
        assert sorted((r.c1, r.c2, r.distance) for r in C.hamming_radius(C.sign_codes(df, "id", "v", bits), bits, radius).collect()) == want


def test_no_task_reads_a_hot_hub_alone(spark, workspace, monkeypatch):
    """A key with half of all rows: after salting the largest partition of the join holds under 5 % of them."""
    hub = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, F.lit(-1)).otherwise(F.col("id")).alias("to"), F.col("id").alias("node"))
    onward = hub.select("to").distinct().withColumn("next", F.lit(0))
    monkeypatch.setattr(skew, "SALTS", 64)
    joined = skew.salted_join(hub, onward, "to", skew.hot_keys(hub, "to", 20_000, rows=1000), "node", "left", salts=64)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "256")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")
    assert sum(sizes) == 20_000 and max(sizes) < 1000


def test_hops_and_neighbourhoods(spark, workspace):
    links = spark.createDataFrame([("A", "B"), ("B", "C"), ("C", "D")], "u string, v string")
    nodes = spark.createDataFrame([(x,) for x in "ABCD"], "id string")
    got = {(r.sample_id, r.train_id): r.similarity for r in G.neighbourhood_jaccard(links, nodes.where("id = 'B'"), nodes, 1, workspace).collect()}
    assert got["B", "D"] == 0.5 and got["B", "B"] == 1.0
    ab = spark.createDataFrame([("t0", "A"), ("t1", "D")], "id string, entity string")
    near = {r.train_id: r.similarity for r in G.network_proximity(links, spark.createDataFrame([("e", "B")], "id string, entity string"), ab, 3, workspace).collect()}
    assert near["t0"] > near["t1"]


def test_independent_set_invariants(spark, workspace):
    rng = random.Random(8)
    rows = [(a, b, rng.random()) for a in range(60) for b in range(a + 1, 60) if rng.random() < 0.1]
    edges = spark.createDataFrame(rows, "i bigint, j bigint, w double")
    nodes = spark.range(60)
    kept = lambda p: {r.id for r in S.independent_set(edges, nodes, p, 0.0, workspace, 3).collect()}
    full = kept(1.0)
    assert kept(0.0) == set(range(60))
    assert not any(a in full and b in full for a, b, _ in rows)
    assert all(n in full or any((a == n and b in full) or (b == n and a in full) for a, b, _ in rows) for n in range(60))
    assert len(full) <= len(kept(0.5)) <= 60 and kept(1.0) == full


def test_component_packing_and_checks(spark, workspace):
    labels = spark.createDataFrame([(i, (i // 3) * 3) for i in range(60)], "id bigint, component bigint")
    edges = spark.createDataFrame([(i, i + 1, 0.9) for i in range(60) if i % 3 != 2] + [(2, 3, 0.2)], "i bigint, j bigint, w double")
    split, status = S.threshold_split(labels, G.component_table(labels, edges))
    assert status == "valid" and split.where("split = 'test'").count() == 12
    assert S.violations(split, edges, 0.8).first().status == "valid"
    assert S.violations(split, edges.withColumn("w", F.lit(0.9)), 0.8).first().status in ("valid", "invalid_threshold_violation")
    big = spark.createDataFrame([(i, 0) for i in range(10)], "id bigint, component bigint")
    assert S.threshold_split(big, G.component_table(big, edges))[1] == "invalid_test_size"
    summary = S.split_summary(split, edges).first()
    assert summary.train_size == 48 and summary.test_size == 12


def test_random_split_is_exact(spark):
    for n in (0, 1, 7, 500):
        out = S.random_split(spark.range(n), "id", 0.2, numeric=True).groupBy("split").count().collect()
        assert {r["split"]: r["count"] for r in out}.get("test", 0) == math.ceil(0.2 * n)


def test_operating_points_all_have_an_operator(spark):
    assert len(S.OPERATING_POINTS) == 28
    assert all(callable(getattr(S, op)) for op, _, _ in S.OPERATING_POINTS.values())
    rows = spark.createDataFrame([(1, "a"), (2, None), (None, "a"), (3, "b")], "id bigint, g string")
    out = S.operating_point("molecular_scaffold_split", rows, id_col="id", groups=["g"], held_out=[(None,)])
    assert {(r.sample_id, r.split, r.heldout_group) for r in out.collect()} == {(1, "train", None), (2, "test", "<null>"), (3, "train", None)}
    with pytest.raises(ValueError):
        S.leave_one_out(spark.range(1200), "id", "id")


# ---- metrics and curves -----------------------------------------------------------------------------------


def test_pairwise_curve_and_contracts(spark, evals, edges):
    c = curve.pairwise_curve(evals, edges, (0.9, 0.6, 0.3))
    rows = {r.subset: r for r in c.collect()}
    assert {k: r.test_size for k, r in rows.items()} == {"all_eval": 4, "similarity_le_0_9": 3, "similarity_le_0_6": 1, "similarity_le_0_3": 1}
    assert rows["all_eval"].mae == pytest.approx((0.1 + 1.2 + 0.5 + 0.05) / 4)
    assert curve.validate_overlap(c).first().valid and curve.validate_novelty(c).first().valid
    none = curve.validate_overlap(c.where("false")).first()
    assert not none.valid and none.row_count == 0
    assert curve.area(c.where("subset = 'all_eval'")).first().computed is False


def test_area_by_hand(spark):
    c = spark.createDataFrame([("a", 0.9, 0.85), ("b", 0.5, 0.72), ("c", 0.1, 0.61), ("d", None, 0.5)], "subset string, cross_split_overlap double, performance double")
    assert curve.area(c, "cross_split_overlap", "performance", True, invert_x=True).first().value == pytest.approx(0.725)


def test_hypothesis_status(spark):
    rows = [("x", "all", 0.1, 1.0, 100), ("x", "mid", 0.5, 1.2, 80), ("x", "hard", 0.9, 1.5, 60), ("y", "all", 0.1, 1.0, 100), ("y", "mid", 0.5, 1.5, 80), ("y", "hard", 0.9, 1.0, 60), ("z", "all", 0.1, 1.0, 5)]
    df = spark.createDataFrame(rows, "axis string, subset string, mean_novelty double, rmse double, test_size int")
    df = df.withColumn("leakage_risk", F.when(F.col("axis") == "x", "post_hoc").otherwise("none"))
    got = {r.axis: (r.status, r.prospective_valid) for r in curve.score_hypotheses(df).collect()}
    assert got == {"x": ("monotonic_supported", False), "y": ("localized_supported", True), "z": ("not_evaluable", True)}
    assert curve.best_axis(curve.score_hypotheses(df)).first().axis == "x"


def test_regression_metrics_edge_cases(spark, evals):
    none = evals.where("false").agg(*M.regression_aggregates()).first()
    assert none.n == 0 and none.mae is None and none.r2 is None
    assert evals.where("sample_id = 'e0'").agg(*M.regression_aggregates()).first().r2 is None


def test_classification_against_pairs(spark):
    rng = random.Random(9)
    rows = [(rng.randint(0, 1), rng.choice([0.1, 0.4, 0.4, 0.6, 0.9])) for _ in range(200)]
    out = M.classification(spark.createDataFrame(rows + [(None, 0.5), (1, None), (1, float("nan"))], "y int, s double"), "y", "s").first()
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    auc = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
    assert out.n == 200 and out.roc_auc == pytest.approx(auc) and out.brier == pytest.approx(sum((y - s) ** 2 for y, s in rows) / 200)
    one = M.classification(spark.createDataFrame([(1, 0.7)], "y int, s double"), "y", "s").first()
    assert one.roc_auc is None and one.accuracy == 1.0


def test_labels(spark):
    assert [r.label for r in M.binary_labels(spark.createDataFrame([("b",), ("a",), (None,)], "l string"), "l").collect()] == [1, 0, None]
    with pytest.raises(Exception, match="two values"):
        M.binary_labels(spark.createDataFrame([("a",)], "l string"), "l").collect()


def test_threshold_parsing():
    assert curve.parse_thresholds("0.5, 1,0.5") == [1.0, 0.5] and curve.parse_thresholds(" ") is None
    with pytest.raises(ValueError):
        curve.parse_thresholds("1.5", unit_interval=True)
    assert curve.axis_type("Distance-from-train") == "distance"
    with pytest.raises(ValueError):
        curve.axis_type("size")


# ---- the rest ---------------------------------------------------------------------------------------------


def test_profiles(spark):
    v = spark.createDataFrame([("c", "ctrl", "g", 1.0), ("c", "A", "g", 3.0), ("c", "B", "g", 2.0), ("d", "A", "g", 9.0)], "cell_type string, condition string, gene string, value double")
    r = A.responses(A.profiles(v), "ctrl")
    assert {(x.cell_type, x.condition): x.response for x in r.collect()} == {("c", "A"): 2.0, ("c", "B"): 1.0}
    combos = spark.createDataFrame([("c", "A+B", "g", 2.5), ("c", "A+X", "g", 1.0)], "cell_type string, condition string, gene string, response double")
    assert {x.condition: x.predicted for x in A.additive_prediction(combos, r).collect()} == {"A+B": 3.0, "A+X": 2.0}
    assert {x.condition: x.support for x in A.component_support(combos, r).collect()} == {"A+B": 1.0, "A+X": 0.5}
    with pytest.raises(ValueError):
        A.blind_bundle(v, ["gene"], ["gene"])


def test_dtw_pruning_loses_nothing(spark):
    rng = random.Random(10)
    df = spark.createDataFrame([(i, [rng.uniform(0, 5) for _ in range(rng.randint(1, 6))]) for i in range(25)], "id bigint, s array<double>")
    from nearfield.functions import pandas_kernels as PK

    everything = E.all_pairs(df, df, lambda a, b: PK.dtw_similarity()(a, b), "s", "id", "id", False).where("similarity >= 0.8")
    assert {(r.sample_id, r.train_id) for r in A.dtw_pruned(df, df, "s", 0.8).collect()} == {(r.sample_id, r.train_id) for r in everything.collect()}


def test_ontology_and_graph_features(spark, workspace):
    items = spark.createDataFrame([("x", "leaf"), ("y", "other")], "id string, term string")
    parents = spark.createDataFrame([("leaf", "mid"), ("mid", "root"), ("other", "root"), ("root", "root")], "child string, parent string")
    got = {(r.id, r.key) for r in A.ancestor_sets(items, parents, 10, workspace).collect()}
    assert got == {("x", "leaf"), ("x", "mid"), ("y", "other")}  # what all items share has no information
    links = spark.createDataFrame([("g", 1, 2), ("g", 2, 3), ("h", 7, 8), ("h", 8, 9)], "graph string, u int, v int")
    labels = spark.createDataFrame([(g, n, "C") for g, n in (("g", 1), ("g", 2), ("g", 3), ("h", 7), ("h", 8), ("h", 9))], "graph string, node int, label string")
    wl = A.wl_labels(links, labels, 2, workspace)
    one, two = ({(r.key, r.weight) for r in wl.where(F.col("id") == g).collect()} for g in "gh")
    assert one == two and len(one) > 2


def test_registry_and_planner(spark):
    table = strategies.entries(spark)
    assert {r.catalog: r["count"] for r in table.groupBy("catalog").count().collect()} == {"definition": 54, "strategy": 38, "operating_point": 28}
    hits = registry.search(table, "protein homology", k=3).collect()
    assert hits and hits[0].score >= hits[-1].score
    assert registry.search(table, "nothingmatches").count() == 0
    assert registry.list_entries(table, kind="hashing sketch").count() == 4
    assert registry.validate(table, ["id", "nope"]).where(F.size("errors") == 1).count() == 120
    assert "# a" in registry.render({"id": "a", "inputs": ["x"], "none": None})
    assert [planner.choose(n).strategy for n in (20_000, 20_001, 250_001)] == ["exact", "chunked", "approximate"]
    assert planner.choose(20_000).warnings == ("exact pairs may be slow",)
    assert planner.execution_mode(True, True, False) == "audit_fallback"


def test_files(spark, tmp_path, evals, edges):
    path = tmp_path / "in.csv"
    path.write_text('sample_id,code,v\n001,0011,1.5\n002,0100,x\n')
    df = readers.read_csv(spark, str(path), ["sample_id"], ("v",))
    assert [(r.code, r.v) for r in df.orderBy("sample_id").collect()] == [("0011", 1.5), ("0100", None)]
    with pytest.raises(ValueError):
        readers.read_csv(spark, str(path), ["nope"])
    with pytest.raises(ValueError):
        readers.read_dataset(spark, str(tmp_path / "x.parquet"), [])
    with pytest.raises(FileNotFoundError):
        readers.read_dataset(spark, str(tmp_path / "none.csv"), [])
    with pytest.raises(ValueError):
        sinks.write_csv(evals.where("false"), str(tmp_path / "out"))
    assert sinks.write_capped(evals, str(tmp_path / "capped"), cap=3) == {"rows": 4, "written": False, "note": "4 rows exceed 3"}
    edges.write.parquet(str(tmp_path / "edges"))
    c = curve.pairwise_curve(evals, readers.read_edges(spark, str(tmp_path / "edges")), (0.6,))
    rows = sinks.curve_rows(c)
    card = sinks.audit_card(c, curve.validate_overlap(c).first().asDict())
    sinks.write_json(card, str(tmp_path / "card.json"))
    assert not sinks.check_card(readers.load_json(str(tmp_path / "card.json")))
    assert "<svg" in sinks.svg_curve(rows, "rmse", "a < b") and "| rmse |" in sinks.markdown_report("t", rows, ["subset", "rmse"])
    indexed = readers.read_with(lambda s, p: readers.read_csv(s, p), spark, str(path), "sample_id")
    assert {r["sample_id"]: r["index"] for r in indexed.collect()} == {"001": 0, "002": 1}


def test_planes_of_plans(spark, edges):
    plan = E.top_k(edges, 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_percentiles_by_sorting_equal_those_of_one_task(spark, workspace, monkeypatch):
    rng = random.Random(31)
    rows = [(rng.choice(["a", "b", None, "c"]), rng.choice([None, float("nan"), 1.0, rng.gauss(0, 3), rng.gauss(0, 3)]), rng.gauss(0, 1)) for _ in range(500)] + [("one", 2.5, 1.0)]
    df = spark.createDataFrame(rows, "g string, y_true double, y_pred double").where("y_true is null or not isnan(y_true)")
    monkeypatch.setattr("nearfield.functions.features.RUNNING_ROWS", 90)
    plain = {r.g: r.asDict() for r in M.regression_table(df, ["g"], 501, [F.avg("y_pred").alias("m")], {"median": "y_pred"}).collect()}
    sorted_ = {r.g: r.asDict() for r in M.regression_table(df, ["g"], 10**9, [F.avg("y_pred").alias("m")], {"median": "y_pred"}).collect()}
    assert set(plain) == set(sorted_) == {"a", "b", None, "c", "one"}
    for g, want in plain.items():
        assert set(want) == set(sorted_[g]) and all(sorted_[g][k] == pytest.approx(v) for k, v in want.items()), g
    points = [0, 0.1, 0.5, 0.77, 1]
    want = M.percentiles_of(df, "y_true", points)
    monkeypatch.setattr(M, "ONE_TASK_ROWS", 0)
    assert M.percentiles_of(df, "y_true", points) == pytest.approx(want) and M.percentiles_of(df.where("false"), "y_true", points) is None


def test_scores_sorted_by_range_give_the_same_metrics(spark, monkeypatch):
    rng = random.Random(41)
    rows = [(rng.choice(["a", "b", "c"]), rng.randint(0, 1), round(rng.random(), 2)) for _ in range(300)]
    df = spark.createDataFrame(rows, "g string, y int, s double")
    plain = [{r.g: r.asDict() for r in M.classification(df, "y", "s", 0.5, ["g"]).collect()}, M.classification(df, "y", "s").first().asDict()]
    monkeypatch.setattr(M, "ONE_TASK_ROWS", 0)
    monkeypatch.setattr("nearfield.functions.features.RUNNING_ROWS", 40)
    assert {r.g: {k: pytest.approx(v) for k, v in r.asDict().items()} for r in M.classification(df, "y", "s", 0.5, ["g"]).collect()} == plain[0]
    assert {k: pytest.approx(v) for k, v in M.classification(df, "y", "s").first().asDict().items()} == plain[1]


def test_windows_and_kernel_sums_in_blocks(spark, monkeypatch):
    rng = random.Random(42)
    series = [(k, [rng.gauss(0, 1) for _ in range(rng.randint(3, 14))]) for k in range(4)]
    got = {(r.id, r.start): r.distance for r in A.matrix_profile(spark.createDataFrame(series, "id int, v array<double>"), "v", 4).collect()}

    def z(w):
        mu = sum(w) / 4
        sd = math.sqrt(max(0.0, sum(x * x for x in w) / 4 - mu * mu))
        return [(x - mu) / sd for x in w]

    want = {}
    for k, v in series:
        windows = {i + 1: z(v[i : i + 4]) for i in range(len(v) - 3)}
        for i, w in windows.items():
            near = [math.dist(w, x) for j, x in windows.items() if abs(i - j) > 2]
            if near:
                want[k, i] = min(near)
    assert got == {k: pytest.approx(v, abs=1e-9) for k, v in want.items()}
    monkeypatch.setattr(A, "MMD_BLOCK", 7)
    rows = [(k, rng.choice(["x", "y"]), [rng.gauss(0, 1), rng.gauss(0, 1)]) for k in range(30)]
    got = {(r.a, r.b): r.similarity for r in A.domain_mmd(spark.createDataFrame(rows, "id int, d string, v array<double>"), "d", "v", 0.5).collect()}
    mean = lambda a, b: sum(math.exp(-0.5 * math.dist(u, w) ** 2) for _, d, u in rows for _, e, w in rows if (d, e) == (a, b)) / sum((d, e) == (a, b) for _, d, _u in rows for _, e, _w in rows)
    for a in "xy":
        for b in "xy":
            assert got[a, b] == pytest.approx(math.exp(-max(0.0, mean(a, a) + mean(b, b) - 2 * mean(a, b))))
