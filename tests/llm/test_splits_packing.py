"""Splits of tied records and packing of texts."""

import random

import pytest

from nearfield.llm import packing, splits
from tests.llm.test_topn_components import union_find

ASSIGN = "sample_id string, run_id string, component_id bigint, compound_id string, component_size int, status string"


def rows():
    rng = random.Random(8)
    out = []
    for i in range(400):
        comp = rng.choice([-1, None, rng.randint(0, 60), rng.randint(0, 60)])
        cpd = rng.choice([None, "n/a", "unknown", "CPD-", f" cpd-{rng.randint(0, 150):05d} ", f"CPD-{rng.randint(0, 150):05d}"])
        out.append((f"s{i:04d}", rng.choice(["r1", "r2", None]), comp, cpd, 0, "x"))
    return out + out[:7] + [(None, "r1", 1, "CPD-00001", 1, "x")]


def truth(data):
    keys, edges = {}, []
    for s, run, comp, cpd, *_ in data:
        if s is None:
            continue
        if comp is not None and comp >= 0 and run is not None:
            keys.setdefault(("run", run, comp), set()).add(s)
        name = (cpd or "").strip().upper()
        if name.startswith("CPD-") and name[4:].isdigit():
            keys.setdefault(("cpd", name), set()).add(s)
    for members in keys.values():
        first = min(members)
        edges += [(first, m) for m in members if m != first]
    return union_find(edges)


@pytest.fixture()
def targets(spark):
    return spark.createDataFrame([("train", 0.8), ("validation", 0.1), ("test", 0.1), (None, 0.5)], "split string, fraction double")


def run(spark, data, targets, state, workspace):
    df = spark.createDataFrame(data, ASSIGN)
    return splits.update(state, df.selectExpr("sample_id AS record_id"), splits.tie_edges(splits.tie_keys(df)), targets, workspace)


def test_groups_match_union_find_and_share_a_split(spark, workspace, targets):
    data = rows()
    state = run(spark, data, targets, splits.empty_state(spark), workspace)
    got = {r.sample_id: r.group_id for r in splits.tied_groups(state).collect()}
    assert got == truth(data)
    table = state.collect()
    assert len(table) == 400 and {r.status for r in table} == {"new"}
    per = {}
    for r in table:
        per.setdefault(r.component, set()).add(r.split)
    assert all(len(s) == 1 for s in per.values())


def test_proportions_of_many_small_groups(spark, workspace, targets):
    data = [(f"s{i:05d}", None, None, f"CPD-{i // 3}", 0, "") for i in range(6000)]
    state = run(spark, data, targets, splits.empty_state(spark), workspace)
    share = {r["split"]: r["count"] / 6000 for r in state.groupBy("split").count().collect()}
    assert abs(share["train"] - 0.8) < 0.01 and abs(share["validation"] - 0.1) < 0.01 and abs(share["test"] - 0.1) < 0.01


def test_increment_keeps_splits_and_quarantines_conflicts(spark, workspace, targets):
    state = spark.createDataFrame([("a", "a", "train", "kept"), ("b", "b", "test", "kept"), ("c", "c", "train", "kept"), ("d", "d", "train", "kept")], splits.STATE)
    data = [("a", "r", 1, None, 0, ""), ("b", "r", 1, None, 0, ""), ("c", "r", 2, None, 0, ""), ("n", "r", 2, None, 0, ""), ("d", "r", 3, None, 0, ""), ("e", "r", 4, None, 0, "")]
    got = {r.record_id: (r.component, r.split, r.status) for r in run(spark, data, targets, state, workspace).collect()}
    assert got["a"] == ("a", None, "quarantined") and got["b"] == ("a", None, "quarantined")
    assert got["c"] == ("c", "train", "kept") and got["n"] == ("c", "train", "kept")
    assert got["d"][1:] == ("train", "kept") and got["e"][2] == "new"
    # a quarantined component stays so; nothing else moves
    again = spark.createDataFrame([(k, *v) for k, v in got.items()], splits.STATE)
    later = {r.record_id: (r.component, r.split, r.status) for r in run(spark, [("z", None, None, None, 0, "")], targets, again, workspace).collect()}
    assert later["a"] == ("a", None, "quarantined") and later["c"] == ("c", "train", "kept") and later["z"][2] == "new"


def test_persisted_state_goes_on_in_versions(spark, workspace, targets, tmp_path):
    path = f"file://{tmp_path}/state"
    assert splits.load_state(spark, path).count() == 0
    records = lambda *ids: spark.createDataFrame([(i,) for i in ids], "record_id string")
    edges = lambda *pairs: spark.createDataFrame(list(pairs), "a string, b string")
    first, one = splits.update_saved(path, records("a", "b", "c"), edges(("a", "b")), targets, workspace)
    before = {r.record_id: r.split for r in first.collect()}
    (tmp_path / "state" / "v00000002").mkdir()  # a job that failed half way
    second, two = splits.update_saved(path, records("d"), edges(("b", "d")), targets, workspace)
    after = {r.record_id: (r.component, r.split) for r in second.collect()}
    assert (one, two) == (1, 3) and after["d"] == ("a", before["a"]) and all(after[k][1] == v for k, v in before.items())
    assert {r.record_id for r in splits.load_state(spark, path, 1).collect()} == {"a", "b", "c"}
    with pytest.raises(ValueError):
        splits.load_state(spark, path, 2)


def test_merged_old_components_take_the_smaller_id(spark, workspace, targets):
    state = spark.createDataFrame([("b", "b", "train", "kept"), ("c", "b", "train", "kept"), ("x", "x", "train", "kept")], splits.STATE)
    got = {r.record_id: r.component for r in run(spark, [("c", "r", 1, None, 0, ""), ("x", "r", 1, None, 0, ""), ("a", "r", 1, None, 0, "")], targets, state, workspace).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "x": "a"}


def test_empty_batch_and_empty_state(spark, workspace, targets):
    assert run(spark, [], targets, splits.empty_state(spark), workspace).count() == 0
    state = spark.createDataFrame([("b", "b", "train", "kept")], splits.STATE)
    assert [tuple(r) for r in run(spark, [], targets, state, workspace).collect()] == [("b", "b", "train", "kept")]


def test_without_targets_new_components_have_no_split(spark, workspace, targets):
    state = run(spark, [("a", "r", 1, None, 0, ""), ("b", "r", 1, None, 0, "")], targets.where("false"), splits.empty_state(spark), workspace)
    assert {(r.record_id, r.component, r.split, r.status) for r in state.collect()} == {("a", "a", None, "new"), ("b", "a", None, "new")}


def test_tightest_fit_tree():
    rng = random.Random(9)
    tree, open_ = packing.TightestFit(300), []
    for k in range(3000):
        if rng.random() < 0.55 or not open_:
            remaining = rng.randint(0, 300)
            tree.add(k, remaining)
            if remaining:
                open_.append(remaining)
        else:
            size = rng.randint(1, 300)
            fits = [r for r in open_ if r >= size]
            got = tree.take(size)
            assert (got is None) == (not fits)
            if got:
                assert got[1] == min(fits)
                open_.remove(got[1])


def check_packing(out, counts, capacities):
    for name, capacity in capacities.items():
        mine = [r for r in out if r.window_name == name]
        fill, spans = {}, {}
        for r in mine:
            fill[r.container_id] = fill.get(r.container_id, 0) + r.n_tokens
            spans.setdefault(r.doc_id, []).append((r.start, r.n_tokens))
        assert all(0 < f <= capacity for f in fill.values())
        for doc, n in counts.items():
            at = 0
            for start, size in sorted(spans.get(doc, [])):
                assert start == at
                at += size
            assert at == n
            assert n > capacity or len(spans.get(doc, [])) <= 1
        yield name, sum(counts.values()) / (len(fill) * capacity) if fill else 1.0


@pytest.mark.parametrize("shard", [100_000, 150])
def test_packing_is_whole_and_tight(spark, workspace, monkeypatch, shard):
    monkeypatch.setattr(packing, "SHARD_PIECES", shard)
    rng = random.Random(10)
    counts = {i: rng.choice([1, 5, rng.randint(1, 400), rng.randint(1, 3000)]) for i in range(900)}
    df = spark.createDataFrame(list(counts.items()), "doc_id bigint, n_tokens bigint")
    windows = spark.createDataFrame([(1, "short", 256), (2, "long", 4096), (3, "bad", None), (4, "zero", 0)], "window_id int, window_name string, capacity_tokens int")
    out = packing.pack(df, windows, workspace).collect()
    for _, filled in check_packing(out, counts, {"short": 256, "long": 4096}):
        assert filled > 0.97
    assert {r.window_name for r in out} == {"short", "long"}


def test_packing_of_nothing_and_blank_texts(spark, workspace):
    docs = spark.createDataFrame([(1, None), (2, " \n"), (None, "abc"), (3, "Two words"), (4, "Two words")], "doc_id bigint, text string")
    counts = {r.doc_id: r.n_tokens for r in packing.token_counts(docs).collect()}
    assert set(counts) == {3, 4} and counts[3] == counts[4] == 2
    windows = spark.createDataFrame([("w", 8)], "window_name string, capacity_tokens int")
    assert packing.pack(packing.token_counts(docs.where("false")), windows, workspace).count() == 0


def test_long_texts_count_the_same_in_blocks():
    text = "  a model of similarity, and so on;\n" * 400 + "x" * 5000
    assert packing.count_tokens(text, block=10**9) == packing.count_tokens(text, block=997)
    rng = random.Random(4)
    for letters in ("ab", "aé漢 '", "x1.'s\n\t", " \n", "12"):
        unbroken = "".join(rng.choice(letters) for _ in range(30_000))
        assert packing.count_tokens(unbroken, block=10**9) == packing.count_tokens(unbroken, block=700)
    words = "alpha beta gamma delta " * 2000
    assert packing.count_tokens(words, block=10**9) == packing.count_tokens(words, block=501)
