"""Cross-split overlaps and set joins lose no pair that brute force finds."""

import random

import numpy as np
import pytest

from nearfield.llm import overlap, setjoin


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def close(a, b):
    return bool(a) and bool(b) and abs(len(a) - len(b)) * 10 <= max(len(a), len(b)) and distance(a, b) * 10 <= max(len(a), len(b))


def texts():
    rng = random.Random(4)
    alphabet = "CNO()=1c[]@H"
    train = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 180))) for _ in range(160)] + ["C" * n for n in (5, 9, 10, 40, 95)] + ["é" * 30]
    evals = list(train[:20])
    for t in train:
        k = len(t) // 10
        s, even = list(t), list(t)
        for p in sorted(rng.sample(range(len(s)), k), reverse=True):
            kind = rng.random()
            if kind < 0.4:
                s[p] = rng.choice(alphabet)
            elif kind < 0.7:
                del s[p]
            else:
                s.insert(p, rng.choice(alphabet))
        for i in range(k):
            even[min(len(even) - 1, i * len(even) // max(1, k) + 4)] = "X"
        evals += ["".join(s), "".join(even)]
    return train, evals


def test_chunks_lose_no_pair_even_with_evenly_spread_edits(spark, workspace):
    train, evals = texts()
    t = spark.createDataFrame([(f"t{i}", f" {x}\t", "clash") for i, x in enumerate(train)] + [("t_null", None, "x"), (None, "CCC", "x"), ("t_blank", "  \t ", "x"), ("t0", f" {train[0]}\t", "again")], "train_id string, smiles string, text string")
    e = spark.createDataFrame([(f"e{i}", x, 1) for i, x in enumerate(evals)] + [("e_null", None, 1), ("e0", evals[0], 2)], "sample_id string, smiles string, overlap int")
    got = [(r.sample_id, r.train_id) for r in overlap.cross_split_overlaps(e, t, workspace).collect()]
    want = {(f"e{i}", f"t{j}") for i, a in enumerate(evals) for j, b in enumerate(train) if close(a, b)}
    assert set(got) == want and len(got) == len(want)


def test_small_blocks_give_the_same(spark, workspace, monkeypatch):
    train, evals = texts()
    train, evals = train[:60], evals[:80]
    monkeypatch.setattr(overlap, "TRAIN_BLOCK", 7)
    monkeypatch.setattr(overlap, "EVAL_BLOCK", 11)
    t = spark.createDataFrame([(f"t{i}", x) for i, x in enumerate(train)], "train_id string, smiles string")
    e = spark.createDataFrame([(f"e{i}", x) for i, x in enumerate(evals)], "sample_id string, smiles string")
    got = {(r.sample_id, r.train_id) for r in overlap.cross_split_overlaps(e, t, workspace).collect()}
    assert got == {(f"e{i}", f"t{j}") for i, a in enumerate(evals) for j, b in enumerate(train) if close(a, b)}


def test_a_text_of_many_ids_meets_in_blocks(spark, workspace, monkeypatch):
    monkeypatch.setattr(overlap, "MEMBERS", 3)
    e = [(f"e{i}", "CCNOCCNOCCNO") for i in range(10)] + [("e9x", "CCNOCCNOCCNN"), ("e8x", None)]
    t = [(f"t{i}", " CCNOCCNOCCNO") for i in range(11)] + [("ty", "CCNOCCNOCCN"), ("tz", "unlike")]
    got = overlap.cross_split_overlaps(spark.createDataFrame(e, "sample_id string, smiles string"), spark.createDataFrame(t, "train_id string, smiles string"), workspace).collect()
    assert {(r.sample_id, r.train_id) for r in got} == {(a, b) for a, x in e if x for b, y in t if close(x.strip(), y.strip())} and len(got) == 11 * 12


def test_empty_tables(spark, workspace):
    t = spark.createDataFrame([], "train_id string, smiles string")
    e = spark.createDataFrame([("a", "CCCCCCCCCCCCCCC")], "sample_id string, smiles string")
    assert overlap.cross_split_overlaps(e, t, workspace).count() == 0
    assert overlap.cross_split_overlaps(e.where("false"), t, workspace).count() == 0


def test_very_long_text(spark, workspace):
    rng = random.Random(2)
    long = "".join(rng.choice("ABCDEF") for _ in range(70_000))
    other = long[:30_000] + "XYZ" + long[30_000:]
    t = spark.createDataFrame([("t", long)], "train_id string, smiles string")
    e = spark.createDataFrame([("e", other), ("f", long[::-1])], "sample_id string, smiles string")
    index = overlap.TrainIndex([long], *overlap.CLASSES[0][1:])
    found = [(int(a), float(f)) for fe, _, fr in index.candidates([other]) for a, f in zip(fe, fr)]
    assert found and found[0][1] > 0.5
    assert t.count() and e.count()


def test_chunk_of_a_text_is_found_wherever_it_stands():
    rng = random.Random(5)
    a = "".join(rng.choice("ABCD") for _ in range(300))
    params = overlap.CLASSES[0][1:]
    own = overlap.Chunker([a], *params)
    moved = overlap.Chunker(["ZZZZZ" + a], *params)
    text, place = own.chains()
    assert len(place) >= 300 // params[1] - 1
    assert np.array_equal(own.digest[place], moved.digest[place + 5])


def brute_sets(rows, t):
    sets = {}
    for i, s in sorted((r for r in rows if r[0] is not None and r[1] is not None), reverse=True):
        sets[i] = {x.strip() for x in s.split(".") if x.strip()}
    ids = sorted(i for i in sets if sets[i])
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) - 1e-9}


@pytest.mark.parametrize("block", [4_000, 3])
def test_set_join_matches_brute_force(spark, workspace, monkeypatch, block):
    monkeypatch.setattr(setjoin, "BLOCK", block)
    rng = random.Random(6)
    common, rare = ["O", "Cl", "CCO"], [f"x{i}" for i in range(60)]
    rows = []
    for i in range(160):
        items = rng.sample(rare, rng.randint(0, 7)) + rng.sample(common, rng.randint(0, 3))
        rng.shuffle(items)
        rows.append((f"r{i:03d}", " . ".join(items + items[:1]) + ". "))
        if i % 3 == 0:
            rows.append((f"c{i:03d}", ".".join(reversed(items[:-1] + rng.sample(rare, 1) if items and i % 2 else items))))
    rows += [("null", None), (None, "O.Cl"), ("blank", " . ."), rows[0], ("same1", "a.b"), ("same2", "b. a"), ("same3", "a.b.b")]
    df = spark.createDataFrame([(a, b, 1, "z") for a, b in rows], "sample_id string, smiles string, class int, items string")
    got = [(r.id_1, r.id_2) for r in setjoin.similar_records(setjoin.component_sets(df, "sample_id", "smiles"), workspace, 0.6).collect()]
    assert set(got) == brute_sets(rows, 0.6) and len(got) == len(set(got))


def test_copies_in_blocks_and_in_class_form(spark, workspace, monkeypatch):
    monkeypatch.setattr(setjoin, "MEMBERS", 7)
    monkeypatch.setattr(setjoin, "hot_keys", lambda df, key, total: df.groupBy(key).count().where("count > 5").select(key))
    rows = [(f"c{i:02d}", "A.B.C.D.E") for i in range(40)] + [(f"d{i}", "A.B.C.D.F") for i in range(9)] + [("e", "X.Y"), ("f", "E.D.C.B.A.G")]
    df = spark.createDataFrame(rows, "sample_id string, smiles string")
    sets = setjoin.component_sets(df, "sample_id", "smiles")
    parts = {i: set(s.split(".")) for i, s in rows}
    want = sorted((x, y) for x in parts for y in parts if x < y and len(parts[x] & parts[y]) >= 0.6 * len(parts[x] | parts[y]))
    assert sorted((r.id_1, r.id_2) for r in setjoin.similar_records(sets, workspace, 0.6).collect()) == want
    links = {r.id: (r.class_id, r.links) for r in setjoin.class_links(sets, workspace, 0.6).collect()}
    assert links["c17"] == ("c00", 2) and links["d3"] == ("d0", 1 + (("d0", "f") in want)) and links["e"] == ("e", 0)


def test_set_join_of_nothing(spark, workspace):
    df = spark.createDataFrame([], "sample_id string, smiles string")
    assert setjoin.similar_records(setjoin.component_sets(df, "sample_id", "smiles"), workspace).count() == 0


def test_merge_skip_counts_occurrences():
    rng = random.Random(7)
    for _ in range(300):
        lists = [sorted(rng.sample(range(60), rng.randint(0, 40))) for _ in range(rng.randint(1, 9))]
        need = rng.randint(1, 6)
        want = sorted((e, c) for e in range(60) if (c := sum(e in x for x in lists)) >= need)
        assert sorted(setjoin.merge_skip(lists, need)) == want
