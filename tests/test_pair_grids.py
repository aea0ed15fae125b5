"""Kernels over blocks of pairs against plain dynamic programs and walks."""

import itertools
import math
import random
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

from nearfield.functions import pandas_kernels as PK
from nearfield.operators import indexes
from nearfield.storage import Workspace


def walk(a, b, tolerance):
    a, b = (sorted(p for p in r if p[1] > 0) for r in (a, b))
    if not a or not b:
        return float(not a and not b)
    i = j = 0
    total = 0.0
    while i < len(a) and j < len(b):
        gap = a[i][0] - b[j][0]
        hit = abs(gap) <= tolerance
        total += a[i][1] * b[j][1] * hit
        i, j = i + (hit or gap < 0), j + (hit or gap > 0)
    norm = [sum(p[1] ** 2 for p in r) ** 0.5 for r in (a, b)]
    return min(1.0, total / norm[0] / norm[1])


def test_spectrum_grid_takes_each_peak_once():
    rng = np.random.default_rng(1)
    some = lambda n: [[(round(float(rng.uniform(0, 0.4)), 3), float(rng.integers(-1, 5))) for _ in range(rng.integers(0, 40))] for _ in range(n)]
    left, right = some(15) + [[]], some(25) + [[]]
    lot = lambda rows: PK.spectrum_lots(pd.DataFrame({"mz": [[p[0] for p in r] for r in rows], "intensity": [[p[1] for p in r] for r in rows]}))
    assert np.allclose(PK.spectrum_grid(lot(left), lot(right), 0.01), [[walk(a, b, 0.01) for b in right] for a in left])


def warp(a, b, window):
    band = max(window, abs(len(a) - len(b)))
    d = np.full((len(a) + 1, len(b) + 1), np.inf)
    d[0, 0] = 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            if abs(i - j) <= band:
                d[i, j] = abs(a[i - 1] - b[j - 1]) + min(d[i - 1, j], d[i, j - 1], d[i - 1, j - 1])
    return np.exp(-d[-1, -1] / (len(a) + len(b)) / 2)


@pytest.mark.parametrize("least", [None, 0.7, 0.9])
def test_dtw_grid(least):
    rng = np.random.default_rng(2)
    left, right = ([rng.normal(size=rng.integers(1, 30)) for _ in range(n)] for n in (12, 40))
    want = np.array([[warp(a, b, 3) for b in right] for a in left])
    assert np.allclose(PK.dtw_grid(2.0, 3, least)(left, right), want if least is None else np.where(want >= least, want, -np.inf))


def test_alignment_grid_beyond_32_bits():
    """Long rows need 64 bits a cell."""
    rng = np.random.default_rng(3)
    row = rng.integers(0, 4, 700).tolist()
    assert PK.alignment_grid([row, [1, 2]], [row, [], [2]]).tolist() == [[1.0, 0.0, 1 / 700], [2 / 700, 0.0, 0.5]]


@pytest.mark.parametrize("name", ["kernel_spectrum", "kernel_dtw", "kernel_event_alignment", "dtw_pruned"])
def test_features_are_not_copied_to_every_pair(spark, name):
    import __spark_entry__

    if not Path("/root/testdata/sf0.001").exists():
        pytest.skip("no test data")
    plan = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().analyzed().toString()
    assert "FlatMapCoGroupsInPandas" in plan and "ArrowEvalPython" not in plan and " Join " not in plan


def test_trajectories_list_no_pair_that_the_boxes_alone_allow(spark, workspace, monkeypatch):
    rng = random.Random(21)
    # all boxes are the same, only few trajectories are alike; some sets of points come several times
    rows = [(f"t{k}", [[0.0, 0.0], [50.0, 50.0], *([float(rng.randint(1, 49)), float(rng.randint(1, 49))] for _ in range(3))]) for k in range(150)]
    rows += [(f"u{k}", list(reversed(p)) + p[:1]) for k, (_, p) in enumerate(rows[:20])]
    rows += [(f"v{k}", [[x + 0.5, y - 0.5] for x, y in p]) for k, (_, p) in enumerate(rows[:20])]
    odd = [("nan", [[0.0, float("nan")], [50.0, 50.0]]), ("inf", [[float("inf"), 0.0]]), ("none", [None, [None, 1.0]]), (None, rows[0][1])]
    far = lambda x, y: max(min(math.dist(p, q) for q in y) for p in x)
    want = {(min(a, b), max(a, b)): max(far(x, y), far(y, x)) for (a, x), (b, y) in itertools.combinations(rows, 2)}
    want = {k: d for k, d in want.items() if d <= 2}
    saved, save = [], Workspace.save

    def watched(self, df, name, *args, **more):
        out = save(self, df, name, *args, **more)
        saved.append(out.count())
        return out

    monkeypatch.setattr(Workspace, "save", watched)
    monkeypatch.setattr(indexes, "BLOCK_ROWS", 40)
    found = indexes.trajectory_join(spark.createDataFrame([*rows, *odd], "id string, points array<array<double>>"), 2.0, workspace).collect()
    assert len(found) == len(want) and {(r.c1, r.c2): r.distance for r in found} == want
    assert max(saved) < 500  # 17,955 pairs have the same box


def test_equal_trajectories_are_unfolded_where_they_are_found(spark, workspace, monkeypatch):
    """No table of pairs is written, and none is shuffled before it leaves, though 3 sets stand for 120 trajectories."""
    sets = [[[0.0, 0.0], [5.0, 5.0]], [[0.3, 0.4], [5.0, 5.0]], [[9.0, 9.0]]]
    rows = [(k * 3 + s, random.Random(k).sample(p, len(p)) + p[:1] * (k % 2)) for k in range(40) for s, p in enumerate(sets)]
    far = [[0.0, 0.5], [0.5, 0.0]]
    want = {(a, b): 0.0 if a % 3 == b % 3 else far[a % 3][b % 3] for a, b in itertools.combinations(range(120), 2) if a % 3 == b % 3 or 2 not in (a % 3, b % 3)}
    saved, save = [], Workspace.save

    def watched(self, df, name, *args, **more):
        out = save(self, df, name, *args, **more)
        saved.append(out.count())
        return out

    monkeypatch.setattr(Workspace, "save", watched)
    monkeypatch.setattr(indexes, "BLOCK_ROWS", 2)
    df = spark.createDataFrame(rows, "id int, points array<array<double>>")
    for members, sent in ((1_000, 1 << 20), (7, 20)):  # one list a set, or several that meet each other
        monkeypatch.setattr(indexes, "TRIP_MEMBERS", members)
        monkeypatch.setattr(indexes, "TRIP_SENT", sent)
        out = indexes.trajectory_join(df, 2.0, workspace, 3)
        found = out.collect()
        assert len(found) == len(want) and {(r.c1, r.c2): r.distance for r in found} == want
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan.partition("FlatMapGroupsInArrow")[0]
    assert max(saved) <= 120
