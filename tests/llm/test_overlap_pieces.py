"""Pieces with at most one edit find every pair within the allowed edits, and few others."""

import random

import numpy as np
import pandas as pd
import pytest

from nearfield.llm import overlap

FRAGMENTS = ["C(=O)N", "CCO", "c1ccccc1", "N", "S", "[C@H](C)", "C#N", "C(F)(F)", "OC(=O)C", "[Se]", "NN", "CCS", "P(=O)(O)", "C=C", "Cl", "B(O)"]


def distance(a, b):
    row = np.arange(len(b) + 1)
    places = np.arange(len(b) + 1)
    codes = np.array([ord(c) for c in b])
    for i, x in enumerate(a, 1):
        new = np.concatenate([[i], np.minimum(row[1:] + 1, row[:-1] + (codes != ord(x)))])
        row = np.minimum.accumulate(new - places) + places
    return int(row[-1])


def close(a, b):
    most = max(len(a), len(b))
    return abs(len(a) - len(b)) * 10 <= most and distance(a, b) * 10 <= most


def edited(rng, text, kinds, evenly):
    s = list(text)
    k = max(1, len(s) // 10 + rng.choice([0, 0, 1]))
    places = [min(len(s) - 1, int((x + 0.5) * len(s) / k)) for x in range(k)] if evenly else [rng.randrange(len(s)) for _ in range(k)]
    for p in sorted(places, reverse=True):
        kind, p = rng.choice(kinds), min(p, len(s) - 1)
        if kind == "s":
            s[p] = rng.choice("CNOX")
        elif kind == "d":
            del s[p]
        else:
            s.insert(p + rng.randint(0, 1), rng.choice("CNOX"))
    return "".join(s)


@pytest.mark.parametrize("length", [9, 10, 18, 20, 29, 40, 71, 72, 100, 112, 119, 150])
def test_no_pair_is_lost_at_any_length(length):
    rng = random.Random(length)
    for alphabet in ("AB", "CNO()=1c[]@H"):
        train = ["".join(rng.choice(alphabet) for _ in range(rng.randint(length, int(length * 1.03)))) for _ in range(8)]
        evals = [edited(rng, t, kinds, evenly) for t in train for kinds in ("s", "i", "d", "id", "sid") for evenly in (True, False)]
        evals = [e for e in evals if len(e) >= 9]
        found = {(int(i), int(j)) for fe, ft in overlap.PieceIndex(train).candidates(evals) for i, j in zip(fe, ft)}
        assert found >= {(i, j) for i, a in enumerate(evals) for j, b in enumerate(train) if close(a, b)}


def test_few_pairs_are_looked_at(monkeypatch):
    rng = random.Random(3)

    def text():
        out = ""
        while len(out) < 109:
            out += rng.choice(FRAGMENTS)
        return out[:112]

    train, evals = [text() for _ in range(3_000)], [text() for _ in range(300)]
    listed, met = [], overlap.PieceIndex._met

    def counted(self, *args):
        for pairs in met(self, *args):
            listed.append(len(pairs))
            yield pairs

    monkeypatch.setattr(overlap.PieceIndex, "_met", counted)
    cell = pd.DataFrame({"text": train + evals, "role": [0] * len(train) + [1] * len(evals), "kind": 0})
    overlap._cell(cell)
    assert 0 < sum(listed) < len(train) * len(evals) / 100


def test_one_cell_of_texts_looked_up_by_pieces_and_by_chunks(monkeypatch):
    rng = random.Random(8)
    train = ["".join(rng.choice("CNO()=") for _ in range(n)) for n in (392, 396, 399, 400, 401)]
    evals = [edited(rng, t, kinds, True) for t in train for kinds in ("s", "i", "d", "sid")] + [train[0] + "C"]
    cell = pd.DataFrame({"text": train + evals, "role": [0] * len(train) + [1] * len(evals), "kind": 0})
    got = overlap._cell(cell)
    assert set(zip(got["a"], got["b"])) >= {(a, b) for a in evals for b in train if close(a, b)}
    best = got[(got["a"] == train[0] + "C") & (got["b"] == train[0])]
    assert best["overlap"].min() > 0.9 and got["overlap"].between(0, 1).all()
