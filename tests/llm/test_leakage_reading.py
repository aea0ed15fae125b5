"""Leaked passages and reading levels."""

import random

import pytest

from nearfield.llm import leakage, reading

VOCAB = [f"{a}{b}{c}" for a in ("tam", "vel", "kan", "ost", "mor") for b in ("dos", "rux", "pel", "gim", "lor") for c in ("ire", "zan", "bex", "hul", "sed")]


def passage(rng, n):
    return [rng.choice(VOCAB) for _ in range(n)]


def edit(rng, words, edits):
    words = list(words)
    step = len(words) // (edits + 1)
    for e in range(edits, 0, -1):
        kind, p = rng.random(), e * step
        if kind < 0.4:
            words[p] = "changed"
        elif kind < 0.7:
            del words[p]
        else:
            words.insert(p, "added")
    return words


def allowed_run(item, doc):
    """Brute force: some span of at least 14 item words within a seventh as many edits of some span of the document."""
    n = len(item)
    for i in range(n):
        for j in range(i + 14, min(n, i + 27) + 1):
            span, k = item[i:j], (j - i) // 7
            row = [0] * (len(doc) + 1)
            for x in span:
                new = [row[0] + 1]
                for q, y in enumerate(doc, 1):
                    new.append(min(row[q] + 1, new[-1] + 1, row[q - 1] + (x != y)))
                row = new
            if min(row) <= k and span[0] in doc and span[-1] in doc:
                return True
    return False


STYLES = {
    "plain": lambda w: " ".join(w),
    "case": lambda w: " ".join(w).upper(),
    "lines": lambda w: "\n> ".join(" ".join(w[i : i + 5]) for i in range(0, len(w), 5)),
    "html": lambda w: "&nbsp; ".join(f"<b>{x}</b>" if i % 3 == 0 else x for i, x in enumerate(w)),
    "hyphen": lambda w: " ".join(f"{x[:3]}-\n{x[3:]}" if i % 4 == 1 else x for i, x in enumerate(w)),
    "soft": lambda w: " ".join(f"{x[:2]}­{x[2:]}​" for x in w),
    "wide": lambda w: " ".join("".join(chr(ord(c) + 0xFEE0) for c in x) for x in w),
    "marks": lambda w: ", ".join(f"*{x}*" if i % 2 else f"_{x}_" for i, x in enumerate(w)),
}


@pytest.mark.parametrize("style", list(STYLES))
def test_style_makes_no_difference(style):
    item = passage(random.Random(1), 40)
    assert leakage.words("Before. " + STYLES[style](item) + " ... after") == ["before", *item, "after"]


def test_runs_are_found_exactly_as_defined():
    rng = random.Random(2)
    items = [(i, passage(rng, rng.randint(14, 50))) for i in range(12)]
    index = leakage.ItemIndex(items)
    vectors = leakage._Vectors()
    checked = 0
    for _ in range(150):
        item_id, item = rng.choice(items)
        n = rng.randint(8, len(item))
        at = rng.randint(0, len(item) - n)
        doc = passage(rng, 6) + edit(rng, item[at : at + n], rng.choice([0, 0, 1, 2, 3, n // 4])) + passage(rng, 6)
        got = {leak[1] for leak in index.leaks([doc], vectors)}
        want = {i for i, w in items if allowed_run(w, doc)}
        assert got <= want
        strict = {i for i, w in items if leakage_run(w, doc)}
        assert strict <= got
        checked += bool(strict)
    assert checked > 30


def test_a_near_window_before_a_run_hides_nothing():
    """Item and document differ in one word before a run, and the window with that word is within the radius."""
    rng = random.Random(11)
    vectors = leakage._Vectors()
    rest = passage(rng, 20)
    first = int(leakage.fingerprints(["x", *rest[:3]], vectors)[0])
    near = next(w for w in (f"w{k}" for k in range(100_000)) if (int(leakage.fingerprints([w, *rest[:3]], vectors)[0]) ^ first).bit_count() <= leakage.RADIUS)
    index = leakage.ItemIndex([(7, ["x", *rest])])
    doc = [near, *rest]
    assert [leak[1:4] for leak in index.leaks([doc], vectors)] == [(7, 20, 0)]


def leakage_run(item, doc):
    """Runs that begin and end with words of their own, by walking from every common window."""
    windows = {}
    for j in range(len(doc) - 3):
        windows.setdefault(tuple(doc[j : j + 4]), []).append(j)
    return any(leakage.run_from_seed(item, i, doc, j) for i in range(len(item) - 3) for j in windows.get(tuple(item[i : i + 4]), ()))


def test_all_fingerprints_within_the_radius_are_found():
    import numpy as np

    rng = np.random.default_rng(3)
    words = passage(random.Random(4), 60)
    index = leakage.HammingBlocks(leakage.fingerprints(words, leakage._Vectors(), 14))
    base = index.prints[:20]
    probes = []
    for p in base:
        for r in range(5):
            flip = np.uint64(0)
            for b in rng.choice(64, r, replace=False):
                flip |= np.uint64(1) << np.uint64(b)
            probes.append(p ^ flip)
    probes = np.array(probes, dtype="uint64")
    got = set(zip(*map(list, index.within(probes))))
    want = {(i, j) for i in range(len(probes)) for j in range(len(index.prints)) if int(np.bitwise_count(probes[i] ^ index.prints[j])) <= leakage.RADIUS}
    assert got == want


@pytest.mark.parametrize("size", [14, 28, 56, 112])
def test_item_sized_windows_find_whole_items_and_the_radius_decides(size):
    """Whole items come by windows of their own size; with one word changed many of them at a distance of 1 to 3."""
    rng = random.Random(size)
    items = [(i, passage(rng, size + rng.randint(0, size // 4))) for i in range(40)]
    index, vectors = leakage.ItemIndex(items), leakage._Vectors()
    docs = [passage(rng, 9) + w + passage(rng, 9) for _, w in items]
    got = sorted(index.leaks(docs, vectors))
    assert [leak[:2] for leak in got] == [(i, i) for i in range(40)] and {leak[5] for leak in got} == {size} and min(leak[6] for leak in got) == 0
    changed = [w[:k] + ["changed"] + w[k + 1 :] for _, w in items for k in [len(w) // 2]]
    got = sorted(index.leaks(changed, vectors))
    assert [leak[:2] for leak in got] == [(i, i) for i in range(40)]
    if size >= 56:
        assert any(leak[5] == size and 1 <= leak[6] <= 3 for leak in got)


def test_documents_in_one_group_do_not_run_into_each_other(monkeypatch):
    monkeypatch.setattr(leakage, "CHUNK", 16)
    rng = random.Random(21)
    item = passage(rng, 40)
    docs = [item[:10], item[10:20], passage(rng, 30) + item[5:30], [], item[20:], passage(rng, 3)]
    got = leakage.ItemIndex([(1, item)]).leaks(docs, leakage._Vectors())
    assert sorted(leak[0] for leak in got) == [2, 4]


def test_find_leaks_on_tables(spark):
    rng = random.Random(5)
    a, b = passage(rng, 30), passage(rng, 30)
    docs = spark.createDataFrame(
        [(1, "x " + " ".join(a[3:20]), "q"), (2, " ".join(a[:12]), "q"), (3, None, "q"), (4, "", "q"), (None, " ".join(a), "q"), (5, "word " * 60_000 + " ".join(b), "q"), (1, "x " + " ".join(a[3:20]), "again")],
        "doc_id bigint, text string, item_id string",
    )
    items = spark.createDataFrame([(1, " ".join(a), "s"), (2, " ".join(b), "s"), (3, " ".join(a).upper(), "s"), (4, None, "s"), (None, " ".join(b), "s"), (5, "too short", "s")], "item_id bigint, text string, doc_id string")
    assert {(r.doc_id, r.item_id) for r in leakage.find_leaks(docs, items).collect()} == {(1, 1), (1, 3), (5, 2)}
    assert leakage.find_leaks(docs.where("false"), items).count() == 0
    assert leakage.find_leaks(docs, items.where("false")).count() == 0


def test_items_in_several_passes(spark, monkeypatch):
    monkeypatch.setattr(leakage, "ITEM_WORDS_PER_PASS", 20)
    rng = random.Random(6)
    texts = [" ".join(passage(rng, 25)) for _ in range(5)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    items = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "item_id bigint, text string")
    assert {(r.doc_id, r.item_id) for r in leakage.find_leaks(docs, items).collect()} == {(i, i) for i in range(5)}


EASY = ["the cat sees a red box", "my friend likes the big dog", "we put the ball in the box", "a dog runs to the red house"]
HARD = ["notwithstanding the stochastic heterogeneity of covariates", "the asymptotic identifiability necessitates regularised inference", "hierarchical misspecification confounds marginal exchangeability", "epistemic calibration precludes nonparametric stratification"]


def document(rng, share):
    sentences = [rng.choice(HARD if rng.random() < share else EASY) for _ in range(12)]
    return ". ".join(sentences) + "."


def test_levels_follow_labels(spark, workspace):
    rng = random.Random(7)
    docs = [(i, document(rng, 1.0 if i % 2 else 0.0)) for i in range(80)]
    mixed = [(1000, ". ".join(HARD * 2 + EASY) + "."), (1001, ". ".join(HARD + EASY * 3) + ".")]
    extra = [(2000, None), (2001, " \n "), (2002, "?!"), (None, "the cat"), (2003, "the cat sees " * 20_000)]
    labels = [(i, f"r{i % 3}", 5 if i % 2 else 1) for i in range(0, 40)] + [(1, "r9", None), (3, "r1", 9), (99999, "r1", 3), (None, "r1", 3), (1, "r1", 5)]
    d = spark.createDataFrame(docs + mixed + extra + docs[:2], "doc_id bigint, text string")
    y = spark.createDataFrame(labels, "doc_id bigint, reader string, reading_level int")
    got = {r.doc_id: r for r in reading.reading_levels(d, y, workspace).collect()}
    assert set(got) == {i for i, _ in docs} | {1000, 1001, 2003}
    for i in range(80):
        assert (got[i].hard_share > 0.5) == bool(i % 2), i
    assert got[1000].hard_share > 0.5 > got[1001].hard_share
    assert 0.5 <= min(r.level for r in got.values()) and max(r.level for r in got.values()) <= 5.5


def test_shuffle_join_beyond_the_broadcast_bound_gives_the_same(spark, workspace, monkeypatch):
    rng = random.Random(8)
    d = spark.createDataFrame([(i, document(rng, i % 2)) for i in range(30)], "doc_id bigint, text string")
    y = spark.createDataFrame([(i, "r", 5 if i % 2 else 1) for i in range(10)], "doc_id bigint, reader string, reading_level int")
    one = {r.doc_id: round(r.level, 9) for r in reading.reading_levels(d, y, workspace).collect()}
    monkeypatch.setattr(reading, "BROADCAST_WORDS", 0)
    assert one == {r.doc_id: round(r.level, 9) for r in reading.reading_levels(d, y, workspace).collect()}


def test_without_labels_or_documents(spark, workspace):
    d = spark.createDataFrame([(1, "one two three")], "doc_id bigint, text string")
    y = spark.createDataFrame([], "doc_id bigint, reader string, reading_level int")
    rows = reading.reading_levels(d, y, workspace).collect()
    assert len(rows) == 1 and rows[0].level is None and rows[0].hard_share == 0
    assert reading.reading_levels(d.where("false"), y, workspace).count() == 0
