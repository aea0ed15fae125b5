"""Kernels against hand-checked values and plain Python."""

import math

import pytest
from pyspark.sql import functions as F

from nearfield.functions import features
from nearfield.functions import kernels as K
from nearfield.functions import pandas_kernels as PK


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def vec(*xs):
    return F.array(*[F.lit(float(x)) for x in xs])


def words(*xs):
    return F.array(*map(F.lit, xs)).cast("array<string>")


CASES = {
    "jaccard": (lambda: K.jaccard(words("a", "b"), words("a", "b", "c")), 2 / 3),
    "jaccard_empty": (lambda: K.jaccard(words(), words()), 1.0),
    "cosine": (lambda: K.cosine(vec(1, 0), vec(1, 1)), 1 / math.sqrt(2)),
    "cosine_zero": (lambda: K.cosine(vec(0, 0), vec(1, 1)), 0.0),
    "cosine_zeros": (lambda: K.cosine(vec(0, 0), vec(0, 0)), 1.0),
    "angle_self": (lambda: K.spectral_angle(vec(1, 0), vec(1, 0)), 1.0),
    "pearson_up": (lambda: K.pearson(vec(1, 2, 3), vec(1, 2, 3)), 1.0),
    "pearson_down": (lambda: K.pearson(vec(1, 2, 3), vec(3, 2, 1)), 0.0),
    "pearson_constant": (lambda: K.pearson(vec(1, 1), vec(1, 2)), 0.0),
    "pearson_both_constant": (lambda: K.pearson(vec(1, 1), vec(1, 1)), 1.0),
    "bray_curtis_self": (lambda: K.bray_curtis(vec(1, 0), vec(1, 0)), 1.0),
    "bray_curtis_other": (lambda: K.bray_curtis(vec(1, 0), vec(0, 1)), 0.0),
    "bray_curtis_zero": (lambda: K.bray_curtis(vec(0, 0), vec(0, 0)), 1.0),
    "js_self": (lambda: K.jensen_shannon(vec(1, 0), vec(1, 0)), 1.0),
    "js_other": (lambda: K.jensen_shannon(vec(1, 0), vec(0, 1)), 0.0),
    "identity": (lambda: K.sequence_identity(F.lit("AAAT"), F.lit("AAAA")), 0.75),
    "identity_length": (lambda: K.sequence_identity(F.lit("AAT"), F.lit("AAAT")), 0.75),
    "identity_empty": (lambda: K.sequence_identity(F.lit(""), F.lit("")), 1.0),
    "edit": (lambda: K.edit_similarity(F.lit("ABCE"), F.lit("ABCD")), 0.75),
    "positional": (lambda: K.positional_identity(F.lit("ABX"), F.lit("ABCDE")), 0.4),
    "linear": (lambda: K.metric_to_similarity(F.lit(1.0), "linear", 2.0), 0.5),
    "inverse": (lambda: K.metric_to_similarity(F.lit(1.0), "inverse"), 0.5),
    "haversine_self": (lambda: K.haversine_similarity(F.lit(1.0), F.lit(2.0), F.lit(1.0), F.lit(2.0)), 1.0),
    "ibs_self": (lambda: K.genotype_ibs(vec(0, 1), vec(0, 1)), 1.0),
    "ibs_missing": (lambda: K.genotype_ibs(F.array(F.lit(None).cast("double"), F.lit(0.0)), vec(1, 2)), 0.0),
    "hamming": (lambda: K.hamming_similarity(F.lit(0b1000), F.lit(0b1100), F.lit(4)), 0.75),
    "weighted": (lambda: K.weighted_jaccard(features.weighted_set(F.lit("a:1;b:1")), features.weighted_set(F.lit("a:2;b"))), 2 / 3),
    "tanimoto": (lambda: K.bits_tanimoto(features.bit_set(F.lit("1000")), features.bit_set(F.lit("1100"))), 0.5),
    "chamfer_self": (lambda: K.chamfer(features.points(F.lit("0:0;1:0")), features.points(F.lit("0:0;1:0"))), 1.0),
    "chamfer_empty": (lambda: K.chamfer(features.points(F.lit("")), features.points(F.lit("0:0"))), 0.0),
    "formula": (lambda: K.map_overlap(K.formula_fractions(F.lit("H2O")), K.formula_fractions(F.lit("CO2"))), 1 / 3),
    "ngram_short": (lambda: F.size(K.char_ngrams(F.lit("ab"))).cast("double"), 1.0),
    "ngram": (lambda: F.size(K.char_ngrams(F.lit("abcd"))).cast("double"), 6.0),
    "mixed": (lambda: K.mixed_metadata([(F.lit("2"), F.lit("3")), (F.lit("a"), F.lit("b"))]), 0.25),
    "mixed_null": (lambda: K.mixed_metadata([(F.lit(None).cast("string"), F.lit(None).cast("string"))]), 1.0),
    "group": (lambda: K.group_equality([(F.lit(None).cast("string"), F.lit(None).cast("string")), (F.lit(1), F.lit(1))]), 1.0),
    "sinkhorn_self_above_other": (lambda: (PK.sinkhorn_similarity()(vec(1, 0), vec(1, 0)) > PK.sinkhorn_similarity()(vec(1, 0), vec(0, 1))).cast("double"), 1.0),
    "alignment_self": (lambda: PK.alignment_identity()(F.lit("ACGT"), F.lit("ACGT")), 1.0),
    "alignment_events": (lambda: PK.alignment_identity()(words("A", "B", "C"), words("A", "B", "D")), 2 / 3),
    "dtw_self": (lambda: PK.dtw_similarity()(vec(0, 1, 2), vec(0, 1, 2)), 1.0),
    "dtw_empty": (lambda: PK.dtw_similarity()(F.array().cast("array<double>"), vec(1)), 0.0),
    "spectrum_self": (lambda: PK.spectrum_similarity()(features.peaks(F.lit("100:1;200:1")), features.peaks(F.lit("200:1;100:1"))), 1.0),
    "spectrum_other": (lambda: PK.spectrum_similarity()(features.peaks(F.lit("100:1;200:1")), features.peaks(F.lit("150:1"))), 0.0),
}


@pytest.mark.parametrize("name", list(CASES))
def test_kernel(spark, name):
    column, want = CASES[name]
    assert value(spark, column()) == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("name", ["jaccard", "cosine", "pearson", "bray_curtis", "jensen_shannon", "sequence_identity", "edit", "positional_identity", "genotype_ibs", "chamfer"])
def test_null_gives_null(spark, name):
    kind = {"jaccard": "array<string>", "sequence_identity": "string", "edit": "string", "positional_identity": "string", "chamfer": "array<array<double>>"}.get(name, "array<double>")
    null = F.lit(None).cast(kind)
    other = {"array<string>": words("a"), "string": F.lit("a"), "array<double>": vec(1, 2), "array<array<double>>": F.array(vec(1, 2))}[kind]
    assert value(spark, K.REGISTRY[name](null, other)) is None


def test_non_finite_distance_fails(spark):
    with pytest.raises(Exception, match="not finite"):
        value(spark, K.metric_to_similarity(F.lit(float("inf"))))


def test_parsers(spark):
    assert value(spark, features.token_set(F.lit(" a; b ;;a\t"))) == ["a", "b"]
    assert value(spark, features.token_set(F.lit(None).cast("string"))) == []
    assert value(spark, features.weighted_set(F.lit("a:2;b;a:1;c:-1"))) == {"a": 3.0, "b": 1.0}
    assert value(spark, features.bit_set(F.lit("1;5;9"))) == [1, 5, 9]
    assert value(spark, features.numbers(F.lit("1;2.5"))) == [1.0, 2.5]
    assert value(spark, features.word_shingles(F.lit("a b c d e f"))) == ["a b c d e", "b c d e f"]
    assert value(spark, features.word_shingles(F.lit("a b"))) == []
    assert value(spark, K.centred_window(F.lit("ABCDEFG"), F.lit(4.0), 1)) == "CDE"


def test_vector_choice(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0)], "id int, emb_0 double, emb_1 double")
    assert df.select(features.vector(df, prefix="emb_")).first()[0] == [2.0, 3.0]
    assert df.select(features.vector(df, ids=("id",))).first()[0] == [2.0, 3.0]
    with pytest.raises(ValueError):
        features.vector(df, ["nope"])


def test_row_ids_follow_an_explicit_order(spark):
    df = spark.createDataFrame([(x,) for x in "dbca"], "k string").repartition(3)
    assert {r.k: r.sample_id for r in features.row_ids(df, "eval_", ["k"]).collect()} == {"a": "eval_00000", "b": "eval_00001", "c": "eval_00002", "d": "eval_00003"}


def test_batched_programs_match_plain_recursions():
    """Every table of the batch kernels against a memoised recursion, over pairs of many sizes in one call."""
    import random
    from functools import cache

    rng = random.Random(12)
    texts = ["".join(rng.choice("ABC") for _ in range(rng.randint(0, 9))) for _ in range(60)]
    left, right = texts[:30], texts[30:]
    matches, length = PK.align_batch(left, right)
    for k, (a, b) in enumerate(zip(left, right)):

        @cache
        def best(i, j, a=a, b=b):
            """(score, order of preference, matches, length)"""
            if not i or not j:
                return -(i + j), 0, i + j
            same = a[i - 1] == b[j - 1]
            options = [(best(i - 1, j - 1), 2 * same - 1, same), (best(i - 1, j), -1, 0), (best(i, j - 1), -1, 0)]
            step, gain, hit = max(options, key=lambda o: o[0][0] + o[1])
            return step[0] + gain, step[1] + hit, step[2] + 1

        assert (matches[k], length[k]) == best(len(a), len(b))[1:]
    series = [[rng.gauss(0, 1) for _ in range(rng.randint(1, 8))] for _ in range(60)]
    for window in (None, 1, 3):
        got = PK.dtw_batch(series[:30], series[30:], window)
        for k, (a, b) in enumerate(zip(series[:30], series[30:])):
            band = max(window if window is not None else 99, abs(len(a) - len(b)))

            @cache
            def cost(i, j, a=a, b=b, band=band):
                if i == 0 or j == 0:
                    return 0.0 if i == j else float("inf")
                if abs(i - j) > band:
                    return float("inf")
                return abs(a[i - 1] - b[j - 1]) + min(cost(i - 1, j), cost(i, j - 1), cost(i - 1, j - 1))

            assert got[k] == pytest.approx(cost(len(a), len(b)) / (len(a) + len(b)))
    peaks = lambda: [(round(rng.random() * 3, 2), rng.choice([0.0, 1.0, rng.random()])) for _ in range(rng.randint(0, 9))]
    left, right = [peaks() for _ in range(40)], [peaks() for _ in range(40)]
    got = PK.spectrum_batch(left, right, 0.1)
    for k, (a, b) in enumerate(zip(left, right)):
        x, y = sorted(p for p in a if p[1] > 0), sorted(p for p in b if p[1] > 0)
        norm = (sum(v * v for _, v in x) * sum(v * v for _, v in y)) ** 0.5
        total = 0.0
        while x and y:
            if abs(x[0][0] - y[0][0]) <= 0.1:
                total += x.pop(0)[1] * y.pop(0)[1]
            else:
                (x if x[0][0] < y[0][0] else y).pop(0)
        assert got[k] == pytest.approx(total / norm if norm else float(not [p for p in a + b if p[1] > 0]))
