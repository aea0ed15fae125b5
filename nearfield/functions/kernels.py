"""Similarity kernels as Column expressions: they run inside the JVM and take any two columns.

Every kernel returns a DOUBLE.  Null inputs give null.  Empty or zero inputs have the defined results in
the docstrings.  Arrays are ``array<double>`` (vectors), ``array<string>`` (sets, sequences),
``map<string,double>`` (weighted sets) or ``array<array<double>>`` (point clouds).
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088
_ZERO = 0.0


def _null_if_either(kernel):
    """Null for a null on either side (greatest and least alone would skip it)."""

    @functools.wraps(kernel)
    def guarded(a: Column, b: Column, *more, **options) -> Column:
        return F.when(a.isNotNull() & b.isNotNull(), kernel(a, b, *more, **options))

    return guarded


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(_ZERO), lambda x, y: x + y)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit_interval(x: Column) -> Column:
    return F.greatest(F.lit(_ZERO), F.least(F.lit(1.0), x))


@_null_if_either
def jaccard(a: Column, b: Column) -> Column:
    """Set Jaccard (K1); two empty sets are 1."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


@_null_if_either
def containment(a: Column, b: Column) -> Column:
    """Share of ``a`` in ``b``; an empty ``a`` is contained."""
    n = F.size(F.array_distinct(a))
    return F.when(n == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / n)


@_null_if_either
def cosine(a: Column, b: Column) -> Column:
    """Cosine in -1..1 (K2); two zero vectors are 1, one is 0."""
    na, nb = norm(a), norm(b)
    return F.when((na == 0) & (nb == 0), F.lit(1.0)).when((na == 0) | (nb == 0), F.lit(_ZERO)).otherwise(dot(a, b) / (na * nb))


def half_shifted(x: Column) -> Column:
    """-1..1 to 0..1."""
    return (F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)) + 1) / 2


@_null_if_either
def spectral_angle(a: Column, b: Column) -> Column:
    """Clipped cosine to 0..1 (K3)."""
    return half_shifted(cosine(a, b))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def manhattan(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


@_null_if_either
def pearson(a: Column, b: Column, raw: bool = False) -> Column:
    """Correlation (K4), to 0..1 unless raw; two constant vectors are 1 if equal else 0, one constant is 0."""
    ca = F.transform(a, lambda x: x - total(a) / F.size(a))
    cb = F.transform(b, lambda x: x - total(b) / F.size(b))
    na, nb = norm(ca), norm(cb)
    both = F.when(a == b, F.lit(1.0)).otherwise(F.lit(_ZERO))
    r = dot(ca, cb) / (na * nb)
    value = r if raw else half_shifted(r)
    return F.when((na == 0) & (nb == 0), both).when((na == 0) | (nb == 0), F.lit(_ZERO)).otherwise(value)


@_null_if_either
def bray_curtis(a: Column, b: Column) -> Column:
    """1 - sum|a-b| / sum(a+b) over non-negative parts (K5); two zero vectors are 1."""
    clip = lambda v: F.transform(v, lambda x: F.greatest(x, F.lit(_ZERO)))
    ca, cb = clip(a), clip(b)
    whole = total(ca) + total(cb)
    return F.when(whole == 0, F.lit(1.0)).otherwise(unit_interval(1 - manhattan(ca, cb) / whole))


def _distribution(a: Column) -> Column:
    clipped = F.transform(a, lambda x: F.greatest(x, F.lit(_ZERO)))
    whole = total(clipped)
    return F.transform(clipped, lambda x: F.when(whole == 0, 1.0 / F.size(a)).otherwise(x / whole))


@_null_if_either
def jensen_shannon(a: Column, b: Column) -> Column:
    """1 - JS / ln 2 of the normalised non-negative parts (K6); a zero vector counts as uniform."""
    p, q = _distribution(a), _distribution(b)

    def half(x: Column, y: Column) -> Column:
        return total(F.zip_with(x, y, lambda u, v: F.when(u > 0, u * F.ln(2 * u / (u + v))).otherwise(F.lit(_ZERO))))

    return F.greatest(F.lit(_ZERO), 1 - 0.5 * (half(p, q) + half(q, p)) / math.log(2))


@_null_if_either
def sequence_identity(a: Column, b: Column) -> Column:
    """Share of agreeing places for equal lengths, else 1 - edit distance / longer length (K7); both empty is 1."""
    n, m = F.length(a), F.length(b)
    same = F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x == y).cast("int")), F.lit(0), lambda x, y: x + F.coalesce(y, F.lit(0)))
    return (
        F.when((n == 0) & (m == 0), F.lit(1.0))
        .when(n == m, same / n)
        .otherwise(1 - F.levenshtein(a, b) / F.greatest(n, m))
    )


@_null_if_either
def edit_similarity(a: Column, b: Column) -> Column:
    """max(0, 1 - edit distance / longer length); both empty is 1."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(_ZERO), 1 - F.levenshtein(a, b) / longest))


@_null_if_either
def positional_identity(a: Column, b: Column) -> Column:
    """Matches over the shared prefix length, divided by the longer length (K24); both empty is 1."""
    longest = F.greatest(F.length(a), F.length(b))
    short = F.least(F.length(a), F.length(b))
    same = F.aggregate(
        F.when(short > 0, F.sequence(F.lit(1), short)).otherwise(F.array().cast("array<int>")),
        F.lit(0),
        lambda acc, i: acc + (F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1))).cast("int"),
    )
    return F.when(longest == 0, F.lit(1.0)).otherwise(same / longest)


def centred_window(sequence: Column, centre: Column, radius: int) -> Column:
    """The part of a sequence within ``radius`` of the 1-based place nearest to ``centre``."""
    at = F.greatest(F.lit(0), F.least(F.length(sequence) - 1, F.bround(centre).cast("int") - 1))
    start = F.greatest(F.lit(0), at - radius)
    return F.substring(sequence, start + 1, at + radius + 1 - start)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((p2 - p1) / 2), F.lit(2.0)) + F.cos(p1) * F.cos(p2) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), F.lit(2.0))
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def metric_to_similarity(distance: Column, form: str = "exp", scale: float = 1.0, clip: bool = True) -> Column:
    """exp(-d/s), 1/(1+d/s) or max(0, 1-d/s) (P7); distances that are not finite fail the query."""
    d = F.when(
        F.isnan(distance) | (F.abs(distance) == float("inf")), F.raise_error(F.lit("distance is not finite")).cast("double")
    ).otherwise(distance)
    forms = {"exp": F.exp(-d / scale), "inverse": 1 / (1 + d / scale), "linear": F.greatest(F.lit(_ZERO), 1 - d / scale)}
    return unit_interval(forms[form]) if clip else forms[form]


def haversine_similarity(lat1: Column, lon1: Column, lat2: Column, lon2: Column, form: str = "exp", scale: float = 1000.0) -> Column:
    """Great-circle distance as a similarity."""
    return metric_to_similarity(haversine_km(lat1, lon1, lat2, lon2), form, scale)


def mixed_metadata(pairs: list[tuple[Column, Column]]) -> Column:
    """Mean over columns (K12): two finite numbers give 1 / (1 + |difference|), else equality of the texts.

    Two nulls are equal texts, one null is not equal.
    """
    parts = []
    for a, b in pairs:
        x, y = a.try_cast("double"), b.try_cast("double")
        finite = x.isNotNull() & y.isNotNull() & ~F.isnan(x) & ~F.isnan(y) & (F.abs(x) != float("inf")) & (F.abs(y) != float("inf"))
        text = F.when(a.cast("string").eqNullSafe(b.cast("string")), F.lit(1.0)).otherwise(F.lit(_ZERO))
        parts.append(F.when(finite, 1 / (1 + F.abs(x - y))).otherwise(text))
    return sum(parts[1:], parts[0]) / len(parts)


def group_equality(pairs: list[tuple[Column, Column]]) -> Column:
    """1 if all group columns agree (null agrees with null), else 0."""
    same = F.lit(True)
    for a, b in pairs:
        same = same & a.eqNullSafe(b)
    return same.cast("double")


#: An element symbol with an optional amount (fixed pattern).
FORMULA = r"([A-Z][a-z]?)([0-9]*\.?[0-9]*)"


def formula_fractions(formula: Column) -> Column:
    """Element -> share of atoms, as a map; a text without elements fails the query."""
    elements = F.regexp_extract_all(formula, F.lit(FORMULA), F.lit(1))
    amounts = F.transform(F.regexp_extract_all(formula, F.lit(FORMULA), F.lit(2)), lambda x: F.coalesce(x.try_cast("double"), F.lit(1.0)))
    pairs = F.arrays_zip(elements.alias("e"), amounts.alias("n"))
    keys = F.array_distinct(elements)
    sums = F.transform(keys, lambda k: F.aggregate(F.filter(pairs, lambda p: p["e"] == k), F.lit(_ZERO), lambda acc, p: acc + p["n"]))
    whole = total(sums)
    return F.when(F.size(keys) == 0, F.raise_error(F.lit("no element in formula")).cast("map<string,double>")).otherwise(
        F.map_from_arrays(keys, F.transform(sums, lambda x: x / whole))
    )


def map_dot(a: Column, b: Column) -> Column:
    return total(F.map_values(F.map_zip_with(a, b, lambda k, x, y: F.coalesce(x, F.lit(_ZERO)) * F.coalesce(y, F.lit(_ZERO)))))


@_null_if_either
def map_cosine(a: Column, b: Column) -> Column:
    """Cosine of weighted sets; two empty ones are 1, one is 0."""
    na, nb = F.sqrt(map_dot(a, a)), F.sqrt(map_dot(b, b))
    return F.when((na == 0) & (nb == 0), F.lit(1.0)).when((na == 0) | (nb == 0), F.lit(_ZERO)).otherwise(map_dot(a, b) / (na * nb))


@_null_if_either
def map_overlap(a: Column, b: Column) -> Column:
    """1 - half the sum of absolute differences of two share maps."""
    return 1 - total(F.map_values(F.map_zip_with(a, b, lambda k, x, y: F.abs(F.coalesce(x, F.lit(_ZERO)) - F.coalesce(y, F.lit(_ZERO)))))) / 2


@_null_if_either
def weighted_jaccard(a: Column, b: Column) -> Column:
    """Sum of minima over sum of maxima; two empty sets are 1."""
    both = F.map_zip_with(a, b, lambda k, x, y: F.struct(F.coalesce(x, F.lit(_ZERO)).alias("x"), F.coalesce(y, F.lit(_ZERO)).alias("y")))
    low = total(F.transform(F.map_values(both), lambda p: F.least(p["x"], p["y"])))
    high = total(F.transform(F.map_values(both), lambda p: F.greatest(p["x"], p["y"])))
    return F.when(high == 0, F.lit(1.0)).otherwise(low / high)


@_null_if_either
def genotype_ibs(a: Column, b: Column) -> Column:
    """Mean of max(0, 1 - |difference| / 2) over the markers present in both (K17); none is 0."""
    present = F.filter(F.zip_with(a, b, lambda x, y: F.greatest(F.lit(_ZERO), 1 - F.abs(x - y) / 2)), lambda v: v.isNotNull())
    return F.when(F.size(present) == 0, F.lit(_ZERO)).otherwise(total(present) / F.size(present))


def chamfer_distance(a: Column, b: Column) -> Column:
    """Half the sum of both mean nearest squared distances."""

    def one_way(u: Column, v: Column) -> Column:
        nearest = F.transform(u, lambda p: F.array_min(F.transform(v, lambda q: total(F.zip_with(p, q, lambda x, y: (x - y) * (x - y))))))
        return total(nearest) / F.size(u)

    return (one_way(a, b) + one_way(b, a)) / 2


@_null_if_either
def chamfer(a: Column, b: Column, form: str = "exp", scale: float = 1.0) -> Column:
    """Chamfer distance of point clouds as a similarity (K19); both empty is 1, one empty is 0."""
    na, nb = F.size(a), F.size(b)
    return F.when((na == 0) & (nb == 0), F.lit(1.0)).when((na == 0) | (nb == 0), F.lit(_ZERO)).otherwise(metric_to_similarity(chamfer_distance(a, b), form, scale))


def char_ngrams(text: Column, lengths: tuple[int, ...] = (2, 3, 4)) -> Column:
    """Distinct character n-grams of several lengths; a text shorter than n gives itself."""
    def of(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - n + 1))
        return F.when(F.length(text) < n, F.array(text)).otherwise(F.transform(starts, lambda i: F.substring(text, i, F.lit(n))))

    parts = [of(n) for n in lengths]
    return F.array_distinct(F.concat(*parts))


def qgrams(text: Column, q: int) -> Column:
    """Distinct q-grams of the text padded with q - 1 marks on each side."""
    padded = F.concat(F.lit("#" * (q - 1)), text, F.lit("$" * (q - 1)))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(padded) - q + 1)), lambda i: F.substring(padded, i, F.lit(q))))


def bits_tanimoto(a: Column, b: Column) -> Column:
    """Tanimoto of bit sets given as arrays of set bits (K22, J8); two empty sets are 1."""
    return jaccard(a, b)


def hamming_similarity(a: Column, b: Column, bits: Column) -> Column:
    """1 - differing bits / bits, for codes as BIGINT."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / bits


#: name -> kernel of two columns, for the generic operators; users may add their own.
REGISTRY = {
    "jaccard": jaccard,
    "cosine": cosine,
    "spectral_angle": spectral_angle,
    "pearson": pearson,
    "bray_curtis": bray_curtis,
    "jensen_shannon": jensen_shannon,
    "sequence_identity": sequence_identity,
    "edit": edit_similarity,
    "positional_identity": positional_identity,
    "formula_cosine": lambda a, b: map_cosine(formula_fractions(a), formula_fractions(b)),
    "formula_overlap": lambda a, b: map_overlap(formula_fractions(a), formula_fractions(b)),
    "weighted_jaccard": weighted_jaccard,
    "genotype_ibs": genotype_ibs,
    "chamfer": chamfer,
    "tanimoto": bits_tanimoto,
}
