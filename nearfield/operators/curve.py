"""Spectral performance curves: nested subsets along an axis, their metrics, contracts, areas and hypotheses."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfield.functions import metrics
from nearfield.operators.edges import attach_axis, max_similarity
from nearfield.schema import require

#: Default similarity thresholds of an audit and the tolerance of its monotonicity contracts (fixed values).
THRESHOLDS = (1.0, 0.8, 0.7, 0.6, 0.5)
TOLERANCE = 1e-12
#: Other names of the two axis types (fixed values).
AXIS_ALIASES = {"overlap": "similarity", "sim": "similarity", "distance_from_train": "distance", "novelty": "distance"}


def axis_type(name: str) -> str:
    """``similarity`` or ``distance`` from any of its names (P5); anything else raises ``ValueError``."""
    key = name.strip().lower().replace("-", "_")
    key = AXIS_ALIASES.get(key, key)
    if key not in ("similarity", "distance"):
        raise ValueError("axis type must be similarity or distance")
    return key


def parse_thresholds(text: str | None, unit_interval: bool = False) -> list[float] | None:
    """Comma-separated numbers, once each, largest first (P4); None or blank is None."""
    if text is None or not text.strip():
        return None
    values = sorted({float(x) for x in text.split(",") if x.strip()}, reverse=True)
    if unit_interval and any(not 0 <= v <= 1 for v in values):
        raise ValueError("similarity thresholds must lie in 0..1")
    return values


def quantile_thresholds(df: DataFrame, axis: str, kind: str, bins: int = 5) -> list[float]:
    """Distinct exact quantiles of the finite axis values (W7): from high to low for similarity, else from low to high."""
    if bins < 2:
        raise ValueError("at least two bins")
    finite = df.where(F.col(axis).isNotNull() & ~F.isnan(axis) & (F.abs(axis) != math.inf))
    row = metrics.percentiles_of(finite, axis, [i / (bins - 1) for i in range(bins)])
    if row is None:
        raise ValueError("axis has no finite value")
    return sorted(set(row), reverse=axis_type(kind) == "similarity")


def novelty(df: DataFrame, axis: str, kind: str) -> DataFrame:
    """Adds ``novelty`` (P6): the distance itself; 1 - similarity if all finite similarities lie in 0..1, else -similarity."""
    a = F.col(axis)
    if axis_type(kind) == "distance":
        return df.withColumn("novelty", a.cast("double"))
    good = a.isNotNull() & ~F.isnan(a) & (F.abs(a) != math.inf)
    ends = df.agg((F.coalesce(F.min(F.when(good, a)), F.lit(0.0)) >= 0).alias("__lo"), (F.coalesce(F.max(F.when(good, a)), F.lit(1.0)) <= 1).alias("__hi"))
    marked = df.crossJoin(F.broadcast(ends))  # one row
    return marked.withColumn("novelty", F.when(F.col("__lo") & F.col("__hi"), 1 - a).otherwise(-a)).drop("__lo", "__hi")


def _subset_name(prefix: str, t: float) -> str:
    return prefix + f"{float(t):g}".replace(".", "_").replace("-", "minus_")


def axis_curve(evals: DataFrame, axis: str, kind: str, thresholds: Sequence[float] | None = None, bins: int = 5, train_size: int = 0, y_true: str = "y_true", y_pred: str = "y_pred", rows_known: int | None = None) -> DataFrame:
    """The curve of an audit (C1): metrics of all rows and of each nested subset, in one pass.

    Subsets are ``axis <= t`` for similarity and ``axis >= t`` for distance; a NaN or null axis is in
    none.  Empty subsets and subsets of all rows are left out.  Each row of the table is copied once per
    subset that holds it, and one aggregation gives all metrics.  ``spectral_parameter`` is the mean novelty.
    """
    require(evals, [axis, y_true, y_pred], "evaluation table")
    kind = axis_type(kind)
    rows = novelty(evals.select(F.col(axis).cast("double").alias("a"), F.col(y_true).cast("double").alias("y_true"), F.col(y_pred).cast("double").alias("y_pred")), "a", kind)
    ts = list(dict.fromkeys(float(t) for t in thresholds)) if thresholds is not None else quantile_thresholds(rows, "a", kind, bins)
    names = {t: _subset_name("similarity_le_" if kind == "similarity" else "distance_ge_", t) for t in ts}
    usable = F.col("a").isNotNull() & ~F.isnan("a")
    member = [F.when(usable & (F.col("a") <= t if kind == "similarity" else F.col("a") >= t), F.struct(F.lit(names[t]).alias("subset"), F.lit(t).alias("threshold"))) for t in ts]
    every = F.struct(F.lit("all_eval").alias("subset"), F.lit(None).cast("double").alias("threshold"))
    spread = rows.select("*", F.explode(F.array_compact(F.array(every, *member))).alias("s")).select("a", "novelty", "y_true", "y_pred", "s.*")
    size = (evals.count() if rows_known is None else rows_known) * (len(ts) + 1)
    more = [F.avg("a").alias("mean_axis_value"), F.avg("novelty").alias("mean_novelty")]
    curve = metrics.regression_table(spread, ["subset", "threshold"], size, more, {"median_axis_value": "a"})
    whole = Window.partitionBy(F.lit(0))  # one row a subset
    curve = curve.withColumn("__all", F.max(F.when(F.col("subset") == "all_eval", F.col("n"))).over(whole)).where((F.col("subset") == "all_eval") | (F.col("n") < F.col("__all")))
    overlap = F.col("mean_axis_value") if kind == "similarity" else -F.col("mean_axis_value")
    return curve.select(
        "subset", "threshold", F.col("mean_novelty").alias("spectral_parameter"), F.lit(train_size).cast("bigint").alias("train_size"), F.col("n").alias("test_size"), "mean_axis_value",
        "median_axis_value", "mean_novelty", overlap.alias("cross_split_overlap"), "n", "mae", "rmse", "r2", "bias_mean_pred_minus_true", "median_abs_error", "p90_abs_error", "p95_abs_error", "max_abs_error",
    )


def pairwise_curve(evals: DataFrame, edges: DataFrame, thresholds: Sequence[float] | None = None, bins: int = 5, train_size: int = 0, strict: bool = True, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """The curve over the highest similarity per evaluation row (C2): aggregate, attach, curve.

    With ``strict`` a row without any edge fails the query, as the audit demands.  Without, such rows have no
    place on the axis and are in no subset, not even in that of all rows; how many they are is what
    :func:`coverage` counts.
    """
    joined = attach_axis(evals, edges, strict)
    return axis_curve(joined if strict else joined.where("axis is not null"), "axis", "similarity", thresholds, bins, train_size, y_true, y_pred, evals.count())


def coverage(evals: DataFrame, edges: DataFrame, group: str) -> DataFrame:
    """``rows, with_axis, left_out`` per group: what a curve that is not strict is about."""
    rows = attach_axis(evals, edges, False)
    return rows.groupBy(group).agg(F.count("*").alias("rows"), F.count("axis").alias("with_axis"), F.count_if(F.col("axis").isNull()).alias("left_out"))


def similarity_bands(evals: DataFrame, edges: DataFrame, thresholds: Sequence[float] = THRESHOLDS, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """The molecule audit's curve (C3): thresholds below 1 only, empty subsets left out, spectral parameter 1 - t, 0 for all rows.

    Rows without any training neighbour have similarity 0.
    """
    rows = evals.join(max_similarity(edges), "sample_id", "left").withColumn("axis", F.coalesce("axis", F.lit(0.0)))
    ts = [t for t in sorted(set(thresholds), reverse=True) if t != 1.0]
    member = [F.when(F.col("axis") <= t, F.struct(F.lit(_subset_name("max_similarity_le_", t)).alias("subset"), F.lit(float(t)).alias("threshold"))) for t in ts]
    every = F.struct(F.lit("all_eval").alias("subset"), F.lit(None).cast("double").alias("threshold"))
    spread = rows.select(F.col(y_true).alias("y_true"), F.col(y_pred).alias("y_pred"), "axis", F.explode(F.array_compact(F.array(every, *member))).alias("s"))
    curve = spread.groupBy("s").agg(*metrics.regression_aggregates(), F.avg("axis").alias("cross_split_overlap"))
    return curve.select("s.subset", "s.threshold", F.coalesce(1 - F.col("s.threshold"), F.lit(0.0)).alias("spectral_parameter"), F.col("n").alias("test_size"), (1 - F.col("cross_split_overlap")).alias("mean_novelty"), "cross_split_overlap", "mae", "rmse", "r2")


def _steps(curve: DataFrame, order: str, value: str) -> DataFrame:
    """Differences between neighbouring curve points with numbers in both columns and a non-empty subset."""
    good = curve.where(F.col(order).isNotNull() & ~F.isnan(order) & F.col(value).isNotNull() & ~F.isnan(value) & (F.col("test_size") > 0))
    w = Window.partitionBy(F.lit(0)).orderBy(order, "subset")  # a curve has a handful of points
    return good.withColumn("delta", F.col(value) - F.lag(value).over(w))


def validate_overlap(curve: DataFrame, order: str = "spectral_parameter") -> DataFrame:
    """One row (C5): does the overlap never rise along the order?  ``valid, status, decreasing_fraction, row_count, increases``."""
    d = F.col("delta")
    out = _steps(curve, order, "cross_split_overlap").agg(
        F.count("*").alias("row_count"), F.count_if(d > TOLERANCE).alias("increases"), F.when(F.count(d) > 0, F.count_if(d <= TOLERANCE) / F.count(d)).alias("decreasing_fraction")
    )
    ok = (F.col("row_count") > 0) & (F.col("increases") == 0)
    return out.select(ok.alias("valid"), F.when(ok, "valid").otherwise("overlap_contract_failed").alias("status"), "decreasing_fraction", "row_count", "increases")


def validate_novelty(curve: DataFrame, order: str = "threshold_order") -> DataFrame:
    """One row (C6): does the mean novelty never fall?  By default in the order of the thresholds, where it can fail."""
    if order == "threshold_order":
        curve = curve.withColumn(order, F.coalesce(-F.col("threshold"), F.lit(-1e300)))
    d = F.col("delta")
    out = _steps(curve, order, "mean_novelty").agg(
        F.count("*").alias("row_count"), F.count_if(d < -TOLERANCE).alias("decreases"), F.when(F.count(d) > 0, F.count_if(d >= -TOLERANCE) / F.count(d)).alias("increasing_fraction")
    )
    ok = (F.col("row_count") > 0) & (F.col("decreases") == 0)
    return out.select(ok.alias("valid"), F.when(ok, "valid").otherwise("novelty_contract_failed").alias("status"), "increasing_fraction", "row_count", "decreases")


def area(curve: DataFrame, x: str = "mean_novelty", y: str = "rmse", higher_is_better: bool = False, normalise: bool = True, invert_x: bool = False, tie: str = "subset") -> DataFrame:
    """One row ``computed, value, point_count`` (C7-C10): the trapezoid area under the curve.

    ``x`` is min-max normalised unless told otherwise, 1 - x with ``invert_x`` (overlap or support as an
    axis); ``y`` is negated unless higher is better.  Not computed for fewer than two points or constant x.
    """
    good = curve.where(F.col(x).isNotNull() & ~F.isnan(x) & F.col(y).isNotNull() & ~F.isnan(y))
    if "test_size" in curve.columns:
        good = good.where("test_size > 0")
    all_rows = Window.partitionBy(F.lit(0))  # a handful of points
    lo, hi = F.min(x).over(all_rows), F.max(x).over(all_rows)
    scaled = F.when(hi > lo, (F.col(x) - lo) / (hi - lo)) if normalise else F.col(x).cast("double")
    pts = good.select(tie, (1 - scaled if invert_x else scaled).alias("__x"), (F.col(y) if higher_is_better else -F.col(y)).alias("__y"))
    w = all_rows.orderBy("__x", tie)
    parts = pts.withColumn("__a", (F.col("__x") - F.lag("__x").over(w)) * (F.col("__y") + F.lag("__y").over(w)) / 2)
    out = parts.agg(F.count("*").alias("point_count"), F.sum("__a").alias("v"), (F.max("__x") > F.min("__x")).alias("wide"))
    ok = (F.col("point_count") >= 2) & F.coalesce(F.col("wide"), F.lit(False))
    return out.select(ok.alias("computed"), F.when(ok, F.col("v")).alias("value"), "point_count")


def _curve_summary(curve: DataFrame, metric: str, higher_is_better: bool, least: int) -> DataFrame:
    sign = -1.0 if higher_is_better else 1.0
    rows = curve.where(F.col(metric).isNotNull() & ~F.isnan(metric) & F.col("mean_novelty").isNotNull() & (F.col("test_size") >= least))
    rows = rows.withColumn("difficulty", F.col(metric) * sign)
    return rows.groupBy("axis").agg(
        F.count("*").alias("points"),
        metrics.correlation("mean_novelty", "difficulty").alias("r"),
        metrics.slope("mean_novelty", "difficulty").alias("slope"),
        F.min_by("difficulty", F.struct("mean_novelty", "subset")).alias("first"),
        F.max_by("difficulty", F.struct("mean_novelty", "subset")).alias("last"),
        F.max("difficulty").alias("highest"),
    )


def score_hypotheses(curves: DataFrame, metric: str = "rmse", higher_is_better: bool = False, least: int = 10) -> DataFrame:
    """C13 per ``axis``: ``status, r, slope, last_delta, max_delta, prospective_valid``.

    Points of fewer than ``least`` rows are dropped.  Difficulty is the metric, negated if higher is
    better; the tolerance 2 % of the easiest point.  Strongest first: monotonic (r >= 0.5 and the hardest
    point above the easiest by more than the tolerance), localized (some point above), weak (r > 0.25),
    else not explanatory; fewer than two points are not evaluable.  A ``leakage_risk`` other than none
    makes an axis not prospectively valid.
    """
    if "leakage_risk" not in curves.columns:
        curves = curves.withColumn("leakage_risk", F.lit("none"))
    flags = curves.groupBy("axis").agg(F.max("leakage_risk").alias("leakage_risk"))
    s = _curve_summary(curves, metric, higher_is_better, least)
    tolerance = F.greatest(F.lit(1e-12), F.abs("first") * 0.02)
    last, high = F.col("last") - F.col("first"), F.col("highest") - F.col("first")
    status = (
        F.when(F.coalesce("points", F.lit(0)) < 2, "not_evaluable")
        .when((F.col("r") >= 0.5) & (last > tolerance), "monotonic_supported")
        .when(high > tolerance, "localized_supported")
        .when(F.col("r") > 0.25, "weak_supported")
        .otherwise("not_explanatory")
    )
    joined = flags.join(s, "axis", "left")
    return joined.select("axis", status.alias("status"), "r", "slope", last.alias("last_delta"), high.alias("max_delta"), F.coalesce(F.col("leakage_risk") == "none", F.lit(True)).alias("prospective_valid"))


def best_axis(scores: DataFrame) -> DataFrame:
    """The best axis (C15): status first, then without leakage, then the larger rise, then the hardest point's rise, then the name."""
    rank = F.array_position(F.array(*map(F.lit, ("not_evaluable", "not_explanatory", "weak_supported", "localized_supported", "monotonic_supported"))), F.col("status"))
    return scores.orderBy(rank.desc(), F.col("prospective_valid").desc(), F.desc_nulls_last("max_delta"), F.desc_nulls_last("last_delta"), "axis").limit(1)


def next_actions(scores: DataFrame) -> DataFrame:
    """What to do with each axis next."""
    action = (
        F.when(~F.col("prospective_valid"), "remove_leakage")
        .when(F.col("status") == "monotonic_supported", "confirm_on_held_out_data")
        .when(F.col("status") == "localized_supported", "refine_axis")
        .when(F.col("status") == "weak_supported", "add_support")
        .when(F.col("status") == "not_evaluable", "collect_more_points")
        .otherwise("drop_axis")
    )
    return scores.select("axis", "status", action.alias("action"))


def review(curve: DataFrame, performance: str, higher_is_better: bool) -> DataFrame:
    """One row (C12): correlation of overlap and performance, and the loss from the easiest to the hardest point."""
    sign = 1.0 if higher_is_better else -1.0
    return curve.where(F.col("test_size") > 0).agg(
        metrics.correlation("cross_split_overlap", performance).alias("r"),
        F.max_by(performance, F.struct("cross_split_overlap", "subset")).alias("easiest"),
        F.min_by(performance, F.struct("cross_split_overlap", "subset")).alias("hardest"),
    ).select("r", "easiest", "hardest", ((F.col("easiest") - F.col("hardest")) * sign).alias("degradation"))


#: Other names that split statistics come with (fixed values); the parameter is any column that ends so.
STATS_ALIASES = {
    "train_size": ("train_size", "n_train"),
    "test_size": ("test_size", "n_test", "n"),
    "cross_split_overlap": ("cross_split_overlap", "overlap", "mean_overlap"),
}


def split_stats_contract(stats: DataFrame) -> DataFrame:
    """One row (C11): at least three points, overlap not rising at all or in three quarters of the steps, sizes of ten and more."""
    names = {"parameter": tuple(c for c in stats.columns if c.lower().endswith("parameter")), **STATS_ALIASES}
    known = {c: [F.col(a) for a in aliases if a in stats.columns] for c, aliases in names.items()}
    named = stats.select(*[(F.coalesce(*cols) if cols else F.lit(None)).cast("double").alias(c) for c, cols in known.items()])
    rows = named.where("parameter is not null and cross_split_overlap is not null").withColumn("subset", F.col("parameter").cast("string")).withColumn("test_size", F.coalesce("test_size", F.lit(1.0)))
    d = F.col("delta")
    out = _steps(rows, "parameter", "cross_split_overlap").agg(
        F.count("*").alias("points"), F.when(F.count(d) > 0, F.count_if(d <= TOLERANCE) / F.count(d)).alias("share"), F.count_if((F.col("test_size") < 10) | (F.col("train_size") < 10)).alias("small_points")
    )
    ok = (F.col("points") >= 3) & (F.coalesce("share", F.lit(0.0)) >= 0.75)
    return out.select("points", F.coalesce(F.col("share") == 1.0, F.lit(False)).alias("monotonic"), "share", ok.alias("valid"), "small_points")
