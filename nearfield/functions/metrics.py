"""Model quality as aggregate expressions and tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.functions.features import running
from nearfield.storage import Workspace

#: Up to so many rows the percentiles of a group are taken in one task; beyond, all rows are sorted by range.
ONE_TASK_ROWS = 5_000_000


def regression_aggregates(y_true: str = "y_true", y_pred: str = "y_pred") -> list[Column]:
    """Aggregates of A1: n, mae, rmse, r2, bias, median / p90 / p95 / max absolute error.

    Quantiles are exact and interpolated.  No row gives n = 0 and nulls; r2 is null for fewer than two
    rows or a constant truth.  NaN in a row makes the row's metrics NaN, as the numbers demand; callers
    filter first if they want otherwise.
    """
    t, p = F.col(y_true), F.col(y_pred)
    e = F.abs(t - p)
    sst = F.var_pop(t) * F.count("*")
    quantiles = F.percentile(e, F.array(F.lit(0.5), F.lit(0.9), F.lit(0.95)))  # one aggregate, used three times
    return [
        F.count("*").alias("n"),
        F.avg(e).alias("mae"),
        F.sqrt(F.avg((t - p) * (t - p))).alias("rmse"),
        F.when((F.count("*") >= 2) & (F.var_pop(t) > 0), 1 - F.sum((t - p) * (t - p)) / sst).alias("r2"),
        F.avg(p - t).alias("bias_mean_pred_minus_true"),
        quantiles[0].alias("median_abs_error"),
        quantiles[1].alias("p90_abs_error"),
        quantiles[2].alias("p95_abs_error"),
        F.max(e).alias("max_abs_error"),
    ]


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: Column, points: Sequence[float], workspace: Workspace) -> DataFrame:
    """``keys`` and ``q``, the exact interpolated percentiles of a value per group, whatever the size of a group.

    The rows are sorted by range over many tasks; the places that the percentiles fall on follow from the
    counts of the groups, and only these rows are picked.  Null values do not count; groups without any are
    missing.
    """
    rows = df.select(*keys, value.cast("double").alias("__v")).where("__v is not null")
    ran = workspace.save(running(rows, [*map(F.asc, keys), F.asc("__v")], {"__place": F.lit(1)}, workspace).select("__v", "__place"), "ranked")
    groups = workspace.save(rows.groupBy(*keys).agg(F.count("*").alias("__n")) if keys else rows.agg(F.count("*").alias("__n")).where("__n > 0"), "groups")
    upto = running(groups, list(map(F.asc, keys)) or [F.asc("__n")], {"__upto": F.col("__n")}, workspace)
    steps = F.posexplode(F.array(*[F.lit(float(p)) for p in points])).alias("__k", "__p")
    at = upto.select(*keys, "__n", (F.col("__upto") - F.col("__n")).alias("__start"), steps)
    rank = F.col("__p") * (F.col("__n") - 1)
    at = at.select(*keys, "__k", "__start", F.floor(rank).alias("__lo"), (rank - F.floor(rank)).alias("__f"), F.ceil(rank).alias("__hi"))
    ends = at.select(*keys, "__k", "__f", F.explode(F.array(F.struct(F.lit(0).alias("e"), (F.col("__start") + F.col("__lo") + 1).alias("__place")), F.struct(F.lit(1).alias("e"), (F.col("__start") + F.col("__hi") + 1).alias("__place")))).alias("x"))
    ends = ends.select(*keys, "__k", "__f", "x.e", "x.__place").join(ran, "__place")
    both = ends.groupBy(*keys, "__k", "__f").agg(F.max(F.when(F.col("e") == 0, F.col("__v"))).alias("a"), F.max(F.when(F.col("e") == 1, F.col("__v"))).alias("b"))
    value_at = F.when(F.col("__f") == 0, F.col("a")).otherwise((1 - F.col("__f")) * F.col("a") + F.col("__f") * F.col("b"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("__k", value_at.alias("v")))), lambda x: x["v"])  # one entry a point
    return both.groupBy(*keys).agg(listed.alias("q")) if keys else both.agg(listed.alias("q")).where(F.size("q") > 0)


def percentiles_of(df: DataFrame, value: Column | str, points: Sequence[float]) -> list[float] | None:
    """Exact percentiles of one column over all rows; None without a value."""
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    rows = df.select(v.alias("v")).where("v is not null")
    if rows.count() <= ONE_TASK_ROWS:
        return rows.agg(F.percentile("v", F.array(*[F.lit(float(p)) for p in points])).alias("q")).first()["q"]
    found = exact_percentiles(rows, [], F.col("v"), points, Workspace(df.sparkSession, "percentiles")).first()
    return found["q"] if found else None


def regression_table(rows: DataFrame, keys: Sequence[str], size: int, more: Sequence[Column] = (), medians: dict[str, str] | None = None, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """A1 per group, with further aggregates and medians of columns; ``size`` bounds the number of rows.

    The same numbers at any size: beyond :data:`ONE_TASK_ROWS` the percentiles come from
    :func:`exact_percentiles` and are joined to the other aggregates.  Keys may be null.
    """
    medians = medians or {}
    own = regression_aggregates(y_true, y_pred)
    if size <= ONE_TASK_ROWS:
        return rows.groupBy(*keys).agg(*own, *more, *[F.percentile(c, F.lit(0.5)).alias(n) for n, c in medians.items()])
    ws = Workspace(rows.sparkSession, "regression")
    name = F.struct(*[F.coalesce(F.col(k).cast("string"), F.lit("<null>")).alias(f"k{i}") for i, k in enumerate(keys)]) if keys else F.struct(F.lit("").alias("k0"))
    rows = ws.save(rows.withColumn("__g", F.to_json(name)), "rows")
    plain = [a for a in own if not any(w in str(a) for w in ("median_abs_error", "p90_abs_error", "p95_abs_error"))]
    out = rows.groupBy("__g", *keys).agg(*plain, *more)
    e = F.abs(F.col(y_true) - F.col(y_pred))
    q = exact_percentiles(rows, ["__g"], e, (0.5, 0.9, 0.95), ws)
    out = out.join(q.select("__g", *[F.col("q")[i].alias(n) for i, n in enumerate(("median_abs_error", "p90_abs_error", "p95_abs_error"))]), "__g", "left")
    for n, c in medians.items():
        out = out.join(exact_percentiles(rows, ["__g"], F.col(c), (0.5,), ws).select("__g", F.col("q")[0].alias(n)), "__g", "left")
    return out.drop("__g")


def error_columns(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """Adds abs_error and squared_error (P10)."""
    d = F.col(y_true) - F.col(y_pred)
    return df.withColumn("abs_error", F.abs(d)).withColumn("squared_error", d * d)


def target_support(evals: DataFrame, train: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred", target: str = "y") -> DataFrame:
    """One row (A5): ranges of the training target and the evaluation truth, and how many values lie outside the former."""
    lo_hi = train.where(F.col(target).isNotNull()).agg(F.min(target).alias("train_min"), F.max(target).alias("train_max"))
    t, p = F.col(y_true), F.col(y_pred)
    outside = lambda c: F.count_if((c < F.col("train_min")) | (c > F.col("train_max")))
    joined = evals.crossJoin(F.broadcast(lo_hi))  # one row
    return joined.groupBy("train_min", "train_max").agg(F.min(t).alias("eval_min"), F.max(t).alias("eval_max"), outside(t).alias("true_outside"), outside(p).alias("pred_outside"))


def robust_scale(column: str, fallback: float = 1.0) -> Column:
    """Interquartile range, else population deviation, else the fallback; at least 1e-12."""
    q = F.percentile(column, F.array(F.lit(0.25), F.lit(0.75)))
    iqr, sd = q[1] - q[0], F.stddev_pop(column)
    return F.greatest(F.lit(1e-12), F.when(iqr > 0, iqr).when(sd > 0, sd).otherwise(F.lit(fallback)))


def correlation(x: str, y: str) -> Column:
    """Pearson correlation; null with fewer than two rows or a constant column."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    return F.when((F.count(a) >= 2) & (F.stddev_pop(a) > 0) & (F.stddev_pop(b) > 0), F.corr(a, b))


def slope(x: str, y: str) -> Column:
    """Least-squares slope of y on x; null with fewer than two rows or constant x."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a = F.when(both, F.col(x))
    return F.when((F.count(a) >= 2) & (F.stddev_pop(a) > 0), F.regr_slope(F.col(y), F.col(x)))


def binary_labels(df: DataFrame, column: str) -> DataFrame:
    """Adds ``label`` 0 or 1 (P8): {0, 1} are kept, else the smaller of the two distinct values is 0.

    Anything but exactly two distinct non-null values fails; rows with null stay null.
    """
    ends = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"), F.countDistinct(column).alias("k"))
    bad = F.raise_error(F.lit("a label must have exactly two values")).cast("int")
    marked = df.crossJoin(F.broadcast(ends))  # one row
    value = F.when(F.col("k") != 2, bad).when(F.col(column).isNull(), F.lit(None).cast("int")).otherwise((F.col(column) == F.col("hi")).cast("int"))
    return marked.withColumn("label", value).drop("lo", "hi", "k")


def _above(per: DataFrame, keys: list[str]) -> DataFrame:
    """``tp`` and ``fp``: positives and negatives at each distinct score and above it, per group; rows ``keys, s, pos, neg``."""
    if per.count() <= ONE_TASK_ROWS:
        at = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(F.desc("s"))
        return per.withColumn("tp", F.sum("pos").over(at)).withColumn("fp", F.sum("neg").over(at))
    ws = Workspace(per.sparkSession, "scores")
    ran = running(per, [*map(F.asc, keys), F.desc("s")], {"__tp": F.col("pos"), "__fp": F.col("neg")}, ws)
    if not keys:
        return ran.withColumnsRenamed({"__tp": "tp", "__fp": "fp"})
    groups = ws.save(per.groupBy(*keys).agg(F.sum("pos").alias("__p"), F.sum("neg").alias("__n")), "groups")
    starts = running(groups, list(map(F.asc, keys)), {"__a": F.col("__p"), "__b": F.col("__n")}, ws)
    starts = starts.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], (F.col("__a") - F.col("__p")).alias("__a"), (F.col("__b") - F.col("__n")).alias("__b"))
    on = None
    for i, k in enumerate(keys):
        same = F.col(k).eqNullSafe(F.col(f"__k{i}"))
        on = same if on is None else on & same
    return ran.join(starts, on).select(*per.columns, (F.col("__tp") - F.col("__a")).alias("tp"), (F.col("__fp") - F.col("__b")).alias("fp"))


def classification(df: DataFrame, label: str, score: str, threshold: float = 0.5, groups: list[str] | None = None) -> DataFrame:
    """A19 per group: n, positives, roc_auc, average_precision, balanced_accuracy, accuracy, f1, mcc, brier.

    Rows with a null label or score (NaN too) are left out.  Equal scores share their rank; average
    precision adds, per distinct score from high to low, precision times the gained recall.  Metrics whose
    denominator is empty are null, f1 and mcc 0.  The only sort is over distinct scores: they are
    aggregated first, and sorted by range over many tasks if they are very many.
    """
    keys = groups or []
    rows = df.where(F.col(label).isNotNull() & F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    rows = rows.select(*keys, F.col(label).cast("double").alias("y"), F.col(score).cast("double").alias("s"))
    per = rows.groupBy(*keys, "s").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    ran = _above(per, keys)
    # pairs of a positive above a negative: negatives below a score, half of those that tie
    agg = ran.groupBy(*keys).agg(
        F.sum("pos").alias("np"), F.sum("neg").alias("nn"), F.sum(F.col("pos") * (F.col("fp") - F.col("neg") / 2)).alias("behind"), F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("ap")
    )
    hit = (F.col("s") >= threshold).cast("double")
    y = F.col("y")
    table = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum(y * hit).alias("tp"), F.sum((1 - y) * hit).alias("fp"), F.sum(y * (1 - hit)).alias("fn"), F.sum((1 - y) * (1 - hit)).alias("tn"), F.avg((y - F.col("s")) * (y - F.col("s"))).alias("brier")
    )
    both = table.join(agg, keys) if keys else table.crossJoin(agg)  # one row each
    tp, fp, fn, tn, p, n = (F.col(c) for c in ("tp", "fp", "fn", "tn", "np", "nn"))
    den = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return both.select(
        *keys,
        "n",
        p.cast("bigint").alias("positives"),
        F.when((p > 0) & (n > 0), 1 - F.col("behind") / (p * n)).alias("roc_auc"),
        F.when(p > 0, F.col("ap") / p).alias("average_precision"),
        F.when((p > 0) & (n > 0), (tp / p + tn / n) / 2).alias("balanced_accuracy"),
        ((tp + tn) / F.col("n")).alias("accuracy"),
        F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(0.0).alias("f1"),
        F.when(den > 0, (tp * tn - fp * fn) / den).otherwise(0.0).alias("mcc"),
        "brier",
    )
