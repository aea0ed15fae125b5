"""Whole evaluations: grids of splits, composition and recommendation of splits, sequence, molecule and perturbation runners."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfield.functions import metrics as M
from nearfield.operators import baselines as B
from nearfield.operators import curve
from nearfield.operators import graph as G
from nearfield.operators import splits as S
from nearfield.operators.edges import nearest_numeric
from nearfield.operators.skew import hot_keys, salted_join
from nearfield.storage import Workspace, metric

#: Cells of a grid that one run works on together; the table of cells is broadcast.
MOST_CELLS = 1_000

# ---- grids of splits (X1, X5, X6, C17) --------------------------------------------------------------------


def grid_cells(edges: DataFrame, nodes: DataFrame, parameters: Sequence[float], repeats: int, threshold: float | None) -> DataFrame:
    """``cell, param, repeat, limit, chance``: what each cell drops neighbours by.

    With a threshold the graph is binary: neighbours above it are dropped with the chance of the parameter, and
    a graph of density 0.4 and more is refused (G12).  Without, it is weighted: neighbours above
    ``lo + (1 - p) (hi - lo)`` are always dropped.
    """
    if not 0 < len(parameters) * repeats <= MOST_CELLS or any(not 0 <= p <= 1 for p in parameters):
        raise ValueError(f"parameters lie in 0..1, and a grid has 1 to {MOST_CELLS} cells")
    stats = G.statistics(edges if threshold is None else edges.where(F.col("w") > threshold).withColumn("w", F.lit(1.0)), nodes).first()
    if threshold is not None and stats["density"] >= G.DENSITY_LIMIT:
        raise ValueError(f"the graph is too dense for splits: {stats['density']:.3f}")
    rows = []
    for k, p in enumerate(parameters):
        limit = S.weighted_threshold(stats["min_weight"], stats["max_weight"], p) if threshold is None else threshold
        rows += [(k * repeats + r, float(p), r, float(limit), 1.0 if threshold is None else float(p)) for r in range(repeats)]
    return edges.sparkSession.createDataFrame(rows, "cell int, param double, repeat int, limit double, chance double")


def independent_sets(edges: DataFrame, nodes: DataFrame, cells: DataFrame, workspace: Workspace) -> DataFrame:
    """``cell, id``: the nodes that each cell of a grid keeps (X1), all cells in the same rounds.

    As in :func:`splits.independent_set` a node that precedes all its remaining neighbours in a hash order is
    kept and they are dropped; parameter 0 of a binary graph keeps all nodes.
    """
    million = F.lit(1_000_000)
    coin = F.pmod(F.xxhash64("cell", "i", "j"), million) < F.col("chance") * million
    drawn = edges.crossJoin(F.broadcast(cells)).where((F.col("w") > F.col("limit")) & coin)  # at most MOST_CELLS rows
    live = workspace.save(drawn.select("cell", "i", "j"), "live", rows=F.count(F.lit(1)))
    order = lambda c: F.struct(F.xxhash64("cell", F.lit("order"), c), F.col(c))
    gone: list[DataFrame] = []
    while metric(live, "rows"):
        both = live.select("cell", F.explode(F.array(F.struct(F.col("i").alias("u"), F.col("j").alias("v")), F.struct(F.col("j").alias("u"), F.col("i").alias("v")))).alias("e")).select("cell", "e.*")
        first = both.groupBy("cell", "u").agg(F.min(order("v")).alias("m")).where(order("u") < F.col("m")).select("cell", "u")
        dropped = workspace.save(both.join(first, ["cell", "u"], "left_semi").select("cell", F.col("v").alias("id")).distinct(), "dropped")
        gone.append(dropped)
        rest = live.join(dropped.withColumnRenamed("id", "i"), ["cell", "i"], "left_anti").join(dropped.withColumnRenamed("id", "j"), ["cell", "j"], "left_anti")
        nxt = workspace.save(rest.select("cell", "i", "j"), "live", rows=F.count(F.lit(1)))
        workspace.drop(live)
        live = nxt
    kept = nodes.select("id").distinct().crossJoin(F.broadcast(cells.select("cell")))
    for dropped in gone:
        kept = kept.join(dropped, ["cell", "id"], "left_anti")
    return workspace.save(kept.select("cell", "id"), "kept")


def grid_splits(kept: DataFrame, cells: DataFrame, workspace: Workspace, share: float = 0.2) -> DataFrame:
    """``param, repeat, cell, sample_id, split`` (X5): in each cell the first ``ceil(share n)`` ids in hash order are test.

    A histogram of the hash finds the bucket of the cut, and only that bucket is ranked.  Cells of ten nodes
    and fewer have no split.
    """
    h = F.pmod(F.xxhash64("cell", "id"), F.lit(1 << 20))
    keyed = kept.withColumn("h", h).withColumn("b", F.shiftright("h", 10))
    counts = workspace.save(keyed.groupBy("cell", "b").agg(F.count("*").alias("n")), "histogram")  # at most 1024 rows a cell
    at = Window.partitionBy("cell").orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("cell")
    ran = counts.withColumn("upto", F.sum("n").over(at)).withColumn("all", F.sum("n").over(whole)).withColumn("want", F.ceil(F.col("all") * F.lit(share) - F.lit(1e-9)))
    cut = ran.where((F.col("upto") >= F.col("want")) & (F.col("upto") - F.col("n") < F.col("want")) & (F.col("all") > S.LEAST_SET))
    cut = cut.select("cell", F.col("b").alias("cut"), (F.col("want") - F.col("upto") + F.col("n")).alias("left"))
    placed = keyed.join(F.broadcast(cut), "cell")  # one row a cell
    rank = F.row_number().over(Window.partitionBy("cell", "b").orderBy("h", "id"))
    inside = placed.where(F.col("b") == F.col("cut")).withColumn("test", rank <= F.col("left"))
    outside = placed.where(F.col("b") != F.col("cut")).withColumn("test", F.col("b") < F.col("cut"))
    out = inside.unionByName(outside).join(F.broadcast(cells.select("cell", "param", "repeat")), "cell")
    return workspace.save(out.select("param", "repeat", "cell", F.col("id").alias("sample_id"), F.when(F.col("test"), "test").otherwise("train").alias("split")), "splits")


def grid_statistics(splits: DataFrame, edges: DataFrame, cells: DataFrame, threshold: float) -> DataFrame:
    """Per cell ``param, repeat, train_size, test_size, num_similar, cross_split_overlap, status`` (C17).

    The overlap is the share of training members with a test member above the threshold.
    """
    ends = G.both_ways(edges.where(F.col("w") > threshold)).select("u", "v")
    n = ends.count()
    side = lambda name, c: splits.where(F.col("split") == name).select("cell", F.col("sample_id").alias(c))
    met = salted_join(ends, side("train", "u"), "u", hot_keys(ends, "u", n), "v")
    similar = met.join(side("test", "v"), ["cell", "v"]).select("cell", "u").distinct().groupBy("cell").agg(F.count("*").alias("num_similar"))
    sizes = splits.groupBy("cell").agg(F.count_if(F.col("split") == "train").alias("train_size"), F.count_if(F.col("split") == "test").alias("test_size"))
    rows = cells.select("cell", "param", "repeat").join(sizes, "cell", "left").join(similar, "cell", "left")
    found = F.when(F.col("train_size") > 0, F.coalesce("num_similar", F.lit(0)))
    return rows.select(
        "param", "repeat", F.coalesce("train_size", F.lit(0)).alias("train_size"), F.coalesce("test_size", F.lit(0)).alias("test_size"), found.alias("num_similar"),
        (found / F.col("train_size")).alias("cross_split_overlap"), F.when(F.col("train_size").isNull(), "too_small").otherwise("valid").alias("status"),
    )


def split_grid(edges: DataFrame, nodes: DataFrame, parameters: Sequence[float], repeats: int, workspace: Workspace, threshold: float = 0.5, done: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Splits and statistics of parameters x repeats (X6); cells whose ``param, repeat`` stand in ``done`` are left out."""
    cells = grid_cells(edges, nodes, parameters, repeats, threshold)
    if done is not None:
        cells = cells.join(done.select("param", "repeat").distinct(), ["param", "repeat"], "left_anti").select(cells.columns)
    cells = workspace.save(cells, "cells")
    splits = grid_splits(independent_sets(edges, nodes, cells, workspace), cells, workspace)
    return splits, grid_statistics(splits, edges, cells, threshold)


def grid_curve(stats: DataFrame) -> DataFrame:
    """The curve over saved splits (C17): mean and deviation of sizes and overlap per parameter."""
    good = stats.where("status = 'valid'")
    return good.groupBy(F.col("param").alias("spectral_parameter")).agg(
        F.count("*").alias("repeats"), F.avg("train_size").alias("train_size"), F.avg("test_size").alias("test_size"), F.avg("cross_split_overlap").alias("cross_split_overlap"), F.stddev_pop("cross_split_overlap").alias("std_css")
    )


# ---- composition and recommendation (A8, J14, X7) ---------------------------------------------------------


def composition(split: DataFrame, rows: DataFrame, label: str, group: str) -> DataFrame:
    """One row (A8): labelled rows, positives and rate of both sides, groups of the test side and those also in training.

    ``rows`` has ``sample_id``, a 0 / 1 label and a group such as a scaffold; null labels and groups do not count.
    """
    joined = rows.select("sample_id", F.col(label).alias("y"), F.col(group).alias("g")).join(split.select("sample_id", "split"), "sample_id")
    labels = joined.where("y is not null").groupBy().pivot("split", ["train", "test"]).agg(F.count("y").alias("labels"), F.sum("y").cast("bigint").alias("positives"), F.avg("y").alias("rate"))
    groups = joined.where("g is not null").groupBy("g").agg(F.max((F.col("split") == "train").cast("int")).alias("a"), F.max((F.col("split") == "test").cast("int")).alias("b"))
    shared = groups.agg(F.coalesce(F.sum("b"), F.lit(0)).cast("bigint").alias("test_groups"), F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0)).cast("bigint").alias("shared_groups"))
    return labels.crossJoin(shared).withColumn("group_overlap", F.when(F.col("test_groups") > 0, F.col("shared_groups") / F.col("test_groups")))  # one row each


def baseline_per_split(rows: DataFrame, splits: dict[str, DataFrame], tokens: str, label: str, features: int = 1024) -> DataFrame:
    """``split_id, roc_auc``: a balanced logistic regression on hashed tokens, fitted anew on each split's training side.

    Null where a side has a single class.
    """
    spark = rows.sparkSession
    out = []
    for split_id, split in splits.items():  # a handful of splits
        joined = rows.where(F.col(label).isNotNull()).join(split.select(F.col("sample_id").alias("id"), "split"), "id")
        scored = B.logistic_on_tokens(joined.where("split = 'train'"), joined.where("split = 'test'"), tokens, label, features)
        out.append((split_id, None if scored is None else M.classification(scored, label, "score").first()["roc_auc"]))
    return spark.createDataFrame(out, "split_id string, roc_auc double")


def with_recommendation(sweep: DataFrame, baseline: DataFrame, prevalence: float) -> DataFrame:
    """The sweep with the baseline's AUROC merged onto valid splits (J14) and the recommended one marked."""
    merged = sweep.drop("recommended", "roc_auc").join(baseline, "split_id", "left").withColumn("roc_auc", F.when(F.col("status") == "valid", F.col("roc_auc")))
    best = S.recommend(merged, prevalence).select("split_id", F.lit(True).alias("recommended"))
    return merged.join(F.broadcast(best), "split_id", "left").withColumn("recommended", F.coalesce("recommended", F.lit(False)))


# ---- runners (B1, B2, C9, C10, C14) -----------------------------------------------------------------------


def contiguous_holdout(rows: DataFrame, id_col: str, position: str, share: float = 0.2) -> DataFrame:
    """Rows whose position lies in the centred interval are test (X9, O4); rows without a position are left out."""
    lo, hi = S.contiguous_interval(rows, position, share)
    return S.predicate_split(rows.where(F.col(position).isNotNull()), id_col, F.col(position).between(lo, hi))


def sequence_axes(test: DataFrame, train: DataFrame) -> DataFrame:
    """``sample_id`` and one similarity a column for the axes that need no alignment (B2): nearest position, nearest depth, seen position.

    Both sides have ``sample_id, mutation_center, mutation_depth``.
    """
    near = lambda column, name: nearest_numeric(test, train, "sample_id", "sample_id", column, 5.0).select("sample_id", F.col("similarity").alias(name))
    seen = train.select("mutation_center").distinct().withColumn("seen_position", F.lit(1.0))
    out = test.select("sample_id", "mutation_center").join(seen, "mutation_center", "left").select("sample_id", F.coalesce("seen_position", F.lit(0.0)).alias("seen_position"))
    return out.join(near("mutation_center", "position"), "sample_id").join(near("mutation_depth", "depth"), "sample_id")


def score_against_first(curves: DataFrame, metric_name: str = "rmse", higher_is_better: bool = False, least: int = 10) -> DataFrame:
    """The runner's form of hypothesis scores (C14): every difference is taken from the first row, that of all rows.

    Points of fewer than ``least`` rows are dropped unless none would be left.  ``axis, status, points, last_delta, max_delta``.
    """
    sign = -1.0 if higher_is_better else 1.0
    good = curves.where(F.col(metric_name).isNotNull() & ~F.isnan(metric_name) & F.col("mean_novelty").isNotNull()).withColumn("difficulty", F.col(metric_name) * sign)
    per = Window.partitionBy("axis")
    large = F.col("test_size") >= least
    good = good.withColumn("__any", F.max(large.cast("int")).over(per)).where(large | (F.col("__any") == 0))
    first = F.min_by("difficulty", F.struct(F.col("subset") != "all_eval", "mean_novelty", "subset"))
    s = good.groupBy("axis").agg(F.count("*").alias("points"), first.alias("base"), F.max_by("difficulty", F.struct("mean_novelty", "subset")).alias("last"), F.max("difficulty").alias("highest"), M.correlation("mean_novelty", "difficulty").alias("r"))
    last, high, tolerance = F.col("last") - F.col("base"), F.col("highest") - F.col("base"), F.greatest(F.lit(1e-12), F.abs("base") * 0.02)
    status = (
        F.when(F.coalesce("points", F.lit(0)) < 2, "not_evaluable")
        .when((F.col("r") >= 0.5) & (last > tolerance), "monotonic_supported")
        .when(high > tolerance, "localized_supported")
        .when(F.col("r") > 0.25, "weak_supported")
        .otherwise("not_explanatory")
    )
    return curves.select("axis").distinct().join(s, "axis", "left").select("axis", status.alias("status"), F.coalesce("points", F.lit(0)).alias("points"), last.alias("last_delta"), high.alias("max_delta"))


def molecule_rows(evals: DataFrame, edges: DataFrame, in_distribution: Sequence[str], thresholds: Sequence[float]) -> DataFrame:
    """The molecule runner's table (B1): one row for the in-distribution splits, then nested bands of the others by similarity to training.

    ``evals`` has ``sample_id, split, y_true, y_pred``; a row without any edge has similarity 0.
    """
    inside = F.col("split").isin(list(in_distribution))
    from nearfield.operators.edges import max_similarity

    rows = evals.join(max_similarity(edges), "sample_id", "left").withColumn("axis", F.coalesce("axis", F.lit(0.0)))
    member = [F.when(~inside & (F.col("axis") <= t), F.struct(F.lit(f"ood_similarity_le_{t:g}".replace(".", "_")).alias("subset"), F.lit(float(t)).alias("threshold"))) for t in thresholds]
    own = F.when(inside, F.struct(F.lit("id").alias("subset"), F.lit(None).cast("double").alias("threshold"))).otherwise(F.struct(F.lit("ood_all").alias("subset"), F.lit(None).cast("double").alias("threshold")))
    spread = rows.select("y_true", "y_pred", "axis", F.explode(F.array_compact(F.array(own, *member))).alias("s"))
    out = spread.groupBy("s").agg(*M.regression_aggregates(), F.avg("axis").alias("cross_split_overlap"))
    return out.select("s.subset", "s.threshold", F.col("n").alias("test_size"), "cross_split_overlap", (1 - F.col("cross_split_overlap")).alias("mean_novelty"), "mae", "rmse", "r2")


def support_area(points: DataFrame, support: str = "support", score: str = "score") -> DataFrame:
    """One row ``computed, value, point_count`` (C10): the area over 1 - support, not normalised, ties in the order of the score."""
    good = points.where(F.col(support).isNotNull() & F.col(score).isNotNull()).select((1 - F.col(support)).alias("x"), F.col(score).alias("y"))
    w = Window.partitionBy(F.lit(0)).orderBy("x", "y")  # a point a profile
    parts = good.withColumn("a", (F.col("x") - F.lag("x").over(w)) * (F.col("y") + F.lag("y").over(w)) / 2)
    out = parts.agg(F.count("*").alias("point_count"), F.sum("a").alias("v"))
    ok = F.col("point_count") >= 2
    return out.select(ok.alias("computed"), F.when(ok, F.col("v")).alias("value"), "point_count")


def run_axes(evals: DataFrame, axes: Sequence[str], thresholds: Sequence[float]) -> DataFrame:
    """The curves of several similarity axes, one column each, under ``axis``."""
    out = None
    for name in axes:
        c = curve.axis_curve(evals, name, "similarity", thresholds).withColumn("axis", F.lit(name))
        out = c if out is None else out.unionByName(c)
    return out
