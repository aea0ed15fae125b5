"""Top N items within every group, also for groups of millions of items.

Hot-cold split: exact group counts (one map-side combined aggregation) divide the groups.
Items of *hot* groups are sorted by range over many tasks, every task keeps at most N items of a group,
and a small second window merges the survivors.  Items of *cold* groups go through one ordinary window.
The union of both is the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfield.operators.skew import HOT_SHARE
from nearfield.storage import Workspace, metric

#: Groups above this many rows (and above a thousandth of the table) are hot.
HOT_GROUP_ROWS = 20_000
#: Aimed number of hot items a task sorts, and the fewest tasks.
RANGE_ROWS = 250_000
LEAST_RANGES = 8


def valid_pairs(edges: DataFrame) -> DataFrame:
    """Edges that count: similarity neither null nor NaN and in 0..1, two different non-null ids."""
    s = F.col("similarity")
    return edges.select("sample_id", "train_id", "similarity").where(
        s.isNotNull() & ~F.isnan(s) & s.between(0.0, 1.0) & (F.col("sample_id") != F.col("train_id"))
    )


def best_per_pair(edges: DataFrame) -> DataFrame:
    """One row a pair with the highest of its similarities."""
    return valid_pairs(edges).groupBy("sample_id", "train_id").agg(F.max("similarity").alias("similarity"))


def top_n(items: DataFrame, source: DataFrame, group: str, score: str, tie: str, n: int, workspace: Workspace) -> DataFrame:
    """The ``n`` items with the highest ``score`` of each group, ties by smaller ``tie``; all if fewer.

    ``items`` has one row per (group, tie); ``source`` is any table with the same group column and at
    least as many rows a group, from which the exact counts are taken (the raw table, so that the count
    does not repeat the aggregation behind ``items``).  Null groups and null scores give no row.
    Repeated (group, tie) rows are ranked as separate items.  The result has ``items``' columns and
    ``rank`` (from 1).  At most 1000 groups are hot, so their keys may be broadcast; the tasks of the range
    sort follow the number of hot rows.
    """
    items = items.where(F.col(group).isNotNull() & F.col(score).isNotNull())
    order = [F.col(score).desc(), F.col(tie).asc()]
    whole = Window.partitionBy(group).orderBy(*order)
    ranked = lambda df: df.withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= n)
    total = source.count()
    if total <= HOT_GROUP_ROWS:
        return ranked(items)
    limit = max(HOT_GROUP_ROWS, HOT_SHARE * total)
    counts = source.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("__n")).where(F.col("__n") > limit)
    hot = workspace.save(counts, "hot", rows=F.coalesce(F.sum("__n"), F.lit(0)))
    if not metric(hot, "rows"):
        return ranked(items)
    hot_groups = F.broadcast(hot.select(group))
    cold = ranked(items.join(hot_groups, group, "left_anti"))
    ranges = max(LEAST_RANGES, -(-metric(hot, "rows") // RANGE_ROWS))
    spread = items.join(hot_groups, group, "left_semi").repartitionByRange(ranges, F.col(group), *order)
    piece = Window.partitionBy("__range", group).orderBy(*order)
    kept = (
        spread.withColumn("__range", F.spark_partition_id())
        .withColumn("__r", F.row_number().over(piece))
        .where(F.col("__r") <= n)
        .drop("__r", "__range")
    )
    return cold.unionByName(ranked(kept))


def nearest_train_rows(edges: DataFrame, n: int = 10, workspace: Workspace | None = None) -> DataFrame:
    """``sample_id, train_id, similarity, rank``: the ``n`` nearest training rows of every sample."""
    return top_n(best_per_pair(edges), valid_pairs(edges), "sample_id", "similarity", "train_id", n, workspace or Workspace(edges.sparkSession, "top-n"))
