"""Pairwise matches to groups: connected components by seed-tree pruning.

Every round each vertex proposes the minimum of its closed neighbourhood to all its neighbours.  A
vertex that nobody proposes is not a minimum anywhere: it drops out and hangs below its own minimum in
the *propagation forest*.  The proposals that meet at one vertex become the edges of the next, smaller
graph.  When no edge is left, what remains are the seeds (the roots), and their ids flow down the forest.

All steps are equi-joins and map-side combined aggregations over (vertex, vertex) rows.  A vertex with a
third of all edges, proposals or children is spread over salts in each of the three joins on a vertex.
Every round is written to the shared folder, which cuts the lineage and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.operators.skew import hot_keys, salted_join
from nearfield.storage import Workspace, metric


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.u", "e.v")


def connected_components(edges: DataFrame, workspace: Workspace, left: str = "a", right: str = "b") -> DataFrame:
    """``record_id, group_id`` for every record of an edge; ``group_id`` is the smallest id of its group.

    Edges are undirected; rows with a null id or two equal ids are dropped, repeated rows count once.
    No edges give an empty table.  The number of rounds grows with the logarithm of the longest chain.
    """
    a, b = F.col(left), F.col(right)
    count = F.count(F.lit(1))
    graph = workspace.save(
        edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct(), "edges", rows=count
    )
    forest: list[tuple[DataFrame, int]] = []
    n = metric(graph, "rows")
    while n:
        both = _both_ways(graph)
        lows = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("low"))
        # proposals: v learns low(u) for each neighbour u, and its own low
        joined = salted_join(both, lows, "u", hot_keys(both, "u", 2 * n), "v").select(F.col("v").alias("u"), "low")
        proposals = workspace.save(joined.unionByName(lows).distinct(), f"proposals{len(forest)}", rows=count)
        best = proposals.groupBy("u").agg(F.min("low").alias("parent"), F.max(F.col("low") == F.col("u")).alias("proposed"))
        best = workspace.save(best, f"best{len(forest)}", dropped=F.count_if(~F.col("proposed")))
        forest.append((best.where(~F.col("proposed")).select(F.col("u").alias("record_id"), "parent"), metric(best, "dropped")))
        # a vertex of many neighbours has as many proposals as they have different minima
        hot = hot_keys(proposals, "u", metric(proposals, "rows"))
        met = salted_join(proposals, best.select("u", "parent"), "u", hot, "low").where(F.col("low") != F.col("parent"))
        nxt = workspace.save(met.select(F.col("parent").alias("a"), F.col("low").alias("b")).distinct(), f"edges{len(forest)}", rows=count)
        workspace.drop(graph)
        workspace.drop(proposals)
        n, graph = metric(nxt, "rows"), nxt
    if not forest:
        return graph.select(F.col("a").alias("record_id"), F.col("b").alias("group_id"))
    # From the last round to the first: parents of a round are labelled by later rounds or are seeds.
    labels = forest[-1][0].select("record_id", F.col("parent").alias("group_id"))
    for level, size in reversed(forest[:-1]):
        known = labels.withColumnRenamed("record_id", "parent")
        flowed = salted_join(level, known, "parent", hot_keys(level, "parent", size), "record_id", "left")
        done = workspace.save(flowed.select("record_id", F.coalesce("group_id", "parent").alias("group_id")), "labels")
        labels = labels.unionByName(done)  # each part is written down, so the plan grows by one scan a round
    roots = labels.select(F.col("group_id").alias("record_id")).distinct().select("record_id", F.col("record_id").alias("group_id"))
    return labels.unionByName(roots)


def consolidate(pairs: DataFrame, workspace: Workspace, threshold: float = 0.8) -> DataFrame:
    """Groups of the records linked by pairs of similarity ``threshold`` or more (see ``valid_pairs``)."""
    from nearfield.llm.topn import valid_pairs

    strong = valid_pairs(pairs).where(F.col("similarity") >= threshold)
    return connected_components(strong, workspace, "sample_id", "train_id")
