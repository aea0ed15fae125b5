"""Similarity graphs: degrees, density, components, hops and overlaps over sparse edge tables.

Edges are rows ``i, j, w`` with ``i < j``; pairs that are not listed have weight 0.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfield.functions.metrics import percentiles_of
from nearfield.operators.skew import HOT_ROWS, hot_keys, salted_join
from nearfield.storage import Workspace, metric

#: Binary graphs denser than this are refused for split generation (fixed value).
DENSITY_LIMIT = 0.4


def normalised(edges: DataFrame, a: str, b: str, w: str) -> DataFrame:
    """Edges as ``i < j`` with the largest weight of repeated pairs; self-pairs, null ids and null or NaN weights are dropped."""
    x, y = F.col(a), F.col(b)
    good = edges.where(x.isNotNull() & y.isNotNull() & (x != y) & F.col(w).isNotNull() & ~F.isnan(F.col(w).cast("double")))
    return good.groupBy(F.least(x, y).alias("i"), F.greatest(x, y).alias("j")).agg(F.max(F.col(w).cast("double")).alias("w"))


def lookup(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Weights of the asked pairs ``a, b`` in any order (G3); unlisted pairs are 0."""
    asked = pairs.select("a", "b", F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j"))
    return asked.join(edges, ["i", "j"], "left").select("a", "b", F.coalesce("w", F.lit(0.0)).alias("w"))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct(F.col("i").alias("u"), F.col("j").alias("v"), "w"), F.struct(F.col("j").alias("u"), F.col("i").alias("v"), "w"))).alias("e")).select("e.*")


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``id, degree, weight, share`` for every node (G5, G6): neighbours, summed weights, neighbours per node of the graph."""
    n = nodes.count()
    ends = both_ways(edges).groupBy(F.col("u").alias("id")).agg(F.count("*").alias("degree"), F.sum("w").alias("weight"))
    return nodes.select("id").join(ends, "id", "left").select(
        "id", F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("weight", F.lit(0.0)).alias("weight"), (F.coalesce("degree", F.lit(0)) / F.lit(max(n, 1))).alias("share")
    )


def statistics(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row (G4, G12, G13, A12): nodes, possible and listed pairs, min / max / sum of weights, density, whether a binary graph is too dense.

    Minimum and maximum range over all possible pairs, so unlisted ones count as 0.  No node: one row of zeros.
    """
    per = edges.agg(F.count("*").alias("listed"), F.min("w").alias("lo"), F.max("w").alias("hi"), F.coalesce(F.sum("w"), F.lit(0.0)).alias("total_weight"))
    row = per.crossJoin(nodes.agg(F.count("*").alias("nodes")))  # one row each
    pairs = (F.col("nodes") * (F.col("nodes") - 1) / 2).cast("bigint")
    full = F.col("listed") == pairs
    density = F.when(pairs > 0, F.col("total_weight") / pairs).otherwise(0.0)
    return row.select(
        "nodes",
        pairs.alias("possible_pairs"),
        "listed",
        F.when(full, F.coalesce("lo", F.lit(0.0))).otherwise(F.least(F.coalesce("lo", F.lit(0.0)), F.lit(0.0))).alias("min_weight"),
        F.greatest(F.coalesce("hi", F.lit(0.0)), F.when(full, F.coalesce("hi", F.lit(0.0))).otherwise(0.0)).alias("max_weight"),
        "total_weight",
        density.alias("density"),
        (density >= DENSITY_LIMIT).alias("too_dense"),
    )


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _jump(pointers: DataFrame, workspace: Workspace) -> DataFrame:
    """Pointer jumping: ``node, to`` until every ``to`` is a root (a node that points nowhere).

    A node that has reached its root is written down and not carried on.  When all nodes of a large
    component share one ``to``, its rows are spread over salts.
    """
    active = workspace.save(pointers, "pointers", rows=F.count(F.lit(1)))
    n, done, old = metric(active, "rows"), [], active
    while n:
        onward = _union([*done, active]).select(F.col("node").alias("to"), F.col("to").alias("next"))

        def step(p: DataFrame, hot: DataFrame | None) -> DataFrame:
            joined = p.join(onward, "to", "left") if hot is None else salted_join(p, onward, "to", hot, "node", "left")
            return joined.select("node", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved"))

        if n <= HOT_ROWS:  # no key can be hot: two jumps a pass
            jumped = step(step(active, None).select("node", "to"), None)
        else:
            jumped = step(active, hot_keys(active, "to", n))
        jumped = workspace.save(jumped, "jumped", moved=F.count_if("moved"))
        workspace.drop(old)
        done.append(jumped.where(~F.col("moved")).select("node", "to"))
        active, n, old = jumped.where("moved").select("node", "to"), metric(jumped, "moved"), None
    return _union(done) if done else active


def merge_components(edges: DataFrame, workspace: Workspace) -> DataFrame:
    """``node, root`` of every node of the edges ``a, b`` (G9); the root is the smallest node connected to it.

    Each round hooks every node to its smallest neighbour, flattens the hooks by pointer jumping and
    continues with the edges between different roots, of which there are at least halved many.  Every
    round is written to the shared folder, and every join on a node or root is salted.  Self-edges are
    ignored, repeated edges count once.
    """
    count = F.count(F.lit(1))

    def save(e: DataFrame) -> DataFrame:
        clean = e.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        return workspace.save(clean, "edges", rows=count)

    edges = save(edges)
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    maps: list[DataFrame] = []
    while total := metric(edges, "rows"):
        hooks = edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("to"))
        flat = _jump(hooks, workspace)
        maps.append(flat)
        to_a = flat.select(F.col("node").alias("a"), F.col("to").alias("ra"))
        to_b = flat.select(F.col("node").alias("b"), F.col("to").alias("rb"))
        left = salted_join(edges, to_a, "a", hot_keys(edges, "a", total), "b", "left").select(F.coalesce("ra", "a").alias("a"), "b")
        nxt = save(salted_join(left, to_b, "b", hot_keys(left, "b", total), "a", "left").select("a", F.coalesce("rb", "b").alias("b")))
        if len(maps) > 1:  # the first table still gives the nodes
            workspace.drop(edges)
        edges = nxt
    out = workspace.save(nodes.select("node", F.col("node").alias("root")), "roots", rows=count)
    for flat in maps:
        step = flat.select(F.col("node").alias("root"), "to")
        moved = salted_join(out, step, "root", hot_keys(out, "root", metric(out, "rows")), "node", "left")
        nxt = workspace.save(moved.select("node", F.coalesce("to", "root").alias("root")), "roots", rows=count)
        workspace.drop(out)
        out = nxt
    return out


def components(edges: DataFrame, nodes: DataFrame, threshold: float, workspace: Workspace) -> DataFrame:
    """``id, component`` of the threshold graph ``w >= threshold`` (G8, G9): the smallest id of each component, single nodes included."""
    strong = edges.where(F.col("w") >= threshold).select(F.col("i").alias("a"), F.col("j").alias("b"))
    roots = merge_components(strong, workspace)
    return nodes.select("id").join(roots.select(F.col("node").alias("id"), "root"), "id", "left").select("id", F.coalesce("root", "id").alias("component"))


def numbered(labels: DataFrame) -> DataFrame:
    """``id, component, number``: components numbered 0, 1, .. in the order of their smallest id.

    The distinct component ids are sorted by range over many tasks; a task's first number is the count of
    the tasks before it.
    """
    from nearfield.functions.features import row_ids

    order = row_ids(labels.select(F.col("component").alias("id")).distinct(), "", ["id"], 1)
    order = order.select(F.col("id").alias("component"), F.col("sample_id").cast("bigint").alias("number"))
    return labels.join(order, "component").select("id", "component", "number")


def component_sweep(edges: DataFrame, nodes: DataFrame, thresholds: list[float], workspace: Workspace) -> Iterator[tuple[float, DataFrame]]:
    """``id, component`` for each threshold, from the highest down.

    Components only merge as the threshold falls, so each threshold starts from the roots of the one above
    and needs only the edges below that.
    """
    above = float("inf")
    base = workspace.save(nodes.select("id", F.col("id").alias("component")), "labels", rows=F.count(F.lit(1)))
    for t in sorted(set(thresholds), reverse=True):
        ends = edges.where((F.col("w") >= t) & (F.col("w") < above)) if above < float("inf") else edges.where(F.col("w") >= t)
        above = t
        a, b = base.select(F.col("id").alias("i"), F.col("component").alias("a")), base.select(F.col("id").alias("j"), F.col("component").alias("b"))
        n = ends.count()
        lifted = salted_join(ends, a, "i", hot_keys(ends, "i", n), "j")
        lifted = salted_join(lifted, b, "j", hot_keys(ends, "j", n), "i").select("a", "b")
        roots = merge_components(lifted, workspace).select(F.col("node").alias("component"), "root")
        hot = hot_keys(base, "component", metric(base, "rows"))
        merged = salted_join(base, roots, "component", hot, "id", "left").select("id", F.coalesce("root", "component").alias("component"))
        base = workspace.save(merged, "labels", rows=F.count(F.lit(1)))
        yield t, base


def threshold_summary(edges: DataFrame, nodes: DataFrame, thresholds: list[float], workspace: Workspace) -> DataFrame:
    """Edges, components and the largest component per threshold."""
    out = None
    for t, labels in component_sweep(edges, nodes, thresholds, workspace):
        sizes = labels.groupBy("component").count().agg(F.count("*").alias("components"), F.max("count").alias("largest"))
        row = edges.where(F.col("w") >= t).agg(F.count("*").alias("edges")).crossJoin(sizes).withColumn("threshold", F.lit(float(t)))  # one row each
        out = row if out is None else out.unionByName(row)
    if out is None:
        return nodes.sparkSession.createDataFrame([], "threshold double, edges bigint, components bigint, largest bigint")
    return out.select("threshold", "edges", "components", F.coalesce("largest", F.lit(0)).alias("largest"))


def component_table(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Per component (A7): size, smallest id, and the largest and mean similarity to everything outside (null if nothing is).

    The mean is over all outside pairs; unlisted ones count as 0.
    """
    n = labels.count()
    sizes = labels.groupBy("component").agg(F.count("*").alias("size"), F.min("id").alias("min_id"))
    a = labels.select(F.col("id").alias("u"), F.col("component").alias("ca"))
    b = labels.select(F.col("id").alias("v"), F.col("component").alias("cb"))
    ends, m = both_ways(edges), 2 * edges.count()
    met = salted_join(salted_join(ends, a, "u", hot_keys(ends, "u", m), "v"), b, "v", hot_keys(ends, "v", m), "u")
    outside = met.where("ca <> cb").groupBy(F.col("ca").alias("component")).agg(F.max("w").alias("m"), F.sum("w").alias("s"))
    rest = F.lit(n) - F.col("size")
    return sizes.join(outside, "component", "left").select(
        "component",
        "size",
        "min_id",
        F.when(rest > 0, F.greatest(F.coalesce("m", F.lit(0.0)), F.when(F.col("m").isNull() | (F.col("m") < 0), 0.0))).alias("external_max"),
        F.when(rest > 0, F.coalesce("s", F.lit(0.0)) / (F.col("size") * rest)).alias("external_mean"),
    )


def component_tables(tagged: DataFrame, edges: DataFrame, count: int) -> DataFrame:
    """``k, component, size, min_id, external_max, external_mean``: :func:`component_table` of ``count`` labellings at once.

    ``tagged`` has ``id, tags``, the component under the k-th labelling as ``tags[k]``.  The edges are joined with
    the tags of both ends once, and leave the join as one row a node.
    """
    n, m, ends = tagged.count(), 2 * edges.count(), both_ways(edges)
    far = salted_join(ends, tagged.select(F.col("id").alias("v"), F.col("tags").alias("tv")), "v", hot_keys(ends, "v", m), "u")
    met = salted_join(far.drop("v"), tagged.select(F.col("id").alias("u"), F.col("tags").alias("tu")), "u", hot_keys(ends, "u", m), "w")
    outside = [F.when(F.col("tu")[k] != F.col("tv")[k], F.col("w")) for k in range(count)]
    each = met.groupBy(F.col("u").alias("id")).agg(*[f(x).alias(f"{c}{k}") for k, x in enumerate(outside) for c, f in (("m", F.max), ("s", F.sum))])
    listed = F.array(*[F.struct(F.lit(k).alias("k"), F.col("tags")[k].alias("component"), F.col(f"m{k}").alias("m"), F.col(f"s{k}").alias("s")) for k in range(count)])
    flat = tagged.join(each, "id", "left").select("id", F.explode(listed).alias("e")).select("id", "e.*")
    rest = F.lit(n) - F.col("size")
    return flat.groupBy("k", "component").agg(F.count("*").alias("size"), F.min("id").alias("min_id"), F.max("m").alias("m"), F.sum("s").alias("s")).select(
        "k",
        "component",
        "size",
        "min_id",
        F.when(rest > 0, F.greatest(F.coalesce("m", F.lit(0.0)), F.when(F.col("m").isNull() | (F.col("m") < 0), 0.0))).alias("external_max"),
        F.when(rest > 0, F.coalesce("s", F.lit(0.0)) / (F.col("size") * rest)).alias("external_mean"),
    )


def hops(links: DataFrame, starts: DataFrame, depth: int, workspace: Workspace) -> DataFrame:
    """``start, id, hop``: the fewest steps from each start to every node within ``depth``.

    ``links`` are undirected rows ``u, v``; ``starts`` has ``start, id`` (several nodes a start: multi-source).
    Only new nodes stay in the frontier, and each step is written down.
    """
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v").distinct()
    seen = workspace.save(starts.select("start", "id", F.lit(0).alias("hop")).distinct(), "hop0")
    frontier = seen
    for step in range(1, depth + 1):
        reached = frontier.join(both, F.col("id") == F.col("u")).select("start", F.col("v").alias("id")).distinct()
        frontier = workspace.save(reached.join(seen, ["start", "id"], "left_anti").withColumn("hop", F.lit(step)), f"hop{step}")
        seen = seen.unionByName(frontier)
    return seen


def neighbourhood_jaccard(links: DataFrame, queries: DataFrame, nodes: DataFrame, depth: int, workspace: Workspace) -> DataFrame:
    """Jaccard of the nodes within ``depth`` hops, the start left out (K20): ``sample_id, train_id, similarity``; both empty is 1.

    Shared nodes are counted by an equi-join on the node, so only pairs with something in common are
    joined; the others are 0 and the pairs of two empty neighbourhoods 1.
    """
    from nearfield.operators.edges import block_pairs

    starts = nodes.select(F.col("id").alias("start"), "id")
    near = hops(links, starts, depth, workspace).where("start <> id").select("start", "id")
    near = workspace.save(near, "near")
    sizes = nodes.select(F.col("id").alias("start")).join(near.groupBy("start").agg(F.count("*").alias("n")), "start", "left").select("start", F.coalesce("n", F.lit(0)).alias("n"))
    a = near.join(queries.select(F.col("id").alias("start")), "start", "left_semi").select(F.col("start").alias("sample_id"), "id")
    b = near.select(F.col("start").alias("train_id"), "id")
    shared = a.join(b, "id").groupBy("sample_id", "train_id").agg(F.count("*").alias("i"))
    pairs = block_pairs(queries.select(F.col("id").alias("sample_id")), nodes.select(F.col("id").alias("train_id")), "train_id")
    counted = (
        pairs.join(shared, ["sample_id", "train_id"], "left")
        .join(sizes.select(F.col("start").alias("sample_id"), F.col("n").alias("na")), "sample_id")
        .join(sizes.select(F.col("start").alias("train_id"), F.col("n").alias("nb")), "train_id")
    )
    i = F.coalesce("i", F.lit(0))
    union = F.col("na") + F.col("nb") - i
    return counted.select("sample_id", "train_id", F.when(union == 0, 1.0).otherwise(i / union).alias("similarity"))


def network_proximity(links: DataFrame, left: DataFrame, right: DataFrame, depth: int, workspace: Workspace, unreachable: float = 10.0, scale: float = 2.0) -> DataFrame:
    """exp(-d / scale) with d the mean of the fewest hops between two entity sets, both ways.

    ``left`` and ``right`` have ``id, entity``; an entity that the other set does not reach within
    ``depth`` counts ``unreachable``.
    """
    from nearfield.operators.edges import block_pairs

    def one_way(x: DataFrame, y: DataFrame, xn: str, yn: str) -> DataFrame:
        reach = hops(links, y.select(F.col("id").alias("start"), F.col("entity").alias("id")), depth, workspace).select(F.col("start").alias(yn), F.col("id").alias("entity"), "hop")
        pairs = block_pairs(x.select(F.col("id").alias(xn), "entity"), y.select(F.col("id").alias(yn)).distinct(), yn)
        return pairs.join(reach, [yn, "entity"], "left").groupBy(xn, yn).agg(F.sum(F.coalesce(F.col("hop").cast("double"), F.lit(unreachable))).alias("s"), F.count("*").alias("n"))

    there = one_way(left, right, "sample_id", "train_id")
    back = one_way(right, left, "train_id", "sample_id").withColumnsRenamed({"s": "s2", "n": "n2"})
    d = (F.col("s") / F.col("n") + F.col("s2") / F.col("n2")) / 2
    return there.join(back, ["sample_id", "train_id"]).select("sample_id", "train_id", F.exp(-d / scale).alias("similarity"))


def cross_overlap(edges: DataFrame, train: DataFrame, test: DataFrame, threshold: float | None = None) -> DataFrame:
    """Overlap of two id lists (A10, A11, G7), one row.

    With a threshold (binary graphs): the share of members of each list with at least one similar member
    of the other, as ``overlap`` (of the train list, as is usual) and ``test_overlap``, with the counts.
    Without (weighted): mean, population deviation, maximum and minimum over all pairs, unlisted ones 0.
    """
    between = both_ways(edges).join(train.select(F.col("id").alias("u")), "u", "left_semi").join(test.select(F.col("id").alias("v")), "v", "left_semi")
    sizes = train.agg(F.count("*").alias("train_size")).crossJoin(test.agg(F.count("*").alias("test_size")))  # one row each
    if threshold is not None:
        hit = between.where(F.col("w") >= threshold).agg(F.countDistinct("u").alias("num_similar"), F.countDistinct("v").alias("test_similar"))
        row = sizes.crossJoin(hit)
        return row.select("train_size", "test_size", "num_similar", (F.col("num_similar") / F.col("train_size")).alias("overlap"), (F.col("test_similar") / F.col("test_size")).alias("test_overlap"))
    sums = between.agg(F.count("*").alias("k"), F.sum("w").alias("s"), F.sum(F.col("w") * F.col("w")).alias("q"), F.max("w").alias("hi"), F.min("w").alias("lo"))
    n = F.col("train_size") * F.col("test_size")
    mean = F.coalesce("s", F.lit(0.0)) / n
    zero = F.when(F.col("k") < n, 0.0)
    return sizes.crossJoin(sums).select(
        "train_size",
        "test_size",
        mean.alias("mean"),
        F.sqrt(F.greatest(F.lit(0.0), F.coalesce("q", F.lit(0.0)) / n - mean * mean)).alias("std"),
        F.greatest("hi", zero).alias("max"),
        F.least("lo", zero).alias("min"),
    )


def pair_quantiles(edges: DataFrame, nodes: DataFrame, points: int = 11) -> DataFrame:
    """``quantile, similarity`` over all pairs (A6), linearly interpolated; the graph must list every pair."""
    steps = [i / (points - 1) for i in range(points)]
    values = percentiles_of(edges, "w", steps) or []
    return edges.sparkSession.createDataFrame(list(zip(steps, values)), "quantile double, similarity double")
