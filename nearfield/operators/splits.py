"""Construction of train / test splits: independent sets, component packing, sweeps and the operating-point family.

Hash choices are ``(id * MULTIPLIER + seed) mod MODULUS`` for numbers and the first 32 bits of an MD5 for other
ids, both of which any SQL engine can repeat.  They depend on the id alone, not on order or partitioning.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.functions import kernels
from nearfield.functions.features import running
from nearfield.functions.metrics import percentiles_of
from nearfield.operators.skew import hot_keys, salted_join
from nearfield.storage import Workspace, metric

MULTIPLIER, MODULUS = 2654435761, 1_000_003
#: Bounds of the test side in component packing, as shares of all rows (fixed values).
TARGET, LEAST, MOST = 0.2, 0.15, 0.25
#: Thresholds of the focused sweep (fixed values).
SWEEP = (0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2)
LEAST_SET = 10


def pseudo(id_col: str, numeric: bool, seed: int = 0) -> Column:
    """A repeatable number in 0 .. MODULUS - 1 for an id."""
    if numeric:
        return F.pmod(F.col(id_col).cast("bigint") * MULTIPLIER + seed * 40_503, F.lit(MODULUS))
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.col(id_col).cast("string")))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint"), F.lit(MODULUS))


def half_even(x: float) -> int:
    return round(x)


# ---- independent sets -------------------------------------------------------------------------------------


def independent_set(edges: DataFrame, nodes: DataFrame, parameter: float, threshold: float, workspace: Workspace, seed: int = 0, least_degree: bool = False) -> DataFrame:
    """``id`` of the kept nodes (X1): a randomised independent set with a spectral parameter.

    Parameter 0 keeps all nodes, 1 a maximal set without any edge of weight above ``threshold``.  Between,
    every edge takes part with that probability (a coin of its two ids).  In rounds each node that
    comes before all its remaining neighbours in a hash order is kept and its neighbours are dropped; this
    needs a logarithmic number of rounds, and the result depends on ids and seed only.  With ``least_degree``
    the order is that of the nodes' remaining degrees, counted anew each round, then of the hash (W9).
    """
    if not 0 <= parameter <= 1:
        raise ValueError("the spectral parameter lies in 0..1")
    coin = F.pmod(F.xxhash64(F.lit(seed), "i", "j"), F.lit(1_000_000)) < int(parameter * 1_000_000)
    live = workspace.save(edges.where((F.col("w") > threshold) & coin).select("i", "j"), "edges")
    order = lambda c: F.struct(*([F.col(f"d{c}")] if least_degree else []), F.xxhash64(F.lit(seed + 1), c), F.col(c))
    dropped: DataFrame | None = None
    while live.take(1):
        both = live.select(F.explode(F.array(F.struct(F.col("i").alias("u"), F.col("j").alias("v")), F.struct(F.col("j").alias("u"), F.col("i").alias("v")))).alias("e")).select("e.*")
        if least_degree:
            degree = workspace.save(both.groupBy("u").agg(F.count("*").alias("du")), "degrees")
            both = both.join(degree, "u").join(degree.select(F.col("u").alias("v"), F.col("du").alias("dv")), "v")
        first = both.groupBy("u", *(["du"] if least_degree else [])).agg(F.min(order("v")).alias("m")).where(order("u") < F.col("m")).select("u")
        gone = workspace.save(both.join(first, "u", "left_semi").select(F.col("v").alias("id")).distinct(), "dropped")
        dropped = gone if dropped is None else dropped.unionByName(gone)
        kept = live.join(gone.select(F.col("id").alias("i")), "i", "left_anti").join(gone.select(F.col("id").alias("j")), "j", "left_anti")
        nxt = workspace.save(kept.select("i", "j"), "edges")
        workspace.drop(live)
        live = nxt
    return nodes.select("id").distinct() if dropped is None else nodes.select("id").distinct().join(dropped, "id", "left_anti")


def weighted_threshold(lo: float, hi: float, parameter: float) -> float:
    """Edge weight above which neighbours are dropped in a weighted graph: lo + (1 - p)(hi - lo)."""
    return lo + (1 - parameter) * (hi - lo)


def random_split(rows: DataFrame, id_col: str, test_share: float = 0.2, seed: int = 0, numeric: bool = False) -> DataFrame:
    """``sample_id, split, role`` (X5, X11, O22): the first ``ceil(share n)`` ids in hash order are test.

    Exact without sorting all rows in one task: a histogram of the hash finds the bucket where the cut
    falls, and only that bucket is ranked.
    """
    keyed = rows.select(F.col(id_col).alias("sample_id")).where("sample_id is not null").distinct().withColumn("h", pseudo("sample_id", numeric, seed))
    counts = {r["b"]: r["n"] for r in keyed.groupBy(F.floor(F.col("h") / 1024).alias("b")).agg(F.count("*").alias("n")).collect()}  # under 1000 rows
    want, at, cut = math.ceil(test_share * sum(counts.values()) - 1e-9), 0, -1
    for b in sorted(counts):
        if at + counts[b] > want:
            cut = b
            break
        at += counts[b]
    rank = F.row_number().over(Window.partitionBy("b").orderBy("h", "sample_id"))
    keyed = keyed.withColumn("b", F.floor(F.col("h") / 1024))
    inside = keyed.where(F.col("b") == cut).withColumn("test", rank <= want - at) if cut >= 0 else keyed.where("false").withColumn("test", F.lit(True))
    outside = keyed.where(F.col("b") != cut).withColumn("test", (F.col("b") < cut) if cut >= 0 else F.lit(True))
    return _roles(inside.unionByName(outside), F.col("test"))


def _roles(rows: DataFrame, test: Column, *more: Column) -> DataFrame:
    t = F.coalesce(test, F.lit(False))
    return rows.select("sample_id", F.when(t, "test").otherwise("train").alias("split"), F.when(t, "held_out").otherwise("fit").alias("role"), *more)


# ---- component packing ------------------------------------------------------------------------------------


def pack_components(table: DataFrame, n: int, workspace: Workspace) -> tuple[DataFrame, str]:
    """``component`` of the test side (X2), and ``valid`` or ``invalid_test_size``.

    Components come in the order of largest external maximum, then external mean (to twelve digits), largest
    first and nulls last, then size, then smallest id.  Each is taken unless it would lead beyond the most
    rows, until the target is reached.  A component that cannot lead from below the target beyond the most
    is never passed over, so all of those come by a distributed running sum of their sizes; the others, of
    which there are at most twenty (or few rows at all), are decided one after another.
    """
    target, least, most = half_even(TARGET * n), math.ceil(LEAST * n - 1e-9), math.floor(MOST * n + 1e-9)
    number = lambda c: F.when(~F.isnan(c), F.col(c))
    order = [number("external_max").desc_nulls_last(), F.round(number("external_mean"), 12).desc_nulls_last(), F.asc("size"), F.asc("min_id")]
    small = F.col("size") <= most - target
    fits = table.where(F.col("size") <= most).select("component", F.col("size").cast("bigint").alias("size"), "external_max", "external_mean", "min_id")
    ran = workspace.save(running(fits, order, {"place": F.lit(1), "before": F.when(small, F.col("size")).otherwise(0)}, workspace), "ran")
    taken: list[tuple] = []
    for row in ran.where(~small).orderBy("place").select("component", "place", "before", "size").collect():  # at most n / (most - target) rows
        total = row["before"] + sum(size for *_, size in taken)
        if total < target and total + row["size"] <= most:
            taken.append((row["component"], row["place"], row["size"]))
    earlier = sum((F.when(F.col("place") > place, size).otherwise(0) for _, place, size in taken), F.lit(0))
    chosen = ran.where(F.when(small, F.col("before") - F.col("size") + earlier < target).otherwise(F.col("component").isin([c for c, *_ in taken])))
    chosen = workspace.save(chosen.select("component", "size"), "chosen", total=F.coalesce(F.sum("size"), F.lit(0)))
    return chosen.select("component"), "valid" if least <= metric(chosen, "total") <= most else "invalid_test_size"


def threshold_split(labels: DataFrame, table: DataFrame, workspace: Workspace | None = None) -> tuple[DataFrame, str]:
    """``sample_id, split, role`` and the status of the packing for labelled components."""
    n = labels.count()
    chosen, status = pack_components(table, n, workspace or Workspace(labels.sparkSession, "packing"))
    test = chosen.withColumn("t", F.lit(True))
    rows = labels.select(F.col("id").alias("sample_id"), "component")
    joined = salted_join(rows, test, "component", hot_keys(rows, "component", n), "sample_id", "left")
    return _roles(joined, F.col("t")), status


def split_id(threshold: float) -> str:
    return f"tau_{threshold:.2f}".replace(".", "p")


def violations(split: DataFrame, edges: DataFrame, threshold: float) -> DataFrame:
    """One row (X4): sizes, cross edges at or above the threshold, and the status."""
    side = split.select("sample_id", "split")
    a, b = side.select(F.col("sample_id").alias("i"), F.col("split").alias("x")), side.select(F.col("sample_id").alias("j"), F.col("split").alias("y"))
    crossed = edges.where(F.col("w") >= threshold).join(a, "i").join(b, "j").where("x <> y").agg(F.count("*").alias("violations"))
    sizes = side.agg(F.count_if(F.col("split") == "train").alias("train_size"), F.count_if(F.col("split") == "test").alias("test_size"))
    row = sizes.crossJoin(crossed)  # one row each
    status = F.when((F.col("train_size") == 0) | (F.col("test_size") == 0), "invalid_empty_train_or_test").when(F.col("violations") > 0, "invalid_threshold_violation").otherwise("valid")
    return row.withColumn("status", status)


def per_test_similarity(split: DataFrame, edges: DataFrame) -> DataFrame:
    """Per test row its largest and mean similarity to the training side (A9); unlisted pairs are 0."""
    from nearfield.operators.graph import both_ways

    train = split.where("split = 'train'")
    n = train.count()
    near = both_ways(edges).join(train.select(F.col("sample_id").alias("v")), "v", "left_semi").groupBy(F.col("u").alias("sample_id")).agg(F.max("w").alias("m"), F.sum("w").alias("s"))
    return split.where("split = 'test'").select("sample_id").join(near, "sample_id", "left").select(
        "sample_id", F.greatest(F.coalesce("m", F.lit(0.0)), F.lit(0.0)).alias("max_similarity"), (F.coalesce("s", F.lit(0.0)) / max(n, 1)).alias("mean_similarity")
    )


def split_summary(split: DataFrame, edges: DataFrame) -> DataFrame:
    """One row (A8): sizes and the distribution of the test rows' similarity to training."""
    m = F.col("max_similarity")
    stats = per_test_similarity(split, edges).agg(
        F.count("*").alias("test_size"), F.avg(m).alias("mean_max"), F.percentile(m, F.lit(0.5)).alias("median_max"), F.percentile(m, F.lit(0.1)).alias("p10_max"), F.percentile(m, F.lit(0.9)).alias("p90_max"),
        F.max(m).alias("max_max"), F.avg("mean_similarity").alias("mean_mean"),
    )
    return split.agg(F.count_if(F.col("split") == "train").alias("train_size")).crossJoin(stats)  # one row each


def split_summaries(tested: DataFrame, edges: DataFrame, count: int) -> DataFrame:
    """``k`` and :func:`split_summary` of ``count`` splits at once: ``tested`` has ``id, tags``, of which ``tags[k]`` tells whether the row is test.

    The edges are joined with the far ends' splits once, and leave as one row a node.
    """
    from nearfield.operators.graph import both_ways

    bits = sum((F.when(~F.col("tags")[k], 1 << k).otherwise(0) for k in range(count)), F.lit(0)).cast("bigint")
    ends, m = both_ways(edges), 2 * edges.count()
    far = salted_join(ends, tested.select(F.col("id").alias("v"), bits.alias("train")), "v", hot_keys(ends, "v", m), "u")
    near = [F.when(F.col("train").bitwiseAND(F.lit(1 << k).cast("bigint")) != 0, F.col("w")) for k in range(count)]
    each = far.groupBy(F.col("u").alias("id")).agg(*[f(x).alias(f"{c}{k}") for k, x in enumerate(near) for c, f in (("m", F.max), ("s", F.sum))])
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    listed = F.array(*[F.struct(F.lit(k).alias("k"), F.col("tags")[k].alias("test"), F.greatest(zero(f"m{k}"), F.lit(0.0)).alias("m"), zero(f"s{k}").alias("s")) for k in range(count)])
    flat = tested.join(each, "id", "left").select(F.explode(listed).alias("e")).select("e.*")
    at = lambda q: F.percentile(F.when(F.col("test"), F.col("m")), F.lit(q))
    test = lambda f, c: f(F.when(F.col("test"), F.col(c)))
    train = F.count_if(~F.col("test"))
    return flat.groupBy("k").agg(
        train.alias("train_size"), F.count_if("test").alias("test_size"), test(F.avg, "m").alias("mean_max"), at(0.5).alias("median_max"), at(0.1).alias("p10_max"), at(0.9).alias("p90_max"),
        test(F.max, "m").alias("max_max"), (test(F.avg, "s") / F.greatest(train, F.lit(1))).alias("mean_mean"),
    )


def recommend(sweep: DataFrame, prevalence: float, drop: float = 0.15, balance: float = 0.10) -> DataFrame:
    """The recommended split (X7): of the valid ones with AUROC at least ``drop`` under the easiest and a balanced label rate
    the one of lowest mean similarity; if none, the valid one of lowest similarity."""
    good = sweep.where("status = 'valid'")
    whole = Window.partitionBy(F.lit(0))  # one row a threshold
    marked = good.withColumn("__easy", F.max_by("roc_auc", "mean_max").over(whole))
    fits = (F.col("roc_auc") <= F.col("__easy") - drop) & (F.abs(F.col("test_rate") - prevalence) <= balance)
    return marked.orderBy(F.coalesce(fits, F.lit(False)).desc(), F.asc_nulls_last("mean_max"), "split_id").limit(1).drop("__easy")


def validate_sweep(sweep: DataFrame) -> DataFrame:
    """One row (X8): is the similarity strictly falling with the threshold, and do the metrics of the first and last split differ?"""
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("threshold"))
    d = sweep.withColumn("d", F.col("mean_max") - F.lag("mean_max").over(w))
    return d.agg(
        F.coalesce(F.max("d") < 0, F.lit(False)).alias("strictly_falling"), F.max_by("roc_auc", "threshold").alias("first_auc"), F.min_by("roc_auc", "threshold").alias("last_auc"), F.count("*").alias("splits")
    )


# ---- operating points -------------------------------------------------------------------------------------


def group_holdout(rows: DataFrame, id_col: str, groups: Sequence[str], held_out: Sequence[Sequence] | None = None, share: float = 0.2, seed: int = 0) -> DataFrame:
    """Whole groups are held out: the listed values, else about a ``share`` of the groups by hash.

    ``heldout_group`` names the group; null counts as a group of its own.
    """
    name = F.concat_ws("|", *[F.coalesce(F.col(g).cast("string"), F.lit("<null>")) for g in groups])
    keyed = rows.select(F.col(id_col).alias("sample_id"), name.alias("g")).where("sample_id is not null")
    if held_out is not None:
        test = F.col("g").isin(["|".join("<null>" if v is None else str(v) for v in h) for h in held_out])
    else:
        test = pseudo("g", False, seed) < int(share * MODULUS)
    return _roles(keyed, test, F.when(test, F.col("g")).alias("heldout_group"))


def leave_one_out(rows: DataFrame, id_col: str, group: str) -> DataFrame:
    """One fold per group (O3, O5, O9-O11): ``fold_id`` is the held-out group, every row is in every fold.

    Groups are counted first; more than 1000 folds are refused, as the result is rows x folds.
    """
    folds = rows.where(F.col(group).isNotNull()).select(F.col(group).cast("string").alias("fold_id")).distinct()
    if len(folds.take(1001)) > 1000:
        raise ValueError("more than 1000 groups: use group_k_fold")
    each = rows.select(F.col(id_col).alias("sample_id"), F.col(group).cast("string").alias("g")).where("sample_id is not null").crossJoin(F.broadcast(folds))
    return _roles(each, F.col("g").eqNullSafe(F.col("fold_id")), F.col("fold_id"))


def group_k_fold(rows: DataFrame, id_col: str, group: str, k: int, numeric: bool = False, seed: int = 0) -> DataFrame:
    """``sample_id, fold_id``: rows of one group share a fold."""
    return rows.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("sample_id"), F.pmod(pseudo(group, numeric, seed), F.lit(k)).cast("int").alias("fold_id"))


def predicate_split(rows: DataFrame, id_col: str, test: Column | str) -> DataFrame:
    """Rows that satisfy a predicate (a Column or SQL text) are test (O4, O27, X9, X10); null is train."""
    return _roles(rows.withColumn("__t", F.expr(test) if isinstance(test, str) else test).withColumnRenamed(id_col, "sample_id"), F.col("__t"))


def contiguous_interval(df: DataFrame, position: str, share: float) -> tuple[float, float]:
    """The centred interval of width ``max(1, share range)`` (X9); share in 0.05..0.8."""
    if not 0.05 <= share <= 0.8:
        raise ValueError("share must lie in 0.05..0.8")
    row = df.agg(F.min(position).alias("lo"), F.max(position).alias("hi")).first()
    lo, hi = float(row["lo"]), float(row["hi"])
    width = max(1.0, (hi - lo) * share)
    middle = (lo + hi) / 2
    return middle - width / 2, middle + width / 2


def quantile_holdout(rows: DataFrame, id_col: str, value: str, share: float = 0.1, side: str = "high") -> DataFrame:
    """The extreme tail of a property is test (O15); NaN and null are train."""
    v = F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double"))
    cut = (percentiles_of(rows, v, [1 - share if side == "high" else share]) or [None])[0]
    return predicate_split(rows, id_col, (v > cut if side == "high" else v < cut) if cut is not None else F.lit(False))


def temporal_forward(rows: DataFrame, id_col: str, ts: str, cutoff: str) -> DataFrame:
    """Rows before the cutoff train, from it on test (O28); rows without time are left out."""
    return predicate_split(rows.where(F.col(ts).isNotNull()), id_col, F.col(ts) >= F.lit(cutoff).cast("timestamp"))


def step_forward(rows: DataFrame, id_col: str, order: str, steps: int) -> DataFrame:
    """``sample_id, fold_id, split, role`` (O1): fold f trains on steps <= f and tests on step f + 1.

    Steps are cut at exact quantiles of the order, so no global sort into one task is needed.
    """
    timed = rows.schema[order].dataType.typeName().startswith("timestamp")
    key = F.col(order).cast("timestamp").cast("double") if timed else F.col(order).cast("double")
    cuts = percentiles_of(rows, key, [i / steps for i in range(1, steps)])
    edges = F.array(*[F.lit(float(c)) for c in (cuts or [])])
    stepped = rows.where(F.col(order).isNotNull()).select(F.col(id_col).alias("sample_id"), F.size(F.filter(edges, lambda c: c < key)).alias("step"))
    folds = stepped.withColumn("fold_id", F.explode(F.sequence(F.lit(0), F.lit(steps - 2)))).where(F.col("step") <= F.col("fold_id") + 1)
    return _roles(folds, F.col("step") == F.col("fold_id") + 1, F.col("fold_id"))


def spatial_block(rows: DataFrame, id_col: str, lat: str, lon: str, degrees: float, share: float = 0.2, buffer_km: float = 0.0, seed: int = 0) -> DataFrame:
    """Blocks of a grid are held out by hash; training rows within the buffer of a test row are dropped.

    The buffer is an anti-join on the neighbouring blocks, so it must not be wider than one block.
    """
    if buffer_km > degrees * 111.0:
        raise ValueError("the buffer must not be wider than a block")
    b = rows.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).select(
        F.col(id_col).alias("sample_id"), F.col(lat).alias("la"), F.col(lon).alias("lo"), F.floor(F.col(lat) / degrees).cast("bigint").alias("x"), F.floor(F.col(lon) / degrees).cast("bigint").alias("y")
    )
    held = F.pmod((F.col("x") * 1009 + F.col("y")) * MULTIPLIER + seed, F.lit(MODULUS)) < int(share * MODULUS)
    out = _roles(b, held, F.col("la"), F.col("lo"), F.col("x"), F.col("y"))
    if buffer_km <= 0:
        return out.select("sample_id", "split", "role")
    near = out.where("split = 'test'").select(F.explode(F.sequence(F.col("x") - 1, F.col("x") + 1)).alias("x"), F.col("y"), F.col("la").alias("ta"), F.col("lo").alias("to"))
    near = near.withColumn("y", F.explode(F.sequence(F.col("y") - 1, F.col("y") + 1)))
    close = (
        out.where("split = 'train'").join(near, ["x", "y"]).where(kernels.haversine_km(F.col("la"), F.col("lo"), F.col("ta"), F.col("to")) <= buffer_km).select("sample_id").distinct()
    )
    return out.select("sample_id", "split", "role").join(close, "sample_id", "left_anti")


def spatiotemporal(rows: DataFrame, id_col: str, block: Column, ts: str, origin: str, horizon_days: int, share: float = 0.2) -> DataFrame:
    """Held-out blocks within the horizon after the origin are test, other blocks before it are train, the rest is left out."""
    start = F.lit(origin).cast("timestamp")
    keyed = rows.select(F.col(id_col).alias("sample_id"), block.cast("string").alias("b"), F.col(ts).alias("ts")).where("ts is not null")
    held = pseudo("b", False) < int(share * MODULUS)
    end = start + F.make_interval(days=F.lit(horizon_days))
    test = held & (F.col("ts") >= start) & (F.col("ts") < end)
    return _roles(keyed.where(test | (~held & (F.col("ts") < start))), test)


def cold_start(pairs: DataFrame, left: str, right: str, mode: str = "left", share: float = 0.2, numeric: bool = False, seed: int = 0) -> DataFrame:
    """Entities that training never sees (O6): rows of held-out left (or right) entities are test; in pair mode both must be
    held out, and rows with only one of them are left out."""
    hold_l, hold_r = pseudo(left, numeric, seed) < int(share * MODULUS), pseudo(right, numeric, seed + 1) < int(share * MODULUS)
    if mode == "pair":
        rows, test = pairs.where(hold_l == hold_r), hold_l & hold_r
    else:
        rows, test = pairs, hold_l if mode == "left" else hold_r
    return rows.withColumn("split", F.when(test, "test").otherwise("train"))


#: The catalog of operating points: name -> (generic operator, held-out unit, curve region); fixed values.
OPERATING_POINTS: dict[str, tuple[str, str, str]] = {
    "bioactivity_step_forward_split": ("step_forward", "time_or_novelty_step", "axis_specific"),
    "biological_sequence_homology_cluster_split": ("threshold_split", "sequence_cluster", "low_overlap"),
    "chromosome_loco_holdout": ("leave_one_out", "chromosome", "low_overlap"),
    "contiguous_mutational_region_split": ("predicate_split", "mutation_region", "low_overlap"),
    "cross_species_taxon_holdout": ("group_holdout", "species_or_taxon", "low_overlap"),
    "drug_target_cold_start_split": ("cold_start", "drug_id_target_id_or_pair", "low_overlap"),
    "graph_covariate_concept_shift_split": ("group_holdout", "environment_or_shift_factor", "axis_specific"),
    "group_k_fold_holdout": ("group_k_fold", "group_id", "axis_specific"),
    "leave_assay_out_bioactivity_split": ("group_holdout", "assay_id_or_context", "low_overlap"),
    "leave_one_domain_out_benchmark": ("leave_one_out", "domain_id", "low_overlap"),
    "leave_site_out_external_validation": ("leave_one_out", "site_id", "low_overlap"),
    "materials_leave_cluster_composition_split": ("group_holdout", "material_cluster_or_composition_regime", "low_overlap"),
    "medical_imaging_scanner_site_holdout": ("group_holdout", "scanner_site_protocol", "low_overlap"),
    "molecular_fingerprint_cluster_split": ("threshold_split", "fingerprint_cluster", "low_overlap"),
    "molecular_property_extreme_split": ("quantile_holdout", "property_bin", "extreme_low_overlap"),
    "molecular_scaffold_split": ("group_holdout", "scaffold", "medium_overlap"),
    "molecular_umap_cluster_split": ("group_holdout", "umap_cluster", "low_overlap"),
    "perturbation_systematic_variation_confounder_holdout": ("group_holdout", "confounder_level_or_effect_regime", "axis_specific"),
    "perturbation_unseen_cell_type_condition_split": ("group_holdout", "cell_type_or_condition", "low_overlap"),
    "perturbation_unseen_perturbation_split": ("group_holdout", "perturbation_id", "low_overlap"),
    "protein_family_remote_homology_holdout": ("group_holdout", "family_or_superfamily", "extreme_low_overlap"),
    "random_iid_split_baseline": ("random_split", "sample", "high_overlap"),
    "regulatory_cross_cell_type_assay_holdout": ("group_holdout", "cell_type_or_assay", "axis_specific"),
    "rna_structurally_dissimilar_split": ("threshold_split", "structure_cluster_or_dissimilar_set", "low_overlap"),
    "spatial_block_buffered_cv": ("spatial_block", "spatial_block", "low_overlap"),
    "spatiotemporal_forecast_horizon_split": ("spatiotemporal", "space_time_block", "axis_specific"),
    "targeted_intended_use_validation": ("predicate_split", "deployment_setting", "axis_specific"),
    "temporal_forward_split": ("temporal_forward", "timestamp_or_period", "axis_specific"),
}


def operating_point(name: str, rows: DataFrame, **arguments) -> DataFrame:
    """The split of a catalog entry through its generic operator, with ``operating_point_id`` and ``expected_curve_region``."""
    operator, _, region = OPERATING_POINTS[name]
    out = globals()[operator](rows, **arguments)
    out = out[0] if isinstance(out, tuple) else out
    return out.withColumn("operating_point_id", F.lit(name)).withColumn("expected_curve_region", F.lit(region))
