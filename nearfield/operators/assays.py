"""Loading and pairing of assay tables, nearest rows under several axes, and the focused split pipeline."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.functions import features
from nearfield.functions import kernels as K
from nearfield.operators import candidates as C
from nearfield.operators import graph as G
from nearfield.operators import setblocks as SB
from nearfield.operators import splits as S
from nearfield.operators.edges import block_pairs, grid_top_k
from nearfield.schema import require
from nearfield.storage import Workspace


def first_of(df: DataFrame, names: Sequence[str], default: Column | None = None) -> Column:
    """The first non-null of the columns that exist (P19); none of them: the default or null."""
    known = [F.col(n) for n in names if n in df.columns]
    options = [*known, *([default] if default is not None else [])]
    return F.coalesce(*options) if options else F.lit(None)


def finite_or_null(column: Column) -> Column:
    """A number, or null for texts that are none, NaN and infinities."""
    v = column.try_cast("double")
    return F.when(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")), v)


def curve_payload(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows with array columns as one row per place (P17): short arrays are padded with null, plain columns repeat."""
    require(df, columns)
    arrays = [c for c, kind in df.select(*columns).dtypes if kind.startswith("array")]
    if not arrays:
        return df.select(*columns)
    zipped = df.select(*[c for c in columns if c not in arrays], F.posexplode(F.arrays_zip(*arrays)).alias("place", "__z"))
    return zipped.select(*[F.col(f"__z.{c}").alias(c) if c in arrays else F.col(c) for c in columns])


def positions(mutant: Column) -> Column:
    """All integers in a mutation text, in order; null gives none."""
    return F.transform(F.regexp_extract_all(F.coalesce(mutant.cast("string"), F.lit("")), F.lit(r"\d+"), F.lit(0)), lambda x: x.cast("int"))


def position_tokens(sequence: Column) -> Column:
    """Position-aware tokens ``pos1_A, pos2_C, ..``; an empty sequence gives none."""
    chars = F.filter(F.split(sequence, ""), lambda c: c != "")
    return F.transform(chars, lambda c, i: F.concat(F.lit("pos"), (i + 1).cast("string"), F.lit("_"), c))


def load_assay(df: DataFrame, order: Sequence[str], most: int | None = None, seed: int = 13) -> DataFrame:
    """``sample_id, sequence, y, mutation_center, mutation_depth, tokens`` of an assay ``mutant, DMS_score, sequence``.

    Rows without score, sequence or any number in the mutant are left out.  With ``most`` a sample of that
    many rows is taken by hash, which is the feature asked for.  Ids follow the explicit order.
    """
    require(df, ["mutant", "DMS_score", "sequence"], "assay")
    at = positions(F.col("mutant"))
    rows = df.where("DMS_score is not null and sequence is not null and not isnan(double(DMS_score))").withColumn("__p", at).where(F.size("__p") > 0)
    if most is not None:
        rows = rows.orderBy(F.xxhash64(F.lit(seed), "mutant", "sequence"), *order).limit(most)
    rows = rows.select(
        *order, F.col("DMS_score").cast("double").alias("y"), *([] if "sequence" in order else ["sequence"]),
        (F.aggregate("__p", F.lit(0.0), lambda a, x: a + x) / F.size("__p")).alias("mutation_center"), F.size("__p").cast("double").alias("mutation_depth"), position_tokens(F.col("sequence")).alias("tokens"),
    )
    return features.row_ids(rows, "seq_", list(order))


def nearest_composite(queries: DataFrame, train: DataFrame, axes: dict[str, float]) -> DataFrame:
    """The nearest training row under several numeric axes at once (J17): the geometric mean of exp(-|difference| / scale).

    Both sides have ``id`` and the axes; ties go to the smaller id; rows with a null axis are left out.
    """
    have = " and ".join(f"`{a}` is not null" for a in axes)
    q = queries.where(have).select(F.col("id").alias("sample_id"), *[F.col(a).cast("double").alias(f"q_{a}") for a in axes])
    t = train.where(have).select(F.col("id").alias("train_id"), *[F.col(a).cast("double").alias(f"t_{a}") for a in axes])
    apart = sum((F.abs(F.col(f"q_{a}") - F.col(f"t_{a}")) / s for a, s in axes.items()), F.lit(0.0))
    pairs = block_pairs(q, t, "train_id").where("sample_id <> train_id").select("sample_id", "train_id", F.round(F.exp(-apart / len(axes)), 10).alias("similarity"))
    best = pairs.groupBy("sample_id").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "train_id")).alias("b"))
    return best.select("sample_id", F.col("b.train_id").alias("train_id"), (-F.col("b.s")).alias("similarity"))


def nearest_molecule(queries: DataFrame, train: DataFrame, text: str) -> DataFrame:
    """The most similar training text by character n-grams (J22, K21), ties by smaller id; no training row: similarity 0 and null."""
    texts = lambda df: df.where(F.col(text).isNotNull()).select("id", F.trim(text).alias("text"))
    ws = Workspace(train.sparkSession, "molecules")
    near = grid_top_k(ws.save(texts(queries), "queries"), ws.save(texts(train), "train"), SB.jaccard_grams, 1, 10, True, SB.gram_sets)
    best = near.select("sample_id", F.struct((-F.col("similarity")).alias("s"), "train_id").alias("b"))
    return queries.select(F.col("id").alias("sample_id")).join(best, "sample_id", "left").select("sample_id", F.col("b.train_id").alias("train_id"), F.coalesce(-F.col("b.s"), F.lit(0.0)).alias("similarity"))


def node_index(nodes: DataFrame) -> DataFrame:
    """``id, index``: ids and their rank from 0, for mapping between the two."""
    ranked = features.row_ids(nodes.select("id").distinct(), "", ["id"], 1)
    return ranked.select("id", F.col("sample_id").cast("bigint").alias("index"))


def focused_splits(sets: DataFrame, labels: DataFrame, workspace: Workspace, thresholds: Sequence[float] = S.SWEEP) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The focused split pipeline (B5): one row a threshold, and the splits by id.

    ``sets`` has ``id, items``, ``labels`` has ``id, label`` (0 or 1).  Every pair of rows counts in the
    packing order and in the similarity summary, whatever the thresholds are: pairs are never listed but
    summed up by profiles and in blocks of equal sets (:mod:`setblocks`), once for the components, once for
    what lies outside of them and once for the splits.  Per threshold: components, packing, check of the cross
    edges, similarity summary, label rate.  ``recommended`` marks the valid split of lowest mean
    similarity whose label rate is within 0.1 of the whole.
    """
    members, classes = C.set_classes(sets, "id", "items")
    members, classes = workspace.save(members, "members"), workspace.save(classes, "classes")
    counts = members.groupBy("class_id").agg(F.count("*").alias("m"))
    # numbers instead of ids, fixed as they are written down
    folded = classes.join(counts, "class_id").select(F.monotonically_increasing_id().alias("class_id"), F.col("class_id").alias("name"), F.transform("items", lambda x: F.xxhash64(x)).alias("items"), "m")
    folded = workspace.save(folded, "folded")
    overlaps, names = SB.Overlaps(folded, workspace), folded.select("class_id", "name")
    forest = workspace.save(SB.forest(overlaps, min(thresholds)), "forest")
    found = dict(G.component_sweep(forest, folded.select(F.col("class_id").alias("id")), list(thresholds), workspace))
    tagged = names
    for k, t in enumerate(thresholds):
        tagged = tagged.join(found[t].select(F.col("id").alias("class_id"), F.col("component").alias(f"__{k}")), "class_id")
    listed = [f"__{k}" for k in range(len(thresholds))]
    tagged = workspace.save(tagged.select("class_id", "name", F.array(*listed).alias("tags")), "tagged")
    tables = workspace.save(SB.component_tables(overlaps, tagged.drop("name"), names), "tables")
    labelled = workspace.save(members.join(tagged.select(F.col("name").alias("class_id"), "tags"), "class_id"), "labelled")
    splits, packed, tested = {}, [], names
    for k, t in enumerate(thresholds):
        split, status = S.threshold_split(labelled.select("id", F.col("tags")[k].alias("component")), tables.where(F.col("k") == k), workspace)
        splits[S.split_id(t)] = split = workspace.save(split, "split")
        packed.append(status)
        tested = tested.join(split.select(F.col("sample_id").alias("name"), (F.col("split") == "test").alias(f"__{k}")), "name")
    tested = workspace.save(tested.select("class_id", F.array(*listed).alias("tags")), "tested")
    summaries = workspace.save(SB.split_summaries(overlaps, tested, thresholds), "summaries")
    rate = labels.agg(F.avg("label")).first()[0] or 0.0
    rows = None
    for k, t in enumerate(thresholds):
        test_rate = splits[S.split_id(t)].where("split = 'test'").join(labels.withColumnRenamed("id", "sample_id"), "sample_id").agg(F.avg("label").alias("test_rate"))
        checked = F.when((F.col("train_size") == 0) | (F.col("test_size") == 0), "invalid_empty_train_or_test").when(F.col("violations") > 0, "invalid_threshold_violation")
        one = summaries.where(F.col("k") == k).drop("k", "violations").crossJoin(test_rate).crossJoin(summaries.where(F.col("k") == k).select("violations"))  # one row each
        row = one.withColumns({"threshold": F.lit(float(t)), "split_id": F.lit(S.split_id(t)), "status": F.coalesce(checked, F.lit(packed[k]))})
        rows = row if rows is None else rows.unionByName(row)
    rows = workspace.save(rows, "sweep")
    best = rows.where((F.col("status") == "valid") & (F.abs(F.col("test_rate") - rate) <= 0.1)).orderBy(F.asc_nulls_last("mean_max"), "split_id").limit(1).select("split_id", F.lit(True).alias("recommended"))
    return rows.join(F.broadcast(best), "split_id", "left").withColumn("recommended", F.coalesce("recommended", F.lit(False))), splits
