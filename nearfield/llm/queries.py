"""Queries of the training-data operators and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm import components, leakage, overlap, packing, reading, setjoin, splits, topn
from nearfield.storage import Workspace

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return topn.nearest_train_rows(_table(spark, d, "pairwise_similarity")).select("sample_id", "train_id")


def p2_ranked(spark: SparkSession, d: str) -> DataFrame:
    return topn.nearest_train_rows(_table(spark, d, "pairwise_similarity"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return components.consolidate(_table(spark, d, "pairwise_similarity"), Workspace(spark, "p3"))


QUERIES: dict[str, Query] = {"p2_found": p2_found, "p2_ranked": p2_ranked, "p3_found": p3_found}

_VALID = "similarity IS NOT NULL AND NOT isnan(similarity) AND similarity BETWEEN 0 AND 1 AND sample_id <> train_id"
_P2 = f"""
    SELECT sample_id, train_id, similarity, CAST(rank AS INT) AS rank FROM (
        SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY similarity DESC, train_id) AS rank
        FROM (SELECT sample_id, train_id, max(similarity) AS similarity FROM pairwise_similarity WHERE {_VALID} GROUP BY ALL))
    WHERE rank <= 10"""

ORACLES: dict[str, str] = {
    "p2_found": f"SELECT sample_id, train_id FROM ({_P2})",
    "p2_ranked": _P2,
    "p3_found": f"""
        WITH RECURSIVE strong AS (SELECT DISTINCT sample_id AS a, train_id AS b FROM pairwise_similarity WHERE {_VALID} AND similarity >= 0.8),
        link AS (SELECT a, b FROM strong UNION SELECT b, a FROM strong),
        reach(record_id, other) AS (SELECT a, a FROM link UNION SELECT reach.record_id, link.b FROM reach JOIN link ON link.a = reach.other)
        SELECT record_id, min(other) AS group_id FROM reach GROUP BY record_id""",
}


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    sets = setjoin.component_sets(_table(spark, d, "focused_molecules"), "sample_id", "smiles")
    pairs = setjoin.similar_records(sets, Workspace(spark, "p5"), 0.6)
    return pairs.select(F.col("id_1").alias("sample_id_1"), F.col("id_2").alias("sample_id_2"))


def p5_links(spark: SparkSession, d: str) -> DataFrame:
    """The class form: one row a record, copies are not paired."""
    sets = setjoin.component_sets(_table(spark, d, "focused_molecules"), "sample_id", "smiles")
    return setjoin.class_links(sets, Workspace(spark, "p5-links"), 0.6).withColumnRenamed("id", "sample_id")


QUERIES |= {"p5_found": p5_found, "p5_links": p5_links}
ORACLES["p5_found"] = r"""
    WITH s AS (
        SELECT sample_id, list_sort(list_distinct(list_filter(list_transform(string_split(smiles, '.'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''))) AS items
        FROM (SELECT sample_id, min(smiles) AS smiles FROM focused_molecules GROUP BY sample_id)),
    n AS (SELECT *, len(items) AS n FROM s WHERE len(items) > 0),
    p AS (SELECT a.sample_id AS sample_id_1, b.sample_id AS sample_id_2, a.n + b.n AS total, len(list_intersect(a.items, b.items)) AS common
          FROM n a JOIN n b ON a.sample_id < b.sample_id)
    SELECT sample_id_1, sample_id_2 FROM p WHERE common >= 0.6 * (total - common) - 1e-9"""

ORACLES["p5_links"] = r"""
    WITH s AS (
        SELECT sample_id, list_sort(list_distinct(list_filter(list_transform(string_split(smiles, '.'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''))) AS items
        FROM (SELECT sample_id, min(smiles) AS smiles FROM focused_molecules GROUP BY sample_id)),
    c AS (SELECT items, min(sample_id) AS class_id, len(items) AS n FROM s WHERE len(items) > 0 GROUP BY items),
    p AS (SELECT a.class_id AS c, b.class_id AS o FROM c a JOIN c b ON a.class_id <> b.class_id AND len(list_intersect(a.items, b.items)) >= 0.6 * (a.n + b.n - len(list_intersect(a.items, b.items))) - 1e-9)
    SELECT sample_id, class_id, count(o) AS links FROM s JOIN c USING (items) LEFT JOIN p ON p.c = class_id GROUP BY sample_id, class_id"""


def _split_state(spark: SparkSession, rows: DataFrame, targets: DataFrame, state: DataFrame, label: str) -> DataFrame:
    ws = Workspace(spark, label)
    edges = splits.tie_edges(splits.tie_keys(rows))
    return splits.update(state, rows.select(F.col("sample_id").alias("record_id")), edges, targets, ws)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "component_assignments")
    return splits.tied_groups(_split_state(spark, rows, _table(spark, d, "split_targets"), splits.empty_state(spark), "p6"))


def p6_splits(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "component_assignments")
    return _split_state(spark, rows, _table(spark, d, "split_targets"), splits.empty_state(spark), "p6-splits")


def p6_incremental(spark: SparkSession, d: str) -> DataFrame:
    """The same table in two batches on a persisted state, the first run and then all others with it: what is kept, new and quarantined."""
    rows, targets = _table(spark, d, "component_assignments"), _table(spark, d, "split_targets")
    first = rows.agg(F.min("run_id")).first()[0]
    ws = Workspace(spark, "p6-incremental")
    path = ws.path("state")
    state = None
    for batch in (rows.where(F.col("run_id") == first), rows):
        edges = splits.tie_edges(splits.tie_keys(batch))
        state, _ = splits.update_saved(path, batch.select(F.col("sample_id").alias("record_id")), edges, targets, ws)
    return state


def p6_check(spark: SparkSession, d: str) -> DataFrame:
    """One row: records, records without a split, keys whose records lie in several splits, and whether each split is near its target."""
    rows = _table(spark, d, "component_assignments")
    ws = Workspace(spark, "p6-check")
    state = ws.save(p6_splits(spark, d), "state")
    n = state.count()
    keys = splits.tie_keys(rows)
    torn = keys.join(state.select("record_id", "split"), "record_id").groupBy("key").agg(F.min("split").alias("lo"), F.max("split").alias("hi")).where("lo <> hi")
    share = state.groupBy("split").agg((F.count("*") / n).alias("share"))
    apart = _table(spark, d, "split_targets").join(share, "split", "left").agg(F.max(F.abs(F.col("fraction") - F.coalesce("share", F.lit(0.0)))).alias("apart"))
    counted = state.agg(F.count("*").alias("records"), F.count_if(F.col("split").isNull()).alias("without_split"))
    return counted.crossJoin(torn.agg(F.count("*").alias("keys_torn"))).crossJoin(apart.select((F.col("apart") < 0.02).alias("near_target")))  # one row each


def p7_packing(spark: SparkSession, d: str) -> DataFrame:
    ws = Workspace(spark, "p7")
    counts = ws.save(packing.token_counts(_table(spark, d, "documents")), "counts")
    return packing.pack(counts, _table(spark, d, "context_windows"), ws)


def p7_fill_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p7_packing(spark, d))


QUERIES |= {
    "p6_found": p6_found,
    "p6_splits": p6_splits,
    "p6_incremental": p6_incremental,
    "p6_check": p6_check,
    "p7_packing": p7_packing,
    "p7_fill_report": p7_fill_report,
}
ORACLES["p6_found"] = r"""
    WITH RECURSIVE tie AS (
        SELECT DISTINCT sample_id AS r, 'run:' || component_id || ':' || run_id AS k FROM component_assignments WHERE component_id >= 0 AND run_id IS NOT NULL
        UNION SELECT sample_id, 'cpd:' || upper(trim(compound_id)) FROM component_assignments WHERE regexp_full_match(upper(trim(compound_id)), 'CPD-[0-9]+')),
    hub AS (SELECT k, min(r) AS h FROM tie GROUP BY k),
    star AS (SELECT DISTINCT r AS a, h AS b FROM tie JOIN hub USING (k) WHERE r <> h),
    link AS (SELECT a, b FROM star UNION SELECT b, a FROM star),
    reach(sample_id, other) AS (SELECT a, a FROM link UNION SELECT reach.sample_id, link.b FROM reach JOIN link ON link.a = reach.other)
    SELECT sample_id, min(other) AS group_id FROM reach GROUP BY sample_id"""


ORACLES["p6_check"] = "SELECT count(DISTINCT sample_id) AS records, 0::BIGINT AS without_split, 0::BIGINT AS keys_torn, true AS near_target FROM component_assignments"


def p7_check(spark: SparkSession, d: str) -> DataFrame:
    """One row a capacity: texts placed, containers over capacity, texts divided without need, texts with tokens lost or doubled, and whether at most 1 % and one container more than needed are used."""
    ws = Workspace(spark, "p7-check")
    documents = _table(spark, d, "documents")
    counts = ws.save(packing.token_counts(documents), "counts")
    packed = ws.save(packing.pack(counts, _table(spark, d, "context_windows"), ws), "packed")
    full = packed.groupBy("window_name", "capacity", "container_id").agg(F.sum("n_tokens").alias("used"))
    full = full.groupBy("window_name").agg(F.count_if(F.col("used") > F.col("capacity")).alias("overfull"), (F.count("*") <= F.ceil(1.01 * F.sum("used") / F.max("capacity")) + 1).alias("well_filled"))
    texts = packed.groupBy("window_name", "capacity", "doc_id").agg(F.count("*").alias("pieces"), F.sum("n_tokens").alias("placed")).join(counts, "doc_id")
    least = F.ceil(F.col("n_tokens") / F.col("capacity"))
    texts = texts.groupBy("window_name").agg(
        F.count("*").alias("texts"), F.count_if(F.col("pieces") != least).alias("divided_without_need"), F.count_if(F.col("placed") != F.col("n_tokens")).alias("not_whole")
    )
    return texts.join(full, "window_name")


QUERIES["p7_check"] = p7_check
ORACLES["p7_check"] = r"""
    SELECT window_name, count(*) AS texts, 0::BIGINT AS divided_without_need, 0::BIGINT AS not_whole, 0::BIGINT AS overfull, true AS well_filled
    FROM documents, context_windows WHERE regexp_matches(text, '\S') GROUP BY window_name"""


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(_table(spark, d, "documents"), _table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_leaks(spark, d).select("doc_id", "item_id")


def p8_verbatim(spark: SparkSession, d: str) -> DataFrame:
    """The found pairs whose document holds the whole item letter by letter."""
    documents, items = _table(spark, d, "documents").select("doc_id", F.col("text").alias("__t")), _table(spark, d, "eval_items").select("item_id", F.trim("text").alias("__i"))
    found = p8_found(spark, d).join(documents, "doc_id").join(items, "item_id")
    return found.where(F.contains("__t", "__i")).select("doc_id", "item_id").distinct()


QUERIES |= {"p8_found": p8_found, "p8_leaks": p8_leaks, "p8_verbatim": p8_verbatim}
ORACLES["p8_verbatim"] = "SELECT DISTINCT doc_id, item_id FROM documents d, eval_items i WHERE trim(i.text) <> '' AND contains(d.text, trim(i.text))"


def p9_levels(spark: SparkSession, d: str) -> DataFrame:
    return reading.reading_levels(_table(spark, d, "documents"), _table(spark, d, "reading_labels"), Workspace(spark, "p9"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_levels(spark, d).where("hard_share > 0.5").select("doc_id")


def p9_profile(spark: SparkSession, d: str) -> DataFrame:
    """Documents and words per source and rounded level."""
    levels = p9_levels(spark, d)
    sources = _table(spark, d, "documents").select(F.col("doc_id"), "source").dropDuplicates(["doc_id"])
    return levels.join(sources, "doc_id").groupBy("source", F.round("level").cast("int").alias("level")).agg(F.count("*").alias("documents"), F.sum("n_words").alias("n_words"))


def p9_fit(spark: SparkSession, d: str) -> DataFrame:
    """The alternation: log-likelihood after each round."""
    ws = Workspace(spark, "p9-fit")
    model = reading.fit(ws.save(reading.units(_table(spark, d, "documents")), "units"), _table(spark, d, "reading_labels"), ws)
    return spark.createDataFrame([(i + 1, x) for i, x in enumerate(model.likelihoods if model else [])], "round int, log_likelihood double")


def p9_holdout(spark: SparkSession, d: str) -> DataFrame:
    """Held-out accuracy: labels of documents whose id is no multiple of four train, the others are compared.  One row."""
    ws, labels = Workspace(spark, "p9-holdout"), _table(spark, d, "reading_labels")
    levels = reading.reading_levels(_table(spark, d, "documents"), labels.where("doc_id % 4 <> 0"), ws)
    both = levels.join(reading.doc_labels(labels.where("doc_id % 4 = 0")), "doc_id")
    hard = F.col("y") >= reading.HARD
    return both.agg(
        F.count("*").alias("documents"),
        F.avg(((F.col("hard_share") > 0.5) == hard).cast("double")).alias("agreement"),
        F.avg(F.abs(F.col("level") - F.col("y"))).alias("mean_error"),
        F.corr("level", "y").alias("correlation"),
    )


QUERIES |= {"p9_found": p9_found, "p9_levels": p9_levels, "p9_profile": p9_profile, "p9_fit": p9_fit, "p9_holdout": p9_holdout}


def p4_overlaps(spark: SparkSession, d: str) -> DataFrame:
    return overlap.cross_split_overlaps(_table(spark, d, "eval_molecules"), _table(spark, d, "train_molecules"), Workspace(spark, "p4"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_overlaps(spark, d).select("sample_id", "train_id")


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping evaluation rows per split and source (both trimmed, lower case, '' if missing): exact and near."""
    name = {c: F.lower(F.trim(F.coalesce(F.col(c), F.lit("")))) for c in ("split", "source")}
    rows = _table(spark, d, "eval_molecules").where("sample_id is not null").groupBy("sample_id").agg(*[F.min(v).alias(c) for c, v in name.items()])
    best = p4_overlaps(spark, d).groupBy("sample_id").agg(F.min("edits").alias("edits"), F.countDistinct("train_id").alias("links"))
    return (
        rows.join(best, "sample_id", "left")
        .groupBy("split", "source")
        .agg(F.count("*").alias("rows"), F.count_if(F.col("edits") == 0).alias("exact"), F.count_if(F.col("edits") > 0).alias("near"), F.coalesce(F.sum("links"), F.lit(0)).alias("links"))
    )


QUERIES |= {"p4_found": p4_found, "p4_overlaps": p4_overlaps, "p4_report": p4_report}
ORACLES["p4_found"] = r"""
    WITH e AS (SELECT DISTINCT sample_id, regexp_replace(smiles, '^\s+|\s+$', '', 'g') AS a FROM eval_molecules),
    t AS (SELECT DISTINCT train_id, regexp_replace(smiles, '^\s+|\s+$', '', 'g') AS b FROM train_molecules)
    SELECT DISTINCT sample_id, train_id FROM e JOIN t ON a <> '' AND b <> '' AND abs(length(a) - length(b)) * 10 <= greatest(length(a), length(b))
    WHERE levenshtein(a, b) * 10 <= greatest(length(a), length(b))"""
ORACLES["p4_report"] = r"""
    WITH e AS (SELECT DISTINCT sample_id, regexp_replace(smiles, '^\s+|\s+$', '', 'g') AS a FROM eval_molecules), t AS (SELECT DISTINCT train_id, regexp_replace(smiles, '^\s+|\s+$', '', 'g') AS b FROM train_molecules),
    p AS (SELECT sample_id, train_id, levenshtein(a, b) AS d FROM e JOIN t ON a <> '' AND b <> '' AND abs(length(a) - length(b)) * 10 <= greatest(length(a), length(b)) WHERE levenshtein(a, b) * 10 <= greatest(length(a), length(b))),
    m AS (SELECT sample_id, min(d) AS d, count(DISTINCT train_id) AS links FROM p GROUP BY sample_id),
    r AS (SELECT sample_id, min(lower(trim(coalesce(split, ''), ' '))) AS split, min(lower(trim(coalesce(source, ''), ' '))) AS source FROM eval_molecules WHERE sample_id IS NOT NULL GROUP BY sample_id)
    SELECT split, source, count(*) AS rows, count(*) FILTER (d = 0) AS exact, count(*) FILTER (d > 0) AS near, coalesce(sum(links), 0)::BIGINT AS links FROM r LEFT JOIN m USING (sample_id) GROUP BY split, source"""
