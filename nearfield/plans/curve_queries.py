"""Queries of metrics and spectral performance curves over the molecule tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.functions import metrics as M
from nearfield.operators import curve as C
from nearfield.operators import edges as E
from nearfield.plans.tables import table
from nearfield.schema import finite

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def scored(spark: SparkSession, d: str) -> DataFrame:
    """Evaluation rows with a finite truth and prediction, once each."""
    return table(spark, d, "eval_molecules").select("sample_id", "y_true", "y_pred", "source", F.lower(F.coalesce("split", F.lit(""))).alias("split")).where(finite("y_true") & finite("y_pred")).distinct()


def valid_edges(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "pairwise_similarity").select("sample_id", "train_id", "similarity", "method")
    return e.where(finite("similarity") & F.col("similarity").between(0, 1) & (F.col("sample_id") != F.col("train_id")))


_SCORED = "SELECT DISTINCT sample_id, y_true, y_pred, source, lower(coalesce(split, '')) AS split FROM eval_molecules WHERE isfinite(y_true) AND isfinite(y_pred)"
_VALID = "SELECT sample_id, train_id, similarity, method FROM pairwise_similarity WHERE isfinite(similarity) AND similarity BETWEEN 0 AND 1 AND sample_id <> train_id"
_METRIC_COLUMNS = ["n", "mae", "rmse", "r2", "bias_mean_pred_minus_true", "median_abs_error", "p90_abs_error", "p95_abs_error", "max_abs_error"]
_METRICS = """count(*) AS n, round(avg(abs(y_true - y_pred)), 6) AS mae, round(sqrt(avg(pow(y_true - y_pred, 2))), 6) AS rmse,
    round(CASE WHEN count(*) >= 2 AND var_pop(y_true) > 0 THEN 1 - sum(pow(y_true - y_pred, 2)) / (var_pop(y_true) * count(*)) END, 6) AS r2, round(avg(y_pred - y_true), 6) AS bias_mean_pred_minus_true,
    round(quantile_cont(abs(y_true - y_pred), 0.5), 6) AS median_abs_error, round(quantile_cont(abs(y_true - y_pred), 0.9), 6) AS p90_abs_error,
    round(quantile_cont(abs(y_true - y_pred), 0.95), 6) AS p95_abs_error, round(max(abs(y_true - y_pred)), 6) AS max_abs_error"""


def rounded(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if kind == "double" and c not in keep else F.col(c) for c, kind in df.dtypes])


QUERIES["regression_metrics"] = lambda s, d: rounded(scored(s, d).groupBy("split").agg(*M.regression_aggregates()))
ORACLES["regression_metrics"] = f"SELECT split, {_METRICS} FROM ({_SCORED}) GROUP BY split"

QUERIES["error_columns"] = lambda s, d: rounded(M.error_columns(scored(s, d)).select("sample_id", "y_true", "y_pred", "abs_error", "squared_error"))
ORACLES["error_columns"] = f"SELECT sample_id, round(y_true, 6) AS y_true, round(y_pred, 6) AS y_pred, round(abs(y_true - y_pred), 6) AS abs_error, round(pow(y_true - y_pred, 2), 6) AS squared_error FROM ({_SCORED})"

QUERIES["target_support"] = lambda s, d: rounded(M.target_support(scored(s, d), table(s, d, "train_molecules").where(finite("y"))))
ORACLES["target_support"] = f"""WITH t AS (SELECT min(y) AS train_min, max(y) AS train_max FROM train_molecules WHERE isfinite(y))
    SELECT round(train_min, 6) AS train_min, round(train_max, 6) AS train_max, round(min(y_true), 6) AS eval_min, round(max(y_true), 6) AS eval_max,
    count(*) FILTER (y_true < train_min OR y_true > train_max) AS true_outside, count(*) FILTER (y_pred < train_min OR y_pred > train_max) AS pred_outside FROM ({_SCORED}), t GROUP BY train_min, train_max"""

QUERIES["robust_scale"] = lambda s, d: rounded(valid_edges(s, d).groupBy("method").agg(M.robust_scale("similarity").alias("scale"), F.count("*").alias("n")))
ORACLES["robust_scale"] = f"""SELECT method, round(greatest(1e-12, CASE WHEN quantile_cont(similarity, 0.75) > quantile_cont(similarity, 0.25) THEN quantile_cont(similarity, 0.75) - quantile_cont(similarity, 0.25)
    WHEN stddev_pop(similarity) > 0 THEN stddev_pop(similarity) ELSE 1 END), 6) AS scale, count(*) AS n FROM ({_VALID}) GROUP BY method"""

QUERIES["graph_counts"] = lambda s, d: valid_edges(s, d).groupBy("method").agg(F.countDistinct("sample_id").alias("samples"), F.countDistinct("train_id").alias("trains"), F.count("*").alias("edges"))
ORACLES["graph_counts"] = f"SELECT method, count(DISTINCT sample_id) AS samples, count(DISTINCT train_id) AS trains, count(*) AS edges FROM ({_VALID}) GROUP BY method"

QUERIES["max_similarity"] = lambda s, d: E.max_similarity(valid_edges(s, d))
ORACLES["max_similarity"] = f"SELECT sample_id, max(similarity) AS axis FROM ({_VALID}) GROUP BY sample_id"

QUERIES["attach_axis"] = lambda s, d: E.attach_axis(scored(s, d), valid_edges(s, d), strict=False).select("sample_id", "axis")
ORACLES["attach_axis"] = f"SELECT sample_id, axis FROM ({_SCORED}) LEFT JOIN ({ORACLES['max_similarity']}) USING (sample_id)"

_CURVE = ["subset", "threshold", "spectral_parameter", "train_size", "test_size", "mean_axis_value", "median_axis_value", "mean_novelty", "cross_split_overlap", *_METRIC_COLUMNS]


def _fixed(spark: SparkSession, d: str) -> DataFrame:
    return C.pairwise_curve(scored(spark, d), valid_edges(spark, d), (0.9, 0.7, 0.5, 0.4, 0.3), strict=False)


QUERIES["pairwise_curve"] = lambda s, d: rounded(_fixed(s, d))
_AXIS = f"SELECT y_true, y_pred, axis AS a, 1 - axis AS novelty FROM ({_SCORED}) JOIN ({ORACLES['max_similarity']}) USING (sample_id)"


def _curve_sql(rows: str, thresholds: str, kind: str) -> str:
    test, prefix, sign = ("a <= t", "similarity_le_", "") if kind == "similarity" else ("a >= t", "distance_ge_", "-")
    return f"""
    WITH r AS ({rows}), t AS (SELECT t, '{prefix}' || replace(CAST(t AS VARCHAR), '.', '_') AS subset FROM ({thresholds})),
    m AS (SELECT 'all_eval' AS subset, CAST(NULL AS DOUBLE) AS threshold, * FROM r UNION ALL SELECT subset, t, r.* FROM t JOIN r ON {test}),
    c AS (SELECT subset, threshold, round(avg(novelty), 6) AS spectral_parameter, 0::BIGINT AS train_size, count(*) AS test_size, round(avg(a), 6) AS mean_axis_value, round(quantile_cont(a, 0.5), 6) AS median_axis_value,
        round(avg(novelty), 6) AS mean_novelty, round({sign}avg(a), 6) AS cross_split_overlap, {_METRICS} FROM m GROUP BY subset, threshold)
    SELECT * FROM c WHERE subset = 'all_eval' OR test_size < (SELECT count(*) FROM r)"""


_FIXED = "SELECT CAST(unnest([0.9, 0.7, 0.5, 0.4, 0.3]) AS DOUBLE) AS t"
ORACLES["pairwise_curve"] = _curve_sql(_AXIS, _FIXED, "similarity")


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_extendedprice").alias("y_true"), (F.col("l_quantity") * 1500).alias("y_pred"), F.col("l_discount").alias("axis"))


QUERIES["axis_curve_distance"] = lambda s, d: rounded(C.axis_curve(_lines(s, d), "axis", "novelty", (0.02, 0.05, 0.08)))
ORACLES["axis_curve_distance"] = _curve_sql("SELECT l_extendedprice AS y_true, l_quantity * 1500 AS y_pred, l_discount AS a, l_discount AS novelty FROM lineitem", "SELECT CAST(unnest([0.02, 0.05, 0.08]) AS DOUBLE) AS t", "distance")


def quantile_thresholds(spark: SparkSession, d: str) -> DataFrame:
    values = C.quantile_thresholds(E.max_similarity(valid_edges(spark, d)), "axis", "similarity", 5)
    return spark.createDataFrame([(i, round(v, 6)) for i, v in enumerate(values)], "place int, threshold double")


QUERIES["quantile_thresholds"] = quantile_thresholds
ORACLES["quantile_thresholds"] = f"SELECT CAST(row_number() OVER (ORDER BY t DESC) - 1 AS INT) AS place, round(t, 6) AS threshold FROM (SELECT DISTINCT unnest(quantile_cont(axis, [0, 0.25, 0.5, 0.75, 1])) AS t FROM ({ORACLES['max_similarity']}))"

QUERIES["similarity_bands"] = lambda s, d: rounded(C.similarity_bands(scored(s, d), valid_edges(s, d)))
ORACLES["similarity_bands"] = f"""
    WITH r AS (SELECT y_true, y_pred, coalesce(axis, 0) AS a FROM ({_SCORED}) LEFT JOIN ({ORACLES['max_similarity']}) USING (sample_id)),
    t AS (SELECT CAST(unnest([0.8, 0.7, 0.6, 0.5]) AS DOUBLE) AS t),
    m AS (SELECT 'all_eval' AS subset, CAST(NULL AS DOUBLE) AS threshold, * FROM r UNION ALL SELECT 'max_similarity_le_' || replace(CAST(t AS VARCHAR), '.', '_'), t, r.* FROM t JOIN r ON a <= t)
    SELECT subset, threshold, round(coalesce(1 - threshold, 0), 6) AS spectral_parameter, test_size, mean_novelty, cross_split_overlap, mae, rmse, r2 FROM
    (SELECT subset, threshold, count(*) AS test_size, round(1 - avg(a), 6) AS mean_novelty, round(avg(a), 6) AS cross_split_overlap, {_METRICS} FROM m GROUP BY ALL)"""

_CTE = f"WITH c AS ({ORACLES['pairwise_curve']})"
QUERIES["overlap_contract"] = lambda s, d: rounded(C.validate_overlap(_fixed(s, d)))
ORACLES["overlap_contract"] = f"""{_CTE}, s AS (SELECT cross_split_overlap - lag(cross_split_overlap) OVER (ORDER BY spectral_parameter, subset) AS d FROM c),
    v AS (SELECT count(*) AS row_count, count(*) FILTER (d > 1e-12) AS increases, round(count(*) FILTER (d <= 1e-12) / count(d), 6) AS decreasing_fraction FROM s)
    SELECT increases = 0 AS valid, CASE WHEN increases = 0 THEN 'valid' ELSE 'overlap_contract_failed' END AS status, decreasing_fraction, row_count, increases FROM v"""
QUERIES["novelty_contract"] = lambda s, d: rounded(C.validate_novelty(_fixed(s, d)))
ORACLES["novelty_contract"] = f"""{_CTE}, s AS (SELECT mean_novelty - lag(mean_novelty) OVER (ORDER BY coalesce(-threshold, -1e300), subset) AS d FROM c),
    v AS (SELECT count(*) AS row_count, count(*) FILTER (d < -1e-12) AS decreases, round(count(*) FILTER (d >= -1e-12) / count(d), 6) AS increasing_fraction FROM s)
    SELECT decreases = 0 AS valid, CASE WHEN decreases = 0 THEN 'valid' ELSE 'novelty_contract_failed' END AS status, increasing_fraction, row_count, decreases FROM v"""


def _area_sql(x: str, y: str, order: str) -> str:
    return f"""{_CTE}, p AS (SELECT {x} AS x, {y} AS y, subset FROM c), n AS (SELECT (x - min(x) OVER ()) / (max(x) OVER () - min(x) OVER ()) AS x, y, subset FROM p), i AS (SELECT {order} AS x, y, subset FROM n),
    a AS (SELECT (x - lag(x) OVER w) * (y + lag(y) OVER w) / 2 AS a FROM i WINDOW w AS (ORDER BY x, subset)) SELECT true AS computed, round(sum(a), 4) AS value, count(*) AS point_count FROM a"""


QUERIES["auspc"] = lambda s, d: C.area(_fixed(s, d)).withColumn("value", F.round("value", 4))
ORACLES["auspc"] = _area_sql("mean_novelty", "-rmse", "x")
QUERIES["auspc_overlap"] = lambda s, d: C.area(_fixed(s, d), "cross_split_overlap", "mae", invert_x=True).withColumn("value", F.round("value", 4))
ORACLES["auspc_overlap"] = _area_sql("cross_split_overlap", "-mae", "1 - x")


def _axes(spark: SparkSession, d: str) -> DataFrame:
    """One curve per similarity method: each method is an axis."""
    out = None
    rows, edges = scored(spark, d), valid_edges(spark, d)
    for m in ("morgan_tanimoto", "embedding_cosine", "sequence_identity", "set_jaccard"):
        c = C.pairwise_curve(rows, edges.where(F.col("method") == m), (0.4, 0.3, 0.2, 0.1), strict=False).withColumn("axis", F.lit(m))
        out = c if out is None else out.unionByName(c)
    return out.withColumn("leakage_risk", F.when(F.col("axis") == "set_jaccard", "post_hoc_uses_eval_labels").otherwise("none"))


QUERIES["hypothesis_scores"] = lambda s, d: C.score_hypotheses(_axes(s, d)).select("axis", "status", F.round("r", 5).alias("r"), F.round("slope", 5).alias("slope"), F.round("last_delta", 6).alias("last_delta"), F.round("max_delta", 6).alias("max_delta"), "prospective_valid")
ORACLES["hypothesis_scores"] = f"""
    WITH r AS (SELECT m.method AS axis, y_true, y_pred, a FROM ({_SCORED}) JOIN (SELECT sample_id, method, max(similarity) AS a FROM ({_VALID}) GROUP BY ALL) m USING (sample_id)
               WHERE method IN ('morgan_tanimoto', 'embedding_cosine', 'sequence_identity', 'set_jaccard')),
    t AS (SELECT CAST(unnest([0.4, 0.3, 0.2, 0.1]) AS DOUBLE) AS t), n AS (SELECT axis, count(*) AS n FROM r GROUP BY axis),
    m AS (SELECT 'all_eval' AS subset, r.* FROM r UNION ALL SELECT 'similarity_le_' || t, r.* FROM t JOIN r ON a <= t),
    c AS (SELECT axis, subset, count(*) AS k, avg(1 - a) AS x, sqrt(avg(pow(y_true - y_pred, 2))) AS y FROM m GROUP BY ALL),
    g AS (SELECT c.* FROM c JOIN n USING (axis) WHERE k >= 10 AND (subset = 'all_eval' OR k < n)),
    s AS (SELECT axis, count(*) AS points, CASE WHEN count(*) >= 2 AND stddev_pop(x) > 0 AND stddev_pop(y) > 0 THEN corr(x, y) END AS r, CASE WHEN count(*) >= 2 AND stddev_pop(x) > 0 THEN regr_slope(y, x) END AS slope,
          arg_min(y, x) AS f, arg_max(y, x) - arg_min(y, x) AS l, max(y) - arg_min(y, x) AS h FROM g GROUP BY axis)
    SELECT axis, CASE WHEN points < 2 THEN 'not_evaluable' WHEN r >= 0.5 AND l > greatest(1e-12, abs(f) * 0.02) THEN 'monotonic_supported' WHEN h > greatest(1e-12, abs(f) * 0.02) THEN 'localized_supported'
        WHEN r > 0.25 THEN 'weak_supported' ELSE 'not_explanatory' END AS status, round(r, 5) AS r, round(slope, 5) AS slope, round(l, 6) AS last_delta, round(h, 6) AS max_delta, axis <> 'set_jaccard' AS prospective_valid FROM s"""
QUERIES["best_axis"] = lambda s, d: C.best_axis(C.score_hypotheses(_axes(s, d))).select("axis", "status", "prospective_valid")
QUERIES["next_actions"] = lambda s, d: C.next_actions(C.score_hypotheses(_axes(s, d)))
QUERIES["curve_review"] = lambda s, d: rounded(C.review(_fixed(s, d), "rmse", False)).withColumn("r", F.round("r", 3))
ORACLES["curve_review"] = f"""{_CTE} SELECT round(corr(cross_split_overlap, rmse), 3) AS r, arg_max(rmse, cross_split_overlap) AS easiest, arg_min(rmse, cross_split_overlap) AS hardest,
    round(-(arg_max(rmse, cross_split_overlap) - arg_min(rmse, cross_split_overlap)), 6) AS degradation FROM c"""
QUERIES["split_stats_contract"] = lambda s, d: rounded(C.split_stats_contract(_fixed(s, d).select("spectral_parameter", F.lit(4000).alias("n_train"), "test_size", "cross_split_overlap")))


def binary_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Whether a prediction finds the targets above 2, per source."""
    rows = scored(spark, d).select("source", (F.col("y_true") > 2).cast("int").alias("label"), (1 / (1 + F.exp(2 - F.round("y_pred", 1)))).alias("score"))
    return rounded(M.classification(rows.where("source is not null"), "label", "score", 0.5, ["source"]))


QUERIES["binary_metrics"] = binary_metrics
ORACLES["binary_metrics"] = f"""
    WITH r AS (SELECT source, CAST(y_true > 2 AS INT) AS y, 1 / (1 + exp(2 - round(y_pred, 1))) AS s FROM ({_SCORED}) WHERE source IS NOT NULL),
    p AS (SELECT source, s, sum(y) AS pos, count(*) - sum(y) AS neg FROM r GROUP BY ALL),
    w AS (SELECT *, sum(pos) OVER o AS tp, sum(neg) OVER o AS fp FROM p WINDOW o AS (PARTITION BY source ORDER BY s DESC)),
    a AS (SELECT source, sum(pos) AS np, sum(neg) AS nn, sum(pos * (fp - neg / 2)) AS behind, sum(pos * tp / (tp + fp)) AS ap FROM w GROUP BY source),
    t AS (SELECT source, count(*) AS n, CAST(count(*) FILTER (y = 1 AND s >= 0.5) AS DOUBLE) AS tp, CAST(count(*) FILTER (y = 0 AND s >= 0.5) AS DOUBLE) AS fp, CAST(count(*) FILTER (y = 1 AND s < 0.5) AS DOUBLE) AS fn,
        CAST(count(*) FILTER (y = 0 AND s < 0.5) AS DOUBLE) AS tn, avg(pow(y - s, 2)) AS brier FROM r GROUP BY source)
    SELECT source, n, CAST(np AS BIGINT) AS positives, round(CASE WHEN np > 0 AND nn > 0 THEN 1 - behind / (np * nn) END, 6) AS roc_auc, round(CASE WHEN np > 0 THEN ap / np END, 6) AS average_precision,
    round(CASE WHEN np > 0 AND nn > 0 THEN (tp / np + tn / nn) / 2 END, 6) AS balanced_accuracy, round((tp + tn) / n, 6) AS accuracy, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1,
    round(CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) > 0 THEN (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) ELSE 0 END, 6) AS mcc, round(brier, 6) AS brier FROM a JOIN t USING (source)"""
