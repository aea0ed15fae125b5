"""Queries of catalogs, models, composed pipelines and batch forms of the streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.functions import kernels as K
from nearfield.functions import metrics as M
from nearfield.operators import advanced as A
from nearfield.operators import assays as AS
from nearfield.operators import baselines as B
from nearfield.operators import candidates as C
from nearfield.operators import curve, nested, registry
from nearfield.operators import edges as E
from nearfield.operators import splits as S
from nearfield.plans import datasets as D
from nearfield.plans import strategies
from nearfield.plans.curve_queries import rounded, valid_edges
from nearfield.plans.kernel_queries import _EMBED, _embeddings
from nearfield.plans.tables import table
from nearfield.schema import finite
from nearfield.storage import Workspace
from nearfield.streaming import streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# ---- advanced kernels -------------------------------------------------------------------------------------


def mahalanobis(spark: SparkSession, d: str) -> DataFrame:
    rows = _embeddings(spark, d).select("id", F.slice("v", 1, 2).alias("v"))
    return rounded(A.mahalanobis_pairs(rows.where("id % 50 = 0"), rows, "v", 2))


QUERIES["kernel_mahalanobis"] = mahalanobis
ORACLES["kernel_mahalanobis"] = f"""WITH t AS ({_EMBED}), c AS (SELECT covar_samp(v[1], v[1]) + 1e-6 AS p, covar_samp(v[1], v[2]) AS q, covar_samp(v[2], v[2]) + 1e-6 AS r FROM t),
    s AS (SELECT a.id AS sample_id, b.id AS train_id, a.v[1] - b.v[1] AS x, a.v[2] - b.v[2] AS y FROM t a JOIN t b ON a.id % 50 = 0 AND a.id <> b.id)
    SELECT sample_id, train_id, round(exp(-sqrt((r * x * x - 2 * q * x * y + p * y * y) / (p * r - q * q))), 6) AS similarity FROM s, c"""


def mahalanobis_full(spark: SparkSession, d: str) -> DataFrame:
    """All 64 parts of the embeddings (K15); SQL states the first two only, so a test holds this against numpy."""
    rows = _embeddings(spark, d).select("id", "v")
    return rounded(A.mahalanobis_pairs(rows.where("id % 50 = 0"), rows, "v", 64))


QUERIES["kernel_mahalanobis_full"] = mahalanobis_full
QUERIES["kernel_domain_mmd"] = lambda s, d: rounded(A.domain_mmd(_embeddings(s, d), "label", "v", 0.01, 0.1))
ORACLES["kernel_domain_mmd"] = f"""WITH t AS ({_EMBED}), k AS (SELECT a.label AS a, b.label AS b, avg(exp(-0.01 * pow(list_distance(a.v, b.v), 2))) AS k FROM t a, t b GROUP BY ALL)
    SELECT k.a, k.b, round(exp(-greatest(0, x.k + y.k - 2 * k.k) / 0.1), 6) AS similarity FROM k JOIN k x ON x.a = k.a AND x.b = k.a JOIN k y ON y.a = k.b AND y.b = k.b"""
QUERIES["dtw_pruned"] = lambda s, d: rounded(A.dtw_pruned(D.user_sequences(s, d).where("id % 50 = 0"), D.user_sequences(s, d), "series", 0.9, 100.0, 10))


def seed_rerank(spark: SparkSession, d: str) -> DataFrame:
    """Scaffolds of the evaluation rows with those of training that share twelve 4-mers, by edit similarity."""
    e = table(spark, d, "eval_molecules").where("murcko_scaffold is not null").select(F.col("murcko_scaffold").alias("s")).distinct().select(F.col("s").alias("id"), "s")
    t = table(spark, d, "train_molecules").where("murcko_scaffold is not null").select(F.col("murcko_scaffold").alias("s")).distinct().select(F.col("s").alias("id"), "s")
    seeds = A.seed_candidates(e, t, "s", 4, 12).drop("seeds")
    return E.top_k(C.verify(seeds, e, t, "s", K.edit_similarity), 3, 9).withColumn("similarity", F.round("similarity", 6))


QUERIES["seed_rerank"] = seed_rerank
ORACLES["seed_rerank"] = """
    WITH e AS (SELECT DISTINCT murcko_scaffold AS s FROM eval_molecules WHERE s IS NOT NULL), t AS (SELECT DISTINCT murcko_scaffold AS s FROM train_molecules WHERE s IS NOT NULL),
    g AS (SELECT s, list_distinct([s[i:i + 3] FOR i IN range(1, length(s) - 2)]) AS g FROM (SELECT s FROM e UNION SELECT s FROM t) WHERE length(s) >= 4),
    p AS (SELECT e.s AS sample_id, t.s AS train_id, round(greatest(0, 1 - levenshtein(e.s, t.s) / greatest(length(e.s), length(t.s))), 9) AS s FROM e JOIN t ON e.s <> t.s JOIN g x ON x.s = e.s JOIN g y ON y.s = t.s
          WHERE len(list_intersect(x.g, y.g)) >= 12)
    SELECT sample_id, train_id, round(s, 6) AS similarity, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY s DESC, train_id) AS r FROM p) WHERE r <= 3"""


def matrix_profile(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.matrix_profile(D.user_sequences(spark, d), "series", 8)).groupBy("id").agg(F.count("*").alias("windows"), F.round(F.min("distance"), 3).alias("motif"), F.round(F.max("distance"), 3).alias("discord"))


QUERIES["matrix_profile"] = matrix_profile
ORACLES["matrix_profile"] = """
    WITH s AS (SELECT user_id AS id, list(value ORDER BY ts, event_id, event_type, value) AS v FROM events GROUP BY user_id), i AS (SELECT id, v, unnest(range(1, len(v) - 6)) AS start FROM s WHERE len(v) >= 8), w AS (SELECT id, start, v[start:start + 7] AS w FROM i),
    m AS (SELECT *, list_sum(w) / 8 AS mu, list_sum(list_transform(w, lambda x: x * x)) / 8 AS q FROM w), d AS (SELECT *, sqrt(greatest(0, q - mu * mu)) AS sd FROM m),
    z AS (SELECT id, start, list_transform(w, lambda x: CASE WHEN sd > 1e-12 THEN (x - mu) / sd ELSE 0 END) AS z FROM d),
    p AS (SELECT a.id, a.start, round(min(list_distance(a.z, b.z)), 6) AS d FROM z a JOIN z b ON a.id = b.id AND abs(a.start - b.start) > 4 GROUP BY ALL)
    SELECT id, count(*) AS windows, round(min(d), 3) AS motif, round(max(d), 3) AS discord FROM p GROUP BY id"""


def _daily(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.dayofweek("ts").cast("string").alias("cell_type"), F.col("event_type").alias("condition"), F.hour("ts").alias("gene"), "value")


QUERIES["profile_responses"] = lambda s, d: rounded(A.responses(A.profiles(_daily(s, d)), "view"))
ORACLES["profile_responses"] = """WITH p AS (SELECT CAST(dayofweek(ts) + 1 AS VARCHAR) AS cell_type, event_type AS condition, CAST(hour(ts) AS INT) AS gene, avg(value) AS m FROM events GROUP BY ALL)
    SELECT a.cell_type, a.condition, a.gene, round(a.m - b.m, 6) AS response FROM p a JOIN p b USING (cell_type, gene) WHERE a.condition <> 'view' AND b.condition = 'view'"""


def _combined(spark: SparkSession, d: str) -> DataFrame:
    """What is measured on days on which a user has two types of events, as combinations ``A+B`` of them."""
    e = table(spark, d, "events").select("user_id", F.to_date("ts").alias("day"), F.dayofweek("ts").cast("string").alias("cell_type"), F.hour("ts").alias("gene"), "event_type", "value")
    days = e.select("user_id", "day", "event_type").distinct()
    left = days.where("event_type in ('click', 'error')").withColumnRenamed("event_type", "l")
    right = days.where("event_type in ('purchase', 'signup')").withColumnRenamed("event_type", "r")
    both = e.join(left.join(right, ["user_id", "day"]), ["user_id", "day"]).where((F.col("event_type") == F.col("l")) | (F.col("event_type") == F.col("r")))
    return both.select("cell_type", F.concat_ws("+", "l", "r").alias("condition"), "gene", "value")


def perturbation_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of event types as combinations: the additive prediction from the single types against what is measured, by support."""
    single = A.profiles(_daily(spark, d))
    known = A.responses(single, "view").where("condition <> 'signup'")
    control = single.where("condition = 'view'")
    observed = A.responses(A.profiles(_combined(spark, d)).unionByName(control), "view")
    return rounded(A.support_summary(A.profile_rmse(A.additive_prediction(observed, known), observed), A.component_support(observed, known)))


QUERIES["perturbation_pipeline"] = perturbation_pipeline
ORACLES["perturbation_pipeline"] = """
    WITH s AS (SELECT CAST(dayofweek(ts) + 1 AS VARCHAR) AS cell_type, event_type AS condition, CAST(hour(ts) AS INT) AS gene, avg(value) AS m FROM events GROUP BY ALL), c AS (SELECT cell_type, gene, m FROM s WHERE condition = 'view'),
    k AS (SELECT s.cell_type, s.condition, s.gene, s.m - c.m AS response FROM s JOIN c USING (cell_type, gene) WHERE s.condition NOT IN ('view', 'signup')),
    d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day, event_type FROM events),
    p AS (SELECT a.user_id, a.day, a.event_type AS l, b.event_type AS r FROM d a JOIN d b USING (user_id, day) WHERE a.event_type IN ('click', 'error') AND b.event_type IN ('purchase', 'signup')),
    o AS (SELECT CAST(dayofweek(ts) + 1 AS VARCHAR) AS cell_type, l || '+' || r AS condition, CAST(hour(ts) AS INT) AS gene, avg(value) AS m FROM events e JOIN p ON p.user_id = e.user_id AND p.day = CAST(ts AS DATE) WHERE event_type IN (l, r) GROUP BY ALL),
    b AS (SELECT o.cell_type, o.condition, o.gene, o.m - c.m AS response FROM o JOIN c USING (cell_type, gene)), q AS (SELECT DISTINCT cell_type, condition, unnest(string_split(condition, '+')) AS part FROM b),
    t AS (SELECT q.cell_type, q.condition, k.gene, sum(k.response) AS predicted FROM q JOIN k ON k.cell_type = q.cell_type AND k.condition = q.part GROUP BY ALL),
    e AS (SELECT cell_type, condition, sqrt(avg(pow(response - coalesce(predicted, 0), 2))) AS rmse FROM b LEFT JOIN t USING (cell_type, condition, gene) GROUP BY ALL),
    u AS (SELECT condition, avg(CAST(part IN (SELECT condition FROM k) AS DOUBLE)) AS support FROM (SELECT DISTINCT condition, part FROM q) GROUP BY condition)
    SELECT support, count(*) AS n, round(avg(rmse), 6) AS mean_rmse, round(quantile_cont(rmse, 0.5), 6) AS median_rmse, round(max(rmse), 6) AS max_rmse FROM e JOIN u USING (condition) GROUP BY support"""

# ---- models -----------------------------------------------------------------------------------------------


def _sides(rows: DataFrame, id_col: str, **more) -> tuple[DataFrame, DataFrame]:
    split = S.random_split(rows, id_col, **more).select(F.col("sample_id").alias(id_col), "split")
    joined = rows.join(split, id_col)
    return joined.where("split = 'train'").drop("split"), joined.where("split = 'test'").drop("split")


def logistic_baseline(spark: SparkSession, d: str) -> DataFrame:
    train, test = _sides(_embeddings(spark, d).withColumn("y", (F.col("label") >= 5).cast("int")), "id", numeric=True)
    scored = B.balanced_logistic(train, test, "v", "y")
    return rounded(M.classification(scored, "y", "score"))


def forest_baseline(spark: SparkSession, d: str) -> DataFrame:
    train, test = _sides(_embeddings(spark, d).withColumn("y", F.col("v")[0] + 2 * F.col("v")[1]), "id", numeric=True)
    return rounded(B.forest(train, test, "v", "y", 20).agg(*M.regression_aggregates("y", "y_pred")))


def ridge_curve(spark: SparkSession, d: str) -> DataFrame:
    """Ridge on the character n-grams of molecules, fitted on training rows, scored along similarity (B1, B2)."""
    grams = lambda df, y: df.where(finite(y) & F.col("smiles").rlike(r"\S")).withColumn("g", K.char_ngrams(F.trim("smiles"), (2, 3)))
    train = grams(table(spark, d, "train_molecules"), "y").select("g", "y")
    test = grams(table(spark, d, "eval_molecules"), "y_true").select("sample_id", "y_true", "g").dropDuplicates(["sample_id"])
    predicted = B.ridge_on_tokens(train, test, "g", "y", 10.0)
    return curve.pairwise_curve(predicted, valid_edges(spark, d), (0.7, 0.5, 0.4, 0.3), strict=False).select("subset", "threshold", "test_size", "mean_novelty", "rmse", "mae")


QUERIES |= {"logistic_baseline": logistic_baseline, "forest_baseline": forest_baseline, "ridge_curve": ridge_curve}


def blind_bundle(spark: SparkSession, d: str) -> DataFrame:
    return A.blind_bundle(table(spark, d, "eval_molecules").select("sample_id", "smiles", "y_pred", "y_true").distinct(), ["smiles", "y_pred"], ["y_true"])[0]


QUERIES["blind_bundle"] = blind_bundle
ORACLES["blind_bundle"] = "SELECT sample_id, smiles, CASE WHEN isfinite(y_pred) THEN y_pred END AS y_pred FROM (SELECT DISTINCT sample_id, smiles, y_pred, y_true FROM eval_molecules)"

# ---- catalogs ---------------------------------------------------------------------------------------------

QUERIES["catalog_counts"] = lambda s, d: strategies.entries(s).groupBy("catalog").agg(F.count("*").alias("n"), F.count_if(F.col("operator") != "-").alias("executable"))
QUERIES["catalog_search"] = lambda s, d: registry.search(strategies.entries(s).where("catalog = 'definition'"), "protein sequence alignment similarity", inputs=["sequence"], k=8).select("id", "score", "operator", F.concat_ws(" ", "missing_inputs").alias("missing_inputs"))
QUERIES["strategy_search"] = lambda s, d: registry.search_strategies(strategies.entries(s), "million scale set similarity minhash", "hashing_sketch_lsh", large=True).select("id", "score", "operator")
QUERIES["catalog_validation"] = lambda s, d: registry.validate(strategies.entries(s), ["id", "kind", "operator", "text"]).withColumn("errors", F.concat_ws("; ", "errors"))


def provenance_contract(spark: SparkSession, d: str) -> DataFrame:
    t = nested.flatten(table(spark, d, "provenance_deliveries"), Workspace(spark, "contract"))
    return registry.provenance_contract(t)


QUERIES["provenance_contract"] = lambda s, d: provenance_contract(s, d).drop("pk").groupBy("delivery_id", "finding_id", "has_id", "has_status", "has_checkpoint", "has_dataset", "complete").agg(F.count("*").alias("findings"))
QUERIES["status_crosstab"] = lambda s, d: rounded(
    registry.crosstab_status(table(s, d, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"], "F")
)
ORACLES["status_crosstab"] = """SELECT o_orderpriority, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P,
    round(count(*) FILTER (o_orderstatus = 'F') / count(*), 6) AS support_fraction FROM orders GROUP BY o_orderpriority"""

# ---- streams, run as batches over the whole table (a test holds them against the streaming run) -----------


def stream_window_metrics(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("ts", "value", F.lit(50.0).alias("guess"), F.get_json_object("props", "$.k").cast("double").alias("k"))
    return rounded(streams.window_metrics(e, "ts", "value", "guess", "k", 25.0).withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd")).withColumn("window_end", F.date_format("window_end", "yyyy-MM-dd")))


QUERIES["stream_window_metrics"] = stream_window_metrics
ORACLES["stream_window_metrics"] = """
    WITH e AS (SELECT ts, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events), w AS (SELECT CAST(date_trunc('day', ts) - to_days(CAST(i AS INT)) AS TIMESTAMP) AS s, value, k FROM e, range(7) t(i))
    SELECT strftime(s, '%Y-%m-%d') AS window_start, strftime(s + INTERVAL 7 DAY, '%Y-%m-%d') AS window_end, CAST(floor(k / 25) AS BIGINT) AS bucket, count(*) AS n, round(avg(abs(value - 50)), 6) AS mae,
    round(sqrt(avg(pow(value - 50, 2))), 6) AS rmse FROM w GROUP BY ALL"""
QUERIES["stream_tumbling_counts"] = lambda s, d: streams.tumbling_counts(table(s, d, "events"), "ts", ["event_type"]).withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd"))
ORACLES["stream_tumbling_counts"] = "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL"
QUERIES["stream_sessions"] = lambda s, d: streams.sessions(table(s, d, "events"), "ts", "user_id", "6 hours").withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("session_start", "session_end")})
ORACLES["stream_sessions"] = """
    WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS first FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    n AS (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, strftime(max(ts) + INTERVAL 6 HOUR, '%Y-%m-%d %H:%M:%S') AS session_end, count(*) AS n FROM n GROUP BY user_id, k"""
QUERIES["stream_running_maximum"] = lambda s, d: streams.running_maximum(valid_edges(s, d), "sample_id", "similarity")
ORACLES["stream_running_maximum"] = "SELECT sample_id, max(similarity) AS highest FROM pairwise_similarity WHERE isfinite(similarity) AND similarity BETWEEN 0 AND 1 AND sample_id <> train_id GROUP BY sample_id"
QUERIES["stream_deduplicated"] = lambda s, d: streams.deduplicated(table(s, d, "train_molecules"), "registered_at", ["train_id"]).select("train_id")
ORACLES["stream_deduplicated"] = "SELECT DISTINCT train_id FROM train_molecules"


def stream_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Mixtures against the training pool of mixtures by shared components (T31), query rows against all."""
    from nearfield.functions import features

    rows = table(spark, d, "focused_molecules").groupBy(F.col("row_index").alias("id")).agg(F.min("smiles").alias("smiles")).select("id", features.token_set(F.col("smiles"), ".").alias("s"))
    return rounded(streams.stream_candidates(rows.where("id % 50 = 0"), rows, "s", K.jaccard, "s", 0.3))


QUERIES["stream_candidates"] = stream_candidates
ORACLES["stream_candidates"] = r"""
    WITH s AS (SELECT row_index AS id, list_distinct(list_filter(list_transform(string_split(coalesce(min(smiles), ''), '.'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')) AS s
               FROM focused_molecules GROUP BY row_index)
    SELECT a.id AS sample_id, b.id AS train_id, round(len(list_intersect(a.s, b.s)) / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))), 6) AS similarity FROM s a JOIN s b ON a.id % 50 = 0 AND a.id <> b.id
    WHERE len(list_intersect(a.s, b.s)) > 0 AND len(list_intersect(a.s, b.s)) / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))) >= 0.3"""

# ---- assays and focused splits ----------------------------------------------------------------------------


def nearest_composite(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"))
    return rounded(AS.nearest_composite(rows.where("id % 50 = 0"), rows, {"size": 5.0, "price": 50.0}))


QUERIES["nearest_composite"] = nearest_composite
ORACLES["nearest_composite"] = """WITH p AS (SELECT a.p_partkey AS sample_id, b.p_partkey AS train_id, round(exp(-(abs(a.p_size - b.p_size) / 5 + abs(a.p_retailprice - b.p_retailprice) / 50) / 2), 10) AS s
    FROM part a JOIN part b ON a.p_partkey % 50 = 0 AND a.p_partkey <> b.p_partkey)
    SELECT sample_id, train_id, round(s, 6) AS similarity FROM p QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY s DESC, train_id) = 1"""


def nearest_molecule(spark: SparkSession, d: str) -> DataFrame:
    number = "int(substring(sample_id, 4)) % 50 = 0"
    e = table(spark, d, "eval_molecules").where(number).groupBy(F.col("sample_id").alias("id")).agg(F.min("smiles").alias("smiles"))
    t = table(spark, d, "train_molecules").groupBy(F.col("train_id").alias("id")).agg(F.min("smiles").alias("smiles"))
    return rounded(AS.nearest_molecule(e, t, "smiles"))


QUERIES["nearest_molecule"] = nearest_molecule
_GRAMS = "list_distinct(flatten([CASE WHEN length(s) < n THEN [s] ELSE [s[i:i + n - 1] FOR i IN range(1, length(s) - n + 2)] END FOR n IN [2, 3, 4]]))"
ORACLES["nearest_molecule"] = f"""
    WITH e AS (SELECT sample_id AS id, trim(min(smiles), ' ') AS s FROM eval_molecules WHERE CAST(substring(sample_id, 4) AS INT) % 50 = 0 GROUP BY sample_id),
    t AS (SELECT train_id AS id, trim(min(smiles), ' ') AS s FROM train_molecules GROUP BY train_id), x AS (SELECT id, {_GRAMS} AS g FROM e WHERE s IS NOT NULL), y AS (SELECT id, {_GRAMS} AS g FROM t WHERE s IS NOT NULL),
    p AS (SELECT x.id AS sample_id, y.id AS train_id, round(len(list_intersect(x.g, y.g)) / (len(x.g) + len(y.g) - len(list_intersect(x.g, y.g))), 10) AS s FROM x, y),
    b AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY s DESC, train_id) = 1)
    SELECT e.id AS sample_id, train_id, round(coalesce(b.s, 0), 6) AS similarity FROM e LEFT JOIN b ON e.id = sample_id"""


def focused_splits(spark: SparkSession, d: str) -> DataFrame:
    """Mixtures of focused_molecules: threshold splits along component overlap, with the recommended one."""
    from nearfield.functions import features

    rows = table(spark, d, "focused_molecules").groupBy("sample_id").agg(F.min("smiles").alias("smiles"), F.max("y").alias("y"))
    sets = rows.select(F.col("sample_id").alias("id"), features.token_set(F.col("smiles"), ".").alias("items"))
    labels = rows.where("y is not null").select(F.col("sample_id").alias("id"), (F.col("y") > 0).cast("int").alias("label"))
    return rounded(AS.focused_splits(sets, labels, Workspace(spark, "focused"))[0])


QUERIES["focused_splits"] = focused_splits
