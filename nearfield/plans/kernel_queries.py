"""Queries of the kernels and exact joins.  Search queries take every row whose id is divisible by 50 against all rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.functions import kernels as K
from nearfield.functions import pandas_kernels as PK
from nearfield.operators import edges as E
from nearfield.plans import datasets as D
from nearfield.plans.tables import table
from nearfield.storage import Workspace

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _embeddings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), "label")


def _nations(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    k = F.col("n_nationkey")
    return n.select(
        k.cast("bigint").alias("id"),
        (F.pmod(k * 37, F.lit(180)) - 90).cast("double").alias("lat"),
        (F.pmod(k * 53, F.lit(360)) - 180).cast("double").alias("lon"),
        F.concat(F.lit("C"), (k % 7 + 1).cast("string"), F.lit("H"), (k % 5 + 2).cast("string"), F.when(k % 3 == 0, "O").otherwise("")).alias("formula"),
        F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.when((k + i) % 5 != 0, ((k * (i + 1)) % 3).cast("double"))).alias("g"),
        F.col("n_name").alias("name"),
        F.col("n_regionkey").alias("region"),
    )


_NATIONS = """SELECT CAST(n_nationkey AS BIGINT) AS id, CAST((n_nationkey * 37) % 180 - 90 AS DOUBLE) AS lat, CAST((n_nationkey * 53) % 360 - 180 AS DOUBLE) AS lon,
    'C' || (n_nationkey % 7 + 1) || 'H' || (n_nationkey % 5 + 2) || CASE WHEN n_nationkey % 3 = 0 THEN 'O' ELSE '' END AS formula,
    [CASE WHEN (n_nationkey + i) % 5 <> 0 THEN CAST((n_nationkey * (i + 1)) % 3 AS DOUBLE) END FOR i IN range(12)] AS g, n_name AS name, n_regionkey AS region FROM nation"""
_EMBED = "SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings"


def _search(name: str, source: Query, feature: str, kernel, sql_table: str, sql: str, queries: str = "id % 50 = 0") -> None:
    """A kernel query: every query row against every other row, and its SQL over pairs a, b."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = source(spark, d)
        out = E.all_pairs(rows.where(queries), rows, kernel, feature, "id", "id", self_pairs=False)
        return out.withColumn("similarity", F.round("similarity", 6))

    QUERIES[name] = run
    condition = queries.replace("id", "a.id")
    if sql:
        ORACLES[name] = f"WITH t AS ({sql_table}) SELECT a.id AS sample_id, b.id AS train_id, round({sql}, 6) AS similarity FROM t a JOIN t b ON {condition} AND a.id <> b.id"


_COS = "list_cosine_similarity(a.v, b.v)"
_search("kernel_cosine", _embeddings, "v", K.cosine, _EMBED, _COS)
_search("kernel_spectral_angle", _embeddings, "v", K.spectral_angle, _EMBED, f"(greatest(-1, least(1, {_COS})) + 1) / 2")
_PEARSON = "[x - list_avg({0}.v) FOR x IN {0}.v]"
_search("kernel_pearson", _embeddings, "v", K.pearson, _EMBED, f"(list_cosine_similarity({_PEARSON.format('a')}, {_PEARSON.format('b')}) + 1) / 2")
_search("kernel_bray_curtis", D.user_histograms, "h", K.bray_curtis, D.HISTOGRAM_SQL, "1 - list_sum([abs(a.h[i] - b.h[i]) FOR i IN range(1, 6)]) / (list_sum(a.h) + list_sum(b.h))")
_P, _Q = "(a.h[i] / list_sum(a.h))", "(b.h[i] / list_sum(b.h))"
_HALF = "list_sum([CASE WHEN {0} > 0 THEN {0} * ln(2 * {0} / ({0} + {1})) ELSE 0 END FOR i IN range(1, 6)])"
_search("kernel_jensen_shannon", D.user_histograms, "h", K.jensen_shannon, D.HISTOGRAM_SQL, f"greatest(0, 1 - 0.5 * ({_HALF.format(_P, _Q)} + {_HALF.format(_Q, _P)}) / ln(2))")
_search("kernel_tanimoto", D.user_bits, "b", K.bits_tanimoto, D.BITS_SQL, "len(list_intersect(a.b, b.b)) / (len(a.b) + len(b.b) - len(list_intersect(a.b, b.b)))")
_search("kernel_sequence_identity", _nations, "name", K.sequence_identity, _NATIONS, """CASE WHEN length(a.name) = length(b.name)
    THEN list_sum([CAST(a.name[i] = b.name[i] AS INT) FOR i IN range(1, length(a.name) + 1)]) / length(a.name) ELSE 1 - levenshtein(a.name, b.name) / greatest(length(a.name), length(b.name)) END""", "id >= 0")
_search("kernel_positional_identity", _nations, "name", K.positional_identity, _NATIONS, "list_sum([CAST(a.name[i] = b.name[i] AS INT) FOR i IN range(1, least(length(a.name), length(b.name)) + 1)]) / greatest(length(a.name), length(b.name))", "id >= 0")
_search("kernel_char_ngram", lambda s, d: _nations(s, d).withColumn("grams", K.char_ngrams(F.col("name"))), "grams", K.jaccard,
        f"SELECT id, list_distinct(flatten([[name[i:i + n - 1] FOR i IN range(1, length(name) - n + 2)] FOR n IN [2, 3, 4]])) AS grams FROM ({_NATIONS})",
        "len(list_intersect(a.grams, b.grams)) / (len(a.grams) + len(b.grams) - len(list_intersect(a.grams, b.grams)))", "id >= 0")
_search("kernel_genotype_ibs", _nations, "g", K.genotype_ibs, _NATIONS, "coalesce(list_avg([greatest(0, 1 - abs(a.g[i] - b.g[i]) / 2) FOR i IN range(1, 13)]), 0)", "id >= 0")
_H = "pow(sin((radians(b.lat) - radians(a.lat)) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin((radians(b.lon) - radians(a.lon)) / 2), 2)"
QUERIES["kernel_haversine"] = lambda s, d: E.block_pairs(
    _nations(s, d).select(F.col("id").alias("sample_id"), F.col("lat").alias("a1"), F.col("lon").alias("a2")), _nations(s, d).select(F.col("id").alias("train_id"), "lat", "lon"), "train_id"
).select("sample_id", "train_id", F.round(K.haversine_similarity(F.col("a1"), F.col("a2"), F.col("lat"), F.col("lon")), 6).alias("similarity"))
ORACLES["kernel_haversine"] = f"WITH t AS ({_NATIONS}) SELECT a.id AS sample_id, b.id AS train_id, round(exp(-2 * 6371.0088 * asin(sqrt(least(1, {_H}))) / 1000), 6) AS similarity FROM t a, t b"
_search("kernel_formula", _nations, "formula", K.REGISTRY["formula_overlap"],
        f"""SELECT id, c / (c + h + o) AS c, h / (c + h + o) AS h, o / (c + h + o) AS o FROM (SELECT id, CAST(regexp_extract(formula, 'C([0-9]+)', 1) AS DOUBLE) AS c,
            CAST(regexp_extract(formula, 'H([0-9]+)', 1) AS DOUBLE) AS h, CAST(contains(formula, 'O') AS DOUBLE) AS o FROM ({_NATIONS}))""",
        "1 - (abs(a.c - b.c) + abs(a.h - b.h) + abs(a.o - b.o)) / 2", "id >= 0")
_search("kernel_chamfer", lambda s, d: _embeddings(s, d).withColumn("cloud", F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: F.slice("v", i * 3 + 1, F.lit(3)))), "cloud",
        lambda a, b: K.chamfer(a, b, "exp", 10.0), f"SELECT id, [v[i * 3 + 1:i * 3 + 3] FOR i IN range(21)] AS c FROM ({_EMBED})",
        "exp(-(list_avg([list_min([list_sum([pow(p[k] - q[k], 2) FOR k IN range(1, 4)]) FOR q IN b.c]) FOR p IN a.c]) + list_avg([list_min([list_sum([pow(p[k] - q[k], 2) FOR k IN range(1, 4)]) FOR p IN a.c]) FOR q IN b.c])) / 2 / 10)")
_search("kernel_sinkhorn", D.user_histograms, "h", lambda a, b: PK.sinkhorn_similarity()(a, b), D.HISTOGRAM_SQL, "")


def _sequence_search(feature: str, score) -> Query:
    """Every fiftieth user against every other one, in blocks: a user's events come to a block once, not with every pair."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = Workspace(spark, "sequences").save(D.user_sequences(spark, d).select("id", F.col(feature).alias("f")), "rows")
        return E.grid_pairs(rows.where("id % 50 = 0"), rows, score, lambda lot: lot["f"].tolist()).withColumn("similarity", F.round("similarity", 6))

    return run


QUERIES["kernel_event_alignment"] = _sequence_search("types", PK.alignment_grid)
QUERIES["kernel_dtw"] = _sequence_search("series", PK.dtw_grid(100.0, 10))


def kernel_spectrum(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers' price spectra in blocks: peak lists of hundreds of peaks are not copied to every pair."""
    peaks = D.supplier_peaks(spark, d).groupBy("id").agg(F.collect_list(F.struct(F.col("mz").cast("double").alias("mz"), F.col("intensity").cast("double").alias("intensity"))).alias("p"))
    rows = Workspace(spark, "spectra").save(peaks.select("id", "p.mz", "p.intensity"), "rows")
    return E.grid_pairs(rows.where("id % 50 = 0"), rows, PK.spectrum_grid, PK.spectrum_lots).withColumn("similarity", F.round("similarity", 6))


QUERIES["kernel_spectrum"] = kernel_spectrum


def metadata_mixed(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").withColumnRenamed("c_custkey", "id")
    edges = E.mixed_top_k(rows.where("id % 50 = 0"), rows, ["c_acctbal", "c_mktsegment", "c_nationkey"], 5, 9)
    return edges.withColumn("similarity", F.round("similarity", 6))


QUERIES["metadata_mixed"] = metadata_mixed
ORACLES["metadata_mixed"] = """
    WITH p AS (SELECT a.c_custkey AS sample_id, b.c_custkey AS train_id, round((1 / (1 + abs(a.c_acctbal - b.c_acctbal)) + CAST(a.c_mktsegment = b.c_mktsegment AS INT)
        + 1 / (1 + abs(a.c_nationkey - b.c_nationkey))) / 3, 9) AS s FROM customer a JOIN customer b ON a.c_custkey % 50 = 0 AND a.c_custkey <> b.c_custkey)
    SELECT sample_id, train_id, round(s, 6) AS similarity, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY s DESC, train_id) AS r FROM p) WHERE r <= 5"""


def group_equality(spark: SparkSession, d: str) -> DataFrame:
    """Customers of one nation and segment: every query row with the rows of its group, as a null-safe equi-join."""
    c = table(spark, d, "customer")
    a = c.where("c_custkey % 50 = 0").select(F.col("c_custkey").alias("sample_id"), F.col("c_nationkey").alias("x"), F.col("c_mktsegment").alias("y"))
    b = c.select(F.col("c_custkey").alias("train_id"), "c_nationkey", "c_mktsegment")
    groups = [(F.col("x"), F.col("c_nationkey")), (F.col("y"), F.col("c_mktsegment"))]
    hit = groups[0][0].eqNullSafe(groups[0][1]) & groups[1][0].eqNullSafe(groups[1][1])
    return a.join(b, hit).where("sample_id <> train_id").select("sample_id", "train_id", K.group_equality(groups).alias("similarity"))


QUERIES["group_equality"] = group_equality
ORACLES["group_equality"] = """SELECT a.c_custkey AS sample_id, b.c_custkey AS train_id, 1.0::DOUBLE AS similarity FROM customer a JOIN customer b
    ON a.c_custkey % 50 = 0 AND a.c_custkey <> b.c_custkey AND a.c_nationkey IS NOT DISTINCT FROM b.c_nationkey AND a.c_mktsegment IS NOT DISTINCT FROM b.c_mktsegment"""


def _dense(metric: str, **more) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = _embeddings(spark, d)
        return E.dense_top_k(rows.where("id % 50 = 0"), rows, "id", "id", "v", 10, metric, **more).withColumn("similarity", F.round("similarity", 6))

    return run


def _dense_sql(value: str) -> str:
    return f"""WITH t AS ({_EMBED}), p AS (SELECT a.id AS sample_id, b.id AS train_id, round({value}, 10) AS s FROM t a JOIN t b ON a.id % 50 = 0 AND a.id <> b.id)
        SELECT sample_id, train_id, round(s, 6) AS similarity, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY s DESC, train_id) AS r FROM p) WHERE r <= 10"""


QUERIES |= {"cosine_topk": _dense("cosine"), "dot_topk": _dense("dot"), "euclid_topk": _dense("euclidean", scale=10.0)}
ORACLES |= {
    "cosine_topk": _dense_sql(f"({_COS} + 1) / 2"),
    "dot_topk": _dense_sql("list_dot_product(a.v, b.v)"),
    "euclid_topk": _dense_sql("exp(-list_distance(a.v, b.v) / 10)"),
}



def composite(mode: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = _nations(spark, d)
        one = E.all_pairs(rows, rows, K.genotype_ibs, "g", "id", "id", False)
        two = E.all_pairs(rows, rows, K.sequence_identity, "name", "id", "id", False)
        return E.composite([one, two], mode, [0.25, 0.75]).withColumn("similarity", F.round("similarity", 6))

    return run


for _mode, _sql in {"mean": "(x + y) / 2", "weighted_mean": "0.25 * x + 0.75 * y", "min": "least(x, y)", "max": "greatest(x, y)", "noisy_or": "1 - (1 - x) * (1 - y)"}.items():
    QUERIES[f"composite_{_mode}"] = composite(_mode)
    ORACLES[f"composite_{_mode}"] = f"""WITH p AS (SELECT sample_id, train_id, x, y FROM ({ORACLES['kernel_genotype_ibs'].replace('AS similarity', 'AS x').replace('round(', '(').replace(', 6)', ')')})
        JOIN ({ORACLES['kernel_sequence_identity'].replace('AS similarity', 'AS y').replace('round(', '(').replace(', 6)', ')')}) USING (sample_id, train_id)) SELECT sample_id, train_id, round({_sql}, 6) AS similarity FROM p"""


def nearest_price(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("line"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price")).distinct()
    parts = table(spark, d, "part").select("p_partkey", F.col("p_retailprice").alias("price"))
    out = E.nearest_numeric(lines, parts, "line", "p_partkey", "price", 10.0)
    return out.withColumn("similarity", F.round("similarity", 6))


QUERIES["nearest_price"] = nearest_price
ORACLES["nearest_price"] = """
    WITH q AS (SELECT DISTINCT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS sample_id, l_extendedprice / l_quantity AS v FROM lineitem),
    t AS (SELECT p_retailprice AS v, min(p_partkey) AS id FROM part GROUP BY 1),
    c AS (SELECT sample_id, q.v, t.id, abs(q.v - t.v) AS dist FROM q ASOF JOIN t ON q.v >= t.v UNION ALL SELECT sample_id, q.v, t.id, abs(q.v - t.v) FROM q ASOF JOIN t ON q.v <= t.v)
    SELECT sample_id, id AS train_id, round(exp(-dist / 10), 6) AS similarity FROM c QUALIFY row_number() OVER (PARTITION BY sample_id, v ORDER BY dist, id) = 1"""


def scaffold_membership(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "eval_molecules").select("sample_id", "murcko_scaffold").distinct()
    return E.membership(e, table(spark, d, "train_molecules"), "murcko_scaffold")


QUERIES["scaffold_membership"] = scaffold_membership
ORACLES["scaffold_membership"] = """SELECT DISTINCT sample_id, murcko_scaffold, murcko_scaffold IS NOT NULL AND murcko_scaffold IN (SELECT murcko_scaffold FROM train_molecules WHERE murcko_scaffold IS NOT NULL) AS in_train
    FROM eval_molecules"""


def metric_transform(spark: SparkSession, d: str) -> DataFrame:
    """Retail prices as distances through the three forms."""
    p = table(spark, d, "part")
    forms = {f: F.round(K.metric_to_similarity(F.col("p_retailprice"), f, 1500.0), 6).alias(f) for f in ("exp", "inverse", "linear")}
    return p.select("p_partkey", *forms.values())


QUERIES["metric_transform"] = metric_transform
ORACLES["metric_transform"] = "SELECT p_partkey, round(exp(-p_retailprice / 1500), 6) AS exp, round(1 / (1 + p_retailprice / 1500), 6) AS inverse, round(greatest(0, 1 - p_retailprice / 1500), 6) AS linear FROM part"
