"""Queries of graphs, splits and operating points."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.functions import features
from nearfield.functions import kernels as K
from nearfield.operators import edges as E
from nearfield.operators import graph as G
from nearfield.operators import splits as S
from nearfield.operators.skew import hot_keys, salted_join
from nearfield.plans.curve_queries import _VALID, rounded, valid_edges
from nearfield.plans.kernel_queries import _EMBED, _embeddings, _nations
from nearfield.plans.tables import table
from nearfield.storage import Workspace, metric

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The similarity graph of all methods, and its nodes."""
    edges = G.normalised(valid_edges(spark, d), "sample_id", "train_id", "similarity")
    nodes = edges.select(F.explode(F.array("i", "j")).alias("id")).distinct()
    return edges, nodes


_G = f"SELECT least(sample_id, train_id) AS i, greatest(sample_id, train_id) AS j, max(similarity) AS w FROM ({_VALID}) GROUP BY ALL"
_N = "SELECT DISTINCT unnest([i, j]) AS id FROM g"

QUERIES["graph_degrees"] = lambda s, d: rounded(G.degrees(*_graph(s, d)))
ORACLES["graph_degrees"] = f"""WITH g AS ({_G}), e AS (SELECT i AS id, w FROM g UNION ALL SELECT j, w FROM g)
    SELECT id, count(*) AS degree, round(sum(w), 6) AS weight, round(count(*) / (SELECT count(DISTINCT id) FROM e), 6) AS share FROM e GROUP BY id"""
QUERIES["degree_distribution"] = lambda s, d: G.degrees(*_graph(s, d)).groupBy("degree").agg(F.count("*").alias("nodes"))
ORACLES["degree_distribution"] = f"SELECT degree, count(*) AS nodes FROM ({ORACLES['graph_degrees']}) GROUP BY degree"
QUERIES["graph_statistics"] = lambda s, d: rounded(G.statistics(*_graph(s, d)))
ORACLES["graph_statistics"] = f"""WITH g AS ({_G}), n AS (SELECT count(*) AS nodes FROM ({_N})), s AS (SELECT count(*) AS listed, max(w) AS hi, sum(w) AS t FROM g)
    SELECT nodes, CAST(nodes * (nodes - 1) // 2 AS BIGINT) AS possible_pairs, listed, 0.0::DOUBLE AS min_weight, round(hi, 6) AS max_weight, round(t, 6) AS total_weight, round(t / (nodes * (nodes - 1) // 2), 6) AS density,
    t / (nodes * (nodes - 1) // 2) >= 0.4 AS too_dense FROM n, s"""


def components(spark: SparkSession, d: str) -> DataFrame:
    edges, nodes = _graph(spark, d)
    return G.components(edges, nodes, 0.8, Workspace(spark, "components"))


def _reach(threshold: float) -> str:
    return f"""link AS (SELECT i AS a, j AS b FROM g WHERE w >= {threshold} UNION SELECT j, i FROM g WHERE w >= {threshold}),
    reach(id, other) AS (SELECT id, id FROM nodes UNION SELECT reach.id, link.b FROM reach JOIN link ON link.a = reach.other),
    labels AS (SELECT id, min(other) AS component FROM reach GROUP BY id)"""


QUERIES["components"] = components
ORACLES["components"] = f"WITH RECURSIVE g AS ({_G}), nodes AS ({_N}), {_reach(0.8)} SELECT id, component FROM labels"
QUERIES["components_numbered"] = lambda s, d: G.numbered(components(s, d)).select("id", F.col("number").cast("bigint").alias("number"))
ORACLES["components_numbered"] = ORACLES["components"].replace("SELECT id, component FROM labels", "SELECT id, dense_rank() OVER (ORDER BY component) - 1 AS number FROM labels")

_TAUS = [0.95, 0.9, 0.85, 0.8]


def threshold_summary(spark: SparkSession, d: str) -> DataFrame:
    edges, nodes = _graph(spark, d)
    ws = Workspace(spark, "sweep")
    return G.threshold_summary(ws.save(edges, "graph"), ws.save(nodes, "nodes"), _TAUS, ws)


QUERIES["threshold_summary"] = threshold_summary
ORACLES["threshold_summary"] = f"WITH RECURSIVE g AS ({_G}), nodes AS ({_N}) " + " UNION ALL ".join(
    f"""(WITH RECURSIVE {_reach(t)} SELECT {t}::DOUBLE AS threshold, (SELECT count(*) FROM g WHERE w >= {t}) AS edges, count(*) AS components, max(n) AS largest FROM (SELECT count(*) AS n FROM labels GROUP BY component))""" for t in _TAUS
)


def component_table(spark: SparkSession, d: str) -> DataFrame:
    edges, nodes = _graph(spark, d)
    labels = G.components(edges, nodes, 0.8, Workspace(spark, "component-table"))
    return rounded(G.component_table(labels, edges))


QUERIES["component_table"] = component_table
ORACLES["component_table"] = f"""WITH RECURSIVE g AS ({_G}), nodes AS ({_N}), {_reach(0.8)},
    e AS (SELECT i AS u, j AS v, w FROM g UNION ALL SELECT j, i, w FROM g),
    o AS (SELECT a.component, max(w) AS m, sum(w) AS s FROM e JOIN labels a ON a.id = u JOIN labels b ON b.id = v WHERE a.component <> b.component GROUP BY a.component),
    z AS (SELECT component, count(*) AS size, min(id) AS min_id FROM labels GROUP BY component)
    SELECT z.component, size, min_id, round(coalesce(m, 0), 6) AS external_max, round(coalesce(s, 0) / (size * ((SELECT count(*) FROM nodes) - size)), 6) AS external_mean FROM z LEFT JOIN o USING (component)"""


def _threshold_split(spark: SparkSession, d: str, tau: float) -> tuple[DataFrame, DataFrame, str]:
    edges, nodes = _graph(spark, d)
    ws = Workspace(spark, "threshold-split")
    edges = ws.save(edges, "graph")
    labels = ws.save(G.components(edges, ws.save(nodes, "nodes"), tau, ws), "labels")
    split, status = S.threshold_split(labels, ws.save(G.component_table(labels, edges), "table"), ws)
    return ws.save(split, "split"), edges, status


def _packed(tau: float) -> str:
    """Common table expressions down to ``split``: the packing walks through the ordered components one by one."""
    return f"""g AS MATERIALIZED ({_G}), nodes AS MATERIALIZED ({_N}), {_reach(tau).replace("labels AS (", "labels AS MATERIALIZED (")},
    e AS (SELECT i AS u, j AS v, w FROM g UNION ALL SELECT j, i, w FROM g),
    o AS (SELECT a.component, max(w) AS m, sum(w) AS s FROM e JOIN labels a ON a.id = u JOIN labels b ON b.id = v WHERE a.component <> b.component GROUP BY a.component),
    z AS (SELECT component, count(*) AS size, min(id) AS min_id FROM labels GROUP BY component),
    x AS (SELECT count(*) AS n, round_even(0.2 * count(*), 0) AS target, ceil(0.15 * count(*) - 1e-9) AS least, floor(0.25 * count(*) + 1e-9) AS most FROM nodes),
    f AS MATERIALIZED (SELECT component, size, row_number() OVER (ORDER BY CASE WHEN n > size THEN coalesce(m, 0) END DESC NULLS LAST, round(CASE WHEN n > size THEN coalesce(s, 0) / (size * (n - size)) END, 12) DESC NULLS LAST, size, min_id) AS k
        FROM z LEFT JOIN o USING (component), x WHERE size <= most),
    walk(k, total, component) AS (SELECT 0::BIGINT, 0::BIGINT, NULL::VARCHAR UNION ALL
        SELECT f.k, CASE WHEN total + size <= most THEN total + size ELSE total END, CASE WHEN total + size <= most THEN f.component END FROM walk JOIN f ON f.k = walk.k + 1, x WHERE total < target),
    split AS MATERIALIZED (SELECT id AS sample_id, CASE WHEN w.component IS NOT NULL THEN 'test' ELSE 'train' END AS split, CASE WHEN w.component IS NOT NULL THEN 'held_out' ELSE 'fit' END AS role
        FROM labels LEFT JOIN (SELECT component FROM walk WHERE component IS NOT NULL) w USING (component))"""


_CROSSED = "SELECT count(*) FROM g JOIN split a ON a.sample_id = i JOIN split b ON b.sample_id = j WHERE a.split <> b.split AND w >= {tau}"
_NEAREST = """SELECT t.sample_id, coalesce(max(w), 0) AS m, coalesce(sum(w), 0) / (SELECT count(*) FROM split WHERE split = 'train') AS s
    FROM (SELECT * FROM split WHERE split = 'test') t LEFT JOIN (SELECT u, w FROM e JOIN split ON sample_id = v AND split = 'train') ON u = t.sample_id GROUP BY t.sample_id"""
_SUMMARY = f"""(SELECT count(*) FROM split WHERE split = 'train') AS train_size, count(*) AS test_size, round(avg(m), 6) AS mean_max, round(quantile_cont(m, 0.5), 6) AS median_max, round(quantile_cont(m, 0.1), 6) AS p10_max,
    round(quantile_cont(m, 0.9), 6) AS p90_max, round(max(m), 6) AS max_max, round(avg(s), 6) AS mean_mean FROM ({_NEAREST})"""

QUERIES["threshold_split"] = lambda s, d: _threshold_split(s, d, 0.8)[0]
ORACLES["threshold_split"] = f"WITH RECURSIVE {_packed(0.8)} SELECT * FROM split"
QUERIES["threshold_split_check"] = lambda s, d: S.violations(*_threshold_split(s, d, 0.8)[:2], 0.8)
ORACLES["threshold_split_check"] = f"""WITH RECURSIVE {_packed(0.8)}
    SELECT count(*) FILTER (split = 'train') AS train_size, count(*) FILTER (split = 'test') AS test_size, ({_CROSSED.format(tau=0.8)}) AS violations, 'valid' AS status FROM split"""
QUERIES["threshold_split_summary"] = lambda s, d: rounded(S.split_summary(*_threshold_split(s, d, 0.8)[:2]))
ORACLES["threshold_split_summary"] = f"WITH RECURSIVE {_packed(0.8)} SELECT {_SUMMARY}"


def sweep(spark: SparkSession, d: str) -> DataFrame:
    """One row a threshold (X3): status and summary of the split, over all thresholds of the sweep.

    Ids are numbered in their order once; the edges meet the components of all thresholds in one pass and
    the sides of all splits in another.
    """
    ws = Workspace(spark, "sweep")
    named = ws.save(_graph(spark, d)[0], "named", rows=F.count(F.lit(1)))
    index = ws.save(features.row_ids(named.select(F.explode(F.array("i", "j")).alias("id")).distinct(), "", ["id"], 1).select("id", F.col("sample_id").cast("bigint").alias("n")), "index")
    edges = named
    for end in ("i", "j"):
        edges = salted_join(edges, index.select(F.col("id").alias(end), F.col("n").alias(f"n{end}")), end, hot_keys(named, end, metric(named, "rows")), "ni" if end == "j" else "j")
    edges, nodes = ws.save(edges.select(F.col("ni").alias("i"), F.col("nj").alias("j"), "w"), "graph"), index.select(F.col("n").alias("id"))
    tagged = nodes
    for k, (_, labels) in enumerate(G.component_sweep(edges, nodes, list(S.SWEEP), ws)):  # from the highest, as in S.SWEEP
        tagged = tagged.join(labels.select("id", F.col("component").alias(f"__{k}")), "id")
    listed = F.array(*[f"__{k}" for k in range(len(S.SWEEP))]).alias("tags")
    tagged = ws.save(tagged.select("id", listed), "tagged")
    tables = ws.save(G.component_tables(tagged, edges, len(S.SWEEP)), "tables")
    tested, packed = nodes, []
    for k, tau in enumerate(S.SWEEP):
        split, status = S.threshold_split(tagged.select("id", F.col("tags")[k].alias("component")), tables.where(F.col("k") == k), ws)
        tested = tested.join(split.select(F.col("sample_id").alias("id"), (F.col("split") == "test").alias(f"__{k}")), "id")
        packed.append((k, tau, S.split_id(tau), status))
    summaries = S.split_summaries(ws.save(tested.select("id", listed), "tested"), edges, len(S.SWEEP))
    status = spark.createDataFrame(packed, "k int, threshold double, split_id string, status string")
    return rounded(summaries.join(F.broadcast(status), "k").drop("k"))


QUERIES["threshold_sweep"] = sweep
_STATUS = "CASE WHEN (SELECT count(*) FROM split WHERE split = 'test') >= (SELECT least FROM x) THEN 'valid' ELSE 'invalid_test_size' END"
ORACLES["threshold_sweep"] = " UNION ALL ".join(
    f"(WITH RECURSIVE {_packed(t)} SELECT {t}::DOUBLE AS threshold, '{S.split_id(t)}' AS split_id, {_STATUS} AS status, {_SUMMARY})" for t in S.SWEEP
)


def cross_overlap(spark: SparkSession, d: str) -> DataFrame:
    edges, nodes = _graph(spark, d)
    return rounded(G.cross_overlap(edges, nodes.where("id like 'tr%'"), nodes.where("id like 'ev%'"), 0.5))


QUERIES["cross_overlap_binary"] = cross_overlap
ORACLES["cross_overlap_binary"] = f"""WITH g AS ({_G}), n AS ({_N}), e AS (SELECT i AS u, j AS v, w FROM g UNION ALL SELECT j, i, w FROM g),
    x AS (SELECT count(DISTINCT u) AS a, count(DISTINCT v) AS b FROM e WHERE u LIKE 'tr%' AND v LIKE 'ev%' AND w >= 0.5), z AS (SELECT count(*) FILTER (id LIKE 'tr%') AS t, count(*) FILTER (id LIKE 'ev%') AS v FROM n)
    SELECT t AS train_size, v AS test_size, a AS num_similar, round(a / t, 6) AS overlap, round(b / v, 6) AS test_overlap FROM x, z"""


def cross_overlap_weighted(spark: SparkSession, d: str) -> DataFrame:
    edges, nodes = _graph(spark, d)
    return rounded(G.cross_overlap(edges, nodes.where("id like 'tr%'"), nodes.where("id like 'ev%'")))


QUERIES["cross_overlap_weighted"] = cross_overlap_weighted
ORACLES["cross_overlap_weighted"] = f"""WITH g AS ({_G}), n AS ({_N}), x AS (SELECT sum(w) AS s, sum(w * w) AS q, max(w) AS hi FROM g WHERE i LIKE 'ev%' AND j LIKE 'tr%'),
    z AS (SELECT count(*) FILTER (id LIKE 'tr%') AS t, count(*) FILTER (id LIKE 'ev%') AS v FROM n)
    SELECT t AS train_size, v AS test_size, round(s / (t * v), 6) AS mean, round(sqrt(q / (t * v) - pow(s / (t * v), 2)), 6) AS std, round(hi, 6) AS max, 0.0::DOUBLE AS min FROM x, z"""


def independent_set(spark: SparkSession, d: str) -> DataFrame:
    edges, nodes = _graph(spark, d)
    return S.independent_set(edges, nodes, 0.8, 0.5, Workspace(spark, "independent"))


QUERIES["independent_set"] = independent_set


def _vector_graph(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of embeddings by rounded cosine, each once."""
    rows = _embeddings(spark, d)
    pairs = E.all_pairs(rows, rows, K.cosine, "v", "id", "id", False).where("sample_id < train_id")
    return pairs.select(F.col("sample_id").alias("i"), F.col("train_id").alias("j"), F.round("similarity", 9).alias("w"))


QUERIES["pair_quantiles"] = lambda s, d: rounded(G.pair_quantiles(_vector_graph(s, d), _embeddings(s, d)))
ORACLES["pair_quantiles"] = f"""WITH t AS ({_EMBED}), p AS (SELECT round(list_cosine_similarity(a.v, b.v), 9) AS w FROM t a JOIN t b ON a.id < b.id)
    SELECT CAST(unnest([0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]) AS DOUBLE) AS quantile, round(unnest(quantile_cont(w, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1])), 6) AS similarity FROM p"""
QUERIES["knn_table"] = lambda s, d: E.dense_top_k(_embeddings(s, d), _embeddings(s, d), "id", "id", "v", 10, raw=True).withColumn("similarity", F.round("similarity", 6))
ORACLES["knn_table"] = f"""WITH t AS ({_EMBED}), p AS (SELECT a.id AS sample_id, b.id AS train_id, round(list_cosine_similarity(a.v, b.v), 10) AS s FROM t a JOIN t b ON a.id <> b.id)
    SELECT sample_id, train_id, round(s, 6) AS similarity, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY s DESC, train_id) AS r FROM p) WHERE r <= 10"""


def _links(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A small network: nations linked to their region and to the next nation."""
    n = table(spark, d, "nation")
    key = F.col("n_nationkey").cast("bigint")
    links = n.select(key.alias("u"), (F.col("n_regionkey") + 1000).cast("bigint").alias("v")).unionByName(n.select(key.alias("u"), ((key * 7 + 3) % 25).alias("v")))
    return links, n.select(key.alias("id"))


_L = "SELECT n_nationkey::BIGINT AS u, n_regionkey + 1000 AS v FROM nation UNION SELECT n_nationkey::BIGINT, (n_nationkey * 7 + 3) % 25 FROM nation"
QUERIES["khop_jaccard"] = lambda s, d: rounded(G.neighbourhood_jaccard(_links(s, d)[0], _links(s, d)[1], _links(s, d)[1], 2, Workspace(s, "khop")))
ORACLES["khop_jaccard"] = f"""WITH l AS ({_L}), b AS (SELECT u, v FROM l WHERE u <> v UNION SELECT v, u FROM l WHERE u <> v), n AS (SELECT n_nationkey::BIGINT AS id FROM nation),
    h AS (SELECT id AS s, v AS x FROM n JOIN b ON u = id UNION SELECT n.id, c.v FROM n JOIN b ON b.u = n.id JOIN b c ON c.u = b.v), k AS (SELECT s, list(DISTINCT x) AS x FROM h WHERE s <> x GROUP BY s)
    SELECT a.s AS sample_id, c.s AS train_id, round(len(list_intersect(a.x, c.x)) / (len(a.x) + len(c.x) - len(list_intersect(a.x, c.x))), 6) AS similarity FROM k a, k c"""


def network_proximity(spark: SparkSession, d: str) -> DataFrame:
    links, _ = _links(spark, d)
    sets = _nations(spark, d).select(F.col("region").cast("bigint").alias("id"), F.col("id").alias("entity"))
    return rounded(G.network_proximity(links, sets, sets, 4, Workspace(spark, "proximity")))


QUERIES["network_proximity"] = network_proximity
ORACLES["network_proximity"] = f"""WITH RECURSIVE l AS ({_L}), b AS (SELECT u, v FROM l WHERE u <> v UNION SELECT v, u FROM l WHERE u <> v), e AS (SELECT n_regionkey::BIGINT AS id, n_nationkey::BIGINT AS entity FROM nation),
    w(s, x, h) AS (SELECT id, entity, 0 FROM e UNION SELECT s, v, h + 1 FROM w JOIN b ON u = x WHERE h < 4), m AS (SELECT s, x, min(h) AS h FROM w GROUP BY s, x),
    o AS (SELECT e.id AS a, r.id AS b, avg(coalesce(h, 10)) AS d FROM e CROSS JOIN (SELECT DISTINCT id FROM e) r LEFT JOIN m ON m.s = r.id AND m.x = e.entity GROUP BY ALL)
    SELECT p.a AS sample_id, p.b AS train_id, round(exp(-(p.d + q.d) / 2 / 2), 6) AS similarity FROM o p JOIN o q ON q.a = p.b AND q.b = p.a"""

# ---- operating points -------------------------------------------------------------------------------------
_HASH = "(({id} * 2654435761 + {seed} * 40503) % 1000003)"


def _op(name: str, source: str, sql: str, **arguments) -> None:
    QUERIES[f"op_{name}"] = lambda s, d: S.operating_point(name, table(s, d, source), **arguments)
    if sql:
        region = S.OPERATING_POINTS[name][2]
        ORACLES[f"op_{name}"] = f"SELECT *, '{name}' AS operating_point_id, '{region}' AS expected_curve_region FROM ({sql})"


def _role(test: str, more: str = "", id_col: str = "sample_id", source: str = "") -> str:
    return f"SELECT {id_col} AS sample_id, CASE WHEN {test} THEN 'test' ELSE 'train' END AS split, CASE WHEN {test} THEN 'held_out' ELSE 'fit' END AS role{more} FROM {source}"


_op("random_iid_split_baseline", "customer", _role(
    "r <= ceil(0.2 * n)", source=f"(SELECT c_custkey, row_number() OVER (ORDER BY {_HASH.format(id='c_custkey', seed=0)}, c_custkey) AS r, count(*) OVER () AS n FROM customer)", id_col="c_custkey"), id_col="c_custkey", numeric=True)
_op("group_k_fold_holdout", "customer", f"SELECT c_custkey AS sample_id, CAST({_HASH.format(id='c_nationkey', seed=0)} % 5 AS INT) AS fold_id FROM customer", id_col="c_custkey", group="c_nationkey", k=5, numeric=True)
_op("leave_one_domain_out_benchmark", "customer", _role("c_mktsegment = f", ", f AS fold_id", "c_custkey", "customer, (SELECT DISTINCT c_mktsegment AS f FROM customer)"), id_col="c_custkey", group="c_mktsegment")
_op("leave_site_out_external_validation", "supplier", _role("s_nationkey = f", ", CAST(f AS VARCHAR) AS fold_id", "s_suppkey", "supplier, (SELECT DISTINCT s_nationkey AS f FROM supplier)"), id_col="s_suppkey", group="s_nationkey")
_op("chromosome_loco_holdout", "part", _role("p_type = f", ", f AS fold_id", "p_partkey", "part, (SELECT DISTINCT p_type AS f FROM part)"), id_col="p_partkey", group="p_type")
_op("molecular_property_extreme_split", "part", _role("p_retailprice > (SELECT quantile_cont(p_retailprice, 0.9) FROM part)", "", "p_partkey", "part"), id_col="p_partkey", value="p_retailprice")
_op("temporal_forward_split", "orders", _role("o_orderdate >= TIMESTAMP '1998-01-01'", "", "o_orderkey", "orders"), id_col="o_orderkey", ts="o_orderdate", cutoff="1998-01-01")
_op("contiguous_mutational_region_split", "part", _role("p_size BETWEEN 20 AND 30", "", "p_partkey", "part"), id_col="p_partkey", test="p_size BETWEEN 20 AND 30")
_op("targeted_intended_use_validation", "customer", _role("c_mktsegment = 'MACHINERY' AND c_acctbal > 0", "", "c_custkey", "customer"), id_col="c_custkey", test="c_mktsegment = 'MACHINERY' AND c_acctbal > 0")
_op("medical_imaging_scanner_site_holdout", "events", _role(
    "event_type = 'click' AND hour(ts) = 3", ", CASE WHEN event_type = 'click' AND hour(ts) = 3 THEN 'click|3' END AS heldout_group", "event_id", "events"), id_col="event_id", groups=["event_type", "site"], held_out=[("click", 3)])
QUERIES["op_medical_imaging_scanner_site_holdout"] = lambda s, d: S.operating_point("medical_imaging_scanner_site_holdout", table(s, d, "events").withColumn("site", F.hour("ts")), id_col="event_id", groups=["event_type", "site"], held_out=[("click", 3)])
for _name, _group in (("cross_species_taxon_holdout", "c_nationkey"), ("perturbation_unseen_perturbation_split", "c_mktsegment")):
    _value = ["7"] if _group == "c_nationkey" else ["BUILDING"]
    _op(_name, "customer", _role(f"CAST({_group} AS VARCHAR) = '{_value[0]}'", f", CASE WHEN CAST({_group} AS VARCHAR) = '{_value[0]}' THEN CAST({_group} AS VARCHAR) END AS heldout_group", "c_custkey", "customer"), id_col="c_custkey", groups=[_group], held_out=[_value])
_op("leave_assay_out_bioactivity_split", "train_molecules", _role("source = 'assay_bank'", ", CASE WHEN source = 'assay_bank' THEN source END AS heldout_group", "train_id", "train_molecules"), id_col="train_id", groups=["source"], held_out=[("assay_bank",)])
_op("graph_covariate_concept_shift_split", "events", _role("event_type = 'error'", ", CASE WHEN event_type = 'error' THEN event_type END AS heldout_group", "event_id", "events"), id_col="event_id", groups=["event_type"], held_out=[("error",)])
#: The repeatable hash of texts.
_MD5 = "(CAST('0x' || substr(md5('0|' || {id}), 1, 8) AS BIGINT) % 1000003)"
for _name, _source, _id, _groups in (
    ("molecular_scaffold_split", "train_molecules", "train_id", ["murcko_scaffold"]),
    ("materials_leave_cluster_composition_split", "part", "p_partkey", ["p_brand"]),
    ("molecular_umap_cluster_split", "embeddings", "vec_id", ["label"]),
    ("perturbation_unseen_cell_type_condition_split", "events", "event_id", ["event_type", "user_id"]),
    ("protein_family_remote_homology_holdout", "supplier", "s_suppkey", ["s_nationkey"]),
    ("regulatory_cross_cell_type_assay_holdout", "part", "p_partkey", ["p_brand", "p_type"]),
    ("perturbation_systematic_variation_confounder_holdout", "orders", "o_orderkey", ["o_orderpriority"]),
):
    _group = "concat_ws('|', " + ", ".join(f"coalesce(CAST({g} AS VARCHAR), '<null>')" for g in _groups) + ")"
    _held = _MD5.format(id="grp") + " < 200000"
    _op(_name, _source, _role(_held, f", CASE WHEN {_held} THEN grp END AS heldout_group", _id, f"(SELECT *, {_group} AS grp FROM {_source})"), id_col=_id, groups=_groups)

_STEP = "(SELECT list_sum([CAST(c < epoch(o_orderdate) AS INT) FOR c IN q]) FROM x)"
QUERIES["op_bioactivity_step_forward_split"] = lambda s, d: S.operating_point("bioactivity_step_forward_split", table(s, d, "orders"), id_col="o_orderkey", order="o_orderdate", steps=5)
ORACLES["op_bioactivity_step_forward_split"] = f"""WITH x AS (SELECT quantile_cont(epoch(o_orderdate), [0.2, 0.4, 0.6, 0.8]) AS q FROM orders), r AS (SELECT o_orderkey, {_STEP} AS step FROM orders)
    SELECT o_orderkey AS sample_id, CASE WHEN step = f + 1 THEN 'test' ELSE 'train' END AS split, CASE WHEN step = f + 1 THEN 'held_out' ELSE 'fit' END AS role, CAST(f AS INT) AS fold_id,
    'bioactivity_step_forward_split' AS operating_point_id, 'axis_specific' AS expected_curve_region FROM r, range(4) t(f) WHERE step <= f + 1"""


def _places(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k, ((k * 37) % 1700 / 10 - 85).alias("lat"), ((k * 53) % 3500 / 10 - 175).alias("lon"))


QUERIES["op_spatial_block_buffered_cv"] = lambda s, d: S.operating_point("spatial_block_buffered_cv", _places(s, d), id_col="c_custkey", lat="lat", lon="lon", degrees=10.0, buffer_km=200.0)
_KM = "2 * 6371.0088 * asin(sqrt(least(1, pow(sin((radians(b.la) - radians(a.la)) / 2), 2) + cos(radians(a.la)) * cos(radians(b.la)) * pow(sin((radians(b.lo) - radians(a.lo)) / 2), 2))))"
ORACLES["op_spatial_block_buffered_cv"] = f"""WITH p AS (SELECT c_custkey AS id, (c_custkey * 37) % 1700 / 10 - 85 AS la, (c_custkey * 53) % 3500 / 10 - 175 AS lo FROM customer),
    g AS (SELECT *, CAST(floor(la / 10) AS BIGINT) AS x, CAST(floor(lo / 10) AS BIGINT) AS y FROM p), h AS (SELECT *, ((((x * 1009 + y) * 2654435761) % 1000003) + 1000003) % 1000003 < 200000 AS t FROM g)
    SELECT id AS sample_id, CASE WHEN t THEN 'test' ELSE 'train' END AS split, CASE WHEN t THEN 'held_out' ELSE 'fit' END AS role, 'spatial_block_buffered_cv' AS operating_point_id, 'low_overlap' AS expected_curve_region
    FROM h a WHERE t OR NOT EXISTS (SELECT 1 FROM h b WHERE b.t AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND {_KM} <= 200)"""
QUERIES["op_spatiotemporal_forecast_horizon_split"] = lambda s, d: S.operating_point("spatiotemporal_forecast_horizon_split", table(s, d, "events"), id_col="event_id", block=F.col("user_id"), ts="ts", origin="2024-01-15", horizon_days=7)
_BLOCK = _MD5.format(id="CAST(user_id AS VARCHAR)") + " < 200000"
_TEST = f"{_BLOCK} AND ts >= TIMESTAMP '2024-01-15' AND ts < TIMESTAMP '2024-01-22'"
ORACLES["op_spatiotemporal_forecast_horizon_split"] = f"""SELECT *, 'spatiotemporal_forecast_horizon_split' AS operating_point_id, 'axis_specific' AS expected_curve_region
    FROM ({_role(_TEST, "", "event_id", "events")} WHERE ts IS NOT NULL AND (({_TEST}) OR (NOT ({_BLOCK}) AND ts < TIMESTAMP '2024-01-15')))"""


def cold_start(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return S.operating_point("drug_target_cold_start_split", rows, left="l_partkey", right="l_suppkey", mode="pair", numeric=True)


QUERIES["op_drug_target_cold_start_split"] = cold_start
_HL, _HR = f"{_HASH.format(id='l_partkey', seed=0)} < 200000", f"{_HASH.format(id='l_suppkey', seed=1)} < 200000"
ORACLES["op_drug_target_cold_start_split"] = f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN {_HL} THEN 'test' ELSE 'train' END AS split, 'drug_target_cold_start_split' AS operating_point_id, 'low_overlap' AS expected_curve_region
    FROM lineitem WHERE ({_HL}) = ({_HR})"""


def _cluster(name: str, tau: float) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        edges, nodes = _graph(spark, d)
        ws = Workspace(spark, name)
        edges = ws.save(edges, "graph")
        labels = ws.save(G.components(edges, nodes, tau, ws), "labels")
        return S.operating_point(name, labels, table=ws.save(G.component_table(labels, edges), "table"), workspace=ws)

    return run


for _name, _tau in (("biological_sequence_homology_cluster_split", 0.9), ("molecular_fingerprint_cluster_split", 0.8), ("rna_structurally_dissimilar_split", 0.85)):
    QUERIES[f"op_{_name}"] = _cluster(_name, _tau)
    ORACLES[f"op_{_name}"] = f"WITH RECURSIVE {_packed(_tau)} SELECT *, '{_name}' AS operating_point_id, 'low_overlap' AS expected_curve_region FROM split"
