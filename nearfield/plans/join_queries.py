"""Queries of the filter-and-verify joins.  Near-duplicates of documents use 5-word shingles and Jaccard >= 0.8."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.functions import features
from nearfield.functions import kernels as K
from nearfield.operators import candidates as C
from nearfield.operators import edges as E
from nearfield.operators import setblocks as SB
from nearfield.operators.skew import spread
from nearfield.plans import datasets as D
from nearfield.plans.kernel_queries import _EMBED, _embeddings
from nearfield.plans.tables import table
from nearfield.storage import Workspace

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _shingles(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = spread(table(spark, d, "documents").where("text is not null").select("doc_id", "text"), "doc_id")
    # shingles as 64-bit hashes: the kernels only need equality
    hashed = docs.select("doc_id", F.transform(features.word_shingles(F.col("text")), lambda s: F.xxhash64(s)).alias("s"))
    ws = Workspace(spark, "shingles")
    members, classes = C.set_classes(ws.save(hashed, "sets"), "doc_id", "s")
    return ws.save(members, "members"), ws.save(classes, "classes")


def _near_duplicates(method: Callable[..., DataFrame]) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        members, classes = _shingles(spark, d)
        return C.class_links(members, method(classes, 0.8)).withColumnRenamed("id", "doc_id")

    return run


QUERIES["document_prefix_join"] = _near_duplicates(C.prefix_jaccard)
QUERIES["document_minhash_join"] = _near_duplicates(C.minhash_jaccard)
_DOC_SQL = r"""
    WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
    s AS (SELECT doc_id, list_sort(list_distinct([hash(array_to_string(w[i:i + 4], ' ')) FOR i IN range(1, len(w) - 3)])) AS s FROM w WHERE len(w) >= 5),
    c AS (SELECT s, min(doc_id) AS class_id, len(s) AS n FROM s GROUP BY s),
    e AS (SELECT class_id, n, unnest(s) AS t FROM c),
    p AS (SELECT a.class_id AS c1, b.class_id AS c2, a.n + b.n - count(*) AS u, count(*) AS i FROM e a JOIN e b ON a.t = b.t AND a.class_id < b.class_id
          AND least(a.n, b.n) >= 0.8 * greatest(a.n, b.n) - 1e-9 GROUP BY a.class_id, b.class_id, a.n, b.n),
    l AS (SELECT c, count(*) AS links FROM (SELECT unnest([c1, c2]) AS c FROM p WHERE i >= 0.8 * u - 1e-9) GROUP BY c)
    SELECT doc_id, class_id, coalesce(links, 0) AS links FROM s JOIN c USING (s) LEFT JOIN l ON l.c = class_id"""
ORACLES |= {"document_prefix_join": _DOC_SQL, "document_minhash_join": _DOC_SQL}


def component_jaccard_topk(spark: SparkSession, d: str) -> DataFrame:
    """Mixtures by shared components, every query row against all (K1 as a search)."""
    rows = table(spark, d, "focused_molecules").groupBy("row_index").agg(F.min("smiles").alias("smiles")).select(F.col("row_index").alias("id"), features.token_set(F.col("smiles"), ".").alias("s"))
    rows = Workspace(spark, "components").save(rows.select("id", F.transform("s", lambda x: F.xxhash64(x)).alias("items")), "rows")
    return E.grid_top_k(rows.where("id % 50 = 0"), rows, SB.jaccard_lots, 5, 9).withColumn("similarity", F.round("similarity", 6))


QUERIES["component_jaccard_topk"] = component_jaccard_topk
ORACLES["component_jaccard_topk"] = r"""
    WITH s AS (SELECT row_index AS id, list_distinct(list_filter(list_transform(string_split(coalesce(min(smiles), ''), '.'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')) AS s
               FROM focused_molecules GROUP BY row_index),
    p AS (SELECT a.id AS sample_id, b.id AS train_id, len(a.s) + len(b.s) AS n, len(list_intersect(a.s, b.s)) AS i FROM s a JOIN s b ON a.id % 50 = 0 AND a.id <> b.id),
    v AS (SELECT sample_id, train_id, round(CASE WHEN n = 0 THEN 1 ELSE i / (n - i) END, 9) AS s FROM p)
    SELECT sample_id, train_id, round(s, 6) AS similarity, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY s DESC, train_id) AS r FROM v) WHERE r <= 5"""


def qgram_edit_join(spark: SparkSession, d: str) -> DataFrame:
    return C.qgram_edit_join(table(spark, d, "part"), "p_partkey", "p_name", 3).withColumn("similarity", F.round("similarity", 6))


QUERIES["qgram_edit_join"] = qgram_edit_join
ORACLES["qgram_edit_join"] = """WITH n AS (SELECT DISTINCT p_name AS t FROM part) SELECT a.t AS a, b.t AS b, CAST(levenshtein(a.t, b.t) AS INT) AS edits,
    round(greatest(0, 1 - levenshtein(a.t, b.t) / greatest(length(a.t), length(b.t))), 6) AS similarity FROM n a JOIN n b ON a.t < b.t AND levenshtein(a.t, b.t) <= 3"""


def scaffold_edit_join(spark: SparkSession, d: str) -> DataFrame:
    """Distinct scaffolds of the training pool within two edits."""
    return C.qgram_edit_join(table(spark, d, "train_molecules"), "train_id", "murcko_scaffold", 2, 3).withColumn("similarity", F.round("similarity", 6))


QUERIES["scaffold_edit_join"] = scaffold_edit_join
ORACLES["scaffold_edit_join"] = """WITH n AS (SELECT DISTINCT murcko_scaffold AS t FROM train_molecules WHERE t IS NOT NULL) SELECT a.t AS a, b.t AS b, CAST(levenshtein(a.t, b.t) AS INT) AS edits,
    round(greatest(0, 1 - levenshtein(a.t, b.t) / greatest(length(a.t), length(b.t))), 6) AS similarity FROM n a JOIN n b ON a.t < b.t AND abs(length(a.t) - length(b.t)) <= 2 WHERE levenshtein(a.t, b.t) <= 2"""


def tanimoto_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = Workspace(spark, "bits").save(D.user_bits(spark, d).select("id", F.col("b").alias("items")), "rows")
    return E.grid_top_k(rows.where("id % 50 = 0"), rows, SB.jaccard_lots, 10, 9).withColumn("similarity", F.round("similarity", 6))


QUERIES["tanimoto_topk"] = tanimoto_topk
ORACLES["tanimoto_topk"] = f"""
    WITH t AS ({D.BITS_SQL}), p AS (SELECT a.id AS sample_id, b.id AS train_id, round(len(list_intersect(a.b, b.b)) / (len(a.b) + len(b.b) - len(list_intersect(a.b, b.b))), 9) AS s
        FROM t a JOIN t b ON a.id % 50 = 0 AND a.id <> b.id)
    SELECT sample_id, train_id, round(s, 6) AS similarity, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY s DESC, train_id) AS r FROM p) WHERE r <= 10"""


def hamming_radius(spark: SparkSession, d: str) -> DataFrame:
    return C.hamming_radius(C.sign_codes(_embeddings(spark, d), "id", "v", 32), 32, 5).withColumn("similarity", F.round("similarity", 6))


QUERIES["hamming_radius"] = hamming_radius
ORACLES["hamming_radius"] = f"""
    WITH c AS (SELECT id, list_sum([CASE WHEN v[i + 1] >= 0 THEN 1::BIGINT << i ELSE 0 END FOR i IN range(32)])::BIGINT AS c FROM ({_EMBED}))
    SELECT a.id AS c1, b.id AS c2, CAST(bit_count(xor(a.c, b.c)) AS INT) AS distance, round(1 - bit_count(xor(a.c, b.c)) / 32, 6) AS similarity FROM c a JOIN c b ON a.id < b.id AND bit_count(xor(a.c, b.c)) <= 5"""


def weighted_jaccard_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = Workspace(spark, "brands").save(D.customer_brands(spark, d).where("id is not null"), "rows")
    return C.weighted_jaccard_top_k(rows.where("id % 50 = 0"), rows, 5, 9).withColumn("similarity", F.round("similarity", 6))


QUERIES["weighted_jaccard_topk"] = weighted_jaccard_topk
ORACLES["weighted_jaccard_topk"] = f"""
    WITH t AS ({D.BRANDS_SQL}), n AS (SELECT id, sum(weight) AS w FROM t GROUP BY id),
    p AS (SELECT a.id AS sample_id, b.id AS train_id, sum(least(a.weight, b.weight)) AS low FROM t a JOIN t b ON a.key = b.key AND a.id % 50 = 0 AND a.id <> b.id GROUP BY ALL),
    v AS (SELECT sample_id, train_id, round(low / (x.w + y.w - low), 9) AS s FROM p JOIN n x ON x.id = sample_id JOIN n y ON y.id = train_id)
    SELECT sample_id, train_id, round(s, 6) AS similarity, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY s DESC, train_id) AS r FROM v) WHERE r <= 5"""


def sparse_peak_cosine(spark: SparkSession, d: str) -> DataFrame:
    rows = C.binned(D.supplier_peaks(spark, d), 0.5)
    return E.top_k(C.sparse_cosine_pairs(rows.where("id % 50 = 0"), rows), 5, 9).withColumn("similarity", F.round("similarity", 6))


QUERIES["sparse_peak_cosine"] = sparse_peak_cosine
ORACLES["sparse_peak_cosine"] = f"""
    WITH b AS (SELECT id, CAST(round_even(mz / 0.5, 0) AS BIGINT) AS key, sum(intensity) AS s FROM ({D.PEAKS_SQL}) WHERE intensity > 0 GROUP BY ALL),
    n AS (SELECT id, sqrt(sum(s * s)) AS n FROM b GROUP BY id), t AS (SELECT id, key, s / n AS w FROM b JOIN n USING (id)),
    p AS (SELECT a.id AS sample_id, c.id AS train_id, round(sum(a.w * c.w), 9) AS s FROM t a JOIN t c ON a.key = c.key AND a.id % 50 = 0 AND a.id <> c.id GROUP BY ALL)
    SELECT sample_id, train_id, round(s, 6) AS similarity, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY s DESC, train_id) AS r FROM p) WHERE r <= 5"""


def block_join(spark: SparkSession, d: str) -> DataFrame:
    """Parts that share brand and type, by the Jaccard of the words of their names."""
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_brand", "p_type", features.token_set(F.col("p_name"), " ").alias("w"))
    edges = C.block_join(rows.where("id % 50 = 0"), rows, ["p_brand", "p_type"], K.jaccard(F.col("a_w"), F.col("b_w")))
    return edges.withColumn("similarity", F.round("similarity", 6))


QUERIES["block_join"] = block_join
ORACLES["block_join"] = """
    WITH t AS (SELECT p_partkey AS id, p_brand, p_type, list_distinct(string_split(p_name, ' ')) AS w FROM part)
    SELECT a.id AS sample_id, b.id AS train_id, round(len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))), 6) AS similarity
    FROM t a JOIN t b ON a.id % 50 = 0 AND a.id <> b.id AND a.p_brand IS NOT DISTINCT FROM b.p_brand AND a.p_type IS NOT DISTINCT FROM b.p_type"""


def filtered_search(spark: SparkSession, d: str) -> DataFrame:
    """Nearest vectors of the same label only (P13, T10): the attribute is part of the join."""
    rows = _embeddings(spark, d)
    edges = C.block_join(rows.where("id % 50 = 0"), rows, ["label"], K.spectral_angle(F.col("a_v"), F.col("b_v")))
    return E.top_k(edges, 5, 10).withColumn("similarity", F.round("similarity", 6))


QUERIES["filtered_search"] = filtered_search
ORACLES["filtered_search"] = f"""
    WITH t AS ({_EMBED}), p AS (SELECT a.id AS sample_id, b.id AS train_id, round((list_cosine_similarity(a.v, b.v) + 1) / 2, 10) AS s FROM t a JOIN t b ON a.id % 50 = 0 AND a.id <> b.id AND a.label = b.label)
    SELECT sample_id, train_id, round(s, 6) AS similarity, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY s DESC, train_id) AS r FROM p) WHERE r <= 5"""


def _lsh(candidates: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = _embeddings(spark, d).select("id", "v")
        queries = rows.where("id % 50 = 0")
        edges = C.verify(candidates(queries, rows), queries, rows, "v", K.spectral_angle)
        return E.top_k(C.fallback_exact(edges, queries, rows, "v", K.spectral_angle), 10, 10).withColumn("similarity", F.round("similarity", 6))

    return run


QUERIES["hyperplane_search"] = _lsh(lambda q, t: C.hyperplane_candidates(q, t, "v", 64, 4, 24))
QUERIES["projection_search"] = _lsh(lambda q, t: C.projection_candidates(q, t, "v", 64, 24.0, 3, 12))
QUERIES["ivf_search"] = lambda s, d: C.ivf_top_k(_embeddings(s, d).where("id % 50 = 0"), _embeddings(s, d), "v", 8, 7, 10).withColumn("similarity", F.round("similarity", 6))


def pivot_radius(spark: SparkSession, d: str) -> DataFrame:
    """Vectors within a Euclidean radius by pivots and the triangle inequality (T20, T25), exact."""
    rows = _embeddings(spark, d).select("id", "v")
    queries = rows.where("id % 50 = 0")
    pivots = [[3.0 * (j == i) for j in range(64)] for i in range(6)]
    near = C.verify(C.pivot_candidates(queries, rows, "v", pivots, 9.5), queries, rows, "v", K.euclidean)
    return near.where("similarity <= 9.5").select("sample_id", "train_id", F.round("similarity", 6).alias("distance"))


QUERIES["pivot_radius"] = pivot_radius
ORACLES["pivot_radius"] = f"""WITH t AS ({_EMBED}) SELECT a.id AS sample_id, b.id AS train_id, round(list_distance(a.v, b.v), 6) AS distance FROM t a JOIN t b
    ON a.id % 50 = 0 AND a.id <> b.id AND list_distance(a.v, b.v) <= 9.5"""


def late_interaction(spark: SparkSession, d: str) -> DataFrame:
    rows = _embeddings(spark, d).select("id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.slice("v", i * 16 + 1, F.lit(16)))).alias("part", "v"))
    return E.top_k(C.late_interaction(rows.where("id % 50 = 0"), rows), 5, 9).withColumn("similarity", F.round("similarity", 6))


QUERIES["late_interaction"] = late_interaction
ORACLES["late_interaction"] = f"""
    WITH t AS (SELECT id, k AS part, v[k * 16 + 1:k * 16 + 16] AS v FROM ({_EMBED}), range(4) r(k)),
    m AS (SELECT a.id AS sample_id, b.id AS train_id, a.part, max(list_cosine_similarity(a.v, b.v)) AS m FROM t a JOIN t b ON a.id % 50 = 0 AND a.id <> b.id GROUP BY ALL),
    p AS (SELECT sample_id, train_id, round(sum(m), 9) AS s FROM m GROUP BY ALL)
    SELECT sample_id, train_id, round(s, 6) AS similarity, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY s DESC, train_id) AS r FROM p) WHERE r <= 5"""


def inner_product_search(spark: SparkSession, d: str) -> DataFrame:
    """Maximum inner product through the cosine of the transformed vectors."""
    rows = _embeddings(spark, d).select("id", "v")
    largest = rows.agg(F.max(K.norm(F.col("v")))).first()[0] or 0.0
    queries = C.inner_product_transform(rows.where("id % 50 = 0"), "v", largest, True)
    return E.dense_top_k(queries, C.inner_product_transform(rows, "v", largest, False), "id", "id", "v", 10).select("sample_id", "train_id", "rank")


QUERIES["inner_product_search"] = inner_product_search
ORACLES["inner_product_search"] = f"""
    WITH t AS ({_EMBED}), p AS (SELECT a.id AS sample_id, b.id AS train_id, list_dot_product(a.v, b.v) AS s FROM t a JOIN t b ON a.id % 50 = 0 AND a.id <> b.id)
    SELECT sample_id, train_id, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY s DESC, train_id) AS r FROM p) WHERE r <= 10"""


def fourier_features(spark: SparkSession, d: str) -> DataFrame:
    rows = _embeddings(spark, d).select("id", "v")
    return C.kernel_search(rows.where("id % 50 = 0"), rows, "v", 64, 10, 0.01, 400).withColumn("similarity", F.round("similarity", 6))


QUERIES["fourier_features"] = fourier_features
ORACLES["fourier_features"] = f"""
    WITH t AS ({_EMBED}), p AS (SELECT a.id AS sample_id, b.id AS train_id, round(exp(-0.01 * pow(list_distance(a.v, b.v), 2)), 10) AS s FROM t a JOIN t b ON a.id % 50 = 0 AND a.id <> b.id)
    SELECT sample_id, train_id, round(s, 6) AS similarity, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY s DESC, train_id) AS r FROM p) WHERE r <= 10"""


def frac_minhash_links(spark: SparkSession, d: str) -> DataFrame:
    """Near-duplicates over a quarter of all shingles by hash (T11): an estimate by design."""
    members, classes = _shingles(spark, d)
    sketch = C.frac_minhash(classes, 4).where(F.size("items") > 0)
    return C.class_links(members, C.prefix_jaccard(sketch, 0.8)).withColumnRenamed("id", "doc_id")


QUERIES["frac_minhash_links"] = frac_minhash_links
