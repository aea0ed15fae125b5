"""Queries for nested records (problem 1)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.operators import nested
from nearfield.plans.tables import table
from nearfield.storage import Workspace

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    tables = nested.flatten(table(spark, d, "provenance_deliveries"), Workspace(spark, "p1"))
    return nested.checkpoint_sources(tables)


def _flat(tag: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return nested.flatten(table(spark, d, "provenance_deliveries"), Workspace(spark, f"p1-{tag}"))[tag]

    return run


QUERIES: dict[str, Query] = {
    "p1_found": p1_found,
    **{f"p1_{tag}s": _flat(tag) for tag in ("finding", "model", "checkpoint", "checksum", "source", "reject")},
}


def p1_counts(spark: SparkSession, d: str) -> DataFrame:
    """Findings, models and checkpoints of each delivery."""
    tables = nested.flatten(table(spark, d, "provenance_deliveries"), Workspace(spark, "p1-counts"))
    tags = ("finding", "model", "checkpoint")
    out = None
    for tag in tags:
        rows = tables[tag].select("delivery_id", F.lit(tag).alias("tag"))
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("delivery_id").agg(*[F.count_if(F.col("tag") == tag).alias(f"{tag}s") for tag in tags])


QUERIES["p1_counts"] = p1_counts
# Every row is a value with what is expected of it; a text that is JSON is opened in place, a list gives its entries.
_WALK = r"""
    WITH RECURSIVE w AS (
        SELECT DISTINCT delivery_id, 'root' AS stage, NULL::VARCHAR AS fid, NULL::INT AS model_no, NULL::VARCHAR AS mode, '' AS path, CAST(payload AS JSON) AS v FROM provenance_deliveries WHERE json_valid(payload)
        UNION ALL
        SELECT delivery_id, n.stage, n.fid, n.model_no, n.mode, n.path, n.v FROM (
            SELECT delivery_id, unnest(CASE
                WHEN inner_text IS NOT NULL THEN [{'stage': stage, 'fid': fid, 'model_no': model_no, 'mode': mode, 'path': path, 'v': CAST(inner_text AS JSON)}]
                WHEN stage = 'root' AND kind = 'OBJECT' THEN [{'stage': 'records', 'fid': fid, 'model_no': model_no, 'mode': mode, 'path': '', 'v': v->'provenance'}]
                WHEN stage = 'record' AND kind = 'OBJECT' THEN [{'stage': 'models', 'fid': v->>'finding_id', 'model_no': model_no, 'mode': mode, 'path': '', 'v': v->'model_source'}]
                WHEN stage = 'model' AND kind = 'OBJECT' THEN [{'stage': 'points', 'fid': fid, 'model_no': CAST(path AS INT), 'mode': coalesce(v->>'execution_mode', ''), 'path': '', 'v': v->'weights_or_checkpoint'}]
                WHEN stage = 'point' AND kind = 'OBJECT' THEN [{'stage': 'points', 'fid': fid, 'model_no': model_no, 'mode': mode, 'path': path, 'v': v->'derived_from'}]
                WHEN stage = 'point' AND kind = 'ARRAY' THEN [{'stage': 'points', 'fid': fid, 'model_no': model_no, 'mode': mode, 'path': path, 'v': v}]
                WHEN stage IN ('records', 'models', 'points') AND kind = 'ARRAY' THEN list_transform(range(json_array_length(v)::BIGINT), lambda i: {'stage': rtrim(stage, 's'), 'fid': fid, 'model_no': model_no, 'mode': mode,
                    'path': CASE WHEN stage = 'points' AND path <> '' THEN path || '.' || i ELSE CAST(i AS VARCHAR) END, 'v': json_extract(v, '$[' || i || ']')})
                WHEN stage IN ('records', 'models', 'points') AND kind <> 'NULL' THEN [{'stage': rtrim(stage, 's'), 'fid': fid, 'model_no': model_no, 'mode': mode, 'path': CASE WHEN stage = 'points' AND path <> '' THEN path || '.0' ELSE '0' END, 'v': v}]
                ELSE [] END) AS n
            FROM (SELECT *, json_type(v) AS kind, CASE WHEN json_type(v) = 'VARCHAR' AND regexp_matches(v->>'$', '^\s*[\[{]') AND json_valid(v->>'$') THEN v->>'$' END AS inner_text FROM w WHERE v IS NOT NULL)))"""
_OPENED = r"json_type(v) = 'VARCHAR' AND regexp_matches(v->>'$', '^\s*[\[{]') AND json_valid(v->>'$')"
ORACLES: dict[str, str] = {
    "p1_found": _WALK
    + rf"""
    SELECT DISTINCT delivery_id, fid AS finding_id, model_no, mode AS execution_mode, path AS checkpoint_path, source AS source_url_or_repo FROM (
        SELECT *, CASE json_type(v) WHEN 'OBJECT' THEN v->>'source_url_or_repo' WHEN 'ARRAY' THEN NULL WHEN 'NULL' THEN NULL ELSE v->>'$' END AS source, {_OPENED} AS opened FROM w WHERE stage = 'point')
    WHERE NOT opened AND regexp_matches(source, '\S')""",
    "p1_counts": _WALK
    + rf"""
    SELECT delivery_id, count(*) FILTER (stage = 'record') AS findings, count(*) FILTER (stage = 'model') AS models, count(*) FILTER (stage = 'point') AS checkpoints FROM w
    WHERE (stage IN ('record', 'model') AND json_type(v) = 'OBJECT') OR (stage = 'point' AND json_type(v) NOT IN ('ARRAY', 'NULL') AND NOT ({_OPENED})) GROUP BY delivery_id""",
}
