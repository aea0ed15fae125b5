"""Readers with explicit contracts.  Ids, codes and fingerprints are always read as text: no inference."""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.schema import require


def read_csv(spark: SparkSession, path: str, required: list[str] | tuple[str, ...] = (), doubles: tuple[str, ...] = ()) -> DataFrame:
    """A CSV with header, every column text but ``doubles`` (S1, S2); a missing column raises ``ValueError``.

    Texts that are no numbers become null in ``doubles``.
    """
    df = require(spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"'), required, path)
    for c in doubles:
        if c in df.columns:
            df = df.withColumn(c, F.col(c).try_cast("double"))
    return df


def read_dataset(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """A data set that must be an existing, non-empty ``.csv`` with the required columns (S3)."""
    if not path.lower().endswith(".csv"):
        raise ValueError("only .csv data sets are supported")
    if "://" not in path and not Path(path).exists():
        raise FileNotFoundError(path)
    df = read_csv(spark, path, required)
    if df.isEmpty():
        raise ValueError(f"{path} is empty")
    return df


def read_with(parse: Callable[[SparkSession, str], DataFrame], spark: SparkSession, path: str, id_col: str) -> DataFrame:
    """A user's parser (S4): its rows with ``sample_id`` and their rank by id (from 0) as ``index``."""
    df = require(parse(spark, path), [id_col])
    ids = df.select(F.col(id_col).cast("string").alias("sample_id")).distinct()
    from nearfield.functions.features import row_ids

    ranked = row_ids(ids.withColumnRenamed("sample_id", "id"), "", ["id"], 1).select(F.col("id").alias("sample_id"), F.col("sample_id").cast("bigint").alias("index"))
    return df.withColumn("sample_id", F.col(id_col).cast("string")).join(ranked, "sample_id")


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """An edge table from parquet or CSV."""
    if path.lower().endswith(".csv"):
        return read_csv(spark, path, ["sample_id", "train_id", "similarity"], ("similarity",))
    return require(spark.read.parquet(path), ["sample_id", "train_id", "similarity"], path)


def read_edge_chunks(spark: SparkSession, path: str, expected: int | None = None) -> DataFrame:
    """Edges ``i, j, w`` of all chunks (S6, G2); another number of rows than ``expected`` raises ``ValueError``."""
    edges = require(spark.read.parquet(path), ["i", "j", "w"], path).select("i", "j", "w")
    if expected is not None and edges.count() != expected:
        raise ValueError(f"{path} does not hold {expected} edges")
    return edges


def read_flattened(df: DataFrame, n: int) -> DataFrame:
    """A flattened upper triangle (S5): rows ``place, w`` of the pairs (0,1), (0,2), .., (1,2), .. of n nodes as edges ``i, j, w``.

    The row of a place follows from the triangle's root, so no pair is listed to find it.
    """
    p, m = F.col("place").cast("double"), F.lit(2.0 * n - 1)
    i = F.floor((m - F.sqrt(m * m - 8 * p)) / 2).cast("bigint")
    start = lambda k: k * F.lit(n) - F.shiftright(k * (k + 1), 1)
    # the root of a large number may be off by one
    i = F.when(start(i) > F.col("place"), i - 1).when(start(i + 1) <= F.col("place"), i + 1).otherwise(i)
    return df.select(i.alias("i"), "place", "w").select("i", (F.col("place") - start(F.col("i")) + F.col("i") + 1).cast("bigint").alias("j"), "w")


def read_json_entries(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document a file, as rows."""
    return spark.read.json(path, multiLine=True)


def load_json(path: str) -> dict | list:
    return json.loads(Path(path).read_text(encoding="utf-8"))


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    """Saved splits with their ``param`` and ``repeat``."""
    return spark.read.parquet(path)
