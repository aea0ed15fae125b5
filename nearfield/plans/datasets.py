"""Typed features over the data folder's tables, for the queries: a DataFrame and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.plans.tables import table

#: Event types in their fixed order of histogram bins.
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


def user_histograms(spark: SparkSession, d: str) -> DataFrame:
    counts = [F.count_if(F.col("event_type") == e).cast("double") for e in EVENT_TYPES]
    return table(spark, d, "events").groupBy(F.col("user_id").alias("id")).agg(F.array(*counts).alias("h"))


HISTOGRAM_SQL = "SELECT user_id AS id, [" + ", ".join(f"CAST(count(*) FILTER (event_type = '{e}') AS DOUBLE)" for e in EVENT_TYPES) + "] AS h FROM events GROUP BY user_id"


def user_bits(spark: SparkSession, d: str) -> DataFrame:
    bit = F.array_position(F.array(*map(F.lit, EVENT_TYPES)), F.col("event_type")).cast("int") * 24 + F.hour("ts")
    return table(spark, d, "events").groupBy(F.col("user_id").alias("id")).agg(F.array_sort(F.collect_set(bit)).alias("b"))  # at most 120 bits


BITS_SQL = "SELECT user_id AS id, list_sort(list_distinct(list(list_position([" + ", ".join(f"'{e}'" for e in EVENT_TYPES) + "], event_type) * 24 + hour(ts)))) AS b FROM events GROUP BY user_id"


def user_sequences(spark: SparkSession, d: str) -> DataFrame:
    """Event types and values of each user in the order of time (one user's events of the period)."""
    ordered = F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type", "value")))
    rows = table(spark, d, "events").groupBy(F.col("user_id").alias("id")).agg(ordered.alias("e"))
    return rows.select("id", F.col("e.event_type").alias("types"), F.col("e.value").alias("series"))


def customer_brands(spark: SparkSession, d: str) -> DataFrame:
    """``id, key, weight``: quantity that each customer bought of each brand."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    return (
        lines.join(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
        .join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
        .groupBy(F.col("o_custkey").alias("id"), F.col("p_brand").alias("key"))
        .agg(F.sum("l_quantity").alias("weight"))
    )


BRANDS_SQL = "SELECT o_custkey AS id, p_brand AS key, sum(l_quantity) AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ALL"


def supplier_peaks(spark: SparkSession, d: str) -> DataFrame:
    """``id, mz, intensity``: price (in thousands) and quantity of each line of a supplier."""
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("id"), (F.col("l_extendedprice") / 1000).alias("mz"), F.col("l_quantity").alias("intensity"))


PEAKS_SQL = "SELECT l_suppkey AS id, l_extendedprice / 1000 AS mz, l_quantity AS intensity FROM lineitem"
