"""Parsers from delimited texts and wide tables to the typed columns that the kernels take."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def strip(text: Column) -> Column:
    """All outer white space off (the built-in trim only takes spaces)."""
    return F.regexp_replace(text, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def token_set(text: Column, delimiter: str = ";", lower: bool = False) -> Column:
    """Distinct trimmed tokens, empty ones dropped; null or blank gives an empty set."""
    source = F.coalesce(F.lower(text) if lower else text, F.lit(""))
    return F.array_distinct(F.filter(F.transform(F.split(source, re.escape(delimiter)), strip), lambda x: x != ""))


def weighted_set(text: Column) -> Column:
    """``k:v;k:v`` to a map: a missing weight is 1, repeated keys add up, weights <= 0 are dropped."""
    entries = F.transform(F.filter(F.split(F.coalesce(text, F.lit("")), ";"), lambda x: strip(x) != ""), lambda x: F.split(x, ":"))
    keys = F.transform(entries, lambda e: strip(e[0]))
    weights = F.transform(entries, lambda e: F.when(F.size(e) < 2, F.lit(1.0)).otherwise(F.get(e, F.lit(1)).try_cast("double")))
    pairs = F.filter(F.arrays_zip(keys.alias("k"), weights.alias("w")), lambda p: p["w"] > 0)
    names = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return F.map_from_arrays(names, F.transform(names, lambda k: F.aggregate(F.filter(pairs, lambda p: p["k"] == k), F.lit(0.0), lambda a, p: a + p["w"])))


def peaks(text: Column) -> Column:
    """``mz:intensity;...`` to an array of structs."""
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), ";"), lambda x: strip(x) != "")
    return F.transform(parts, lambda p: F.struct(F.split(p, ":")[0].cast("double").alias("mz"), F.split(p, ":")[1].cast("double").alias("intensity")))


def points(text: Column) -> Column:
    """``x:y:z;...`` to an array of points of any dimension."""
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), ";"), lambda x: strip(x) != "")
    return F.transform(parts, lambda p: F.transform(F.split(p, ":"), lambda x: x.cast("double")))


def numbers(text: Column, delimiter: str = ";") -> Column:
    return F.transform(F.filter(F.split(F.coalesce(text, F.lit("")), re.escape(delimiter)), lambda x: strip(x) != ""), lambda x: x.cast("double"))


def bit_set(text: Column) -> Column:
    """``0101`` or ``;``-separated places to the array of set bits."""
    places = F.filter(F.transform(F.split(text, ";"), lambda x: x.try_cast("int")), lambda x: x.isNotNull())
    chars = F.filter(F.transform(F.split(text, ""), lambda x, i: F.when(x == "1", i)), lambda x: x.isNotNull())
    return F.when(text.rlike("^[01]+$"), chars).otherwise(places)


def vector(df: DataFrame, columns: list[str] | None = None, prefix: str | None = None, ids: tuple[str, ...] = ()) -> Column:
    """Columns as one vector: an explicit list, else those with the prefix, else all but the ids.

    Missing or no columns raise ``ValueError``.
    """
    if columns:
        missing = [c for c in columns if c not in df.columns]
        if missing:
            raise ValueError(f"missing columns {missing}")
        chosen = columns
    elif prefix:
        chosen = [c for c in df.columns if c.startswith(prefix)]
    else:
        chosen = [c for c in df.columns if c not in ids]
    if not chosen:
        raise ValueError("no feature column")
    return F.array(*[F.col(c).cast("double") for c in chosen])


def word_shingles(text: Column, n: int = 5) -> Column:
    """Distinct n-word shingles of the lower-cased words; texts of fewer words give none."""
    # the words are bound as a lambda variable, else they would be extracted again for every shingle
    words = F.array(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))

    def cut(ws: Column) -> Column:
        shingles = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(ws) - n + 1)), lambda i: F.array_join(F.slice(ws, i, n), " "))
        return F.when(F.size(ws) < n, F.array().cast("array<string>")).otherwise(F.array_distinct(shingles))

    return F.get(F.transform(words, cut), F.lit(0))


def row_ids(df: DataFrame, prefix: str, order: list[str], width: int = 5) -> DataFrame:
    """Adds ``sample_id`` = prefix and the zero-padded place in an explicit order, from 0.

    The places come from a distributed sort: ranks within range partitions plus the counts before them.
    """
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id())
    counts = {r["__p"]: (r["n"], r["lo"]) for r in parts.groupBy("__p").agg(F.count("*").alias("n"), F.min("__i").alias("lo")).collect()}  # one row a partition
    start, rows = 0, []
    for p in sorted(counts):
        rows.append((p, start - counts[p][1]))
        start += counts[p][0]
    offsets = df.sparkSession.createDataFrame(rows, "__p int, __o bigint")
    number = F.lpad((F.col("__i") + F.col("__o")).cast("string"), width, "0")
    wide = F.when((F.col("__i") + F.col("__o")) >= 10**width, (F.col("__i") + F.col("__o")).cast("string")).otherwise(number)
    return parts.join(F.broadcast(offsets), "__p").withColumn("sample_id", F.concat(F.lit(prefix), wide)).drop("__p", "__i", "__o")


#: Rows that one task of a distributed running sum holds.
RUNNING_ROWS = 500_000


def running(df: DataFrame, order: list, sums: dict, workspace) -> DataFrame:
    """``df`` with running sums in an order over all rows: ``sums`` maps a new column to the Column that is summed.

    The rows are sorted by range over many tasks and written down; a task's sums start from those of the
    tasks before it, which are one row a task.
    """
    columns = df.columns
    keyed = df.select("*", *[v.alias(f"__running_v_{k}") for k, v in sums.items()])
    rows = keyed.count()
    parts = max(1, -(-rows // RUNNING_ROWS))
    placed = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__running_part", F.spark_partition_id())
    placed = workspace.save(placed, "ordered")
    totals = sorted(placed.groupBy("__running_part").agg(*[F.sum(f"__running_v_{k}").alias(k) for k in sums]).collect(), key=lambda r: r["__running_part"])  # one row a task
    whole = {k: dict(placed.dtypes)[f"__running_v_{k}"] in ("int", "bigint") for k in sums}
    starts, at = [], {k: 0 if whole[k] else 0.0 for k in sums}
    for r in totals:
        starts.append((r["__running_part"], *at.values()))
        at = {k: v + (r[k] or 0) for k, v in at.items()}
    kinds = {k: "bigint" if whole[k] else "double" for k in sums}
    offsets = df.sparkSession.createDataFrame(starts, "__running_part int" + "".join(f", `__running_s_{k}` {kinds[k]}" for k in sums))
    window = Window.partitionBy("__running_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = placed.join(F.broadcast(offsets), "__running_part")
    return joined.select(*columns, *[(F.sum(f"__running_v_{k}").over(window) + F.col(f"__running_s_{k}")).alias(k) for k in sums])
