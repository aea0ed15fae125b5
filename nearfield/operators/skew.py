"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot when it holds more than this share of all rows, so there are at most 1 / share of them.
HOT_SHARE = 0.001
#: ... and at least this many rows; fewer never hurt a task.
HOT_ROWS = 50_000
#: Pieces into which a hot key is cut.
SALTS = 32


def hot_keys(df: DataFrame, key: str, total: int, rows: int = HOT_ROWS, share: float = HOT_SHARE) -> DataFrame:
    """Keys with more than ``max(rows, share * total)`` rows: never more than ``1 / share`` keys.

    Counts are exact and combined on the map side.  Null keys are not counted.  With no more than ``rows``
    rows in all there is nothing to count.
    """
    if total <= rows:
        none = df.sparkSession.createDataFrame([], df.select(key).schema)
        none._nearfield_none = True
        return none
    return df.where(F.col(key).isNotNull()).groupBy(key).count().where(F.col("count") > max(rows, share * total)).select(key)


def salt_of(*columns: Column, salts: int = SALTS) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(salts)).cast("int")


def salted_join(
    big: DataFrame, small: DataFrame, key: str, hot: DataFrame, spread: str, how: str = "inner", salts: int = SALTS
) -> DataFrame:
    """``big JOIN small USING (key)`` where ``small`` has one row a key and ``big`` may be skewed.

    Rows of ``big`` with a hot key are spread over ``salts`` pieces by the hash of column ``spread``;
    the matching rows of ``small`` are copied to each piece.  ``hot`` comes from :func:`hot_keys` and has
    at most 1000 rows, which is why it may be broadcast.  ``how`` is inner or left.
    """
    if getattr(hot, "_nearfield_none", False):
        return big.join(small, key, how)
    flag = hot.select(F.col(key).alias("__hot"))
    left = big.join(F.broadcast(flag), F.col(key) == F.col("__hot"), "left").withColumn(
        "__salt", F.when(F.col("__hot").isNotNull(), salt_of(F.col(spread), salts=salts)).otherwise(F.lit(0))
    )
    right = (
        small.join(F.broadcast(flag), F.col(key) == F.col("__hot"), "left")
        .withColumn(
            "__salt",
            F.explode(F.when(F.col("__hot").isNotNull(), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))),
        )
        .drop("__hot")
    )
    return left.drop("__hot").join(right, [key, "__salt"], how).drop("__salt")


class KeyCounts:
    """The exact counts of a key, written down once: which keys are cut into blocks of ``size``, and which are hot."""

    def __init__(self, df: DataFrame, key: str, size: int, workspace):
        n = F.col("__n")
        counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("__n"))
        self.table = workspace.save(counts, "counts", total=F.coalesce(F.sum(n), F.lit(0)), most=F.coalesce(F.max(n), F.lit(0)))
        self.key, found = key, self.table._nearfield_metrics
        self.cut = found["most"] > size
        self.parts = self.table.where(n > size).select(key, F.ceil(n / F.lit(size)).cast("int").alias("__parts"))
        self.hot = self.table.where(n > max(HOT_ROWS, HOT_SHARE * found["total"])).select(key)  # at most 1000
        if found["most"] <= HOT_ROWS:
            self.hot._nearfield_none = True

    def with_parts(self, df: DataFrame, by: str, of: "KeyCounts | None" = None) -> DataFrame:
        """``df`` with ``__parts``, the number of blocks of its key in this table or in that ``of`` the other side."""
        other = of or self
        if not other.cut:
            return df.withColumn("__parts", F.lit(1))
        return salted_join(df, other.parts, self.key, self.hot, by, "left").withColumn("__parts", F.coalesce("__parts", F.lit(1)))


def _part(by: str) -> Column:
    return F.pmod(F.xxhash64(by), F.col("__parts")).cast("int")


def meet(df: DataFrame, key: str, by: str, columns: list[str], size: int, workspace) -> DataFrame:
    """Every unordered pair of rows that share a key, as ``{column}_1, {column}_2``, once for each key shared.

    A self-join in which block meets block, so that no task holds all rows of a key.  ``by`` must differ
    between the rows of a key; ``columns`` holds it.  Which row of a pair comes first is not defined.
    Rows whose key no other row has are left out first.  ``df`` is read twice, so write it down if it is costly.
    """
    counts = KeyCounts(df, key, size, workspace)
    shared = counts.table.where(F.col("__n") > 1).select(key, F.ceil(F.col("__n") / F.lit(size)).cast("int").alias("__parts"))
    blocks = salted_join(df.where(F.col(key).isNotNull()), shared, key, counts.hot, by).withColumn("__part", _part(by))
    part, last = F.col("__part"), F.col("__parts") - 1
    left = blocks.select(F.col(key).alias("__k"), *[F.col(c).alias(f"{c}_1") for c in columns], part.alias("__i"), F.explode(F.sequence(part, last)).alias("__j"))
    right = blocks.select(F.col(key).alias("__k"), *[F.col(c).alias(f"{c}_2") for c in columns], part.alias("__j"), F.explode(F.sequence(F.lit(0), part)).alias("__i"))
    pairs = left.join(right, ["__k", "__i", "__j"]).where((F.col("__i") < F.col("__j")) | (F.col(f"{by}_1") < F.col(f"{by}_2")))
    return pairs.drop("__k", "__i", "__j")


def facing(left: DataFrame, right: DataFrame, key: str, left_by: str, right_by: str, size: int, workspace) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``__i`` and ``__j``: rows of a key that are to meet share both, and no block has more than about ``size`` rows of a side.

    A row comes once for each block that the other side has of its key.  Null keys are left out.
    """
    a, b = KeyCounts(left, key, size, workspace), KeyCounts(right, key, size, workspace)
    sides = []
    for df, by, mine, theirs, own, other in ((left, left_by, a, b, "__i", "__j"), (right, right_by, b, a, "__j", "__i")):
        placed = mine.with_parts(df.where(F.col(key).isNotNull()), by).withColumn(own, _part(by)).drop("__parts")
        # every row meets all blocks that the other side has of its key
        placed = mine.with_parts(placed, by, theirs).withColumn(other, F.explode(F.sequence(F.lit(0), F.col("__parts") - 1)))
        sides.append(placed.drop("__parts"))
    return sides[0], sides[1]


def meet_two(left: DataFrame, right: DataFrame, key: str, left_by: str, right_by: str, size: int, workspace) -> DataFrame:
    """``left JOIN right USING (key)`` without the key, where both sides may have many rows of it: blocks meet blocks.

    The other columns of the two sides must have different names.  Null keys match nothing.
    """
    a, b = facing(left, right, key, left_by, right_by, size, workspace)
    return a.join(b, [key, "__i", "__j"]).drop("__i", "__j", key)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """The rows over enough tasks for Python work on each row: shuffles only a table that comes in too few splits.

    The splits are those of the input; a frame that holds a shuffle is not run to find its number of tasks,
    which would be that of the moment only, but dealt anew.
    """
    wanted = 2 * df.sparkSession.sparkContext.defaultParallelism
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return df.repartition(wanted, *keys)
    return df if df.rdd.getNumPartitions() >= wanted else df.repartition(wanted, *keys)
