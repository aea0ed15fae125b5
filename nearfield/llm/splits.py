"""Splits that keep related records together, kept up to date batch by batch.

The state is a persisted table ``record_id, component, split, status``.  A batch brings ties between
records (old and new).  Components are merged by hooking each to its smallest neighbour and pointer
jumping along the hooks until every component knows its root; only component ids travel in the loop,
never records.  Then

* a component that held records before keeps their split;
* a component with records of two splits is a *conflicting merge*: it is quarantined (status
  ``quarantined``, no split) until somebody decides, and nothing else moves;
* new components fill the splits that are furthest below their target.

The component id is the smallest record id in it.  ``save_state`` and ``load_state`` keep the table in
numbered versions below a durable path, so that batches may be days and applications apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nearfield.operators.graph import merge_components
from nearfield.operators.skew import hot_keys, salted_join
from nearfield.storage import Workspace, metric

STATE = "record_id string, component string, split string, status string"
#: A new component above this share of the records is placed one by one: there are at most 1 / share.
LARGE_SHARE = 0.001
#: Fewest and most buckets of the prefix sum over all other new components, and records a bucket aims at.
SUM_BUCKETS = (1024, 65_536)
BUCKET_RECORDS = 200_000


def empty_state(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], STATE)


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete versions below a path."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return []
    names = [f.getPath() for f in fs.listStatus(where)]
    done = [n for n in names if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(n, "_SUCCESS"))]
    return sorted(int(n.getName()[1:]) for n in done if n.getName()[:1] == "v" and n.getName()[1:].isdigit())


def save_state(state: DataFrame, path: str) -> int:
    """Writes the state as the next version below ``path``, a durable folder, and returns its number.

    A version counts once it is complete; one that a failed job left half written is never read, and its
    number is not used again.
    """
    spark = state.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    begun = [f.getPath().getName() for f in fs.listStatus(where)] if fs.exists(where) else []
    number = max([int(n[1:]) for n in begun if n[:1] == "v" and n[1:].isdigit()], default=0) + 1
    state.select("record_id", "component", "split", "status").write.mode("error").parquet(f"{path}/v{number:08d}")
    return number


def load_state(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The state of a version, by default of the last complete one; an empty state where there is none yet."""
    known = _versions(spark, path)
    if version is None and not known:
        return empty_state(spark)
    if version is not None and version not in known:
        raise ValueError(f"no complete version {version} below {path}")
    return spark.read.schema(STATE).parquet(f"{path}/v{version or known[-1]:08d}")


def update_saved(path: str, records: DataFrame, edges: DataFrame, targets: DataFrame, workspace: Workspace) -> tuple[DataFrame, int]:
    """One batch on the persisted table: loads the last version, updates it and saves the next; the state and its version."""
    spark = records.sparkSession
    number = save_state(update(load_state(spark, path), records, edges, targets, workspace), path)
    return load_state(spark, path, number), number


def tie_keys(assignments: DataFrame) -> DataFrame:
    """``record_id, key``: the keys that tie records of ``component_assignments``.

    A key is the run and its non-negative component id, or a compound id of the form CPD-digits after
    trimming, whatever its case.  Null ids, negative components and words that name nothing give no key.
    """
    compound = F.upper(F.regexp_replace("compound_id", r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    keys = F.array(
        F.when((F.col("component_id") >= 0) & F.col("run_id").isNotNull(), F.concat(F.lit("run:"), F.col("component_id").cast("string"), F.lit(":"), "run_id")),
        F.when(compound.rlike(r"^CPD-[0-9]+$"), F.concat(F.lit("cpd:"), compound)),
    )
    rows = assignments.where(F.col("sample_id").isNotNull()).select(F.col("sample_id").alias("record_id"), F.explode(F.array_compact(keys)).alias("key"))
    return rows.distinct()


def tie_edges(keys: DataFrame) -> DataFrame:
    """``a, b``: every record tied to the smallest record of each of its keys (a star, never all pairs).

    The smallest record is a map-side combined aggregate; the join back is salted for keys that hold a
    large share of the rows.
    """
    hubs = keys.groupBy("key").agg(F.min("record_id").alias("a"))
    hot = hot_keys(keys, "key", keys.count())
    return salted_join(keys, hubs, "key", hot, "record_id").where(F.col("record_id") != F.col("a")).select("a", F.col("record_id").alias("b")).distinct()


def _fill(new: DataFrame, held: dict[str, int], targets: dict[str, float], total: int, workspace: Workspace) -> DataFrame:
    """``component, split`` for new components ``component, n`` such that the splits near their targets.

    Large components (at most 1 / LARGE_SHARE of them) go one by one, largest first, to the split that
    lacks most.  The others stand in hash order; the running sum of their sizes, a prefix sum over
    buckets and then within each, is cut where one split is full and the next begins.
    """
    spark = new.sparkSession
    lack = {s: f * total - held.get(s, 0) for s, f in targets.items()}
    limit = max(1.0, LARGE_SHARE * total)
    large = new.where(F.col("n") > limit).orderBy(F.desc("n"), "component").collect()
    placed = []
    for row in large:
        split = max(lack, key=lambda s: (lack[s], s))
        lack[split] -= row["n"]
        placed.append((row["component"], split))
    first = spark.createDataFrame(placed, "component string, split string")

    buckets = int(min(SUM_BUCKETS[1], max(SUM_BUCKETS[0], total // BUCKET_RECORDS)))
    small = new.where(F.col("n") <= limit).withColumn("h", F.xxhash64(F.lit("fill"), "component"))
    small = small.withColumn("bucket", F.pmod(F.shiftright("h", 20), F.lit(buckets)))
    sums = {r["bucket"]: r["n"] for r in small.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}
    rest = sum(sums.values())
    open_ = {s: max(0.0, v) for s, v in lack.items()}
    scale = rest / (sum(open_.values()) or 1.0)
    starts, at = [], 0
    for bucket in sorted(sums):
        starts.append((bucket, at))
        at += sums[bucket]
    offsets = spark.createDataFrame(starts, "bucket bigint, start bigint")
    order = Window.partitionBy("bucket").orderBy("h", "component").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    middle = F.col("start") + F.sum("n").over(order) - F.col("n") / 2
    choice, edge = F.lit(max(targets)), rest * (1 + 1e-9)
    for split in sorted(open_):  # from the last piece to the first
        choice = F.when(middle <= edge, F.lit(split)).otherwise(choice) if edge > 0 else choice
        edge -= open_[split] * scale
    second = small.join(F.broadcast(offsets), "bucket").select("component", choice.alias("split"))  # one row a bucket
    return first.unionByName(second)


def update(state: DataFrame, records: DataFrame, edges: DataFrame, targets: DataFrame, workspace: Workspace) -> DataFrame:
    """The next state after a batch: ``records`` (``record_id``) and ``edges`` (``a, b``).

    Records of the state and of the batch are the result; ids in edges that are neither are ignored only
    if null.  ``targets`` has ``split, fraction`` (a handful of rows); without any usable row new components
    stay without a split.  Repeated records and edges count
    once; an empty batch returns the state unchanged.
    """
    goal = {r["split"]: float(r["fraction"]) for r in targets.where("split is not null and fraction > 0").collect()}
    ends = edges.select(F.explode(F.array("a", "b")).alias("record_id"))
    fresh = records.select("record_id").unionByName(ends).where("record_id is not null").distinct()
    known = state.select("record_id", F.col("component").alias("old"), "split", "status")
    current = workspace.save(
        known.join(fresh, "record_id", "full_outer").select("record_id", F.coalesce("old", "record_id").alias("at"), "split", "status", F.col("old").isNotNull().alias("before")),
        "records",
        moved=F.count_if(F.col("before") & (F.col("at") != F.col("record_id"))),
    )
    lifted = edges.select("a", "b")
    if metric(current, "moved"):  # the ends of the edges become the components that they are in now
        lifted = workspace.save(lifted.where("a is not null and b is not null"), "ties", rows=F.count(F.lit(1)))
        where = current.select("record_id", "at").where(F.col("before") & (F.col("at") != F.col("record_id")))
        for end, other in (("a", "b"), ("b", "a")):
            hot = hot_keys(lifted, end, metric(lifted, "rows"))
            moved = salted_join(lifted, where.select(F.col("record_id").alias(end), F.col("at").alias("__c")), end, hot, other, "left")
            lifted = workspace.save(moved.select(F.coalesce("__c", end).alias(end), other), "lifted", rows=F.count(F.lit(1)))
    roots = merge_components(lifted, workspace)
    hot = hot_keys(current, "at", current.count())
    named = salted_join(current, roots.select(F.col("node").alias("at"), "root"), "at", hot, "record_id", "left")
    named = workspace.save(named.select("record_id", F.coalesce("root", "at").alias("component"), "split", "status"), "named")
    groups = named.groupBy("component").agg(
        F.count("*").alias("n"),
        F.min("split").alias("lo"),
        F.max("split").alias("hi"),
        F.max(F.coalesce(F.col("status") == "quarantined", F.lit(False))).alias("was"),
    )
    groups = workspace.save(groups, "groups")
    conflict = F.col("was") | (F.col("lo") != F.col("hi"))
    kept = groups.where(F.coalesce(conflict, F.lit(False)) | F.col("lo").isNotNull()).select(
        "component", F.when(~F.coalesce(conflict, F.lit(False)), F.col("lo")).alias("split"), F.when(F.coalesce(conflict, F.lit(False)), "quarantined").otherwise("kept").alias("status"), "n"
    )
    totals = kept.where("status = 'kept'").groupBy("split").agg(F.sum("n").alias("n"))
    held = {r["split"]: r["n"] for r in totals.collect()}  # one row a split
    new = groups.where(F.col("lo").isNull() & ~F.col("was")).select("component", "n")
    total = sum(held.values()) + (new.agg(F.sum("n")).first()[0] or 0)
    placed = _fill(new, held, goal, total, workspace) if goal else new.select("component", F.lit(None).cast("string").alias("split"))
    filled = placed.withColumn("status", F.lit("new"))
    decided = workspace.save(kept.drop("n").unionByName(filled), "decided")
    hot = hot_keys(named, "component", named.count())
    out = salted_join(named.select("record_id", "component"), decided, "component", hot, "record_id")
    return workspace.save(out.select("record_id", "component", "split", "status"), "state")


def tied_groups(state: DataFrame) -> DataFrame:
    """``sample_id, group_id`` of every record that shares its component with another."""
    shared = state.groupBy("component").count().where("count > 1").select("component")
    hot = hot_keys(state, "component", state.count())
    return salted_join(state, shared, "component", hot, "record_id").select(F.col("record_id").alias("sample_id"), F.col("component").alias("group_id"))
