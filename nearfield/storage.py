"""Intermediate tables in the folder that all executors share.

Iterative operators cut their lineage by writing parquet and reading it back, so that a lost executor
costs only the tasks that were running.  The folder is ``spark.checkpoint.dir`` of the session; only
where that is unset and the session runs in one process (tests, a laptop) a folder of the machine is used.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def is_local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process."""
    master = spark.sparkContext.master
    return master == "local" or (master.startswith("local[") and not master.startswith("local-cluster"))


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session; without one, a cluster is refused, as its executors share no local folder."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not is_local(spark):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="nearfield-")
    return _LOCAL[app]


def metric(df: DataFrame, name: str):
    """An aggregate that was asked for when the table was saved."""
    return df._nearfield_metrics[name]


class Workspace:
    """Named parquet tables of one operator run below the shared folder.

    ``save`` writes and reads back; ``drop`` removes a table that no later step reads; the rest is removed
    when the application ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/nearfield/{label}-{uuid.uuid4().hex[:12]}"
        self._count = 0
        self._marked = False

    def _file(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def path(self, name: str) -> str:
        self._count += 1
        return f"{self.root}/{self._count:04d}-{name}"

    def save(self, df: DataFrame, name: str, partition_by: list[str] | None = None, **metrics: Column) -> DataFrame:
        """The table, written and read back.  ``metrics`` are aggregates over what was written, see :func:`metric`.

        They are not observed during the write: a session that has observed anything can no longer ship the
        closures of fitted models.
        """
        target = self.path(name)
        schema = df.schema
        writer = df.write.mode("error")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(target)
        if not self._marked:  # what is left goes when the application ends
            path, fs = self._file(self.root)
            fs.deleteOnExit(path)
            self._marked = True
        out = self.spark.read.schema(schema).parquet(target)
        out._nearfield_path = target
        out._nearfield_metrics = out.agg(*[c.alias(k) for k, c in metrics.items()]).first().asDict() if metrics else {}
        return out

    def drop(self, df: DataFrame | None) -> None:
        target = getattr(df, "_nearfield_path", None)
        if target is None:
            return
        path, fs = self._file(target)
        fs.delete(path, True)
