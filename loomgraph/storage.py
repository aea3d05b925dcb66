"""Shared storage for intermediate results: lineage is cut here and nowhere else.

The folder is the one the cluster names in ``spark.checkpoint.dir``. Only where that setting is unset
and the master is local (tests on one machine) is a temporary folder made and set; on a cluster that is an error.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share; Spark's checkpoint directory is set to it if it has none."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = context._jsc.sc().getCheckpointDir()
    if named:
        if not current.isDefined():
            context.setCheckpointDir(named)
        return named.rstrip("/")
    if not current.isDefined():
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="loomgraph-"))
        current = context._jsc.sc().getCheckpointDir()
    return current.get().rstrip("/")


class Stage:
    """A table written as Parquet in the shared folder and read back; ``drop()`` removes it.

    With ``give_back``, what its job shuffled is removed from the disks as soon as the table is written.
    """

    def __init__(self, df: DataFrame, name: str = "stage", give_back: bool = False):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        with shuffles_removed(self.spark) if give_back else nullcontext():
            df.write.option("compression", "zstd").parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)
        _written.append((self.spark, self.path))

    def drop(self) -> None:
        _delete(self.spark, self.path)
        if (self.spark, self.path) in _written:
            _written.remove((self.spark, self.path))


def staged(df: DataFrame, name: str = "stage", give_back: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder, return the reread table; removed when the program ends."""
    return Stage(df, name, give_back).df


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Spark removes shuffle files at the end of each job in here, not only when the driver collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if was is None else spark.conf.set(key, was)


def _delete(spark: SparkSession, path: str) -> None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(conf).delete(target, True)


@atexit.register
def clean() -> None:
    """Removes all that is still there; results that read it can't be computed any more."""
    while _written:
        try:
            _delete(*_written.pop())
        except Exception:  # the session is gone: the folder's owner removes the rest
            return
