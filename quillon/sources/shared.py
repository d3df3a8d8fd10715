"""The folder that all machines share, and tables written into it.

Lineage ends at a written table: later stages read files that outlive executors, and every reader sees
the same rows in the same place, however often a plan is evaluated.
"""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.errors import ConfigError


def shared_root(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; on a local master without it, a temporary one of this process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ConfigError("spark.checkpoint.dir has to name a folder that all machines of the cluster share")
    found = getattr(spark, "_quillon_shared", None)
    if not found:
        folder = tempfile.mkdtemp(prefix="quillon-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        found = spark._quillon_shared = "file://" + folder
    return found


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def written(spark: SparkSession) -> list[str]:
    """Paths in the shared folder that this session has not deleted yet."""
    if not hasattr(spark, "_quillon_written"):
        spark._quillon_written = []
    return spark._quillon_written


def remember(spark: SparkSession, path: str) -> str:
    """Have drop_durable() delete this path too."""
    written(spark).append(path)
    return path


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it back."""
    spark = df.sparkSession
    path = remember(spark, shared_path(spark, name))
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._quillon_path = path
    return found


def _delete(spark: SparkSession, paths: list[str]) -> None:
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(hadoop).delete(place, True)
        written(spark).remove(path)


def forget(df: DataFrame) -> None:
    """Delete one table that durable() gave."""
    _delete(df.sparkSession, [df._quillon_path])


def drop_durable(spark: SparkSession) -> None:
    """Delete all that this session has written into the shared folder; frames that read it can't be used any more."""
    _delete(spark, list(written(spark)))


#: Rows of a few numbers that are broadcast; a side with more is joined by a shuffle.
BROADCAST_ROWS = 200_000


def bounded(side: DataFrame, rows: int) -> DataFrame:
    """A side with a known number of short rows, to be broadcast if they are few enough; else neither side is.

    Spark would choose by the size of files, which are far smaller than their rows where values repeat.
    """
    return F.broadcast(side) if rows <= BROADCAST_ROWS else side.hint("merge")


@contextlib.contextmanager
def passing(spark: SparkSession):
    """Tables written inside are deleted at the end, but for those that the function given here was called with."""
    before, kept = set(written(spark)), set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df._quillon_path)
        return df

    yield keep
    _delete(spark, [p for p in written(spark) if p not in before and p not in kept])
