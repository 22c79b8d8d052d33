"""The folder all executors can reach, for tables a job writes on its way."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """Folder named by the cluster, or set on the session's context. A local
    session without either gets a folder of its own; a cluster must name one."""
    context = spark.sparkContext
    folder = spark.conf.get(CHECKPOINT_SETTING, None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_SETTING} to a folder all executors can reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="bibliolake-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


#: Names of the tables on the way that are dropped at the end of a ``dropped_tables``.
_OPEN: list[list[str]] = []


def new_path(spark: SparkSession, name: str) -> str:
    where = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if _OPEN:
        _OPEN[-1].append(where)
    return where


@contextmanager
def dropped_tables(spark: SparkSession) -> Iterator[None]:
    """Drops the tables that operators write on their way, once the block ends::

        with dropped_tables(spark):
            top_subgraph(papers)[1].write.parquet(result)

    Results that are still to be computed must be written inside the block. Only what was
    made inside it is removed, also when it fails; without it the tables stay in the shared
    folder.
    """
    _OPEN.append([])
    try:
        yield
    finally:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        settings = spark.sparkContext._jsc.hadoopConfiguration()
        for where in _OPEN.pop():
            path = hadoop(where)
            path.getFileSystem(settings).delete(path, True)


def through_table(df: DataFrame, name: str) -> DataFrame:
    """Write once and read back: later passes scan the table and a lost
    executor costs a re-read, not the whole lineage."""
    spark = df.sparkSession
    where = new_path(spark, name)
    df.write.parquet(where)
    return spark.read.parquet(where)


def by_year(df: DataFrame) -> DataFrame:
    """Rows gathered by year for a write with one folder per year, sorted by id.

    Rebalancing sizes the pieces at run time: a year with most of the rows is
    split into several files, small years share a task. A range partitioning
    would read everything twice, once to sample it.
    """
    return df.hint("rebalance", "year").sortWithinPartitions("year", "file_id")
