"""Cutting lineage in the folder that driver and executors share.

The folder is the session's ``spark.checkpoint.dir``.  Only a local session that names none gets
a temporary one; on a cluster that is an error, as no machine's own folder is shared.  Nothing
here is kept on a single executor, so a lost executor costs a re-read and no recomputation of
what came before.
"""

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder, set on the session when it had none."""
    found = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not found:
        found = spark.sparkContext.getCheckpointDir() or ""
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessel-checkpoints-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Compressed bytes of a task, and rows of a shuffle for each partition, within ``small_tasks``.
TASK_BYTES, TASK_ROWS = 8 << 20, 500_000
#: First partitions of the shuffles of large joins whose rows aren't known.
UNKNOWN = 400

#: For each open ``temporary`` block, the paths written in it.
_OPEN: list[list[str]] = []


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Delete what is staged within the block when it ends; its last reader must be in the block."""
    made: list[str] = []
    _OPEN.append(made)
    try:
        yield
    finally:
        _OPEN.remove(made)
        for path in made:
            drop_path(spark, path)


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of small iterative state (graph frontiers, label tables)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def small_tasks(spark: SparkSession, rows: int = 0, partitions: int = 0) -> Iterator[None]:
    """Bound what one task holds of the queries that run within the block.

    Adaptive execution and file splits size tasks by compressed bytes.  Tables of ids of which
    most are equal shrink so far that tasks of the usual size would aggregate tens of millions of
    rows.  Within the block tasks take ``TASK_BYTES`` at most, unless the session has less, and
    shuffles have a partition for every ``TASK_ROWS`` of ``rows`` and ``partitions`` at least, which
    adaptive execution joins again where there is little to shuffle.
    """
    most = lambda key: min(TASK_BYTES, spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)))
    put = {key: f"{most(key)}b" for key in ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes")}
    first = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    put[first] = str(max(int(spark.conf.get(first, None) or spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS), partitions))
    before = {key: spark.conf.get(key, None) for key in put}
    try:
        for key, value in put.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def staged(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` once as a columnar table in the shared folder and read it back.

    For results that cost much to compute and are read several times.  ``keep`` leaves the table
    where it is when a ``temporary`` block ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/scratch/{name}-{uuid.uuid4().hex}" if keep else scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted at the end of the innermost ``temporary`` block."""
    path = f"{shared_dir(spark)}/scratch/{name}-{uuid.uuid4().hex}"
    if _OPEN:
        _OPEN[-1].append(path)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder."""
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jpath, True)
