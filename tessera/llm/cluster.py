"""What operators ask of the session: the shared folder, sizes of inputs, tables that cut lineage."""

from __future__ import annotations

import gc
import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.lineage import shared_folder


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share (``spark.checkpoint.dir``, see ``shared_folder``)."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written as Parquet to the shared folder and read again: lineage ends here, lost executors cost a reread."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a few numbers that are broadcast at most; where there are more, both sides shuffle.
BROADCAST_ROWS = 1 << 18


def without(rows: DataFrame, gone: DataFrame, by: list[tuple[str, str]]) -> DataFrame:
    """``rows`` that have no equal in the narrow, stored ``gone`` by pairs of columns, nulls equal to nulls.

    Up to BROADCAST_ROWS rows to remove are counted and broadcast, and ``rows`` stay where they are; beyond, both shuffle.
    """
    same = F.lit(True)
    for one, two in by:
        same = same & rows[one].eqNullSafe(gone[two])
    return rows.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, same, "left_anti")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a stored table that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def tidy(spark: SparkSession) -> None:
    """Let go of shuffle files and checkpoints that nothing refers to any more.

    Spark's cleaner removes them once the driver's garbage is collected, which otherwise happens when the driver's memory
    is short or every half hour; jobs of many phases ask for it between them. Checkpoints go only where the session has
    ``spark.cleaner.referenceTracking.cleanCheckpoints``.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def input_parts(df: DataFrame, per_part: int | None = None) -> int:
    """Number of partitions for the rows of ``df``: its size as the optimizer knows it over the size of a file split."""
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = spark.sparkContext.defaultParallelism
    if size > 1 << 55:  # the optimizer knows no size
        return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))
    if per_part is None:
        java = spark._jvm.org.apache.spark.network.util.JavaUtils
        per_part = int(java.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes")))
    return max(least, math.ceil(size / per_part))


#: Bytes of rows that go to Python at once, see ``small_batches``.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """From now on rows of this session go to Python in batches of BATCH_BYTES at most.

    By default one may have 64 MB, which Spark and Python hold several times over; operators that read whole texts cut
    them into smaller blocks anyway. Smaller settings stay.
    """
    key, java = "spark.sql.execution.arrow.maxBytesPerBatch", spark._jvm.org.apache.spark.network.util.JavaUtils
    if int(java.byteStringAsBytes(spark.conf.get(key))) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while stem in taken:
        stem += "_"
    return stem


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with its columns named c0, c1, ... in order, so that no name clashes with another, repeated ones included."""
    return df.toDF(*(f"c{n}" for n in range(len(df.columns))))


def renamed(df: DataFrame, before: list[str], added: list[str]) -> DataFrame:
    """The columns of a ``numbered`` table under their names ``before``, but for those that clash with ``added``, then ``added``."""
    new = {a.lower() for a in added}
    kept = [(n, name) for n, name in enumerate(before) if name.lower() not in new]
    return df.select(*(f"c{n}" for n, _ in kept), *added).toDF(*(name for _, name in kept), *added)


def place_of(df: DataFrame, name: str) -> int:
    """The index of a column, found by its exact name first, then by its name in any case."""
    if name in df.columns:
        return df.columns.index(name)
    return [c.lower() for c in df.columns].index(name.lower())
