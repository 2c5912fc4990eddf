"""A drop folder: files that appear are cleaned, published next to themselves and reported, each once.

Clean copies land in the folder that is watched. The report of what was published is a second stream; both meet by the
digest of the content in a state that holds, of each digest, the copies that haven't been seen as files yet. A file that
is such a copy is passed over, and its state goes; a copy that never appears is forgotten after a time.
"""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.plans import sanitise
from tessera.sources import scan
from tessera.sources.parts import kind_of
from tessera.sources.publish import publish

_FILE = "path string, modificationTime timestamp, length long, content binary"
REPORT = "file_id long, status string, error_key string, published string, path string, copy_sha256 string, batch long"
#: Milliseconds after which a copy that was published but never seen as a file is forgotten.
FORGET_MS = 7 * 24 * 3600 * 1000


def _sift(key: tuple, batches, state: GroupState):
    """The files of one content that aren't the copies awaited; state: the paths of those."""
    if state.hasTimedOut:
        state.remove()
        return
    awaited, files = set(state.get[0]) if state.exists else set(), []
    for batch in batches:
        awaited |= set(batch.loc[batch["is_copy"], "path"])
        files += list(batch.loc[~batch["is_copy"], "path"])
    left = awaited - set(files)
    if left:
        state.update((sorted(left),))
        state.setTimeoutDuration(FORGET_MS)
    elif state.exists:
        state.remove()
    yield pd.DataFrame({"path": sorted(set(files) - awaited)}, dtype=str)


def _with_bodies(paths: DataFrame) -> DataFrame:
    """``file_id, path, content`` of the paths, read on the executors; files that are gone have no content."""

    def read(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                try:
                    with open(path, "rb") as stream:
                        body = stream.read()
                except OSError:
                    body = None
                yield pa.RecordBatch.from_arrays([pa.array([path], pa.string()), pa.array([body], pa.binary())], ["path", "content"])

    return paths.select("path").mapInArrow(read, "path string, content binary").select(F.xxhash64("path").alias("file_id"), "path", "content")


def watch(spark: SparkSession, folder: str, report: str, checkpoint: str, pattern: str = "*", once: bool = False) -> StreamingQuery:
    """Start a query that cleans what matches ``pattern`` in ``folder`` and appends REPORT's rows as Parquet to ``report``.

    Clean copies are known by the report, which has the name and digest of each, and are left alone. Files of any other
    name or content are cleaned. The checkpoint remembers which files were seen and which copies are awaited. ``once``
    handles what is there and ends.
    """
    where = spark._jvm.org.apache.hadoop.fs.Path(report)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(where)  # a stream reads it from the start

    def handle(batch: DataFrame, number: int) -> None:
        files = _with_bodies(batch).withColumn("kind", kind_of(F.col("content"))).persist()
        paths = files.select("file_id", "path")
        done = publish(sanitise.clean(files).join(paths, "file_id"))
        copies = scan.digests(done.filter("published IS NOT NULL").select(F.col("published").alias("path"))).withColumnsRenamed({"path": "published", "sha256": "copy_sha256"})
        told = done.join(paths, "file_id").join(copies, "published", "left").withColumn("batch", F.lit(number).cast("long"))
        told.select(*(f.split()[0] for f in REPORT.split(", "))).write.mode("append").parquet(report)
        files.unpersist()

    stream = spark.readStream.format("binaryFile").schema(_FILE).option("pathGlobFilter", pattern).load(folder)
    files = stream.select(F.sha2("content", 256).alias("digest"), F.regexp_replace("path", "^file:(//)?", "").alias("path"), F.lit(False).alias("is_copy"))
    copies = spark.readStream.schema(REPORT).parquet(report).filter("published IS NOT NULL").select(F.col("copy_sha256").alias("digest"), F.col("published").alias("path"), F.lit(True).alias("is_copy"))
    fresh = files.unionByName(copies).groupBy("digest").applyInPandasWithState(_sift, "path string", "copies array<string>", "append", GroupStateTimeout.ProcessingTimeTimeout)
    writer = fresh.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
