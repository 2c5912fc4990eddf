"""Publishing of clean copies next to their originals: exclusive names, temporary files, nothing overwritten."""

from __future__ import annotations

import contextlib
import errno
import itertools
import json
import os
import stat
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from tessera.functions.names import candidates, without_dates
from tessera.operators.lineage import shared_folder
from tessera.sources.naming import batch_names, listed

# Suffixes of the formats, the first is the default.
SUFFIXES = {"PNG": (".png", ".apng"), "GIF": (".gif",), "WEBP": (".webp",), "JPEG": (".jpg", ".jpeg", ".jpe", ".jfif"), "TIFF": (".tif", ".tiff"), "HEIC": (".heic", ".heif", ".hif", ".heics", ".heifs"), "AVIF": (".avif", ".avifs")}
SUFFIXES |= {"MP4": (".mp4", ".mov", ".m4v", ".qt", ".3gp", ".3g2", ".f4v"), "MOV": (".mov", ".mp4", ".m4v", ".qt", ".3gp", ".3g2", ".f4v")}


def settle(finished: str, original: str, suffix: str, naming: str = "plain", noun: str = "photo", wish: str | None = None) -> str:
    """Link a finished file under the first free name next to its original, with its permissions and no user attributes.

    ``wish`` is tried first. A name that the file has already is its own.
    """
    folder, name = os.path.split(original)
    names = candidates(os.path.splitext(name)[0], suffix, naming, noun)
    for target in (os.path.join(folder, c) for c in itertools.chain([wish] if wish else [], names)):
        try:
            os.link(finished, target)  # fails if the name is taken
        except FileExistsError:
            if not os.path.samefile(finished, target):
                continue
        for attribute in _attributes(target):
            os.removexattr(target, attribute)
        os.chmod(target, stat.S_IMODE(os.stat(original).st_mode))
        return target
    raise AssertionError("names never run out")


def _attributes(path: str) -> list[str]:
    try:
        return [a for a in os.listxattr(path) if a.startswith("user.")]
    except OSError as error:
        if error.errno in (errno.ENOTSUP, errno.EOPNOTSUPP, errno.ENOSYS):  # a file system without any
            return []
        raise


def suffix_for(name: str, kind: str | None) -> str:
    """The name's own suffix if its format may have it or isn't known, else the format's first."""
    own = os.path.splitext(name)[1]
    return own if kind is None or own.lower() in SUFFIXES[kind] else SUFFIXES[kind][0]


#: Part of the name of every file that isn't finished.
UNFINISHED = ".unfinished"


class _Written(WriterCommitMessage):
    """What a task that ended says of itself: the file that lists what it wrote."""

    def __init__(self, listing: str):
        self.listing = listing


class _CopyWriter(DataSourceWriter):
    """Writes results under temporary names; only what the tasks that count have listed is known to the job afterwards."""

    def __init__(self, jobs: str, job: str):
        self.jobs, self.job = jobs, job

    def write(self, rows) -> _Written:
        attempt, used = os.path.join(self.jobs, f"{self.job}.{uuid.uuid4().hex}"), set()
        listing = attempt + ".json"
        try:
            with open(listing, "w") as out, open(attempt + ".folders", "w") as folders:
                for row in rows:
                    temporary = None
                    if row.status == "cleaned":
                        folder = os.path.dirname(row.path)
                        if folder not in used:  # told before the first file is there: an attempt may end at any time
                            folders.write(json.dumps([folder]) + "\n")
                            folders.flush()
                            used.add(folder)
                        temporary = os.path.join(folder, f".{self.job}.{uuid.uuid4().hex}{UNFINISHED}")
                        _write_out(temporary, row.result)
                    said = {"file_id": row.file_id, "status": row.status, "error_key": row.error_key, "path": row.path, "kind": row.kind, "temporary": temporary}
                    out.write(json.dumps(said) + "\n")
                out.flush()
                os.fsync(out.fileno())
        except BaseException:
            _gone(listing)
            raise
        return _Written(listing)

    def commit(self, messages) -> None:
        with open(os.path.join(self.jobs, f"{self.job}.lists"), "w") as out:
            out.writelines(m.listing + "\n" for m in messages if m is not None)

    def abort(self, messages) -> None:
        """Nothing counts; what tasks have written is swept by the job, for most of them can't say any more what it was."""


def _write_out(path: str, content: bytes) -> None:
    with os.fdopen(os.open(path, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o600), "wb") as out:
        out.write(content)
        out.flush()
        os.fsync(out.fileno())


def _gone(path: str | None) -> None:
    if path is not None:
        with contextlib.suppress(FileNotFoundError):
            os.unlink(path)


class MediaCopies(DataSource):
    """``write.format("media_copies")``: options ``jobs`` (a folder that all can open) and ``job`` (a name of its own)."""

    @classmethod
    def name(cls) -> str:
        return "media_copies"

    def schema(self) -> str:
        return _OUTCOME

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _CopyWriter(self.options["jobs"], self.options["job"])


_OUTCOME = "file_id long, status string, error_key string, path string, kind string, result binary"
_LISTED = "file_id long, status string, error_key string, path string, kind string, temporary string"


def _jobs_folder(spark: SparkSession) -> str:
    folder = shared_folder(spark)
    path = folder.removeprefix("file://") if folder.startswith("file://") else folder.removeprefix("file:")
    if "://" in path:
        raise ValueError("copies are files: publishing needs a shared folder that can be opened")
    os.makedirs(path, exist_ok=True)
    return path


def publish(outcomes: DataFrame, naming: str = "plain") -> DataFrame:
    """Outcomes with ``path`` and ``result`` written out: ``file_id, status, error_key, published``.

    Results are computed and written once, under temporary names next to their originals; a task that fails or runs
    twice leaves nothing that counts. Names are dealt to the whole batch at once, and then each temporary file is linked
    under its name. A link that is there already and is the same file is the job's own, so linking may be repeated, too;
    a name that somebody else took meanwhile is passed over. Temporary files go last. Neither originals nor other files
    are touched. All folders must be shared by the executors; null paths and ids must not be among the outcomes.
    """
    spark = outcomes.sparkSession
    jobs, job = _jobs_folder(spark), uuid.uuid4().hex
    spark.dataSource.register(MediaCopies)
    rows = outcomes.select(*(F.col(f.split()[0]) for f in _OUTCOME.split(", ")))
    try:
        rows.write.format("media_copies").options(jobs=jobs, job=job).mode("append").save()
        with open(os.path.join(jobs, f"{job}.lists")) as lines:
            lists = lines.read().split()
        written = spark.read.schema(_LISTED).json([f"file://{p}" for p in lists]) if lists else spark.createDataFrame([], _LISTED)
        return linked(written.checkpoint(), naming).checkpoint()
    finally:
        _sweep(spark, jobs, job)


def _wishes(written: DataFrame, naming: str, noun: str) -> DataFrame:
    """``file_id, wish``: the name that the batch deals to each copy, settled before any is linked.

    Anonymous names follow from the temporary file's, which is random. A name that nobody else wants needs no dealing.
    """
    copies = written.filter("temporary IS NOT NULL")
    split = lambda n: F.regexp_extract("path", r"(?s)^(.*)/([^/]*?)(\.[^./]*)?$", n)
    stem, suffix = split(2), split(3)
    own = F.coalesce(*(F.when(F.col("kind") == k, F.when(F.lower(suffix).isin(*names), suffix).otherwise(F.lit(names[0]))) for k, names in SUFFIXES.items()), suffix)
    if naming == "anonymous":
        return copies.select("file_id", F.concat(F.lit(f"{noun}_"), F.md5(F.col("temporary").cast("binary")), F.lower(own)).alias("wish"))
    base = stem if naming == "original" else F.coalesce(F.nullif(without_dates(stem), F.lit("")), F.lit(noun))
    files = copies.select("file_id", F.when(split(1) == "", "/").otherwise(split(1)).alias("folder"), base.alias("base"), own.alias("suffix")).checkpoint()
    # A copy that is alone with its name finds a free one by itself: what the batch deals are names that several want.
    several = files.groupBy("folder", "base", "suffix").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    files = files.join(several, ["folder", "base", "suffix"]).checkpoint()
    if files.isEmpty():
        return files.select("file_id", F.lit(None).cast("string").alias("wish"))
    return batch_names(files, listed(files)).select("file_id", F.col("name").alias("wish"))


def linked(written: DataFrame, naming: str = "plain", noun: str = "photo") -> DataFrame:
    """``written`` (``file_id, status, error_key, path, kind, temporary``) with each temporary file ``published`` under its name.

    Names are dealt right away; linking happens as the rows are computed, and again without effect. A null kind keeps
    the name's own suffix.
    """

    def link(batches):
        for batch in batches:
            rows = batch.to_pylist()
            names = [r["temporary"] and settle(r["temporary"], r["path"], suffix_for(r["path"], r["kind"]), naming, noun, r["wish"]) for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("file_id", "status", "error_key")] + [pa.array(names, pa.string())], ["file_id", "status", "error_key", "published"])

    wished = written.join(_wishes(written, naming, noun), "file_id", "left")
    return wished.mapInArrow(link, "file_id long, status string, error_key string, published string")


def swept(folders: DataFrame, job: str) -> None:
    """Remove the job's temporary files from each ``folder``, also those of attempts that were lost."""

    def remove(batches):
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                with contextlib.suppress(FileNotFoundError):
                    for entry in os.scandir(folder or "/"):
                        if entry.name.startswith(f".{job}.") and entry.name.endswith(UNFINISHED):
                            _gone(entry.path)
            yield batch

    folders.select("folder").mapInArrow(remove, "folder string").count()


def _sweep(spark: SparkSession, jobs: str, job: str) -> None:
    """Remove the job's temporary files from the folders that its attempts noted, then all that it noted."""
    notes = [e.path for e in os.scandir(jobs) if e.name.startswith(f"{job}.")]
    told = [f"file://{p}" for p in notes if p.endswith(".folders")]
    if told:
        swept(spark.read.text(told).distinct().select(F.from_json("value", "array<string>")[0].alias("folder")), job)
    for path in notes:
        _gone(path)


def summary(outcomes: DataFrame) -> DataFrame:
    """``status, error_key, n``: how many files ended how."""
    return outcomes.groupBy("status", F.coalesce("error_key", F.lit("")).alias("error_key")).agg(F.count(F.lit(1)).alias("n"))
