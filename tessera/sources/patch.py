"""Copies of large files changed in place: patches as rows of (path, start, bytes), applied by one task per file.

The original is only read. The copy gets its name when every patch is in and its digest taken again equals the one
before; a task that runs again starts from a new temporary copy.
"""

from __future__ import annotations

import mmap
import os
import shutil
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.lineage import shared_folder
from tessera.sources import movie
from tessera.sources.jpeg import Broken
from tessera.sources.publish import UNFINISHED, linked, settle, swept
from tessera.sources.scan import digest

RESULT = "path string, published string, sha256 string, error string"


def changed_copy(path: str, change: Callable[[str], str | None], partial: str) -> tuple[str | None, str | None]:
    """(its digest, error key) of the copy ``partial`` that ``change`` edits in place; it returns an error key or None.

    A copy that comes to nothing goes again.
    """
    good = False
    try:
        before = _copied(path, partial)
        if before is None:
            return None, "not_a_file"
        error = change(partial)
        if error is None:
            with ThreadPoolExecutor(2) as pool:
                again, sha256 = pool.map(digest, (path, partial))
            error = None if again == before else "source_changed"
        good = error is None
        return (sha256 if good else None), error
    finally:
        if not good and os.path.exists(partial):
            os.unlink(partial)


def _copied(path: str, partial: str) -> str | None:
    """Copy a file to a new one and tell its SHA-256, hashed while the system copies; None if it can't be read."""
    if not os.path.isfile(path):
        return None
    os.close(os.open(partial, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o600))
    with ThreadPoolExecutor(1) as pool:  # neither holds the interpreter's lock
        hashed = pool.submit(digest, path)
        shutil.copyfile(path, partial)
        return hashed.result()


def _partial(path: str, job: str) -> str:
    return os.path.join(os.path.dirname(path), f".{job}.{uuid.uuid4().hex}{UNFINISHED}")


def _patching(patches: list[tuple[int, bytes]], length: int | None) -> Callable[[str], str | None]:
    """The change that writes patches, which must lie inside the file and not overlap, and then cuts the file to ``length``."""
    spans = sorted((at, at + len(body)) for at, body in patches)

    def change(partial: str) -> str | None:
        size = os.path.getsize(partial)
        end = size if length is None else length
        if any(a[1] > b[0] for a, b in zip(spans, spans[1:], strict=False)) or spans and (spans[0][0] < 0 or spans[-1][1] > size) or not 0 <= end <= size:
            return "damaged"
        with open(partial, "r+b") as out:
            for at, body in patches:
                out.seek(at)
                out.write(body)
            out.truncate(end)
            out.flush()
            os.fsync(out.fileno())
        return None

    return change


def apply_to_copy(path: str, patches: list[tuple[int, bytes]], length: int | None, naming: str = "plain") -> tuple[str | None, str | None, str | None]:
    """(published path, its digest, error key) of one file."""
    partial = _partial(path, uuid.uuid4().hex)
    sha256, error = changed_copy(path, _patching(patches, length), partial)
    if error is not None:
        return None, None, error
    try:
        return settle(partial, path, os.path.splitext(path)[1], naming, "video"), sha256, None
    finally:
        os.unlink(partial)


def _video(path: str, partial: str) -> tuple[str | None, str | None, str | None]:
    """(kind, digest, error key) of a video cleaned in a copy through memory maps; only its boxes and unused bytes are read and changed."""

    def change(partial: str) -> str | None:
        try:
            with open(path, "rb") as source, open(partial, "r+b") as copy:
                with mmap.mmap(source.fileno(), 0, access=mmap.ACCESS_READ) as original:
                    plan = movie.Plan(original)
                    with mmap.mmap(copy.fileno(), 0, access=mmap.ACCESS_WRITE) as view:
                        for a, b in movie.steps(plan.edits.zeros):
                            view[a:b] = bytes(b - a)
                        for at, body in plan.edits.puts:
                            view[at : at + len(body)] = body
                        view.flush()
                    copy.truncate(plan.length)
                    os.fsync(copy.fileno())
                    with mmap.mmap(copy.fileno(), 0, access=mmap.ACCESS_READ) as result:
                        return "verification_failed" if movie.difference(original, result) else None
        except Broken as broken:
            return broken.key
        except ValueError:  # an empty file can't be mapped
            return "damaged"

    with open(path, "rb") as stream:
        old = stream.read(12)
    return "MOV" if old[4:8] != b"ftyp" or old[8:12] == b"qt  " else "MP4", *changed_copy(path, change, partial)


_MADE = "path string, kind string, temporary string, sha256 string, error string"


def _published(spark: SparkSession, make: Callable[[str], DataFrame], paths: DataFrame, naming: str) -> DataFrame:
    """RESULT of the copies that ``make`` (given the job's name) leaves under temporary names, as ``publish`` gives names to them."""
    shared_folder(spark)
    job = uuid.uuid4().hex
    try:
        made = make(job).withColumn("file_id", F.monotonically_increasing_id()).checkpoint()
        status = F.when(F.col("temporary").isNull(), "refused").otherwise("cleaned")
        done = linked(made.select("file_id", status.alias("status"), F.col("error").alias("error_key"), "path", "kind", "temporary"), naming, "video")
        return done.join(made.select("file_id", "path", "sha256"), "file_id").select("path", "published", "sha256", F.col("error_key").alias("error")).checkpoint()
    finally:
        swept(paths.filter("path IS NOT NULL").select(F.regexp_extract("path", "(?s)^(.*)/[^/]*$", 1).alias("folder")).distinct(), job)


def clean_videos(files: DataFrame, naming: str = "plain") -> DataFrame:
    """Outcomes of video files (``path``), each cleaned in a copy next to it: ``path, published, sha256, error``.

    A file is one task's work whatever its size and never held in memory. Copies are made right away, once, under
    temporary names, and get their names as ``publish`` deals them: a task that runs twice leaves no spare copy.
    """

    def make(job: str) -> DataFrame:
        def run(batches):
            for batch in batches:
                for path in batch.column(0).to_pylist():
                    partial = _partial(path, job) if path else None
                    kind, sha256, error = _video(path, partial) if path and os.path.isfile(path) else (None, None, "not_a_file")
                    row = (path, kind, None if error else partial, sha256, error)
                    yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in row], ["path", "kind", "temporary", "sha256", "error"])

        return files.select("path").mapInArrow(run, _MADE)

    return _published(files.sparkSession, make, files, naming)


def patched(files: DataFrame, patches: DataFrame, naming: str = "plain") -> DataFrame:
    """Outcomes of ``files`` (``path``, ``length`` of the result or null) after ``patches`` (``path, start, body``), made like those of ``clean_videos``.

    The patches of one file are one task's work.
    """
    tagged = files.select("path", F.col("length").alias("start"), F.lit(None).cast("binary").alias("body"), F.lit(True).alias("is_file"))
    rows = tagged.unionByName(patches.select("path", "start", "body", F.lit(False).alias("is_file")))

    def make(job: str) -> DataFrame:
        def run(own: pd.DataFrame) -> pd.DataFrame:
            path, head, error, sha256, partial = own["path"].iloc[0], own[own["is_file"]], "not_a_file", None, None
            if len(head):
                length = head["start"].iloc[0]
                edits = [(int(a), bytes(b)) for a, b in own.loc[~own["is_file"], ["start", "body"]].itertuples(index=False)]
                partial = _partial(path, job)
                sha256, error = changed_copy(path, _patching(edits, None if pd.isna(length) else int(length)), partial)
            return pd.DataFrame([(path, None, None if error else partial, sha256, error)], columns=["path", "kind", "temporary", "sha256", "error"])

        return rows.groupBy("path").applyInPandas(run, _MADE)

    return _published(files.sparkSession, make, rows, naming)


def zero_spans(path: str, spans: DataFrame) -> DataFrame:
    """Patches that fill spans (``start, end``) with zeros."""
    return spans.select(F.lit(path).alias("path"), "start", F.unhex(F.repeat(F.lit("00"), (F.col("end") - F.col("start")).cast("int"))).alias("body"))
