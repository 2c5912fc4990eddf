"""Files by path: a data source that reads no more of them than is asked for, and digests over mapped files.

The data source is registered as ``media_head``. Its option ``paths`` is a JSON list; each path is a row, also if it is
no file. The schema that it is read with chooses the columns: heads are read for ``head`` and ``kind`` only, bodies for
``content`` only. With the option ``filters``, for which the session needs ``spark.sql.python.filterPushdown.enabled``,
filters on ``is_file``, ``length`` and ``kind`` are pushed into it: a file that they refuse isn't read beyond its head.
Executors must reach the paths.
"""

from __future__ import annotations

import hashlib
import json
import mmap
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

HEAD = 4096
_STEP = 1 << 20
#: What can be asked for, and what is read without being asked.
COLUMNS = {"path": "string", "is_file": "boolean", "length": "long", "modified": "double", "head": "binary", "kind": "string", "content": "binary"}
SCHEMA = "path string, is_file boolean, length long, modified double, head binary"


class _Slice(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


def head_kind(head: bytes) -> str | None:
    """The format of a file by its first bytes, as ``parts.kind_of`` tells it."""
    from tessera.sources import parts

    if head[:4] == b"RIFF" and head[8:12] == b"WEBP":
        return parts.WEBP
    for at, magic, name in parts.SIGNATURES:
        if head.startswith(magic, at - 1):
            return name
    brands = set()
    if head[4:8] == b"ftyp" and len(head) >= 16:
        last = min(int.from_bytes(head[:4], "big"), len(head), 8 + parts.FILE_TYPE_BYTES)
        brands = {head[8:12], *(head[at : at + 4] for at in range(16, last - 3, 4))}
    for kind, names in ((parts.AVIF, parts.AVIF_BRANDS), (parts.HEIC, parts.HEIF_BRANDS)):
        if brands & {n.encode() for n in names}:
            return kind
    if head[4:8] in {a.encode() for a in parts.movie.OLD_ATOMS} or brands and head[8:12] == b"qt  ":
        return parts.MOV
    return parts.MP4 if brands & {n.encode() for n in (*parts.movie.BRANDS, *parts.movie.MAKERS)} else None


#: How a pushed filter holds; null values hold none.
_HOLDS = {EqualTo: lambda x, f: x == f.value, In: lambda x, f: x in f.value, GreaterThan: lambda x, f: x > f.value, GreaterThanOrEqual: lambda x, f: x >= f.value, LessThan: lambda x, f: x < f.value, LessThanOrEqual: lambda x, f: x <= f.value, IsNotNull: lambda x, f: True}
_PUSHED = ("is_file", "length", "kind")


class _HeadReader(DataSourceReader):
    def __init__(self, paths: list[str], parts: int, columns: list[str]):
        self.paths, self.parts, self.columns, self.filters = paths, max(1, min(parts, len(paths) or 1)), columns, []

    def partitions(self) -> list[InputPartition]:
        return [_Slice(self.paths[n :: self.parts]) for n in range(self.parts)]

    def _refused(self, row: dict) -> bool:
        """Whether a filter on what is known so far doesn't hold."""
        return any(f.attribute[0] in row and (row[f.attribute[0]] is None or not _HOLDS[type(f)](row[f.attribute[0]], f)) for f in self.filters)

    def read(self, partition: _Slice) -> Iterator[tuple]:
        wanted = {*self.columns, *(f.attribute[0] for f in self.filters)}
        for path in partition.paths:
            row = dict.fromkeys(COLUMNS) | {"path": os.path.abspath(os.path.expanduser(path)), "is_file": False}
            try:
                with open(row["path"], "rb") as stream:
                    info = os.fstat(stream.fileno())
                    row |= {"is_file": True, "length": info.st_size, "modified": info.st_mtime}
                    if self._refused({k: row[k] for k in ("is_file", "length")}):
                        continue
                    if wanted & {"head", "kind"}:
                        row["head"] = stream.read(HEAD)
                        row["kind"] = head_kind(row["head"])
                    if "content" in wanted and not self._refused({k: row[k] for k in _PUSHED}):
                        stream.seek(0)
                        row["content"] = stream.read()
            except OSError:
                row |= {"is_file": False, "length": None, "modified": None, "head": None, "kind": None, "content": None}
            if not self._refused({k: row[k] for k in _PUSHED}):
                yield tuple(row[c] for c in self.columns)


class _FilteringReader(_HeadReader):
    def pushFilters(self, filters):
        for f in filters:
            if type(f) in _HOLDS and len(f.attribute) == 1 and f.attribute[0] in _PUSHED:
                self.filters.append(f)
            else:
                yield f


class MediaHead(DataSource):
    """``spark.read.format("media_head").option("paths", json.dumps(paths)).load()``; option ``parts`` sets the tasks.

    ``.schema(...)`` with other of COLUMNS asks for those.
    """

    @classmethod
    def name(cls) -> str:
        return "media_head"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> DataSourceReader:
        kind = _FilteringReader if self.options.get("filters") == "true" else _HeadReader
        return kind(json.loads(self.options["paths"]), int(self.options.get("parts", "8")), schema.fieldNames())


def files(spark: SparkSession, paths: list[str], columns: list[str]) -> DataFrame:
    """The named COLUMNS of each path; filters on ``is_file``, ``length`` and ``kind`` are decided before bodies are read."""
    spark.dataSource.register(MediaHead)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    schema = ", ".join(f"{c} {COLUMNS[c]}" for c in columns)
    return spark.read.format("media_head").schema(schema).options(paths=json.dumps(paths), filters="true").load()


def admitted(spark: SparkSession, paths: list[str], kinds: list[str], largest: int) -> DataFrame:
    """``file_id, path, length, kind, content, refusal`` of each path: bodies of files of ``kinds`` up to ``largest`` bytes only.

    The others are refused by their heads as ``not_a_file``, ``unsupported_format`` or ``too_large``.
    """
    every = files(spark, paths, ["path", "is_file", "length", "kind"]).dropDuplicates(["path"])
    bodies = files(spark, paths, ["path", "length", "kind", "content"]).filter(F.col("kind").isin(kinds) & (F.col("length") <= largest)).dropDuplicates(["path"])
    known = F.coalesce(F.col("kind").isin(kinds), F.lit(False))
    refusal = F.when(~F.col("is_file"), "not_a_file").when(~known, "unsupported_format").when(F.col("length") > largest, "too_large")
    joined = every.join(bodies.select("path", "content"), "path", "left")
    return joined.select(F.xxhash64("path").alias("file_id"), "path", "length", "kind", "content", refusal.alias("refusal"))


def heads(spark: SparkSession, paths: list[str]) -> DataFrame:
    """A row per path with the first bytes of the file, or ``is_file`` false."""
    spark.dataSource.register(MediaHead)
    return spark.read.format("media_head").option("paths", json.dumps(paths)).load()


def digest(path: str) -> str | None:
    """SHA-256 of a file through a memory map, a step at a time; None if it can't be read."""
    total = hashlib.sha256()
    try:
        with open(path, "rb") as stream:
            if os.fstat(stream.fileno()).st_size:
                with mmap.mmap(stream.fileno(), 0, access=mmap.ACCESS_READ) as view:
                    for at in range(0, len(view), _STEP):
                        total.update(view[at : at + _STEP])
    except OSError:
        return None
    return total.hexdigest()


def digests(files: DataFrame) -> DataFrame:
    """``files`` (with ``path``) with ``sha256`` of each file's bytes, read on the executors."""

    def look(batches):
        for batch in batches:
            own = pa.array([p and digest(p) for p in batch.column("path").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("path"), own], ["path", "sha256"])

    return files.select("path").mapInArrow(look, "path string, sha256 string")
