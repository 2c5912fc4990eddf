"""Queries over media files that are derived from a given table: each supplier's file holds a mark of its row where it is private.

A file is one of the cases of its format, chosen by the supplier's key; what must become of it is known, so SQL can say
it. A mark that is left in a clean copy is a leak.
"""

from __future__ import annotations

import functools
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.lineage import shared_folder
from tessera.plans import sanitise
from tessera.sources import fixtures, fuzz, parts, publish, scan

ALL = (parts.PNG, parts.GIF, parts.WEBP, parts.JPEG, parts.TIFF, parts.BMP, parts.HEIC, parts.AVIF, parts.MP4, parts.MOV)
#: What a file can be, null if unknown: formats with a parser and the rest.
PARSED = (parts.BMP, *parts.PARSERS)
OTHERS = (*sanitise.IN_PLACE, None)
KINDS = (*PARSED, *OTHERS)
_LENGTH = len(fixtures.SECRET)


@functools.cache  # a Python worker makes them once, not for each task
def cases_of(kinds: tuple[str, ...]) -> list[tuple]:
    """The cases whose files have one of the formats."""
    return [c for c in fixtures.cases() if scan.head_kind(c[1][: scan.HEAD]) in kinds]


def marked(content: bytes, mark: bytes) -> bytes:
    """The file with ``mark``, as long as the secret of the cases, in place of that; checksums of PNG chunks that it changes follow."""
    out = bytearray(content.replace(fixtures.SECRET, mark))
    at = 8
    while content.startswith(b"\x89PNG") and at + 12 <= len(out):
        end = at + 8 + int.from_bytes(out[at : at + 4], "big")
        if end + 4 > len(out):
            break
        if out[at:end] != content[at:end]:
            was_sound = zlib.crc32(content[at + 4 : end]) == int.from_bytes(content[end : end + 4], "big")
            out[end : end + 4] = zlib.crc32(out[at + 4 : end]).to_bytes(4, "big") if was_sound else out[end : end + 4]
        at = end + 4
    return bytes(out)


#: Suppliers whose files are one task's work, and bytes of files that leave Python at once.
FILES_OF_TASK, BATCH_BYTES = 512, 4 << 20


def _marks(spark: SparkSession, d: str) -> DataFrame:
    """``file_id, mark`` of each supplier."""
    mark = F.substring(F.sha2(F.concat_ws(":", "s_suppkey", "s_name"), 256), 1, _LENGTH)
    return spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("file_id"), mark.alias("mark"))


def _dealt(spark: SparkSession, d: str, kinds: tuple[str, ...], damage: bool, only: tuple[str | None, ...]) -> DataFrame:
    """``_marks``, FILES_OF_TASK or fewer to a task: of all suppliers, or undamaged of those whose case has one of the formats ``only``."""
    rows = _marks(spark, d)
    if not damage and not set(kinds) <= set(only):
        names = {c[0] for c in cases_of(only)}
        rows = rows.filter(F.pmod("file_id", F.lit(len(cases_of(kinds)))).isin([n for n, c in enumerate(cases_of(kinds)) if c[0] in names]))
    return rows.repartition(max(1, -(-rows.count() // FILES_OF_TASK)))


def _made(batches, kinds: tuple[str, ...], damage: bool, only: tuple[str | None, ...]):
    """Arrow batches ``file_id, name, mark, kind, content`` of the ``_marks`` whose file has one of the formats ``only``, of BATCH_BYTES or one file."""
    own = cases_of(kinds)

    def batch_of(ids, names, marks, told, made):
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(c, pa.string()) for c in (names, marks, told)), pa.array(made, pa.binary())], ["file_id", "name", "mark", "kind", "content"])

    for batch in batches:
        held, size = [], 0
        for key, token in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            name, content, *_ = own[key % len(own)]
            body = marked(content, token.encode())
            body = fuzz.mutated(body, fuzz.random.Random(token)) if damage else body
            kind = scan.head_kind(body[: scan.HEAD])
            if kind not in only:
                continue
            if held and size + len(body) > BATCH_BYTES:
                yield batch_of(*zip(*held, strict=True))
                held, size = [], 0
            held.append((key, name, token, kind, body))
            size += len(body)
        if held:
            yield batch_of(*zip(*held, strict=True))


def _files(spark: SparkSession, d: str, kinds: tuple[str, ...] = ALL, damage: bool = False, only: tuple[str | None, ...] = KINDS) -> DataFrame:
    """``file_id, name, mark, kind, content``: a file per supplier, or those of the formats ``only``.

    A supplier is a few bytes and its file up to a million: rows are dealt over tasks before files are made of them.
    """
    return _dealt(spark, d, kinds, damage, only).mapInArrow(lambda batches: _made(batches, kinds, damage, only), "file_id long, name string, mark string, kind string, content binary")


def _unparsed(spark: SparkSession, d: str, kinds: tuple[str, ...], damage: bool = False) -> DataFrame:
    """``sanitise.unparsed`` of the ``_files`` that no parser takes: each is made and cleaned by one Python worker, without leaving it in between."""
    return _dealt(spark, d, kinds, damage, OTHERS).mapInArrow(lambda batches: sanitise.unparsed_batches(_made(batches, kinds, damage, OTHERS)), sanitise.UNPARSED)


def _outcomes(spark: SparkSession, d: str, kinds: tuple[str, ...], damage: bool = False) -> DataFrame:
    """Outcomes of the suppliers' files. Files without a parser are made and read once; the others are small and read by several branches, so they are stored."""
    done = []
    if damage or set(kinds) & set(OTHERS):
        done.append(sanitise.outcomes(_unparsed(spark, d, kinds, damage)))
    if damage or set(kinds) & set(PARSED):
        shared_folder(spark)
        done.append(sanitise.clean(_files(spark, d, kinds, damage, PARSED).checkpoint()))
    return functools.reduce(DataFrame.unionByName, done)


def _clean(spark: SparkSession, d: str, kinds: tuple[str, ...]) -> DataFrame:
    own = cases_of(kinds)
    name = F.get(F.array(*(F.lit(c[0]) for c in own)), F.pmod("file_id", F.lit(len(own))).cast("int"))
    done = _outcomes(spark, d, kinds).join(_marks(spark, d).select("file_id", name.alias("name"), "mark"), "file_id", "left")
    leaked = F.coalesce(F.contains("result", F.col("mark").cast("binary")), F.lit(False))
    return done.select("file_id", "name", "status", "error_key", leaked.alias("leaked"))


def _expected(kinds: tuple[str, ...]) -> str:
    """SQL of what becomes of each supplier's file."""
    quoted = lambda text: "NULL" if text is None else f"'{text}'"
    own = cases_of(kinds)
    rows = ", ".join(f"({n}, {quoted(name)}, {quoted(status)}, {quoted(key)})" for n, (name, _, status, key, _) in enumerate(own))
    return f"SELECT s_suppkey AS file_id, name, status, error_key FROM supplier JOIN (VALUES {rows}) c(n, name, status, error_key) ON n = s_suppkey % {len(own)}"


FORMATS = {
    "png_clean": (parts.PNG,), "gif_clean": (parts.GIF,), "webp_clean": (parts.WEBP,), "jpeg_clean": (parts.JPEG,), "tiff_clean": (parts.TIFF,),
    "bmp_to_png": (parts.BMP,), "heif_clean": (parts.HEIC, parts.AVIF), "mp4_clean": (parts.MP4, parts.MOV),
}


def media_parts(spark: SparkSession, d: str) -> DataFrame:
    shared_folder(spark)
    table = sanitise.decided(parts.parts(_files(spark, d, only=PARSED).checkpoint()))
    return table.groupBy("kind", F.decode("part", "ISO-8859-1").alias("part"), "keep", "refusal").agg(F.count(F.lit(1)).alias("n"))


def media_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return publish.summary(_outcomes(spark, d, ALL))


def damaged_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return publish.summary(_outcomes(spark, d, ALL, damage=True))


QUERIES = {name: lambda spark, d, kinds=kinds: _clean(spark, d, kinds) for name, kinds in FORMATS.items()}
QUERIES |= {f.__name__: f for f in (media_parts, media_outcomes, damaged_outcomes)}

ORACLE_SQL = {name: f"SELECT *, false AS leaked FROM ({_expected(kinds)})" for name, kinds in FORMATS.items()}
ORACLE_SQL["media_outcomes"] = f"SELECT status, coalesce(error_key, '') AS error_key, count(*) AS n FROM ({_expected(ALL)}) GROUP BY 1, 2"
