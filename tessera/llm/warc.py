"""WARC archives: pages written as response, continuation and revisit records, and read back by segment reassembly.

Each record is a gzip member of its own, as the format asks, and goes through Spark's text writer as raw bytes, one row
per member: a member ends with the high byte of its length, which is zero below 16 MiB, and the writer is told to end
its rows with that byte. A block beyond ``SEGMENT`` bytes is cut into segments. The reader inflates a file piece by piece
and parses record by record, once; records of one segment are finished there, and segments are grouped by the
identifier of their origin, ordered by number, checked against the total length, joined and freed of chunked framing.
"""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.cluster import shared_dir
from tessera.llm.exact_dedup import with_winners

#: Bytes of a record's block beyond which it is segmented, and of a transfer chunk.
SEGMENT, CHUNK = 48 << 10, 16 << 10
#: Payloads of fewer bytes are always written whole.
REVISIT_FROM = 100
#: Revisits, of some 50 bytes each, up to which they are broadcast instead of shuffling the pages.
BROADCAST_ROWS = 100_000
#: Records in one archive at most; bytes of a member before compression, and of a file that are inflated at once.
RECORDS, MEMBER, PIECE = 1 << 14, 8 << 20, 1 << 16
_URN = "urn:tessera:page:"


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """The payload in chunked transfer framing."""
    parts = [b"%x\r\n%s\r\n" % (len(piece := payload[at : at + size]), piece) for at in range(0, len(payload), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; chunk extensions and trailers are skipped; ValueError if the framing is broken."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunked framing ends early")
        stated = body[at:end].split(b";")[0].strip()
        if not stated or stated.strip(b"0123456789abcdefABCDEF"):
            raise ValueError("a chunk states no size")
        size = int(stated, 16)
        if not size:
            return b"".join(out)
        at = end + 2
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk has another length than stated")
        out.append(body[at : at + size])
        at += size + 2


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP response block."""
    head, _, body = block.partition(b"\r\n\r\n")
    fields = dict(line.lower().split(b":", 1) for line in head.split(b"\r\n")[1:] if b":" in line)
    return unchunked(body) if fields.get(b"transfer-encoding", b"").strip() == b"chunked" else body


def _record(kind: str, record_id: str, fields: list[tuple[str, object]], block: bytes) -> bytes:
    """A whole record."""
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), *fields, ("Content-Length", len(block))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def members(record: bytes) -> list[bytes]:
    """The record as gzip members without their last byte, a zero; more than one only for huge headers."""
    out = []
    for at in range(0, len(record), MEMBER):
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        out.append((packer.compress(record[at : at + MEMBER]) + packer.flush())[:-1])
    return out


def inflated(content: bytes):
    """The bytes of all members of an archive, piece by piece; ValueError where it is damaged or cut short."""
    at, stream = 0, None
    try:
        while at < len(content):
            piece = content[at : at + PIECE]
            at += len(piece)
            while piece:
                stream = stream or zlib.decompressobj(31)
                yield stream.decompress(piece)
                piece = stream.unused_data
                if stream.eof:
                    stream = None
    except zlib.error as error:
        raise ValueError("an archive is damaged") from error
    if stream is not None:
        raise ValueError("an archive ends early")


def page_records(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, unique: str, segment: int = SEGMENT) -> list[bytes]:
    """The records of one page: a revisit of ``refers_to``, or a response with its continuations."""
    record_id = f"{_URN}{'' if page_id is None else page_id}:{unique}"
    uri = "".join(c for c in url or "" if c > " ")
    about = [("WARC-Target-URI", uri), ("WARC-Date", "2000-01-01T00:00:00Z"), ("WARC-Payload-Digest", f"sha256:{hashlib.sha256(payload).hexdigest()}"), ("X-Payload-Length", len(payload))]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    kind = ("Content-Type", "application/http; msgtype=response")
    if refers_to is not None:
        profile = ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        return [_record("revisit", record_id, [*about, kind, profile, ("WARC-Refers-To", f"<{_URN}{refers_to}>")], http)]
    block = http + chunked(payload)
    if len(block) <= segment:
        return [_record("response", record_id, [*about, kind], block)]
    out = [_record("response", record_id, [*about, kind, ("WARC-Segment-Number", 1)], block[:segment])]
    for n, at in enumerate(range(segment, len(block), segment), 2):
        fields = [("WARC-Segment-Origin-ID", f"<{record_id}>"), ("WARC-Segment-Number", n)]
        if at + segment >= len(block):
            fields.append(("WARC-Segment-Total-Length", len(block)))
        out.append(_record("continuation", f"{record_id}:{n}", fields, block[at : at + segment]))
    return out


def parse(pieces):
    """(fields with lower-case names, block) of each record of an archive, given as bytes or as pieces of them.

    ValueError where the format is broken. Only the record at hand is kept.
    """
    pieces = iter([pieces] if isinstance(pieces, bytes) else pieces)
    held, at, searched = bytearray(), 0, 0

    def more() -> bool:
        nonlocal at, searched
        piece = next(pieces, None)
        if at:
            del held[:at]
            searched, at = max(0, searched - at), 0
        held.extend(piece or b"")
        return piece is not None

    while True:
        while (end := held.find(b"\r\n\r\n", max(at, searched))) < 0:
            searched = max(at, len(held) - 3)
            if not more():
                if len(held) > at:
                    raise ValueError("a record has no header")
                return
        lines = bytes(held[at:end]).split(b"\r\n")
        if not lines[0].startswith(b"WARC/"):
            raise ValueError("a record has no header")
        fields = {}
        for line in lines[1:]:
            name, _, value = line.partition(b":")
            fields[name.decode().lower()] = value.strip().decode()
        at = searched = end + 4
        stated = fields.get("content-length", "")
        if not (stated.isascii() and stated.isdigit()):
            raise ValueError("a record states no length")
        size = int(stated)
        while len(held) - at < size + 4:
            if not more():
                raise ValueError("a record has another length than stated")
        if held[at + size : at + size + 4] != b"\r\n\r\n":
            raise ValueError("a record has another length than stated")
        yield fields, bytes(held[at : at + size])
        at = searched = at + size + 4


def _page(urn: str | None) -> int | None:
    number = (urn or "").strip("<>").removeprefix(_URN).split(":")[0]
    return int(number) if number else None


def write_archives(pages: DataFrame, path: str, segment: int = SEGMENT) -> None:
    """Write a record per row of ``pages`` (``page_id, url, html``) as gzip archives under ``path``.

    Of rows with equal payloads of at least ``REVISIT_FROM`` bytes the one with the smallest ``page_id`` is the
    response and the others revisit it; rows that repeat its ``page_id`` are responses too. Null ids revisit, or are
    responses where their payload has no other id. A null html is an empty payload. Other columns are ignored.
    """
    spark = pages.sparkSession
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    digest = F.unhex(F.sha2(F.col("html"), 256))
    large = own.filter(F.octet_length("html") >= REVISIT_FROM).select("page_id", digest.alias("digest")).checkpoint()
    won = with_winners(large, "digest", "page_id", least=True)
    again = won.filter("keep_id IS NOT NULL AND NOT (page_id <=> keep_id)").select(F.col("page_id").alias("own_id"), F.col("digest").alias("own_digest"), F.col("keep_id").alias("refers_to")).distinct().checkpoint()
    if again.count() <= BROADCAST_ROWS:
        again = F.broadcast(again)  # counted just now; pages then stay where they are
    marked = own.withColumn("digest", digest).join(again, F.col("page_id").eqNullSafe(F.col("own_id")) & (F.col("digest") == F.col("own_digest")), "left")

    def render(batches):
        from pyspark import TaskContext

        n, part = 0, TaskContext.get().partitionId()
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                out = []
                for row in batch.slice(at, 64).to_pylist():
                    for record in page_records(row["page_id"], row["url"], row["html"].encode(), row["refers_to"], f"{part}-{n}", segment):
                        out += members(record)
                    n += 1
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    marked.select("page_id", "url", "html", "refers_to").mapInArrow(render, "record binary").select(F.col("record").cast("string").alias("value")).write.options(lineSep="\0", compression="none", maxRecordsPerFile=str(RECORDS)).text(path)


_FIELDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
_RAW = f"{_FIELDS}, origin string, segment int, total long, block binary"


def _finished(fields: dict, block: bytes, keep: bool) -> tuple:
    """A row of _FIELDS; ValueError if the payload differs from what its record states."""
    kind = fields["warc-type"]
    digest, size = fields["warc-payload-digest"].removeprefix("sha256:"), int(fields["x-payload-length"])
    payload = None
    if kind == "response":
        payload = payload_of(block)
        if len(payload) != size or hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError("a payload differs from its digest")
    return _page(fields["warc-record-id"]), size, digest, kind, _page(fields.get("warc-refers-to")), payload if keep else None


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    names, types = zip(*(f.split() for f in schema.split(", ")), strict=True)
    columns = zip(*rows, strict=True) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(columns, types, strict=True)], list(names))


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """Records of the archives under ``path``: ``page_id, payload_bytes, payload_digest, record_type, refers_to`` and, if asked for, ``payload``.

    A missing, repeated or short segment, broken framing and a payload that differs from its digest raise an error.
    """

    def look(batches):
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for fields, block in parse(inflated(content.as_py())):
                    number = int(fields.get("warc-segment-number", 0))
                    if not number:
                        rows.append((*_finished(fields, block, payloads), None, None, None, None))
                        continue
                    total = fields.get("warc-segment-total-length")
                    origin = fields.get("warc-segment-origin-id", fields["warc-record-id"])
                    digest, size = fields.get("warc-payload-digest", "").removeprefix("sha256:") or None, fields.get("x-payload-length")
                    rows.append((None, size and int(size), digest, fields["warc-type"], None, None, origin, number, total and int(total), block))
                    if len(rows) >= 256:
                        yield _table(rows, _RAW)
                        rows = []
                yield _table(rows, _RAW)

    def reassemble(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["segment"])
        block = b"".join(r["block"] for r in rows)
        if [r["segment"] for r in rows] != list(range(1, len(rows) + 1)) or rows[-1]["total"] != len(block):
            raise ValueError(f"segments of {rows[0]['origin']} don't add up")
        first = rows[0]
        fields = {"warc-type": first["record_type"], "warc-payload-digest": first["payload_digest"], "x-payload-length": first["payload_bytes"], "warc-record-id": first["origin"]}
        return pa.Table.from_batches([_table([_finished(fields, block, payloads)], _FIELDS)])

    shared_dir(spark, "records")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    records = files.mapInArrow(look, _RAW).checkpoint()  # parsed once: segments, and a row of numbers for each other record
    names = [f.split()[0] for f in _FIELDS.split(", ")]
    whole = records.filter("origin IS NULL").select(*names)
    joined = records.filter("origin IS NOT NULL").groupBy("origin").applyInArrow(reassemble, _FIELDS)
    found = whole.unionByName(joined)
    return found if payloads else found.drop("payload")


def unanswered(found: DataFrame) -> DataFrame:
    """Revisits of ``read_archives`` whose response is missing or has another digest."""
    answers = found.filter("record_type = 'response'").select(F.col("page_id").alias("answer_id"), F.col("payload_digest").alias("answer"))
    return found.filter("record_type = 'revisit'").join(answers, (F.col("refers_to") == F.col("answer_id")) & (F.col("payload_digest") == F.col("answer")), "left_anti")


def round_trip(pages: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Write the archives of ``pages`` to the shared folder and read them back."""
    path = shared_dir(pages.sparkSession, "archives")
    write_archives(pages, path, segment)
    return read_archives(pages.sparkSession, path)
