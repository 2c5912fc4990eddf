"""Clean copies of media files as a plan: parse, decide by allowlist, serialise, parse again and compare.

Parsing and serialising run in Arrow batches. What is kept, rewritten, dropped or refused is decided between them by a
broadcast policy, windows over a file's parts and the first error in file order. Each file ends as one outcome row; a
doubt about one file never stops the others.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.lineage import shared_folder
from tessera.sources import heif, jpeg, movie, scan, tiff
from tessera.sources.parts import AVIF, BMP, GIF, HEIC, JPEG, LOOPS, MOV, MP4, PARSERS, PNG, PROFILE, TIFF, WEBP, Refused, parts, riff_chunk, shown_image

# Parts that a clean copy may hold. (format, part, sizes or none for any, once, only before image data)
POLICY = [
    (PNG, b"IHDR", [13], False, False), (PNG, b"PLTE", None, False, False), (PNG, b"tRNS", None, False, False), (PNG, b"IDAT", None, False, False),
    (PNG, b"IEND", [0], False, False), (PNG, b"gAMA", [4], True, True), (PNG, b"cHRM", [32], True, True), (PNG, b"sRGB", [1], True, True),
    (PNG, b"cICP", [4], True, True), (PNG, b"sBIT", [1, 2, 3, 4], True, True), (PNG, b"mDCV", [24], True, True), (PNG, b"cLLI", [8], True, True),
    (PNG, b"pHYs", [9], True, True), (PNG, b"bKGD", [1, 2, 6], True, True), (PNG, b"acTL", [8], True, True), (PNG, b"fcTL", [26], False, False),
    (PNG, b"fdAT", None, False, False), (PNG, b"iCCP", None, True, True), (PNG, b"eXIf", None, True, False),
    (WEBP, b"VP8X", [10], False, False), (WEBP, b"VP8 ", None, False, False), (WEBP, b"VP8L", None, False, False), (WEBP, b"ALPH", None, False, False),
    (WEBP, b"ANIM", [6], True, False), (WEBP, b"ANMF", None, False, False), (WEBP, b"ICCP", None, True, False), (WEBP, b"EXIF", None, True, False),
    (JPEG, b"SOI", None, False, False), (JPEG, b"EOI", None, False, False), (JPEG, b"DB", None, False, False), (JPEG, b"C4", None, False, False),
    (JPEG, b"DRI", None, False, False), (JPEG, b"SOS", None, False, False), (JPEG, b"coding", None, False, False), (JPEG, b"DNL", None, False, False),
    (JPEG, b"JFIF", None, True, False), (JPEG, b"Exif", None, True, False), (JPEG, b"XMP", None, True, False), (JPEG, b"ICC", None, False, False), (JPEG, b"Adobe", None, True, False),
    (JPEG, b"ISO", None, True, False), (JPEG, b"AROT", None, True, False), (JPEG, b"MPF", None, True, False), (JPEG, b"picture", None, False, False),
    (TIFF, b"head", [2], False, False), (TIFF, b"block", None, False, False), *((TIFF, b"tag%d" % tag, None, False, False) for tag in tiff.KEPT),
    (GIF, b"header", None, False, False), (GIF, b"image", None, False, False), (GIF, b"control", None, False, False), (GIF, b"trailer", None, False, False),
    *((GIF, name, None, True, False) for name in LOOPS), (GIF, PROFILE, None, True, False),
]
REWRITTEN = {b"eXIf", b"EXIF", b"ANMF", b"image", b"control", b"iCCP", b"ICCP", PROFILE, *LOOPS, b"DNL", b"JFIF", b"Exif", b"ICC", b"Adobe", b"coding", b"DRI", b"SOS", b"XMP", b"tag34675", b"ISO", b"AROT", b"MPF", b"picture"}
MAX_DROPPED, MEGAPIXELS, ANIMATION_MEGAPIXELS, FRAME = 1024, 268, 64, 1 << 16


def alive(table: DataFrame) -> DataFrame:
    """``file_id, ord`` of the coding tables that a scan reads: of each slot the last definition before the scan."""
    own = table.filter((F.col("kind") == JPEG) & F.col("note").isNotNull()).select("file_id", "ord", "note", (F.col("part") == b"SOS").alias("reads"))
    slots = own.withColumn("slot", F.explode(F.split("note", ",")))
    latest = F.last(F.when(~F.col("reads"), F.col("ord")), ignorenulls=True).over(Window.partitionBy("file_id", "slot").orderBy("ord"))
    return slots.withColumn("latest", latest).filter(F.col("reads") & F.col("latest").isNotNull()).select("file_id", F.col("latest").alias("ord")).distinct()


def decided(table: DataFrame, coding: DataFrame | None = None) -> DataFrame:
    """``parts`` with ``keep`` and ``refusal`` (a key, by part) under the policy.

    ``coding`` has the parts of JPEG files only, where these can be had without parsing the others again.
    """
    spark = table.sparkSession
    rows = [(f, p, s, o, b, p in REWRITTEN) for f, p, s, o, b in POLICY]
    policy = spark.createDataFrame(rows, "kind string, part binary, sizes array<int>, once boolean, early boolean, is_rewritten boolean")
    by = Window.partitionBy("file_id")
    order = by.orderBy("ord")
    # Rows behind one, nearest last: a frame that ends with the file's last row would be walked again for each row.
    behind = by.orderBy(F.desc("ord")).rowsBetween(Window.unboundedPreceding, -1)
    code = F.col("part").cast("string")
    joined = table.join(F.broadcast(policy), ["kind", "part"], "left").withColumn("known", F.col("once").isNotNull())  # a fixed table of a few rows
    joined = joined.join(alive(table if coding is None else coding).withColumn("is_alive", F.lit(True)), ["file_id", "ord"], "left")
    known = F.col("known")
    image_at = F.min(F.when((F.col("kind") == PNG) & (code == "IDAT"), F.col("ord"))).over(by)
    color = F.max(F.when((code == "IHDR") & (F.col("ord") == 0), F.conv(F.hex(F.substring("payload", 10, 1)), 16, 10).cast("int"))).over(by)
    usable = known & (~F.col("is_rewritten") | F.col("rewritten").isNotNull() | code.isin("eXIf", "EXIF", "Exif", "XMP") | F.col("rewriting").isNotNull())
    late = F.coalesce(F.col("early") & (image_at < F.col("ord")), F.lit(False))
    again = F.coalesce(F.col("once"), F.lit(False)) & (F.sum(F.when(usable, 1).otherwise(0)).over(Window.partitionBy("file_id", "part").orderBy("ord")) > 1)
    flagged = joined.withColumns({"image_at": image_at, "color": color, "late": late, "again": again, "usable": usable})
    animated = F.min(F.when((code == "acTL") & ~F.col("late"), F.col("ord"))).over(by)
    stray = code.isin("fcTL", "fdAT") & F.coalesce(animated > F.col("ord"), F.lit(True))
    plain = (code == "PLTE") & F.col("color").isin(2, 6)
    # Of graphic controls in a row the last before an image counts.
    following = F.last(F.when(code.isin("image", "control"), code), ignorenulls=True).over(behind)
    overruled = (F.col("kind") == GIF) & (code == "control") & F.coalesce(following != "image", F.lit(True))
    dropped = F.sum(F.when((F.col("kind") == GIF) & (~F.col("usable") | F.col("again")), 1).otherwise(0)).over(order)
    # A simple WebP is its first chunk.
    simple = (F.col("kind") == WEBP) & (F.col("ord") > 0) & F.first(code).over(order).isin("VP8 ", "VP8L")
    dead = F.col("note").isNotNull() & (code != "SOS") & F.col("is_alive").isNull()
    skip = F.col("late") | F.col("again") | stray | plain | overruled | simple | dead
    wrong_size = F.col("sizes").isNotNull() & ~F.array_contains("sizes", F.octet_length("payload"))
    critical = (F.col("kind") == PNG) & ~known & code.rlike("^[A-Z]")
    is_png = F.col("kind") == PNG
    refusal = (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(is_png & ((F.col("ord") == 0) != (code == "IHDR")), "damaged")
        .when(known & ~F.col("sound"), "damaged")
        .when((F.col("kind") == GIF) & (dropped > MAX_DROPPED), "unsupported_part")
        .when(skip, None)
        .when(known & (wrong_size | ((code == "fdAT") & (F.octet_length("payload") < 4))), "damaged")
        .when(F.col("rewriting").isNotNull(), F.col("rewriting"))
        .when(critical, "unsupported_part")
    )
    emptied = F.col("is_rewritten") & F.col("rewritten").isNull()
    keep = known & ~skip & ~emptied
    # A control goes right before its image, whatever stood between.
    image_next = F.last(F.when(code == "image", F.col("ord")), ignorenulls=True).over(behind)
    place = F.when(code == "control", image_next * 2 - 1).otherwise(F.col("ord") * 2)
    out = flagged.withColumns({"refusal": refusal, "keep": F.coalesce(keep, F.lit(False)), "place": place})
    return out.select("file_id", "kind", "ord", "place", "part", F.coalesce("rewritten", "payload").alias("payload"), "keep", "refusal")


def _inflates_to(pieces: list[bytes], expected: int) -> None:
    """One zlib stream of exactly so many bytes and nothing behind it; never more than a step of it in memory."""
    stream, made = zlib.decompressobj(), 0
    try:
        for piece in pieces:
            if stream.eof and piece:
                raise Refused("extra_image_data")
            while piece and not stream.eof:
                made += len(stream.decompress(piece, 1 << 20))
                if made > expected:
                    raise Refused("extra_image_data")
                piece = stream.unconsumed_tail
        while made <= expected and not stream.eof and (more := stream.decompress(b"", 1 << 20)):
            made += len(more)
    except zlib.error:
        raise Refused("damaged") from None
    if stream.unused_data or made > expected:
        raise Refused("extra_image_data")
    if not stream.eof or made != expected:
        raise Refused("damaged")


def _lines(width: int, height: int, bits: int, interlaced: bool) -> int:
    """Bytes of an image's filtered scanlines over its passes."""
    # First column, column step, first row and row step of each pass.
    steps = [(0, 8, 0, 8), (4, 8, 0, 8), (0, 4, 4, 8), (2, 4, 0, 4), (0, 2, 2, 4), (1, 2, 0, 2), (0, 1, 1, 2)] if interlaced else [(0, 1, 0, 1)]
    sizes = [(len(range(x, width, dx)), len(range(y, height, dy))) for x, dx, y, dy in steps]
    return sum(rows * (1 + -(-columns * bits // 8)) for columns, rows in sizes if columns)


# Channels, bit depths and bytes of bKGD by color type.
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
_DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}
_BACKGROUND = {0: 2, 2: 6, 3: 1, 4: 2, 6: 6}


def _need(truth: bool, key: str = "damaged") -> None:
    if not truth:
        raise Refused(key)


def finish_png(own: list[tuple[bytes, bytes]]) -> bytes:
    """A PNG of the kept parts: checked against its header, image data in pieces of one size, frames numbered from 0."""
    width, height, depth, color, method, filters, interlaced = struct.unpack(">IIBBBBB", own[0][1])
    _need(width > 0 and height > 0 and depth in _DEPTHS.get(color, ()) and not method and not filters and interlaced < 2)
    _need(width * height <= MEGAPIXELS * 10**6, "too_large")
    held: dict[bytes, list[bytes]] = {}
    for code, body in own:
        held.setdefault(code, []).append(body)
    palette, alpha = held.get(b"PLTE", []), held.get(b"tRNS", [])
    _need(len(palette) <= 1 and len(alpha) <= 1 and (color != 3 or bool(palette)) and not (color in (0, 4) and palette))
    colors = len(palette[0]) // 3 if palette else 0
    _need(not palette or (len(palette[0]) % 3 == 0 and 0 < colors <= 256))
    _need(not alpha or len(alpha[0]) in {0: [2], 2: [6], 3: range(1, colors + 1)}.get(color, []))
    for body in held.get(b"bKGD", []):
        _need(len(body) == _BACKGROUND[color])
        levels = body if color == 3 else struct.unpack(f">{len(body) // 2}H", body)
        _need(max(levels) < (colors if color == 3 else 1 << depth))
    for body in held.get(b"sBIT", []):
        _need(len(body) == (3 if color == 3 else _CHANNELS[color]) and all(1 <= b <= (8 if color == 3 else depth) for b in body))
    _need(all(b[0] <= 3 for b in held.get(b"sRGB", [])) and all(b[2] == 0 and b[3] <= 1 for b in held.get(b"cICP", [])) and all(b[8] <= 1 for b in held.get(b"pHYs", [])))
    bits = depth * _CHANNELS[color]
    _inflates_to(held.get(b"IDAT", []), _lines(width, height, bits, bool(interlaced)))
    _need(all(int.from_bytes(b[:4], "big") == len(held.get(b"fcTL", [])) for b in held.get(b"acTL", [])))
    frames: list[tuple[int, int, list[bytes]]] = []
    out, number, run = [], 0, None
    for code, body in [*own, (b"", b"")]:
        if run and run[0] != code:  # a run of image data ends
            whole = b"".join(run[1])
            for at in range(0, len(whole), FRAME):
                piece = whole[at : at + FRAME]
                if run[0] == b"fdAT":
                    piece, number = number.to_bytes(4, "big") + piece, number + 1
                out.append((run[0], piece))
            run = None
        if code == b"fcTL":
            w, h, x, y = struct.unpack_from(">IIII", body, 4)
            _need(w > 0 and h > 0 and x + w <= width and y + h <= height)
            frames.append((w, h, []))
            body, number = number.to_bytes(4, "big") + body[4:], number + 1
        if code in (b"IDAT", b"fdAT"):
            if code == b"fdAT":
                _need(bool(frames))
                frames[-1][2].append(body[4:])
            run = run or (code, [])
            run[1].append(body[4:] if code == b"fdAT" else body)
        elif code:
            out.append((code, body))
    for w, h, pieces in frames:
        if pieces:
            _inflates_to(pieces, _lines(w, h, bits, bool(interlaced)))
    return b"\x89PNG\r\n\x1a\n" + b"".join(len(b).to_bytes(4, "big") + c + b + zlib.crc32(c + b).to_bytes(4, "big") for c, b in out)


def finish_webp(own: list[tuple[bytes, bytes]]) -> bytes:
    """A WebP of the kept parts: the simple form where nothing needs the extended one, flags that match what is held."""
    if own and own[0][0] in (b"VP8 ", b"VP8L"):
        own = own[:1]
    else:
        _need(bool(own) and own[0][0] == b"VP8X" and len(own[0][1]) == 10)
        header, rest = own[0][1], own[1:]
        across, down = (int.from_bytes(header[k : k + 3], "little") + 1 for k in (4, 7))
        _need(across * down <= (ANIMATION_MEGAPIXELS if header[0] & 2 else MEGAPIXELS) * 10**6, "too_large")
        shown = shown_image(rest)
        body = [c for n, c in enumerate(rest) if c[0] in (b"ICCP", b"ANIM", b"ANMF") or n in shown]
        turned = [c for c in rest if c[0] == b"EXIF"]
        codes = {code for code, _ in body}
        _need(bool(codes & {b"VP8 ", b"VP8L", b"ANMF"}))
        if turned or codes & {b"ICCP", b"ALPH", b"ANIM", b"ANMF"}:
            # Alpha and animation as they were, profile and EXIF if held.
            flags = header[0] & 0x12 | (0x20 if b"ICCP" in codes else 0) | (8 if turned else 0)
            own = [(b"VP8X", bytes([flags, 0, 0, 0]) + header[4:]), *body, *turned]
        else:
            own = [c for c in body if c[0] in (b"VP8 ", b"VP8L")][:1]
    data = b"WEBP" + b"".join(riff_chunk(*c) for c in own)
    return b"RIFF" + len(data).to_bytes(4, "little") + data


def finish_gif(own: list[tuple[bytes, bytes]]) -> bytes:
    return b"".join(body for _, body in own)


FINISH = {PNG: finish_png, WEBP: finish_webp, GIF: finish_gif, JPEG: jpeg.join, TIFF: tiff.join}
_RESULT = "file_id long, kind string, result binary, refusal string, units array<binary>"
#: Formats whose media data stays where it is, with what makes a clean copy and says whether that is proven.
IN_PLACE = {HEIC: heif.clean_and_prove, AVIF: heif.clean_and_prove, MP4: movie.clean_and_prove, MOV: movie.clean_and_prove}


def shown_units(kind: str, kept: list[tuple[bytes, bytes]]) -> list[bytes]:
    """Digests of what a decoder shows of the kept parts, in order, whatever the serialiser makes of framing and numbers.

    They are taken from an original and from its clean copy, parsed anew, and must be equal one by one.
    """
    units: list[tuple[bytes, bytes]] = []
    if kind == WEBP:
        shown = kept[:1] if kept and kept[0][0] in (b"VP8 ", b"VP8L") else [kept[n] for n in shown_image(kept)] + [p for p in kept if p[0] in (b"ANIM", b"ANMF", b"ICCP", b"EXIF")]
        kept = sorted(shown, key=lambda p: p[0] == b"EXIF")
    for code, body in kept:
        if kind == PNG and code in (b"IDAT", b"fdAT"):
            body = body[4:] if code == b"fdAT" else body
            if units and units[-1][0] == code:  # one stream in pieces
                units[-1] = code, units[-1][1] + body
                continue
        elif kind == PNG and code == b"fcTL" or kind == JPEG and code in (b"DB", b"C4"):
            body = body[4:]  # without the number of the frame or segment
        elif kind == TIFF and code in (b"tag273", b"tag324"):  # places of blocks
            body = body[:4]
        units.append((code, body))
    return [hashlib.sha256(code + b"\0" + body).digest() for code, body in units]


def _gathered(marked: DataFrame) -> DataFrame:
    """Per file the kept parts in order and the first refusal."""
    first = F.min(F.when(F.col("refusal").isNotNull(), F.struct("ord", "refusal")))["refusal"]
    kept = F.array_sort(F.collect_list(F.when(F.col("keep"), F.struct("place", "part", "payload"))))
    return marked.groupBy("file_id", "kind").agg(first.alias("refusal"), kept.alias("kept"))


def rebuilt(files: DataFrame, finish: dict | None = None) -> DataFrame:
    """``file_id, kind, result, refusal, units``: the clean copy of each file or the key why there is none.

    ``finish`` gives other serialisers than FINISH by format.
    """
    serialisers = finish or FINISH

    def write(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                result, refusal, units = None, row["refusal"], None
                if refusal is None:
                    kept = [(p["part"], p["payload"]) for p in row["kept"]]
                    try:
                        result, units = serialisers[row["kind"]](kept), shown_units(row["kind"], kept)
                    except (Refused, jpeg.Broken) as refused:
                        refusal = refused.key
                columns = [pa.array([row["file_id"]], pa.int64()), pa.array([row["kind"]], pa.string()), pa.array([result], pa.binary()), pa.array([refusal], pa.string()), pa.array([units], pa.list_(pa.binary()))]
                yield pa.RecordBatch.from_arrays(columns, ["file_id", "kind", "result", "refusal", "units"])

    coding = parts(files.filter(F.col("kind") == JPEG))
    return _gathered(decided(parts(files), coding)).mapInArrow(write, _RESULT)


def unparsed_batches(batches):
    """``unparsed`` of Arrow batches (``file_id, kind, content``) inside a task."""
    for batch in batches:
        for at in range(batch.num_rows):
            row, result, refusal, proven = batch.slice(at, 1).to_pylist()[0], None, None, False
            if row["content"] is None:
                refusal = "not_a_file"
            elif row["kind"] not in IN_PLACE:
                refusal = "unsupported_format"
            else:
                try:
                    result, proven = IN_PLACE[row["kind"]](row["content"])
                except jpeg.Broken as broken:
                    refusal = broken.key
            columns = [pa.array([row["file_id"]], pa.int64()), pa.array([row["kind"]], pa.string()), pa.array([result], pa.binary()), pa.array([refusal], pa.string()), pa.array([proven], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["file_id", "kind", "result", "refusal", "proven"])


UNPARSED = "file_id long, kind string, result binary, refusal string, proven boolean"


def unparsed(files: DataFrame) -> DataFrame:
    """``UNPARSED`` of files that no parser takes, each read once: cleaned in place (``IN_PLACE``) or refused.

    A result is proven if cleaning it again changes nothing and reading it beside its original finds no difference.
    """
    return files.select("file_id", "kind", "content").mapInArrow(unparsed_batches, UNPARSED)


def outcomes(proven: DataFrame) -> DataFrame:
    """``file_id, kind, status, error_key, result`` of results (``file_id, kind, result, refusal, proven``)."""
    key = F.when(F.col("refusal").isNotNull(), F.col("refusal")).when(~F.coalesce("proven", F.lit(False)), "verification_failed")
    return proven.select("file_id", "kind", F.when(key.isNull(), "cleaned").otherwise("refused").alias("status"), key.alias("error_key"), F.when(key.isNull(), F.col("result")).alias("result"))


def clean(files: DataFrame, finish: dict | None = None) -> DataFrame:
    """Outcomes of ``files`` (``file_id, kind, content``): ``file_id, kind, status, error_key, result``, the kind being the result's.

    A result counts only if it is parsed anew and every part of it is allowed, cleaning it again yields the same bytes,
    and what it shows equals what the kept parts of the original show, unit by unit; else the file is refused as
    ``verification_failed``. Files without content are ``not_a_file``, unknown kinds ``unsupported_format``. ``files`` is
    read three times; of files that no parser takes ``outcomes(unparsed(files))`` gives the same in one reading.
    """
    shared_folder(files.sparkSession)
    first = rebuilt(files, finish).checkpoint()  # parsed and serialised once, though two branches read it
    again = rebuilt(first.filter("result IS NOT NULL").select("file_id", "kind", F.col("result").alias("content")), finish)
    # The optimizer only guesses the size of what Python makes: no side of this join may be broadcast by such a guess.
    checked = first.join(again.select("file_id", F.sha2("result", 256).alias("digest"), F.col("units").alias("units_again")).hint("merge"), "file_id", "left")
    same = (F.sha2("result", 256) == F.col("digest")) & (F.col("units") == F.col("units_again"))
    parsed = checked.withColumn("proven", F.coalesce(same, F.lit(False))).select("file_id", "kind", "result", "refusal", "proven")
    # Every file that a parser takes has one row by now.
    is_parsed = F.coalesce(F.col("kind").isin(BMP, *PARSERS), F.lit(False)) & F.col("content").isNotNull()
    return outcomes(parsed.unionByName(unparsed(files.filter(~is_parsed))))


def clean_paths(spark: SparkSession, paths: list[str], largest: int) -> DataFrame:
    """Outcomes of files by path as ``clean`` gives them, with ``path``: what can't be cleaned or is larger than ``largest`` is refused unread."""
    seen = scan.admitted(spark, paths, [BMP, *PARSERS, *IN_PLACE], largest).checkpoint()
    early = seen.filter("refusal IS NOT NULL").select("file_id", "kind", F.lit("refused").alias("status"), F.col("refusal").alias("error_key"), F.lit(None).cast("binary").alias("result"))
    return clean(seen.filter("refusal IS NULL")).unionByName(early).join(seen.select("file_id", "path"), "file_id")
