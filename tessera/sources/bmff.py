"""ISO base media files (HEIF, AVIF, MP4, QuickTime) as tables: boxes, and the items of a meta box with their references.

Files of these kinds are inspected, not yet cleaned. A parser walks bytes in Arrow batches and ends with an error row
where the structure breaks; what holds between rows is checked by joins, windows and closure.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import compare, constraints, graph
from tessera.sources.jpeg import Broken

# Boxes that hold boxes, with the bytes before the first one; limits of what a file may hold.
CONTAINERS = {**dict.fromkeys("moov trak mdia minf dinf stbl edts udta iprp ipco mvex".split(), 0), "meta": 4, "iref": 4}
MOST_BOXES = 1 << 18
METADATA = ["Exif", "uri ", "mime", "jumb"]


def walk(data: bytes, start: int, end: int) -> Iterator[tuple[str, int, int, int]]:
    """(type, header, content, end) of the boxes of a range: 32-bit and 64-bit sizes, or up to the end."""
    n = 0
    while start < end:
        n += 1
        if n > MOST_BOXES:
            raise Broken("unsupported_part")
        size, head = int.from_bytes(data[start : start + 4], "big"), 8
        if size == 1:
            size, head = int.from_bytes(data[start + 8 : start + 16], "big"), 16
        elif size == 0:
            size = end - start
        if start + head > end or size < head or start + size > end:
            raise Broken()
        yield data[start + 4 : start + 8].decode("latin-1"), start, start + head, start + size
        start += size


def _tree(data: bytes) -> Iterator[tuple]:
    """(ord, parent, depth, type, start, content, end) in file order, then an error row if the walk breaks."""
    rows: list[tuple] = []

    def into(start: int, end: int, parent: int | None, depth: int) -> None:
        for kind, at, content, stop in walk(data, start, end):
            own = len(rows)
            rows.append((own, parent, depth, kind, at, content, stop, None))
            if kind in CONTAINERS and depth < 16 and not (kind == "meta" and data[content + 4 : content + 8] == b"hdlr"):
                into(content + CONTAINERS[kind], stop, own, depth + 1)
            elif kind == "meta":  # QuickTime's has no version
                into(content, stop, own, depth + 1)

    try:
        into(0, len(data), None, 0)
    except Broken as broken:
        rows.append((len(rows), None, 0, "", len(data), len(data), len(data), broken.key))
    yield from rows


BOXES = "file_id long, ord int, parent int, depth int, box string, start long, content long, end long, error string"


def boxes(files: DataFrame) -> DataFrame:
    """A row per box of each file (``file_id, content``), offsets only."""

    def look(batches):
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        for batch in batches:
            for file_id, content in zip(batch.column("file_id").to_pylist(), batch.column("content"), strict=True):
                rows = [(file_id, *r) for r in _tree(content.as_py() or b"")]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 9, kinds, strict=True)], [f.split()[0] for f in BOXES.split(", ")])

    return files.select("file_id", "content").mapInArrow(look, BOXES)


class _Cursor:
    """Numbers of a box, read in order."""

    def __init__(self, data: bytes, at: int, end: int):
        self.data, self.at, self.end = data, at, end

    def number(self, size: int) -> int:
        if self.at + size > self.end:
            raise Broken()
        self.at += size
        return int.from_bytes(self.data[self.at - size : self.at], "big")


def layout(data: bytes) -> dict[str, list[tuple]]:
    """``items`` (id, type), ``extents`` (id, n, start, end), ``refs`` (type, origin, target, n), ``primary`` (id) of the meta box."""
    out: dict[str, list[tuple]] = {"items": [], "extents": [], "refs": [], "primary": []}
    metas = [b for b in walk(data, 0, len(data)) if b[0] == "meta"]
    if len(metas) != 1:
        raise Broken("unsupported_part")
    children = list(walk(data, metas[0][2] + 4, metas[0][3]))
    own = {kind: (content, end) for kind, _, content, end in children}
    if any(sum(c[0] == k for c in children) != 1 for k in ("pitm", "iinf", "iloc")):
        raise Broken("unsupported_part")
    read = _Cursor(data, *own["pitm"])
    out["primary"].append((read.number(2 if read.number(4) >> 24 == 0 else 4),))
    read = _Cursor(data, *own["iinf"])
    count = read.number(2 if read.number(4) >> 24 == 0 else 4)
    records = list(walk(data, read.at, read.end))
    if len(records) != count:
        raise Broken()
    for kind, _, content, end in records:
        read = _Cursor(data, content, end)
        version = read.number(4) >> 24
        if kind != "infe" or version not in (2, 3):
            raise Broken("unsupported_part")
        ident = read.number(2 if version == 2 else 4)
        if read.number(2):
            raise Broken("unsupported_part")
        out["items"].append((ident, read.number(4).to_bytes(4, "big").decode("latin-1")))
    read = _Cursor(data, *own["iloc"])
    version, sizes = read.number(4) >> 24, read.number(2)
    if version > 2:
        raise Broken("unsupported_part")
    offset, length, base, index = sizes >> 12, sizes >> 8 & 15, sizes >> 4 & 15, sizes & 15 if version else 0
    wide = 4 if version == 2 else 2
    for _ in range(read.number(wide)):
        ident, method = read.number(wide), read.number(2) if version else 0
        if read.number(2) or method > 1 or method and "idat" not in own:
            raise Broken("unsupported_part")
        start, limit = own["idat"] if method else (0, len(data))
        start += read.number(base)
        for n in range(read.number(2)):
            read.number(index)
            at, size = start + read.number(offset), read.number(length)
            if at + size > limit:
                raise Broken()
            out["extents"].append((ident, n, at, at + size))
    if read.at != read.end:
        raise Broken()
    if "iref" in own:
        content, end = own["iref"]
        wide = 2 if data[content] == 0 else 4
        for kind, _, at, stop in walk(data, content + 4, end):
            read = _Cursor(data, at, stop)
            origin, n = read.number(wide), read.number(2)
            out["refs"] += [(kind, origin, read.number(wide), k) for k in range(n)]
            if read.at != stop:
                raise Broken()
    return out


LAYOUT = (
    "file_id long, error string, primary array<struct<item_id: long>>, items array<struct<item_id: long, type: string>>, "
    "extents array<struct<item_id: long, n: int, start: long, end: long>>, refs array<struct<type: string, origin: long, target: long, n: int>>"
)


def layouts(files: DataFrame) -> DataFrame:
    """The item tables of each HEIF or AVIF file as arrays, or the key why they can't be read."""

    def look(batches):
        i, s, n = pa.int64(), pa.string(), pa.int32()
        kinds = {"primary": [("item_id", i)], "items": [("item_id", i), ("type", s)], "extents": [("item_id", i), ("n", n), ("start", i), ("end", i)], "refs": [("type", s), ("origin", i), ("target", i), ("n", n)]}
        for batch in batches:
            for file_id, content in zip(batch.column("file_id").to_pylist(), batch.column("content"), strict=True):
                error, found = None, {k: None for k in kinds}
                try:
                    found = layout(content.as_py())
                except Broken as broken:
                    error = broken.key
                lists = [pa.array([found[k] and [dict(zip([f for f, _ in fields], row, strict=True)) for row in found[k]]], pa.list_(pa.struct(fields))) for k, fields in kinds.items()]
                yield pa.RecordBatch.from_arrays([pa.array([file_id], i), pa.array([error], s), *lists], ["file_id", "error", *kinds])

    return files.filter(F.col("kind").isin("HEIC", "AVIF")).select("file_id", "content").mapInArrow(look, LAYOUT)


def table(laid: DataFrame, name: str) -> DataFrame:
    """One of the arrays as rows with their ``file_id``."""
    return laid.select("file_id", F.explode(name).alias("row")).select("file_id", "row.*")


def refusals(laid: DataFrame) -> DataFrame:
    """``file_id, refusal``: the structural errors of item tables; a file without one has no row."""
    items, extents, refs, primary = (table(laid, n) for n in ("items", "extents", "refs", "primary"))
    key = lambda df, column, name="node": df.select("file_id", F.struct("file_id", F.col(column).alias("item")).alias(name))
    known, located = key(items, "item_id"), key(extents, "item_id", "at")
    named = key(refs, "origin", "end").unionByName(key(refs, "target", "end")).unionByName(key(primary, "item_id", "end"))
    found = [laid.filter("error IS NOT NULL").select("file_id", F.col("error").alias("refusal"))]
    damage = [
        constraints.repeated(items, ["file_id", "item_id"]), graph.dangling(named, "end", known, "node"), graph.dangling(located, "at", known, "node"),
        items.filter(~F.col("type").isin(*METADATA)).join(extents, ["file_id", "item_id"], "left_anti"),
        extents.filter("start = end").join(items.filter(~F.col("type").isin(*METADATA)), ["file_id", "item_id"], "left_semi"),
    ]
    found += [d.select("file_id", F.lit("damaged").alias("refusal")) for d in damage]
    spans = extents.filter("end > start").select("file_id", "start", "end").distinct()
    before = F.max("end").over(Window.partitionBy("file_id").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    found.append(spans.withColumn("before", before).filter("before > start").select("file_id", F.lit("unsupported_part").alias("refusal")))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.groupBy("file_id").agg(F.min("refusal").alias("refusal"))


def built_from(laid: DataFrame) -> DataFrame:
    """``file_id, item_id``: the primary image of each file and every item it is derived from or described by."""
    node = lambda column: F.struct("file_id", F.col(column).alias("item_id"))
    refs = table(laid, "refs")
    edges = refs.filter(F.col("type") == "dimg").select(node("origin").alias("origin"), node("target").alias("target"))
    edges = edges.unionByName(refs.filter(F.col("type").isin("auxl", "cdsc")).select(node("target").alias("origin"), node("origin").alias("target")))
    return graph.closure(edges, table(laid, "primary").select(node("item_id").alias("node"))).select("node.file_id", "node.item_id")


def box_changes(now: DataFrame, then: DataFrame) -> DataFrame:
    """Boxes by type and size that one walk has and the other hasn't, per file, as a multiset."""
    shape = lambda df: df.select("file_id", "box", (F.col("end") - F.col("start")).alias("size"))
    return compare.multiset_diff(shape(now), shape(then))
