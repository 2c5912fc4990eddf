"""Exact join of documents by the Jaccard similarity of their word n-grams, in size-banded tiles of bitmap signatures.

Similar sets can't differ much in size, and in any order of all n-grams each has a few first ones of which it must share
one with a similar set. So sets meet in tiles named by one of those n-grams and a band of sizes. In a tile, bitmaps
into which the n-grams are hashed bound the overlap of two sets from above: what a set has at bits that the other lacks
can't be shared. Pairs within the bound are only told as stars of sets that may be linked; the sorted arrays of those are
sent once and intersected exactly.

Equal sets are one set throughout. Sets whose very first n-gram is equal are compared with one representative before all
else, so that groups of close copies are classes when the tiles are laid; tiles and comparisons only count pairs of
different classes. The order puts the n-grams that many texts have last: a passage in a third of all texts names no tile
of texts that have anything else. Every pair of similar sets shares a tile, whatever the order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.cluster import fresh, shared_dir, small_batches, tidy, without
from tessera.llm.comparisons import block_requests, compared, labelled, set_name, shingle_sets, star_requests
from tessera.llm.exact_dedup import split_join
from tessera.llm.simhash import RADIUS, _connected, fingerprint
from tessera.llm.simhash import _stars as fingerprint_stars
from tessera.llm.textblocks import blocks, forget, mix, release

SHINGLE, PERCENT = 5, 80
#: Counters of the summary of frequent n-grams: at most so many of them are put last in the order.
COUNTERS = 4096
#: N-grams that are counted at once.
COUNTED = 1 << 18
#: Sets of a block of a tile: larger tiles are cut into blocks that meet pairwise.
TILE = 4096
#: Bits of a signature at most and at least; between, two to four for each n-gram.
MOST_BITS, LEAST_BITS = 1 << 22, 64
#: Ratio of the sizes of a band; a little over 1/0.8, so that similar sets lie in one band or in neighbours.
BAND = 1.26


def prefix(codes: np.ndarray, frequent: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The first n-grams of a sorted set by the order: of two sets that similar, each has one of the other's among them."""
    at = np.searchsorted(frequent, codes)
    last = (frequent[np.minimum(at, len(frequent) - 1)] == codes) if len(frequent) else np.zeros(len(codes), bool)
    ordered = np.concatenate([codes[~last], codes[last]])
    return ordered[: len(codes) + (-percent * len(codes) // 100) + 1] if len(codes) else codes


def signature(codes: np.ndarray) -> bytes:
    """The n-grams hashed into a bitmap of a power of two of bits."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << max(0, 2 * len(codes) - 1).bit_length()))
    out = np.zeros(bits, np.uint8)
    out[(mix(codes) & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(out).tobytes()


def bitmaps(signatures: list[bytes]) -> np.ndarray:
    """The signatures as rows of 64-bit numbers, wider ones folded to the least width."""
    width = min(map(len, signatures))
    out = np.zeros((len(signatures), width), np.uint8)
    for n, s in enumerate(signatures):
        out[n] = np.bitwise_or.reduce(np.frombuffer(s, np.uint8).reshape(-1, width), 0)
    return out.view(np.uint64)


def may_overlap(maps: np.ndarray, ones: np.ndarray, p: int, others: np.ndarray, size: int, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Whether the set of row ``p`` may be that similar to each of ``others``: bits of one that the other lacks stand for n-grams that aren't shared."""
    both = np.bitwise_count(maps[others] & maps[p]).sum(1, dtype=np.int64)
    most = np.minimum(sizes - ones[others], size - ones[p]) + both
    return (100 + percent) * most >= percent * (sizes + size)


def candidates(size, root, side, lower, maps, percent: int) -> np.ndarray:
    """A number for each set of a tile: sets of one number are connected by pairs of different classes that may be similar.

    Sets that have no such pair get -1. Pairs lie across sides 0 and 1, or within side 2; two sets of the lower band meet
    in that band's own tile.
    """
    order = np.argsort(size, kind="stable")
    size, root, side, lower, maps = size[order], root[order], side[order], lower[order], maps[order]
    ones = np.bitwise_count(maps).sum(1, dtype=np.int64)
    stop = np.searchsorted(size, 100 * size // percent, "right")
    label, met = np.arange(len(size)), np.zeros(len(size), bool)
    for p in range(len(size) - 1):
        ahead = np.arange(p + 1, stop[p])
        fit = (label[ahead] != label[p]) & (root[ahead] != root[p]) & ((side[ahead] == 2) | (side[ahead] != side[p]))
        ahead = ahead[fit & ~lower[ahead] if lower[p] else fit]
        found = ahead[may_overlap(maps, ones, p, ahead, size[p], size[ahead], percent)] if len(ahead) else ahead
        if len(found):
            met[p] = met[found] = True
            label[np.isin(label, label[found])] = label[p]
    out = np.full(len(size), -1)
    out[order] = np.where(met, label, -1)
    return out


def similar_pairs(sets: list[np.ndarray], role: np.ndarray, root: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """(i, j) of sets with at least that similarity, so many that all links between their classes are told.

    ``root`` numbers the class of each set; sets in one class aren't compared. Roles 0 and 1 are compared with each
    other only; role 2 with everything. Bit counts come first, then the sorted arrays are intersected.
    """
    percent = round(100 * similarity)
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    order = np.argsort(size, kind="stable")
    sets, role, label, size = [sets[k] for k in order], role[order], np.unique(root, return_inverse=True)[1][order], size[order]
    signatures = [signature(s) for s in sets]
    width = np.fromiter(map(len, signatures), np.int64, len(sets))
    # A set's partners ahead are of its width or twice that: each width has bitmaps of both.
    maps, ones, row = {}, {}, {}
    for w in np.unique(width).tolist():
        own = np.flatnonzero((width == w) | (width == 2 * w))
        maps[w] = bitmaps([signatures[k] for k in own])
        ones[w], row[w] = np.bitwise_count(maps[w]).sum(1, dtype=np.int64), np.searchsorted(own, np.arange(len(sets) + 1))
    stop, out = np.searchsorted(size, 100 * size // percent, "right"), []
    for p in range(len(sets)):
        ahead = np.arange(p + 1, stop[p])
        ahead = ahead[(label[ahead] != label[p]) & ((role[ahead] == 2) | (role[ahead] != role[p])) & (size[ahead] > 0)]
        w = int(width[p])
        near = ahead[may_overlap(maps[w], ones[w], row[w][p], row[w][ahead], size[p], size[ahead], percent)] if len(ahead) else ahead
        if not len(near) or not size[p]:
            continue
        other = np.concatenate([sets[k] for k in near])
        at = np.minimum(np.searchsorted(sets[p], other), size[p] - 1)
        shared = np.add.reduceat((sets[p][at] == other).astype(np.int64), np.cumsum(size[near]) - size[near])
        close = near[(100 + percent) * shared >= percent * (size[near] + size[p])]
        _, once = np.unique(label[close], return_index=True)
        out += [(int(order[p]), int(order[j])) for j in close[once]]
        if len(once):
            label[np.isin(label, label[close])] = label[p]
    return out


def frequent_shingles(rows: DataFrame, shingle: int = SHINGLE) -> np.ndarray:
    """At most COUNTERS n-grams, sorted: those in the most texts, by a Misra-Gries summary of each partition.

    An n-gram in more than one of COUNTERS places of its partitions is among them, unless COUNTERS others are more
    frequent. The order that they make is only cheaper than another, never more or less right.
    """

    def counted(seen, n, held):
        key, at = np.unique(np.concatenate([seen, *held]), return_inverse=True)
        total = np.bincount(at, np.concatenate([n, *(np.ones(len(h), np.int64) for h in held)]), len(key)).astype(np.int64)
        if len(key) > COUNTERS:
            total = total - np.partition(total, len(key) - COUNTERS - 1)[len(key) - COUNTERS - 1]
        return key[total > 0], total[total > 0]

    def summarise(batches):
        forget()
        seen, n, held, size = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0
        for batch in blocks(batches):
            for codes in shingle_sets(batch.column("text"), shingle):
                held.append(codes)
                size += len(codes)
                if size >= COUNTED:
                    seen, n = counted(seen, n, held)
                    held, size = [], 0
        seen, n = counted(seen, n, held)
        yield pa.RecordBatch.from_arrays([pa.array(seen.view(np.int64)), pa.array(n)], ["key", "n"])

    found = rows.select("text").mapInArrow(summarise, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter("n > 64")
    top = found.orderBy(F.desc("n"), "key").limit(COUNTERS).collect()
    return np.sort(np.array([r.key for r in top], np.int64).view(np.uint64))


def _sets(rows: DataFrame, frequent: np.ndarray, shingle: int, percent: int, simhash: bool) -> DataFrame:
    """``doc_id, fp, size, keys, sig`` of each row: 128 bits that name its set, its first n-grams and its signature; its SimHash ``sim`` on request."""

    def look(batches):
        forget()
        for batch in blocks(batches):
            found = shingle_sets(batch.column("text"), shingle)
            keys = [prefix(c, frequent, percent).view(np.int64) for c in found]
            ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            column = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys)))
            columns = [batch.column("doc_id"), pa.array([set_name(c) for c in found], pa.binary()), pa.array(list(map(len, found)), pa.int64()), column, pa.array(list(map(signature, found)), pa.binary())]
            names = ["doc_id", "fp", "size", "keys", "sig"]
            if simhash:
                prints = np.fromiter(map(fingerprint, batch.column("text").to_pylist()), np.uint64, batch.num_rows)
                columns, names = [*columns, pa.array(prints.view(np.int64))], [*names, "sim"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(look, "doc_id long, fp binary, size long, keys array<long>, sig binary" + (", sim long" if simhash else ""))


def _first_links(rows: DataFrame, points: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """``fp, star`` of links between each set and the representative of those with the same first n-gram."""
    return _links_of_groups(rows, points, points.select("pid", "size", F.get("keys", F.lit(0)).alias("key")).checkpoint(), shingle, similarity)


def _simhash_links(rows: DataFrame, points: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """``fp, star`` of links between each set and the representative of those that its SimHash leads to, RADIUS bits a step."""
    prints = points.select(F.col("sim").alias("fp")).distinct().checkpoint()
    roots = _connected(fingerprint_stars(prints, prints.count(), RADIUS))
    members = points.select("pid", "size", F.col("sim").alias("fp")).join(roots, "fp", "left").select("pid", "size", F.coalesce("root", "fp").alias("key")).checkpoint()
    tidy(points.sparkSession)
    return _links_of_groups(rows, points, members, shingle, similarity)


def _links_of_groups(rows: DataFrame, points: DataFrame, members: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """``fp, star`` of links between each of ``members`` (``pid, size, key``) and the representative of its key."""
    groups = members.groupBy("key").agg(F.min("pid").alias("rep"), F.sum("size").alias("mass"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    pairs = split_join(members, groups, "key").filter("pid <> rep").select("pid", "rep", "mass")
    return compared(rows, points, star_requests(pairs, None), shingle, similarity, similar_pairs).checkpoint()


def _tiles(points: DataFrame, roots: DataFrame) -> DataFrame:
    """``key, band, i, j, side, lower, pid, root, size, sig``: each set in each block of each tile that it has a part in."""
    # Most n-grams are in one set only; only keys are counted, and only shared ones are looked at further.
    postings = points.select("pid", F.explode("keys").alias("key"))
    shared = postings.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    found = postings.join(shared, "key").checkpoint()
    band = F.floor(F.log(F.col("size").cast("double")) / float(np.log(BAND))).cast("int")
    narrow = labelled(points.select("pid", "size"), roots).select("pid", "root", "size", band.alias("band"))
    placed = found.join(narrow, "pid").checkpoint()
    # Two exclusive sums tell n-grams of the same sets apart from others; one of them is enough.
    sums = [F.bit_xor(F.xxhash64("pid", F.lit(seed))).alias(f"x{seed}") for seed in (1, 2)]
    groups = placed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("pid").alias("least"), F.max("pid").alias("last"), F.min("root").alias("low"), F.max("root").alias("high"), *sums)
    open_ = groups.filter("low <> high").groupBy("least", "last", "n", "x1", "x2").agg(F.min("key").alias("key")).select("key")
    members = placed.join(open_, "key").checkpoint()
    tidy(points.sparkSession)
    sizes = members.groupBy("key", "band").agg(F.count(F.lit(1)).alias("n")).checkpoint()
    below = sizes.select("key", (F.col("band") + 1).alias("band"), F.col("n").alias("n_low"))
    tiles = sizes.join(below, ["key", "band"], "left").withColumn("n_low", F.coalesce("n_low", F.lit(0))).filter("n > 1 OR n_low > 0")
    tiles = tiles.select("key", "band", F.ceil((F.col("n") + F.col("n_low")) / TILE).alias("n_blocks"))
    asks = members.withColumn("lower", F.lit(False)).unionByName(members.withColumn("band", F.col("band") + 1).withColumn("lower", F.lit(True)))
    placed = asks.join(tiles, ["key", "band"]).withColumn("own", F.pmod(F.xxhash64("pid"), F.col("n_blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    at = placed.select("key", "band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), side.alias("side"), "lower", "pid", "root", "size")
    return at.join(points.select("pid", "sig"), "pid").select("key", "band", "i", "j", "side", "lower", "pid", "root", "size", "sig")


def _may_link(tiles: DataFrame, percent: int) -> DataFrame:
    """``fp, star``: sets that bit counts don't keep apart, as stars of each tile."""
    by = ["key", "band", "i", "j"]

    def told(parts):
        columns = [np.concatenate([p.column(k).to_numpy(zero_copy_only=False) for p in parts]) for k in ("size", "root", "side", "lower", "pid")]
        size, root, side, lower, pid = columns
        if len(size) < 2 or root.min() == root.max():
            return None
        maps = bitmaps([s for p in parts for s in p.column("sig").to_pylist()])
        label = candidates(size, root, side, lower.astype(bool), maps, percent)
        met = np.flatnonzero(label >= 0)
        if not len(met):
            return None
        name, at = np.unique(label[met], return_inverse=True)
        star = np.full(len(name), np.iinfo(np.int64).max)
        np.minimum.at(star, at, pid[met])
        return np.stack([pid[met], star[at]])

    def sweep(batches):
        open_, key = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            tile = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in by])
            starts = np.concatenate([[0], np.flatnonzero((tile[:, 1:] != tile[:, :-1]).any(0)) + 1, [batch.num_rows]])
            found = []
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                if (own := tuple(tile[:, a].tolist())) != key:
                    found.append(told(open_) if open_ else None)
                    open_, key = [], own
                open_.append(batch.slice(a, b - a))
            if found := [f for f in found if f is not None]:
                yield _stars(np.concatenate(found, 1))
            release()
        if open_ and (last := told(open_)) is not None:
            yield _stars(last)

    return tiles.repartition(*by).sortWithinPartitions(*by).mapInArrow(sweep, "fp long, star long").distinct()


def _stars(found: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], ["fp", "star"])


def _classes(rows: DataFrame, points: DataFrame, shingle: int, percent: int) -> DataFrame:
    """``fp, root`` of every set with a link, both as numbers of sets."""
    similarity = percent / 100
    edges = _first_links(rows, points, shingle, similarity)
    if "sim" in points.columns:
        edges = edges.unionByName(_simhash_links(rows, points, shingle, similarity))
    roots = _connected(edges)
    tidy(points.sparkSession)
    buckets = _connected(_may_link(_tiles(points, roots), percent))
    tidy(points.sparkSession)
    asked = buckets.select(F.col("fp").alias("pid"), F.col("root").alias("key")).join(points.select("pid", "size"), "pid").checkpoint()
    requests = block_requests(asked, roots)
    if requests is None:
        return roots
    return _connected(edges.unionByName(compared(rows, points, requests, shingle, similarity, similar_pairs).checkpoint()))


def _points(rows: DataFrame, shingle: int, percent: int, simhash: bool) -> tuple[DataFrame, DataFrame]:
    """``doc_id, fp, size`` of every row, and ``pid, fp, low, size, keys, sig`` of every set that isn't empty, ``sim`` on request."""
    wide = _sets(rows, frequent_shingles(rows, shingle), shingle, percent, simhash).checkpoint()
    whole = wide.filter("size > 0").groupBy("fp").agg(F.min("doc_id").alias("low"), *(F.first(c).alias(c) for c in wide.columns[2:]))
    points = whole.withColumn("pid", F.monotonically_increasing_id()).checkpoint()
    return wide.select("doc_id", "fp", "size").checkpoint(), points


def joined(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE, percent: int = PERCENT, simhash: bool = False) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id``, the smallest ``doc_id`` that links lead to.

    A text's set has its distinct n-grams of ``shingle`` words, A-Z lower-cased, words between ASCII white space; a text
    of fewer words is one n-gram. Two rows link if 100 times their intersection is ``percent`` or more times their union.
    Texts without words, null ones included, link with nothing: their component is their own id. Rows that repeat an id
    are rows of their own; null ids name no component unless it has no other. Other columns are ignored; an empty table
    gives an empty result. With ``simhash`` texts whose fingerprints link (``RADIUS`` bits, a vantage-point tree) are compared
    first; the tiles then only look for what fingerprints miss. The result is the same.
    """
    small_batches(docs.sparkSession)
    shared_dir(docs.sparkSession, "ngrams")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    own, points = _points(rows, shingle, percent, simhash)
    tidy(docs.sparkSession)
    named = labelled(points.select("pid", "fp", "low"), _classes(rows, points, shingle, percent)).select("fp", "low", "root").checkpoint()
    least = named.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = split_join(named.select("fp", "root"), least, "root").select("fp", "component_id").checkpoint()
    linked = split_join(own.filter("size > 0").select("doc_id", "fp", F.col("size").alias("n_shingles")), classes, "fp")
    alone = own.filter("size = 0").select("doc_id", F.col("size").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.select("doc_id", "n_shingles", "component_id").unionByName(alone)


def drop_alike(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, simhash: bool = False) -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest ``doc_id``; columns unchanged.

    Texts without words are copies of each other here. Rows that repeat the id that stays are all kept; a component of
    null ids only stays whole.
    """
    found = joined(docs, shingle=shingle, percent=percent, simhash=simhash).checkpoint()
    first = found.filter("n_shingles = 0").agg(F.min("doc_id").alias("component_id")).first().component_id
    least = F.when(F.col("n_shingles") == 0, F.lit(first).cast("long")).otherwise(F.col("component_id"))
    gone = found.withColumn("component_id", least).filter("doc_id <> component_id OR (doc_id IS NULL AND component_id IS NOT NULL)")
    name = fresh(docs, "gone_id")
    ids = gone.select(F.col("doc_id").alias(name)).distinct().checkpoint()
    tidy(docs.sparkSession)
    return without(docs, ids, [("doc_id", name)])
