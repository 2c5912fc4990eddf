"""SimHash near-dedup with vantage-point trees.

Distinct fingerprints are dealt over the leaves of a vantage-point tree whose vantage points and radii come from a
bounded sample. A fingerprint is indexed in one leaf and asks every leaf that the triangle inequality can't exclude,
so pairs across a boundary are found and none is lost. Leaves compare exactly. A leaf emits no pairs but, for each
fingerprint with a link, the star it belongs to there; stars that share a fingerprint are joined by repeated minima
until nothing changes.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.cluster import BROADCAST_ROWS, fresh, shared_dir
from tessera.llm.exact_dedup import split_join
from tessera.llm.textblocks import blocks, gather, mix

SHINGLE, RADIUS, SEED = 4, 4, 42
#: Fingerprints that a leaf holds at about; the tree has one level per doubling beyond.
LEAF = 4096
#: Fingerprints that the tree is fitted to, at most twice as many, and the levels of the tree at most.
SAMPLE, DEEPEST = 32768, 11
#: Fingerprints that ask in one task at about, and that are dealt at once.
ASKING, DEALT = 1 << 18, 2048


def shingle_codes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of the word shingles of a text, repeats included; fewer words are one shingle, none of them none."""
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: lower-cases A-Z and splits at ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    body = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    stop = np.cumsum(size + 1) - 1
    first = stop - size
    if len(words) > shingle:
        first, stop = first[: len(words) - shingle + 1], stop[shingle - 1 :]
    else:
        first, stop = first[:1], stop[-1:]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(body[a:b], SEED) for a, b in zip(first.tolist(), stop.tolist(), strict=True)], np.uint64)


def majority(codes: np.ndarray) -> int:
    """The bits that are set in over half of the codes; zero without any."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(codes), 1 << 16):
        bits = np.unpackbits(codes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(codes)).view(">u8")[0]) if len(codes) else 0


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the word shingles of a text: a bit is set if it is in over half of the shingles' hashes."""
    return majority(shingle_codes(text, shingle))


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fp`` of every row; ``fp`` is the fingerprint's bits as a signed long. Null and empty texts: zero."""

    def look(batches):
        for batch in blocks(batches):
            own = np.array([fingerprint(t, shingle) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(own)], ["doc_id", "fp"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(look, "doc_id long, fp long")


@dataclass
class Tree:
    """A vantage-point tree: inner nodes in heap order, each with a vantage point and a radius; leaves are numbered from 0."""

    vantage: np.ndarray
    radius: np.ndarray
    depth: int

    @classmethod
    def fitted(cls, sample: np.ndarray, depth: int) -> "Tree":
        """Vantage points drawn from each node's part of the sample, radii at the median distance."""
        draw, n = np.random.default_rng(5), (1 << depth) - 1
        tree = cls(np.zeros(n, np.uint64), np.full(n, 32), depth)
        parts = {0: sample}
        for node in range(n):
            own = parts.pop(node)
            # Of a few candidates the one whose distances spread most splits best.
            tries = own[draw.integers(0, len(own), 8)] if len(own) else draw.integers(0, 1 << 63, 1, np.uint64)
            tree.vantage[node] = max(tries, key=lambda v: np.bitwise_count(own ^ v).std() if len(own) else 0)
            distance = np.bitwise_count(own ^ tree.vantage[node]).astype(np.int64)
            tree.radius[node] = int(np.median(distance)) if len(own) else 32
            inner = distance <= tree.radius[node]
            parts[2 * node + 1], parts[2 * node + 2] = own[inner], own[~inner]
        return tree

    def leaf(self, points: np.ndarray) -> np.ndarray:
        """The leaf that indexes each point."""
        node = np.zeros(len(points), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (np.bitwise_count(points ^ self.vantage[node]) > self.radius[node])
        return node - ((1 << self.depth) - 1)

    def reach(self, points: np.ndarray, within: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of point, leaf) for every leaf that may hold something ``within`` that distance of the point."""
        index, node = np.arange(len(points)), np.zeros(len(points), np.int64)
        for _ in range(self.depth):
            distance = np.bitwise_count(points[index] ^ self.vantage[node]).astype(np.int64)
            inner, outer = distance - within <= self.radius[node], distance + within > self.radius[node]
            index = np.concatenate([index[inner], index[outer]])
            node = np.concatenate([2 * node[inner] + 1, 2 * node[outer] + 2])
        return index, node - ((1 << self.depth) - 1)


def merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each the smallest index of its component) after joining the components of a[i] and b[i]."""
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
    return label


def components(own: np.ndarray, asking: np.ndarray, within: int, vantage: np.uint64) -> np.ndarray:
    """Labels over ``own`` followed by ``asking``: links among ``own`` and between ``asking`` and ``own``."""
    both = np.concatenate([own, asking])
    label = np.arange(len(both))
    far = np.bitwise_count(own ^ vantage).astype(np.int64)
    order = np.argsort(far, kind="stable")
    ring = np.searchsorted(far[order], np.arange(66))
    inside = own[order]
    distance = np.bitwise_count(both ^ vantage).astype(np.int64)
    for d in np.unique(distance).tolist():
        who = np.flatnonzero(distance == d)
        low, high = ring[max(0, d - within)], ring[min(64, d + within) + 1]
        if low == high:
            continue
        step = max(1, (1 << 20) // (high - low))
        for at in range(0, len(who), step):
            part = who[at : at + step]
            i, j = np.nonzero(np.bitwise_count(both[part][:, None] ^ inside[None, low:high]) <= within)
            label = merged(label, part[i], order[low + j])
    return label


def _shares(tree: Tree, sample: np.ndarray, each: float, within: int) -> tuple[np.ndarray, np.ndarray]:
    """Per leaf, into how many blocks its own points and its asking points are cut, as the sample lets expect."""
    leaves = 1 << tree.depth
    home = tree.leaf(sample)
    index, leaf = tree.reach(sample, within)
    asks = leaf > home[index]
    cut = lambda counts, most: np.maximum(1, np.ceil(counts * each / most)).astype(np.int64)
    return cut(np.bincount(home, minlength=leaves), 2 * LEAF), cut(np.bincount(leaf[asks], minlength=leaves), ASKING)


def _stars(points: DataFrame, n: int, within: int) -> DataFrame:
    """``fp, star`` for every fingerprint with a link, for every star it belongs to (named by one of its fingerprints).

    The tree has at most 2**DEEPEST leaves, so that each node's part of the sample stays large enough to split it; the
    points of a larger leaf, and those that ask it, are cut into blocks that meet pairwise, one task each.
    """
    depth = min(DEEPEST, max(0, math.ceil(math.log2(max(1, n) / LEAF))))
    every = max(1, n // SAMPLE)
    drawn = points.filter(F.pmod(F.xxhash64("fp"), F.lit(every)) == 0).select("fp").toArrow().column("fp").to_numpy()
    sample = np.sort(drawn).astype(np.int64).view(np.uint64)
    tree = Tree.fitted(sample, depth)
    shared = points.sparkSession.sparkContext.broadcast((tree, *_shares(tree, sample, n / max(1, len(sample)), within)))  # 2**DEEPEST nodes

    def deal(batches):
        own_tree, wide, deep = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, DEALT):
                fp = batch.column(0).slice(at, DEALT).to_numpy().view(np.uint64)
                home, spread = own_tree.leaf(fp), mix(fp)
                index, leaf = own_tree.reach(fp, within)
                asks = leaf > home[index]  # the other direction finds the same pairs
                index, leaf = index[asks], leaf[asks]
                # A point of a leaf lies in one block there and also asks the leaf's later blocks.
                block = (spread % wide[home].astype(np.uint64)).astype(np.int64)
                later = wide[home] - 1 - block
                every_block = gather(np.zeros(len(index), np.int64), wide[leaf])
                asked_by = np.concatenate([np.repeat(index, wide[leaf]), np.repeat(np.arange(len(fp)), later)])
                to_leaf = np.concatenate([np.repeat(leaf, wide[leaf]), np.repeat(home, later)])
                to_block = np.concatenate([every_block, gather(block + 1, later)])
                chunk = (spread[asked_by] >> np.uint64(32)) % deep[to_leaf].astype(np.uint64)
                who = np.concatenate([np.repeat(np.arange(len(fp)), deep[home]), asked_by])
                where = np.concatenate([np.repeat(home, deep[home]), to_leaf])
                row = np.concatenate([np.repeat(block, deep[home]), to_block])
                column = np.concatenate([gather(np.zeros(len(fp), np.int64), deep[home]), chunk.astype(np.int64)])
                asked = np.arange(len(who)) >= len(who) - len(asked_by)
                order = np.lexsort((asked, column, row, where))
                keys = [x[order] for x in (where, row, column, asked)]
                new = np.append(True, np.any([k[1:] != k[:-1] for k in keys], axis=0)) if len(who) else np.zeros(0, bool)
                cut = np.flatnonzero(new)
                values, ends = fp[who[order]].astype("<u8"), np.append(cut[1:], len(who))
                blob = [values[x:y].tobytes() for x, y in zip(cut.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(pa.array(k[cut]) for k in keys), pa.array(blob, pa.binary())], ["leaf", "block", "chunk", "asking", "points"])

    def link(table: pa.Table) -> pa.Table:
        asking = table.column("asking").to_numpy()
        parts = [np.frombuffer(b, "<u8") for b in table.column("points").to_pylist()]
        none = [np.zeros(0, np.uint64)]
        own = np.sort(np.concatenate(none + [p for p, a in zip(parts, asking, strict=True) if not a]))
        other = np.sort(np.concatenate(none + [p for p, a in zip(parts, asking, strict=True) if a]))
        both = np.concatenate([own, other])
        label = components(own, other, within, both[len(both) // 2])
        linked = np.flatnonzero(np.bincount(label, minlength=len(both))[label] > 1)
        return pa.table({"fp": both[linked].view(np.int64), "star": both[label[linked]].view(np.int64)})

    dealt = points.select("fp").mapInArrow(deal, "leaf long, block long, chunk long, asking boolean, points binary")
    return dealt.groupBy("leaf", "block", "chunk").applyInArrow(link, "fp long, star long")


def _few_connected(members: DataFrame) -> DataFrame:
    """``fp, root`` as ``_connected`` gives them, of at most BROADCAST_ROWS rows: one task reads them all."""

    def join(batches):
        own = [np.stack([b.column(k).to_numpy() for k in ("fp", "star")]) for b in batches if b.num_rows]
        fp, star = np.concatenate(own, 1) if own else np.zeros((2, 0), np.int64)
        ids, at = np.unique(np.concatenate([fp, star]), return_inverse=True)
        label = merged(np.arange(len(ids)), at[: len(fp)], at[len(fp) :])
        low, who = np.full(len(ids), np.iinfo(np.int64).max), np.unique(at[: len(fp)])
        np.minimum.at(low, label[at[len(fp) :]], star)
        yield pa.RecordBatch.from_arrays([pa.array(ids[who]), pa.array(low[label[who]])], ["fp", "root"])

    return members.select("fp", "star").coalesce(1).mapInArrow(join, "fp long, root long").checkpoint()


def _connected(stars: DataFrame) -> DataFrame:
    """``fp, root``: the smallest fingerprint that is reachable through shared stars; a star is named by one of its members.

    Up to BROADCAST_ROWS rows of two numbers are joined in one task: rounds of shuffles would leave a file per task and
    table, many times what is in them. Beyond, minima are repeated until nothing changes.
    """
    members = stars.checkpoint()
    n = members.count()
    if n <= BROADCAST_ROWS:
        return _few_connected(members)
    labels = members.groupBy("fp").agg(F.min("star").alias("root")).checkpoint()
    while n:
        of_star = members.join(labels, "fp").groupBy("star").agg(F.min("root").alias("root"))
        new = split_join(members, of_star, "star", n_rows=n).groupBy("fp").agg(F.min("root").alias("low"))
        step = labels.join(new, "fp").select("fp", "root", "low").checkpoint()
        if step.filter("low <> root").isEmpty():
            break
        # Jump over the root's own label, so that long chains shorten.
        jump = step.select(F.col("fp").alias("low"), F.col("low").alias("next"))
        labels = split_join(step.select("fp", "low"), jump, "low", n_rows=n).select("fp", F.col("next").alias("root")).checkpoint()
    return labels


def near_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE, within: int = RADIUS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, fingerprint, component_id, n_links``.

    Two fingerprints link at ``within`` or fewer differing bits; ``component_id`` is the smallest ``doc_id`` reachable,
    the row's own included; ``n_links`` counts the other rows of its component. Null, empty and wordless texts have
    fingerprint zero and link like any other. Null ids never name a component unless it has no other id. Other columns
    are ignored; an empty table gives an empty result.
    """
    shared_dir(docs.sparkSession, "simhash")
    own = fingerprints(docs, text, doc_id, shingle).checkpoint()
    points = own.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("rows")).checkpoint()
    roots = _connected(_stars(points, points.count(), within))
    named = points.join(roots, "fp", "left").select("fp", "low", "rows", F.coalesce("root", "fp").alias("root")).checkpoint()
    whole = named.groupBy("root").agg(F.min("low").alias("component_id"), F.sum("rows").alias("total")).checkpoint()
    classes = split_join(named.select("fp", "root"), whole, "root").select("fp", "component_id", "total").checkpoint()
    found = split_join(own, classes, "fp")
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", (F.col("total") - 1).alias("n_links"))


def drop_near_copies(docs: DataFrame, shingle: int = SHINGLE, within: int = RADIUS) -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest ``doc_id``; columns unchanged.

    Rows that repeat that ``doc_id`` stay; a component of null ids only stays whole.
    """
    gone = near_dedup(docs, shingle=shingle, within=within).filter("doc_id <> component_id OR (doc_id IS NULL AND component_id IS NOT NULL)")
    name = fresh(docs, "gone_id")
    ids = gone.select(F.col("doc_id").alias(name)).distinct()
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids[name]), "left_anti")
