"""Sets of word shingles, and comparisons of sets on request.

A request sends a set, found again by its text, to a comparison; a comparison never holds more than about GROUP shingles:
members meet their representative in blocks, and the blocks of a bucket meet pairwise. Links come back as stars.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.exact_dedup import split_join
from tessera.llm.textblocks import SPACE, blocks, flat, hashes, lowered, mix, release, spans

SHINGLE = 5
#: Shingles that one comparison holds at about; a longer text is one block by itself.
GROUP = 1 << 18
#: Numbers of eight bytes that are broadcast at most; where there are more, both sides shuffle.
BROADCAST_IDS = 1 << 20
#: Bytes of shingles in one batch on their way to comparisons.
SENT_BYTES = 4 << 20


def shingle_sets(texts: pa.Array, shingle: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the word shingles of each text; one of fewer words is one shingle, one without words none.

    Words are hashed where they lie, and shingles as chains of their words' hashes and their number.
    """
    raw, starts, ends = flat(texts)
    raw = lowered(raw)
    begin, stop, row = spans(raw, starts, ends, ~SPACE)
    word = hashes(raw, begin, stop)
    size = np.bincount(row, minlength=len(starts)) if len(row) else np.zeros(len(starts), np.int64)
    first = np.cumsum(size) - size
    chain = np.full(max(0, len(word) - shingle + 1), shingle, np.uint64)
    for k in range(shingle):
        chain = mix(chain * _STEP ^ word[k : k + len(chain)])
    out = []
    for at, n in zip(first.tolist(), size.tolist(), strict=True):
        if n >= shingle:
            out.append(np.unique(chain[at : at + n - shingle + 1]))
            continue
        code = np.full(min(n, 1), n, np.uint64)
        for k in range(n):
            code = mix(code * _STEP ^ word[at + k : at + k + 1])
        out.append(code)
    return out


#: An odd multiplier between the words of a chain.
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The set of one text, see ``shingle_sets``."""
    return shingle_sets(pa.array([text], pa.string()), shingle)[0]


def set_name(codes: np.ndarray) -> bytes:
    """128 bits that name a set."""
    import xxhash

    return xxhash.xxh3_128_digest(codes.tobytes())


_ASK = "kind int, g long, i long, j long, role int, root long"
_AT = [f.split()[0] for f in _ASK.split(", ")]


def compared(rows: DataFrame, points: DataFrame, requests: DataFrame, shingle: int, similarity: float, pairs_of) -> DataFrame:
    """``fp, star`` of confirmed links: each request sends the set ``pid`` to the comparison (kind, g, i, j) by ``pairs_of``."""
    # A set asks once per band and block; lists are cut where a representative goes to many blocks.
    listed = requests.groupBy("pid", F.floor(F.col("j") / 1024).alias("part")).agg(F.collect_list(F.struct(*_AT)).alias("asks")).drop("part")
    named = listed.join(points.select("pid", "fp", "low"), "pid")
    named = named.checkpoint()
    ids = named.select(F.col("low").alias("asked_id")).distinct()
    wanted = rows
    if named.count() <= BROADCAST_IDS:  # then texts that nobody asks for don't shuffle
        wanted = rows.join(F.broadcast(ids), rows["doc_id"].eqNullSafe(ids["asked_id"]), "left_semi")
    texts = wanted.join(named, wanted["doc_id"].eqNullSafe(named["low"])).select("text", "pid", "fp", "asks")

    def send(batches):
        for batch in blocks(batches):
            out, held = [], 0
            for codes, pid, fp, asks in zip(shingle_sets(batch.column("text"), shingle), *(batch.column(k).to_pylist() for k in ("pid", "fp", "asks")), strict=True):
                if set_name(codes) != fp:  # another row with the same id
                    continue
                body = codes.astype("<u8").tobytes()
                for own in asks:
                    out.append((*(own[k] for k in _AT), pid, body))
                    held += len(body) + 64
                    if held >= SENT_BYTES:
                        yield _sent(out)
                        out, held = [], 0
            if out:
                yield _sent(out)

    def compare(batches):
        key, held = None, []
        for batch in batches:
            found = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:4] != key and held:
                    found += _links(held, similarity, pairs_of)
                    held = []
                key = row[:4]
                held.append(row)
            if found:
                yield _edges(found)
            release()
        if held:
            yield _edges(_links(held, similarity, pairs_of))

    sent = texts.mapInArrow(send, f"{_ASK}, pid long, codes binary")
    by = ["kind", "g", "i", "j"]
    return sent.repartition(*by).sortWithinPartitions(*by).mapInArrow(compare, "fp long, star long").distinct()


def _sent(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [*_AT, "pid", "codes"])


def _links(rows: list[tuple], similarity: float, pairs_of) -> list[tuple[int, int]]:
    """(member, star) of the links in one comparison; rows that repeat a set count once."""
    own = list({row[6]: row for row in rows}.values())
    pairs = pairs_of([np.frombuffer(row[7], "<u8") for row in own], np.array([row[4] for row in own]), np.array([row[5] for row in own]), similarity)
    return [x for i, j in pairs for x in ((own[i][6], own[i][6]), (own[j][6], own[i][6]))]


def _edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["fp", "star"])


def _blocks_of(mass):
    """Number of blocks for so many shingles."""
    return F.greatest(F.lit(1), F.ceil(mass / GROUP)).cast("long")


def labelled(sets: DataFrame, roots: DataFrame | None) -> DataFrame:
    """``sets`` with the class ``root`` of each, itself where nothing is linked to it."""
    if roots is None:
        return sets.withColumn("root", F.col("pid"))
    return sets.join(roots.withColumnRenamed("fp", "pid"), "pid", "left").withColumn("root", F.coalesce("root", "pid"))


def star_requests(pairs: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Requests that compare each member with its representative, in blocks of members."""
    stars = pairs.groupBy("pid", "rep").agg(F.max("mass").alias("mass")).withColumn("j", F.pmod(F.xxhash64("pid"), _blocks_of(F.col("mass"))))
    at = [F.lit(0).alias("kind"), F.col("rep").alias("g"), F.lit(0).cast("long").alias("i"), "j"]
    one = stars.select("pid", *at, F.lit(1).alias("role"))
    reps = stars.select("rep", "j").distinct().select(F.col("rep").alias("pid"), *at, F.lit(0).alias("role"))
    return labelled(one.unionByName(reps), roots)


def block_requests(asked: DataFrame, roots: DataFrame) -> DataFrame | None:
    """Requests for buckets whose members beside the representative are in different classes; None if there are none."""
    left = labelled(asked, roots).checkpoint()
    by_root = left.groupBy("key", "root").agg(F.sum("size").alias("mass"))
    unsettled = by_root.groupBy("key").agg(F.max_by("root", F.struct("mass", "root")).alias("main"), F.max("mass").alias("most"), F.sum("mass").alias("all"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    unsettled = unsettled.select("key", "main", _blocks_of(F.col("most")).alias("wide"), _blocks_of(F.col("all") - F.col("most")).alias("deep")).checkpoint()
    if unsettled.isEmpty():
        return None
    left = split_join(left, unsettled, "key").withColumn("is_main", F.col("root") == F.col("main"))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    main = left.filter("is_main").withColumn("j", F.pmod(F.xxhash64("pid"), F.col("wide"))).withColumn("i", upto("deep"))
    rest = left.filter("NOT is_main").withColumn("own", F.pmod(F.xxhash64("pid"), F.col("deep")))
    across, within = rest.withColumn("i", F.col("own")).withColumn("j", upto("wide")), rest.withColumn("other", upto("deep"))
    role = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    at = lambda kind, own: ["pid", F.lit(kind).alias("kind"), F.col("key").alias("g"), "i", "j", own.alias("role"), "root"]
    requests = main.select(*at(1, F.lit(0))).unionByName(across.select(*at(1, F.lit(1))))
    inside = within.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    return requests.unionByName(inside.select(*at(2, role)))
