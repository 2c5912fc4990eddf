"""Exact dedup with a heavy-hitter split.

Digests are first reduced per partition by Misra-Gries; the merged summary names every digest that may exceed its
share of the rows. Those few are counted exactly, and their winners are broadcast, so their rows never shuffle. All
other groups are small by the summary's guarantee and go through an ordinary shuffle.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.cluster import fresh, shared_dir, without

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Counters of a Misra-Gries summary. A digest with more than 1/COUNTERS of a partition's rows stays in its summary.
COUNTERS = 512


def normalised(text):
    """A-Z lower-cased, null as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def misra_gries(counts: Counter, more: Counter, k: int) -> Counter:
    """The summary of both inputs together, with at most ``k`` counters."""
    total = counts + more
    if len(total) <= k:
        return total
    cut = sorted(total.values(), reverse=True)[k]
    return Counter({key: n - cut for key, n in total.items() if n > cut})


def heavy_keys(keys: DataFrame, key: str, k: int | None = None) -> DataFrame:
    """Every value of ``key`` that may hold more than 2/k of all rows, and maybe others: at most ``k`` rows.

    A partition keeps ``k`` counters; the summaries are merged as sums and the ``k`` largest stay. Nulls are no keys.
    """
    kind, k = keys.schema[key].dataType, k or COUNTERS

    def summarise(batches):
        seen: Counter = Counter()
        for batch in batches:
            for part in range(0, batch.num_rows, 8 * k):
                seen = misra_gries(seen, Counter(x for x in batch.column(0).slice(part, 8 * k).to_pylist() if x is not None), k)
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), arrow_type), pa.array(list(seen.values()), pa.int64())], ["key", "n"])

    arrow_type = pa.binary() if isinstance(kind, T.BinaryType) else pa.string() if isinstance(kind, T.StringType) else pa.int64()
    schema = T.StructType([T.StructField("key", kind), T.StructField("n", T.LongType())])
    found = keys.select(key).mapInArrow(summarise, schema).groupBy("key").agg(F.sum("n").alias("n"))
    return found.filter("n > 1").orderBy(F.desc("n"), "key").limit(k).select(F.col("key").alias(key))


#: Narrow rows of one key that a task takes without harm: fewer of them all aren't split.
SPLIT_ROWS = 1 << 18


def split_join(rows: DataFrame, lookup: DataFrame, key: str, how: str = "inner", n_rows: int | None = None) -> DataFrame:
    """``rows`` joined to ``lookup``, which has one row per value of ``key``; frequent values don't meet in one task.

    ``rows`` is read several times and should be a stored or checkpointed table of few columns; ``n_rows`` is their
    number where it is known.
    """
    if (rows.count() if n_rows is None else n_rows) <= SPLIT_ROWS:
        return rows.join(lookup, key, how)
    heavy = heavy_keys(rows, key).checkpoint()  # at most COUNTERS rows, so the broadcasts have a proven bound
    found = lookup.join(F.broadcast(heavy), key).checkpoint()
    mapped = rows.join(F.broadcast(heavy), key, "left_semi").join(F.broadcast(found), key, how)
    rest = rows.join(F.broadcast(heavy), key, "left_anti").join(lookup, key, how)
    return mapped.unionByName(rest)


def with_winners(rows: DataFrame, key: str, pick: str, least: bool = False) -> DataFrame:
    """``rows`` with ``keep_id`` (largest ``pick`` of the rows with an equal ``key``; smallest if ``least``) and ``group_size``.

    ``rows`` is read several times and should be a stored or checkpointed table of few columns.
    """
    best = F.min if least else F.max
    heavy = heavy_keys(rows, key)
    # At most COUNTERS rows, so both broadcasts have a proven bound.
    exact = rows.join(F.broadcast(heavy), key).groupBy(key).agg(best(pick).alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    frequent = exact.checkpoint()
    mapped = rows.join(F.broadcast(frequent), key)
    rest = rows.join(F.broadcast(frequent.select(key)), key, "left_anti")
    groups = rest.groupBy(key).agg(best(pick).alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return mapped.unionByName(rest.join(groups, key))


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after lower-casing A-Z; a null text counts as empty, so null and empty texts form
    one group. Of equal texts the row with the largest ``doc_id`` stays; rows that repeat that ``doc_id`` are the same
    row and all stay. Null ids lose to any id and stay only where a group has no other. Other columns are ignored,
    whatever their names. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    shared_dir(spark, "digests")
    digests = docs.select(F.col(doc_id).alias("doc_id"), F.unhex(F.sha2(normalised(F.col(text)), 256)).alias("digest")).checkpoint()
    won = with_winners(digests, "digest", "doc_id")
    return won.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` without the rows that ``exact_dedup`` drops; columns unchanged."""
    gone = exact_dedup(docs, text, doc_id).filter("NOT kept").select(F.col("doc_id").alias("gone_id"), F.unhex("text_sha256").alias("gone_digest")).checkpoint()
    digest = fresh(docs, "digest")
    marked = docs.withColumn(digest, F.unhex(F.sha2(normalised(F.col(text)), 256)))
    return without(marked, gone, [(doc_id, "gone_id"), (digest, "gone_digest")]).drop(digest)
