"""Comparisons of two sets of rows: multisets, ordered sequences, runs against a baseline."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.sliced import Sliced


def multiset_diff(now: DataFrame, then: DataFrame) -> DataFrame:
    """Rows with the number by which they differ: ``added`` where ``now`` has more, ``removed`` where ``then`` has."""
    columns = now.columns
    signed = now.withColumn("one", F.lit(1)).unionByName(then.withColumn("one", F.lit(-1)))
    net = signed.groupBy(*columns).agg(F.sum("one").alias("net")).filter("net <> 0")
    return net.select(*columns, F.when(F.col("net") > 0, "added").otherwise("removed").alias("change"), F.abs("net").alias("n"))


def equal_sequences(rows: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """``key, twin``: every key with the smallest other key that has an equal sequence of values in order.

    Only a SHA-256 of each sequence, with the type and length of every value told apart, is grouped and joined; a group's
    keys aren't paired with each other: its two smallest are found by one aggregate.
    """
    sequence = F.transform(F.array_sort(F.collect_list(F.struct(*order, *values))), lambda x: F.struct(*(x[v].alias(v) for v in values)))
    whole = rows.groupBy(key).agg(F.unhex(F.sha2(F.to_json(sequence), 256)).alias("digest"))
    low = whole.groupBy("digest").agg(F.min(key).alias("low"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    grouped = whole.join(low, "digest")
    seconds = grouped.filter(F.col(key) > F.col("low")).groupBy("digest").agg(F.min(key).alias("second"))
    twin = F.when(F.col(key) == F.col("low"), F.col("second")).otherwise(F.col("low"))
    return grouped.join(seconds, "digest").select(key, twin.alias("twin"))


def zipped(one: DataFrame, two: DataFrame, keys: list[str], order: list[str], values: list[str], slice_rows: int | None = None) -> DataFrame:
    """Rows of both tables paired by their place in order within ``keys``: ``keys, place`` (from 0) and each value of both.

    The columns of values are ``<name>_one`` and ``<name>_two``; where one side is longer the other's are null and
    ``missing`` says which side lacks the row (``one``, ``two`` or null).
    """
    sides = []
    for name, side in (("one", one), ("two", two)):
        placed = Sliced.of(side, keys, order, slice_rows).before(place=("count", F.lit(True))).done()
        sides.append(placed.select(*keys, "place", F.lit(True).alias(f"in_{name}"), *(F.col(v).alias(f"{v}_{name}") for v in values)))
    missing = F.when(F.col("in_one").isNull(), "one").when(F.col("in_two").isNull(), "two")
    return sides[0].join(sides[1], [*keys, "place"], "full").withColumn("missing", missing).drop("in_one", "in_two")


def pairwise_unequal(one: DataFrame, two: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """The ``keys`` whose rows differ somewhere when paired in order, in number or in a value."""
    differs = F.col("missing").isNotNull()
    for v in values:
        differs = differs | ~F.col(f"{v}_one").eqNullSafe(F.col(f"{v}_two"))
    return zipped(one, two, keys, order, values).filter(differs).select(*keys).distinct()


def coalesced(first: DataFrame, then: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of both lists with each combination of ``keys`` once: the earliest of ``first`` wins, then that of ``then``."""
    ranked = first.withColumn("list_rank", F.lit(0)).unionByName(then.withColumn("list_rank", F.lit(1)))
    best = F.row_number().over(Window.partitionBy(*keys).orderBy("list_rank", *order))
    return ranked.withColumn("best", best).filter("best = 1").drop("best", "list_rank")


def set_relations(one: DataFrame, two: DataFrame, key: str, value: str) -> DataFrame:
    """``key, shared, only_one, only_two``: how the sets of values of each key on both sides relate.

    One pass over the distinct values of both sides; subset, superset, equality and intersection follow from the counts.
    Nulls are values like any other.
    """
    both = one.select(key, value).distinct().withColumn("side", F.lit(1)).unionByName(two.select(key, value).distinct().withColumn("side", F.lit(2)))
    sides = both.groupBy(key, value).agg(F.sum("side").alias("sides"))
    count = lambda n: F.sum(F.when(F.col("sides") == n, 1).otherwise(0))
    return sides.groupBy(key).agg(count(3).alias("shared"), count(1).alias("only_one"), count(2).alias("only_two"))


def against_baseline(run: DataFrame, baseline: DataFrame, key: str, status: str) -> DataFrame:
    """``key``, status now and before, and a note: new, same or changed."""
    before = baseline.select(F.col(key).alias("old_key"), F.col(status).alias("before"))
    joined = run.join(before, F.col(key) == F.col("old_key"), "left")
    note = F.when(F.col("old_key").isNull(), "new").when(F.col(status).eqNullSafe(F.col("before")), "same").otherwise("changed")
    return joined.select(key, F.col(status).alias("now"), "before", note.alias("note"))


#: Slices into which a group's shapes are dealt, and tasks that compare them at least.
SHAPE_SLICES, SHAPE_TASKS = 16, 256


def paired_shapes(rows: DataFrame, keys: list[str], shape: list[str], key: str, fits: Callable[..., Column], one: str, other: str) -> DataFrame:
    """``one, other``: every pair of rows of equal ``keys`` whose shapes fit, as their values of ``key``; a row pairs with itself, too.

    Rows of one shape are one row of the comparison, which so grows with the shapes of a group and not with its rows:
    only pairs that fit are spelled out. A group's shapes are dealt over SHAPE_SLICES slices, each of which meets all of them, so
    that few large groups are many tasks' work. Null keys, shapes and values of ``key`` pair with nothing.
    """
    cells = rows.groupBy(*keys, *shape).agg(F.collect_list(key).alias("cell")).dropna(subset=[*keys, *shape])
    small = cells.withColumn("slice", F.pmod(F.xxhash64(*shape), F.lit(SHAPE_SLICES)))
    large = cells.select(*keys, *(F.col(c).alias(f"other_{c}") for c in shape), F.col("cell").alias("other_cell"))
    large = large.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SHAPE_SLICES - 1).cast("long"))))
    by = [*keys, "slice"]
    small, large = small.repartition(SHAPE_TASKS, *by), large.repartition(SHAPE_TASKS, *by)  # a number keeps small tables in many tasks
    met = small.hint("merge").join(large, by).filter(fits(*(F.col(c) for c in shape), *(F.col(f"other_{c}") for c in shape)))
    return met.select(F.explode("cell").alias(one), "other_cell").select(one, F.explode("other_cell").alias(other))


def not_subsequences(now: DataFrame, then: DataFrame, keys: list[str], order: str, value: str, slice_rows: int | None = None) -> DataFrame:
    """Groups of ``now`` whose values in order aren't a subsequence of those of ``then``'s group: the ``keys``, each once.

    Elements may have been dropped, not added or reordered; values may repeat, and nulls are values. Each value of
    ``now`` is matched by the next occurrence behind the match before it, which leaves most for those that follow. Both
    sides are numbered in order and stream through their group's task together, a value of ``now`` before the value of
    ``then`` at its place: no match lies before a value's own place, so what waits is what has been skipped, 16 bytes
    each. A group that ``then`` lacks is told unless it is empty in ``now``, too.
    """
    sides = []
    for turn, side in enumerate((now, then)):
        placed = Sliced.of(side.select(*keys, order, value), keys, [order], slice_rows).before(place=("count", F.lit(True))).done()
        digest = F.unhex(F.substring(F.sha2(F.to_json(F.struct(F.col(value).alias("v"))), 256), 1, 32))
        group = F.unhex(F.substring(F.sha2(F.to_json(F.struct(*(F.col(k).alias(f"k{n}") for n, k in enumerate(keys)))), 256), 1, 32))
        sides.append(placed.select(*keys, group.alias("match_group"), "place", F.lit(turn).alias("match_turn"), digest.alias("match_value")))

    def match(batches):
        waiting, group, last = deque(), None, None
        for batch in batches:
            names = batch.column("match_group").to_pylist()
            failed = []
            for at, (name, turn, digest) in enumerate(zip(names, batch.column("match_turn").to_pylist(), batch.column("match_value").to_pylist(), strict=True)):
                if name != group:
                    if waiting:
                        failed.append(last if at == 0 else batch.slice(at - 1, 1))
                    waiting, group = deque(), name
                if turn == 0:
                    waiting.append(digest)
                elif waiting and waiting[0] == digest:
                    waiting.popleft()
            if batch.num_rows:
                last = batch.slice(batch.num_rows - 1, 1)
            yield from (row.select(keys) for row in failed)
        if waiting:
            yield last.select(keys)

    both = sides[0].unionByName(sides[1]).repartition("match_group").sortWithinPartitions("match_group", "place", "match_turn")
    return both.mapInArrow(match, now.select(*keys).schema)
