"""Ordered passes over keys of any size: a key with too many rows is cut into slices of its order.

A window by key alone puts all rows of a key into one task. Here keys with more than ``slice_rows`` rows get boundaries
from an evenly spread sample of their order; a row's slice is the number of boundaries at or before it, found by
bisection in a broadcast of bounded size. Rows shuffle once, by key and slice, over tasks whose number grows with the
rows (``dealt``). A pass then runs within slices, one small
row per slice carries what the rows of earlier slices amount to, and both are put together. Every further pass over the
same slices reuses their partitioning.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a key beyond which it is cut, unless so many keys would be cut that their boundaries grow beyond the bound.
SLICE_ROWS = 1 << 20
#: Slices of all keys together at about, which bounds what is broadcast; a slice holds a share of the rows beyond that.
MOST_SLICES = 1 << 15
#: Sampled rows for each slice, of which every last one is a boundary.
SAMPLES = 16
#: Rows of a key's shuffle in one task at about.
TASK_ROWS = 1 << 19


def dealt(rows: DataFrame, n: int, *by: str) -> DataFrame:
    """``rows``, ``n`` of them, over a task per TASK_ROWS by columns, where the session's shuffles have fewer tasks than that.

    Their number is fixed, and with it a task's memory would grow with the input. Joins, windows and aggregates by the
    same columns reuse the partitioning.
    """
    tasks = math.ceil(n / TASK_ROWS)
    return rows if tasks <= int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows.repartition(tasks, *by)


def _equal(one: DataFrame, two: DataFrame, keys: list[str], others: list[str]) -> Column:
    out = F.lit(True)
    for k, other in zip(keys, others, strict=True):
        out = out & one[k].eqNullSafe(two[other])
    return out


class Sliced:
    """Rows with the column ``slice``: -1 for keys in one piece, else the slice's place in the order of its key."""

    def __init__(self, rows: DataFrame, keys: list[str], order: list[str], cut: bool):
        self.rows, self.keys, self.order, self.cut = rows, keys, order, cut

    @classmethod
    def of(cls, rows: DataFrame, keys: list[str], order: list[str], slice_rows: int | None = None) -> Sliced:
        """``rows`` cut by ``order`` (ascending, nulls first); rows of equal order stay in one slice.

        Rows are counted by key right away. ``order`` should tell rows apart: where it doesn't, the order within equal
        rows is open, and a key whose rows are all equal isn't cut.
        """
        sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("slice_n"))
        largest, total = sizes.agg(F.max("slice_n"), F.sum("slice_n")).first()
        limit = max(slice_rows or SLICE_ROWS, math.ceil((total or 0) / MOST_SLICES))
        if (largest or 0) <= limit:
            return cls(dealt(rows, total or 0, *keys).withColumn("slice", F.lit(-1)), keys, order, False)
        names = [f"slice_key{n}" for n in range(len(keys))]
        large = sizes.filter(F.col("slice_n") > limit).select(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)))
        step = max(1, limit // SAMPLES)
        spread = rows.filter(F.pmod(F.xxhash64(*keys, *order), F.lit(step)) == 0)
        at = F.struct(*order)
        found = spread.join(F.broadcast(large), _equal(spread, large, keys, names)).groupBy(*names).agg(F.array_sort(F.collect_list(at)).alias("sample"))
        each = min(SAMPLES, limit)
        bounds = found.select(*names, F.array_distinct(F.filter("sample", lambda _, n: n % each == each - 1)).alias("slice_bounds"))
        kept = rows.sparkSession.createDataFrame(bounds.collect(), bounds.schema)  # at most about 2 * MOST_SLICES boundaries
        longest = kept.agg(F.max(F.size("slice_bounds"))).first()[0] or 0
        steps = [1 << k for k in range(max(1, longest).bit_length() - 1, -1, -1)]
        marked = rows.join(F.broadcast(kept), _equal(rows, kept, keys, names), "left")
        place = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda done, s: F.when(F.get("slice_bounds", done + s - 1) <= at, done + s).otherwise(done))
        number = F.when(F.col("slice_bounds").isNull(), -1).otherwise(place)
        return cls(dealt(marked.withColumn("slice", number).drop(*names, "slice_bounds"), total, *keys, "slice"), keys, order, True)

    def before(self, **passes: tuple[str, Column]) -> Sliced:
        """The rows with a column per pass: what ``(kind, value)`` amounts to over the rows of the key strictly before each.

        Kinds: ``count`` of rows where the value holds, ``sum`` (0 without rows), ``max`` and ``last`` (null without
        values; nulls are skipped). A struct around a value lets ``last`` see nulls, too.
        """
        added = self.rows.withColumns({f"slice_{n}": _operand(kind, value) for n, (kind, value) in passes.items()})
        by = Window.partitionBy(*self.keys, "slice").orderBy(*self.order).rowsBetween(Window.unboundedPreceding, -1)
        local = added.withColumns({n: _over(kind, F.col(f"slice_{n}"), by) for n, (kind, _) in passes.items()})
        if self.cut:
            names = [f"slice_key{n}" for n in range(len(self.keys))]
            whole = added.filter("slice >= 0").groupBy(*self.keys, "slice").agg(*(_total(kind, F.col(f"slice_{n}"), self.order).alias(n) for n, (kind, _) in passes.items()))
            earlier = Window.partitionBy(*self.keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
            carried = whole.select(*(F.col(k).alias(n) for k, n in zip(self.keys, names, strict=True)), F.col("slice").alias("slice_at"), *(_over("sum" if kind == "count" else kind, F.col(n), earlier).alias(f"carry_{n}") for n, (kind, _) in passes.items()))
            # A row per slice, about 2 * MOST_SLICES at most.
            local = local.join(F.broadcast(carried), _equal(local, carried, [*self.keys, "slice"], [*names, "slice_at"]), "left")
            local = local.withColumns({n: _joined(kind, F.col(n), F.col(f"carry_{n}")) for n, (kind, _) in passes.items()})
            local = local.drop(*names, "slice_at", *(f"carry_{n}" for n in passes))
        return Sliced(local.drop(*(f"slice_{n}" for n in passes)), self.keys, self.order, self.cut)

    def done(self) -> DataFrame:
        return self.rows.drop("slice")


def _operand(kind: str, value: Column) -> Column:
    return F.when(value, 1).otherwise(0).cast("long") if kind == "count" else value


def _over(kind: str, value: Column, by) -> Column:
    if kind in ("count", "sum"):
        return F.coalesce(F.sum(value).over(by), F.lit(0))
    return F.max(value).over(by) if kind == "max" else F.last(value, ignorenulls=True).over(by)


def _total(kind: str, value: Column, order: list[str]) -> Column:
    if kind in ("count", "sum"):
        return F.sum(value)
    return F.max(value) if kind == "max" else F.max_by(value, F.when(value.isNotNull(), F.struct(*order)))


def _joined(kind: str, local: Column, carried: Column) -> Column:
    if kind in ("count", "sum"):
        return local + F.coalesce(carried, F.lit(0))
    return F.greatest(local, carried) if kind == "max" else F.coalesce(local, carried)
